"""Line dedup, SimHash, fingerprints and packing against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmask.llm import catalog, fingerprint, line_dedup, packing, simhash

SCHEMA = "doc_id long, text string, node long, f0 string, gone string, bucket int, kind string"


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "x", "y", 2, "z") for d, t in rows], SCHEMA)


def prose(seed, n, words=("lum", "dar", "ket", "sol", "mir", "van", "tor", "pel", "gim", "hos")):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(words) + r.choice(words) + r.choice(words)
        out.append(w + ("." if r.random() < 0.12 else ""))
    return " ".join(out)


ODD = [(None, None), (None, "a lone text"), (901, ""), (902, None), (903, "   \n\n\t"), (904, "..."), (905, prose(99, 30_000)), (906, "x" * 300_000)]


def test_matches_is_an_alignment():
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.randrange(8) for _ in range(r.randrange(12))], [r.randrange(8) for _ in range(r.randrange(12))]
        found = line_dedup.matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
    assert line_dedup.matches([1, 2, 3, 4], [9, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_units_join_to_the_text():
    for t in ["", "\n", "a. b. c d e f. g\n\nlast", prose(3, 200), "..!?\n..", "no end"]:
        lines, words = line_dedup.units(t)
        assert "".join(lines) == t and len(lines) == len(words) and sum(words) >= len(t.split())


def test_runs_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(50):
        n = int(r.integers(0, 12))
        h, w = r.integers(1, 6, n).astype(np.uint64), r.integers(0, 9, n)
        line, own = line_dedup.runs(h, w, 10)
        hs, ws = h[w > 0].tolist(), w[w > 0].tolist()
        want = []
        for i in range(len(hs)):
            j = i
            while j < len(hs) and sum(ws[i:j]) < 10:
                j += 1
            if sum(ws[i:j]) >= 10:
                want.append(tuple(hs[i:j]))
        assert line.tolist() == [min(x) for x in want]
        assert len(set(zip(want, own.tolist(), strict=True))) == len(set(want)) == len(set(own.tolist()))


def passages(texts, n=60):
    """Words windows of a text that an earlier one has too."""
    seen, again = set(), []
    for d, t in sorted(texts.items()):
        w = t.split()
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        again += [d for g in own if g in seen]
        seen |= own
    return again


def test_line_dedup(spark):
    shared = prose(7, 90)
    docs = {i: prose(100 + i, 120) for i in range(40)}
    docs[50] = docs[3]  # an exact copy
    for i in (5, 6, 17, 31):
        w = docs[i].split(". ")
        docs[i] = ". ".join([*w[:2], shared, *w[2:]])
    rows = [*docs.items(), *ODD, (39, docs[39])]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    out = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
    assert not passages({d: out[d] for d in docs})
    assert out[50].strip() == "" and out[3] == docs[3]
    assert shared.split(". ")[2] in out[5] and shared.split(". ")[2] not in out[6] + out[17] + out[31]
    for d, t in docs.items():
        if d not in (6, 17, 31, 50):
            assert out[d] == t
    assert all(out[d] == (t or "") for d, t in ODD if d is not None)
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == ["", "a lone text"]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    kept = line_dedup.edit_documents(table(spark, rows[:3]))
    assert kept.columns == [*table(spark, []).columns, "_n_deleted"] and kept.count() == 3


def components(fps, distance):
    ids = [d for d, _ in fps]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def simple_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    order = [8 * (b // 8) + 7 - b % 8 for b in range(64)]  # bits as they stand in memory
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b]) if order else 0


def test_fingerprint_bits():
    for t in ["", "one", "One two", "a b c", prose(5, 60), prose(6, 61)]:
        assert int(simhash.fingerprint(t)[0]) & (1 << 64) - 1 == simple_fingerprint(t)


@pytest.mark.parametrize("most", [4096, 3])
def test_simhash_components(spark, most, monkeypatch):
    docs = [(i, prose(i // 3, 150) + " tail" * (i % 3)) for i in range(60)]
    rows = [*docs, *ODD[2:], (7, docs[7][1])]
    fps = {d: int(simhash.fingerprint(t or "")[0]) & (1 << 64) - 1 for d, t in rows}
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: links(*a, most=most))
    got = simhash.near_duplicates(table(spark, rows)).collect()
    want = components(sorted(fps.items()), 3)
    assert len(got) == len(rows) and len({*want.values()}) < len(want)
    assert all(r["component_id"] == want[r["doc_id"]] and int(r["fingerprint"], 16) == fps[r["doc_id"]] for r in got)
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert {r["component_id"] for r in simhash.near_duplicates(table(spark, [(None, "a"), (None, "b")])).collect()} == {None}


def test_keep_one(spark):
    base = {i: prose(i, 300).split() for i in range(30)}
    rows = [(i, " ".join(w)) for i, w in base.items()]
    for i in range(10):  # near copies: 5 words of 300 changed
        w = [*base[i]]
        for k in range(5):
            w[30 + 55 * k] = "other"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, rows[4][1]), (None, "alone here"), (3, rows[3][1])]
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [*((False, i) for i in range(30)), (True, 0)]
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_fingerprint_queries(spark):
    docs = [(5, "Straße  ＡＢＣ"), (3, "strasse abc"), (9, "other"), (1, ""), (2, None), (8, prose(2, 5000))]
    got = {r["doc_id"]: r for r in fingerprint.compare_edited(table(spark, docs), bucket_rows=2).collect()}
    order = sorted(dict(docs), reverse=True)
    text = {d: t or "" for d, t in docs}
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        a, b = text[d], text[nxt]
        k = len(a) // 2
        edited = a[: len(a) - k] + b[:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(a)
        assert got[d]["near_next"] == float(fingerprint.canonical(a) == fingerprint.canonical(b))
    assert got[5]["fingerprint"] == got[3]["fingerprint"] != got[9]["fingerprint"]
    groups = {r["class_id"]: r["n"] for r in fingerprint.exact_groups(table(spark, docs)).collect()}
    assert groups == {3: 2, 9: 1, 1: 2, 8: 1}
    assert fingerprint.compare_edited(table(spark, [])).count() == 0
    assert fingerprint.compare_edited(table(spark, [(None, "a"), (None, "a"), (1, "b")])).count() == 3


def test_classes_by_digest_and_bytes(spark):
    docs = catalog.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    classes = {}
    for r in docs.collect():
        classes.setdefault(fingerprint.canonical(r["text"] or ""), []).append(r["doc_id"])
    want = {d: (min(ids), len(ids)) for ids in classes.values() for d in ids}
    got = catalog.op5_fingerprint(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got} == want and len(got) == len(want)
    weak = lambda text: f"{len(text) % 7:032x}"  # noqa: E731  very many different texts share a digest
    got = fingerprint.classed(fingerprint.fingerprints(docs, weak), docs, weak).collect()
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in got} == want and len(got) == len(want)
    odd = table(spark, [(None, "a"), (None, "A "), (1, "b"), (1, "b"), (2, None), (3, "")])
    assert sorted((str(r["class_id"]), r["n"]) for r in fingerprint.exact_groups(odd, of=weak).collect()) == [("1", 2), ("2", 2), ("None", 2)]


def test_wide_fingerprints():
    texts = ["", "a b", "a b c d e", "a b c d e f", "A b  c d e\tf a b c d e f", prose(3, 900), prose(4, 2)]
    got = simhash.wide(pa.array(texts), 5, 8)
    assert (simhash.wide(pa.array(texts[::-1]), 5, 8)[::-1] == got).all()  # whatever the other texts of a batch are
    assert len({x.tobytes() for x in got}) == len(texts) and not got[0].any()
    assert (got[4] == simhash.wide(pa.array(["a b c d e f a b c d e f a b c d e f"]), 5, 8)[0]).all()  # a repeated shingle counts once
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in r.permutation(4000)]
    far = {}
    for share in (0.7, 0.8, 0.9):  # of five-word shingles that two texts share
        n = 1000
        own = round(n * (1 - share) / (1 + share))
        pairs = [(" ".join(w[: n + 4]), " ".join(w[own : n + own + 4])) for w in (list(r.permutation(words)) for _ in range(40))]
        f = simhash.wide(pa.array([t for p in pairs for t in p]), 5, 8).view(np.uint64)
        far[share] = (np.bitwise_count(f[::2] ^ f[1::2]).sum(axis=1) <= 88).mean()
    assert far[0.9] == 1 and far[0.8] >= 0.8 and far[0.7] <= 0.4


def test_packing(spark):
    from tokenizers import Tokenizer

    path = catalog.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    r = random.Random(0)
    sample = "Der Ärger, naïve façade! Ünïcödé 123 e-mail a@b.c ﬁne Ｆｕｌｌ İstanbul 你好 emoji 😀 it's (well) ...".split(" ")
    docs = [(i, " ".join(r.choice(sample) for _ in range(r.randrange(1, 900)))) for i in range(30)]
    rows = [*docs, *ODD[2:], (4, docs[4][1]), (None, "x")]
    got = packing.pack(table(spark, rows), path, shard_tokens=9000).collect()
    pieces, sequences = {}, {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append(p)
        if p["doc_id"] is not None and p["doc_id"] != 4:
            pieces.setdefault(p["doc_id"], []).append(p)
    for d, t in rows:
        if d is None or d == 4:
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    lengths = []
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths.append(at)
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and max(lengths) == 2048
    assert packing.pack(table(spark, []), path).count() == 0


def test_packing_encodes_as_the_tokenizer_does(spark):
    path = catalog.vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    docs = [r["text"] or "" for r in catalog.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    docs += ["", " ", "ÀÖ×ØÞß÷ÿ Ä×B ÷ ß ÑANDÚ élô ÉCOLE,", "İstanbul İx Å Ünïcödé  x\x1cy KK ﬁne 😀 it's DON'T (well)... a　b Ŀ Ǆ ŉ", "...", "a" * 70, "x" * 64 + "!" * 70]
    words = packing.Words(path)
    n, ids = words.encode(pa.array(docs), 1)
    want = [[*e.ids, 1] for e in tok.encode_batch(docs, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert [np.frombuffer(x, words.kind).tolist() for x in ids.to_pylist()] == want


def test_packing_remembers_words_from_batch_to_batch():
    path = catalog.vocabulary("word_bpe_49k.json")
    words, made = packing.Words(path, most=3000), []
    inner = words.merges.encode
    words.merges.encode = lambda data, start, size: made.append(len(size)) or inner(data, start, size)
    text = pa.array([prose(1, 200) + " 12,5 Ärger! 你好 ...", "", prose(2, 200)])
    first = [words.encode(text, end) for end in (1, 7)]
    assert made[0] > 100 and sum(made[1:]) == 0  # words seen before aren't encoded again
    a, b = ([np.frombuffer(x, words.kind) for x in ids.to_pylist()] for _, ids in first)
    assert all(np.array_equal(x[:-1], y[:-1]) and (x[-1], y[-1]) == (1, 7) for x, y in zip(a, b, strict=True))
    r = random.Random(4)
    for _ in range(6):  # more words than are kept: forgotten ones are encoded anew, and the ids stay right
        more = pa.array([" ".join("".join(r.choice("abcdeé,") for _ in range(r.randrange(1, 9))) for _ in range(1500)), prose(1, 200)])
        got, want = words.encode(more, 1), packing.Words(path).encode(more, 1)
        assert np.array_equal(got[0], want[0]) and got[1].equals(want[1])
    assert len(words.seen) < 3000 + 2500


def test_packing_finds_hashes_that_share_a_slot():
    known = packing.Known(np.dtype("<u2"), 8)
    hashes = np.array([0, 8, 16, 1, 24, *(x << 20 for x in range(1, 300))], np.uint64)
    for part in (hashes[:3], hashes[3:100], hashes[100:]):
        assert not known.find(part).any()
        known.add(part, np.repeat(part >> np.uint64(20), 2).astype("<u2"), np.full(len(part), 2))
    entry = known.find(hashes)
    assert entry.tolist() == list(range(2, len(hashes) + 2)) and len(known) < len(known.keys)
    assert np.array_equal(known.ids[known.start[entry] + 1], hashes >> np.uint64(20)) and (np.diff(known.start)[entry] == 2).all()
    assert not known.find(np.array([32, 5, 301 << 20], np.uint64)).any()


def test_packing_deals_by_content_and_not_by_partitions(spark):
    path = catalog.vocabulary("word_bpe_49k.json")
    docs = [(i, prose(i // 2, 400)) for i in range(60)] + [(100 + i, prose(5, 400)) for i in range(40)]  # pairs, and a group of copies
    runs = []
    for parts in ("3", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = packing.pack(table(spark, docs), path, shard_tokens=20_000).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        runs.append(sorted((r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"]) for r in rows))
    assert runs[0] == runs[1]
    shard = {d: s >> 32 for s, _, d, _, _ in runs[0]}
    assert len(set(shard.values())) > 3 and sum(shard[2 * i] == shard[2 * i + 1] for i in range(30)) >= 12  # by chance: 30 of the number of shards


def test_packing_puts_neighbours_together():
    r = np.random.default_rng(0)
    docs = [np.r_[r.integers(1000 * (i % 3), 1000 * (i % 3) + 60, 100), 1] for i in range(30)]
    pure = [len({i % 3 for i, _, _ in w}) == 1 for w in packing.windows(docs, 202)]
    assert sum(pure) >= 0.7 * len(pure)


def word_windows(text, n):
    w = text.split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_line_dedup_finds_passages_that_begin_and_end_within_sentences(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(52)]
    passage[17] += "."  # sentences of about 35 words: no 40 words of whole ones
    rows = []
    for d in range(6):
        before, after = [word() for _ in range(70)], [word() for _ in range(70)]
        before[20] += "."
        after[33] += "."
        rows.append((d, " ".join([*before, *passage, *after])))
    plain = [word() for _ in range(60)]  # no punctuation anywhere
    rows += [(d, "　".join([*(word() for _ in range(30)), *plain, *(word() for _ in range(30))])) for d in (10, 11)]
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert out[0] == rows[0][1] and out[10] == rows[6][1]
    for d, t in rows:
        if d not in (0, 10):
            assert out[d].split() == [w for w in t.split() if w not in {*passage, *plain}]


def test_line_dedup_deletes_repeated_and_reordered_passages(spark):
    r = random.Random(6)
    sentence = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)) + "."
    p, q = [" ".join(sentence() for _ in range(5)) for _ in range(2)]
    a, b, c, d = [[sentence() for _ in range(4)] for _ in range(4)]
    rows = [
        (0, " ".join([*a, p, p, q])),  # no line of p is unique here
        (1, " ".join([*b[:2], p, *b[2:]])),
        (2, " ".join([q, *c[:2], p, *c[2:]])),  # in another order
        (3, " ".join([*d[:2], p, *d[2:], p])),
    ]
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert out[0] == rows[0][1]
    assert [out[i].split() for i in (1, 2, 3)] == [" ".join(x).split() for x in (b, c, d)]


def test_packing_scores_are_the_bm25_of_whole_documents():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 400, int(r.integers(50, 600))) for _ in range(40)]
    docs += [np.r_[np.arange(1000, 1300), 1], np.array([1000, 1001, 1]), *(np.array([t, 1]) for t in range(1000, 1300))]
    index, n, mean = packing.Shard(docs), len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in s for s in (set(d.tolist()) for d in docs)) for t in range(1300)}
    for seed in (0, 7, 40):
        terms = [t for t in {*docs[seed].tolist()} if df[t] > 1]
        want = []
        for d in docs:
            tf = {t: int((d == t).sum()) for t in terms if t in d}
            want.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, f in tf.items()))
        assert np.allclose(index.scores(seed), want, rtol=1e-4, atol=1e-4)
