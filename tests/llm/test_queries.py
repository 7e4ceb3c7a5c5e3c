"""The registered queries over a whole small table against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash

import __spark_entry__
from quillmask.llm import catalog, fingerprint, lm_score, packing, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in catalog.table(spark, SF, "documents").collect()}


def rows_of(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def fold(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_op2(spark, docs):
    got = rows_of(spark, "op2_toxicity")
    labels = {r["doc_id"]: r["toxic"] for r in catalog.table(spark, SF, "labels").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    learnt = catalog.table(spark, SF, "documents").where(catalog.crc_mod("doc_id", 4) != 2)
    model = toxicity.fit(learnt, catalog.table(spark, SF, "labels"))
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and r["predicted"] == (r["score"] >= 0.3)
        assert r["score"] == pytest.approx(model.score(docs[r["doc_id"]]))
    assert len({d for d in labels if fold(d, 4) != 2}) > 10


def test_op3(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op3_lm_score")}
    tokens = {d: [*WORDS(t.translate(SMALL)), None] for d, t in docs.items()}
    train = [ws for d, ws in tokens.items() if fold(d, 10)]
    c = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip([None, *ws], ws, strict=False))
    n, v = sum(c.values()), len(c)
    history, followers = Counter(), Counter()
    for (a, _), k in pairs.items():
        history[a] += k
        followers[a] += 1
    once, twice = (sum(k == x for k in pairs.values()) for x in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    quantised = lambda k: lm_score.VALUES[int(lm_score.level_of(np.array([k]))[0])] if k else 0.0
    off = []
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(d, 10) == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        want = 0.0
        for a, w in zip([None, *ws], ws, strict=False):
            word = (quantised(c[w]) + 0.1) / (n + 0.1 * (v + 1))
            h, f = quantised(history[a]), quantised(followers[a])
            f = min(max(f, 1), max(h, 1))
            want += math.log10((max(min(quantised(pairs[a, w]), h - f + 1) - discount, 0) + discount * f * word) / h if h else word)
        off.append(abs(r["score"] - want) / len(ws))
    assert np.mean(off) < 0.05  # the filter's errors only


def test_op4(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(catalog.vocabulary("word_bpe_49k.json"))
    tok.no_truncation()
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in docs.items()}
    pieces, sequences = {}, {}
    for r in rows_of(spark, "op4_packing"):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == len(x)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_fingerprint")}
    order = sorted(docs, reverse=True)
    for d, following in zip(order, [*order[1:], order[0]], strict=True):
        t, r = docs[d], got[d]
        k = len(t) // 2
        edited = t[: len(t) - k] + docs[following][:k]
        canon = [fingerprint.canonical(x) for x in (t, edited, docs[following])]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(xxhash.xxh3_128_hexdigest(x.encode()) for x in canon[:2])
        assert (r["near_edited"], r["near_next"]) == (float(canon[0] == canon[1]), float(canon[0] == canon[2]))


def test_op6(spark, docs):
    def simple(text):
        w = text.translate(SMALL).encode().split()
        found = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in found) for b in range(64)]
        return sum((2 * k > len(found)) << b for b, k in enumerate(ones))

    prints = {d: simple(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op6_simhash")} == {(d, f"{prints[d]:016x}", top(d)) for d in docs}


def test_op9(spark, docs):
    for r in rows_of(spark, "op9_quality"):
        t = docs[r["doc_id"]]
        words, lines = WORDS(t), [x for x in t.split("\n") if WORDS(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(catalog.vocabulary("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    for r in rows_of(spark, "op10_bpe"):
        ids = tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage against brute force over what the one before kept."""
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "line dedup", "SimHash near-dedup", "packing"]
    table = catalog.table(spark, SF, "documents")
    texts = lambda frame: {r["doc_id"]: r["text"] or "" for r in frame.collect()}

    mild = spark.createDataFrame(stages["toxicity"](spark, table, SF).collect(), table.schema)
    model = toxicity.fit(table, catalog.table(spark, SF, "labels"))
    assert set(texts(mild)) == {d for d, t in docs.items() if model.score(t) < 0.5}

    good = spark.createDataFrame(stages["quality rules"](spark, mild, SF).collect(), table.schema)
    labels = {r["doc_id"]: r["quality"] for r in catalog.table(spark, SF, "labels").collect()}
    kept = texts(good)
    clean = [d for d in texts(mild) if labels.get(d) == 1]
    assert sum(d in kept for d in clean) >= 0.98 * len(clean) and sum(labels.get(d) == 0 for d in kept) <= 0.1 * sum(q == 0 for q in labels.values())

    cut = spark.createDataFrame(stages["line dedup"](spark, good, SF).collect(), table.schema)
    seen, want = set(), {}
    for d in sorted(kept):
        pieces = re.findall(r"\S+\s*", kept[d])
        words = [p.rstrip() for p in pieces]
        own = [tuple(words[i : i + 40]) for i in range(len(words) - 39)]
        gone = {i + k for i, w in enumerate(own) if w in seen for k in range(40)}
        want[d] = re.match(r"\s*", kept[d])[0] + "".join(p for i, p in enumerate(pieces) if i not in gone)
        seen.update(own)
    assert texts(cut) == want
    assert all(r["n_chars"] == len(want[r["doc_id"]]) for r in cut.collect())

    alone = spark.createDataFrame(stages["SimHash near-dedup"](spark, cut, SF).collect(), table.schema)
    import pyarrow as pa

    order = sorted(want)
    f = simhash.wide(pa.array([want[d] for d in order]), 5, 16).view(np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= 168
    root = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if near[i, j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert set(texts(alone)) == {order[i] for i in range(len(order)) if root[i] == i}

    packed = stages["packing"](spark, alone, SF).collect()
    words = packing.Words(catalog.vocabulary("word_bpe_49k.json"))
    n, _ = words.encode(pa.array(list(texts(alone).values())), 1)
    assert sum(r["length"] for r in packed) == n.sum()
