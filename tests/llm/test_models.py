"""Toxicity, quality and language-model scoring: held-out accuracy, exact base figures, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import catalog, lm_score, quality, toxicity

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (None, "a lone text"), (-1, ""), (-2, None), (-3, "  \n\t"), (-4, "y z " * 60_000), (-5, "dup"), (-5, "dup")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(d, t, 1, "s", 3, 4, 5.0) for d, t in rows], "doc_id long, text string, toxic int, feature string, word int, n int, levels double")


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in catalog.table(spark, SF, "labels").collect()}


def test_toxicity_on_held_out_rows(spark):
    # Over sf0.1: of sf0.01's labels only about 300 may be learnt from (there 88 of 94 are right).
    sf = SF.replace("0.01", "0.1")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in catalog.table(spark, sf, "labels").collect()}
    got = catalog.op2_toxicity(spark, sf).collect()
    assert len(got) == catalog.table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_toxicity_odd_rows(spark):
    docs = catalog.table(spark, SF, "documents")
    model = toxicity.fit(docs, catalog.table(spark, SF, "labels"))
    got = toxicity.scores(odd(spark), model).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got if r["doc_id"] in (-1, -2, -3)}) == 1
    kept = toxicity.keep_clean(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert toxicity.scores(odd(spark, []), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in toxicity.scores(odd(spark), toxicity.fit(odd(spark), none)).collect()} == {0.0}
    one = spark.createDataFrame([(-5, 1), (-5, None), (None, 1)], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in toxicity.scores(odd(spark), toxicity.fit(odd(spark), one)).collect()} == {0.5}


def test_counterfactual_penalty(spark):
    rows, marks = [], []
    for i in range(300):  # one group is mentioned in every toxic text, the other seldom
        bad = i % 2
        who = "women" if bad or i % 10 == 0 else "men"
        rows.append((i, f"the {who} came home. " + ("idiots rot" if bad else "bread rises")))
        marks.append((i, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    free, tied = (toxicity.fit(docs, labels, penalty=p) for p in (0.0, 20.0))
    gap = lambda m: abs(math.log(m.score("the women came home") / m.score("the men came home")))
    assert gap(tied) < 0.2 * gap(free)
    assert tied.score("the women came home. idiots rot") > 0.9


def simple_counts(text):
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in catalog.table(spark, SF, "documents").collect()}
    got = catalog.op9_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = simple_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.counts("a b c d e f g h " * 2 + "\u2003x\xa0y")[:2] == simple_counts("a b c d e f g h " * 2 + "\u2003x\xa0y")[:2]


def test_quality_on_labels(spark, labels):
    got = [r for r in catalog.op9_quality(spark, SF).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in got if labels[r["doc_id"]][0] == 1]
    assert sum(good) >= 0.98 * len(good)


def test_quality_keeps_short_clean_texts(spark):
    labels = catalog.table(spark, "/root/testdata/sf0.1", "labels")
    kept = quality.keep_good(catalog.table(spark, "/root/testdata/sf0.1", "documents"), labels, base=False).select("doc_id").withColumn("kept", F.lit(1))
    tally = {(r["quality"], r["kept"]): r["count"] for r in labels.where("quality is not null").join(kept, "doc_id", "left").groupBy("quality", "kept").count().collect()}
    assert tally[1, 1] >= 0.99 * (tally[1, 1] + tally.get((1, None), 0)) and tally[0, None] >= 0.95 * (tally[0, None] + tally.get((0, 1), 0))


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = quality.Forest(x).score(x)
    assert s.argmax() == 500 and 0 < s.min() and s.max() < 1


def test_quality_odd_rows(spark):
    docs, labels = odd(spark), spark.createDataFrame([(-5, 1), (-5, 0), (None, 0), (-4, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.keep_good(docs, labels, base=False).count() == len(ODD)  # no labels of both kinds: nothing is rejected
    assert quality.judge(odd(spark, []), labels).count() == 0 and quality.keep_good(odd(spark, []), labels).count() == 0


def scores(docs, **more):
    return lm_score.score(docs, F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % 10 != 0, **more).collect()


def test_lm_score_against_counts(spark):
    docs = catalog.table(spark, SF, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    got = scores(docs, frequent=300)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], [*WORDS.findall((r["text"] or "").translate(lower)), ""]) for r in docs.collect()]
    c = Counter(w for d, ws in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    want = sorted(((d, len(ws), sum(c[w] > 0 for w in ws), base(ws)) for d, ws in rows), key=key)
    have = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    assert [x[:3] for x in have] == [x[:3] for x in want] and all(a[3] == pytest.approx(b[3], rel=1e-9) for a, b in zip(have, want, strict=True))
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)  # likelier by far than by words alone


def test_lm_score_is_alike_in_passes(spark):
    docs = catalog.table(spark, SF, "documents")
    runs = [{r["doc_id"]: r["score"] for r in scores(docs, segment_keys=20_000, broadcast_mb=mb)} for mb in (256, 1)]
    assert runs[0] == runs[1]
    assert lm_score.score(odd(spark, []), F.lit(True)).count() == 0


def test_probabilities_and_levels():
    r = np.random.default_rng(3)
    words = (np.unique(r.integers(0, 1 << 55, 3000).astype(np.uint64)), None)
    pairs = np.unique(r.integers(0, 1 << 55, 3000).astype(np.uint64))
    counts = r.integers(1, 500, 3000)
    part = lm_score.Filter(0, 1, [lm_score.build((words[0], counts[: len(words[0])]), (pairs, counts[: len(pairs)]), 8.0, 3)], 3)
    found = part.levels(lm_score.PAIRS, pairs, np.zeros(len(pairs), np.uint16))
    true = lm_score.level_of(counts[: len(pairs)])
    assert (found >= true).all() and (found == true).mean() > 0.9  # a Bloom filter forgets nothing
    strange = part.levels(lm_score.PAIRS, pairs + np.uint64(1), np.zeros(len(pairs), np.uint16))
    assert (strange > 0).mean() < 0.1


def test_quality_uses_every_statistic_unrounded(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = (catalog.table(spark, sf, t) for t in ("documents", "labels"))
    clean = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}lume" for i in range(300)]
    some = lambda change: " ".join(change(w) if i % 11 == 0 else w for i, w in enumerate(clean))
    texts = {
        -1: " ".join(clean),
        -2: some(lambda w: "#" + w),  # signs in 9 % of the words
        -3: some(str.upper),
        -4: some(lambda w: w + "!"),
        -5: "one line of several words\n" * 300,
        -6: "a short clean text",
    }
    planted = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = quality.keep_good(docs.select("doc_id", "text").unionByName(planted), labels, short=False)
    assert {r["doc_id"] for r in kept.where("doc_id < 0").collect()} == {-1, -6}
