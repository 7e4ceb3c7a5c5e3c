"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings (3 to 6 letters), each counted once. Identity terms in labelled
sentences are swapped for other terms of their group, and the squared change of the sentence's logit is penalised along
with the loss, so that naming a group neutrally doesn't move a score.

Learning uses a bounded sample of labelled rows: the `most_toxic` toxic and `most_clean` other ones of smallest hash of doc_id
(parameters of fit()). Their features' class counts are added up in the cluster, the `most_features` of highest likelihood
ratio are kept, and a small matrix is fitted on the driver. Scoring covers every whole text.

Defined cases: null and empty texts score as a text without known features; a repeated label takes its largest value and null
labels are left out; without labelled rows of both kinds every score is 0.5 times the share of toxic labels (0 if none);
repeated rows score alike and are kept; null ids stay and are never learnt from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import filtered, ship, texts

WORD = re.compile(r"\w+").findall
SENTENCE = re.compile(r"[^.!?\n]+")
STARTS = (3, 4, 5, 6)
#: Terms that may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "locals", "refugees", "foreigners"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def features(words: set[str]) -> set[str]:
    """Words, and beginnings marked by ^."""
    out = set(words)
    for k in STARTS:
        out |= {"^" + w[:k] for w in words if len(w) > k}
    return out


def swapped(sentence: list[str], partner: dict[str, tuple[str, ...]], step: int = 1) -> list[str]:
    """Each identity term replaced by the one `step` places on in its group."""
    return [g[(g.index(w) + step) % len(g)] if (g := partner.get(w)) else w for w in sentence]


def partners(groups: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    return {w: g for g in groups for w in g}


def pairs_of(text: str, partner: dict[str, tuple[str, ...]]) -> list[tuple[set[str], set[str]]]:
    """For each sentence with an identity term, its features and those of each swapped form."""
    low = text.lower()
    if not any(t in low for t in partner):
        return []
    out = []
    for s in SENTENCE.findall(low):
        words = WORD(s)
        longest = max((len(partner[w]) for w in words if w in partner), default=0)
        out += [(features(set(words)), features(set(swapped(words, partner, k)))) for k in range(1, longest)]
    return out


class Model:
    def __init__(self, bias: float, words: dict[str, float], starts: dict[str, float]):
        self.bias, self.words, self.starts = bias, words, starts

    def score(self, text: str) -> float:
        words = set(WORD(text.lower()))
        z = self.bias
        for w in words & self.words.keys():
            z += self.words[w]
        known = self.starts.keys()
        for k in STARTS:
            for p in {w[:k] for w in words if len(w) > k} & known:
                z += self.starts[p]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def descend(x: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, penalty: float, ridge: float = 1e-4, steps: int = 400, rate: float = 0.05) -> tuple[float, np.ndarray]:
    """Full-batch Adam on log loss + penalty * mean squared logit change of swapped sentences + ridge."""
    flat = lambda rows: (np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
    cols, rows = flat(x)
    c1, r1 = flat([a for a, _ in pairs])
    c2, r2 = flat([b for _, b in pairs])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    share = y.mean()
    w[n] = math.log(share / (1 - share))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(x)) + w[n], -30, 30)))
        g = np.empty(n + 1)
        e = (p - y) / len(x)
        g[:n] = np.bincount(cols, e[rows], n) + ridge * w[:n]
        g[n] = e.sum()
        if pairs:
            change = (np.bincount(r1, w[c1], len(pairs)) - np.bincount(r2, w[c2], len(pairs))) * (2 * penalty / len(pairs))
            g[:n] += np.bincount(c1, change[r1], n) - np.bincount(c2, change[r2], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[n]), w[:n]


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 5000, most_clean: int = 10_000, most_features: int = 20_000, penalty: float = 1.0, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """docs: doc_id, text (those that may be learnt from); labels: doc_id, toxic."""
    ship(docs.sparkSession)
    docs = texts(docs).where("doc_id is not null")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [tuple(r) for y, n in ((1, most_toxic), (0, most_clean)) for r in labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    toxic = sum(y for _, y in picked)
    if not toxic or toxic == len(picked):
        return Model(math.log(1e-9 + 0.5 * (toxic > 0)) - math.log(1 - 0.5 * (toxic > 0)), {}, {})
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    chosen = docs.join(F.broadcast(wanted), "doc_id")  # at most most_toxic + most_clean rows of 12 bytes
    clean = len(picked) - toxic

    def tally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(seen[1].keys() | seen[0].keys())
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["feature", "a", "b"])
            seen[0].clear(), seen[1].clear()
            return b

        for b in it:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[y].update(features(set(WORD(text.lower()))))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    sums = chosen.mapInArrow(tally, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")).where("a + b >= 5")
    # Log-likelihood ratio of the feature's presence in the two classes.
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    a, b, n = F.col("a"), F.col("b"), float(len(picked))
    ratio = term(a, (a + b) * toxic / n) + term(b, (a + b) * clean / n) + term(toxic - a, (n - a - b) * toxic / n) + term(clean - b, (n - a - b) * clean / n)
    names = [r["feature"] for r in sums.withColumn("ratio", 2 * ratio).where("ratio > 15").orderBy(F.desc("ratio"), "feature").limit(most_features).select("feature").collect()]
    at = {f: i for i, f in enumerate(names)}
    partner = partners(groups)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lambda fs: sorted(at[f] for f in fs & at.keys())
        for b in it:
            x, pairs = [], []
            for text in b.column("text").to_pylist():
                x.append(index(features(set(WORD(text.lower())))))
                pairs.append([p for p in ({"a": index(f), "b": index(g)} for f, g in pairs_of(text, partner)) if p["a"] != p["b"]])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.int32())), pa.array(pairs, kind)], names=["toxic", "x", "pairs"])

    got = chosen.mapInArrow(rows, "toxic int, x array<int>, pairs array<struct<a:array<int>,b:array<int>>>").toArrow()
    x = [np.array(r, np.int64) for r in got.column("x").to_pylist()]
    pairs = [(np.array(p["a"], np.int64), np.array(p["b"], np.int64)) for r in got.column("pairs").to_pylist() for p in r]
    bias, w = descend(x, np.array(got.column("toxic").to_pylist(), float), pairs, len(names), penalty)
    return Model(bias, {f: float(w[i]) for f, i in at.items() if f[0] != "^"}, {f[1:]: float(w[i]) for f, i in at.items() if f[0] == "^"})


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(model.score, b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    return filtered(docs, lambda batch: [model.score(t) < threshold for t in batch], text_col)
