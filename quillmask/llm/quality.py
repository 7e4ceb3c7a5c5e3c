"""Quality rules: an isolation forest over rule statistics.

Each text gets counts that quality rules use (words, symbols, repeated lines, repeated 8-word windows, capitals, exclamation marks,
words said twice in a row).
The base rule uses words and repeats, the forest all of them: rates of symbols, words in capitals, marks and echoes, the shares of repeated lines and
of words in repeated windows, mean word length and number of words. Each counts by how far it lies outside what good labelled texts have, so that no
text is rare for being short or for a few signs. Trees that split a
random statistic at a random value are grown on a bounded sample of labelled rows; a text that random splits cut off early is anomalous, score 2^(-mean path length / expected path length). The threshold is calibrated on all
labelled rows: of the cuts that lose at most `clean_loss` of the good ones, the one that rejects most bad ones, in the middle of those that reject as many.

Sample: the `sample` labelled rows of smallest hash, of which bad ones make up at most `bad_share` (a forest isolates
what is rare). Both are parameters of fit(). Without labelled rows of both kinds nothing but the base rule rejects.

Defined cases: null, empty and blank texts have no words and fail the base rule; windows run over whole texts of any length
(exact, by ranks, in memory linear in the text); a repeated label takes its smallest quality and null labels are left out;
repeated rows are judged alike and kept; null ids stay, unlabelled; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut, filtered, ship, texts

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps", "n_marks", "n_echoes", "n_lines"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_BLANK = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more in the text; ranks of windows double from 1 to `width` words."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    size = 1
    while size < width:
        step = min(size, width - size)
        _, ranks = np.unique(ranks[: len(ranks) - step] * (n + 1) + ranks[step:], return_inverse=True)
        size += step
    twice = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _shouted(word: bytes) -> bool:
    return len(word) > 2 and word.isupper()


def counts(text: str) -> tuple[int, ...]:
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    drop = lambda chars: len(b) - len(b.translate(None, chars))
    return (len(words), len(text) - drop(_BLANK), drop(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), sum(map(_shouted, words)), b.count(b"!"), sum(map(eq, words, words[1:])), len(lines))


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        cols = list(zip(*map(counts, b.column("text").to_pylist()), strict=True)) or [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_run, SCHEMA)


#: By how much a statistic has to lie outside the bounds to count half: rates and shares, mean word length, log of words.
SCALE = np.array([0.02] * 6 + [1.0, 1.0])


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics in the order of the forest's dimensions; a text without words has zeros. Of n signs, capitals, marks, echoes or repeated lines, n - sqrt(n) count: one may be chance."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    w = np.maximum(c["n_words"], 1)
    sure = lambda k: np.maximum(c[k] - np.sqrt(c[k]), 0)
    return np.column_stack((sure("n_symbols") / w, sure("n_caps") / w, sure("n_marks") / w, sure("n_echoes") / w, sure("n_dup_lines") / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / w, c["word_chars"] / w, np.log1p(c["n_words"])))


def bounds_of(good: np.ndarray, tail: float = 0.0004) -> np.ndarray:
    """Least and greatest of each statistic in good texts, but for a share `tail` of them at either end; rates and shares have no least."""
    out = np.quantile(good, [tail, 1 - tail], axis=0)
    out[0, :6] = 0
    return out


def features(c: dict[str, np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """How far each statistic lies outside the bounds, from 0 (within) to below 1."""
    r = rates(c)
    out = np.maximum(np.maximum(bounds[0] - r, r - bounds[1]), 0)
    return out / (out + SCALE)


def _expected(n: float) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays: dimension (-1: leaf), split, left child, and at leaves the path length."""

    def __init__(self, x: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7, bounds: np.ndarray | None = None, anchors: np.ndarray | None = None):
        self.bounds = bounds  # with which features() made x
        anchors = x[:0] if anchors is None else anchors  # rows that every tree has
        rng = np.random.default_rng(seed)
        self.norm = max(_expected(min(rows, len(x))), 1e-9)
        self.trees = []
        for _ in range(trees):
            own = np.vstack([x[rng.choice(len(x), min(rows, len(x)), replace=False)], anchors])
            dim, cut_at, left, path = [], [], [], []

            def grow(at: np.ndarray, depth: int) -> int:
                me = len(dim)
                dim.append(-1), cut_at.append(0.0), left.append(0), path.append(depth + _expected(len(at)))
                low, high = at.min(axis=0), at.max(axis=0)
                wide = np.flatnonzero(high > low)
                if len(at) > 1 and len(wide) and depth < 12:
                    d = int(rng.choice(wide))
                    s = rng.uniform(low[d], high[d])
                    under = at[:, d] <= s
                    dim[me], cut_at[me] = d, s
                    grow(at[under], depth + 1)
                    left[me] = len(dim)  # the right child; the left one follows its parent
                    grow(at[~under], depth + 1)
                return me

            grow(own, 0)
            self.trees.append((np.array(dim), np.array(cut_at), np.array(left), np.array(path)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for dim, cut_at, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(13):
                d = dim[at]
                inner = d >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(d, 0)] <= cut_at[at]
                at = np.where(inner, np.where(go, at + 1, right[at]), at)
            total += path[at]
        return np.power(2.0, -total / len(self.trees) / self.norm)


def scored(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats with anomaly (0 without a forest)."""
    ship(stats.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = forest.score(features({c: b.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}, forest.bounds)) if forest else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "anomaly"])

    return stats.mapInArrow(run, SCHEMA + ", anomaly double")


def base_failed(short: bool = True) -> str:
    """The base rule; short: with the part on texts of few words."""
    return "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)" if short else "(100 * n_repeat_words > 30 * n_words)"


def fit(stats: DataFrame, labels: DataFrame, sample: int = 8192, bad_share: float = 0.06, clean_loss: float = 0.004, base: bool = True, short: bool = True) -> tuple[Forest | None, float]:
    """Forest and threshold from stats joined with labels (doc_id, quality 1 good, 0 bad); base: leave out what the base rule (short: with its part on short texts) rejects anyway."""
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = (stats.where(f"not {base_failed(short)}") if base else stats).join(labels, "doc_id")
    pick = lambda q, n: known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), *COUNTS).limit(n).select(*COUNTS).toPandas()
    good, bad = pick(1, int(sample * (1 - bad_share))), pick(0, int(sample * bad_share))
    if good.empty or bad.empty:
        return None, 2.0
    bounds = bounds_of(rates({c: good[c].to_numpy() for c in COUNTS}))
    x = np.vstack([features({c: p[c].to_numpy() for c in COUNTS}, bounds) for p in (good, bad.head(max(1, round(len(good) * bad_share / (1 - bad_share)))))])
    forest = Forest(x, bounds=bounds, anchors=np.eye(x.shape[1]))  # so that trees also split statistics in which the labelled texts are alike
    bins = scored(known.select("doc_id", *COUNTS), forest).select("doc_id", F.floor(F.col("anomaly") * 2000).cast("int").alias("bin")).join(labels, "doc_id")
    tally = {(r["bin"], r["quality"]): r["count"] for r in bins.groupBy("bin", "quality").count().collect()}  # 4000 rows at most
    n_good = sum(v for (_, q), v in tally.items() if q)
    lost = caught = 0
    best, low = (0, 2001), 2001
    for b in range(2000, -1, -1):
        lost, caught = lost + tally.get((b, 1), 0), caught + tally.get((b, 0), 0)
        if lost <= clean_loss * n_good and caught > best[0]:
            best = (caught, b)
        if lost <= clean_loss * n_good and caught == best[0]:
            low = b
    return forest, (best[1] + low + 1) // 2 / 2000


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: float) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly, kept."""
    stats = cut(statistics(docs, id_col, text_col))
    forest, threshold = fit(stats, labels, **bounds)
    out = scored(stats, forest).withColumn("base_failed", F.expr(base_failed()))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: bool = True, short: bool = True, **bounds: float) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; without the base rule the forest decides alone; without its part on short texts (short) short clean texts stay, repeats go.

    Counts are made twice instead of shuffling the texts.
    """
    forest, threshold = fit(cut(statistics(docs, id_col, text_col)), labels, base=base, short=short, **bounds)

    def keeps(batch: list[str]) -> list[bool]:
        c = dict(zip(COUNTS, np.array([counts(t) for t in batch], np.int64).reshape(-1, len(COUNTS)).T, strict=True))
        anomaly = forest.score(features(c, forest.bounds)) if forest else np.zeros(len(batch))
        failed = base & (short & (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"]))
        return (~failed & (anomaly < threshold)).tolist()

    return filtered(docs, keeps, text_col)
