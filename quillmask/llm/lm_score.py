"""LM scoring: an n-gram model in a log-frequency Bloom filter.

Words and word pairs of the training documents are counted over all data; a count c is stored as its level 1 + floor(log2 c) by entering
(n-gram, 1) to (n-gram, level). The filter is cut into segments by n-gram hash; each segment is made by one task from its own counts, with a
size in proportion to its entries. Workers get it by broadcast and read a count back by probing level after level until one is
missing; it stands for the middle of its bucket. Besides words and pairs the filter holds how often a word is a history and how many
distinct words follow it. Pair estimates are smoothed by absolute discounting: what the discount, which follows from how many pairs occur once and twice,
takes from a history's pairs goes to word estimates that add a tenth like the base. So a pair seen once is worth little, and one seen
twice far more.

A broadcast holds at most `broadcast_mb` of segments. A larger filter is read in several passes, one block of segments each: the levels
found so far travel with the documents, written to the shared folder between passes, and scores are the same.

The base score needs exact counts: the most frequent words, `frequent` at most, are broadcast; all other ones are joined by
word (exact, no cut), grouped per document before the shuffle.

Texts are handled as arrays of a batch's words (module _words), each distinct word and pair of a batch once; no word becomes a Python object.

Defined cases: null, empty and blank texts consist of the end token; texts are never cut; rows that share doc_id and text (repeated
rows) each get a row; null ids take part as the text '' in the fold; an empty table gives an empty result; other columns are ignored.
Within a batch, and among the broadcast words, words are equal if their 64-bit hashes are. Counts of pairs are kept by 56 bits of hash within a
segment and read through the filter, so both have a small error rate (parameter `bits` per entry); base scores depend on neither.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import cut, ship, texts
from ._words import MARK, mark_hash, mix, numbered, words_of

#: Kinds of entries: counts of words, of histories, of histories' distinct followers, and of pairs.
WORDS, HISTORIES, FOLLOWERS, PAIRS = range(4)


def word_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From words' hashes their keys as words and as histories."""
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(1)), mix(h * np.uint64(5) + np.uint64(2))


def pair_keys(history: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The low 56 bits of a pair's key are 24 bits of its history's key and 32 of its own, so a history's pairs share a segment."""
    return (mix(history + h) & np.uint64(0xFFFFFFFF)) | ((history & np.uint64(0xFFFFFF)) << np.uint64(32))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(segments)).astype(np.uint16)


def _probes(keys: np.ndarray, kind: int, level: int, m: np.ndarray | np.uint64, hashes: int) -> Iterator[np.ndarray]:
    """Bit positions below m, which is less than 2^32."""
    low = np.uint64(0xFFFFFFFF)
    x = mix(keys * np.uint64(2 * level + 1) + np.uint64(level + 64 * kind))
    a, step = x >> np.uint64(32), (x & low) | np.uint64(1)
    for i in range(hashes):
        yield (((a + np.uint64(i) * step) & low) * m) >> np.uint64(32)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def value_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of [2^(l-1), 2^l), 0 for no level."""
    low = np.exp2(np.maximum(levels, 1) - 1.0)
    return np.where(levels > 0, low * 1.5 - 0.5, 0.0)


LOW = {WORDS: np.uint64(0xFFFFFFFFFFFFFF), HISTORIES: np.uint64(0xFFFFFF), FOLLOWERS: np.uint64(0xFFFFFF), PAIRS: np.uint64(0xFFFFFFFFFFFFFF)}


def build(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], bits: float, hashes: int) -> bytes:
    """The filter of one segment, from distinct keys (low bits) and counts; histories are added up from their pairs."""
    histories, at = np.unique(pairs[0] >> np.uint64(32), return_inverse=True)
    entries = [(WORDS, *words), (PAIRS, *pairs), (HISTORIES, histories, np.bincount(at, pairs[1], len(histories))), (FOLLOWERS, histories, np.bincount(at, minlength=len(histories)))]
    entries = [(kind, keys, level_of(counts)) for kind, keys, counts in entries]
    m = min(max(64, 8 * math.ceil(bits * sum(int(levels.sum()) for _, _, levels in entries) / 8)), (1 << 32) - 8)
    flags = np.zeros(m, np.uint8)
    for kind, keys, levels in entries:
        for level in range(1, int(levels.max(initial=0)) + 1):
            for p in _probes(keys[levels >= level], kind, level, np.uint64(m), hashes):
                flags[p] = 1
    return np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """Some segments side by side: lo is the first one's number."""

    def __init__(self, lo: int, segments: int, parts: list[bytes], hashes: int):
        self.lo, self.segments, self.hashes = lo, segments, hashes
        self.bits = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([8 * len(p) for p in parts], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)

    def levels(self, kind: int, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Levels of the keys in these segments; -1 for keys of others."""
        at = segment.astype(np.int64) - self.lo
        out = np.where((at >= 0) & (at < len(self.sizes)), 0, -1).astype(np.int8)
        live = np.flatnonzero(out == 0)
        k, at = (keys & LOW[kind])[live], at[live]
        m, start = self.sizes[at], self.starts[at]
        level = 1
        while len(live) and level < 64:
            hit = np.ones(len(live), bool)
            for p in _probes(k, kind, level, m, self.hashes):
                p += start
                hit &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live, k, m, start = live[hit], k[hit], m[hit], start[hit]
            out[live] = level
            level += 1
        return out


def pairs_of(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, as numbers of history and word, and of each word its pair's place. A text's first history is the end token before it, the mark of the text
    before; the batch's first word has its last one."""
    before = np.roll(number, 1)
    first, back = numbered(((before << 32) | number).view(np.uint64))
    return before[first], number[first], back


class Prober:
    """Levels of the words of a batch and of their pairs, from some segments; each distinct one is probed once."""

    def __init__(self, part: Filter):
        self.part = part

    def levels(self, hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
        """hashes: of the distinct words; number: of each word. Rows of levels by kind, a column for each word."""
        part = self.part
        word, history = word_keys(hashes)
        its = segment_of(history, part.segments)
        own = part.levels(WORDS, word, segment_of(word, part.segments))
        as_history, followers = part.levels(HISTORIES, history, its), part.levels(FOLLOWERS, history, its)
        past, now, back = pairs_of(number)
        pairs = part.levels(PAIRS, pair_keys(history[past], hashes[now]), its[past])
        return np.stack([own[number], as_history[past][back], followers[past][back], pairs[back]])


#: value_of() of each level.
VALUES = value_of(np.arange(64))


def log_probabilities(levels: np.ndarray, n: int, v: int, discount: float) -> np.ndarray:
    """log10 probability of each token: pairs by absolute discounting, words by the base's added tenth."""
    word, history, followers, pair = VALUES[levels]
    base = (word + 0.1) / (n + 0.1 * (v + 1))
    followers = np.minimum(np.maximum(followers, 1), np.maximum(history, 1))
    pair = np.minimum(pair, history - followers + 1)  # the other followers have one each at least; so no probability reaches 1
    return np.log10(np.where(history > 0, (np.maximum(pair - discount, 0) + discount * followers * base) / np.maximum(history, 1), base))


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        w = words_of(b.column("text"))
        first, number = numbered(w.hash)
        yield pa.RecordBatch.from_arrays([w.bytes_of(first), pa.array(np.bincount(number, minlength=len(first)))], names=["word", "c"])


def _count_ngrams(segments: int, most: int = 1_500_000):
    """Rows (segment, part): the distinct words' and pairs' keys of some texts, with counts."""

    def counted(keys: np.ndarray, own: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each segment its distinct keys and their counts; n: of each key."""
        order = np.lexsort((keys, own))
        keys, own = keys[order], own[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])
        sums, at = np.add.reduceat(n[order], new), np.searchsorted(own[new], np.arange(segments + 1))
        return [(keys[new[a:b]], sums[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held = [], [], 0

        def out() -> pa.RecordBatch:
            sides = [counted(*(np.concatenate(x) for x in zip(*side, strict=True))) for side in (words, pairs)]
            words.clear(), pairs.clear()
            rows = [(s, b"".join(_packed(*side[s]) for side in sides)) for s in range(segments) if any(len(side[s][0]) for side in sides)]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["segment", "part"])

        for b in it:
            h = words_of(b.column("text")).hash
            if not len(h):
                continue
            first, number = numbered(h)
            h = h[first]
            word, history = word_keys(h)
            past, now, back = pairs_of(number)
            words.append((word & LOW[WORDS], segment_of(word, segments), np.bincount(number)))
            pairs.append((pair_keys(history[past], h[now]), segment_of(history, segments)[past], np.bincount(back)))
            held += len(first) + len(past)
            if held > most:
                yield out()
                held = 0
        if held:
            yield out()

    return run


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """56 bits of each key and its count, one byte where that is enough."""
    seven = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u8")
    return np.array([len(keys), len(large)], "<u4").tobytes() + seven.tobytes() + small.tobytes() + large.tobytes()


def _unpacked(part: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    n, large = np.frombuffer(part, "<u4", 2, at).tolist()
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7] = np.frombuffer(part, np.uint8, 7 * n, at + 8).reshape(n, 7)
    counts = np.frombuffer(part, np.uint8, n, at + 8 + 7 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(part, "<u8", large, at + 8 + 8 * n).astype(np.int64)
    return wide.view("<u8").ravel(), counts, at + 8 + 8 * n + 8 * large


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)


def segments_of(train: DataFrame, segments: int, bits: float, hashes: int) -> DataFrame:
    """segment, bytes, and how many pairs occur once and twice."""
    parts = train.mapInArrow(_count_ngrams(segments), "segment long, part binary")
    schema = "segment long, bytes binary, once long, twice long"

    def make(key: tuple, t: pa.Table) -> pa.Table:
        words, pairs = [], []
        for x in t.column("part"):
            part = x.as_py()
            k, c, at = _unpacked(part, 0)
            words.append((k, c))
            k, c, _ = _unpacked(part, at)
            pairs.append((k, c))
        pairs = _added(pairs)
        return pa.table({"segment": [key[0].as_py()], "bytes": pa.array([build(_added(words), pairs, bits, hashes)], pa.binary()), "once": [int((pairs[1] == 1).sum())], "twice": [int((pairs[1] == 2).sum())]})

    return parts.groupBy("segment").applyInArrow(make, schema)


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = 200_000, bits: float = 8.0, hashes: int = 3, segment_keys: int = 2_000_000, broadcast_mb: int = 256) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; trains: which rows are learnt from, over doc_id and text."""
    spark = docs.sparkSession
    ship(spark)
    docs = texts(docs, id_col, text_col)
    train = docs.where(trains)

    words = cut(train.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The lowest power-of-two-root class of counts that still leaves at most `frequent` words above it.
    classes = words.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect()  # 512 rows at most
    least, many = 1 << 62, 0
    for r in classes:
        many += r["n"]
        if many > frequent:
            break
        least = r["c"]
    top = spark.sparkContext.broadcast(_shares(words.where(F.col("c") >= least).toArrow(), n, v))
    rare = words.where(F.col("c") < least).select("word", "c")

    # Filter: segments of at most about segment_keys keys, two for each token.
    segments = max(1, min(1 << 16, math.ceil(2 * n / segment_keys)))
    made = cut(segments_of(train, segments, bits, hashes))
    stats = made.select("segment", F.length("bytes").alias("size"), "once", "twice").orderBy("segment").collect()  # 65536 rows at most
    sizes = [(r["segment"], r["size"]) for r in stats]
    once, twice = sum(r["once"] for r in stats), sum(r["twice"] for r in stats)
    discount = (once + 1) / (once + 2 * twice + 2)
    blocks: list[list[int]] = [[0, 0]]  # from, to: of segment numbers
    room = broadcast_mb << 20
    for s, size in sizes:
        if size > room and s > blocks[-1][0]:
            blocks.append([s, s])
            room = broadcast_mb << 20
        room -= size
        blocks[-1][1] = s + 1
    blocks[-1][1] = segments

    state = docs.withColumn("levels", F.lit(None).cast("binary"))
    for lo, hi in blocks[:-1]:
        state = cut(state.mapInArrow(_prober(_sent(spark, made, lo, hi, segments, hashes)), "doc_id long, text string, levels binary"))
    last = _sent(spark, made, *blocks[-1], segments, hashes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_, shares = top.value
        prober = Prober(last.value)
        for b in it:
            w = words_of(b.column("text"))
            starts = w.starts() if len(b) else w.marks
            first, number = numbered(w.hash)
            distinct = w.hash[first]
            sums = lambda x: np.add.reduceat(x, starts) if len(x) else x
            p = sums(log_probabilities(_merged(prober.levels(distinct, number), b.column("levels")), max(n, 1), v, discount))
            at = np.minimum(np.searchsorted(hashes_, distinct), max(len(hashes_) - 1, 0))
            share = np.where(hashes_[at] == distinct, shares[at], np.nan) if len(hashes_) else np.full(len(distinct), np.nan)
            share = share[number]
            # The other words: each document's distinct ones, with their counts.
            other = np.flatnonzero(np.isnan(share))
            text = np.searchsorted(w.marks, other)
            each, back = numbered(((text << 40) | number[other]).view(np.uint64))
            rest = pa.StructArray.from_arrays([w.bytes_of(other[each]), pa.array(np.bincount(back, minlength=len(each)), pa.int32())], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[each], np.arange(len(b) + 1)), pa.int32()), rest)
            keys = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in b.column("text").cast(pa.binary()).to_pylist()]
            size = w.marks - starts + 1
            cols = [pa.array(keys, pa.int64()), pa.array(size), pa.array(size - np.bincount(text, minlength=len(b))), pa.array(sums(np.nan_to_num(share))), pa.array(p), lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "key", "n_tokens", "n_known", "base_score", "score", "rest"])

    scored = state.mapInArrow(run, "doc_id long, key long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:binary,n:int>>")
    # One row for the document itself, under a word that isn't one and that no other document has, and one for each of its other words.
    own = F.struct(F.encode(F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("key").cast("string")), "utf-8").alias("word"), F.lit(0).alias("n"))
    flat = scored.select("doc_id", "key", "n_tokens", "n_known", "base_score", "score", F.explode(F.concat(F.array(own), "rest")).alias("w"))
    itself = F.col("w.n") == 0
    flat = flat.select("doc_id", "key", *[F.when(itself, F.col(c)).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")], F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    joined = flat.join(rare, "word", "left")
    total = n + 0.1 * (v + 1)
    more = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(float(total)))
    sums = joined.groupBy("doc_id", "key").agg(
        F.max("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("copies"), F.max("n_known").alias("n_known"), F.max("base_score").alias("base_score"), F.max("score").alias("score"),
        F.sum(F.when(F.col("n") > 0, more)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known"),
    )
    share = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0))
    return sums.select(
        "doc_id", "n_tokens", (F.col("n_known") + share("more_known").cast("long")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + share("more")).alias("base_score"), "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def _sent(spark, made: DataFrame, lo: int, hi: int, segments: int, hashes: int):
    """Broadcast of the segments from lo to hi; those without keys are small and empty."""
    parts = {r["segment"]: bytes(r["bytes"]) for r in made.where(F.col("segment").between(lo, hi - 1)).toLocalIterator()}
    return spark.sparkContext.broadcast(Filter(lo, segments, [parts.get(s, bytes(8)) for s in range(lo, hi)], hashes))


def _merged(found: np.ndarray, before: pa.Array) -> np.ndarray:
    """The levels found, with those that earlier passes have found."""
    if not before.null_count and len(before):
        found = np.maximum(found, np.concatenate([np.frombuffer(x.as_buffer(), np.int8).reshape(4, -1) for x in before], axis=1))
    return found


def _prober(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(sent.value)
        for b in it:
            w = words_of(b.column("text"))
            first, number = numbered(w.hash)
            found = _merged(prober.levels(w.hash[first], number), b.column("levels"))
            levels = [x.tobytes() for x in np.split(found, w.starts()[1:], axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(levels, pa.binary())], names=["doc_id", "text", "levels"])

    return run


def _shares(words: pa.Table, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of words (word, c), and the log10 of their shares of the base."""
    word, c = words.column("word").combine_chunks(), words.column("c").to_numpy().astype(float)
    mark = pc.equal(word, MARK)  # it isn't a word of a text
    w = words_of(pc.if_else(mark, pa.scalar(b"", word.type), word))
    own = np.where(mark.to_numpy(zero_copy_only=False), mark_hash(), w.hash[w.starts()]) if len(word) else w.hash
    order = np.argsort(own)
    return own[order], np.log10((c[order] + 0.1) / (n + 0.1 * (v + 1)))
