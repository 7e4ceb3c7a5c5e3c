"""Line dedup: passages that an earlier document holds too are deleted from the later one.

A window is `min_words` consecutive words of a document, wherever they stand in its lines and sentences. A word of a document is deleted if it lies in
a window that a document of smaller doc_id has too: so a passage goes word by word, whether or not it begins and ends within sentences, has
punctuation at all, stands in another order or is repeated in either document. A window is never deleted from the first document that
holds it, unless it overlaps one that a still earlier document has; each word of a passage stays once.

Search: each window is represented by the smallest hash of the word sequences of half its length in it, as in winnowing, so equal windows have equal
representatives, and about a tenth of the sequences represent any. Those that two documents or more have go into a Bloom filter, which can only let
through too many, never too few. Windows in a row with one representative are a group; groups that passed the filter are looked up by
the hash of their windows, and all windows of a group that an earlier document has too are gone. Where a representative has different groups, which
may have some windows in common, the windows of each group's first holder are looked up one by one; other holders' groups are gone
anyway. So every window that an earlier document has is found, and none is left out for being frequent.

Only hashes are shuffled for the search; texts are read three times, and shuffled once, by doc_id, to be edited.

Defined cases: null and empty texts come back as empty texts; words are what white space (as in str.split) separates and are equal if their bytes are; a
deleted word takes the white space after it along; windows are equal if their 64-bit hashes are; passages within one document stay;
repeated rows with one doc_id are edited alike and aren't compared with each other; rows with null ids are returned as they are (a null text as an
empty one); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import cut, ship, stored, texts

#: Words from which a line is cut at the next end of a sentence.
CUT = 4
PIECES = re.compile(r"[^.!?\n]+[.!?]*[^\S\n]*\n?|[.!?]+[^\S\n]*\n?|\n").findall
_B = np.uint64(0x9E3779B97F4A7C15)
_UNB = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: White space of str.split beyond ASCII's; it is read as blanks of as many bytes.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTES = np.where(_SPACE, 0, np.random.default_rng(11).integers(1, 1 << 63, 256)).astype(np.uint64)
#: Bytes of text that are hashed at a time, and the most bits that the filter has.
GROUP, MOST_BITS = 1 << 20, 1 << 31


def units(text: str) -> tuple[list[str], list[int]]:
    """Lines, cut after ends of sentences once they have CUT words, and their numbers of words; joined they are the text."""
    out, words = [], []
    held, have = "", 0
    for s in PIECES(text):
        held = held + s if held else s
        have += len(s.split())
        if have >= CUT or s[-1] == "\n":
            out.append(held), words.append(have)
            held, have = "", 0
    if held:
        out.append(held), words.append(have)
    return out, words


class Words(NamedTuple):
    """The words of some texts one after another, and the windows of the texts."""

    first: np.ndarray  # of each text, and of the end, its first word
    start: np.ndarray  # of each word, its first byte in its text
    at: np.ndarray  # of each window, its first word
    key: np.ndarray  # of each window, its representative
    own: np.ndarray  # of each window, its hash

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, its first window and its hash."""
        new = _changes(np.searchsorted(self.first, self.at, "right"), self.key)
        if not len(new):
            return new, self.own
        size = np.diff(np.r_[new, len(self.at)])
        powers = np.cumprod(np.full(int(size.max()), _B))
        return new, _mixed(np.add.reduceat(self.own * powers[np.arange(len(self.at)) - np.repeat(new, size)], new))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the sequences of n, by halves."""
    if n == 1:
        return h
    a = _sequences(h, n // 2)
    out = a[: len(h) - n + 1] * _B + a[n // 2 : n // 2 + len(h) - n + 1]
    return _mixed(out * _B + h[n - 1 :] if n % 2 else out)


def windows_of(raw: list[bytes], least: int) -> Words:
    """raw: texts as UTF-8, white space as ASCII."""
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = _SPACE[data]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    origin = np.cumsum([0, *(len(x) + 1 for x in raw)])
    first = np.searchsorted(start, origin)
    none = np.empty(0, np.uint64)
    if len(start) < least:
        return Words(first, start - np.repeat(origin[:-1], np.diff(first)), np.empty(0, np.int64), none, none)
    size = np.diff(np.r_[start, len(data)])
    powers = np.cumprod(np.full(int(size.max()), _B))
    within = np.arange(start[0], len(data)) - np.repeat(start, size)
    h = _mixed(np.add.reduceat(_BYTES[data[start[0] :]] * powers[within], start - start[0]))
    half = max(1, least // 2)
    low, width, want = _sequences(h, half), 1, least - half + 1
    while width < want:
        step = min(width, want - width)
        low, width = np.minimum(low[: len(low) - step], low[step:]), width + step
    text = np.repeat(np.arange(len(raw)), np.diff(first))
    at = np.flatnonzero(text[: len(text) - least + 1] == text[least - 1 :])
    return Words(first, start - origin[text], at, low[at], _sequences(h, least)[at])


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _blanked(text: str) -> bytes:
    if _WIDE.search(text):
        text = _WIDE.sub(lambda m: " " * len(_bytes(m[0])), text)
    return _bytes(text)


def _groups(b: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, Words]]:
    """doc_id of each window, and the windows, for some texts at a time."""
    ids, raw, held = [], [], 0
    for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
        ids.append(d), raw.append(_blanked(t))
        held += len(raw[-1])
        if held >= GROUP:
            yield _owned(ids, windows_of(raw, least))
            ids, raw, held = [], [], 0
    if ids:
        yield _owned(ids, windows_of(raw, least))


def _owned(ids: list[int], w: Words) -> tuple[np.ndarray, Words]:
    return np.array(ids, np.int64)[np.searchsorted(w.first, w.at, "right") - 1], w


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Positions at which a row differs from the one before it."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _keys(least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for doc, w in _groups(b, least):
                new = _changes(doc, w.key)
                yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(w.key[new].view(np.int64))], names=["doc_id", "hash"])

    return run


def filter_of(keys: DataFrame) -> np.ndarray:
    """Bits, as bytes, of a Bloom filter of one hash over the one column of keys (long, hashed evenly), 16 to 32 bits a key; its length is a power of two."""
    bits = min(MOST_BITS, 1 << max(13, (16 * keys.count()).bit_length()))

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in it:
            bit = b.column("bit").to_numpy(zero_copy_only=False)
            for own in np.split(bit, _changes(bit >> 13)[1:]):
                if len(own):
                    parts.setdefault(int(own[0] >> 13), np.zeros(8192, bool))[own & 8191] = True
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    dealt = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("bit")).repartition(F.shiftright("bit", 13)).sortWithinPartitions("bit")
    out = np.zeros(bits // 8, np.uint8)
    for part, x in dealt.mapInArrow(fill, "part long, bits binary").toLocalIterator():  # 256 MB at most in all
        out[part * 1024 : part * 1024 + 1024] = np.frombuffer(x, np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & np.uint64(8 * len(bits) - 1)
    return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def shared_windows(docs: DataFrame, min_words: int = 40) -> DataFrame:
    """doc_id, hash: of a document's groups and single windows that documents of smaller doc_id have too."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("doc_id is not null")
    several = (F.min("doc_id").alias("earlier"), F.max("doc_id").alias("top"))
    ahead = lambda of: of.groupBy("hash").agg(*several).where("top > earlier").select("hash", "earlier")
    # What is joined is written before: a join of two plain shuffles can split the rows of a hash that very many documents share.
    later = lambda of: of.select("doc_id", "hash").join(cut(ahead(of)), "hash").where("doc_id > earlier").select("doc_id", "hash")
    keys = rows.mapInArrow(_keys(min_words), "doc_id long, hash long")
    shared = spark.sparkContext.broadcast(filter_of(cut(ahead(keys).select("hash"))))

    def grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for doc, w in _groups(b, min_words):
                new, own = w.groups()
                some = passes(shared.value, w.key[new])
                new, own = new[some], own[some]
                yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(w.key[new].view(np.int64)), pa.array(own.view(np.int64))], names=["doc_id", "key", "hash"])

    groups = stored(rows.mapInArrow(grouped, "doc_id long, key long, hash long"))
    holders = groups.groupBy("key", "hash").agg(F.min("doc_id").alias("earlier"))
    differing = cut(holders.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    unsure = spark.sparkContext.broadcast(filter_of(cut(holders.join(differing, "key", "left_semi").select(F.col("hash").bitwiseXOR(F.col("earlier")).alias("holder")))))

    def single(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for doc, w in _groups(b, min_words):
                new, own = w.groups()
                some = passes(unsure.value, own ^ doc[new].view(np.uint64)) & passes(shared.value, w.key[new])
                some = np.repeat(some, np.diff(np.r_[new, len(w.at)]))
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(w.own[some].view(np.int64))], names=["doc_id", "hash"])

    windows = stored(rows.mapInArrow(single, "doc_id long, hash long"))
    return later(groups).unionByName(later(windows))


def edited(text: str, gone: list[int], least: int) -> tuple[str, int]:
    """The text without the words of its windows in gone (hashes of groups and of windows), and how many words that are."""
    raw = _bytes(text)
    w = windows_of([_blanked(text)], least)
    edge = np.zeros(len(w.start) + 1, np.int64)
    new, own = w.groups()
    whole = np.repeat(np.isin(own.view(np.int64), gone), np.diff(np.r_[new, len(w.at)]))
    hit = w.at[whole | np.isin(w.own.view(np.int64), gone)]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    drop = np.cumsum(edge[:-1]) > 0
    ends = np.r_[w.start[1:], len(raw)]
    new = _changes(drop)
    parts = [raw[: w.start[0]]] if len(w.start) else [raw]
    parts += [raw[w.start[i] : ends[j - 1]] for i, j in zip(new, [*new[1:], len(drop)], strict=True) if not drop[i]] if len(new) else []
    return b"".join(parts).decode("utf-8", "surrogatepass"), int(drop.sum())


def edit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40) -> DataFrame:
    """docs with all their columns, the text (null: empty) edited, and _n_deleted, the number of words that go."""
    found = shared_windows(texts(docs, id_col, text_col), min_words)
    gone = found.groupBy(F.col("doc_id").alias("_later")).agg(F.collect_set("hash").alias("_gone"))

    def edit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, lost = [], []
            for t, g in zip(b.column(text_col).to_pylist(), b.column("_gone").to_pylist(), strict=True):
                t, n = edited(t or "", g, min_words) if g else (t or "", 0)
                out.append(t), lost.append(n)
            new = {text_col: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([*(new.get(c, b.column(c)) for c in names), pa.array(lost, pa.int64())], names=[*names, "_n_deleted"])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_deleted", T.LongType())])
    return docs.join(gone, docs[id_col] == gone["_later"], "left").drop("_later").mapInArrow(edit, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40) -> DataFrame:
    """doc_id, text (edited), n_deleted (words) for every row."""
    return edit_documents(texts(docs, id_col, text_col), min_words=min_words).withColumnRenamed("_n_deleted", "n_deleted")


# The search by runs of lines and their alignment used these; they stay for callers and tests.


def runs(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run, the hash of its representative line and its own hash. Lines without words don't take part."""
    h, w = hashes[words > 0], words[words > 0].astype(np.int64)
    total = np.cumsum(w)
    ends = np.searchsorted(total, total - w + least) + 1
    n = int(np.searchsorted(ends, len(h), "right"))  # ends rise: the first n runs are complete
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    starts, ends = np.arange(n), ends[:n]
    least_line = h[:n].copy()
    for d in range(1, int((ends - starts).max())):
        in_run = starts + d < ends
        least_line[in_run] = np.minimum(least_line[in_run], h[starts[in_run] + d])
    powers = np.cumprod(np.full(len(h), _B))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
    own = (sums[ends] - sums[:n]) * np.cumprod(np.full(n, _UNB))
    return least_line, own ^ (own >> np.uint64(31))


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: aligned pairs (position in a, position in b) of equal lines, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 and cb.get(x) == 1}
        common = [(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at]
        # Longest increasing sequence of positions in a, by piles.
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(common):
            p = bisect_left(tops, i)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(i), piles.append(k)
            else:
                tops[p], piles[p] = i, k
        chain, k = [], piles[-1] if piles else -1
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        if not chain:
            continue
        i0, j0 = a0, b0
        for i, j in [*reversed(chain), (a1, b1)]:
            work.append((i0, i, j0, j))
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)
