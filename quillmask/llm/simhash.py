"""SimHash near-duplicate search.

A text's fingerprint has a bit for each position that is set in over half of its shingles' hashes. Two fingerprints link if they
differ in at most `distance` bits. Fingerprints are cut into blocks so that close pairs share one; pairs that meet in a block are
verified by their full Hamming distance. Two ways of cutting:

- pigeonhole(blocks, distance), for 64 bits and a small distance: a linked pair agrees in at least `blocks - distance` of the blocks, so
  each choice of that many is a key and no link is lost.
- deals(count, blocks), for wide fingerprints: the bits are dealt into `blocks` blocks in `count` ways, each block is a key. Up to
  `blocks - 1` differing bits a shared block is certain; beyond that it is likely: of 1024 bits two sets of shingles with similarity 0.8
  differ in 155 on average (standard deviation 11.5) and share one of 60 blocks with a probability of 0.978 (0.9: over 0.9999). 64 bits can't tell
  0.8 (10 bits on average) from chance when there are millions of documents, and the wider a fingerprint, the nearer its distance is to the similarity.

Copies are merged first (one row per distinct fingerprint). Within a key, links come out as a spanning forest, at most one edge per
fingerprint, never as all pairs; keys with more than `most` fingerprints are dealt into sub-groups that together hold every pair.
Components are then found by alternating large-star and small-star steps in the cluster.

Defined cases: A-Z are lower-cased and words are split at ASCII white space; a text with fewer words than a shingle is one shingle,
one without words (null, empty, blank) has fingerprint zero and links like any other; repeated rows and null ids keep their rows (a
component whose ids are all null has a null id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import cut, ship, spread, texts
from ._words import mix as _mix
from ._words import numbered, words_of

#: Sub-group tables up to this many rows (of 12 bytes) are broadcast; larger ones are joined by key.
MOST_HOT = 1_000_000
_STEP = 0x9E3779B97F4A7C15


def ones_of(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of 64-bit words have each bit; at most 255 are added up in a byte."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1)
    return np.add([bits[i : i + 255].sum(axis=0, dtype=np.uint8) for i in range(0, len(bits), 255)], 0, dtype=np.int64).sum(axis=0)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """64 bits as one signed word, from the XXH64 of the text's shingles, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(1, np.int64)
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += ones_of(hashes[i : i + (1 << 14), None])
    return np.packbits(ones * 2 > n).view(np.int64)


def wide(batch: pa.Array, words: int, width: int) -> np.ndarray:
    """A row of `width` 64-bit words, signed, for each text: each distinct shingle counts once, under hashes made of its words'."""
    w = words_of(batch)
    begins = w.starts() if len(batch) else w.marks
    count = w.marks - begins
    steps = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_STEP)
    out = np.zeros((len(batch), width), np.int64)
    if not len(w.hash):
        return out
    at = np.repeat(np.arange(len(batch)), count + 1)
    n = len(w.hash)
    own, text = np.r_[w.hash, np.zeros(words, np.uint64)], np.r_[at, np.full(words, -1)]
    own[w.marks] = 0
    sums = np.zeros(n, np.uint64)
    for j in range(words):  # words after a text's end count as zeros
        sums = sums * np.uint64(_STEP) + np.where(text[j : j + n] == at, own[j : j + n], np.uint64(0))
    inside = np.arange(n) - begins[at]
    shingle = np.flatnonzero((inside == 0) & (count[at] > 0) | (inside <= count[at] - words))
    first, _ = numbered(_mix(sums[shingle]) + at[shingle].astype(np.uint64) * np.uint64(_STEP))
    shingle = shingle[np.sort(first)]
    edges = np.searchsorted(at[shingle], np.arange(len(batch) + 1)).tolist()
    for d, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            ones = np.zeros(64 * width, np.int64)
            for i in range(a, b, 1 << 12):
                ones += ones_of(_mix(_mix(sums[shingle[i : min(b, i + (1 << 12))], None]) + steps))
            out[d] = np.packbits(ones * 2 > b - a).view(np.int64)
    return out


def node_of(f: np.ndarray) -> np.ndarray:
    """One signed long for each row of fingerprint words: the word itself, or a hash of several."""
    x = f.view(np.uint64)
    out = x[:, 0]
    for j in range(1, x.shape[1]):
        out = _mix(out * np.uint64(_STEP)) + x[:, j]
    return (out if x.shape[1] == 1 else _mix(out)).view(np.int64)


def columns(width: int) -> list[str]:
    return [f"f{j}" for j in range(width)]


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns(width)]).astype(np.int64, copy=False).reshape(-1, width)


def hashed(docs: DataFrame, words: int = 3, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, f0, f1, ... (signed longs)."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = wide(b.column("text"), words, width) if width > 1 else np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.int64).reshape(-1, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node_of(f)), *(pa.array(c) for c in f.T)], names=["doc_id", "node", *columns(width)])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, node long, " + ", ".join(f"{c} long" for c in columns(width)))


def shown(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def pigeonhole(blocks: int, distance: int) -> list[np.ndarray]:
    """Bit positions of a 64-bit fingerprint for each choice of blocks that a close pair may agree in."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    return [np.concatenate(c) for c in combinations(each, blocks - distance)]


def deals(count: int, blocks: int, bits: int, seed: int = 11) -> list[np.ndarray]:
    """Bit positions of the blocks of `count` deals."""
    rng = np.random.default_rng(seed)
    return [x for _ in range(count) for x in np.array_split(rng.permutation(bits), blocks)]


def keys_of(f: np.ndarray, positions: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each row of f: the bits at these positions, with the number of the key above them; over 52 bits are hashed."""
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), -1), axis=1)
    out = np.empty((len(f), len(positions)), np.uint64)
    for t, at in enumerate(positions):
        x = np.zeros(len(f), np.uint64)
        for p in at:
            x = (x << np.uint64(1)) | bits[:, p]
        out[:, t] = (_mix(x) if len(at) > 52 else x) ^ (np.uint64(t) << np.uint64(52))
    return out.view(np.int64)


#: Groups up to this size are compared many at a time, to find those that hold a link at all.
SMALL = 24


def linked_groups(f: np.ndarray, begins: np.ndarray, ends: np.ndarray, distance: int) -> np.ndarray:
    """Which of the groups of rows of f have two rows or more and, as far as they are small, a link."""
    size, f = ends - begins, f.view(np.uint64)
    out = size > SMALL
    for m in range(2, SMALL + 1):
        own = np.flatnonzero(size == m)
        rows = f[begins[own, None] + np.arange(m)]
        for d in range(1, m):
            out[own] |= (np.bitwise_count(rows[:, d:] ^ rows[:, :-d]).sum(axis=-1, dtype=np.int64) <= distance).any(axis=1)
    return out


def forest(f: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges, as rows of f, of a spanning forest of the links among distinct fingerprints."""
    f = f.view(np.uint64)
    close = lambda a, b: np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= distance
    if len(f) == 2:
        return [(0, 1)] if close(f[0], f[1]) else []
    out, left = [], np.arange(len(f))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = close(f[left], f[u])
            if near.any():
                found = left[near]
                out += [(int(u), x) for x in found.tolist()]
                queue += list(found)
                left = left[~near]
    return out


def links(fps: DataFrame, positions: list[np.ndarray], distance: int, width: int = 1, most: int = 4096) -> DataFrame:
    """Edges (u, v) of nodes that connect what the links connect; fps has f0, ... once for each distinct fingerprint."""
    f = columns(width)

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = keys_of(np.ascontiguousarray(_matrix(b, width)), positions)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * len(positions), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in f), lists], names=[*f, "keys"])

    each = fps.select(*f).mapInArrow(keyed, ", ".join(f"{c} long" for c in f) + ", keys array<bigint>").select(*f, F.explode("keys").alias("k"))
    # Large keys are told by counts that are added up before they are shuffled, so no task has to see one whole.
    hot = cut(each.groupBy("k").count().where(F.col("count") > most).select("k", F.ceil(F.col("count") / most).cast("int").alias("parts")))
    n_hot = hot.count()
    rows = each.select(*f, "k", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if n_hot:
        found = each.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64(*f), F.col("parts")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        rows = found.select(*f, "k", F.explode(others).alias("g")).select(*f, "k", "g.i", "g.j")
    rows = rows.repartition(spread(fps), "k", "i", "j").sortWithinPartitions("k", "i", "j")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, width + 3), np.int64)

        def edges(x: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            u, v = [], []
            f, begins = np.ascontiguousarray(x[:, :width]), np.r_[0, ends[:-1]].astype(np.int64)
            some = linked_groups(f, begins, ends, distance)
            for a, b in zip(begins[some], ends[some], strict=True):
                own = f[a:b]
                if pairs := forest(own, distance):
                    nodes = node_of(own).tolist()
                    u += [nodes[i] for i, _ in pairs]
                    v += [nodes[j] for _, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in it:
            x = np.vstack([held, np.column_stack([_matrix(b, width), *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "i", "j"))])])
            ends = np.flatnonzero((x[1:, width:] != x[:-1, width:]).any(axis=1)) + 1
            last = ends[-1] if len(ends) else 0
            yield edges(x, ends)
            held = x[last:]  # the last group may go on in the next batch
        if len(held):
            yield edges(held, np.array([len(held)]))

    return rows.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root (the smallest node of its component) for every node with an edge, by large-star and small-star steps until nothing changes (of the order of log^2 of the nodes)."""

    def signed(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct())
    seen = signed(e)
    settled = not seen[0]
    while not settled:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        before, seen = seen, signed(e)
        settled = before == seen
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, words: int, distance: int, width: int, positions: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, f0, ..., component_id (the smallest doc_id that links reach) for every row."""
    rows = cut(hashed(docs, words, width, id_col, text_col))
    fps = cut(rows.groupBy("node", *columns(width)).agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, positions, distance, width))
    # Few fingerprints have an edge: only theirs are looked up by component.
    linked = fps.join(roots, "node").select("node", "first", "root")
    heads = fps.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select("node", "first", F.col("node").alias("root"))
    member = linked.unionByName(heads)
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    found = member.join(smallest, "root").groupBy("node").agg(F.min("component_id").alias("component_id"))
    # Written before it is joined: a join of two plain shuffles can split the rows of a fingerprint that very many documents share.
    named = cut(fps.groupBy("node").agg(F.min("first").alias("first")).join(found, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")))
    return rows.join(named, "node")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row, by 64-bit fingerprints and all links."""
    found = grouped(docs, words, distance, 1, pigeonhole(blocks, distance), id_col, text_col)
    return found.select("doc_id", shown(F.col("f0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, distance: int = 168, width: int = 16, count: int = 1, blocks: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component: that of the smallest doc_id.

    By wide fingerprints: two sets of shingles with similarity 0.8 differ in at most 168 of 1024 bits with a probability of 0.88, with
    0.85 of 0.998, with 0.75 of 0.25, with 0.7 of 0.01. Rows that repeat a doc_id count as one document, of which one
    row stays. A component whose ids are all null keeps one row for each text.
    """
    found = grouped(docs, words, distance, width, deals(count, blocks, 64 * width), id_col, text_col)
    heads = cut(found.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("_head")).agg(F.count("*").alias("_n")))
    kept = docs.join(heads, docs[id_col].eqNullSafe(heads["_head"]))
    once = kept.where("_n = 1").select(*docs.columns)
    if heads.where("_n > 1").isEmpty():
        return once
    again = kept.where("_n > 1").select(*docs.columns, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_key"))
    return once.unionByName(again.where(docs[id_col].isNotNull()).dropDuplicates([id_col]).unionByName(again.where(docs[id_col].isNull()).dropDuplicates(["_key"])).drop("_key"))
