"""Document fingerprints: a canonical exact digest.

A text is made canonical by Unicode normalisation (NFKC), case folding and white-space folding (runs become one space,
none at the ends); its fingerprint is the 128-bit xxh3 of the canonical UTF-8 bytes as 32 hex digits. Texts are of one class if
digest and canonical bytes are equal. Only digests are shuffled to find the buckets that several rows share; the canonical texts of those
buckets' rows alone are then grouped by digest and bytes, copies merged before the shuffle, so that a collision of digests can't merge two texts
and a bucket that a third of all rows share is a few rows.

Defined cases: a null text is empty, and all empty or blank texts share one fingerprint; documents without an equal are
classes of their own; repeated rows each get a row; a null doc_id is allowed (it sorts last, and is a class's smallest
id only if all its ids are null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import cut, ship, spread, texts
from .line_dedup import filter_of, passes


def canonical(text: str) -> str:
    """NFKC, case folding, then NFKC again, as folding can undo it; then single spaces."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """1 if two canonical texts have equal digests and equal bytes, else 0."""
    return float(digest(a) == digest(b) and a == b)


def _bits(fingerprint: str) -> int:
    """The last 64 bits, signed."""
    return int(fingerprint[-16:], 16) - (1 << 63)


def fingerprints(docs: DataFrame, of: Callable[[str], str] = digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for every row."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([of(canonical(t)) for t in b.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _canonical_rows(docs: DataFrame, of: Callable[[str], str], wanted) -> DataFrame:
    """doc_id, fingerprint, canonical of the rows that may be of the broadcast filter `wanted` of fingerprints."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            canon = [canonical(t) for t in b.column("text").to_pylist()]
            own = [of(c) for c in canon]
            some = np.flatnonzero(passes(wanted.value, np.array([_bits(x) for x in own], np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), pa.array([own[i] for i in some], pa.string()), pa.array([canon[i] for i in some], pa.string())], names=["doc_id", "fingerprint", "canonical"])

    return docs.mapInArrow(run, "doc_id long, fingerprint string, canonical string")


def _filter(fingerprint: DataFrame):
    number = F.conv(F.right("fingerprint", F.lit(16)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return fingerprint.sparkSession.sparkContext.broadcast(filter_of(fingerprint.select(number.cast("long").alias("bits"))))


def classed(rows: DataFrame, docs: DataFrame, of: Callable[[str], str] = digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rows (doc_id and fingerprint, one for each row of docs, and other columns) with class_id, the smallest doc_id of its class, and class_size."""
    docs = texts(docs, id_col, text_col)
    shared = cut(fingerprints(docs, of).groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    groups = _canonical_rows(docs, of, _filter(shared)).groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    by_digest = groups.groupBy("fingerprint").agg(F.count("*").alias("texts"), F.min("class_id").alias("class_id"), F.max("class_size").alias("class_size"))
    by_digest = cut(by_digest.where("class_size > 1 or texts > 1"))
    found = rows.join(by_digest, "fingerprint", "left")
    alone = found.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "class_size": F.coalesce("class_size", F.lit(1).cast("long"))}).where("texts is null or texts = 1").drop("texts")
    collided = cut(by_digest.where("texts > 1").select("fingerprint"))
    if collided.isEmpty():
        return alone
    # Different texts share a digest: their rows are told apart by bytes, row by row.
    told = _canonical_rows(docs, of, _filter(collided)).join(collided, "fingerprint").join(groups.join(collided, "fingerprint"), ["fingerprint", "canonical"])
    told = told.groupBy("doc_id", "fingerprint", "class_id", "class_size").count().drop("count")
    apart = found.where("texts > 1").drop("texts", "class_id", "class_size").alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.fingerprint") == F.col("t.fingerprint"))
    return alone.unionByName(apart.join(told.alias("t"), same).select("r.*", "t.class_id", "t.class_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: Callable[[str], str] = digest) -> DataFrame:
    """fingerprint, class_id (smallest doc_id), n (documents) for each class."""
    rows = classed(fingerprints(docs, of, id_col, text_col), docs, of, id_col, text_col)
    return rows.groupBy("fingerprint", "class_id", F.col("class_size").alias("n")).count().drop("count")


def _dealer(bounds: list[int], top: int | None):
    """Rows with the bucket of their id; the greatest id of a bucket also goes to the next one, and the greatest of all to the first, as the row after the last there."""

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = len(bounds)
        for b in it:
            rows, bucket, kind = [], [], []
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                k = 0 if d is None else bisect_left(bounds, d)
                rows.append(i), bucket.append(k), kind.append(0)
                if d == top:
                    rows.append(i), bucket.append(0), kind.append(1)
                if k < last and d == bounds[k]:
                    rows.append(i), bucket.append(k + 1), kind.append(1)
            t = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), t.column("doc_id"), t.column("text")], names=["bucket", "kind", "doc_id", "text"])

    return deal


def edit(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as many characters (or all) of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # the row that waits for the one after it
    for b in it:
        out = []
        for bucket, kind, d, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "doc_id", "text")), strict=True):
            if kind and held is None:
                continue
            canon = canonical(text)
            if held is not None:
                _, hd, ht, hc = held
                edited = edit(ht, text)
                ec = canonical(edited)
                out.append((hd, len(ht), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(hc), digest(ec), likeness(hc, ec), likeness(hc, canon)))
            held = None if kind else (bucket, d, text, canon)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2000, most_buckets: int = 10_000) -> DataFrame:
    """Each text against its edited form and the next document in descending doc_id (after the last comes the first).

    Ids are cut at approximate quantiles; each bucket is sorted within one task and streamed with one row held, and the one row
    that each bucket needs from its neighbour is copied to it. The texts are shuffled once, and no bucket has to fit in memory.
    """
    ship(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    n, top = rows.agg(F.count("*"), F.max("doc_id")).first()
    parts = max(1, min(most_buckets, n // bucket_rows))
    bounds = []
    if parts > 1 and top is not None:
        at = [i / parts for i in range(1, parts)]
        bounds = [b for b in sorted(set(rows.agg(F.percentile_approx("doc_id", at, 20 * parts)).first()[0])) if b < top]
    dealt = rows.mapInArrow(_dealer(bounds, top), "bucket int, kind int, doc_id long, text string")
    dealt = dealt.repartition(max(spread(docs), len(bounds) // 4), "bucket").sortWithinPartitions("bucket", "kind", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
