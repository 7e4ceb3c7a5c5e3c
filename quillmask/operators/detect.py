"""Detectors: frames of documents (doc_id, text) become frames of spans.

Spans: doc_id, component, comp_idx, det_idx (order within the component and document), start, stop, entity_type, id, replacement,
confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums, kinds, patterns, spans

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
SPANS = "doc_id {id}, component string, comp_idx int, det_idx int, start int, stop int, entity_type string, id string, replacement string, confidence double"


def by_pattern(docs: DataFrame, component: str = "01-REGEX", comp_idx: int = 1, names: tuple[str, ...] | None = None, min_confidence: float = 0.0, id_col: str = "doc_id", text_col: str = "text", ascii_words: bool = False) -> DataFrame:
    """One projection finds all patterns; min_confidence 0 keeps every match. Words and digits are Unicode's, with ascii_words ASCII's as in DuckDB."""
    found = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.posexplode(patterns.spans(F.col(text_col), names, ascii_words)).alias("det_idx", "s"))
    confidence = checksums.confidence(F.col("s.entity_type"), F.col("s.base"), F.col("s.match"))
    out = found.select(
        "doc_id", F.lit(component).alias("component"), F.lit(comp_idx).alias("comp_idx"), "det_idx", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
        F.col("s.entity_type").alias("entity_type"), F.lit(None).cast("string").alias("id"), F.col("s.match").alias("replacement"), confidence.alias("confidence"),
    )
    return out.where(F.col("confidence") >= min_confidence) if min_confidence else out


def token_chunks(tokens: DataFrame, size: int = 384, overlap: int = 50) -> DataFrame:
    """doc_id, chunk, first, last (token positions), start, stop: windows over offsets array<struct<start,stop>>; the last one ends with the text."""
    n = F.size("offsets")
    step = size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    rows = tokens.where(n > 0).select("doc_id", "offsets", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    first, last = F.col("chunk") * step, F.least(F.col("chunk") * step + size, F.size("offsets")) - 1
    return rows.select("doc_id", "chunk", first.alias("first"), last.alias("last"), F.get("offsets", first)["start"].alias("start"), F.get("offsets", last)["stop"].alias("stop"))


def char_chunks(text: str, limit: int) -> list[tuple[int, str]]:
    """Overlapping pieces of at most `limit` (256 or more) characters, cut at a space in the last 30 per cent if there is one."""
    limit = max(256, limit)
    overlap = min(128, max(32, limit // 16))
    out, start = [], 0
    while start < len(text):
        stop = min(start + limit, len(text))
        if stop < len(text) and (space := text.rfind(" ", start, stop)) - start >= limit * 0.7:
            stop = space
        out.append((start, text[start:stop]))
        if stop == len(text):
            break
        start = stop - overlap
    return out


def char_chunked(docs: DataFrame, limit: int = 4000, id_type: str = "long") -> DataFrame:
    """doc_id, chunk, start, piece of every document; a chunk's start depends on where the one before was cut, so a text is walked in order.

    A worker holds one batch of texts, at most 4 MB or one text if the session has no bound of its own, and as much of their pieces.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH) == SPARKS_OWN:
        conf.set(BATCH, "4m")
    names = ["doc_id", "chunk", "start", "piece"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            out, size = [], 0
            for d, t in zip(part.column("doc_id"), part.column("text"), strict=True):
                for n, (start, piece) in enumerate(char_chunks(t.as_py() or "", limit)):
                    out.append((d.as_py(), n, start, piece))
                    size += len(piece)
                    if size >= 2**22:
                        yield batch(out, part)
                        out, size = [], 0
            if out:
                yield batch(out, part)

    def batch(rows: list[tuple], part: pa.RecordBatch) -> pa.RecordBatch:
        kinds = (part.column("doc_id").type, pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text").mapInArrow(run, f"doc_id {id_type}, chunk int, start int, piece string")


def shifted(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans of chunks (doc_id, chunk, start, stop) at their places in the documents; chunks: doc_id, chunk, start."""
    at = chunks.select("doc_id", "chunk", F.col("start").alias("_at"))
    return found.join(at, ["doc_id", "chunk"]).withColumns({c: F.col(c) + F.col("_at") for c in ("start", "stop")}).drop("_at")


def top_per_chunk(found: DataFrame, k: int = 100) -> DataFrame:
    """The k most confident spans of each chunk, first ones on ties; 0 keeps all. Needs doc_id, chunk, ord."""
    if k <= 0:
        return found
    best = Window.partitionBy("doc_id", "chunk").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "ord")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def of_length(found: DataFrame, least: int = 3, most: int = 80) -> DataFrame:
    size = F.col("stop") - F.col("start")
    return found.where((size > 0) & (size >= least) & (size <= most))


def suppressed(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, kept array: of each run of spans that overlap its head (same type, IoU over the threshold) the most confident one.

    Spans are sorted by (start, stop, ord); a run ends with the first one that doesn't overlap its head.
    """
    item = F.struct("start", "stop", "ord", "entity_type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    runs = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    kind = "struct<start:int,stop:int,ord:int,entity_type:string,confidence:double>"

    def step(acc, x):
        same = (acc["head"]["entity_type"] == x["entity_type"]) & (spans.iou(acc["head"]["start"], acc["head"]["stop"], x["start"], x["stop"]) > threshold)
        best = F.when(x["confidence"] > acc["best"]["confidence"], x).otherwise(acc["best"])
        return (
            F.when(acc["head"].isNull(), F.struct(x.alias("head"), x.alias("best"), acc["out"].alias("out")))
            .when(same, F.struct(acc["head"].alias("head"), best.alias("best"), acc["out"].alias("out")))
            .otherwise(F.struct(x.alias("head"), x.alias("best"), F.array_append(acc["out"], acc["best"]).alias("out")))
        )

    start = F.struct(F.lit(None).cast(kind).alias("head"), F.lit(None).cast(kind).alias("best"), F.array().cast(f"array<{kind}>").alias("out"))
    folded = F.aggregate(F.transform("s", lambda x: x.cast(kind)), start, step, lambda acc: F.when(acc["best"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["best"])))
    return runs.select("doc_id", F.inline(folded))


def coalesced(found: DataFrame) -> DataFrame:
    """Overlapping spans of a document become one, with the first one's type and id; extended ones lose their confidence."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop", "ord")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order))
    first = F.struct("start", "stop", "ord")
    return (
        rows.groupBy("doc_id", "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("stop", first).alias("_own"), F.min_by("entity_type", first).alias("entity_type"), F.min_by("id", first).alias("id"), F.min_by("confidence", first).alias("_c"))
        .select("doc_id", "start", "stop", "entity_type", "id", F.when(F.col("stop") == F.col("_own"), F.col("_c")).alias("confidence"))
    )


def by_model(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], component: str, comp_idx: int, family: str, id_type: str = "long") -> DataFrame:
    """Any model: load() runs once in each worker and gives a function from texts to lists of {start, stop, label, confidence}.

    Labels that the family doesn't know are dropped. Models need packages and weights that the cluster has to provide.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for part in it:
            rows = [
                (d, component, comp_idx, i, s["start"], s["stop"], s["label"], None, t[s["start"] : s["stop"]], s.get("confidence"))
                for d, t, found in zip(part["doc_id"], part["text"], predict(part["text"].tolist()), strict=True)
                for i, s in enumerate(found)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "component", "comp_idx", "det_idx", "start", "stop", "entity_type", "id", "replacement", "confidence"])

    found = docs.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(run, SPANS.format(id=id_type))
    return found.withColumn("entity_type", kinds.of_family(F.col("entity_type"), family)).where("entity_type is not null")


def supported(found: DataFrame, component_types: DataFrame) -> DataFrame:
    """Spans whose type their component declares; component_types: component, entity_type."""
    return found.join(component_types, ["component", "entity_type"], "left_semi")
