"""JSON-lines documents and results.

Ground truth is a list of spans, or a text with inline blocks ##TYPE;ID;RAW@@ which replaces the document's text. Null and []
mean "not evaluated", a text without blocks means "evaluated, nothing to find".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds

BLOCK = r"(?s)##([^;#@]+);([^;#@]*);(.*?)@@"
GOLD = "array<struct<start:int,stop:int,entity_type:string,id:string,confidence:double>>"


def inline_text(gold: Column) -> Column:
    return F.regexp_replace(gold, BLOCK, "$3")


def inline_spans(gold: Column) -> Column:
    """Spans of inline blocks in the text that inline_text() gives, by position."""
    extract = lambda group: F.regexp_extract_all(gold, F.lit(BLOCK), F.lit(group))
    pieces = F.arrays_zip(F.split(gold, BLOCK, -1).alias("gap"), extract(1).alias("type"), extract(2).alias("id"), extract(3).alias("raw"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["raw"])
        span = F.struct(start.alias("start"), stop.alias("stop"), kinds.canonical(x["type"]).alias("entity_type"), F.nullif(F.trim(x["id"]), F.lit("")).alias("id"), F.lit(1.0).alias("confidence"))
        return F.struct(stop.alias("at"), F.array_append(acc["out"], span).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(GOLD).alias("out"))
    return F.aggregate(F.filter(pieces, lambda x: x["raw"].isNotNull()), begin, step, lambda acc: acc["out"])


def gold_of(raw: Column) -> Column:
    """The gold column's spans (null: not evaluated) from a JSON list or a text."""
    listed = F.from_json(raw, "array<struct<start:int,end:int,entity_type:string,id:string,confidence:double>>")
    listed = F.transform(listed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("stop"), kinds.canonical(s["entity_type"]).alias("entity_type"), s["id"].alias("id"), s["confidence"].alias("confidence")))
    return F.when(F.ltrim(raw).startswith("["), F.when(F.size(listed) > 0, listed.cast(GOLD))).otherwise(inline_spans(raw))


def read(spark: SparkSession, path: str, text_field: str = "text", id_field: str | None = None, gold_field: str | None = None, strict: bool = True) -> DataFrame:
    """doc_id string, text, gold, metadata. Malformed lines and empty texts fail (strict) or are dropped.

    Without ids, documents are numbered doc-0, doc-1, ... in file order.
    """
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError(f"not a .jsonl path: {path}")
    names = list(dict.fromkeys(n for n in (text_field, id_field, gold_field, "metadata") if n))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    if id_field is None:
        numbered = rows.rdd.zipWithIndex().map(lambda x: (*x[0], f"doc-{x[1]}"))  # the only way to number lines in file order without one task
        rows = spark.createDataFrame(numbered, T.StructType([*schema.fields, T.StructField("_id", T.StringType())]))
        id_field = "_id"
    return projected(rows, text_field, id_field, gold_field, strict)


def projected(rows: DataFrame, text_field: str, id_field: str, gold_field: str | None = None, strict: bool = True) -> DataFrame:
    """doc_id, text, gold, metadata from the strings of a line's fields."""
    empty = F.coalesce(F.length(text_field) == 0, F.lit(True))
    text = F.when(empty, F.raise_error(F.lit(f"a document has no {text_field}"))).otherwise(F.col(text_field)) if strict else F.col(text_field)
    rows = rows if strict else rows.where(~empty)
    gold = F.col(gold_field) if gold_field else F.lit(None).cast("string")
    inline = gold.isNotNull() & ~F.ltrim(gold).startswith("[")
    return rows.select(
        F.col(id_field).cast("string").alias("doc_id"), F.when(inline, inline_text(gold)).otherwise(text).alias("text"), gold_of(gold).alias("gold"),
        F.when(~F.col("metadata").isin("{}", ""), F.col("metadata")).alias("metadata"),
    )


def _entities(c: Column) -> Column:
    return F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("end"), s["entity_type"].alias("entity_type"), s["id"].alias("id"), s["confidence"].alias("confidence")))


def results(masked: DataFrame) -> DataFrame:
    """The output document's six fields from doc_id, original_text, masked_text, entities, gold, evaluation."""
    empty = F.array().cast("array<struct<start:int,end:int,entity_type:string,id:string,confidence:double>>")
    gold = F.coalesce(_entities(F.col("gold")), empty) if "gold" in masked.columns else empty
    evaluation = F.col("evaluation") if "evaluation" in masked.columns else F.lit(None).cast("string")
    return masked.select("doc_id", "masked_text", "original_text", evaluation.alias("evaluation"), gold.alias("ground_truth_entities"), F.coalesce(_entities(F.col("entities")), empty).alias("predicted_entities"))


def write(masked: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines with null keys kept; an existing path is an error. single gives one file, for small outputs."""
    rows = results(masked)
    (rows.coalesce(1) if single else rows).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def cache_entries(requests: DataFrame) -> DataFrame:
    """doc_id, entity_type, id, alias from the JSON column entity_cache {type: {id: [alias]}}; ids that are no integers are skipped."""
    parsed = F.from_json("entity_cache", "map<string,map<string,array<string>>>")
    rows = requests.select("doc_id", F.explode(parsed).alias("entity_type", "ids")).select("doc_id", "entity_type", F.explode("ids").alias("id", "aliases"))
    return rows.select("doc_id", "entity_type", F.col("id").try_cast("int").alias("id"), F.explode(F.array_distinct("aliases")).alias("alias")).where("id is not null")
