"""More queries over the library's operators, registered beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checksums, kinds, names, patterns, spans
from ..operators import compare, detect, evaluate, mask, metrics, overlap, resolve
from ..sources import jsonl
from . import corpora as C
from . import plots
from .catalog import _DOCS, _EXACT, _MULTI, _pairs, _sql_kind, _sql_spans, _sql_valid, exact6, found, query, table

# Detection.


def _contacts_query(name):
    return lambda spark, d: found(C.frame(spark, d, C.CONTACTS), names=(name,)).select("doc_id", "entity_type", "start", "stop", "replacement", "confidence")


for _p in ("PHONE", "IBAN", "IPV6"):
    query(_sql_spans(C.duck(C.CONTACTS), "doc_id", "text", (_p,)), f"regex_spans_{_p.lower()}")(_contacts_query(_p))


def _idents_query(name):
    return lambda spark, d: found(C.frame(spark, d, C.IDENTS), names=(name,), text_col="ident").select("doc_id", "entity_type", "start", "stop", "replacement", "confidence")


for _p in ("DNI", "CIF", "NIE"):
    query(_sql_spans(C.duck(C.IDENTS), "doc_id", "ident", (_p,)), f"regex_spans_{_p.lower()}")(_idents_query(_p))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p.name}', {p.confidence}::DOUBLE, {str(p.checked).lower()}, {len(p.regex)})" for p in patterns.PATTERNS) + ") AS t(name, confidence, validated, size)")
def pattern_metadata(spark, d):
    return patterns.described(spark).select("name", "confidence", "validated", F.length("regex").alias("size"))


@query(f"SELECT lower(kind) AS kind, count(*) AS n, count(*) FILTER ({_sql_valid('kind', 'ident')}) AS valid FROM (SELECT * FROM {C.duck(C.IDENTS)} UNION ALL SELECT doc_id, 'OTHER', ident FROM {C.duck(C.IDENTS)}) GROUP BY 1")
def validator_lookup(spark, d):
    rows = C.frame(spark, d, C.IDENTS)
    rows = rows.unionByName(rows.withColumn("kind", F.lit("OTHER"))).withColumn("kind", F.lower("kind"))  # any case; unknown types are never valid
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(checksums.valid(F.col("kind"), F.col("ident")), 1)).alias("valid"))


@query("WITH RECURSIVE t AS (SELECT doc_id, text FROM documents), c AS (SELECT doc_id, text, 0 AS chunk, 0 AS start, 0 AS stop, false AS done, '' AS piece FROM t WHERE false UNION ALL SELECT doc_id, text, 0, 0, s, s = length(text), substr(text, 1, s) FROM (SELECT doc_id, text, CASE WHEN length(text) <= 4000 THEN length(text) WHEN p >= 2800 THEN p ELSE 4000 END AS s FROM (SELECT *, 4000 - position(' ' IN reverse(substr(text, 1, 4000))) AS p FROM t WHERE length(text) > 0)) UNION ALL SELECT doc_id, text, chunk + 1, b, s, s = length(text), substr(text, b + 1, s - b) FROM (SELECT *, CASE WHEN b + 4000 >= length(text) THEN length(text) WHEN p >= 2800 THEN b + p ELSE b + 4000 END AS s FROM (SELECT *, stop - 128 AS b, CASE WHEN position(' ' IN substr(text, stop - 127, 4000)) = 0 THEN -1 ELSE 4000 - position(' ' IN reverse(substr(text, stop - 127, 4000))) END AS p FROM c WHERE NOT done))) SELECT doc_id, chunk, start, md5(piece) AS piece FROM c")
def chunk_chars(spark, d):
    return detect.char_chunked(table(spark, d, "documents")).select("doc_id", "chunk", "start", F.md5("piece").alias("piece"))


@query(f"SELECT doc_id, chunk, ord, CAST(start + chunk * 1000 AS INT) AS start, CAST(stop + chunk * 1000 AS INT) AS stop FROM {C.duck(C.CHUNKS)}")
def chunk_offset_shift(spark, d):
    rows = C.frame(spark, d, C.CHUNKS)
    chunks = rows.select("doc_id", "chunk").distinct().withColumn("start", F.col("chunk") * 1000)
    return detect.shifted(rows, chunks).select("doc_id", "chunk", "ord", "start", "stop")


@query(f"SELECT component, {_sql_kind('entity_type')} AS entity_type, count(*) AS n FROM {C.duck(C.SPANS)} WHERE component = '02-SPACY' OR {_sql_kind('entity_type')} = 'COMPANY' GROUP BY ALL")
def supported_types(spark, d):
    types = spark.sql("SELECT * FROM VALUES ('01-REGEX', 'COMPANY'), ('02-SPACY', 'NAME'), ('02-SPACY', 'COMPANY') AS t(component, entity_type)")
    rows = C.frame(spark, d, C.SPANS).withColumn("entity_type", kinds.canonical(F.col("entity_type")))
    return detect.supported(rows, F.broadcast(types)).groupBy("component", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, entity_type, count(*) AS n FROM ({_sql_spans('(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE ' + chr(39) * 2 + ' END AS text FROM documents)', 'doc_id', 'text', ('IPV4', 'EMAIL'))}) GROUP BY ALL")
def empty_text_detects_nothing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("text"))
    return found(docs, names=("IPV4", "EMAIL")).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT component, entity_type, det_idx, count(*) AS n FROM {C.duck(C.SPANS)} GROUP BY ALL UNION ALL SELECT '03-MORE', entity_type, CAST(det_idx + 10 AS INT), count(*) FROM {C.duck(C.SPANS)} WHERE det_idx < 2 GROUP BY ALL")
def detectors_union(spark, d):
    rows = C.frame(spark, d, C.SPANS)
    more = rows.where("det_idx < 2").withColumns({"component": F.lit("03-MORE"), "comp_idx": F.lit(3), "det_idx": F.col("det_idx") + 10})
    return rows.unionByName(more).groupBy("component", "entity_type", "det_idx").agg(F.count("*").alias("n"))


# Spans and texts.


@query(f"SELECT doc_id, det_idx, CAST(greatest(0, least(20, start)) AS INT) AS start, CAST(greatest(0, least(20, stop)) AS INT) AS stop, CASE WHEN det_idx = 3 THEN 'given' ELSE substr('lorem ipsum dolor si', CAST(greatest(0, least(20, start)) + 1 AS INT), CAST(greatest(0, least(20, stop)) - greatest(0, least(20, start)) AS INT)) END AS mention FROM {C.duck(C.SPANS)}")
def span_mentions_clamped(spark, d):
    text = F.lit("lorem ipsum dolor si")
    rows = C.frame(spark, d, C.SPANS).withColumn("s", F.struct(F.when(F.col("det_idx") == 3, "given").alias("replacement"), "start", "stop"))
    return rows.select("doc_id", "det_idx", spans.clamped(F.col("start"), text).alias("start"), spans.clamped(F.col("stop"), text).alias("stop"), spans.mention(text, F.col("s")).alias("mention"))


@query(f"SELECT doc_id, string_agg(det_idx, ',' ORDER BY prio, hier, comp_idx, det_idx) AS by_priority, string_agg(det_idx, ',' ORDER BY start, det_idx) AS by_start FROM {C.duck(C.SPANS)} GROUP BY 1")
def candidate_order(spark, d):
    item = F.struct("prio", "hier", "comp_idx", "det_idx", "start")
    rows = C.frame(spark, d, C.SPANS).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("a"), F.array_sort(F.collect_list(F.struct("det_idx", "start"))).alias("b"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: s["det_idx"].cast("string")), ",")
    return rows.select("doc_id", listed(F.col("a")).alias("by_priority"), listed(mask.by_start(F.col("b"))).alias("by_start"))


@query(f"SELECT s.component, {_sql_kind('s.entity_type')} AS entity_type, coalesce(p.prio, 1000000) AS prio, CAST(CASE s.component WHEN '02-SPACY' THEN 4 ELSE 0 END AS INT) AS hier, count(*) AS n FROM {C.duck(C.SPANS)} s LEFT JOIN (VALUES ('01-REGEX', 'COMPANY', 2), ('02-SPACY', 'NAME', 1)) AS p(component, entity_type, prio) ON s.component = p.component AND {_sql_kind('s.entity_type')} = p.entity_type GROUP BY ALL")
def priority_and_hierarchy(spark, d):
    rows = C.frame(spark, d, C.SPANS).drop("prio", "hier").withColumn("entity_type", kinds.canonical(F.col("entity_type")))
    priorities = spark.sql("SELECT * FROM VALUES ('01-REGEX', 'COMPANY', 2), ('02-SPACY', 'NAME', 1) AS t(component, entity_type, prio)")
    hierarchy = spark.sql("SELECT * FROM VALUES ('02-SPACY', 4) AS t(component, hier)")
    ranked = overlap.ranked(rows, F.broadcast(priorities), F.broadcast(hierarchy))
    return ranked.groupBy("component", "entity_type", "prio", "hier").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, length(regexp_replace(text, '\\s+', ' ', 'g')) AS n FROM documents WHERE doc_id % 10 = 3 AND length(text) < 3000")
def whitespace_map(spark, d):
    """The texts of some documents with runs of white space as one space; each character's place is checked against the text."""
    rows = table(spark, d, "documents").where("doc_id % 10 = 3 and length(text) < 3000").select("doc_id", "text", spans.squeezed(F.col("text")).alias("s"), spans.squeezed_places(F.col("text")).alias("at"))
    read = F.array_join(F.transform("at", lambda i: F.regexp_replace(F.substring("text", i + 1, F.lit(1)), r"(?U)\s", " ")), "")
    return rows.select("doc_id", F.md5(read).alias("squeezed"), F.size("at").cast("long").alias("n"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS html FROM documents")
def html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(spans.escaped_html(F.col("text"))).alias("html"))


@query("SELECT DISTINCT c_mktsegment AS segment, substr(sha1(c_mktsegment), 1, 8) AS hash, 'ab_' || lower(substr(c_mktsegment, 1, 1)) || 'c' AS snake FROM customer")
def short_names(spark, d):
    c = F.col("c_mktsegment")
    mixed = F.concat(F.lit("ab"), F.left(c, F.lit(1)), F.lit("c"))
    return table(spark, d, "customer").select(c.alias("segment"), names.short_hash(c).alias("hash"), names.snake(mixed).alias("snake")).distinct()


# Resolution.


@query(f"SELECT t.doc_id, t.component, t.det_idx, coalesce(i.id, t.id) AS id FROM {C.duck(C.SPANS)} t LEFT JOIN (SELECT doc_id, start, stop, entity_type, max_by('e' || det_idx, det_idx) AS id FROM {C.duck(C.SPANS)} WHERE det_idx % 3 < 2 GROUP BY ALL) i ON t.doc_id = i.doc_id AND t.start = i.start AND t.stop = i.stop AND t.entity_type = i.entity_type")
def ids_written_back(spark, d):
    rows = C.frame(spark, d, C.SPANS)
    ids = rows.where("det_idx % 3 < 2").select("doc_id", "start", "stop", "entity_type", F.col("det_idx").alias("ord"), F.concat(F.lit("e"), F.col("det_idx").cast("string")).alias("id"))
    return resolve.written_back(rows, ids).select("doc_id", "component", "det_idx", "id")


@query(f"SELECT doc_id, entity_type, lower(mention) AS key, min(start) AS start, CAST(arg_min(ord, start * 100000 + ord) AS INT) AS ord FROM {C.duck(C.MENTIONS)} GROUP BY ALL")
def first_appearance(spark, d):
    rows = C.frame(spark, d, C.MENTIONS).groupBy("doc_id", "entity_type", F.lower("mention").alias("key")).agg(F.min(F.struct("start", "ord")).alias("first"))
    return rows.select("doc_id", "entity_type", "key", "first.start", "first.ord")


@query(f"SELECT doc_id, entity_type, CAST(id AS INT) AS id, alias FROM (SELECT DISTINCT doc_id, entity_type, ord % 5 AS id, mention AS alias FROM {C.duck(C.MENTIONS)})")
def cache_aliases(spark, d):
    """Aliases of a request's cache {type: {id: [alias]}}, repeated ones once, ids that are no integers left out."""
    rows = C.frame(spark, d, C.MENTIONS)
    keyed = rows.select("doc_id", "entity_type", (F.col("ord") % 5).cast("string").alias("id"), F.col("mention").alias("alias"))
    odd = keyed.withColumn("id", F.lit("x"))
    lists = keyed.unionByName(keyed).unionByName(odd).groupBy("doc_id", "entity_type", "id").agg(F.collect_list("alias").alias("aliases"))
    types = lists.groupBy("doc_id", "entity_type").agg(F.map_from_entries(F.collect_list(F.struct("id", "aliases"))).alias("ids"))
    requests = types.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("entity_type", "ids")))).alias("entity_cache"))
    return jsonl.cache_entries(requests)


# Sources.


@query(f"SELECT coalesce(id, 'none') AS doc_id, regexp_replace(gold, '##([^;#@]+);([^;#@]*);(.*?)@@', '\\3', 'g') AS text, n, CASE WHEN n = 0 THEN '{{\"k\":1}}' END AS metadata FROM (SELECT CAST(doc_id AS VARCHAR) AS id, gold, len(regexp_extract_all(gold, '##([^;#@]+);([^;#@]*);(.*?)@@')) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'plain text of ' || doc_id ELSE gold END AS gold FROM {C.duck(C.INLINE)}))")
def jsonl_documents(spark, d):
    """Lines of JSON as documents: ids, texts with inline gold replaced, gold spans, metadata ({} is none)."""
    rows = C.frame(spark, d, C.INLINE)
    gold = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("plain text of "), F.col("doc_id").cast("string"))).otherwise(F.col("gold"))
    meta = F.when(F.col("doc_id") % 3 == 0, '{"k":1}').otherwise("{}")
    read = jsonl.projected(rows.select(F.lit("placeholder").alias("body"), F.col("doc_id").cast("string").alias("key"), gold.alias("truth"), meta.alias("metadata")), "body", "key", "truth")
    return read.select("doc_id", "text", F.size("gold").cast("long").alias("n"), "metadata")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [] ELSE [0, 3] END AS at, doc_id % 2 = 1 AS judged FROM {C.duck(C.LETTERS)}")
def jsonl_gold_lists(spark, d):
    """Gold as a JSON list; an empty list and no gold mean that the document isn't evaluated."""
    raw = F.when(F.col("doc_id") % 4 == 0, "[]").when(F.col("doc_id") % 2 == 1, '[{"start":0,"end":3,"entity_type":"person"}]')
    gold = jsonl.gold_of(raw)
    none = F.array().cast("array<int>")
    return C.frame(spark, d, C.LETTERS).select("doc_id", F.coalesce(F.flatten(F.transform(gold, lambda s: F.array(s["start"], s["stop"]))), none).alias("at"), gold.isNotNull().alias("judged"))


@query(f"SELECT doc_id, text AS original_text, '[' || doc_id || ']' AS masked_text, '[{{\"start\":0,\"end\":6,\"entity_type\":\"NAME\",\"id\":null,\"confidence\":0.5}}]' AS predicted, '[]' AS gold FROM {C.duck(C.LETTERS)}")
def result_documents(spark, d):
    """The output document's fields, spans without their replacements."""
    span = F.struct(F.lit(0).alias("start"), F.lit(6).alias("stop"), F.lit("NAME").alias("entity_type"), F.lit(None).cast("string").alias("id"), F.lit(0.5).alias("confidence"), F.lit("Client").alias("replacement"))
    rows = C.frame(spark, d, C.LETTERS).select("doc_id", F.col("text").alias("original_text"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")).alias("masked_text"), F.array(span).alias("entities"))
    out = jsonl.results(rows)
    listed = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return out.select("doc_id", "original_text", "masked_text", listed("predicted_entities").alias("predicted"), listed("ground_truth_entities").alias("gold"))


# Evaluation and comparison.


@query(f"SELECT entity_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_EXACT}) GROUP BY GROUPING SETS ((entity_type), ())")
def run_level_merge(spark, d):
    """Documents' counts are summed per day part first, then over all of them."""
    parts = evaluate.counted(_pairs(spark, d), "exact", None).withColumn("part", F.col("doc_id") % 7).groupBy("part", "scope", "variant", "entity_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return evaluate.summed(parts).select("entity_type", "tp", "fp", "fn")


@query(f"SELECT doc_id, tp, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0), 6) AS f1 FROM ({_DOCS})")
def rates_or_null(spark, d):
    scored = compare.scored_documents(evaluate.counted(_pairs(spark, d), "exact", None))
    return scored.select("doc_id", "tp", *[exact6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT doc_id, tp, fp, fn FROM ({_DOCS}) WHERE contains(CAST(doc_id AS VARCHAR), '7') ORDER BY tp / nullif(tp + fn, 0) NULLS FIRST, doc_id LIMIT 20 OFFSET 20")
def document_search_page(spark, d):
    """The second page of 20 documents whose id holds a 7, by recall: a report's view."""
    scored = compare.scored_documents(evaluate.counted(_pairs(spark, d), "exact", None))
    return compare.found_page(scored, "7", 1, 20, "recall").select("doc_id", "tp", "fp", "fn")


@query(f"SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id, start, stop, entity_type FROM {C.duck(C.PREDS)} INTERSECT SELECT doc_id, start, stop, entity_type FROM {C.duck(C.GOLDS)}) UNION ALL SELECT 'predicted', count(*) FROM (SELECT doc_id, start, stop, entity_type FROM {C.duck(C.PREDS)} EXCEPT SELECT doc_id, start, stop, entity_type FROM {C.duck(C.GOLDS)}) UNION ALL SELECT 'gold', count(*) FROM (SELECT doc_id, start, stop, entity_type FROM {C.duck(C.GOLDS)} EXCEPT SELECT doc_id, start, stop, entity_type FROM {C.duck(C.PREDS)})")
def span_set_operations(spark, d):
    sides = evaluate.set_sides(C.frame(spark, d, C.PREDS), C.frame(spark, d, C.GOLDS))
    side = F.when(F.col("p") & F.col("g"), "both").when(F.col("p"), "predicted").otherwise("gold")
    counts = sides.groupBy(side.alias("side")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("both",), ("predicted",), ("gold",)], "side string")
    return F.broadcast(names).join(counts, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT DISTINCT run_id, entity_type FROM ({_MULTI})")
def union_of_keys(spark, d):
    return compare.multi_diff(C.frame(spark, d, C.RUNS), "run-1", ["entity_type"], "f1").select("run_id", "entity_type").distinct()


@query(f"SELECT run_id, entity_type, CASE WHEN delta IS NULL THEN 'n/a' ELSE printf('%+.4f', delta) END AS delta, CASE WHEN abs(baseline) > 1e-12 AND candidate IS NOT NULL THEN printf('%+.4f', delta / baseline * 100) ELSE 'n/a' END AS pct FROM ({_MULTI})")
def delta_format(spark, d):
    out = compare.multi_diff(C.frame(spark, d, C.RUNS), "run-1", ["entity_type"], "f1")
    return out.select("run_id", "entity_type", *[compare.shown(F.col(c)).alias(c) for c in ("delta", "pct")])


@query("SELECT * FROM (VALUES ('detector:02-SPACY', 2), ('detector:10-REGEX', 10), ('masker', 10000), ('07-X', 7)) AS t(component, place)")
def component_places(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('detector:02-SPACY'), ('detector:10-REGEX'), ('masker'), ('07-X') AS t(component)")
    return rows.select("component", compare.component_order(F.col("component")).alias("place"))


_NAMED_RUNS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'run-' || CAST(20240100 + o_orderkey % 20 AS STRING) || 'T' || CAST(o_orderkey AS STRING) ELSE 'other-' || CAST(o_orderkey AS STRING) END AS run_id, CAST('2024-01-01' AS TIMESTAMP) + o_orderkey % 19 * INTERVAL '1' DAY AS mtime FROM {orders}"


@query(f"WITH r AS (SELECT *, CASE WHEN run_id LIKE 'run-%' THEN substr(run_id, 5, 8) ELSE strftime(mtime, '%Y%m%d') END AS day FROM {C.duck(_NAMED_RUNS)}), l AS (SELECT * FROM r WHERE day = (SELECT max(day) FROM r)) SELECT run_id, day, (SELECT run_id FROM l ORDER BY mtime, run_id LIMIT 1) AS baseline FROM l")
def latest_day_runs(spark, d):
    return compare.latest_day(C.frame(spark, d, _NAMED_RUNS)).select("run_id", "day", "baseline")


# Statistics and plots.


@query("SELECT 'all' AS side, count(*) AS n, coalesce(min(v), 0)::DOUBLE AS min, coalesce(max(v), 0)::DOUBLE AS max, round(coalesce(avg(v), 0), 6)::DOUBLE AS mean FROM (SELECT o_totalprice::DOUBLE AS v FROM orders) UNION ALL SELECT 'none', 0, 0, 0, 0")
def stats_pack(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v"))
    pack = lambda x, side: metrics.pack(x, [], "v").select(F.lit(side).alias("side"), "n", "min", "max", exact6(F.col("mean")).alias("mean"))
    return pack(rows, "all").unionByName(pack(rows.where("false"), "none"))


@query(f"SELECT entity_type, part, n, CAST(sum(n) OVER (PARTITION BY entity_type ORDER BY k) - n AS BIGINT) AS base FROM (SELECT entity_type, 'tp' AS part, 1 AS k, tp AS n FROM (SELECT entity_type, sum(tp)::BIGINT AS tp FROM ({_EXACT}) GROUP BY 1) UNION ALL SELECT entity_type, 'fp', 2, fp FROM (SELECT entity_type, sum(fp)::BIGINT AS fp FROM ({_EXACT}) GROUP BY 1) UNION ALL SELECT entity_type, 'fn', 3, fn FROM (SELECT entity_type, sum(fn)::BIGINT AS fn FROM ({_EXACT}) GROUP BY 1))")
def plot_stacked_bars(spark, d):
    return plots.stacked(evaluate.summed(evaluate.counted(_pairs(spark, d), "exact", None)).where("entity_type is not null"), "entity_type", ["tp", "fp", "fn"])


@query(f"SELECT run_id AS bar, entity_type AS label, f1 AS value FROM {C.duck(C.RUNS)}")
def plot_grouped_bars(spark, d):
    return plots.grouped(C.frame(spark, d, C.RUNS), "run_id", "entity_type", "f1")
