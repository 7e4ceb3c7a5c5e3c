"""The contract's queries over the training-data operators, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, fingerprint, line_dedup, lm_score, packing, quality, simhash, toxicity, url_filter
from ._base import crc_mod

#: The rules that op8 is given: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The turns that op7 is given besides the table's.
PROBE = "\\### Assistant: </turn> ok"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A few rows as a local relation, whose size the planner knows."""
    quoted = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)} AS t({columns})")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    scores = toxicity.scores(docs, model)
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 10) == 0
    scores = lm_score.score(table(spark, sf_dir, "documents"), ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint.classed(fingerprint.compare_edited(docs), docs)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = values(spark, "conv_id, turn, role, text", [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)])
    probe = probe.select(*[F.col(c).cast(turns.schema[c].dataType) for c in turns.columns])
    return chat_format.digests(chat_format.format_chats(turns.unionByName(probe)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), values(spark, "host, path, verdict", list(URL_RULES)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


#: White space that parts words, as in str.split.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^{_SPACE}]+[{_SPACE}]*') AS pieces FROM d)),
w AS (
  SELECT doc_id, i, piece, md5(string_agg(regexp_replace(piece, '[{_SPACE}]+$', ''), ' ') OVER f) AS own, count(*) OVER f AS n
  FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
o AS (SELECT own, min(doc_id) AS earliest FROM w WHERE n = 40 GROUP BY own),
g AS (SELECT doc_id, i, piece, n = 40 AND coalesce(earliest < doc_id, false) AS gone FROM w LEFT JOIN o USING (own)),
k AS (SELECT doc_id, i, piece, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS lost FROM g)
SELECT d.doc_id, regexp_extract(any_value(d.text), '^[{_SPACE}]*') || coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT lost), '') AS text,
  count(*) FILTER (WHERE lost) AS n_deleted
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""

OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same, row_number() OVER w AS n,
    CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 END AS label,
    length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS body
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + 7 + CASE WHEN same THEN 0 ELSE label + 7 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(h, pth, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (
  SELECT p.*, h || pth AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pth) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, pth))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE n = 1
"""

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_lm_score, op4_packing, op5_fingerprint, op6_simhash, op7_chat_format, op8_url_filter, op9_quality, op10_bpe)}
ORACLES = {"op1_line_dedup": OP1_SQL, "op7_chat_format": OP7_SQL, "op8_url_filter": OP8_SQL}
