"""URL filters: each URL is expanded into host-suffix and path-prefix expressions, which meet the rules in an equi-join
on a short hash prefix; full digests confirm a hit and the longest rule wins.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's path. Expressions
are made only for the numbers of host labels and the path lengths that occur among the rules, so a very long URL makes no
more of them than the rules can use. Precedence: longest host and path together, then longest host, then block before
allow. Each distinct (host, path) is judged once, so copies of a hot URL are merged before any shuffle by expression.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased (a port or user
stays part of it); the path is the rest up to ``?``, ``#`` or the end. A null URL or one without ``://`` has empty host and
path and takes the default verdict. Repeated rows are judged alike and all kept; null ids are kept; an empty table gives an
empty result; no rules means the default for all; other columns are ignored. Null hosts or paths in a rule count as empty;
a rule with an empty host never fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import ascii_lower


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; rules has host, path, verdict."""
    rules = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host <> ''")
    shapes = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    labels, lengths = sorted(shapes["labels"]), sorted(shapes["lengths"])  # as many as there are label counts (127) and path lengths
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)  # noqa: E731  no host holds a line break and a slash in this order by accident: digests are confirmed
    short = lambda d: F.substring(d, 1, 2 * prefix_bytes)
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    distinct = urls.select("host", "path").distinct()
    asked = distinct.select("host", "path", F.explode(suffixes).alias("e_host")).withColumn("e_path", F.explode(prefixes)).withColumn("e_digest", digest(F.col("e_host"), F.col("e_path")))
    known = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path")))
    hits = asked.withColumn("short", short(F.col("e_digest"))).join(known.withColumn("short", short(F.col("r_digest"))), "short")
    hits = hits.where("e_digest = r_digest and e_host = r_host and e_path = r_path")
    rank = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), (F.col("r_verdict") == "block"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best"))
    found = urls.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
