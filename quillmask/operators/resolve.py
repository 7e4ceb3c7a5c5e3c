"""Entity resolution: mentions of one type in one document that look alike get one id.

Mentions are compared by the cosine of their character trigram counts; linked mentions form entities, numbered by first appearance.
A cache of known aliases gives its id to an entity that holds an alias exactly or is close enough to one; new ids go on from the
cache's greatest. Trigrams meet in an equi-join within document and type, so no pair without a common trigram is formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "entity_type"]


def trigrams(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed, between ^ and $; none for an empty mention."""
    t = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    p = F.concat(F.lit("^"), t, F.lit("$"))
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def vectors(names: DataFrame, keys: list[str], text: str = "mention") -> DataFrame:
    """keys, gram, n."""
    return names.select(*keys, F.explode(trigrams(F.col(text))).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def cosines(a: DataFrame, b: DataFrame, left: str, right: str, pair_filter: Column | None = None) -> DataFrame:
    """KEYS, left, right, cosine of all pairs with a common trigram; a and b have KEYS, an item column, gram, n."""
    norm = lambda v, item: v.groupBy(*KEYS, item).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dots = a.withColumnRenamed("n", "n1").join(b.withColumnRenamed("n", "n2"), [*KEYS, "gram"])
    dots = dots.where(pair_filter) if pair_filter is not None else dots
    dots = dots.groupBy(*KEYS, left, right).agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    dots = dots.join(norm(a, left).withColumnRenamed("norm", "norm1"), [*KEYS, left]).join(norm(b, right).withColumnRenamed("norm", "norm2"), [*KEYS, right])
    return dots.select(*KEYS, left, right, (F.col("dot") / (F.col("norm1") * F.col("norm2"))).alias("cosine"))


def named(mentions: DataFrame) -> DataFrame:
    """mentions (doc_id, entity_type, ord, start, mention) with node: the first ord of an equal mention; empty ones are alone."""
    same = Window.partitionBy(*KEYS, "mention", F.when(F.length(F.trim("mention")) == 0, F.col("ord")))
    return mentions.withColumn("node", F.min("ord").over(same))


def similar_pairs(mentions: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, entity_type, node_a < node_b, cosine of linked different mentions."""
    nodes = mentions.where("ord = node").select(*KEYS, "node", "mention")
    v = vectors(nodes, [*KEYS, "node"])
    a, b = v.withColumnRenamed("node", "node_a"), v.withColumnRenamed("node", "node_b")
    return cosines(a, b, "node_a", "node_b", F.col("node_a") < F.col("node_b")).where(F.col("cosine") >= threshold)


def components(mentions: DataFrame, pairs: DataFrame, everything: bool = False) -> DataFrame:
    """mentions with root: the least node of its component. Graphs are per document and type and hold that document's mentions only."""
    links = pairs.groupBy(*KEYS).agg(F.collect_list(F.array("node_a", "node_b")).alias("links"))
    graphs = mentions.groupBy(*KEYS).agg(F.array_sort(F.collect_set("node")).alias("nodes")).join(links, KEYS, "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            rows = []
            for d, t, nodes, edges in zip(part["doc_id"], part["entity_type"], part["nodes"], part["links"], strict=True):
                up = {int(n): int(n) for n in nodes}

                def top(n: int, up: dict[int, int] = up) -> int:
                    while up[n] != n:
                        up[n] = up[up[n]]
                        n = up[n]
                    return n

                for a, b in edges if edges is not None else ():
                    a, b = top(int(a)), top(int(b))
                    up[max(a, b)] = min(a, b)
                rows += [(d, t, n, int(nodes[0]) if everything else top(n)) for n in up]
            yield pd.DataFrame(rows, columns=["doc_id", "entity_type", "node", "root"])

    kind = mentions.schema["doc_id"].dataType.simpleString()
    roots = graphs.mapInPandas(run, f"doc_id {kind}, entity_type string, node int, root int")
    return mentions.join(roots, [*KEYS, "node"])


def resolved(mentions: DataFrame, threshold: float = 0.75, cache: DataFrame | None = None) -> DataFrame:
    """doc_id, entity_type, ord, id (int) for every mention.

    mentions: doc_id, entity_type, ord (int, unique in the document), start, mention. cache: doc_id, entity_type, id, alias.
    """
    rows = named(mentions)
    rows = components(rows, similar_pairs(rows, threshold), everything=threshold <= 0)
    groups = rows.groupBy(*KEYS, "root").agg(F.min(F.struct("start", "ord")).alias("first"))
    if cache is None:
        groups = groups.withColumn("known", F.lit(None).cast("int")).withColumn("top", F.lit(0))
    else:
        # Exact: the entity's first mention that is an alias decides; of ids that share an alias the later one holds it.
        owner = cache.groupBy(*KEYS, F.col("alias").alias("mention")).agg(F.max("id").alias("id"))
        exact = rows.join(owner, [*KEYS, "mention"]).groupBy(*KEYS, "root").agg(F.min_by("id", "ord").alias("exact"))
        members = vectors(rows.where("ord = node"), [*KEYS, "root", "node"]).select(*KEYS, F.struct("root", "node").alias("member"), "gram", "n")
        aliases = vectors(cache.distinct(), [*KEYS, "id", "alias"], "alias").select(*KEYS, F.struct("id", "alias").alias("known"), "gram", "n")
        near = cosines(members, aliases, "member", "known").where(F.col("cosine") >= threshold)
        near = near.groupBy(*KEYS, F.col("member.root").alias("root")).agg(F.max_by("known.id", F.struct("cosine", (-F.col("known.id")).alias("i"))).alias("near"))
        tops = cache.groupBy(*KEYS).agg(F.max("id").alias("top"))
        groups = groups.join(exact, [*KEYS, "root"], "left").join(near, [*KEYS, "root"], "left").join(tops, KEYS, "left")
        groups = groups.select(*KEYS, "root", "first", F.coalesce("exact", "near").cast("int").alias("known"), F.coalesce("top", F.lit(0)).alias("top"))
    fresh = Window.partitionBy(*KEYS, F.col("known").isNull()).orderBy("first")
    groups = groups.withColumn("id", F.coalesce("known", F.col("top") + F.row_number().over(fresh)).cast("int"))
    return rows.join(groups.select(*KEYS, "root", "id"), [*KEYS, "root"]).select("doc_id", "entity_type", "ord", "id")


def written_back(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Spans with the ids of (doc_id, start, stop, entity_type, ord, id); the last writer of equal bounds wins."""
    last = ids.groupBy("doc_id", "start", "stop", "entity_type").agg(F.max_by("id", "ord").cast("string").alias("_id"))
    return found.join(last, ["doc_id", "start", "stop", "entity_type"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
