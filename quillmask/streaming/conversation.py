"""Entity memory of conversations: the ids that earlier turns gave to mentions hold for later ones.

The rule is that of a cache: a mention known under its type keeps its id, new ones go on from the greatest. Turns of one
conversation are taken in order within a micro-batch; a turn that arrives after later ones is numbered when it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, turn long, ord int, entity_type string, mention string, id int"
_COLUMNS = ["conv_id", "turn", "ord", "entity_type", "mention", "id"]


def _number(rows: pd.DataFrame, known: dict[tuple[str, str], int], tops: dict[str, int]) -> pd.DataFrame:
    rows = rows.sort_values(["turn", "ord"], kind="stable")
    ids = []
    for kind, text in zip(rows["entity_type"], rows["mention"], strict=True):
        if (kind, text) not in known:
            tops[kind] = known[kind, text] = tops.get(kind, 0) + 1
        ids.append(known[kind, text])
    return rows.assign(id=ids)[_COLUMNS]


def numbered(mentions: DataFrame) -> DataFrame:
    """Batch: conv_id, turn, ord, entity_type, mention with id. First occurrences are numbered by expressions alone."""
    first = mentions.groupBy("conv_id", "entity_type", "mention").agg(F.min(F.struct("turn", "ord")).alias("first"))
    firsts = first.groupBy("conv_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("first", "mention"))).alias("all"))
    ids = firsts.select("conv_id", "entity_type", F.posexplode("all").alias("pos", "f")).select("conv_id", "entity_type", F.col("f.mention").alias("mention"), (F.col("pos") + 1).cast("int").alias("id"))
    return mentions.join(ids, ["conv_id", "entity_type", "mention"]).select(*_COLUMNS)


def numbered_stream(mentions: DataFrame) -> DataFrame:
    """Stream: the same with the memory as keyed state, append mode."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, texts, ids = state.get if state.exists else ([], [], [])
        known = {(k, t): i for k, t, i in zip(kinds, texts, ids, strict=True)}
        tops: dict[str, int] = {}
        for (k, _), i in known.items():
            tops[k] = max(tops.get(k, 0), i)
        out = _number(pd.concat(list(parts)), known, tops)
        state.update(([k for k, _ in known], [t for _, t in known], list(known.values())))
        yield out

    return mentions.groupBy("conv_id").applyInPandasWithState(update, OUT, "kinds array<string>, texts array<string>, ids array<int>", "append", GroupStateTimeout.NoTimeout)


def running_counts(found: DataFrame):
    """Streaming totals by type, for an output in complete mode."""
    return found.groupBy("entity_type").agg(F.count("*").alias("spans"))
