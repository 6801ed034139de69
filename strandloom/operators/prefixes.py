"""The prefix heuristic: least cost of aligning the next letters from a node, capped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import edit_edges
from strandloom.operators.lineage import settled


def reach(length: int, cap: int = 5, dele: int = 5) -> int:
    """The most edges that an alignment of so many letters passes at a cost below the cap, where deletions cost something: one a letter, and the deletions below the cap."""
    return length + (cap - 1) // dele


def prefix_costs(edges: DataFrame, wanted: DataFrame, cap: int = 5, match: int = 0, subst: int = 1, ins: int = 5, dele: int = 5) -> DataFrame:
    """(node, prefix, cost) for wanted (node, prefix): min(cap, least edit cost of the prefix over walks from the node).

    States (key, letter index, node) at a cost below the cap are relaxed letter
    by letter, deletions first until none improves; distinct pairs are computed
    once. With node classes, pass representatives and join the cost back.
    """
    keys = settled(wanted.select("node", "prefix").distinct())
    state = keys.select(F.col("node").alias("k_node"), "prefix", F.col("node").alias("at"), F.lit(0).alias("cost"))
    length = keys.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("n")).first()["n"]
    price = F.when(F.col("move") == "ORIG", match).when(F.col("move") == "SUBST", subst).when(F.col("move") == "INS", ins).otherwise(dele)
    done = None

    def best(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("cost") < cap).groupBy("k_node", "prefix", "at").agg(F.min("cost").alias("cost"))

    for i in range(length + 1):
        state = settled(best(state))
        while dele < cap:
            along = state.join(edges.select(F.col("src").alias("at"), "dst"), "at").select("k_node", "prefix", F.col("dst").alias("at"), (F.col("cost") + dele).alias("cost"))
            closed = settled(best(state.unionByName(along)))
            same = closed.agg(F.count("*").alias("n"), F.sum("cost").alias("c")).first() == state.agg(F.count("*").alias("n"), F.sum("cost").alias("c")).first()
            state = closed
            if same:
                break
        ended = state.where(F.length("prefix") == i).select("k_node", "prefix", "cost")
        done = ended if done is None else done.unionByName(ended)
        going = state.where(F.length("prefix") > i).select("k_node", "prefix", "cost", F.col("at").alias("node"), F.substring("prefix", F.lit(i + 1), F.lit(1)).alias("letter"))
        moved = edit_edges(going, edges).where("move <> 'DEL'")
        state = moved.select("k_node", "prefix", F.col("to").alias("at"), (F.col("cost") + price).alias("cost"))
    low = done.groupBy(F.col("k_node").alias("node"), "prefix").agg(F.min("cost").alias("low"))
    return keys.join(low, ["node", "prefix"], "left").select("node", "prefix", F.least(F.lit(cap), F.coalesce("low", F.lit(cap))).alias("cost"))


def prefix_bound(ahead: str, wanted: str, prices: tuple[int, int, int, int], cap: int) -> int:
    """min(cap, least edit cost of the wanted letters over the walk that spells `ahead` from here, or a part of it)."""
    match, subst, ins, dele = prices
    row = [min(cap, j * dele) for j in range(len(ahead) + 1)]
    for c in wanted:
        new = [row[0] + ins]
        for j, x in enumerate(ahead):
            new.append(min(row[j] + (match if x == c else subst), row[j + 1] + ins, new[j] + dele))
        row = new
    return min(cap, min(row))


def word_cost(ahead: Column, wanted: Column, cap: int = 5, match: int = 0, subst: int = 1, ins: int = 5, dele: int = 5) -> Column:
    """prefix_bound of two columns. Exact for a node without branches ahead if `ahead` has the wanted letters' number and one for every deletion below the cap, or ends with its walk."""

    @F.pandas_udf("int")
    def cost(a: pd.Series, w: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, prefix_bound(*p, (match, subst, ins, dele), cap)) for p in zip(a, w, strict=True)], dtype="int32")

    return cost(ahead, wanted)
