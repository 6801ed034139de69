"""Ordered operators over a whole table without a task that orders it all."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced(rows: DataFrame, order: str, rows_per_slice: int) -> DataFrame:
    """rows with a column `slice` that grows with the numeric column `order`: cuts at quantiles, equal values together."""
    n = rows.count()
    k = max(1, min(100_000, math.ceil(n / rows_per_slice)))
    cuts = []
    if k > 1:
        cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / k for i in range(1, k)], 10 * k).alias("c")).first()["c"] or []))
    # a coarse search finds the chunk of cuts, a fine one the place in it, so a row meets few of them
    step = max(1, math.isqrt(len(cuts)))
    constant = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    value = F.col(order).cast("double")
    upto = F.size(F.filter(constant(cuts[::step], "array<double>"), lambda c: c <= value))
    chunks = constant([cuts[i : i + step] for i in range(0, len(cuts), step)], "array<array<double>>")
    place = (upto - 1) * step + F.size(F.filter(F.element_at(chunks, upto), lambda c: c <= value))
    return rows.withColumn("slice", F.when(F.col(order).isNull(), -1).when(upto == 0, 0).otherwise(place))


def running(rows: DataFrame, order: str, ties: list[str], value: Column, rows_per_slice: int = 65_536) -> DataFrame:
    """rows with `position` (from 1) and `running` (sum of value so far), by order, then the columns of ties.

    Slices are summed on their own and shifted by the slices before; only one
    row a slice is ordered in one task.
    """
    cut = sliced(rows.withColumn("__v", value), order, rows_per_slice)
    inner = Window.partitionBy("slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    per = cut.groupBy("slice").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    out = cut.withColumn("position", F.count("*").over(inner)).withColumn("running", F.sum("__v").over(inner)).join(per, "slice")
    return out.withColumn("position", F.col("position") + F.col("__n")).withColumn("running", F.col("running") + F.col("__s")).drop("slice", "__v", "__n", "__s")


def every_nth(rows: DataFrame, order: str, ties: list[str], n: int) -> DataFrame:
    """Every n-th row by order, the first included."""
    return running(rows, order, ties, F.lit(0)).where((F.col("position") - 1) % n == 0).drop("running")


def exponential_mean(rows: DataFrame, order: str, ties: list[str], value: Column, span: int = 400) -> DataFrame:
    """rows with `ewm`, the adjusted exponentially weighted mean of value so far.

    A slice, in which equal order values stand together, is summed in blocks of
    ten spans, so that no weight leaves a double; a block gets the weighted sums
    of the sixteen before it, behind which weights are below 1e-17.
    """
    q, size = 1 - 2 / (span + 1), 10 * span
    cut = sliced(rows.withColumn("__v", value.cast("double")), order, max(4096, size))
    at = F.row_number().over(Window.partitionBy("slice").orderBy(order, *ties)) - 1
    cut = cut.withColumn("__at", at).withColumn("__block", F.expr(f"__at div {size}")).withColumn("__i", F.col("__at") % size + 1)
    upto = Window.partitionBy("slice", "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.pow(F.lit(q), -F.col("__i")), F.pow(F.lit(q), F.col("__i"))
    cut = cut.withColumn("__a", F.sum(F.col("__v") * up).over(upto) * down).withColumn("__b", F.sum(up).over(upto) * down)
    per = cut.groupBy("slice", "__block").agg(F.max("__i").alias("n"), F.max_by("__a", "__i").alias("a"), F.max_by("__b", "__i").alias("b"))
    earlier = F.collect_list(F.struct("n", "a", "b")).over(Window.orderBy("slice", "__block").rowsBetween(-16, -1))  # a row a block
    carry = lambda c: F.aggregate(F.col("__e"), F.lit(0.0), lambda s, x: s * F.pow(F.lit(q), x["n"]) + x[c])
    per = per.withColumn("__e", earlier).select("slice", "__block", carry("a").alias("__ca"), carry("b").alias("__cb"))
    out = cut.join(per, ["slice", "__block"])
    return out.withColumn("ewm", (F.col("__a") + F.col("__ca") * down) / (F.col("__b") + F.col("__cb") * down)).drop("slice", "__v", "__at", "__block", "__i", "__a", "__b", "__ca", "__cb")


def cumulative_share(rows: DataFrame, value: str) -> DataFrame:
    """Empirical distribution: (value, share of rows at or below it), one row a distinct value."""
    per = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("held"))
    out = running(per, value, [], F.col("held"))
    total = per.agg(F.sum("held").alias("total"))
    return out.crossJoin(total).select(value, (F.col("running") / F.col("total")).alias("share"))
