"""Statistics of runs and the tables of an evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import error_probability, log_base, lower_count
from strandloom.operators.windows import running

#: Limits beyond which a run counts as failed: seconds and megabytes.
TIME_LIMIT, MEMORY_LIMIT = 3600, 20_000
#: Names of algorithms for display, in the order of reports.
ALGORITHMS = (("astar-seeds", "seeds"), ("astar-prefix", "prefix"), ("dijkstra", "Dijkstra"))
#: Columns of runs, their names on an axis and their units.
AXES = (
    ("head", "Reference size [bp]", "bp"),
    ("head_Mbp", "Reference size [Mbp]", "Mbp"),
    ("s", "Runtime [s]", "s"),
    ("N", "Reads", ""),
    ("m", "Read length [bp]", "bp"),
    ("max_rss", "Memory", "MB"),
    ("score", "Alignment cost", None),
    ("explored_states", "Explored states", None),
    ("align_sec", "Alignment time [s]", None),
    ("cost", "Alignment cost", None),
    ("explored_per_bp", "Explored states per bp", None),
    ("error_rate", "Error rate", None),
    ("bps", "Alignment rate [bp/s]", "bp/s"),
    ("spkb", "Alignment time [s/kbp]", None),
)


def merged_counters(rows: DataFrame, counters: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of counters over all rows or by group; partial sums combine before the shuffle."""
    return rows.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in counters])


def read_statistics(reads: DataFrame, n_edges: int | None = None) -> DataFrame:
    """One row: n_reads, size_sum (lengths less one), avg_size, phred_error of reads (seq, phred), coverage of the edges of one strand pair."""
    codes = F.split(F.coalesce("phred", F.lit("")), "")
    errors = F.aggregate(codes, F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a + error_probability(c)))
    out = reads.agg(F.count("*").alias("n_reads"), F.sum(F.length("seq") - 1).alias("size_sum"), F.avg(F.length("seq") - 1).alias("avg_size"), (F.sum(errors) / F.sum(F.length("seq") - 1)).alias("phred_error"))
    return out if n_edges is None else out.withColumn("coverage", F.col("size_sum") / F.lit(float(max(1, n_edges // 2))))


def alignment_summary(alignments: DataFrame) -> DataFrame:
    """One row of the totals of alignments (read_id, rank, status, cost, spell)."""
    first = alignments.where("rank = 1")
    share = lambda s: (100.0 * F.count_if(F.col("status") == s) / F.count("*")).alias(f"{s}_percent")
    return first.agg(
        F.count("*").alias("n_reads"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("avg_cost"), F.max("cost").alias("max_cost"),
        F.sum(lower_count(F.col("spell"))).alias("edits"), share("unique"), share("ambiguous"), share("overcost"),
    )


def path_summary(alignments: DataFrame, match: int = 0, subst: int = 1, ins: int = 5, dele: int = 5) -> DataFrame:
    """(etype, n, cost) over the steps of all paths."""
    from strandloom.functions.sequence import edge_cost

    steps = alignments.select(F.explode("path").alias("s")).select("s.etype")
    return steps.groupBy("etype").agg(F.count("*").alias("n"), F.sum(edge_cost(F.col("etype"), match, subst, ins, dele)).alias("cost"))


def with_rates(runs: DataFrame) -> DataFrame:
    """Derived columns of alignment rows: rates per base pair and the error rate."""
    return runs.withColumns({
        "pushed_popped": F.col("pushed") + F.col("popped"),
        "explored_per_bp": F.col("explored_states") / F.col("len"),
        "t_map_per_bp": F.col("t(map)") / F.col("len"),
        "crumbs_per_bp": F.col("crumbs") / F.col("len"),
        "error_rate": F.col("cost") / F.col("len"),
    })


def with_throughput(runs: DataFrame, letters: Column, seconds: Column, megabytes: Column) -> DataFrame:
    """s_per_kbp, kbp_per_s and memory in GB."""
    kbp = letters / F.lit(1000.0)
    return runs.withColumns({"s_per_kbp": seconds / kbp, "kbp_per_s": F.when(seconds > 0, kbp / seconds), "memory_gb": megabytes / F.lit(1000.0)})


def with_technology_throughput(runs: DataFrame) -> DataFrame:
    """bps, spkb, kbps, GB and head_Mbp of benchmark rows, each by its own technology; an unknown one raises, and a quotient by 0 is null.

    Letters are reads times length for illumina, coverage (N) times head for
    hifi, and coverage per 5 million letters of head for hifi-natural, where
    head cancels out.
    """
    tech = F.col("sequencing_technology")
    letters = F.when(tech == "hifi-natural", F.col("N") * F.lit(5e6)).when(tech == "illumina", (F.col("N") * F.col("m")).cast("double")).when(tech == "hifi", (F.col("N") * F.col("head")).cast("double"))
    letters = letters.otherwise(F.raise_error(F.concat(F.lit("unknown technology "), F.coalesce(tech, F.lit("null")))).cast("double"))
    rows = runs.withColumn("bps", F.try_divide(letters, F.col("s").cast("double")))
    return rows.withColumns({"spkb": F.try_divide(F.lit(1e3), F.col("bps")), "kbps": F.col("bps") * F.lit(1e-3), "GB": F.col("max_rss") * F.lit(1e-3), "head_Mbp": F.col("head") / F.lit(1e6)})


def within_limits(runs: DataFrame, seconds: str, megabytes: str) -> DataFrame:
    """Runs at or below both limits."""
    return runs.where((F.col(seconds) <= TIME_LIMIT) & (F.col(megabytes) <= MEMORY_LIMIT))


def complete_rows(runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in the columns, or in any."""
    return runs.dropna(subset=columns)


def ranked_algorithms(runs: DataFrame, column: str = "algo") -> DataFrame:
    """Algorithms by their display name and rank; unknown ones keep theirs and come last."""
    names = reduce(lambda c, x: c.when(F.col(column) == x[0], x[1]), ALGORITHMS, F.when(F.lit(False), ""))
    order = reduce(lambda c, x: c.when(F.col(column) == x[1][0], x[0]), enumerate(ALGORITHMS), F.when(F.lit(False), -1))
    return runs.withColumn("algo_rank", order.otherwise(len(ALGORITHMS))).withColumn("algo_name", names.otherwise(F.col(column)))


def group_means(runs: DataFrame, algo: str, x: str, y: str) -> DataFrame:
    """Means of y by (algo, x), and by algo over its rows with x 'all', in one reading: both groupings combine in the map tasks."""
    rows = runs.select(algo, F.col(x).cast("string").alias(x), y)
    per = rows.groupingSets([[F.col(algo), F.col(x)], [F.col(algo)]], algo, x).agg(F.avg(y).alias("mean"), F.count(y).alias("n"), F.grouping(x).alias("__every"))
    return per.select(algo, F.when(F.col("__every") == 1, "all").otherwise(F.col(x)).alias(x), "mean", "n")


def pivot_means(runs: DataFrame, x: str, algo: str, names: list[str], y: str) -> DataFrame:
    """A row a value of x, the mean of y of each algorithm side by side."""
    return runs.groupBy(x).pivot(algo, names).agg(F.avg(y))


def log_linear(means: DataFrame, algo: str, x: str, y: str) -> DataFrame:
    """Fit ln y = a x + b per algorithm over rows with positive y: (algo, slope, intercept, base) with base = exp(slope)."""
    ln = F.log(F.col(y))
    fit = means.where(F.col(y) > 0).groupBy(algo).agg(F.regr_slope(ln, F.col(x).cast("double")).alias("slope"), F.regr_intercept(ln, F.col(x).cast("double")).alias("intercept"))
    return fit.withColumn("base", F.exp("slope"))


def growth(slope: Column, x0: float, x1: float) -> Column:
    return F.exp(slope * (x1 - x0))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, cumulative): counts in equal bins of [low, high], 0 and bins + 1 hold what lies outside."""
    at = F.expr(f"width_bucket(CAST({value} AS double), CAST({low} AS double), CAST({high} AS double), {bins})")
    per = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return per.withColumn("cumulative", F.sum("n").over(Window.orderBy("bin")))


def binned_means(rows: DataFrame, bin_of: Column, y: str) -> DataFrame:
    return rows.groupBy(bin_of.alias("bin")).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))


def medians(rows: DataFrame, by: str, y: str) -> DataFrame:
    return rows.groupBy(by).agg(F.median(y).alias("median"))


def share_of_max(rows: DataFrame, by: str, y: str) -> DataFrame:
    """(by, total, share): sums of y, and them over the largest."""
    per = rows.groupBy(by).agg(F.sum(y).alias("total"))
    return per.withColumn("share", F.col("total") / F.max("total").over(Window.partitionBy()))


def depth_marker(runs: DataFrame, edges: str) -> DataFrame:
    return runs.agg(F.floor(log_base(4, F.avg(edges))).cast("int").alias("depth"))


def with_reference_edges(runs: DataFrame) -> DataFrame:
    return runs.withColumn("doubled_edges", F.col("total_edges") - F.col("trie_edges"))


def stacked_edges(runs: DataFrame, x: str) -> DataFrame:
    """Means by x of the edges of the doubled graph (`reference`), of the trie, and of the one on top of the other (`total`)."""
    per = with_reference_edges(runs).groupBy(x).agg(F.avg("doubled_edges").alias("reference"), F.avg("trie_edges").alias("trie"))
    return per.withColumn("total", F.col("reference") + F.col("trie"))


def with_axis(rows: DataFrame, column: str = "measure") -> DataFrame:
    """rows with `label` and `unit` of the run column that each names; unknown names stand for themselves."""

    def shown(at: int) -> Column:
        known = [x for a in AXES if a[at] is not None for x in (F.lit(a[0]), F.lit(a[at]))]
        return F.coalesce(F.element_at(F.create_map(*known), F.col(column)), F.col(column))

    return rows.withColumn("label", shown(1)).withColumn("unit", shown(2))


def column_means(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, mean, highest, label, unit): each column of runs with its mean and highest value, from one aggregation."""
    per = runs.agg(*[F.struct(F.avg(c).alias("mean"), F.max(c).cast("double").alias("highest")).alias(c) for c in columns])
    each = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c)["mean"].alias("mean"), F.col(c)["highest"].alias("highest")) for c in columns])).alias("r"))
    return with_axis(each.select("r.*"))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "readname", columns: tuple[str, ...] = ("spell", "cost")) -> DataFrame:
    """(key, verdict) of a full outer join: left, right, the first column that differs, or equal."""
    x, y = a.select(F.col(key).alias("ka"), *[F.col(c).alias(f"a_{c}") for c in columns]), b.select(F.col(key).alias("kb"), *[F.col(c).alias(f"b_{c}") for c in columns])
    met = x.join(y, F.col("ka") == F.col("kb"), "full_outer")
    verdict = F.when(F.col("kb").isNull(), "left").when(F.col("ka").isNull(), "right")
    for c in columns:
        verdict = verdict.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c)
    return met.select(F.coalesce("ka", "kb").alias(key), verdict.otherwise("equal").alias("verdict"))


def missing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, repeats counted."""
    return a.exceptAll(b)


def parameter_grid(spark, **values: list) -> DataFrame:
    """The cross product of small lists of parameters."""
    frames = [spark.createDataFrame([(v,) for v in vs], [name]) for name, vs in values.items()]
    return reduce(lambda x, y: x.crossJoin(y), frames)


def paste(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two tables side by side, by position: the order of a numeric column, then of further ones. What is longer is cut.

    Positions are counted in slices, so no task orders a table.
    """
    placed = [running(rows, by[0], by[1:], F.lit(0)).drop("running").withColumnRenamed("position", "__p") for rows, by in ((a, order_a), (b, order_b))]
    return placed[0].join(placed[1], "__p").drop("__p")


def last_rows(rows: DataFrame, by: str, position: str) -> DataFrame:
    """Of each group the row with the largest position."""
    last = rows.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), position).alias("r"))
    return last.select(by, "r.*")


def all_runs(*runs: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), runs)
