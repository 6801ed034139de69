"""Mixing sources to target weights by Sainte-Laguë apportionment.

The corpus is cut into blocks of equal tokens. Sources win blocks by highest
quotients target / (2s - 1), every shard of a source wins part of its source's
blocks the same way, and the documents of a shard, in seeded order, give the
blocks that a seeded even selection names. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WORD_PATTERN, draw, fresh, settled, table, text_of

#: Tokens of a block, words of a shard, and the seed of all draws.
BLOCK, SHARD_WORDS, SEED = 16, 1 << 18, 20


def sainte_lague(rows: DataFrame, per_range: int = 4096) -> DataFrame:
    """(g, i, blocks) of rows (g, i, v, seats): the seats of each group go one by one to the highest quotient v / (2s - 1), ties to the smaller i.

    With all seats given, n of them to k rows of the sum V, the divisor lies
    between V / (n + k / 2) and V / (n - k / 2), as rounding moves each row by
    half a seat at most. Seats won at the larger divisor are sure, and between
    the two lie about k quotients, so the work is linear in the rows. These
    are counted by ranges of 1 / quotient, whose running sums show the one
    range in which the last seat falls; only inside a range are they ranked.
    Rows without v win nothing and are absent.
    """
    rows = rows.where("v > 0 AND seats > 0")
    k = F.col("k") / F.lit(2.0)
    per = rows.groupBy("g").agg(F.max("seats").alias("n"), F.sum("v").alias("all"), F.count("*").cast("double").alias("k"))
    low, high = F.greatest(F.lit(0.0), (F.col("n") - k) / F.col("all")) * (1 - 1e-9), (F.col("n") + k) / F.col("all") * (1 + 1e-9)
    per = per.select("g", "n", low.alias("low"), high.alias("high"), F.ceil(F.col("k") / per_range).alias("ranges"))
    seats_at = lambda x: F.floor(F.col("v") * F.col(x) + 0.5).cast("long")
    at = rows.drop("seats").join(per, "g").withColumn("sure", seats_at("low")).withColumn("upto", seats_at("high"))
    open_ = at.where("upto > sure").select("g", "i", "v", "low", "high", "ranges", F.explode(F.sequence(F.col("sure") + 1, F.col("upto"))).alias("s"))
    open_ = open_.withColumn("quotient", F.col("v") / (2 * F.col("s") - 1))
    place = (1 / F.col("quotient") - 2 * F.col("low")) / (2 * (F.col("high") - F.col("low"))) * F.col("ranges")
    open_ = open_.select("g", "i", "quotient", F.least(F.greatest(F.floor(place), F.lit(0)), F.col("ranges") - 1).alias("range"))
    left = at.groupBy("g").agg((F.max("n") - F.sum("sure")).alias("left_over"))
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = open_.groupBy("g", "range").agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    held = held.join(left, "g").where("before < left_over").select("g", "range", (F.col("left_over") - F.col("before")).alias("most"))
    ranked = open_.join(held, ["g", "range"]).withColumn("place", F.row_number().over(Window.partitionBy("g", "range").orderBy(F.col("quotient").desc(), "i")))
    won = ranked.where("place <= most").groupBy("g", "i").agg(F.count("*").alias("won"))
    return at.select("g", "i", "sure").join(won, ["g", "i"], "left").select("g", "i", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("blocks"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: float = 3.0) -> DataFrame:
    """(no, source, source_size, weight, target) from (source, size): shares of all sizes by weight, none above max_repeats of its source.

    Sources by code point, null last, take the weights in turn. Shares above
    their cap stop there and the excess is shared again by weight: with the
    sources ordered by cap / weight, the first k stop, k the smallest number
    for which the level of the others lies within the next one's cap. One row
    a source is gathered here, never a document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("no", F.row_number().over(by_name))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", turn).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the first source whose own cap reaches the level sets it for all, and levels only fall after it; before it every source stops at its cap
    open_level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight") * (1 + 1e-12), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("weight"))
    return per.select("no", "source", "source_size", "weight", target.alias("target"))


#: Equal rows that one task numbers.
EQUAL_ROWS = 1 << 16


def _numbered_copies(sized: DataFrame) -> DataFrame:
    """A row for each of the `equal` rows, numbered by `copy` from 1; many are dealt out before they are written out."""
    few = sized.where(F.col("equal") <= EQUAL_ROWS).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "equal")))
    many = sized.where(F.col("equal") > EQUAL_ROWS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(equal - 1) div {EQUAL_ROWS}"))))
    many = many.repartition("doc_id", "h", "part").withColumn("copy", F.explode(F.sequence(F.col("part") * EQUAL_ROWS + 1, F.least("equal", (F.col("part") + 1) * EQUAL_ROWS))))
    return few.unionByName(many.drop("part")).drop("equal")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, source, shard.

    taken is the words the mix takes of the document, repeats counted: whole
    passes over its shard plus its words in the blocks chosen of a last,
    partial pass. copies is the same in whole documents: the passes, plus one
    if the block at the document's middle is chosen. `block` is the tokens of a
    block, a shard of a source holds about `shard_words` words, and `seed`
    fixes shards, order and choice.

    Skew: a hot source has many shards, and rows equal in id, source and text
    are counted first and then numbered, so that they fall into shards like
    different ones; no task orders much more than a shard. Texts without words
    are ordered apart from it, in a thousand parts.
    Null texts have size 0 and are never taken; null sources form one source;
    null and repeated ids count as documents of their own; an empty table gives
    no rows; other columns are ignored.
    """
    n_words = F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words.alias("size"), draw(text_of()).alias("h"))
    sized = settled(sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("equal")))  # ids and sizes, so the texts are read once
    target = settled(source_targets(sized.select("source", (F.col("size") * F.col("equal")).alias("size")), weights, float(max_repeats)))  # a row a source
    asked = target.where("target > 0").select(F.lit(0).alias("g"), F.col("no").alias("i"), (F.col("target") / block).alias("v"))
    asked = asked.join(asked.groupBy("g").agg(F.round(F.sum("v")).alias("seats")), "g")
    won = sainte_lague(asked).select(F.col("i").alias("no"), "blocks")
    quota = target.join(won, "no", "left").select("no", "source", "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    quota = settled(quota.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words)))).cast("long")))
    # documents meet the quota of their source, a row each; the side with the sources is small enough for Spark to send out or is joined as is
    rows = _numbered_copies(sized).alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")), "inner")
    rows = rows.select("doc_id", F.col("d.source").alias("source"), "no", "size", "h", "copy", "source_size", "target", F.pmod(draw(F.col("doc_id"), F.col("h"), F.col("copy"), F.lit(seed)), F.col("n_shards")).alias("shard"))
    lengths = settled(rows.groupBy("no", "shard").agg(F.sum("size").alias("length")))  # a row a shard
    parts = lengths.join(quota.select("no", F.col("blocks").cast("double").alias("seats")), "no")
    parts = sainte_lague(parts.select(F.col("no").alias("g"), F.col("shard").alias("i"), F.col("length").cast("double").alias("v"), "seats"))
    shards = lengths.join(parts.select(F.col("g").alias("no"), F.col("i").alias("shard"), "blocks"), ["no", "shard"], "left")
    shards = shards.select("no", "shard", "length", F.least(F.coalesce("blocks", F.lit(0)) * block, F.lit(max_repeats) * F.col("length")).alias("words"))
    # texts without words take no place in their shard, however many they are, so they need no order among the others
    at = rows.join(shards, ["no", "shard"]).withColumn("idle", F.when(F.col("size") > 0, 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "copy"), F.lit(1023))).cast("int"))
    order = Window.partitionBy("no", "shard", "idle").orderBy(draw(F.col("doc_id"), F.col("copy"), F.lit(seed + 1)), "doc_id", "h", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    passes = F.when(F.col("length") > 0, F.expr("words div length")).otherwise(F.lit(0))
    at = at.withColumn("passes", passes).withColumn("rest", F.col("words") - F.col("passes") * F.col("length"))
    # of the n blocks of the shard, those at which floor((k + phase) * chosen / n) steps are taken: even, and shifted by the seed
    at = at.withColumn("n", F.ceil(F.col("length") / block)).withColumn("chosen", F.least(F.col("n"), F.round(F.col("rest") / block).cast("long")))
    at = at.withColumn("phase", F.pmod(draw(F.col("source"), F.col("shard"), F.lit(seed + 2)), F.greatest(F.col("n"), F.lit(1))))

    def picked(k: str) -> str:
        return f"(floor((({k}) + phase) * chosen / greatest(n, 1)) - floor(phase * chosen / greatest(n, 1)))"

    def words_before(x: str) -> str:
        k = f"(({x}) div {block})"
        return f"({picked(k)} * {block} + (({x}) - {k} * {block}) * ({picked(k + ' + 1')} - {picked(k)}))"

    middle = f"((start + size div 2) div {block})"
    at = at.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.expr(f"{words_before('start + size')} - {words_before('start')}").cast("long"))))
    at = at.withColumn("once", F.when(F.col("size") > 0, F.expr(f"{picked(middle + ' + 1')} - {picked(middle)}").cast("long")).otherwise(F.lit(0)))
    taken = F.least(F.col("passes") * F.col("size") + F.col("part"), F.lit(max_repeats) * F.col("size"))
    copies = F.least(F.col("passes") + F.col("once"), F.lit(max_repeats))
    return at.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"), "source", "shard", "h")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("h")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it takes them, with all their columns.

    The decisions (one per id, source and text) go back to the documents by id
    and text hash, so rows without an id keep their own decision too. Rows equal
    in all three can't be told apart: each gets the rounded mean of their copies,
    which departs from `taken` by half a copy a row at most. Texts without words
    are never taken; an empty table stays empty; columns of any name pass through.
    """
    key = {c: fresh(c) for c in ("id", "source", "hash", "copies", "copy", "own")}  # names that docs can't hold
    mixed = mix_sources(docs).groupBy(F.col("doc_id").alias(key["id"]), F.col("source").alias(key["source"]), F.col("h").alias(key["hash"])).agg(F.round(F.avg("copies")).cast("int").alias(key["copies"])).where(F.col(key["copies"]) > 0)
    keyed = docs.withColumn(key["own"], draw(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col(key["id"])) & F.col("source").cast("string").eqNullSafe(F.col(key["source"])) & (F.col(key["own"]) == F.col(key["hash"]))
    taken = keyed.join(mixed, same).withColumn(key["copy"], F.explode(F.sequence(F.lit(1), F.col(key["copies"]))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
