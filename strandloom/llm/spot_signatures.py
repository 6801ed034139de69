"""Document fingerprints by SpotSigs (Theobald et al., 2008), from DataFrame functions only.

Common words are anchors. A signature is an anchor, or a run of them, with the
chain of content words that follows it. A document's fingerprint digests its
set of signatures; sets are partitioned by length and compared by a Jaccard
coefficient that a bound on the lengths can prune.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import draw, settled, table, text_of

#: The anchors, frequent function words of several languages.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were with "
    "aber als auch auf aus bei das dem den der des die ein eine er es im ist mit nicht sich sie und von war wie zu "
    "au aux dans de des du elle en est et il la le les ne pas pour qui que sur un une "
    "al como con del el ella en es esa ese los las lo más no para por se su un una y"
).split()

#: Content words without an anchor after which every one starts a chain.
GAP = 4
#: Likeness that the length partitions serve.
THRESHOLD = 0.8


def _anchored(text: Column, anchors: list[str]) -> Column:
    """Words of a text in order, each run of anchors glued with ':' before the content word that follows it."""
    either = "|".join(sorted(set(anchors), key=lambda w: (-len(w), w)))
    glued = F.regexp_replace(F.regexp_replace(F.lower(text), ":", " "), rf"(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]*+", "$1:")
    return F.filter(F.split(glued, r"[^\p{L}\p{N}:]++"), lambda w: w != "")


def signatures(text: Column, anchors: list[str] = ANCHORS) -> Column:
    """Sorted distinct 60-bit signatures of a text: anchor run, content word, next content word.

    A content word with no anchor before it nor before the GAP - 1 content words
    ahead of it starts a chain too, so lists and texts in other languages are
    covered; the rule is local, and an edit changes no signature far from it. A
    text without words has no signature.
    """

    def chain(w: Column, i: Column, ws: Column) -> Column:
        near = F.slice(ws, F.greatest(i - (GAP - 2), F.lit(1)), F.least(i + 1, F.lit(GAP)))
        starts = F.contains(w, F.lit(":")) | ~F.exists(near, lambda x: F.contains(x, F.lit(":")))
        following = F.substring_index(F.get(ws, i + 1), ":", -1)
        return F.when(starts, draw(w, following))

    # an array of one, transformed, binds the words once
    bound = F.transform(F.array(_anchored(text, anchors)), lambda ws: F.transform(ws, lambda w, i: chain(w, i, ws)))[0]
    return F.array_sort(F.array_distinct(F.filter(bound, lambda s: s.isNotNull())))


def fingerprint(sigs: Column) -> Column:
    """Digest of a signature set: its size and the MD5 of its sorted members."""
    joined = F.array_join(sigs.cast("array<string>"), ",")
    return F.concat(F.lpad(F.lower(F.hex(F.size(sigs))), 8, "0"), F.lit("-"), F.md5(joined.cast("binary")))


def length_partition(sigs: Column, threshold: float) -> Column:
    """Partition by set length: sets two or more partitions apart can't reach the threshold."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.lit(-math.log(threshold))).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets; 1 for two empty ones. A pair with an empty side is pruned."""
    shared = F.size(F.array_intersect(a, b))
    bound = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(bound == 0, F.lit(0.0)).otherwise(
        F.transform(F.array(shared), lambda s: s.cast("double") / (F.size(a) + F.size(b) - s))[0]
    )


def _constant(values: list, kind: str) -> Column:
    """A literal array of any size, one expression in the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _slices(rows: DataFrame, rows_per_slice: int) -> tuple[list[int], dict[int, int]]:
    """Cuts of doc_id into slices at quantiles (one bounded sketch), and of slices filled by one repeated id, or by null ids, the number of parts they need."""
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    k = max(1, min(200_000, math.ceil(n / rows_per_slice)))
    cuts = []
    if k > 1:
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k).alias("c")).first()["c"] or []))
    one = F.min("doc_id").eqNullSafe(F.max("doc_id"))
    held = rows.select("doc_id", _slice_of(cuts).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"), one.alias("one"))
    hot = held.where(F.col("one") & (F.col("n") > 4 * rows_per_slice)).collect()  # slices of one id alone
    return cuts, {r["slice"]: min(200_000, math.ceil(r["n"] / rows_per_slice)) for r in hot}


def _slice_of(cuts: list[int]) -> Column:
    """The number of cuts at or below the id, null ids behind the last: a coarse step finds the chunk, a fine one the place in it."""
    step = max(1, math.isqrt(len(cuts)))
    coarse = _constant(cuts[::step], "array<bigint>")
    chunks = _constant([cuts[i : i + step] for i in range(0, len(cuts), step)], "array<array<bigint>>")
    upto = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
    fine = F.size(F.filter(F.element_at(chunks, upto), lambda c: c <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).when(upto == 0, F.lit(0)).otherwise((upto - 1) * step + fine).cast("int")


def with_next(docs: DataFrame, rows_per_slice: int = 4096) -> DataFrame:
    """(slice, lent, doc_id, h, text, held): the distinct rows (id, text) of the table in slices, held the number of times each stands there.

    Their order is by id, null ids last, equal ids by a draw `h` on the text;
    each row's next is the following in its slice. The first row of a slice
    also goes, marked lent, to the slice before it (that of the whole table to
    the last), so that no task orders the table. Slices are cut at quantiles of
    the id. Where one id, or null, fills slices alone, its equal rows are first
    gathered with map-side counts and the rest is cut into even parts of h. One
    row a slice is collected; there are up to 200,000, which grow beyond 200,000
    times rows_per_slice rows.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    cuts, parts = _slices(docs.select("doc_id"), rows_per_slice)
    drawn = rows.withColumn("base", _slice_of(cuts)).withColumn("h", draw(F.col("text"))).withColumn("held", F.lit(1).cast("long"))
    number, n_slices = [], 0  # of the first part of each base slice
    for i in range(len(cuts) + 2):
        number.append(n_slices)
        n_slices += parts.get(i, 1)
    first = F.element_at(_constant(number, "array<int>"), F.col("base") + 1)
    if parts:
        hot = F.col("base").isin(*parts)
        once = drawn.where(hot).groupBy("base", "doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("held"))
        drawn = drawn.where(~hot).unionByName(settled(once.select("doc_id", "text", "base", "h", "held")))
        many = F.element_at(_constant([parts.get(i, 1) for i in range(len(cuts) + 2)], "array<int>"), F.col("base") + 1)
        first = first + F.least(many - 1, F.floor(F.col("h") / F.lit(float(1 << 60)) * many).cast("int"))
    placed = drawn.withColumn("slice", first.cast("int")).drop("base")
    heads = sorted((r["slice"], *r["d"]) for r in placed.groupBy("slice").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), "h")).alias("d")).collect())  # one row a slice
    ids, draws, before = [None] * n_slices, [None] * n_slices, [None] * n_slices
    for i, (s, d, h) in enumerate(heads):
        ids[s], draws[s], before[s] = d, h, heads[i - 1][0]
    at = F.col("slice") + 1
    lends = (F.element_at(_constant(ids, "array<bigint>"), at) == F.coalesce("doc_id", F.lit(0))) & (F.element_at(_constant(draws, "array<bigint>"), at) == F.col("h"))
    own = F.struct(F.col("slice").alias("slice"), F.lit(False).alias("lent"))
    lent = F.struct(F.element_at(_constant(before, "array<int>"), at).alias("slice"), F.lit(True).alias("lent"))
    goes = F.when(lends, F.array(own, lent)).otherwise(F.array(own))
    out = placed.withColumn("goes", F.explode(goes)).select(F.col("goes.slice").alias("slice"), F.col("goes.lent").alias("lent"), "doc_id", "h", "text", "held")
    return out.repartition("slice").groupBy("slice", "lent", "doc_id", "h").agg(F.first("text").alias("text"), F.sum("held").alias("held"))


def fingerprints(docs: DataFrame, *, anchors: list[str] = ANCHORS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_part.

    The edited text replaces the last floor(n_chars / 2) code points by the
    first as many (or all) of the next document, the next other row by id; of
    equal ids by a draw on the text; null ids come last, and after the last
    comes the first. Null texts read as empty: no signature, and likeness 1 to
    another text without any. Rows equal in id and text are one document and
    give as many equal rows; a document alone is its own next; texts of any
    length are read whole; an empty table gives no rows; other columns are
    ignored. Texts are shuffled once, and signed behind the shuffle.
    """
    placed = with_next(docs).withColumn("sigs", signatures(F.col("text"), anchors))
    order = Window.partitionBy("slice").orderBy("lent", F.col("doc_id").asc_nulls_last(), "h")
    paired = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)).where("NOT lent")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.select("doc_id", "held", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    edited = edited.withColumn("edited_sigs", signatures(F.col("edited"), anchors))
    out = edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
        length_partition(F.col("sigs"), threshold).alias("length_part"),
        "held",
    )
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("held")))).drop("__copy", "held")


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
