"""Best-fit packing of documents into bins of equal capacity, under conflicts.

Bins are ordered by residual. Each carries a bitmap of its sources and one of
its duplicate clusters; a document goes to the tightest bin with room for it,
and where that bin conflicts the successor search goes on to the next one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import WORD_PATTERN, settled, table, text_of


class Bins:
    """Open bins of a shard; the set of residuals in use is one integer's bits, so the successor is a shift away.

    Bins of one residual stand in groups by what is full in them: sources
    without a free slot, and clusters that they hold. A residual whose bins are
    all full for the item is passed by in one step, a group in another, so a
    source that fills its slots everywhere costs no scan of its bins.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[dict[frozenset, dict[int, None]]] = [{} for _ in range(capacity + 1)]
        self.count = [0] * (capacity + 1)
        self.held: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
        self.used = 0
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.full: list[frozenset] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for an item; a new bin where none is compatible. A negative cluster is one without other members."""
        above = self.used >> size
        r, mine = size, (("source", source), ("cluster", cluster))
        while above:
            step = (above & -above).bit_length() - 1
            r += step
            held, n = self.held[r], self.count[r]
            if all(held.get(m, 0) < n for m in mine):
                for full, bins in self.at[r].items():
                    if mine[0] not in full and mine[1] not in full:
                        b = next(iter(bins))
                        return b, self._put(b, size, source, cluster)
            above >>= step + 1
            r += 1
        b = len(self.residual)
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.full.append(frozenset())
        self._add(b)
        return b, self._put(b, size, source, cluster)

    def _add(self, b: int) -> None:
        r, full = self.residual[b], self.full[b]
        self.at[r].setdefault(full, {})[b] = None
        self.count[r] += 1
        self.used |= 1 << r
        for k in full:
            self.held[r][k] = self.held[r].get(k, 0) + 1

    def _take(self, b: int) -> None:
        r, full = self.residual[b], self.full[b]
        bins = self.at[r][full]
        del bins[b]
        if not bins:
            del self.at[r][full]
        self.count[r] -= 1
        if not self.count[r]:
            self.used &= ~(1 << r)
        for k in full:
            self.held[r][k] -= 1
            if not self.held[r][k]:
                del self.held[r][k]

    def _put(self, b: int, size: int, source: int, cluster: int) -> int:
        self._take(b)
        r, new = self.residual[b], []
        slots = ((1 << self.per_source) - 1) << (source * self.per_source)
        free = slots & ~self.sources[b]
        self.sources[b] |= free & -free  # the source's next free bit
        if self.sources[b] & slots == slots:
            new.append(("source", source))
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
            new.append(("cluster", cluster))
        if new:
            self.full[b] = self.full[b].union(new)
        self.residual[b] = r - size
        self._add(b)
        return self.capacity - r


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Pieces of one shard's documents with their bins: largest first, ties by id, cluster and copy; of equally tight bins any compatible one."""
    rows = rows.sort_values(["doc_id", "cluster", "copy"], kind="stable", na_position="last")
    source = {s: i for i, s in enumerate(sorted(set(rows["source"].fillna("")), key=str))}
    # a cluster needs a bit only where it can meet itself: with several pieces in the shard
    parts = (rows["size"] + capacity - 1) // capacity
    several = parts.groupby(rows["cluster"]).sum()
    cluster = {c: i for i, c in enumerate(several.index[several > 1].sort_values())}
    pieces = []
    for doc_id, copy, size, s, c in zip(rows["doc_id"], rows["copy"], rows["size"], rows["source"].fillna(""), rows["cluster"], strict=True):
        for i, start in enumerate(range(0, size, capacity)):
            pieces.append((doc_id, copy, i, start, min(capacity, size - start), s, c))
    pieces.sort(key=lambda p: -p[4])
    bins, out = Bins(capacity, per_source), []
    for doc_id, copy, i, start, n, s, c in pieces:
        b, offset = bins.place(n, source[s], cluster.get(c, -1))
        out.append((doc_id, copy, i, start, n, b, offset))
    found = pd.DataFrame(out, columns=["doc_id", "copy", "piece", "start_word", "n_words", "bin", "offset"])
    return found.astype({"doc_id": "Int64", "copy": "int64", "piece": "int64", "start_word": "int64", "n_words": "int64", "bin": "Int64", "offset": "Int64"})


def pack(docs: DataFrame, *, cluster: str | None = None, capacity: int = 2048, per_source: int = 4, shard_words: int = 1 << 20) -> DataFrame:
    """Per piece of a document: doc_id, copy, piece, start_word, n_words, bin_id, offset.

    Sizes are words; a document longer than `capacity` is cut into pieces that
    cover it whole. A bin holds no two pieces of one duplicate cluster (rows of
    one value in the column `cluster`, such as the classes of near duplicates;
    equal texts where none is named or the value is null) and at most `per_source` of one source. Documents are dealt by hash
    into shards of about `shard_words` words that are packed on their own;
    repeated rows are numbered (copy) and dealt apart, so neither a hot source
    nor a hot text fills one shard. bin_id is shard * 2^32 + bin.

    A text without words (null, empty) gives one piece of 0 words and a null
    bin; null ids and sources count as values of their own; an empty table gives
    no rows; other columns are ignored. Ties go as in pack_shard.
    """
    n = F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long")
    own = F.xxhash64(text_of()) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster).cast("string"), F.lit("named"))).otherwise(F.xxhash64(text_of()))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), own.alias("cluster"))
    sized = settled(sized.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n")))
    total = sized.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("w")).first()["w"]
    shards = max(1, math.ceil(total / shard_words))
    items = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "copy"), F.lit(shards)))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = pack_shard(pdf, capacity, per_source)
        found.insert(5, "bin_id", found["bin"] + int(key[0]) * (1 << 32))
        return found.drop(columns="bin")

    filled = items.where("size > 0").groupBy("shard").applyInPandas(packed, "doc_id long, copy long, piece long, start_word long, n_words long, bin_id long, offset long")
    # texts without words take no bin, so they pass by the shards, however many they are
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    return filled.unionByName(items.where("size = 0").select("doc_id", "copy", zero.alias("piece"), zero.alias("start_word"), zero.alias("n_words"), none.alias("bin_id"), none.alias("offset")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of pack over the documents of the stage.

    After the stage of near duplicates each class has one document, and the
    mix repeats it as equal rows, so that clusters by equal texts are its
    classes. Nulls, empty and very long texts, ties, repeated rows, an empty
    table and other columns go as in pack.
    """
    return pack(docs)
