"""Embedding near-duplicates through an inverted multi-index (Babenko and Lempitsky, 2012).

Each half of a unit vector has its own codebook; pairs of codewords form a grid
of cells. A query walks the cells in the order of a lower bound of their
distance until no unvisited cell can hold a wanted neighbour (or until the
radius that reaches the target recall), and what it meets is verified by cosine
in double precision. Cells are compared as matrix blocks, so no pair is a row.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import components, settled, table

#: Rows of a block of a cell; two blocks meet in one task.
BLOCK = 1024
#: Least cosine of a link.
THRESHOLD = 0.9


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means++ with Lloyd rounds on a bounded sample."""
    draw = np.random.default_rng(seed)
    centres = [x[draw.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)) and d.sum() > 0:
        centres.append(x[draw.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


class MultiIndex:
    def __init__(self, dims: int, first: np.ndarray, second: np.ndarray, radius: float):
        self.dims, self.cut, self.books, self.radius = dims, dims // 2, (first, second), radius

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, radius: float, seed: int) -> MultiIndex:
        cut = sample.shape[1] // 2
        return cls(sample.shape[1], _kmeans(sample[:, :cut], k, seed), _kmeans(sample[:, cut:], k, seed + 1), radius)

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Codewords of both halves of each unit vector, and its squared distance to every other codeword's region."""
        near_of, sides = [], []
        for x, c in zip((unit[:, : self.cut], unit[:, self.cut :]), self.books, strict=True):
            d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0.0)
            near = d.argmin(1)
            between = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 1e-300))
            # a point of another codeword's region lies beyond the plane midway between the two codewords
            bound = np.maximum(d - d[np.arange(len(x)), near][:, None], 0.0) / (2 * between[near])
            bound[np.arange(len(x)), near] = 0.0
            near_of.append(near)
            sides.append(bound**2)
        return near_of[0], near_of[1], sides

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The cell of each unit vector, and the cells of its walk, nearest first."""
        i, j, sides = self.bounds(unit)
        return i * len(self.books[1]) + j, [self._walk(a, b) for a, b in zip(*sides, strict=True)]

    def calibrate(self, unit: np.ndarray, threshold: float, recall: float, seed: int) -> None:
        """Set the radius at which walks meet the share `recall` of neighbours.

        Neighbours are the links among the sample and, as these may be few,
        every sample vector turned by the threshold's angle in a random
        direction, the hardest link there is.
        """
        draw = np.random.default_rng(seed)
        off = draw.standard_normal(unit.shape)
        off -= (off * unit).sum(1, keepdims=True) * unit
        off /= np.maximum(np.sqrt((off**2).sum(1, keepdims=True)), 1e-300)
        turned = threshold * unit + math.sqrt(max(0.0, 1 - threshold**2)) * off
        few = unit[:2048]
        a, b = np.nonzero(np.triu(few @ few.T >= threshold, 1))
        need = [self._needed(unit, turned), self._needed(few[a], few[b]), self._needed(few[b], few[a])]
        reach = max(float(np.quantile(x, recall)) for x in need if len(x))
        self.radius = min(self.radius, math.sqrt(reach))

    def _needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        (i, j, _), (_, _, sides) = self.bounds(y), self.bounds(x)
        at = np.arange(len(x))
        return sides[0][at, i] + sides[1][at, j]

    def _walk(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Multi-sequence traversal: cells (i, j) by a[i] + b[j], until that exceeds the radius."""
        most = self.radius**2 * (1 + 1e-9) + 1e-12
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        out, seen, heap = [], {(0, 0)}, [(a[i_order[0]] + b[j_order[0]], 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            if s > most:
                break
            out.append(int(i_order[i]) * len(b) + int(j_order[j]))
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[i_order[x]] + b[j_order[y]], x, y))
        return out


def _units(packed, kind: str) -> np.ndarray:
    """Unit vectors in double precision of packed raw ones; scaled first, so that no square over- or underflows."""
    e = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    e = e / np.abs(e).max(1, keepdims=True)
    return e / np.sqrt((e**2).sum(1, keepdims=True))


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, lowest node it reaches) with the components of the bipartite link matrix: labels sink along links until none does."""
    i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    at, far = linked[np.ix_(i, j)], np.iinfo(np.int64).max
    a, b = left[i].astype(np.int64), right[j].astype(np.int64)
    while len(i):
        lower_b = np.minimum(b, np.where(at, a[:, None], far).min(axis=0))
        lower_a = np.minimum(a, np.where(at, lower_b[None, :], far).min(axis=1))
        if (lower_a == a).all() and (lower_b == b).all():
            break
        a, b = lower_a, lower_b
    nodes, lows = np.concatenate([left[i], right[j]]), np.concatenate([a, b])
    return nodes[nodes != lows], lows[nodes != lows]


#: Parts into which the rows of one component are dealt when its lowest id goes back to them.
SALTS = 16


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, codewords: int | None = None, sample_rows: int = 8192, recall: float = 0.9995, seed: int = 9) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept, n_copies.

    Links join vectors with cosine >= threshold. The codebooks are fitted on at
    most `sample_rows` distinct vectors and every vector is indexed. Walks stop
    at the radius that meets the share `recall` of neighbours turned away by
    the threshold's angle; with recall 1 or more they cover every cell that can
    hold a link, and none is missed.

    Equal vectors are one row with a weight, so copies are counted and never
    paired. Cells larger than a block meet block by block; each task sends a
    count per query and a spanning forest, never the links themselves. Vectors
    that are null, zero, or hold null or non-finite components link with
    nothing, and vectors of different lengths not with each other: every length
    has an index of its own. A null vec_id keeps its row with a null component;
    repeated rows are vectors of their own; an empty table gives no rows; other
    columns are ignored.

    Of two cells only the one of the smaller number asks the other, so a pair
    is compared once, and a link found counts at both its ends.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"  # raw components travel as they came
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(valid, F.sha2(F.concat_ws(",", F.transform("e", lambda x: (x + 0.0).cast("string"))), 256)))
    keyed = settled(rows.select("vec_id", "h"))
    classes = rows.where("h IS NOT NULL").groupBy("h").agg(F.first("e").alias("e"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    classes = settled(classes.select(F.monotonically_increasing_id().alias("node"), "h", "e", F.size("e").alias("d"), "w", "low"))  # the numbers hold once they are written
    indexes: dict[int, tuple[int, MultiIndex]] = {}  # by length: a number for its cells, and the index
    for number, r in enumerate(sorted(classes.groupBy("d").count().where("count > 1").collect())):  # a row a length
        sample = classes.where(F.col("d") == r["d"]).orderBy("h").limit(sample_rows).select("e").collect()
        x = np.array([v["e"] for v in sample])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x**2).sum(1, keepdims=True))
        k = codewords or int(min(256, max(12, r["count"] ** 0.25)))
        fitted = MultiIndex.fit(x, k, math.sqrt(max(0.0, 2 * (1 - threshold))), seed)
        if recall < 1:
            fitted.calibrate(x, threshold, recall, seed + 2)
        indexes[r["d"]] = number, fitted
    if not indexes:
        linked = spark.createDataFrame([], "node long, links long")
        edges = spark.createDataFrame([], "a long, b long")
    else:
        shared = spark.sparkContext.broadcast(indexes)

        def place(batches):
            """A row as member of its cell, one as query in it, and one as query in each later cell of its walk."""
            for whole in batches:
                length = whole["e"].map(len)
                for d in sorted(set(length) & set(shared.value)):
                    pdf, (number, index) = whole[length == d], shared.value[d]
                    raw = np.stack(pdf["e"].to_numpy()).astype(kind)
                    own, walks = index.cells(_units([bytes(v) for v in raw], kind))
                    base = number << 40
                    for lo in range(0, len(pdf), 256):
                        part = []
                        for n, w, v, o, walk in zip(pdf["node"][lo : lo + 256], pdf["w"][lo : lo + 256], raw[lo : lo + 256], own[lo : lo + 256], walks[lo : lo + 256], strict=True):
                            u = bytes(v)
                            part += [(base + int(o), n, w, False, True, u), (base + int(o), n, w, True, True, u)]
                            part += [(base + c, n, w, True, False, u) for c in walk if c > o]
                        yield pd.DataFrame(part, columns=["cell", "node", "w", "query", "home", "u"])

        placed = settled(classes.select("node", "w", "e").mapInPandas(place, "cell long, node long, w long, query boolean, home boolean, u binary"))
        load = placed.groupBy("cell").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("members"), F.sum(F.when(F.col("query"), 1).otherwise(0)).alias("queries")).where("members > 0")
        load = load.select("cell", F.ceil(F.col("members") / BLOCK).cast("long").alias("mb"), F.ceil(F.col("queries") / BLOCK).cast("long").alias("qb"))
        blocks = placed.join(load, "cell")
        # a member meets every block of queries, a query every block of members
        own_block = F.pmod(F.xxhash64("node"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("mb")))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb")) - 1))
        blocks = blocks.select("cell", "node", "w", "query", "home", "u", own_block.alias("own"), others.alias("other"))
        blocks = blocks.select("cell", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("q"), F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("m"), "node", "w", "query", "home", "u")

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            q, m = pdf[pdf["query"]], pdf[~pdf["query"]]
            if not len(q) or not len(m):
                return pd.DataFrame({"node": [], "links": [], "a": [], "b": []}).astype("int64")
            left, right = q["node"].to_numpy(), m["node"].to_numpy()
            cosine = _units(q["u"], kind) @ _units(m["u"], kind).T
            linked = (cosine >= threshold) & (left[:, None] != right[None, :])
            away = ~q["home"].to_numpy()
            # pairs of one cell are met from both sides, pairs of two cells once
            counts = np.concatenate([linked.astype(np.float64) @ m["w"].to_numpy(), linked[away].T.astype(np.float64) @ q["w"].to_numpy()[away]]).astype(np.int64)
            nodes, some = np.concatenate([left, right]), np.flatnonzero(counts)
            a, b = _forest(linked, left, right)
            return pd.concat([pd.DataFrame({"node": nodes[some], "links": counts[some], "a": -1, "b": -1}), pd.DataFrame({"node": -1, "links": 0, "a": a, "b": b})]).astype("int64")

        met = settled(blocks.groupBy("cell", "q", "m").applyInPandas(meet, "node long, links long, a long, b long"))
        linked = met.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
        edges = met.where("links = 0").select("a", "b")
    reach = components(edges)
    counted = settled(classes.select("node", "h", "w", "low").join(linked, "node", "left").join(reach, "node", "left").select("node", "h", "w", "low", F.coalesce("links", F.lit(0)).alias("links"), "component"))
    # the lowest id of a component goes back to its vectors in SALTS parts, so that no component fills a task
    lows = counted.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = counted.where("component IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    joined = salted.join(lows, ["component", "salt"]).select(F.col("h").alias("c_h"), "w", "links", "component_id")
    joined = joined.unionByName(counted.where("component IS NULL").select(F.col("h").alias("c_h"), "w", "links", F.col("low").alias("component_id")))
    out = keyed.join(joined, F.col("h") == F.col("c_h"), "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"), F.coalesce("w", F.lit(1)).cast("long").alias("n_copies"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
