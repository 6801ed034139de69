"""Connected components of an undirected edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.lineage import settled

#: Edges that one task contracts by itself.
BLOCK = 1 << 16
#: A node with more than one in so many of all edges is a hub, whose edges are spread over several keys.
HUB = 1024


def contracted(links: DataFrame, n_links: int) -> DataFrame:
    """Edges (u, v) with the same components, v below u: within a block of about BLOCK edges each node leads to the smallest one that the block's edges reach.

    Blocks are whole partitions put together, so no row is shuffled, and a
    block's memory is bounded by its edges.
    """

    def contract(batches):
        u, v = [], []
        for batch in batches:
            u.append(np.asarray(batch.column(0)))
            v.append(np.asarray(batch.column(1)))
        if not u:
            return
        nodes, at = np.unique(np.concatenate([*u, *v]), return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        low = np.arange(len(nodes))
        while True:
            # each root takes the least root that an edge shows it, then all nodes look up their root's
            x, y = low[a], low[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = low[low]
                if (up == low).all():
                    break
                low = up
        own = np.flatnonzero(low != np.arange(len(nodes)))
        for lo in range(0, len(own), 1 << 16):
            part = own[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[low[part]])], names=["u", "v"])

    return links.coalesce(max(1, -(-n_links // BLOCK))).mapInArrow(contract, "u long, v long")


def lowest(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """(u, v, m) of pairs (u, v) with the least v of each u: hubs, of which there are fewer than HUB, are joined in parts."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") * HUB / F.lit(float(max(1, n_pairs)))).cast("int")
    hubs = low.where(parts > 1).select("u", parts.alias("parts"))
    dealt = pairs.join(F.broadcast(hubs), "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int"))
    low = low.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(low, ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the smallest node.

    Nodes without an edge to another are absent; nulls and self loops are
    dropped. Blocks of edges are contracted where they lie; where there are
    several, large-star and small-star rounds (Kiveris et al., 2014) follow, each
    a map-side combined min and one join back, in parts at hubs. Rounds grow
    with the logarithm of the longest path that the blocks leave, and every
    round is checkpointed.
    """
    links = settled(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    n = links.count()
    links = settled(contracted(links, n))
    digest = None
    for _ in range(max_rounds if n > BLOCK else 0):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both, 2 * n).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = lowest(large, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v")
        small = settled(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        links = settled(contracted(small, n))
        now = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if digest == (now["n"], now["h"]):
            break
        digest = (now["n"], now["h"])
    else:
        if n > BLOCK:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
