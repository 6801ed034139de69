"""Alignment of a stream of reads: each micro-batch runs the batch plan. An extension; the batch plan is the definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.align import Costs, align


def align_stream(reads: DataFrame, segments: DataFrame, links: DataFrame | None, out: str, checkpoint: str, *, costs: Costs = Costs(), k: int = 1, seed_len: int | None = None, drop_tail: bool = True) -> StreamingQuery:
    """Align streaming reads (read_id, seq) and write each batch once, under its number, as Parquet in `out`."""

    def each(batch: DataFrame, number: int) -> None:
        found = align(segments, links, batch, costs=costs, k=k, seed_len=seed_len, drop_tail=drop_tail)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
