"""Pieces shared by the corpus operators: reading, fold rule, draws; checkpoints and components are the core's."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.components import components as components
from strandloom.operators.lineage import deleted as deleted
from strandloom.operators.lineage import ensure_checkpoint_dir as ensure_checkpoint_dir
from strandloom.operators.lineage import settled as settled

#: Bytes of a word in the default word rule: anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(name: str = "doc_id") -> Column:
    """True for the fifth of rows kept for testing; a null id counts as held out."""
    key = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


def draw(*parts: Column) -> Column:
    """60 random-like bits of the parts, by MD5 so that SQL elsewhere draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def fresh(prefix: str) -> str:
    """A column name that no input can hold by accident."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and where; for `deleted` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), path


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their place from 1 in the order, without a task that orders them all.

    Ranges of the order are sorted on their own and shifted by the lengths of
    the ranges before; one row a range is ordered in one task. Rows equal in
    the order lie in one range: let it end in something that tells them apart.
    The rows are read twice, as Spark samples them for the ranges.
    """
    place = F.monotonically_increasing_id()  # partition << 33, and the row's place in it
    cut = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place))
    cut = cut.withColumn("__range", F.shiftright("__place", 33))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # a row a partition at most, so the table of ranges is bounded by spark.sql.shuffle.partitions
    at = cut.join(F.broadcast(per), "__range").withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return at.drop("__place", "__range", "__before")


def packed_rows(column: pa.Array, width: int) -> np.ndarray:
    """Bytes of a binary column whose values all have `width` bytes, a row a value."""
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, dtype=np.int32, count=1, offset=4 * column.offset)[0]) if len(column) else 0
    return np.frombuffer(data, dtype=np.uint8, count=len(column) * width, offset=first).reshape(-1, width) if len(column) else np.empty((0, width), np.uint8)


def packed_column(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    n, width = rows.shape
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
