"""Tab-separated results: alignments, statistics and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of an alignment file.
ALIGNMENTS = (
    "ref STRING, refsize INT, algo STRING, operation STRING, readname STRING, memory DOUBLE, len INT, read STRING, spell STRING, cost INT, "
    "start INT, strand STRING, pushed DOUBLE, popped DOUBLE, repeat_rate DOUBLE, `t(map)` DOUBLE, `t(astar)` DOUBLE, unique_best INT, explored_states INT, crumbs INT"
)
#: The columns of an aggregate of benchmark runs.
BENCHMARKS = (
    "algo STRING, graph STRING, head INT, N INT, m INT, sequencing_technology STRING, errorrate DOUBLE, seedlen INT, s DOUBLE, `h:m:s` STRING, "
    "max_rss DOUBLE, max_vms DOUBLE, max_uss DOUBLE, max_pss DOUBLE, io_in DOUBLE, io_out DOUBLE, mean_load DOUBLE"
)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One or many tab-separated files with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ALIGNMENTS)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BENCHMARKS)


def read_all(spark: SparkSession, folder: str, schema: str, name: str = "*.tsv") -> DataFrame:
    """Every file of that name under a folder, with its path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return files.csv(folder, sep="\t", header=True, schema=schema).withColumn("file", F.col("_metadata.file_path"))


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", header=True)


def write_statistics(row: DataFrame, path: str) -> None:
    """A one-row table, its columns in the order of their names."""
    row.select(*sorted(row.columns)).coalesce(1).write.csv(path, sep="\t", header=True)
