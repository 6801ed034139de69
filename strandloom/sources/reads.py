"""Read files: FASTQ and FASTA of whole records, any number of files and splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.lineage import settled

#: Bits of a read's id below the number of its file.
FILE_BITS = 40
#: Splits up to which a row of each (24 bytes) is broadcast.
MOST_SPLITS = 2_000_000


def _starts(held: list[str], lines: int) -> int | None:
    """Where the first record starts among lines from the middle of a file, if that can be told.

    Of FASTQ a line with @ whose second next starts with +: below a quality that
    starts with @ stands the next name, and then letters.
    """
    for i in range(min(lines, len(held) - (lines == 4) * 2)):
        if held[i].startswith("@" if lines == 4 else ">") and (lines == 2 or held[i + 2].startswith("+")):
            return i
    return None


def _cutter(lines: int, ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches (file, split, value) in their order: (file, split, at, l0, l1, ..) of the records whole inside a split, at its first line's place there.

    With ends, (file, split, at, value) of the lines left at either end of a
    split, and a row of value null whose `at` is the number of its lines.
    """

    def table(key: tuple[int, int], at: int, held: list[str | None]) -> pa.RecordBatch:
        step = 1 if ends else lines
        n = len(held) // step
        fields = {"value": held} if ends else {f"l{i}": held[i::lines] for i in range(lines)}
        long = lambda values: pa.array(values, pa.int64())
        return pa.RecordBatch.from_pydict({"file": long([key[0]] * n), "split": long([key[1]] * n), "at": long(range(at, at + n * step, step))} | {k: pa.array(v, pa.string()) for k, v in fields.items()})

    def cut(batches):
        key, at, held, found = None, 0, [], False  # at: the place in the split of the first line held

        def last():
            if ends and key is not None:
                if held:
                    yield table(key, at, held)
                yield table(key, at + len(held), [None])

        for batch in batches:
            files, splits, values = batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value").to_pylist()
            begin = 0
            while begin < len(values):
                here = (files[begin], splits[begin])
                end = next((i for i in range(begin, len(values)) if (files[i], splits[i]) != here), len(values))
                if here != key:
                    yield from last()
                    key, at, held, found = here, 0, [], here[1] == 0
                held, begin = held + values[begin:end], end
                if not found and (first := _starts(held, lines)) is not None:
                    if ends and first:
                        yield table(key, at, held[:first])
                    at, held, found = at + first, held[first:], True
                if found and (n := len(held) // lines * lines):
                    if not ends:
                        yield table(key, at, held[:n])
                    at, held = at + n, held[n:]
        yield from last()

    return cut


def _records(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """(record, l0, l1, ..): files cut into records of so many lines, numbered from 0; those of the n-th of several files, by name, from n << FILE_BITS.

    The tasks that read the splits find where records start and cut them there;
    only the few lines at the ends of splits, whose records lie in two, are
    shuffled. A first reading gathers these and the number of lines of every
    split, which numbers the records: a row a split goes through the driver.
    """
    file = F.xxhash64("_metadata.file_path").alias("file")
    raw = spark.read.text(path).select(file, F.col("_metadata.file_block_start").alias("split"), "value")
    left = settled(raw.mapInArrow(_cutter(lines, True), "file long, split long, at long, value string"))
    named = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), file).collect()  # a row a file
    base = {r["file"]: n << FILE_BITS for n, r in enumerate(sorted(named))}
    shifts, upto = [], {}
    for r in sorted(left.where("value IS NULL").select("file", "split", "at").collect()):  # a row a split
        shifts.append((r["file"], r["split"], base[r["file"]], upto.get(r["file"], 0)))
        upto[r["file"]] = upto.get(r["file"], 0) + r["at"]
    shift = spark.createDataFrame(shifts, "file long, split long, base long, before long")
    if len(shifts) <= MOST_SPLITS:
        shift = F.broadcast(shift)
    fields = [f"l{i}" for i in range(lines)]
    line = F.col("before") + F.col("at")
    number = F.when(line % lines == 0, F.col("base") + F.expr(f"(before + at) div {lines}")).otherwise(F.raise_error(F.lit(f"a record has more or less than {lines} lines")).cast("long"))
    whole = raw.mapInArrow(_cutter(lines, False), "file long, split long, at long, " + ", ".join(f"{f} string" for f in fields)).join(shift, ["file", "split"]).select(number.alias("record"), *fields)
    rest = left.where("value IS NOT NULL").join(shift, ["file", "split"]).select(F.col("base") + F.expr(f"(before + at) div {lines}"), (line % lines).alias("i"), "value").toDF("record", "i", "value")
    across = rest.groupBy("record").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f) for i, f in enumerate(fields)])
    return whole.unionByName(across)


def _checked(rows: DataFrame) -> DataFrame:
    """Reads upper-cased; a letter that is no nucleotide raises."""
    seq = F.upper("seq")
    return rows.withColumn("seq", F.when(seq.rlike("^[ACGTN]+$"), seq).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide in read "), F.coalesce("name", F.lit("?"))))))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq, grnd, phred) of four-line records; read_id orders them as in the file, one file after another."""
    r = _records(spark, path, 4).where("l0 <> '' AND l1 IS NOT NULL")
    return _checked(r.select(F.col("record").alias("read_id"), F.substring("l0", 2, 1 << 30).alias("name"), F.col("l1").alias("seq"), F.substring("l2", 2, 1 << 30).alias("grnd"), F.col("l3").alias("phred")))


def read_fasta_queries(spark: SparkSession, path: str) -> DataFrame:
    """As read_fastq, of FASTA records of exactly two lines."""
    r = _records(spark, path, 2).where("l0 <> '' AND l1 IS NOT NULL")
    return _checked(r.select(F.col("record").alias("read_id"), F.substring("l0", 2, 1 << 30).alias("name"), F.col("l1").alias("seq"), F.lit("").alias("grnd"), F.lit("").alias("phred")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    name = path.lower()
    if name.endswith((".fq", ".fastq")):
        return read_fastq(spark, path)
    if name.endswith((".fa", ".fasta")):
        return read_fasta_queries(spark, path)
    raise ValueError(f"{path} should end in .fa, .fasta, .fq or .fastq")


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    return reads.orderBy("read_id").limit(n)
