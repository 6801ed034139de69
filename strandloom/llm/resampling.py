"""Importance resampling towards a target distribution, by hashed word n-grams.

Identical texts are collapsed by grouping the full text. Features and weight are
computed once a distinct text, its counts multiplied by its multiplicity; the
weights go back to the documents before each adds noise of its own.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import deleted, numbered, settled, stored, table, text_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of lower-cased bytes: digits, letters a to z and whatever is not ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
#: A text that holds more than one in so many of all rows is spread over several keys on its way back to them.
HOT = 1024


def hashed_features(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to `longest` of them: crc32 carried on from the run one word shorter."""
    words = WORDS(text.translate(LOWER))
    runs = list(map(crc32, words))
    spaced = [b" " + w for w in words]
    found = [runs]
    for n in range(1, longest):
        runs = list(map(crc32, spaced[n:], runs))  # a run and the word behind it; the last run has none
        found.append(runs)
    return len(words), np.array([h for run in found for h in run], dtype=np.int64) % buckets


def featured(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(digest, copies, n_words, n_features, features) of texts (text, copies): the buckets packed into two or four bytes each."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    fields = [("digest", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("features", pa.binary())]

    def read(batches):
        for batch in batches:
            digests, copies, texts = (batch.column(i).to_pylist() for i in range(3))
            for lo in range(0, len(texts), 256):  # so that no batch of results grows with the number of rows
                rows = [hashed_features(t, longest, buckets) for t in texts[lo : lo + 256]]
                columns = [digests[lo : lo + 256], copies[lo : lo + 256], [n for n, _ in rows], [len(f) for _, f in rows], [f.astype(kind).tobytes() for _, f in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    asked = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", F.col("text").cast("binary").alias("text"))
    return asked.mapInArrow(read, "digest binary, copies long, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences in all documents of each bucket's features, copies counted: summed within tasks first, `buckets` rows in the end."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = np.unique(np.frombuffer(packed, dtype=kind), return_counts=True)
                total[at] += n * copies
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(total[held])], names=["bucket", "n"])

    per = features.select("copies", "features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in per:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of a bucket's share in the target over its share in the raw corpus, one added to every count."""
    all_raw, all_target = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_raw / ((float(s) + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight): the floored mean gain of a distinct text's features, 0 without any."""
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32
    shared = features.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def weigh(batches):
        for batch in batches:
            weights = [int(shared.value[np.frombuffer(f, dtype=kind)].sum()) // (len(f) // kind().itemsize) if f else 0 for f in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, type=pa.int64())], names=["digest", "copies", "n_words", "n_features", "weight"])

    return features.mapInArrow(weigh, "digest binary, copies long, n_words long, n_features long, weight long")


def gumbel_noise(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:doc_id); a null id reads as no letters."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null where it is not drawn).

    Features are all runs of 1 to `longest` words, hashed into `buckets`; the
    weight is the floored mean of the gains of docs against target (text), the
    score adds Gumbel noise seeded by the id, and of the N documents of at least
    `min_words` words the floor(percent * N / 100) highest scores are drawn, ties
    to the smaller id, null ids last; equal rows take ranks of their own in any
    order. That draws without replacement in proportion to exp(weight / 1000).

    Null and empty texts have no features and weight 0; texts of any length are
    read whole; repeated rows count as often as they stand; an empty table gives
    no rows, an empty target gains against nothing; other columns are ignored.
    What grows with the data is shuffled: whole texts once, grouped after a
    count within tasks, and their digests. The driver sees a number a bucket.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    features, folder = stored(featured(rows.groupBy("text").agg(F.count("*").alias("copies")), longest, buckets))
    wanted = featured(target.select(text_of().alias("text")).groupBy("text").agg(F.count("*").alias("copies")), longest, buckets)
    weights = settled(text_weights(features, bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))))
    deleted(docs.sparkSession, folder)
    totals = weights.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("n_words") >= min_words, F.col("copies"))), F.lit(0)).alias("able")).first()
    # fewer than HOT texts hold more than a HOT-th of the rows each; their rows are dealt over as many keys as keep each below that
    salts = F.ceil(F.col("copies") * HOT / F.lit(float(max(1, totals["rows"])))).cast("int")
    hot = weights.select("digest", salts.alias("salts")).where("salts > 1")
    own = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    own = own.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    known = weights.select("digest", "n_words", "n_features", "weight", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    scored = own.join(known, ["digest", "salt"]).select("doc_id", "tie", "n_words", "n_features", "weight", (F.col("weight") + gumbel_noise(seed, F.col("doc_id"))).cast("long").alias("score"))
    scored = settled(scored)
    able = numbered(scored.where(F.col("n_words") >= min_words), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")], "place")
    drawn = percent * totals["able"] // 100
    ranked = able.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(*out))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
