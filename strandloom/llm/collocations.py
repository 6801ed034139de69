"""Phrase collocation mining by sorted runs of packed word ids.

Frequent words are numbered by a dictionary and pieces of text break at all
others. The run of ids from each place on, up to the longest phrase, is one key
of fixed width. Keys are radix-sorted and counted in blocks where they arise,
then dealt by ranges, sorted and counted by run length: every phrase is a prefix
of the keys that start with it, and these stand together.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import deleted, numbered, packed_column, packed_rows, settled, stored, table, text_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words, and runs of the characters that end a piece.
TOKENS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+").findall
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Distinct words that a task counts, and ids that it collects, before it hands on what it has.
WORDS_HELD, IDS_HELD = 200_000, 1 << 20
#: Rows of a partition that are looked at to draw the ranges of keys.
FIRST_ROWS = 20
#: The longest word that the broadcast part of the dictionary takes.
WORD_BYTES = 64


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (lang, text): occurrences of each word, and under a null word those of all words."""

    def count(batches):
        held, size = {}, 0

        def handed():
            rows = [(lang, word, n) for lang, words in held.items() for word, n in words.items() if word[:1] not in BREAKS or not word]
            rows += [(lang, None, sum(n for word, n in words.items() if word[:1] not in BREAKS)) for lang, words in held.items()]
            for lo in range(0, len(rows), 1 << 16):
                langs, words, n = zip(*rows[lo : lo + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(TOKENS(text.as_py().translate(LOWER)))
                size += len(own)
                if size > WORDS_HELD:
                    yield from handed()
                    held, size = {}, 0
        yield from handed()

    return docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, n, total, id): words with enough occurrences, numbered from 1 by falling count; total is that of all words of the language."""
    counts = settled(word_counts(docs).where(F.col("word").isNull() | (F.col("n") >= min_count)))
    frequent = counts.where("word IS NOT NULL").join(counts.where("word IS NULL").select("lang", F.col("n").alias("total")), "lang")
    return settled(numbered(frequent, [F.col("n").desc(), F.col("lang"), F.col("word")], "id"))


def rare_tail(docs: DataFrame, tail: DataFrame) -> DataFrame:
    """docs (row, lang, text) with `found`: ids of the words that the tail of the dictionary holds, each distinct word of a document with its id.

    Only words behind the broadcast part meet here, none of them a hot key, and
    a document has one row a distinct word.
    """

    def distinct(batches):
        for batch in batches:
            for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = [w for w in set(TOKENS(text.as_py().translate(LOWER))) if w[:1] not in BREAKS]
                for lo in range(0, len(words), 1 << 16):
                    part = words[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary())], names=["row", "lang", "word"])

    seen = docs.select("row", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(distinct, "row long, lang string, word binary")
    met = seen.join(tail.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("found"))
    return docs.join(met, "row", "left")


def id_blocks(batches, known: dict[str, dict[bytes, int]]):
    """Ids of the words of (lang, text, found) batches, a 0 at each break, in arrays of about IDS_HELD."""
    parts, held = [], 0
    for batch in batches:
        for lang, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            ids, own = known.get(lang, {}), found.as_py()
            tokens = TOKENS(text.as_py().translate(LOWER))
            if own:
                own = {f["word"]: f["id"] for f in own}
                parts.append(np.fromiter((ids.get(t) or own.get(t, 0) for t in tokens), dtype=np.uint32, count=len(tokens)))
            else:
                parts.append(np.fromiter(map(ids.get, tokens, [0] * len(tokens)), dtype=np.uint32, count=len(tokens)))
            parts.append(np.zeros(1, dtype=np.uint32))
            held += len(tokens) + 1
            if held >= IDS_HELD:
                yield np.concatenate(parts)
                parts, held = [], 0
    if parts:
        yield np.concatenate(parts)


def pack_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of ids as bytes, `width` an id, that sort like the ids."""
    return ids.astype(">u4").view(np.uint8).reshape(len(ids), ids.shape[1], 4)[:, :, 4 - width :].reshape(len(ids), -1)


def unpack_ids(rows: np.ndarray, width: int) -> np.ndarray:
    ids = np.zeros((len(rows), rows.shape[1] // width, 4), dtype=np.uint8)
    ids[:, :, 4 - width :] = rows.reshape(len(rows), -1, width)
    return ids.reshape(len(rows), -1).view(">u4").astype(np.uint32)


def phrase_keys(docs: DataFrame, known: dict[str, dict[bytes, int]], longest: int, width: int, bounds: list[bytes], first_rows: int | None = None) -> DataFrame:
    """(part, key, n) of docs (lang, text, found): up to `longest` ids from each place at which two frequent words stand side by side, sorted and counted by block; part is the number of bounds up to the key.

    With first_rows only so many rows of each partition are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, np.array(bounds, dtype=f"S{width * longest}")))

    def read(batches):
        ids_of, cuts = shared.value
        if first_rows is not None:
            batches = (batch.slice(0, first_rows) for batch in itertools.islice(batches, 1))
        for ids in id_blocks(batches, ids_of):
            ids = np.append(ids, np.zeros(longest, dtype=np.uint32))
            n = len(ids) - longest
            columns = [ids[:n]]
            for j in range(1, longest):
                columns.append(np.where(columns[-1] > 0, ids[j : n + j], np.uint32(0)))
            keys = np.stack(columns, axis=1)[columns[1] > 0]
            if not len(keys):
                continue
            halves = [h for c in reversed(keys.T) for h in ((c & 0xFFFF).astype(np.uint16), (c >> 16).astype(np.uint16)) if h.any()]
            keys = keys[np.lexsort(halves)]  # 16 bits a pass, the least first: numpy's stable sort of such is a radix sort
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            count = np.diff(np.append(first, len(keys))).astype(np.int64)
            packed = np.ascontiguousarray(pack_ids(keys[first], width))
            part = np.searchsorted(cuts, packed.view(f"S{width * longest}").ravel(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), packed_column(packed), pa.array(count)], names=["part", "key", "n"])

    return docs.select("lang", F.col("text").cast("binary").alias("text"), "found").mapInArrow(read, "part int, key binary, n long")


def key_bounds(docs: DataFrame, known: dict[str, dict[bytes, int]], longest: int, width: int) -> list[bytes]:
    """Bounds between as many ranges of keys as the session's shuffles have partitions, at quantiles of the first FIRST_ROWS rows of every partition: they balance the ranges and change no count."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = phrase_keys(docs, known, longest, width, [], FIRST_ROWS).select("key").orderBy(F.xxhash64("key")).limit(100 * parts).collect()
    keys = sorted(bytes(r["key"]) for r in some)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def run_lengths(keys: DataFrame, longest: int, width: int, min_count: int) -> DataFrame:
    """(key, a) of sorted keys (key, n): prefixes of 2 to `longest` ids with at least min_count occurrences.

    A run that ends inside its task is whole and dropped if it is short; the
    first and the last of a task may go on next door and are handed on whatever
    their length, to be added up.
    """

    def count(batches):
        going: dict[int, list] = {}  # phrase length -> ids, occurrences so far, whether it began the task

        def handed(rows: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_ids(head[None, :], width).tobytes() for head, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["key", "a"])

        for batch in batches:
            if not len(batch):
                continue
            rows = unpack_ids(packed_rows(batch.column(0), width * longest), width)
            n = np.asarray(batch.column(1))
            out = []
            for m in range(2, longest + 1):
                sub = rows[:, :m]
                first = np.flatnonzero(np.concatenate([[True], (sub[1:] != sub[:-1]).any(axis=1)]))
                sums, heads = np.add.reduceat(n, first), sub[first]
                opening = np.zeros(len(first), dtype=bool)
                if m not in going:
                    opening[0] = True
                elif (going[m][0] == heads[0]).all():
                    sums[0] += going[m][1]
                    opening[0] = going[m][2]
                else:
                    heads, sums, opening = np.vstack([going[m][0], heads]), np.append(going[m][1], sums), np.append(going[m][2], opening)
                going[m] = [heads[-1], int(sums[-1]), bool(opening[-1])]
                keep = ((sums >= min_count) | opening) & (heads[:, -1] > 0)
                keep[-1] = False
                out += zip(heads[keep], sums[keep].tolist(), strict=True)
            yield handed(out)
        yield handed([(head, n) for head, n, _ in going.values() if head[-1] > 0])

    return keys.mapInArrow(count, "key binary, a long").groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def collocations(docs: DataFrame, *, min_count: int = 100, longest: int = 5, top: int = 2000, table_words: int = 1 << 18) -> DataFrame:
    """Per language the `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to `longest` words with at least min_count
    occurrences a inside pieces, overlaps included. score is the least of
    floor(1000 * a * n / (l * r)) over its cuts into first words and rest, ties
    to the shorter first part. A candidate inside a longer one that occurs as
    often is dropped: it is enough to look one word further, as any candidate
    between the two occurs as often as both. Order: score and a falling, phrase
    by bytes. Products are decimals of 38 digits; more raises.

    The `table_words` most frequent words of at most WORD_BYTES bytes are
    broadcast; frequent words beyond are joined, a row a document and distinct
    word, and documents are then written with row numbers first. Null languages
    are `und`; null and empty texts have no words; texts are read whole, also a
    very long one; repeated rows count as often as they stand; an empty table
    gives no rows; other columns are ignored. 2**32 frequent words at most.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    words = dictionary(rows, min_count)
    short = (F.col("id") <= table_words) & (F.octet_length("word") <= WORD_BYTES)
    known: dict[str, dict[bytes, int]] = {}
    for r in words.where(short).select("lang", "word", "id").toLocalIterator():  # at most table_words rows of WORD_BYTES
        known.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
    tail, folders = words.where(~short), []
    if tail.isEmpty():
        asked = rows.withColumn("found", F.lit(None).cast("array<struct<word:binary,id:bigint>>"))
    else:
        held, folder = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        folders.append(folder)
        asked = rare_tail(held, tail)
    size = words.count()
    width = 2 if size < 1 << 16 else 3 if size < 1 << 24 else 4  # bytes of an id in a key
    bounds = key_bounds(asked, known, longest, width)
    keys = phrase_keys(asked, known, longest, width, bounds).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("key")
    found = settled(run_lengths(keys.select("key", "n"), longest, width, min_count))
    for folder in folders:
        deleted(docs.sparkSession, folder)
    # every part of a phrase is as frequent, so it has a count: a word's in the dictionary, a phrase's among the found
    own = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    held = found.select("key", "a").unionByName(words.select(own.alias("key"), F.col("n").alias("a")))
    size = (F.octet_length("key") / width).cast("int")
    cuts = found.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr(f"substring(key, 1, {width} * k)")).withColumn("right", F.expr(f"substring(key, {width} * k + 1)"))
    cuts = cuts.join(held.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(held.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    spelt = found.select("key", F.explode(F.sequence(F.lit(1), size)).alias("at")).withColumn("own", F.expr(f"substring(key, {width} * (at - 1) + 1, {width})"))
    spelt = spelt.join(words.select(own.alias("own"), "lang", "word", "total"), "own").groupBy("key").agg(F.min("lang").alias("lang"), F.min("total").alias("n"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    spelt = spelt.select("key", "lang", "n", F.array_join(F.col("w.word"), " ").alias("phrase"))
    score = F.expr("(cast(1000 * a AS decimal(38,0)) * n) div (cast(l AS decimal(38,0)) * r)")
    best = cuts.join(spelt, "key").groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"), F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("a").alias("a"), F.first("n").alias("n"))
    inner = found.where(size > 2).select(F.explode(F.array(F.expr(f"substring(key, 1, octet_length(key) - {width})"), F.expr(f"substring(key, {width} + 1)"))).alias("key"), "a").distinct()
    kept = settled(best.join(inner, ["key", "a"], "left_anti").select("key", "lang", "phrase", "a", "s.l", "s.r", "n", "s.score"))
    # ranked by ranges of the whole order, from each language's first place on: no task orders a language
    at = numbered(kept, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "place")
    first = at.groupBy("lang").agg(F.min("place").alias("first"))
    ranked = at.join(first, "lang").withColumn("rank", F.col("place") - F.col("first") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
