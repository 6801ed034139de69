"""Near-duplicate documents by Order MinHash (Marçais et al., 2019).

A sketch keeps the few k-mers of words, labelled by occurrence, that are
smallest under one hash, in the order of the text, so that equal sketches speak
for a small edit distance and not only for common words. Texts that are
neighbours in several sketches form groups; inside a group, pairs that a lossless prefix filter leaves
are verified by an alignment inside a band, which alone decides.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import components, fresh, settled, table, text_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a k-mer.
K = 3
#: Sketches of a text, and k-mers in one: edits at random in a fifth of the words leave the k-mers Jaccard 0.34.
SKETCHES, PICK = 80, 2
#: Texts of at most so many words also get sketches of one pair of words, as edits may leave them no k-mer.
SHORT, SHORT_SKETCHES = 40, 24
#: Sketches in which two texts have to be neighbours to be grouped.
MEETINGS = 2
#: Words of the grams that bound the edits.
Q = 2
#: Words and texts in a block of a group; pairs of long texts take the time, so words bound it first.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 18, 1500

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, size=SKETCHES + SHORT_SKETCHES, dtype=np.uint64)[:, None]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordIds(dict):
    """64-bit ids of words, the same in every process; cleared when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return x


_IDS = WordIds()


def word_ids(text: str) -> np.ndarray:
    words = WORDS.findall(text)
    return np.fromiter(map(_IDS.__getitem__, words), dtype=np.uint64, count=len(words))


def kmers(ids: np.ndarray, size: int = 0) -> np.ndarray:
    """Hashes of the runs of `size` words, or K, in text order; a shorter text is one run."""
    if not len(ids):
        return ids
    k = min(size or K, len(ids))
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i]) * _M1
        h ^= h >> np.uint64(29)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with the number of the occurrence, so repeats differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return h
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    occurrence = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    out = h.copy()
    out[order] = s ^ (occurrence.astype(np.uint64) * _M2)
    return out


def sketches(x: np.ndarray, first: int = 0, rows: int = SKETCHES, pick: int = PICK) -> list[int]:
    """Order MinHash keys of labelled k-mers under the seeds from `first`, as signed 64-bit numbers."""
    if not len(x):
        return []
    keys = []
    step = max(1, min(rows, 400_000 // len(x)))
    for lo in range(first, first + rows, step):
        h = (x[None, :] ^ _SEEDS[lo : min(lo + step, first + rows)]) * _M1
        h ^= h >> np.uint64(32)
        h *= _M2
        row = np.arange(len(h))
        found = []
        for _ in range(min(pick, len(x))):
            found.append(h.argmin(axis=1))
            h[row, found[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        key = (row + lo).astype(np.uint64) * _M2 + np.uint64(1)
        for at in np.sort(np.array(found), axis=0):
            key = (key ^ x[at]) * _M1
            key ^= key >> np.uint64(29)
        keys += key.view(np.int64).tolist()
    return keys


def text_sketches(ids: np.ndarray) -> list[int]:
    """All keys of a text of words."""
    keys = sketches(labelled(kmers(ids)))
    return keys + sketches(labelled(kmers(ids, Q)), SKETCHES, SHORT_SKETCHES, 1) if len(ids) <= SHORT else keys


#: Words up to which the band is kept in the bits of integers; longer texts go by diagonals, with the same result.
BIT_WORDS = 1 << 14


def edits_within(a: list[int] | np.ndarray, b: list[int] | np.ndarray, most: int) -> int | None:
    """Edit distance of two word lists if at most `most`, by an alignment inside a band of that width on both sides."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(a) - len(b) > most:
        return None
    return by_diagonals(a, b, most) if len(a) > BIT_WORDS else by_bits(list(map(int, a)), list(map(int, b)), min(most, len(a)))


def by_bits(a: list[int], b: list[int], most: int) -> int | None:
    """As edits_within for a not shorter than b, the differences between rows of the band held as bits (Hyyrö, 2003).

    At column j, bit k stands for row j - most + k. The distance is followed
    along the lowest diagonal of the band until that leaves the matrix, and
    then along the last row.
    """
    n, m = len(a), len(b)
    rows: dict[int, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | (1 << i)
    full = (1 << (2 * most + 1)) - 1
    up, down = ((1 << (most + 1)) - 1) << most, 0  # differences +1 and -1 from the row above
    top, dist = 1 << (2 * most), most
    for j in range(1, m + 1):
        equal, shift = rows.get(b[j - 1], 0), j - most - 1
        equal = (equal >> shift if shift >= 0 else equal << -shift) & full
        same = ((((equal & up) + up) ^ up) | equal | down) & full  # no difference along the diagonal
        right, left = down | (full & ~(same | up)), up & same
        if j <= n - most:
            if not same & top:
                dist += 1
                if dist > m - n + 2 * most:
                    return None
        else:
            row = n - j + most
            dist += (right >> row & 1) - (left >> row & 1)
            if dist - (m - j) > most:
                return None
        same >>= 1
        up, down = left | (full & ~(same | right)), right & same
    return dist if dist <= most else None


def by_diagonals(a: list[int] | np.ndarray, b: list[int] | np.ndarray, most: int) -> int | None:
    """As edits_within, by furthest-reaching points on the diagonals of the band: memory linear in the band."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return None
    # ends that match nothing, so that no slide leaves its text
    x, y = (np.append(np.asarray(t, dtype=np.uint64), np.uint64(0)) for t in (a, b))
    wide = most + 2
    front = np.full(2 * wide + 1, -2, dtype=np.int64)  # by diagonal k at k + wide, letters of a

    def slide(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Each point along its diagonal while words match, the last one that moves by runs of 256."""
        live = np.flatnonzero((i < n) & (i + k < m))
        while len(live):
            live = live[x[i[live]] == y[i[live] + k[live]]]
            i[live] += 1
            live = live[(i[live] < n) & (i[live] + k[live] < m)]
            if len(live) == 1:
                at, d = int(i[live[0]]), int(k[live[0]])
                while at < n and at + d < m:
                    to = min(at + 256, n, m - d)
                    differ = np.flatnonzero(x[at:to] != y[at + d : to + d])
                    if len(differ):
                        at += int(differ[0])
                        break
                    at = to
                i[live[0]] = at
                break
        return i

    front[wide] = slide(np.array([0]), np.array([0]))[0]
    for e in range(most + 1):
        if front[goal + wide] >= n:
            return e
        k = np.arange(max(-e - 1, goal - (most - e)), min(e + 1, goal + (most - e)) + 1)
        c = k + wide
        i = np.maximum(np.maximum(front[c] + 1, front[c - 1]), front[c + 1] + 1)
        i = np.minimum(i, np.minimum(n, m - k))
        ok = (i >= 0) & (i + k >= 0)
        reach = np.full_like(front, -2)
        reach[c[ok]] = slide(i[ok], k[ok])
        front = reach
    return None


def most_edits(longer: int, threshold: float) -> int:
    return math.floor((1 - threshold) * longer + 1e-9)


def grams(ids: np.ndarray, size: int = Q) -> np.ndarray:
    """The labelled grams of so many words, sorted."""
    return np.sort(labelled(kmers(ids, size)))


def least_shared(longer: int, threshold: float) -> int:
    """Labelled grams that texts share if they are within the threshold: an edit destroys Q at most."""
    return max(1, longer - Q + 1 - Q * most_edits(longer, threshold))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that two sorted arrays of distinct ones have in common."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def links_of(texts: list[str], sides: list[int], threshold: float, guests: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of indices whose links connect all that is linked among these texts (a spanning forest).

    With two different sides only pairs across them are compared, and pairs of
    two guests, which meet elsewhere, are not. A pair within
    the threshold shares least_shared grams, so one of the first n - that + 1
    grams of either text in the order of rarity; only texts that meet there and
    share as many are aligned, and only while they are not yet connected.
    """
    ids = [word_ids(t) for t in texts]
    sets = [grams(x) for x in ids]
    single = [grams(x, 1) for x in ids]
    sizes = np.array([len(s) for s in sets])
    guests = guests or [False] * len(texts)
    across = len(set(sides)) > 1
    if not sizes.sum():
        return []
    every, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), dtype=np.int64)
    rank[np.lexsort((every, df))] = np.arange(len(every))
    parent = list(range(len(texts)))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    postings: dict[int, list[int]] = {}
    offset, edges = 0, []
    for i in range(len(texts)):
        mine = inverse[offset : offset + sizes[i]]
        offset += sizes[i]
        words = len(ids[i])
        fewest = min((least_shared(n, threshold) for n in range(words, int(words / threshold + 1e-9) + 1)), default=1)
        first = mine[np.argsort(rank[mine])[: max(sizes[i] - fewest + 1, 0) if sizes[i] else 0]]
        tokens = first[df[first] > 1].tolist()
        met: set[int] = set()
        for token in tokens:
            met.update(postings.get(token, ()))
        for j in sorted(met):
            if (across and sides[i] == sides[j]) or (guests[i] and guests[j]) or find(i) == find(j):
                continue
            longer, shorter = max(len(ids[i]), len(ids[j])), min(len(ids[i]), len(ids[j]))
            most = most_edits(longer, threshold)
            # an edit takes one word, or Q grams, from what the two share
            if longer - shorter > most or shared(single[i], single[j]) < longer - most or shared(sets[i], sets[j]) < least_shared(longer, threshold):
                continue
            if edits_within(ids[i], ids[j], most) is not None:
                edges.append((j, i))
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
        for token in tokens:
            postings.setdefault(token, []).append(i)
    return edges


def digest_of(text: Column) -> Column:
    """The SHA-256 of a text, all of it: equal digests are equal texts."""
    return F.unhex(F.sha2(text, 256))


#: Parts into which the rows of one class are dealt when its totals go back to them.
SALTS = 16


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, class_id, kept, n_copies, text_id (the text's SHA-256 in hex).

    class_id is the smallest doc_id of the documents that links reach; kept is
    true for that one (of several texts under that id for one text only, and
    for one text of a class without ids). Links join equal texts, and texts
    whose words differ by at most 1 - threshold of the longer in edits;
    candidates share MEETINGS of SKETCHES sketches, in which they are neighbours
    by length; in expectation that misses a pair with edits at random in a
    fifth of its words about once in 1,000.

    Equal texts are one node, numbered after they are gathered by their full
    digest, so copies cost a row each and no comparison. A group of candidates
    larger than a block is compared block against block, in tasks that send a
    spanning forest. Null texts read as empty; texts without words are alike
    only if equal; a null id keeps its row, in the class of its text; repeated
    rows share their class; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hashed = rows.select("doc_id", "text", digest_of(F.col("text")).alias("digest"))

    def sketch(batches):
        for pdf in batches:
            found = [word_ids(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "n": [len(x) for x in found], "keys": [text_sketches(x) for x in found]})

    sketched = hashed.mapInPandas(sketch, "doc_id long, digest binary, n long, keys array<long>")
    classes = sketched.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    classes = settled(classes.withColumn("node", F.monotonically_increasing_id()))  # the numbers hold once they are written
    buckets = classes.select("node", "n", F.explode("keys").alias("key"))
    # lengths too far apart need too many edits, so a sketch joins only neighbours in length
    by_length = Window.partitionBy("key").orderBy("n", "node")
    chain = buckets.select("node", "n", F.lag("node").over(by_length).alias("before"), F.lag("n").over(by_length).alias("shorter"))
    chain = chain.where(F.col("n") - F.col("shorter") <= F.floor(F.col("n") * (1 - threshold) + 1e-9))
    # a shared line gives two texts a sketch in common now and then, a small edit distance gives them many
    chain = chain.groupBy("node", "before").agg(F.count("*").alias("met")).where(F.col("met") >= MEETINGS)
    groups = components(chain.select(F.col("node").alias("a"), F.col("before").alias("b")))
    members = classes.select("node", "digest", "rep", "n").join(groups.select("node", F.col("component").alias("group")), "node")
    load = members.groupBy("group").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("texts") / BLOCK_TEXTS)).cast("long")
    # texts within the threshold lie in the same or the next band of lengths: a large group is dealt into cells of one band and, as guests, the one below
    band = F.floor(F.log(F.col("n").cast("double")) / max(1.01 * math.log(1 / threshold), 0.01)).cast("long")
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(band, band + 1))
    members = settled(members.join(load.select("group", blocks.alias("blocks")), "group").select("node", "digest", "rep", "n", F.col("group").alias("whole"), F.explode(cells).alias("cell"), "blocks", band.alias("band")).withColumn("guest", (F.col("blocks") > 1) & (F.col("cell") > F.col("band"))).drop("blocks", "band"))
    load = members.groupBy("whole", "cell").agg(F.sum("n").alias("shingles"), F.count("*").alias("texts"))
    load = load.select("whole", "cell", F.xxhash64("whole", "cell").alias("group"), blocks.alias("blocks"))
    members = settled(members.join(load, ["whole", "cell"]))
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.select("node", F.col("digest").alias("m_digest"), "rep", "group", "own", "blocks", "guest")
    # one row gives the text of a node: that of its smallest id; texts that no id holds are gathered first
    named = hashed.where("doc_id IS NOT NULL").unionByName(hashed.where("doc_id IS NULL").dropDuplicates(["digest"]))
    texts = named.join(placed, (F.col("digest") == F.col("m_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    # a text meets every block of its group, its own included
    texts = texts.select("node", "text", "group", "own", "guest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    texts = texts.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "text", "own", "guest")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        nodes = pdf["node"].tolist()
        found = links_of(pdf["text"].tolist(), pdf["own"].tolist(), threshold, pdf["guest"].tolist())
        return pd.DataFrame({"a": [nodes[x] for x, _ in found], "b": [nodes[y] for _, y in found]}).astype("int64")

    links = settled(texts.groupBy("group", "i", "j").applyInPandas(verify, "a long, b long"))
    # totals by class over distinct texts that have a link, then back to them in SALTS parts, so that no class fills a task
    linked = settled(classes.select("node", "digest", "rep", "copies").join(components(links), "node"))
    first = F.struct(F.col("rep").isNull(), "rep", "digest")
    totals = linked.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("n_copies"), F.min_by("digest", first).alias("lead"))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.select("digest", "component", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    of_text = salted.join(totals, ["component", "salt"]).select("digest", "class_id", "n_copies", "lead")
    alone = classes.join(linked.select("node"), "node", "left_anti").select("digest", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), F.col("digest").alias("lead"))
    # the digests are taken again from the texts, so that no row's sketches are written but those of the classes
    out = hashed.select("doc_id", "digest").join(of_text.unionByName(alone), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("lead"))
    return out.select("doc_id", "class_id", kept.alias("kept"), "n_copies", F.lower(F.hex("digest")).alias("text_id"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id, with all its columns.

    Rows are matched by id and text, so another text under a kept id keeps its
    own decision; of rows equal in both one stays. Null texts and ids, empty and
    very long texts, and repeated rows go as in near_duplicates; an empty table
    stays empty; columns of any name pass through.
    """
    own_id, own_text, node = fresh("id"), fresh("text"), fresh("node")  # names that docs can't hold
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_id").alias(own_text)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(node) == F.col(own_text))
    return docs.withColumn(node, F.sha2(text_of(), 256)).join(kept, same, "left_semi").dropDuplicates(["doc_id", node]).drop(node)
