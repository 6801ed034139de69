"""Toxic passages as maximum-scoring segments of token log-odds.

Each token scores by the log-odds of its unit between toxic and clean labelled
texts under an informative Dirichlet prior (Monroe et al., 2008), drawn towards
0 by its standard error: positive where the evidence is strong, negative where
it speaks for clean texts, a small cost where there is none. The unit is the
word; a word without evidence of its own falls back on its first letters, which
carry over to unseen inflections. Ruzzo and Tompa's linear scan lists every
maximal segment; a Gumbel law fitted to the best segments of clean texts turns
segment scores into p-values, and their evidence is calibrated to a
probability.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import held_out, settled, table, text_of

TOKENS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as units beside the word itself.
STEMS = (4, 5, 6)
#: A segment with a smaller p-value is significant.
ALPHA = 0.05


def units(word: str) -> list[str]:
    return ["=" + word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end inclusive, score) of token scores, by Ruzzo and Tompa.

    Linear in the tokens but for the search of earlier candidates, which each
    positive token passes once.
    """
    found: list[list] = []  # left sum, right sum, start, end, previous candidate with a smaller left sum
    for at, (s, total) in enumerate(zip(scores, accumulate(scores), strict=True)):
        if s <= 0:
            continue
        cand = [total - s, total, at, at, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= cand[0]:
                j = found[j][4]
            cand[4] = j
            if j < 0 or found[j][1] >= cand[1]:
                found.append(cand)
                break
            cand = [found[j][0], cand[1], found[j][2], cand[3], -1]
            del found[j:]
    return [(a, b, right - left) for left, right, a, b, _ in found]


class ToxicModel:
    """table: unit scores, positive or negative; gap: cost of a token without evidence; the rest: calibration."""

    def __init__(self, table: dict[str, float], gap: float, base: float):
        self.table, self.gap, self.base = table, gap, base
        self.mu, self.beta, self.mean_n = 0.0, 0.5, 1.0
        self.a, self.b = math.log(base / (1 - base)), 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def word(self, w: str) -> float:
        """The word's own score; where it has none, the highest of its beginnings, else the gap."""
        own = self.table.get("=" + w)
        return own if own is not None else max((self.table[u] for u in units(w) if u in self.table), default=-self.gap)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        cache = self.__dict__.setdefault("cache", {})
        words = TOKENS.findall(text.lower())
        try:
            scores = [cache[w] for w in words]
        except KeyError:
            if len(cache) > 300_000:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = self.word(w)
            scores = [cache[w] for w in words]
        return len(words), maximal_segments(scores) if scores and max(scores) > 0 else []

    def p_value(self, score: float, n: int) -> float:
        z = (score - self.mu) / self.beta - math.log((n + 1) / (self.mean_n + 1))
        return -math.expm1(-math.exp(-z)) if z > -700 else 1.0

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
        kept, total = [], 0.0
        for a, b, s in segments:
            p = self.p_value(s, n)
            if p < ALPHA:
                kept.append((a, b, s))
                total -= math.log10(max(p, 1e-30))
        return total, kept

    def score(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        n, segments = self.segments(text)
        e, kept = self.evidence(n, segments)
        z = self.a + self.b * min(e, 60.0)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0, n, kept


def _sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, y) of at most max_train labelled rows outside the held-out fold, one row for equal texts; a label other than 0 and 1 is none."""
    known = F.col("toxic").cast("double")
    ids = labels.select(F.col("doc_id").alias("k"), F.when(known == 1, 1).when(known == 0, 0).alias("y")).where(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out("k"))
    ids = ids.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k", F.lit(11)), "k").limit(max_train)
    rows = docs.select(F.col("doc_id").alias("k"), text_of().alias("t")).where(~held_out("k")).join(F.broadcast(ids), "k")  # at most max_train ids
    return rows.groupBy(F.sha2("t", 256).alias("h")).agg(F.min("t").alias("t"), F.max("y").alias("y"))


def train_toxic(docs: DataFrame, labels: DataFrame, *, max_train: int = 20_000, prior: float = 20.0, errors: float = 1.64, least: float = 1.5, gap: float = 0.2) -> ToxicModel:
    """Fit on at most `max_train` labelled rows (chosen by a hash of the id).

    Unit counts are texts that hold the unit; `prior` is the Dirichlet mass in
    texts, spread as in both classes together. A unit whose log-odds less
    `errors` standard errors exceed `least` scores that; a word whose log-odds
    plus as many stay below 0 scores that; a word of both kinds of texts that
    could do either scores -`gap`, as does one never seen, so texts without
    toxic words drift down. Units have to stand in two of the texts; the model
    holds those with a score of their own, and words at the gap only where one
    of their beginnings has one.
    """
    train = _sample(docs, labels, max_train)

    def partial(batches):
        n = [0, 0]
        for pdf in batches:
            held: dict[str, list[int]] = {}
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                n[y] += 1
                for u in {u for w in set(TOKENS.findall(t.lower())) for u in units(w)}:
                    held.setdefault(u, [0, 0])[y] += 1
            yield pd.DataFrame({"u": list(held), "c0": [c[0] for c in held.values()], "c1": [c[1] for c in held.values()]}, columns=["u", "c0", "c1"]).astype({"c0": "int64", "c1": "int64"})
        yield pd.DataFrame({"u": [""], "c0": [n[0]], "c1": [n[1]]})

    counts = train.select("t", "y").mapInPandas(partial, "u string, c0 long, c1 long").groupBy("u").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counts = settled(counts.where("c0 + c1 >= 2 OR u = ''"))
    head = counts.where("u = ''").first()
    n0, n1 = (head["c0"], head["c1"]) if head else (0, 0)
    base = (n1 + 0.5) / (n0 + n1 + 1.0) if n0 + n1 else 0.01
    model = ToxicModel({}, gap, min(max(base, 1e-4), 1 - 1e-4))
    if not n1 or not n0:
        return model
    share = F.lit(prior) * (F.col("c1") + F.col("c0")) / F.lit(float(n1 + n0))

    def log_odds(c: str, n: int) -> Column:
        held = F.col(c) + share
        return F.log(held / F.greatest(F.lit(float(n)) + prior - held, F.lit(0.5)))

    mid, error = log_odds("c1", n1) - log_odds("c0", n0), errors * F.sqrt(1 / (F.col("c1") + share) + 1 / (F.col("c0") + share))
    scored = counts.where("u <> ''").select("u", "c0", "c1", (mid - error).alias("low"), (mid + error).alias("high"))
    # beginnings only speak for toxic texts; a word met often enough to do so speaks for itself
    known = F.when((F.col("c1") >= 2) & (F.col("low") > least), F.col("low")).when(F.startswith("u", F.lit("=")) & (F.col("high") < 0), F.col("high")).when(F.startswith("u", F.lit("=")) & (F.col("c0") >= 2), F.lit(-gap))
    scored = settled(scored.select("u", known.alias("s")).where("s IS NOT NULL"))
    # what costs the gap needs an entry only to keep one of its beginnings from speaking for it
    idle = F.startswith("u", F.lit("=")) & (F.col("s") == -gap)
    begun = F.explode(F.array(*[F.concat(F.substring("u", 2, k), F.lit("*")) for k in STEMS])).alias("b")
    needed = scored.where(idle).select("u", "s", begun).join(scored.where(~idle).select(F.col("u").alias("b")), "b", "left_semi").select("u", "s").distinct()
    model.table = {r["u"]: r["s"] for r in scored.where(~idle).unionByName(needed).collect()}
    return _calibrate(model, train)


def _calibrate(model: ToxicModel, train: DataFrame) -> ToxicModel:
    shared = train.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n double, best double")
    def best(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.segments(t) for t in texts]
        return pd.DataFrame({"n": [float(n) for n, _ in found], "best": [max((s for _, _, s in seg), default=0.0) for _, seg in found]}, columns=["n", "best"])

    null = train.where("y = 0").select(best("t").alias("b")).agg(F.avg("b.n").alias("n"), F.percentile_approx("b.best", [0.5, 0.99], 1000).alias("q")).first()
    model.mean_n = null["n"] or 1.0
    middle, high = null["q"] or (0.0, 0.0)  # the Gumbel quantiles at 0.5 and 0.99, which a few mislabelled texts don't move
    model.beta = max(0.35, (high - middle) / (math.log(-math.log(0.5)) - math.log(-math.log(0.99))))
    model.mu = middle + math.log(-math.log(0.5)) * model.beta
    fitted = train.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        m = fitted.value
        return pd.Series([round(4 * min(m.evidence(*m.segments(t))[0], 60.0)) / 4 for t in texts], dtype="float64")

    bins = train.select("y", evidence("t").alias("e")).groupBy("e", "y").agg(F.count("*").alias("n")).collect()  # at most 2 x 241 rows
    x, y, w = (np.array([float(r[k]) for r in bins]) for k in ("e", "y", "n"))
    a, b = model.a, 0.0
    for _ in range(60):  # Newton steps of a ridge-held logistic curve
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([np.sum(w * (y - p)), np.sum(w * (y - p) * x)]) - 0.02 * np.array([a, b])
        v = w * p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.02 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = float(a), float(max(b, 0.0))
    return model


def score_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_words, n_passages, passages.

    passages: array of (first, last, score), the words of every significant
    segment. predicted is 1 from a score of 0.5 on, evidence counts up to 60
    powers of ten. Reads text alone, whole at any length. Null and empty texts hold
    no passage and get the score of a text without evidence; equal rows score
    alike and stay; no rows give no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_words long, passages array<struct<first:int,last:int,score:double>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.score(t) for t in texts]
        return pd.DataFrame({"score": [r[0] for r in rows], "n_words": [r[1] for r in rows], "passages": [[{"first": a, "last": b, "score": s} for a, b, s in r[2]] for r in rows]}, columns=["score", "n_words", "passages"])

    out = docs.select("doc_id", text_of().alias("text")).select("doc_id", score("text").alias("s"))
    return out.select("doc_id", held_out().alias("held_out"), "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.n_words", F.size("s.passages").alias("n_passages"), "s.passages")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxic(docs, train_toxic(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, with all their columns.

    Null and empty texts hold no passage and stay; texts of any length are read
    whole; equal rows share their fate; an empty table stays empty; columns of
    any name pass through.
    """
    model = train_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t)[0] for t in texts], dtype="float64")

    return docs.where(toxic(text_of()) < 0.5)
