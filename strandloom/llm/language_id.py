"""Language identification by sparse multinomial logistic regression.

Character n-grams are hashed to a fixed space and weighted by TF-IDF, the
document frequencies counted over the rows that may be learned from. The weights
are fitted with follow-the-regularised-leader (McMahan et al., 2013) under an
elastic net and the probabilities calibrated by one temperature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import held_out, table, text_of

#: Size of the hashed feature space.
DIMS = 1 << 14
#: Lengths of the character n-grams.
NGRAMS = (1, 2, 3)
UNDETERMINED = "und"


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a lower-cased text, a vector of DIMS."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = np.zeros(DIMS, dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint64)
    for k in range(max(NGRAMS)):
        if len(c) <= k:
            break
        h = h[: len(c) - k] * np.uint64(0x9E3779B97F4A7C15) + c[k:] + np.uint64(1)
        if k + 1 in NGRAMS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((x >> np.uint64(50)).astype(np.int64), minlength=DIMS)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and L2-normal TF-IDF values."""
    n = grams(text)
    at = np.flatnonzero(n)
    v = np.log1p(n[at]) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, (v / norm if norm else v)


class LanguageModel:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        at, v = vector(text, self.idf)
        z = (v @ self.weights[at]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of every hashed n-gram, over all rows (t); a task sends DIMS counts at most."""

    def partial(batches):
        held, n = np.zeros(DIMS + 1, dtype=np.int64), 0
        for pdf in batches:
            for t in pdf["t"]:
                held[:DIMS] += grams(t) > 0
                n += 1
        held[DIMS] = n
        at = np.flatnonzero(held)
        yield pd.DataFrame({"f": at, "n": held[at]})

    rows = docs.select("t").mapInPandas(partial, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(DIMS + 1, dtype=np.int64)
    for r in rows:
        held[r["f"]] = r["n"]
    return held[:DIMS], int(held[DIMS])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, *, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights (DIMS, k) of a multinomial logistic regression, FTRL-proximal with an elastic net."""
    z, n, w = np.zeros((DIMS, k)), np.zeros((DIMS, k)), np.zeros((DIMS, k))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v, y = rows[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            s = v @ wi
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = v[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - step * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w


def train_language(docs: DataFrame, *, rows_per_lang: int = 300, max_rows: int = 20_000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> LanguageModel:
    """Fit on about `rows_per_lang` rows of every language, fewer (20 at least) where languages are so many that these exceed `max_rows`.

    Rows outside the held-out fold with a non-null lang and a letter, taken by a
    hash of doc_id under a threshold set from the language's count, the first
    2 x rows_per_lang of a language by that hash at most. Every fifth row of a
    language fits the temperature. Document frequencies are over all of these
    rows, not the sample alone; held-out texts and rows without lang are not read.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", text_of().alias("t")).where(F.col("lang").isNotNull() & ~held_out() & F.col("t").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = counts.count()
    per_lang = max(20, min(rows_per_lang, max_rows // max(n_langs, 1)))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.join(F.broadcast(counts), "lang").where(unit < F.lit(float(per_lang)) / F.col("n"))  # a row a language
    first = Window.partitionBy("lang").orderBy("u", "t")
    sample = sample.select("lang", F.xxhash64("doc_id", F.lit(seed + 1)).alias("u"), "t").withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * per_lang)
    held, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + held)) + 1.0
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def featured(batches):
        for pdf in batches:
            out = [vector(t, shared.value) for t in pdf["t"]]
            yield pd.DataFrame({"lang": pdf["lang"], "u": pdf["u"], "at": [a.astype(np.uint16).tobytes() for a, _ in out], "v": [v.astype(np.float32).tobytes() for _, v in out]})

    taken = sample.select("lang", "u", "t").mapInPandas(featured, "lang string, u long, at binary, v binary").collect()
    taken.sort(key=lambda r: (r["u"], r["lang"], bytes(r["at"])))
    langs = sorted({r["lang"] for r in taken})
    if not langs:
        return LanguageModel([], idf, np.zeros((DIMS, 0)), 1.0)
    index = {x: i for i, x in enumerate(langs)}
    data = [(np.frombuffer(r["at"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["v"], dtype=np.float32).astype(np.float64), index[r["lang"]]) for r in taken]
    met, fit, check = [0] * len(langs), [], []
    for d in data:  # the first four rows of a language are fitted, so that each has weights
        met[d[2]] += 1
        (fit if met[d[2]] % 5 else check).append(d)
    check = check or fit
    weights = ftrl(fit, len(langs), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    logits = np.array([v @ weights[at] for at, v, _ in check])
    y = np.array([d[2] for d in check])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    return LanguageModel(langs, idf, weights, float(temperature))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Reads text alone, whole at any length. lang_pred is `und` with score 0 for
    a null text, a text without a letter, or where nothing could be learned; of
    languages that score alike the first by code point is given; equal rows
    score alike and stay; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select("doc_id", text_of().alias("text")).select("doc_id", predict("text").alias("p")).select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train_language(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Documents whose language is recognised with at least min_score, with all their columns.

    Learns from the documents of the stage; one without a letter (`und`), null
    or empty goes. Texts of any length are read whole; equal rows share their
    fate; an empty table stays empty; columns of any name pass through.
    """
    shared = spark.sparkContext.broadcast(train_language(docs))

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        return pd.Series([(p := shared.value.predict(t))[0] != UNDETERMINED and p[1] >= min_score for t in texts], dtype="bool")

    return docs.where(keeps(text_of()))
