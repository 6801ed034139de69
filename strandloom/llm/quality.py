"""Quality by co-training (Blum and Mitchell, 1998).

One logistic classifier sees the text alone: its characters and its layout. The
other sees the page's metadata alone: source, language and length. Over rounds
each scores all unlabelled documents and labels those it is most sure of for
the other; each is then calibrated on labelled rows kept apart, and the
calibrated views are combined.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import held_out, settled, table, text_of

#: Hashed character bigrams and trigrams and the layout of the text view.
GRAM_DIMS, LAYOUT_DIMS = 1024, 8
#: Hashed sources, hashed languages and classes of length of the metadata view.
SOURCE_DIMS, LANG_DIMS, LENGTH_DIMS = 64, 16, 24
TEXT_DIMS, META_DIMS = GRAM_DIMS + LAYOUT_DIMS, SOURCE_DIMS + LANG_DIMS + LENGTH_DIMS
#: Log-odds beyond which a view is sure of a document.
SURE = 2.0


def text_view(text: str) -> np.ndarray:
    """L2-normal log counts of hashed character bigrams and trigrams, and the layout: lines, cases, marks."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = raw.astype(np.uint64)
    n = np.zeros(GRAM_DIMS)
    for k in (2, 3):
        if len(c) >= k:
            h = np.zeros(len(c) - k + 1, dtype=np.uint64)
            for i in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - k + 1 + i] + np.uint64(1)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            n += np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=GRAM_DIMS)
    v = np.log1p(n)
    norm = np.sqrt((v * v).sum())
    lines, d = text.split("\n"), max(len(raw), 1)
    kinds = np.bincount(_KINDS[np.minimum(raw, 128)], minlength=5)
    layout = [np.log1p(len(raw) / len(lines)) / 8, 4 * kinds[1] / d, 6 * kinds[2] / d, 6 * kinds[3] / d, 4 * kinds[4] / d, len(set(lines)) / len(lines), np.log1p(len(lines)) / 8, float(len(raw) == 0)]
    return np.concatenate([v / norm if norm else v, layout]).astype(np.float32)


def _kinds() -> np.ndarray:
    """Upper-case letters 1, marks 2, digits 3, the blank 4 among ASCII, anything else 0."""
    of = np.zeros(129, dtype=np.int64)
    of[65:91], of[48:58], of[32] = 1, 3, 4
    of[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
    return of


_KINDS = _kinds()


def meta_view(source: str | None, lang: str | None, length: int) -> np.ndarray:
    """Source and language as hashed indicators, and the class of the length."""
    v = np.zeros(META_DIMS, dtype=np.float32)
    v[zlib.crc32(b"s" + (source or "").encode("utf-8", "surrogatepass")) % SOURCE_DIMS] = 0.5
    v[SOURCE_DIMS + zlib.crc32(b"l" + (lang or "").encode("utf-8", "surrogatepass")) % LANG_DIMS] = 0.5
    v[SOURCE_DIMS + LANG_DIMS + min(int(length).bit_length(), LENGTH_DIMS - 1)] = 0.5
    return v


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, l2: float = 1e-3, tol: float = 1e-5, most: int = 3000) -> np.ndarray:
    """Weights of a class-balanced logistic regression with a constant last, by accelerated gradient steps until no slope exceeds `tol`."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    pos, neg = max((y > 0.5).sum(), 1), max((y <= 0.5).sum(), 1)
    s = np.where(y > 0.5, 0.5 / pos, 0.5 / neg)
    w = u = np.zeros(x.shape[1]) if start is None else start
    rate, run = 4.0 / max(float(s @ np.einsum("ij,ij->i", x, x)), 1e-9), 0
    for _ in range(most):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        g = (s * (p - y)) @ x + l2 * np.append(u[:-1], 0)
        if np.abs(g).max() < tol:
            return u
        nxt = u - rate * g
        run = 0 if g @ (nxt - w) > 0 else run + 1  # momentum starts again where it leads uphill
        u = nxt + run / (run + 3) * (nxt - w)
        w = nxt
    return w


def fit_curve(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of a small logistic regression with a constant last, by Newton steps, held to `prior` by a ridge."""
    x, w = np.hstack([np.clip(x, -30, 30), np.ones((len(x), 1))]), prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * (w - prior)
        d = np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), g), -1, 1)
        w = w - d
        if np.abs(d).max() < 1e-9:
            break
    return w


class Quality:
    """Weights of both views, the curve (slope, constant) that calibrates each, and the weights that combine them."""

    def __init__(self, base: float):
        z = float(np.log(base / (1 - base)))
        self.text, self.meta = np.zeros(TEXT_DIMS + 1), np.zeros(META_DIMS + 1)
        self.curves, self.mix = np.array([[0.0, z], [0.0, z]]), np.array([0.0, 0.0, z])

    def logits(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Of both views, not calibrated."""
        return np.stack([t @ self.text[:-1] + self.text[-1], m @ self.meta[:-1] + self.meta[-1]], axis=1)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return np.clip(z, -30, 30) * self.curves[:, 0] + self.curves[:, 1]

    def scores(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: the text view's, the metadata view's and the combined probability."""
        c = self.calibrated(self.logits(t, m))
        z = np.column_stack([c, np.clip(c, -30, 30) @ self.mix[:2] + self.mix[2]])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, t: np.ndarray, m: np.ndarray, y: np.ndarray) -> None:
        """Each view by a curve of its own, then both together."""
        z = self.logits(t, m)
        self.curves = np.array([fit_curve(z[:, [i]], y, np.array([1.0, 0.0])) for i in (0, 1)])
        self.mix = fit_curve(self.calibrated(z), y, np.array([0.5, 0.5, 0.0]))


def _arrays(found: list) -> tuple[np.ndarray, np.ndarray]:
    t = np.frombuffer(b"".join(r["tv"] for r in found), dtype=np.float32).reshape(-1, TEXT_DIMS)
    return t, np.frombuffer(b"".join(r["mv"] for r in found), dtype=np.float32).reshape(-1, META_DIMS)


def _views(batches):
    for pdf in batches:
        t = [text_view(x).tobytes() for x in pdf["t"]]
        m = [meta_view(s, g, len(x)).tobytes() for x, s, g in zip(pdf["t"], pdf["s"], pdf["g"], strict=True)]
        yield pd.DataFrame({"k": pdf["k"], "h": pdf["h"], "y": pdf["y"], "tv": t, "mv": m})


def _in_parts(texts: pd.Series, sources: pd.Series, langs: pd.Series, use) -> np.ndarray:
    """Rows of use(text views, metadata views), 512 documents at a time."""
    out = []
    for lo in range(0, len(texts), 512):
        part = texts[lo : lo + 512]
        m = [meta_view(s, g, len(x)) for x, s, g in zip(part, sources[lo : lo + 512], langs[lo : lo + 512], strict=True)]
        out.append(use(np.array([text_view(x) for x in part]), np.array(m)))
    return np.concatenate(out) if out else np.zeros((0, 3))


def _logits(spark: SparkSession, model: Quality):
    """A column function of text, source and language: the log-odds of both views as the model is now."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("z0 double, z1 double")
    def logits(texts: pd.Series, sources: pd.Series, langs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_in_parts(texts, sources, langs, shared.value.logits)[:, :2], columns=["z0", "z1"])

    return logits


def train_quality(docs: DataFrame, labels: DataFrame, *, max_train: int = 5000, rounds: int = 3, exchange: int = 250) -> Quality:
    """Fit on at most `max_train` labelled rows and, of each kind, view and round, `exchange` pseudo-labelled ones.

    Labelled rows outside the held-out fold are chosen by a hash; every fifth is
    kept for calibration. In a round each view scores all unlabelled documents
    outside that fold, and the `exchange` it is most sure of on either side,
    beyond SURE, go to the other view. Only rows of a fit are bounded, never
    those scored.
    """
    source, lang = F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("g")
    rows = docs.select(F.col("doc_id").alias("k"), text_of().alias("t"), source, lang).where(~held_out("k")).withColumn("h", F.xxhash64("t", "s", "g"))
    known = labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("double").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k"))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("k", F.lit(8)), "k").limit(max_train)
    kinds = f"k {docs.schema['doc_id'].dataType.simpleString()}, h long, y double, tv binary, mv binary"
    order = F.xxhash64("k", "h")
    found = rows.join(F.broadcast(picked), "k").mapInPandas(_views, kinds).orderBy(order, "k", "h").limit(max_train).collect()  # at most max_train ids sent out and rows fetched
    t, m = _arrays(found)
    y = np.array([float(r["y"]) for r in found])
    model = Quality(float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)))
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[~check])) < 2 or len(set(y[check])) < 2:
        return model
    own = {"text": (t[~check], y[~check]), "meta": (m[~check], y[~check])}
    taken: set[tuple] = set()
    for step in range(rounds + 1):
        model.text = fit_logistic(*own["text"], start=model.text if step else None)
        model.meta = fit_logistic(*own["meta"], start=model.meta if step else None)
        if step == rounds:
            break
        scored = rows.select("k", "h", _logits(docs.sparkSession, model)("t", "s", "g").alias("z")).select("k", "h", "z.*")
        sure = settled(scored.where((F.abs("z0") > SURE) | (F.abs("z1") > SURE)))  # ids and log-odds, no texts
        free = settled(sure.join(known.select("k"), "k", "left_anti").distinct())
        new: dict[tuple, dict[str, float]] = {}
        for z, other in (("z0", "meta"), ("z1", "text")):
            for label, by in ((1.0, F.col(z).desc()), (0.0, F.col(z).asc())):
                side = free.where(F.col(z) > SURE if label else F.col(z) < -SURE)
                best = side.select("k", "h", z).orderBy(by, "k", "h").limit(exchange + len(taken)).collect()
                for r in [r for r in best if (r["k"], r["h"]) not in taken][:exchange]:
                    new.setdefault((r["k"], r["h"]), {})[other] = label
        if not new:
            break
        taken |= set(new)
        ids = docs.sparkSession.createDataFrame([(k, h, None) for k, h in sorted(new)], kinds.split(", tv")[0])
        got = rows.join(F.broadcast(ids), ["k", "h"]).dropDuplicates(["k", "h"]).mapInPandas(_views, kinds).orderBy("k", "h").collect()  # at most 4 x exchange rows
        views = dict(zip(("text", "meta"), _arrays(got), strict=True))
        for other in own:
            at = [i for i, r in enumerate(got) if other in new[r["k"], r["h"]]]
            if at:
                x, before = own[other]
                own[other] = np.vstack([x, views[other][at]]), np.append(before, [new[got[i]["k"], got[i]["h"]][other] for i in at])
    model.calibrate(t[check], m[check], y[check])
    return model


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, text_score, meta_score; predicted is 1 if score >= 0.5.

    text_score and meta_score are the calibrated views alone. Null texts,
    sources and languages read as empty; a text of any length is read whole;
    equal rows score alike and stay; without labels of both kinds every score
    is the base rate; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text_score double, meta_score double, score double")
    def score(texts: pd.Series, sources: pd.Series, langs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_in_parts(texts, sources, langs, shared.value.scores), columns=["text_score", "meta_score", "score"])

    out = docs.select("doc_id", score(text_of(), F.col("source").cast("string"), F.col("lang").cast("string")).alias("q"))
    return out.select("doc_id", held_out().alias("held_out"), "q.score", (F.col("q.score") >= 0.5).cast("int").alias("predicted"), "q.text_score", "q.meta_score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
