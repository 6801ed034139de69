import math
import random
import re
import zlib

from strandloom.llm.common import held_out
from strandloom.llm.toxicity import ToxicModel, maximal_segments, score_toxic, toxicity_stage, train_toxic


def brute_segments(dense):
    """Maximal scoring segments by the definition: the best segment, then both sides of it again; ties to the leftmost, shortest."""
    out = []

    def search(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += dense[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j, total)
        if best:
            search(lo, best[0])
            out.append(best)
            search(best[1] + 1, hi)

    search(0, len(dense))
    return out


def test_segments_equal_the_definition():
    draw = random.Random(2)
    for _ in range(300):
        dense = [draw.choice([-0.5, -0.2, -1.7, draw.random() * 3]) for _ in range(draw.randint(0, 25))]
        got = maximal_segments(dense)
        want = brute_segments(dense)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def corpus(spark, n=900):
    draw = random.Random(6)
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con", "tur") for b in ("em", "sum", "or", "et", "ad", "ix", "us")]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(draw.randint(1, 4)):
                text.insert(draw.randrange(len(text)), draw.choice(["vilest", f"grobz{draw.choice('abcdefgh')}{draw.choice('klmn')}"]))
        rows.append((i, " ".join(text), "en", "s", 1.0, "clash"))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    rows += [(None, "vilest grobzak", None, None, 0.0, ""), (5000, None, None, None, 0.0, ""), (5001, "", "en", "s", 0.0, ""), (5002, "lorem " * 30_000 + "vilest grobzzz " + "sitet " * 30_000, "en", "s", 0.0, ""), (0, rows[0][1], "en", "s", 0.0, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, held_out string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = train_toxic(docs, labels)
    rows = score_toxic(docs, model).collect()
    assert len(rows) == docs.count()
    tested = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in tested)
    assert len(tested) > 100 and right / len(tested) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[5000]["predicted"] == by[5001]["predicted"] == 0 and by[5000]["score"] == by[5001]["score"]
    assert by[None]["predicted"] == 1 and by[None]["held_out"]
    long = by[5002]
    assert long["n_passages"] == 1 and long["passages"][0]["first"] == 30_000


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", (held_out().cast("int") * (1 - labels["toxic"]) + (~held_out()).cast("int") * labels["toxic"]).cast("int"))
    a, b = train_toxic(docs, labels), train_toxic(docs, flipped)
    assert a.table == b.table and (a.a, a.b) == (b.a, b.b)


def test_model_equals_a_plain_computation(spark):
    """Log-odds, Gumbel law, curve and scores from the definitions, over plain lists."""
    docs, labels = corpus(spark, 240)
    model = train_toxic(docs, labels)
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    train = {r["text"] or "": y[r["doc_id"]] for r in docs.collect() if r["doc_id"] in y and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    n = [sum(v == c for v in train.values()) for c in (0, 1)]
    held = {}
    for text, label in train.items():
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        for u in {"=" + w for w in words} | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) >= k}:
            held.setdefault(u, [0, 0])[label] += 1
    table = {}
    for u, (c0, c1) in held.items():
        if c0 + c1 < 2:
            continue
        share = 20.0 * (c0 + c1) / sum(n)
        odds = [math.log((c + share) / max(m + 20.0 - c - share, 0.5)) for c, m in ((c0, n[0]), (c1, n[1]))]
        error = 1.64 * math.sqrt(1 / (c1 + share) + 1 / (c0 + share))
        low, high = odds[1] - odds[0] - error, odds[1] - odds[0] + error
        if c1 >= 2 and low > 1.5:
            table[u] = low
        elif u[0] == "=" and high < 0:
            table[u] = high
        elif u[0] == "=" and c0 >= 2:
            table[u] = -0.2
    assert any(v < -0.2 for v in table.values()) and any(v > 0 for v in table.values())
    # words at the gap are left out where no beginning of theirs scores: every word scores as with them
    needed = {u for u, v in table.items() if v != -0.2 or any(u[1:][:k] + "*" in table for k in (4, 5, 6) if len(u) > k)}
    assert needed == model.table.keys() and len(needed) < len(table)
    assert all(abs(v - model.table[u]) < 1e-9 for u, v in table.items() if u in needed)
    assert all(abs(model.word(u[1:]) - v) < 1e-9 for u, v in table.items() if u[0] == "=")

    def passages(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        scores = [table.get("=" + w, max((table[u] for u in (w[:k] + "*" for k in (4, 5, 6) if len(w) >= k) if u in table), default=-0.2)) for w in words]
        return len(words), brute_segments(scores)

    clean = [passages(t) for t, label in train.items() if label == 0]
    best = sorted(max((s for _, _, s in seg), default=0.0) for _, seg in clean)
    q = [best[math.ceil(p * len(best)) - 1] for p in (0.5, 0.99)]
    beta = max(0.35, (q[1] - q[0]) / (math.log(-math.log(0.5)) - math.log(-math.log(0.99))))
    mu, mean = q[0] + math.log(-math.log(0.5)) * beta, sum(k for k, _ in clean) / len(clean)
    assert abs(model.beta - beta) < 1e-9 and abs(model.mu - mu) < 1e-9 and abs(model.mean_n - mean) < 1e-9
    for r in score_toxic(docs, model).collect():
        if r["doc_id"] is None or r["doc_id"] >= 240:
            continue
        text = next(d["text"] for d in docs.where(f"doc_id = {r['doc_id']}").take(1)) if r["doc_id"] % 40 == 0 else None
        if text is None:
            continue
        k, seg = passages(text)
        p = [1 - math.exp(-math.exp(-((s - mu) / beta - math.log((k + 1) / (mean + 1))))) for _, _, s in seg]
        e = min(sum(-math.log10(max(x, 1e-30)) for x in p if x < 0.05), 60.0)
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.a + model.b * e)))) < 1e-9
        assert [(x["first"], x["last"]) for x in r["passages"]] == [(a, b) for (a, b, _), x in zip(seg, p, strict=True) if x < 0.05]


def test_only_0_and_1_are_labels(spark):
    docs, labels = corpus(spark, 60)
    odd = labels.unionByName(spark.createDataFrame([(3, 2), (4, -1), (7, None)], "doc_id long, toxic int"))
    assert train_toxic(docs, odd.where("doc_id NOT IN (3, 4, 7) OR toxic IS NULL OR toxic NOT IN (0, 1)")).table == train_toxic(docs, labels.where("doc_id NOT IN (3, 4, 7)")).table


def test_stage_handles_odd_rows(spark, tmp_path):
    docs, labels = corpus(spark, 300)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    kept = toxicity_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5000 in ids and 5001 in ids and None not in ids and 5002 not in ids and 0 not in ids
    assert toxicity_stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_nothing_to_learn(spark):
    docs, labels = corpus(spark, 30)
    model = train_toxic(docs, labels.where("false"))
    assert isinstance(model, ToxicModel) and not model.table
    assert {r["predicted"] for r in score_toxic(docs, model).collect()} == {0}
    assert score_toxic(docs.where("false"), model).count() == 0
    assert train_toxic(docs.where("false"), labels).table == {}
