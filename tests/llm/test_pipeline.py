import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_chain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    bins = {}
    for r in rows:
        if r["bin_id"] is not None:
            bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_words"]
    assert max(bins.values()) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "source_mix", "packing"]


def test_stages_equal_their_operators(spark, data):
    """Each decision of a stage is its operator's, row by row."""
    from strandloom.llm.common import table
    from strandloom.llm.order_minhash import near_duplicates
    from strandloom.llm.toxicity import score_toxic, train_toxic

    docs = table(spark, data, "documents")
    first = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, data)
    assert first.columns == docs.columns
    scores = score_toxic(docs, train_toxic(docs, table(spark, data, "labels")))
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in scores.where("predicted = 0").collect()}
    third = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data)
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in near_duplicates(docs).where("kept").collect()}


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated and empty rows, a very long text, a clashing column, and a table without rows."""
    good = [(i, f"this is a plain english text number {i} with the words of a page and of its {'own ' * (i % 5)} kind", "en" if i % 3 else "de", "s" if i % 2 else None, 1, "x") for i in range(60)]
    odd = [(None, "a text that has no id at all but the words of a page", None, None, None, None), (70, None, "en", "s", 0, "x"), (71, "", None, "s", 0, "x"), (3, good[3][1], "en", "s", 1, "x"), (72, "plain words " * 20_000, "en", "s", 1, "x")]
    labels = [(i, 1, int(i % 7 == 0)) for i in range(60)]
    for name, rows in (("odd", good + odd), ("empty", [])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bin_id string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = {r["doc_id"] for r in got}
    assert 72 in kept and None in kept and not kept & {70, 71}
    assert sum(r["n_words"] for r in got if r["doc_id"] == 72) % 40_000 == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
