import pytest

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Hello world, it's a test: don't  panic!\n\n\tTabs and   spaces   \r\n", "", None, " leading", "trailing ", "\n", "  \n  ", "naïve café Straße ÆØÅ ǅ ª º ² ½ µ",
    "日本語のテキスト 123 ١٢٣", "emoji 🎉🎉 ‍ ­   \x1c \x85 x", "<|endoftext|> inside <|endoftext|>text", "a" * 5000, "12345 67.89 $$$ ### %%%", "'s 'll 've 'd 'm 're 't 'S",
    "İstanbul ŁÓDŹ İ", "\x00\x01 control", "word " * 3000, "“quotes” – dashes… €", "\xa0nbsp\xa0 　wide", "mixed🎉case ABCdef",
]


def truth(texts, name):
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return [len(m.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("cache", [400_000, 3])
def test_counts_equal_the_library(spark, name, cache):
    from strandloom.llm.token_counts import token_counts

    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(docs, P.path(name), table_size=16 if cache == 3 else 32_768, cache_size=cache, limit=100).collect()
    assert len(got) == len(rows)
    want = dict(enumerate(truth(TEXTS, name)))
    for r in got:
        if r["doc_id"] is not None:
            t = TEXTS[r["doc_id"]] or ""
            assert (r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len(t.encode())), t
            assert r["over_limit"] == (r["n_tokens"] > 100)


def test_empty_table(spark):
    from strandloom.llm.token_counts import token_counts

    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0
