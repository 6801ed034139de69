from hashlib import sha256

import pytest

P = pytest.importorskip("public_tokenizers")
NAME = "word_bpe_49k.json"
TEXTS = [
    "Hello world, it's a test: don't  panic!\n\n\tTabs", "", None, " leading", "naïve café Straße ÆØÅ ǅ ª º ² ½ µ İstanbul", "日本語のテキスト 123 ١٢٣ ΟΔΥΣΣΕΥΣ Σ", "emoji 🎉🎉 ‍ ­   \x1c \x85 x", "<|endoftext|> in <|startoftext|>text<|endoftext",
    "a" * 5000, "aaaa aaa aa banana bananas", "12345 67.89 $$$ ### %%% ____ a_b", "'s 'll 've 'd 'm 're 't 'S 'LL", "\x00\x01 control \x00\x00two", "word " * 3000, "é Å", "“quotes” – dashes… €", "Ångström ﬁ ſ", "the then there thereby other others",
]


def truth(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(NAME))
    found = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    return [(len(e.ids), sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for e in found]


@pytest.mark.parametrize("cache", [500_000, 3])
def test_equals_the_library(spark, cache):
    from strandloom.llm.bpe import bpe_round_trip

    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1), (None, "null id", 1)]
    got = bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), P.path(NAME), cache_size=cache).collect()
    assert len(got) == len(rows)
    want = truth(TEXTS)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]], TEXTS[r["doc_id"]]


def test_query_equals_the_library(spark, data):
    from strandloom.llm.bpe import op13_bpe_round_trip

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op13_bpe_round_trip(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r["doc_id"] for r in docs], truth([r["text"] for r in docs]), strict=True))


def test_every_token_and_chance_words_equal_the_library():
    """Each token of the vocabulary on its own, and words of few letters in which merges compete."""
    import json
    import random

    from tokenizers import Tokenizer, models

    from strandloom.llm.bpe import Merges, trie_encodings

    spec = json.load(open(P.path(NAME)))
    m = spec["model"]
    bare = Tokenizer(models.BPE(vocab=m["vocab"], merges=[tuple(x) for x in m["merges"]], end_of_word_suffix="</w>"))
    draw = random.Random(5)
    words = [t.removesuffix("</w>") for t in m["vocab"]] + ["".join(draw.choice("aeinstr") for _ in range(draw.randint(1, 40))) for _ in range(3000)] + ["a" * n for n in range(1, 70)]
    words = [w for w in words if w]
    got = trie_encodings(words, Merges(spec))
    assert got == [e.ids for e in bare.encode_batch(words)]


def test_shared_prefixes_are_computed_once():
    import json

    from strandloom.llm.bpe import Merges, trie_encodings

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    merges = Merges(json.load(open(P.path(NAME))))
    merges.ids = Counted(merges.ids)
    trie_encodings(["inter" * 20 + c for c in "abcdefgh"], merges)
    together, Counted.asked = Counted.asked, 0
    for c in "abcdefgh":
        trie_encodings(["inter" * 20 + c], merges)
    assert together * 4 < Counted.asked


def test_other_vocabularies_are_refused_and_empty_table(spark):
    from strandloom.llm.bpe import Merges, bpe_round_trip

    with pytest.raises(ValueError):
        Merges({"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, "merges": ["a b", "b c", "ab c", "a bc"]}})
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), P.path(NAME)).count() == 0
