"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a
bounded cache in every Python worker that a miss fills through the tokenizer.
No pre-token is ever shuffled; the counts do not depend on either tier.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table, text_of

#: Texts of these characters alone split alike under every Unicode version, and by the plainer pattern below.
STABLE = "[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*"
#: The same split for such texts: their letters are \w but digits and the underscore.
PLAIN_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"

_WORKER: dict[str, "TokenLengths"] = {}


def _plain(spec: dict) -> bool:
    """Whether pre-tokens come from the byte-level split alone."""
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _merger(spec: dict):
    """A function from the bytes of a pre-token to its tokens, by the ranks of the vocabulary."""
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items()}
    return tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def merges_by_rank(content: bytes) -> bool:
    """Whether a byte-level vocabulary can be merged by token rank alone: its merges stand in the order of the tokens they make, and each token makes itself."""
    from tokenizers import Tokenizer

    model = json.loads(content)["model"]
    vocab, letters = model.get("vocab"), _byte_letters()
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or not isinstance(vocab, dict):
        return False
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    if None in made or made != sorted(made) or set(vocab.values()) - set(made) != {vocab[c] for c in letters if c in vocab} or len(vocab) != len(made) + 256:
        return False
    single = [t for t in (bytes(letters[c] for c in token).decode("utf-8", "replace") for token in vocab) if "\ufffd" not in t]
    tokenizer = Tokenizer.from_str(content.decode("utf-8"))
    pieces = re.compile(PLAIN_SPLIT).findall
    alone = [t for t in single if pieces(t) == [t]]
    return all(len(e.ids) == 1 for e in tokenizer.encode_batch_fast(alone, add_special_tokens=False))


class TokenLengths:
    """Token count of whole texts under one tokenizer file's content."""

    def __init__(self, kind: str, content: bytes, frequent: dict[str, int], cache_size: int, ordered: bool = False):
        self.cache_size, self.kind = cache_size, kind
        if kind == "model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.split = None
            return
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content.decode("utf-8"))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split = re.compile(PLAIN_SPLIT).findall if _plain(spec) else None
        self.stable = re.compile(STABLE).fullmatch
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.merge = _merger(spec) if ordered else None
        self.frequent = dict(frequent)
        self.cache = dict(self.frequent)

    def encoded(self, texts: list[str]) -> list[int]:
        """By the library alone."""
        if self.kind == "model":
            return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def lengths(self, pieces: list[str]) -> list[int]:
        """Of pre-tokens, each merged on its own."""
        if self.merge is None:
            return self.encoded(pieces)
        return [len(self.merge(p.encode("utf-8"))) for p in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.encoded(texts)
        out: list[int] = []
        for text in texts:
            if any(s in text for s in self.special) or not self.stable(text):
                out.append(self.encoded([text])[0])
                continue
            pieces = self.split(text)
            try:
                out.append(sum(map(self.cache.__getitem__, pieces)))
            except KeyError:
                missing = [p for p in set(pieces) if p not in self.cache]
                if len(self.cache) + len(missing) > self.cache_size:
                    self.cache = dict(self.frequent)
                    missing = [p for p in set(pieces) if p not in self.cache]
                self.cache.update(zip(missing, self.lengths(missing), strict=True))
                out.append(sum(map(self.cache.__getitem__, pieces)))
        return out


def _worker(key: str, shared, cache_size: int) -> TokenLengths:
    """The worker's own table, kept over tasks of one query."""
    if key not in _WORKER:
        _WORKER.clear()
        kind, content, frequent, ordered = shared.value
        _WORKER[key] = TokenLengths(kind, content, frequent, cache_size, ordered)
    return _WORKER[key]


def frequent_lengths(docs: DataFrame, kind: str, content: bytes, sample_rows: int, size: int) -> dict[str, int]:
    """Lengths of at most `size` frequent pre-tokens of at most `sample_rows` texts; only warms the cache."""
    lengths = TokenLengths(kind, content, {}, 0)
    if lengths.split is None or not size:
        return {}
    rows = docs.select(text_of().alias("t")).limit(sample_rows).collect()
    seen = Counter(p for r in rows if lengths.stable(r["t"]) for p in lengths.split(r["t"]))
    common = [p for p, _ in seen.most_common(size) if len(p) <= 64 and not any(s in p for s in lengths.special)]
    return dict(zip(common, lengths.lengths(common), strict=True))


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024, table_size: int = 32_768, sample_rows: int = 500, cache_size: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The tokenizer file is read on the driver and broadcast with the frequent
    table (at most `table_size` entries of at most 64 characters, taken from at
    most `sample_rows` texts; it changes speed only). Texts with special strings
    or characters whose class varies between Unicode versions go through the
    library whole. Null texts count as empty (0 tokens); repeated rows are kept;
    an empty table gives an empty result; other columns are ignored.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    kind = "model" if tokenizer_path.endswith(".model") else "json"
    shared = docs.sparkSession.sparkContext.broadcast((kind, content, frequent_lengths(docs, kind, content, sample_rows, table_size), kind == "json" and _plain(json.loads(content)) and merges_by_rank(content)))

    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(_worker(key, shared, cache_size).counts(texts.tolist()), dtype="int64")

    counted = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
