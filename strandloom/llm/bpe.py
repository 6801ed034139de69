"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is fixed by the last token of each of its prefixes: that
of a prefix is the only token at its end that the merges leave apart from the
last token before it. Distinct words of a task share a trie of their symbols,
and one depth-first walk gives every prefix its last token, shared ones once.
"""

from __future__ import annotations

import json
import re
import uuid
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table, text_of
from strandloom.llm.token_counts import STABLE, _byte_letters

#: Fixed value: the split of the vocabulary file, and the same for texts of STABLE characters, whose letters are \w but digits and the underscore.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
#: The same once more for lower-cased ASCII.
ASCII_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
#: Letters of texts whose words go into one trie.
GROUP = 1 << 20
#: Marks, outside of STABLE, of words that the library has written and of added tokens.
WRITTEN, ADDED = "\ue000", "\ue001"

_WORKER: dict[str, "Encoder"] = {}


class Merges:
    """The merges of a vocabulary as a binary tree of tokens, and whether two tokens stay apart."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE vocabulary")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(pairs)}
        self.parts = {self.ids[a + b]: (self.ids[a], self.ids[b]) for a, b in pairs}
        self.born = {self.ids[a + b]: i for i, (a, b) in enumerate(pairs)}
        # lengths of the tokens with the same last two symbols, the longest first; a single symbol fits everywhere
        tails: dict[str, set[int]] = {}
        for token in self.ids:
            body = token.removesuffix(self.suffix) if self.suffix else token
            if len(body) > 1:
                tails.setdefault(body[-2:] + token[len(body) :], {1}).add(len(body))
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in tails.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        if len(self.parts) != len(pairs) or any(self.born.get(t, -1) >= i for t, i in self.born.items() for t in self.parts[t]):
            raise ValueError("the same token comes from two merges, or before its parts")

    def stay(self, left: int, right: int) -> bool:
        """Whether merging the letters of both together leaves these two tokens.

        The merges are undone from the last on. Whenever the two tokens that
        then meet at the border could merge before the step just undone, they
        would have; of equal merges the one further left goes first.
        """
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        never = len(self.rank)
        until = never
        while True:
            if self.rank.get((left, right), never) < until:
                return False
            a, b = self.born.get(left, -1), self.born.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until, left = a, self.parts[left][1]
            else:
                until, right = b + 1, self.parts[right][0]


def trie_encodings(words: list[str], merges: Merges) -> list[list[int]]:
    """Token ids of each word (a string of the vocabulary's letters): the words' trie walked depth first, each node given the last token of its prefix."""
    child: list[dict[str, int]] = [{}]
    ends: list[int] = []
    for word in words:
        node = 0
        for symbol in [*word[:-1], word[-1] + merges.suffix] if word else []:
            nxt = child[node].get(symbol)
            if nxt is None:
                nxt = child[node][symbol] = len(child)
                child.append({})
            node = nxt
        ends.append(node)
    last, reach = [-1] * len(child), [0] * len(child)  # a node's last token, and the node before it
    ids, stay, lengths, single = merges.ids, merges.stay, merges.lengths, [1]
    path, letters = [0], ""
    todo = [(node, symbol, 1) for symbol, node in child[0].items()]
    while todo:
        node, symbol, depth = todo.pop()
        del path[depth:]
        letters = letters[: depth - 1] + symbol
        path.append(node)
        # tokens of n symbols that end here, the longest first; just one of them stays apart from the last token before it
        for n in lengths.get(letters[depth - 2 :], single) if depth > 1 else single:
            if n > depth or (token := ids.get(letters[depth - n :])) is None:
                continue
            before = path[depth - n]
            if before == 0 or (last[before] >= 0 and stay(last[before], token)):
                last[node], reach[node] = token, before
                break
        todo += [(nxt, s, depth + 1) for s, nxt in child[node].items()]
    out = []
    for node in ends:
        tokens = []
        while node:
            if last[node] < 0:
                raise ValueError("a word has letters that the vocabulary lacks")
            tokens.append(last[node])
            node = reach[node]
        out.append(tokens[::-1])
    return out


class Encoder:
    """Whole texts under one tokenizer file, with a bounded cache of words."""

    def __init__(self, content: bytes, cache_size: int):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.library = Tokenizer.from_str(content.decode("utf-8"))  # its normaliser and splitter only, for rare characters
        self.merges = Merges(spec)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0]["pattern"].get("Regex") == SPLIT and parts[1]["type"] == "ByteLevel"
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda t: [t]
        self.stable = re.compile(STABLE).fullmatch
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.tokens = {i: t for t, i in self.merges.ids.items()} | {i: t for t, i in self.added.items()}
        if spec.get("decoder") is not None:
            raise ValueError("only a vocabulary without a decoder of its own is decoded")
        self.size = cache_size
        self.words: dict[str, tuple[int, str, str]] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens, those of rare characters as the library writes them, marked."""
        if self.plain and self.stable(text):
            return (ASCII_SPLIT if text.isascii() else PLAIN_SPLIT)(text.lower())
        return [WRITTEN + piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(ADDED + part)
            elif part:
                out += self.split(part)
        return out

    def learn(self, missing: list[str]) -> None:
        """Encode words in one trie and keep them: number of tokens, ids and tokens joined."""
        ordinary = [w for w in missing if not w.startswith(ADDED)]
        written = [w[1:] if w.startswith(WRITTEN) else w.encode("utf-8").decode("latin-1").translate(self.letters) for w in ordinary]
        for word, ids in zip(ordinary, trie_encodings(written, self.merges), strict=True):
            self.words[word] = len(ids), " ".join(map(str, ids)), self.decode(ids)
        for word in missing:
            if word.startswith(ADDED):
                self.words[word] = 1, str(self.added[word[1:]]), word[1:]
        if len(self.merges.apart) > self.size:
            self.merges.apart.clear()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own a vocabulary writes its tokens apart."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def encoded(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text the number of tokens and the digests of its ids and of its decoded text."""
        out = []
        at = 0
        while at < len(texts):
            group, letters = [], 0
            while at < len(texts) and (not group or letters + len(texts[at]) <= GROUP):
                group.append(self.pieces(texts[at]))
                letters += len(texts[at])
                at += 1
            distinct = set().union(*group)
            missing = [w for w in distinct if w not in self.words]
            if missing:
                if len(self.words) + len(missing) > self.size:
                    self.words.clear()
                    missing = list(distinct)
                self.learn(missing)
            for words in group:
                found = list(map(self.words.__getitem__, words))
                ids, tokens = " ".join([f[1] for f in found]), " ".join([f[2] for f in found])
                out.append((sum([f[0] for f in found]), sha256(ids.encode()).hexdigest(), sha256(tokens.encode("utf-8")).hexdigest()))
        return out


def _worker(key: str, shared, cache_size: int) -> Encoder:
    """The worker's own encoder, kept over tasks of one query."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(shared.value, cache_size)
    return _WORKER[key]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, *, cache_size: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded text in UTF-8).

    Encoded as the library of the file does without special tokens of its own;
    strings of added tokens inside a text are those tokens. Nothing is shuffled:
    a task puts the distinct unknown words of about GROUP letters into one trie
    and keeps at most `cache_size` words; a longer text is a group of its own.
    Texts with characters whose class varies between Unicode versions are
    normalised and split by the library, their words then encoded as all others.

    Null and empty texts have 0 tokens and the digest of the empty string;
    texts are encoded whole; repeated rows and null ids are kept; an empty table
    gives no rows; other columns are ignored. A vocabulary in which one token
    comes from two merges, or with a decoder, is refused.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    Merges(json.loads(content))
    shared, key = docs.sparkSession.sparkContext.broadcast(content), uuid.uuid4().hex

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def round_trip(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_worker(key, shared, cache_size).encoded(texts.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", round_trip(text_of()).alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
