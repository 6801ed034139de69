"""Licence scan by a positional rare-token index.

Templates, and the base phrases as templates that are key phrase alone, are
stored as postings word -> (template, position), of the highest-IDF words of
each template only: as many as every placement of enough weight has to meet. A
file looks up the licence words it holds, rarest first; each posting proposes
where a template would start, the proposals of all words are intersected by
relative position, and a placement counts once its words weigh enough and its
mandatory key phrase stands there word for word.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table, text_of

#: How many of a template's rare words have to agree on a placement (speed only), and the share of its weight that a placement needs.
AGREE, SHARE = 2, 0.7
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases every scan reports, wherever they stand.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, words of a notice or of a sentence of a licence's text, mandatory key phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "on an as is basis without warranties or conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "publish distribute sublicense and or sell copies"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "in all copies or substantial portions"),
    ("mit", "released under the mit license", "the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "must reproduce the above copyright notice"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "may be used to endorse or promote products"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("gpl", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def _split(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower leaves non-ASCII bytes alone."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower())


def rare_places(weight: list[float], words: list[bytes], share: float, agree: int) -> tuple[list[int], int]:
    """The places of a template's rarest words, and how many of them any placement worth `share` of its weight meets.

    The rarest words are taken until the others, with the agree - 1 heaviest of
    those taken, weigh less than the share: then no such placement can meet
    fewer than `agree` of them. Where one word weighs too much for that, fewer
    have to agree.
    """
    order = sorted(range(len(weight)), key=lambda i: (-weight[i], words[i], i))
    need = share * sum(weight) * (1 - 1e-9)  # sums in another order differ by less
    for votes in range(min(agree, len(order)), 0, -1):
        spare = sum(weight[i] for i in order[: votes - 1])
        for k in range(votes, len(order) + 1):
            if spare + sum(weight[i] for i in order[k:]) < need:
                return order[:k], votes
    return order, 1


class LicenceIndex:
    """Postings of the rare words of templates and base phrases; the latter are templates of which every word is key."""

    def __init__(self, templates, base, idf: dict[bytes, float], agree: int, share: float):
        self.share, self.templates = share, []
        postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, words, key, is_base in [*((label, p, p, True) for p, label in base), *((*t, False) for t in templates)]:
            w, k = words.encode().split(), key.encode().split()
            weight = [idf.get(x, 1.0) for x in w]
            places, votes = rare_places(weight, w, 1.0 if is_base else share, 1 if is_base else agree)
            for at in places:
                postings[w[at]].append((len(self.templates), at))
            self.templates.append((label, w, weight, sum(weight), k, is_base, votes))
        # the rarest words first
        self.postings = dict(sorted(postings.items(), key=lambda x: (-idf.get(x[0], 1.0), x[0])))
        self.keys = [frozenset(t[4]) for t in self.templates]
        self.words = frozenset(self.postings).union(*self.keys)

    def placements(self, asked: set[int], at: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(template, start) on which as many of the file's licence words agree as a placement needs, of the templates asked for."""
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for x, listed in self.postings.items():
            for n, t in listed if x in at else ():
                if n in asked:
                    for i in at[x]:
                        votes[n, i - t] += 1
        return sorted(p for p, v in votes.items() if v >= self.templates[p[0]][6])

    def scan(self, text: str) -> tuple:
        words = _split(text)
        held = self.words.intersection(words)
        asked = {n for n, key in enumerate(self.keys) if key <= held} if held else set()
        if not asked:
            return len(words), 0, None, None, "", "", 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in held:
                at[w].append(i)
        places, labels, found = [], set(), {}
        for n, start in self.placements(asked, at):
            label, template, weight, total, key, is_base, _ = self.templates[n]
            lo, hi = max(0, start), start + len(template)
            if is_base:
                if start >= 0 and words[start:hi] == key:
                    places.append(start)
                    labels.add(label)
                continue
            got = sum(x for j, x in enumerate(weight) if 0 <= start + j < len(words) and words[start + j] == template[j])
            if got >= self.share * total and any(words[i : i + len(key)] == key for i in range(lo, hi - len(key) + 1)):
                found[label] = max(found.get(label, 0.0), got / total)
        score = 1.0 if labels else round(max(found.values(), default=0.0), 6)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), score


def licence_idf(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """Inverse document frequency of the licence words over all documents (one row per word and task is shuffled)."""

    def partial(batches):
        total, held = 0, defaultdict(int)
        for pdf in batches:
            for text in pdf["text"]:
                total += 1
                for w in vocabulary.intersection(_split(text)):
                    held[w] += 1
        yield pd.DataFrame({"word": ["", *(w.decode() for w in held)], "n": [total, *held.values()]})

    rows = docs.select(text_of().alias("text")).mapInPandas(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    total = df.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) + 0.01 for w in vocabulary}


def scan_licences(docs: DataFrame, templates=TEMPLATES, base=BASE, *, agree: int = AGREE, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A placement of a template holds if words worth `share` of the template's IDF
    stand at their relative positions and the key phrase stands whole inside; a
    base phrase has to stand there whole. Placements come from the index, which
    misses none of them (see rare_places); `agree` changes speed only. score is 1 for a
    base phrase, else the best share of a template found, else 0. IDF comes
    from all documents. Null texts read as empty (no words, empty labels, null
    places, score 0); texts of any length are read whole; words of equal IDF go
    by their bytes; repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    vocabulary = frozenset(w for words in [*(t[1] for t in templates), *(p for p, _ in base)] for w in words.encode().split())
    idf = licence_idf(docs, vocabulary)

    state: list[LicenceIndex] = []

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not state:
            state.append(LicenceIndex(templates, base, idf, agree, share))
        found = pd.DataFrame([state[0].scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", text_of().alias("text")).select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
