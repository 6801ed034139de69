import math
import random
import re

from strandloom.llm.license_scan import BASE, SHARE, TEMPLATES, scan_licences

TEXTS = [
    "Released CC BY today. cc   by! CC-BY-NC 4.0", "All Rights Reserved", "This work is licensed under the GNU General Public License, version 3.", "nothing to see", "", None, "cc", "by cc by cc by",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "ALL\nRIGHTS\tRESERVED all rights reserved", "ÀLL RIGHTS RESERVED", "all rights éreserved", "word " * 20_000 + "all rights reserved " + "x " * 20_000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "apache license version", "the rights reserved all general license public",
]


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_and_templates(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "cc by", "x"), (0, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = scan_licences(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert r["labels"].split(",") == sorted(set(r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert "apache-2.0" in by[8]["labels"] and "cc-by-nc-4.0" in by[9]["labels"] and "gpl-3.0" in by[2]["labels"] and "mit" in by[14]["labels"]
    assert by[15]["labels"] == by[16]["labels"] == by[3]["labels"] == "" and by[3]["score"] == 0


def test_empty_table(spark):
    assert scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_scan(texts, templates=TEMPLATES, share=SHARE):
    """(labels, score) of every text, each template laid at every start of each text."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    idf = lambda w: math.log((1 + len(texts)) / (1 + sum(w in ws for ws in split))) + 0.01
    idf = {w: idf(w) for t in templates for w in t[1].split()}
    out = []
    for text, words in zip(texts, split, strict=True):
        base = set(filter(None, base_of(text)[4].split(",")))
        found = {}
        for label, template, key in templates:
            t, k = template.split(), key.split()
            for start in range(1 - len(t), len(words)):
                got = sum(idf[x] for j, x in enumerate(t) if 0 <= start + j < len(words) and words[start + j] == x)
                inside = any(words[i : i + len(k)] == k for i in range(max(0, start), start + len(t) - len(k) + 1))
                if inside and got >= share * sum(idf[x] for x in t):
                    found[label] = max(found.get(label, 0), got / sum(idf[x] for x in t))
        out.append((",".join(sorted(base | set(found))), 1.0 if base else round(max(found.values(), default=0.0), 6)))
    return out


def test_placements_by_brute_force(spark):
    """Damaged templates between other words, their ends cut, one beside another: the index loses no placement, however many words must agree."""
    draw = random.Random(10)
    filler = "the of and a licence software use any text copy under license words".split()
    texts = [None, ""]
    for i in range(300):
        words = []
        for _ in range(draw.randrange(1, 4)):
            words += draw.choices(filler, k=draw.randrange(6))
            t = TEMPLATES[draw.randrange(len(TEMPLATES))][1].split()
            cut = draw.choice([0, 0, 1, 2])
            words += [draw.choice(filler) if draw.random() < 0.1 * (i % 5) else w for w in t[cut : len(t) - draw.choice([0, 0, 1])]]
        texts.append(" ".join(words))
    want = plain_scan(texts)
    assert 0 < sum(labels == "" for labels, _ in want) < 250 and any("," in labels for labels, _ in want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for agree in (1, 2, 4):
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licences(docs, agree=agree).collect()}
        for i, (labels, score) in enumerate(want):
            assert got[i][0] == labels and abs(got[i][1] - score) < 2e-6, (agree, texts[i])
