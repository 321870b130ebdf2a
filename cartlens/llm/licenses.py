"""License scan with a positional index of rare words.

Base labels come from phrases. Beyond them, every template (a license's notice, reference or identifier) is indexed by
word and position. Of the license words in a file, the ones with the highest inverse document frequency, counted over the
whole corpus, are looked up: each occurrence minus its position in the template is a place where the template may start,
and places where several rare words agree are kept. The template's mandatory key phrases propose places as well, so
nothing hangs on the number of rare words: a template counts only where its phrases stand. At every place the words
of the template are matched in order, with gaps, within ``SLACK`` words around it, so that inserted, missing or repeated words
("dnl", "rem", line numbers) do not end a match.

Words are runs of ASCII letters, digits and non-ASCII characters, in ASCII lower case. Two passes over the texts,
neither shuffles them; what is gathered, document frequencies of license words, is bounded by the templates.

Defined cases: null and empty texts have no words, no labels, score 0. Rows without id, repeated rows, empty tables and
extra columns need no special care: every row gets its own result in place. The time of a text of any kind follows its
length.
"""

from __future__ import annotations

import math
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, worker_state, wrapped

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

# Words of public license notices, and the phrases that must be in them.
TEMPLATES = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
        (
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
            "with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
            ["apache license version 2 0", "in compliance with the license"],
        ),
    ],
    "gpl-3.0": [
        ("under the gnu general public license version 3", ["gnu general public license version 3"]),
        (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your "
            "option any later version",
            ["gnu general public license", "version 3 of the license"],
        ),
    ],
    "gpl-2.0": [
        ("under the gnu general public license version 2", ["gnu general public license version 2"]),
        (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 2 of the license or at your "
            "option any later version",
            ["gnu general public license", "version 2 of the license"],
        ),
    ],
    "lgpl": [("under the terms of the gnu lesser general public license", ["gnu lesser general public license"])],
    "agpl-3.0": [("under the terms of the gnu affero general public license", ["gnu affero general public license"])],
    "cc-by-4.0": [("licensed under cc by 4 0", ["cc by 4 0"])],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa 4 0"])],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc 4 0"])],
    "mit-notice": [
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
            ["permission is hereby granted free of charge", "without restriction"],
        ),
    ],
    "mit-reference": [
        ("licensed under the mit license", ["under the mit license"]),
        ("released under the mit license", ["under the mit license"]),
    ],
    "bsd": [
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met",
            ["redistribution and use in source and binary forms"],
        ),
    ],
    "mpl-2.0": [
        (
            "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
            "not distributed with this file you can obtain one at",
            ["mozilla public license v 2 0"],
        ),
    ],
    "unlicense": [
        (
            "this is free and unencumbered software released into the public domain anyone is free to copy modify "
            "publish use compile sell or distribute this software",
            ["free and unencumbered software"],
        ),
    ],
}

# Short references, and identifiers by their words behind "SPDX-License-Identifier:".
REFERENCES = {
    "apache-2.0": ["apache license version 2 0", "apache license 2 0"],
    "gpl-3.0": ["gnu gpl v3", "gnu gpl version 3", "gnu general public license v3", "gplv3"],
    "gpl-2.0": ["gnu gpl v2", "gnu gpl version 2", "gnu general public license v2", "gplv2"],
    "lgpl": ["gnu lesser general public license", "gnu lgpl"],
    "agpl-3.0": ["gnu affero general public license", "gnu agpl"],
    "bsd": ["bsd 3 clause", "bsd 2 clause", "3 clause bsd license", "2 clause bsd license"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
}
IDENTIFIERS = {
    "apache-2.0": ["apache 2 0"], "gpl-3.0": ["gpl 3 0"], "gpl-2.0": ["gpl 2 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl-3.0": ["agpl 3 0"],
    "cc-by-4.0": ["cc by 4 0"], "cc-by-sa-4.0": ["cc by sa 4 0"], "cc-by-nc-4.0": ["cc by nc 4 0"], "mit-reference": ["mit"],
    "bsd": ["bsd 2 clause", "bsd 3 clause"], "mpl-2.0": ["mpl 2 0"], "unlicense": ["unlicense"],
}

# Rare words of a template that are looked up in a file, and how many of them must agree about the place.
RARE_WORDS = 6
MIN_AGREEING = 2
MIN_SCORE = 0.75
# Words before and behind the expected ones among which those of the template are looked for.
SLACK = 8


def forms() -> list[tuple[str, str, list[str]]]:
    """(label, words, key phrases) of all notices, references and identifiers."""
    out = [(label, text, phrases) for label, found in TEMPLATES.items() for text, phrases in found]
    out += [(label, text, [text]) for label, texts in REFERENCES.items() for text in texts]
    for label, names in IDENTIFIERS.items():
        out += [(label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for name in names]
    return out


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _starts(text: list[bytes], phrase: list[bytes], at: list[int]) -> list[int]:
    """Of the places ``at`` of the phrase's first word, those where the phrase stands."""
    n = len(phrase)
    return [i for i in at if text[i : i + n] == phrase]


def _stands(phrase: list[bytes], there: list[bytes]) -> bool:
    return any(there[i : i + len(phrase)] == phrase for i in range(len(there) - len(phrase) + 1))


def common(where: dict[bytes, list[int]], there: list[bytes]) -> int:
    """The length of the longest common subsequence of a template, as places by word, and ``there``.

    One bit per place of the template, cleared where the subsequence grows.
    """
    size = 1 + max((q for places in where.values() for q in places), default=-1)
    full = (1 << size) - 1
    open_ = full
    for w in there:
        if w in where:
            hit = open_ & sum(1 << q for q in where[w])
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return size - open_.bit_count()


class Index:
    """The templates by word and position, with the weights of their words."""

    def __init__(self, frequency: dict[str, int], n_docs: int):
        self.base = {label: phrase.encode().split() for label, phrase in BASE.items()}
        self.templates = [
            (label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in forms()
        ]
        self.vocabulary = {w for _, ws, _ in self.templates for w in ws}.union(*self.base.values())
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w.decode(), 0))) for w in self.vocabulary}
        self.postings = []
        for _, ws, _ in self.templates:
            where: dict[bytes, list[int]] = {}
            for q, w in enumerate(ws):
                where.setdefault(w, []).append(q)
            self.postings.append(where)

    def places(self, form, phrases, where, present, at, ws) -> list[int]:
        """Where the template may start: the rare words agree about it, or a key phrase stands in its place."""
        rare = sorted(present.intersection(where), key=lambda w: (-self.idf[w], w))[:RARE_WORDS]
        agreeing: dict[int, int] = {}
        for w in rare:
            for start in {p - q for p in at(w) for q in where[w]}:
                agreeing[start] = agreeing.get(start, 0) + 1
        need = min(MIN_AGREEING, len(rare))
        found = {s for s, n in agreeing.items() if n >= need}
        for phrase in phrases:
            shifts = [q for q in where[phrase[0]] if form[q : q + len(phrase)] == phrase]
            found.update(p - q for p in _starts(ws, phrase, at(phrase[0])) for q in shifts)
        return sorted(found)

    def scan(self, text: str | None):
        """(words, base places, first, last, base labels, labels, score) of a text."""
        ws = words(text)
        present = self.vocabulary.intersection(ws)
        places: dict[bytes, list[int]] = {}

        def at(word: bytes) -> list[int]:
            # One sweep for all license words of the text, and only if some phrase may be there.
            if not places:
                for i, w in enumerate(ws):
                    if w in present:
                        places.setdefault(w, []).append(i)
            return places[word]

        starts, labels = [], set()
        for label, phrase in self.base.items():
            if present.issuperset(phrase):
                found = _starts(ws, phrase, at(phrase[0]))
                if found:
                    labels.add(label)
                    starts += found
        base_labels, score = sorted(labels), 0.0
        for (label, form, phrases), where in zip(self.templates, self.postings):
            if not all(present.issuperset(p) for p in phrases):
                continue
            for start in self.places(form, phrases, where, present, at, ws):
                there = ws[max(start - SLACK, 0) : max(start + len(form) + SLACK, 0)]
                share = common(where, there) / len(form)
                if share >= MIN_SCORE and all(_stands(p, there) for p in phrases):
                    labels.add(label)
                    score = max(score, share)
                    if score == 1.0:
                        break  # neither the label nor the score can change
        return len(ws), len(starts), min(starts, default=None), max(starts, default=None), base_labels, sorted(labels), score


def word_frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each license word occurs, and the number of documents. Bounded by the templates."""
    vocabulary = Index({}, 0).vocabulary

    @F.pandas_udf("array<string>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([[w.decode() for w in vocabulary.intersection(words(t))] for t in texts], dtype=object)

    # A marker word per document counts the documents in the same pass.
    found = docs.select(F.explode(F.concat(present(F.col(text).cast("string")), F.array(F.lit("")))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts, counts.pop("", 0)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, beside the findings of every text in ``found``."""
    shared = docs.sparkSession.sparkContext.broadcast(word_frequencies(docs, text))
    key = uuid.uuid4().hex
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf(
        "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, score double"
    )
    def scan(texts: pd.Series) -> pd.DataFrame:
        one = worker_state("licenses", key, lambda: Index(*shared.value)).scan
        out = pd.DataFrame([one(t) for t in texts], columns=columns)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return wrapped(docs, _text=text).select("row", scan(F.col("_text").cast("string")).alias("found"))


def license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: places and labels of license mentions in every document."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word",
        F.array_join("found.base_labels", ",").alias("base_labels"), F.array_join("found.labels", ",").alias("labels"),
        "found.score",
    )
