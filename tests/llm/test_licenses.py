"""The license scan against brute force over all places, odd headers, and long texts."""

import random
import time

import pytest

from cartlens.llm import licenses

WORDS = [f for _, f, _ in licenses.forms()]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def brute(index, text):
    """Labels and score by looking at every place of the text."""
    ws = licenses.words(text)
    labels, score = {b for b, p in index.base.items() if any(ws[i : i + len(p)] == p for i in range(len(ws)))}, 0.0
    for label, form, phrases in index.templates:
        rare = sorted(set(form) & set(ws), key=lambda w: (-index.idf[w], w))[: licenses.RARE_WORDS]
        for start in range(-len(form), len(ws)):
            here = lambda q: ws[start + q] if 0 <= start + q < len(ws) else None  # noqa: B023, E731
            agree = sum(any(form[q] == w == here(q) for q in range(len(form))) for w in rare)
            phrased = any(
                form[q : q + len(p)] == p and start + q >= 0 and ws[start + q : start + q + len(p)] == p for p in phrases for q in range(len(form))
            )
            if (rare and agree >= min(licenses.MIN_AGREEING, len(rare))) or phrased:
                there = ws[max(0, start - licenses.SLACK) : max(0, start + len(form) + licenses.SLACK)]
                share = subsequence(form, there) / len(form)
                whole = all(any(there[i : i + len(p)] == p for i in range(len(there))) for p in phrases)
                if share >= licenses.MIN_SCORE and whole:
                    labels.add(label)
                    score = max(score, share)
    return sorted(labels), score


def test_scan_equals_brute_force():
    draw = random.Random(2)
    index = licenses.Index({"license": 50, "the": 400, "apache": 3, "gnu": 2, "version": 40}, 500)
    for _ in range(60):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            form = draw.choice(WORDS).split()
            for _ in range(draw.randrange(5)):
                at = draw.randrange(len(form))
                form[at : at + draw.randrange(2)] = draw.choices(["dnl", "the", "license", "x"], k=draw.randrange(3))
                form = form or ["x"]
            parts += draw.choices(["noise", "the", "of", "software"], k=draw.randrange(6)) + form
        text = " ".join(parts)
        found = index.scan(text)
        assert (found[5], found[6]) == brute(index, text), text


@pytest.mark.parametrize(("text", "label"), [
    ("Apache License, Version 2.0", "apache-2.0"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("GNU GPL v3", "gpl-3.0"),
    ("the BSD 3-clause license", "bsd"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"), ("SPDX-License-Identifier: MIT", "mit-reference"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation; version 2 of the License.", "gpl-2.0"),
    ("\n".join("dnl " + " ".join(WORDS[3].split()[i : i + 6]) for i in range(0, 60, 6)), "gpl-3.0"),
    ("\n".join(f"{i} " + " ".join(WORDS[1].split()[i : i + 9]) for i in range(0, 60, 9)), "apache-2.0"),
])
def test_headers_and_identifiers(text, label):
    assert label in licenses.Index({}, 10).scan(text)[5]


def test_what_is_no_license():
    index = licenses.Index({}, 10)
    for text in ("permission of the public is general", "mit students", "version 2 0 of the software", "apache helicopters and a license", "the"):
        assert index.scan(text)[5] == []


@pytest.mark.parametrize("unit", ["apache license version 2 0 ", "gnu general public license ", "version 3 of the license ", "the software ", "cc by ", "x" * 50, "spdx license identifier "])
def test_a_million_characters(unit):
    start = time.process_time()
    licenses.Index({}, 10).scan(unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 20
