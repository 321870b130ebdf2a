"""Surrogates: names in all their forms, numbers that only look like cards, and texts made to hurt a pattern."""

import re
import time

import corpus_pipeline
from cartlens.llm import pii


def replaced(docs, told):
    return {r["row"]["doc_id"]: r["new_text"] for r in pii.pseudonymised(docs(list(enumerate(told)))).collect()}


def test_short_forms_and_untitled_repeats_are_one_person(docs):
    got = replaced(docs, [
        "Mr John Smith met Mr Smith and John Smith. Smith's house, Smithson, Mary Smith",
        "Dr. Smith wrote to Prof. Peter Miller; Miller agreed.", "John Smith has no title here.", "Mrs O'Neil-Jones and O'Neil-Jones",
    ])
    first, last = re.match(r"Mr (\w+) (\w+) met", got[0]).groups()
    assert got[0] == f"Mr {first} {last} met Mr {last} and {first} {last}. {last}'s house, Smithson, Mary {last}"
    assert first in pii.GIVEN["latin"]["m"] and last not in ("Smith", "John")
    given, family = re.match(rf"Dr\. {last} wrote to Prof\. (\w+) (\w+); ", got[1]).groups()
    assert got[1].endswith(f"; {family} agreed.") and len({first, last, given, family}) == 4
    assert got[2] == "John Smith has no title here."
    assert re.fullmatch(r"Mrs (\w+) and \1", got[3])


def test_distinct_people_stay_distinct(docs):
    names = [f"Mr {a}{b}a {c}{d}mann" for a in "BDFGKL" for b in "aeiou" for c in "HMNRST" for d in "aeiou"]
    got = replaced(docs, names)
    assert len(set(got.values())) == len(names)
    words = {w for t in got.values() for w in t.split()[1:]}
    assert len({t.split()[1] for t in got.values()}) == 30 and len({t.split()[2] for t in got.values()}) == 30
    assert not words & {w for n in names for w in n.split()[1:]}


def test_cards_have_a_valid_check_digit(docs):
    told = ["id 123456789012345 and 9807915762804490", "4845168114407329, 4845-1681-1440-7329"]
    got = replaced(docs, told)
    assert got[0] == told[0]
    cards = re.fullmatch(r"(\d{16}), (\d{4}-\d{4}-\d{4}-\d{4})", got[1]).groups()
    assert cards[0] == cards[1].replace("-", "") != "4845168114407329"


MILLION = 1_000_000
HARD = {
    "dots behind a sign": "mail a@" + "b." * (MILLION // 2) + "org", "hosts": "a@b.b.b " * (MILLION // 8), "times": "1:1:1 " * (MILLION // 6),
    "digits": "7" * MILLION, "spaced digits": "1 " * (MILLION // 2), "dots": "." * MILLION, "local part": "a" * MILLION + " x@y.org",
    "unspaced": "用" * (MILLION // 3) + "@", "capitals": "A" * MILLION, "titles": "Mr Aa " * (MILLION // 6), "signs": "@" * MILLION,
    "hexadecimal": "f:" * (MILLION // 2), "iban": "DE12 " + "3456 " * (MILLION // 5), "plus": "+1" * (MILLION // 2),
    "apostrophes": "Mr " + "A'b" * (MILLION // 3), "keys": "sk-" * (MILLION // 3), "words": "password " * (MILLION // 9),
}


def test_long_texts_of_any_shape(docs):
    """A million characters each, and a secret of that length: linear time, no stack."""
    secret = "password: " + "aB1-" * (MILLION // 4)
    start = time.time()
    got = replaced(docs, [*HARD.values(), secret, "call +1 203 555 8282"])
    assert time.time() - start < 120
    assert len(got) == len(HARD) + 2 and got[len(HARD) + 1] != "call +1 203 555 8282"
    assert all(got[n] == HARD[kind] for n, kind in enumerate(HARD) if kind in ("dots behind a sign", "times", "digits", "dots", "signs"))
    shaped = got[len(HARD)]
    assert len(shaped) == len(secret) and re.match(r"password: (?:[a-z][A-Z]\d-)+$", shaped) and "aB1-aB1-" not in shaped


def test_pipeline_stage_with_odd_rows(spark):
    rows = [(None, None, "x", None), (1, "", "a", 0), (2, "mail a@" + "b." * 20_000 + "org", "a", 5), (3, "call +1 203 555 8282", "a", 1),
            (3, "call +1 203 555 8282", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string, n_chars long").selectExpr("*", "1 AS _key", "2 AS names")
    got = pii.without_pii(spark, docs, "")
    assert got.columns == docs.columns
    found = {(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()}
    assert {(None, None, None), (1, "", 0), (2, rows[2][1], len(rows[2][1]))} < found and len(found) == 4 == len(got.distinct().collect())
    assert pii.without_pii(spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.STAGES[3][1] is pii.without_pii
