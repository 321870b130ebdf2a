"""Row-wise operators against plain brute force, the tokenizers library, and cases with a known answer."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartlens.llm import bpe, decontaminate, html_text, languages, licenses, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def same(found, expected):
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


# Quality rules


def repeated_words(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return len(inside)


def test_ledger_equals_brute_force(corpus):
    expected = []
    for doc_id, text in rows_of(corpus):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected.append((
            doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), repeated_words(words),
        ))
    found = quality_rules.ledger(corpus).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    )
    same(found.collect(), expected)


def test_overlapping_windows_cover_each_word_once(docs):
    text = " ".join(["a"] * 12 + [f"w{i}" for i in range(30)])
    got = quality_rules.ledger(docs([(1, text)])).collect()[0]
    assert got["n_repeat_words"] == repeated_words(text.split()) == 12
    assert got["row"]["words"] == "z"


def test_policies_and_ablations(corpus):
    entries = quality_rules.ledger(corpus).select("fail_bits").persist()
    bits = [r["fail_bits"] for r in entries.collect()]
    for r in quality_rules.ablations(entries).collect():
        mask = quality_rules.mask_of(quality_rules.POLICIES[r["policy"]])
        bit = quality_rules.mask_of([r["rule"]])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert r["n_kept"] == sum(b & mask == 0 for b in bits)
        assert r["n_kept_without"] == sum(b & mask & ~bit == 0 for b in bits)


# Greedy string tiling


def brute_tiles(doc, item, least):
    """The textbook loop: take the longest free match, mark it, begin again."""
    doc_marked, item_marked, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                    and not doc_marked[i + n] and not item_marked[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        doc_marked[i : i + n] = item_marked[j : j + n] = [True] * n
        tiles.append((i, j, n))


def test_tiles_equal_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        item = [draw.randrange(4) for _ in range(draw.randrange(1, 18))]
        doc = [draw.randrange(-1, 4) for _ in range(draw.randrange(1, 30))]
        assert decontaminate.greedy_tiles(doc, item, 3) == brute_tiles(doc, item, 3)


def test_reordered_passages_leak(spark, docs):
    words = [f"word{i}" for i in range(40)]
    items = spark.createDataFrame(
        [(1, " ".join(words)), (2, "Short one"), (3, None), (4, ""), (5, " ".join(words))], "item_id long, text string"
    )
    moved = " ".join([*words[20:], "x", *words[:20]])
    rows = [
        (1, f"a b {moved.upper()}, c"), (2, " ".join(words[:20])), (3, None), (4, ""), (None, "a SHORT one."), (1, "clean")
    ]
    for block_words in (10, 1000):
        found = decontaminate.with_leaks(docs(rows), items, block_words=block_words)
        got = [(r["row"]["doc_id"], sorted(x["item_id"] for x in r["leaks"])) for r in found.collect()]
        same([(a, tuple(b)) for a, b in got], [(1, (1, 5)), (2, ()), (3, ()), (4, ()), (None, (2,)), (1, ())])


def test_no_items_no_leaks(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r["leaks"] for r in decontaminate.with_leaks(docs([(1, "a b")]), items).collect()] == [[]]


# HTML


def test_article_without_the_rest():
    page = (
        "<html><body><header>H</header><nav><a href=x>N</a></nav><div id='main'><p>One <b>two</b><p class=ad>buy"
        "<p>Three&nbsp;&amp; &lt;x&gt;<br>four</p><ul><li>a<li>b</ul><form>f</form><div class='comments'><p>c</div></div>"
        "<aside>s</aside><script>var p='</p>'</script><footer>F</footer>"
    )
    assert html_text.extract(page, None) == "One two\nThree & <x> four\na\nb"
    assert [html_text.extract(x, None) for x in (None, "", "plain <!-- no --> text")] == ["", "", "plain text"]


def test_hosts_agree_on_a_path(spark):
    def page(long, body):
        return f"<body><div class='story{long}'><p>{body}</p></div><div class='side1'><p>{'s ' * 30}</p></div></body>"

    pages = [(i, "http://a.org/x", page(i, f"text {i} " * 40)) for i in range(3)]
    # By itself this page would choose the longer side text.
    pages += [(3, "http://a.org/y", page(7, "short")), (4, None, "<p>alone</p>"), (5, "http://b.org", None)]
    found = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["row"]["page_id"]: r["main_text"] for r in found.collect()}
    assert got[3] == "short" and got[4] == "alone" and got[5] == ""
    assert got[1] == " ".join(["text 1"] * 40)


def test_whole_articles_of_mixed_hosts(spark):
    def nested(n):
        return (
            f"<body><article><h1>Title {n}</h1><p>Lead {n}</p><div class='body'><p>{f'story {n} ' * 60}</p></div>"
            f"<section class='more'><p>More {n}</p></section></article><div class='side'><p>{'s ' * 30}</p></div></body>"
        )

    # Another template, with a little text at the path of the first one.
    other = f"<body><article><div class='body'><p>note</p></div></article><div class='post'><p>{'long text ' * 50}</p></div></body>"
    plain = f"<body><div class='page'><h1>Head</h1><div class='text'><p>{'words ' * 60}</p></div></div></body>"
    pages = [(n, "http://a.org/x", nested(n)) for n in range(3)] + [(3, "http://a.org/y", other)]
    pages += [(4, None, plain), (5, None, nested(5)), (6, "no url", f"<div class='b'><p>{'other ' * 90}</p></div>")]
    found = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["row"]["page_id"]: r["main_text"] for r in found.collect()}
    for n in (0, 1, 2, 5):
        assert got[n] == f"Title {n}\nLead {n}\n{' '.join([f'story {n}'] * 60)}\nMore {n}"
    assert got[3] == " ".join(["long text"] * 50)
    assert got[4] == "Head\n" + " ".join(["words"] * 60) and got[6] == " ".join(["other"] * 90)


@pytest.mark.parametrize("attributes", [
    "class='content has-sidebar'", "class='main with-comments'", "class='article-share-wrapper'", "class='sidebar'",
    "role='dialog'", "aria-hidden='true'",
])
def test_what_holds_the_text_is_not_cut(attributes):
    page = f"<body><div {attributes}><h1>T</h1><p>{'text ' * 50}</p><div class='comment-list'><p>c</p></div></div><p>end</p></body>"
    assert html_text.extract(page, None) == "T\n" + " ".join(["text"] * 50)
    # A longer side bar stays out where there is a heading elsewhere.
    assert html_text.extract(f"<h1>T</h1><p>text</p><div {attributes.replace('content has-', '')}></div><div id='comments'>{'c ' * 99}</div>", None) == "T\ntext"


# Tokenizers


ODD = [
    "", "a", "<|endoftext|>", "x<|startoftext|> y<|endoftext|>!", "it's they'LL don't 'S", "  a  b\n\n c\t\t",
    "12345 ½ ²", "日本語 テキスト 🎉🎉", "a" * 3000, "<|endoftext", "नमस्ते क्षि", chr(0x3A3) * 2, " \x1c\x85\xa0z\x00y", "\n x \n",
    "é é Å", "a\r\nb \n c",
]


@pytest.mark.parametrize("path", [bpe.WORD_FILE])
def test_bpe_equals_the_library(corpus, path):
    library, own = Tokenizer.from_file(path), bpe.WordTokenizer(bpe.read_spec(path), cache=50)
    for _, text in [(None, t) for t in ODD] + rows_of(corpus):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw, decoded = own.encode_decode(text)
        assert raw == b"".join(n.to_bytes(4, "little") for n in ids)
        assert decoded == own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_digests(corpus, docs):
    library = Tokenizer.from_file(bpe.WORD_FILE)
    for df in (corpus, docs([(1, "a b"), (None, None), (2, "")])):
        expected = []
        for doc_id, text in rows_of(df):
            ids = library.encode(text or "", add_special_tokens=False).ids
            raw = b"".join(n.to_bytes(4, "little") for n in ids)
            decoded = library.decode(ids, skip_special_tokens=False).encode()
            expected.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        same(bpe._digests(bpe.encoded(df)).collect(), expected)


def test_token_counts_equal_the_library(corpus):
    library = Tokenizer.from_file(token_counts.BYTE_FILE)
    expected = [
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows_of(corpus)
    ]
    found = token_counts.counted(corpus).select("row.doc_id", "n_bytes", "n_tokens")
    same(found.collect(), expected)


def test_odd_texts_count_like_the_library(docs):
    library = Tokenizer.from_file(token_counts.BYTE_FILE)
    found = token_counts.counted(docs(list(enumerate(ODD))))
    for r in found.collect():
        assert r["n_tokens"] == len(library.encode(ODD[r["row"]["doc_id"]], add_special_tokens=False).ids)


# Licenses


def test_license_places_and_labels(docs):
    texts = [
        "x Licensed under the Apache License, Version 2.0. y MIT license cc by CC-BY", None, "", "apache mit gnu license",
        "This program: GNU General Public License, version 3. and gnu general public license", "MIT License " * 3,
    ]
    got = {r["row"]["doc_id"]: r["found"] for r in licenses.scanned(docs(list(enumerate(texts)))).collect()}
    for n, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        starts, labels = [], set()
        for label, phrase in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        found = got[n]
        assert (found["n_words"], found["n_base"]) == (len(words), len(starts))
        assert (found["first_word"], found["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert found["base_labels"] == sorted(labels) and labels <= set(found["labels"])
        assert 0 <= found["score"] <= 1
    assert "apache-2.0" in got[0]["labels"] and "gpl-3.0" not in got[3]["labels"]


# Languages


def test_languages_of_held_out_rows(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = languages.fitted(given.where(~held))
    found = languages.identified(given.where(held), model).collect()
    right = [r["lang_pred"] == r["row"]["lang"] for r in found]
    sure = [ok for ok, r in zip(right, found) if r["accepted"]]
    assert sum(right) / len(right) > 0.95
    assert len(sure) > 0.5 * len(right) and sum(sure) / len(sure) > 0.98


def test_languages_of_odd_texts(docs):
    model = languages.train([(["the", "and", "of"], "en"), (["der", "und", "die"], "de")] * 20, [])
    found = languages.identified(docs([(1, None), (2, ""), (3, "12 ² !"), (4, "und der"), (4, "und der")]), model)
    got = Counter((r["row"]["doc_id"], r["lang_pred"]) for r in found.collect())
    assert got == {(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "de"): 2}


def test_rare_languages_and_sources_are_learned_at_every_size(spark):
    # 30,000 rows of one language, nearly all of one source, beside 30 rows of another and one row of a third.
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the house of "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 1000 == 0, "small").otherwise("hot").alias("source"),
    )
    rare = [(100_000 + n, f"das haus und der hund {n}", "de", "x") for n in range(30)] + [(200_000, "casa y perro", "es", "y")]
    rows = rows.unionByName(spark.createDataFrame(rare, "doc_id long, text string, lang string, source string"))
    assert languages.fitted(rows).languages == ["de", "en", "es"]
    labelled = languages._labelled(rows.where("lang <> 'es'"), F.lit(False))
    drawn = languages.by_language(labelled, 100, 1).collect()
    found = Counter(r["lang"] for r in drawn)
    assert found["de"] == 30 and found["en"] == 70
    assert Counter(r["source"] for r in drawn)["small"] >= 25
    assert [r["doc_id"] for r in languages.uniform(labelled, 50, 2).collect()] == [
        r["doc_id"] for r in languages.uniform(labelled.repartition(7), 50, 2).collect()
    ]


def test_long_texts_and_forgotten_words():
    """Whole texts count: the language of the tail decides, and a full table of words changes nothing."""
    model = languages.train([(["the", "and", "of"], "en"), (["der", "und", "die"], "de")] * 20, [])
    text = "the and " * 3 + "der und " * 100_000
    full, small = languages.Scorer(model), languages.Scorer(model, languages.PIECE_WORDS)
    assert full.predict(text)[0] == "de"
    texts = [text, *(f"the{n} und{n * 7} of{n * 3}" * (n % 3000) for n in range(0, 9000, 450))]
    assert [full.predict(t) for t in texts] == [small.predict(t) for t in texts]
    assert languages.Scorer(model).predict("x" * 1_000_000)[1] <= 1


def test_memory_does_not_grow_with_the_languages():
    rows = [([f"w{n}", f"v{n}"], f"l{n:03}") for n in range(300)]
    assert languages.Scorer(languages.train(rows, [], epochs=1)).places.values.shape[1] == languages.DIMENSIONS + 1
    assert languages.quota([5, 1000, 1000], 105) == 50 and languages.quota([1000] * 50, 100) == languages.LANGUAGE_ROWS


def test_nothing_to_learn_from(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    found = languages.identified(docs([(1, "a")]), languages.fitted(empty)).collect()
    assert [(r["lang_pred"], r["lang_score"]) for r in found] == [("und", 0.0)]


# Empty tables


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.ledger(none).count() == 0
    assert bpe.encoded(none).count() == token_counts.counted(none).count() == 0
    assert licenses.scanned(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_texts(pages).count() == 0
