"""Packing: every token once, no gaps, no padding; levels by a plain search; ids as the tokenizers library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cartlens.llm import packing

LIBRARY = Tokenizer.from_file(packing.TOKENIZER_FILE)


def expected_ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check_sequences(pieces, size):
    """``pieces``: (sequence, offset, length). Gapless from 0, full or a power of two."""
    sequences = defaultdict(list)
    for sequence, offset, length in pieces:
        assert length > 0
        sequences[sequence].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)


def check_query(spark, df, rows, parts=3):
    got = packing.packed(df.repartition(parts) if parts else df).collect()
    check_sequences([(r["sequence_id"], r["offset"], len(r["ids"]) // 4) for r in got], packing.SEQUENCE)
    # Rows may share an id: together their tokens are those of all of them, cut at the starts.
    found, expected = defaultdict(list), defaultdict(list)
    for r in got:
        found[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for doc_id, text in rows:
        ids = expected_ids(text)
        expected[doc_id, len(ids)].append(ids.tobytes())
    assert found.keys() == expected.keys()
    for key, pieces in found.items():
        texts = expected[key]
        if len(texts) == 1:
            assert b"".join(ids for _, ids in sorted(pieces)) == texts[0]
            assert [s for s, _ in sorted(pieces)] == list(np.cumsum([0] + [len(i) // 4 for _, i in sorted(pieces)][:-1]))
        else:
            assert sum(len(i) for _, i in pieces) == sum(map(len, texts))


def test_given_and_odd_documents(spark, corpus):
    odd = spark.createDataFrame(
        [(9100, "a<|endoftext|>b"), (9101, " " * 5000 + "x"), (9102, "\n" * 1200), (9103, "é 一二 \U0001f600" * 900)], "doc_id long, text string")
    both = corpus.unionByName(odd)
    check_query(spark, both, [(r["doc_id"], r["text"]) for r in both.collect()])


def test_extra_columns_and_empty_tables(spark, docs):
    rows = [(1, "a b"), (2, None), (None, "c")]
    check_query(spark, docs(rows), rows)
    assert packing.packed(docs([])).collect() == []


def test_query_derives_lengths_and_checksums(spark):
    got = packing.packed_documents(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        ids = expected_ids(texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def sum_of_squares(counts, size):
    return sum(n * n for level, n in counts.items() if 0 < level < size)


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_a_plain_search(seed):
    size, random_ = 16, random.Random(seed)
    packer, counts, out, total = packing.Packer(0, size, 10_000), defaultdict(int), [], 0
    for row in range(400):
        length = random_.choice([1, 2, 3, 5, 7, 9, 11, 15]) if seed else random_.choice([5, 7])
        total += length
        costs = []
        for level in range(size):
            if level + length <= size and (level == 0 or counts[level]):
                after = dict(counts)
                if level:
                    after[level] -= 1
                after[level + length] = after.get(level + length, 0) + 1
                costs.append((sum_of_squares(after, size), -level))
        level = -min(costs)[1]
        assert packer.best_level(length) == level
        if level:
            counts[level] -= 1
        counts[level + length] += 1
        out += packer.place(row, np.arange(length, dtype="<u4"))
        assert all(counts[k] == packer.counts[k] for k in range(1, size))
    out += packer.close()
    check_sequences([(p[3], p[4], len(p[5]) // 4) for p in out], size)
    assert sum(len(p[5]) for p in out) == 4 * total


def test_bounded_windows_need_no_padding():
    """Lengths that fit together in no way, and a bound of three windows."""
    packer, out = packing.Packer(7, 100, 3), []
    for row in range(50):
        out += packer.place(row, np.full(70, row, dtype="<u4"))
        assert packer.open <= 3
    out += packer.close() + packer.close()
    check_sequences([(p[3], p[4], len(p[5]) // 4) for p in out], 100)
    tokens = defaultdict(bytes)
    for row, start, total, _, _, ids in sorted(out):
        assert total == 70 and len(tokens[row]) == 4 * start
        tokens[row] += ids
    assert dict(tokens) == {row: np.full(70, row, dtype="<u4").tobytes() for row in range(50)}


def test_documents_longer_than_a_sequence():
    packer = packing.Packer(0, 8, 5)
    out = packer.place("a", np.arange(21, dtype="<u4")) + packer.place("b", np.arange(8, dtype="<u4")) + packer.close()
    assert [(p[0], p[1], p[3], len(p[5]) // 4) for p in out] == [("a", 0, 0, 8), ("a", 8, 1, 8), ("b", 0, 2, 8), ("a", 16, 3, 4), ("a", 20, 4, 1)]


def test_ranks_agree_with_the_library_on_every_code_point():
    with open(packing.RANKS_FILE, encoding="ascii") as f:
        encoder = packing.Encoder(packing.read_spec(packing.TOKENIZER_FILE), f.read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b1{c}2.{c}! {c} {c}{c}a" for c in points]
    for start in range(0, len(texts), 50_000):
        part = texts[start : start + 50_000]
        for text, e in zip(part, LIBRARY.encode_batch_fast(part, add_special_tokens=False)):
            assert encoder.ranks.encode_ordinary(text) == e.ids


def test_ids_of_random_texts():
    with open(packing.RANKS_FILE, encoding="ascii") as f:
        encoder = packing.Encoder(packing.read_spec(packing.TOKENIZER_FILE), f.read())
    random_ = random.Random(5)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "\r", " ", "　", "9", "..", "é", "一", "\U0001f600", "<|endoftext|>", "<|end", "\x1c", "́"]
    for _ in range(5000):
        text = "".join(random_.choices(alphabet, k=random_.randrange(12)))
        assert encoder.ids(text).tobytes() == expected_ids(text).tobytes()
    for text in (" " * 1000, "a" + " " * 999 + "b", "\n" * 200_000 + "x", "a" * 200_000):
        assert encoder.ids(text).tobytes() == expected_ids(text).tobytes()
