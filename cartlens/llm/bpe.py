"""Byte-pair encoding and decoding with the merge tables of public tokenizer files.

A pre-token is a doubly linked list of symbols; a priority queue holds the adjacent pairs by merge rank, then by place.
The smallest entry is merged if both of its symbols are still there (stale entries are skipped), and the pairs with
the new neighbours enter the queue. Decoding puts the vocabulary strings of the ids together.

Texts are encoded where they are read: one pass, no shuffle, memory bounded by a batch of texts and a bounded cache of
pre-tokens per worker. The tokenizer file is read on the driver and travels as one broadcast of a few MB.

Defined cases: null and empty texts have no ids and decode to the empty string. Rows without id, repeated rows, empty
tables and extra columns need no special care: every row gets its own result in place.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import BoundedCache, table, worker_state, wrapped

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")

# The white space of Unicode, by code point, because regex dialects disagree about it.
SPACE = "".join(
    chr(c) for c in [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def split_patterns(pattern: str):
    """``findall`` of a pre-token pattern with LETTER, NUMBER and SPACE for the characters of Unicode's L and N
    categories and white space. Most texts have no character beyond U+FFFF, where a pattern without those is faster."""

    def ranges(kind: str, end: int) -> str:
        found, start = [], None
        for c in range(end + 1):
            inside = c < end and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                found.append((start, c - 1))
                start = None
        found += [(a, b) for a, b in ADDED_IN_16[kind] if b < end]
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in found)

    def compiled(end: int):
        text = pattern.replace("LETTER", ranges("L", end)).replace("NUMBER", ranges("N", end)).replace("SPACE", SPACE)
        return re.compile(text).findall

    short, full = compiled(0x10000), compiled(sys.maxunicode + 1)
    limit = chr(0xFFFF)
    return lambda text: short(text) if text.isascii() or max(text) <= limit else full(text)


# What Unicode 16 adds to the letters and numbers of Unicode 15.1, which Python 3.13 knows.
ADDED_IN_16 = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
        (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
        (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
        (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
        (0x1E5F0, 0x1E5F0),
    ],
    "N": [
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
        (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
    ],
}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest
    from U+0100 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A merge table over symbol ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.letters = vocab, byte_letters()
        # Where no symbol stands for a byte, it is dropped.
        self.inner = [vocab.get(x, -1) for x in self.letters]
        self.final = [vocab.get(x + end, -1) for x in self.letters]
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {(a, b): rank << 32 for rank, (a, b, _) in enumerate(self.parts)}

    def symbols(self, data: bytes) -> list[int]:
        """The symbols a pre-token starts with: one per byte, the last one with the end mark."""
        if not data:
            return []
        inner = self.inner
        out = [inner[b] for b in data[:-1]]
        out.append(self.final[data[-1]])
        return [x for x in out if x >= 0]

    def merge(self, symbols: list[int]) -> list[int]:
        size, rank = len(symbols), self.rank
        # Queue entries are rank and place in one integer: the smallest is the first pair of the lowest rank.
        queue = [
            r + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None
        ]
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push, parts = heapq.heappop, heapq.heappush, self.parts
        symbols = [*symbols, -2]  # a symbol behind the end that is part of no pair
        after, before = list(range(1, size + 2)), list(range(-1, size))
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, right, merged = parts[entry >> 32]
            j = after[i]
            if symbols[i] != left or symbols[j] != right:
                continue  # stale: one of the two has been merged with another neighbour
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            before[k] = i
            r = rank.get((merged, symbols[k]))
            if r is not None:
                push(queue, r + i)
            h = before[i]
            if h >= 0:
                r = rank.get((symbols[h], merged))
                if r is not None:
                    push(queue, r + h)
        return [s for s in symbols if s >= 0]


# str.split takes these for white space, tokenizers do not.
_CONTROLS = re.compile("[" + chr(0x1C) + "-" + chr(0x1F) + "]").search


class WordTokenizer:
    """Lower-cased, NFC-normalised words with an end mark; white space is dropped. ``spec`` is the file's JSON."""

    def __init__(self, spec: str, cache: int = 120_000):
        data = json.loads(spec)
        model = data["model"]
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.strings = {n: s for s, n in model["vocab"].items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.special = {t["content"]: (t["id"].to_bytes(4, "little"), t["content"]) for t in data["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, marks)) + ")").split
        self.pre_tokens = split_patterns("'s|'t|'re|'ve|'m|'ll|'d|[LETTER]+|[NUMBER]|[^SPACELETTERNUMBER]+")
        self.of_pre_token = BoundedCache(self._encode_pre_token, cache)
        self.of_word = BoundedCache(self.encode_plain, cache)

    def _encode_pre_token(self, pre_token: str) -> tuple[bytes, str]:
        ids = self.merges.merge(self.merges.symbols(pre_token.encode("utf-8", "surrogatepass")))
        return b"".join([n.to_bytes(4, "little") for n in ids]), self.decode(ids)

    def encode_plain(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, vocabulary strings with a space between) of text without marks."""
        # Lower case letter by letter: no look at the end of a word for the Greek sigma.
        plain = unicodedata.normalize("NFC", text).replace(chr(0x3A3), chr(0x3C3)).lower()
        found = list(map(self.of_pre_token.__getitem__, self.pre_tokens(plain)))
        if len(found) == 1:
            return found[0]
        return b"".join([p[0] for p in found]), " ".join([p[1] for p in found if p[0]])

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """No pre-token spans white space, so a text is encoded by its white-space words, most of them remembered."""
        text = text or ""
        parts = self.special_split(text) if "<|" in text else [text]
        found: list[tuple[bytes, str]] = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append(self.special[part])
            elif _CONTROLS(part):
                found.append(self.encode_plain(part))
            else:
                found += map(self.of_word.__getitem__, part.split())
        return b"".join([p[0] for p in found]), " ".join([p[1] for p in found if p[0]])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[n] for n in ids)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, text: str = "text", path: str = WORD_FILE) -> DataFrame:
    """``docs`` as struct ``row``, beside ``ids`` (binary: little-endian 32-bit integers) and ``decoded``."""
    key = os.path.basename(path)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.pandas_udf("ids binary, decoded string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        both = worker_state("word_bpe", key, lambda: WordTokenizer(spec.value)).encode_decode
        return pd.DataFrame([both(t) for t in texts], columns=["ids", "decoded"], dtype=object)

    return wrapped(docs, _text=text).withColumn("bpe", udf(F.col("_text").cast("string"))).select(
        "row", "bpe.ids", "bpe.decoded"
    )


def _digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "row.doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: number and digests of the ids and of the decoded text of every document."""
    return _digests(encoded(table(spark, sf_dir, "documents").select("doc_id", "text")))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage of the pipeline: as the query, for the documents that are left."""
    return _digests(encoded(docs))
