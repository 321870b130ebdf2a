"""Token counts of a byte-level BPE vocabulary, with a shortcut for pre-tokens that are one token.

Offline, every string of the vocabulary is encoded by itself; those that come out as one token are proven whole. A
pre-token that is whole counts one without merging; only the rest goes through the merges. One pass, no shuffle; the
table has one entry per vocabulary string at most, which bounds the broadcast.

Defined cases: null and empty texts have no bytes and no tokens. Rows without id, repeated rows, empty tables and
extra columns need no special care: every row gets its own result in place.
"""

from __future__ import annotations

import json
import os
import re

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.bpe import Merges, read_spec, split_patterns
from cartlens.llm.common import BoundedCache, table, worker_state, wrapped

BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024

PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[LETTER]+| ?[NUMBER]+| ?[^SPACELETTERNUMBER]+|[SPACE]+(?![^SPACE])|[SPACE]+"
)


def whole_tokens(merges: Merges) -> set[str]:
    """The vocabulary strings, as text, that encode alone as one token. Strings that are no UTF-8 are no text."""
    byte_of = {letter: b for b, letter in enumerate(merges.letters)}
    found = set()
    for string, n in merges.vocab.items():
        if all(c in byte_of for c in string):
            data = bytes(byte_of[c] for c in string)
            if merges.merge(merges.symbols(data)) == [n]:
                try:
                    found.add(data.decode())
                except UnicodeDecodeError:
                    pass
    return found


class TokenCounter:
    def __init__(self, spec: str, whole: set[str], cache: int = 120_000):
        data = json.loads(spec)
        model = data["model"]
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]])
        self.whole = whole
        self.marks = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special_split = re.compile("|".join(map(re.escape, self.marks))).split
        self.pre_tokens = split_patterns(PRE_TOKENS)
        self.merged = BoundedCache(self._merged, cache)
        self.known = BoundedCache(self.count_plain, cache)

    def count_plain(self, text: str) -> int:
        """The tokens of a text without special strings: whole pre-tokens count one, the rest is merged."""
        found = self.pre_tokens(text)
        rest = [p for p in found if p not in self.whole]
        return len(found) - len(rest) + sum(map(self.merged.__getitem__, rest))

    def _merged(self, pre_token: str) -> int:
        return len(self.merges.merge(self.merges.symbols(pre_token.encode("utf-8", "surrogatepass"))))

    def _count_part(self, text: str) -> int:
        # With single spaces and line ends only, no pre-token spans two words: a space belongs to the word behind it,
        # a line end is a pre-token of its own. The two ways to split differ where any other white space is, or two
        # of these stand together or at an end.
        if text.replace("\n", " ").split(" ") != text.split():
            return self.count_plain(text)
        total, known = text.count("\n") * self.known["\n"], self.known
        for line in text.split("\n"):
            first, *others = line.split(" ")
            total += known[first]
            if others:
                total += sum(map(known.__getitem__, [" " + w for w in others]))
        return total

    def count(self, text: str | None) -> int:
        text = text or ""
        if not any(m in text for m in self.marks):
            return self._count_part(text)
        parts = self.special_split(text)
        return len(parts) - 1 + sum(map(self._count_part, parts))


def counted(docs: DataFrame, text: str = "text", path: str = BYTE_FILE) -> DataFrame:
    """``docs`` as struct ``row``, beside ``n_bytes`` and ``n_tokens``."""
    spec_text = read_spec(path)
    model = json.loads(spec_text)["model"]
    proven = whole_tokens(Merges(model["vocab"], [tuple(m) for m in model["merges"]]))
    shared = docs.sparkSession.sparkContext.broadcast((spec_text, proven))
    key = os.path.basename(path)

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        count = worker_state("token_counter", key, lambda: TokenCounter(*shared.value)).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    df = wrapped(docs, _text=text).withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    return df.select("row", F.octet_length("_text").cast("long").alias("n_bytes"), udf("_text").alias("n_tokens"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: bytes and tokens of every document."""
    found = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
