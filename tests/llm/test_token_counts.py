"""Token counts against the tokenizers library on texts that mix every kind of white space."""

import random

from tokenizers import Tokenizer

from cartlens.llm import token_counts

PARTS = [
    "a", "the", "'s", "don't", "x1", "12", ".", "...", "é", "\u4e00", "\U0001f600", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2003",
    "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "<|endoftext|>", "<|",
]


def counter():
    spec = token_counts.read_spec(token_counts.BYTE_FILE)
    model = token_counts.json.loads(spec)["model"]
    merges = token_counts.Merges(model["vocab"], [tuple(m) for m in model["merges"]])
    return token_counts.TokenCounter(spec, token_counts.whole_tokens(merges))


def test_random_texts_count_like_the_library():
    library, one, draw = Tokenizer.from_file(token_counts.BYTE_FILE), counter(), random.Random(8)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(14))) for _ in range(20_000)]
    texts += ["a\tb\n\n\nc\td", "a b\tc\n\nd", " a", "a ", "\na\n", "a\xa0b  c", "", " ", "\n"]
    different = [t for t in texts if one.count(t) != len(library.encode(t, add_special_tokens=False).ids)]
    assert different == []
