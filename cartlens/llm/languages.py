"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and calibrated rejection.

A word's features are itself and its character 2- to 4-grams with word marks, hashed into buckets; a text is the mean
of the bucket embeddings of all its words, and a linear layer with softmax gives the languages. Embeddings and layer
are trained by stochastic gradient descent in numpy on the whole texts of a bounded number of rows: as many of every
language, spread over its sources, so a rare language is learned at every size. Another bounded sample, uniform over the
rows as the share of right predictions is meant for the corpus as it is, sets the temperature of the softmax and the
score from which predictions are accepted.

The rows are drawn from a table of ids, languages and sources, written once; texts are read for the drawn rows, and
once more, whole, in one pass and without a shuffle, to be predicted. A task remembers words by the sum of their
embeddings, so its memory does not depend on the number of languages, and looks at long texts piece by piece.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled row everything is
``und``. Rows without id are never learned from; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import BoundedCache, table, worker_state, wrapped
from cartlens.session import checkpointed

# Rows of the training sample. Languages get equal parts of them, what a rare one leaves goes to the others, and none
# gets fewer than LANGUAGE_ROWS if it has them.
TRAIN_ROWS = 1000
LANGUAGE_ROWS = 20
# So many times the rows are drawn by hash before the exact number is taken.
DRAWN = 3
CALIBRATION_ROWS = 500
# Ids of drawn rows up to which they are broadcast; there are more only with very many languages.
BROADCAST_ROWS = 20_000

BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 2
RATE = 0.5
BATCH_WORDS = 50
# Words of a text that are looked at together.
PIECE_WORDS = 20_000
# Share of accepted predictions that should be right on the calibration sample.
TARGET_PRECISION = 0.99

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def text_words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def pieces_of(text: str | None):
    """The words of a text, some thousand at a time."""
    text = (text or "").lower()
    if len(text) <= PIECE_WORDS:
        yield LETTERS.findall(text)
        return
    words = map(re.Match.group, LETTERS.finditer(text))
    while piece := list(islice(words, PIECE_WORDS)):
        yield piece


def features(word: str) -> list[int]:
    """Buckets of a word and of its character 2- to 4-grams. CRC32 is the same on every machine."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


class Model:
    """Embeddings (buckets x dimensions) and the linear layer (dimensions x languages, and a bias) after training."""

    def __init__(
        self, languages: list[str], embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, accept: float
    ):
        self.languages, self.embeddings, self.weights, self.bias = languages, embeddings, weights, bias
        self.temperature, self.accept = temperature, accept

    def logits(self, sums: np.ndarray, n: int) -> np.ndarray:
        return sums / max(n, 1) @ self.weights + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits - logits.max()) / self.temperature
        e = np.exp(z)
        return e / e.sum()


class Places(dict):
    """The row of each remembered word in ``values``: the sum of its embeddings, and their number."""

    def __init__(self, embeddings: np.ndarray, limit: int):
        super().__init__()
        self.embeddings, self.values = embeddings, np.zeros((limit, DIMENSIONS + 1), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        buckets = features(word)
        self.values[place, :-1] = self.embeddings[buckets].sum(axis=0)
        self.values[place, -1] = len(buckets)
        return place


class Scorer:
    """Predicts texts with remembered words; forgets them when there are too many."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit, self.places = model, limit, Places(model.embeddings, limit)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.model.languages:
            return UNKNOWN, 0.0
        sums, letters = np.zeros(DIMENSIONS + 1), False
        for piece in pieces_of(text):
            letters = letters or any(map(str.isalpha, piece))
            if len(self.places) + len(piece) > self.limit:
                self.places.clear()
            places = np.fromiter(map(self.places.__getitem__, piece), dtype=np.int64, count=len(piece))
            sums += self.places.values[places].sum(axis=0, dtype=np.float64)
        if not letters:
            return UNKNOWN, 0.0
        p = self.model.probabilities(self.model.logits(sums[:-1], sums[-1]))
        best = int(p.argmax())
        return self.model.languages[best], float(min(1.0, p[best]))


def train(
    rows: list[tuple[list[str], str]], calibration: list[tuple[list[str], str]], epochs: int = EPOCHS, seed: int = 7
) -> Model:
    """Fit on (words, language) rows; the steps see short pieces of texts, so that short texts are learned too."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 0)), np.zeros(0), 1.0, 1.0)
    number = {lang: n for n, lang in enumerate(languages)}
    random = np.random.default_rng(seed)
    embeddings = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    pieces, known = [], BoundedCache(features, 200_000)
    for found, lang in rows:
        for start in range(0, len(found), BATCH_WORDS):
            counts = Counter(b for w in found[start : start + BATCH_WORDS] for b in known[w])
            if counts:
                n = np.fromiter(counts.values(), dtype=np.float64)
                pieces.append((np.fromiter(counts.keys(), dtype=np.int64), n / n.sum(), number[lang]))
    step, steps = 0, max(1, epochs * len(pieces))
    for _ in range(epochs):
        for k in random.permutation(len(pieces)):
            buckets, share, target = pieces[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ embeddings[buckets]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target] -= 1.0
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            # Each bucket occurs once in a piece, so plain indexing adds up rightly.
            embeddings[buckets] -= (rate * len(buckets)) * np.outer(share, back)
    model = Model(languages, embeddings.astype(np.float32), weights, bias, 1.0, 0.0)
    return calibrated(model, [(w, number[lang]) for w, lang in calibration if lang in number])


def calibrated(model: Model, rows: list[tuple[list[str], int]]) -> Model:
    """Temperature by likelihood, and the lowest score from which accepted predictions reach the target precision."""
    logits, targets = [], []
    for found, target in rows:
        buckets = [b for w in found for b in features(w)]
        if buckets:
            logits.append(model.logits(model.embeddings[buckets].sum(axis=0, dtype=np.float64), len(buckets)))
            targets.append(target)
    if not logits:
        return model
    z, y = np.array(logits), np.array(targets)

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.2, 20, 60)
    model.temperature = float(min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean()))
    p = probabilities(model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= TARGET_PRECISION)
    model.accept = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def _labelled(docs: DataFrame, held: Column) -> DataFrame:
    """(doc_id, lang, source, held) of the rows one can learn from, once per id, written down."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return checkpointed(docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", "lang", source.alias("source"), held.alias("held")
    ).distinct())


def uniform(labelled: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most ``rows`` of ``labelled``, the first by a hash of the id."""
    total = labelled.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000))
    share = min(1_000_000, int(2_000_000 * rows / total) + 1000) if total else 0
    return labelled.withColumn("place", place).where(F.col("place") < share).orderBy("place", "doc_id", "lang", "source").limit(rows)


def quota(counts: list[int], rows: int) -> int:
    """The number of rows a language may have so that all have ``rows`` together; at least ``LANGUAGE_ROWS``."""
    left = rows
    for k, n in enumerate(sorted(counts)):
        part = left // (len(counts) - k)
        if n > part:
            return max(part, LANGUAGE_ROWS)
        left -= n
    return max(rows, LANGUAGE_ROWS)


def by_language(labelled: DataFrame, rows: int, salt: int) -> DataFrame:
    """Rows of every language, as many as ``quota`` says, taken from its sources in turn by a hash of the id.

    Rows that are ``held`` serve only languages without others.
    """
    counts = labelled.groupBy("lang", "source", "held").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    langs = counts.groupBy("lang").agg(
        F.min("held").alias("held"), F.sum(F.when(~F.col("held"), F.col("n"))).alias("rest"), F.sum("n").alias("n"),
    ).select("lang", "held", F.coalesce("rest", "n").alias("n_lang"))
    most = quota([r["n_lang"] for r in langs.select("n_lang").collect()], rows)
    sources = counts.join(langs, ["lang", "held"])
    n_sources = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    # Both a draw of equal size from each source and one uniform over the language.
    share = DRAWN * most * F.greatest(1 / (F.col("n_sources") * F.col("n")), 1 / F.col("n_lang"))
    shares = sources.join(n_sources, "lang").select("lang", "source", "held", share.alias("share"))
    place = F.xxhash64("doc_id", F.lit(salt))
    drawn = (
        labelled.join(shares, ["lang", "source", "held"]).where(F.pmod(place, F.lit(1 << 30)) < F.col("share") * (1 << 30))
        .select("doc_id", "lang", "source", place.alias("place"))
    )
    turn = F.row_number().over(Window.partitionBy("lang", "source").orderBy("place", "doc_id"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "place", "doc_id", "source"))
    return drawn.withColumn("turn", turn).withColumn("at", at).where(F.col("at") <= most)


def fitted(docs: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang), and source where there is one; calibration rows are not trained on, but
    for languages that have no others."""
    labelled = _labelled(docs, F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0)
    use = by_language(labelled, TRAIN_ROWS, 1).select("doc_id", "lang", F.lit(0).alias("use")).unionByName(
        uniform(labelled.where("held"), CALIBRATION_ROWS, 2).select("doc_id", "lang", F.lit(1).alias("use"))
    )
    use = checkpointed(use.distinct())
    if use.count() <= BROADCAST_ROWS:
        use = F.broadcast(use)
    texts = docs.where("text IS NOT NULL").select("doc_id", "lang", "text").join(use, ["doc_id", "lang"])
    rows = sorted(map(tuple, texts.groupBy("doc_id", "lang", "use").agg(F.min("text").alias("text")).collect()))
    trained, calibration = ([(text_words(text), lang) for _, lang, at, text in rows if at == use_] for use_ in (0, 1))
    return train(trained, calibration)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, beside ``lang_pred``, ``lang_score`` and ``accepted``."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.embeddings, model.weights, model.bias, model.temperature, model.accept)
    )
    key = uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        one = worker_state("language", key, lambda: Scorer(Model(*shared.value))).predict
        return pd.DataFrame([one(t) for t in texts], columns=["lang", "score"])

    found = wrapped(docs, _text=text).withColumn("p", predict(F.col("_text").cast("string")))
    return found.select(
        "row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("lang_score"),
        ((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= F.lit(model.accept))).alias("accepted"),
    )


def predicted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the language of every document, by a model that never saw the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = fitted(docs.where(~held_out).select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]))
    found = identified(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", F.col("lang_score").alias("score"), "accepted")
