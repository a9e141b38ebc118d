"""Language identification in two levels with linear support vector machines.

Texts become hashed counts of byte pairs and triples (A-Z lower-cased), square-rooted and of unit
length; whole texts are read, in pieces.  The first level predicts the language family, the second
one the language within it; both let one-versus-one machines vote.  A family of one language needs
no second level.

The machines are fitted on the driver on a bounded sample: at most ``SAMPLE`` labelled documents in
all, as many of each language where it has them, chosen by a hash of doc_id.  Everything else reads all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is any text when
nothing can be learned (``accepted`` then rejects only texts without a letter); rows that repeat a doc_id are judged each (and learned from once); a null
doc_id is not held out and not learned from; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from catamatch.llm.common import map_slices

SAMPLE, SIZE, STEPS, LOSS_WEIGHT = 2400, 1 << 12, 150, 50.0
PIECE = 1 << 20
UNKNOWN = "und"
#: Documents whose prediction scores less are rejected.
LEAST_SCORE = 0.2
#: Families of common languages; any other language is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "ru": "slavic", "uk": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic"}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(raw: bytes, size: int = SIZE) -> np.ndarray:
    """float32 vector of ``size`` values of unit length."""
    counts = np.zeros(size)
    shift = np.uint32(32 - (size - 1).bit_length())
    for at in range(0, max(1, len(raw)), PIECE):
        data = _LOWER[np.frombuffer(raw[max(0, at - 2):at + PIECE], np.uint8)].astype(np.uint32)
        if len(data) < 2:
            continue
        pairs = data[:-1] << np.uint32(8) | data[1:]
        triples = (pairs[:-1] << np.uint32(8) | data[2:]) + np.uint32(1 << 24)
        for grams in (pairs[1:] if at else pairs, triples):
            counts += np.bincount((grams * np.uint32(2654435761)) >> shift, minlength=size)
    out = np.sqrt(counts)
    return (out / (np.sqrt(counts.sum()) or 1.0)).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, loss_weight: float = LOSS_WEIGHT) -> np.ndarray:
    """Linear machine for y of -1 and 1: squared hinge loss and L2, by accelerated gradient steps.

    The last entry is the intercept.  All in 32 bits, so that no step copies the vectors.
    """
    y = y.astype(np.float32)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * np.float32(loss_weight)
    rate = np.float32(1 / (1 + 2 * loss_weight * 2))
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for i in range(steps):
        pull = 2 * cost * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        after = v - rate * (v - np.append(pull @ x, pull.sum()))
        v = after + np.float32(i / (i + 3)) * (after - w)
        w = after
    return w


class Duels:
    """One-versus-one machines over the classes of one level."""

    def __init__(self, x: np.ndarray, names: list[str]):
        self.classes = sorted(set(names))
        names = np.array(names)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = []
        for a, b in self.pairs:
            rows = (names == self.classes[a]) | (names == self.classes[b])
            self.weights.append(fit(x if rows.all() else x[rows], np.where(names[rows] == self.classes[a], 1.0, -1.0)))

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        """Class of most votes, at a tie of the largest margins, and a share of confidence."""
        if not self.pairs:
            return self.classes[0], 1.0
        votes, margins = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        worst = np.ones(len(self.classes))
        for (a, b), w in zip(self.pairs, self.weights):
            m = float(vector @ w[:-1] + w[-1])
            p = 1 / (1 + np.exp(-4 * m))
            votes[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
            worst[a], worst[b] = min(worst[a], p), min(worst[b], 1 - p)
        best = max(range(len(self.classes)), key=lambda i: (votes[i], margins[i], -i))
        return self.classes[best], float(worst[best])


class Model:
    """Family level and, per family, language level."""

    def __init__(self, x: np.ndarray, langs: list[str], families=FAMILIES):
        names = [families.get(lang, lang) for lang in langs]
        self.family = Duels(x, names)
        self.languages = {}
        for name in self.family.classes:
            rows = np.array([n == name for n in names])
            self.languages[name] = Duels(x if rows.all() else x[rows], [lang for lang, r in zip(langs, rows) if r])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return UNKNOWN, 0.0
        vector = features(text.encode())
        family, sure = self.family.predict(vector)
        lang, also = self.languages[family].predict(vector)
        return lang, sure * also


def held_out() -> Column:
    """True for the quarter of doc_ids that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled documents that are not held out; None without any."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    langs = known.select("lang").distinct().count()
    if not langs:
        return None
    order = W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    each = max(1, sample // langs)
    # only the smallest hashes, four times as many as needed, go to the task that ranks a language
    rates = known.groupBy("lang").agg((F.lit(4.0 * each) / F.count("*")).alias("__rate"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # one row a language: in a join on lang all rows of one language would meet in one task
    near = known.join(F.broadcast(rates) if langs <= sample else rates, "lang").where(place < F.col("__rate")).select("doc_id", "lang").distinct()
    chosen = near.withColumn("__no", F.row_number().over(order)).where(F.col("__no") <= each)
    chosen = chosen.orderBy("__no", "lang").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))
    texts = docs.select("doc_id", "lang", "text").join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))
    texts = texts.groupBy("doc_id", "lang").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(cols):
        kept = [(lang.decode(), features(t).tobytes()) for lang, t in zip(cols["lang"], cols["text"]) if has_letter(t.decode())]
        return {"lang": [k[0] for k in kept], "vector": [k[1] for k in kept]}

    rows = sorted(map_slices(texts.select("lang", "text"), run, "lang string, vector binary").collect())
    if not rows:
        return None
    langs, x = [r["lang"] for r in rows], np.empty((len(rows), SIZE), np.float32)
    for i in range(len(rows)):
        x[i], rows[i] = np.frombuffer(rows[i]["vector"], np.float32), None
    return Model(x, langs)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of the documents plus ``__pred``: STRUCT<lang, score>."""
    if model is None:
        return docs.withColumn("__pred", F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))

    @pandas_udf("lang string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang", "score"])

    return docs.withColumn("__pred", run(F.col("text")))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predicted(docs.select("doc_id", "text"), learn(docs, sample)).select(
        "doc_id", held_out().alias("held_out"), F.col("__pred.lang").alias("lang_pred"), F.col("__pred.score").alias("score"))


def accepted(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is known, with all their columns.

    When nothing can be learned no language can be judged: all documents with a letter stay.
    """
    model = learn(docs, sample)
    if model is None:
        letter = pandas_udf(lambda text: text.map(lambda t: bool(t) and has_letter(t)), "boolean")
        return docs.where(letter(F.col("text")))
    marked = predicted(docs, model)
    return marked.where((F.col("__pred.lang") != UNKNOWN) & (F.col("__pred.score") >= least)).drop("__pred")
