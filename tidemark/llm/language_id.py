"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier on hashed byte n-grams of the lower-cased text says
which side the text is on. Decoding takes the language whose codeword loses least against these answers, each bit
weighted by how often its classifier is right; a bit that goes wrong is outvoted by the others. A text whose best and
second best codeword are about equally near is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import bounded_batches, draw, whole_text
from tidemark.session import materialise

#: Bound on the labelled rows of each language that the classifiers are fitted on, the first by a hash of the id.
SAMPLE_ROWS = 1_000
#: Labelled rows by which the bits are centred and weighed, and ids sent to the tasks: with more, a share of each language, or a join.
FIT_ROWS = 200_000
GRAM = 3
BUCKETS = 1 << 15
UNDETERMINED = "und"
AMBIGUOUS = 0.5  # a smaller share of the probability for the best language is flagged
SMOOTHING = 1.0
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)  # odd numbers that spread the bytes


def has_letter(text: str) -> bool:
    """Is there a letter? The pattern also finds numerals of other kinds than digits, which are then told apart."""
    found = _LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each class: all ways to part up to five classes in two; beyond that, random rows far apart."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=classes) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    bits = int(np.ceil(12 * np.log2(classes)))
    draw, best, gap = random.Random(seed), None, -1
    for _ in range(200):
        code = np.array([[draw.choice((1, -1)) for _ in range(bits)] for _ in range(classes)], float)
        if (abs(code.sum(axis=0)) == classes).any():
            continue
        nearest = int(((bits - code @ code.T) / 2 + bits * np.eye(classes)).min())
        if nearest > gap:
            best, gap = code, nearest
    return best


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte (the last ones wrap into what follows in the buffer)."""
    size = len(data) - GRAM + 1
    mixed = np.zeros(size, np.uint32)
    for i in range(GRAM):
        mixed = (mixed ^ data[i : i + size]) * _MULTIPLIERS[i]
        mixed ^= mixed >> np.uint32(15)
    return (mixed & np.uint32(BUCKETS - 1)).astype(np.int32)


def _joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte buffer, a space before and at least ``GRAM`` after each, and where each begins."""
    parts = [(" " + t.lower() + " " * GRAM).encode() for t in texts]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return np.frombuffer(b"".join(parts), np.uint8), starts


@dataclass
class LanguageModel:
    """Languages, their codewords, for each bucket and bit the log odds of the two sides, and a weight per bit."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    scale: np.ndarray

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        """For each text and bit the mean log odds, scaled: positive for the +1 side."""
        data, starts = _joined(texts)
        buckets = gram_hashes(data)
        lengths = np.diff(np.append(starts, len(buckets)))
        sums = np.empty((len(texts), self.odds.shape[1]))
        for bit in range(self.odds.shape[1]):
            sums[:, bit] = np.add.reduceat(self.odds[:, bit][buckets], starts, dtype=np.float64)
        return (sums / lengths[:, None] + self.bias) * self.scale

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """Probability of each language: a softmax over the weighted losses of its codeword."""
        plus, minus = np.logaddexp(0, -margins) * self.bit_weight, np.logaddexp(0, margins) * self.bit_weight
        loss = plus @ (self.code > 0).T.astype(float) + minus @ (self.code < 0).T.astype(float)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return share / share.sum(axis=1, keepdims=True)

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float, bool]]:
        if not len(texts):
            return []
        lettered = [has_letter(t) for t in texts]
        if not self.languages:
            return [(UNDETERMINED, 0.0, True)] * len(texts)
        out: list[tuple[str, float, bool]] = []
        for at in range(0, len(texts), 256):
            share = self.shares(self.margins(texts[at : at + 256]))
            best = share.argmax(axis=1)
            for row, (b, letters) in enumerate(zip(best, lettered[at : at + 256])):
                score = float(share[row, b])
                out.append((self.languages[b], score, score < AMBIGUOUS) if letters else (UNDETERMINED, 0.0, True))
        return out


def labelled_sample(docs: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """At most ``rows`` documents with letters for each label (text, lang), the first by a hash of their id; written once.

    Every label is learned; the driver gets one count for each.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(key).alias("_id"), F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    base = base.where("lang is not null and text is not null and _id is not null")
    counted = base.groupBy("lang").count().collect()
    if not counted:
        return materialise(base.select("text", "lang"), "labelled")
    # rows that cannot be among the first are left out before any of them are gathered, so a frequent label is no burden
    share = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, (2.0 * rows + 100) / r["count"]))])
    keys = base.where(draw("_id") <= F.element_at(share, F.col("lang"))).select("_id", "lang")
    first = Window.partitionBy("lang").orderBy(draw("_id"), "_id")
    chosen = keys.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rows).select("_id", "lang").distinct()
    chosen = F.broadcast(chosen) if rows * len(counted) <= FIT_ROWS else chosen
    return materialise(base.join(chosen, ["_id", "lang"]).select("text", "lang"), "labelled")


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the n-gram buckets by language, one row per batch and language."""
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            counts = np.bincount(gram_hashes(_joined(part["text"].tolist())[0]), minlength=BUCKETS)
            yield pd.DataFrame({"lang": [lang], "counts": [counts.astype(np.int64)], "rows": [len(part)]})


def learn_languages(sample: DataFrame) -> LanguageModel:
    """Fit the bits on a bounded sample (text, lang): see ``labelled_sample``.

    Every language of the sample is learned. What comes to the driver are counts of ``BUCKETS`` n-gram buckets, one language
    after the other; it keeps a sum for each bit, so memory grows with the log of the number of languages. No labelled row
    gives a model without languages: every text is then undetermined. One language is always predicted if it is the only one.
    """
    counts = materialise(sample.repartition("lang").mapInPandas(_gram_counts, "lang string, counts array<long>, rows long"), "grams")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum(total).alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1), np.ones(1))
    place = {lang: i for i, lang in enumerate(languages)}
    every, plus = np.zeros(BUCKETS), np.zeros((code.shape[1], BUCKETS))  # sums of the shares of buckets: all, and the +1 side of each bit
    for row in counts.toLocalIterator():
        share = np.array(row["counts"], float) / totals[row["lang"]]
        every += share
        plus[code[place[row["lang"]]] > 0] += share
    odds = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        sizes = [(code[:, bit] == side).sum() for side in (1, -1)]
        sums = plus[bit], np.maximum(every - plus[bit], 0)
        sides = [part / n if n else np.full(BUCKETS, 1 / BUCKETS) for part, n in zip(sums, sizes)]
        smooth = SMOOTHING / BUCKETS / 10
        odds[:, bit] = np.log(sides[0] + smooth) - np.log(sides[1] + smooth)
    model = LanguageModel(languages, code, odds, np.zeros(code.shape[1]), np.ones(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) == 1:
        return model

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            side = model.code[[place[lang] for lang in batch["lang"]]]
            margins = model.margins(batch["text"].tolist())
            yield pd.DataFrame({"m": list(margins), "y": list(side)})

    part = min(1.0, FIT_ROWS / max(1, counts.agg(F.sum("rows")).first()[0]))
    known = sample if part == 1 else sample.where(draw("text") < part)
    fit = known.mapInPandas(measured, "m array<double>, y array<double>").toPandas()  # one number per bit and sampled row
    margins, side = np.vstack(fit["m"]), np.vstack(fit["y"])
    for bit in range(code.shape[1]):
        plus, minus = margins[side[:, bit] > 0, bit], margins[side[:, bit] < 0, bit]
        if not len(plus) or not len(minus):
            continue
        model.bias[bit] = -(np.median(plus) + np.median(minus)) / 2
        spread = np.median(abs(np.concatenate([plus + model.bias[bit], minus + model.bias[bit]])))
        model.scale[bit] = 4 / max(float(spread), 1e-6)
        right = ((margins[:, bit] + model.bias[bit]) * side[:, bit] > 0).mean()
        model.bit_weight[bit] = max(0.05, np.log(max(right, 0.5) / max(1 - right, 1e-3)))
    model.bit_weight *= code.shape[1] / model.bit_weight.sum()
    return model


def predictor(model: LanguageModel) -> Callable[[Column], Column]:
    """Expression: text -> (lang, score, ambiguous)."""

    @pandas_udf("lang string, score double, ambiguous boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(model.predict(texts.tolist()), columns=["lang", "score", "ambiguous"])

    return predicted


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "language") -> DataFrame:
    """Add the struct ``name``: lang (``und`` without a letter), score (0 to 1), ambiguous.

    Null counts as the empty text: ``und``, score 0, ambiguous. Whole texts are read. Rows stay where they are and keep all
    their columns, so nulls, ties and repeated rows elsewhere do not matter.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, predictor(model)(whole_text(F.col(text))))
