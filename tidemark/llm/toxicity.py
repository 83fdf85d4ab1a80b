"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton in folded text.

Folding undoes disguises: case, accents, look-alike letters of other alphabets, and digits or signs that stand for
letters inside a word. An entry is a word or, with ``*`` at its end, how words begin. Where several match, the heaviest
counts, and none inside an exception phrase. The weights of the matches, set against the length of the text, give the
score.

Entries, weights and exception phrases are learned from labelled rows: a weight is the log of how much likelier the entry is
in toxic documents; an exception is an entry's word with the one before or after it, if the two stand together rather in
documents that are not toxic. The counts are Spark aggregations; the driver sees only what makes it into the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import bounded_batches, draw, whole_text
from tidemark.session import materialise

#: Bound on the labelled rows that the lexicon and the score are fitted on, the first by a hash of the id.
SAMPLE_ROWS = 40_000
MIN_DOCS = 3  # a word in fewer toxic documents says nothing
MIN_WEIGHT = 1.5  # log of the odds; weaker words stay out
SMOOTHING = 0.5
#: An entry's share among toxic rows must exceed that among others by so many standard errors, beginnings by more.
DIFFERENCE, DIFFERENCE_BEGINNING = 2.2, 4.0
COUNTED_ROWS = 1000  # rows whose words a task adds up at a time
BEGINNINGS = (5, 6, 7)  # letters of the beginnings that are tried
THRESHOLD = 0.3

#: Letters of other alphabets that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = dict(zip("абвгеёзикмнорстухѕіјԁһαβγδεηικνορτυχω", "abbreesukmhopctyxsijdhabydenikvoptuxw"))
ACCENTED = dict(
    zip("àáâãäåāăąçćčďèéêëēėęěğìíîïīįıłñńňòóôõöøōőřśšşťţùúûüūůűýÿžźż", "aaaaaaaaacccdeeeeeeeegiiiiiiilnnnoooooooorssstt" + "uuuuuuu" + "yyzzz")
)
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = {"@": "a", "$": "s", "!": "i"}

_FULLWIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_TABLE = str.maketrans(LOOKALIKES | ACCENTED | DIGITS | {k: v.lower() for k, v in _FULLWIDTH.items()} | {"​": "", "‍": "", "­": ""})
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text without case, accents and disguises. A sign counts as a letter only in front of one."""
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_TABLE)


@dataclass
class Lexicon:
    """Weights by folded word, exception phrases, and the logistic function of (bias, log of weight, log of density)."""

    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    logistic: Sequence[float] = (-4.0, 2.0, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                word = entry.rstrip("*")
                whole, begins = machine.get(word, (0, None, None))[1:]
                if entry == word:
                    machine.add_word(word, (len(word), weight, begins))
                else:
                    machine.add_word(word, (len(word), whole, weight))
            for phrase in self.exceptions:
                machine.add_word(fold(phrase), (len(fold(phrase)), None, None))
            machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def found(self, text: str) -> dict[int, float]:
        """The heaviest match in a folded text by where its word starts, without those inside an exception phrase."""
        machine = self.automaton()
        if not len(machine):
            return {}
        found: dict[int, float] = {}
        spared, size = [], len(text)
        for end, (length, whole, begins) in machine.iter(text):
            start = end + 1 - length
            if start and text[start - 1].isalnum():
                continue
            ends = end + 1 == size or not text[end + 1].isalnum()
            if whole is None and begins is None:
                if ends:
                    spared.append((start, end))
            else:
                weight = max(whole or 0.0, begins or 0.0) if ends else begins
                if weight and weight > found.get(start, 0.0):
                    found[start] = weight
        free = -1  # exceptions that overlap are gone through once
        for start, end in sorted(spared):
            for at in range(max(start, free), end + 1):
                found.pop(at, None)
            free = max(free, end + 1)
        return found

    def matches(self, text: str) -> tuple[float, int]:
        """Summed weight and number of the lexicon words in a folded text, without those inside an exception phrase."""
        found = self.found(text)
        return sum(found.values()), len(found)

    def phrases(self, text: str) -> set[str]:
        """Every matching word of a folded text, written together with the word before and with the word after it."""
        found, seen = self.found(text), set()
        if found:
            words = [(m.start(), m[0]) for m in _WORD.finditer(text)]
            for i, (at, word) in enumerate(words):
                if at in found:
                    seen.update(f"{a} {b}" for a, b in ((words[j][1], words[j + 1][1]) for j in (i - 1, i) if 0 <= j < len(words) - 1))
        return seen

    def features(self, text: str) -> tuple[float, float, int]:
        """Log of the weight, log of the weight per thousand characters (plus one each), and the number of matches."""
        weight, n = self.matches(fold(text))
        return math.log1p(weight), math.log1p(1000 * weight / max(len(text), 100)), n

    def score(self, text: str) -> tuple[float, int]:
        a, b, n = self.features(text)
        bias, by_weight, by_density = self.logistic
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + by_weight * a + by_density * b)))), n


def scorer(lexicon: Lexicon) -> Callable[[Column], Column]:
    """Expression: text -> (score, matches)."""

    @pandas_udf("score double, matches int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([lexicon.score(t) for t in texts], columns=["score", "matches"])

    return scored


def _count_rows(counts: tuple[Counter[str], Counter[str]]) -> Iterator[pd.DataFrame]:
    """Counts of documents without and with the label, as rows (word, toxic, clean)."""
    for toxic, found in enumerate(counts):
        if found:
            yield pd.DataFrame({"word": list(found), "toxic": list(found.values()) if toxic else 0, "clean": 0 if toxic else list(found.values())})


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per entry and label, added up before they are shuffled."""
    for batch in batches:
        for at in range(0, len(batch), COUNTED_ROWS):
            counts = Counter[str](), Counter[str]()
            part = batch.iloc[at : at + COUNTED_ROWS]
            for text, toxic in zip(part["text"], part["toxic"]):
                words = set(_WORD.findall(fold(text)))
                counts[toxic].update(words)
                counts[toxic].update({w[:n] + "*" for n in BEGINNINGS for w in words if len(w) >= n})
            yield from _count_rows(counts)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` documents with a label (text, toxic 0/1), the first by a hash of their id; written once."""
    bounded_batches(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, (1.5 * rows + 100) / max(labels.count(), 1))  # rows beyond it cannot be among the first
    chosen = labels.where(draw("_id") <= share).orderBy(draw("_id"), "_id").limit(rows)
    docs = docs.select(F.col("doc_id").alias("_id"), whole_text(F.col("text")).alias("text"))
    return materialise(docs.join(F.broadcast(chosen), "_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a little ridge on (1, x)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), g)
    return w.tolist()


def _phrase_counts(lexicon: Lexicon):
    """Documents per phrase around a match and label, added up before they are shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter[str](), Counter[str]()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts[toxic].update(lexicon.phrases(fold(text)))
            yield from _count_rows(counts)

    return counted


def learn_exceptions(sample: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> list[str]:
    """Phrases around the words of ``lexicon`` that are no likelier in the ``toxic`` rows of the sample than in its ``clean``
    ones, and stand in ``MIN_DOCS`` of the latter: there the word means no harm. As many as the sample has."""
    counts = sample.mapInPandas(_phrase_counts(lexicon), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    in_toxic, in_clean = (F.col("t") + SMOOTHING) / (toxic + 1.0), (F.col("c") + SMOOTHING) / (clean + 1.0)
    harmless = counts.where((F.col("c") >= MIN_DOCS) & (in_toxic <= in_clean))
    return [r["word"] for r in harmless.select("word").orderBy("word").collect()]


def learn_lexicon(sample: DataFrame, exceptions: Sequence[str] | None = None) -> Lexicon:
    """Entries, weights, exceptions and score from a bounded sample (text, toxic): see ``labelled_sample``. Exceptions that
    the caller gives take the place of learned ones.

    An empty sample, or one with a single class, gives an empty lexicon: every text then scores low.
    """
    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, exceptions or ())
    counts = sample.mapInPandas(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    in_toxic, in_clean = (F.col("t") + SMOOTHING) / (toxic + 1.0), (F.col("c") + SMOOTHING) / (clean + 1.0)
    error = F.sqrt(in_toxic / toxic + in_clean / clean)
    weight = F.log(in_toxic) - F.log(in_clean)
    strong = counts.select("word", weight.alias("w"), ((in_toxic - in_clean) / error).alias("z"), "t").where((F.col("t") >= MIN_DOCS) & (F.col("w") >= MIN_WEIGHT) & (F.col("z") >= F.when(F.col("word").endswith("*"), DIFFERENCE_BEGINNING).otherwise(DIFFERENCE)))
    lexicon = Lexicon({r["word"]: float(r["w"]) for r in strong.select("word", "w").orderBy("word").collect()})
    lexicon = Lexicon(lexicon.weights, learn_exceptions(sample, lexicon, toxic, clean) if exceptions is None else exceptions)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"a": [m[0] for m in made], "b": [m[1] for m in made], "y": batch["toxic"]})

    fitted = sample.mapInPandas(featured, "a double, b double, y int").toPandas()  # three numbers a sampled row
    lexicon.logistic = _fit_logistic(fitted[["a", "b"]].to_numpy(), fitted["y"].to_numpy())
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Add the struct ``name``: score (0 to 1), matches.

    Rows stay where they are and keep all their columns, so nulls, ties and repeated rows elsewhere do not matter. Null
    counts as the empty text, which has the score of a text without matches. Time and memory follow the text's length.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, scorer(lexicon)(whole_text(F.col(text))))
