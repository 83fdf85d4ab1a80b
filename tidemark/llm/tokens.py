"""Token counts at every prefix of a text, for a piece model of the BPE kind.

The count of a prefix follows from shorter prefixes: among the pieces that end where the prefix ends, exactly one can be
its last token, namely the one that the encoder keeps apart from the last token of what precedes it. So
``count[i] = count[i - len(last)] + 1``, and one pass over a word gives the count of each of its prefixes. Words (white
space and what follows it) do not influence each other, so their counts add up, and a word seen before is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tidemark.llm.common import bounded_batches, whole_text

SPACE = "▁"  # fixed value: how the model writes a space
CACHED_WORDS = 1_000_000  # words a worker remembers; it starts anew beyond that
CACHED_PAIRS = 500_000
CACHED_LENGTH = 64  # longer words are counted each time they occur
STRUCT = "n_bytes long, n_tokens long, deltas binary"


def read_model(path: str) -> bytes:
    """The model file's bytes, read by the driver and sent to the tasks (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


class PieceModel:
    """Pieces and scores of a model, and how it keeps two neighbouring pieces apart."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(library.get_piece_size()):
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)):
                piece = library.id_to_piece(i)
                self.scores[piece], self.ids[piece] = library.get_score(i), i
        self.longest = max(map(len, self.scores))
        self.alphabet = {c for piece in self.scores for c in piece}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece of this model crosses the start of a word")
        line_end = "" if "\n" in self.alphabet else "\n"
        # a character that is in no piece parts what is before it from what is after it
        self.words = re.compile(f"{SPACE}+[^{SPACE}{line_end}]*" + (f"|{line_end}[^{SPACE}{line_end}]*" if line_end else ""))
        self.reached = {p for p in self.scores if self.merged(p) == [p]}  # pieces that merges can make
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The text as the encoder's merges leave it: always the best scored neighbours, the first of them on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Do these two pieces stay two when their text is encoded?"""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known


class PrefixCounter:
    """Counts per prefix, as deltas of one signed byte per character (a token more, or several fewer after a merge)."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self._known: dict[str, bytes] = {}

    def _extend(self, word: str, kept: int, counts: list[int], last: list[str]) -> None:
        """Fill ``counts`` and ``last`` for the prefixes of ``word`` longer than ``kept``."""
        model = self.model
        alphabet, reached, pairs, longest = model.alphabet, model.reached, model.pairs, model.longest
        del counts[kept + 1 :], last[kept + 1 :]
        for end in range(kept + 1, len(word) + 1):
            if word[end - 1] not in alphabet:  # written as bytes, nothing merges over it
                counts.append(counts[-1] + len(word[end - 1].encode()))
                last.append("")
                continue
            for start in range(end - longest if end > longest else 0, end):
                piece = word[start:end]
                if piece in reached:
                    left = last[start]
                    if not left or pairs.get((left, piece)) or model.apart(left, piece):
                        counts.append(counts[start] + 1)
                        last.append(piece)
                        break
            else:
                raise ValueError(f"no last token at {end} of {word!r}")

    def _learn(self, words: set[str]) -> None:
        """Count words not seen yet. Sorted, each continues the prefix it shares with the one before."""
        before, counts, last = "", [0], [""]
        for word in sorted(words):
            kept = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                kept += 1
            self._extend(word, kept, counts, last)
            self._known[word] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])
            before = word

    def deltas(self, texts: list[str]) -> list[bytes]:
        """For each text, a delta for the leading space the model adds and one for each character."""
        find, known, out = self.model.words.findall, self._known, []
        for at in range(0, len(texts), 512):
            split = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[at : at + 512]]
            if len(known) > CACHED_WORDS:
                known.clear()
            new = set().union(*split).difference(known)
            self._learn(new)
            out += [b"".join(map(known.__getitem__, words)) for words in split]
            for word in new:
                if len(word) > CACHED_LENGTH:
                    del known[word]
        return out


_counters: dict[int, PrefixCounter] = {}


def _counter(model: bytes) -> PrefixCounter:
    key = hash(model)
    if key not in _counters:
        _counters[key] = PrefixCounter(model)
    return _counters[key]


def prefix_counter(model: bytes) -> Callable[[Column], Column]:
    """Expression: text -> (n_bytes, n_tokens, deltas) without special tokens; see ``prefix_counts``."""

    @pandas_udf(STRUCT)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(model)
        for texts in batches:
            texts = texts.tolist()
            deltas = counter.deltas(texts)
            yield pd.DataFrame(
                {
                    "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas],
                    "deltas": deltas,
                }
            )

    return counted


def prefix_counts(docs: DataFrame, model_path: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """Add the struct ``name``: n_bytes (UTF-8), n_tokens, deltas.

    Adding the first ``i + 1`` deltas (signed bytes) gives the number of tokens of the first ``i`` characters as the
    library would encode them on their own (0 for none). Null text counts as empty: 0 tokens and no deltas. All other
    columns are kept as they are; rows are not moved, so repeated rows and ids of any kind do not matter. A text of any
    length takes time and memory in proportion to it.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, prefix_counter(read_model(model_path))(whole_text(F.col(text))))


@pandas_udf(LongType())
def tokens_of_prefix(deltas: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` characters of a text (of all of it, if it is shorter)."""
    return pd.Series(
        [int(np.frombuffer(d, np.int8)[: int(c) + 1].sum(dtype=np.int64)) if c > 0 else 0 for d, c in zip(deltas, chars)], dtype="int64"
    )


@pandas_udf(LongType())
def prefix_within(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of a text that has at most ``budget`` tokens."""
    out = []
    for d, most in zip(deltas, budget):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(d, np.int8), dtype=np.int64)[1:] <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="int64")
