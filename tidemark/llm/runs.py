"""Stretches of a text that repeat with a period, found while its words are appended: online dyadic square catching.

For every power of two B from 8 on, each completed block of B words has a catcher. It watches the words that come after it
and looks for its block at the distances B to 2B - 1, those of 8 words at 1 to 15. A window of B words that ends at the
word just appended has thus one block to be compared with (two for B = 8), whatever the length of the text: a word costs one
comparison of names a level. A name is a hash of the window, made from the names of its halves. A stretch with period p and
length max(24, 3p) or more holds a whole block B <= p < 2B (8, if p < 16) with its copy p words on, so none is missed.

A block that meets its copy is extended word by word to both sides, as far as words p apart are identical; names only
propose, words decide. What overlaps with a stretch of the same period belongs to it, and a stretch that reached the last
word goes on with the next one. Blocks inside a known run are not looked at again for multiples of its period. Texts may be
appended word by word or in pieces of any size, with the same result.

Words stay in memory as numbers; names are kept as far back as a level looks. Many texts are appended one after the other
with a word of its own between them, so numpy works on all of them at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, whole_text

LEAST_WORDS, LEAST_REPEATS = 24, 3
FIRST_BLOCK = 8
PIECE = 1 << 16  # words appended at once
BATCH_WORDS = 1 << 20  # texts searched together
SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number spread over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self._held = np.zeros(1024, dtype)
        self.size = 0

    def extend(self, values: np.ndarray | int, count: int | None = None) -> None:
        count = len(values) if count is None else count
        if self.size + count > len(self._held):
            larger = np.zeros(max(2 * len(self._held), self.size + count), self._held.dtype)
            larger[: self.size] = self._held[: self.size]
            self._held = larger
        self._held[self.size : self.size + count] = values
        self.size += count

    @property
    def values(self) -> np.ndarray:
        return self._held[: self.size]


class _Names:
    """Names of the windows of one size, from the position ``first`` on."""

    def __init__(self, size: int):
        self.size, self.first, self.names = size, 0, np.zeros(0, np.uint64)

    @property
    def end(self) -> int:
        return self.first + len(self.names)

    def at(self, start: int, stop: int) -> np.ndarray:
        return self.names[start - self.first : stop - self.first]

    def add(self, names: np.ndarray) -> None:
        back = 4 * self.size
        cut = max(0, len(self.names) - back)
        self.names = np.concatenate([self.names[cut:], names])
        self.first += cut


class SquareCatchers:
    """Maximal runs of a sequence of numbers that is appended piece by piece.

    ``longest`` is the length of the longest part in which a run is looked for: no period above a third of it is tried.
    """

    def __init__(self, longest: int):
        self.words = _Grown(np.int64)
        self._names = [_Names(1)]
        while self._names[-1].size < FIRST_BLOCK or self._names[-1].size * 2 * LEAST_REPEATS <= longest:
            self._names.append(_Names(self._names[-1].size * 2))
        self._open: dict[int, list[int]] = {}  # period -> [start, end] of its last stretch of words that have a copy
        self._live: set[int] = set()  # periods whose stretch reaches the last word
        self._closed: list[tuple[int, int, int]] = []
        # for each word the run with the farthest end that holds it
        self._run_end, self._run_period = _Grown(np.int64), _Grown(np.int64)

    def append(self, words: np.ndarray) -> None:
        """Advance all catchers over these words."""
        self.words.extend(words)
        self._run_end.extend(0, len(words))
        self._run_period.extend(1, len(words))
        for period in list(self._live):
            self._grow(period)
        for names in self._names:
            start, stop = names.end, self.words.size - names.size + 1
            if stop <= start:
                break
            if names.size == 1:
                names.add(_mixed(self.words.values[start:stop].astype(np.uint64) * _ODD + np.uint64(1)))
            else:
                half = names.size // 2
                left, right = below.at(start, stop), below.at(start + half, stop + half)
                names.add(_mixed(left * np.uint64(3) + _mixed(right + _ODD)))
            below = names
            if names.size >= FIRST_BLOCK:
                self._catch(names, start, stop)

    def _catch(self, names: _Names, start: int, stop: int) -> None:
        """Compare the windows that begin at ``start`` to ``stop`` with the blocks whose catchers watch them."""
        size = names.size
        at = np.arange(start, stop)
        blocks = [(at // size - 1) * size]
        if size == FIRST_BLOCK:
            blocks.append(at // size * size)
        found = []
        for block in blocks:
            met = np.flatnonzero((block >= 0) & (block < at))
            met = met[names.names[block[met] - names.first] == names.names[at[met] - names.first]]
            found.append(np.stack([at[met] - block[met], block[met]]))
        period, block = np.concatenate(found, axis=1)
        new = ~self._within(period, block, block + size)
        period, block = period[new], block[new]
        order = np.lexsort((block, period))
        period, block = period[order], block[order]
        breaks = np.flatnonzero((np.diff(period) != 0) | (np.diff(block) != size)) + 1
        for group in np.split(np.arange(len(period)), breaks):
            if len(group):
                self._meet(int(period[group[0]]), int(block[group[0]]), int(block[group[-1]]) + size, size)

    def _within(self, period, start, end):
        """Whether a known run holds these words and their copies, and its period divides ``period``."""
        return (self._run_end.values[start] >= end + period) & (period % self._run_period.values[start] == 0)

    def _meet(self, period: int, start: int, end: int, size: int) -> None:
        """The blocks from ``start`` to ``end`` have copies by their names: report the stretch they belong to."""
        words = self.words.values
        if self._within(period, start, end):
            return
        if not np.array_equal(words[start:end], words[start + period : end + period]):
            # equal names of different words: look at each block by itself
            if end - start > size:
                for at in range(start, end, size):
                    self._meet(period, at, at + size, size)
            return
        known = self._open.get(period)
        if known is not None:
            if start < known[1]:
                return
            self._close(period)
        while start > 0:
            back = min(size, start)
            same = words[start - back : start] == words[start - back + period : start + period]
            miss = np.flatnonzero(~same)
            start -= back if len(miss) == 0 else back - 1 - int(miss[-1])
            if len(miss):
                break
        self._open[period] = [start, end]
        self._grow(period)

    def _grow(self, period: int) -> None:
        """Extend a stretch to the right as far as words have copies."""
        words, stretch = self.words.values, self._open[period]
        step = 64
        while stretch[1] + period < len(words):
            end = min(stretch[1] + step, len(words) - period)
            miss = np.flatnonzero(words[stretch[1] : end] != words[stretch[1] + period : end + period])
            if len(miss):
                stretch[1] += int(miss[0])
                self._live.discard(period)
                break
            stretch[1] = end
            step *= 2
        else:
            self._live.add(period)
        start, end = stretch[0], stretch[1] + period
        if stretch[1] - start >= period:
            held = self._run_end.values[start:end]
            shorter = held < end
            held[shorter] = end
            self._run_period.values[start:end][shorter] = period

    def _close(self, period: int) -> None:
        start, end = self._open.pop(period)
        self._live.discard(period)
        if end + period - start >= max(LEAST_WORDS, LEAST_REPEATS * period):
            self._closed.append((start, end + period - start, period))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of all runs of the words so far, by start, then period; ends the search."""
        for period in list(self._open):
            self._close(period)
        smallest: dict[tuple[int, int], int] = {}
        for start, length, period in self._closed:
            smallest[start, length] = min(period, smallest.get((start, length), period))
        return sorted((start, length, period) for (start, length), period in smallest.items())


def find_runs(words: np.ndarray, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """Runs of one sequence, appended ``piece`` words at a time."""
    catchers = SquareCatchers(len(words))
    for at in range(0, len(words), piece):
        catchers.append(words[at : at + piece])
    return catchers.runs()


def _order(seed: int, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of ``n`` words; None: all stand where they were."""
    if seed < 0 or seed % 10 or n == 0:
        return None
    g = seed // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % period
    return at


def _result(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    sums = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    if not runs:
        return (0, None, None, None, None, *sums)
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (len(runs), start, length, period, 1000 * length // period, *sums)


def _searched(texts: list[list[bytes]]) -> Iterator[tuple]:
    """The results of some texts, searched as one sequence."""
    numbers: dict[bytes, int] = {}
    catchers = SquareCatchers(max(map(len, texts), default=0))
    firsts, waiting, held, total = [], [], 0, 0
    for i, words in enumerate(texts):
        firsts.append(total)
        waiting.append(np.array([*(numbers.setdefault(w, len(numbers)) for w in words), -1 - i], np.int64))
        held += len(words) + 1
        total += len(words) + 1
        if held >= PIECE or i == len(texts) - 1:
            joined = np.concatenate(waiting)
            for at in range(0, len(joined), PIECE):
                catchers.append(joined[at : at + PIECE])
            waiting, held = [], 0
    of_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catchers.runs():
        i = int(np.searchsorted(firsts, start, side="right")) - 1
        of_text[i].append((start - firsts[i], length, period))
    for words, runs in zip(texts, of_text):
        yield _result(words, runs)


def _runs_of(seed: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows, texts, held = [], [], 0
    for number, value in zip(seed, text):
        words = value.encode().split()  # bytes are split at the six ASCII blanks only
        order = _order(int(number), len(words))
        texts.append(words if order is None else [words[i] for i in order])
        held += len(words)
        if held >= BATCH_WORDS:
            rows.extend(_searched(texts))
            texts, held = [], 0
    rows.extend(_searched(texts))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names, dtype=object)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "runs", planted: bool = False) -> DataFrame:
    """``docs`` with a column ``name``: struct(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A run is a
    stretch with smallest period p and at least max(24, 3p) words that no neighbouring word extends. start to exponent_milli
    are of the run that repeats most often, null without runs; collapsed_sha256 is of the text without the words after the
    first p of a run, one space between words. Null and empty texts have no words and no runs.

    With ``planted``, a tenth of the texts, by the CRC-32 of the id, first get a periodic end: a known answer for tests. Rows
    with a null id are left as they are. Every row is judged by itself: repeated rows get equal results. Rows keep their
    columns, a column called ``name`` is replaced, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    seed = F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(-1)) if planted else F.lit(-1)
    return docs.withColumn(name, F.pandas_udf(_runs_of, SCHEMA)(seed.cast("long"), whole_text(F.col(text))))
