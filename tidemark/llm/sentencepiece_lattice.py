"""Encoding and decoding with a piece model, as a relational lattice.

A task takes the distinct words of a batch of documents that it does not know yet and encodes them together. Their substrings
are joined with the piece table, one character longer at a time and only as long as some piece goes on; the matches (start,
size, id) are the edges of the words' lattices. A fold over all these lattices at once walks them:

* ``viterbi`` for models of the unigram kind: position by position, the best scored path that ends there;
* ``merges`` for models of the byte-pair kind, whose encoder does not look for the best sum of scores: it joins the best
  scored neighbours again and again. The fold starts with a cut between all characters and takes out, one after the other,
  the cut whose neighbours span the best scored edge.

The ids of a document are those of its words in order. Characters that no piece has are written as their bytes' pieces. The
ids of the words are joined with the pieces again, and the bytes compared with the words. Edges, cuts and ids are columns of
numpy and Arrow; documents stay where they are, so nothing is shuffled or written between.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from tidemark.llm.common import bounded_batches, whole_text
from tidemark.llm.tokens import SPACE, PieceModel

LONGEST_WORD = 64  # longer words, which the merges would take quadratic time for, are encoded from their prefixes
UNKNOWN_PENALTY = 10.0  # fixed value: how far below the worst piece an unknown character scores in the unigram kind
KNOWN_WORDS = 400_000  # words a worker remembers (some 110 MB); it starts anew beyond that
TOGETHER = 60_000  # characters of words whose lattices are walked together; a longer word is walked alone
NO_RANK = 1 << 30


class Lattice:
    """The piece table of a model, and the lattices of many words over it.

    Words lie one after the other in one array of characters, with a gap before, between and after them. Characters are
    numbered from 1; 0 is a gap or a character that no piece has.
    """

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.model = own = PieceModel(model)
        self.size, self.longest, self.unknown = library.get_piece_size(), own.longest, library.unk_id()
        self.first_byte = next((i for i in range(self.size) if library.is_byte(i)), -1)
        alphabet = sorted(own.alphabet)
        self.width = len(alphabet) + 1
        self.codes = np.zeros(0x110000, np.int16 if self.width < 1 << 15 else np.int32)
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, self.width)
        # what pieces begin with: row i of ``longer`` (prefix, next character) leads to prefix i + 1, 0 is the empty one
        prefixes, longer = {"": 0}, []
        for piece in own.ids:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in prefixes:
                    prefixes[piece[:end]] = len(prefixes)
                    longer.append(prefixes[piece[: end - 1]] * self.width + int(self.codes[ord(piece[end - 1])]))
        self.longer = pd.Index(np.array(longer, np.int64))
        self.piece_of = np.full(len(prefixes), -1, np.int32)
        self.piece_of[[prefixes[p] for p in own.ids]] = list(own.ids.values())
        # by id; the last row is that of id -1, no piece
        scores = np.array([own.scores[p] for p in own.ids])
        self.scores, self.ranks = np.full(self.size + 1, -np.inf), np.full(self.size + 1, NO_RANK, np.int64)
        self.scores[list(own.ids.values())] = scores
        self.ranks[list(own.ids.values())] = np.unique(-scores, return_inverse=True)[1]
        self.least = float(scores.min())
        self.bytes_of = pa.array([b"" if library.is_control(i) else _bytes_of(library, i) for i in range(self.size)] + [b""], pa.binary())

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """Id of the piece by start and size; -1 where the substring is none, and in the last column."""
        table = np.full((len(codes), self.longest + 2), -1, np.int32)
        start = np.flatnonzero(codes)
        prefix = np.zeros(len(start), np.int64)
        for size in range(1, self.longest + 1):
            prefix = self.longer.get_indexer(prefix * self.width + codes[start + (size - 1)]) + 1
            found = prefix > 0
            start, prefix = start[found], prefix[found]
            table[start, size] = self.piece_of[prefix]
        return table

    def merged_starts(self, edges: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the tokens start after the best scored neighbours have been joined again and again, in each word."""
        n = len(edges)
        after, before = np.arange(1, n + 2), np.arange(-1, n + 1)
        starts = np.ones(n, bool)

        def weigh(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Rank of the edge, and on a tie the first: less is better."""
            return (self.ranks[edges[start, np.minimum(end - start, self.longest + 1)]] << 32) + start

        joined = weigh(np.arange(n), np.arange(2, n + 2))  # by the start of the left one of two neighbours
        places = _ranges(first, sizes)
        while len(sizes):
            best = np.minimum.reduceat(joined[places], np.cumsum(sizes) - sizes)
            more = best < NO_RANK << 32
            if not more.all():
                places, sizes, best = places[np.repeat(more, sizes)], sizes[more], best[more]
            left = best & ((1 << 32) - 1)
            right = after[left]
            end = after[right]
            starts[right], after[left], before[end] = False, end, left
            joined[right] = NO_RANK << 32
            joined[left] = weigh(left, after[end])  # over a gap there is no edge
            joined[before[left]] = weigh(before[left], end)
        return starts

    def viterbi_starts(self, edges: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the tokens of the path with the largest sum of scores start, in each word."""
        best, origin = np.zeros(len(edges)), np.zeros(len(edges), np.int64)
        for at in range(1, int(sizes.max()) + 1):
            end = first[sizes >= at] + at
            top, source = np.full(len(end), -np.inf), end
            for size in range(min(at, self.longest), 0, -1):
                score = self.scores[edges[end - size, size]]
                if size == 1:  # a single character is always an edge, known or not
                    score = np.where(np.isinf(score), self.least - UNKNOWN_PENALTY, score)
                score = best[end - size] + score
                source, top = np.where(score >= top, end - size, source), np.maximum(score, top)
            best[end], origin[end] = top, source
        starts = np.zeros(len(edges), bool)
        place = first + sizes
        while len(place):
            place = origin[place]
            starts[place] = True
            place, first = place[place > first], first[place > first]
        return starts

    def encode(self, words: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Words, none of them empty -> their ids one after the other, and where each word's begin (and the last one's end)."""
        sizes = np.array([len(w) for w in words])
        first = np.cumsum(sizes + 1) - sizes
        points = np.zeros(int(first[-1] + sizes[-1]) + 1, np.uint32)
        points[_ranges(first, sizes)] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        gaps = np.append(0, first + sizes)
        codes = self.codes[points]
        codes[gaps] = 0
        edges = self.edges(codes)
        starts = (self.merged_starts if kind == "merges" else self.viterbi_starts)(edges, first, sizes)
        starts[gaps] = True
        start = np.flatnonzero(starts)
        ids = edges[start[:-1], np.diff(start)]
        each = np.ones(len(ids), np.int64)
        number = np.searchsorted(start, gaps)
        each[number[:-1]] = 0  # gaps are no tokens
        lone = (ids < 0) & (each > 0)
        ids[lone] = self.unknown
        if self.first_byte >= 0 and lone.any():
            coded = [chr(c).encode() for c in points[start[:-1][lone]]]
            each[lone] = [len(c) for c in coded]
            ids = np.repeat(ids, each)
            ids[np.repeat(lone, each)] = np.frombuffer(b"".join(coded), np.uint8).astype(np.int32) + self.first_byte
        else:
            ids = ids[each > 0]
        return ids, np.append(0, np.cumsum(each))[number]

    def encode_long(self, word: str) -> list[int]:
        """Ids by the last token of each prefix, for a word too long for the merges."""
        own, last = self.model, [""]
        for end in range(1, len(word) + 1):
            pieces = (word[s:end] for s in range(max(0, end - own.longest), end) if word[s:end] in own.reached)
            last.append(next((p for p in pieces if not last[end - len(p)] or own.apart(last[end - len(p)], p)), ""))
        coded, end = [], len(word)
        while end:
            if last[end]:
                coded.append([own.ids[last[end]]])
            else:
                coded.append([b + self.first_byte for b in word[end - 1].encode()] if self.first_byte >= 0 else [self.unknown])
            end -= len(last[end]) or 1
        return [i for code in reversed(coded) for i in code]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Ids one after the other and where each row's begin -> the rows' bytes, with the model's space as a space; ids of
        control pieces and ids that the model does not have count as nothing."""
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        pieces = self.bytes_of.take(pa.array(known))
        ends = np.append(0, np.cumsum(pc.binary_length(pieces).to_numpy(), dtype=np.int64))
        data = pieces.buffers()[2] or pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets]), data])


def _bytes_of(library: sentencepiece.SentencePieceProcessor, number: int) -> bytes:
    piece = library.id_to_piece(number)
    return bytes([int(piece[3:5], 16)]) if library.is_byte(number) else piece.replace(SPACE, " ").encode()


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Words a worker has encoded: their ids (four bytes each), and those whose ids do not decode to them."""

    def __init__(self, model: bytes, kind: str):
        self.lattice, self.kind = Lattice(model), kind
        self.known: dict[str, bytes] = {}
        self.failed: set[str] = set()

    def forget(self) -> None:
        self.known.clear()
        self.failed.clear()

    def learn(self, words: Iterable[str]) -> None:
        """Encode these distinct words and decode them again."""
        together, size = [], 0
        for word in words:
            if self.kind == "merges" and len(word) > LONGEST_WORD:
                ids = np.array(self.lattice.encode_long(word), np.int32)
                self._keep([word], ids, np.array([0, len(ids)]))
                continue
            if together and size + len(word) > TOGETHER:
                self._keep(together, *self.lattice.encode(together, self.kind))
                together, size = [], 0
            together.append(word)
            size += len(word)
        if together:
            self._keep(together, *self.lattice.encode(together, self.kind))

    def _keep(self, words: list[str], ids: np.ndarray, offsets: np.ndarray) -> None:
        coded, ends = ids.astype(np.int32, copy=False).tobytes(), (offsets * 4).tolist()
        self.known.update((w, coded[a:b]) for w, a, b in zip(words, ends, ends[1:]))
        meant = pa.array([w.replace(SPACE, " ").encode() for w in words], pa.large_binary())
        same = pc.equal(self.lattice.decode(ids, offsets), meant).to_numpy(zero_copy_only=False)
        self.failed.update(words[i] for i in np.flatnonzero(~same))

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Texts -> their ids, and whether the ids of their words decode to the words."""
        find, known = self.lattice.model.words.findall, self.known
        if len(known) > KNOWN_WORDS:
            self.forget()
        split = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(known)
        self.learn(new)
        coded = [b"".join(map(known.__getitem__, words)) for words in split]
        right = [not self.failed or self.failed.isdisjoint(words) for words in split]
        for word in new:
            if len(word) > LONGEST_WORD:
                del known[word]
                self.failed.discard(word)
        return _lists(coded), pa.array(right, pa.bool_())


def _lists(coded: list[bytes]) -> pa.Array:
    """Ids of four bytes each -> an array of ids in each row."""
    offsets = np.append(0, np.cumsum([len(c) // 4 for c in coded])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(model: bytes, kind: str) -> Encoder:
    key = hash(model), kind
    if key not in _encoders:
        _encoders[key] = Encoder(model, kind)
    return _encoders[key]


def encode_words(words: DataFrame, model: bytes, kind: str = "merges") -> DataFrame:
    """Words (word) -> (word, ids). An empty word has none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, kind)
        for batch in batches:
            column = batch.column("word").to_pylist()
            encoder.forget()
            encoder.learn({w for w in column if w})
            yield pa.RecordBatch.from_arrays([batch.column("word"), _lists([encoder.known.get(w, b"") for w in column])], ["word", "ids"])

    bounded_batches(words.sparkSession)
    return words.select("word").mapInArrow(made, "word string, ids array<int>")


def decode_ids(rows: DataFrame, model: bytes, key: str = "word", ids: str = "ids", name: str = "decoded") -> DataFrame:
    """(key, ids) -> (key, decoded): the pieces' bytes in order, with the model's space as a space; ids of control pieces are
    left out. Ids that the model does not have count as nothing, and so do nulls."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        for batch in batches:
            column = batch.column(1)
            numbers = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lattice.decode(numbers, offsets).cast(pa.large_string()).cast(pa.string())], [key, name])

    picked = rows.select(key, ids)
    bounded_batches(rows.sparkSession)
    return picked.mapInArrow(made, StructType([picked.schema[0]]).add(name, StringType()))


def encode(docs: DataFrame, model: bytes, kind: str = "merges", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key, ids, and round_trip (do the ids of its words decode to the words?).

    Null text counts as empty and has no ids. Rows are not moved, so repeated keys and null keys are rows of their own;
    other columns may have any name. A word of any length is encoded; a document's ids are gathered in its row.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, kind)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *encoder.encode(batch.column(1).to_pylist())], [key, "ids", "round_trip"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(key, whole_text(F.col(text)).alias("_text"))
    schema = StructType([rows.schema[0]]).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType())
    return rows.mapInArrow(made, schema)
