"""Packing token sequences by lexical retrieval.

Documents are encoded once and written. How many documents have a token, and the mean length, are counted over all of them.
Every document then gets a key, its rarest tokens that others have too, and the whole table is sorted by it, so documents
that share rare tokens come together wherever they were read. Shards are cut from this order, up to a bound on tokens.

A shard has an inverted index of its documents' token ids with BM25 weights. A window is filled greedily: it begins with a
seed, the seed's terms are looked up, and of the neighbours that are not used yet the best scored are taken, as long as
they fit. What no neighbour fits into is filled with the head of the best one, whose rest opens the next window, so
windows have no padding; the last tokens of a shard go into windows whose lengths are powers of two.

Shards never wait for one another. A neighbour that shares none of a document's rarest tokens can be in another shard: the
README gives the share of neighbours that are found.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, first_row_number, whole_text
from tidemark.session import materialise

WINDOW = 4096
END_ID = 2
#: Tokens and documents of a shard: what one index holds in memory (16 MB of ids), whatever the size of the input.
SHARD_TOKENS, SHARD_DOCS = 4 << 20, 4096
KEY_TERMS = 4  # rarest tokens in the key by which documents are sorted
K1, B = 1.2, 0.75
CACHED_WORDS = 600_000  # some 80 MB of a worker
TEXTS = 2048  # parted together
CACHED_LENGTH = 64
PIECE = "position long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The tokenizer's own pattern for what it encodes separately is ``'s|'t|'re|'ve|'m|'ll|'d``, letters, one digit, or
#: what is neither white space, letter nor digit; here the kinds of characters in plain texts of lower case.
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space to one library and not to the other
_TEXT_END = "\x1c"  # plain texts have none
_SPACES = b"\t\n\v\f\r "
_SPACE, _LETTER, _MARK, _ALONE = range(4)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[[*_SPACES]] = _SPACE
_KINDS[[*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KINDS[[*b"0123456789", ord(_TEXT_END)]] = _ALONE
_KIND_OF = _KINDS.tobytes()
_PLAIN = bytes([*range(0x80), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)).difference(_PRINTING)))}
#: How the model writes each character of Latin-1: it has the bytes of UTF-8 as characters.
_WRITTEN = [chr(b).encode().decode("latin-1").translate(_BYTE_LETTERS) for b in range(0x100)]


def _latin(text: str) -> bool:
    """Has the text no characters but ASCII and Latin-1 letters?"""
    try:
        return text.isascii() or not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def _plain(text: str) -> bool:
    return "<|" not in text and not any(c in text for c in _SEPARATORS) and _latin(text)


def text_parts(texts: list[str]) -> pa.BinaryArray:
    """What the tokenizer encodes separately, in Latin-1, of plain texts one after the other; a text ends with ``_TEXT_END``."""
    coded = (_TEXT_END.join(texts) + _TEXT_END * 2).encode("latin-1").translate(_LOWER)
    text, kinds = np.frombuffer(coded, np.uint8), np.frombuffer(coded.translate(_KIND_OF), np.uint8)
    begins = kinds == _ALONE
    begins[0] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    quotes = np.flatnonzero((text[:-2] == ord("'")) & begins[:-2])
    one, two = text[quotes + 1], text[quotes + 2]
    size = np.isin(one, [*b"stmd"]) + 2 * ((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l")))
    quotes, size = quotes[size > 0], size[size > 0]
    begins[quotes + 1] = False  # belongs to the quote
    begins[quotes + 1 + size] = True
    shown = kinds != _SPACE
    shown[-1] = False
    offsets = np.append(np.flatnonzero(begins[shown]), np.count_nonzero(shown)).astype(np.int32)
    parts = coded.translate(None, _SPACES)  # the last of the two ends is beyond the offsets
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(parts)])


@lru_cache(maxsize=1)
def _library(tokenizer: str):
    """The tokenizer, read once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer)


class Encoder:
    """Ids of a text as little-endian unsigned numbers of 32 bits (or as ``kind`` says), then ``END_ID``.

    The tokenizer lowers the case, parts the text by its pattern and has its model encode each part on its own, so texts are
    parted together and the model gets a part once as long as it is remembered. Texts with characters beyond Latin-1 letters, for
    which normal forms and classes matter, or with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, tokenizer: str, kind: str = "<u4"):
        self._tokenizer = _library(tokenizer)
        self._model = self._tokenizer.model
        self._kind = np.dtype(kind)
        self._known: dict[bytes, bytes] = {}
        self._end = np.array([END_ID], kind).tobytes()

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self._kind).tobytes() + self._end for e in found]

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        data, ids, ends = list(map(self._known.get, parts)), [], []
        new = [i for i, found in enumerate(data) if found is None]
        tokenize = self._model.tokenize
        for i in new:
            part = parts[i]
            ids += [t.id for t in tokenize(part.decode() if part.isalpha() else "".join([_WRITTEN[b] for b in part]))]
            ends.append(len(ids))
        coded, size = np.array(ids, self._kind).tobytes(), self._kind.itemsize
        begin = 0
        for i, end in zip(new, ends):
            data[i] = coded[begin * size : end * size]
            begin = end
        if len(self._known) + len(new) > CACHED_WORDS:  # of all words, those of these texts are the likeliest to come again
            self._known.clear()
            new = range(min(len(parts), CACHED_WORDS))
        self._known.update((parts[i], data[i]) for i in new if len(parts[i]) <= CACHED_LENGTH)
        return data

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        parts = text_parts(texts).dictionary_encode()
        known = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._encode_parts(known), pa.large_binary()).take(parts.indices)
        _, offsets, data = ids.buffers()
        end = known.index(_TEXT_END.encode())
        ends = np.frombuffer(offsets, np.int64)[1 : len(ids) + 1][parts.indices.to_numpy() == end].tolist()
        data = memoryview(data)
        return [bytes(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        self._known[_TEXT_END.encode()] = self._end
        out = [b""] * len(texts)
        plain = [_plain(t) for t in texts]
        for way, coded in ((True, self._encode_plain), (False, self._encode_whole)):
            chosen = [i for i, p in enumerate(plain) if p is way]
            if chosen:
                for i, ids in zip(chosen, coded([texts[i] for i in chosen])):
                    out[i] = ids
        return out


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, kind: str) -> Encoder:
    """The encoder of a worker, with the parts that it remembers from earlier tasks."""
    return Encoder(tokenizer, kind)


def distinct(ids: np.ndarray) -> np.ndarray:
    """The different numbers, rising; those of 16 bits are sorted in linear time."""
    ids = np.sort(ids, kind="stable")
    begins = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=begins[1:])
    return ids[begins]


@dataclass
class Corpus:
    """Of all documents: their number, their mean length, and for each token how many have it."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        terms = np.concatenate([distinct(d) for d in docs])
        return cls(len(docs), float(np.mean([len(d) for d in docs])), np.bincount(terms))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        """BM25 weights; nothing for a term that half of the documents have or that only one has."""
        df = self.df[terms]
        return np.where(df < 2, 0.0, np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 0.0))

    @cached_property
    def rarity(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that more than one document has, rarest first (ties by the id), and each token's place among them; those that
        no two documents have come after all others."""
        order = np.lexsort((np.arange(len(self.df)), np.where(self.df > 1, self.df, np.iinfo(np.int64).max)))
        place = np.empty(len(order), "<u2" if len(order) <= 1 << 16 else "<u4")
        place[order] = np.arange(len(order))
        return order[: np.count_nonzero(self.df > 1)].astype(">u4"), place

    def key(self, ids: np.ndarray) -> bytes:
        """The rarest tokens that other documents have too, rarest first."""
        shared, place = self.rarity
        places = distinct(place[ids])[:KEY_TERMS]
        return shared[places[places < len(shared)]].tobytes()


class Index:
    """Inverted index of a shard: for each term the documents that have it, with BM25 weights by the whole corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(docs)
        self.n, self.ids = len(docs), docs
        lengths = np.array([len(d) for d in docs])
        both = np.concatenate(docs).astype(np.int64)  # token and document in one number, sorted in place
        both <<= 32
        both |= np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        both.sort()
        begins = np.ones(len(both), bool)  # of each (term, document)
        np.not_equal(both[1:], both[:-1], out=begins[1:])
        postings = np.flatnonzero(begins)
        times = np.diff(np.append(postings, len(both))).astype(np.float32)
        both = both[postings]
        del begins, postings
        self.docs = (both & 0xFFFFFFFF).astype(np.int32)
        both >>= 32
        self.first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        self.last = np.append(self.first[1:], len(both))
        self.terms = both[self.first].astype("<u4")
        del both
        norm = K1 * (1 - B + B * lengths / max(corpus.mean, 1.0))
        idf = corpus.idf(self.terms)
        self.strong = idf > 0
        self.weights = np.repeat(idf.astype(np.float32), self.last - self.first)
        self.weights *= times * np.float32(K1 + 1) / (times + norm[self.docs].astype(np.float32))

    def scores(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Score of each document against the seed; nothing for used ones and for those that share no term of some weight."""
        at = np.searchsorted(self.terms, distinct(self.ids[seed]))
        shared = at[self.strong[at]]
        if not len(shared):
            return np.zeros(self.n)
        spans = [slice(*x) for x in zip(self.first[shared].tolist(), self.last[shared].tolist())]
        docs, weights = (np.concatenate([column[x] for x in spans], dtype=kind) for column, kind in ((self.docs, np.int64), (self.weights, np.float64)))
        scores = np.bincount(docs, weights, self.n)
        scores[used] = 0
        return scores

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term of some weight with the seed, best first, ties to the earlier document."""
        scores = self.scores(seed, used)
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id once."""
    sequences: list[list[tuple[int, int, int]]] = []
    n = len(docs)
    left = np.zeros(n, np.int64)  # where the unpacked rest of each document begins
    size = np.array([len(d) for d in docs], np.int64)
    for i in range(n):  # whole windows of long documents
        while size[i] - left[i] >= window:
            sequences.append([(i, int(left[i]), window)])
            left[i] += window
    used = left >= size
    if used.all():
        return sequences
    index = Index(docs, corpus)
    order = np.argsort(-(size - left), kind="stable")  # longest rests first
    pending, carried = 0, -1
    while True:
        if carried >= 0:
            seed, carried = carried, -1
        else:
            while pending < n and used[order[pending]]:
                pending += 1
            if pending == n:
                break
            seed = int(order[pending])
        used[seed] = True
        sequence = [(seed, int(left[seed]), int(size[seed] - left[seed]))]
        room = window - sequence[0][2]
        scores = index.scores(seed, used)
        while room:  # the best one that fits, ties to the earlier document
            d = int(np.where(size - left <= room, scores, 0).argmax())
            rest = int(size[d] - left[d])
            if not scores[d] or rest > room:
                break
            sequence.append((d, int(left[d]), rest))
            used[d], scores[d] = True, 0
            room -= rest
        if room:  # no neighbour fits: cut the best one that is left, or the next document
            d = int(scores.argmax())
            if not scores[d]:
                d = -1
            at = pending
            while d < 0 and room and at < n:
                c = int(order[at])
                at += 1
                if used[c]:
                    continue
                rest = int(size[c] - left[c])
                if rest <= room:
                    sequence.append((c, int(left[c]), rest))
                    used[c] = True
                    room -= rest
                else:
                    d = c
            if d >= 0 and room:
                sequence.append((d, int(left[d]), room))
                left[d] += room
                room, carried = 0, d
        sequences.append(sequence)
        if room:  # the shard is used up
            sequences[-1:] = powers_of_two(sequence)
    return sequences


def powers_of_two(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are powers of two, longest first."""
    total, queue, out = sum(p[2] for p in sequence), list(reversed(sequence)), []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            d, start, length = queue.pop()
            take = min(length, room)
            out[-1].append((d, start, take))
            room -= take
            if take < length:
                queue.append((d, start + take, length - take))
    return out


def count_corpus(encoded: DataFrame, kind: str, vocabulary: int) -> Corpus:
    """Counts over all documents. The driver gets a row per token of the vocabulary, whatever the size of the input."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, tokens = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            docs = [np.frombuffer(data, kind) for data in batch["_ids"]]
            if docs:
                df += np.bincount(np.concatenate([distinct(d) for d in docs]), minlength=vocabulary)
            n, tokens = n + len(docs), tokens + sum(map(len, docs))
        terms = np.flatnonzero(df)
        yield pd.DataFrame({"term": [-2, -1, *terms], "n": [n, tokens, *df[terms]]}).astype("int64")

    rows = encoded.select("_ids").mapInPandas(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(vocabulary, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    n = found.get(-2, 0)
    return Corpus(n, found.get(-1, 0) / max(n, 1), df)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces of all documents: ``keys``, position (of the row in its shard), start (in the document), length, ids_crc32
    (of the piece's ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (in the sequence).

    A sequence has ``window`` ids, or a power of two of them at the end of a shard. Null text counts as empty and has its
    end id alone. Every row is packed: repeated rows, null keys and ties give a document each. A text that is longer than
    a shard is a shard of its own. Documents with one key, however many, are parted by their row number.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()  # two megabytes, sent with the task
    from tokenizers import Tokenizer

    vocabulary = max(END_ID, *Tokenizer.from_str(tokenizer).get_vocab().values()) + 1
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    broadcast = spark.sparkContext.broadcast(tokenizer)
    names = [f"_k{i}" for i in range(len(keys))]
    types = [t for _, t in docs.select(*keys).dtypes]
    kept = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    whole = {n: "Int64" for n, t in zip(names, types) if t in ("bigint", "int", "smallint", "tinyint")}

    def encoded_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, row = _encoder(broadcast.value, kind), first_row_number()
        for batch in batches:
            texts = batch.pop("_text").tolist()
            data = [x for at in range(0, len(texts), TEXTS) for x in encoder.encode(texts[at : at + TEXTS])]
            made = batch.astype(whole)
            made["_row"] = np.arange(row, row + len(texts))
            made["_ids"] = data
            row += len(texts)
            yield made

    read = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], whole_text(F.col(text)).alias("_text"))
    encoded = materialise(read.mapInPandas(encoded_rows, f"{kept}, _row long, _ids binary"), "token_ids")
    counts = spark.sparkContext.broadcast(count_corpus(encoded, kind, vocabulary))

    @F.pandas_udf("binary")
    def key_of(ids: pd.Series) -> pd.Series:
        return pd.Series([counts.value.key(np.frombuffer(x, kind)) for x in ids], dtype=object)

    laid = encoded.withColumn("_key", key_of("_ids"))
    laid = laid.repartitionByRange("_key", "_row").sortWithinPartitions("_key", "_row").drop("_key", "_row")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus, sequence_id = counts.value, first_row_number()
        shard: list[np.ndarray] = []
        owners: list[tuple] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal sequence_id
            rows = []
            for sequence in pack_shard(shard, window, corpus):
                offset = 0
                for d, start, length in sequence:
                    crc = zlib.crc32(shard[d][start : start + length].astype("<u4").tobytes())
                    rows.append((*owners[d], d, start, length, crc, len(shard[d]), sequence_id, offset))
                    offset += length
                sequence_id += 1
            return pd.DataFrame(rows, columns=[*names, *columns]).astype(whole)

        for batch in batches:
            ids_of = batch[names].astype(object).where(batch[names].notna(), None).itertuples(index=False, name=None)
            for owner, data in zip(ids_of, batch["_ids"]):
                ids = np.frombuffer(data, kind)
                if shard and (tokens + len(ids) > SHARD_TOKENS or len(shard) >= SHARD_DOCS):
                    yield flush()
                    shard, owners, tokens = [], [], 0
                shard.append(ids)
                owners.append(owner)
                tokens += len(ids)
        if shard:
            yield flush()

    columns = [part.split()[0] for part in PIECE.split(", ")]
    return laid.mapInPandas(packed, f"{kept}, {PIECE}").select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *columns)
