import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import sentencepiece_lattice as lattice
from tidemark.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = tokens.read_model(PATH)
ODD = ["", "a", " ", "  hello   world ", "a\nb\tc\n\n d", "日本語 テスト", "éé x", "\x00a", "▁x▁▁y", "<s></s><unk>", "a" * 100, "=" * 90, "\U0001f600 hi\U0001f600"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_every_prefix_as_the_library(library):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("ab \n▁é日Theing") for _ in range(70)) for _ in range(60)]
    for text, deltas in zip(texts, tokens.PrefixCounter(MODEL).deltas(texts)):
        counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=int)
        assert [int(counts[i]) if i else 0 for i in range(len(text) + 1)] == [len(library.encode(text[:i])) for i in range(len(text) + 1)]


def test_counts_and_budgets(spark, odd_docs, no_docs, library):
    counted = tokens.prefix_counts(odd_docs, PATH)
    assert counted.columns == [*odd_docs.columns, "tokens"]
    for r in counted.collect():
        assert (r.tokens.n_bytes, r.tokens.n_tokens) == (len((r.text or "").encode()), len(library.encode(r.text or "")))
    asked = counted.where("length(text) > 20").select("text", tokens.tokens_of_prefix("tokens.deltas", F.lit(9)).alias("n"), tokens.prefix_within("tokens.deltas", F.lit(5)).alias("c"))
    for r in asked.collect():
        assert r.n == len(library.encode(r.text[:9]))
        assert r.c == max(i for i in range(min(len(r.text), 200) + 1) if len(library.encode(r.text[:i])) <= 5)
    assert tokens.prefix_counts(no_docs, PATH).count() == 0


def test_lattice_encodes_as_the_library(spark, odd_docs, no_docs, library):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for docs in (rows, odd_docs):
        coded = lattice.encode(docs.repartition(1).select("doc_id", "text"), MODEL).collect()
        assert sorted(str((r.doc_id, r.ids)) for r in coded) == sorted(str((r.doc_id, library.encode(r.text or ""))) for r in docs.collect())
        assert all(r.round_trip for r in coded)
    assert lattice.encode(no_docs, MODEL).count() == 0


def best_path(text, scores, least):
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            score = scores.get(text[start:end], least - lattice.UNKNOWN_PENALTY if end - start == 1 else None)
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_viterbi_finds_the_best_sum(spark, library):
    scores = tokens.PieceModel(MODEL).scores
    texts = ["▁" + t for t in ["hello", "thebleer", "international", "unbelievable", "Strasse", "zzzq", "the", "a日b", "xĀy"]]
    words = spark.createDataFrame([(t,) for t in texts], "word string")
    got = {r.word: r.ids for r in lattice.encode_words(words, MODEL, "viterbi").collect()}
    for t in texts:
        known = [i for i in got[t] if not library.is_byte(i)]
        unknown = sum(c not in scores for c in t)
        score = sum(library.get_score(i) for i in known) + unknown * (min(scores.values()) - lattice.UNKNOWN_PENALTY)
        assert score == best_path(t, scores, min(scores.values())) and library.decode(got[t]) == t[1:]


def test_decode(spark, library):
    texts = ["a b", "日本 x", "\x01\x02", "  two"]
    rows = spark.createDataFrame([(i, library.encode(t)) for i, t in enumerate(texts)] + [(99, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in lattice.decode_ids(rows, MODEL, "k").collect()}
    assert got == {i: " " + t for i, t in enumerate(texts)} | {99: ""}


def test_encoding_moves_and_writes_nothing(odd_docs):
    """Every occurrence of a word went through two shuffles, and the words' ids through two written tables."""
    coded = lattice.encode(odd_docs, MODEL)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan


def made_texts(draw, n):
    syllables = ["the", "er", "Un", "ing", "é", "ß", "日本", "\U0001f600", "12", "&&", "\n", "\n\n", " ", "  ", "▁", "\x00", "\t", "tion"]
    return ["".join(draw.choice(syllables) for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("known, together", [(lattice.KNOWN_WORDS, lattice.TOGETHER), (20, 40), (0, 1)])
def test_words_of_many_texts_are_encoded_together_as_the_library(monkeypatch, library, known, together):
    monkeypatch.setattr(lattice, "KNOWN_WORDS", known)
    monkeypatch.setattr(lattice, "TOGETHER", together)
    encoder, texts = lattice.Encoder(MODEL, "merges"), made_texts(random.Random(7), 300) + ODD
    for at in range(0, len(texts), 50):
        ids, right = encoder.encode(texts[at : at + 50])
        assert ids.to_pylist() == [library.encode(t) for t in texts[at : at + 50]]
        assert all(right.to_pylist())
    assert all(len(w) <= lattice.LONGEST_WORD for w in encoder.known)


def test_edges_are_the_substrings_that_are_pieces():
    walked, scores = lattice.Lattice(MODEL), tokens.PieceModel(MODEL).scores
    words = ["▁the", "ing", "\n", "▁日本x", "\u0100", "tion"]
    text = "\0" + "\0".join(words) + "\0"  # no piece has this character
    edges = walked.edges(walked.codes[[ord(c) for c in text]])
    got = {(int(s), int(n)): int(edges[s, n]) for s, n in zip(*np.nonzero(edges >= 0))}
    ids = tokens.PieceModel(MODEL).ids
    assert got == {(s, n): ids[text[s : s + n]] for s in range(len(text)) for n in range(1, walked.longest + 1) if text[s : s + n] in scores and s + n <= len(text)}


def test_ids_that_decode_to_another_word_are_told():
    encoder = lattice.Encoder(MODEL, "merges")
    the = encoder.lattice.model.ids["▁the"]
    pieces = encoder.lattice.bytes_of.to_pylist()
    encoder.lattice.bytes_of = lattice.pa.array([b" tha" if i == the else p for i, p in enumerate(pieces)], lattice.pa.binary())
    for _ in range(2):  # learned, then remembered
        assert encoder.encode(["the", "a the b", "thethe", "a b", ""])[1].to_pylist() == [False, False, False, True, True]
