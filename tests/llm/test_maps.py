"""Toxicity, language, packing, sharding and page text."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import html_text, language_id, packing, sharding, toxicity
from tidemark.llm.common import held_out

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# toxicity


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"clown": 5.0, "scum": 4.0, "stupi*": 3.0}, ["circus clown"])
    for text in ("You CLOWN!", "a cl0wn", "сlоwn", "ｃｌｏｗｎ", "$cum", "clówn"):
        assert lexicon.matches(toxicity.fold(text))[1] == 1, text
    for text in ("the circus clown", "clowning", "uncl0wn", "scums", "", "100% scu m"):
        assert lexicon.matches(toxicity.fold(text))[1] == 0, text
    assert lexicon.matches(toxicity.fold("stupidity and stupid")) == (6.0, 2)
    assert lexicon.score("scum " + "fine words " * 2000)[0] < lexicon.score("scum")[0]


def plain_matches(lexicon, text):
    """Every entry looked for at every word, the words of exceptions left out."""
    spared = {i for p in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_])(?={re.escape(p)}(?![^\W_]))", text) for i in range(m.start(), m.start() + len(p))}
    total, n = 0.0, 0
    for m in re.finditer(r"[^\W_]+", text):
        fits = [w for e, w in lexicon.weights.items() if (m[0].startswith(e[:-1]) if e.endswith("*") else m[0] == e)]
        if fits and m.start() not in spared:
            total, n = total + max(fits), n + 1
    return total, n


def test_matcher_as_plain_search(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(docs, labels))
    texts = [toxicity.fold(r.text) for r in docs.where("text is not null").collect()]
    pairs = Counter(p for t in texts for p in toxicity.Lexicon(lexicon.weights).phrases(t))
    lexicon = toxicity.Lexicon(lexicon.weights, sorted(pairs)[::2])
    assert lexicon.weights and lexicon.exceptions
    for text in texts:
        total, n = lexicon.matches(text)
        want, m = plain_matches(lexicon, text)
        assert n == m and abs(total - want) < 1e-9


def test_exceptions_are_learned(spark):
    rows = [(f"you vile thing {i}", 1) for i in range(60)] + [(f"the vile river flows {i}", 0) for i in range(20)] + [(f"fine weather {i}", 0) for i in range(380)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "vile" in lexicon.weights and "vile river" in lexicon.exceptions and "vile thing" not in lexicon.exceptions
    assert lexicon.score("along the vile river")[1] == 0 and lexicon.score("a vile man")[1] == 1
    assert toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), ["vile man"]).exceptions == ["vile man"]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(docs, labels.where(~held_out(F.col("doc_id")))))
    scored = toxicity.score_toxicity(docs, lexicon).join(labels.where(held_out(F.col("doc_id"))), "doc_id")
    seen = Counter((r.toxic, r.toxicity.score >= toxicity.THRESHOLD) for r in scored.collect())
    assert seen[0, True] <= 0.03 * (seen[0, True] + seen[0, False])
    assert seen[1, True] >= 0.6 * (seen[1, True] + seen[1, False])


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(odd_docs, labels))
    scored = toxicity.score_toxicity(odd_docs, lexicon)
    assert scored.columns == [*odd_docs.columns, "toxicity"]
    assert all(0 <= r.toxicity.score <= 1 for r in scored.collect())
    empty = toxicity.learn_lexicon(toxicity.labelled_sample(no_docs, labels))
    assert empty.weights == {} and toxicity.score_toxicity(no_docs, empty).count() == 0


# language


def test_codewords_differ():
    for n in (2, 3, 4, 5, 12, 40):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len(code) == n and min(apart) >= max(1, code.shape[1] // 5)


def test_letters():
    assert [language_id.has_letter(t) for t in ("", "12 _", "²Ⅷ", "² a", "é", "字")] == [False, False, False, True, True, True]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn_languages(language_id.labelled_sample(docs.where(~held_out(F.col("doc_id")))))
    found = language_id.identify_language(docs.where(held_out(F.col("doc_id"))), model).collect()
    assert sum(r.lang == r.language.lang for r in found) >= 0.98 * len(found)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.learn_languages(language_id.labelled_sample(odd_docs))
    found = language_id.identify_language(odd_docs, model)
    assert found.columns == [*odd_docs.columns, "language"]
    for r in found.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.language.lang in model.languages) if lettered else (r.language.lang, r.language.ambiguous) == ("und", True)
        assert 0 <= r.language.score <= 1
    none = language_id.learn_languages(language_id.labelled_sample(no_docs))
    assert {r.language.lang for r in language_id.identify_language(odd_docs, none).collect()} == {"und"}
    one = language_id.learn_languages(language_id.labelled_sample(odd_docs.where("lang = 'en'")))
    assert one.predict(["words"])[0][0] == "en"


def test_every_label_is_learned(spark):
    """More than 200 labels, each with words of its own."""
    rows = [(3 * i + j, f"l{i:03d}", " ".join(f"{chr(0x4E00 + 7 * i)}{chr(0x4E03 + 7 * i)}" for _ in range(20))) for i in range(230) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.learn_languages(language_id.labelled_sample(docs))
    assert len(model.languages) == 230
    texts = [r[2] for r in rows[::3]]
    assert sum(p[0] == r[1] for p, r in zip(model.predict(texts), rows[::3])) >= 220


# packing


def check_pieces(pieces, texts, window):
    """``texts`` in the order of (shard, position): pieces hold every id once and sequences have no padding."""
    tokenizer = Tokenizer.from_file(WORDS)
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.key].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert set(documents) == set(texts)
    for key, parts in documents.items():
        ids = np.array(tokenizer.encode(texts[key], add_special_tokens=False).ids + [packing.END_ID], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_packing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select(F.col("doc_id").alias("key"), "text")
    texts = {r.key: r.text for r in docs.collect()}
    for window in (4096, 512):
        check_pieces(packing.pack(docs, WORDS, window, keys=("key",)).collect(), texts, window)


def test_packing_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.repartition(1).withColumn("key", F.monotonically_increasing_id())
    docs.write.mode("overwrite").parquet(path := spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/odd_packing")
    docs = spark.read.parquet(path)
    pieces = packing.pack(docs, WORDS, keys=("key", "doc_id"))
    check_pieces(pieces.collect(), {r.key: r.text or "" for r in docs.collect()}, 4096)
    assert pieces.where("doc_id is null").select("key").distinct().count() == docs.where("doc_id is null").count()
    assert packing.pack(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("text", ["It's we'LL don't", "<|endoftext|> x", "日本 é é ß Σς", "x\x1cy z", "12345 ²³ª", "__a--", "''s", "", "a" * 300])
def test_ids_are_the_tokenizers(text):
    with open(WORDS, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids + [packing.END_ID]
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


def test_texts_are_parted_together_as_the_tokenizer_parts_them():
    draw = np.random.default_rng(6)
    signs = [chr(c) for c in range(33, 127)] + list("ÀÉßéÿ") + [" ", "\n", "\t ", "'s", "'LL", "'ve", "''", "n't", "the", "9.", "...", "\x00", "\x7f"]
    texts = ["", "a" * 70, "'", "x'r", *["".join(draw.choice(signs, draw.integers(1, 40))) for _ in range(3000)]]
    texts = [t for t in texts if packing._plain(t)]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
    want = [part.encode("latin-1") for t in texts for part in [*re.findall(pattern, t.lower()), "\x1c"]]
    assert packing.text_parts(texts).to_pylist() == want
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read(), "<u2")
    coded = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert coded == [e.ids + [packing.END_ID] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_part_goes_to_the_model_once():
    with open(WORDS, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    given, model = [], encoder._model

    class Counting:
        def tokenize(self, part):
            given.append(part)
            return model.tokenize(part)

    encoder._model, encoder._tokenizer = Counting(), None  # no plain text is parted by the library
    first = encoder.encode(["Some words, some more.", "more words"] * 50)
    assert sorted(given) == [",", ".", "more", "some", "words"]
    assert encoder.encode(["words more", "Some words, some more."])[1] == first[0] and len(given) == 5


def test_parts_are_remembered_from_task_to_task_and_the_latest_when_there_are_too_many(monkeypatch):
    with open(WORDS, encoding="utf-8") as file:
        tokenizer = file.read()
    encoder = packing._encoder(tokenizer, "<u2")
    first = encoder.encode(["some words"])
    assert packing._encoder("".join(tokenizer), "<u2") is encoder and {b"some", b"words"} <= set(encoder._known)
    monkeypatch.setattr(packing, "CACHED_WORDS", 6)
    encoder._known.clear()
    for text in ("some words", "one two three", "some other"):
        encoder.encode([text])
    assert set(encoder._known) == {b"some", b"other", b"\x1c"}
    assert encoder.encode(["some words"]) == first


def test_a_window_takes_the_best_neighbours_that_fit():
    """Against a plain version that sorts all neighbours, on shards of many sizes, with repeated documents and ties."""
    draw = np.random.default_rng(8)
    for n in (1, 2, 40, 120):
        docs = [np.minimum(draw.zipf(1.4, draw.integers(1, 50)), 900).astype("<u2") for _ in range(n)]
        docs += docs[: n // 3]
        corpus, used = packing.Corpus.of(docs), np.zeros(len(docs), bool)
        index = packing.Index(docs, corpus)
        sequences = packing.pack_shard(docs, 64, corpus)
        taken, rest = Counter(), [len(d) for d in docs]
        for sequence in sequences:
            if sum(p[2] for p in sequence) < 64:
                break  # the end of the shard
            used[[d for d, r in enumerate(rest) if not r]] = True
            used[sequence[0][0]] = True
            near, room, want = index.neighbours(sequence[0][0], used).tolist(), 64 - sequence[0][2], []
            for d in near:
                if rest[d] <= room:
                    want.append((d, taken[d], rest[d]))
                    room -= rest[d]
            cut = [d for d in near if d not in {w[0] for w in want}]
            if room and cut:
                want.append((cut[0], taken[cut[0]], room))
            if near:
                assert sequence[1 : 1 + len(want)] == want
            for d, _, length in sequence:
                taken[d] += length
                rest[d] -= length


def test_key_is_the_rarest_shared_tokens():
    draw = np.random.default_rng(7)
    docs = [np.minimum(draw.zipf(1.3, draw.integers(1, 60)), 49_000).astype("<u2") for _ in range(400)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    corpus = packing.Corpus.of(docs)
    for d in docs:
        rarest = sorted({t for t in d.tolist() if df[t] > 1}, key=lambda t: (df[t], t))[: packing.KEY_TERMS]
        assert corpus.key(d) == np.array(rarest, ">u4").tobytes()


def test_neighbours_share_rare_terms():
    docs = [np.array(x, "<u4") for x in ([1, 2, 3, 90, 91], [1, 7], [4, 90, 91], [1, 5], [6])]
    index = packing.Index(docs)
    assert index.neighbours(0, np.array([True, False, False, False, False])).tolist()[0] == 2
    assert index.neighbours(4, np.zeros(5, bool)).tolist() == []


def test_terms_are_weighed_by_the_corpus_and_none_is_left_out():
    docs = [np.array([*range(100, 140), 7, 8], "<u4"), np.array([7, 8, 1], "<u4"), np.array([2, 3], "<u4")]
    df = np.full(200, 5)  # forty terms of the seed are rarer than those that it shares
    df[[7, 8]] = 6
    assert packing.Index(docs, packing.Corpus(100, 10.0, df)).neighbours(0, np.array([True, False, False])).tolist() == [1]


def test_related_documents_meet_wherever_they_are(spark, monkeypatch):
    """Pairs that share rare words, one of each pair in the first partition and one in the last, in shards of few documents."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 8)
    rare = [f"{a}{b}" for a in ("volcano", "harbour", "quantum", "penguin", "granite") for b in ("zq", "xw", "vj", "kx")]
    rows = [(i, f"{rare[i % 20]} {rare[i % 20]} " + "the same old words of all " * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "key long, text string").repartitionByRange(2, "key")
    pieces = packing.pack(docs, WORDS, 320, keys=("key",)).collect()
    sequences = defaultdict(set)
    for p in pieces:
        sequences[p.key].add(p.sequence_id)
    assert sum(bool(sequences[i] & sequences[i + 20]) for i in range(20)) >= 15


# sharding


def test_sharding(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for table, shards in ((docs, 40), (docs, 7), (odd_docs, 3), (odd_docs, 40)):
        placed = sharding.shard_rows(table, shards).collect()
        rows = [(r.doc_id, r.text or "") for r in table.collect()]
        want = sorted(str((i, len(t.encode()) + 16, zlib.crc32(t.encode()))) for i, t in rows)
        assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in placed) == want
        slots = defaultdict(list)
        for r in placed:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
        if table is docs:
            groups = defaultdict(set)
            for r in placed:
                groups[r.link].add(r.shard)
            assert sum(len(g) > 1 for g in groups.values()) <= 3
    assert sharding.shard_rows(no_docs).count() == 0


def test_hot_group_is_cut_as_far_as_needed(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('text ', id div 6)) as text")
    placed = sharding.shard_rows(docs, 10).groupBy("link").agg(F.countDistinct("shard").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s <= 8 for r in placed if r.n == 1000)  # four at least
    assert sum(r.s > 1 for r in placed) <= 25
    assert "Python" not in sharding.shard_rows(docs, 10)._jdf.queryExecution().toString()


def test_a_third_of_all_rows_is_in_as_few_shards_as_hold_it(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', if(id % 30 = 1, 'other', concat('text ', id div 6))) as text")
    placed = sharding.shard_rows(docs, 40).groupBy("link").agg(F.countDistinct("shard").alias("s"), F.count("*").alias("n")).collect()
    assert {r.n: r.s for r in placed if r.n >= 300} == {4000: 14, 400: 2}  # shards of 300 rows
    assert sharding.place_large([10, 7, 3], [5, 5, 5, 5]) == [[(0, 5), (1, 5)], [(2, 5), (3, 2)], [(3, 3)]]


# page text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy!</div>
<div class="page has-wide-layout"><article><h1>Title &amp; more</h1><p>One <b>two
three</b>.<p>Four&nbsp;&#233; <script>x()</script>five<br>six</p><div class="cookie-notice">We use cookies</div>
<form><input value=x> send</form><blockquote>said</blockquote><section id="comments"><p>First!</p></section></article></div>
<aside>Other</aside><footer>&copy; me</footer></body></html>"""


def text_of(html, template=frozenset()):
    return html_text.main_text(html_text.parse(html), set(template))


def test_article_text():
    assert text_of(PAGE) == "Title & more One two three. Four é five six said"
    assert text_of("") == "" and text_of("just words &lt;b&gt;") == "just words <b>"
    assert text_of("<p>a<p>b</b></p></div>c") == "a b c"
    assert text_of("<div class='has-sidebar'><main><p>x</p></main></div><div id=sidebar>y</div>") == "x"
    assert text_of("<div>" * 3000 + "deep") == "deep"


def test_templates_are_removed_where_they_recur(spark):
    def page(i, host):
        box = "<div><span>Follow our site every day</span></div>"
        return (i, f"https://{host}/p{i}?q=1", f"<body>{box}<div><p>Story {i} of the day</p></div><p>Shared by two {i // 2}</p></body>", 7)

    rows = [page(i, "a.example") for i in range(40)] + [page(i, "b.example") for i in range(100, 103)]
    rows += [(200, None, None, 7), (201, "not an address", "<article><p>Same</p></article>", 7)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(4)
    got = html_text.extract_text(pages)
    assert got.columns == [*pages.columns, "main_text"] and got.count() == len(rows)
    texts = {r.page_id: r.main_text for r in got.collect()}
    assert texts[5] == "Story 5 of the day Shared by two 2"
    assert texts[101].startswith("Follow our site every day Story 101")
    assert texts[200] == "" and texts[201] == "Same"
    assert html_text.extract_text(pages.where("page_id < 0")).count() == 0


def test_templates_inside_an_article_are_removed(spark):
    """On every page of a host, without a telling class: in an article, in a main around the page; prose that recurs stays."""
    box, links = "<div><p>Get our letter every week</p></div>", "<ul><li>Home</li><li>Sport</li></ul>"

    def page(i, host):
        story = f"<h1>News</h1><p>Story {i}.</p><p>A sentence that all share.</p>"
        inner = f"<section>{box}{story}</section>" if host == "a.example" else f"{links}<div>{story}{box}</div>"
        tag = "article" if host == "a.example" else "main"
        return (i, f"https://{host}/{i}", f"<body><{tag}>{inner}</{tag}></body>")

    rows = [page(i, "a.example") for i in range(20)] + [page(i, "b.example") for i in range(20, 40)]
    copy = "<article><div><p>One text on many pages</p></div></article>"
    rows += [(i, f"https://c.example/{i}", f"<p>{i}</p>{copy}") for i in range(40, 60)]  # copies are no template
    rows += [(i, f"https://d.example/{i}", f"<article><div><p>{'Long words of near copies. ' * 9}</p></div><p>{i}</p></article>") for i in range(60, 80)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    texts = {r.page_id: r.main_text for r in got.collect()}
    assert all(texts[i] == f"News Story {i}. A sentence that all share." for i in range(40))
    assert all(texts[i] == "One text on many pages" for i in range(40, 60))
    assert all(texts[i].startswith("Long words") for i in range(60, 80))


def test_pages_hold_their_documents(spark):
    """The articles of the test pages, with menus, adverts and footers around them."""
    for r in html_text.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).limit(50).collect():
        assert r.main_text and "track(" not in r.main_text and "©" not in r.main_text and "<p>" not in r.main_text
