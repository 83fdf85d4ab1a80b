"""Queries that apply each operator to its whole table, and SQL with the same result where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie, exact_dedup, fingerprints, html_text, jaccard_join, language_id, packing, runs
from tidemark.llm import sentencepiece_lattice, sharding, tokens, top_k, toxicity
from tidemark.llm.common import held_out

TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the lexicon is learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(docs, labels))
    scored = toxicity.score_toxicity(docs, lexicon)
    score = F.col("toxicity.score")
    predicted = (score >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), predicted.alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the classifiers are learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    sample = language_id.labelled_sample(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.identify_language(docs.select("doc_id", "text"), language_id.learn_languages(sample))
    columns = [F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous")]
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *columns)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, the last of its prefix counts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.prefix_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document, and whether its words decode to themselves."""
    model = tokens.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_lattice.encode(_table(spark, sf_dir, "documents"), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with identical texts; the largest doc_id of each stays."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 token ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("position")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most; equal texts together as far as they fit."""
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents")).drop("link")
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by the similarity of their four-word shingles, 85 per cent or more, as connected parts."""
    grouped = jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=85)
    return grouped.select("doc_id", "n_shingles", "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    read = html_text.extract_text(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and those of the next document are."""
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which get a periodic end first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.periodic_runs(docs, planted=True).select("doc_id", "runs.*")


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_html_text": op9_html_text,
    "op10_language": op10_language,
    "op11_fingerprints": op11_fingerprints,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
            FROM words
        ), grams AS (SELECT r, unnest(g) AS gram FROM sets
        ), shared AS (
            SELECT a.r AS x, b.r AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL
        ), links AS (
            SELECT x, y FROM shared JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE 100 * n >= 85 * (len(a.g) + len(b.g) - n)
        ), reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
        FROM reach JOIN sets s ON s.r = reach.x JOIN sets o ON o.r = reach.y GROUP BY s.r, s.doc_id, len(s.g)
    """,
    # CRC-32 bit by bit: -1 stands for a shift, other values for the next byte
    "op12_conversation_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (SELECT c, list(turn ORDER BY i) AS a FROM t GROUP BY c
        ), h AS (
            SELECT c, a, xor(4294967295, list_reduce(
                list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 4 AS h
            FROM own
        ), r AS (
            SELECT h.c, list_concat(coalesce(b.a, [])[1:h.h], h.a[h.h + 1:]) AS a FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20
        ), m AS (SELECT c, a[1:d] AS k, d, len(a) = d AS is_end FROM (SELECT c, a, unnest(range(0, len(a) + 1)) AS d FROM r)
        ), nodes AS (
            SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256
            FROM m GROUP BY k, d
        ), children AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
        ), each AS (
            SELECT nodes.*, coalesce(children.n, 0) AS n_children,
                   CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END AS saved
            FROM nodes LEFT JOIN children USING (k, d)
        ), subtrees AS (
            SELECT k[1:j] AS k, j AS d, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
            FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM each) GROUP BY ALL
        )
        SELECT e.conv_id, e.d AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.leaves AS n_leaves,
               s.saved::BIGINT AS saved_tokens, e.ends_sha256
        FROM each e JOIN subtrees s USING (k, d) LEFT JOIN each p ON p.d = e.d - 1 AND p.k = e.k[1:e.d - 1]
    """,
}
