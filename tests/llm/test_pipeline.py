"""The stages of the corpus pipeline against plain versions of what they keep."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute_components
from tidemark.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact_dedup", "ngram_jaccard", "packing"]

    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in kept["toxicity"][0]} - {r.doc_id for r in kept["toxicity"][1]}
    assert len([i for i in gone if toxic.get(i) == 0]) <= 1
    before, after = kept["language"]
    assert len(after) >= 0.97 * len(before)

    before, after = kept["exact_dedup"]
    best = defaultdict(int)
    for r in before:
        best[r.text] = max(best[r.text], r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())

    before, after = kept["ngram_jaccard"]
    grouped, groups = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in grouped})

    before, after = kept["packing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    lengths = defaultdict(int)
    for r in after:
        lengths[r.doc_id] += r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in after)


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() > 100
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_on_odd_rows(spark, odd_docs):
    """Null ids, null and empty texts, repeated rows and further columns go through the first four stages as a chain."""
    docs, kept = odd_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == odd_docs.columns
        kept[name] = docs.collect()
    given = odd_docs.collect()
    assert len(kept["toxicity"]) <= len(given) and all(r in given for r in kept["toxicity"])
    assert all(any(c.isalpha() for c in r.text or "") for r in kept["language"])
    assert len(kept["exact_dedup"]) == len({r.text for r in kept["language"]})
    assert {r.text for r in kept["ngram_jaccard"]} <= {r.text for r in kept["exact_dedup"]}
