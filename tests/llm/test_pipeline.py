"""The pipeline stage by stage against brute force on whole small tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from citewerk.llm import quality
from citewerk.llm.decontaminate import best_distance, normal_form
from citewerk.llm.sentencepiece_codec import decode_column
from citewerk.llm.shared import id_bucket
from tests.llm.test_exact_dedup import low
from tests.llm.test_jaccard_join import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert docs.columns == columns
        results[name] = (
            {r.doc_id: r.text for r in before.collect()},
            {r.doc_id for r in docs.select("doc_id").collect()},
        )
    texts, kept = results["quality"]
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(table, labels, id_bucket(F.col("doc_id"), 5) != 0)
    scores = table.select("doc_id", quality.score_column(table, model).alias("s")).collect()
    assert kept == {r.doc_id for r in scores if r.s >= 0.3}

    texts, kept = results["exact_dedup"]
    assert kept == set({low(t): i for i, t in sorted(texts.items())}.values())

    texts, kept = results["near_dedup"]
    assert kept == {r[0] for r in brute(sorted(texts.items()), 5, 80) if r[0] == r[2]}

    texts, kept = results["decontaminate"]
    items = [normal_form(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {i for i, t in texts.items() if any(item in normal_form(t) for item in items)}
    assert not kept & leaked
    for i in set(texts) - kept - leaked:
        assert any(best_distance(item, normal_form(texts[i])) <= 0.1 * len(item) for item in items)

    texts, kept = results["encode"]
    assert kept == set(texts)
    rows = docs.withColumn("back", decode_column(docs)).select("doc_id", "back", "round_trip").collect()
    assert all(r.round_trip and r.back == texts[r.doc_id] for r in rows)
    whole = {(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {(r.doc_id, r.decoded_sha256) for r in docs.collect()}
