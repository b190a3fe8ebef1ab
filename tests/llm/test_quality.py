"""The machine against explicit pairs, held-out accuracy, edges."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from citewerk.llm.quality import SIZE, FactorisationMachine, features, fit, score_column
from citewerk.llm.shared import id_bucket

FOLDER = "/root/testdata/sf0.1"


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(4)
    machine = FactorisationMachine(factors=3)
    machine.weight = rng.normal(size=SIZE).astype(np.float32)
    machine.factor = rng.normal(size=(SIZE, 3)).astype(np.float32)
    machine.freeze()
    row = features("One two, two THREE!! ünd\nOne two".encode(), 31.0)
    pairs = list(zip(*row))
    wanted = sum(v * machine.weight[i] for i, v in pairs) + sum(
        float(machine.factor[i] @ machine.factor[j]) * v * w for (i, v), (j, w) in itertools.combinations(pairs, 2)
    )
    assert math.isclose(machine.margins([row])[0], wanted, rel_tol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = fit(docs, labels, id_bucket(F.col("doc_id"), 5) != 0)
    scored = docs.withColumn("score", score_column(docs, model)).join(labels, "doc_id")
    out = scored.where(id_bucket(F.col("doc_id"), 5) == 0).collect()
    assert len(out) > 500 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out]) > 0.98


def test_edges(spark):
    rows = [(1, "good text", 9), (1, "good text", 9), (2, None, None), (None, "", 0), (3, "z " * 90_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = fit(docs, labels, F.lit(True))
    scores = [r.s for r in docs.select(score_column(docs, model).alias("s")).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    none = fit(docs.limit(0), labels, F.lit(True))
    assert docs.limit(0).select(score_column(docs, none).alias("s")).count() == 0
    assert abs(docs.select(score_column(docs, none).alias("s")).first().s - 0.5) < 0.02
    without = docs.drop("n_chars")
    assert without.select(score_column(without, model).alias("s")).count() == 5
