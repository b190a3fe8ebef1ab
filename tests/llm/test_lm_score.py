"""Counts and base scores against Python, probabilities that sum to one, a model better than its base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewerk.llm import lm_score
from citewerk.llm.lm_score import CLASSES, score_texts, train
from citewerk.llm.shared import LOWER_BYTES, WORD, id_bucket
from citewerk.llm.words import word_hashes


def words(text):
    return [*re.findall(WORD, (text or "").encode().translate(LOWER_BYTES)), None]


def learn(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2


def check(rows, got):
    counts = Counter(w for i, t, *_ in rows if learn(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    wanted = []
    for i, text, *_ in rows:
        ws = words(text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        wanted.append((repr(i), learn(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 6)))
    found = [(repr(r.doc_id), r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found) == sorted(wanted)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("frequent", [1 << 18, 700])
def test_documents(spark, monkeypatch, frequent):
    """With a short list of frequent words most counts come from the join."""
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = score_texts(docs, id_bucket(F.col("doc_id"), 7) != 2).collect()
    check(rows, got)
    out = [r for r in got if not r.training]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "A a\x0bB", 3), (2, "a" * 70_000 + " b", 4), (2, "a" * 70_000 + " b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    check(rows, score_texts(docs, id_bucket(F.col("doc_id"), 7) != 2).collect())
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0
    nothing = score_texts(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.base_score == 0 for r in nothing)


def test_distribution():
    rng = np.random.default_rng(1)
    pairs = np.zeros((CLASSES + 1, CLASSES))
    pairs[:6, :6] = rng.integers(0, 200, (6, 6))
    logs = train(pairs).astype(float)
    assert np.allclose((10**logs).sum(axis=1), 1, atol=1e-4)
    true = pairs[:6, :6] / pairs[:6, :6].sum(axis=1, keepdims=True)
    assert np.abs(10 ** logs[:6, :6] - true).max() < 0.05


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [b"One two  THREE", b"", b" x ", b"long " * 300 + b"y" * 900]
    whole, sizes = word_hashes(texts, 512)
    monkeypatch.setattr("citewerk.llm.words.BLOCK_BYTES", 40)
    parts, again = word_hashes(texts, 512)
    assert (whole == parts).all() and (sizes == again).all() and sizes.tolist() == [3, 0, 1, 301]
