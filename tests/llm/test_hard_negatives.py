"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewerk.llm import hard_negatives as module
from citewerk.llm.hard_negatives import hard_negatives

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256):
    held = []
    for number, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((number, i, [math.floor(scale * x) for x in v], label))
    out = []
    key = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for number, i, v, label in held:
        if i is None or i % 100:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        near = sorted(((score(w), j, n) for n, j, w, x in held if x == label and n != number), key=key)[:5]
        far = sorted(((score(w), j, n) for n, j, w, x in held if x != label), key=key)
        for p, j, _ in near:
            fits = [r for r in far if 80 * p <= 100 * r[0] <= 100 * p][:5]
            out += [(i, j, rank, r[1], p, r[0]) for rank, r in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed, count, width=16, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, width))
    rows = []
    for i in range(count):
        v = centres[rng.integers(clusters)] + rng.normal(0, 0.6, width)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("block", [100, 1 << 14])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    monkeypatch.setattr(module, "ROWS_IN_TASK", 300)
    monkeypatch.setattr(module, "ANCHORS_AT_ONCE", 5)
    rows = vectors(block, 900)
    same = rows[0][1]
    rows += [(5000 + k, same, k % 4) for k in range(200)]  # a very common vector, among them ties
    rows += [rows[100], rows[100], (None, same, 1), (None, rows[7][1], 0)]
    rows += [(6000, None, 1), (6100, same, None), (6200, [None, *same[1:]], 2), (6300, [math.nan, *same[1:]], 2),
             (6400, [math.inf, *same[1:]], 3), (6500, [], 1), (6600, same[:3], 1), (6700, [-x for x in same], 9)]
    frame = spark.createDataFrame(rows, KIND).withColumns({"uid": F.lit(1), "anchor": F.lit("x"), "code1": F.lit(2)})
    found = hard_negatives(frame, F.col("vec_id") % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == brute(rows) and len(got) > 100


def test_empty_and_single(spark):
    frame = spark.createDataFrame(vectors(1, 3), KIND)
    assert hard_negatives(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(frame.where("vec_id > 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(frame.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_large_numbers(spark):
    """Products beyond the whole numbers of a double are exact."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-200_000, 200_000, 8).astype(float).tolist(), i % 2) for i in range(301)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    found = hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_visit_in_order():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 9, rng.integers(1, 9)).astype(float), rng.integers(0, 9, rng.integers(1, 9)).astype(float)
        seen = list(module.visit(x, y))
        assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(len(x)) for j in range(len(y))]
        sums = [s for s, _, _ in seen]
        assert sums == sorted(sums, reverse=True) and all(s == x[i] + y[j] for s, i, j in seen)


def test_stops_on_certified_lists():
    """Clustered rows: most cells are never scored, and the bound holds for every row."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 200, (20, 16))
    points = np.floor(np.concatenate([c + rng.normal(0, 5, (60, 16)) for c in centres]))
    index = module.Index(16, [module.codebook(points[:, :8], 20), module.codebook(points[:, 8:], 20)])
    codes = [module.nearest_code(h, c) for h, c in zip(index.halves(points), index.centres)]
    for k, (half, code) in enumerate(zip(index.halves(points), codes)):
        np.maximum.at(index.radii[k], code, np.linalg.norm(half - index.centres[k][code], axis=1))
    bounds = index.bounds(points)
    for a in range(0, len(points), 97):
        assert (points @ points[a] <= bounds[0][a][codes[0]] + bounds[1][a][codes[1]]).all()
    ids = np.arange(len(points))
    block = module.Block(codes[0], codes[1], ids, ids, np.zeros(len(points), np.int64), points)
    spans, scored = block.spans, []
    block.spans = lambda *a: scored.extend(spans(*a)) or spans(*a)
    lists = module.Lists(1, 1, 5)
    anchors = {"uid": np.array([7]), "label": np.array([0]), "vectors": points[7:8]}
    module.search_block(block, index, anchors, lists, [(np.array([-(1 << 60)]), np.array([1 << 60]))], True)
    scores = points @ points[7]
    scores[7] = -np.inf
    assert sorted(lists.score[0, 0].tolist(), reverse=True) == np.sort(scores)[::-1][:5].tolist()
    assert sum(e - s for s, e in scored) < len(points) / 4
