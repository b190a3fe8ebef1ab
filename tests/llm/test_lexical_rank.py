"""Ranked lexical search against a brute-force ranking of all documents."""

import math
import random
import re

import pytest

from citewerk.llm.lexical_rank import best_documents, term_lists
from citewerk.llm.shared import LOWER_BYTES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").encode().translate(LOWER_BYTES).decode())


def brute(docs, items, k):
    lists = [(i, plain_terms(t)) for i, t in docs]
    lists = [(i, t) for i, t in lists if t]
    n_docs, total = len(lists), sum(len(t) for _, t in lists)
    df = {}
    for _, terms in lists:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for place, (i, terms) in enumerate(lists):
            m = 100 - 90 + 90 * len(terms) * n_docs // total
            score = 0
            for t in set(plain_terms(text)):
                if tf := terms.count(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i, place))
        best = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0, s[3]))[:k]
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(best, 1)]
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    pick = lambda n: " ".join(vocabulary[int(60 * rng.random() ** 3)] for _ in range(n))
    docs = [(i, pick(rng.choice([1, 2, 5, 20, 80, 400]))) for i in range(size)]
    docs += [(size + 1, docs[3][1].upper()), docs[5], docs[5], (None, docs[7][1]), (None, docs[7][1])]
    docs += [(9_001, None), (9_002, ""), (9_003, "-!? \x7f"), (9_004, "Äb-W3_w4é w59"), (9_005, "w1 " * 3000)]
    items = [(i, pick(rng.choice([1, 3, 12]))) for i in range(17)]
    items += [(3, "w59 w58"), (None, "w0"), (50, None), (51, "?"), (52, "nowhere"), (53, "äB Äb w3 W3")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"items_at_once": 7, "bundle": 3, "slice_docs": 16}, {"k": 1, "slice_docs": 40}])
def test_against_brute_force(spark, options):
    docs, items = corpus(len(options) + 4, 260)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, uid int")
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, terms int")
    found = best_documents(frame, asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(found.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items, options.get("k", 10))


def test_empty_tables(spark):
    docs, items = corpus(1, 10)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert best_documents(frame.limit(0), asked).count() == 0
    assert best_documents(frame, asked.limit(0)).count() == 0
    assert best_documents(frame.where("doc_id = 9002"), asked).count() == 0
    assert best_documents(frame.limit(1), asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_ties(spark):
    """More equal documents than places: the smallest ids come first."""
    docs = [(k, "b a") for k in range(300, 0, -1)] + [(k, "c") for k in range(400, 450)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    found = best_documents(frame, asked, slice_docs=32).orderBy("rank").collect()
    assert [r.doc_id for r in found] == list(range(1, 11)) and len({r.score for r in found}) == 1


def test_long_text_in_blocks():
    text = ("é" * 700_000 + " abc-D9 ").encode() * 3
    parts = [t for part in term_lists(text) for t in part]
    assert parts == [("é" * 700_000).encode(), b"abc", b"d9"] * 3
