"""The statistical splitter: by hand, in memory against joins, and what it learns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citewerk.functions.compounds import compound_parts_local
from citewerk.operators import splitter
from citewerk.plans.pipeline import stored_splitter

HEADS = "hafen ladung kessel wasser segel anker maschinen kajüten".split()
TAILS = "meister raum pumpe kammer wache plan winde druck".split()


@pytest.fixture(scope="module")
def texts(spark):
    said = [*HEADS, *TAILS] * 3
    said += [a + h for h in HEADS for a in ("alt", "neu", "groß", "vor", "bei", "un", "miß")]
    said += [t + e for t in TAILS for e in ("en", "er", "te", "bar", "lich", "los", "haft")]
    said += ["und", "die", "x" * 70, "Hafenmeister", None, ""]
    return spark.createDataFrame([(w,) for w in said], "text string")


@pytest.fixture(scope="module")
def model(spark, texts):
    return splitter.settled(splitter.learn(splitter.distinct_words(texts, F.col("text"))))


def test_counts_by_hand(spark, texts, model):
    words = {w.lower() for (w,) in texts.collect() if w and 3 <= len(w) <= 64}
    want = {}
    for word in words:
        for at in range(len(word)):
            for end in range(at + 3, min(len(word), at + 6) + 1):
                role = 0 if at == 0 and end < len(word) else 1 if end == len(word) and at else 2 if at else None
                if role is not None:
                    want.setdefault(word[at:end], [0, 0, 0])[role] += 1
    want = {run: tuple(n) for run, n in want.items() if sum(n) >= splitter.LEAST_WORDS}
    assert {r.run: (r.begins, r.ends, r.inside) for r in model.collect()} == want


def test_parts(model):
    known = splitter.splitter(model)
    for word in ("Kesseldruck", "ankerwinde", "Hafenmeister", "kajütenplan"):
        head = next(h for h in HEADS if word.lower().startswith(h))
        assert known.parts(word) == [head, word.lower()[len(head):]]
    for word in ("kessel", "segel", "x" * 70, "ab", "", "unbekanntes"):
        assert known.parts(word) == []
    assert compound_parts_local("Der Kesseldruck im Kesselraum", known) == "kessel druck raum"


def test_nested_and_linked_parts(spark):
    """A part is cut again, with longer sides; a linking s may stand before the cut."""
    known = splitter.Splitter(
        {"druck": (9, 0, 1), "kes": (9, 0, 0), "sel": (0, 9, 0), "wasser": (0, 9, 1), "amt": (0, 9, 0), "haus": (9, 0, 0)}
    )
    assert known.parts("Wasserkesseldruck") == ["wasserkessel", "wasser", "kessel", "druck"]
    assert known.parts("amtshaus") == ["amts", "haus"]
    assert known.parts("amtkessel") == ["amt", "kessel"]
    assert known.parts("amtkessel", nested=True) == []  # three letters are no nested part


def test_joins_and_memory_agree(spark, texts, model):
    rng = random.Random(5)
    words = splitter.distinct_words(texts, F.col("text"))
    more = ["".join(rng.choice(HEADS + TAILS) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    words = words.union(spark.createDataFrame([(w,) for w in more], "word string")).distinct()
    known = splitter.splitter(model)
    got = {r.word: r.parts for r in splitter.split_words(words, model).collect()}
    assert got == {r.word: known.parts(r.word) for r in words.collect() if known.parts(r.word)} and got


def test_empty_and_large(spark, texts, model, monkeypatch):
    none = splitter.learn(splitter.distinct_words(texts.limit(0), F.col("text")))
    assert splitter.splitter(none).parts("Kesseldruck") == []
    assert splitter.split_words(splitter.distinct_words(texts, F.col("text")), none).count() == 0
    monkeypatch.setattr(splitter, "MAX_LEXICON_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        splitter.splitter(model)


def test_stored_with_the_index(spark, texts, tmp_path):
    path = str(tmp_path / "index")
    assert stored_splitter(spark, path).parts("Kesseldruck") == []
    chunks = texts.select(F.lit(None).cast("string").alias("heading"), "text")
    first = stored_splitter(spark, path, chunks)
    assert first.parts("Kesseldruck") == ["kessel", "druck"]
    again = stored_splitter(spark, path, chunks.limit(0))
    assert again.shares == first.shares == stored_splitter(spark, path).shares


def test_tasks_of_a_worker_share_a_model():
    """A model that comes to a worker again is the one it has, with what it has split."""
    import pickle

    made = splitter.Splitter({"kessel": (5, 0, 0), "druck": (0, 5, 0)})
    sent = pickle.dumps(made)
    first = pickle.loads(sent)
    assert pickle.loads(sent) is first and first.shares == made.shares
    other = pickle.loads(pickle.dumps(splitter.Splitter({"raum": (1, 1, 0)})))
    assert other is not first and other.shares != first.shares


def test_runs_of_a_word_are_distinct_without_an_aggregate(spark):
    """All runs of all words of a task in one aggregate took 776 MB of a task on 0.1 GB."""
    words = spark.createDataFrame([("xxxxxxxxxx",), ("gartenzaun",)], "word string")
    model = spark.createDataFrame([("gar", 4, 0, 0), ("zaun", 0, 4, 0), ("xxx", 1, 1, 2)], splitter.MODEL)
    plan = splitter.cuts(words, model)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate(keys=[word#" in line and "run#" in line.split("]")[0]]
    found = words.select("word", F.sort_array(F.array_distinct(splitter._run_array(F.col("word")))).alias("runs"))
    for row in found.collect():
        size = len(row.word)
        want = {row.word[a : a + k] for a in range(size) for k in range(3, 7) if a + k <= size}
        assert row.runs == sorted(want)
