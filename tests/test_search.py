"""Searching and keeping the index, over notes of a shipyard."""

from __future__ import annotations

import random
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from citewerk.functions.compounds import Lexicon
from citewerk.functions.text import citation
from citewerk.functions.tokens import question_lexemes
from citewerk.operators import index as ix
from citewerk.operators import postings as inv
from citewerk.operators.evidence import collect_evidence
from citewerk.operators.ranking import POSITION_WEIGHT
from citewerk.operators.retrieval import (
    latest_only,
    matches_all,
    reciprocal_rank_fusion,
    search,
    text_candidates,
    text_search,
    vector_search,
)
from citewerk.schemas import CHUNKS

WORDS = Lexicon("schiff rumpf motor schaden anstrich pumpe wasser leck werft dock".split())
TOPICS = ("rumpf", "motor", "pumpe", "anstrich")


class TopicEncoder:
    """One axis for each topic that a text names, and one for none of them."""

    def encode(self, texts):
        return [[float(t in text.lower()) for t in TOPICS] + [0.01] for text in texts]


DIM = len(TOPICS) + 1


def note(key, text, project="SEE-7", file="dock/bericht.pdf", place="Blatt 1", day=date(2025, 3, 4), heading="Befund"):
    return {
        "chunk_id": key, "segment_id": f"s-{key}", "document_id": f"d-{file}", "project_id": project,
        "index": 0, "text": text, "char_start": 0, "char_end": len(text), "source_path": f"{project}/{file}",
        "file_name": file.split("/")[-1], "doc_type": "protokoll", "document_date": day, "page_no": None,
        "locator": place, "heading": heading,
    }


HULL = note("hull", "Rumpfschaden unter der Wasserlinie, das Leck ist abgedichtet.")
ENGINE = note("engine", "Der Motor verliert Öl; die Wasserpumpe wird getauscht.", place="Blatt 2")
PAINT = note("paint", "Anstrich des Rumpfes nach der Reparatur, zweiter Anstrich später.", place="Blatt 3", day=None)
OTHER = note("other", "Rumpfschaden vollständig behoben.", project="SEE-8", file="werft/liste.xlsx")
NOTES = (HULL, ENGINE, PAINT, OTHER)


def rows_of(spark, notes):
    chunks = spark.createDataFrame([[n[c] for c in CHUNKS.fieldNames()] for n in notes], CHUNKS)
    return ix.index_rows(chunks, TopicEncoder(), WORDS, DIM)


def stored(spark, path, notes):
    ix.upsert(spark, path, rows_of(spark, notes))
    return ix.open_index(spark, path), ix.open_postings(spark, path)


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    return stored(spark, str(tmp_path_factory.mktemp("held") / "index"), NOTES)


def test_stored_tables_are_small(spark, tmp_path):
    """Lists of places take most of the room: rows and blocks are stored with the denser codec."""
    path = str(tmp_path / "index")
    stored(spark, path, NOTES)
    for own in (path, ix.postings_path(path)):
        files = [pq.ParquetFile(f).metadata.row_group(0) for f in Path(own).rglob("*.parquet")]
        assert files and {g.column(n).compression for g in files for n in range(g.num_columns)} == {"ZSTD"}


def keys(found):
    return [r.chunk_id for r in found.collect()]


def ask(held, question, project="SEE-7", **options):
    index, inverted = held
    return search(
        index, project_id=project, question=question, encoder=TopicEncoder(), dim=DIM, lexicon=WORDS,
        inverted=inverted, **options,
    )


def test_ranks_are_fused(spark):
    placed = spark.createDataFrame([("x", 3), ("y", 1), ("x", 1), ("z", 2)], "item string, rank int")
    points = {r["item"]: r.score for r in reciprocal_rank_fusion(placed).collect()}
    assert points == pytest.approx({"x": 1 / 63 + 1 / 61, "y": 1 / 61, "z": 1 / 62})


def test_vectors_and_citation(held):
    near = vector_search(held[0], project_id="SEE-7", query_embedding=[0, 1, 0, 0, 0], limit=2)
    assert keys(near)[0] == "engine" and near.count() == 2
    parts = [F.col(c) for c in ("project_id", "file_name", "locator", "document_date")]
    assert near.select(citation(*parts).alias("c")).first().c == "SEE-7 · bericht.pdf · Blatt 2 · 04.03.2025"


@pytest.mark.parametrize(
    ("question", "found"),
    [
        ("Welche Schäden hat der Rumpf?", ["hull", "paint"]),  # part and stem of a compound
        ("Pumpen", ["engine"]),
        ("Anstriche am Motor", ["paint", "engine"]),  # two places before one
        ("Schiffsmotor", ["engine"]),  # the question is split, too
        ("der die das und", []),
        ("Kajüte", []),
    ],
)
def test_words_joined_by_or(held, question, found):
    index, inverted = held
    for options in ({}, {"inverted": inverted}):
        hits = text_search(index, project_id="SEE-7", question=question, limit=9, lexicon=WORDS, **options)
        assert keys(hits) == found


def test_headings_are_searched(held):
    both = question_lexemes("Befund Reparatur")
    assert keys(held[0].where(matches_all(F.col("lexemes"), both))) == ["paint"]


def test_hybrid_keeps_projects_apart(held):
    first = ask(held, "Motor").first()
    assert (first.chunk_id, first.vector_rank, first.text_rank) == ("engine", 1, 1)
    assert first.score == pytest.approx(2 / 61)
    assert {r.project_id for r in ask(held, "Rumpfschaden behoben").collect()} == {"SEE-7"}
    assert keys(ask(held, "Rumpfschaden", "SEE-8")) == ["other"] and keys(ask(held, "Rumpf", "SEE-9")) == []
    assert ask(held, "Rumpf", limit=1).count() == 1
    for wrong in ("../SEE-7", "", "SEE-7' --"):
        with pytest.raises(ValueError, match="Projekt-ID"):
            ask(held, "Rumpf", wrong)
    with pytest.raises(ValueError, match="Dimension"):
        search(held[0], project_id="SEE-7", question="x", encoder=TopicEncoder(), dim=DIM + 1)


def test_scans_are_pruned(held):
    plan = ask(held, "Rumpf")._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("project_id" in s.split("PartitionFilters:")[1][:120] for s in scans)
    words = inv.any_word(held[1], "SEE-7", [["rumpf"]], 3)._jdf.queryExecution().toString()
    scans = [line for line in words.splitlines() if "FileScan" in line]
    assert scans and all("lexeme" in s.split("PushedFilters:")[1] for s in scans)


def test_evidence_in_order_of_time(held):
    index, inverted = held
    found = collect_evidence(
        index, project_id="SEE-7", encoder=TopicEncoder(), questions=["Rumpf und Motor?", "Welcher Anstrich?"],
        dim=DIM, lexicon=WORDS, inverted=inverted,
    )
    assert keys(found) == ["paint", "engine", "hull"]


# ---------------------------------------------------------------- blocks against scans


def many(seed, count):
    rng = random.Random(seed)
    words = ["alpha", "bravo", "carlo", "delta", "echo", "fox"]
    pick = lambda: " ".join(words[int(6 * rng.random() ** 2)] for _ in range(rng.randint(1, 25)))
    return [note(f"n{i:04d}", pick(), heading=None, project="SEE-7" if i % 5 else "SEE-8") for i in range(count)]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """An index written in three goes, with chunks replaced and removed."""
    path = str(tmp_path_factory.mktemp("filled") / "index")
    notes = many(1, 400)
    ix.upsert(spark, path, rows_of(spark, notes[:250]))
    ix.upsert(spark, path, rows_of(spark, notes[250:]))
    changed = [dict(n, text="alpha " * 30 + n["text"] if k % 2 else "fox") for k, n in enumerate(notes[100:140])]
    ix.upsert(spark, path, rows_of(spark, changed))
    now = notes[:100] + changed + notes[140:]
    left = [n for k, n in enumerate(now) if k % 11]
    chunks = spark.createDataFrame([[n[c] for c in CHUNKS.fieldNames()] for n in left], CHUNKS)
    assert ix.prune_index(spark, path, chunks) == len(now) - len(left)
    return path, left


QUESTIONS = [["alpha", "echo"], ["fox"], ["carlo", "delta", "fox"], ["nothing"], []]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_block_top_k_is_exact(spark, filled, k):
    path, _ = filled
    index, inverted = ix.open_index(spark, path), ix.open_postings(spark, path)
    want = text_candidates(index, "SEE-7", QUESTIONS, k)
    got = inv.any_word(inverted, "SEE-7", QUESTIONS, k)
    shown = lambda df: sorted(tuple(r) for r in df.withColumn("text_score", F.round("text_score", 6)).collect())
    assert shown(got.select(*want.columns)) == shown(want) and want.count()


def test_blocks_below_the_kth_score_are_not_read(spark, filled):
    path, _ = filled
    inverted = inv.Inverted(ix.open_postings(spark, path).blocks)
    rows, askers = inv._asked(inverted, "SEE-7", QUESTIONS[:1])
    buckets = rows.where("most > 0").select("bucket", askers).distinct().count()
    assert 0 < inv.reachable(rows, askers, 3).count() < buckets
    assert inv.reachable(rows, askers, 10_000).count() == buckets


def test_blocks_are_made_where_rows_lie(spark, filled, monkeypatch):
    """However many blocks a lexeme has in a bucket, they hold each entry once, and nothing is shuffled."""
    index = ix._stored(spark, filled[0])
    want = {
        (r.chunk_id, r.seq, w, tuple(p for x, p in zip(r.lexemes, r.places) if x == w))
        for r in index.collect() for w in r.lexemes
    }
    for tokens in (1, 50, inv.BLOCK_TOKENS):
        made = []
        for batch in index.select(
            "project_id", "shard", inv.bucket_of(F.col("chunk_id")).alias("bucket"), "chunk_id", "seq", "lexemes", "places"
        ).toArrow().to_batches():
            monkeypatch.setattr(inv, "BLOCK_TOKENS", tokens)
            made += [r for b in inv._inverted(iter([batch])) for r in b.to_pylist()]
        got = [
            (c, s, r["lexeme"], tuple(p))
            for r in made if r["bucket"] >= 0 for c, s, p in zip(r["chunk_ids"], r["seqs"], r["places"])
        ]
        assert len(got) == len(want) and set(got) == want
        assert sum(r["n"] for r in made if r["lexeme"] == "") == index.count()
        assert all(r["n"] == len(r["places"]) and r["most"] == max(map(len, r["places"])) for r in made if r["lexeme"])
    assert "Exchange" not in inv.blocks(index)._jdf.queryExecution().toString()


def test_rows_are_finished_in_their_shards(spark, tmp_path):
    """What is staged and shuffled is what `finish` starts from; a wrong vector stores nothing."""
    from citewerk.schemas import CHUNK_COLUMNS

    path, shaped = str(tmp_path / "index"), lambda rows: ix.index_rows(rows, TopicEncoder(), WORDS, DIM)
    chunks = lambda notes: spark.createDataFrame([[n[c] for c in CHUNKS.fieldNames()] for n in notes], CHUNKS).select(*CHUNK_COLUMNS)
    assert ix.upsert(spark, path, chunks([*NOTES, HULL]), DIM, finish=shaped) == 5
    assert ix.upsert(spark, path, chunks([dict(HULL, text="Kiel geprüft.")]), DIM, finish=shaped) == 1
    with pytest.raises(Exception, match="Dimension"):
        ix.upsert(spark, path, chunks([dict(HULL, text="Neu."), note("new", "Neu.")]), DIM + 1, finish=shaped)
    index, inverted = ix.open_index(spark, path), ix.open_postings(spark, path)
    assert {r.chunk_id: r.text for r in index.collect()} == {n["chunk_id"]: n["text"] for n in NOTES} | {"hull": "Kiel geprüft."}
    assert keys(inv.any_word(inverted, "SEE-7", [["kiel"]], 5)) == ["hull"]
    assert inv.statistics(inverted, "SEE-7", ["kiel", "leck"])[::2] == (3, {"kiel": 1, "leck": 0})


def plain_covers(lists):
    """All shortest stretches by trying every pair of ends."""
    places = sorted(p for own in lists for p in own)
    holds = lambda a, b: all(any(a <= p <= b for p in own) for own in lists)
    found = [(a, b) for a in places for b in places if a <= b and holds(a, b)]
    least = [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]
    return sum(POSITION_WEIGHT / (1 + b - a + 1 - sum(a <= p <= b for p in places)) for a, b in least)


def test_cover_density(spark, filled):
    path, left = filled
    index, inverted = ix.open_index(spark, path), ix.open_postings(spark, path)
    asked = [["carlo", "alpha"], ["delta", "echo", "fox"], ["fox", "nothing"]]
    got = {(r.question_no, r.chunk_id): r.text_score for r in inv.all_words(inverted, "SEE-7", asked, 1000).collect()}
    want = {}
    for row in index.where("project_id = 'SEE-7'").select("chunk_id", "lexemes", "places").collect():
        for number, words in enumerate(asked):
            lists = [[p for w, p in zip(row.lexemes, row.places) if w == word] for word in words]
            if all(lists):
                want[number, row.chunk_id] = plain_covers(lists)
    assert want and got == pytest.approx(want)


def test_stop_words_take_a_place(spark, tmp_path):
    near, far = note("near", "Leck am Rumpf"), note("far", "Leck an und in und von dem Rumpf")
    _, inverted = stored(spark, str(tmp_path / "i"), [near, far])
    hits = inv.all_words(inverted, "SEE-7", [["leck", "rumpf"]], 5).orderBy("text_rank").collect()
    assert [(h.chunk_id, round(h.text_score, 6)) for h in hits] == [("near", 0.05), ("far", round(0.1 / 7, 6))]


def test_bm25(spark, filled):
    import math

    path, left = filled
    index, inverted = ix.open_index(spark, path), ix.open_postings(spark, path)
    rows = [(r.chunk_id, r.lexemes) for r in index.where("project_id = 'SEE-7'").select("chunk_id", "lexemes").collect()]
    mean = sum(len(w) for _, w in rows) / len(rows)
    asked = QUESTIONS[:4]
    got = {(r.question_no, r.chunk_id): r.text_score for r in inv.bm25(inverted, "SEE-7", asked, 1000).collect()}
    want = {}
    for number, words in enumerate(asked):
        for word in words:
            df = sum(word in w for _, w in rows)
            rarity = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
            for key, w in rows:
                if n := w.count(word):
                    gain = rarity * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))
                    want[number, key] = want.get((number, key), 0.0) + gain
    assert want and got == pytest.approx(want, abs=1e-8)
    best = text_search(index, project_id="SEE-7", question="fox", limit=3, inverted=inverted, scorer="bm25")
    assert best.count() == 3
    with pytest.raises(ValueError, match="postings"):
        text_search(index, project_id="SEE-7", question="fox", limit=3, scorer="bm25")


# ---------------------------------------------------------------- keeping the index


def test_upsert_appends_and_replaces(spark, tmp_path):
    path = str(tmp_path / "index")
    stored(spark, path, NOTES)
    new = dict(HULL, text="Kiel geprüft.")
    index, inverted = stored(spark, path, [new, note("keel", "Kiel und Ruder.")])
    texts = {r.chunk_id: r.text for r in index.collect()}
    assert len(texts) == 5 and texts["hull"] == "Kiel geprüft."
    assert spark.read.parquet(path).count() == 6  # what is stored grows by what was given
    assert keys(inv.any_word(inverted, "SEE-7", [["kiel"]], 5)) == ["hull", "keel"]
    assert "hull" not in keys(inv.any_word(inverted, "SEE-7", [["leck"]], 5))
    assert keys(ix.known_ids(index, "SEE-8")) == ["other"]
    assert ix.upsert(spark, path, rows_of(spark, [])) == 0
    moved = dict(OTHER, project_id="SEE-7")
    index, _ = stored(spark, path, [moved, moved])
    assert keys(ix.known_ids(index, "SEE-8")) == [] and index.count() == 5


def test_prune_and_compact(spark, tmp_path):
    path = str(tmp_path / "index")
    stored(spark, path, NOTES)
    stored(spark, path, [dict(ENGINE, text="Motor läuft.")])
    kept = spark.createDataFrame([[n[c] for c in CHUNKS.fieldNames()] for n in (HULL, ENGINE)], CHUNKS)
    assert ix.prune_index(spark, path, kept) == 2 and ix.prune_index(spark, path, kept) == 0
    before = {r.chunk_id: r.text for r in ix.open_index(spark, path).collect()}
    assert set(before) == {"hull", "engine"} and spark.read.parquet(path).count() == 5
    assert inv.statistics(ix.open_postings(spark, path), "SEE-7", ["rumpf"])[0] == 2
    assert ix.compact(spark, path) == 3 and ix.compact(spark, path) == 0
    assert {r.chunk_id: r.text for r in ix.open_index(spark, path).collect()} == before
    inverted = ix.open_postings(spark, path)
    assert inverted.gone is None and spark.read.parquet(path).count() == 2
    assert inv.statistics(inverted, "SEE-7", ["rumpf"]) == (2, inv.statistics(inverted, "SEE-7", [])[1], {"rumpf": 1})
    assert inv.statistics(inverted, "SEE-8", ["rumpf"]) == (0, 0, {})
    # a removed chunk can come back
    index, inverted = stored(spark, path, [PAINT])
    assert index.count() == 3 and keys(inv.any_word(inverted, "SEE-7", [["anstrich"]], 5)) == ["paint"]


def test_a_run_that_died_is_made_good(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    stored(spark, path, NOTES)

    def fail(*args):
        raise OSError("no more room")

    with monkeypatch.context() as patch:
        patch.setattr(ix, "_write", fail)
        with pytest.raises(OSError):
            ix.upsert(spark, path, rows_of(spark, [dict(HULL, text="Neuer Kiel."), note("new", "Kiel")]))
    assert "hull" not in keys(ix.open_index(spark, path))  # counts as not indexed, so it is due again
    index, inverted = stored(spark, path, [dict(HULL, text="Neuer Kiel."), note("new", "Kiel")])
    assert index.count() == 5
    hits = inv.any_word(inverted, "SEE-7", [["kiel"]], 5).collect()
    assert {(h.chunk_id, h.text_score) for h in hits} == {("hull", 0.1), ("new", 0.1)}


def test_older_layout_is_refused(spark, tmp_path):
    path = str(tmp_path / "old")
    rows_of(spark, NOTES).drop("places").withColumn("shard", F.lit(0)).write.parquet(path)
    with pytest.raises(RuntimeError, match="--neu"):
        ix.open_index(spark, path)
    ix.reset_index(spark, path)
    assert ix.open_index(spark, path).count() == 0 and ix.open_postings(spark, path).blocks.count() == 0


def test_last_versions_only(spark, tmp_path):
    from dataclasses import replace
    from datetime import datetime

    first, second = note("v1", "Leck Leck am Rumpf", file="a/x.pdf"), note("v2", "Leck am Rumpf", file="a/y.pdf")
    index, inverted = stored(spark, str(tmp_path / "index"), [first, second, note("else", "Rumpf", file="b.pdf")])
    papers = spark.createDataFrame(
        [("d-a/x.pdf", "SEE-7", "SEE-7/a", datetime(2025, 1, 1)), ("d-a/y.pdf", "SEE-7", "SEE-7/a", datetime(2025, 2, 1)),
         ("d-b.pdf", "SEE-7", "SEE-7/b", datetime(2024, 1, 1)), ("d-z", "SEE-8", "SEE-7/a", datetime(2026, 1, 1))],
        "document_id string, project_id string, source_path string, ingested_at timestamp",
    )
    last = latest_only(index, papers)
    assert set(keys(last)) == {"v2", "else"}
    assert keys(text_search(last, project_id="SEE-7", question="Leck", limit=1)) == ["v2"]
    only = replace(inverted, only=last.select("chunk_id"))
    assert keys(text_search(last, project_id="SEE-7", question="Leck", limit=1, inverted=only)) == ["v2"]
    assert keys(text_search(index, project_id="SEE-7", question="Leck", limit=1, inverted=inverted)) == ["v1"]


def test_shards_are_cut_in_bounded_pieces(spark, monkeypatch):
    """The text that one file of a shard holds does not grow with the table, and pieces hold whole buckets."""
    notes = [note(f"p{i:05d}", "wasser " * 40, project="SEE-7" if i % 4 else "none") for i in range(1600)]
    rows = spark.createDataFrame([[n[c] for c in CHUNKS.fieldNames()] for n in notes], CHUNKS)
    rows = rows.withColumn("project_id", F.expr("nullif(project_id, 'none')")).withColumn("shard", ix.shard_of(F.col("chunk_id")))
    monkeypatch.setattr(ix, "TASK_BYTES", 8 << 10)
    dealt = ix._clustered(rows).withColumn("task", F.spark_partition_id()).withColumn("bucket", inv.bucket_of(F.col("chunk_id")))
    files = dealt.groupBy("task", "project_id", "shard").agg(F.sum(F.length("text")).alias("size"), F.count("*").alias("n"))
    found = files.agg(F.sum("n"), F.max("size"), F.count("*")).first()
    assert found[0] == len(notes) and found[1] < 3 * (8 << 10) and found[2] > 2 * 16
    assert dealt.groupBy("project_id", "bucket").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()
    assert sorted(r.chunk_id for r in dealt.collect()) == sorted(n["chunk_id"] for n in notes)
