import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from citewerk.plans.pipeline import index_chunks, ingest
from citewerk.schemas import TABLES
from citewerk.sources.office import read_items
from citewerk.sources.tables import read_table
from citewerk.streaming.ingest import ingest_stream
from tests.conftest import LetterEncoder, make_docx, make_pdf, make_xlsx

NOW = datetime(2026, 9, 17, 8, 0)


def run(spark, raw_dir, **options):
    out = str(raw_dir.parent / "tables")
    return out, ingest(spark, raw_dir=str(raw_dir), tables_dir=out, now=NOW, **options)


def rows(spark, out, name):
    return read_table(spark, out, name).collect()


def test_first_run_writes_all_tables(spark, raw_dir):
    before = {p: p.read_bytes() for p in raw_dir.rglob("*") if p.is_file()}
    out, result = run(spark, raw_dir)
    assert (result.documents, result.skipped) == (4, 0)
    for name, schema in TABLES.items():
        table = read_table(spark, out, name)
        assert table.columns == schema.fieldNames()
        assert [f.dataType for f in table.schema] == [f.dataType for f in schema]
        assert table.count() == getattr(result, name)
    documents = {r.source_path: r for r in rows(spark, out, "documents")}
    protocol = documents["SEE-7/protokolle/2031-02-17_werftrunde.docx"]
    assert protocol.doc_type == "protokoll" and protocol.ingested_at == NOW
    assert protocol.document_date == date(2031, 2, 17)
    plan = documents["SEE-7/terminplan/dockplan.xlsx"]
    assert plan.document_date == date(2031, 2, 17)
    assert documents["SEE-7/statusberichte/dock_2031-02.pdf"].document_date == date(2031, 2, 1)
    chunks = rows(spark, out, "chunks")
    assert {c.document_date for c in chunks if c.file_name == "dockplan.xlsx"} == {date(2031, 2, 17)}
    assert all(c.source_path.startswith(c.project_id + "/") for c in chunks)
    assert len({c.chunk_id for c in chunks}) == len(chunks)
    assert {p: p.read_bytes() for p in raw_dir.rglob("*") if p.is_file()} == before


def test_segments_of_each_format(spark, raw_dir):
    out, _ = run(spark, raw_dir, project_id="SEE-7")
    names = {r.document_id: r.file_name for r in rows(spark, out, "documents")}
    assert set(r.project_id for r in rows(spark, out, "documents")) == {"SEE-7"}
    segments = {}
    for s in sorted(rows(spark, out, "segments"), key=lambda s: s["index"]):
        segments.setdefault(names[s.document_id], []).append(s)
    for found in segments.values():
        assert [s["index"] for s in found] == list(range(len(found)))
        assert all(s.text.strip() for s in found)

    pdf = segments["dock_2031-02.pdf"]
    assert [(s.kind, s.page_no, s.locator) for s in pdf] == [("seite", 1, "S. 1"), ("seite", 2, "S. 2")]
    assert [s.heading for s in pdf] == ["Dockbericht Februar 2031", "3. Proben"]
    assert "geflickt" in pdf[0].text and "Messung steht aus" in pdf[1].text

    docx = segments["2031-02-17_werftrunde.docx"]
    assert [s.locator for s in docx] == ["Logbuch der Werftrunde 8", "TOP 1", "TOP 2", "Abschnitt 2"]
    assert docx[2].text.splitlines()[1:] == [
        "Gegenstand: Ruderprüfung",
        "Lage: Noch niemand eingeteilt.",
        "Zuständig: offen",
    ]
    assert docx[1].heading == "Punkte der Runde" and docx[-1].heading is None
    assert all(s.page_no is None for s in docx)

    xlsx = segments["dockplan.xlsx"]
    assert [s.locator for s in xlsx] == [
        "Dockplan, Kopf",
        "Dockplan, Zeile D3",
        "Dockplan, Zeile D9",
    ]
    assert xlsx[0].text == "Dockplan SEE-7, Stand 17.02.2031"
    assert xlsx[1].text.splitlines()[2:] == ["Tage zu spät: 4", "Lage: läuft", "Ende: 16.02.2031"]
    assert "Tage zu spät" not in xlsx[2].text


def test_second_run_is_a_no_op_and_changes_are_versions(spark, raw_dir, docx_bytes):
    out, first = run(spark, raw_dir)
    chunks = read_table(spark, out, "chunks").count()
    _, second = run(spark, raw_dir)
    assert (second.documents, second.skipped, second.chunks) == (0, first.documents, 0)
    assert read_table(spark, out, "chunks").count() == chunks

    (raw_dir / "SEE-7/protokolle/2031-02-17_werftrunde.docx").write_bytes(docx_bytes + b" ")
    (raw_dir / "SEE-7/protokolle/2031-02-24_werftrunde.docx").write_bytes(docx_bytes)
    _, third = run(spark, raw_dir)
    assert (third.documents, third.skipped) == (2, 3)
    versions = read_table(spark, out, "documents").groupBy("source_path").count()
    assert versions.where("count > 1").count() == 1


def test_interrupted_run_is_repeated_without_doubles(spark, raw_dir):
    from citewerk.sources import storage

    out, first = run(spark, raw_dir)
    # As after a crash before the documents were written: chunks and segments exist.
    storage.remove(spark, f"{out}/documents")
    storage.mark(spark, f"{out}/_open_run")
    _, again = run(spark, raw_dir)
    assert again.documents == first.documents
    assert read_table(spark, out, "chunks").count() == first.chunks
    assert read_table(spark, out, "segments").count() == first.segments
    # As after a crash while chunks were being written: some are missing.
    some = read_table(spark, out, "chunks").where(F.col("index") == 0)
    kept = str(raw_dir.parent / "kept")
    some.write.parquet(kept)
    storage.remove(spark, f"{out}/chunks")
    storage.remove(spark, f"{out}/documents")
    storage.mark(spark, f"{out}/_open_run")
    spark.read.parquet(kept).write.partitionBy("project_id").parquet(f"{out}/chunks")
    run(spark, raw_dir)
    chunks = read_table(spark, out, "chunks")
    assert (chunks.count(), chunks.distinct().count()) == (first.chunks, first.chunks)


def test_rejected_ignored_and_unknown(spark, raw_dir, pdf_bytes):
    (raw_dir / "lose_datei.pdf").write_bytes(pdf_bytes)
    (raw_dir / "entwurf").mkdir()
    (raw_dir / "entwurf/bericht.pdf").write_bytes(pdf_bytes)
    (raw_dir / "SEE-7/notiz.txt").write_text("x")
    (raw_dir / "SEE-7/sonstiges").mkdir()
    (raw_dir / "SEE-7/sonstiges/irgendwas_2026-13.pdf").write_bytes(pdf_bytes)
    out, result = run(spark, raw_dir)
    assert list(result.rejected_paths()) == ["entwurf/bericht.pdf", "lose_datei.pdf"]
    assert result.documents == 5
    odd = read_table(spark, out, "documents").where(F.col("file_name").startswith("irgend")).first()
    assert odd.doc_type == "unbekannt" and odd.document_date is None


def test_empty_and_missing_folder(spark, tmp_path):
    (tmp_path / "leer").mkdir()
    for name in ("leer", "fehlt"):
        result = ingest(spark, raw_dir=str(tmp_path / name), tables_dir=str(tmp_path / "t"))
        assert (result.documents, result.chunks) == (0, 0)
    assert read_table(spark, str(tmp_path / "t"), "documents").count() == 0


@pytest.mark.parametrize("project", ["..", "SEE-7/..", "../raw", "SEE-7\n", "", "see-7"])
def test_bad_project_id_is_refused_before_reading(spark, raw_dir, project):
    with pytest.raises(ValueError, match="Projekt-ID"):
        run(spark, raw_dir, project_id=project)
    assert not (raw_dir.parent / "tables").exists()


def test_unknown_suffix():
    with pytest.raises(ValueError, match="dwg"):
        read_items("plan.dwg", b"")


def test_index_is_incremental(spark, raw_dir):
    out, result = run(spark, raw_dir)
    path = str(raw_dir.parent / "index")
    options = dict(tables_dir=out, index_path=path, encoder=LetterEncoder(8), dim=8)
    some = index_chunks(spark, project_id="SEE-8", **options)
    assert some.embedded == 2
    rest = index_chunks(spark, commits=3, **options)
    assert (rest.embedded, rest.skipped) == (result.chunks - 2, 2)
    assert spark.read.parquet(path).count() == result.chunks

    # Other chunk limits give the same ids other texts.
    from citewerk.operators.chunks import rechunk
    from citewerk.operators.index import open_index, pending_ids

    segments, papers = (read_table(spark, out, n) for n in ("segments", "documents"))
    again = rechunk(segments, papers, 20, 5)
    index = open_index(spark, path)
    by_span = {r[0] for r in pending_ids(again, index).collect()}
    assert by_span == {r[0] for r in pending_ids(again, index, compare_texts=True).collect()}
    assert len(by_span) > result.chunks
    same = rechunk(segments, papers)
    assert same.exceptAll(read_table(spark, out, "chunks")).isEmpty()
    assert pending_ids(same, index).isEmpty()

    class Never:
        def encode(self, texts):
            raise AssertionError

    again = index_chunks(spark, **{**options, "encoder": Never()})
    assert (again.embedded, again.skipped) == (0, result.chunks)


def test_stream_ingest(spark, raw_dir, pdf_bytes):
    out = str(raw_dir.parent / "stream")
    options = dict(raw_dir=str(raw_dir), tables_dir=out, checkpoint_dir=str(raw_dir.parent / "ck"))
    ingest_stream(spark, **options).awaitTermination()
    assert read_table(spark, out, "documents").count() == 4
    (raw_dir / "SEE-44").mkdir()
    (raw_dir / "SEE-44/neu.pdf").write_bytes(pdf_bytes)
    ingest_stream(spark, **options).awaitTermination()
    assert read_table(spark, out, "documents").count() == 5


def test_two_project_corpus(spark, tmp_path):
    """Eleven files of three formats in two projects, with known segment counts and dates."""

    def minutes(items):
        table = [("TOP", "Thema", "Sachstand")]
        table += [(str(n), f"Thema {n}", "Sachstand 12.09.2026 unverändert.") for n in range(1, items + 1)]
        return make_docx(
            [
                ("h", "Protokoll"), ("p", "Teilnehmende"), ("h", "Rückblick"), ("p", "Keine Punkte."),
                ("h", "Tagesordnung"), ("t", table), ("p", "Nächster Termin"),
            ]
        )

    def paper(pages, stand=""):
        return make_pdf([[(16, f"Abschnitt {n}"), (11, f"Text {n}. {stand}")] for n in range(pages)])

    tasks = [["ID", "Vorgang", "Status"]] + [[f"V0{n}", f"Vorgang {n}", "offen"] for n in range(1, 10)]
    plan = make_xlsx({"Dockplan": [["Plan, Stand: 17.2.2031"], [], *tasks]})
    files = {
        "SEE-7/protokolle/2026-09-01_baubesprechung.docx": (minutes(5), 8, date(2026, 9, 1)),
        "SEE-7/protokolle/2026-09-08_baubesprechung.docx": (minutes(5), 8, date(2026, 9, 8)),
        "SEE-7/protokolle/2031-02-17_werftrunde.docx": (minutes(5), 8, date(2031, 2, 17)),
        "SEE-7/statusberichte/statusbericht_2026-08.pdf": (paper(3, "Stand 31.08.2026"), 3, date(2026, 8, 31)),
        "SEE-7/statusberichte/dock_2031-02.pdf": (paper(4, "Stand 17.02.2031"), 4, date(2031, 2, 17)),
        "SEE-7/terminplan/dockplan.xlsx": (plan, 10, date(2031, 2, 17)),
        "SEE-7/genehmigungen/baugenehmigung.pdf": (paper(2), 2, None),
        "SEE-7/genehmigungen/behördenkorrespondenz.pdf": (paper(3), 3, None),
        "SEE-8/protokolle/2026-09-10_baubesprechung.docx": (minutes(4), 7, date(2026, 9, 10)),
        "SEE-8/statusberichte/dock_2031-02.pdf": (paper(2, "Stand 17.02.2031"), 2, date(2031, 2, 17)),
        "SEE-8/genehmigungen/baugenehmigung.pdf": (paper(1), 1, None),
    }
    for name, (data, _, _) in files.items():
        # Decomposed umlauts on disk, as some file systems store them.
        target = tmp_path / "raw" / unicodedata.normalize("NFD", name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    out = str(tmp_path / "tables")
    result = ingest(spark, raw_dir=str(tmp_path / "raw"), tables_dir=out)
    assert (result.documents, result.segments, result.chunks) == (11, 56, 56)
    found = {d.source_path: d for d in rows(spark, out, "documents")}
    assert {p: d.document_date for p, d in found.items()} == {p: f[2] for p, f in files.items()}
    counts = {r.source_path: r["count"] for r in read_table(spark, out, "chunks").groupBy("source_path").count().collect()}
    assert counts == {p: f[1] for p, f in files.items()}
    assert read_table(spark, out, "chunks", "SEE-7").count() == 46
