import re
from datetime import date
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citewerk.functions.chunking import boundary_positions, spans, text_spans
from citewerk.functions.compounds import NO_PARTS, Lexicon, compound_parts_local, split_compound
from citewerk.functions.german import stem
from citewerk.functions.ids import derive_id, derive_id_local, require_project_id
from citewerk.functions.text import matches_terms, match_form
from citewerk.functions.tokens import question_lexemes, tokens_of
from citewerk.functions.vectors import (
    checked_embedding,
    cosine_similarity,
    embed,
    embed_query,
    require_dimension,
)
from citewerk.operators.chunks import BLOCK, running_offset
from citewerk.sources import office, pdf
from citewerk.sources.files import date_from_segments, date_from_text, doc_type_of, project_of
from tests.conftest import LetterEncoder, make_docx, make_xlsx

SENTENCE = "Das Ruderlager an Steuerbord wird erst vermessen, wenn das Dock leer und die Welle frei ist. "
LONG = "\n".join(SENTENCE * 4 for _ in range(6))


def pieces(text, max_chars=600, overlap=150):
    return [text[a:b] for a, b in spans(text, max_chars, overlap)]


def test_spans_keep_sentences():
    found = pieces(LONG)
    assert len(found) > 1
    assert all(len(p) <= 600 and p.startswith("Das ") and p.endswith(".") for p in found)
    offsets = list(spans(LONG, 600, 150))
    assert offsets[1][0] < offsets[0][1]
    assert offsets[0][0] == 0 and offsets[-1][1] == len(LONG.rstrip())
    assert all(b[0] <= a[1] for a, b in pairwise(offsets))


def test_spans_special_cases():
    assert pieces("  kurz  ") == ["  kurz  "]
    assert [len(p) for p in pieces("A" * 500, 200, 0)] == [200, 200, 100]
    # White space of any kind separates words and is trimmed.
    assert pieces("aaaa bbbb cccc", 6, 0)[0] == "aaaa b"
    assert list(spans(" " * 9, 4, 0))[0] == (4, 4)


def slow_spans(text, max_chars, overlap):
    """The rules, word for word and position by position."""
    n = len(text)
    if n <= max_chars:
        return [(0, n)]
    cuts = [m.end() for m in re.finditer(r"\n+|(?<=[.!?:;])\s+", text)]
    out, start = [], 0
    while True:
        last = start + max_chars >= n
        end = n if last else max((c for c in cuts if start < c <= start + max_chars), default=start + max_chars)
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        out.append((a, b))
        if last:
            return out
        target = max(end - overlap, start + 1)
        earlier = [c for c in cuts if start < c <= target]
        if earlier:
            start = max(earlier)
        else:
            start = next((p for p in range(target, end) if text[p - 1].isspace()), end)
        if start >= n:
            return out


@settings(max_examples=400, deadline=None)
@given(
    st.text(alphabet="ab.!: \n  \tä", max_size=120),
    st.integers(1, 30),
    st.integers(0, 12),
)
def test_spans_equal_brute_force(text, max_chars, overlap):
    found = list(spans(text, max_chars, overlap))
    assert found == slow_spans(text, max_chars, overlap)
    assert all(b - a <= max_chars for a, b in found) or len(text) <= max_chars


def test_span_udf(spark):
    rows = spark.createDataFrame([("seite", LONG), ("tabellenzeile", LONG)], "kind string, text string")
    found = rows.select("kind", F.inline_outer(text_spans(F.col("text"), F.col("kind"), 600, 150))).collect()
    assert [r.text for r in found if r.kind == "seite"] == pieces(LONG)
    assert [r.text for r in found if r.kind != "seite"] == [LONG]
    cuts = rows.select(boundary_positions("text")).first()[0]
    assert cuts == [m.end() for m in re.finditer(r"\n+|(?<=[.!?:;])\s+", LONG)]
    with pytest.raises(ValueError):
        text_spans(F.col("text"), max_chars=0)


def test_running_offset_across_blocks(spark):
    """One key holds almost all rows, over several blocks."""
    n = 3 * BLOCK + 7
    rows = spark.range(n).select(
        F.when(F.col("id") < n - 3, "hot").otherwise("cold").alias("k"),
        F.when(F.col("id") < n - 3, F.col("id")).otherwise(F.col("id") - (n - 3)).alias("pos"),
        (F.col("id") % 5).alias("amount"),
    )
    found = {(r.k, r.pos): r.offset for r in running_offset(rows, "k", "pos", "amount").collect()}
    total = 0
    for pos in range(n - 3):
        assert found["hot", pos] == total
        total += pos % 5
    assert found["cold", 0] == 0 and len(found) == n


SHIP_WORDS = Lexicon("schiff bau rumpf bruch stelle prüfung brand schutz brandschutz motor last frei bord".split())


@pytest.mark.parametrize(
    ("word", "parts"),
    [
        ("Schiffbau", ["schiff", "bau"]), ("SCHIFFSBAU", ["schiffs", "bau"]),
        ("Rumpfbruchstelle", ["rumpfbruch", "rumpf", "bruch", "stelle"]),
        ("Brandschutzprüfung", ["brandschutz", "brand", "schutz", "prüfung"]),
        ("Bauprüfung", ["bau", "prüfung"]),
        *[(w, []) for w in ("Schiffe", "Prüfung", "Bruchteil", "Freibad", "Motoröl", "bord", "")],
    ],
)
def test_compounds(word, parts):
    known = Lexicon([*SHIP_WORDS.words, "rumpfbruch"])
    assert split_compound(word, known) == parts == known.parts(word)


def test_compound_texts():
    assert compound_parts_local("Schiffbau: der Bau ruht.", SHIP_WORDS) == "schiff bau"
    assert compound_parts_local("Schiffbau, Brandschutz und Schiffsbau", SHIP_WORDS) == "schiff bau brand schutz schiffs"
    assert compound_parts_local("K-12 SB-2025/3, 17.000 t", SHIP_WORDS) == ""
    assert compound_parts_local("Schiffbau", NO_PARTS) == ""
    with pytest.raises(ValueError, match="bytes"):
        Lexicon("x" * 1000 + str(i) for i in range(70_000))


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("genehmigungen", "genehm"), ("baugenehmigung", "baugenehm"), ("fristen", "frist"),
        ("häuser", "haus"), ("aufeinander", "aufeinand"), ("kategorischen", "kategor"),
        ("auffassung", "auffass"), ("ergebnisse", "ergebnis"), ("größe", "gross"), ("au", "au"),
        ("verantwortlichkeit", "verantwort"), ("freundlichkeit", "freundlich"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_tokens(spark):
    assert tokens_of("N-07 BA-2026-0587 Bau-Amt 48.500 am 30.09.2026, 2te a_b!") == [
        "n", "-07", "ba", "-2026", "-0587", "bau-amt", "bau", "amt", "48.500", "am", "30.09.2026",
        "2te", "a", "b",
    ]
    assert tokens_of("Der Bau\nwächst über 3 m") == ["der", "bau", "wächst", "über", "3", "m"]
    assert question_lexemes("und die oder") == []
    assert question_lexemes("BA-2026-0587") == ["ba", "-2026", "-0587"]


def test_ids_and_projects(spark):
    found = spark.range(1).select(derive_id(F.lit("BAU-42"), F.lit("p/ä"), F.lit(7))).first()[0]
    assert found == derive_id_local("BAU-42", "p/ä", 7) and len(found) == 32
    for good in ("BAU-42", "AB-1", "ABCDEFGHIJ-123456"):
        assert require_project_id(good) == good
    for bad in ("B-1", "BAU42", "BAU-1234567", "bau-42", "BAU-42 ", "BAU-٤٢", "ÄB-1"):
        with pytest.raises(ValueError, match="Projekt-ID"):
            require_project_id(bad)


def test_path_rules(spark):
    paths = ["BAU-42/Protokolle/x.pdf", "BAU-42/a/genehmigungen/terminplan/x.pdf", "BAU-42/protokolle", "lose.pdf", "x/y.pdf"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    kinds = [r[0] for r in rows.select(doc_type_of(F.col("p"))).collect()]
    assert kinds == ["protokoll", "genehmigung", "unbekannt", "unbekannt", "unbekannt"]
    assert [r[0] for r in rows.select(project_of(F.col("p"))).collect()] == ["BAU-42"] * 3 + [None] * 2


def test_content_dates(spark):
    def found(*texts):
        segments = F.array(*[F.struct(F.lit(t).alias("text")) for t in texts])
        return spark.range(1).select(date_from_segments(segments)).first()[0]

    assert found("BAU-42 – Lindenhof · Stand 15.09.2026 · Projektsteuerung") == date(2026, 9, 15)
    assert found("Stand: 1.9.2026") == date(2026, 9, 1)
    assert found("Sachstand / Beschluss", "Der Standsicherheitsnachweis", "Sachstand 12.09.2026") is None
    assert found("Stand 31.02.2026", "Stand 28.02.2026") == date(2026, 2, 28)
    assert found("Stand 15.09.2026", "Stand 01.10.2026") == date(2026, 9, 15)
    nbsp = spark.range(1).select(date_from_text(F.lit("Stand 15.09.2026"))).first()[0]
    assert nbsp == date(2026, 9, 15)


def test_vectors(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None)], "i int, e array<float>"
    )
    found = [r[0] for r in rows.orderBy("i").select(cosine_similarity(F.col("e"), [3.0, 0.0])).collect()]
    assert found == [1.0, 0.0, None, None]
    texts = spark.createDataFrame([("en" * i + "i",) for i in range(70)], "t string").coalesce(1)
    vectors = texts.select(embed(F.col("t"), LetterEncoder(3), 3, 32), F.length("t")).collect()
    assert [v[0] for v in vectors] == [[(v[1] - 1) / 2, (v[1] - 1) / 2, 1.0] for v in vectors]
    assert embed_query("  Nenner ", LetterEncoder(4), 4) == LetterEncoder(4).encode(["query: Nenner"])[0]
    with pytest.raises(ValueError, match="Dimension"):
        require_dimension([1.0], 2)
    with pytest.raises(Exception, match="Dimension"):
        rows.where("i = 0").select(checked_embedding(F.col("e"), 3)).collect()


def test_terms(spark):
    def hit(text, *groups):
        return spark.range(1).select(matches_terms(match_form(F.lit(text)), groups)).first()[0]

    assert hit("Verzug 5 AT", ("5 at",)) and not hit("Verzug 15 AT", ("5 at",))
    assert hit("4–6  Wochen", ("4-6 wochen",)) and not hit("nur Brandschutz", ("brandschutz",), ("frist",))
    assert hit("zum 12.10.", ("12.10",)) and not hit("zum 12x10", ("12.10",))


def test_office_details():
    rows = [("TOP", "A", "B"), ("", "", ""), ("x", "1", ""), ("", "2", "3")]
    items = office.read_items("x.docx", make_docx([("p", "vorn"), ("t", rows), ("p", "hinten")]))
    assert [i.get("number") for i in items] == [None, 2, 3, None]
    assert [i["place"] for i in items] == ["Abschnitt 1", "Tabelle 1", "Tabelle 1", "Abschnitt 2"]
    sheet = [["Titel"], [], ["x", "y"], ["ID", "A", "B"], [1, 2.5, ("date", 46280.5)], [], [None, "q"]]
    items = office.read_items("x.XLSX", make_xlsx({"S": sheet, "T": [["nur", "zwei"]]}))
    assert items[0]["text"] == "Titel\n\nx y"
    assert items[1]["cells"] == ["1", "2.5", "15.09.2026"]
    assert [i.get("number") for i in items[1:]] == [1, 3]


def test_pdf_pages_and_strings():
    data = b"""1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 /Resources << /Font << /F 7 0 R >> >> >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj
4 0 obj << /Length 99 >> stream
BT /F 12 Tf 14 TL 50 700 Td (Haus \\(B\\) \\344) Tj T* [(Roh) -20 (bau) -300 (liegt)] TJ ET
endstream endobj
5 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R >> endobj
6 0 obj << /Length 0 >> stream
endstream endobj
7 0 obj << /Type /Font /Subtype /Type1 >> endobj"""
    assert list(pdf.pages(data)) == [[(12.0, "Haus (B) ä"), (12.0, "Rohbau liegt")], []]
    with pytest.raises(ValueError, match="PyMuPDF"):
        list(pdf.pages(b"trailer << /Encrypt 9 0 R >>"))


def test_lists_are_made_piece_by_piece(spark, monkeypatch):
    """Texts of a batch are lexed in bounded pieces, whose lists are those of each text alone."""
    import pyarrow as pa

    from citewerk.functions import stretches, tokens
    from citewerk.functions.compounds import compound_parts_local
    from citewerk.functions.german import index_form

    texts = ["Schiffbau: Bau-Amt 48.500", None, "", " \u0130stanbul\xa0\u039f\u0394\u039f\u03a3. und ", "und der Schiffsbau " * 9]
    whole, stops = pa.array(texts, pa.string()), frozenset(["und", "der"])
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(stretches, "PIECE_BYTES", size)
        assert sum(n for _, n in stretches.pieces(whole)) == len(texts)
        got = tokens._string_lists(whole, lambda run: tokens._run_tokens(run.lower())).to_pylist()
        assert got == [tokens_of(t or "") for t in texts]
        made = []
        for at, count in stretches.pieces(whole):
            made += tokens._placed(pa.array([t or "" for t in texts[at : at + count]]), tokens._vocabulary(stops), SHIP_WORDS).to_pylist()
        for text, row in zip(texts, made, strict=True):
            parts = compound_parts_local(text or "", SHIP_WORDS)
            placed = [(index_form(t), n) for n, t in enumerate(tokens_of(f"{text or ''} {parts}")) if t not in stops]
            assert row == {"compound_terms": parts, "lexemes": [w for w, _ in placed], "places": [n for _, n in placed]}
    assert len(list(stretches.pieces(whole))) == 1
