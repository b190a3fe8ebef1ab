from __future__ import annotations

import io
import os
import zipfile
import zlib
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYSPARK_PYTHON", "python")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("citewerk-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# ---------------------------------------------------------------- tiny office files

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def make_docx(blocks: list) -> bytes:
    """Blocks: ("h", text), ("p", text) or ("t", rows)."""
    styles = (
        f'<w:styles {_W}><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style>'
        '<w:style w:styleId="Titel"><w:name w:val="Title"/></w:style></w:styles>'
    )

    def paragraph(text: str, style: str = "") -> str:
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    body = ""
    for kind, content in blocks:
        if kind == "t":
            rows = "".join(
                "<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>"
                for row in content
            )
            body += f"<w:tbl>{rows}</w:tbl>"
        else:
            body += paragraph(content, "berschrift1" if kind == "h" else "")
    document = f"<w:document {_W}><w:body>{body}</w:body></w:document>"
    return _zip({"word/document.xml": document, "word/styles.xml": styles})


def make_xlsx(sheets: dict[str, list[list]]) -> bytes:
    """Cells are text, numbers, None, or ("date", serial)."""
    parts = {
        "xl/workbook.xml": f"<workbook {_X} {_R}><sheets>"
        + "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>'
            for i, n in enumerate(sheets, 1)
        )
        + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>"
        + "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(sheets) + 1)
        )
        + "</Relationships>",
        "xl/styles.xml": f'<styleSheet {_X}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    strings: list[str] = []
    for i, rows in enumerate(sheets.values(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, value in enumerate(row):
                ref = f"{chr(65 + c)}{r}"
                if value is None:
                    continue
                if isinstance(value, tuple):
                    cells += f'<c r="{ref}" s="1"><v>{value[1]}</v></c>'
                elif isinstance(value, str):
                    strings.append(value)
                    cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    cells += f'<c r="{ref}"><v>{value}</v></c>'
            body += f'<row r="{r}">{cells}</row>' if cells else ""
        parts[f"xl/worksheets/sheet{i}.xml"] = (
            f"<worksheet {_X}><sheetData>{body}</sheetData></worksheet>"
        )
    parts["xl/sharedStrings.xml"] = (
        f"<sst {_X}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    )
    return _zip(parts)


def make_pdf(pages: list[list[tuple[float, str]]]) -> bytes:
    """Pages of (font size, line); 'fl' is written as a ligature through a font encoding."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    font = add(
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding "
        b"<< /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [1 /fl] >> >>"
    )
    kids = []
    parent = 2 + 2 * len(pages)
    for lines in pages:
        ops, y = [], 780
        for size, text in lines:
            raw = text.replace("fl", "\x01").encode("cp1252", "replace")
            raw = raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            ops.append(b"BT /F1 %g Tf 1 0 0 1 56 %d Tm (%s) Tj ET" % (size, y, raw))
            y -= 24
        stream = zlib.compress(b"\n".join(ops))
        content = add(
            b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream)
        )
        kids.append(
            add(
                b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >> >> >>"
                % (parent, content, font)
            )
        )
    refs = b" ".join(b"%d 0 R" % k for k in kids)
    tree = add(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (refs, len(kids)))
    assert tree == parent
    add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
    out = b"%PDF-1.4\n" + b"".join(
        b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)
    )
    return out + b"trailer << /Root %d 0 R >>\n%%%%EOF" % len(objects)


@pytest.fixture(scope="session")
def pdf_bytes():
    return make_pdf(
        [
            [(16, "Dockbericht Februar 2031"), (11, "Anstrich geflickt, Probefahrt offen.")],
            [
                (8, "Werft Süd · Dockmeisterei"),
                (16, "3. Proben"),
                (11, "Ruderlager Steuerbord: Messung steht aus."),
            ],
        ]
    )


@pytest.fixture(scope="session")
def docx_bytes():
    return make_docx(
        [
            ("h", "Logbuch der Werftrunde 8"),
            ("p", "Schiff: SEE-7"),
            ("h", "Punkte der Runde"),
            (
                "t",
                [
                    ("TOP", "Gegenstand", "Lage", "Zuständig"),
                    ("1", "Wellenlager", "Spiel gemessen, Tausch nötig.", "Brandt Antriebe"),
                    ("2", "Ruderprüfung", "Noch niemand eingeteilt.", "offen"),
                ],
            ),
            ("p", "Weiter am Montag im Trockendock"),
        ]
    )


@pytest.fixture(scope="session")
def xlsx_bytes():
    return make_xlsx(
        {
            "Dockplan": [
                ["Dockplan SEE-7, Stand 17.02.2031"],
                [],
                ["Pos", "Arbeit", "Tage zu spät", "Lage", "Ende"],
                ["D3", "Propeller abziehen", 4, "läuft", ("date", 47895)],
                ["D9", "Anoden tauschen", None, "offen"],
            ],
            "Notizen": [["ohne", "Kopf"]],
        }
    )


@pytest.fixture
def raw_dir(tmp_path, pdf_bytes, docx_bytes, xlsx_bytes):
    files = {
        "SEE-7/statusberichte/dock_2031-02.pdf": pdf_bytes,
        "SEE-7/protokolle/2031-02-17_werftrunde.docx": docx_bytes,
        "SEE-7/terminplan/dockplan.xlsx": xlsx_bytes,
        "SEE-8/statusberichte/dock_2031-02.PDF": pdf_bytes,
    }
    for name, data in files.items():
        target = tmp_path / "raw" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return tmp_path / "raw"


class LetterEncoder:
    """Stands in for a model: how often the text has each of a few frequent letters."""

    LETTERS = "enirstdh"

    def __init__(self, dim: int):
        self.letters = self.LETTERS[:dim]

    def encode(self, texts):
        return [[float(text.lower().count(letter)) for letter in self.letters] for text in texts]
