"""Text lines of PDF pages with their font size.

Uses PyMuPDF where it is installed. Otherwise a small reader handles the common
case: Flate or plain streams, object streams, ToUnicode maps or Latin encodings.
Encrypted files and text drawn inside form objects need PyMuPDF.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

Line = tuple[float, str]

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(
    rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\s/<>\[\](){}%]*|<[0-9A-Fa-f\s]*>|\("
    rb"|\d+\s+\d+\s+R\b|[-+]?(?:\d+\.?\d*|\.\d+)|[^\s/<>\[\](){}%]+|[(){}<>]"
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

# Names of the Latin letters German fonts re-encode.
GLYPHS = {
    "space": " ", "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "Adieresis": "Ä",
    "Odieresis": "Ö", "Udieresis": "Ü", "germandbls": "ß", "fi": "ﬁ", "fl": "ﬂ",
    "endash": "–", "emdash": "—", "quotedblbase": "„", "quotedblleft": "“",
    "quotedblright": "”", "bullet": "•", "periodcentered": "·", "Euro": "€", "section": "§",
    "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "slash": "/",
    "parenleft": "(", "parenright": ")", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}


class Name(str):
    pass


class Ref(int):
    pass


class Operator(str):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    depth, out = 1, bytearray()
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            following = data[at + 1 : at + 4]
            octal = re.match(rb"[0-7]{1,3}", following)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
            else:
                out += _ESCAPES.get(following[:1], b"" if following[:1] == b"\n" else following[:1])
                at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if depth == 0:
            break
        out += c
    return bytes(out), at


def _items(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Objects and operators of a PDF byte sequence with the offset behind each."""
    stack: list[tuple[str, list]] = []
    while at < len(data):
        token = _TOKEN.match(data, at)
        if token is None:
            at += 1
            continue
        raw, at = token[0], token.end()
        if raw[:1].isspace() or raw[:1] == b"%":
            continue
        if raw in (b"<<", b"["):
            stack.append((raw.decode(), []))
            continue
        if raw in (b">>", b"]"):
            if not stack:
                continue
            kind, values = stack.pop()
            value: object = values if kind == "[" else dict(zip(values[::2], values[1::2]))
        elif raw == b"(":
            value, at = _string(data, at)
        elif raw[:1] == b"/":
            name = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw[1:])
            value = Name(name.decode("latin-1"))
        elif raw[:1] == b"<":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif raw.endswith(b"R") and raw[:1].isdigit():
            value = Ref(int(raw.split()[0]))
        elif re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", raw):
            value = float(raw) if b"." in raw else int(raw)
        else:
            value = Operator(raw.decode("latin-1"))
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


class _File:
    def __init__(self, data: bytes):
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("Verschlüsselte PDF-Datei; dafür PyMuPDF installieren")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for found in _OBJECT.finditer(data):
            number = int(found[1])
            first = next(_items(data, found.end()), None)
            if first is None:
                continue
            value, at = first
            self.objects[number] = value
            stream = re.compile(rb"\s*stream\r?\n").match(data, at)
            if isinstance(value, dict) and stream:
                length = self.get(value.get("Length"))
                end = stream.end() + length if isinstance(length, int) else -1
                if end < 0 or not data[end : end + 20].lstrip().startswith(b"endstream"):
                    end = data.find(b"endstream", stream.end())
                self.streams[number] = data[stream.end() : end]
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(number, value)

    def _unpack(self, number: int, header: dict) -> None:
        body = self.stream(number)
        first = self.get(header["First"])
        numbers = [v for v, _ in _items(body[:first])]
        for inner, offset in zip(numbers[::2], numbers[1::2]):
            item = next(_items(body, first + offset), None)
            if item is not None:
                self.objects.setdefault(inner, item[0])

    def get(self, value: object) -> object:
        while isinstance(value, Ref):
            value = self.objects.get(int(value))
        return value

    def stream(self, number: int) -> bytes:
        header, raw = self.objects[number], self.streams.get(number, b"")
        filters = self.get(header.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name != "FlateDecode":
                return b""
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def page_nodes(self) -> Iterator[tuple[dict, dict]]:
        """Pages in order with their (possibly inherited) resources."""
        roots = [v for v in self.objects.values() if isinstance(v, dict) and v.get("Pages")]
        todo: list[tuple[object, dict]] = [(r["Pages"], {}) for r in roots[-1:]]
        while todo:
            reference, inherited = todo.pop()
            node = self.get(reference)
            if not isinstance(node, dict):
                continue
            resources = self.get(node.get("Resources")) or inherited
            if "Kids" in node:
                todo += [(kid, resources) for kid in reversed(self.get(node["Kids"]))]
            else:
                yield node, resources

    def content(self, page: dict) -> bytes:
        found = page.get("Contents")
        parts = self.get(found) if not isinstance(found, Ref) else found
        if isinstance(parts, Ref) and isinstance(self.get(parts), list):
            parts = self.get(parts)
        refs = parts if isinstance(parts, list) else [parts]
        return b"\n".join(self.stream(int(r)) for r in refs if isinstance(r, Ref))


class _Font:
    def __init__(self, file: _File, font: dict):
        self.width = 2 if font.get("Subtype") == "Type0" else 1
        self.codes: dict[int, str] = {}
        encoding = file.get(font.get("Encoding"))
        if isinstance(encoding, dict):
            code = 0
            for item in file.get(encoding.get("Differences")) or []:
                if isinstance(item, Name):
                    uni = re.fullmatch("uni([0-9A-F]{4})", item)
                    glyph = chr(int(uni[1], 16)) if uni else GLYPHS.get(item)
                    if glyph or len(item) == 1:
                        self.codes[code] = glyph or str(item)
                    code += 1
                else:
                    code = int(item)
        if isinstance(font.get("ToUnicode"), Ref):
            self._read_map(file.stream(int(font["ToUnicode"])))

    def _read_map(self, body: bytes) -> None:
        values: list = []
        for item, _ in _items(body):
            if not isinstance(item, Operator):
                values.append(item)
                continue
            if item == "endbfchar":
                for code, text in zip(values[::2], values[1::2]):
                    self._put(code, 0, text)
            elif item == "endbfrange":
                for low, high, text in zip(values[::3], values[1::3], values[2::3]):
                    span = int.from_bytes(high, "big") - int.from_bytes(low, "big") + 1
                    for step in range(min(span, 65536)):
                        if isinstance(text, list):
                            self._put(low, step, text[step])
                        else:
                            self._put(low, step, text, step)
            values = []

    def _put(self, code: bytes, step: int, text: bytes, shift: int = 0) -> None:
        self.width = len(code)
        shown = text.decode("utf-16-be", "replace")
        if shift and shown:
            shown = shown[:-1] + chr(ord(shown[-1]) + shift)
        self.codes[int.from_bytes(code, "big") + step] = shown

    def decode(self, raw: bytes) -> str:
        out = []
        for at in range(0, len(raw), self.width):
            piece = raw[at : at + self.width]
            code = int.from_bytes(piece, "big")
            if code in self.codes:
                out.append(self.codes[code])
            elif self.width == 1:
                out.append(piece.decode("cp1252", "replace"))
        return "".join(out)


def _page_lines(file: _File, page: dict, resources: dict) -> list[Line]:
    named = file.get(resources.get("Font")) or {}
    fonts: dict[str, _Font] = {}
    plain = _Font(file, {})
    lines: list[list] = []  # [baseline, size, text]
    font, size, scale, leading, x, y, moved = plain, 0.0, 1.0, 0.0, 0.0, 0.0, False
    operands: list = []

    def show(raw: bytes) -> None:
        nonlocal moved
        text = font.decode(raw)
        if not text:
            return
        real = abs(size * scale)
        if lines and abs(lines[-1][0] - y) <= max(real, 1) * 0.3:
            gap = " " if moved and not lines[-1][2].endswith(" ") else ""
            lines[-1][1] = max(lines[-1][1], real)
            lines[-1][2] += gap + text
        else:
            lines.append([y, real, text])
        moved = False

    for item, _ in _items(file.content(page)):
        if not isinstance(item, Operator):
            operands.append(item)
            continue
        args, operands = operands, []
        if item == "BT":
            x, y, scale = 0.0, 0.0, 1.0
        elif item == "Tf" and len(args) == 2:
            name, size = args
            if name not in fonts and isinstance(file.get(named.get(name)), dict):
                fonts[name] = _Font(file, file.get(named[name]))
            font = fonts.get(name, plain)
        elif item == "TL" and args:
            leading = args[0]
        elif item in ("Td", "TD") and len(args) == 2:
            x, y, moved = x + args[0] * scale, y + args[1] * scale, True
            leading = -args[1] if item == "TD" else leading
        elif item == "Tm" and len(args) == 6:
            scale = args[3] or args[0] or 1.0
            x, y, moved = args[4], args[5], True
        elif item in ("T*", "'", '"'):
            y -= leading * scale
            if item != "T*" and args and isinstance(args[-1], bytes):
                show(args[-1])
        elif item == "Tj" and args and isinstance(args[0], bytes):
            show(args[0])
        elif item == "TJ" and args and isinstance(args[0], list):
            for part in args[0]:
                if isinstance(part, bytes):
                    show(part)
                elif isinstance(part, (int, float)) and part < -180:
                    moved = True
    return [(real, text.strip()) for _, real, text in lines if text.strip()]


def _with_pymupdf(data: bytes, pymupdf) -> Iterator[list[Line]]:
    with pymupdf.open(stream=data, filetype="pdf") as document:
        for page in document:
            found = []
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", []):
                    text = "".join(span["text"] for span in line["spans"]).strip()
                    if text:
                        found.append((max(span["size"] for span in line["spans"]), text))
            yield found


def pages(data: bytes) -> Iterator[list[Line]]:
    """Lines (font size, text) of every page, blank pages included."""
    try:
        import pymupdf
    except ImportError:
        file = _File(data)
        for page, resources in file.page_nodes():
            yield _page_lines(file, page, resources)
    else:
        yield from _with_pymupdf(data, pymupdf)
