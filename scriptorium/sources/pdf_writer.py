"""PDF files of text pages, in many of the forms that readers must understand.

One page holds a list of lines. A ``Style`` says how the file is put together: its cross-reference table, how objects and
content are packed and filtered, which encoding the font has, and how strings are shown. The text that a reader gets is
the same in all of them.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

PAGE_LINES = 50
WIDTH = 64


@dataclass(frozen=True)
class Style:
    #: Of the content: any of Flate, Flate12, Flate2, LZW, Hex, A85, Run, in the order in which a reader undoes them.
    filters: tuple[str, ...] = ()
    #: winansi, macroman, differences, unicode (two-byte codes with a ToUnicode map).
    encoding: str = "winansi"
    #: tj, array (TJ, blanks by gaps), quote (the ' operator), hex strings, actual (ActualText).
    show: str = "tj"
    #: table, stream (cross-reference stream and object streams), none (nothing that leads to an object), updated.
    xref: str = "table"
    #: Half of a page's lines in a form, content in two streams, pages in a nested tree.
    forms: bool = False
    split: bool = False
    nested: bool = False
    image: bool = False


STYLES = (
    Style(),
    Style(("Flate12",), "unicode"),
    Style(("Flate",), "winansi", "array", "stream"),
    Style(("Hex",), "differences"),
    Style(("A85", "Flate"), "winansi", "array", nested=True),
    Style(("LZW",), "macroman", "quote"),
    Style(("Run",), "winansi", forms=True, split=True),
    Style((), "winansi", "actual", "none", image=True),
    Style(("Flate",), "differences", "hex", "updated", nested=True),
    Style(("Flate2",), "unicode", "quote", "stream", split=True, image=True),
)


def run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, wider one code early, with a clear code at the start and where the table is full."""
    bits, count, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, count
        bits, count = bits << width | code, count + width
        while count >= 8:
            count -= 8
            out.append(bits >> count & 255)
            bits &= (1 << count) - 1

    table, width, held = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, width)
    for value in data:
        longer = held + bytes([value])
        if longer in table:
            held = longer
            continue
        put(table[held], width)
        code = table[longer] = len(table) + 2
        if code == 4094:
            put(256, 12)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif code == (1 << width) - 1:
            width += 1
        held = bytes([value])
    if held:
        put(table[held], width)
        if len(table) + 2 == (1 << width) - 1:  # the reader's table grows with that code as well
            width += 1
    put(257, width)
    if count:
        out.append(bits << (8 - count) & 255)
    return bytes(out)


def _rowed(data: bytes) -> np.ndarray:
    return np.frombuffer(data + b" " * (-len(data) % WIDTH), np.uint8).reshape(-1, WIDTH)


def _png_up(data: bytes) -> bytes:
    rows = _rowed(data)
    out = np.full((len(rows), WIDTH + 1), 2, np.uint8)
    out[:, 1:] = rows
    out[1:, 1:] -= rows[:-1]
    return out.tobytes()


def _tiff(data: bytes) -> bytes:
    rows = _rowed(data)
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out.tobytes()


FILTERS = {
    "Flate": ("/FlateDecode", "null", zlib.compress),
    "Flate12": ("/FlateDecode", f"<< /Predictor 12 /Columns {WIDTH} >>", lambda b: zlib.compress(_png_up(b))),
    "Flate2": ("/FlateDecode", f"<< /Predictor 2 /Columns {WIDTH} >>", lambda b: zlib.compress(_tiff(b))),
    "LZW": ("/LZWDecode", "null", lzw),
    "Hex": ("/ASCIIHexDecode", "null", lambda b: b.hex().encode() + b">"),
    "A85": ("/ASCII85Decode", "null", lambda b: base64.a85encode(b) + b"~>"),
    "Run": ("/RunLengthDecode", "null", run_length),
}


def stream(data: bytes, filters: tuple[str, ...] = (), more: str = "") -> bytes:
    """An object's bytes; ``filters`` in the order in which a reader undoes them."""
    for name in reversed(filters):
        data = FILTERS[name][2](data)
    names = " ".join(FILTERS[n][0] for n in filters)
    parms = " ".join(FILTERS[n][1] for n in filters)
    how = f"/Filter [{names}] /DecodeParms [{parms}]" if filters else ""
    return f"<< /Length {len(data)} {how} {more} >>\nstream\n".encode() + data + b"\nendstream"


class Codes:
    """How a font writes characters as bytes, and its objects."""

    def __init__(self, style: Style, pages: list[list[str]]):
        self.kind = style.encoding
        chars = sorted({c for page in pages for line in page for c in line})
        codec = {"winansi": "cp1252", "macroman": "mac_roman"}.get(self.kind)
        try:
            if codec:
                "".join(chars).encode(codec)
        except UnicodeEncodeError:
            self.kind = "unicode"
        # Codes that differ from ASCII go to the letters that ASCII lacks; more than these need two bytes.
        odd = [c for c in chars if not " " <= c <= "~"]
        if self.kind == "differences" and len(odd) > 120:
            self.kind = "unicode"
        self.codec = {"winansi": "cp1252", "macroman": "mac_roman"}.get(self.kind)
        self.other = {c: 128 + i for i, c in enumerate(odd)}
        self.chars = chars
        # Two-byte codes of characters beyond them.
        self.far = {c: 0xE000 + i for i, c in enumerate(c for c in chars if c > "\uffff")}
        self.moved = {ord(c): chr(n) for c, n in (self.far if self.kind == "unicode" else self.other).items()}

    def bytes_of(self, text: str) -> bytes:
        if self.kind == "unicode":
            return text.translate(self.moved).encode("utf-16-be", "surrogatepass") if self.far else text.encode("utf-16-be", "surrogatepass")
        if self.codec:
            return text.encode(self.codec, "surrogatepass")
        return text.translate(self.moved).encode("latin-1")

    def font(self, first: int) -> dict[int, bytes]:
        """Objects from number ``first``, the font itself."""
        base = "/Type /Font /Subtype /Type1 /BaseFont /Helvetica"
        if self.kind == "differences":
            names = " ".join("/uni" + c.encode("utf-16-be").hex().upper() for c in self.other)
            return {first: f"<< {base} /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [128 {names}] >> >>".encode()}
        if self.kind != "unicode":
            return {first: f"<< {base} /Encoding /{'MacRomanEncoding' if self.kind == 'macroman' else 'WinAnsiEncoding'} >>".encode()}
        units = {self.bytes_of(c): c.encode("utf-16-be", "surrogatepass") for c in self.chars}
        plain = sorted(u for u in units if u < b"\x01\x00")
        odd = sorted(u for u in units if u >= b"\x01\x00")
        table = ["1 begincodespacerange <0000> <FFFF> endcodespacerange"]
        if plain:
            table.append(f"1 beginbfrange <{plain[0].hex()}> <{plain[-1].hex()}> <{plain[0].hex()}> endbfrange")
        for at in range(0, len(odd), 100):
            part = odd[at : at + 100]
            table.append(f"{len(part)} beginbfchar " + " ".join(f"<{u.hex()}> <{units[u].hex()}>" for u in part) + " endbfchar")
        return {first: f"<< /Type /Font /Subtype /Type0 /ToUnicode {first + 1} 0 R >>".encode(), first + 1: stream("\n".join(table).encode(), ("Flate",))}


SPECIAL = {b"(": b"\\(", b")": b"\\)", b"\\": b"\\\\", b"\n": b"\\n", b"\r": b"\\r", b"\t": b"\\t", b"\0": b"\\000"}
SPECIALS = re.compile(rb"[()\\\n\r\t\0]")


def literal(raw: bytes) -> bytes:
    return b"(" + SPECIALS.sub(lambda m: SPECIAL[m[0]], raw) + b")"


def _shown(line: str, codes: Codes, style: Style) -> bytes:
    raw = codes.bytes_of(line)
    if style.show == "hex" or codes.kind == "unicode":
        text = b"<" + raw.hex().encode() + b">"
    elif style.show == "array":
        blank = codes.bytes_of(" ")
        return b"[" + (b" -250 ".join(map(literal, raw.split(blank))) if len(blank) == 1 else literal(raw)) + b"] TJ"
    elif style.show == "actual":
        actual = "<" + (b"\xfe\xff" + line.encode("utf-16-be", "surrogatepass")).hex() + ">"
        return f"/Span << /ActualText {actual} >> BDC (unread) Tj EMC".encode()
    else:
        text = literal(raw)
    return text + (b" '" if style.show == "quote" else b" Tj")


def _content(lines: list[str], codes: Codes, style: Style, size: float = 10) -> bytes:
    out = [b"BT", f"/F1 {size:g} Tf 12 TL 72 720 Td".encode()]
    for n, line in enumerate(lines):
        if n and style.show != "quote":
            out.append(b"0 -12 Td" if n % 2 else b"T*")
        out.append(_shown(line, codes, style))
    return b"\n".join([*out, b"ET"])


IMAGE = b"q 2 0 0 2 0 0 cm BI /W 2 /H 1 /CS /RGB /BPC 8 ID (\x01Tj\x02) EI Q\n"


def document(pages: list[list[str]], style: Style = STYLES[0], title: str = "", heads: dict[int, str] | None = None) -> bytes:
    """The file's bytes. ``title``: of the file's information; ``heads``: lines in large letters, by page from 0."""
    heads = heads or {}
    codes = Codes(style, [*pages, list(heads.values())])
    info = b"\xfe\xff" + title.encode("utf-16-be") if not title.isascii() else title.encode()
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Title " + literal(info) + b" >>"}
    objects |= codes.font(4)
    resources = "/Resources << /Font << /F1 4 0 R >> {} >>"
    number, kids = 10, []
    for n, lines in enumerate(pages):
        head = _content([heads[n]], codes, style, 24) + b"\n" if n in heads else b""
        body, form, xobject = lines, b"", ""
        if style.forms and lines:
            half = len(lines) // 2
            objects[number] = stream(_content(lines[half:], codes, style), style.filters, "/Type /XObject /Subtype /Form " + resources.format(""))
            body, form, xobject = lines[:half], b"\n/X1 Do", f"/XObject << /X1 {number} 0 R >>"
            number += 1
        content = (IMAGE if style.image else b"") + head + _content(body, codes, style) + form
        parts = [content]
        if style.split:  # at a line's end, so that no token is cut
            at = content.find(b"\n", len(content) // 2)
            parts = [content[:at], content[at + 1 :]] if at > 0 else parts
        refs = []
        for part in parts:
            objects[number] = stream(part, style.filters)
            refs.append(f"{number} 0 R")
            number += 1
        own = "" if style.nested else resources.format(xobject)
        objects[number] = f"<< /Type /Page /Parent 2 0 R {own} /Contents [{' '.join(refs)}] >>".encode()
        kids.append(number)
        number += 1
    shared = resources.format("") if style.nested else ""
    if style.nested and len(kids) > 1:
        half = len(kids) // 2
        for part in (kids[:half], kids[half:]):
            objects[number] = f"<< /Type /Pages /Parent 2 0 R /Kids [{' '.join(f'{k} 0 R' for k in part)}] /Count {len(part)} >>".encode()
            number += 1
        top = [number - 2, number - 1]
    else:
        top = kids
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in top)}] /Count {len(kids)} {shared} >>".encode()
    return {"stream": _with_streams, "none": _without_table, "updated": _updated}.get(style.xref, _with_table)(objects)


def _written(objects: dict[int, bytes], out: bytearray) -> dict[int, int]:
    at = {}
    for n in sorted(objects):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n"
    return at


def _table(at: dict[int, int], out: bytearray, more: str = "") -> None:
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for n in sorted(at):
        out += b"%d 1\n%010d 00000 n \n" % (n, at[n])
    out += f"trailer\n<< /Size {max(at) + 1} /Root 1 0 R /Info 3 0 R {more} >>\nstartxref\n{start}\n%%EOF\n".encode()


def _with_table(objects: dict[int, bytes]) -> bytes:
    out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    _table(_written(objects, out), out)
    return bytes(out)


def _updated(objects: dict[int, bytes]) -> bytes:
    """The tree of pages was empty at first; an update brings it and everything below it."""
    out = bytearray(b"%PDF-1.4\n")
    first = objects | {2: b"<< /Type /Pages /Kids [] /Count 0 >>"}
    _table(_written(first, out), out)
    last = out.rindex(b"xref\n0 1\n")
    _table(_written({2: objects[2]}, out), out, f"/Prev {last}")
    return bytes(out)


def _without_table(objects: dict[int, bytes]) -> bytes:
    out = bytearray(b"%PDF-1.4\n")
    _written(objects, out)
    return bytes(out + b"trailer\n<< /Root 1 0 R /Info 3 0 R >>\n")


def _with_streams(objects: dict[int, bytes]) -> bytes:
    """Objects that are no streams are packed into one object stream; a stream takes the place of the table."""
    out = bytearray(b"%PDF-1.5\n")
    packed = {n: b for n, b in objects.items() if not b.endswith(b"endstream")}
    plain = {n: b for n, b in objects.items() if n not in packed}
    holder, table = max(objects) + 1, max(objects) + 2
    heads, bodies = [], bytearray()
    for n, body in sorted(packed.items()):
        heads.append(f"{n} {len(bodies)}")
        bodies += body + b"\n"
    head = " ".join(heads).encode() + b"\n"
    plain[holder] = stream(head + bytes(bodies), ("Flate",), f"/Type /ObjStm /N {len(packed)} /First {len(head)}")
    at = _written(plain, out)
    at[table] = len(out)
    rows = bytearray()
    for n in range(table + 1):
        if n in at:
            rows += b"\x01" + at[n].to_bytes(4, "big") + b"\0\0"
        elif n in packed:
            rows += b"\x02" + holder.to_bytes(4, "big") + sorted(packed).index(n).to_bytes(2, "big")
        else:
            rows += b"\0\0\0\0\0\xff\xff"
    body = stream(bytes(rows), ("Flate",), f"/Type /XRef /Size {table + 1} /W [1 4 2] /Root 1 0 R /Info 3 0 R")
    start = len(out)
    out += b"%d 0 obj\n" % table + body + b"\nendobj\n" + b"startxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def paged(text: str, lines: int = PAGE_LINES) -> list[list[str]]:
    """The lines of a text, page by page; an empty text has one page."""
    found = text.split("\n")
    return [found[i : i + lines] for i in range(0, len(found), lines)]


def files(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """``path, content``: a file for every text, named by its id, in the styles in turn."""
    titled = title_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for start in range(0, batch.num_rows, 256):
                ids, texts_, titles = (c[start : start + 256] for c in columns)
                made = [document(paged(t or ""), STYLES[i % len(STYLES)], title or "") for i, t, title in zip(ids, texts_, titles, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{i}.pdf" for i in ids], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    title = F.col(title_col) if titled else F.lit("")
    return spread(texts.select(F.col(id_col).cast("long"), F.col(text_col), title.alias("_title"))).mapInArrow(run, "path string, content binary")
