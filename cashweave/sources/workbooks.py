"""Payslip workbooks to grids of text cells: the one place where Python touches the rows.

An .xlsx is a zip of XML parts and Spark has no reader for it, so each file is unpacked inside a
task; the result is nothing but text cells, and everything after that is Spark expressions.
"""

from __future__ import annotations

import functools
import io
import posixpath
import re
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import PAYSLIP_GRIDS
from .provenance import base_name

# Ship these helpers with the task, so that workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROW, CELL, IS, T_ = (f"{MAIN}{name}" for name in ("row", "c", "is", "t"))


@functools.lru_cache(maxsize=256)
def _first_sheet_part(workbook: bytes, rels: bytes) -> str:
    """The part that holds the first sheet, given the two parts that say so: files of one origin share them."""
    sheet = ElementTree.fromstring(workbook).find(f"{MAIN}sheets/{MAIN}sheet")
    for rel in ElementTree.fromstring(rels):
        if rel.get("Id") == sheet.get(REL_ID):
            return posixpath.normpath(posixpath.join("/xl", rel.get("Target"))).lstrip("/")
    raise ValueError("the workbook names no first sheet")


def _text(node) -> str:
    """Text of a plain or rich string, phonetic hints left out."""
    parts = [node.find(f"{MAIN}t")] + [r.find(f"{MAIN}t") for r in node.findall(f"{MAIN}r")]
    return "".join(t.text or "" for t in parts if t is not None)


def _value(cell, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        if len(cell) == 1 and cell[0].tag == IS and len(cell[0]) == 1 and cell[0][0].tag == T_:  # plain text only
            return cell[0][0].text or ""
        inline = cell.find(IS)
        return "" if inline is None else _text(inline)
    return _typed(kind, cell.findtext(f"{MAIN}v"), shared)


def _typed(kind: str, raw: str | None, shared: list[str]) -> str:
    """Text of a cell's value that is not an inline string."""
    if raw is None or kind == "e":
        return ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "n":
        number = float(raw)
        return str(int(number)) if number == int(number) else repr(number)
    return raw


@functools.lru_cache(maxsize=65536)
def _column_no(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


# Cells as spreadsheet programs write most of them, with the ends of the rows they begin and end: plain text or a value,
# without formulas, rich text, comments or other attributes.
_CHARS = r"[^<>&\r\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"
_PLAIN = rf"{_CHARS}*+(?:&(?:amp|lt|gt|quot|apos);{_CHARS}*+)*+"
PLAIN_CELL = re.compile(
    r'(?:(<row)(?: r="([0-9]++)")?+(?: spans="[0-9:]++")?+>)?+'
    r'<c(?: r="([A-Z]++)[0-9]++")?+(?: s="[0-9]++")?+(?: t="([A-Za-z]++)")?+'
    rf'(?:/>|>(?:<is><t(?: xml:space="preserve")?+>({_PLAIN})</t></is>|<v>({_CHARS}++)</v>)?+</c>)(</row>)?+')
DECLARATION = re.compile(rb'(?:<\?xml version="1.0" encoding="(?i:utf-8)"(?: standalone="(?:yes|no)")?\?>\s*)?<[^?]')
FIRST_COLUMNS = [chr(c) for c in range(65, 91)]
ENTITIES = {"&quot;": '"', "&apos;": "'"}


@functools.lru_cache(maxsize=64)
def _is_plain_frame(head: bytes, tail: bytes) -> bool:
    """Whether a sheet's parts before and after its rows are well formed and its rows stand where they are looked for."""
    if not DECLARATION.match(head) or b"<!" in head + tail or b"<?" in head[1:] + tail:
        return False
    root = ElementTree.fromstring(head + tail)
    found = [e for e in root.iter() if e.tag.rpartition("}")[2] == "sheetData"]
    return found == root.findall(f"{MAIN}sheetData") and len(found) == 1 and not (len(found[0]) or found[0].text)


def _plain_rows(sheet: bytes, shared: list[str]) -> list[list[str]] | None:
    """The rows of a sheet whose cells are all plain, without building its elements; None for any other sheet."""
    start, end = sheet.find(b"<sheetData>") + 11, sheet.rfind(b"</sheetData>")
    if start == 10 or end < start:
        return None
    try:
        if not _is_plain_frame(sheet[:start], sheet[end:]):
            return None
        found = PLAIN_CELL.split(sheet[start:end].decode())
    except (ElementTree.ParseError, UnicodeDecodeError):
        return None
    if any(found[::8]):  # something between the cells
        return None
    opens, numbers, refs, kinds, texts, raws, closes = (found[n::8] for n in range(1, 8))
    if [o is None for o in opens[1:]] != [c is None for c in closes[:-1]] or None in (opens[:1] + closes[-1:]):
        return None
    cells = [text if kind == "inlineStr" and text and "&" not in text else _plain_value(kind, text, raw, shared)
             for kind, text, raw in zip(kinds, texts, raws)]
    begin = [n for n, o in enumerate(opens) if o is not None]
    rows: list[list[str]] = []
    for i, j in zip(begin, [*begin[1:], len(cells)]):
        if numbers[i]:
            rows.extend([] for _ in range(int(numbers[i]) - 1 - len(rows)))
        if refs[i:j] == FIRST_COLUMNS[:j - i]:
            rows.append(cells[i:j])
            continue
        rows.append(values := [])
        for ref, value in zip(refs[i:j], cells[i:j]):
            if ref:
                values += [""] * (_column_no(ref) - len(values))
            values.append(value)
    return rows


def _plain_value(kind: str | None, text: str | None, raw: str | None, shared: list[str]) -> str:
    return unescape(text or "", ENTITIES) if kind == "inlineStr" else _typed(kind or "n", raw, shared)


def _element_rows(sheet: bytes, shared: list[str]) -> list[list[str]]:
    rows: list[list[str]] = []
    for row in (r for data in ElementTree.fromstring(sheet).iterfind(f"{MAIN}sheetData") for r in data if r.tag == ROW):
        number = int(row.get("r", len(rows) + 1))
        rows.extend([] for _ in range(number - 1 - len(rows)))
        values: list[str] = []
        for cell in row:
            if cell.tag != CELL:
                continue
            ref = cell.get("r")
            if ref:
                values += [""] * (_column_no(ref) - len(values))
            values.append(_value(cell, shared))
        rows.append(values)
    return rows


DIRECTORY_END, ENTRY = "<4s4H2LH", "<4s6H3L5H2L"  # of 22 and 46 bytes


def _plain_parts(content: bytes) -> dict[str, tuple[int, int, int, int, int]] | None:
    """Place, size, size unpacked, method and checksum of each part of an ordinary zip, from its directory; None for any other."""
    end = len(content) - 22
    if end < 0:
        return None
    mark, disk, first, here, count, size, start, comment = struct.unpack_from(DIRECTORY_END, content, end)
    if mark != b"PK\5\6" or disk or first or here != count or comment or start + size != end:
        return None
    parts, at, last = {}, start, 0
    for _ in range(count):
        if at + 46 > end:
            return None
        (mark, _, version, flags, method, _, _, crc, packed, unpacked, name_size, extra, note, on, _, _, place) = struct.unpack_from(ENTRY, content, at)
        name = content[at + 46:at + 46 + name_size]
        own = place + 30 + name_size + int.from_bytes(content[place + 28:place + 30], "little")  # behind the name and extra field
        # In the order of the directory, none of them encrypted, overlapping, or with more to say than the directory has places for.
        if (mark != b"PK\1\2" or version > 45 or flags & ~0x80E or method not in (0, 8) or 0xFFFFFFFF in (packed, unpacked, place)
                or extra or on or place < last or own + packed > start or not name.isascii() or b"\0" in name
                or content[place:place + 4] != b"PK\3\4"
                or content[place + 26:place + 28] != name_size.to_bytes(2, "little") or content[place + 30:place + 30 + name_size] != name):
            return None
        parts[name.decode()] = own, packed, unpacked, method, crc
        at, last = at + 46 + name_size + note, own + packed
    return parts if at == end else None


def _part(content: bytes, place: int, packed: int, unpacked: int, method: int, crc: int) -> bytes:
    data = content[place:place + packed]
    if method:
        unzip = zlib.decompressobj(-15)
        data = unzip.decompress(data, unpacked + 1)
        if not unzip.eof:
            raise zipfile.BadZipFile("incomplete part")
    if len(data) != unpacked or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("damaged part")
    return data


def _sheet_and_strings(names, read) -> tuple[bytes, list[str]]:
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in root.findall(f"{MAIN}si")]
    return read(_first_sheet_part(read("xl/workbook.xml"), read("xl/_rels/workbook.xml.rels"))), shared


def _unpacked(content: bytes) -> tuple[bytes, list[str]]:
    """The first sheet and the shared strings. The parts of an ordinary zip are taken by their places; any other, and what
    cannot be read so, is left to ``zipfile``, which has the last word on what is broken."""
    parts = _plain_parts(content)
    if parts:
        try:
            return _sheet_and_strings(parts, lambda name: _part(content, *parts[name]))
        except (KeyError, zipfile.BadZipFile, zlib.error):
            pass
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return _sheet_and_strings(book.namelist(), book.read)


def sheet_rows(content: bytes) -> list[list[str]]:
    """The first sheet as rows of text, blank rows kept, every row as wide as the widest."""
    sheet, shared = _unpacked(content)
    rows = _plain_rows(sheet, shared)
    if rows is None:
        rows = _element_rows(sheet, shared)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


ROWS_PER_BATCH = 10_000  # sheet rows, so that a batch stays small however long the sheets are
ARROW = pa.schema([("source_file", pa.string()), ("grid", pa.list_(pa.list_(pa.string()))), ("error", pa.string())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip((names, grids, errors), ARROW)], schema=ARROW)

    names, grids, errors, rows = [], [], [], 0
    for batch in batches:
        for name, content in zip(batch.column("source_file"), batch.column("content")):
            grid = error = None
            try:
                grid = sheet_rows(content.as_py())
            except Exception as err:  # whatever a broken file makes the parsers raise
                error = f"not a readable workbook: {err}"
            names.append(name.as_py())
            grids.append(grid)
            errors.append(error)
            rows += len(grid or ()) + 1
            if rows >= ROWS_PER_BATCH:
                yield pack()
                names, grids, errors, rows = [], [], [], 0
    if names:
        yield pack()


def decode_workbooks(files: DataFrame) -> DataFrame:
    """``(source_file, content)`` to grids, each file inside one task. A file that cannot be read has no grid but
    an ``error``, so that it does not stop the others."""
    return files.select("source_file", "content").mapInArrow(
        _decode, T.StructType([*PAYSLIP_GRIDS.fields, T.StructField("error", T.StringType())]))


def read_payslip_grids(spark: SparkSession, path: str, whole_path: bool = False,
                       recursive: bool = False) -> DataFrame:
    """The grids (or errors) of all workbooks in ``path``, with ``recursive`` in all folders below as well; the extension
    may be in any case. ``source_file`` is the file's name, or with ``whole_path`` its path, from which :func:`..provenance.with_provenance` reads entity keys."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]")
             .option("recursiveFileLookup", str(recursive).lower()).load(path))
    name = F.col("path") if whole_path else base_name("path")
    return decode_workbooks(files.select(name.alias("source_file"), "content"))
