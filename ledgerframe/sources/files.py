"""Files of several kinds, scanned for risks and read as tables, without running anything in them."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain, islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Levels of JSON and unpacked bytes of a workbook beyond which a file is refused.
DEPTH, UNPACKED = 64, 200 << 20
PDF_RISKS = {"javascript": rb"/(?:JavaScript|JS)\b", "launch": rb"/Launch\b", "submit": rb"/SubmitForm\b", "open_action": rb"/OpenAction\b", "embedded_file": rb"/EmbeddedFile", "rich_media": rb"/RichMedia\b", "encrypted": rb"/Encrypt\b"}
REJECTING = {"encrypted", "zip_bomb", "unsafe_path", "damaged", "binary", "too_deep"}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Rows of a table that leave a worker at once.
PIECE = 2_000
SCHEMA = "path string, kind string, verdict string, flags array<string>, tables array<struct<name:string,headers:array<string>,rows:array<array<string>>>>"


def kind_of(data: bytes) -> str:
    """pdf, xlsx, html, json, csv or other, by content."""
    head = data[:1_024].lstrip()
    if b"%PDF-" in data[:1_024]:
        return "pdf"
    if data[:4] == b"PK\x03\x04":
        return "xlsx" if b"xl/" in data else "other"
    if re.match(rb"<(?:!doctype|html)", head, re.I):
        return "html"
    if head[:1] in (b"{", b"["):
        return "json"
    return "other" if b"\0" in head and data[:2] not in (b"\xff\xfe", b"\xfe\xff") else "csv"


def decode(data: bytes) -> str:
    """Text by its mark, else UTF-8, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


class Rows:
    """The rows that `make` reads anew each time they are gone through, so that a table is never held whole."""

    def __init__(self, make: Callable[[], Iterator[list[str]]]):
        self.make = make

    def __iter__(self) -> Iterator[list[str]]:
        return self.make()


def split_header(rows: Iterable[list[str]]) -> tuple[list[str], Rows]:
    """The header among the first ten filled rows: mostly words, and at least half as wide as the widest; then the rest."""
    filled = lambda: (r for r in rows if any(c.strip() for c in r))
    first = list(islice(filled(), 10))
    widest = max((sum(bool(c.strip()) for c in r) for r in first), default=0)
    for i, r in enumerate(first):
        cells = [c.strip() for c in r if c.strip()]
        if sum(not re.fullmatch(r"[-+]?[\d.,%\s:/-]+", c) for c in cells) * 2 > len(cells) and len(cells) * 2 >= widest:
            return [c.strip() for c in r], Rows(lambda: islice(filled(), i + 1, None))
    return [f"column_{i + 1}" for i in range(max(map(len, filled()), default=0))], Rows(filled)


def read_csv(data: bytes) -> tuple[list[str], list[tuple]]:
    text = decode(data)
    if "\0" in text:
        return ["binary"], []
    lines = [line.rstrip("\n") for line in islice(io.StringIO(text), 5)]
    first = list(islice(chain.from_iterable(line.splitlines() for line in lines), 5))
    mark = max(",;\t|", key=lambda m: min((line.count(m) for line in first if line.strip()), default=0) * 100 + text[:4_000].count(m) / 100)
    headers, rows = split_header(Rows(lambda: csv.reader(io.StringIO(text), delimiter=mark)))
    return [], [("data", headers, rows)]


def read_json(data: bytes) -> tuple[list[str], list[tuple]]:
    text, depth, most = decode(data), 0, 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[\[{\]}]', text):
        depth += (m[0] in "[{") - (m[0] in "]}")
        most = max(most, depth)
    if most > DEPTH:
        return ["too_deep"], []
    try:
        found = json.loads(text)
    except ValueError:
        found = Rows(lambda: (json.loads(line) for line in _lines(text) if line.strip()))
    if isinstance(found, dict):
        found = next((v for v in found.values() if isinstance(v, list) and v and isinstance(v[0], dict)), [found])
    items = lambda: (x if isinstance(x, dict) else {"value": x} for x in (found if isinstance(found, list | Rows) else [found]))
    try:
        headers = list(dict.fromkeys(k for x in items() for k in x))
    except ValueError:
        return ["damaged"], []
    return [], [("data", headers, Rows(lambda: ([_plain(x.get(h)) for h in headers] for x in items())))]


def _lines(text: str) -> Iterator[str]:
    """The lines of `splitlines`, without a list of them all."""
    for line in io.StringIO(text):
        yield from line.splitlines()


def _plain(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _column(place: str | None) -> int:
    """Number of the column in a cell's place, 0 without one."""
    number = 0
    for letter in re.match("[A-Z]*", place or "")[0]:
        number = number * 26 + ord(letter) - 64
    return number


def read_xlsx(data: bytes) -> tuple[list[str], list[tuple]]:
    """Visible sheets, rows and columns as stored; no formula is evaluated."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = archive.namelist()
    except zipfile.BadZipFile:
        return ["damaged"], []
    flags = []
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        flags.append("unsafe_path")
    if sum(i.file_size for i in archive.infolist()) > UNPACKED:
        flags.append("zip_bomb")
    if flags:
        return flags, []
    flags += [flag for flag, part in (("macro", "vbaProject"), ("external_link", "externalLinks/"), ("ole", "embeddings/")) if any(part in n for n in names)]
    try:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        shared = [("".join(t.text or "" for t in s.iter(f"{_MAIN}t"))) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        tables = []
        for i, sheet in enumerate(book.iter(f"{_MAIN}sheet")):
            path = f"xl/worksheets/sheet{i + 1}.xml"
            if sheet.get("state", "visible") != "visible" or path not in names:
                continue
            root = ElementTree.fromstring(archive.read(path))
            hidden = {c for e in root.iter(f"{_MAIN}col") if e.get("hidden") == "1" for c in range(int(e.get("min")), int(e.get("max")) + 1)}
            rows = []
            for row in root.iter(f"{_MAIN}row"):
                if row.get("hidden") == "1":
                    continue
                cells, column = {}, 0
                for c in row.iter(f"{_MAIN}c"):
                    column = _column(c.get("r")) or column + 1  # a cell without a place follows the one before
                    if any((f.text or "").lower().lstrip("+-=").startswith(("dde", "cmd|")) for f in c.iter(f"{_MAIN}f")):
                        flags.append("dde")
                    value = c.find(f"{_MAIN}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
                    cells[column] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append([cells.get(k, "") for k in range(1, max(cells, default=0) + 1) if k not in hidden])
            headers, rest = split_header(rows)
            tables.append((sheet.get("name"), headers, rest))
    except (ElementTree.ParseError, KeyError, ValueError, IndexError):
        return [*flags, "damaged"], []
    return list(dict.fromkeys(flags)), tables


def _opened(data: bytes) -> tuple[str, str, list[str], list[tuple]]:
    """(kind, verdict, flags, tables) of a file, its tables' rows still to be gone through; rejected files give no tables."""
    kind, tables = kind_of(data), []
    if kind == "pdf":
        flags = [name for name, mark in PDF_RISKS.items() if re.search(mark, re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data))]
        flags += [] if b"%%EOF" in data[-2_048:] else ["damaged"]
    elif kind in ("csv", "json", "xlsx"):
        flags, tables = {"csv": read_csv, "json": read_json, "xlsx": read_xlsx}[kind](data)
    else:
        flags = [] if kind == "html" else ["binary"]
    verdict = "rejected" if REJECTING & set(flags) else "risky" if flags else "clean"
    return kind, verdict, flags, [] if verdict == "rejected" else tables


def scan(path: str, data: bytes, most: int | None = None) -> tuple:
    """(path, kind, verdict, flags, tables): rejected files give no tables; risky ones give them with their flags.

    `most` rows of each table are kept if given, and a table that is cut says so by the flag truncated.
    """
    kind, verdict, flags, tables = _opened(data)
    held = [(n, h, list(islice(r, most if most is None else most + 1))) for n, h, r in tables]
    if most is not None and any(len(r) > most for _, _, r in held):
        flags, held = [*flags, "truncated"], [(n, h, r[:most]) for n, h, r in held]
    return path, kind, verdict, flags, [{"name": n, "headers": h, "rows": r} for n, h, r in held]


def _scanned(path: str, data: bytes, most: int | None) -> tuple:
    """A file that no reader can make sense of is a rejected one, and doesn't end the job that reads others."""
    try:
        return scan(path, data, most)
    except Exception:  # whatever a damaged file makes a parser throw
        return path, "other", "rejected", ["unreadable"], []


def read(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """`scan` of each file at the path; one that can't be read is a row that says so.

    A row holds its file's tables whole; `table_rows` reads tables of any length.
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([_scanned(p, bytes(c), most)], columns=["path", "kind", "verdict", "flags", "tables"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(one, SCHEMA)


def pieces(path: str, data: bytes) -> Iterator[pd.DataFrame]:
    """The rows of a file's tables, PIECE at most at once: path, table, headers, first (number of the first row, from 0), rows.

    A file is gone through once before its first row leaves, so one that can't be read to its end gives none.
    """
    try:
        tables = _opened(data)[3]
        for _, _, r in tables:
            for _ in r:
                pass
    except Exception:  # as in `_scanned`
        return
    for name, headers, r in tables:
        for k, part in enumerate(batched(r, PIECE)):
            yield pd.DataFrame([(path, name, headers, k * PIECE, list(part))], columns=["path", "table", "headers", "first", "rows"])


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row of each table in the files at the path, as `rows` gives them; no table is held whole."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                yield from pieces(p, bytes(c))

    kind = "path string, table string, headers array<string>, first long, rows array<array<string>>"
    return _numbered(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(one, kind))


def rows(files: DataFrame) -> DataFrame:
    """One row for each table row: path, table, row number from 1, values by header."""
    tables = files.select("path", F.explode("tables").alias("t"))
    return _numbered(tables.select("path", F.col("t.name").alias("table"), "t.headers", F.lit(0).alias("first"), "t.rows"))


def _numbered(tables: DataFrame) -> DataFrame:
    """Rows of tables or their pieces (path, table, headers, first, rows)."""
    found = tables.select("path", "table", "headers", "first", F.posexplode("rows").alias("n", "values"))
    width = F.least(F.size("headers"), F.size("values"))
    pairs = F.zip_with(F.slice("headers", F.lit(1), width), F.slice("values", F.lit(1), width), lambda h, v: F.struct(h.alias("header"), v.alias("value")))
    return found.select("path", "table", (F.col("first") + F.col("n") + 1).cast("int").alias("row"), pairs.alias("cells"))
