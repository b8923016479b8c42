"""WARC archives: an index written first, then byte-range reads of the records wanted, joined where they touch."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerframe.llm.files import attempt_name, place
from ledgerframe.operators.scale import join_groups
from ledgerframe.session import materialise, scratch

#: Payloads from this size on are written once and revisited.
REVISIT_BYTES = 100
#: Ranges this close are read together, up to so many bytes at once.
GAP, MOST_READ = 1 << 16, 1 << 23
#: Bytes of archives that one task reads on average.
TASK_BYTES = 1 << 26
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """A WARC/1.1 record, its own gzip member: a response with the payload, or, without one, a revisit that points at `refers`."""
    urn = lambda n: f"<urn:page:{'null' if n is None else n}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: {urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse(member: bytes) -> dict:
    """A record's fields, payload and HTTP length; raises ValueError where lengths or digest don't hold."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    return {"type": fields["WARC-Type"], "id": _number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "digest": digest, "refers": _number(fields.get("WARC-Refers-To")), "payload": payload, "size": size}


def _number(urn: str | None) -> int | None:
    found = (urn or "null").removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def decided(narrow: DataFrame) -> DataFrame:
    """Add `revisit` and `refers_to` to rows (row, page_id, url, digest, bytes) of payloads from REVISIT_BYTES on.

    Of the rows of a digest, that with the smallest page_id is no revisit (null ids last, then URL and row decide).
    """
    best = F.min(F.struct(F.col("page_id").isNull(), "page_id", "url", "row")).alias("best")
    groups = narrow.groupBy("digest").agg(best, F.count("*").alias("n"))
    again = F.col("row") != F.col("best.row")
    return join_groups(narrow, groups, "digest", "n").select("page_id", "url", "digest", "bytes", again.alias("revisit"), F.when(again, F.col("best.page_id")).alias("refers_to"))


def records(pages: DataFrame) -> DataFrame:
    """What is to be written: page_id, url, html (null for a revisit), bytes, digest, refers_to.

    All is decided on a table without payloads, which revisits and payloads below REVISIT_BYTES need alone. Each
    larger payload is shuffled once, by its digest, to the response that carries it.
    """
    html = F.coalesce("html", F.lit(""))
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    large = F.col("bytes") >= REVISIT_BYTES
    brief = source.select("page_id", "url", "digest", "bytes", F.when(~large, F.col("html")).alias("html")).withColumn("row", F.monotonically_increasing_id())
    brief = materialise(brief, "warc-brief")
    known = materialise(decided(brief.filter(large).drop("html")), "warc-decided")
    payloads = source.filter(large).groupBy("digest").agg(F.first("html").alias("html"))  # equal ones meet before the shuffle
    columns = ["page_id", "url", "html", "bytes", "digest", "refers_to"]
    small = brief.filter(~large).withColumn("refers_to", F.lit(None).cast("long"))
    again = known.filter("revisit").withColumn("html", F.lit(None).cast("string"))
    return known.filter("not revisit").join(payloads, "digest").select(columns).union(again.select(columns)).union(small.select(columns))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) into archives in `folder`; returns the index.

    One archive a task: file, offset, length, URL and digest of each record, and its page_id.
    """
    rows = records(pages)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place(folder)
        name, out, at = attempt_name("pages", ".warc.gz"), None, 0
        for batch in batches:
            out = out or files.open_output_stream(f"{path}/{name}", compression=None)
            found = []
            for page_id, url, text, size, known, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "bytes", "digest", "refers_to"))):
                number, other = (None if x is None else int(x) for x in (page_id, refers))
                data = record(number, url, None if text is None else text.encode(), int(size), known, other)
                out.write(data)
                found.append((name, at, len(data), url, known, number))
                at += len(data)
            frame = pd.DataFrame(found, columns=["file", "offset", "length", "url", "digest", "page_id"])
            yield frame.assign(page_id=pd.array([f[-1] for f in found], dtype="Int64"))
        if out:
            out.close()

    files, path = place(folder)
    files.create_dir(path, recursive=True)
    # Ids travel as text: pandas would make whole numbers beside nulls inexact.
    exact = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(exact.mapInPandas(one, INDEX), "warc-index")


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the index's rows: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Without `payload` the payloads are read and measured, but stay in the workers.

    Rows are sorted by file and offset; ranges that touch, or nearly, are read with one request.
    """

    def joined(batch: pd.DataFrame) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        file, start, end, parts = None, 0, 0, []
        for name, offset, length in zip(batch["file"], batch["offset"].tolist(), batch["length"].tolist()):
            if parts and (name != file or not 0 <= offset - end <= GAP or offset + length - start > MOST_READ):
                yield file, start, end, parts
                parts = []
            if not parts:
                file, start = name, offset
            parts.append((offset, length))
            end = offset + length
        if parts:
            yield file, start, end, parts

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place(folder)
        name, handle = None, None
        for batch in batches:
            for file, start, end, parts in joined(batch):
                if file != name:
                    if handle:
                        handle.close()
                    name, handle = file, files.open_input_file(f"{path}/{file}")
                data = handle.read_at(end - start, start)
                found = [parse(data[a - start : a - start + n]) for a, n in parts]
                frame = pd.DataFrame({
                    "page_id": pd.array([f["id"] for f in found], dtype="Int64"), "url": [f["url"] for f in found], "payload": [f["payload"] for f in found], "payload_bytes": [f["size"] for f in found],
                    "payload_digest": [f["digest"] for f in found], "record_type": [f["type"] for f in found], "refers_to": pd.array([f["refers"] for f in found], dtype="Int64"),
                })
                yield frame if payload else frame.drop(columns="payload")
        if handle:
            handle.close()

    rows = index.select("file", "offset", "length")
    tasks = max(8, -(-(rows.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    spread = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInPandas(one, f"page_id long, url string, {'payload binary, ' if payload else ''}payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Write archives of all pages and read every record back, its payload too or only what it measures.

    One row per input row. Null html is an empty payload, always a response; a null URL is written as an empty one.
    Of equal payloads of REVISIT_BYTES at least, the row with the smallest page_id is the response, and one of them
    where rows repeat. Null ids come last: they revisit the smallest id, and where all ids of a payload are null, one row
    is the response and the others are revisits with a null refers_to. No rows write no file.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, payload)
