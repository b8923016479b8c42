"""Token-id files: one concatenated id array, with document boundaries in Elias-Fano code."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerframe.llm.eliasfano import EliasFano
from ledgerframe.llm.files import attempt_name, place
from ledgerframe.llm.tokens import default_tokenizer, encoder
from ledgerframe.session import materialise, scratch

MAGIC = b"LFTOKEN1"
#: Documents that a file holds on average; documents whose places are asked for at once; bytes that one request reads.
FILE_DOCS, RUN, MOST_READ = 4_096, 256, 1 << 23
#: Footer: magic, then width, documents, documents without id, ids, smallest id, and the two codes' lengths.
FOOTER = len(MAGIC) + 7 * 8


class TokenFile:
    """A file of this format: ids, code of the documents' ends, code of their ids, footer.

    The codes take a few bits a document; the ids stay in the file and are read as asked for.
    """

    def __init__(self, handle):
        self.handle, size = handle, handle.size()
        footer = handle.read_at(FOOTER, size - FOOTER)
        if footer[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.width, self.docs, self.nameless, self.ids, self.base, ends, names = np.frombuffer(footer, "<i8", 7, len(MAGIC)).tolist()
        codes = handle.read_at(ends + names, self.ids * self.width)
        self.ends, self.names = EliasFano.from_bytes(codes[:ends]), EliasFano.from_bytes(codes[ends:])

    def span(self, i: int) -> tuple[int, int]:
        """Start and end of document i in the id array."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def spans(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of documents first to last (not included)."""
        ends = self.ends.range(first, last)
        return np.concatenate([[self.ends.select(first - 1) if first else 0], ends[:-1]]).astype(np.int64), ends

    def read(self, start: int, end: int) -> np.ndarray:
        data = self.handle.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Ids of documents first to last (not included); `nameless` documents without one come before all others."""
        without = min(max(self.nameless - first, 0), last - first)
        return [None] * without + (self.names.range(first + without - self.nameless, last - self.nameless) + self.base).tolist()

    def checksums(self, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """CRC-32 of each document's ids, as 32-bit numbers; neighbours are read with one request, long ones with several."""
        found, most = [], MOST_READ // self.width
        at, data = 0, np.empty(0, dtype="<u4")
        for start, end in zip(starts.tolist(), ends.tolist()):
            crc = 0
            while start < end:
                if not at <= start < at + len(data):
                    at, data = start, self.read(start, min(start + most, int(ends[-1])))
                part = data[start - at : end - at]
                crc, start = zlib.crc32(part, crc), start + len(part)
            found.append(crc)
        return found


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write `docs` (doc_id, text) as files in `folder`, in ascending doc_id order across files and in each.

    Rows of one doc_id may lie in several files, so that no id (nor its absence) makes a file larger than others.
    Returns the manifest: file, docs, ids.
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, names, ends, total, out = encoder(tokenizer), [], [], 0, None
        end = coder.id(end_id)
        files, path = place(folder)
        name = attempt_name("ids", ".tok")
        for batch in batches:
            out = out or files.open_output_stream(f"{path}/{name}")
            for doc_id, data in zip(batch["doc_id"], coder.encode_all(batch["text"].tolist())):
                data += end
                out.write(data)
                total += len(data) // coder.width
                ends.append(total)
                names.append(None if doc_id is None else int(doc_id))
        if out is None:
            return
        known = [x for x in names if x is not None]
        base = known[0] if known else 0
        a, b = EliasFano.encode(np.array(ends)).to_bytes(), EliasFano.encode(np.array(known, dtype=np.int64) - base).to_bytes()
        out.write(a + b + MAGIC + np.array([coder.width, len(ends), len(ends) - len(known), total, base, len(a), len(b)], dtype="<i8").tobytes())
        out.close()
        yield pd.DataFrame({"file": [name], "docs": [len(ends)], "ids": [total]})

    spark = docs.sparkSession
    rows = docs.count()
    files, path = place(folder)
    files.create_dir(path, recursive=True)
    numbered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(max(1, -(-rows // FILE_DOCS)), "doc_id", "row").sortWithinPartitions("doc_id", "row").select(F.col("doc_id").cast("string"), "text")
    # The file name starts with the partition's number, and ranges ascend with it.
    return materialise(ordered.mapInPandas(one, "file string, docs long, ids long"), "token-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place(folder)
        for batch in batches:
            for name, before in zip(batch["file"], batch["before"]):
                with files.open_input_file(f"{path}/{name}") as handle:
                    f = TokenFile(handle)
                    for i in range(0, f.docs, RUN):
                        j = min(i + RUN, f.docs)
                        starts, ends = f.spans(i, j)
                        yield pd.DataFrame({"doc_id": pd.array(f.doc_ids(i, j), dtype="Int64"), "start": starts + before, "n_tokens": ends - starts, "ids_crc32": f.checksums(starts, ends)})

    upto = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.withColumn("before", F.coalesce(F.sum("ids").over(upto), F.lit(0)).cast("long"))  # one row a file
    spread = bases.repartition(max(1, manifest.count()), "file")
    return spread.mapInPandas(one, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode whole texts, write the files and read them back: doc_id, start, n_tokens, ids_crc32.

    One row per input row. Null and empty texts are one end id; texts of any length are encoded and read back whole.
    Rows without doc_id come first; repeated ids stay rows of their own, in any order among themselves. Other columns
    don't matter. No rows write no file.
    """
    folder = folder or scratch(docs.sparkSession, "token-files")
    return read(write(docs, folder, tokenizer or default_tokenizer(), end_id), folder)
