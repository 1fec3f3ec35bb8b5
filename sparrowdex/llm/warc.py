"""WARC files of gzip members: a writer and a splittable reader.

Each record is a gzip member of its own, so a file can be read from the middle.
A task gets a byte range. It scans the range for the gzip magic bytes; they also
occur by chance inside compressed data, so a candidate counts only if it decodes
and what it decodes to starts with a WARC version line and a complete header
block, however long that is. A task owns exactly the records whose members start
inside its range and reads past its end to finish the last one: every record is read
once, whatever the ranges. After a member is decoded, the next one starts where it
ends, so that scanning is only needed at the start of a range and after damage.

An uncompressed `.warc` file has nothing to synchronise on (a page may quote a WARC
header), so it is one range, read as a stream by one task.

Defined results: a truncated or damaged member is skipped and scanning resumes
after its magic bytes; in an uncompressed file, at the next line that starts with
`WARC/`. Empty files have no records, nor have empty tables. Header names are
case-insensitive; a missing header is null, folded lines are joined by a space, and
of a repeated header the values are joined by ", " (of Content-Length the first
counts). Blanks around a header's value aren't part of it. Concatenated files are
read in full. A member that holds several records (a file compressed as a whole) is
read by the task that owns its start. Contents and headers may have any length.

Pages: null ids, URLs and contents are written with a header that says so and read
back as null, unlike empty ones; URLs with outer blanks or line ends go percent-encoded
into a header of their own. Repeated pages are repeated records; no order among
equal pages is kept or needed. Extra columns aren't written."""

from __future__ import annotations

import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace

SPLIT_BYTES, READ = 16 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION, END, BLANKS = b"WARC/", b"\r\n\r\n", " \t"
PIECE = 1 << 13  # compressed bytes that a member is first decoded from; doubled up to READ
FIELDS = ["path", "offset", "warc_type", "record_id", "target_uri", "warc_date", "content_type", "headers", "content"]
SCHEMA = "path string, offset long, warc_type string, record_id string, target_uri string, warc_date string, content_type string, headers map<string,string>, content binary"
PAGE_ID, NULLS, EXACT_URL = "x-page-id", "x-null", "x-target-uri-encoded"


def record(headers: dict[str, str], content: bytes) -> bytes:
    """A WARC/1.1 record as one gzip member. Line ends in values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items()), f"Content-Length: {len(content)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One file for each partition. A file appears under its final name only when
    complete, and a repeated task replaces it with the same content."""

    def run(batches):
        from pyspark import TaskContext

        disk, folder = fs.FileSystem.from_uri(path)
        disk.create_dir(folder, recursive=True)
        ctx = TaskContext.get()
        final, part = f"{folder}/part-{ctx.partitionId():06d}.warc.gz", f"{folder}/_part-{ctx.taskAttemptId()}"
        n = 0
        with disk.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    head = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{'null' if page is None else page}>", "Content-Type": "text/html; charset=utf-8"}
                    nulls = [k for k, v in (("id", page), ("url", url), ("html", html)) if v is None]
                    head |= {"X-Page-Id": str(page)} if page is not None else {}
                    head |= {"WARC-Target-URI": url} if url is not None else {}
                    head |= {"X-Target-URI-Encoded": quote(url, safe="")} if url and (url != url.strip(" \t") or re.search(r"[\r\n]", url)) else {}
                    head |= {"X-Null": ",".join(nulls)} if nulls else {}
                    out.write(record(head, (html or "").encode()))
                    n += 1
        disk.move(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


class _Reader:
    """Bytes of a file from an offset on, held in a window that can be dropped from the front."""

    def __init__(self, f, at: int, size: int):
        self.f, self.base, self.size, self.data = f, at, size, bytearray()
        f.seek(at)

    def fill(self, until: int) -> bool:
        """Makes the bytes up to `until` available; False at the end of the file."""
        while self.base + len(self.data) < until:
            more = self.f.read(READ)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, before: int) -> None:
        n = before - self.base
        if n > 0:
            del self.data[:n]
            self.base = before


def _inflate(r: _Reader, at: int, doubtful: bool) -> tuple[bytearray, int] | None:
    """(decoded bytes, end offset) of the member at `at`; None if it doesn't decode. A
    doubtful one is given up as soon as what it decodes to can't start with a header block."""
    d, out, size, seen = zlib.decompressobj(31), bytearray(), PIECE, 0
    while not d.eof:
        if not r.fill(at + 1):
            return None
        piece = bytes(r.data[at - r.base : at - r.base + size])
        try:
            out += d.decompress(piece)
        except zlib.error:
            return None
        at += len(piece) - len(d.unused_data)
        size = min(2 * size, READ)
        if doubtful and len(out) >= len(VERSION):
            if not out.startswith(VERSION):
                return None
            if out.find(END, max(0, seen - len(END))) >= 0:
                if _header(out) is None:
                    return None
                doubtful = False
            seen = len(out)
    return None if doubtful else (out, at)


def _header(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int] | None:
    """(headers in lower case, start of the content) of the record at `at`."""
    if not data.startswith(VERSION, at):
        return None
    end = data.find(END, at)
    if end < 0:
        return None
    headers: dict[str, str] = {}
    last = None
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last is not None:
            headers[last] = f"{headers[last]} {line.strip(BLANKS)}".strip(BLANKS)
            continue
        k, colon, v = line.partition(":")
        if not colon:
            return None
        last, v = k.strip(BLANKS).lower(), v.strip(BLANKS)
        if last not in headers:
            headers[last] = v
        elif last != "content-length":
            headers[last] += f", {v}"
    length = headers.get("content-length", "")
    return (headers, end + len(END)) if length.isascii() and length.isdigit() else None


def read_range(f, start: int, end: int, size: int):
    """(offset, headers, content) of the records whose members start in [start, end)."""
    r, at, aligned = _Reader(f, start, size), start, False
    while at < end:
        if not aligned:
            r.drop(at)
            r.fill(at + READ)
            k = r.data.find(MAGIC, at - r.base)
            if k < 0:
                at = max(at, r.base + len(r.data) - len(MAGIC) + 1)
                if not r.fill(at + len(MAGIC)):
                    return
                continue
            at = r.base + k
            if at >= end:
                return
        elif not r.fill(at + len(MAGIC)):
            return
        r.drop(at)
        if r.data[: len(MAGIC)] != MAGIC:
            aligned = False
            continue
        whole = _inflate(r, at, not aligned)
        if whole is None:
            aligned, at = False, at + 1
            continue
        data, after = whole
        pos = 0
        while (h := _header(data, pos)) is not None:
            headers, skip = h
            stop = skip + int(headers["content-length"])
            if stop > len(data):
                break
            yield at, headers, bytes(data[skip:stop])
            pos = stop
            while data[pos : pos + 2] == b"\r\n":
                pos += 2
        aligned, at = True, after


def read_plain(f, size: int):
    """(offset, headers, content) of the records of an uncompressed file."""
    r, at = _Reader(f, 0, size), 0
    while r.fill(at + 1):
        r.drop(at)
        if r.data[:2] == b"\r\n":
            at += 2
            continue
        h, seen = None, 0
        while r.fill(at + seen + 1) and r.data.startswith(VERSION[: len(r.data)]):
            if r.data.find(END, max(0, seen - len(END))) >= 0:
                h = _header(r.data)
                break
            seen = len(r.data)
        if h is not None and r.fill(at + h[1] + int(h[0]["content-length"])):
            stop = h[1] + int(h[0]["content-length"])
            yield at, h[0], bytes(r.data[h[1] : stop])
            at += stop
            continue
        at += 1  # damage: on to the next line that starts a record
        while True:
            k = r.data.find(b"\n" + VERSION, at - 1 - r.base if at > r.base else 0)
            if k >= 0:
                at = r.base + k + 1
                break
            at = max(at, r.base + len(r.data) - len(VERSION))
            r.drop(at - 1)
            if not r.fill(r.base + len(r.data) + 1):
                return


def splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, end, size) of the byte ranges of all *.warc.gz files in a folder; an uncompressed *.warc file is one range."""
    if split_bytes < 1:
        raise ValueError("split_bytes must be positive")
    disk, folder = fs.FileSystem.from_uri(path)
    files = [(x.path, x.size) for x in disk.get_file_info(fs.FileSelector(folder, recursive=True)) if x.is_file and x.path.endswith((".warc.gz", ".warc")) and x.size]
    rows = spark.createDataFrame(sorted(files), "path string, size long")
    step = F.when(F.col("path").endswith(".gz"), F.lit(split_bytes).cast("long")).otherwise(F.col("size"))
    rows = rows.select("path", "size", step.alias("step"))
    return rows.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, "step")).alias("start"), "size", "step").select("path", "start", F.least(F.col("start") + F.col("step"), "size").alias("end"), "size")


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the WARC files in a folder, with the columns of SCHEMA."""
    ranges = splits(spark, path, split_bytes)
    n = ranges.count()

    def run(batches):
        disk, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for p, start, end, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows, held = [], 0
                with disk.open_input_file(p) as f:
                    plain = p.endswith(".warc") and f.read(len(MAGIC)) != MAGIC
                    for offset, h, content in read_plain(f, size) if plain else read_range(f, start, end, size):
                        rows.append((p, offset, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), list(h.items()), content))
                        held += len(content) + sum(map(len, h.values()))
                        if held > (4 << 20):
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(max(1, n)).mapInArrow(run, SCHEMA) if n else spark.createDataFrame([], SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=FIELDS)


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, html) from records that `write_pages` wrote."""
    html = F.when(F.coalesce(F.array_contains(F.split(F.col("headers")[NULLS], ","), "html"), F.lit(False)), None).otherwise(F.decode("content", "UTF-8"))
    url = F.coalesce(F.url_decode(F.col("headers")[EXACT_URL]), "target_uri")
    return records.select(F.col("headers")[PAGE_ID].cast("long").alias("page_id"), url.alias("url"), html.alias("html"))


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages written to WARC files in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{Workspace(spark, 'warc').path}/files"
    write_pages(pages, path)
    return pages_of(read_warc(spark, path, split_bytes))


SQL = "SELECT page_id, url, html FROM pages"
