"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Each record is a gzip member of its own. The reader checks member (zlib's CRC), version line, header, Content-Length, the two
line ends behind the block, and the block's digest. Where a check fails it searches the bytes behind for the next member or
version line that passes, goes on there, and logs the bytes between as a quarantined gap. Archives are read a window at a time, so
they may be of any size; what is held whole is one gzip member or record.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, frugal, materialise, short_batches

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes unpacked at once, and bytes of an archive that are held.
_STEP, _WINDOW = 1 << 16, 1 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(record_id: str | None) -> int | None:
    tail = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "2026-01-01T00:00:00Z") -> bytes:
    """A response record, or with refers_to a revisit record: the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", "".join((url or "").split()))]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def compressed(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- salvage


class Source:
    """Random access to an archive through a window, with searches that remember what they found."""

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        self.size = self.file.size()
        self.start, self.window = 0, b""
        self.known: dict[bytes, tuple[int, int]] = {}

    def read(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if b <= a:
            return b""
        if not self.start <= a <= b <= self.start + len(self.window):
            self.start, self.window = a, self.file.read_at(max(b - a, _WINDOW), a)
        return self.window[a - self.start : b - self.start]

    def find(self, needle: bytes, start: int) -> int:
        """The first place from `start` on, or -1. A place found before is the answer for every start up to it."""
        since, place = self.known.get(needle, (0, -2))
        if place != -2 and since <= start and (place == -1 or start <= place):
            return place
        at, place = start, -1
        while at < self.size and place < 0:
            held = self.read(at, at + _WINDOW)
            k = held.find(needle)
            place = at + k if k >= 0 else -1
            at += max(1, len(held) - len(needle) + 1)
        self.known[needle] = (start, place)
        return place


def _member(source: Source, at: int) -> tuple[bytes, int] | None:
    """The bytes of the gzip member at `at` and where it ends, if it is whole."""
    unpack, out = zlib.decompressobj(31), []
    while at < source.size:
        part = source.read(at, at + _STEP)
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            return None
        at += len(part)
        if unpack.eof:
            return b"".join(out), at - len(unpack.unused_data)
    return None


def _record(source: Source, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header, block and end of the record at `at`, or which check failed."""
    if source.read(at, at + len(VERSION)) != VERSION:
        return "no version line"
    split = source.find(b"\r\n\r\n", at)
    if split < 0:
        return "unended header"
    head: dict[str, str] = {}
    for line in source.read(at, split).decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return "malformed header"
        head[key.strip().lower()] = value.strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return "no content length"
    start, end = split + 4, split + 4 + int(length)
    if source.read(end, end + 4) != b"\r\n\r\n":
        return "wrong content length"
    block = source.read(start, end)
    name, _, said = head.get("warc-block-digest", "").partition(":")
    if name.lower() == "sha1" and said != digest(block):
        return "wrong block digest"
    return head, block, end + 4


def salvage(data: Source | bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(offset, length, header, block, reason) of each record, and of each gap with no header and a reason, in order.

    Offsets are those of the archive; records that share a gzip member share its offset and length. An empty archive has none.
    """
    source, at = Source(data) if isinstance(data, bytes) else data, 0
    gap: tuple[int, str] | None = None
    while at < source.size:
        found, end, reason = _here(source, at)
        if found:
            if gap:
                yield gap[0], at - gap[0], None, b"", gap[1]
                gap = None
            for head, block in found:
                yield at, end - at, head, block, ""
            if reason:  # the rest of a member
                yield at, end - at, None, b"", reason
            at = end
            continue
        gap = gap or (at, reason)
        after = [p for p in (source.find(MAGIC, at + 1), source.find(VERSION, at + 1)) if p >= 0]
        at = min(after, default=source.size)
    if gap:
        yield gap[0], source.size - gap[0], None, b"", gap[1]


def _here(source: Source, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int, str]:
    """The records at `at`, where they end, and why there are none or not all of a member."""
    if source.read(at, at + 3) != MAGIC:
        got = _record(source, at)
        return ([], at, got) if isinstance(got, str) else ([got[:2]], got[2], "")
    member = _member(source, at)
    if member is None:
        return [], at, "broken member"
    inner, end = Source(member[0]), member[1]
    out, p, reason = [], 0, ""
    while p < inner.size:
        got = _record(inner, p)
        if isinstance(got, str):
            reason = reason or got
            p = inner.find(VERSION, p + 1)
            if p < 0:
                break
            continue
        out.append(got[:2])
        p = got[2]
    return out, end, reason if out else reason or "empty member"


# ---------------------------------------------------------------- frames

READ_SCHEMA = "path string, offset long, length long, gap string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 8_000_000) -> DataFrame:
    """Writes a record for each row of page_id, url and html into archives under `folder`, a URI that the executors reach.

    Of rows with equal payloads of at least least_bytes bytes, that with the largest page_id is the response and the others revisit
    it; all other rows are responses. Returns the manifest: path, records and bytes of each archive.

    A null html is an empty payload, a null url an empty one. Rows that share the largest page_id are all responses, and
    so are equal payloads none of which has a page_id; a null page_id is less than any other. A task's archives get
    their final names, the same for every attempt, once all are written. An empty table writes nothing.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    newest = large.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest")
    rows = rows.join(newest, "digest", "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to")).sortWithinPartitions("page_id", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        done: list[tuple[str, str, int, int]] = []
        sink, count, size = None, 0, 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, refers_to = (x.as_py() for x in row)  # one payload at a time
                if sink is None:
                    name = f"part-{task.partitionId():06d}-{len(done):05d}.warc.gz"
                    temporary = f"{root}/_{task.taskAttemptId()}-{name}"
                    sink, count, size = files.open_output_stream(temporary, compression=None), 0, 0
                data = compressed(record(page_id, url, payload, refers_to))
                sink.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    done.append((temporary, name, count, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((temporary, name, count, size))
        for temporary, name, _, _ in done:
            files.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[1]}" for x in done], pa.string()), *(pa.array([x[k] for x in done], pa.int64()) for k in (2, 3))], ["path", "records", "bytes"])

    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    short_batches(pages.sparkSession)
    return materialise(rows.mapInArrow(frugal(write), "path string, records long, bytes long"))


def _uri(path: str) -> str:
    """A path as Spark gives it, as a URI with an authority."""
    return re.sub("^file:/+", "file:///", urllib.parse.quote(path, safe=":/@%"))


def _opens(path: str) -> bool:
    """Whether Python can open files there itself."""
    try:
        pyarrow.fs.FileSystem.from_uri(_uri(path))
    except (pa.ArrowException, OSError):
        return False
    return True


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives under a path: gap is null for records and the failed check for gaps.

    payload_bytes and payload_digest are those of the full payload; a revisit has them from its headers and its payload is null.
    Archives may be of any size and are read a window at a time; only in a store that nothing but Spark can open are they read as
    wholes, there below 2 GB. Empty archives give no rows, and so does a folder without files; a path that doesn't exist is an error.
    """
    files = spark.read.format("binaryFile").load(path)
    if _opens(path if ":" in path else "file:" + path):
        return read_paths(files.select("path"), payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from _rows(path.as_py(), Source(data.as_py()), payloads)

    return files.select("path", "content").mapInArrow(frugal(read), READ_SCHEMA)


def read_paths(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records and gaps of the archives that a frame's column `path` names, each a window at a time. Null paths are left out; an empty frame gives an empty frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = pyarrow.fs.FileSystem.from_uri(_uri(path))
                with files.open_input_file(name) as file:
                    yield from _rows(path, Source(file), payloads)

    return paths.where("path IS NOT NULL").select("path").mapInArrow(frugal(read), READ_SCHEMA)


def _rows(path: str, source: Source, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The rows of an archive, some MB at a time."""
    out, held = [], 0
    for offset, length, head, block, reason in salvage(source):
        row = _row(path, offset, length, head, block, reason, payloads)
        out.append(row)
        held += len(row["payload"] or b"") + 200
        if held > 8_000_000:
            yield _batch(out)
            out, held = [], 0
    yield _batch(out)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_FIELDS = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in READ_SCHEMA.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _FIELDS)


def _row(path: str, offset: int, length: int, head: dict[str, str] | None, block: bytes, reason: str, payloads: bool) -> dict:
    row = dict.fromkeys(_FIELDS.names) | {"path": path, "offset": offset, "length": length}
    if head is None:
        return row | {"gap": reason}
    http, _, payload = block.partition(b"\r\n\r\n") if "http" in head.get("content-type", "") else (b"", b"", block)
    row |= {"record_type": head.get("warc-type"), "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri")}
    if row["record_type"] == "revisit":
        said = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        full = int(said[0]) if said and said[0].isdigit() else None
        return row | {"refers_to": _page(head.get("warc-refers-to")), "payload_bytes": full, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    return row | {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload if payloads else None}


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the session's shared folder and reads them back (records only, without payloads).

    Fails if the archives give back fewer or more records than were written. An empty table gives an empty frame.
    """
    spark = pages.sparkSession
    base = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    # a folder without a scheme is one of the session's default file system, as for Spark
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    manifest = write_archives(pages, re.sub("^file:/+", "file:///", f"{base}/warc-{uuid.uuid4().hex}"), least_bytes)
    archives, written = manifest.agg(F.count("*"), F.sum("records")).first()
    if not archives:
        return spark.createDataFrame([], READ_SCHEMA)
    tasks = max(1, min(archives, 8 * spark.sparkContext.defaultParallelism, math.ceil(written / 1000)))
    found = materialise(read_paths(manifest.repartition(tasks, "path"), payloads=False).where("gap IS NULL"))
    read = found.count()
    if read != written:
        raise ValueError(f"{written} records were written, {read} came back")
    return found
