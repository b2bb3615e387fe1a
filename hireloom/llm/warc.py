"""Web archives: write records with an index, read back only what is wanted.

Every page becomes a record, compressed on its own, in archive files in a
shared folder. The index table has archive, offset, length, URL and digest of
each record. Reading starts from the index: rows of the wanted records are
dealt by archive and stretch, sorted by offset, and near ranges are joined to
one read. Files are reached through ``pyarrow.fs``, so the folder may lie in
any store that it knows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shared import partitions

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# End of the fixed values.

INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, stated_digest string, payload binary"
_EPOCH = b"1970-01-01T00:00:00Z"


def _name(page_id: int | None) -> bytes:
    return b"<urn:hireloom:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def _page(name: bytes | None) -> int | None:
    number = (name or b"").strip(b"<>").rpartition(b":")[2]
    return int(number) if number.lstrip(b"-").isdigit() else None


def _uri(url: str) -> bytes:
    """Control characters and spaces are escaped, so that a header stays one line; the index keeps the URL as given."""
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url.encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a revisit has the HTTP head alone, a response also the payload."""
    block = HTTP_HEAD % len(payload) + (payload if refers_to is None else b"")
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _name(page_id), b"WARC-Date: " + _EPOCH]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _uri(url))
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + _name(refers_to)]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A row of ``RECORDS`` from one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    kind = fields[b"WARC-Type"].decode()
    url = fields.get(b"WARC-Target-URI")
    return (
        _page(fields[b"WARC-Record-ID"]),
        None if url is None else url.decode(),
        kind,
        _page(fields.get(b"WARC-Refers-To")),
        fields[b"WARC-Payload-Digest"].partition(b":")[2].decode(),
        block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
    )


def _packed(raw: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Archive:
    """One growing archive file of a task attempt, and the index rows of its records."""

    def __init__(self, folder: str, name: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.name, self.at = name, 0
        self.out = self.store.open_output_stream(f"{path}/{name}", compression=None)

    def add(self, raw: bytes) -> tuple[int, int]:
        data, at = _packed(raw), self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)


def with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages(page_id, url, payload)`` with digest, size and, for all but the smallest id of equal payloads, ``refers_to``."""
    sized = pages.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = (
        sized.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("top"))
        .where("first < top")
        .select("payload_digest", "first")
    )
    found = sized.join(firsts, "payload_digest", "left")
    return found.withColumn("refers_to", F.expr("CASE WHEN page_id > first THEN first END")).drop("first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for every row below ``folder`` and return the index, a table there.

    Of rows with equal payloads of ``least_bytes`` or more, those of the
    smallest id are responses and the others revisits of it; a null id is
    always a response. A null html is an empty payload. Rows that repeat are
    all written. An empty table gives an empty index. Other columns are
    ignored. Files are named by task attempt and only those of attempts that
    ended well are in the index, so a lost executor leaves no wrong entry.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, archive = 0, None
        with ExitStack() as opened:  # closed however the task ends
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if archive is None or archive.at >= archive_bytes:
                        opened.close()
                        archive = _Archive(f"{folder}/archives", f"{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz")
                        opened.callback(archive.out.close)
                        number += 1
                    offset, length = archive.add(record(page_id, url, payload, digest, refers_to))
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((archive.name, offset, length, page_id, url, digest, size, kind, refers_to))
                yield _batch(rows, INDEX)

    ordered = with_revisits(base, least_bytes).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
    index = ordered.mapInArrow(write, INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = [*zip(*rows, strict=True)] or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def read_records(selected: DataFrame, folder: str, stretch: int = 32 << 20, gap: int = 1 << 20, most: int = 8 << 20) -> DataFrame:
    """The records (``RECORDS``) of selected index rows.

    Rows are dealt by archive and ``stretch`` of bytes, to a task for each
    stretch of what they point at, and sorted by offset; ranges at most ``gap``
    apart are joined to reads of at most ``most`` bytes (or one record).
    Selected rows that repeat give repeated records. Index rows hold no nulls
    but ids and URLs; an empty index gives no rows.
    """
    spark = selected.sparkSession
    pointed = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # Spark would size the tasks by the index rows, not by the bytes behind them.
    tasks = max(partitions(spark), -(-pointed // stretch))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/archives")
        current, archive = None, None
        with ExitStack() as opened:
            for batch in batches:
                spans = [*zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
                at = 0
                while at < len(spans):
                    name, low, size = spans[at]
                    high, to = low + size, at + 1
                    while to < len(spans) and spans[to][0] == name and spans[to][1] - high <= gap and spans[to][1] + spans[to][2] - low <= most:
                        high, to = max(high, spans[to][1] + spans[to][2]), to + 1
                    if current != name:
                        opened.close()
                        current, archive = name, opened.enter_context(store.open_input_file(f"{root}/{name}"))
                    data = archive.read_at(high - low, low)
                    yield _batch([parse(zlib.decompress(data[o - low : o - low + n], 31)) for _, o, n in spans[at:to]], RECORDS)
                    at = to

    places = selected.select("archive", "offset", "length", F.floor(F.col("offset") / stretch).alias("part"))
    dealt = places.repartition(tasks, "archive", "part").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(read, RECORDS)


def read_pages(selected: DataFrame, folder: str) -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` as read from the archives.

    Size and digest of a response are computed from its payload; a revisit
    takes those of the response to which it refers, which must be selected too;
    where it is not, size and digest are null. A null html was written as an
    empty payload. Rows that repeat come back as often; an empty index gives no
    rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("page_id", "url", "record_type", "refers_to")),
                 pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
                 pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payloads], pa.string())],
                ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"],
            )

    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"

    def digested(index: DataFrame) -> DataFrame:
        return read_records(index, folder).mapInArrow(digest, fields)

    responses, revisits = (selected.where(F.col("record_type") == kind) for kind in ("response", "revisit"))
    # Of the responses only those that a revisit names are read once more.
    targets = responses.join(revisits.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    full = digested(targets).groupBy("page_id").agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("full"))
    found = digested(revisits).drop("payload_bytes", "payload_digest").join(full.withColumnRenamed("page_id", "refers_to"), "refers_to", "left")
    return digested(responses).unionByName(found.select("page_id", "url", "record_type", "refers_to", "full.payload_bytes", "full.payload_digest"))
