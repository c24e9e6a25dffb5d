"""WARC archives with an index that is written first and read by coalesced byte ranges.

``archive`` writes gzip-member records into one file per task and returns the
index: a row per record with file, offset, length, URL and digest.  ``read``
takes any selection of index rows, sorts it by file and offset, joins
neighbouring ranges into one read each, and parses the records found there.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the smallest page id is a response and the others revisit it; rows that repeat
that page id and payload are responses too.  A row without page id revisits
another's payload but is never referred to.  Null pages are empty payloads;
a null URL leaves the header out; line breaks in a URL are escaped.

A task writes files of its own name for each attempt, and the index names only
those of the attempts that counted, so a lost executor costs a rewrite and
leaves at most a file nobody refers to.  The folder has to be one that pyarrow
reaches from every executor (file on a shared disk, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from votemill import runtime

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, page_id string, digest string, record_type string"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
MAX_FILE = 1 << 30


def first_pages(pages: DataFrame, key: str, html: str, min_revisit: int) -> DataFrame:
    """(digest, first) of payloads that occur more than once."""
    rows = pages.select(F.col(f"`{key}`").alias("page"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.where(F.octet_length("html") >= min_revisit).select("page", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{name}: {value}\r\n".encode() for name, value in fields if value is not None)


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def build(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One record, not compressed; ``first`` is the page a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if first is not None else http + payload
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Profile", None if first is None else PROFILE), ("WARC-Refers-To", None if first is None else record_id(first, digest)),
            ("X-Refers-To-Page", first), ("X-Page-Id", page), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])


def parse(record: bytes) -> tuple:
    """The columns of RECORD from one uncompressed record; a response's digest is taken from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    common = fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields.get("X-Refers-To-Page")
    if fields["WARC-Type"] == "revisit":
        return *common, int(_fields(http)["Content-Length"]), stated, None
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"record of page {fields.get('X-Page-Id')} does not match its digest")
    return *common, len(payload), digest, payload


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 100, level: int = 3) -> DataFrame:
    """Write every page as a record under ``folder`` and return the index, itself written to the shared folder."""
    spark = pages.sparkSession
    runtime.ship(spark)
    folder = folder or runtime.fresh_path(spark, "warc")
    first = runtime.materialize(first_pages(pages, key, html, min_revisit), "warc-first")
    rows = pages.select(F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(first, "digest", "left")
    refers = F.when((F.octet_length("payload") >= min_revisit) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select(F.col("page").cast("string"), "url", "payload", "digest", refers.cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        number, out, at = 0, None, 0
        for batch in batches:
            index = []
            page, link, payload, digest, first_page = batch.columns
            for r in range(batch.num_rows):
                if out is None or at >= MAX_FILE:
                    if out is not None:
                        out.close()
                    name, number, at = f"{stem}-{number:03d}.warc.gz", number + 1, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                own, where, hexed, refers_to = page[r].as_py(), link[r].as_py(), digest[r].as_py(), first_page[r].as_py()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(build(own, where, payload[r].as_py(), hexed, refers_to)) + packer.flush()
                out.write(data)
                index.append((name, at, len(data), where, own, hexed, "response" if refers_to is None else "revisit"))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index) if index else [()] * 7, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4])],
                                             names=["file", "offset", "length", "url", "page_id", "digest", "record_type"])
        if out is not None:
            out.close()

    index = runtime.materialize(rows.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (file, offset, length), sorted, whose ranges one read covers."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[-1][0] or row[1] - (run[-1][1] + run[-1][2]) > gap or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(index: DataFrame, with_payload: bool = True, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """The records of the given index rows, as RECORD; ranges at most ``gap`` bytes apart are read at once, up to ``most`` bytes."""
    spark = index.sparkSession
    runtime.ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = index.select("folder", "file", "offset", "length").repartitionByRange(parts, "folder", "file", "offset").sortWithinPartitions("folder", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            for group in ranges([(f"{folder}/{name}", at, size) for folder, name, at, size in rows], gap, most):
                store, path = fs.FileSystem.from_uri(group[0][0])
                start, end = group[0][1], group[-1][1] + group[-1][2]
                with store.open_input_file(path) as source:
                    data = source.read_at(end - start, start)
                records = [parse(zlib.decompress(data[at - start:at - start + size], 31)) for _, at, size in group]
                columns = list(zip(*records))
                if not with_payload:
                    columns[6] = [None] * len(records)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()])],
                                                 names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return chosen.mapInArrow(run, RECORD)
