"""WARC archives as a chunked record table: oversized payloads stream as (record, chunk) rows."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import Stage, by_value

CHUNK = 1 << 18
# Rows go to Spark in batches of about this many bytes.
BATCH = 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "row long, page_id long, url string, record string, chunk_no int, data binary, n_bytes long, sha1 string, last boolean"


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


class _Batches:
    """Collects rows and gives them out once they hold enough bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int):
        self.rows.append(row)
        self.size += size + 64
        if self.size >= BATCH:
            yield self.flush()

    def flush(self):
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


_CHUNK_SCHEMA = pa.schema(
    [("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record", pa.string()), ("chunk_no", pa.int32()),
     ("data", pa.binary()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("last", pa.bool_())]
)


def chunked(pages: DataFrame, chunk: int = CHUNK, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """The chunk table: row, page_id, url, record, chunk_no, data, n_bytes, sha1, last.

    row numbers the rows of pages, so equal rows are records of their own; page_id and record (the
    whole payload's digest) lead to the entry of records(). n_bytes and sha1 (upper-case base32) are running: they cover the payload up to and with
    this chunk, so the last chunk's are the whole payload's. A null or empty payload is one
    empty chunk. url is carried by chunk 0 alone; a page table without urls has null ones.
    """
    link = F.col(url) if url in pages.columns else F.lit(None)
    source = pages.select(F.col(page_id).cast("long"), link.cast("string"), F.col(payload).cast("binary"), F.monotonically_increasing_id())

    def cut(batches):
        out = _Batches(_CHUNK_SCHEMA)
        for batch in batches:
            for i in range(batch.num_rows):
                buffer = batch.column(2)[i].as_buffer()
                view = memoryview(buffer) if buffer is not None else memoryview(b"")
                page, address, number = (batch.column(c)[i].as_py() for c in (0, 1, 3))
                digest, record = hashlib.sha1(), _base32(hashlib.sha1(view))
                for no, at in enumerate(range(0, max(1, len(view)), chunk)):
                    part = bytes(view[at : at + chunk])
                    digest.update(part)
                    end = at + len(part)
                    row = (number, page, address if no == 0 else None, record, no, part, end, _base32(digest), end == len(view))
                    yield from out.add(row, len(part))
        yield out.flush()

    return source.mapInArrow(cut, CHUNKS)


def records(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, n_bytes, sha1, refers_to.

    Of pages with equal payloads (digest and length) of at least least_bytes, the one with the
    largest page_id is the response and has a null refers_to; the others refer to it. Smaller
    payloads are all responses. Counts combine before the shuffle, so one payload that a third
    of the pages share is no hot task.
    """
    last = chunks.filter("last").select("page_id", "n_bytes", "sha1")
    kept = last.filter((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    top = kept.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).filter("c > 1")
    joined = last.join(top.drop("c"), ["sha1", "n_bytes"], "left")
    return joined.select("page_id", "n_bytes", "sha1", F.expr("if(page_id < top, top, null)").alias("refers_to"))


def _open(path: str):
    """(file system, path inside) for any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


def _urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _head(page, url, n_bytes: int, sha1: str, refers_to) -> bytes:
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: {_urn(page)}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Payload-Length: {n_bytes}"]
    lines += ["Content-Type: text/html", f"Content-Length: {n_bytes if refers_to is None else 0}", "", ""]
    return "\r\n".join(lines).encode()


def write(chunks: DataFrame, index: DataFrame, folder: str, most_bytes: int = 256 << 20) -> DataFrame:
    """Write the records as gzipped WARC files under folder; gives (path, n_records) of each file.

    chunks is chunked()'s table, index records()'s. A page's chunks meet in one task, in order,
    and are written as they come, each record a gzip member; a revisit has no body. A file is
    closed beyond most_bytes. Every attempt of a task writes files of its own name, and only
    those named in the result count, so a repeated attempt does no harm.
    """
    notes = index.select(F.col("page_id").alias("_id"), "n_bytes", F.col("sha1").alias("_sha1"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("record") == F.col("_sha1"))
    joined = chunks.select("row", "page_id", "url", "record", "chunk_no", "data").join(notes, same)
    # A revisit's body is not read again.
    joined = joined.filter("refers_to is null or chunk_no = 0").withColumn("data", F.expr("if(refers_to is null, data, null)"))
    joined = joined.sortWithinPartitions("page_id", "record", "row", "chunk_no")

    def put(batches):
        import uuid

        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        sink = packer = None
        done, path, count, size = [], "", 0, 0

        def close():
            nonlocal sink, packer
            if packer is not None:
                sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
                packer = None

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] == 0:
                    close()
                    if sink is not None and size >= most_bytes:
                        sink.close()
                        done.append((path, count))
                        sink = None
                    if sink is None:
                        path, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = system.open_output_stream(f"{top}/{path}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    sink.write(packer.compress(_head(r["page_id"], r["url"], r["n_bytes"], r["record"], r["refers_to"])))
                    count += 1
                if r["data"]:
                    sink.write(packer.compress(r["data"]))
                    size += len(r["data"])
        close()
        if sink is not None:
            sink.close()
            done.append((path, count))
        names, counts = zip(*done) if done else ((), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "n_records"])

    columns = ["page_id", "url", "record", "chunk_no", "data", "n_bytes", "refers_to"]
    return joined.select(columns).mapInArrow(put, "path string, n_records long")


def read(files: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of archives named by files(path) under folder, with record headers.

    page_id, url, record_type, refers_to, chunk_no, data, n_bytes, sha1, last: n_bytes and sha1
    run along with the chunks as in chunked(). A revisit is one row without data, whose
    n_bytes and sha1 are those of the payload it stands for. A file is read as a stream, never
    whole; a record that ends early raises EOFError.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("chunk_no", pa.int32()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("last", pa.bool_())]
    )

    def number(urn):
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def scan(stream, out):
        while True:
            line = stream.readline()
            if not line:
                return
            if not line.strip():
                continue
            head = {}
            while line := stream.readline().strip():
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            page, url, kind = number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"]
            left, digest, no, end = int(head["content-length"]), hashlib.sha1(), 0, 0
            if kind == "revisit":
                sha1, end = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                yield from out.add((page, url, kind, number(head["warc-refers-to"]), 0, None, end, sha1, True), 0)
                continue
            while left or no == 0:
                part = stream.read(min(chunk, left))
                if len(part) < min(chunk, left):
                    raise EOFError(f"record of page {page} ends early")
                digest.update(part)
                left, end = left - len(part), end + len(part)
                row = (page, url if no == 0 else None, kind, None, no, part, end, _base32(digest), left == 0)
                yield from out.add(row, len(part))
                no += 1

    def get(batches):
        import gzip

        system, top = _open(folder)
        out = _Batches(schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{top}/{path}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    yield from scan(stream, out)
        yield out.flush()

    kinds = "page_id long, url string, record_type string, refers_to long, chunk_no int, data binary, n_bytes long, sha1 string, last boolean"
    return files.select("path").mapInArrow(get, kinds)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC records in the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Edge cases: a null or empty html is an empty payload; a null url is left out; a page
    without page_id is a response, with a null id; rows that repeat a page_id are a record each,
    with equal payloads all of the same type. Other columns are not read. No pages, no records.
    """
    stage = Stage(pages.sparkSession, "warc")
    # Hash partitions of pages hold whole records, so what one task writes is bounded by it.
    chunks = chunked(pages)
    index = stage.keep(records(chunks, least_bytes), "index")
    folder = stage.path("archive")
    files = stage.keep(write(chunks, index.distinct(), folder), "files")
    n = files.count()
    back = read(files.repartition(max(1, n)), folder)
    return back.filter("last").select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + strpos('{''.join(format(i, '05b') + ' ' for i in range(32))}', substr(b, {1 + 5 * i}, 5)) // 6, 1)" for i in range(32))
QUERIES = {"op10_warc": op10}
SQL = {
    "op10_warc": f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, '')))::BIGINT AS n
  FROM pages
),
x AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top,
         list_aggregate(list_transform(range(1, 41), lambda i: right(bin(strpos('0123456789abcdef', substr(hex, i::INT, 1)) + 15), 4)), 'string_agg', '') AS b
  FROM p
)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM x
"""
}

by_value(__name__)
