"""WARC archives written and read as a table of record and chunk numbers."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, may_be_in, saved, shared_dir

#: Bytes of a payload in one row; no task holds more of a record than a few chunks.
CHUNK = 1 << 18
#: Bytes after which a task starts another archive.
ARCHIVE = 1 << 28
#: WARC-Date of all records, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"

_ID = "urn:page:"


def record_types(pages: DataFrame, payload: str = "html", least: int = 0) -> DataFrame:
    """page_id, sha1 (hex) of the pages that are revisits, and refers_to. Of records with
    equal payloads of at least `least` bytes the smallest page_id is the response; rows that
    repeat it are responses too. Null payloads count as empty, null ids come last; repeated rows are
    listed once; an empty table has no revisits; other columns aren't read."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    light = saved(pages.select("page_id", F.sha1(body).alias("sha1"), F.octet_length(body).alias("n")), "digests").where(F.col("n") >= least)
    first = light.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return light.join(first, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def chunk_table(pages: DataFrame, payload: str = "html", least: int = 0, chunk: int = CHUNK, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A row per chunk: page_id, url, sha1, n_bytes (of the whole payload), refers_to (null in
    responses), chunk_no, data. A record's chunks follow each other; a revisit has one, empty.

    Up to `limit` revisits are broadcast; of more, only payloads that a filter of their keys lets through
    meet them in a shuffle. Null payloads count as empty; repeated rows are records each; an empty table has no
    chunks; other columns aren't read."""
    revisits = saved(record_types(pages, payload, least), "revisits").withColumnsRenamed({"page_id": "r_id", "sha1": "r_sha1"})
    rows = pages.select("page_id", "url", F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body")).withColumn("sha1", F.sha1("body"))
    on = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1"))
    if revisits.limit(limit + 1).count() <= limit:
        rows = rows.join(F.broadcast(revisits), on, "left")
    else:
        sifted = may_be_in(rows, F.xxhash64("page_id", "sha1"), revisits, F.xxhash64("r_id", "r_sha1"), "may")
        rows = sifted.where("NOT may").unionByName(sifted.where("may").join(revisits, on, "left"), allowMissingColumns=True).drop("may")
    rows = rows.withColumn("revisit", F.col("r_sha1").isNotNull())
    last = F.when(F.col("revisit"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.octet_length("body") - 1) / F.lit(chunk)))).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "sha1", F.octet_length("body").cast("long").alias("n_bytes"), "revisit", "refers_to", "chunk_no", data.alias("data"))


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _head(row: dict) -> bytes:
    """The WARC header and, for a response, the HTTP header that starts its block."""
    name = lambda x: f"<{_ID}{'' if x is None else x}>"
    http = b"" if row["revisit"] else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "%0A", row["url"]))
    if row["revisit"]:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(row['refers_to'])}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(row['sha1'])}", f"X-Payload-Length: {row['n_bytes']}", f"Content-Length: {len(http) + (0 if row['revisit'] else row['n_bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes a chunk table as gzip members, one a record, below `folder`; returns the written
    table of path, records and bytes. Each attempt of a task has files of its own and only
    those of attempts that ended well are listed, so lost executors leave no trace. No chunks
    make no archives; repeated records are written each."""
    source, base = pafs.FileSystem.from_uri(folder)
    source.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        part, out, path, packer, digest, due = TaskContext.get().partitionId(), None, "", None, None, ""
        records, size, done = 0, 0, []

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            size += len(data)

        def close() -> None:
            nonlocal packer
            if packer:
                if digest is not None and digest.hexdigest() != due:
                    raise ValueError(f"the chunks of a record in {path} don't have its digest")
                put(packer.compress(b"\r\n\r\n") + packer.flush())
                packer = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    close()
                    if out and size > ARCHIVE:
                        out.close()
                        done.append((path, records, size))
                        out = None
                    if not out:
                        path, records, size = f"{root}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(path)
                    records, packer = records + 1, zlib.compressobj(4, zlib.DEFLATED, 31)
                    digest, due = (None, "") if row["revisit"] else (hashlib.sha1(), row["sha1"])
                    put(packer.compress(_head(row)))
                if digest is not None:
                    digest.update(row["data"])
                    put(packer.compress(row["data"]))
        close()
        if out:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return saved(chunks.mapInArrow(write, "path string, records long, bytes long"), "archives")


CHUNKS = "page_id string, url string, record_type string, refers_to string, declared_bytes long, declared_digest string, chunk_no int, chunk_bytes int, read_bytes long, sha1 string, last boolean, data binary"


def _read(stream, chunk: int, with_data: bool) -> Iterator[tuple]:
    """The chunks of an archive; sha1 and read_bytes are of the payload up to and with the chunk."""
    with gzip.GzipFile(fileobj=stream) as file:
        while line := file.readline():
            if line in (b"\r\n", b"\n"):
                continue
            head = {}
            while (line := file.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                head[k] = v
            left = int(head["Content-Length"])
            if head["WARC-Type"] == "response":
                while (line := file.readline()) not in (b"\r\n", b""):
                    left -= len(line)
                left -= 2
            ids = [x and x[1 + len(_ID) : -1] or None for x in (head["WARC-Record-ID"], head.get("WARC-Refers-To"))]
            fixed = (ids[0], head.get("WARC-Target-URI"), head["WARC-Type"], ids[1], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"))
            digest, no, read = hashlib.sha1(), 0, 0
            while True:
                data = file.read(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise EOFError("an archive ends inside a record")
                left, read = left - len(data), read + len(data)
                digest.update(data)
                yield (*fixed, no, len(data), read, digest.hexdigest(), not left, data if with_data else None)
                no += 1
                if not left:
                    break


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the listed archives (ids as strings), each read as a stream by a task
    of its own. Records come as they stand: repeated ones repeatedly, those of null ids with a
    null id, empty payloads as one empty chunk; no archives, no rows."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CHUNKS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for row in _read(stream, chunk, with_data):
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                        if held > 16 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    # A range per archive: a number that is asked for isn't merged, however few bytes the list has.
    return archives.select("path").repartitionByRange(max(1, archives.count()), "path").mapInArrow(read, CHUNKS)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


def records(chunks: DataFrame) -> DataFrame:
    """A row per record of a chunk table, from its last chunk: what a response's payload holds
    as read, and what a revisit declares of the payload it refers to. Other columns are left out;
    an empty table has no records."""

    @F.pandas_udf("string")
    def base32(hexes):
        return hexes.map(_base32)

    response = F.col("record_type") == "response"
    return chunks.where("last").select(
        "page_id", "url", F.when(response, F.col("read_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.when(response, base32("sha1")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", F.when(~response, F.col("refers_to")).alias("refers_to")
    )
