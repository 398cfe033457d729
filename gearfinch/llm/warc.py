"""WARC archives: a deterministic sharded writer, and a reader.

Rows are sorted by page id over range partitions.  Each partition writes gzip members (one a record) to files under
temporary names and rolls to a new file by compressed size.  A first manifest lists the temporary files; a commit job
renames them and the final manifest names only what is committed, so a task that is run again, or a job that dies,
leaves no half archive that a reader would see.  Headers, digests, ids and dates are made from the content: equal input
gives equal files.

Of rows with equal payloads of `least` bytes or more, the one with the largest id is the response and the others are
revisit records that refer to it.  Null html is an empty payload.  Equal rows with the largest id are all responses, as
are rows without an id if no row with an id has their payload.  A null url leaves out the target URI; control characters
and blanks in it are percent-encoded.  An empty table makes an empty manifest.
A payload of any length is one record; it is held whole by the task that writes it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import partitions, scratch, table, text_bytes

ROLL_BYTES = 32 << 20
PARTITION_BYTES = 32 << 20
LEAST = 0
DATE = "2024-01-01T00:00:00Z"
_FILES = "temporary string, name string, records long, bytes long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """One record; keeper: the page of the response, if this one revisits it."""
    digest, revisit = base32_sha1(payload), keeper is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(keeper, digest)}", f"X-Refers-To-Page-Id: {keeper}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def keepers(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digest, keeper of the pages that revisit another."""
    rows = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    per = rows.groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(per, ["digest", "n"]).where("keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper)").select("page_id", "digest", "keeper").distinct()


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives and their manifest into folder (a new one); returns the manifest: name, records, bytes, sha256."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    n = min(100_000, max(partitions(spark), -(-text_bytes(pages, "html") // PARTITION_BYTES)))
    roles = keepers(pages, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "keeper", F.lit(0).alias("kind"))
    rows = pages.select("*", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("keeper"), F.lit(1).alias("kind")).unionByName(roles)
    ordered = rows.repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "kind", "url", F.sha1("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/_temporary")
        part, serial, out, at, own = context.partitionId(), 0, None, None, {}
        done = []

        def close() -> None:
            out["stream"].close()
            done.append((out["path"], out["name"], out["records"], out["bytes"], out["sha"].hexdigest()))

        for batch in batches:
            for page_id, url, html, digest, keeper, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != page_id:
                    at, own = page_id, {}
                if kind == 0:
                    own[digest] = keeper
                    continue
                payload = html.encode()
                data = member(record(page_id, url, payload, own.get(hashlib.sha1(payload).hexdigest()) if own else None))
                if out and out["bytes"] + len(data) > roll_bytes:
                    close()
                    out, serial = None, serial + 1
                if not out:
                    name = f"part-{part:06d}-{serial:05d}.warc.gz"
                    path = f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
                    out = {"name": name, "path": path, "stream": fs.open_output_stream(path, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                    head = member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                    out["stream"].write(head)
                    out["bytes"] += len(head)
                    out["sha"].update(head)
                out["stream"].write(data)
                out["records"] += 1
                out["bytes"] += len(data)
                out["sha"].update(data)
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["temporary", "name", "records", "bytes", "sha256"])

    ordered.select("page_id", "url", "html", "digest", "keeper", "kind").mapInArrow(write, _FILES).write.parquet(f"{folder}/_written")
    written = spark.read.schema(_FILES).parquet(f"{folder}/_written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(row["temporary"]).type != pyarrow.fs.FileType.NotFound:  # else an earlier try moved it
                    fs.move(row["temporary"], f"{root}/{row['name']}")
            yield batch.drop_columns(["temporary"])

    written.mapInArrow(commit, "name string, records long, bytes long, sha256 string").write.parquet(f"{folder}/manifest")
    return spark.read.schema("name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members, a few kilobytes at a time."""
    z, data = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal z
        raw = z.unused_data if z.eof else b""
        if z.eof:
            z = zlib.decompressobj(31)
        raw = raw or stream.read(1 << 16)
        if not raw:
            return False
        data.extend(z.decompress(raw))
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("a record breaks off")
                return
        lines = data[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        while len(data) < end + 8 + size:
            if not more():
                raise ValueError("a record breaks off")
        yield head, bytes(data[end + 4 : end + 4 + size])
        del data[: end + 8 + size]


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, digests checked; a task for a few files each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in read_records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = head["WARC-Type"] == "response"
                        if base32_sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:") or response and (base32_sha1(payload) != digest or len(payload) != length):
                            raise ValueError(f"{name}: a record does not match its digest")
                        number = lambda h: int(head[h]) if h in head else None
                        rows.append((number("X-Page-Id"), head.get("WARC-Target-URI"), length, digest, head["WARC-Type"], number("X-Refers-To-Page-Id"), payload if payloads and response else None))
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return manifest.select("name").repartition(4 * partitions(manifest.sparkSession)).mapInArrow(read, _RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) payload_bytes, sha1(html) hex, html FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('{_BASE32}', 1 + CAST((CAST('0x' || substr(hex || '00', CAST(floor(i * 5 / 4) AS BIGINT) + 1, 2) AS BIGINT) // CAST(pow(2, 8 - (i * 5) % 4 - 5) AS BIGINT)) % 32 AS BIGINT), 1)), '') payload_digest,
  max(page_id) OVER (PARTITION BY html) keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN page_id <> keeper THEN keeper END refers_to FROM b
"""
