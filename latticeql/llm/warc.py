"""WARC archives and revisit resolution.

Pages are first written as archives of response records, a gzip member each; the writers return a header row for each record: file,
place, id and payload digest. Headers alone are shuffled by payload digest: the record with the largest id of each digest is the original, and
the other records of that digest are joined to it. The archives are then rewritten file by file with fresh headers: a
record that has an original elsewhere becomes a revisit record that names it and carries no payload, the others stay responses.
Payloads never enter a shuffle, so a page that a third of all rows share moves only headers.

Cases: a null page is an empty payload; payloads shorter than LEAST bytes are never revisits; of records that repeat
payload and id, the one that lies last is the original; null ids lose against any other, and null urls have no target
header; an empty table gives no archives and an empty result. Only the named columns are read, so others can have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm.common import bound_batches, fresh_dir, join_groups, make_dir, shuffle_partitions, store, text_of, written

#: Bytes that a payload needs to be replaced by a reference.
LEAST = 1000
#: Level of compression.
LEVEL = 4
#: Records of a batch that a task hands on.
ROWS = 500

# Fixed values of the format, WARC 1.1.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

HEADERS = "file string, at long, size int, page_id long, digest string, payload_bytes long"
HEADER_SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int32()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])


def record_id(file: str, at: int) -> str:
    """Names a record by the place it was first written to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rpartition('/')[2]}:{at}')}>"


def record(kind: str, headers: dict, block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def target(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def response(page_id: int | None, url: str | None, payload: bytes, name: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = {"WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": target(url), "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id, "X-Payload-Length": len(payload), "Content-Type": "application/http; msgtype=response"}
    return record("response", headers, (HTTP % len(payload)).encode() + payload)


def parsed(content: bytes) -> tuple[dict, bytes]:
    """(headers with lower-case names, block) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(re.split(r":\s*", x, maxsplit=1) for x in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    return headers, rest[: int(headers["content-length"])]


def records(stream):
    """(place, bytes) of each gzip member of a file, which is read piece by piece."""
    at, d, out, size, left = 0, zlib.decompressobj(31), [], 0, b""
    while True:
        data = left or stream.read(1 << 20)
        left = b""
        if not data:
            break
        out.append(d.decompress(data))
        size += len(data) - len(d.unused_data)
        if d.eof:
            yield at, b"".join(out)
            left, at = d.unused_data, at + size
            d, out, size = zlib.decompressobj(31), [], 0


def _write(to: str):
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        file, fs, path, out, at, rows = f"{to}/pages-{task.partitionId():08d}.warc.gz", *store(f"{to}/pages-{task.partitionId():08d}.warc.gz"), None, 0, []
        temp = f"{path}.{task.taskAttemptId()}.tmp"
        for b in batches:
            for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out = out or fs.open_output_stream(temp, compression=None)
                payload = html.encode()
                content = response(page_id, url, payload, record_id(file, at))
                out.write(content)
                rows.append({"file": file, "at": at, "size": len(content), "page_id": page_id, "digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)})
                at += len(content)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, HEADER_SCHEMA)
                    rows = []
        if out:
            out.close()
            fs.move(temp, path)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, HEADER_SCHEMA)

    return write


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of response records in a new shared folder; returns a header row for each record."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return written(rows.mapInArrow(_write(make_dir(fresh_dir(spark, "warc"))), HEADERS), "warc-headers")


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """The header rows with original: page_id, file and at of the record that a record repeats, null for originals."""
    place = F.struct("page_id", "file", "at")
    best = headers.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(place).alias("original"), F.count("*").alias("n")).filter("n > 1")
    large = join_groups(headers.filter(F.col("payload_bytes") >= least), written(best, "repeated-payloads"), ["digest"], "n", "left").drop("n")
    large = large.withColumn("original", F.when((F.col("original.file") == F.col("file")) & (F.col("original.at") == F.col("at")), F.lit(None)).otherwise(F.col("original")))
    small = headers.filter(~(F.col("payload_bytes") >= least)).withColumn("original", F.lit(None).cast(best.schema["original"].dataType))
    return large.unionByName(small)


def _rewrite(to: str):
    def rewrite(batches):
        from pyspark import TaskContext

        attempt, name, source, out, n = TaskContext.get().taskAttemptId(), None, None, None, 0
        schema = pa.schema([("file", pa.string()), ("n", pa.int64())])

        def close():
            source.close()
            out[1].close()
            out[0].move(f"{out[2]}.{attempt}.tmp", out[2])
            return pa.RecordBatch.from_pylist([{"file": f"{to}/{name.rpartition('/')[2]}", "n": n}], schema)

        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    if name is not None:
                        yield close()
                    name, n = r["file"], 0
                    fs, path = store(name)
                    source = fs.open_input_file(path)
                    fs, path = store(f"{to}/{name.rpartition('/')[2]}")
                    out = (fs, fs.open_output_stream(f"{path}.{attempt}.tmp", compression=None), path)
                source.seek(r["at"])
                headers, block = parsed(gzip.decompress(source.read(r["size"])))
                fresh = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, headers['warc-record-id'])}>" if r["original"] else headers["warc-record-id"], "WARC-Date": DATE, "WARC-Target-URI": headers.get("warc-target-uri"), "WARC-Payload-Digest": headers["warc-payload-digest"], "X-Page-Id": headers.get("x-page-id"), "X-Payload-Length": headers["x-payload-length"], "Content-Type": headers["content-type"]}
                if r["original"]:
                    o = r["original"]
                    fresh |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(o["file"], o["at"]), "WARC-Refers-To-Date": DATE, "X-Refers-To-Page": o["page_id"]}
                    block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
                out[1].write(record("revisit" if r["original"] else "response", fresh, block))
                n += 1
        if name is not None:
            yield close()

    return rewrite


def rewrite(resolved: DataFrame) -> DataFrame:
    """Writes the deduplicated archives in a new shared folder, a file for each file; returns file and n (records)."""
    spark = resolved.sparkSession
    bound_batches(spark)
    to = make_dir(fresh_dir(spark, "warc-deduplicated"))
    rows = resolved.select("file", "at", "size", "original").repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "at")
    return written(rows.mapInArrow(_rewrite(to), "file string, n long"), "warc-files")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_record string, payload binary"
RECORD_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in RECORDS.split(", ")])


def _read(with_payload: bool):
    def number(x):
        return None if x is None else int(x)

    def read(batches):
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, path = store(file)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for _, content in records(stream):
                        h, block = parsed(content)
                        payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["x-payload-length"])):
                            raise ValueError(f"{file}: a payload differs from its digest")
                        rows.append({"page_id": number(h.get("x-page-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": int(h["x-payload-length"]), "payload_digest": digest, "refers_to": number(h.get("x-refers-to-page")), "record_id": h["warc-record-id"], "refers_to_record": h.get("warc-refers-to"), "payload": payload if with_payload else None})
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    return read


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (column file): page_id, url, record_type, payload_bytes, payload_digest (lower-case hex), refers_to,
    record_id, refers_to_record, payload (null for revisits). Payloads are verified against their digests."""
    spark = files.sparkSession
    return files.select("file").repartition(shuffle_partitions(spark), "file").mapInArrow(_read(with_payload), RECORDS)
