"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file holds whole documents in ascending id order. Ids are replaced by their rank among the file's own frequencies, so
most take one byte; the file carries its rank-to-id list, which makes it readable by itself and needs no pass over the
corpus before writing. Each rank takes one to four bytes; the two-bit lengths, less one, of four ranks share a control byte,
and all control bytes precede all data bytes. A reader looks control bytes up in a table of 256 rows, sums lengths to
offsets, and gathers all ranks at once with numpy.

Layout, little endian: magic "RVB1", n_docs u32, n_ids u32 (entries of the rank list), n_tokens u64; rank list u32 each;
document ids i64 each; a byte each, 1 where the id is null; tokens of each document u32; control bytes; data bytes.

Cases: null text is the empty text and so a document of just the end id; null ids come first; repeated rows stay
repeated documents; documents of one id come in the order of a hash of their texts, so that files can share a frequent id; an empty table writes no file and reads as an empty table. Only the
named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import bound_batches, fresh_dir, make_dir, shuffle_partitions, store, text_of, written

MAGIC = b"RVB1"
HEAD = struct.Struct("<4sIIQ")
#: A file is closed once it has so many tokens; this bounds the memory of writers and readers.
FILE_TOKENS = 4_000_000

#: Lengths of the four ranks of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    four.reshape(-1)[: len(ranks)] = size - 1
    control = (four << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of control and data bytes (numpy arrays of bytes)."""
    size = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if len(longer):
            out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list, counts: list, ids: np.ndarray) -> bytes:
    """A file's content. doc_ids may hold None; counts: tokens of each document."""
    used, inverse, often = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(used), np.uint32)
    rank[order] = np.arange(len(used), dtype=np.uint32)
    control, data = pack(rank[inverse] if len(ids) else np.zeros(0, np.uint32))
    null = bytes(x is None for x in doc_ids)
    return b"".join((HEAD.pack(MAGIC, len(doc_ids), len(used), len(ids)), used[order].astype("<u4").tobytes(), array("q", [x or 0 for x in doc_ids]).tobytes(), null, np.array(counts, "<u4").tobytes(), control, data))


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, tokens of each, all ids) of a file's content."""
    magic, n_docs, n_ids, n = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    names = np.frombuffer(content, "<u4", n_ids, at)
    at += 4 * n_ids
    docs = np.frombuffer(content, "<i8", n_docs, at)
    at += 8 * n_docs
    null = np.frombuffer(content, np.uint8, n_docs, at)
    at += n_docs
    counts = np.frombuffer(content, "<u4", n_docs, at)
    at += 4 * n_docs
    n_control = -(-n // 4)
    control = np.frombuffer(content, np.uint8, n_control, at)
    ranks = unpack(control, np.frombuffer(content, np.uint8, offset=at + n_control), n)
    return [None if z else int(x) for x, z in zip(docs, null, strict=True)], counts, names[ranks] if n else np.zeros(0, "<u4")


def put(uri: str, content: bytes, attempt: int) -> None:
    """Writes under another name first, so that a lost or repeated task leaves no partial file."""
    fs, path = store(uri)
    with fs.open_output_stream(f"{path}.{attempt}.tmp") as f:
        f.write(content)
    fs.move(f"{path}.{attempt}.tmp", path)


def get(uri: str) -> bytes:
    fs, path = store(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def _write(at: str, path: str, end: int, most: int):
    def write(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        e, last = bpe.encoder(path), array("I", [end]).tobytes()
        docs, counts, packed, n, seq = [], [], [], 0, 0

        def close():
            file = f"{at}/{part:08d}-{seq:06d}.rvb"
            put(file, file_bytes(docs, counts, np.frombuffer(b"".join(packed), "<u4")), attempt)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": file, "n_docs": len(docs), "n_tokens": n}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), bpe.texts(b.column(1)), strict=True):
                ids = e.tree([e.leaf(x) for x in bpe.leaves_of(text.decode())]) if len(text) > bpe.PIECE else e.ids(text)
                docs.append(doc)
                packed += (ids, last)
                counts.append(len(ids) // 4 + 1)
                n += counts[-1]
                if n >= most:
                    yield close()
                    docs, counts, packed, n, seq = [], [], [], 0, seq + 1
        if docs:
            yield close()

    return write


def write(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the encoded texts as files in a new shared folder and returns their manifest in file order: part, seq, file,
    n_docs, n_tokens, start (tokens of all files before).

    path: a tokenizer file, readable on each executor; end: the id that closes each document."""
    spark = docs.sparkSession
    bound_batches(spark)
    at = make_dir(fresh_dir(spark, "token-files"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    # Ranges split the rows of one id by their texts, and equal rows by the place they were read at.
    rows = rows.select("doc", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc", "hash", "place").sortWithinPartitions("doc", "hash", "place").select("doc", "text")
    files = written(rows.mapInArrow(_write(at, path, end, file_tokens), MANIFEST), "token-manifest")
    # Two steps, so that no task sorts all files: sums of blocks of partitions, then sums within a block.
    block = F.floor(F.col("part") / 1000)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.groupBy(block.alias("block")).agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = files.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return inside.join(blocks, "block").select(*files.columns, (F.col("base") + F.col("inside")).alias("start"))


def _read(batches):
    for b in batches:
        for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            docs, counts, ids = read_file(get(file))
            ends = np.cumsum(counts, dtype=np.int64)
            for a in range(0, len(docs), 1000):
                z = min(a + 1000, len(docs))
                first = ends[a] - counts[a]
                yield pa.RecordBatch.from_arrays([pa.array(docs[a:z], pa.int64()), pa.array(start + ends[a:z] - counts[a:z], pa.int64()), pa.array(counts[a:z].astype(np.int64)), _binary(ids[first : ends[z - 1]], ends[a:z] - first)], ["doc", "start", "n_tokens", "ids"])


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (tokens of all documents before), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    spark = manifest.sparkSession
    files = manifest.select("file", "start").repartition(shuffle_partitions(spark), "file")
    return files.mapInArrow(_read, "doc long, start long, n_tokens long, ids binary").withColumnRenamed("doc", id_col)
