"""Exact dedup by a tree merge of sorted digest runs.

Each input partition's digests form a run: a file of fixed-width entries (digest, second hash, length, best id, size), one
for each text of the partition, sorted by digest. In each round of the binomial tree FAN runs are merged into one. A run of round r
is cut into FAN^r files, one for each range of the digest, so files stay as long as the first ones; a merge takes one
range out of FAN files by the places their manifest names, merges the sorted slices in STEPS steps, and writes the range's file
of the new run. Entries of the same digest become one at every level, so a text that a third of all rows share is one entry of each
run from the first level on; every merge keeps the best id and verifies that entries of equal digest agree in the texts' second hash
and length; else the job fails rather than drop a text. After the rounds one run is left, lying over all ranges.

Each round is a written manifest, and a file is written under another name first, so a lost task is simply run again. A merge
holds one step's entries. Rows find their group by a join on the digest; groups of more than a thousandth of all rows, of
which there are at most a thousand, are joined by a broadcast.

Cases: null text is the empty text; of rows that repeat text and id one counts as kept by id (all have kept = true, as
they carry the kept id); null ids lose against any other; an empty table gives an empty table. Only the named columns
are read, so other columns can have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm.common import bound_batches, fresh_dir, join_groups, lower_ascii, make_dir, opened, shuffle_partitions, store, text_of, written

#: Runs that meet in a round; steps of a merge.
FAN, STEPS = 8, 16

#: A digest is four numbers, most significant first, so that their order is that of its bytes.
ENTRY = np.dtype([("digest", "<u8", 4), ("check", "<i8"), ("length", "<i8"), ("best", "<i8"), ("size", "<i8")])
MANIFEST = "run long, piece long, file string, places array<long>"
MANIFEST_SCHEMA = pa.schema([("run", pa.int64()), ("piece", pa.int64()), ("file", pa.string()), ("places", pa.list_(pa.int64()))])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the text in UTF-8, A-Z in lower case), check (a second hash), length (in bytes), written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), lower_ascii(text_of(text_col)).alias("text"))
    rows = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("check"), F.octet_length("text").cast("long").alias("length"))
    return written(rows, "digests")


def combined(entries: np.ndarray, largest: bool) -> np.ndarray:
    """Sorted entries with those of equal digest as one."""
    if not len(entries):
        return entries
    d = entries["digest"]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1))))
    for c in ("check", "length"):
        if (np.minimum.reduceat(entries[c], first) != np.maximum.reduceat(entries[c], first)).any():
            raise ValueError("texts of equal digest differ")
    out = entries[first]
    out["best"] = (np.maximum if largest else np.minimum).reduceat(entries["best"], first)
    out["size"] = np.add.reduceat(entries["size"], first)
    return out


def merged(slices: list, largest: bool) -> np.ndarray:
    """Sorted runs as one: a stable sort finds the runs and merges them."""
    both = np.concatenate(slices)
    lead = both["digest"][:, 0].astype(np.uint64)
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    both = both[order]
    if (lead[1:] == lead[:-1]).any():
        both = both[np.lexsort([both["digest"][:, k] for k in (3, 2, 1, 0)])]
    return combined(both, largest)


def _range(digest: np.ndarray, pieces: int) -> np.ndarray:
    """The number of the range, of so many, that digests lie in, by their first 32 bits."""
    return ((digest[:, 0].astype(np.uint64) >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


class _Run:
    """A file being written, and how many of its entries each step of the next round's ranges has."""

    def __init__(self, at: str, run: int, piece: int, pieces: int, fan: int):
        self.run, self.piece, self.steps, self.grid = run, piece, fan * STEPS, pieces * fan * STEPS
        self.file = f"{at}/run-{run:08d}-{piece:08d}"
        self.inner = np.zeros(self.steps, np.int64)

    def batches(self, arrays):
        with opened(self.file) as f:
            for x in arrays:
                f.write(x.tobytes())
                self.inner += np.bincount(_range(x["digest"], self.grid) - self.piece * self.steps, minlength=self.steps)
        yield pa.RecordBatch.from_pylist([{"run": self.run, "piece": self.piece, "file": self.file, "places": [0, *np.cumsum(self.inner).tolist()]}], MANIFEST_SCHEMA)


def _write_run(at: str, largest: bool, fan: int):
    """The rows of a partition, sorted by digest, as the file of a run; the last digest of a batch waits for the next."""

    def entries(batches):
        carry = np.zeros(0, ENTRY)
        for b in batches:
            rows = np.zeros(b.num_rows, ENTRY)
            rows["digest"] = np.frombuffer(b"".join(b.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            for c in ("check", "length", "best"):
                rows[c] = b.column(c).to_numpy()
            rows["size"] = 1
            out = combined(np.concatenate((carry, rows)), largest)
            carry = out[-1:]
            yield out[:-1]
        yield carry

    def write(batches):
        from pyspark import TaskContext

        filled = (b for b in batches if b.num_rows)
        if (first := next(filled, None)) is not None:
            yield from _Run(at, TaskContext.get().partitionId(), 0, 1, fan).batches(entries(x for some in ([first], filled) for x in some))

    return write


def _slice(file: str, first: int, end: int) -> np.ndarray:
    fs, path = store(file)
    with fs.open_input_file(path) as f:
        f.seek(first * ENTRY.itemsize)
        return np.frombuffer(f.read((end - first) * ENTRY.itemsize), ENTRY)


def _merge(at: str, largest: bool, pieces: int, fan: int):
    """pieces: the ranges that the new runs are cut into."""

    def merge(batches):
        for b in batches:
            for row in b.to_pylist():
                steps = (merged([_slice(s["file"], *s["places"][k : k + 2]) for s in row["slices"]], largest) for k in range(STEPS))
                yield from _Run(at, row["run"], row["piece"], pieces, fan).batches(steps)

    return merge


def _read(batches):
    for b in batches:
        for file in b.column("file").to_pylist():
            fs, path = store(file)
            with fs.open_input_stream(path) as f:
                while data := f.read(100_000 * ENTRY.itemsize):
                    rows = np.frombuffer(data, ENTRY)
                    raw = rows["digest"].astype(">u8").tobytes()
                    digest = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, 32 * len(rows) + 1, 32, dtype=np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([digest, pa.array(rows["best"].astype(np.int64)), pa.array(rows["size"].astype(np.int64))], ["digest", "best", "size"])


def classes(rows: DataFrame, largest: bool = True, fan: int = FAN) -> DataFrame:
    """digest, best (the largest, or smallest, id), size: one row for each text of digests()."""
    spark = rows.sparkSession
    bound_batches(spark)
    none = -(2**63) if largest else 2**63 - 1
    at = make_dir(fresh_dir(spark, "digest-runs"))
    entries = rows.select("digest", "check", "length", F.coalesce("id", F.lit(none).cast("long")).alias("best"))
    files = written(entries.sortWithinPartitions("digest").mapInArrow(_write_run(at, largest, fan), MANIFEST), "digest-round")
    left, pieces = (files.agg(F.max("run")).first()[0] or 0) + 1, 1
    while left > 1:
        left = -(-left // fan)
        pieces *= fan
        slices = files.select(F.floor(F.col("run") / fan).alias("run"), "piece", "file", "places", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("s"))
        slice_ = F.struct("file", F.slice("places", F.col("s") * STEPS + 1, STEPS + 1).alias("places"))
        jobs = slices.groupBy("run", (F.col("piece") * fan + F.col("s")).alias("piece")).agg(F.collect_list(slice_).alias("slices"))
        files = written(jobs.mapInArrow(_merge(f"{at}/round-{pieces}", largest, pieces, fan), MANIFEST), "digest-round")
    found = files.select("file").repartition(shuffle_partitions(spark), "file").mapInArrow(_read, "digest binary, best long, size long")
    return found.select("digest", F.when(F.col("best") != none, F.col("best")).alias("best"), "size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, fan: int = FAN) -> DataFrame:
    """id_col, keep_id, group_size, kept, digest: a row for each row of docs. Of equal texts (A-Z in lower case) the row
    with the largest id stays, or with the smallest if not largest."""
    rows = digests(docs, id_col, text_col)
    best = written(classes(rows, largest, fan).select("digest", F.col("best").alias("keep_id"), F.col("size").alias("group_size")), "digest-classes")
    joined = join_groups(rows.select("id", "digest"), best, ["digest"], "group_size")
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
