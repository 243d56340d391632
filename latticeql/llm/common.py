"""What the operators of this subpackage share: the folder that every executor sees, written intermediate
tables, bounded Arrow batches, and small helpers. Nothing here depends on the size of the input."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that goes to a Python worker, and its bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch holds, so a worker's memory doesn't depend on how many rows a task has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset (a local session, as in tests) a temporary
    folder of this machine takes its place; on a cluster the setting must name a shared one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="latticeql-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A URI below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, random: bool = False) -> DataFrame:
    """The rows of df, computed once, as a table in the shared folder: lineage ends there and lost executors cost
    nothing already done. random: mostly hashes, at which compression and dictionaries lose their time."""
    spark = session_of(df)
    at = fresh_dir(spark, name)
    df.write.options(**({"compression": "snappy", "parquet.enable.dictionary": "false"} if random else {"compression": "zstd"})).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(column: str = "text") -> Column:
    """The column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and nothing else. A text of ASCII alone takes the faster function, which does the same to it."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, A_Z, a_z))


def store(uri: str):
    """(file system, path) for a URI or a local path, for the Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri) if not uri.startswith("file:") else uri)


@contextlib.contextmanager
def opened(uri: str):
    """A file to write, under another name until it is whole, so that a lost or repeated task leaves no partial one."""
    from pyspark import TaskContext

    fs, path = store(uri)
    temp = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(temp) as f:
        yield f
    fs.move(temp, path)


def make_dir(uri: str) -> str:
    fs, path = store(uri)
    fs.create_dir(path, recursive=True)
    return uri


#: Groups of more than this part of all rows are joined by a broadcast; there can't be more of them than this number.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list, size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, both written tables; groups: a row for each combination of keys, size: how many rows have it. Groups
    of more than a HOT-th of all rows, at most HOT of them, are broadcast, so no task of the shuffle gets more of one key."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HOT > total
    hot = F.broadcast(groups.filter(large))
    rest = rows.join(F.broadcast(groups.filter(large).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.filter(~large), keys, how), allowMissingColumns=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
