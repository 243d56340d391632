"""Tab-separated grid output with a numbered header, and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header(columns: list) -> str:
    """The header of a file: # 1:iteration, a tab, 2:time and so on."""
    return "# " + "\t".join(f"{n}:{c}" for n, c in enumerate(columns, 1))


def write_tsv(df: DataFrame, path: str) -> None:
    """Part files of rows, and the header as a part of its own. Complex columns (structs of re and im) become two."""
    flat = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            flat += [F.col(f"{f.name}.{x.name}").alias(f"{f.name}.{x.name}") for x in f.dataType.fields]
        else:
            flat.append(F.col(f"`{f.name}`"))
    out = df.select(*flat)
    out.write.csv(path, sep="\t", nullValue="nan")
    df.sparkSession.createDataFrame([(header(out.columns),)], "h string").coalesce(1).write.text(f"{path.rstrip('/')}.header")


def read_tsv(spark: SparkSession, path: str, types: dict | None = None) -> DataFrame:
    """Reads what write_tsv wrote; columns are double unless types says otherwise."""
    names = [x.partition(":")[2] for x in spark.read.text(f"{path.rstrip('/')}.header").first()[0].removeprefix("# ").split("\t")]
    schema = ", ".join(f"`{n}` {(types or {}).get(n, 'double')}" for n in names)
    return spark.read.schema(schema).csv(path, sep="\t", nullValue="nan")


def keep_first(df: DataFrame, keys: list, ghost: str = "isghost") -> DataFrame:
    """Of rows for the same point the interior one: a minimum by key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != ghost]
    best = df.groupBy(*keys).agg(F.min(F.struct(ghost, *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def output_every(df: DataFrame, every: int, iteration: str = "iteration") -> DataFrame:
    """Iterations that are written out; 0: none."""
    return df.filter(F.col(iteration) % every == 0) if every > 0 else df.limit(0)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_checkpoint(groups: dict, path: str, iteration: int, parameters: dict | None = None, structure: dict | None = None) -> bool:
    """Each group that is to be kept, as a table of the iteration, and last a document of the parameters, the structure of the
    hierarchy and the epoch (the checkpoints written before). A checkpoint that has its document isn't written again; one without it
    is what a lost run left, and is replaced. Whether it was written."""
    from latticeql.sources.records import write_json

    spark = next(iter(groups.values())).sparkSession
    here = f"{path}/iteration={iteration}"
    if _exists(spark, f"{here}/document"):
        return False
    done = [x for x in _iterations(spark, path) if x < iteration]
    for name, df in groups.items():
        df.write.mode("overwrite").parquet(f"{here}/{name}")
    write_json(spark, f"{here}/document", {"iteration": iteration, "parameters": parameters or {}, "structure": structure or {}, "epoch": len(done), "groups": sorted(groups)})
    return True


def _iterations(spark: SparkSession, path: str) -> list:
    """The iterations of whole checkpoints, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for x in names if x.startswith("iteration=") and _exists(spark, f"{path}/{x}/document") for n in [int(x.partition("=")[2])])


def due(iteration: int, every: int, seconds: float, limit: float, last: bool = False, at_end: bool = False) -> bool:
    """Whether a checkpoint is to be written: each so many iterations, after so many seconds since the last one, or at the end."""
    return bool((every > 0 and iteration % every == 0) or 0 < limit <= seconds or (last and at_end))


def recover(spark: SparkSession, path: str, iteration: int | None, name: str) -> DataFrame:
    """A group of a checkpoint, the last whole one if no iteration is named."""
    return spark.read.parquet(f"{path}/iteration={_iterations(spark, path)[-1] if iteration is None else iteration}/{name}")


def recovered(spark: SparkSession, path: str, iteration: int | None = None) -> dict:
    """The document of a checkpoint: iteration, parameters, structure, epoch, groups."""
    from latticeql.sources.records import read_json

    return read_json(spark, f"{path}/iteration={_iterations(spark, path)[-1] if iteration is None else iteration}/document")
