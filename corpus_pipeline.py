"""The corpus pipeline: five stages, each by an operator of latticeql.llm, each over all that the one before kept.

The quality classifier drops documents it scores below its cut. Line dedup takes recurring lines out of texts, and n_chars
follows; no document goes. Near-dedup keeps the document with the smallest id of each group of texts whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more. Decontamination drops contaminated documents. The last stage encodes the texts.

Cases are those of the operators: null texts count as empty (and are the empty text after line dedup), empty tables give empty
tables, and further columns of docs pass through all stages but the last, whatever their names. A null id is an id like any
other, but that a row with one gives way to any near duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeql.llm import bpe, decontam, line_dedup, quality, simhash
from latticeql.llm.common import table, written
from latticeql.llm.registry import VOCABULARY


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a score of at least the cut. The labels of held-out rows aren't used."""
    from latticeql.llm.registry import remainder

    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id") != 0))
    return docs.filter(quality.scored(model) >= quality.CUT)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns named as the operator's own counts travel in a struct and come back as they were."""
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    free = "own" + "_" * max(map(len, docs.columns))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], *([F.struct(*own).alias(free)] if own else []))
    out = line_dedup.dedup_lines(rows)
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(free)[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


#: Rows of a list of documents that is broadcast, at most: a few dozen bytes each.
BROADCAST_ROWS = 1_000_000


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns, which tells rows of the same id apart. Maps, which have no hash, count by their texts."""

    def hashable(field) -> Column:
        kind = field.dataType.simpleString()
        return docs[f"`{field.name}`"].cast("string") if "map<" in kind or "variant" in kind else docs[f"`{field.name}`"]

    return F.xxhash64(*map(hashable, docs.schema.fields))


def listed(rows: DataFrame) -> DataFrame:
    """A written list of documents, to be broadcast if a count of it allows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id; of rows with that id, the one with the smallest hash of its
    columns; of rows equal in all columns, one. Rows with a null id stay only if the group has no other."""
    groups = simhash.near_duplicates(docs, also={"row_hash": whole_row(docs)}, verified=True)
    copies = groups.groupBy("component", "doc_id", "row_hash").agg(F.count("*").alias("copies"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "copies")).alias("best")
    kept = written(copies.groupBy("component").agg(best).select(F.col("best.doc_id").alias("kept_id"), F.col("best.row_hash").alias("kept_hash"), F.col("best.copies").alias("copies")), "kept")

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs["doc_id"].eqNullSafe(some["kept_id"]) & (whole_row(docs) == some["kept_hash"]), "left_semi")

    several = kept.filter("copies > 1")
    if not several.take(1):
        return of(kept)
    # Copies are equal in all columns; one is told from another by the hash alone, as maps can't be compared.
    copies = of(several)
    own = "row_hash" + "_" * max(map(len, docs.columns))
    return of(kept.filter("copies = 1")).unionByName(copies.withColumn(own, whole_row(copies)).dropDuplicates(["doc_id", own]).drop(own))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one: those that share an id, or have none, don't go for each other's sake."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("hash"))
    found = decontam.decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.hash").alias("bad_hash")).distinct()
    # The list is written and counted first, as an estimate would have whole documents shuffled against a few rows.
    bad = listed(written(bad, "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the SHA-256 of ids and of the decoded text."""
    out = bpe.encode(docs, VOCABULARY, memo=bpe.SMALL_MEMO)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", classify), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL can't express the classifier, the near-duplicate groups or the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as a table of its own and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
