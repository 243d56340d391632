"""Line dedup by a log-template tree, in DataFrame functions only.

A line is parsed at fixed depth: its number of words, then its LEAD leading words, where a word with a digit is a variable
field; that is the leaf. Lines with fewer than LEAST words without a digit (rows of numbers) have no variable fields and
are compared by all their words. In a leaf the words that follow are cut into FIELDS consecutive fields. A line belongs to
the template of all its words and, with FUZZY words or more, to those in which one field is a wildcard, so lines that differ
only in one field of at most a fifth of their words share a template. A template that occurs in more than one document recurs:
its lines stay in the first document (the smallest id) and are dropped from all others.

Texts are parsed once: a written table has each line's templates as hashes of 128 bits, with document ids, and both what
recurs and whom it hits is found there. (Among 10^13 templates unequal ones share a hash with a chance of 10^-13.)
First documents are found by partial minima, so a line that a third of all rows share is one row of each task. The recurring
ones are joined back to their lines: those with more than a thousandth of all rows by a broadcast, the rest by a shuffle.

Cases: null texts are empty; lines of fewer than LEAST words never go; texts from which nothing goes stay as they
are, and the rest are joined by line feeds (empty if all lines went); rows that share an id are one document, each with
the text it has; null ids come first; ids are integers; an empty table gives an empty table. Input columns can have any name: the result has them
with the text replaced, and a column named as one of the operator's own is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeql.llm.common import join_groups, text_of, written

#: Leading words of a leaf; fields behind them; words of a line that can go at all, and without a digit of one with variable fields;
#: words of a line that can match with a wildcard.
LEAD, FIELDS, LEAST, FUZZY = 3, 5, 3, 8


def words_of(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r\f\v")), r"\s+")


def parsed(lines: DataFrame) -> DataFrame:
    """lines with words instead of line, those with a digit as <*> if enough are without, and rigid: whether they aren't."""
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"[^\s0-9]*+[0-9]\S*", "<*>"))
    rows = lines.withColumn("masked", masked).withColumn("words", words_of(F.coalesce("masked", "line")))
    rigid = F.col("masked").isNotNull() & (F.size(F.array_remove("words", "<*>")) < LEAST)
    rows = rows.withColumn("rigid", rigid)
    return rows.withColumn("words", F.when(F.col("rigid"), words_of(F.col("line"))).otherwise(F.col("words"))).drop("masked", "line")


def templates(keyed: DataFrame) -> DataFrame:
    """id, h, no, keys: an array of the hashes (k, l) of each line's templates, the line itself and with each field a wildcard. keyed:
    id, h, text. Parts of a line are hashed once, in a projection of their own; templates are hashes of those. k and l are hashes of
    the same values by different seeds."""
    lines = keyed.select("id", "h", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = parsed(lines).withColumn("n", F.size("words")).filter(F.col("n") >= LEAST)
    rest = F.greatest(F.col("n") - LEAD, F.lit(0))

    def both(name: str, *values) -> list:
        return [F.xxhash64(*values).alias(f"{name}k"), F.xxhash64(F.lit(2), *values).alias(f"{name}l")]

    def field(k: int) -> Column:
        first, end = F.floor(rest * k / FIELDS).cast("int"), F.floor(rest * (k + 1) / FIELDS).cast("int")
        return F.slice("words", first + LEAD + 1, end - first)

    parts = lines.select("id", "h", "no", "n", "rigid", *both("lead", F.slice("words", 1, LEAD)), *[c for k in range(FIELDS) for c in both(f"f{k}", field(k))])

    def key(wild: int) -> Column:
        return F.struct(*[F.xxhash64("n", F.lit(wild), f"lead{s}", *[f"f{k}{s}" for k in range(FIELDS) if k != wild]).alias(s) for s in "kl"])

    keys = F.when((F.col("n") >= FUZZY) & ~F.col("rigid"), F.array(*map(key, range(-1, FIELDS)))).otherwise(F.array(key(-1)))
    return parts.select("id", "h", "no", keys.alias("keys"))


def drops(keyed: DataFrame) -> DataFrame:
    """id, h, drop (numbers of lines, from 0, sorted) for documents that lose lines. keyed: id, h, text."""
    lines = written(templates(keyed), "line-templates", random=True)
    rows = lines.select("id", "h", "no", F.inline("keys"))
    first = rows.groupBy("k", "l").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")).filter("first <> last").select("k", "l", "first", "size")
    gone = join_groups(rows, written(first, "recurring-templates"), ["k", "l"], "size").filter("id <> first").select("id", "h", "no")
    return gone.groupBy("id", "h").agg(F.sort_array(F.collect_set("no")).alias("drop"))


def without(lines: Column, edges: Column) -> Column:
    """The text of the lines without some; edges: the places of those, sorted, between -1 and the number of lines. What lies between two
    edges is sliced out."""
    kept = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1))
    return F.array_join(F.flatten(kept), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, the text without lines of recurring templates, then n_lines and n_dropped; a row for each row."""
    text = text_of(text_col)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64(text).alias("h")]
    gone = drops(docs.select(*key, text.alias("text")))
    rows = docs.select(*key, text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    # Lines and edges are columns of their own: inside the slices they would be computed for each.
    joined = rows.join(gone, ["id", "h"], "left").withColumn("lines", F.split("text", "\n"))
    joined = joined.withColumn("edges", F.concat(F.array(F.lit(-1)), "drop", F.array(F.size("lines"))))
    new = F.when(F.col("drop").isNull(), F.col("text")).otherwise(without(F.col("lines"), F.col("edges")))
    n_lines, n_dropped = F.size("lines").cast("long"), F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    own = {"n_lines", "n_dropped"}
    kept = [new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in own]
    return joined.select(*kept, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
