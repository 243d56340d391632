"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is WINDOW consecutive words of an item, or the whole of a shorter one. Its tokens are its shingles of two words (of one
word, if it has no more), ordered by rarity, counted over all documents. A document that holds a window holds its rarest shingle,
so the prefix of one shingle, the necessary one for containment of the whole window, is joined: each occurrence of such a shingle in a
document meets the windows of which it is the prefix, at the place the prefix has in them. Positional and length bounds leave
those that fit into the document there, and the words themselves are compared, exactly.

Shingles are 64-bit hashes of words in full lower case, which equal words have in common, so a hash or letter too many
alike costs a comparison and changes nothing. The index of windows, a row for each prefix and window, is broadcast if a count of
its words, taken before, is within BROADCAST_WORDS; else hashes of shingles and their places are shuffled, never a word for each.
Texts are split once a pass, one to count shingles and one to join them, in generated code.

Cases: null texts and texts without words have no words and are never contaminated; items without words have no
windows; repeated items count by distinct item id; repeated rows of a document each get the same result; a null item
id is left out of the list of items; empty tables give empty results, or results without hits. Only the named columns are read, so
other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeql.llm.common import lower_ascii, text_of, written

WINDOW = 13
#: Words in the windows of an index that is broadcast, at most: some 20 bytes each.
BROADCAST_WORDS = 2_000_000

# Fixed value: what separates words, before A-Z are in lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as they are written."""
    return F.filter(F.split(text, SEPARATOR), lambda w: w != "")


def with_words(docs: DataFrame) -> DataFrame:
    """docs with words instead of text: as words_of, but in generated code, as only the ends can be empty."""
    rows = docs.withColumn("parts", F.split("text", SEPARATOR))
    first, last = F.get("parts", F.lit(0)) == "", F.element_at("parts", -1) == ""
    rows = rows.withColumn("skip", F.when(first, 1).otherwise(0)).withColumn("less", F.when(last, 1).otherwise(0))
    size = F.greatest(F.size("parts") - F.col("skip") - F.col("less"), F.lit(0))
    return rows.select(*[c for c in docs.columns if c != "text"], F.slice("parts", F.col("skip") + 1, size).alias("words"))


def shingle(words: Column, pos: Column, n: int) -> Column:
    """The hash of the n words (one or two) from a place."""
    return F.xxhash64(F.lit(n), *[F.lower(F.get(words, pos + k)) for k in range(n)])


def shingled(docs: DataFrame, sizes: tuple) -> DataFrame:
    """docs (key, words) with a row for each shingle of the sizes: pos (from 0) and g, its hash; and one for the row itself, with
    pos -1."""
    rows = docs.select("key", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("pos"))
    words, pos = F.col("words"), F.col("pos")
    g = [F.when((pos >= 0) & (pos + n <= F.size(words)), shingle(words, pos, n)) for n in sizes]
    if len(g) == 1:
        return rows.withColumn("g", g[0])
    none = F.array(F.lit(None).cast("long"))
    return rows.withColumn("g", F.explode(F.when(pos < 0, none).otherwise(F.array(*g)))).filter((pos < 0) | F.col("g").isNotNull())


def index(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, bool, tuple]:
    """(windows, whether they may be broadcast, sizes of their shingles). windows: g (the prefix), at (its place in the window), size,
    wanted (the words, joined by spaces), items. docs: key, words."""
    spread = items.select("item", words_of(lower_ascii(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    windows = spread.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    windows = written(windows.groupBy("words").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items")), "windows")
    size = F.size("words")
    n, least, most = windows.agg(F.sum(size), F.min(size), F.max(size)).first()
    small = (n or 0) <= BROADCAST_WORDS
    sizes = (1,) * (least == 1) + (2,) * (most != 1)
    hint = F.broadcast if small else (lambda df: df)
    pos, words = F.col("pos"), F.col("words")
    g = F.when(size == 1, shingle(words, pos, 1)).when(pos + 1 < size, shingle(words, pos, 2))
    tokens = written(windows.select("*", F.posexplode("words").alias("pos", "w")).select("words", "items", "pos", g.alias("g")).filter("g is not null"), "window-shingles")
    counts = shingled(docs, sizes).select("g").join(hint(tokens.select("g").distinct()), "g").groupBy("g").agg(F.count("*").alias("n"))
    ranked = tokens.join(hint(counts), "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.groupBy("words", "items").agg(F.min(F.struct("n", "g", "pos")).alias("p"))
    return written(prefix.select("p.g", F.col("p.pos").alias("at"), size.alias("size"), F.array_join("words", " ").alias("wanted"), "items"), "window-index"), small, sizes


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, rows (of docs with this key), n_words, spans (first word, from 0, and words of each occurrence), items: of the rows of
    docs (key, words)."""
    windows, small, sizes = index(docs, items, window)
    each = shingled(docs, sizes)
    if not small:
        prefixes = windows.select("g").distinct()
        places = each.select("key", "g", "pos").join(prefixes, "g", "left_semi").groupBy("key").agg(F.collect_set(F.struct("pos", "g")).alias("places"))
        none = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("g")))
        placed = docs.join(places, "key", "left").withColumn("places", F.concat(none, F.coalesce("places", F.array().cast(places.schema["places"].dataType))))
        each = placed.select("key", "words", F.explode("places").alias("p")).select("key", F.when(F.col("p.pos") < 0, F.size("words")).alias("n"), "words", "p.pos", "p.g")
        # What leaves a document is, for each prefix, the words around it that a window can cover.
        first = F.greatest(F.col("pos") - window + 1, F.lit(0))
        each = each.select("key", "pos", "g", F.size("words").alias("n_words"), F.slice("words", first + 1, F.greatest(F.col("pos") - first + window, F.lit(0))).alias("words"), first.alias("first"))
        found = each.join(windows, "g", "left")
    else:
        found = each.select("key", "pos", "g", F.size("words").alias("n_words"), "words", F.lit(0).alias("first")).join(F.broadcast(windows), "g", "left")
    start = F.col("pos") - F.col("at")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    here = F.slice("words", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("size"))
    holds = inside & (lower_ascii(F.array_join(here, " ")) == F.col("wanted"))
    row = F.col("pos") < 0
    found = found.filter(row | holds).select("key", F.when(row, F.col("n_words")).alias("n_words"), F.when(~row, F.struct(start.alias("first"), "size")).alias("span"), F.when(~row, F.col("items")).alias("items"))
    return found.groupBy("key").agg(F.count("n_words").alias("rows"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Words in any of the spans, which are sorted by first."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["first"] + s["size"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], s["first"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, n_words, n_hit, items (ids as sorted strings), spans, contaminated, a row for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    key = F.struct("id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    keyed = with_words(rows.select(key.alias("key"), "text"))
    wanted = items.select(F.col(item_col).alias("item"), text_of(item_text).alias("text"))
    found = hits(keyed, wanted, window)
    n_hit = covered(F.col("spans"))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows")
    out = found.select("key", "n_words", n_hit.alias("n_hit"), "items", "spans").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select(F.col("key.id").alias(id_col), *[c for c in out.columns if c != "key"])
