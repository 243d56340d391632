"""MinHash groups: near-duplicate groups by the exact Jaccard similarity of word shingles (jaccard). An operator of its own; the pipeline's
near-dedup is by SimHash (simhash_jaccard).

Two texts are linked if their sets of shingles have a Jaccard similarity of at least SHARE hundredths, and a group is what links
connect. Candidates are texts whose fingerprints the SimHash operator links, and, as texts at 0.8 differ in some 10 of 64 bits and no covering code reaches so far, those that share one of
BANDS bands of ROWS minima of the same hashes: a pair at similarity 0.8 shares none with a chance of (1 - 0.8^4)^32 = 5e-8, a pair at
0.9 of 4e-15. What is linked is decided by the sets (of 64-bit hashes) alone.

Of a band's texts each is first compared with the one that has the smallest hash; what that connects is one group, and then pairs
that are still in different groups are compared. So near copies of one text take comparisons in proportion to their number, and no
candidate pair goes unless its texts are connected already. Before texts are fetched, candidates are compared by their minima: of
128, a pair at 0.8 agrees in fewer than ALIKE with a chance of 3e-9. Bands still with several groups are searched inside tasks, block
against block, so a band that a third of all texts share makes rows by the block and by what agrees, not by the pair; a pair that
agrees in its minima and not in its sets (a similarity of some 0.6 to 0.8) does make a row.

Cases: null texts are empty; texts without words are linked with each other; equal texts always share a group; repeated rows stay
repeated rows; ids aren't compared, so null ids are ids like any other; an empty table gives an empty table. Only the named columns
are read, so other columns can have any name. (Unequal texts share a hash with a chance of 2^-64 a pair.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import bound_batches, join_groups, shuffle_partitions, text_of, written
from latticeql.llm.jaccard import shingles, verified
from latticeql.llm.simhash import bits, components, majority
from latticeql.llm.simhash import links as fingerprint_links

#: Bands and minima of a band; seed of the factors.
BANDS, ROWS, SEED = 32, 4, 42
#: Minima, of all, that a candidate pair needs in common; texts of a band that are compared as one block.
ALIKE, ROWS_A_BLOCK = 74, 1024
#: Shingles whose minima are taken at a time.
BLOCK = 512

#: Odd factors: x -> factor * x is a permutation of the 32-bit numbers.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(text: bytes) -> tuple[np.ndarray, int, bytes]:
    """The BANDS keys of a text, signed hashes of a band's number and its minima, the SimHash of the same shingles, and a byte of
    each minimum."""
    least, counts, n = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), np.zeros(64, np.int64), 0
    for hashes in shingles(text):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(short), BLOCK):
            np.minimum(least, (short[a : a + BLOCK, None] * FACTORS).min(axis=0), out=least)
        counts += bits(hashes)
        n += len(hashes)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64), majority(counts, n), least.astype(np.uint8).tobytes()


def covered(sketches: DataFrame) -> DataFrame:
    """a, b: pairs of texts that connect what their fingerprints do. sketches: h, fp, a row for each text."""
    reps = written(sketches.groupBy("fp").agg(F.min("h").alias("rep")), "representatives")
    near = fingerprint_links(reps.select("fp", F.col("rep")))
    equal = sketches.join(reps, "fp").filter("h <> rep").select(F.col("rep").alias("a"), F.col("h").alias("b"))
    return near.select("a", "b").unionByName(equal)


def _minima(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose minima agree. sketches: h, minima."""
    one, two = (sketches.select(F.col("h").alias(k), F.col("minima").alias(f"minima_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b")
    udf = F.arrow_udf(lambda x, y: pa.array((_minima(x) == _minima(y)).sum(axis=1) >= ALIKE), "boolean")
    return both.filter(udf("minima_a", "minima_b")).select("a", "b")


def _bands(array: pa.Array) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)


def _block(band: int, one: list, two: list) -> tuple[np.ndarray, np.ndarray]:
    """The pairs between two blocks (h, group, minima, bands) of a band that are in different groups and whose minima agree; a pair is
    found in the first of the bands that it shares alone."""
    (h, group, minima, bands), (h2, group2, minima2, bands2) = one, two
    e, f = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(h), 64):
        i, j = np.nonzero((group[at : at + 64, None] != group2[None, :]) & (h[at : at + 64, None] < h2[None, :]))
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)] + at, j[k : k + (1 << 14)]
            near = (minima[x] == minima2[y]).sum(axis=1) >= ALIKE
            x, y = x[near], y[near]
            first = np.argmax(bands[x] == bands2[y], axis=1)
            here = bands[x, first] == band
            e.append(h[x[here]])
            f.append(h2[y[here]])
    return np.concatenate(e), np.concatenate(f)


def _columns(b: pa.RecordBatch) -> list:
    return [b.column("h").to_numpy(), b.column("component").to_numpy(), _minima(b.column("minima")), _bands(b.column("bands"))]


def _edges(e: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(e), pa.array(f)], ["a", "b"])


def _small(batches):
    """Over rows sorted by band, all rows of a band in the partition: its pairs."""
    from itertools import groupby

    def parts():
        for b in batches:
            band = b.column("band").to_numpy()
            edges = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
            columns = _columns(b)
            for a, z in zip(edges, edges[1:], strict=False):
                if z > a:
                    yield band[a], [c[a:z] for c in columns]

    out = []
    for band, some in groupby(parts(), key=lambda x: x[0]):
        columns = [np.concatenate(x) for x in zip(*(c for _, c in some), strict=True)]
        out.append(_block(band, columns, columns))
        if sum(len(e) for e, _ in out) > 10_000 or len(out) > 1000:
            yield _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))
            out = []
    if out:
        yield _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _large(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    side, columns = t.column("side").to_numpy(), _columns(t.to_batches()[0])
    one, two = ([c[side == k] for c in columns] for k in (0, 1))
    band = t.column("band")[0].as_py()
    found = [_edges(*_block(band, one, two))]
    # The rows of one block are on both sides, and those of two have the smaller hash on either.
    if t.column("x")[0] != t.column("y")[0]:
        found.append(_edges(*_block(band, two, one)))
    return pa.Table.from_batches(found)


def apart(grouped: DataFrame, block: int) -> DataFrame:
    """a, b: the pairs of texts in one band whose minima agree and that are in different groups, each once. grouped: band, h,
    component, minima, bands."""
    n = shuffle_partitions(grouped.sparkSession)
    several = grouped.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x <> y")
    several = written(several.select("band", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "bands-apart")
    rows = written(grouped.join(several, "band"), "texts-apart")
    few = rows.filter("blocks = 1").select("band", "h", "component", "minima", "bands").repartition(n, "band").sortWithinPartitions("band")
    # Block pair (x, y), x <= y: each text goes to the pairs its block is in; side says which of the two it is.
    many = rows.filter("blocks > 1").withColumn("m", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumn("side", F.explode(F.when(F.col("m") == F.col("o"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("m") > F.col("o")).cast("int")))))
    many = many.select("band", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), "side", "h", "component", "minima", "bands")
    return few.mapInArrow(_small, "a long, b long").unionByName(many.groupBy("band", "x", "y").applyInArrow(_large, "a long, b long"))

def links(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: edges that connect the same texts as all links do. sketches: h, bands, fp, minima, copies, a row for each text; texts: h,
    text."""
    bound_batches(sketches.sparkSession)
    rows = sketches.select("h", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("band", "least")
    held = written(rows.join(shared, "band"), "shared-bands")
    stars = held.filter("h <> least").select(F.col("least").alias("a"), F.col("h").alias("b"))
    near = covered(sketches.select("h", "fp")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = written(agreeing(stars.unionByName(near).distinct(), sketches), "stars")
    edges = written(verified(stars, texts, sketches), "star-links")
    found = components(edges)
    grouped = held.select("band", "h").join(found, F.col("h") == F.col("node"), "left").select("band", "h", F.coalesce("component", "h").alias("component"))
    pairs = written(apart(grouped.join(sketches.select("h", "minima", "bands"), "h"), ROWS_A_BLOCK).join(stars, ["a", "b"], "left_anti"), "pairs-apart")
    return edges.unionByName(verified(pairs, texts, sketches))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: dict | None = None) -> DataFrame:
    """id_col, component (the same for all rows of a group), and further columns of docs (also: by name): a row for each row
    of docs."""

    def keys(text: pa.Array) -> pa.Array:
        both = [sketch(x) for x in bpe.texts(text)]
        bands, fps, minima = zip(*both, strict=True) if both else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(minima, pa.binary())], ["bands", "fp", "minima"])

    bound_batches(docs.sparkSession)
    text, more = text_of(text_col), [c.alias(name) for name, c in (also or {}).items()]
    h = F.xxhash64(text).alias("h")
    rows = docs.select(F.col(id_col).alias("id"), h, F.arrow_udf(keys, "bands array<bigint>, fp bigint, minima binary")(text).alias("sketch"), *more)
    sketches = written(rows.select("id", "h", "sketch.bands", "sketch.fp", "sketch.minima", *(also or {})), "sketches")
    each = sketches.groupBy("h").agg(*[F.first(c).alias(c) for c in ("bands", "fp", "minima")], F.count("*").alias("copies"))
    each = written(each, "text-sketches")
    found = components(links(each, docs.select(h, text.alias("text")))).withColumnRenamed("node", "h")
    classes = written(found.join(each.select("h", "copies"), "h"), "text-classes")
    joined = join_groups(sketches, classes, ["h"], "copies", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("component", "h").alias("component"), *(also or {}))
