"""The verified form of SimHash groups: anchor points find the candidates, the exact Jaccard similarity of word shingles decides.

Two texts are linked if their sets of five-word shingles (jaccard) have a similarity of at least 0.8, and a group is what links connect.
The fingerprint is the SimHash of the set: for each of WIDTH bits of a shingle's hash, in how many more shingles it is set than not. Sets
at 0.8 have vectors of such counts at a cosine of 0.89 or more, so some 15 % of signs differ, beyond the reach of the covering code of 64
bits and a threshold of 4 (simhash). The anchors of a part here are 64 words of a coset of the first-order Reed-Muller code of length 256,
any two of which differ in at least half of their bits: PART words and their complements. A fingerprint's home is the anchor that its
counts lie nearest to (a bit near the threshold, which a near copy has otherwise, so weighs little). Texts that share both homes of one
of COVERS pairs of parts, 4096 anchors a pair, are compared within their task: by 128 signs, then by the sum of what 256 counts in
steps of 16 levels differ by. Those within LIMIT have their texts fetched and compared. A row for each cover, and about n^2 / 150
comparisons of a few nanoseconds.

A home is shared with a chance of 0.48 at a similarity of 0.8, two with 0.23 (0.38 at 0.9), none of COVERS with some 10^-6. The sum is
328 at 0.8 with a deviation of 21, so LIMIT is five deviations off; half of the pairs at 0.67 are within it. Turns of the same counts
aren't independent, so recall is measured as well (README).

Large groups: first a few covers give trees of what is closest, and what their texts connect is a group; then only pairs in different
groups are compared, over all covers. An anchor of more than BLOCK rows is dealt out to tasks as pairs of its blocks.

Cases: null texts are empty; texts without words are linked with each other; equal texts always share a group; repeated rows stay
repeated rows; ids aren't compared, so null ids are ids like any other; an empty table gives an empty table. Only the named columns
are read, so other columns can have any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import bound_batches, join_groups, shuffle_partitions, text_of, written
from latticeql.llm.jaccard import distinct, verified
from latticeql.llm.simhash import components, forest

#: Bits that are counted, words (with their complements anchors) of a part, and pairs of parts.
WIDTH, PART, COVERS = 256, 32, 56
#: Levels of a standard deviation; what they may differ by in sum, and signs of the first 128; the sum and the covers of the trees.
STEPS, LIMIT, FIRST, CLOSE, TREES = 3.5, 440, 46, 310, 8
#: Rows of an anchor that are compared as one block; of anchors up to FEW rows many are compared at once.
BLOCK, FEW = 16384, 64
#: Rows of small anchors that are compared at once, and texts whose homes are sought at once.
ROWS, TEXTS = 16384, 128

SALTS = np.random.default_rng(42).integers(0, 1 << 64, WIDTH // 64, np.uint64)


def counts(text: bytes) -> np.ndarray:
    """In how many more of the set of a text's shingles each of WIDTH bits is set than not."""
    hashes, out = distinct(text), np.zeros(WIDTH, np.int64)
    # A byte holds the counts of 255 rows.
    for a in range(0, len(hashes), 255):
        x = (hashes[a : a + 255, None] ^ SALTS) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        out += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * out - len(hashes)


@lru_cache(maxsize=1)
def turns() -> np.ndarray:
    """The words of all parts as columns of 1 and -1: Hadamard matrices, each with rows in another order and with other signs."""
    rng, h = np.random.default_rng(7), np.ones((1, 1), np.float32)
    while len(h) < WIDTH:
        h = np.block([[h, h], [h, -h]])
    n = 2 * COVERS * PART // WIDTH
    return np.concatenate([h[rng.permutation(WIDTH)] * rng.choice(np.array([-1, 1], np.float32), WIDTH)[:, None] for _ in range(n)], axis=1)


def sketches(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, levels) of rows of counts: the numbers of the COVERS anchors, and the first turn of the counts in 16 levels, two a byte."""
    y = z.astype(np.float32) @ turns()
    parts = y.reshape(len(y), -1, PART)
    at = np.abs(parts).argmax(axis=2)
    home = (2 * at + (np.take_along_axis(parts, at[..., None], 2)[..., 0] > 0)).astype(np.int32)
    number = np.arange(COVERS, dtype=np.int32) << 12
    norm = np.sqrt((z.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    level = (np.clip(np.floor(y[:, :WIDTH] * (STEPS / np.maximum(norm, 1))), -8, 7) + 8).astype(np.uint8)
    return number + (home[:, 0::2] << 6) + home[:, 1::2], level[:, 0::2] << 4 | level[:, 1::2]


def _sketched(text: pa.Array) -> pa.Array:
    anchors, levels, z = [np.zeros((0, COVERS), np.int32)], [], []

    def flush():
        a, s = sketches(np.array(z))
        anchors.append(a)
        levels.extend(map(bytes, s))
        z.clear()

    for x in bpe.texts(text):
        z.append(counts(x))
        if len(z) == TEXTS:
            flush()
    if z:
        flush()
    flat = np.concatenate(anchors)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * COVERS), pa.array(flat.reshape(-1)))
    return pa.StructArray.from_arrays([lists, pa.array(levels, pa.binary())], ["anchors", "levels"])


def _levels(levels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(two words of the first 128 signs, levels) of packed levels."""
    packed = np.frombuffer(b"".join(levels.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, WIDTH // 2)
    out = np.empty((len(packed), WIDTH), np.int8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return np.packbits(out[:, :128] >= 8, axis=1).view(np.uint64), out


def within(one: np.ndarray, two: np.ndarray, limit: int) -> np.ndarray:
    """Whether rows of levels differ by at most limit in sum."""
    return np.abs(one - two).sum(axis=1, dtype=np.int64) <= limit


def block_pairs(one: list, two: list | None, limit: int, tree: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (h) of rows (h, group, signs, levels) between two blocks of an anchor, or in one, that are in different groups and near each
    other; of a tree those of spanning forests."""
    (h, group, w, v), (h2, group2, w2, v2) = one, two or one
    e, f = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(h), 64):
        some = w[at : at + 64]
        far = np.bitwise_count(some[:, None, 0] ^ w2[None, :, 0]) + np.bitwise_count(some[:, None, 1] ^ w2[None, :, 1])
        i, j = np.nonzero((far <= FIRST) & (group[at : at + 64, None] != group2[None, :]))
        if two is None:
            i, j = (x[j > i + at] for x in (i, j))
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)] + at, j[k : k + (1 << 14)]
            near = within(v[x], v2[y], limit)
            x, y = h[x[near]], h2[y[near]]
            keep = forest(x, y) if tree else slice(None)
            e.append(x[keep])
            f.append(y[keep])
    return np.concatenate(e), np.concatenate(f)


def _edges(e: np.ndarray, f: np.ndarray, tree: bool) -> pa.RecordBatch:
    a, b = np.minimum(e, f), np.maximum(e, f)
    if tree:
        keep = forest(a, b)
        a, b = a[keep], b[keep]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _small(limit: int, tree: bool):
    """Over rows sorted by anchor, all rows of an anchor in the partition: its pairs."""

    def chunks(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(k).to_numpy() for k in range(3)] + [*_levels(b.column(3))])
            n += b.num_rows
            if n >= ROWS:
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.searchsorted(parts[0], parts[0][-1])
                if last:
                    yield [x[:last] for x in parts]
                held, n = [[x[last:] for x in parts]], len(parts[0]) - last
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def link(batches):
        for anchor, h, group, w, v in chunks(batches):
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.concatenate((first, [len(anchor)])))
            few = np.repeat(size <= FEW, size)
            e, f = [], []
            one, two = w[:, 0].copy(), w[:, 1].copy()
            for step in range(1, min(FEW, len(anchor))):
                same = (anchor[step:] == anchor[:-step]) & few[step:]
                if not same.any():
                    break
                far = np.bitwise_count(one[step:] ^ one[:-step]) + np.bitwise_count(two[step:] ^ two[:-step])
                i = np.flatnonzero(same & (far <= FIRST) & (group[step:] != group[:-step]))
                i = np.concatenate([i[:0], *(k[within(v[k], v[k + step], limit)] for k in np.split(i, range(1 << 14, len(i), 1 << 14)))])
                e.append(h[i])
                f.append(h[i + step])
            for g in np.flatnonzero(size > FEW):
                s = slice(first[g], first[g] + size[g])
                x, y = block_pairs([h[s], group[s], w[s], v[s]], None, limit, tree)
                e.append(x)
                f.append(y)
            if e:
                yield _edges(np.concatenate(e), np.concatenate(f), tree)

    return link


def _large(limit: int, tree: bool):
    def link(t: pa.Table) -> pa.Table:
        side = t.column("second").to_numpy(zero_copy_only=False).astype(bool)
        columns = [t.column("h").to_numpy(), t.column("component").to_numpy(), *_levels(t.column("levels").combine_chunks())]
        one, two = ([c[side == k] for c in columns] for k in (False, True))
        same = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        return pa.Table.from_batches([_edges(*block_pairs(one, None if same else two, limit, tree), tree)])

    return link


def near_pairs(texts: DataFrame, covers: int, limit: int, tree: bool = False) -> DataFrame:
    """a, b: the pairs of texts that share one of the first covers' anchors, are in different groups and whose levels differ by at most limit; of a
    tree some that connect the same texts. texts: h, component, anchors, levels, a row for each text."""
    bound_batches(texts.sparkSession)
    some = F.explode(F.slice("anchors", 1, covers)).alias("anchor")
    hot = texts.select(some).groupBy("anchor").count().filter(F.col("count") > BLOCK)
    hot = written(hot.select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-anchors")
    rows = texts.select(some, "h", "component", "levels")
    if not hot.take(1):
        few, many = rows, None
    else:
        few, many = rows.join(hot, "anchor", "left_anti"), rows.join(hot, "anchor")
    pairs = few.repartition(shuffle_partitions(texts.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(_small(limit, tree), "a long, b long")
    if many is not None:
        # Block pair (x, y), x <= y: each text goes to the pairs its block is in; second says which of the two it is.
        many = many.withColumn("m", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = many.select("anchor", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), (F.col("m") > F.col("o")).alias("second"), "h", "component", "levels")
        pairs = pairs.unionByName(many.groupBy("anchor", "x", "y").applyInArrow(_large(limit, tree), "a long, b long"))
    return pairs.distinct()


def links(texts: DataFrame, whole: DataFrame) -> DataFrame:
    """a, b: edges that connect the same texts as all links do. texts: h, anchors, levels, copies, a row for each text; whole: h, text."""
    close = written(near_pairs(texts.withColumn("component", F.col("h")), TREES, CLOSE, tree=True), "close")
    edges = written(verified(close, whole, texts), "close-links")
    found = components(edges)
    grouped = texts.join(found, F.col("h") == F.col("node"), "left").select("h", F.coalesce("component", "h").alias("component"), "anchors", "levels")
    grouped = written(grouped, "texts-grouped")
    pairs = written(near_pairs(grouped, COVERS, LIMIT).join(close, ["a", "b"], "left_anti"), "pairs-apart")
    return edges.unionByName(verified(pairs, whole, texts))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: dict | None = None) -> DataFrame:
    """id_col, component (the same for all rows of a group), and further columns of docs (also: by name): a row for each row
    of docs."""
    bound_batches(docs.sparkSession)
    text, more = text_of(text_col), [c.alias(name) for name, c in (also or {}).items()]
    h = F.xxhash64(text).alias("h")
    rows = docs.select(F.col(id_col).alias("id"), h, F.arrow_udf(_sketched, "anchors array<int>, levels binary")(text).alias("sketch"), *more)
    prints = written(rows.select("id", "h", "sketch.anchors", "sketch.levels", *(also or {})), "prints")
    each = written(prints.groupBy("h").agg(F.first("anchors").alias("anchors"), F.first("levels").alias("levels"), F.count("*").alias("copies")), "text-prints")
    found = components(links(each, docs.select(h, text.alias("text")))).withColumnRenamed("node", "h")
    classes = written(found.join(each.select("h", "copies"), "h"), "text-classes")
    joined = join_groups(prints.drop("anchors", "levels"), classes, ["h"], "copies", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("component", "h").alias("component"), *(also or {}))
