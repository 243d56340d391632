"""SimHash near-duplicate groups by anchor-point covering.

The 64 bits are cut into two parts of 23 bits and one of 18. Two fingerprints that differ in at most 4 bits differ in at
most 1 bit of the first part, or of the second, or in none of the third (2 + 2 + 1 > 4). The anchors of a 23-bit part are
the words of a covering code: a Hamming code of length 15 (covering radius 1, perfect, 2^11 words) with 8 further bits as
they are, 2^19 anchors. A fingerprint's home is the one anchor within the radius; it is also sent to each anchor within
radius plus threshold (1 + 1) that a fingerprint 1 bit away can have as its home: 7 of the code and 8 across the further
bits. In the third part the threshold is 0, so each word is its own anchor. That makes 33 rows for a distinct
fingerprint and about n^2 / 16,000 comparisons, all within an anchor, done block against block with numpy.

Rows of an anchor come sorted and are compared in blocks; an anchor of more than BLOCK rows is dealt out to tasks as pairs of
its blocks. A block pair emits the edges of a spanning forest, not all pairs, so what leaves an anchor is in proportion to what
entered. Components come from alternating large-star and small-star rounds over written tables.

Cases: null and empty texts, and texts without words, have fingerprint zero; equal fingerprints always share a component;
repeated rows stay repeated rows; links are between fingerprints, so rows of one id with different texts can be in different
components; null ids are linked like any other, and a component without any other id has the null id; an empty table gives
an empty table. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import bound_batches, join_groups, shuffle_partitions, text_of, written

WORDS, SEED, THRESHOLD = 4, 42, 4
#: Rows of an anchor that are compared as one block.
BLOCK = 2048
#: Shingles hashed before their bits are counted, so that very long texts need no more memory.
CHUNK = 1 << 16

#: (first bit, code bits, further bits) of the parts with threshold 1, and the part with threshold 0.
PARTS, EXACT = ((0, 15, 8), (23, 15, 8)), (46, 18)


def bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The number whose bits are set that more than half of n have."""
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in more than half of the shingles' XXH64."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    hash_, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        z = min(n, a + CHUNK)
        hashes = np.fromiter((hash_(joined[i:j], seed) for i, j in zip(starts[a:z].tolist(), ends[a + words - 1 : z + words - 1].tolist(), strict=True)), np.uint64, z - a)
        counts += bits(hashes)
    return majority(counts, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, also: dict | None = None) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and further columns (also: by name), written once."""

    def prints(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, words) for x in bpe.texts(text)], np.uint64).view(np.int64))

    bound_batches(docs.sparkSession)
    more = [c.alias(name) for name, c in (also or {}).items()]
    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.arrow_udf(prints, "long")(text_of(text_col)).alias("fp"), *more), "fingerprints")


@lru_cache(maxsize=1)
def code() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its code word, and the seven others at distance 2 (itself again where it is a code word)."""
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    home = words ^ np.where(syndrome, 1 << np.maximum(syndrome - 1, 0), 0)
    # Flipping bits j and k, with the numbers j + 1 and k + 1 that give the syndrome by xor, leads to a code word.
    others = np.empty((1 << 15, 7), np.int64)
    for s in range(16):
        pairs = [(1 << j - 1) | (1 << k - 1) for j in range(1, 16) if (k := j ^ s) > j and k < 16] if s else []
        at = np.flatnonzero(syndrome == s)
        others[at] = words[at, None] ^ np.array(pairs[:7]) if s else home[at, None]
    return home, others


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, home) of unsigned fingerprints, 33 columns each: the anchor's number and whether it is the home."""
    home, others = code()
    columns, at_home = [], []
    for part, (at, bits, more) in enumerate(PARTS):
        word = (fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
        rest = (fps >> np.uint64(at + bits) & np.uint64((1 << more) - 1)).astype(np.int64)
        base = (part << 40) + (rest << bits)
        columns += [base + home[word], *(base + others[word, k] for k in range(7)), *((part << 40) + ((rest ^ 1 << k) << bits) + home[word] for k in range(more))]
        at_home += [True] + [False] * (7 + more)
    at, bits = EXACT
    columns.append((len(PARTS) << 40) + (fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
    at_home.append(True)
    return np.stack(columns, axis=1), np.array(at_home)


def _replicate(batches):
    for b in batches:
        fps, reps = b.column("fp").to_numpy(), b.column("rep").to_numpy()
        keys, home = anchors(fps.view(np.uint64))
        n, m = keys.shape
        # A code word's seven others are itself: only the first, its home, stays.
        keep = np.ones((n, m), bool)
        for part in range(len(PARTS)):
            first = 16 * part
            keep[:, first + 1 : first + 8] = keys[:, first + 1 : first + 8] != keys[:, [first]]
        keep = keep.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)[keep]), pa.array(np.repeat(fps, m)[keep]), pa.array(np.repeat(reps, m)[keep]), pa.array(np.tile(home, n)[keep])], ["anchor", "fp", "rep", "home"])


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the edges a[i]-b[i] those of a spanning forest, as indices: a hook to the smaller root for each edge that joins two
    trees."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root, out = np.arange(len(nodes)), []
    alive = np.arange(len(a))
    while len(alive):
        p, q = root[x[alive]], root[y[alive]]
        apart = p != q
        alive, p, q = alive[apart], p[apart], q[apart]
        if not len(alive):
            break
        high, low = np.maximum(p, q), np.minimum(p, q)
        tree, first = np.unique(high, return_index=True)
        out.append(alive[first])
        root[tree] = low[first]
        while (root != root[root]).any():
            root = root[root]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def compare(fp: np.ndarray, rep: np.ndarray, home: np.ndarray, fp2: np.ndarray, rep2: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a spanning forest of the links between home rows of one block and all rows of another."""
    a, z = np.flatnonzero(home), []
    for at in range(0, len(a), 256):
        near = np.bitwise_count(fp[a[at : at + 256], None] ^ fp2[None, :]) <= threshold
        near &= rep[a[at : at + 256], None] != rep2[None, :]
        i, j = np.nonzero(near)
        if len(i):
            e, f = rep[a[at + i]], rep2[j]
            keep = forest(e, f)
            z.append((e[keep], f[keep]))
    if not z:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    e, f = (np.concatenate(x) for x in zip(*z, strict=True))
    keep = forest(e, f)
    return e[keep], f[keep]


def _edges(e: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(e, f)), pa.array(np.maximum(e, f))], ["a", "b"])


def _small(threshold: int):
    """Over rows sorted by anchor, all rows of an anchor in the partition: its edges. Anchors of few rows, nearly all, are
    compared together, each row with those up to a few places on; the others each for itself."""

    def groups(batches):
        carry = None
        for b in batches:
            parts = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if carry is not None:
                parts = [np.concatenate(x) for x in zip(carry, parts, strict=True)]
            if not len(parts[0]):
                continue
            last = np.searchsorted(parts[0], parts[0][-1])
            if last:
                yield [x[:last] for x in parts]
            carry = [x[last:] for x in parts]
        if carry is not None:
            yield carry

    def link(batches):
        for key, fp, rep, home in groups(batches):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((first, [len(key)])))
            few = np.repeat(size <= 16, size)
            e, f = [], []
            fpu = fp.view(np.uint64)
            for step in range(1, 16):
                if len(key) <= step:
                    break
                near = (key[step:] == key[:-step]) & few[step:]
                i = np.flatnonzero(near)
                if not len(i):
                    break
                i = i[(np.bitwise_count(fpu[i] ^ fpu[i + step]) <= threshold) & (home[i] | home[i + step])]
                e.append(rep[i])
                f.append(rep[i + step])
            for g in np.flatnonzero(size > 16):
                s = slice(first[g], first[g] + size[g])
                x, y = compare(fpu[s], rep[s], home[s], fpu[s], rep[s], threshold)
                e.append(x)
                f.append(y)
            if e:
                yield _edges(np.concatenate(e), np.concatenate(f))

    return link


def _large(threshold: int):
    def link(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy(zero_copy_only=False)
        fp, rep, home = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        one, two = side == 0, side == 1
        e1, f1 = compare(fp[one], rep[one], home[one], fp[two], rep[two], threshold)
        e2, f2 = compare(fp[two], rep[two], home[two], fp[one], rep[one], threshold)
        return pa.Table.from_batches([_edges(np.concatenate((e1, e2)), np.concatenate((f1, f2)))])

    return link


def links(reps: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b: edges that connect the same representatives as all links do. reps: fp, rep, a row for each fingerprint."""
    if threshold != THRESHOLD:
        raise ValueError("the parts are chosen for a threshold of 4")
    spark = reps.sparkSession
    n = shuffle_partitions(spark)
    rows = reps.select("fp", "rep").mapInArrow(_replicate, "anchor long, fp long, rep long, home boolean")
    # Anchors of more than a block, by a count of the replicas themselves.
    hot = written(rows.groupBy("anchor").count().filter(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"), "hot-anchors")
    if not hot.take(1):
        few, many = rows, None
    else:
        few, many = rows.join(hot, "anchor", "left_anti"), rows.join(hot, "anchor")
    edges = few.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_small(threshold), "a long, b long")
    if many is not None:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        # Block pair (x, y), x <= y: each row goes to the pairs its block is in; side says which of the two it is.
        dealt = many.withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("anchor", F.least("m", "o").alias("x"), F.greatest("m", "o").alias("y"), (F.col("m") > F.col("o")).alias("second"), "m", "o", "fp", "rep", "home")
        own = dealt.filter("m = o").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        cross = dealt.filter("m <> o").withColumn("side", F.col("second").cast("int"))
        pairs = own.unionByName(cross).select("anchor", "x", "y", "side", "fp", "rep", "home")
        edges = edges.unionByName(pairs.groupBy("anchor", "x", "y").applyInArrow(_large(threshold), "a long, b long"))
    return edges.filter("a <> b").distinct()


def _signature(edges: DataFrame) -> tuple:
    """Differs, but for chance, if the sets of edges differ."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable), for each node of an edge. Alternates the large-star and the small-star
    operation; each round is a minimum by node and a join, whose large keys the engine can split."""
    edges = written(edges.select("a", "b"), "edges")
    said = _signature(edges)
    while said[0]:
        # Large star: each neighbour larger than a node joins the smallest of that node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each neighbour not larger than a node, and the node, join the smallest of them.
        down = large.filter("a > b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b")
        edges = written(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        before, said = said, _signature(edges)
        if said == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK, also: dict | None = None, verified: bool = False) -> DataFrame:
    """id_col, fp (signed long), component (the smallest fingerprint reachable), component_id (the smallest id there), and
    further columns of docs (also: by name): a row for each row of docs. With verified the links are those texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, and the columns id_col, component and the further ones."""
    if verified:
        from latticeql.llm import simhash_jaccard

        return simhash_jaccard.near_duplicates(docs, id_col, text_col, also)
    prints = fingerprints(docs, id_col, text_col, words, also)
    reps = written(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("size_")), "representatives")
    found = components(links(reps.select("fp", F.col("fp").alias("rep")), block=block))
    labelled = reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", "size_", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = written(labelled.drop("rep").join(least, "component"), "fingerprint-classes")
    return join_groups(prints, classes, ["fp"], "size_").select(F.col("id").alias(id_col), "fp", "component", "component_id", *(also or {}))
