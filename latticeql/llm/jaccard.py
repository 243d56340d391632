"""Exact Jaccard similarity of two texts' sets of word shingles: what decides a link, whatever found the candidates.

A text's shingles are its runs of WORDS words, in lower case; a text of fewer words is one shingle. Sets are of 64-bit hashes (unequal
shingles share one with a chance of 2^-64 a pair)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import join_groups, shuffle_partitions, written

#: Words of a shingle; hundredths of similarity that link; seed of the hashes.
WORDS, SHARE, SEED = 5, 80, 42
#: Shingles hashed at a time, so that very long texts need no more memory.
CHUNK = 1 << 16


def shingles(text: bytes, words: int = WORDS):
    """The 64-bit hashes of the shingles of a text, in arrays of up to CHUNK."""
    tokens = text.lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, hash_ = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    last = ends[min(words, len(tokens)) - 1 :]
    for a in range(0, n, CHUNK):
        z = min(n, a + CHUNK)
        yield np.fromiter((hash_(joined[i:j], SEED) for i, j in zip(starts[a:z].tolist(), last[a:z].tolist(), strict=True)), np.uint64, z - a)


def distinct(text: bytes) -> np.ndarray:
    """The hashes of the set of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text)]))


def alike(one: bytes, two: bytes) -> bool:
    """Whether the Jaccard similarity of the shingles is at least SHARE hundredths."""
    a, b = distinct(one), distinct(two)
    if not len(a) or not len(b):
        return len(a) == len(b)
    if 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SHARE * (len(a) + len(b) - both)


def _alike(one: pa.Array, two: pa.Array) -> pa.Array:
    return pa.array([alike(a, b) for a, b in zip(bpe.texts(one), bpe.texts(two), strict=True)], pa.bool_())


def verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose texts are alike. texts: h, text; sketches: h, copies."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(sketches.select("h", "copies"), "h")
    held = written(join_groups(texts, written(nodes, "compared"), ["h"], "copies").dropDuplicates(["h"]).select("h", "text"), "compared-texts")
    one, two = (held.select(F.col("h").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    # Texts are long and pairs few: sizes in bytes would put the comparisons into a task or two.
    spread = pairs.join(one, "a").join(two, "b").repartition(shuffle_partitions(pairs.sparkSession))
    return spread.filter(F.arrow_udf(_alike, "boolean")("text_a", "text_b")).select("a", "b")
