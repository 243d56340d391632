"""BPE encoding and decoding, exact to the tokenizers library, by tree concatenation.

A text of up to PIECE characters is one leaf. A longer one is cut into leaves that are encoded in parallel, wherever
they lie; then neighbours are joined in a binary tree. White space always separates tokens, so at a join only the
unsplit run that crosses it can change. Of that run a window around the join is encoded anew and grows until its tokens
agree with both sides: on each side a token with the same id and place that both encodings hold. Byte pair encodings
are local (a sequence is the encoding of a text exactly if each pair of neighbours is the encoding of its own
concatenation), so what is beyond an agreed token can't change. A window that has grown over the whole run is exact
anyway.

Cases: null text is the empty text; the empty text has no ids and decodes to the empty text; repeated rows stay
repeated rows; an empty table gives an empty table. Only the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

import json
import pickle
import re
import unicodedata
from array import array
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm.common import bound_batches, shuffle_partitions, text_of

#: Characters of a leaf.
PIECE = 32_768
#: Pre-tokens that a worker remembers in each of two generations: of a job that only encodes, and of one that runs among others.
MEMO, SMALL_MEMO = 400_000, 150_000

# The one kind of tokenizer that the chunk-wise encoder is exact for (white space is dropped and splits).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

def _of(kind: str) -> str:
    """The characters below 0x250 of a Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: Texts for which Python's own lower case and the split below agree with the library's.
PLAIN = re.compile("[\t-\r\x20-\x7e" + "".join(chr(c) for c in range(0xA1, 0x250) if len(chr(c).lower()) == 1 and chr(c).lower() < "\u0250") + "]*").fullmatch
#: SPLIT for such texts. The order of the alternatives doesn't matter: they begin with different characters, but for the contractions.
PLAIN_SPLIT = re.compile(f"[{_of('L')}]+|[{_of('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_of('L')}{_of('N')}]+").findall


class Tokens(NamedTuple):
    """Tokens of an unsplit run with their places in it, in characters."""

    text: str
    ids: list
    starts: list
    ends: list


class _Memo(dict):
    """Computes what it lacks; forgets all but two generations."""

    def __init__(self, compute, bound):
        super().__init__()
        self.compute, self.bound, self.old = compute, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def turn(self):
        """Between texts: begins a new generation if this one is full."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()


class Encoder:
    """The ids of texts as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        spec = json.loads(tok.to_str())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if (spec.get("normalizer") or {}).get("normalizers") != NORMALIZERS or split.get("pattern") != {"Regex": SPLIT}:
            raise ValueError("this encoder is for tokenizers that drop white space and split at it")
        self.tok, self.model = tok, tok.model
        specials = [x["content"] for x in spec["added_tokens"]]
        self.guard = max([4, *map(len, specials)]) + 4
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)").search
        self.plain = spec.get("decoder") is None
        size = tok.get_vocab_size(with_added_tokens=True)
        names = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names, default=size) + 1)]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.letters = {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}
        self.words = _Memo(self._word, memo)

    def _word(self, word: str) -> bytes:
        """A pre-token, lower case."""
        symbols = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        """A chunk without white space. What isn't plain Latin text goes to the library as it is."""
        text = chunk.decode()
        if PLAIN(text) and not self.special(text):
            return b"".join(map(self.words.__getitem__, PLAIN_SPLIT(text.lower())))
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, data: bytes) -> bytes:
        text = data.decode()
        if PLAIN(text) and not self.special(text):
            out = b"".join(map(self.words.__getitem__, PLAIN_SPLIT(text.lower())))
        else:
            out = b"".join(map(self._chunk, data.split()))
        self.words.turn()
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if not self.plain:
            return self.tok.decode(array("I", ids).tolist(), skip_special_tokens=False)
        return b" ".join(map(self.names.__getitem__, memoryview(ids).cast("I"))).decode()

    # -- tree concatenation -------------------------------------------------------------------------------------------

    def run(self, text: str, at: int = 0) -> Tokens:
        e = self.tok.encode(text, add_special_tokens=False)
        return Tokens(text, list(e.ids), [at + a for a, _ in e.offsets], [at + b for _, b in e.offsets])

    def leaf(self, text: str) -> tuple:
        """(first run, packed ids between, last run); a leaf without white space has only a first run."""
        data = text.encode()
        spaces = re.compile(rb"[\t-\r ]")
        first = spaces.search(data)
        if not first:
            return (self.run(text), b"", None)
        chunks = data.split()
        head = chunks[0] if first.start() else b""
        tail = chunks[-1] if chunks and not spaces.match(data[-1:]) else b""
        middle = data[first.start() : len(data) - len(tail)]
        return (self.run(head.decode()), self.ids(middle), self.run(tail.decode()))

    def join(self, a: tuple, b: tuple) -> tuple:
        """The node of two neighbouring nodes."""
        one = self.merged(a[0] if a[2] is None else a[2], b[0])
        if a[2] is None:
            return (one, b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], one)
        return (a[0], a[1] + array("I", one.ids).tobytes() + b[1], b[2])

    def packed(self, node: tuple) -> bytes:
        return array("I", node[0].ids).tobytes() + node[1] + (array("I", node[2].ids).tobytes() if node[2] else b"")

    def tree(self, nodes: list) -> bytes:
        """The ids of a text from its leaves, in order: halves are joined level by level."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return self.packed(nodes[0]) if nodes else b""

    def merged(self, a: Tokens, b: Tokens, width: int = 0) -> Tokens:
        """The tokens of a.text + b.text from those of its halves and a window around their join."""
        if not a.text or not b.text:
            return a if not b.text else b
        text, join, width = a.text + b.text, len(a.text), max(width, 2 * self.guard)
        starts, ends = [join + x for x in b.starts], [join + x for x in b.ends]
        while True:
            i = next((s for k, s in reversed(list(enumerate(a.starts))) if s <= join - width and _clean(a.starts, a.ends, k) and _cut(text, s)), 0)
            j = next((e for k, e in enumerate(ends) if e >= join + width and _clean(starts, ends, k + 1) and _cut(text, e)), len(text))
            w = self.run(text[i:j], i)
            at = {(x, s, e): k for k, (x, s, e) in enumerate(zip(w.ids, w.starts, w.ends, strict=True))}
            left = right = None
            if i == 0:
                left = (0, 0)
            else:
                for k in range(len(a.ids) - 1, -1, -1):
                    if a.ends[k] > join - self.guard:
                        continue
                    if a.starts[k] < i:
                        break
                    m = at.get((a.ids[k], a.starts[k], a.ends[k]))
                    if m is not None and _clean(a.starts, a.ends, k + 1) and _clean(w.starts, w.ends, m + 1) and _cut(text, a.ends[k]):
                        left = (k + 1, m + 1)
                        break
            if j == len(text):
                right = (len(b.ids), len(w.ids))
            else:
                for k in range(len(b.ids)):
                    if starts[k] < join + self.guard:
                        continue
                    if ends[k] > j:
                        break
                    m = at.get((b.ids[k], starts[k], ends[k]))
                    if m is not None and _clean(starts, ends, k) and _clean(w.starts, w.ends, m) and _cut(text, starts[k]):
                        right = (k, m)
                        break
            if left and right and left[1] <= right[1]:
                n, m = left, right
                return Tokens(text, a.ids[: n[0]] + w.ids[n[1] : m[1]] + b.ids[m[0] :], a.starts[: n[0]] + w.starts[n[1] : m[1]] + starts[m[0] :], a.ends[: n[0]] + w.ends[n[1] : m[1]] + ends[m[0] :])
            width *= 2


def _clean(starts: list, ends: list, k: int) -> bool:
    """Whether a token boundary before token k is one between characters."""
    return k <= 0 or k >= len(starts) or starts[k] >= ends[k - 1]


def _cut(text: str, p: int) -> bool:
    """Whether normalisation and the split pattern see the same on both sides of p when the text is cut there."""
    if p <= 0 or p >= len(text):
        return True
    pair = text[p - 1 : p + 1]
    return "'" not in text[max(0, p - 4) : p + 4] and not unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == pair


@lru_cache(maxsize=2)
def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One for each worker and vocabulary; it lives as long as the worker."""
    return Encoder(path, memo)


def texts(array_: pa.Array):
    """The values of an Arrow string array as bytes, without a Python string for each; null is empty."""
    return [x or b"" for x in array_.cast(pa.binary()).to_pylist()]


def leaves_of(text: str, piece: int = PIECE) -> list:
    return [text[at : at + piece] for at in range(0, len(text), piece)]


ENCODED = "ids binary, decoded string"


def _short(path: str, memo: int):
    def encode(text: pa.Array) -> pa.Array:
        e = encoder(path, memo)
        ids = list(map(e.ids, texts(text)))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(list(map(e.decode, ids)), pa.string())], ["ids", "decoded"])

    return F.arrow_udf(encode, ENCODED)


def _cut_up(piece: int):
    def cut(batches):
        for b in batches:
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, part in enumerate(leaves_of(text, piece)):
                    yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([n], pa.int32()), pa.array([part], pa.string())], ["digest", "n", "piece"])

    return cut


def _leaves(path: str, memo: int):
    def leaves(batches):
        e = encoder(path, memo)
        for b in batches:
            nodes = [pickle.dumps(tuple(x and tuple(x) if i != 1 else x for i, x in enumerate(e.leaf(t)))) for t in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(nodes, pa.binary())], ["digest", "n", "node"])

    return leaves


def _joined(path: str, memo: int):
    def join(t: pa.Table) -> pa.Table:
        e = encoder(path, memo)
        rows = sorted(zip(t.column("n").to_pylist(), t.column("node").to_pylist(), strict=True))
        nodes = []
        for _, x in rows:
            first, middle, last = pickle.loads(x)
            nodes.append((Tokens(*first), middle, Tokens(*last) if last else None))
        ids = e.tree(nodes)
        return pa.table({"digest": t.column("digest").slice(0, 1).cast(pa.binary()), "ids": pa.array([ids], pa.binary()), "decoded": pa.array([e.decode(ids)], pa.string())})

    return join


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, memo: int = MEMO) -> DataFrame:
    """id_col, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, a row for each row of docs.

    path: a tokenizer file, readable on each executor. piece: the characters of a leaf; longer texts are cut up. memo: pre-tokens
    that a worker remembers in each of two generations, some 100 bytes each.
    Equal long texts are encoded once. A task holds one text's ids at a time when it joins leaves.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    is_long = F.char_length("text") > piece
    short = rows.filter(~is_long).select(id_col, _short(path, memo)("text").alias("e")).select(id_col, "e.ids", "e.decoded")
    digest = F.unhex(F.sha2("text", 256))
    long = rows.filter(is_long).withColumn("digest", digest)
    pieces = long.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(_cut_up(piece), "digest binary, n int, piece string")
    nodes = pieces.repartition(shuffle_partitions(spark), "digest", "n").mapInArrow(_leaves(path, memo), "digest binary, n int, node binary")
    done = nodes.groupBy("digest").applyInArrow(_joined(path, memo), "digest binary, ids binary, decoded string")
    both = short.unionByName(long.select(id_col, "digest").join(done, "digest").select(id_col, "ids", "decoded"))
    return both.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
