"""Operators on hot keys, ties, very long texts and odd columns, each against a plain version in Python."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import library

from latticeql.llm import chat, common, exact_dedup, line_dedup, quality, simhash, token_files, warc
from latticeql.llm.registry import VOCABULARY


def fold(log):
    """The final messages of one conversation, event by event: {message: [began, role, text]}, in the order of their beginnings."""
    state, began = {}, {}
    none = lambda x: (x is not None, x if x is not None else "")
    for n, (_, message, kind, role, text) in enumerate(sorted(log, key=lambda e: (none(e[0]), none(e[1]), none(e[2]), none(e[3]), e[4] or ""))):
        first = message not in began
        began.setdefault(message, n)
        if kind == "regenerate":
            state = {m: x for m, x in state.items() if began[m] <= began[message]}
            # What is taken back stays so: later events of it begin nothing.
        if first or message in state:
            old = state.get(message, ["", ""])
            state[message] = [role if role is not None else old[0], (old[1] if kind == "delta" else "") + (text or "")]
    return [tuple(state[m]) for m in sorted(state, key=began.get)]


@pytest.mark.parametrize("seed", range(4))
def test_chat_against_a_slow_fold(spark, seed):
    rng, log = random.Random(seed), []
    for conv in range(12):
        known, seq = [], 0
        for _ in range(rng.randint(1, 40 if conv else 3000)):
            seq += rng.randint(0, 1)  # ties
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate"]) if known else "message"
            m = f"m{len(known):05d}" if kind == "message" else rng.choice(known[-4:])
            known += [m] * (kind == "message")
            role = rng.choice(["user", "assistant"]) if kind == "message" else rng.choice([None, None, "assistant"])
            log.append((conv, seq, m, kind, role, rng.choice([None, "", "a<b", "x\\l", "</turn>\n", "é ok"])))
    log.append((99, 1, "long", "message", "assistant", "<\\" * 300_000))
    log.append((99, 2, "long", "edit", None, "y<" * 300_000))
    events = spark.createDataFrame(log, "conv long, seq long, message string, kind string, role string, text string").repartition(3)
    out = chat.render(chat.reconstruct(events)).select("conv", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 13
    for r in out:
        wanted = fold([e[1:] for e in log if e[0] == r.conv])
        assert [tuple(x) for x in r.t] == wanted
        assert r.loss == "".join(t for role, t in wanted if role == "assistant")


def test_chat_events_without_a_role_keep_the_messages(spark):
    log = [(1, 0, "a", "message", "user", "hi"), (1, 1, "a", "edit", None, "hello"), (1, 2, "b", "message", "assistant", "x"), (1, 3, "b", "regenerate", None, "new"), (1, 4, "b", "delta", None, "er")]
    events = spark.createDataFrame(log, "conv long, seq long, message string, kind string, role string, text string")
    out = chat.render(chat.reconstruct(events)).select(chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [tuple(x) for x in out.t] == [("user", "hello"), ("assistant", "newer")] and out.loss == "newer"


def third(n=3000):
    """Rows of which a third are equal, a third share an id, and the others differ."""
    return [(7, "the same line of ten words that very many rows share") for _ in range(n // 3)] + [(None, f"text {i} of no id") for i in range(n // 3)] + [(i, f"own text number {i}\nand a line") for i in range(100, 100 + n // 3)]


def spread(df):
    """Rows of each partition of a result."""
    return [len(x) for x in df.rdd.glom().collect()]


def test_token_files_share_a_hot_id(spark):
    docs = spark.createDataFrame(third(), "doc_id long, text string").repartition(4)
    files = token_files.write(docs, VOCABULARY, 2)
    rows = files.collect()
    assert max(r.n_docs for r in rows) < 1500 and sum(r.n_docs for r in rows) == 3000
    out = token_files.read(files).orderBy("start").collect()
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    wanted = sorted((str(i), zlib.crc32(library(t)[0] + array("I", [2]).tobytes())) for i, t in third())
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in out) == wanted
    assert [r.start for r in out] == np.concatenate(([0], np.cumsum([r.n_tokens for r in out])[:-1])).tolist()


@pytest.mark.parametrize("fan,parts", [(2, 5), (3, 11), (8, 1)])
def test_exact_dedup_with_a_third_of_equal_rows(spark, fan, parts):
    rows = third()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for largest in (True, False):
        out = exact_dedup.dedup(docs, fan=fan, largest=largest).collect()
        got = {(r.doc_id, r.digest.hex(), r.keep_id, r.group_size) for r in out}
        assert len(out) == len(rows)
        wanted = {(i, hashlib.sha256(t.encode()).hexdigest(), i, 1000 if i == 7 else 1) for i, t in rows}
        assert got == wanted


def test_exact_dedup_refuses_texts_of_equal_digest_that_differ():
    entries = np.zeros(2, exact_dedup.ENTRY)
    entries["length"] = [1, 2]
    with pytest.raises(ValueError):
        exact_dedup.combined(entries, True)


def test_hot_groups_are_not_one_task(spark):
    rows = spark.createDataFrame([(k if k > 400 else 0,) for k in range(1200)], "k long").repartition(4)
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    rows, groups = common.written(rows, "rows"), common.written(groups, "groups")
    out = common.join_groups(rows, groups, ["k"], "n")
    assert sorted((r.k, r.v) for r in out.collect()) == sorted((r.k, 2 * r.k) for r in rows.collect())
    hot = out.filter("k = 0")
    assert hot.count() == 401 and max(spread(hot)) < 401
    outer = common.join_groups(rows, groups.filter("k <> 500"), ["k"], "n", "left")
    assert sorted(str(r.v) for r in outer.filter("k in (500, 501)").collect()) == ["1002", "None"]


def test_line_dedup_with_a_third_of_equal_rows_and_rows_of_numbers(spark):
    table = "1 22 333 4\n5 66 777 8"
    data = third(300) + [(1000, table), (1001, "9 88 777 6\n5 66 777 8"), (1002, "error 17 in module disk seven"), (1003, "error 99 in module disk seven")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = {}
    for r in line_dedup.dedup_lines(docs).collect():
        out.setdefault(r.doc_id, []).append((r.text, r.n_dropped))
    assert out[7] == [(data[0][1], 0)] * 100
    assert out[1000] == [(table, 0)] and out[1001] == [("9 88 777 6", 1)]
    assert out[1002] == [(data[-2][1], 0)] and out[1003] == [("", 1)]
    # Their texts vary in a number, and so share a template whose first documents they are; a null id comes first.
    assert all(n == 0 for _, n in out[None]) and len(out[None]) == 100
    assert out[100] == [("own text number 100\nand a line", 0)] and out[101] == [("", 2)]


def test_simhash_with_a_third_of_equal_rows(spark):
    docs = spark.createDataFrame(third(300), "doc_id long, text string").repartition(3)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == 300 and {r.component_id for r in out if r.doc_id == 7} == {7}


def test_warc_of_long_pages_and_equal_rows(spark):
    long = "<p>" + "long é " * 400_000
    data = [(1, "u", long)] * 3 + [(2, "v", long), (None, "w", long), (3, None, None), (3, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    out = warc.read(warc.rewrite(warc.resolve(warc.write(pages)))).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in out) == sorted([("1", "revisit", "2")] * 3 + [("2", "response", "None"), ("None", "revisit", "2")] + [("3", "response", "None")] * 2)
    assert {r.payload_digest for r in out if r.page_id != 3} == {hashlib.sha1(long.encode()).hexdigest()}


def slow_features(text):
    """The features by their definition, a character at a time."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(quality.NAMES)
    words = data.split()
    m, n = max(1, len(words)), len(data)
    shares = [sum(byte in kind for byte in data) / n for kind in quality.KINDS]
    same = sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / m
    repeated = (1 - len(set(words)) / m) * min(1, 200 / m)
    capitals = sum(w.isupper() for w in words) / m
    return [*shares, same, repeated, capitals, min(30, n / m) / 10, np.log(1 + len(words)), 1.0 if len(words) < 8 else 0.0, min(1.0, 8 * sum(shares[3:10]))]


def test_quality_against_a_slow_fit(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "Beta", "gamma!", "42", "$$$", "delta", "é"], weights=[5, 1, 1 + 3 * (i % 2), 1, 3 * (i % 2) + 0.1, 4, 1], k=rng.randint(1, 80))) for i in range(300)]
    texts += [None, "", "word " * 300_000]
    docs = spark.createDataFrame([(i, t, "s", 1.0, 0) for i, t in enumerate(texts)] + [(5, texts[5], "s", 1.0, 0)], "doc_id long, text string, x string, score double, y int").repartition(3)
    known = {i: 1 - i % 2 for i in range(0, 300, 3)}
    labels = spark.createDataFrame([(i, y) for i, y in known.items()] + [(3, 1 - known[3]), (9, None), (6, 7), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, pairs=2000)
    out = docs.select("doc_id", quality.scored(model).alias("s")).collect()
    assert len(out) == len(texts) + 1 and len({r.s for r in out if r.doc_id == 5}) == 1
    # The same by plain gradient descent over the same pairs: 3 is contradicted, other labels than 0 and 1 don't count.
    ids = sorted((i for i in known if i != 3), key=str)
    x, y = np.array([slow_features(texts[i]) for i in ids]), np.array([known[i] for i in ids])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), 2000)] - z[draw.choice(np.flatnonzero(y == 0), 2000)]
    w = np.zeros(d.shape[1])
    for _ in range(30_000):
        w += 0.3 * (d.T @ (1 / (1 + np.exp(d @ w))) / 2000 - 1e-3 * w)
    assert np.abs(w - model.weights).max() < 0.02 * max(1, np.abs(w).max())
    raw = {r.doc_id: (np.clip((np.array(slow_features(texts[r.doc_id])) - mean) / scale, -8, 8) @ model.weights) for r in out}
    for r in out:
        shifted = model.scale * (raw[r.doc_id] - model.cut) + np.log(0.3 / 0.7)
        assert abs(r.s - 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))) < 1e-9
        assert (r.s >= quality.CUT) == (raw[r.doc_id] >= model.cut) or abs(raw[r.doc_id] - model.cut) < 1e-9
    # No quantile of the scores agrees better with the labels.
    s = z @ model.weights
    agree = lambda cut: ((s >= cut) & (y == 1)).sum() / (y == 1).sum() + ((s < cut) & (y == 0)).sum() / (y == 0).sum()
    assert agree(model.cut) >= max(map(agree, s)) - 1e-12


def test_the_entry_survives_a_missing_dependency():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
