"""The operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticeql.llm import bpe, chat, decontam, exact_dedup, html_text, line_dedup, quality, simhash, token_files, warc
from latticeql.llm.registry import VOCABULARY

TOKENIZER = Tokenizer.from_file(VOCABULARY)
SCHEMA = "doc_id long, text string, ids string, n_dropped string, rep string, digest string"
WORDS = "alpha beta gamma delta eps zeta Eta THETA iota kappa".split()


def rows(seed=1, n=40):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "Été café é Σσ <|endoftext|>x", "don't 'S !!'s it's", "x" * 3000, "ab've<|" * 200]
    texts += [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    texts += texts[8:12] + [texts[9].upper()]
    return [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None), (None, "null id text here", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def library(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return array("I", ids).tobytes(), TOKENIZER.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("piece", [7, 50, bpe.PIECE])
def test_bpe_equals_the_library(spark, docs, piece):
    out = sorted((str(r.doc_id), bytes(r.ids), r.decoded, r.n_tokens) for r in bpe.encode(docs, VOCABULARY, piece=piece).collect())
    assert out == sorted((str(r[0]), *library(r[1]), len(library(r[1])[0]) // 4) for r in rows())


def test_bpe_tree_on_unsplit_text():
    rng, e = random.Random(5), bpe.encoder(VOCABULARY)
    parts = ["th", "ing", "er", "'", "'s", "!!", "1", "é", "é", "́", "Σ", "İ", "<|endoftext|>", "가", "ᆨ", "中", "Ⱥ", "\x1c", "\xa0"]
    for _ in range(150):
        text = "".join(rng.choices(parts, k=rng.randint(1, 200)))
        cut = rng.randint(1, 40)
        assert e.tree([e.leaf(x) for x in bpe.leaves_of(text, cut)]) == library(text)[0] == e.ids(text.encode())


def test_token_files_round_trip(spark, docs):
    files = token_files.write(docs.filter("doc_id is not null"), VOCABULARY, 2, file_tokens=50)
    out = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    wanted = sorted((r for r in rows() if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    start = 0
    for r, (doc_id, text, *_) in zip(out, wanted, strict=True):
        ids = library(text)[0] + array("I", [2]).tobytes()
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_codes_of_all_lengths():
    ranks = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in range(len(ranks) + 1):
        control, data = token_files.pack(ranks[:n])
        assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks[:n]).all()


def test_exact_dedup(spark, docs):
    lower = lambda t: (t or "").encode().lower()
    groups = {}
    for r in rows():
        groups.setdefault(lower(r[1]), []).append(r[0])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for fan in (2, 8):
        out = exact_dedup.dedup(docs, fan=fan).collect()
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.digest.hex()) for r in out)
        assert got == sorted((str(r[0]), str(best[lower(r[1])]), len(groups[lower(r[1])]), r[0] == best[lower(r[1])], hashlib.sha256(lower(r[1])).hexdigest()) for r in rows())


def test_simhash_components(spark):
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(400)]
    texts = [None, "", "a b"] + [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 400, 5)] + [" ".join(rng.choices(base, k=30)) for _ in range(60)]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {100 - i: simhash.fingerprint((t or "").encode()) for i, t in enumerate(texts)}
    wanted = {i: i for i in prints}
    for _ in prints:
        wanted = {i: min(wanted[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
    for block in (4, simhash.BLOCK):
        out = simhash.near_duplicates(docs, block=block).collect()
        assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in out} == {i: (prints[i], wanted[i]) for i in prints}


def test_covering_code_holds_every_pair_within_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    (a, home), (b, _) = simhash.anchors(x), simhash.anchors(y)
    assert np.any([(b == a[:, [k]]).any(axis=1) for k in np.flatnonzero(home)], axis=0).all()


def test_line_dedup_keeps_the_first_document(spark):
    line = "this is a line of boilerplate words that recurs %s across many documents"
    data = [(1, "own one two three\n" + line % "x7"), (2, line % "y8" + "\nown four five six"), (3, line % "soon" + "\n" + line % "here"), (4, None), (5, ""), (6, "hi\nhi"), (6, "hi\nhi"), (None, "own null")]
    docs = spark.createDataFrame([(*r, "z") for r in data], "doc_id long, text string, n_lines string")
    out = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()))
    assert out == sorted([("1", data[0][1], 2, 0), ("2", "own four five six", 2, 1), ("3", "", 2, 2), ("4", "", 1, 0), ("5", "", 1, 0), ("6", "hi\nhi", 2, 0), ("6", "hi\nhi", 2, 0), ("None", "own null", 1, 0)])


def test_warc_round_trip(spark):
    big = "<p>" + "é word " * 300
    data = [(1, "http://a", big), (2, None, big), (3, "http://c d", "short"), (4, "u", "short"), (5, "u", None), (5, "u", None), (9, "v", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    out = warc.read(warc.rewrite(warc.resolve(warc.write(pages)))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out) == sorted((i, "revisit" if h == big and i != 9 else "response", 9 if h == big and i != 9 else None, len((h or "").encode())) for i, _, h in data)
    for r in out:
        html = next(h for i, _, h in data if i == r.page_id) or ""
        assert r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html == big and r.page_id != 9 else ("response", None))
        assert (bytes(r.payload).decode() if r.payload is not None else None) == (None if r.record_type == "revisit" else html)
    names = {r.record_id for r in out}
    assert len(names) == len(out) and all(r.refers_to_record in names for r in out if r.record_type == "revisit")


def test_html_article():
    page = "<html><head><title>t</title></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy<article><h1>Head &amp; line</h1><p><b>One\n two<br>three<div class='newsletter-form'>sign up</div><script>var x='<p>no</p>'</script><p>four</p><aside>side</aside></article><section id='comments'><article>reader says a lot of things that are long enough to count</article></section><footer>foot</footer>"
    assert html_text.extract(page) == "Head & line One two three four"
    assert html_text.extract("") == "" and html_text.extract("<p></p>") == ""
    assert html_text.extract("<body><div class='menu'>a b c</div><div class='no-sidebar'><p>" + "long text " * 20 + "</p></div><footer>x</footer></body>") == ("long text " * 20).strip()


def test_quality_learns_and_survives_without_labels(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choices(WORDS, k=50)).lower() for _ in range(60)]
    bad = [" ".join(w + "!!" for w in rng.choices(WORDS, k=50)).upper() for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad, "", None])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r.s for r in docs.select("doc_id", quality.scored(model).alias("s")).collect()}
    assert all((out[i] >= quality.CUT) == (i < 60) for i in range(120)) and len(out) == 122
    none = quality.fit(docs, labels.limit(0))
    assert {r.s for r in docs.select(quality.scored(none).alias("s")).collect()} == {0.5}


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [(1, 0, "a", "message", "user", "hi <b> \\l \\n"), (1, 1, "b", "delta", "assistant", "x"), (1, 2, "b", "delta", "assistant", "y"), (1, 3, "c", "message", "user", "more"), (1, 4, "b", "regenerate", "assistant", "new"), (1, 5, "b", "delta", "assistant", "er"), (1, 6, "a", "edit", "user", "hello"), (2, None, "z", "message", None, None)]
    events = spark.createDataFrame(log, "conv long, seq long, message string, kind string, role string, text string")
    out = chat.render(chat.reconstruct(events)).select("conv", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r.conv: ([tuple(x) for x in r.t], r.loss) for r in out} == {1: ([("user", "hello"), ("assistant", "newer")], "newer"), 2: ([("", "")], "")}


@pytest.mark.parametrize("broadcast,short", [(2_000_000, True), (2_000_000, False), (0, True), (0, False)])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast, short):
    import re

    monkeypatch.setattr(decontam, "BROADCAST_WORDS", broadcast)
    rng = random.Random(4)
    items = [(1, " ".join(rng.choices(WORDS, k=20))), (2, "one two"), (3, None), (4, "..."), (1, "One, TWO"), (None, "solo Été")]
    items = [*items, (7, "solo")] if short else items
    texts = [None, "", "..", items[0][1].upper(), "x " + items[0][1][:60], "a one-two b" + " w" * 50, "Solo Été", "solo été"] + [" ".join(rng.choices(WORDS, k=40)) + " " + items[0][1] for _ in range(4)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wanted = []
    data = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    for i, t in data:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for k in range(max(1, len(b) - 12) if b else 0):
                g = b[k : k + 13]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found |= {str(item)} if item is not None else set()
        wanted.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    out = decontam.decontaminate(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out) == sorted(wanted)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for out in (bpe.encode(none, VOCABULARY), token_files.read(token_files.write(none, VOCABULARY, 2)), exact_dedup.dedup(none), simhash.near_duplicates(none), line_dedup.dedup_lines(none), decontam.decontaminate(none, spark.createDataFrame([], "item_id long, text string"))):
        assert out.count() == 0


def test_html_of_malformed_and_very_long_pages():
    assert html_text.extract("<article><p>" + "one <b>two</b> three <p>" * 20_000) == " ".join(["one two three"] * 20_000)
    assert html_text.extract("<article>" + "a<b " * 20_000).startswith("a<b a<b")
    assert html_text.extract("<article><p>x</p><!-- open <b") == "x"
    assert html_text.extract("<font>" * 5000 + "<article>" + "<p>a</p>" * 5000) == " ".join("a" * 5000)


def test_other_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, file string")
    assert html_text.extracted(pages).count() == 0
    assert warc.read(warc.rewrite(warc.resolve(warc.write(pages)))).count() == 0
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string, seq string")
    assert chat.render(chat.reconstruct(chat.events_of_rows(rows))).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    model = quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.select(quality.scored(model)).count() == 0


def test_rows_of_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, None, "a", "b"), (None, None, "a", "b"), (1, "x " * 200_000, "a", "b")], "doc_id long, text string, id string, key string")
    assert [r.n_tokens for r in bpe.encode(docs, VOCABULARY).orderBy("n_tokens").collect()] == [0, 0, 200_000]
    assert token_files.read(token_files.write(docs, VOCABULARY, 2)).count() == 3
    assert sorted(r.group_size for r in exact_dedup.dedup(docs).collect()) == [1, 2, 2]
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(docs).collect()) == ["1", "None", "None"]
    assert line_dedup.dedup_lines(docs).columns[:4] == ["doc_id", "text", "id", "key"] and line_dedup.dedup_lines(docs).count() == 3
    assert decontam.decontaminate(docs, spark.createDataFrame([(None, None, 1)], "item_id long, text string, key int")).count() == 3
    pages = spark.createDataFrame([(None, None, None, "f"), (None, None, "<article>text", "f")], "page_id long, url string, html string, file string")
    assert sorted(r.text for r in html_text.extracted(pages).collect()) == ["", "text"]
    assert warc.read(warc.rewrite(warc.resolve(warc.write(pages)))).count() == 2
    turns = spark.createDataFrame([(None, None, None, None, "s"), (1, None, "assistant", "x<y", "s")], "conv_id long, turn long, role string, text string, seq string")
    assert chat.render(chat.reconstruct(chat.events_of_rows(turns))).count() == 2
