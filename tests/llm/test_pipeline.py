"""The pipeline's stages on rows with nulls, repeated rows and clashing names, and the whole of it against brute force."""

import hashlib
import re
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from latticeql.llm import quality, simhash  # noqa: E402
from latticeql.llm.common import table  # noqa: E402
from latticeql.llm.registry import VOCABULARY, remainder  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, row_hash long, kept_id string, own int"
LONG = " ".join(f"w{i} word" for i in range(300))


def rows(*pairs):
    return [(i, t, "en", None, None, "mine", 1, "x", 5) for i, t in pairs]


def stage(name, spark, data):
    docs = spark.createDataFrame(data, SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
    assert name == "encode" or out.columns == docs.columns
    return out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_survive_nulls_and_empty_tables(spark, name):
    assert stage(name, spark, []).count() == 0
    data = [*rows((1, None), (1, None), (None, None), (None, ""), (2, LONG)), (None,) * 9]
    assert all(r.n_lines in ("mine", None) and r.own in (5, None) for r in stage(name, spark, data).collect() if name != "encode")


def test_one_row_of_each_group_stays(spark):
    near = LONG.replace("w7 ", "other ")
    data = rows((5, LONG), (5, LONG), (4, near), (4, near), (4, near + "!"), (None, LONG), (9, "something else that is far from the rest of it"), (5, "and one more of a kind that nobody has seen"))
    data += rows((None, "a text without an id and quite its own words"), (None, "a text without an id and quite its own words"))
    out = stage("near_dedup", spark, data).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out)
    assert ids == [(False, 4), (False, 5), (False, 9), (True, 0)]
    assert next(r for r in out if r.doc_id == 5).text.startswith("and one more")


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontaminate"])
def test_stages_pass_maps_structs_and_very_long_texts(spark, name):
    text = "".join(f"word{i % 7919} and{i % 13}\n" for i in range(60_000))
    data = [(1, LONG, 5, {"a": 1}, ([1],)), (1, LONG, 5, {"a": 1}, ([1],)), (1, LONG, 5, None, None), (2, text, 5, {"b": 2}, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long, meta map<string,int>, more struct<x:array<int>>")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
    assert out.columns == docs.columns
    rows = sorted((r.doc_id, str(r.meta)) for r in out.collect())
    assert name != "near_dedup" or (len(rows) == 2 and rows[1] == (2, "{'b': 2}"))
    assert name not in ("line_dedup", "decontaminate") or len(rows) == 4


def test_long_lists_of_contaminated_rows_are_joined(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    test_clean_rows_stay_beside_contaminated_ones_of_the_same_id(spark)


def test_clean_rows_stay_beside_contaminated_ones_of_the_same_id(spark):
    item = next(r.text for r in table(spark, SMALL, "benchmark").collect() if len((r.text or "").split()) > 13)
    data = rows((1, item), (1, "clean"), (None, "clean too"), (None, "see: " + item), (3, None))
    assert sorted(str(r.text) for r in stage("decontaminate", spark, data).collect()) == ["None", "clean", "clean too"]


def templates(line):
    """The templates of a line as values: words, with one field a wildcard."""
    split = lambda x: [w for w in re.split(r"\s+", x, flags=re.A) if w]
    words = split(re.sub(r"\S*[0-9]\S*", "<*>", line, flags=re.A))
    rigid = re.search("[0-9]", line) and sum(w != "<*>" for w in words) < 3
    words = split(line) if rigid else words
    if len(words) < 3:
        return
    yield (len(words), None, tuple(words))
    lead, rest = words[:3], words[3:]
    for k in range(5 if len(words) >= 8 and not rigid else 0):
        a, z = len(rest) * k // 5, len(rest) * (k + 1) // 5
        yield (len(words), k, tuple(lead + rest[:a]), tuple(rest[z:]))


def test_whole_pipeline_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = quality.fit(docs, table(spark, SMALL, "labels").filter(remainder("doc_id") != 0))
    data = sorted((r.doc_id, r.text or "") for r in docs.collect())
    scores = model.score(np.array([quality.features(t.encode()) for _, t in data]))
    data = [d for d, s in zip(data, scores, strict=True) if s >= quality.CUT]
    holders = {}
    for i, t in data:
        for line in t.split("\n"):
            for key in templates(line):
                holders.setdefault(key, set()).add(i)
    gone = lambda i, line: any(len(holders[k]) > 1 and min(holders[k]) != i for k in templates(line))
    data = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in data]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in data}
    class_ = {i: i for i in prints}
    while True:
        new = {i: min(class_[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == class_:
            break
        class_ = new
    data = [(i, t) for i, t in data if class_[i] == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 13]) for r in table(spark, SMALL, "benchmark").collect() for w in [words(r.text)] if w for k in range(max(1, len(w) - 12))}
    sizes, left = {len(w) for w in windows}, []
    for i, t in data:
        w = words(t)
        hit = {q for n in sizes for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for q in range(p, p + n)}
        if not hit or 20 * len(hit) < len(w):
            left.append((i, t))
    tokenizer, wanted = Tokenizer.from_file(VOCABULARY), []
    for i, t in left:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        packed, text = array("I", ids).tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == wanted
