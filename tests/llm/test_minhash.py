"""The groups of the pipeline's near-dedup stage against brute-force Jaccard over five-word shingles."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from latticeql.llm import minhash, simhash  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def smallest(texts):
    """For each id the smallest one that links of Jaccard >= 0.8 lead to."""
    sets = {i: shingles(t) for i, t in texts.items()}
    linked = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    near = {i: [j for j in sets if linked(sets[i], sets[j])] for i in sets}
    out = {i: i for i in sets}
    while (new := {i: min(out[j] for j in near[i]) for i in sets}) != out:
        out = new
    return out


def planted(seed=6):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(10**6)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", *(" ".join(word() for _ in range(60)) for _ in range(40))]
    for n in (40, 200, 2000):
        for share in (0.001, 0.01, 0.02, 0.022, 0.025, 0.04, 0.08):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            texts += [" ".join(word() if rng.random() < share else w for w in base) for _ in range(3)]
    chain = [word() for _ in range(300)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain[25 * k] = chain[25 * k + 8] = chain[25 * k + 16] = word()
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [2, minhash.ROWS_A_BLOCK])
def test_groups_are_those_of_brute_force_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "ROWS_A_BLOCK", block)
    texts = planted()
    wanted = smallest(texts)
    out = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    least = {}
    for r in out:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.component] for r in out} == wanted and len(out) == len(texts)


def test_the_stage_drops_what_four_bits_miss(spark):
    texts = planted()
    wanted = smallest(texts)
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    assert any(wanted[i] != i and all((prints[i] ^ prints[j]).bit_count() > 4 for j in texts if j != i) for i in texts)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i in texts if wanted[i] == i)
