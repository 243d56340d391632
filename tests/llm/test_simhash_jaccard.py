"""The anchor points of the near-dedup stage: they alone find the candidates, and miss none that brute force links."""

import numpy as np
import pyarrow as pa
import pytest
from test_minhash import planted, smallest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from latticeql.llm import minhash, simhash, simhash_jaccard  # noqa: E402


def test_the_stage_needs_no_minhash(spark, monkeypatch):
    def gone(*args, **kwargs):
        raise AssertionError("near-dedup is by SimHash")

    monkeypatch.setattr(minhash, "near_duplicates", gone)
    texts = planted(3)
    wanted = smallest(texts)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i in texts if wanted[i] == i)


def test_groups_of_anchors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_jaccard, "BLOCK", 2)
    texts = planted()
    wanted = smallest(texts)
    out = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), verified=True).collect()
    least = {}
    for r in out:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.component] for r in out} == wanted and len(out) == len(texts)


@pytest.mark.parametrize("few", [1, simhash_jaccard.FEW])
def test_pairs_at_the_threshold_share_anchors_and_are_near(monkeypatch, few):
    monkeypatch.setattr(simhash_jaccard, "FEW", few)
    rng = np.random.default_rng(5)
    sets = []
    for n in (8, 80, 800):
        for _ in range(100):
            # 0.8 of the union is in both: once as a part, once with as much of its own on either side.
            h, g = rng.integers(0, 1 << 64, (2, n + n // 4), np.uint64)
            sets += [(h[:n], h), (g[: n + n // 8], np.concatenate((g[:n], g[n + n // 8 :])))]
    monkeypatch.setattr(simhash_jaccard, "distinct", lambda x: x)
    flat = [x for pair in sets for x in pair]
    anchors, levels = simhash_jaccard.sketches(np.array([simhash_jaccard.counts(x) for x in flat]))
    rows = sorted((int(a), i) for i, mine in enumerate(anchors) for a in mine)
    batch = pa.RecordBatch.from_pydict({"anchor": pa.array([a for a, _ in rows], pa.int32()), "h": [i for _, i in rows], "component": [i for _, i in rows], "levels": pa.array([bytes(levels[i]) for _, i in rows], pa.binary())})
    found = {pair for b in simhash_jaccard._small(simhash_jaccard.LIMIT, False)(iter([batch])) for pair in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)}
    assert found == {(2 * k, 2 * k + 1) for k in range(len(sets))}
