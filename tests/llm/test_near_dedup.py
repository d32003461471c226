"""Pairs of the near-dedup stage that meet but can't be similar: their texts don't move."""

import numpy as np

from netloom.llm import simhash


def test_sketches_rule_out_no_similar_sets():
    rng = np.random.default_rng(11)
    for n in (1, 2, 9, 60, 130, 255, 256, 1_100, 40_000):
        whole = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * 2 + 1)
        for part in (1.0, 0.9, 0.8):
            x, y = whole[:n], whole[n - int(n * part) : 2 * n - int(n * part)]
            shared = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            assert simhash.may_share(simhash.sketch(x), simhash.sketch(y), shared)
            assert simhash.may_share(simhash.sketch(x), simhash.sketch(x[: max(1, int(n * part))]), max(1, int(n * part)) / n)
        if n > 100:
            assert not simhash.may_share(simhash.sketch(whole[:n]), simhash.sketch(whole[n : 2 * n]), 0.8)
    crowded = np.arange(1_000, dtype=np.uint64)  # counts beyond a byte rule out nothing
    assert simhash.may_share(simhash.sketch(crowded), simhash.sketch(crowded + np.uint64(5_000)), 0.8)


def test_texts_that_share_a_shingle_alone_stay_where_they_are(spark, monkeypatch):
    """Twenty texts with one sentence in common, and a pair of near copies: the texts of the pair alone are read for comparison."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    texts = [f"{words(60)} one sentence that all of them have {words(60)}" for _ in range(20)]
    near = words(120)
    found, real = [], simhash._texts_of
    monkeypatch.setattr(simhash, "_texts_of", lambda pairs, *a: (found.append(pairs.count()), real(pairs, *a))[1])
    docs = spark.createDataFrame(list(enumerate([*texts, near, f"{near} end"])), "doc_id long, text string")
    monkeypatch.setattr(simhash, "_may", lambda *a: simhash.F.lit(True))  # even if places and sizes allowed all pairs
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(21))
    assert sum(found) == 1
