"""Plans of joins whose sides are far larger than the tables they are made of."""

import numpy as np

from netloom.llm import bpe, mil_classifier, simhash, suffix_dedup
from netloom.llm.queries import word_bpe
from netloom.storage import materialize


def test_keys_of_fingerprints_are_not_gathered_by_the_driver(spark):
    """Each fingerprint has 7 and some 180 keys; the planner sees the small table of fingerprints alone."""
    rng = np.random.default_rng(5)
    some = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 200)]
    table = materialize(spark.createDataFrame([(x,) for x in [*some, *[x ^ 5 for x in some]]], "fp long"), "distinct")
    found = simhash.links(table)
    assert {frozenset(r) for r in found.collect()} == {frozenset((x, x ^ 5)) for x in some}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_go_to_the_workers_once(spark, monkeypatch):
    """Whole texts are most of what an executor holds while workers read them."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    calls = {bpe: lambda: bpe.digest_texts(docs, word_bpe()), mil_classifier: lambda: mil_classifier.classify(docs, None, keep=True)}
    for module, call in calls.items():
        seen, real = [], module.map_arrow
        monkeypatch.setattr(module, "map_arrow", lambda df, f, schema, seen=seen, real=real: (seen.append((len(df.columns), schema)), real(df, f, schema))[1])
        assert call().count() == 2
        assert seen[-1][0] == 2
        assert module is mil_classifier or "c1" not in seen[-1][1]


def test_long_strings_move_in_small_batches(spark, monkeypatch):
    """Batches of 10,000 texts are tens of MB, which an executor and its worker hold several times; no text goes to a worker when the result is read."""
    rng, name, written, real = np.random.default_rng(9), "spark.sql.execution.arrow.maxBytesPerBatch", [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, label: (written.append((label, spark.conf.get(name, None))), real(df, label))[1])
    some = "".join(chr(x) for x in rng.integers(0x400, 0x2000, 150))  # two and three bytes each, cut within
    rows = [(1, "a" + some + "b"), (2, "\u00e9" + some[:80] + "\u4e00" + some[80:]), (3, "c" + some[1:] + "d"), (4, None), (None, "short")]
    before = spark.conf.get(name, None)
    found = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), window=50)
    assert {x for _, x in written} == {str(2 << 20)} and spark.conf.get(name, None) == before
    assert sum(label == "columns" for label, _ in written) == suffix_dedup.STAGES - 1
    cut = found._jdf.queryExecution().analyzed().toString()
    assert not [x for x in cut.split("\n") if "MapInArrow" in x and "text" in x]
    raws = [(t or "").encode() for _, t in rows]
    for r, raw in zip(sorted(found.collect(), key=lambda r: r.doc_id or 9), raws):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if sum(x[k : k + 50] == raw[i : i + 50] for x in raws for k in range(len(x) - 49)) > 1:
                gone[i : i + 50] = True
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), rest)
