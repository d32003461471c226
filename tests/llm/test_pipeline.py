"""The stages of the corpus pipeline, each on what its predecessor kept, against brute force."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import mil_classifier, simhash
from netloom.llm.queries import table

from .test_ops import ODD, SCHEMA, brute_contamination, brute_fingerprint, brute_lines, encoded, library, low, words  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(kept):
    for df in kept[:-1]:
        assert df.columns == kept[0].columns


def test_quality_keeps_what_the_classifier_passes(spark, kept):
    model = mil_classifier.fit(kept[0], table(spark, SF, "labels"))
    good = {r.doc_id for r in mil_classifier.classify(kept[0], model).collect() if r.predicted}
    assert {i for i, _ in rows(kept[1])} == good and len(good) > 700
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    wrong = [i for i, q in labels.items() if (i in good) != (q == 1)]
    assert len(wrong) <= 0.02 * len(labels)


def test_lines(kept):
    want = []
    for x in brute_lines(rows(kept[1]), 50):
        i, n_lines, n_removed, _, text = eval(x)  # the reprs of test_ops
        if n_removed == 0 or n_removed < n_lines:
            want.append((i, text))
    got = kept[2].select("doc_id", "text", "n_chars").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)


def grams(text, k=5):
    w = words(low(text))
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)}


def test_near_copies(kept):
    before, after = rows(kept[2]), {i for i, _ in rows(kept[3])}
    sets, prints = {i: grams(t) for i, t in before}, {i: brute_fingerprint(t, 5) for i, t in before}
    like = {i: set() for i, _ in before}
    for a, b in itertools.combinations(sorted(sets), 2):
        near = (prints[a] ^ prints[b]).bit_count() <= 3
        if near or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            like[a].add(b)
            like[b].add(a)
    assert all(not (a in after and b in after) for a in like for b in like[a])
    gone = set(sets) - after
    assert gone and all(like[i] for i in gone)
    assert {i for i in like if not like[i]} <= after


def test_leaks_and_encoding(spark, kept, library):  # noqa: F811
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {eval(x)[0] for x in brute_contamination(rows(kept[3]), items) if not eval(x)[-1]}
    assert {i for i, _ in rows(kept[4])} == clean and len(clean) < kept[3].count()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in kept[5].collect()}
    for i, t in rows(kept[4]):
        ids = encoded(library, t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_a_leak_without_an_id_takes_no_other_along(spark, kept):
    item = table(spark, SF, "benchmark").first().text
    docs = spark.createDataFrame([(None, item, "en", "a", 1), (None, "nothing of the kind", "en", "a", 1), (5, "a " + item, None, None, None), (5, "clean", None, None, None)], kept[0].schema)
    assert sorted(r.text for r in corpus_pipeline.leaks(spark, docs, SF).collect()) == ["clean", "nothing of the kind"]


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_similar_groups_on_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    got = simhash.similar_groups(odd).collect()
    assert len(got) == len(ODD)
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == 4 and of[7] == 7
    assert sorted((r.doc_id for r in simhash.keep_one(odd).collect()), key=str) == [1, 4, 6, 7, 8, 9, None]  # the empty text without an id is a copy of 1
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(odd.limit(0)).count() == 0


def test_ids_of_several_texts_and_of_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a, {"k": 1}), (1, b, {"k": 2}), (2, a + " more", {"k": 3}), (None, b + " more", {"k": 4}), (None, c, {"k": 5}), (None, c + " more", None), (1, a, {"k": 6})]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, h map<string,int>"))
    kept = sorted((r.doc_id is None, r.text[0], r.h["k"] if r.h else None) for r in got.collect())
    assert got.columns == ["doc_id", "text", "h"] and [x[:2] for x in kept] == [(False, "a"), (False, "b"), (True, "c")] and kept[0][2] == 1


def test_stages_keep_other_columns_of_any_name(spark, kept):
    extra = ["score", "n_removed", "n_lines", "h", "of", "ids", "id", "text_hash", "tags"]
    docs = kept[0].drop("n_chars").limit(60)
    for i, x in enumerate(extra[:-1]):
        docs = docs.withColumn(x, F.col("doc_id") * 10 + i)
    docs = docs.withColumn("tags", F.create_map(F.lit("id"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all([r[x] for x in extra[:-1]] == [r.doc_id * 10 + i for i in range(len(extra) - 1)] and r.tags == {"id": r.doc_id} for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_take_empty_tables(spark, kept):
    for (_, stage), df in zip(corpus_pipeline.STAGES, kept):
        assert stage(spark, df.limit(0), SF).count() == 0


def test_a_large_group_of_near_copies_keeps_one(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = [" ".join(base)] * 30
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(150)] = f"new{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(50)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, *range(1000, 1050)]


def test_similar_texts_far_apart_by_fingerprint_are_linked(spark):
    import random

    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    line = " and so the same line again goes on"
    a, b = base, base + line * 100
    assert simhash.jaccard(a, b, 5) >= 0.8 and (brute_fingerprint(a, 5) ^ brute_fingerprint(b, 5)).bit_count() > 18
    docs = spark.createDataFrame([(1, a), (2, b), (3, line)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


@pytest.mark.parametrize("common_texts", [2, 10**6])
def test_similar_groups_are_the_components_of_all_pairs(spark, monkeypatch, common_texts):
    import random

    monkeypatch.setattr(simhash, "COMMON_SAMPLE", 1)
    monkeypatch.setattr(simhash, "COMMON_TEXTS", common_texts)
    rng, texts = random.Random(9), []
    shared = [f"s{rng.randrange(10**6)}" for _ in range(30)]  # a passage in most texts
    for _ in range(6):
        base = shared + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((20, 60, 150)))]
        for _ in range(20):  # a walk: neighbours are about as similar as the bound, its ends are not
            base = list(base)
            for _ in range(rng.randrange(1, 3)):
                base[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [grams(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {i: find(i) for i in range(len(texts))}
    order = rng.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == want and 6 < len(set(want.values())) < len(texts)


def test_texts_near_by_fingerprint_alone_are_not_linked(spark):
    import random

    rng = random.Random(6)
    a, b = (" and so the same line again goes" * 400 + "".join(f" u{rng.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    assert simhash.jaccard(a, b, 5) < 0.1 and (brute_fingerprint(a, 5) ^ brute_fingerprint(b, 5)).bit_count() <= 3
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2]


def test_the_driver_finds_everything():
    import __spark_entry__ as driver

    names = driver.queries()
    assert "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11))
    assert set(driver.oracle_sql()) <= set(names)
