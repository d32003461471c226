"""The ten operators against brute force, on the driver's small tables and on odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from netloom.llm import bpe, decontaminate, golay, html_density, interpolated_lm, line_dedup, mil_classifier, quality_rules, simhash, suffix_dedup, token_counts
from netloom.llm.queries import word_bpe

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, words string"

#: Nulls in any column, empty and white texts, ties, repeated rows, clashing names of columns, odd characters, a long text.
ODD = [
    (1, None, None, None, None, "x", 1, "w"), (2, "", "en", "a", 0, None, None, None), (3, " \n\t ", "en", None, 3, "x", 1, "w"), (None, "a text without an id, which is not much", None, "a", 1, "x", 1, "w"), (None, None, None, None, None, None, None, None),
    (4, "The same words again. " * 40, "en", "a", 1, "x", 1, "w"), (4, "The same words again. " * 40, "en", "a", 1, "x", 1, "w"), (5, "the SAME words again. " * 40, "de", "a", 1, "x", 1, "w"), (6, "İstanbul ΣΑΣ <|endoftext|> a\x1cb é \x00 日本語 🙂", "en", "b", 1, "x", 1, "w"),
    (7, "\n".join(f"Line {i % 7} of a longer text with some words in it, over and over." for i in range(300)), "en", "b", 1, "x", 1, "w"), (8, "x" * 5000, "en", "b", 1, "x", 1, "w"), (9, "ab " * 9000, "en", "b", 1, "x", 1, "w"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def words(text):
    return SPACE.findall(text or "")


def low(text):
    return (text or "").translate(LOW)


# ---- op1 ----


def brute_fingerprint(text, k):
    import xxhash

    w = words(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_golay_tables():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 1 << 23, 3000)
    flip = np.where(rng.random(3000) < 0.9, 1 << rng.integers(0, 23, 3000), 0)
    near = golay.nearest(u)
    around = golay.around(u ^ flip)
    assert (around == near[:, None]).any(axis=1).all()
    assert {int((x >= 0).sum()) for x in around} <= {1, 6}


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                y ^= 1 << b
            prints.add(y)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3} and got


def test_simhash_matches_brute_force(spark, docs, odd, texts):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [(r[0], r[1]) for r in ODD])):
        prints = [brute_fingerprint(t, 3) for _, t in rows]
        want = sorted(map(repr, zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints))))
        assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# ---- op2 ----


def base(text):
    w, found, covered = words(text), collections.Counter(), set()
    grams = list(zip(w, w[1:], w[2:]))
    found.update(grams)
    for i, g in enumerate(grams):
        if found[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def brute_kept(rows, min_docs):
    """Fences from whole lists of bucketed measures."""

    def bucket(v):
        spare = max(0, v.bit_length() - 7) if v else 0
        return v >> spare << spare

    def measures(text):
        n, chars, symbols, dups, repeats = base(text)
        lines = len([x for x in (text or "").split("\n") if words(x)])
        caps = sum("A" <= c <= "Z" for c in text or "")
        part = lambda a, b: 1000 * a // b if b else 0
        return {"symbols": part(symbols, n), "dup_lines": part(dups, lines), "repeats": part(repeats, n), "word_length": part(chars, n), "capitals": part(caps, chars)}

    passed = [(lang, source, measures(t)) for _, t, lang, source in rows if base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0]]
    out = {}
    for i, (_, t, lang, source) in enumerate(rows):
        n, *_, repeats = base(t)
        failed = n < 50 or 100 * repeats > 50 * n
        own = [m for x, y, m in passed if (x, y) == (lang, source)]
        if len(own) < min_docs:
            own = [m for x, y, m in passed if x == lang]
        if len(own) < min_docs:
            own = [m for _, _, m in passed]
        ok = not failed
        for name, (_, _, least, both) in quality_rules.MEASURES.items():
            if failed:
                break
            values = sorted(bucket(m[name]) for m in own)
            q1, q3 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            reach = 3 * max(q3 - q1, least)
            mine = measures(t)[name]
            ok &= mine <= q3 + reach and (not both or mine >= q1 - reach)
        out[i] = (failed, ok)
    return out


@pytest.mark.parametrize("min_docs", [3, 20])
def test_quality_rules_match_brute_force(spark, docs, odd, texts, min_docs):
    for df, rows in ((docs, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in texts]), (odd, [r[:4] for r in ODD])):
        kept = brute_kept(rows, min_docs)
        want = sorted(repr((i, *base(t), *kept[k])) for k, (i, t, _, _) in enumerate(rows))
        got = quality_rules.adaptive_rules(df, min_docs=min_docs).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in got) == want
    assert quality_rules.adaptive_rules(odd.limit(0)).count() == 0


# ---- op3, op8 ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(word_bpe())


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts_match_the_library(docs, odd, texts, library):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [r[:2] for r in ODD])):
        want = sorted(repr((i, len((t or "").encode()), n := len(encoded(library, t)), n > 2048)) for i, t in rows)
        for chunk, overlap in ((16_384, 256), (600, 32)):
            got = token_counts.count_tokens(df, word_bpe(), chunk_chars=chunk, overlap=overlap).collect()
            assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got) == want
    assert token_counts.count_tokens(odd.limit(0), word_bpe()).count() == 0


def test_definitions_whose_tokens_cross_white_space(docs, odd, texts):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    spec = json.loads(definition)
    assert [token_counts.way_of(x) for x in (json.loads(word_bpe()), spec, spec | {"normalizer": {"type": "NFKC"}}, spec | {"pre_tokenizer": None})] == ["words", "spaced", "whole", "whole"]
    other = Tokenizer.from_str(definition)
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [r[:2] for r in ODD])):
        got = token_counts.count_tokens(df, definition, chunk_chars=600, overlap=32).collect()
        assert sorted(repr((r.doc_id, r.n_tokens)) for r in got) == sorted(repr((i, len(encoded(other, t)))) for i, t in rows)
    whole = json.dumps(spec | {"normalizer": {"type": "NFKC"}})
    other = Tokenizer.from_str(whole)
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in token_counts.count_tokens(odd, whole, chunk_chars=600, overlap=32).collect()) == sorted(repr((i, len(encoded(other, t)))) for i, t, *_ in ODD)


def test_added_tokens_of_other_beginnings(library):
    import json

    spec = json.loads(word_bpe())
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49_408, "content": "[MASK]"})
    from tokenizers import Tokenizer

    other, coder = Tokenizer.from_str(json.dumps(spec)), bpe.WordBPE(json.dumps(spec))
    for text in ("a [MASK] b", "[mask] <|endoftext|>[MASK]", "[ MASK ]"):
        assert coder.encode(text) == encoded(other, text)


def test_capitals_make_no_added_token(library):
    texts = ["A <|ENDOFTEXT|> B", "A <|endoftext|> B", "THE The the", "É È the THE"]
    assert token_counts.word_counts(library, texts, {}, ["<|startoftext|>", "<|endoftext|>"]) == [len(encoded(library, x)) for x in texts]


@pytest.mark.parametrize("text", ["word " * 900, "x" * 3000, "a b" + "y" * 1500 + " c d e f" * 200, "é" * 700 + "\n" + "ß ä" * 400, "'s 't " * 500])
def test_splicing_widens_until_it_fits(library, text):
    assert token_counts.spliced_ids(lambda x: library.encode(x, add_special_tokens=False), text, 200, 16) == encoded(library, text)


def test_bpe_round_trip_matches_the_library(docs, odd, texts, library):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [r[:2] for r in ODD])):
        want = []
        for i, t in rows:
            ids = encoded(library, t)
            want.append(repr((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
        got = bpe.digest_texts(df, word_bpe()).collect()
        assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(want)
    whole = bpe.encode_texts(odd, word_bpe()).where("doc_id = 6").first()
    assert whole["ids"] == encoded(library, ODD[8][1]) and whole["words"] == "w" and bpe.encode_texts(odd.limit(0), word_bpe()).count() == 0


def test_long_words_merge_as_short_ones(library, monkeypatch):
    coder = bpe.WordBPE(word_bpe())
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(150, 400)))
        assert coder.encode(text) == encoded(library, text)


# ---- op4 ----


def test_classifier_on_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in mil_classifier.classify(docs, mil_classifier.fit(docs, labels)).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    seen = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(seen) > 50 and sum(a == b for a, b in seen) / len(seen) >= 0.95


def test_attention_by_hand():
    """Scores of bags of passages, one number at a time."""
    rng = np.random.default_rng(3)
    model = mil_classifier.Model.fresh(4, 3, 2)
    model.weights = {k: rng.standard_normal(v.shape) for k, v in model.weights.items()}
    p = model.weights
    bags = [rng.standard_normal((n, mil_classifier.WIDTH)) / 5 for n in (1, 4, 2)]
    want = []
    for bag in bags:
        hidden, energy = [], []
        for x in bag:
            h = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(4)]
            gate = lambda m, k: sum(h[j] * p[m][j, k] for j in range(4))  # noqa: E731, B023
            energy.append(sum(math.tanh(gate("V", k)) / (1 + math.exp(-gate("U", k))) * p["w"][k] for k in range(3)))
            hidden.append(h)
        share = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        logit = sum(a * h[j] * p["c"][j] for a, h in zip(share, hidden) for j in range(4)) + p["c0"][0]
        want.append(1 / (1 + math.exp(-logit)))
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    assert model.score(np.concatenate(bags), starts) == pytest.approx(want)


def test_attention_finds_the_passage_that_counts():
    """Bags of noise with one telling passage: learnt weights rest on it, and equal ones score worse."""
    rng = np.random.default_rng(4)
    bags, labels, told = [], [], []
    for i in range(600):
        bag = rng.standard_normal((12, mil_classifier.WIDTH)).astype(np.float32) * 0.3
        at = rng.integers(12)
        bag[at, 0], bag[at, 1] = 3.0, 3.0 if i % 2 else -3.0
        bags.append(bag)
        labels.append(i % 2)
        told.append(at)
    model = mil_classifier.train(bags[:400], np.array(labels[:400]))
    starts = np.arange(0, 200 * 12, 12)
    x = np.concatenate(bags[400:])
    accuracy = lambda m: np.mean((m.score(x, starts) >= 0.5) == np.array(labels[400:]))
    _, (_, _, _, a, _, _) = model.forward(x, starts)
    assert accuracy(model) > 0.97 and np.mean(a.reshape(-1, 12).argmax(axis=1) == told[400:]) > 0.5  # by chance a twelfth
    even = mil_classifier.Model(model.weights | {"w": np.zeros_like(model.weights["w"])})
    assert accuracy(even) < accuracy(model)


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    model = mil_classifier.Model.fresh(5, 3, 1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, starts, y, weight = rng.standard_normal((7, mil_classifier.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z, _ = model.forward(x, starts)
        return float((np.logaddexp(0, z) - y * z) @ weight / weight.sum())

    for name, g in model.gradients(x, starts, y, weight).items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        held = model.weights[name][at]
        model.weights[name][at] = held + 1e-5
        up = loss()
        model.weights[name][at] = held - 1e-5
        down = loss()
        model.weights[name][at] = held
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_classifier_on_odd_rows(spark, odd):
    none = spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in mil_classifier.classify(odd, mil_classifier.fit(odd, none)).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(4, 1, 0)], "doc_id long, quality int, toxic int")
    model = mil_classifier.fit(odd, some)
    assert mil_classifier.classify(odd, model).count() == len(ODD) and mil_classifier.classify(odd.limit(0), model).count() == 0
    assert mil_classifier.classify(odd, model, keep=True).columns == [*odd.columns, "score"]


def test_classifier_learns_from_all_passages(spark, monkeypatch):
    texts = {i: " ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate([9_000, 50, 7_050, 120, 6_500, 6_401, 300, 8_000])}
    seen = []
    monkeypatch.setattr(mil_classifier, "train", lambda bags, y: seen.extend(bags))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    mil_classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int"), held_out=-1)
    want = [mil_classifier.encode_passages(x).astype(np.float16) for x in texts.values()]
    assert sorted(x.tobytes() for x in seen) == sorted(x.tobytes() for x in want)


# ---- op5 ----


def test_language_model_counts(docs, odd, texts):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [r[:2] for r in ODD])):
        tokens = [[*words(low(t)), "\n"] for _, t in rows]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
        c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
        total, distinct = sum(c.values()), len(c)
        want = sorted((repr((i, h, len(t), sum(c[w] > 0 for w in t), total)), sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)) for (i, _), h, t in zip(rows, held, tokens))
        got = interpolated_lm.score_texts(df).collect()
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
        mine = sorted((repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)), r.base_score) for r in got)
        assert [x[0] for x in mine] == [x[0] for x in want] and [x[1] for x in mine] == pytest.approx([x[1] for x in want])
    assert interpolated_lm.score_texts(odd.limit(0)).count() == 0


def test_language_model_beats_single_words_on_held_out_texts(docs):
    got = [r for r in interpolated_lm.score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_interpolated_probabilities(spark):
    """With two training texts, every factor by hand."""
    rows = [(i, t) for i, t in ((1, "a b a b c"), (3, "a b"), (14, "a c d"))]
    assert [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows].count(True) <= 1
    got = {r.doc_id: r for r in interpolated_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [[*t.split(), "\n"] for i, t in rows if not got[i].held_out]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["\n", *t], t))
    n, v, r = sum(c.values()), len(c), interpolated_lm.RATIOS
    cells = collections.Counter()
    step = lambda x: int(np.clip(round(math.log(x) * 4) + 33, 1, r - 1)) if x > 0 else 0
    for t in train:
        for a, b in zip(["\n", *t], t):
            before = c[a] - 1
            cells[(int(interpolated_lm.bucket(np.array([before]))[0]) * r + step((pairs[a, b] - 1) / before * (v + 1) if before else 0)) * r + step((c[b] - 1) / (n - 1) * (v + 1))] += 1
    weights = interpolated_lm.learn_weights(np.array(sorted(cells)), np.array([cells[k] for k in sorted(cells)], float))
    for i, t in rows:
        score = 0.0
        for a, b in zip(["\n", *t.split()], [*t.split(), "\n"]):
            w = weights[int(interpolated_lm.bucket(np.array([c[a]]))[0])]
            score += math.log10(w[0] / (v + 1) + w[1] * c[b] / n + (w[2] * pairs[a, b] / c[a] if c[a] else 0))
        assert got[i].score == pytest.approx(score)


def test_shards_and_blocks_of_any_size_agree(docs, monkeypatch):
    want = sorted((r.doc_id, round(r.base_score, 6), round(r.score, 6)) for r in interpolated_lm.score_texts(docs).collect())
    monkeypatch.setattr(interpolated_lm, "SHARD_ENTRIES", 3_000)
    monkeypatch.setattr(interpolated_lm, "BLOCK_TOKENS", 1_500)
    for fan in (512, 4):
        monkeypatch.setattr(interpolated_lm, "FAN", fan)
        assert sorted((r.doc_id, round(r.base_score, 6), round(r.score, 6)) for r in interpolated_lm.score_texts(docs).collect()) == want


def test_rows_of_the_levels_follow_the_input(docs, monkeypatch):
    assert [interpolated_lm.levels(*x) for x in ((1, 1), (288, 72), (512, 3), (513, 129), (600_000, 150_000))] == [(1, 1, 1), (1, 288, 72), (1, 512, 3), (2, 23, 12), (3, 85, 54)]
    monkeypatch.setattr(interpolated_lm, "BLOCK_TOKENS", 1_500)
    monkeypatch.setattr(interpolated_lm, "FAN", 4)
    sent = []
    for part in (docs.where("doc_id % 4 = 0"), docs):
        table = interpolated_lm.materialize(interpolated_lm.blocks(part, "doc_id", "text", 7, 2), "blocks")
        n_blocks = table.count()
        count, groups, ranges = interpolated_lm.levels(n_blocks, n_blocks // 2 + 1)
        found = interpolated_lm.totals(interpolated_lm._block_nodes(table), count, groups, ranges)
        sent.append((n_blocks, found.where("node <> -1").count()))
        assert sent[-1][1] <= 2 * n_blocks * 4
    assert sent[1][0] > 2 * sent[0][0] > 8


def test_mixture_weights_match_brute_force():
    """Expectation-maximisation token by token, without arrays."""
    rng = np.random.default_rng(2)
    r = interpolated_lm.RATIOS
    cells = np.unique(rng.integers(0, 6, 200) * r * r + rng.integers(0, 60, 200) * r + rng.integers(1, 60, 200))
    counts = rng.integers(1, 50, len(cells)).astype(float)
    value = lambda c: math.exp((c - 33) / interpolated_lm.STEPS) if c else 0.0
    rows = [(int(c) // r**2, (1.0, value(int(c) % r), value(int(c) // r % r)), n) for c, n in zip(cells, counts)]

    def estimate(rows, a, rounds, prior):
        for _ in range(rounds):
            sums = list(prior)
            for _, p, n in rows:
                total = sum(x * y for x, y in zip(a, p))
                for i in range(3):
                    sums[i] += n * a[i] * p[i] / total
            a = [x / sum(sums) for x in sums]
        return a

    shared = estimate(rows, [0.1, 0.5, 0.4], 100, [0, 0, 0])
    got = interpolated_lm.learn_weights(cells, counts)
    for b in range(1, 6):
        want = estimate([x for x in rows if x[0] == b], shared, 100, [10 * x for x in shared])
        assert got[b] == pytest.approx(want, abs=2e-5)


# ---- op6 ----


GRAM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(docs, items, length=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = GRAM_WORD.findall(low(t))
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = GRAM_WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= {str(y) for y in x if y is not None}
        out.append(repr((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))))
    return sorted(out)


def test_contamination_matches_brute_force(spark, docs, odd, texts):
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    odd_items = [(1, "words again. The same"), (2, "The"), (2, None), (3, ""), (None, "a text without an id, which is not much"), (5, "ab ab ab ab ab ab ab ab ab ab ab ab"), (6, "Line 3 of a longer text with some words in it, over and over. Line 4 of")]
    for df, rows, items in ((docs, [(r["doc_id"], r["text"]) for r in texts], [(r["item_id"], r["text"]) for r in bench]), (odd, [r[:2] for r in ODD], odd_items)):
        frame = spark.createDataFrame(items, "item_id long, text string")
        for small in ("10m", "-1"):  # with tables that the planner broadcasts, and without
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
            got = decontaminate.contamination(df, frame).collect()
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert all(r.n_items == len(r["items"]) and r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in got)
            assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got) == brute_contamination(rows, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(odd, none).collect()} == {False}


# ---- op7 ----


def test_main_text_of_all_pages():
    import html

    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert html_density.main_text(r["html"]) == "\n".join(x for x in blocks if x)


LONG = "Words in this paragraph go on and on, so that it is long enough to be the article. " * 4
P = LONG.strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a&nbsp;b &lt;i&gt; &eacute;&#33;", "a b <i> é!"), ("<script>var a='<p>x</p>'</script><style>p{}</style>", ""),
        (f"<body><div class='menu'><a href=x>a</a></div><div id=content><h2>Title</h2><p>{LONG}<p>{LONG}<div class='comments'><p>{LONG}</div></div><div class=sidebar><p>{LONG}{LONG}</div>", f"Title\n{P}\n{P}"),
        (f"<div><header>Site</header><div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p><ul><li>one</li><li>two<li>three</ul></article><section class=comments><article><p>{LONG}</article></section>", f"{P}\none\ntwo\nthree"),
        (f"<nav>{LONG}</nav><form>{LONG}</form><footer>{LONG}</footer><main><p>{LONG}</main><aside>{LONG}</aside><!-- {LONG} -->", P),
        (f"<body class='single comments-open'><div id=page><div class='site-header'><h2>Site</h2></div><div class=post><h1>Title</h1><p class=byline>By A. Writer<p>{LONG}<ins class=adsbygoogle>{LONG}</ins><p>{LONG}</div><ol class=comment-list><li>{LONG}</ol><div class='widget-area'>{LONG}</div><form>{LONG}</form></div>", f"Title\nBy A. Writer\n{P}\n{P}"),
        ("<p>cut off by the end <a hre", "cut off by the end"), ("<p " + "a=1 " * 5000 + ">deep" + "<div>" * 3000 + "x", "deep\nx"),
    ],
)
def test_main_text(page, text):
    assert html_density.main_text(page) == text


@pytest.mark.parametrize("page", ['<a href="x ' * 90_000, "<div>" * 100_000 + "x", "<p><table><tr><td>" + "<span><div>" * 40_000, "<iframe>" * 50_000, "<" * 1_000_000, "<td>" * 50_000 + "</div>" * 50_000, '<div a="' * 50_000 + ">", "<b>" * 50_000 + "<p>" * 50_000])
def test_main_text_in_linear_time(page):
    import time

    took = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        html_density.main_text(part)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def brute_main_text(page: str) -> str:
    """The formula, its sums and the threshold by recursion over a well-formed page without marks (div, p, ul, li, b, a)."""
    import xml.etree.ElementTree as ET
    from math import e, log

    body = ET.fromstring(page)
    inline = ("a", "b")

    def figures(x, linked=False):
        """[characters, link characters, tags, link tags] inside x."""
        linked |= x.tag == "a"
        out = [len("".join((x.text or "").split())), 0, 0, 0]
        out[1] = linked * out[0]
        for y in x:
            tail = len("".join((y.tail or "").split()))
            out = [p + q for p, q in zip(out, figures(y, linked))]
            out = [out[0] + tail, out[1] + linked * tail, out[2] + 1, out[3] + (linked or y.tag == "a")]
        return out

    def own(x):
        """The same of the run of text of x: without its blocks."""
        bare = ET.Element(x.tag)
        bare.text = x.text

        def copy(source, target):
            for y in source:
                if y.tag in inline:
                    z = ET.SubElement(target, y.tag)
                    z.text, z.tail = y.text, y.tail
                    copy(y, z)
                elif y.tail:
                    ET.SubElement(target, "tail").text = y.tail

        copy(x, bare)
        got = figures(bare)
        tails = len(bare.findall(".//tail"))
        return [got[0], got[1], got[2] - tails, got[3] - len(bare.findall(".//a//tail"))]

    _, link_chars, _, _ = figures(body)
    share = link_chars / (figures(body)[0] or 1)

    def formula(c, lc, t, lt):
        if not c:
            return 0.0
        return c / (t or 1) * log(max(1.0, c / (lc or 1) * (t or 1) / (lt or 1))) / log(1 + log(c / (c - lc or 1) * lc + share * c + e))

    def blocks(x):
        return [z for y in x for z in ([y] if y.tag not in inline else blocks(y))]

    dense = {x: formula(*figures(x)) for x in body.iter() if x.tag not in inline}
    sums = {x: formula(*own(x)) + sum(dense[y] for y in reversed(blocks(x))) for x in dense}
    below = lambda x: [x, *(z for y in blocks(x) for z in below(y))]
    depth = {body: 0}
    for x in below(body):
        for y in blocks(x):
            depth[y] = depth[x] + 1
    parent = {y: x for x in dense for y in blocks(x)}

    def best(x):
        """Of the largest sums the innermost, then the first."""
        out = x
        for y in (best(y) for y in reversed(blocks(x))):
            if sums[y] >= sums[out]:
                out = y
        return out

    top = best(body)
    path = [top]
    while path[-1] is not body:
        path.append(parent[path[-1]])
    threshold = min(dense[x] for x in (path[:-1] or path))
    whole = {best(x) for x in below(body) if figures(x)[0] and dense[x] >= threshold and (x is not body or top is not body)}
    out: list[list[str]] = [[]]

    if top is body and formula(*own(body)) >= threshold:
        whole.add(("run", body))

    def walk(x, kept):
        block = x.tag not in inline
        if x is body and ("run", body) in whole:
            return walk_run(x)
        kept |= block and x in whole
        if block:
            out.append([])
        out[-1].append((x.text or "") if kept else "")
        for y in x:
            walk(y, kept)
            out[-1].append((y.tail or "") if kept else "")
        if block:
            out.append([])

    def walk_run(x):
        """The run of text of the body stays, its blocks by themselves."""
        out[-1].append(x.text or "")
        for y in x:
            walk_run(y) if y.tag in inline else walk(y, False)
            out[-1].append(y.tail or "")

    walk(body, False)
    return "\n".join(z for z in (" ".join("".join(y).split()) for y in out) if z)


def test_main_text_matches_brute_force():
    rng = random.Random(5)

    def piece(depth: int) -> str:
        words = " ".join("x" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 10, 40])))
        tag = rng.choice(["div", "div", "p", "li", "b", "a", "a"]) if depth else "div"
        if tag in ("p", "b", "a", "li"):
            return f"<{tag}>{words}</{tag}>"
        return f"<{tag}>{words if rng.random() < 0.3 else ''}" + "".join(piece(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    texts = 0
    for _ in range(400):
        page = "<body>" + rng.choice(["", "some text " * 9]) + "".join(piece(3) for _ in range(rng.randint(1, 6))) + "</body>"
        want = brute_main_text(page)
        assert html_density.main_text(page) == want, page
        texts += 0 < len(want) < len(" ".join(re.sub("<[^>]*>", " ", page).split()))
    assert texts > 100  # density leaves text out


def test_density_decides_without_marks(monkeypatch):
    pages = [r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    marked = [html_density.main_text(x) for x in pages]
    monkeypatch.setattr(html_density, "MARKED_TAGS", frozenset())
    monkeypatch.setattr(html_density, "MARKED_WORDS", frozenset())
    assert sum(html_density.main_text(x) == y for x, y in zip(pages, marked)) > 0.85 * len(pages)
    monkeypatch.setattr(html_density, "density", lambda *_: 1.0)
    assert sum(html_density.main_text(x) != y for x, y in zip(pages, marked)) > 0.85 * len(pages)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x", None), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted(repr(tuple(r)) for r in html_density.extract_main_text(pages).collect()) == sorted(map(repr, [(1, None, "", 0), (None, "u", "x", 1), (1, None, "", 0)]))
    assert html_density.extract_main_text(pages.limit(0)).count() == 0


# ---- op9 ----


def brute_bytes(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append(repr((doc, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize(("window", "max_bucket"), [(200, 20_000), (40, 20_000), (40, 1)])
def test_bytes_match_brute_force(docs, odd, texts, window, max_bucket):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [r[:2] for r in ODD])):
        got = suffix_dedup.remove_repeated_bytes(df, window=window, max_bucket=max_bucket, shard_strings=50).collect()
        assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == brute_bytes(rows, window)
    assert suffix_dedup.remove_repeated_bytes(odd.limit(0)).count() == 0


def test_pieces_agree_with_the_whole(monkeypatch):
    text = bytes(random.Random(1).choices(b"ab ", k=4000))
    whole = {(int(p), int(h)) for _, _, p, h in [(0, 0, *x[2:]) for x in suffix_dedup.segments(text, 64)] for p, h in zip(p, h)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    windows = sum(int(x[1].sum()) for x in suffix_dedup.segments(text, 64))
    assert windows == len(text) - 63
    assert {(int(p), int(h)) for x in suffix_dedup.segments(text, 64) for p, h in zip(x[2], x[3])} == whole


def test_columns_against_all_pairs():
    rng = random.Random(4)
    core = bytes(rng.choices(b"ab", k=12))
    strings, left = [], []
    while len(strings) < 60:
        a, b = rng.randrange(0, 6), rng.randrange(0, 6)
        s = bytes(rng.choices(b"ab", k=a)) + core + bytes(rng.choices(b"ab", k=b))
        if (s, a) not in zip(strings, left):
            strings.append(s)
            left.append(a)
    copies = np.array([1 + (i % 7 == 0) for i in range(60)])
    made = suffix_dedup.Construction.of_strings(strings, np.array(left), np.zeros(60, int), copies)
    while len(made.columns):
        made.insert(14, 5)
        made = suffix_dedup.Construction.unpacked(made.packed())
    flags = {(i, k) for i, runs in made.runs().items() for a, z in runs for k in range(a, z + 1)}
    for i, s in enumerate(strings):
        for k in range(len(s) - 13):
            want = copies[i] > 1 or any(0 <= (o := k - left[i] + left[j]) and t[o : o + 14] == s[k : k + 14] for j, t in enumerate(strings) if j != i)
            assert ((i, k) in flags) == want


# ---- op10 ----


def brute_lines(rows, least):
    """Rows of the same id and text are one document. From each line on, the longest run that starts anywhere before, compared line by line."""
    seen = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    runs, order, places = collections.defaultdict(list), {}, collections.defaultdict(list)
    for has, i, t in seen:
        lines = [(k, x) for k, x in ((k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(t.split("\n"))) if x]
        order[has, i, t] = lines
    for d in seen:
        lines = order[d]
        for a in range(len(lines)):
            longest = 0
            for other, b in places[lines[a][1]]:
                n = 0
                while a + n < len(lines) and b + n < len(other) and n < 70 and lines[a + n][1] == other[b + n][1]:
                    n += 1
                longest = max(longest, n)
            if sum(len(words(x)) for _, x in lines[a : a + longest]) >= least:
                runs[d].append((lines[a][0], lines[a + longest - 1][0]))
            places[lines[a][1]].append((lines, a))
    out = []
    for i, t in rows:
        d = (i is not None, i or 0, t or "")
        gone = {k for a, b in runs[d] for k in range(a, b + 1)}
        held = dict(order[d])
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        out.append(repr((i, len(held), len(gone & set(held)), sum(k - 1 not in gone for k in gone), kept if gone else t)))
    return sorted(out)


@pytest.mark.parametrize("least", [50, 8])
def test_lines_match_brute_force(docs, odd, texts, least):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in texts]), (odd, [r[:2] for r in ODD])):
        got = line_dedup.remove_repeated_lines(df, min_words=least).collect()
        assert sorted(repr((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.text)) for r in got) == brute_lines(rows, least)
    assert line_dedup.remove_repeated_lines(odd.limit(0)).count() == 0


def test_the_whole_maximal_run_goes(spark):
    run = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abc", (40, 20, 5))]
    rows = [(1, "\n".join(["first", *run, "one"])), (2, "\n".join(["second", *run, "", "two"])), (3, "\n".join(run[1:]))]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame([(*x, "kept", 7) for x in rows], "doc_id long, text string, n_other string, n_runs int")).orderBy("doc_id").collect()
    assert [r.text for r in got] == [rows[0][1], "second\n\ntwo", rows[2][1]] and [(r.n_removed, r.n_runs, r.n_other) for r in got] == [(0, 0, "kept"), (3, 1, "kept"), (0, 0, "kept")]


def test_random_lines_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lines = [f"l{rng.randrange(3)}" + " w" * rng.randrange(3) for _ in range(rng.randrange(60))]
        if rows and rng.random() < 0.6:  # a passage of another document
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            lines[rng.randrange(len(lines) + 1) :] = other[a : a + rng.randrange(60)]
        rows.append((i, "\n".join(lines)))
    for least in (5, 50):
        got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()
        assert sorted(repr((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.text)) for r in got) == brute_lines(rows, least)


def test_ranks_are_the_order_of_suffixes(spark):
    rows = [(i, "\n".join(x)) for i, x in enumerate(["abcabcabc", "bcabd", "abcab", "xyz"])]
    lines = line_dedup.places(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    held = {r.place: r for r in lines.collect()}
    for k, level in enumerate(line_dedup.suffix_ranks(lines, 4)):
        suffix = {r.place: [(held[r.place + j].a, held[r.place + j].b) for j in range(2**k)] for r in level.collect()}
        ranks = {r.place: r["rank"] for r in level.collect()}
        assert suffix and all((suffix[p] < suffix[q]) == (ranks[p] < ranks[q]) for p in suffix for q in suffix)
