"""Benchmark decontamination by winnowing, in JVM expressions only.

Words become 64-bit hashes, k consecutive ones a k-gram hash, and of every w consecutive k-grams the one with the least hash (the
last on ties) is kept as a fingerprint. A span of w + k - 1 words holds w k-grams, so that equal spans of that length keep the same
one: with w + k - 1 = L every shared window of L words shares a fingerprint. Fingerprints of documents are joined with the distinct ones of
the items. Each meeting is extended to the windows of L words that hold it, and a window whose words (two 64-bit hashes) are those of
an item's window is a hit. The items of equal windows are gathered before that join, so that no join has more than one row for a key on the items' side,
however many items share a window and however many documents hold it.

L is 10; an item of fewer words is one window of its own length, with k = min(5, L).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return F.transform(F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))


def _range(first: Column, last: Column) -> Column:
    """The numbers from first to last; none if last is less."""
    return F.when(last < first, F.array().cast("array<int>")).otherwise(F.sequence(first, F.greatest(first, last)))


def winnowed(rows: DataFrame, words: str, window: int, name: str) -> DataFrame:
    """rows with an array column name of (window, gram, place), the fingerprints of the hash array column words."""
    k = min(GRAM, window)
    w, a = window - k + 1, F.col(words)
    none = F.array().cast("array<bigint>")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
    rows = rows.withColumn("_grams", F.when(F.size(a) < window, none).otherwise(F.transform(upto(F.size(a) - k), lambda i: F.xxhash64(F.lit(window), *[F.get(a, i + j) for j in range(k)]))))
    g = F.col("_grams")
    if w > 1:
        rows = rows.withColumn("_least", F.when(F.size(g) < w, none).otherwise(F.transform(upto(F.size(g) - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))))
        last = lambda m, i: reduce(lambda rest, j: F.when(F.get(g, i + j) == m, i + j).otherwise(rest), range(1, w), i)
        rows = rows.withColumn("_places", F.array_distinct(F.transform("_least", last)))
    else:
        rows = rows.withColumn("_least", F.lit(None)).withColumn("_places", F.transform(g, lambda _, i: i))
    found = F.transform("_places", lambda p: F.struct(F.lit(window).alias("window"), F.get(g, p).alias("gram"), p.alias("place")))
    return rows.withColumn(name, found).drop("_grams", "_least", "_places")


def _prints(rows: DataFrame, words: str, windows: list[int], name: str) -> DataFrame:
    for n in windows:
        rows = winnowed(rows, words, n, f"{name}{n}")
    return rows.withColumn(name, F.concat(*[F.col(f"{name}{n}") for n in windows])).drop(*[f"{name}{n}" for n in windows])


def _window(words: str, window: Column, start: Column) -> Column:
    """The place and the name, two hashes, of a window of the hash array words."""
    held = F.slice(words, start + 1, window)
    return F.struct(start.alias("s"), (start + window).alias("e"), F.xxhash64(window, held).alias("a"), F.xxhash64(F.lit("b"), window, held).alias("b"))


def item_windows(items: DataFrame) -> DataFrame:
    """a, b, items: each distinct window of items (item, words, length), with the sorted ids of the items that have it."""
    every = F.transform(_range(F.lit(0), F.size("words") - F.col("length")), lambda s: _window("words", F.col("length"), s))
    # explode_outer: for explode, the optimiser would add a filter that computes the whole array again
    rows = items.select("item", F.explode_outer(every).alias("w")).where("w is not null")
    return rows.groupBy(F.col("w.a").alias("a"), F.col("w.b").alias("b")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated, items of every row of docs.

    n_hit: words inside any occurrence of an item's window. items: the sorted ids, as text, of items with occurring windows;
    items_sha256: of these, comma-joined. Null texts have no words; items without words have no window; an item whose id is null marks words but isn't
    listed; items with the same id count once. Rows are told apart by id and text hash, and repeated ones give a row each, as do null ids. Empty tables give no rows,
    or no hits. Columns other than the named ones aren't read. No side of a join is broadcast but by the planner, where its table is small.
    """
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), word_hashes(benchmark[item_text_col]).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    windows = sorted(x[0] for x in items.select("length").distinct().collect())  # at most `window` numbers
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    whole = texts.select("id", F.xxhash64("text").alias("text_hash"), "text")
    texts = whole.select("id", "text_hash", word_hashes(F.col("text")).alias("words"))
    if not windows:
        none = F.array().cast("array<string>")
        return _summary(texts.select("id", F.size("words").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), none.alias("items")), id_col)
    prints = reduce(DataFrame.unionByName, [_prints(items.where(F.col("length") == n), "words", [n], "p") for n in windows])
    grams = materialize(prints.select(F.explode_outer("p").alias("p")).where("p is not null").select(F.col("p.gram").alias("item_gram")).distinct(), "item-grams")
    # beside its fingerprints each document has a row that meets nothing and carries its number of words
    own = F.array(F.struct(F.lit(0).alias("window"), F.lit(None).cast("bigint").alias("gram"), F.size("words").alias("place")))
    stored = _prints(texts, "words", windows, "p").select("id", "text_hash", F.explode(F.concat(own, F.col("p"))).alias("p")).select("id", "text_hash", "p.*")
    met = stored.join(grams, F.col("gram") == F.col("item_gram"), "left").where(F.col("item_gram").isNotNull() | (F.col("window") == 0))
    met = materialize(met.select("id", "text_hash", "window", "place"), "meetings")
    meetings = met.where("window > 0").groupBy("id", "text_hash").agg(F.collect_set(F.struct("window", "place")).alias("met"))
    meetings = meetings.select(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"), "met")
    # few documents meet anything, as a rule: these are found first, by a written table of known size, and read again
    keys = materialize(met.where("window > 0").select(F.col("id").alias("key"), F.col("text_hash").alias("key_hash")).distinct(), "met-documents")
    held = whole.join(keys, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("key_hash")), "left_semi")
    held = held.dropDuplicates(["id", "text_hash"]).select("id", "text_hash", word_hashes(F.col("text")).alias("words"))
    held = held.join(meetings, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash"))).drop("of", "of_hash")
    around = lambda m: F.transform(_range(F.greatest(m["place"] + F.least(m["window"], F.lit(GRAM)) - m["window"], F.lit(0)), F.least(m["place"], F.size("words") - m["window"])), lambda s: F.struct(m["window"].alias("window"), s.alias("s")))
    starts = F.array_distinct(F.flatten(F.transform("met", around)))
    held = held.select("id", "text_hash", F.explode_outer(F.transform(starts, lambda x: _window("words", x["window"], x["s"]))).alias("w")).where("w is not null").select("id", "text_hash", "w.*")
    known = materialize(item_windows(items), "item-windows").withColumnsRenamed({"a": "item_a", "b": "item_b"})
    hits = held.join(known, (F.col("a") == F.col("item_a")) & (F.col("b") == F.col("item_b")))
    found = hits.groupBy("id", "text_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.collect_set("items").alias("items"))
    found = found.select(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"), _covered("spans").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    rows = met.where("window = 0")
    rows = rows.join(found, rows["id"].eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    out = rows.select("id", F.col("place").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return _summary(out, id_col)


def _covered(spans: str) -> Column:
    """The number of words that spans [s, e) cover."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["reach"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(a["reach"], x["e"]).alias("reach")),
    )["n"]


def _summary(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


#: The rows of op6_decontamination for DuckDB: all windows of all documents against all windows of the items.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM cut),
lens AS (SELECT DISTINCT n FROM iw),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM places),
hit AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
