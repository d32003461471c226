"""Quality rules whose limits adapt to language and source: limits come from mergeable quantile sketches, documents are joined to them.

The sketch of a measure in a stratum (a language and source) is a histogram with a bucket for each of the leading `PRECISION` bits
of a whole number (as in HDR histograms): its relative error is at most 1/64, its size at most some thousand buckets whatever the
number of documents, and sketches merge by adding counts. So one pre-aggregated count gives the sketches of all strata, and a
stratum of fewer than `min_docs` documents takes the merged sketch of its language, or else that of all documents. Everything is
counted in whole numbers, so that results don't depend on the order of rows.

A document that passes the base rule is kept if each measure lies within the fences of its stratum: at most the third
quartile plus `REACH` times the spread of the quartiles, and for word length also at least the first quartile minus as much. A least
spread for each measure keeps strata without any variation from rejecting the first document that differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, text_of

#: Leading bits of a measure that a sketch keeps.
PRECISION = 7
#: Spreads of the quartiles that a fence lies beyond them.
REACH = 3
#: Measures in thousandths: numerator, denominator, least spread, whether low values are fenced too.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 50, False),
    "dup_lines": ("n_dup_lines", "n_lines", 200, False),
    "repeats": ("n_repeat_words", "n_words", 100, False),
    "word_length": ("word_chars", "n_words", 500, True),
    "capitals": ("n_capitals", "word_chars", 50, False),
}


def _without(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc, lang, source and the counts of every row, JVM expressions only; a null text has no words."""
    space = " \t\n\x0b\x0c\r"
    rows = docs.select(docs[id_col].alias("doc"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"), text_of(docs[text_col]).alias("text"))
    rows = rows.withColumn("bare", F.btrim("text", F.lit(space)))
    rows = rows.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"[{SPACE}]+")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(space)) != ""))
    counts = rows.select(
        "doc", "lang", "source", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", space, "")).cast("bigint").alias("word_chars"),
        _without(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    return repeated_words(counts, "words", "n_repeat_words").drop("words")


def repeated_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """rows with the number of words that lie in a window of three words found twice or more in the array column words.

    Windows are compared by a 64-bit hash. Texts without a repeated window end after one pass over a hash set; the others sort
    (hash, place), mark places whose neighbour has the same hash, and add up what the marked windows cover.
    """
    w = F.col(words)
    hashes = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    rows = rows.withColumn("_hashes", hashes)
    placed = F.array_sort(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))
    marked = F.filter("_placed", lambda x, j: F.coalesce(F.get("_placed", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_placed", j + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("_marked", F.sort_array(F.transform(marked, lambda x: x["i"])))
    covered = F.aggregate(
        "_marked",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("bigint").alias("n"), p.alias("last")),
    )["n"]
    return rows.withColumn(name, F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_hashes", "_placed", "_marked")


def bucket(value: Column) -> Column:
    """The least whole number with the same PRECISION leading bits; value is 0 or more."""
    spare = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def _permille(name: str) -> Column:
    top, bottom, _, _ = MEASURES[name]
    return F.when(F.col(bottom) > 0, F.expr(f"1000 * {top} div {bottom}")).otherwise(F.lit(0).cast("bigint"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the sketch of each stratum, over documents that pass the base rule."""
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), bucket(_permille(x)).alias("bucket")) for x in MEASURES]))
    rows = measured.where(~F.col("base_failed")).select("lang", "source", values.alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, total, q1, q3 from sketches merged to the columns by."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")  # a group has some thousand buckets at most
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn("below", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(*by, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )


def fences(sketch: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, and for each measure low_<measure> and high_<measure>, for every stratum of the sketches."""
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("lang1"), F.col("measure").alias("measure1"), F.col("total").alias("total1"), F.col("q1").alias("q11"), F.col("q3").alias("q31"))
    whole = _quartiles(sketch, []).select(F.col("measure").alias("measure2"), F.col("q1").alias("q12"), F.col("q3").alias("q32"))
    every = own.join(lang, own["lang"].eqNullSafe(lang["lang1"]) & (own["measure"] == lang["measure1"])).join(whole, F.col("measure") == F.col("measure2"))
    pick = lambda q: F.when(F.col("total") >= min_docs, F.col(q)).when(F.col("total1") >= min_docs, F.col(q + "1")).otherwise(F.col(q + "2"))
    least = F.element_at(F.create_map(*[F.lit(y) for name, x in MEASURES.items() for y in (name, x[2])]), F.col("measure"))
    every = every.select("lang", "source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3")).withColumn("reach", REACH * F.greatest(F.col("q3") - F.col("q1"), least))
    columns = []
    for name, (_, _, _, both) in MEASURES.items():
        here = F.col("measure") == name
        columns.append(F.max(F.when(here, F.col("q3") + F.col("reach"))).alias(f"high_{name}"))
        if both:
            columns.append(F.max(F.when(here, F.col("q1") - F.col("reach"))).alias(f"low_{name}"))
    return every.groupBy("lang", "source").agg(*columns)


def adaptive_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 100) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and verdicts' figures, of every row.

    base_failed: fewer than 50 words, or over half of them in repeated windows of three. kept: neither base_failed nor beyond a fence
    of its stratum. Null languages and sources are strata of their own; null texts have no words and so fail the base rule; repeated
    rows count each; an empty table gives none. Columns other than the four named aren't read. Sketches and fences are joined without
    a forced broadcast: adaptive execution broadcasts the fences where their measured size allows, and splits hot strata where not.
    """
    measured = measure(docs, id_col, text_col, lang_col, source_col)
    measured = measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    measured = materialize(measured, "measures")
    limits = fences(sketches(measured), min_docs)  # its three uses share one exchange
    limits = limits.select(F.col("lang").alias("lang1"), F.col("source").alias("source1"), *[x for x in limits.columns if x not in ("lang", "source")])
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["lang1"]) & measured["source"].eqNullSafe(limits["source1"]), "left")
    within = F.lit(True)
    for name, (_, _, _, both) in MEASURES.items():
        within &= F.coalesce(_permille(name) <= F.col(f"high_{name}"), F.lit(False))
        if both:
            within &= F.coalesce(_permille(name) >= F.col(f"low_{name}"), F.lit(False))
    return joined.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"), "n_lines", "n_capitals")


def _oracle() -> str:
    """The rows of op2_quality_rules for DuckDB: the same counts, sketches and fences in SQL."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    permille = " UNION ALL ".join(f"SELECT r, lang, source, base_failed, '{name}' AS measure, CASE WHEN {bottom} > 0 THEN 1000 * {top} // {bottom} ELSE 0 END AS v, {least} AS least, {str(both).lower()} AS both_sides FROM c" for name, (top, bottom, least, both) in MEASURES.items())
    quartiles = lambda by: f"SELECT {by} measure, max(total) AS total, min(CASE WHEN 4 * below >= total THEN bucket END) AS q1, min(CASE WHEN 4 * below >= 3 * total THEN bucket END) AS q3 FROM (SELECT {by} measure, bucket, sum(n) OVER (PARTITION BY {by} measure) AS total, sum(n) OVER (PARTITION BY {by} measure ORDER BY bucket) AS below FROM (SELECT {by} measure, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: trim(x, {white}) <> '') AS lines FROM d),
g AS (SELECT r, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS k FROM w)),
t AS (SELECT r, k FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM t) GROUP BY r),
b AS (SELECT r, doc_id, lang, source, len(words) AS n_words, CAST(length(translate(text, {white}, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
m AS ({permille}),
s AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - {PRECISION}, 0)) << greatest(length(bin(v)) - {PRECISION}, 0) AS bucket, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL),
own AS ({quartiles("lang, source,")}), langs AS ({quartiles("lang,")}), every AS ({quartiles("")}),
pick AS (SELECT own.lang, own.source, own.measure, CASE WHEN own.total >= 100 THEN own.q1 WHEN langs.total >= 100 THEN langs.q1 ELSE every.q1 END AS q1, CASE WHEN own.total >= 100 THEN own.q3 WHEN langs.total >= 100 THEN langs.q3 ELSE every.q3 END AS q3
  FROM own JOIN langs ON own.lang IS NOT DISTINCT FROM langs.lang AND own.measure = langs.measure JOIN every ON own.measure = every.measure),
ok AS (SELECT r, bool_and(coalesce(v <= q3 + {REACH} * greatest(q3 - q1, least) AND (NOT both_sides OR v >= q1 - {REACH} * greatest(q3 - q1, least)), false)) AS within
  FROM m LEFT JOIN pick ON m.lang IS NOT DISTINCT FROM pick.lang AND m.source IS NOT DISTINCT FROM pick.source AND m.measure = pick.measure GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept, n_lines, n_capitals FROM c JOIN ok USING (r)
"""


ORACLE_SQL = _oracle()
