"""Line dedup by a suffix array over sequences of line ids, by distributed prefix doubling, in JVM expressions only.

A document is the sequence of its lines that have a word. All lines of all documents stand in one table, numbered in the order of the documents
(by id, then text hash) with a gap after each document, so that the line behind place g is g + 1, and places are compared as numbers.

Doubling: the rank of a place says where the suffix from there on sorts, by its first 2^k lines. Ranks of the first line come from the order of the lines' ids (two
64-bit hashes). Each round joins the table with itself at distance 2^k, sorts the distinct pairs of ranks, and numbers them in that order. A suffix that no other
agrees with leaves the table, as none agrees with it in more lines either. Since a run of `min_words` words has at most that many lines, the rounds end there.

Intervals: the suffixes that agree in their first m lines are an interval of the suffix array, with longest common prefixes of m or more inside it.
From the highest round down, each place's longest common prefix with any earlier place is put together bit by bit: the interval at
depth m, known by its first place, splits by the ranks of the 2^k lines behind; whatever isn't the first of its part agrees with an earlier place in m + 2^k
lines. So every place knows the longest run from it on that occurs before: a maximal repeated run, or the first lines of one that suffice to mark
its first line. Where such a run has min_words words, its lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_table, materialize, text_of

_WHITE = " \t\n\x0b\x0c\r"


def _upto(n: Column) -> Column:
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))


def places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_hash, line (its number in the text), a, b (its id), words, place: every line with a word of the distinct documents, written once."""
    rows = docs.select(docs[id_col].alias("doc"), text_of(docs[text_col]).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("lines", F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_WHITE))))
    rows = rows.withColumn("at", F.filter(F.transform("lines", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull()))

    def line(i: Column) -> Column:
        x = F.get("lines", i)
        return F.struct(i.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"), F.size(F.split(x, f"[{SPACE}]+")).cast("bigint").alias("words"))

    rows = rows.select("doc", "text_hash", F.transform("at", line).alias("lines")).dropDuplicates(["doc", "text_hash"]).where(F.size("lines") > 0)
    gap = F.array(F.lit(None).cast("struct<line:int,a:bigint,b:bigint,words:bigint>"))
    ordered = rows.orderBy("doc", "text_hash").select("doc", "text_hash", F.explode_outer(F.concat("lines", gap)).alias("l"))
    # the numbers follow the order of the partitions and of the rows in them; they are written at once, and not computed again
    numbered = ordered.select("doc", "text_hash", "l", F.monotonically_increasing_id().alias("place")).where("l is not null")
    return materialize(numbered.select("doc", "text_hash", "l.*", "place"), "places")


def _ranked(rows: DataFrame, *key: str) -> DataFrame:
    """place, rank, words, last of the rows that share their key with others: rank numbers the keys in their order."""
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(*key)
    ranks = shared.select(*[F.col(x).alias(f"of_{x}") for x in key], F.monotonically_increasing_id().alias("rank"))
    # a join of two tables, so that adaptive execution can split the rows of a very common line
    same = [F.col(x) == F.col(f"of_{x}") for x in key]
    return rows.join(ranks, same).select("place", "rank", "words", "last")


def suffix_ranks(lines: DataFrame, min_words: int) -> list[DataFrame]:
    """For k = 0, 1, ...: place, rank by the first 2^k lines, their words and last line, of each suffix that another agrees with so far."""
    levels = [materialize(_ranked(lines.withColumn("last", F.col("line")), "a", "b"), "ranks")]
    while 2 ** len(levels) <= min_words and not levels[-1].isEmpty():
        step = 2 ** (len(levels) - 1)
        behind = levels[-1].select((F.col("place") - step).alias("before"), F.col("rank").alias("rank2"), F.col("words").alias("words2"), F.col("last").alias("last2"))
        both = levels[-1].join(behind, F.col("place") == F.col("before"))
        both = both.select("place", F.col("rank").alias("rank1"), "rank2", (F.col("words") + F.col("words2")).alias("words"), F.col("last2").alias("last"))
        levels.append(materialize(_ranked(both, "rank1", "rank2"), "ranks"))
    return levels


def earlier_prefixes(levels: list[DataFrame]) -> DataFrame:
    """place, depth, origin, words, last: the longest common prefix with any earlier place, in lines, below 2^len(levels).

    origin: the first place with the same `depth` lines; words, last: their words and last line. Places without an earlier one are missing.
    """
    found = None
    for k in reversed(range(len(levels))):
        level = levels[k].select(F.col("place").alias("at"), F.col("rank").alias("next"), F.col("words").alias("more"), F.col("last").alias("end"))
        fresh = level
        none = F.lit(0).cast("bigint")
        if found is not None:
            fresh = level.join(found.select("place"), F.col("at") == F.col("place"), "left_anti")
        fresh = fresh.select(F.col("at").alias("place"), none.alias("depth"), F.lit(-1).cast("bigint").alias("origin"), none.alias("words"), F.lit(None).cast("int").alias("last"), "next", "more", "end")
        if found is None:
            known, seen = fresh, fresh.select("depth", "origin", "next", "place")
        else:
            known = found.join(level, F.col("place") + F.col("depth") == F.col("at"), "left").drop("at").unionByName(fresh)
            firsts = found.select("depth", "origin").distinct().join(level, F.col("origin") + F.col("depth") == F.col("at")).select("depth", "origin", "next", F.col("origin").alias("place"))
            seen = known.where("next is not null").select("depth", "origin", "next", "place").unionByName(firsts)
        parts = seen.groupBy("depth", "origin", "next").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1")
        # written, so that the join is one of two tables, whose rows of a very common line adaptive execution can split
        parts = materialize(parts.select(F.col("depth").alias("d"), F.col("origin").alias("o"), F.col("next").alias("x"), "first"), "intervals")
        joined = known.join(parts, (F.col("depth") == F.col("d")) & (F.col("origin") == F.col("o")) & (F.col("next") == F.col("x")), "left")
        longer = F.col("first") < F.col("place")  # null where nothing agrees
        joined = joined.where(longer | (F.col("depth") > 0)).select(
            "place", F.when(longer, F.col("depth") + 2**k).otherwise(F.col("depth")).alias("depth"), F.when(longer, F.col("first")).otherwise(F.col("origin")).alias("origin"),
            F.when(longer, F.col("words") + F.col("more")).otherwise(F.col("words")).alias("words"), F.when(longer, F.col("end")).otherwise(F.col("last")).alias("last"),
        )
        before, found = found, materialize(joined, "prefixes")
        drop_table(parts)
        if before is not None:
            drop_table(before)
    return found


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """doc, text_hash, runs (first and last line): from each place that starts a run of min_words words which starts earlier as well, the longest such run."""
    lines = places(docs, id_col, text_col)
    levels = suffix_ranks(lines, max(1, min_words))
    found = earlier_prefixes(levels).where(F.col("words") >= min_words).select(F.col("place").alias("start"), "last")
    found = lines.join(found, F.col("place") == F.col("start")).groupBy("doc", "text_hash").agg(F.collect_list(F.struct(F.col("line").alias("first"), "last")).alias("runs"))
    found = materialize(found, "removed")
    for x in (lines, *levels):
        drop_table(x)
    return found


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with text_col rid of later copies of repeated runs of lines, and n_lines, n_removed, n_runs (bigint).

    A line stands between \\n; its id leaves out white space at both ends; lines without a word take no part, but go where the run around them goes. A run
    of min_words words or more is a later copy, and goes, if the same sequence of lines starts at an earlier place, in the same document or in one that comes
    before by id, then text hash; so the first copy of each maximal repeated run stays whole, and the others go whole. n_lines: lines with a word; n_removed: those removed;
    n_runs: maximal removed stretches. A text that loses nothing stays as it is, null included. Rows with the same id and text count as one document
    and end alike; null ids come first. An empty table gives an empty one. Other columns are kept, but for those named n_lines, n_removed or
    n_runs, which the new ones replace.
    """
    added = ["n_lines", "n_removed", "n_runs"]
    docs = docs.drop(*[x for x in added if x not in (id_col, text_col)])
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = (f"c{names.index(x)}" for x in (id_col, text_col))
    gone = repeated_runs(plain, doc, text, min_words)
    rows = plain.withColumn("h", F.xxhash64(text_of(F.col(text))))
    # texts move whatever the number of removed lines, so that cost follows the input
    joined = rows.hint("merge").join(gone, rows[doc].eqNullSafe(gone["doc"]) & (rows["h"] == gone["text_hash"]), "left")
    joined = joined.withColumn("lines", F.split(text_of(F.col(text)), "\n"))
    wordy = lambda x: F.btrim(x, F.lit(_WHITE)) != ""
    joined = joined.withColumn("removed", F.when(F.col("runs").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))))
    joined = joined.withColumn("left_over", F.when(F.col("runs").isNotNull(), F.transform(F.array_except(_upto(F.size("lines")), F.col("removed")), lambda i: F.get("lines", i))))
    kept = F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.concat_ws("\n", "left_over"))
    n_lines = F.size(F.filter("lines", wordy)).cast("bigint")
    n_left = F.when(F.col("runs").isNull(), n_lines).otherwise(F.size(F.filter("left_over", wordy)).cast("bigint"))
    n_runs = F.when(F.col("runs").isNull(), F.lit(0)).otherwise(F.size(F.filter("removed", lambda x, i: (i == 0) | (F.get("removed", i - 1) != x - 1)))).cast("bigint")
    out = joined.select(*[kept.alias(text) if x == text else F.col(x) for x in plain.columns], n_lines.alias("n_lines"), (n_lines - n_left).alias("n_removed"), n_runs.alias("n_runs"))
    return out.toDF(*names, *added)


#: The rows of op10_line_dedup for DuckDB: lines; of every run of 50 words the least ones from each line on and up to each line, which cover it; their first copies, and what the others cover.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM docs),
bare AS (SELECT doc_id, ln, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM raw),
lines AS (
  SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS place
  FROM bare WHERE line <> ''),
sums AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM lines),
ends AS (
  SELECT s.doc_id, s.place, s.ln, min(e.place) AS last_place
  FROM sums s JOIN sums e ON e.doc_id = s.doc_id AND e.place >= s.place AND e.place < s.place + 50 AND e.upto - s.upto + s.nw >= 50
  GROUP BY ALL),
starts AS (
  SELECT e.doc_id, max(s.place) AS place, e.place AS last_place
  FROM sums s JOIN sums e ON e.doc_id = s.doc_id AND e.place >= s.place AND e.place < s.place + 50 AND e.upto - s.upto + s.nw >= 50
  GROUP BY e.doc_id, e.place),
least AS (SELECT doc_id, place, last_place FROM ends UNION SELECT doc_id, place, last_place FROM starts),
runs AS (
  SELECT r.doc_id, r.place, min(l.ln) AS first_ln, max(l.ln) AS last_ln, string_agg(l.line, chr(10) ORDER BY l.place) AS content
  FROM least r JOIN lines l ON l.doc_id = r.doc_id AND l.place BETWEEN r.place AND r.last_place GROUP BY r.doc_id, r.place, r.last_place),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, place) AS copy FROM runs),
gone AS (SELECT DISTINCT r.doc_id, w.ln FROM ranked r JOIN raw w ON w.doc_id = r.doc_id AND w.ln BETWEEN r.first_ln AND r.last_ln WHERE r.copy > 1),
marked AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM gone),
per_doc AS (
  SELECT raw.doc_id, count(*) FILTER (lines.ln IS NOT NULL) AS n_lines, count(*) FILTER (lines.ln IS NOT NULL AND marked.ln IS NOT NULL) AS n_removed,
    count(DISTINCT marked.run) AS n_runs, coalesce(string_agg(raw.line, chr(10) ORDER BY raw.ln) FILTER (marked.ln IS NULL), '') AS kept
  FROM raw LEFT JOIN lines USING (doc_id, ln) LEFT JOIN marked USING (doc_id, ln) GROUP BY raw.doc_id)
SELECT doc_id, n_lines, n_removed, n_runs, sha256(kept) AS kept_sha256 FROM per_doc
"""
