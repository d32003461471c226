"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word of the Golay code. If two
fingerprints differ in three bits at most, then (pigeonhole) either one segment is equal and another differs in one bit at most, or all three differ
in one bit each. So a fingerprint is stored under seven keys: for each choice of two segments in order, the first one itself and the index of the
codeword nearest to the second (33 or 34 bits); and the indices of the three nearest codewords (36 bits). It is looked up under every codeword
within distance 4 of a segment (up to 6, on average 5.3): whatever lies within one bit meets. The join verifies the true distance, and takes each linked pair once, at the first key
that fulfils its condition. Only distinct fingerprints take part, so that exact copies of any number cost nothing. Unrelated fingerprints meet once in 2^33 pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_labels
from . import golay
from .common import drop_table, map_arrow, materialize, parts, text_of

#: Segments as (shift, bits), and the choices of an equal and a near segment that make a key.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHOICES = tuple((i, j) for i in range(3) for j in range(3) if i != j)
DISTANCE = 3


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """The XXH64 hashes (seed 42) of a text's word shingles, in order, repeats included; none without words.

    Only A-Z are lower-cased; words are split at ASCII white space; a text of fewer words is one shingle.
    """
    words = text.encode().lower().split()
    if words and len(words) < shingle_words:
        words = [b" ".join(words)]
    elif shingle_words > 1:
        words = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in words), np.uint64, len(words))


def _simhash(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for texts of any length
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text's shingle_hashes; 0 without words."""
    return _simhash(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """id, fp (bigint) of every row; null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle_words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    unsigned = fp.view(np.uint64)
    return [(unsigned >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]


def stored_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp): a key for each choice of segments, and one for all three."""
    parts = _segments(fp)
    near = [golay.nearest(x).astype(np.int64) for x in parts]
    keys = [t << 40 | parts[i] << 12 | near[j] for t, (i, j) in enumerate(CHOICES)]
    keys.append(len(CHOICES) << 40 | near[0] << 24 | near[1] << 12 | near[2])
    return np.concatenate(keys), np.tile(np.arange(len(fp)), len(keys))


def lookup_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp): the same with every codeword within distance 4."""
    parts = _segments(fp)
    around = [golay.around(x).astype(np.int64) for x in parts]
    keys, rows = [], []

    def add(every: np.ndarray, there: np.ndarray) -> None:
        at, *rest = np.nonzero(there)
        keys.append(every[(at, *rest)])
        rows.append(at)

    for t, (i, j) in enumerate(CHOICES):
        add(t << 40 | parts[i][:, None] << 12 | around[j], around[j] >= 0)
    a, b, c = around[0][:, :, None, None], around[1][:, None, :, None], around[2][:, None, None, :]
    add(len(CHOICES) << 40 | a << 24 | b << 12 | c, (a >= 0) & (b >= 0) & (c >= 0))
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(distinct: DataFrame, make, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(whole), 2_000):
                fp = whole[at : at + 2_000]
                keys, rows = make(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", name])

    return map_arrow(distinct.select("fp"), run, f"key bigint, {name} bigint")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: each pair of the distinct fingerprints (column fp, no nulls) that differ in 1 to 3 bits, once."""
    errors = []
    for shift, bits in SEGMENTS:
        mask = (1 << bits) - 1
        errors.append(F.bit_count(F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), shift).bitwiseAND(F.lit(mask).cast("bigint"))))
    at, before = F.shiftright(F.col("s.key"), 40), F.lit(False)
    first = (at == len(CHOICES)) & (errors[0] == 1) & (errors[1] == 1) & (errors[2] == 1)
    for t, (i, j) in enumerate(CHOICES):
        fits = (errors[i] == 0) & (errors[j] <= 1)
        first = first | ((at == t) & fits & ~before)
        before = before | fits
    stored, lookup = _keyed(distinct, stored_keys, "a").alias("s"), _keyed(distinct, lookup_keys, "b").alias("l")
    met = (F.col("s.key") == F.col("l.key")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE) & first
    # both sides are many times the table they are made of, by whose size the planner would gather one of them
    return stored.hint("merge").join(lookup, met).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id of every row: the smallest id reachable by links of at most 3 differing bits.

    Texts without words (null, empty or white space only) have fingerprint zero and are linked like any other. Null ids are never the
    smallest; a component of null ids alone has a null component_id. Repeated rows give a row each; an empty table gives none. Columns other than the two named are
    not read, so that their names don't matter.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")).repartition(n, "fp"), "distinct")
    return _grouped(prints, distinct, links(distinct).select(F.col("b").alias("u"), F.col("a").alias("v")), id_col)


def _grouped(prints: DataFrame, distinct: DataFrame, edges: DataFrame, id_col: str, node: str = "fp") -> DataFrame:
    """id_col, fingerprint, component_id of prints (id, fp, node), whose distinct nodes (node, least) are linked by edges (u, v)."""
    linked = materialize(star_labels(edges), "labels").withColumnRenamed("node", "linked")
    rooted = distinct.join(linked, distinct[node] == linked["linked"], "left").select(node, "least", F.coalesce("root", node).alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(smallest, "root").select(node, "component_id")
    out = prints.join(component, node)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def jaccard(a: str, b: str, shingle_words: int) -> float:
    """Shared part of two texts' sets of word shingles; a text of fewer words is one shingle."""
    def grams(text: str) -> set:
        w = text.encode().lower().split()
        return set(zip(*(w[i:] for i in range(shingle_words)))) if len(w) >= shingle_words else {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


#: One text of so many is read for common shingles; those found in COMMON_TEXTS of them go last, the COMMON_MOST commonest at most.
COMMON_SAMPLE, COMMON_TEXTS, COMMON_MOST = 16, 3, 1 << 18


def _common_shingles(texts: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and the rank by which each goes behind rarer ones. They decide what a prefix costs, never what it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle_words)).view(np.int64))], ["token"])

    some = texts.where(F.pmod("text_hash", F.lit(COMMON_SAMPLE)) == 0).groupBy("text_hash").agg(F.max("text").alias("text"))
    counts = map_arrow(some.select("text"), run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_TEXTS)
    found = counts.orderBy(F.desc("n"), "token").limit(COMMON_MOST).toArrow()
    token, n = (x.to_numpy().astype(np.int64) for x in found.columns)
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], n[order]


def shingle_prefix(tokens: np.ndarray, common: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Of distinct hashes, rare ones first, as many as two sets of this similarity can't both spend on what they don't share."""
    rank = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, n[at], 0)
    least = int(np.ceil(similarity * len(tokens) - 1e-9))
    return tokens[np.lexsort((tokens, rank))][: len(tokens) - least + 1]


def sketch(tokens: np.ndarray) -> bytes:
    """How many distinct hashes start with each of 2^6 to 2^13 values of their first bits, some one or two each; 255 stands for more, too."""
    bits = min(13, max(6, (len(tokens) // 2).bit_length()))
    return np.minimum(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_share(a: bytes, b: bytes, similarity: float) -> bool:
    """False if sets of these sketches can't be similar: they share at most the lesser count of each value."""
    x, y = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (a, b))
    if x.max() == 255 or y.max() == 255:
        return True
    n = min(len(x), len(y))
    x, y = x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)
    return int(np.minimum(x, y).sum()) >= similarity / (1 + similarity) * int(x.sum() + y.sum()) - 1e-6


def _may(similarity: float, a: str, b: str) -> Column:
    """Whether sets a and b can be similar if the shingle at these positions is the first that they share."""
    sizes, left = [F.col(f"{x}.size") for x in (a, b)], [F.col(f"{x}.size") - F.col(f"{x}.pos") for x in (a, b)]
    return (F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-6) & (F.least(*left) >= similarity / (1 + similarity) * (sizes[0] + sizes[1]) - 1e-6)


def _texts_of(pairs: DataFrame, texts: DataFrame, distinct: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, text of the nodes of pairs (u, v), written; known: such a table of others, from which texts are taken where they are in it."""
    wanted = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "wanted")
    some, missing = None, wanted
    if known is not None:
        some = known.join(wanted, "node", "left_semi")
        missing = materialize(wanted.join(known.select("node"), "node", "left_anti"), "missing")
    keys = materialize(missing.join(distinct.select("node", F.col("text_hash").alias("of")), "node"), "keys")  # of known size: where it is small, no text moves
    found = texts.join(keys, F.col("text_hash") == F.col("of")).groupBy("node").agg(F.max("text").alias("text"))
    return materialize(found if some is None else found.unionByName(some), "texts")


def _where(pairs: DataFrame, found: DataFrame, of: str, good: Callable) -> DataFrame:
    """The pairs (u, v) of nodes of which good holds, given column `of` of both in found (node, of)."""
    both = pairs.join(found.select(F.col("node").alias("u"), F.col(of).alias("x")), "u").join(found.select(F.col("node").alias("v"), F.col(of).alias("y")), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([good(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["u", "v"])

    return materialize(map_arrow(both.select("u", "v", "x", "y"), compare, "u bigint, v bigint"), "similar")


def _possible(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sketches allow the similarity, so that few texts move."""
    return _where(pairs, distinct, "sketch", lambda x, y: may_share(x, y, similarity))


def _verified(pairs: DataFrame, found: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts (node, text) share `similarity` of their shingles or more."""
    return _where(pairs, found, "text", lambda x, y: jaccard(x, y, shingle_words) >= similarity)


def _similar(texts: DataFrame, distinct: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """u, v: links between nodes, whose components are those of all pairs that share `similarity` of their shingles or more.

    Prefix filtering: in one order of all shingles, two such sets share one among the first of each, at places that leave room for the rest. So texts meet
    by these. First each is compared with one text of each shingle, which joins large groups at the cost of their texts; then all pairs
    that share a shingle, can be similar and aren't yet in one component. Texts are read of those pairs whose sketches allow it.
    """
    rows = distinct.where("size > 0").select("node", "size", F.posexplode("prefix").alias("pos", "token"))
    twice = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("token").alias("at"))  # few tokens: the others move as numbers alone
    met_once = materialize(rows.join(materialize(twice, "tokens"), F.col("token") == F.col("at")).select("token", "node", "size", "pos"), "meetings")
    centres = met_once.groupBy("token").agg(F.min(F.struct("node", "size", "pos")).alias("c")).select(F.col("token").alias("at"), "c")
    shared = met_once.join(materialize(centres, "centres"), F.col("token") == F.col("at")).select("token", F.struct("node", "size", "pos").alias("m"), "c")
    shared = materialize(shared, "shared")
    drop_table(met_once)
    pair = lambda a, b: (F.greatest(f"{a}.node", f"{b}.node").alias("u"), F.least(f"{a}.node", f"{b}.node").alias("v"))
    tried = materialize(shared.where((F.col("m.node") != F.col("c.node")) & _may(similarity, "m", "c")).select(*pair("m", "c")).distinct(), "tried")
    near = _possible(tried, distinct, similarity)
    found = _texts_of(near, texts, distinct)
    linked = _verified(near, found, shingle_words, similarity)
    roots = materialize(star_labels(linked), "roots")
    rooted = shared.join(roots, F.col("m.node") == F.col("node"), "left").select("token", "m", F.coalesce("root", "m.node").alias("root"))
    parts = materialize(rooted.groupBy("token", "root").agg(F.collect_list("m").alias("members")), "parts")
    others = parts.select(F.col("token").alias("token2"), F.col("root").alias("root2"), F.col("members").alias("members2"))
    met = parts.join(others, (F.col("token") == F.col("token2")) & (F.col("root") < F.col("root2")))
    met = met.select(F.explode("members").alias("m"), "members2").select("m", F.explode("members2").alias("c")).where(_may(similarity, "m", "c"))
    rest = materialize(met.select(*pair("m", "c")).distinct().join(tried, ["u", "v"], "left_anti"), "rest")
    for x in (shared, parts):
        drop_table(x)
    rest = _possible(rest, distinct, similarity)
    more = _texts_of(rest, texts, distinct, found)
    drop_table(found)
    linked = linked.unionByName(_verified(rest, more, shingle_words, similarity))
    drop_table(more)
    return linked


def _similar_nodes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, text_hash, fp, node of every row, the distinct nodes, and links between them."""
    texts = docs.select(text_of(docs[text_col]).alias("text")).select(F.xxhash64("text").alias("text_hash"), "text")
    common, n_texts = _common_shingles(texts, shingle_words)
    held = docs.sparkSession.sparkContext.broadcast((common, n_texts))  # at most COMMON_MOST pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            fp, node, size, prefix, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, shingle_words)
                tokens = np.unique(hashes)
                fp.append(_simhash(hashes))
                node.append(xxhash.xxh64_intdigest(tokens.tobytes(), 44) - (1 << 63))
                size.append(len(tokens))
                sketches.append(sketch(tokens))
                prefix.append(shingle_prefix(tokens, *held.value, similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)])
            prefixes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int32()), prefixes, pa.array(sketches, pa.binary())], ["id", "text_hash", "fp", "node", "size", "prefix", "sketch"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).select("id", F.xxhash64("text").alias("text_hash"), "text")
    prints = materialize(map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint, node bigint, size int, prefix array<bigint>, sketch binary"), "fingerprints")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.groupBy("node").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    distinct = materialize(distinct.repartition(n, "node"), "distinct")
    return prints.select("id", "text_hash", "fp", "node"), distinct.select("node", "least"), _similar(texts, distinct, shingle_words, similarity)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id_col, fingerprint, component_id of every row, as near_duplicates, but linked where texts share `similarity` of their shingles.

    Every pair of that similarity is in one component, and no other is linked, however near its fingerprints.
    Texts of the same shingles are one node. Rows without words are linked with each other. Other cases are as in near_duplicates.
    """
    prints, distinct, linked = _similar_nodes(docs, id_col, text_col, shingle_words, similarity)
    return _grouped(prints, distinct, linked, id_col, "node")


def _least(rows: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """The least row of each key, by its columns in order; columns of kinds that have no order count by their text."""
    ordered = [F.col(x).cast("string") if any(y in rows.schema[x].dataType.simpleString() for y in ("map<", "variant", "interval")) else F.col(x) for x in names]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*ordered)).alias("r")).select("r.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group of similar texts (see similar_groups) one row.

    It is that of the smallest id, then text hash; null ids come last, so that such a row stays only where its group has no other. Of repeated rows of one
    id and text the least stays, by its columns in order. Rows of one id with different texts are documents of their own. Other columns are kept,
    whatever their names and kinds.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text = (f"c{names.index(x)}" for x in (id_col, text_col))
    prints, distinct, linked = _similar_nodes(plain, doc, text, shingle_words, similarity)
    roots = materialize(star_labels(linked), "labels").withColumnRenamed("node", "linked")
    rooted = distinct.join(roots, distinct["node"] == roots["linked"], "left").select("node", F.coalesce("root", "node").alias("root"))
    rows = prints.groupBy("node", "id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(rooted, "node")
    rows = materialize(rows.select("id", "text_hash", "n", "root"), "rooted")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"))
    first = first.select("root", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    # what goes, and what stands more than once, are few rows as a rule: written first, so that the planner knows their size
    special = rows.join(first, "root").where(~stays | (F.col("n") > 1))
    special = materialize(special.select(F.col("id").alias("of"), F.col("text_hash").alias("of_hash"), stays.alias("stays")), "copies")
    hashed = plain.withColumn("h", F.xxhash64(text_of(F.col(text))))
    same = hashed[doc].eqNullSafe(special["of"]) & (F.col("h") == F.col("of_hash"))
    whole = hashed.join(special, same, "left_anti")
    repeated = hashed.join(special.where("stays"), same, "left_semi")
    return whole.select(plain.columns).unionByName(_least(repeated, plain.columns, [doc, "h"])).toDF(*names)
