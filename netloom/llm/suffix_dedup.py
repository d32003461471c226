"""Removal of long byte strings that occur more than once, by column-wise Burrows-Wheeler construction over many strings.

A string of `window` bytes goes from every place where it starts, if it starts anywhere else. The construction inserts one symbol of each string a round. Over whole texts that
would take as many rounds over the whole collection as the longest text has bytes. So windows come together first:

Every window has one of its `GRAM`-byte grams as its minimizer: the one of the least hash,
the last on ties. Consecutive windows with the same minimizer form a segment of at most 2 * window - GRAM bytes. Equal windows have
equal minimizers at the same place within them, so segments meet by the hash of that gram, their bucket. Segments that meet no other take no part. Equal ones (by a
128-bit digest, counted before the shuffle) are one string with its number of copies. All others, whatever their number of copies, are
constructed.

The strings of a shard of buckets are aligned at the minimizer and read from the last column to the first. For each suffix in their order, the transform holds the
symbol before it, which stands in the next column; sorting stably by it inserts that column, and gives the order of the suffixes that begin there. The
common prefixes of neighbours are the range minima of the column before, plus one, within a symbol. Since equal windows
stand in the same columns, only the suffixes of the newest column are kept. Neighbours with a common prefix of `window` or more begin with a repeated window,
and so does a suffix of that length of a string with copies.

The columns are inserted in `STAGES` blocks. Between two blocks the columns still to come, the order, the common prefixes and what has been found are a row for each shard of a table in the
shared folder, which is written and read in sequence. So the files are read and written sequentially, and a lost executor costs a block.

A bucket of more than `max_bucket` strings would be too much for a shard. A window holds, beside the minimizer, half of its other bytes to the left of it or half to the right. So such a
bucket falls apart into those that agree in as many bytes more on the left, and those that do on the right, each with the windows that hold them; this
repeats until buckets are small, at the latest when the strings are single windows, which are all equal. Parts are solved as any bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_arrow, materialize, parts, ship, small_batches, text_of

GRAM = 32
#: Bytes that are read at a time; texts of more are taken in overlapping pieces.
PIECE = 1 << 18
#: Blocks of columns of the construction, 2 at least; a table stands between any two.
STAGES = 4
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
_LOW = np.uint64((1 << 24) - 1)  # more than PIECE


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    n = len(data) - 7
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    word *= _K[0]
    word ^= word >> np.uint64(29)
    word *= _K[2]
    word ^= word >> np.uint64(32)
    m = len(data) - GRAM + 1
    out = np.zeros(m, np.uint64)
    for at in range(0, GRAM, 8):
        out *= _K[1]
        out += word[at : at + m]
    out ^= out >> np.uint64(31)
    out *= _K[0]
    return out ^ out >> np.uint64(32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a text: starts, numbers of windows, places of the minimizer, and its hash, of its segments."""
    out = []
    for piece in range(0, max(1, len(text) - window + 1), PIECE):
        data = np.frombuffer(text, np.uint8)[piece : piece + PIECE + window - 1]
        if len(data) < window:
            break
        hashes = gram_hashes(data)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _least(hashes & ~_LOW | _LOW - place, window - GRAM + 1)
        at = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        count = np.diff(np.append(first, len(at)))
        out.append((first + piece, count, at[first] + piece, hashes[at[first]].view(np.int64)))
    return out


class Construction:
    """Strings of buckets, aligned at a place in each, and the state of their column-wise construction.

    columns: the symbols still to come, a row for each column, with zeros where a string has none. Column `zero` of them is that of the places left.
    """

    def __init__(self, columns: np.ndarray, zero: int, left: np.ndarray, right: np.ndarray, bucket: np.ndarray, copies: np.ndarray):
        self.columns, self.zero, self.left, self.right, self.bucket, self.copies = columns, zero, left, right, bucket, copies
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.common = np.zeros(len(bucket) + 1, np.int16)  # of each suffix in the order with the one before it; one more for reduceat
        self.found_string, self.found_column = np.zeros(0, np.int32), np.zeros(0, np.int16)

    @staticmethod
    def of_strings(strings: list[bytes], left: np.ndarray, bucket: np.ndarray, copies: np.ndarray) -> Construction:
        size = np.array([len(x) for x in strings], np.int64)
        zero = int(left.max())
        columns = np.zeros((zero + int((size - left).max()), len(strings)), np.uint8)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        string = np.repeat(np.arange(len(strings)), size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + (zero - left)[string]
        columns[column, string] = flat
        return Construction(columns, zero, left.astype(np.int16), (size - left).astype(np.int16), bucket.astype(np.int32), copies > 1)

    def insert(self, window: int, most: int) -> None:
        """Insert up to `most` columns, the last ones first."""
        strings, places = [self.found_string], [self.found_column]
        for row in range(len(self.columns) - 1, max(-1, len(self.columns) - 1 - most), -1):
            column = row - self.zero
            there = np.flatnonzero(self.left[self.order] >= -column)
            held = self.order[there]
            transform = np.where(self.right[held] > column, self.columns[row][held].astype(np.int64) + 1, 0)
            key = self.bucket[held].astype(np.int64) * 257 + transform
            turn = np.argsort(key, kind="stable")
            key, before = key[turn], there[turn]
            self.order = held[turn]
            same = (key[1:] == key[:-1]) & (transform[turn][1:] > 0)
            now = np.zeros(len(self.order) + 1, np.int16)
            if same.any():
                spans = np.stack([before[:-1][same] + 1, before[1:][same] + 1], axis=1).ravel()
                now[1:-1][same] = np.minimum.reduceat(self.common, spans)[::2] + 1
            self.common = now
            hit = now[:-1] >= window
            hit[:-1] |= hit[1:].copy()
            hit |= self.copies[self.order] & (self.right[self.order] - column >= window)
            found = self.order[hit]
            strings.append(found)
            places.append((self.left[found] + column).astype(np.int16))
        self.columns = self.columns[: max(0, len(self.columns) - most)]
        self.found_string, self.found_column = np.concatenate(strings), np.concatenate(places)

    def runs(self) -> dict[int, list[list[int]]]:
        """Of each string with a repeated window, the first and last of each run of such windows."""
        turn = np.lexsort((self.found_column, self.found_string))
        string, place = self.found_string[turn], self.found_column[turn].astype(np.int64)
        edge = np.flatnonzero((np.diff(string, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1))
        out: dict[int, list[list[int]]] = {}
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(string)]):
            out.setdefault(int(string[a]), []).append([int(place[a]), int(place[z - 1])])
        return out

    #: The state as it stands in a table, and the kinds of its numbers.
    FIELDS = (("left", np.int16), ("right", np.int16), ("bucket", np.int32), ("copies", np.bool_), ("order", np.int32), ("common", np.int16), ("found_string", np.int32), ("found_column", np.int16))

    def packed(self) -> dict:
        return {"zero": self.zero, "height": len(self.columns), "columns": self.columns.tobytes()} | {x: getattr(self, x).tobytes() for x, _ in self.FIELDS}

    @staticmethod
    def unpacked(row: dict) -> Construction:
        out = Construction.__new__(Construction)
        for x, kind in Construction.FIELDS:
            setattr(out, x, np.frombuffer(row[x], kind))
        out.zero, out.columns = row["zero"], np.frombuffer(row["columns"], np.uint8).reshape(row["height"], len(out.bucket))
        return out


def _in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches from chunks of columns, each of some `most` by weigh(chunk): batches of single rows would cost more than their contents."""
    held: list[list[pa.Array]] = [[] for _ in names]
    weight = 0
    for chunk in rows:
        for column, x, kind in zip(held, chunk, types):
            column.append(x if isinstance(x, pa.Array) else pa.array(x, kind))
        weight += weigh(chunk)
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in held], names)
            held, weight = [[] for _ in names], 0
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in held], names)


def _digest(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _segment_rows(texts: DataFrame, window: int) -> DataFrame:
    """uid, starts, n, at, bucket, content: a row for each distinct segment of a piece of a text, with all its starts there.

    Text that repeats itself at a short distance has a segment for each repetition, but few distinct ones.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                if len(raw) < window:
                    continue
                for first, count, at, bucket in segments(raw, window):
                    digests = np.array([_digest(raw[a:z]) for a, z in zip(first.tolist(), (first + count + window - 1).tolist())], "V16")
                    content, one, which, times = np.unique(digests.view("S16"), return_index=True, return_inverse=True, return_counts=True)
                    starts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32)), pa.array(first[np.argsort(which, kind="stable")]))
                    yield np.full(len(one), uid), starts, count[one].astype(np.int32), (at - first)[one].astype(np.int32), bucket[one], pa.array([x.tobytes() for x in digests[one]], pa.binary())

    names = ["uid", "starts", "n", "at", "bucket", "content"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    run = lambda batches: _in_batches(found(batches), names, types, lambda x: 80 * len(x[0]))
    return map_arrow(texts, run, "uid bigint, starts array<bigint>, n int, at int, bucket bigint, content binary")


def _buckets(texts: DataFrame, window: int) -> DataFrame:
    """bucket: one row for each segment, without reading more of it than its minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket for text in batch.column(0) for _, _, _, bucket in segments(text.as_buffer().to_pybytes(), window)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["bucket"])

    return map_arrow(texts.select("text"), run, "bucket bigint")


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """uid, piece, part: texts in pieces, with what a segment that starts in one may hold of the next; so that what is looked up in a row is bounded."""
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PIECE)
    numbered = texts.select("uid", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return numbered.select("uid", "piece", F.substring("text", (F.col("piece") * PIECE + 1).cast("int"), F.lit(PIECE + 2 * window)).alias("part"))


def _with_bytes(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """bucket, at, content, copies, bytes of segments (uid, start, n, at, bucket, content, copies)."""
    size = PIECE
    grouped = wanted.groupBy(F.col("uid").alias("of"), F.floor(F.col("start") / size).alias("of_piece")).agg(F.collect_list(F.struct("start", "n", "at", "bucket", "content", "copies")).alias("wanted"))
    pieces = _pieces(texts, window)
    joined = pieces.hint("merge").join(grouped, (pieces["uid"] == grouped["of"]) & (pieces["piece"] == grouped["of_piece"])).select("piece", "part", "wanted")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for piece, part, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = part.as_buffer().to_pybytes()
                cut = [raw[(a := r["start"] - piece * size) : a + r["n"] + window - 1] for r in rows]
                yield [r["bucket"] for r in rows], [r["at"] for r in rows], [r["content"] for r in rows], [r["copies"] for r in rows], cut

    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
    run = lambda batches: _in_batches(found(batches), ["bucket", "at", "content", "copies", "bytes"], types, lambda x: 400 * len(x[0]))
    return map_arrow(joined, run, "bucket bigint, at int, content binary, copies bigint, bytes binary")


_STATE = "shard bigint, buckets binary, ats binary, contents binary, zero int, height int, columns binary, " + ", ".join(f"`{x}` binary" for x, _ in Construction.FIELDS)


def _constructed(strings: DataFrame, n: int, window: int, shard_strings: int) -> DataFrame:
    """bucket, at, content, runs (of repeated windows) of the strings that have any."""
    shards = max(1, -(-n // shard_strings))

    def begin(key: tuple, table: pa.Table) -> pa.Table:
        bucket = np.unique(table["bucket"].to_numpy(), return_inverse=True)[1]
        made = Construction.of_strings(table["bytes"].to_pylist(), table["at"].to_numpy().astype(np.int64), bucket, table["copies"].to_numpy())
        made.insert(window, most)
        names = {"shard": key[0].as_py(), "buckets": table["bucket"].to_numpy().tobytes(), "ats": table["at"].to_numpy().tobytes(), "contents": b"".join(table["content"].to_pylist())}
        return pa.Table.from_pylist([names | made.packed()], schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0].strip("`"), kinds[x.split()[1]]) for x in _STATE.split(", ")])
    most = -(-(2 * window - GRAM) // STAGES)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = Construction.unpacked(row)
                made.insert(window, most)
                yield pa.RecordBatch.from_pylist([row | made.packed()], schema)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                made = Construction.unpacked(row)
                made.insert(window, most)
                runs = made.runs()
                which = np.array(list(runs), np.int64)
                bucket, at, content = np.frombuffer(row["buckets"], np.int64)[which], np.frombuffer(row["ats"], np.int32)[which], [row["contents"][16 * j : 16 * j + 16] for j in runs]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(at), pa.array(content, pa.binary()), pa.array(list(runs.values()), pa.list_(pa.list_(pa.int32())))], ["bucket", "at", "content", "runs"])

    # a file holds a few shards only, so that a batch of its rows is small
    parts = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 8)
    dealt = strings.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards))).repartition(parts, "shard")
    state = materialize(dealt.groupBy("shard").applyInArrow(begin, _STATE), "columns")
    for _ in range(STAGES - 2):  # the first block is inserted before the first table, the last one behind the last
        before, state = state, materialize(map_arrow(state, go_on, _STATE), "columns")
        drop_table(before)
    found = materialize(map_arrow(state, end, "bucket bigint, at int, content binary, runs array<array<int>>"), "runs")
    drop_table(state)
    return found


def _apart(strings: DataFrame, window: int) -> DataFrame:
    """The parts of the strings of too large buckets: bucket, at, content of each, and part_bucket, part_at, part_content, part_low, part_high, shift, bytes, copies.

    Strings agree in `low` bytes before the minimizer and `high` behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw, at, low, high = r["bytes"], r["at"], r["low"], r["high"]
                rest = window - GRAM - low - high
                half = -(-rest // 2)
                least, last = max(0, at + GRAM + high - window), min(at - low, len(raw) - window)  # windows that hold what the strings agree in
                for side, a, z, more in ((0, least, min(last, at - low - half), (low + half, high)), (1, max(least, at + GRAM + high + half - window), last, (low, high + half))):
                    if a <= z:
                        part = raw[a : z + window]
                        core = raw[at - more[0] : at + GRAM + more[1]]
                        bucket = xxhash.xxh64_intdigest(core, r["bucket"] % (1 << 64) ^ side) - (1 << 63)
                        out.append({"bucket": r["bucket"], "at": at, "content": r["content"], "part_bucket": bucket, "part_at": at - a, "part_content": _digest(part), "part_low": more[0], "part_high": more[1], "shift": a, "bytes": part, "copies": r["copies"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("bucket", pa.int64()), ("at", pa.int32()), ("content", pa.binary()), ("part_bucket", pa.int64()), ("part_at", pa.int32()), ("part_content", pa.binary()), ("part_low", pa.int32()), ("part_high", pa.int32()), ("shift", pa.int32()), ("bytes", pa.binary()), ("copies", pa.int64())])
    return map_arrow(strings, run, "bucket bigint, at int, content binary, part_bucket bigint, part_at int, part_content binary, part_low int, part_high int, shift int, bytes binary, copies bigint")


def _solved(strings: DataFrame, window: int, max_bucket: int, shard_strings: int) -> DataFrame:
    """bucket, at, content, runs of strings (bucket, at, content, copies, bytes, low, high) with repeated windows; the table of strings is dropped."""
    key = ["bucket", "at", "content"]
    sizes = strings.groupBy("bucket").agg(F.count(F.lit(1)).alias("different"), F.sum("copies").alias("m"), F.min(F.lit(window - GRAM) - F.col("low") - F.col("high")).alias("rest"))
    # single windows that agree in all bytes are one string
    large = materialize(sizes.where((F.col("different") > max_bucket) & (F.col("rest") > 0)).select(F.col("bucket").alias("large")), "large")
    n = strings.count()
    if large.isEmpty():
        found = _constructed(strings, n, window, shard_strings)
        drop_table(strings)
        return found
    same = strings["bucket"] == large["large"]
    found = _constructed(strings.join(large, same, "left_anti"), n, window, shard_strings)
    parts = materialize(_apart(strings.join(large, same, "left_semi"), window), "parts")
    drop_table(strings)
    smaller = parts.groupBy("part_bucket", "part_at", "part_content").agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"), F.first("part_low").alias("low"), F.first("part_high").alias("high"))
    again = _solved(materialize(smaller.withColumnsRenamed({f"part_{x}": x for x in key}), "strings"), window, max_bucket, shard_strings)
    again = again.select(*[F.col(x).alias(f"of_{x}") for x in key], "runs")
    met = parts.join(again, (F.col("part_bucket") == F.col("of_bucket")) & (F.col("part_at") == F.col("of_at")) & (F.col("part_content") == F.col("of_content")))
    back = met.select(*key, F.transform("runs", lambda r: F.transform(r, lambda x: x + F.col("shift"))).alias("runs")).groupBy(*key).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    out = materialize(found.unionByName(back), "runs")
    drop_table(parts)
    return out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """Disjoint [first, end) spans that cover the same."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _gone(some: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """of, gone: the spans to remove of each text, disjoint and in order; merged within each of its pieces first."""
    size = PIECE
    places = some.join(repeated, (some["bucket"] == repeated["b"]) & (some["at"] == repeated["a"]) & (some["content"] == repeated["c"]))
    spans = F.transform("starts", lambda s: F.transform("runs", lambda r: F.array(s + r[0], s + r[1] + window)))
    places = places.select("uid", F.floor(F.get("starts", F.lit(0)) / size).alias("piece"), F.flatten(spans).alias("spans"))
    pieces = places.groupBy("uid", "piece").agg(F.flatten(F.collect_list("spans")).alias("spans")).select("uid", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_merged(x) for x in part.column(1).to_pylist()], pa.list_(pa.list_(pa.int64())))], ["uid", "spans"])

    kinds = "uid bigint, spans array<array<bigint>>"
    few = map_arrow(pieces, run, kinds).groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return map_arrow(few, run, kinds).select(F.col("uid").alias("of"), F.col("spans").alias("gone"))


def _rest(text: Column, gone: Column) -> Column:
    """The bytes of a text that are in none of the disjoint spans.

    The text is a variable of a lambda, as a column would be copied whole for each span; strings of any bytes are joined as they are.
    """
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(gone, lambda s: s[1]))
    ends = F.concat(F.transform(gone, lambda s: s[0]), F.array(F.length(text).cast("bigint")))
    cut = F.transform(F.array(text), lambda t: F.array_join(F.zip_with(starts, ends, lambda a, z: F.substring(t, (a + 1).cast("int"), (z - a).cast("int")).cast("string")), ""))
    return F.when(F.size(gone) == 0, text).otherwise(cut[0].cast("binary"))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, max_bucket: int = 20_000, shard_strings: int = 5_000) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 of every row.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of `window` bytes that covers it also starts elsewhere, in
    any row, that of a repeated row included; strings are those of the input. n_spans: maximal runs of removed bytes. Texts of fewer bytes
    stay whole. Null ids keep their rows; an empty table gives none; other columns aren't read. max_bucket and shard_strings bound a task's memory and
    change no result.
    """
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} at least")
    spark = docs.sparkSession
    ship(spark)
    with small_batches(spark):
        texts = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), text_of(docs[text_col]).cast("binary").alias("text")), "texts")
        bare = texts.select("uid", "text")
        # counted first and written, so that adaptive execution can split a very common bucket in the join of two tables
        twice = _buckets(bare, window).groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("bucket").alias("again"))
        twice = materialize(twice, "buckets")
        every = _segment_rows(bare, window)
        some = materialize(every.join(twice, every["bucket"] == twice["again"], "left_semi"), "segments")
        wanted = some.groupBy("bucket", "at", "content").agg(F.sum(F.size("starts")).alias("copies"), F.min(F.struct("uid", F.get("starts", F.lit(0)).alias("start"), "n")).alias("one"))
        strings = _with_bytes(bare, wanted.select("one.*", "at", "bucket", "content", "copies"), window)
        strings = materialize(strings.withColumn("low", F.lit(0)).withColumn("high", F.lit(0)), "strings")
        repeated = _solved(strings, window, max_bucket, shard_strings)
    gone = _gone(some, repeated.withColumnsRenamed({"bucket": "b", "at": "a", "content": "c"}), window)
    joined = texts.hint("merge").join(gone, texts["uid"] == gone["of"], "left").select("id", "text", F.coalesce("gone", F.array().cast("array<array<bigint>>")).alias("gone"))
    # no text goes to a worker here: this runs when the result is read, under its reader's settings of batches
    n_removed = F.aggregate("gone", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    rest = joined.select("id", F.length("text").cast("bigint").alias("n_bytes"), n_removed.alias("n_removed"), F.size("gone").cast("bigint").alias("n_spans"), _rest(F.col("text"), F.col("gone")).alias("kept"))
    return rest.withColumn("kept_sha256", F.sha2("kept", 256)).withColumnRenamed("id", id_col)
