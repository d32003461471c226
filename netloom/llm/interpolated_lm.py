"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token w after v mixes maximum-likelihood estimates,

    P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1),

with weights a that depend on the frequency of the context v (a bucket for each power of two). They are learnt by expectation-
maximisation on held-out counts: each training token in turn is deleted from the counts that predict it.

How it runs: texts become blocks of some half a million tokens, a row each, which hold the hashes of the block's words and the tokens
as numbers of these. Each block sends the counts of its distinct words and word pairs, sorted by hash, cut into ranges of the hashes and
compressed; whoever holds a range adds up the counts of the blocks and sends to each the totals of what it asked for. So every
count covers the whole corpus, a common word or pair is one entry of a block however often it stands there, and no
vocabulary is gathered in one place. Were each block to send to each range, rows would grow with the square of the corpus. So beyond
`FAN` blocks the counts go by levels: on each one, up to FAN groups of blocks are added up to one, for at most FAN times narrower ranges, until
one group is left; the totals come back the same way. A block then has a bounded number of rows on each level, and levels grow with
the logarithm. The tables of blocks, of levels and of totals are written to the shared folder.

Words and pairs are known by 64-bit hashes; n-grams are words and pairs of words.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, drop_table, map_arrow, materialize, ship, text_of

BLOCK_TOKENS = 500_000
#: Entries that one shard adds up, about.
SHARD_ENTRIES = 1_000_000
#: Groups of blocks that are added up at once, and ranges that a group's entries are cut into, at most.
FAN = 512
#: Words whose hashes a worker remembers; when full, it starts anew.
CACHE_WORDS = 250_000
BUCKETS = 40
#: Steps of the logarithm of an estimate's ratio to the uniform one, in the held-out counts that expectation-maximisation sees.
STEPS, RATIOS = 4.0, 128

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
#: No word holds a newline.
END = xxhash.xxh64_intdigest(b"\n", 42)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = found
        return found


_hashes = _Hashes()


def token_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words, A-Z lower-cased, and of the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_hashes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; the first of a text stands after an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = END
    x = before * _K[0] + (tokens << np.uint64(32) | tokens >> np.uint64(32)) * _K[1]
    x ^= x >> np.uint64(32)
    x *= _K[2]
    return x ^ x >> np.uint64(29)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers compressed, the bytes of like weight together."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Block:
    """The tokens of some documents, as numbers of their distinct words in the order of frequency."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.words, self.tokens, self.sizes, self.train = words, tokens, sizes, train
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.token_train = np.repeat(train, sizes)

    @staticmethod
    def of_texts(hashes: list[np.ndarray], train: list[bool]) -> Block:
        words, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        return Block(words[order], rank[tokens], np.array([len(x) for x in hashes], np.int64), np.array(train, bool))

    def entries(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of an order, sorted by hash; their counts in training texts; and the entry of each token."""
        if order == 1:
            by_hash = np.argsort(self.words)
            place = np.empty(len(by_hash), np.int64)
            place[by_hash] = np.arange(len(by_hash))
            found, inverse = self.words[by_hash], place[self.tokens]
        else:
            found, inverse = np.unique(pair_hashes(self.words[self.tokens], self.starts), return_inverse=True)
        return found, np.bincount(inverse, self.token_train, len(found)).astype(np.uint32), inverse


def blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int) -> DataFrame:
    """block, ids, sizes, train, words, tokens, n: a row for some BLOCK_TOKENS tokens of whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        hashes: list[np.ndarray] = []
        train: list[bool] = []

        def row() -> pa.RecordBatch:
            made = Block.of_texts(hashes, train)
            flat = pa.concat_arrays(ids)
            columns = [
                pa.array([secrets.randbits(62)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([made.sizes.tolist()], pa.list_(pa.int64())),
                pa.array([train], pa.list_(pa.bool_())), pa.array([pack(made.words)], pa.binary()), pa.array([pack(made.tokens.astype(np.uint32))], pa.binary()), pa.array([len(made.tokens)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "train", "words", "tokens", "n"])

        total = 0
        for batch in batches:
            for i, (text, learn) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                found = token_hashes(text.as_py())
                if total and total + len(found) > BLOCK_TOKENS:
                    yield row()
                    ids, hashes, train, total = [], [], [], 0
                ids.append(batch.column(0).slice(i, 1))
                hashes.append(found)
                train.append(learn)
                total += len(found)
        if hashes:
            yield row()

    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"), (crc_fold(docs[id_col], folds) != held_out).alias("train"))
    return map_arrow(rows, run, f"block bigint, ids array<{kind}>, sizes array<bigint>, train array<boolean>, words binary, tokens binary, n bigint")


def _block(row: dict) -> Block:
    return Block(unpack(row["words"], np.uint64), unpack(row["tokens"], np.uint32).astype(np.int64), np.array(row["sizes"], np.int64), np.array(row["train"], bool))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def levels(n_blocks: int, n_shards: int) -> tuple[int, int, int]:
    """Levels, groups of blocks that are added up to one on each, and ranges that entries are cut into on each."""
    fan = max(2, FAN)
    count = 1
    while fan**count < max(n_blocks, n_shards):
        count += 1
    root = lambda n: next(x for x in range(1, fan + 1) if x**count >= n)
    return count, root(n_blocks), root(n_shards)


_NODE = "node bigint, prefix bigint, order int"
_PIECE = f"{_NODE}, digit bigint, hashes binary, counts binary, to bigint, to_prefix bigint"
_ANSWER = f"{_NODE}, digit bigint, payload binary, distinct_n bigint, total bigint"


def _block_nodes(table: DataFrame) -> DataFrame:
    """node, prefix, order, hashes, counts: the entries of each block, in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(row)
            for order in (1, 2):
                found, counts, _ = block.entries(order)
                yield pa.RecordBatch.from_pylist([{"node": row["block"], "prefix": 0, "order": order, "hashes": pack(np.diff(found, prepend=np.uint64(0))), "counts": pack(counts.astype(np.uint64))}], pa.schema([("node", pa.int64()), ("prefix", pa.int64()), ("order", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    return map_arrow(table.select("block", "sizes", "train", "words", "tokens"), run, f"{_NODE}, hashes binary, counts binary")


def _pieces(nodes: DataFrame, level: int, groups: int, ranges: int, rest: int) -> DataFrame:
    """The entries of each node, cut into ranges of their hashes; to, to_prefix: the node that they are added up in."""
    shards = ranges ** (level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found, counts = np.cumsum(unpack(row["hashes"], np.uint64), dtype=np.uint64), unpack(row["counts"], np.uint64)
            prefix = _shard(found, shards)
            which, at = np.unique(prefix, return_index=True)
            cuts = [*at.tolist(), len(found)]
            n = len(which)
            columns = [
                pa.array([row["node"]] * n, pa.int64()), pa.array([row["prefix"]] * n, pa.int64()), pa.array([row["order"]] * n, pa.int32()), pa.array(which % ranges, pa.int64()),
                pa.array([pack(np.diff(found[a:b], prepend=np.uint64(0))) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([pack(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([row["node"] % groups**rest] * n, pa.int64()), pa.array(which, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PIECE.split(", ")])

    return map_arrow(nodes, run, _PIECE)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The range, of so many equal ones (below 2^24), of each hash; a range is cut into whole ranges where shards is multiplied."""
    return ((hashes >> np.uint64(24)) * np.uint64(shards) >> np.uint64(40)).astype(np.int64)


def _added(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the pieces, their total counts, the place of each entry among them, and where each piece's entries begin."""
    hashes = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in group["hashes"]]
    found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(found), np.uint64)
    np.add.at(total, inverse, np.concatenate([unpack(x, np.uint64) for x in group["counts"]]))
    return found, total, inverse, np.cumsum([0, *map(len, hashes)])


def _answers(group: pd.DataFrame, total: np.ndarray, inverse: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
    out = group[["node", "prefix", "order", "digit"]].copy()
    out["payload"] = [pack(total[inverse[a:b]]) for a, b in zip(cuts, cuts[1:])]
    out["distinct_n"] = out["total"] = 0
    return out


def totals(nodes: DataFrame, count: int, groups: int, ranges: int, level: int = 0) -> DataFrame:
    """node, prefix, order, digit, payload: the corpus-wide training counts of the entries of each node; node -1: distinct, total of a range."""
    pieces = _pieces(nodes, level, groups, ranges, count - 1 - level)
    if level == count - 1:

        def add(group: pd.DataFrame) -> pd.DataFrame:
            _, total, inverse, cuts = _added(group)
            own = pd.DataFrame({"node": [-1], "prefix": [0], "order": group["order"].iloc[:1].to_numpy(), "digit": [0], "payload": [b""], "distinct_n": [int((total > 0).sum())], "total": [int(total.sum())]})
            return pd.concat([_answers(group, total, inverse, cuts), own])

        return pieces.groupBy("to", "to_prefix", "order").applyInPandas(add, _ANSWER)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found, total, _, _ = _added(group)
        return pd.DataFrame({"node": [key[0]], "prefix": [key[1]], "order": [key[2]], "hashes": [pack(np.diff(found, prepend=np.uint64(0)))], "counts": [pack(total)]})

    def give(asked: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return answered[["node", "prefix", "order", "digit", "payload", "distinct_n", "total"]]  # of a range
        _, _, inverse, cuts = _added(asked)
        total = np.concatenate([unpack(x, np.uint64) for x in answered.sort_values("digit")["payload"]])
        return _answers(asked, total, inverse, cuts)

    pieces = materialize(pieces, f"pieces-{level}")
    merged = pieces.groupBy("to", "to_prefix", "order").applyInPandas(merge, f"{_NODE}, hashes binary, counts binary")
    merged = materialize(merged, f"merged-{level}")
    above = materialize(totals(merged, count, groups, ranges, level + 1), f"answers-{level}")
    drop_table(merged)
    return pieces.groupBy("to", "to_prefix", "order").cogroup(above.groupBy("node", "prefix", "order")).applyInPandas(give, _ANSWER)


def _looked_up(row: dict) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """A block, and for each token c(w), c(v), c(v w) in all training texts."""
    block = _block(row)
    counts = {order: np.concatenate([unpack(x["payload"], np.uint64) for x in sorted((x for x in row["found"] if x["order"] == order), key=lambda x: x["digit"])]).astype(np.float64) for order in (1, 2)}
    found, _, inverse = block.entries(1)
    own = counts[1][inverse]
    at = np.searchsorted(found, np.uint64(END))
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[block.starts] = counts[1][at]
    return block, own, before, counts[2][block.entries(2)[2]]


def bucket(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 for none, else one for each power of two."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _ratio_cell(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else the step of the logarithm of a ratio, which runs from about e^-8 to e^23."""
    step = np.round(np.log(np.maximum(ratio, 1e-300)) * STEPS) + 33
    return np.where(ratio > 0, np.clip(step, 1, RATIOS - 1), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """BUCKETS x 3 weights (uniform, one word, two words) that fit held-out counts best; buckets with few counts lean to all the others."""
    where, pair, single = cells // RATIOS**2, cells // RATIOS % RATIOS, cells % RATIOS
    value = lambda c: np.where(c > 0, np.exp((c - 33) / STEPS), 0.0)
    p = np.stack([np.ones(len(cells)), value(single), value(pair)], axis=1)
    shared = np.array([0.1, 0.5, 0.4])
    weights = np.tile(shared, (BUCKETS, 1))
    for step in range(2 * rounds):
        now = weights[where] if step >= rounds else np.tile(shared, (len(cells), 1))
        post = now * p
        post *= (counts / post.sum(axis=1))[:, None]
        if step < rounds:
            shared = post.sum(axis=0) / post.sum() if len(cells) else shared
            weights[:] = shared
        else:
            gathered = np.stack([np.bincount(where, post[:, i], BUCKETS) for i in range(3)], axis=1) + 10 * shared
            weights = gathered / gathered.sum(axis=1, keepdims=True)
    weights = np.maximum(weights, 1e-6)
    weights[0, 2] = 0  # a context that never occurs predicts nothing
    return weights / weights.sum(axis=1, keepdims=True)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are words and one end of each text; training texts are those whose crc32(id as text) mod folds isn't held_out. base_score is that of
    add-one single words, score the log10 probability by the interpolated model. Null texts count as empty (the end alone), null ids as the
    empty id; repeated rows count each and give a row each; an empty table gives none. Without any training text, estimates are uniform.
    Other columns aren't read. A shard holds SHARD_ENTRIES entries or so, a block BLOCK_TOKENS tokens unless one text has more.
    """
    spark = docs.sparkSession
    ship(spark)
    table = materialize(blocks(docs, id_col, text_col, folds, held_out), "blocks")
    n, n_blocks = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    found = materialize(totals(_block_nodes(table), *levels(n_blocks, max(1, -(-n // SHARD_ENTRIES)))), "totals")
    distinct, tokens = found.where("node = -1 and order = 1").agg(F.coalesce(F.sum("distinct_n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    answers = found.where("node <> -1").groupBy("node").agg(F.collect_list(F.struct("order", "digit", "payload")).alias("found")).withColumnRenamed("node", "asked")
    joined = materialize(table.join(answers, table["block"] == answers["asked"]).drop("asked", "block", "n"), "looked-up")
    drop_table(found)
    drop_table(table)
    uniform = 1 / (distinct + 1)

    def hold_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, own, before, pair = _looked_up(row)
            keep = block.token_train
            own, before, pair = own[keep] - 1, before[keep] - 1, pair[keep] - 1
            cell = (bucket(before) * RATIOS + _ratio_cell(np.where(before > 0, pair / np.maximum(before, 1), 0) / uniform)) * RATIOS + _ratio_cell(own / max(1, tokens - 1) / uniform)
            cells, counts = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.astype(np.int64))], ["cell", "n"])

    # the cells are bounded by BUCKETS * RATIOS ** 2, whatever the corpus
    cells = map_arrow(joined, hold_out, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    weights = learn_weights(np.array([x["cell"] for x in cells], np.int64), np.array([x["n"] for x in cells], np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_rows([batch])):
                block, own, before, pair = _looked_up(row)
                mix = weights[bucket(before)]
                p = mix[:, 0] * uniform + mix[:, 1] * own / max(1, tokens) + mix[:, 2] * np.where(before > 0, pair / np.maximum(before, 1), 0)
                total = lambda x: np.add.reduceat(x, block.starts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(batch.schema.get_field_index("ids"))[i].values, pa.array(~block.train), pa.array(block.sizes), pa.array(total((own > 0).astype(np.int64))), pa.array(np.full(len(block.sizes), tokens, np.int64)),
                    pa.array(total(np.log10((own + 1) / (tokens + distinct + 1)))), pa.array(total(np.log10(p))),
                ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(joined, score, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
