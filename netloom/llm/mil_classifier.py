"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Each passage is encoded by a fixed vector (hashed words and word shapes,
kinds of bytes, word length, variety, repetition), and a learned layer turns it into h = tanh(x W + b). Gated attention gives each passage
the weight a = softmax((tanh(h V) * sigmoid(h U)) w) within its document, and the score is the logistic value of the
weighted sum of the h. Only labels of documents train all of it, by Adam on the logistic loss, on a bounded sample; every
passage of every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import crc_fold, map_arrow, parts, text_of

PASSAGE_WORDS = 100
WORD_BUCKETS, SHAPE_BUCKETS, BYTE_KINDS = 64, 48, 9
WIDTH = WORD_BUCKETS + SHAPE_BUCKETS + BYTE_KINDS + 4
#: Words whose buckets a worker remembers; when full, it starts anew.
CACHE_WORDS = 300_000


def _kinds() -> bytes:
    """For each byte its kind: a small letter, A capital, 0 digit, . , ! ? ' " ( ) - :;, # other signs, e beyond ASCII, _ control."""
    out = bytearray(b"_" * 256)
    for b in range(256):
        c = chr(b)
        out[b] = ord("e") if b > 127 else ord("a") if c.islower() else ord("A") if c.isupper() else ord("0") if c.isdigit() else ord(".") if c in ".,;:'\"()-" else ord("!") if c in "!?" else ord("|") if c in "|/\\" else ord("#") if 32 < b < 127 else ord("_")
    return bytes(out)


_KIND = _kinds()
_KIND_NUMBER = np.zeros(256, np.int64)
for _i, _c in enumerate(b"aA0.!|#e_"):
    _KIND_NUMBER[np.frombuffer(_KIND, np.uint8) == _c] = _i
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Buckets(dict):
    """word -> word bucket and sign, and shape bucket, in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = zlib.crc32(word.lower())
        shape = zlib.crc32(_RUN.sub(rb"\1", word.translate(_KIND))) % SHAPE_BUCKETS
        found = (h >> 8) % WORD_BUCKETS << 16 | (h & 1) << 8 | shape
        if len(word) <= 64:
            self[word] = found
        return found


_buckets = _Buckets()


def encode_passages(text: str) -> np.ndarray:
    """A row of WIDTH figures for each passage of a whole text; one row of zeros for a text without words."""
    words = text.encode().split()
    n = len(words)
    count = max(1, -(-n // PASSAGE_WORDS))
    out = np.zeros((count, WIDTH), np.float32)
    if not n:
        return out
    found = np.fromiter(map(_buckets.__getitem__, words), np.int64, n)
    passage = np.arange(n) // PASSAGE_WORDS
    size = np.bincount(passage, minlength=count).astype(np.float32)
    sign = 1.0 - 2.0 * (found >> 8 & 1)
    out[:, :WORD_BUCKETS] = np.bincount(passage * WORD_BUCKETS + (found >> 16), sign, count * WORD_BUCKETS).reshape(count, -1) / np.sqrt(size)[:, None]
    shapes = np.bincount(passage * SHAPE_BUCKETS + (found & 255), minlength=count * SHAPE_BUCKETS).reshape(count, -1)
    out[:, WORD_BUCKETS : WORD_BUCKETS + SHAPE_BUCKETS] = 4 * shapes / size[:, None]
    at = WORD_BUCKETS + SHAPE_BUCKETS
    for i in range(count):
        part = words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS]
        whole = b"".join(part)
        out[i, at : at + BYTE_KINDS] = 4 * np.bincount(_KIND_NUMBER[np.frombuffer(whole, np.uint8)], minlength=BYTE_KINDS) / len(whole)
        out[i, at + BYTE_KINDS :] = len(whole) / len(part) / 8, len(set(part)) / len(part), len(part) / PASSAGE_WORDS, 4 * sum(map(eq, part, part[1:])) / len(part)
    return out


@dataclass
class Model:
    """Weights of the passage layer, the gated attention and the document layer."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int, gate: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Model({"W": draw(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "c0": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """Logits of the bags that begin at rows starts of x, and what the gradients need."""
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z @ p["c"] + p["c0"], (h, t, s, a, z, bag)

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        logits, _ = self.forward(x, starts)
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        logits, (h, t, s, a, z, bag) = self.forward(x, starts)
        d = ((1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y) * weight / weight.sum()).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = np.einsum("ij,ij->i", dz[bag], h)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "c0": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit to bags (passages x WIDTH) and their labels 0 or 1; both classes weigh the same."""
    model = Model.fresh(hidden, gate, seed)
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = [len(bags[i]) for i in chosen]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            found = model.gradients(np.concatenate([bags[i] for i in chosen]).astype(np.float32), starts, y[chosen], weight[chosen])
            step += 1
            for k, g in found.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + decay * model.weights[k])
    return model


def sample_labels(labels: DataFrame, label_col: str, id_col: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """At most per_class ids of either label outside the held-out fold, in the order of a hash of the id. An id with several labels has the least."""
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and id is not null")
    rows = rows.where(crc_fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.min("label").alias("label"))
    return rows.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(per_class).unionByName(rows.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(per_class))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, per_class: int = 2_000) -> Model | None:
    """A model learnt from every passage of a sample of at most per_class labelled documents of each class.

    The bound concerns training alone; of several rows of one id that of the least text hash is taken. None if there are no labelled documents of both classes.
    """
    sample = sample_labels(labels, label_col, id_col, folds, held_out, per_class)
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    chosen = texts.join(F.broadcast(sample), "id")  # at most 2 * per_class rows of two numbers
    # of the rows of one id one, so that as many rows come to the driver at most
    chosen = chosen.groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode_passages(text).astype(np.float16).tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "label", "x"])

    rows = map_arrow(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, label int, x binary").collect()
    rows.sort(key=lambda r: (str(r["id"]), bytes(r["x"])))
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return train([np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH) for r in rows], y)


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1, keep: bool = False) -> DataFrame:
    """id_col, held_out, score, predicted of every row, from the passages of its whole text; keep: all columns of docs, and score.

    Null texts count as empty and are scored as a document of one empty passage. Without a model every score is 0.5. Repeated rows
    and null ids give rows of their own. Other columns aren't read unless kept; then one named score is replaced by the new one.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights if model else None)  # some 30 kB

    names = [x for x in docs.columns if x != "score" or x in (id_col, text_col)] if keep else [id_col]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    # a kept text goes to the workers once
    own = text_col in names and plain.schema[place[text_col]].dataType == StringType()
    source = names.index(text_col) if own else len(names)
    rows = plain.select(*[plain[place[x]] for x in names], *([] if own else [text_of(plain[place[text_col]]).alias("whole_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(weights.value) if weights.value else None
        for batch in batches:
            for part in parts(batch):
                scores: list[float] = []
                texts = [x or "" for x in part.column(source).to_pylist()]
                for at in range(0, len(texts), 32):
                    bags = [encode_passages(x) for x in texts[at : at + 32]]
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]).astype(np.int64)
                    scores += held.score(np.concatenate(bags), starts).tolist() if held else [0.5] * len(bags)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores, pa.float64())], [str(i) for i in range(len(names) + 1)])

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields[: len(names)])
    out = map_arrow(rows, run, f"{schema}, score double").toDF(*names, "score")
    if keep:
        return out
    return out.select(id_col, (crc_fold(F.col(id_col), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
