"""Byte-pair encoding and decoding of whole texts, exact to the definition file of a word BPE.

Each short word holds its symbols and, beside them in one contiguous array, the rank of each adjacent pair. The array is
scanned for its minimum (the first one on ties), the boundary there is deleted, and the ranks of the two neighbours are
looked up anew, until no pair has a rank. Words of more than `LONG_WORD` symbols, where scanning would cost the square of
their length, take the same merges in the same order from a heap.

Words between white space are looked up in a cache of bounded size first, as merges never cross white space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .common import map_arrow, parts, text_of

#: Above this many symbols a word's merges come from a heap.
LONG_WORD = 128
#: Words kept with their ids by a worker; when full, the cache starts anew.
CACHE_WORDS = 300_000

_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the definition
_WORDS = regex.compile(r"[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_RANK = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder for the text of a tokenizers .json file: NFC, white space, lower case, Split, ByteLevel, BPE with word ends."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        before = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or before != ["Split", "ByteLevel"] or spec.get("decoder") is not None:
            raise ValueError("this kind of definition isn't supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.hints = sorted({x[:2] for x in self.added})  # no added token is in a text that holds none of these
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = [vocab[x] for x in symbols]
        self.final = [vocab[x + end] for x in symbols]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge_word(self, parts: list[int]) -> list[int]:
        """Merge the symbols of one word, in place."""
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        pairs = self.pairs
        none = (_NO_RANK, -1)
        ranks = [pairs.get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least is none:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = pairs.get(parts[i] << 20 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, found[1], parts[i], parts[i + 1]) for i in range(n - 1) if (found := pairs.get(parts[i] << 20 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (found := pairs.get(parts[x] << 20 | parts[y])):
                    heapq.heappush(heap, (found[0], x, found[1], parts[x], parts[y]))
        return [x for x in parts if x >= 0]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a text without white space and added tokens."""
        chunk = "".join(x.lower() for x in unicodedata.normalize("NFC", chunk)) if not chunk.isascii() else chunk.lower()
        out: list[int] = []
        for word in self.words.findall(chunk):
            raw = word.encode()
            parts = [self.inner[b] for b in raw[:-1]]
            # the end of a word belongs to its last character, whose bytes but the last are symbols of their own
            parts.append(self.final[raw[-1]])
            out += self.merge_word(parts)
        return tuple(out)

    def _plain(self, text: str, out: list[int]) -> None:
        """Add the ids of a text without added tokens."""
        cache = self.cache
        if text.isascii():
            text = text.lower()  # as each word would be; fewer words are new to the cache
        for chunk in _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split():
            if (ids := cache.get(chunk)) is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                ids = self._chunk(chunk)
                if len(chunk) <= 64:
                    cache[chunk] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; the strings of added tokens in it are those tokens, as by the library's default."""
        out: list[int] = []
        if any(x in text for x in self.hints):
            for i, part in enumerate(self.split_added.split(text)):
                if i % 2:
                    out.append(self.added[part])
                else:
                    self._plain(part, out)
        else:
            self._plain(text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text for ids where the definition names no decoder: the tokens, joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[int, WordBPE] = {}


def load(definition: str) -> WordBPE:
    key = hash(definition)
    if key not in _loaded:
        _loaded[key] = WordBPE(definition)
    return _loaded[key]


def _over_texts(docs: DataFrame, tokenizer_json: str, text_col: str, added: str, make, keep: bool = True) -> DataFrame:
    """docs with the columns that make gives for its texts; keep: with text_col. Texts go to the workers once, and come back only if kept."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: bounded, 1.7 MB here
    names = docs.columns
    at = names.index(text_col)
    kept = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = kept.schema.fields[at].dataType == StringType()
    rows = kept if plain else kept.withColumn("whole_text", text_of(kept[f"c{at}"]))
    source, shown = at if plain else len(names), [i for i in range(len(names)) if keep or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for batch in batches:
            for part in parts(batch):
                columns = [*[part.column(i) for i in shown], *make(bpe, [x or "" for x in part.column(source).to_pylist()])]
                yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    fields = ", ".join(f"c{i} {kept.schema.fields[i].dataType.simpleString()}" for i in shown)
    out = map_arrow(rows, run, f"{fields}, {added}")
    return out.toDF(*[names[i] for i in shown], *[x.split()[0] for x in added.split(", ")])


def encode_texts(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """docs with ids array<int>, the tokens of text_col, and decoded string, the text of those ids.

    A null text counts as empty: no ids, an empty decoded text. Other columns and repeated rows are kept as they are, but for columns
    named ids or decoded, which the new ones replace. An empty table gives an empty one.
    """
    docs = docs.drop(*[x for x in ("ids", "decoded") if x != text_col])

    def make(bpe: WordBPE, texts: list[str]) -> list[pa.Array]:
        ids = [bpe.encode(x) for x in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())]

    return _over_texts(docs, tokenizer_json, text_col, "ids array<int>, decoded string", make)


def digest_texts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded text) of every row.

    Encodes and decodes as encode_texts does, but ships digests rather than the ids. Null texts count as empty; null ids and
    repeated rows give a row each; other columns are not read.
    """
    def make(bpe: WordBPE, texts: list[str]) -> list[pa.Array]:
        counts, ids_sha, text_sha = [], [], []
        for x in texts:
            ids = bpe.encode(x)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    text = f"text of {id_col}"
    rows = docs.select(docs[id_col], docs[text_col].alias(text))
    return _over_texts(rows, tokenizer_json, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, keep=False)
