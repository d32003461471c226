"""Token counts of whole texts, also of huge ones: overlapping chunks, encoded with offsets and spliced where both encodings agree.

A text of more than `chunk_chars` characters is cut into chunks, each of which starts `overlap` characters before the end of the one before.
Two neighbouring chunks are spliced at a boundary that

* both encodings have,
* is preceded in both by the same `agree` tokens at the same offsets, and
* stands right before a white-space character of the text and behind another character.

The last point is the proof of stability: the definitions that are spliced (see way_of) give the text before and the text after such a boundary the
same tokens whether or not the other is there. Where a chunk has no
such boundary the overlap is doubled, in the end up to the whole of the chunk before, so that a text without any white
space is encoded in one piece.

Shorter texts have no need of that. Where no token crosses white space they fall apart there, and the library encodes each of
their words that the worker has not met before; otherwise it encodes the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, text_of

#: A boundary before one of these is stable.
BREAKS = frozenset(" \t\n\r\x0b\x0c")

#: Words whose token counts a worker remembers; when full, it starts anew.
CACHE_WORDS = 800_000
#: White space to str.split, but not to the tokenizers: texts with it are encoded whole.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")

_loaded: dict[int, object] = {}
_counts: dict[int, dict[str, int]] = {}


def load(definition: str):
    """The library's tokenizer for the text of a .json file; kept by worker, without its own threads, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(definition)
    if key not in _loaded:
        made = Tokenizer.from_str(definition)
        made.no_truncation()
        made.no_padding()
        _loaded[key] = made
    return _loaded[key]


def way_of(spec: dict) -> str:
    """How texts may fall apart under a definition: "words" at any white space, "spaced" between a word and the space behind it, or "whole" not at all.

    words: texts are normalised by NFC, small letters and white space to one space, and split into words without white space, as by word_bpe_49k.json.
    spaced: byte-level pieces with the usual pattern and no normaliser, as by byte_bpe_50k.json; a piece begins with its space. Nothing is
    known about other definitions, nor where an added token takes white space along: their texts are encoded whole, however long.
    """
    if any(x.get(k) for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or any(y.isspace() for x in spec["added_tokens"] for y in x["content"]) or spec["model"]["type"] != "BPE":
        return "whole"
    steps = (spec["normalizer"] or {}).get("normalizers") or ([spec["normalizer"]] if spec["normalizer"] else [])
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps)
    before = spec["pre_tokenizer"] or {}
    first, *rest = before.get("pretokenizers") or [before]
    if plain and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"] and all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in rest):
        pattern = regex.compile(first["pattern"]["Regex"])
        if not any(y.isspace() for a in "a1.\u00e9" for space in (" ", "\n", "\t", "  ", "\xa0") for b in "a1.\u00e9" for x in pattern.finditer(a + space + b) for y in x[0]):
            return "words"
    if not steps and not rest and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return "spaced"
    return "whole"


def _common_boundary(text: str, left, right, start: int, agree: int) -> tuple[int, int, int] | None:
    """The last stable boundary of two (offset, encoding) chunks: its place in the text, tokens before it left and right."""
    (a0, a), (b0, b) = left, right
    ends = {b0 + end: i + 1 for i, (_, end) in enumerate(b.offsets)}
    for i in range(len(a.ids), 0, -1):
        at = a0 + a.offsets[i - 1][1]
        if at <= max(b0, start):
            return None
        j = ends.get(at)
        if j is None or at >= len(text) or text[at] not in BREAKS or text[at - 1].isspace():
            continue
        n = min(agree, i)
        if j >= n and a.ids[i - n : i] == b.ids[j - n : j] and all(a0 + x[0] == b0 + y[0] for x, y in zip(a.offsets[i - n : i], b.offsets[j - n : j])):
            return at, i, j
    return None


def spliced_ids(encode, text: str, chunk_chars: int = 16_384, overlap: int = 256, agree: int = 4) -> list[int]:
    """The ids of a whole text from chunks of it. encode(str) gives an object with ids and offsets, as the library does."""
    if overlap < 1 or chunk_chars <= overlap:
        raise ValueError("0 < overlap < chunk_chars is needed")
    if len(text) <= chunk_chars:
        return list(encode(text).ids)
    ids: list[int] = []
    a0, a1 = 0, chunk_chars
    left, taken, spliced = (a0, encode(text[a0:a1])), 0, 0  # taken: left's tokens that stand before the last splice
    while a1 < len(text):
        width, end = overlap, min(len(text), a1 + chunk_chars - overlap)
        while True:
            b0 = max(spliced, a1 - width)
            right = (b0, encode(text[b0:end]))
            if b0 == spliced:  # widened to the last splice: the new chunk replaces the one before
                left, taken = right, 0
                break
            if found := _common_boundary(text, left, right, spliced, agree):
                spliced, i, j = found
                ids += left[1].ids[taken:i]
                left, taken = right, j
                break
            width *= 2
        a1 = end
    return ids + left[1].ids[taken:]


def _small_letters(text: str, added: list[str]) -> str:
    """An ASCII text in small letters, unless that could make one of the added tokens (in small letters here) of it."""
    low = text.lower()
    return text if any(x in low for x in added) else low


def word_counts(tokenizer, texts: list[str], known: dict[str, int], added: list[str] | None = None) -> list[int]:
    """The tokens of each text, as the sum over its words; known: the counts of words so far, to which new ones are added.

    added: the tokenizer makes small letters, and these are its added tokens in small letters. Capitals then go first, so that fewer words are new.
    """
    split = [(_small_letters(x, added) if added is not None and x.isascii() else x).split() if not _ODD_SPACE.search(x) else [x] for x in texts]
    new = list(set().union(*split) - known.keys())
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = list(set().union(*split))
    for at in range(0, len(new), 4_096):
        part = new[at : at + 4_096]
        known.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False))))
    out = [sum(map(known.__getitem__, words)) for words in split]
    for w in new:
        if len(w) > 64:
            del known[w]
    return out


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = 16_384, overlap: int = 256) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    tokenizer_json: the definition itself, not a path, so that executors need no file; its way_of decides how texts are encoded. Null texts count as empty (0 bytes, 0 tokens);
    null ids stay null; repeated rows give a row each; an empty table gives none. Other columns, whatever their names, are not read.
    Memory in a task is that of an Arrow batch of texts and of two chunks, unless a text has no white space or the definition asks for whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: bounded, 1.7 MB here

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared.value)
        known = _counts.setdefault(hash(shared.value), {})
        spec = json.loads(tokenizer.to_str())
        kinds = [x["type"] for x in ((spec["normalizer"] or {}).get("normalizers") or [spec["normalizer"] or {"type": ""}])]
        added = [x["content"].lower() for x in spec["added_tokens"]] if "Lowercase" in kinds else None
        encode = lambda x: tokenizer.encode(x, add_special_tokens=False)
        way = way_of(spec)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            short = [i for i, x in enumerate(texts) if len(x) <= chunk_chars]
            counts = [0] * len(texts)
            for at in range(0, len(short), 256):
                part = short[at : at + 256]
                held = [texts[i] for i in part]
                for i, n in zip(part, word_counts(tokenizer, held, known, added) if way == "words" else map(len, tokenizer.encode_batch_fast(held, add_special_tokens=False))):
                    counts[i] = n
            for i, x in enumerate(texts):
                if len(x) > chunk_chars:
                    counts[i] = len(encode(x).ids if way == "whole" else spliced_ids(encode, x, chunk_chars, overlap))
            n_bytes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
