"""Helpers that the operators share: text defaults, crc folds, and the library's tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import drop_table, map_arrow, materialize, ship, small_batches

__all__ = ["SPACE", "crc_fold", "drop_table", "map_arrow", "materialize", "parts", "ship", "small_batches", "text_of"]

#: The white space of the word definition `[^\x20\x09-\x0D]+`, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def text_of(column: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows: a worker's copies of texts, and what the executor reads back, are as large as a part, not as a batch of 10,000 texts."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
