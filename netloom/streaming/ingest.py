"""Label ingest as a stream, an extension: counts of issues by window of arrival, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_issue


def issue_counts(lines: DataFrame, n_classes: int, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, issue (ok without one), n of a stream or table of label lines (time, line)."""
    rows = lines.select(time, F.coalesce(label_issue(F.col("line"), n_classes), F.lit("ok")).alias("issue"))
    rows = rows.withWatermark(time, late) if lines.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), "issue").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "issue", "n")
