"""Sinks: label files by split, class names, manifests, ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines as Parquet parts by split, with their file and line number; one file for each picture would not scale."""
    labels.write.partitionBy("split").mode("errorifexists").parquet(path)


def write_label_text(labels: DataFrame, path: str) -> None:
    """Label lines (stem, line_no, line) as text, a folder stem=... with one file for each picture, in the order of line_no: for trainers that want such files."""
    rows = labels.repartition("stem").sortWithinPartitions("stem", "line_no")
    rows.select("stem", F.col("line").alias("value")).write.partitionBy("stem").mode("errorifexists").option("lineSep", "\n").text(path)


def write_document(row: DataFrame, path: str, ending: str) -> None:
    """The one row (value) of a dimension as a text file of this ending, written by Spark and renamed in its store."""
    row.coalesce(1).write.mode("errorifexists").text(path)
    spark = row.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/part-*.txt")):
        store.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"data{ending}"))


def write_manifest(moves: DataFrame, path: str) -> None:
    moves.write.mode("errorifexists").option("header", "true").csv(path)


def write_ordered_text(lines: DataFrame, path: str, order: list[str]) -> None:
    """One text file with \\n ends, in this order: a deck or drawing of one picture."""
    lines.orderBy(*order).select("text").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)


def names_yaml(vocabulary: DataFrame) -> DataFrame:
    """One row, text: the data.yaml of a vocabulary (name, id), a dimension of some hundred rows."""
    names = F.array_sort(F.collect_list(F.struct("id", "name")))
    quoted = F.transform(F.col("v"), lambda x: F.concat(F.lit("'"), x["name"], F.lit("'")))
    return vocabulary.agg(names.alias("v")).select(F.concat(F.lit("nc: "), F.size("v").cast("string"), F.lit("\nnames: ["), F.concat_ws(", ", quoted), F.lit("]\n")).alias("text"))
