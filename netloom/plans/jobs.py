"""Whole dataset jobs as one plan each: conversion, merge, audit, fold, re-split, freeze, publication guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import etl


def converted_coco(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """file_name, stem, split, line of COCO boxes (see sources.coco_boxes); boxes without area and unknown categories go. classes: cls, new_id."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    rows = etl.remapped(boxes.withColumnRenamed("category", "cls"), classes)
    line = tx.yolo_line(F.col("new_id"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return rows.select("file_name", stem.alias("stem"), tx.split_of(tx.sha1_bucket(stem), 80, 10).alias("split"), line.alias("line")).where("line is not null")


def merged(files: DataFrame, labels: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (dataset, split, name, content), labels (dataset, split, name, class_name, ...): the vocabulary, label rows with new ids of files that stay, statistics.

    Of files of the same content the first by dataset, split and name in small letters stays. Files are told apart by dataset, split and name. A null in one of these is
    a name of its own; files of null content are equal to empty ones.
    """
    key = ["dataset", "split", "name"]
    keyed = files.withColumn("lower_name", F.lower("name")).withColumn("content", F.coalesce(F.col("content").cast("binary"), F.lit(b"")))
    first = etl.first_by_content(keyed, "content", ["dataset", "split", "lower_name", "name"]).select(*key).distinct()
    first = first.toDF(*[f"first_{x}" for x in key])
    same = lambda rows: rows["dataset"].eqNullSafe(first["first_dataset"]) & rows["split"].eqNullSafe(first["first_split"]) & rows["name"].eqNullSafe(first["first_name"])
    bare = keyed.select(*key)
    marked = bare.join(first.withColumn("is_first", F.lit(True)), same(bare), "left").select("dataset", F.coalesce("is_first", F.lit(False)).alias("is_first"))
    named = etl.canonical(labels.join(first, same(labels), "left_semi"), "class_name", aliases)
    vocabulary = etl.vocabulary(named, "canonical")
    return vocabulary, named.join(vocabulary, "canonical"), etl.merge_stats(marked)


def audit(images: DataFrame, labels: DataFrame, classes: DataFrame, n_classes: int) -> dict[str, DataFrame]:
    """The tables of an audit of images (stem, split, source, name) and label lines (stem, line): histogram, support, leaks, sources, issues, missing."""
    parsed = labels.join(images.select("stem", "split"), "stem").select("stem", "split", "line", tx.clean_label(F.col("line"), n_classes).alias("c"))
    rows = parsed.where("c is not null").select("stem", "split", F.col("c.cls").alias("class_id")).join(classes, "class_id")
    histogram = etl.histogram_by_split(rows, classes, ["train", "valid", "test"])
    circuits = images.withColumn("circuit", tx.circuit_of(F.col("name"))).where("circuit is not null")
    return {
        "histogram": histogram,
        "support": etl.support_buckets(histogram.select("cls", F.col("total").alias("instances"))),
        "leaks": etl.leak_groups(circuits, "circuit", "split"),
        "sources": etl.source_split_rollup(images, "source", "split"),
        "issues": etl.label_sanity(labels, n_classes),
        "missing": etl.missing_labels(images, labels),
    }


def resplit(images: DataFrame) -> DataFrame:
    """The manifest of pictures (name, split) whose circuit's bucket is in another split: all pictures of a circuit end in one."""
    circuit = tx.circuit_of(F.col("name"))
    wanted = images.withColumn("circuit", circuit).where("circuit is not null").withColumn("wanted", tx.split_of(tx.md5_bucket(F.col("circuit")), 70, 15))
    return etl.moves(wanted, "split", "wanted")


def frozen(labels: DataFrame, ids: DataFrame, excluded: list[str], least_instances: int = 100, least_images: int = 25) -> DataFrame:
    """The taxonomy over labels (cls, image_id, name) of sources that aren't excluded, classes folded first. ids: cls, old_id."""
    rows = labels
    for prefix in excluded:
        rows = rows.where(~F.col("name").startswith(prefix))
    histogram = etl.class_histogram(rows.withColumn("cls", etl.folded(F.col("cls"))))
    full = ids.join(histogram, "cls", "left").na.fill(0, ["instances", "images"])
    return etl.frozen_taxonomy(full, least_instances, least_images)


def seeded_split(files: DataFrame, key: str, seed: int = 42, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """files with split: of all n files the first int(n * train), in the order of a hash of seed and key, are train, the next int(n * valid) valid, the rest test.

    The order is that of a hash, as a random generator's can't be had in parallel. Ranks are counted by ranges of the hash, so that no task sees all files; files of
    the same key (nulls are one) follow each other in any order.
    """
    from pyspark.sql import Window

    hashed = files.withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("_range", F.shiftrightunsigned("_h", 52))
    sizes = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    order = Window.partitionBy("_range").orderBy(F.shiftleft("_h", 12), "_h", key)
    ranked = hashed.join(before, F.col("_range") == F.col("_of")).withColumn("_r", F.col("_before") + F.row_number().over(order))
    most_train, most_valid = F.floor(F.col("_all") * train), F.floor(F.col("_all") * valid)
    split = F.when(F.col("_r") <= most_train, "train").when(F.col("_r") <= most_train + most_valid, "valid").otherwise("test")
    return ranked.select(*files.columns, split.alias("split"))
