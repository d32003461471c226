"""Dataset ETL over pictures and label rows: dedup, vocabularies, histograms, leak checks, splits, samples, audits.

labels: file, line_no, line or parsed columns. Dimensions of classes are of fixed, small size; everything else is grouped or joined on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_label, label_issue, sanitized
from ..model import FOLD


def first_by_content(files: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first file, by order, of each content; contents meet by their sha256, and only keys and hashes are shuffled before the choice."""
    keyed = files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    first = keyed.groupBy("sha256").agg(F.min(F.struct(*order)).alias("_first")).select("sha256", "_first")
    return keyed.join(first.withColumnRenamed("sha256", "_sha"), (F.col("sha256") == F.col("_sha")) & (F.struct(*order) == F.col("_first"))).drop("_first", "_sha")


def canonical(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """df with canonical: the alias of a name (alias, target; as written), or else its sanitized form. Aliases are a fixed table."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("target").alias("_target"))
    return df.join(a, F.col(name) == F.col("_alias"), "left").withColumn("canonical", F.coalesce("_target", sanitized(F.col(name)))).drop("_alias", "_target")


def class_histogram(labels: DataFrame, cls: str = "cls", image: str = "image_id") -> DataFrame:
    """cls, instances, images (that contain it)."""
    per = labels.groupBy(cls, image).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(cls).agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("images"))


def histogram_by_split(labels: DataFrame, classes: DataFrame, splits: list[str]) -> DataFrame:
    """cls, a count for each split, total, of every class of the dimension, also those without instances."""
    counts = labels.groupBy("cls").agg(*[F.sum((F.col("split") == s).cast("bigint")).alias(s) for s in splits])
    rows = classes.select("cls").join(counts, "cls", "left").na.fill(0, splits)
    return rows.withColumn("total", sum((F.col(s) for s in splits[1:]), F.col(splits[0])))


def source_split_rollup(images: DataFrame, source: str, split: str) -> DataFrame:
    """source, split, n, with subtotals by source and the grand total (nulls)."""
    return images.rollup(source, split).agg(F.count(F.lit(1)).alias("n"))


def leak_groups(images: DataFrame, group: str, split: str) -> DataFrame:
    """group, n_splits of the groups that stand in more than one split."""
    return images.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def frozen_taxonomy(histogram: DataFrame, least_instances: int = 100, least_images: int = 25) -> DataFrame:
    """old_id, cls, instances, keep, new_id (dense over kept classes in order of old_id, -1 for others). A taxonomy is a dimension of some hundred rows."""
    keep = (F.col("instances") >= least_instances) & (F.col("images") >= least_images)
    rows = histogram.withColumn("keep", keep)
    number = F.sum(F.col("keep").cast("bigint")).over(Window.orderBy("old_id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.select("old_id", "cls", "instances", "keep", F.when(F.col("keep"), number).otherwise(-1).cast("bigint").alias("new_id"))


def vocabulary(df: DataFrame, name: str) -> DataFrame:
    """name, id: dense ids from 0 over the sorted distinct names; a vocabulary is a dimension of some hundred rows."""
    return df.select(name).distinct().select(name, (F.row_number().over(Window.orderBy(name)) - 1).cast("bigint").alias("id"))


def remapped(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels with the new_id of their class; those dropped or unknown go."""
    kept = taxonomy.where("new_id >= 0").select("cls", "new_id")
    return labels.join(kept, "cls")


def folded(cls: Column) -> Column:
    """The class that a class is folded into, or itself."""
    out = cls
    for old, new in FOLD.items():
        out = F.when(cls == old, new).otherwise(out)
    return out


def fold_report(labels: DataFrame) -> DataFrame:
    """old, new, n of the instances that folding moves."""
    return labels.select(F.col("cls").alias("old"), folded(F.col("cls")).alias("new")).where("old <> new").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def fold_counts(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """new, n, moved, dropped: instances of each class after folding, those that folding moved there, and in the row of a null class the boxes that go.

    labels: cls, w, h; taxonomy: cls of the classes that stay. Boxes without area and of classes that don't stay go.
    """
    kept = taxonomy.select(F.col("cls").alias("stays")).distinct()
    rows = labels.withColumn("new", folded(F.col("cls"))).join(kept, F.col("new") == F.col("stays"), "left")
    good = F.col("stays").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0)
    rows = rows.select(F.when(good, F.col("new")).alias("new"), (good & (F.col("new") != F.col("cls"))).alias("moved"))
    return rows.groupBy("new").agg(F.sum(F.col("new").isNotNull().cast("bigint")).alias("n"), F.sum(F.coalesce(F.col("moved").cast("bigint"), F.lit(0))).alias("moved"), F.sum(F.col("new").isNull().cast("bigint")).alias("dropped"))


def capped_sample(images: DataFrame, source: str, key: str, cap: int) -> DataFrame:
    """min(cap, n) pictures of each source of n, in the order of a hash of their key, then the key; a null source is a source, a null key counts as no text.

    Counts by ranges of the hash tell where the first cap rows of each source end; rows behind that range go. What is left of a source, also if all its rows share
    a key, is ranked in parts before the last ranking, so that no source's rows stand in one task.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    hashed = images.withColumn("_h", h).withColumn("_range", F.shiftright("_h", 20))
    sizes = hashed.groupBy(F.col(source).alias("_source"), "_range").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows a source at most
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sizes.withColumn("_before", before).where(F.col("_before") < cap).groupBy("_source").agg(F.max("_range").alias("_last"))
    thin = hashed.join(last, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_range") <= F.col("_last"))).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    first = thin.withColumn("_r", F.row_number().over(Window.partitionBy(source, "_part").orderBy("_h", key))).where(F.col("_r") <= cap)
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy("_h", key))).where(F.col("_r") <= cap)
    return ranked.select(*images.columns)


def label_sanity(labels: DataFrame, n_classes: int, examples: int = 10) -> DataFrame:
    """issue, n, examples (the least lines) of label lines."""
    rows = labels.select(label_issue(F.col("line"), n_classes).alias("issue"), "line").where("issue is not null")
    counts = rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    # the least lines of each of 64 parts first, so that no issue's lines stand in one window
    part = rows.select("issue", "line").distinct().withColumn("part", F.pmod(F.xxhash64("line"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("issue", "part").orderBy("line"))).where(F.col("r") <= examples)
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("issue").orderBy("line"))).where(F.col("r") <= examples)
    return counts.join(few.groupBy("issue").agg(F.array_sort(F.collect_list("line")).alias("examples")), "issue")


def cleaned_labels(labels: DataFrame, n_classes: int) -> DataFrame:
    """file, line_no, cls, cx, cy, w, h of the lines that can be used."""
    return labels.select("file", "line_no", clean_label(F.col("line"), n_classes).alias("c")).where("c is not null").select("file", "line_no", "c.*")


def split_orientation(labels: DataFrame) -> DataFrame:
    """file, line_no, label (five words), orientation (the sixth, or R0); a file with a line of any other width gives nothing."""
    words = F.split(F.trim("line"), r"\s+")
    rows = labels.withColumn("words", words).withColumn("bad", ~F.size("words").isin(5, 6))
    poisoned = rows.where("bad").select(F.col("file").alias("_file")).distinct()
    rows = rows.join(poisoned, rows["file"] == poisoned["_file"], "left_anti")
    return rows.select("file", "line_no", F.concat_ws(" ", F.slice("words", 1, 5)).alias("label"), F.coalesce(F.get("words", F.lit(5)), F.lit("R0")).alias("orientation"))


def with_orientation(labels: DataFrame, sidecar: DataFrame) -> DataFrame:
    """labels (file, line_no, label) with the orientation of the same line of their file's sidecar (file, line_no, orientation); null where it has none."""
    return labels.join(sidecar.select("file", "line_no", "orientation"), ["file", "line_no"], "left")


def missing_labels(images: DataFrame, labels: DataFrame, stem: str = "stem") -> DataFrame:
    """Pictures without a label file."""
    return images.join(labels.select(stem).distinct(), stem, "left_anti")


def support_buckets(histogram: DataFrame) -> DataFrame:
    """bucket (zero, under_30, under_100, enough), n_classes, instances."""
    bucket = F.when(F.col("instances") == 0, "zero").when(F.col("instances") < 30, "under_30").when(F.col("instances") < 100, "under_100").otherwise("enough")
    return histogram.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_classes"), F.sum("instances").alias("instances"))


def merge_stats(files: DataFrame) -> DataFrame:
    """dataset, images, duplicates, kept: counts of each dataset of a merge; files has dataset and is_first."""
    kept = F.sum(F.col("is_first").cast("bigint"))
    return files.groupBy("dataset").agg(F.count(F.lit(1)).alias("images"), (F.count(F.lit(1)) - kept).alias("duplicates"), kept.alias("kept"))


def model_rank(scores: DataFrame) -> DataFrame:
    """tag, mean_recall, min_recall, n of each model's results."""
    return scores.groupBy("tag").agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.count(F.lit(1)).alias("n"))


def moves(images: DataFrame, current: str, wanted: str) -> DataFrame:
    """The manifest of pictures whose split changes; nothing is moved."""
    return images.where(F.col(current) != F.col(wanted))


def publishable(files: DataFrame, most_bytes: int = 14 * 2**30) -> DataFrame:
    """One row: n, bytes, ok of the files of a dataset that is to be published."""
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("ok", F.col("bytes") <= most_bytes)


def used_classes(labels: DataFrame, names: DataFrame) -> DataFrame:
    """class_id, name of the classes of the dimension names that any label uses."""
    return names.join(labels.select(F.col("cls").alias("class_id")).distinct(), "class_id", "left_semi")
