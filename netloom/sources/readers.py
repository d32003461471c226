"""Sources: label folders, class names, COCO files, archives, decks, drawings, pictures. All read by Spark's readers, so that any of its stores will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import map_arrow

#: Endings of picture files.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff", ".pgm", ".npy")


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def stem_of(path):
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, length of picture files below a folder, for a listing by lower(path); the content column isn't read."""
    rows = _files(spark, path).select("path", "length")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return rows.where(ending.isin(*IMAGE_ENDINGS)).withColumn("stem", stem_of(F.col("path")))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, stem, line_no, line of the label files below a folder; blank lines go."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "").withColumn("stem", stem_of(F.col("file")))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """file, class_id, name from data.yaml files: a flow list, a block list, or numbered names, which keep their numbers."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    flow = F.regexp_extract("value", r"(?s)names\s*:\s*\[(.*?)\]", 1)
    block = F.regexp_extract("value", r"(?m)^names\s*:\s*\n((?:[ \t]*(?:-|\d+\s*:)[^\n]*(?:\n|$))+)", 1)
    bare = lambda x: F.btrim(F.trim(x), F.lit("'\""))
    item = r"(?m)^[ \t]*(-|\d+)[ \t]*:?[ \t]*([^\n]*?)[ \t]*$"
    part = lambda group: F.regexp_extract_all(block, F.lit(item), F.lit(group))
    listed = F.transform(F.filter(F.transform(F.split(flow, ","), bare), lambda x: x != ""), lambda x, i: F.struct(i.alias("class_id"), x.alias("name")))
    numbered = F.transform(F.arrays_zip(part(1).alias("mark"), part(2).alias("name")), lambda x, i: F.struct(F.coalesce(x["mark"].try_cast("int"), i).alias("class_id"), bare(x["name"]).alias("name")))
    return rows.select("file", F.explode_outer(F.when(flow != "", listed).otherwise(F.filter(numbered, lambda x: x["name"] != ""))).alias("c")).where("c is not null").select("file", "c.class_id", "c.name")


def coco_boxes(spark: SparkSession, path: str) -> DataFrame:
    """file_name, width, height, category, x, y, w, h of the annotations of COCO files; images and categories meet within their file."""
    schema = "images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    images = rows.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    names = rows.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    boxes = rows.select("file", F.explode("annotations").alias("a")).select("file", "a.image_id", "a.category_id", *[F.get("a.bbox", F.lit(i)).alias(x) for i, x in enumerate("xywh")])
    return boxes.join(images, ["file", "image_id"]).join(names, ["file", "category_id"]).select("file_name", "width", "height", "category", "x", "y", "w", "h")


def archive_members(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """archive, member, stem, length, content of the files in archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            raw = z.read(member)
                            stem = member.filename.rpartition("/")[2].rpartition(".")[0]
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member.filename]), pa.array([stem]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], ["archive", "member", "stem", "length", "content"])

    return map_arrow(_files(spark, path, glob).select("path", "content"), run, "archive string, member string, stem string, length bigint, content binary")


def pgm_pixels(spark: SparkSession, path: str) -> DataFrame:
    """image_id (path), x, y, value of binary grey pictures (P5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
                if not head:
                    raise ValueError(f"{name} isn't a binary grey picture")
                w, h = int(head[1]), int(head[2])
                grey = np.frombuffer(raw, np.uint8, w * h, head.end()).reshape(h, w)
                y, x = np.indices((h, w))
                yield pa.RecordBatch.from_arrays([pa.array([name] * (w * h)), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(grey.ravel().astype(np.int64))], ["image_id", "x", "y", "value"])

    return map_arrow(_files(spark, path, "*.pgm").select("path", "content"), run, "image_id string, x bigint, y bigint, value bigint")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, text of decks and drawings."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """file, epochs, map5095: the last row of training logs. Each file's own header tells its columns; headers have spaces and vary."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    cells = lambda x: F.transform(F.split(x, ","), lambda y: F.btrim(y))
    rows = rows.withColumn("header", F.transform(cells(F.get("lines", F.lit(0))), lambda x: F.lower(x)))
    rows = rows.select("file", "header", F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).withColumn("line", cells(F.col("line")))
    at = lambda test: F.transform(F.filter(F.transform("header", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), lambda i: F.get("line", i).try_cast("double"))
    known = lambda values: F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))
    rows = rows.select("file", known(at(lambda x: x == "epoch")).alias("e"), known(at(lambda x: x.contains("map50-95"))).alias("s")).where("e is not null")
    last = rows.groupBy("file").agg(F.max(F.struct("e", "s")).alias("last"))
    return last.select("file", F.col("last.e").cast("bigint").alias("epochs"), F.col("last.s").alias("map5095"))


def structure(spark: SparkSession, path: str) -> DataFrame:
    """kind (image, label, archive, other), n, bytes of the files below a folder."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kind = F.when(ending.isin(*IMAGE_ENDINGS), "image").when(ending == ".txt", "label").when(ending.isin(".zip", ".tar", ".gz"), "archive").otherwise("other")
    return _files(spark, path).select("path", "length").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
