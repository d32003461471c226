"""Detection as a table function with an injected model, and the second looks at pictures: zoomed windows and weak detections.

Models aren't part of the library: `load` is called once in each worker and gives a function from a list of pictures (bytes) to a list of detections
(cls, conf, x0, y0, x1, y1) for each. Without a model, detections are a table like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import map_arrow
from .spatial import nms, novel_boxes

Model = Callable[[list[bytes]], list[list[tuple]]]


def detections(images: DataFrame, load: Callable[[], Model], least: float = 0.35, batch: int = 16) -> DataFrame:
    """image_id, det_id, cls, conf, x0, y0, x1, y1 of images (image_id, content), of confidence least or more; det_id counts within a picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                rows = [(i, n, *d) for i, found in zip(some.column(0).to_pylist(), model(some.column(1).to_pylist())) for n, d in enumerate(x for x in found if x[1] >= least)]
                columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
                kinds = [part.schema.types[0], pa.int64(), pa.string(), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["image_id", "det_id", "cls", "conf", "x0", "y0", "x1", "y1"])

    kind = images.schema["image_id"].dataType.simpleString()
    return map_arrow(images.select("image_id", "content"), run, f"image_id {kind}, det_id bigint, cls string, conf double, x0 double, y0 double, x1 double, y1 double")


def windows(boxes: DataFrame, width: int, height: int, pad: int = 30, side: int = 640) -> DataFrame:
    """boxes with wx0, wy0, wx1, wy1, the padded window within the picture, and scale, by which its longer side becomes `side`."""
    rows = boxes.withColumn("wx0", F.greatest(F.col("x0") - pad, F.lit(0))).withColumn("wy0", F.greatest(F.col("y0") - pad, F.lit(0)))
    rows = rows.withColumn("wx1", F.least(F.col("x1") + pad, F.lit(width))).withColumn("wy1", F.least(F.col("y1") + pad, F.lit(height)))
    return rows.withColumn("scale", F.lit(float(side)) / F.greatest(F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")))


def unzoomed(found: DataFrame) -> DataFrame:
    """Detections within a window (wx0, wy0, scale) in the coordinates of the picture."""
    out = found
    for c, origin in (("x0", "wx0"), ("x1", "wx0"), ("y0", "wy0"), ("y1", "wy0")):
        out = out.withColumn(c, F.col(origin) + F.col(c) / F.col("scale"))
    return out


def harvested(weak: DataFrame, present: DataFrame, least: float = 0.15, threshold: float = 0.5) -> DataFrame:
    """Weak detections of confidence least or more that overlap nothing present nor each other, the strongest first."""
    return novel_boxes(present, weak.where(F.col("conf") >= least), threshold)


def first_look(found: DataFrame, least: float = 0.35) -> DataFrame:
    return nms(found.where(F.col("conf") >= least))
