"""Intermediate tables in the cluster's shared folder, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes on disk from which on a table's rows are counted.
MEASURED = 1 << 20

_run = uuid.uuid4().hex[:12]
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_netloom_dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._netloom_dir = "file://" + tempfile.mkdtemp(prefix="netloom-")
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, S112  the session may have ended before; the folder's owner cleans it then
            continue


def _sized(table: DataFrame, path: str) -> DataFrame:
    """table, of the Parquet files at path, so that the planner takes it for as large as its rows.

    It would go by the files, which are a tenth of the rows or less where ids stand in sequence or values repeat, and have the driver
    broadcast many millions of rows. The factor from files to rows is a setting of the session that reads them, so that is another one
    with the same settings otherwise; the table comes back through a view that all sessions see.
    """
    spark, name = table.sparkSession, "spark.sql.sources.fileCompressionFactor"
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < MEASURED:
        return table
    factor, held = 1, table.count() * table._jdf.schema().defaultSize()  # the files' footers have the count
    while size * factor < held:
        factor *= 2
    if factor == 1:
        return table
    sessions = spark.__dict__.setdefault("_netloom_sessions", {})
    if factor not in sessions:
        sessions[factor] = spark.newSession()
    reader = sessions[factor]
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            reader.conf.set(key, value)
    reader.conf.set(name, str(float(spark.conf.get(name)) * factor))
    view = f"netloom_{uuid.uuid4().hex}"
    reader.read.schema(table.schema).parquet(path).createGlobalTempView(view)
    try:
        return spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{view}")
    finally:
        reader.catalog.dropGlobalTempView(view)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the table, so that lineage is cut and any executor may be lost.

    The table stays until the application ends or drop_table, as the result may be read at any time until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom-{_run}/{label}-{uuid.uuid4().hex[:8]}"
    _written.append((spark, path))
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return _sized(spark.read.schema(df.schema).parquet(path), path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize wrote, when nothing reads it any more."""
    files = df.inputFiles()
    if files:
        path = files[0].rpartition("/")[0]
        for written in _written:
            if path.split(":", 1)[-1].lstrip("/") == written[1].split(":", 1)[-1].lstrip("/"):
                _remove(df.sparkSession, path)
                _written.remove(written)
                return


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_netloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="netloom-code-"), f"netloom_{_run}.zip")  # the driver serves it while the application runs
    with zipfile.ZipFile(path, "w") as z:
        for found in sorted(package.rglob("*.py")):
            z.write(found, found.relative_to(package.parent))
    context.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    context._netloom_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package's modules at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


@contextmanager
def small_batches(spark: SparkSession, most: int = 2 << 20) -> Iterator[None]:
    """What runs inside gives Python workers batches of some `most` bytes; Spark's 10,000 rows are tens of MB of texts, which the executor and the worker hold several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= most:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
