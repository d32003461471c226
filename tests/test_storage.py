"""The shared folder, and what the driver's module does without the training-data subpackage."""

import importlib
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from netloom import storage


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name: {"spark.checkpoint.dir": folder}.get(name))
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))
        assert storage.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert storage.shared_dir(session("local[8]")).startswith("file://")


class Missing:
    """Makes imports of a name fail as if it weren't installed."""

    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.mark.parametrize("name", ["netloom.llm", "corpus_pipeline"])
def test_only_the_subpackage_may_be_missing(monkeypatch, name):
    for loaded in [x for x in sys.modules if x.partition(".")[0] in ("corpus_pipeline", "__spark_entry__") or x.startswith("netloom.llm")]:
        monkeypatch.delitem(sys.modules, loaded)
    import netloom

    monkeypatch.delattr(netloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Missing(name), *sys.meta_path])
    driver = importlib.import_module("__spark_entry__")
    assert driver.llm_queries is None and "net_fanout" in driver.queries() and not any(x.startswith("op1_") for x in driver.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def sizes(*tables):
    return [int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in tables]


def test_tables_are_as_large_as_their_rows(spark):
    """Ids in sequence and few classes take little room in a file; the planner mustn't broadcast their millions of rows for that."""
    n = 2_000_000
    ids = spark.range(n).select(F.col("id").alias("comp_id"), F.element_at(F.array(F.lit("gnd"), F.lit("vdd")), (F.col("id") % 2 + 1).cast("int")).alias("cls"))
    comps = storage.materialize(ids, "comps")
    files = spark.read.parquet(comps.inputFiles()[0].rpartition("/")[0])
    limit = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b"))
    assert sizes(files)[0] < limit and sizes(comps)[0] > n * 20 and sizes(comps.select("comp_id"))[0] > limit
    pins = comps.select("comp_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"))
    lone = pins.join(comps.where("cls = 'gnd'"), "comp_id", "left_anti")
    assert "Broadcast" not in lone._jdf.queryExecution().executedPlan().toString()
    assert lone.count() == n // 2 * 3
    assert comps.sparkSession is spark and not spark.catalog.listTables("global_temp")
    storage.drop_table(comps)
    with pytest.raises(Exception, match="not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        comps.count()


def test_small_and_dense_tables_are_left_as_they_are(spark):
    small = storage.materialize(spark.range(100).withColumn("x", F.lit(1)), "small")
    dense = storage.materialize(spark.range(300_000).select(F.xxhash64("id").alias("u"), F.xxhash64("id", F.lit(1)).alias("v")), "dense")
    for table in (small, dense):
        files = spark.read.parquet(table.inputFiles()[0].rpartition("/")[0])
        assert sizes(files) == sizes(table)


def test_workers_get_small_batches_of_large_rows(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    before = spark.conf.get(name, None)
    with pytest.raises(ZeroDivisionError), storage.small_batches(spark):
        found = [r.n for r in storage.materialize(storage.map_arrow(rows, sizes, "n bigint"), "sizes").collect()]
        assert sum(found) > 12_000_000
        assert max(found) < 3 << 20
        with storage.small_batches(spark, 1 << 30):
            assert spark.conf.get(name) == str(2 << 20)
        raise ZeroDivisionError
    assert spark.conf.get(name, None) == before
