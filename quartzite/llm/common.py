"""Shared-folder tables, connected components and session settings for the operators of this subpackage."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.sources.tables import shared_root


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where the session names none, a local one (tests) gets a temporary folder and a cluster an error."""
    return shared_root(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quartzite-{name}-{uuid.uuid4().hex}"


_collectors: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of all tables that `materialize` writes meanwhile."""
    paths: list[str] = []
    _collectors.append(paths)
    try:
        yield paths
    finally:
        _collectors.remove(paths)


#: Seconds after which the driver's heap is collected while tables are written.
COLLECT_S = 10.0
_collected = 0.0


def _collect(spark: SparkSession) -> None:
    """Collect the driver's garbage.  Its heap grows with the events of all tasks, to the limit, and only a full collection gives it back."""
    global _collected
    spark.sparkContext._jvm.System.gc()
    _collected = time.monotonic()


@contextmanager
def trimmed(spark: SparkSession) -> Iterator[None]:
    """The driver's garbage is collected every COLLECT_S seconds, however long the job meanwhile takes."""
    over = threading.Event()

    def run() -> None:
        while not over.wait(min(1.0, COLLECT_S)):
            if time.monotonic() - _collected >= COLLECT_S:
                _collect(spark)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and lost executors recompute nothing above.

    The table is deleted by `drop`, or else when the driver ends.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    schema = df.schema
    for paths in _collectors:
        paths.append(path)
    with trimmed(spark):
        df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)  # what `drop` leaves goes with the session
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by `materialize` that nothing reads any more, and let Spark delete the shuffle files behind them."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _collect(spark)  # Spark's cleaner removes the files of a shuffle when the driver has collected its last reference


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows (and where the version knows it, the bytes) of one Arrow batch, so long texts can't fill a worker.

    These are settings of the session and stay: they change how rows are handed over, not what any query gives.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def width(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Number of partitions for a bucketed exchange: the session's shuffle setting, or the scan's partitions if more."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions()) if df is not None else n


def _stars(e: DataFrame) -> bool:
    """Whether each node of the edges (u, v) has one v or is one."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n + root > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected `edges` as rows (node, component), component = smallest node of it.

    Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond").
    A round costs two shuffles of the edge list, the number of rounds grows with the logarithm of the longest chain, and
    nothing is gathered in one place: a node with many neighbours is a join key whose partitions AQE can split.
    Self loops and null ends are ignored; nodes without an edge have no row.
    """
    spark = edges.sparkSession
    old_path = new_path(spark, "cc")
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v").distinct(), "cc", old_path)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(m, both.u == m.k).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the link of a node to its own minimum is made from its larger side
        large = large.unionByName(m.where("k > m").select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        large_path = new_path(spark, "cc")
        large = materialize(large, "cc", large_path)
        s = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(s, large.u == s.k).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(s.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        path = new_path(spark, "cc")
        e = materialize(small, "cc", path)
        drop(spark, old_path, large_path)
        old_path = path
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
