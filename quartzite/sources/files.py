"""Files as rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _empty_files(spark: SparkSession, root: str, recursive: bool) -> list[str]:
    """Files without a byte: Spark's source has no row for them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, recursive)
    out = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def _links(root: str) -> list[str]:
    """Links under a local folder, which a scan doesn't follow; other stores have none."""
    top = root.removeprefix("file://").removeprefix("file:")
    if "://" in top or not os.path.isdir(top):
        return []
    return [os.path.join(at, x) for at, folders, names in os.walk(top) for x in (*folders, *names) if os.path.islink(os.path.join(at, x))]


def scan(spark: SparkSession, root: str, recursive: bool = True, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, relative, length, content) of the files under `root`, or of one file.  `content` is only read where it is used; filters on length reach the source.

    Links in local folders are not followed.  ignored: names of folders whose files are left out at any depth, as the caller has them.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length", "content")
    empty = _empty_files(spark, root, recursive)
    if empty:
        df = df.unionByName(spark.createDataFrame([(p, 0, b"") for p in empty], "path string, length long, content binary"))
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    relative = F.when(F.col("path") == top, top.rpartition("/")[2]).otherwise(F.substring("path", len(top) + 2, 1 << 30))
    df = df.select("path", relative.alias("relative"), "length", "content")
    for link in _links(root):
        df = df.where(~F.concat("path", F.lit("/")).contains(f"{link}/"))
    for name in ignored:
        df = df.where(~F.concat(F.lit("/"), "relative").contains(f"/{name}/"))
    return df


def ordered(files: DataFrame, path_col: str, folder: str) -> DataFrame:
    """`files` with place (long): each row's place in the order of its path, from 0; of equal paths any order.

    Range-sorted once into `folder`; a partition's rows are numbered by themselves, and start where those before it end.
    """
    rows = files.repartitionByRange(F.col(path_col)).withColumn("part", F.spark_partition_id())
    rows.write.parquet(folder)
    rows = files.sparkSession.read.parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = rows.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(path_col)) - 1
    return rows.withColumn("own", own).join(base, F.col("part") == F.col("of")).withColumn("place", (F.col("base") + F.col("own")).cast("long")).drop("part", "of", "own", "base")
