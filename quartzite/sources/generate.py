"""Deterministic inputs from `spark.range` and expressions: any size, in parallel, the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(i: Column, salt: int, top: int) -> Column:
    """A whole number under `top` for each `i`: the first digits of a digest."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(f"/{salt}"))), 1, 12), 16, 10).cast("long"), F.lit(top))


def wal(spark: SparkSession, n: int) -> DataFrame:
    """A write-ahead log: lsn, transaction, operation, payload."""
    i = F.col("id")
    return spark.range(n).select((i * 50).alias("lsn"), F.floor(i / 4).cast("long").alias("tx"), F.pmod(i * 7, F.lit(3)).cast("int").alias("op"), F.md5(i.cast("string")).alias("payload"))


def logs(spark: SparkSession, n: int) -> DataFrame:
    """JSON log lines."""
    i = F.col("id")
    level = F.element_at(F.array(*map(F.lit, ("INFO", "DEBUG", "WARN", "ERROR"))), (noise(i, 1, 4) + 1).cast("int"))
    return spark.range(n).select("id", F.format_string('{"id": %d, "level": "%s", "loss": %d, "module": "m%d"}', i, level, noise(i, 2, 1000), noise(i, 3, 9)).alias("line"))


def rows_csv(spark: SparkSession, n: int) -> DataFrame:
    """CSV lines of training metrics."""
    i = F.col("id")
    return spark.range(n).select("id", F.concat_ws(",", F.floor(i / 100).cast("string"), F.pmod(i, F.lit(100)).cast("string"), noise(i, 4, 100_000).cast("string"), noise(i, 5, 1000).cast("string")).alias("line"))


def dna(spark: SparkSession, n: int) -> DataFrame:
    """Lines of 60 bases."""
    base = lambda i: F.substring(F.lit("ACGT"), (noise(i, 6, 4) + 1).cast("int"), F.lit(1))
    return spark.range(n).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: base(F.col("id") * 60 + k))).alias("line"))


def grid(spark: SparkSession, side: int) -> DataFrame:
    """A smooth elevation grid."""
    x, y = F.pmod("id", F.lit(side)), F.floor(F.col("id") / side)
    return spark.range(side * side).select(x.alias("x"), y.alias("y"), (100 + 50 * F.sin(x / 16) * F.cos(y / 16)).alias("z"))


def weights(spark: SparkSession, n: int) -> DataFrame:
    """Weights like a network's: sums of four uniform numbers, with ones and zeros among them."""
    i = F.col("id")
    bell = (noise(i, 7, 1000) + noise(i, 8, 1000) + noise(i, 9, 1000) + noise(i, 10, 1000) - 1998) / 20_000
    return spark.range(n).select("id", F.when(F.pmod(i, F.lit(8)) == 0, 0.0).when(F.pmod(i, F.lit(8)) == 1, 1.0).otherwise(bell).alias("w"))


def assets(spark: SparkSession, n: int, distinct: int) -> DataFrame:
    """Files of which only `distinct` differ."""
    return spark.range(n).select(F.format_string("tex_%03d.raw", F.col("id")).alias("path"), F.repeat(F.md5(F.pmod("id", F.lit(distinct)).cast("string")), 128).alias("content"))


#: Words of generated prose.
WORDS = ("river", "stone", "amber", "field", "quiet", "morning", "letter", "window", "garden", "copper", "silver", "winter", "harbor", "lantern", "meadow", "paper")


def _says(i: Column) -> Column:
    """Twelve words."""
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (noise(i * 12 + k, 11, len(WORDS)) + 1).cast("int"))
    return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(11)), word))


def _code(i: Column) -> Column:
    return F.concat(F.lit("def f"), i.cast("string"), F.lit("(x):\n    return x * "), noise(i, 12, 97).cast("string"), F.lit(" + "), noise(i, 13, 1000).cast("string"), F.lit("\n"))


def _record(i: Column) -> Column:
    return F.format_string('{"id": %d, "name": "user%d", "score": %d, "tags": ["t%d", "t%d"]}', i, noise(i, 14, 500), noise(i, 15, 100), noise(i, 16, 9), noise(i, 17, 9))


def _xml(i: Column) -> Column:
    return F.format_string('<row id="%d"><v>%d</v></row>', i, noise(i, 19, 10_000))


def text(spark: SparkSession, n: int) -> DataFrame:
    """Lines of prose."""
    return spark.range(n).select("id", _says(F.col("id")).alias("line"))


def code(spark: SparkSession, n: int) -> DataFrame:
    """Small functions."""
    return spark.range(n).select("id", _code(F.col("id")).alias("line"))


def records(spark: SparkSession, n: int) -> DataFrame:
    """JSON records."""
    return spark.range(n).select("id", _record(F.col("id")).alias("line"))


def html(spark: SparkSession, n: int) -> DataFrame:
    """Paragraphs of a page."""
    return spark.range(n).select("id", F.format_string('<div class="c%d"><p>%s</p></div>', noise(F.col("id"), 18, 7), _says(F.col("id"))).alias("line"))


def xml(spark: SparkSession, n: int) -> DataFrame:
    """Rows of a document."""
    return spark.range(n).select("id", _xml(F.col("id")).alias("line"))


def halves(spark: SparkSession, n: int) -> DataFrame:
    """Bits of half-precision floats: multiples of 1/1024 under 2, of both signs."""
    m, sign = noise(F.col("id"), 20, 2048), noise(F.col("id"), 21, 2)
    e = F.floor(F.log2(m))
    return spark.range(n).select("id", (sign * 32_768 + F.when(m == 0, 0).otherwise((e + 4) * 1024 + m * F.pow(F.lit(2.0), 10 - e))).cast("int").alias("bits"))


def mixed(spark: SparkSession, n: int) -> DataFrame:
    """Files of several kinds."""
    i, kind = F.col("id"), F.pmod("id", F.lit(4))
    path = F.concat(F.format_string("mixed/%05d", i), F.element_at(F.array(*map(F.lit, (".txt", ".py", ".json", ".xml"))), (kind + 1).cast("int")))
    return spark.range(n).select(path.alias("path"), F.when(kind == 0, _says(i)).when(kind == 1, _code(i)).when(kind == 2, _record(i)).otherwise(_xml(i)).alias("content"))
