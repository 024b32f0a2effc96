"""Tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`.  Where the session names none, a local one gets a temporary folder and a cluster an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="quartzite-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")
