"""The same operators on streams: stateless blocks, and counts that each micro-batch adds once."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quartzite.functions.arrow import map_bytes
from quartzite.operators.entropy import byte_histogram, entropy_of
from quartzite.sources.archive import block_rows
from quartzite.sources.tables import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that `spark.checkpoint.dir` names; a local session without it gets a temporary one, a cluster an error."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*")


def stream_blocks(stream: DataFrame, id_col: str, col: str, out: str, checkpoint: str):
    """Blocks of every row, as they come; the file sink commits each micro-batch once."""
    blocks = map_bytes(stream, col, block_rows, "block_no int, mode int, n long, packed long, crc long, restored string", [id_col], many=True)
    return blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_histogram(stream: DataFrame, col: str, key: str, out: str, checkpoint: str):
    """Adds each micro-batch's byte counts as a folder of its own number: a batch that runs again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        byte_histogram(batch, col, F.col(key)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_entropy(spark: SparkSession, out: str) -> DataFrame:
    total = spark.read.parquet(out).groupBy("key", "b").agg(F.sum("n").alias("n"))
    return entropy_of(total, ["key"])


STATE = "counts binary, total long, n long, bits double"


def _learn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, step: int, limit: int) -> Iterator[pd.DataFrame]:
    """Code the key's values, in the order of their numbers, by counts that are learnt from all that came before, in this micro-batch or an earlier one."""
    if state.exists:
        packed, total, n, bits = state.get
        f = np.frombuffer(packed, np.int64).copy()
    else:
        f, total, n, bits = np.ones(256, np.int64), 256, 0, 0.0
    rows = pd.concat(list(frames)).sort_values("ord")
    for x in rows["x"]:
        for b in bytes(x or b""):
            bits -= math.log2(f[b] / total)
            f[b] += step
            total += step
            n += 1
            if total > limit:
                f = np.maximum(1, f >> 1)
                total = int(f.sum())
    state.update((f.tobytes(), total, n, bits))
    yield pd.DataFrame({"key": [key[0]], "n": [n], "bits": [bits], "total": [total]})


def stream_online(stream: DataFrame, key: str, order: str, col: str, out: str, checkpoint: str, step: int = 16, limit: int = 32_000):
    """An adaptive byte model for each `key`, kept as state from micro-batch to micro-batch: (key, n, bits, total) after each.

    Within a micro-batch values go by `order`; counts are halved, 1 at least, when their total passes `limit`.  The state of a key is 2 kB,
    whatever it has seen.  Null values have no bytes; null keys are a key of their own.
    """

    def learn(k, frames, state):
        return _learn(k, frames, state, step, limit)

    src = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("ord"), F.encode(F.col(col).cast("string"), "UTF-8").alias("x"))
    rows = src.groupBy("key").applyInPandasWithState(learn, "key string, n long, bits double, total long", STATE, "append", GroupStateTimeout.NoTimeout)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows and seconds of each micro-batch."""

    def __init__(self):
        self.events: list[dict] = []

    def onQueryStarted(self, event):
        self.events.append({"status": "started", "id": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.events.append({"status": "progress", "batch": p.batchId, "rows": p.numInputRows, "ms": p.durationMs.get("triggerExecution", 0)})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.events.append({"status": "error" if event.exception else "done", "id": str(event.id)})
