"""The engine as functions: archives of folders, entropy of a text, and what an HTTP layer would answer."""

from __future__ import annotations

import base64
import hashlib
import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.functions import security
from quartzite.functions.kernels import as_bytes, entropy
from quartzite.sources import archive
from quartzite.sources.files import scan


def compress(spark: SparkSession, source: str, out: str, solid: bool = True, ignored: tuple[str, ...] = (), lossy: int = 0, speed: str = "normal", passphrase: str | None = None) -> dict:
    """Archive the files under `source` at `out`; both may be in any store that Spark reads.  With a passphrase, containers are encrypted."""
    began = time.perf_counter()
    files = scan(spark, source, ignored=ignored).select(F.col("relative").alias("path"), "content")
    settings = archive.Settings(solid, lossy, speed)
    if passphrase is None:
        archive.write_archive(files, out, settings)
    else:
        security.encrypt(archive.packed_rows(files, settings), "archive", passphrase).write.parquet(out)
    made = spark.read.parquet(out).agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n"), F.sum(F.octet_length("archive")).alias("packed")).first()
    return metrics(made.n or 0, made.packed or 0, time.perf_counter() - began) | {"files": made.n_files or 0}


def decompress(spark: SparkSession, source: str, passphrase: str | None = None) -> DataFrame:
    """(path, mode, elem, pad, content) of an archive.  A wrong passphrase or a changed byte is an error."""
    rows = spark.read.parquet(source).select("archive")
    return archive.unpacked_rows(rows if passphrase is None else security.decrypt(rows, "archive", passphrase))


def restore(spark: SparkSession, source: str, folder: str, passphrase: str | None = None) -> dict:
    """Write an archive's files as a tree under `folder`, which all executors share."""
    began = time.perf_counter()
    done = archive.restore_files(decompress(spark, source, passphrase), folder).agg(F.count("*").alias("files"), F.sum("n").alias("n")).first()
    packed = spark.read.parquet(source).agg(F.sum(F.octet_length("archive")).alias("n")).first().n or 0
    return metrics(done.n or 0, packed, time.perf_counter() - began) | {"files": done.files}


def metrics(n: int, packed: int, seconds: float) -> dict:
    """Sizes, ratio, saving in per cent and MB a second; nothing divided by zero."""
    return {"original_bytes": n, "packed_bytes": packed, "ratio": round(n / max(1, packed), 4), "saved_pct": round(100 * (n - packed) / n, 4) if n else 0.0, "seconds": round(seconds, 4), "mb_per_s": round(n / 1e6 / seconds, 4) if seconds > 0 else 0.0}


def text_entropy(text: str | bytes) -> dict:
    x = as_bytes(text.encode() if isinstance(text, str) else text)
    h = round(entropy(np.bincount(x, minlength=256)), 4) + 0.0
    least = int(np.ceil(h * len(x) / 8))
    return {"total_bytes": len(x), "entropy_bits_per_byte": h, "theoretical_min_bytes": least, "max_theoretical_ratio": round(len(x) / max(1, least), 3)}


def _one(spark: SparkSession | None, fn, data: bytes, passphrase: str, **kw) -> bytes | None:
    """`fn` of `security` on one value: the engine's ciphers are Spark's."""
    spark = spark or SparkSession.builder.getOrCreate()
    out = fn(spark.createDataFrame([(bytearray(data),)], "x binary"), "x", passphrase, **kw).first()[0]
    return None if out is None else bytes(out)


def handle(action: str, body: str, spark: SparkSession | None = None) -> tuple[int, str]:
    """(status, JSON) of a request: entropy, compress or decompress, with `text` or base64 `data`, and perhaps `passphrase`, in a JSON body; or status.

    400 for what can't be read, 403 for a wrong or missing passphrase or a changed container.
    """
    try:
        if action == "status":
            return 200, json.dumps({"status": "ok", "actions": ["compress", "decompress", "entropy", "status"]})
        request = json.loads(body)
        data = request["text"].encode() if "text" in request else base64.b64decode(request["data"], validate=True)
        passphrase = request.get("passphrase")
        if action == "entropy":
            answer = text_entropy(data)
        elif action == "compress":
            packed = archive.pack_stream(data)
            answer = {"sha256": hashlib.sha256(data).hexdigest()} | metrics(len(data), len(packed), 0)
            answer["data"] = base64.b64encode(_one(spark, security.encrypt, packed, passphrase) if passphrase else packed).decode()
        elif action == "decompress":
            if data.startswith(security.MAGIC):
                data = _one(spark, security.decrypt, data, passphrase, strict=False) if passphrase else None
                if data is None:
                    return 403, json.dumps({"error": "the container is encrypted" if not passphrase else "the passphrase is wrong or the container was changed"})
            plain = archive.unpack_stream(data)
            answer = {"data": base64.b64encode(plain).decode(), "sha256": hashlib.sha256(plain).hexdigest()}
        else:
            return 404, json.dumps({"error": f"no action {action}"})
    except (KeyError, TypeError, ValueError, IndexError) as e:
        return 400, json.dumps({"error": str(e)})
    return 200, json.dumps(answer)


def report(results: DataFrame, path: str) -> None:
    """Write results as JSON lines."""
    results.write.mode("overwrite").json(path)
