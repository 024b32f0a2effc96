"""Functions for SQL: `quartzite.functions.sql.register(spark)`, then `SELECT entropy(x), crc32c(x) FROM ...`, `SELECT * FROM text_parts('...')`."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quartzite.functions import kernels as K
from quartzite.sources import archive
from quartzite.sources.zips import ENTRY
from quartzite.sources.zips import entries as entries_of_zip


def entropy(values: pd.Series) -> pd.Series:
    """Bits a byte of each binary value; null for null."""
    return values.map(lambda x: None if x is None else K.entropy(np.bincount(K.as_bytes(x), minlength=256)))


def crc32c(values: pd.Series) -> pd.Series:
    sizes = [0 if x is None else len(x) for x in values]
    crc = K.crc32c_rows(K.as_bytes(b"".join(x for x in values if x is not None)), np.append(0, np.cumsum(sizes, dtype=np.int64)))
    return pd.Series([None if x is None else int(c) for x, c in zip(values, crc, strict=True)], dtype="Int64")


def group_entropy(values: pd.Series) -> float:
    """Bits a byte of all values of a group together."""
    total = np.zeros(256, np.int64)
    for x in values:
        total += np.bincount(K.as_bytes(x), minlength=256)
    return K.entropy(total)


class TextParts:
    """Rows (pos, part): alternating runs of ASCII letters and the rest."""

    def eval(self, text: str):
        for i, m in enumerate(re.finditer(r"[a-zA-Z]+|[^a-zA-Z]+", text or "")):
            yield i, m[0]


class ZipEntries:
    """Rows of the central directory of a zip; none where there is none."""

    def eval(self, data: bytes):
        yield from entries_of_zip(K.as_bytes(data))


class ArchiveEntries:
    """Rows (path, mode, elem, pad, content) of a container; a damaged one is an error."""

    def eval(self, data: bytes):
        if data is not None:
            yield from archive.entries(bytes(data))


def register(spark: SparkSession) -> None:
    spark.udf.register("entropy", F.pandas_udf(entropy, "double"))
    spark.udf.register("crc32c", F.pandas_udf(crc32c, "long"))
    spark.udf.register("group_entropy", F.pandas_udf(group_entropy, "double"))
    spark.udtf.register("text_parts", F.udtf(TextParts, returnType="pos int, part string"))
    spark.udtf.register("zip_entries", F.udtf(ZipEntries, returnType=ENTRY))
    spark.udtf.register("archive_entries", F.udtf(ArchiveEntries, returnType=archive.ENTRY))
