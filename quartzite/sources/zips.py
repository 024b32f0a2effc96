"""Entries of zip files in a binary column."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from quartzite.functions.arrow import map_bytes

ENTRY = "name string, offset long, size long, packed_size long, method int, is_tensor boolean, is_metadata boolean"


def entries(x: np.ndarray):
    """Central directory of a zip; nothing where there is none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(x.tobytes()))
    except zipfile.BadZipFile:
        return
    for e in z.infolist():
        yield e.filename, e.header_offset, e.file_size, e.compress_size, e.compress_type, "/data/" in e.filename, e.filename.endswith((".pkl", ".json"))


def zip_entries(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    return map_bytes(df, col, entries, ENTRY, keep, many=True)


def zip_of(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files:
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()
