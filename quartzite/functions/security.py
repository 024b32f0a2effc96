"""Encrypted containers: magic, salt, nonce, AES-256-GCM with the magic as additional data; the key by PBKDF2-HMAC-SHA256."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC, ROUNDS = b"QZENC\x01\x00", 100_000


def derive_key(passphrase: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def is_encrypted(data: Column) -> Column:
    return F.hex(F.substring(data, 1, len(MAGIC))) == MAGIC.hex().upper()


def encrypt(df: DataFrame, col: str, passphrase: str, salt: bytes | None = None) -> DataFrame:
    """`col` (binary) as containers.  One salt for a call, so one key derivation; every value has a nonce of its own."""
    salt = salt or os.urandom(16)
    key = F.lit(bytearray(derive_key(passphrase, salt)))
    # an empty iv argument stands for a random one
    body = F.aes_encrypt(F.col(col), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.lit(bytearray(MAGIC)))
    return df.withColumn(col, F.concat(F.lit(bytearray(MAGIC)), F.lit(bytearray(salt)), body))


def _derive(passphrase: str):
    def keys(salts: pd.Series) -> pd.Series:
        return salts.map(lambda s: derive_key(passphrase, bytes(s)))

    return keys


#: Salts whose keys are broadcast at most; with more, rows are joined by salt and one of BUCKETS.
SENT_SALTS, BUCKETS = 4096, 32


def decrypt(df: DataFrame, col: str, passphrase: str, strict: bool = True) -> DataFrame:
    """Containers of any number of salts, a key derivation for each.  A wrong key, a changed byte or what is no container is an error, or null if not `strict`.

    The salts are counted first: a call of `encrypt` has one, and then nothing is shuffled.
    """
    box = F.col("row")[col]
    salted = df.select(F.struct(*df.columns).alias("row"))
    salted = salted.select("row", F.when(is_encrypted(box), F.substring(box, len(MAGIC) + 1, 16)).alias("salt"), F.pmod(F.hash(box), F.lit(BUCKETS)).alias("bucket"))
    keys = salted.select(F.col("salt").alias("of")).where("of is not null").distinct()
    few = keys.limit(SENT_SALTS + 1).collect()
    if len(few) <= SENT_SALTS:
        keys = df.sparkSession.createDataFrame(few, "of binary")
    keys = keys.withColumn("key", F.pandas_udf(_derive(passphrase), "binary")("of"))
    if len(few) <= SENT_SALTS:
        found = salted.join(F.broadcast(keys), F.col("salt") == F.col("of"), "left")
    else:  # a salt may stand in any share of the rows
        keys = keys.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
        found = salted.join(keys, (F.col("salt") == F.col("of")) & (F.col("bucket") == F.col("b")), "left")
    fn = F.aes_decrypt if strict else F.try_aes_decrypt
    plain = fn(F.substring(box, len(MAGIC) + 17, 1 << 30), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray(MAGIC)))
    no = F.raise_error(F.lit("not an encrypted container")).cast("binary") if strict else F.lit(None).cast("binary")
    out = F.when(box.isNull(), None).when(F.col("key").isNotNull(), plain).otherwise(no)
    return found.select(*((out if c == col else F.col("row")[c]).alias(c) for c in df.columns))
