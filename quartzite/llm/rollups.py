"""Token counts as delta-maintained rollups.

A batch of signed changes (+1 for an inserted document, -1 for a deleted one; a revised count is both) is summed to one row per
source, language and tokenizer version before it is stored, and totals are the sums over all batches.  A batch is a folder named
by its id that appears by one rename: committing an id again changes nothing, whether the first attempt finished or died half way.
`compact` sums the batches up in one base folder, which keeps their ids, so that totals don't read every batch ever committed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm.common import arrow_batches, new_path
from quartzite.llm.scan import NON_SPACE, pieces, spans, text_chunks
from quartzite.llm.tokens import vocabulary, word_bpe

#: In a base folder: its sums, and the names of the batches in them.
ROWS, IDS = "rows", "batches"
KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
CHANGE = "source string, lang string, tokenizer string, sign long, tokens long"


#: Tokenizer versions: a vocabulary file of the public tokenizers, or "blank_words": runs of non-blank characters.
VERSIONS = ("word_bpe_49k.json", "blank_words")


def count_tokens(raw: np.ndarray, offs: np.ndarray, version: str, path: str | None) -> np.ndarray:
    if version == "blank_words":
        if len(offs) == 2:  # one text, of any length
            return np.array([sum(len(spans(raw[a:b], np.array([0, b - a]), NON_SPACE)[0]) for a, b in pieces(raw, NON_SPACE))])
        return np.bincount(spans(raw, offs, NON_SPACE)[2], minlength=len(offs) - 1).astype(np.int64)
    return word_bpe(path).counts(raw, offs)


def _changes(batches: Iterator[pa.RecordBatch], versions: dict[str, str | None]) -> Iterator[pa.RecordBatch]:
    """(source, lang, sign, text) to a change for each tokenizer version."""
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(3)):
            part = batch.slice(i, j - i)
            for name, path in versions.items():
                n = count_tokens(raw, offs, name, path)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([name] * (j - i)), part.column(2), pa.array(n)], ["source", "lang", "tokenizer", "sign", "tokens"])


def token_changes(docs: DataFrame, sign: int | Column = 1, versions: Sequence[str] = VERSIONS, vocab_dir: str | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A signed change for each document and tokenizer version; `sign` may be a column with a number of copies.

    Null and empty texts have no tokens; null source and language are groups of their own; very long texts are counted in
    stretches; repeated rows count each; an empty table gives no change; other columns are ignored whatever their names.
    """
    arrow_batches(docs.sparkSession)
    paths = {v: None if v == "blank_words" else f"{vocab_dir}/{v}" if vocab_dir else vocabulary(v) for v in versions}
    signs = sign if isinstance(sign, Column) else F.lit(sign)
    src = docs.select(F.col(source_col).cast("string"), F.col(lang_col).cast("string"), signs.cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(partial(_changes, versions=paths), CHANGE)


def revisions(old: DataFrame, new: DataFrame, id_col: str = "doc_id", versions: Sequence[str] = VERSIONS) -> DataFrame:
    """Changes that turn the counts of `old` into those of `new`: only documents that differ in text, source or language are counted.

    Rows are told apart by a digest of their whole content, so repeated rows and null ids are counted as often as they stand there.
    Only digests are compared; the texts of the rows that changed are joined back.
    """
    cols = [id_col, "source", "lang", "text"]
    both = new.select(*cols, F.lit(1).alias("side")).unionByName(old.select(*cols, F.lit(-1).alias("side")))
    both = both.withColumn("digest", F.sha2(F.to_json(F.struct(*cols)), 256))
    net = both.groupBy("digest").agg(F.sum("side").alias("net")).where("net <> 0").withColumnRenamed("digest", "of")
    rows = both.join(net, F.col("digest") == F.col("of")).dropDuplicates(["digest"])
    return token_changes(rows, F.col("net"), versions)


class TokenRollup:
    """The batches under one folder of a store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @staticmethod
    def _name(batch_id: str) -> str:
        return f"batch-{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def _names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path("")))
        return sorted(n for n in names if n.startswith(prefix))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base folder and the batches that are in it."""
        found = self._names("base-")
        if not found:
            return None, set()
        rows = self.spark.read.text(f"{self.path}/{found[-1]}/{IDS}").collect()
        return found[-1], {r[0] for r in rows}

    def committed(self, batch_id: str) -> bool:
        return self.fs.exists(self._path(self._name(batch_id))) or self._name(batch_id) in self._base()[1]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add `changes` (source, lang, tokenizer, sign, tokens) under `batch_id`; False if it has been committed before."""
        if self.committed(batch_id):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        draft = f"draft-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/{draft}")
        if not self.committed(batch_id) and self.fs.rename(self._path(draft), self._path(self._name(batch_id))):
            # a rival may have been first: then the rename put this draft inside its folder
            inside = self._path(f"{self._name(batch_id)}/{draft}")
            if not self.fs.exists(inside):
                return True
            self.fs.delete(inside, True)
            return False
        self.fs.delete(self._path(draft), True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all batches; groups that have come to nothing are left out."""
        base, inside = self._base()
        paths = [f"{self.path}/{base}/{ROWS}"] * bool(base) + [f"{self.path}/{n}" for n in self._names("batch-") if n not in inside]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        all_rows = self.spark.read.schema(DELTA).parquet(*paths)
        return all_rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Sum all batches up in a new base; False if there is nothing to do or a rival was first.  It may be repeated, or die at any point.

        The base appears by one rename, with the ids of its batches; their folders go only then.
        """
        base, inside = self._base()
        fresh = [n for n in self._names("batch-") if n not in inside]
        if fresh:
            draft, name = f"draft-{uuid.uuid4().hex}", f"base-{int(base[5:]) + 1 if base else 1:012d}"
            self.totals().write.parquet(f"{self.path}/{draft}/{ROWS}")
            self.spark.createDataFrame([(n,) for n in sorted(inside | set(fresh))], "n string").coalesce(1).write.text(f"{self.path}/{draft}/{IDS}")
            if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(draft), self._path(name)) or self.fs.exists(self._path(f"{name}/{draft}")):
                self.fs.delete(self._path(f"{name}/{draft}"), True)
                self.fs.delete(self._path(draft), True)
                return False
            base, inside = name, inside | set(fresh)
        for n in [*(n for n in self._names("batch-") if n in inside), *self._names("base-")]:
            if n != base:
                self.fs.delete(self._path(n), True)
        return bool(fresh)


#: The language whose texts `op5_token_counts` revises.
REVISED = "es"


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents, by way of an earlier state: Spanish texts ended in a draft mark, and were revised later.

    The first batch inserts that state, the second deletes and inserts what has changed, and the first is committed once more, to no effect.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    draft = lambda d: d.withColumn("text", F.concat("text", F.lit(" (draft)")))
    mine = F.coalesce(F.col("lang") == REVISED, F.lit(False))
    before = docs.withColumn("text", F.when(mine, F.concat("text", F.lit(" (draft)"))).otherwise(F.col("text")))
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    rollup.commit("drafts", token_changes(before))
    rollup.commit("revised", revisions(draft(docs.where(mine)), docs.where(mine)))
    rollup.commit("drafts", token_changes(before))
    return rollup.totals()
