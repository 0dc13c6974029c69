"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A ledger is a folder in the shared storage with one sub-folder for each committed batch. A batch holds
additive totals alone (docs, tokens, chars with signs), so its size is that of the groups and not of the
documents. Totals are the sum over committed batches, but for those that a committed snapshot has folded in: a
snapshot names them in rows of its own, so that its totals and what they replace change hands in one rename."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind_of, slices
from .vocab import TOKENIZER_DIR, token_ids

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
#: Rows of a batch: its name, and totals, or the name of a batch that it folds in.
ROWS = f"batch string, folds string, {SCHEMA}"

#: Tokenizer versions of the production rollup, and their files in TOKENIZER_DIR.
TOKENIZERS = {"byte-bpe-multi-50k.v1": "byte_bpe_multi_50k.tiktoken", "piece-bpe-32k.v1": "piece_bpe_32k.model"}


def counted(
    docs: DataFrame, tokenizers: str | Sequence[str] = tuple(TOKENIZERS), tokenizer_dir: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, chars), for each row of docs one row under each tokenizer version.

    Whole texts are tokenised, in one pass for all versions. A null or empty text has 0 tokens and 0 chars; a null id,
    source or lang is carried along, and ids may be of any type; repeated rows each have their rows. Other columns of
    docs are ignored. No rows in, none out. Map only, no shuffle."""
    versions = [tokenizers] if isinstance(tokenizers, str) else list(tokenizers)
    paths = [f"{tokenizer_dir}/{TOKENIZERS.get(x, x)}" for x in versions]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list[int]] = [[] for _ in paths]
            for _, part in slices(b.column(3)):
                texts = ["" if x is None else x for x in part.to_pylist()]
                for own, path in zip(n, paths):
                    own += [len(x) for x in token_ids(path, texts)]
            for own, version in zip(n, versions):
                cols = [*b.columns[:3], pa.array([version] * b.num_rows, pa.string()), pa.array(np.array(own, np.int64)), b.column(4)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "lang", "tokenizer", "tokens", "chars"])

    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), text.alias("text"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"),
    )
    return narrow.mapInArrow(count, f"doc_id {kind_of(docs, id_col)}, source string, lang string, tokenizer string, tokens long, chars long")


def inserts(rows: DataFrame) -> DataFrame:
    """Delta of added documents: rows of counted()."""
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    """Delta of removed documents: rows of counted() as they were added."""
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Delta of changed documents: minus the old rows, plus the new. Groups may change too."""
    return _signed(old, -1).unionByName(_signed(new, 1))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    s = F.lit(sign).cast("long")
    return rows.select(*GROUP, s.alias("docs"), (s * F.col("tokens")).alias("tokens"), (s * F.col("chars")).alias("chars"))


class Ledger:
    """Batches of deltas in a shared folder; each batch id counts once, however often it is committed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{path}/batches"))

    def has(self, batch: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/batches/{batch}/_SUCCESS"))

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Write the batch's totals and rename them into place; False if the batch was there already.

        A run that dies before the rename leaves only a staging folder, which no reader sees; a rerun of
        the batch, or of another driver racing it, adds nothing, as the rename fails where the target is."""
        totals = delta.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        return self._place(batch, totals.select(F.lit(batch).alias("batch"), F.lit(None).cast("string").alias("folds"), "*"))

    def _place(self, batch: str, rows: DataFrame) -> bool:
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.has(batch):
            return False
        staged = f"{self.path}/_staging/{batch}-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(staged)
        target = self._at(f"{self.path}/batches/{batch}")
        done = not self._fs.exists(target) and self._fs.rename(self._at(staged), target)
        if done and not self.has(batch):  # some file systems move into a folder that has come up meanwhile
            done = False
        if not done:
            self._fs.delete(self._at(staged), True)
        return bool(done)

    def batches(self) -> list[str]:
        found = self._fs.listStatus(self._at(f"{self.path}/batches"))
        return sorted(x.getPath().getName() for x in found if self.has(x.getPath().getName()))

    def _every(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.path}/batches/{x}" for x in names])

    def _totals(self, names: list[str]) -> DataFrame:
        every = self._every(names)
        folded = every.where("folds is not null").select(F.col("folds").alias("batch")).distinct()
        left = every.where("folds is null").join(folded, "batch", "left_anti")
        return left.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).where("docs != 0 or tokens != 0 or chars != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars) over committed batches; groups without documents go."""
        return self._totals(self.batches())

    def compact(self, batch: str) -> bool:
        """Fold all batches into one snapshot batch; False, and nothing is changed, if a batch of that name is there.

        The snapshot holds the totals of the batches that it names, and readers pass over what a snapshot names: wherever
        a run dies, every batch counts once. Ids of folded batches stay known. Their data stays until vacuum()."""
        names = self.batches()
        if batch in names:
            return False
        totals = self._totals(names).select(F.lit(batch).alias("batch"), F.lit(None).cast("string").alias("folds"), *GROUP, *SUMS)
        folds = self.spark.createDataFrame([(batch, x, None, None, None, None, None, None) for x in names], ROWS)
        return self._place(batch, totals.unionByName(folds))

    def vacuum(self) -> None:
        """Delete the data of batches that a committed snapshot has folded in, and staging folders of dead runs; folders of
        batches stay, as markers. For when nobody reads totals() of an earlier state or commits."""
        folded = self._every(self.batches()).where("folds is not null").select("folds").distinct()
        for (x,) in folded.collect():  # names of batches alone
            for f in self._fs.listStatus(self._at(f"{self.path}/batches/{x}")):
                if f.getPath().getName() != "_SUCCESS":
                    self._fs.delete(f.getPath(), False)
        self._fs.delete(self._at(f"{self.path}/_staging"), True)
