"""A quad store on parquet: a set of quads as segments of added and of removed quads in a directory.

A version is a list of segments, in the order of writing, in a small numbered file. A batch adds a segment
and a version; segments never change, so that a reader keeps what it began with until vacuum()."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as R

_KEY = ["s", "p", "o", "g"]


def same_quad(a: str, b: str) -> Column:
    """Equality of quads of two aliases; the default graph, which is null, equals itself."""
    return (F.col(f"{a}.s") == F.col(f"{b}.s")) & (F.col(f"{a}.p") == F.col(f"{b}.p")) & (F.col(f"{a}.o") == F.col(f"{b}.o")) & F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))


#: Versions of more segments are folded into one when the next is written.
MOST_SEGMENTS = 32
#: A batch with at most so many predicates is compared with the quads of these alone.
MOST_PREDICATES = 200


class QuadStore:
    """Readers see all of a batch or nothing of it, and go on reading the version that they opened; a write that dies leaves the
    store as it was. One writer at a time: of two that write the same version, the second fails.

    A batch reads of the store what its predicates and the range of its subjects select, and writes its own size; one in
    MOST_SEGMENTS batches rewrites the store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("version-"))

    def _segments(self, number: int) -> list[tuple[str, str]] | None:
        """(sign, name) of the segments of a version; None where its file isn't complete."""
        stream = self._fs.open(self._at(f"{self.path}/version-{number:012d}"))
        try:
            text = str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return [tuple(x) for x in json.loads(text)] if text.endswith("]") else None

    def _current(self) -> tuple[int, list[tuple[str, str]]]:
        """The last complete version; (0, []) of a new store."""
        for n in reversed(self._versions()):
            if (found := self._segments(n)) is not None:
                return n, found
        return 0, []

    def _publish(self, segments: list[tuple[str, str]]) -> None:
        number = max(self._versions(), default=0) + 1
        out = self._fs.create(self._at(f"{self.path}/version-{number:012d}"), False)  # fails where it is
        try:
            out.write(json.dumps(segments).encode())
        finally:
            out.close()

    def _write(self, quads: DataFrame) -> str:
        name = uuid.uuid4().hex
        # sorted by predicate and subject: row groups that a pattern can't match are skipped by their bounds
        rows = quads.select(*_KEY).repartitionByRange("p", "s.v").sortWithinPartitions("p", "s.v")
        rows.write.parquet(f"{self.path}/data-{name}")
        return name

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(R.QUADS).parquet(f"{self.path}/data-{name}")

    def _view(self, segments: list[tuple[str, str]], where: Column | None = None) -> DataFrame:
        """The quads of a version, or those of them that meet a condition, which reaches the files. Removed quads hold for
        the segments before them; a store without removed ones is a plain scan."""
        cut = lambda df: df if where is None else df.where(where)
        parts: list[DataFrame] = []
        for sign, name in segments:
            if sign == "+":
                parts.append(cut(self._segment(name)))
            elif parts:
                before = reduce(DataFrame.unionByName, parts)
                parts = [before.alias("a").join(cut(self._segment(name)).alias("b"), same_quad("a", "b"), "left_anti")]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], R.QUADS)

    def _touched(self, batch: DataFrame) -> Column | None:
        """A condition that the quads of a batch meet, for the store to be read with; None of an empty batch."""
        subject = F.col("s.v")
        lo, hi, names = batch.agg(F.min(subject), F.max(subject), F.slice(F.collect_set("p"), 1, MOST_PREDICATES + 1)).first()
        if lo is None:
            return None
        near = subject.between(F.lit(lo), F.lit(hi))
        return near & F.col("p").isin(*names) if len(names) <= MOST_PREDICATES else near

    def _append(self, sign: str, quads: DataFrame) -> None:
        _, segments = self._current()
        if len(segments) >= MOST_SEGMENTS:
            segments = self.compact()
        self._publish([*segments, (sign, self._write(quads))])

    @property
    def quads(self) -> DataFrame:
        return self._view(self._current()[1])

    def _frame(self, quads: DataFrame | Iterable[R.Quad]) -> DataFrame:
        if isinstance(quads, DataFrame):
            return quads.select(*_KEY)
        return self.spark.createDataFrame([q.row() for q in quads], R.QUADS)

    def insert(self, quads: DataFrame | Iterable[R.Quad]) -> int:
        """Add quads in one batch; those that are there already stay once. Returns the number of different quads given."""
        _, segments = self._current()
        given = self._write(self._frame(quads).dropDuplicates(_KEY))  # a segment of its own until it is compared
        batch = self._segment(given)
        if not any(sign == "+" for sign, _ in segments):
            self._publish([("+", given)])
            return batch.count()
        where = self._touched(batch)
        if where is None:
            return 0
        there = self._view(segments, where).alias("b")
        self._append("+", batch.alias("a").join(there, same_quad("a", "b"), "left_anti"))
        return batch.count()

    def delete(self, quads: DataFrame | Iterable[R.Quad]) -> None:
        """Remove quads in one batch; those that aren't there are passed over."""
        self._append("-", self._frame(quads).dropDuplicates(_KEY))

    def clear(self) -> None:
        self._publish([])

    def compact(self) -> list[tuple[str, str]]:
        """Write the current quads as one segment. Readers of earlier versions go on."""
        _, segments = self._current()
        if len(segments) > 1:
            segments = [("+", self._write(self._view(segments)))]
            self._publish(segments)
        return segments

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last `keep`, and segments that none of these has. For when nobody reads or writes earlier ones."""
        versions = self._versions()
        kept = {name for n in versions[-keep:] for _, name in self._segments(n) or []}
        for n in versions[:-keep]:
            self._fs.delete(self._at(f"{self.path}/version-{n:012d}"), False)
        for x in self._fs.listStatus(self._at(self.path)):
            name = x.getPath().getName()
            if name.startswith("data-") and name.removeprefix("data-") not in kept:
                self._fs.delete(x.getPath(), True)

    def contains(self, quad: R.Quad) -> bool:
        g = None if quad.g is None else quad.g
        return not self.match(quad.s, quad.p, quad.o, g).isEmpty()

    def count(self) -> int:
        return self.quads.count()

    def match(self, s: object = None, p: object = None, o: object = None, g: object = None, any_graph: bool = False) -> DataFrame:
        """Quads with the given terms; None matches any term, and for g the default graph unless any_graph."""
        from .sources.graphs import QuadGraph

        q = QuadGraph(self.quads)
        df = q.quads
        for name, x in (("s", s), ("o", o)):
            if x is not None:
                df = df.where(q._is(name, x))
        if p is not None:
            df = df.where(F.col("p") == p.value)
        if g is not None:
            return df.where(q._is("g", g))
        return df if any_graph else df.where("g is null")

    def graphs(self) -> DataFrame:
        """The names of the graphs that have quads."""
        return self.quads.where("g is not null").select("g").distinct()

    def load(self, path: str, form: str | None = None, graph: R.IRI | None = None, base: str = "") -> int:
        """Read a file or folder of any supported format, once, and insert it; returns the number of quads it had."""
        from .sources.files import read_rdf

        quads = read_rdf(self.spark, path, form, base)
        if graph is not None:
            quads = quads.withColumn("g", F.coalesce(F.col("g"), R.constant(graph)))
        return self.insert(quads)

    def engine(self):  # noqa: ANN201
        """An engine over the current version."""
        from .engine import Engine

        return Engine.over_quads(self.quads)


__all__ = ["QuadStore", "same_quad"]
