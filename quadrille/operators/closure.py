"""Transitive closure of a relation of pairs, for the property paths `+` and `*`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut: written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class _Rounds:
    """Frames of distinct pairs. Two that hold as many rounds are written as one, so that n rounds are log n frames and a
    pair is written log n times."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, DataFrame]] = []

    def add(self, df: DataFrame) -> None:
        n = 1
        while self.parts and self.parts[-1][0] == n:
            df, n = checkpointed(self.parts.pop()[1].unionByName(df)), 2 * n
        self.parts.append((n, df))

    @property
    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for _, df in self.parts])


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with a path of one edge or more from a to b. With start (a column a), only those from there.

    Semi-naive: each round joins only the pairs that the last one found, writes only new pairs, and ends when there are
    none. Cycles end too, as a pair counts once."""
    edges = checkpointed(edges.distinct())
    new = edges if start is None else checkpointed(edges.join(start.distinct(), "a", "left_semi"))
    steps = edges.select(F.col("a").alias("m"), F.col("b").alias("n"))
    found = _Rounds()
    found.add(new)
    while not new.isEmpty():
        longer = new.join(steps, F.col("b") == F.col("m")).select("a", F.col("n").alias("b")).distinct()
        new = checkpointed(longer.join(found.all, ["a", "b"], "left_anti"))
        found.add(new)
    return found.all
