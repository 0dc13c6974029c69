"""Sharding by a k-d tree over document metadata, cut at weighted medians until leaves have the target bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, guarded, join_small, without

TARGET_BYTES = 16 << 20
#: Nodes with at most so many distinct metadata vectors are finished inside one task, by the same rule.
LOCAL_ROWS = 1 << 17
DIMS = ["d0", "d1", "d2", "d3"]
#: The last dimension only breaks ties: it is cut where no other has any width left.
WEIGHTS = [1.0, 1.0, 1.0, 1e-9]


def vector(lang: Column, source: Column, text: Column, key: Column) -> list[Column]:
    """The metadata dimensions as integers: hashed language, hashed source, log size, 16 hashed bits of the id."""
    code = lambda c: F.when(c.isNull(), -1).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << 20)))
    size = F.round(1000 * F.log2(1.0 + F.coalesce(F.char_length(text), F.lit(0))))
    tie = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 16))
    return [x.cast("long").alias(d) for x, d in zip((code(lang), code(source), size, tie), DIMS)]


def cut(values: np.ndarray, weights: np.ndarray) -> int | None:
    """The value v below the largest for which the weight of values <= v is nearest to half; the lower of two. None if all are equal."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    if len(first) < 2:
        return None
    sums = np.cumsum(np.add.reduceat(w, first))
    return int(v[first][np.argmin(np.abs(2 * sums[:-1] - sums[-1]))])


def widest(low: np.ndarray, high: np.ndarray, span: np.ndarray) -> int:
    """The dimension with the most width as a share of the whole table's; the first of equals."""
    return int(np.argmax((high - low) / np.maximum(span, 1) * np.array(WEIGHTS)))


def split_locally(x: np.ndarray, weight: np.ndarray, span: np.ndarray, target: int, path: str = "") -> list[str]:
    """The path ('0': low side, '1': high side) of the leaf of each row of x."""
    out = np.full(len(x), "", object)
    todo = [(np.arange(len(x)), path)]
    while todo:
        rows, at = todo.pop()
        v = None
        if weight[rows].sum() > target:
            d = widest(x[rows].min(0), x[rows].max(0), span)
            v = cut(x[rows, d], weight[rows])
        if v is None:
            out[rows] = at
            continue
        low = x[rows, d] <= v
        todo += [(rows[low], at + "0"), (rows[~low], at + "1")]
    return out.tolist()


def leaves(docs: DataFrame, target_bytes: int = TARGET_BYTES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(d0 .. d3, weight, shard) of each distinct metadata vector; shard is its leaf's path."""
    weight = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")
    vec = docs.select(*vector(F.col("lang"), F.col("source"), F.col("text"), F.col("doc_id")), weight.alias("w"))
    vec = vec.groupBy(*DIMS).agg(F.sum("w").alias("w")).withColumn("node", F.lit(""))
    live = Table(vec, "kd_0")
    ends = live.df.agg(*[F.min(d) for d in DIMS], *[F.max(d) for d in DIMS]).first()
    span = [(b or 0) - (a or 0) for a, b in zip(ends[:4], ends[4:])]
    dims = F.array(*DIMS)
    while True:
        stats = live.df.groupBy("node").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("w").alias("total"), *[(F.max(d) - F.min(d)).alias(f"r{i}") for i, d in enumerate(DIMS)]
        )
        big = stats.where((F.col("rows") > local_rows) & (F.col("total") > target_bytes) & F.greatest(*[f"r{i}" for i in range(4)]).__gt__(0))
        width = F.greatest(*[F.col(f"r{i}") / float(max(span[i], 1)) * WEIGHTS[i] for i in range(4)])
        pick = F.lit(0)
        for i in (3, 2, 1, 0):
            pick = F.when(F.col(f"r{i}") / float(max(span[i], 1)) * WEIGHTS[i] == width, i).otherwise(pick)
        plan = Table(big.select("node", "total", pick.alias("dim")), "kd_plan")
        if plan.df.isEmpty():
            plan.drop()
            break
        value = F.element_at(dims, F.col("dim") + 1)
        sums = join_small(live.df, plan, ["node"]).select("node", "total", "dim", value.alias("v"), "w")
        sums = sums.groupBy("node", "total", "dim", "v").agg(F.sum("w").alias("w"))
        run = F.sum("w").over(W.partitionBy("node").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        far = F.abs(2 * F.col("run") - F.col("total"))
        at = sums.withColumn("run", run).where("run < total").groupBy("node", "dim").agg(F.min(F.struct(far.alias("f"), "v")).alias("x"))
        cuts = Table(at.select("node", "dim", F.col("x.v").alias("v")), "kd_cuts")
        side = F.when(value <= F.col("v"), "0").otherwise("1")
        moved = join_small(live.df, cuts, ["node"], "left")
        moved = moved.withColumn("node", F.when(F.col("v").isNull(), F.col("node")).otherwise(F.concat("node", side)))
        after = Table(moved.select(*DIMS, "w", "node"), "kd_level")
        for t in (live, plan, cuts):
            t.drop()
        live = after
    width_of = np.array(span, np.float64)

    def finish(group: pa.Table) -> pa.Table:
        x = np.column_stack([group.column(d).to_numpy() for d in DIMS])
        path = split_locally(x, group.column("w").to_numpy(), width_of, target_bytes, group.column("node")[0].as_py())
        return pa.table([*(group.column(d) for d in DIMS), group.column("w"), pa.array(path, pa.string())], names=[*DIMS, "weight", "shard"])

    # each node is one group: a node over local_rows that reached here has vectors that are all equal, hence one
    return live.df.groupBy("node").applyInArrow(finish, "d0 long, d1 long, d2 long, d3 long, weight long, shard string")


@guarded
def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """All rows and columns of docs with shard (the leaf's path in the tree) and shard_id (its rank, from 0).

    A node over target_bytes of UTF-8 text is cut in two at the weighted median (to the nearest value
    that leaves both sides rows) of its widest dimension, until no node is over the target or all its
    documents agree in every dimension: one document over the target, or rows that repeat one, stay together.
    The result doesn't depend on local_rows or on how rows are partitioned. Null language, source, text
    or id are values like any other; a null or empty text weighs one byte. Columns of docs named shard or
    shard_id are replaced. No rows in, none out. Only metadata takes part in building the tree; texts move
    once, to meet their shard."""
    docs = without(docs, "shard", "shard_id")
    tree = Table(leaves(docs, target_bytes, local_rows), "kd_leaves")
    rank = F.row_number().over(W.orderBy("shard")) - 1
    ids = Table(tree.df.select("shard").distinct().withColumn("shard_id", rank), "kd_ids")
    placed = join_small(tree.df, ids, ["shard"]).select(*[F.col(d).alias(f"__ql_{d}") for d in DIMS], "shard", "shard_id")
    keys = {f"__ql_{d}": v for d, v in zip(DIMS, vector(F.col("lang"), F.col("source"), F.col("text"), F.col("doc_id")))}
    return docs.withColumns(keys).join(placed, list(keys)).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "shard_id")
