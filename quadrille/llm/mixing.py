"""Mixing sources to target weights by Pareto order sampling of a fixed size in each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Table, guarded, join_small, without

#: Sources are weighted by their share of rows to this power: under 1 lifts small sources.
TEMPERATURE = 0.7
SEED = "mix-1"
#: Ranks are found in so many bins of log odds; only the bin that the cut falls into is sorted.
BINS = 4096


def size_weight(text: Column) -> Column:
    """A document's weight within its source: the bit length of its number of characters; 0 for none."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    return F.when(n > 0, F.char_length(F.bin(n))).otherwise(0).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) made of 48 bits of an MD5, the same on every engine and run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**48))


def allocate(sizes: DataFrame, budget: int | None, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """(source, x_total, take): rows to take from each source, by largest remainders; they sum to the budget."""
    every = W.partitionBy()
    total = F.sum("n").over(every)
    if weights is None:
        raw = F.round(F.pow((F.col("n") / total).cast("double"), F.lit(temperature)), 9)
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == name, F.lit(float(w))).otherwise(raw)
    raw = F.when(F.col("x_total") > 0, raw).otherwise(0.0)
    out = sizes.withColumn("raw", raw).withColumn("budget", total if budget is None else F.lit(budget).cast("long"))
    out = out.withColumn("exact", F.round(F.col("budget") * F.col("raw") / F.sum("raw").over(every), 6))
    out = out.where("raw > 0").withColumn("base", F.floor("exact"))
    order = W.orderBy((F.col("exact") - F.col("base")).desc(), F.col("source").asc_nulls_first())
    left = F.col("budget") - F.sum("base").over(every)
    return out.withColumn("take", F.col("base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).select("source", "x_total", "take")


@guarded
def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None,
    temperature: float = TEMPERATURE, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Rows of docs, each as often as it was drawn, with copy (1, 2, ...) added (a column of that name is replaced).

    A source gets its share of the budget (number of rows by default). Within it a document expects
    take * weight / total weight copies; whole copies are certain, and the fractions are the inclusion odds
    p of a Pareto order sample: the take - sum(whole) documents with the least u/(1-u) : p/(1-p), where u
    hashes seed, id and occurrence. So every source has exactly its number of rows.

    A null source is a source of its own, with weight only by temperature. A null or empty text has weight 0
    and is never drawn; a source with such texts alone gets nothing. Repeated rows (same id) are documents
    of their own and are told apart by their occurrence; null ids likewise. Ties of the ratio go to the
    lower id (null first), then occurrence. An empty table gives no rows.

    No source is sorted whole: documents are counted in bins of the ratio, and only the bin in which a
    source's cut lies is ranked."""
    docs = without(docs, "copy")
    src = F.col(f"`{source_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), src.alias("source"), size_weight(F.col(f"`{text_col}`")).alias("x"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    sizes = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_total"))
    plan = Table(allocate(sizes, budget, weights, temperature), "mix_plan")
    # the same id twice: the occurrence, in the order of hashes, is part of the key
    copies = slim.repartition("id").groupBy("id", "source", "x", "h").agg(F.count(F.lit(1)).alias("times"))
    occ = F.row_number().over(W.partitionBy("id").orderBy("source", "x", "h", "o")) - 1
    keyed = copies.withColumn("o", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    repeated = W.partitionBy("id")
    keyed = keyed.withColumn("occ", F.when(F.count(F.lit(1)).over(repeated) > 1, occ).otherwise(0))
    keyed = keyed.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    small = Table(plan.df.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"), "x_total", "take"), "mix_rates")
    e = (F.col("take") * F.col("x")).cast("double") / F.col("x_total").cast("double")
    drawn = join_small(keyed, small, ["source_key"]).withColumn("e", e).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("#"), F.col("occ").cast("string"))
    u = uniform(seed, key)
    ratio = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    slot = F.least(F.greatest(F.floor(F.log(F.col("q")) * (BINS / 128.0) + BINS / 2), F.lit(0)), F.lit(BINS - 1))
    slot = F.when(F.col("q").isNotNull(), slot)  # greatest and least pass nulls over
    drawn = Table(drawn.withColumn("q", ratio).withColumn("bin", slot).select("id", "source", "source_key", "x", "h", "times", "occ", "take", "whole", "q", "bin"), "mix_drawn")
    bins = drawn.df.groupBy("source_key", "bin").agg(F.count("q").alias("n"), F.sum("whole").alias("whole"), F.max("take").alias("take"))
    need = F.max("take").over(W.partitionBy("source_key")) - F.sum("whole").over(W.partitionBy("source_key"))
    seen = F.coalesce(F.sum("n").over(W.partitionBy("source_key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = bins.withColumn("need", need).withColumn("before", seen).where("bin is not null and before < need and before + n >= need")
    cut = Table(cut.select("source_key", F.col("bin").alias("cut_bin"), (F.col("need") - F.col("before")).alias("rest")), "mix_cut")
    placed = join_small(drawn.df, cut, ["source_key"], "left")
    inside = placed.where("bin = cut_bin").withColumn("rank", F.row_number().over(W.partitionBy("source_key").orderBy("q", F.col("id").asc_nulls_first(), "occ")))
    inside = inside.withColumn("more", F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0)).drop("rank")
    other = placed.where("bin is null or cut_bin is null or bin != cut_bin").withColumn("more", F.when(F.col("bin") < F.col("cut_bin"), 1).otherwise(0))
    chosen = inside.unionByName(other).withColumn("n", (F.col("whole") + F.col("more")).cast("int")).where("n > 0")
    chosen = chosen.groupBy("id", "source", "x", "h").agg(F.collect_list("n").alias("ns")).select(
        F.col("id").alias("__ql_id"), F.col("source").alias("__ql_s"), F.col("x").alias("__ql_x"), F.col("h").alias("__ql_h"), F.col("ns").alias("__ql_n")
    )
    left = docs.withColumns({"__ql_1": src, "__ql_2": size_weight(F.col(f"`{text_col}`")), "__ql_3": F.xxhash64(F.col(f"`{text_col}`"))})
    on = (F.col(f"`{id_col}`").eqNullSafe(F.col("__ql_id"))) & (F.col("__ql_1").eqNullSafe(F.col("__ql_s"))) & (F.col("__ql_2") == F.col("__ql_x")) & (F.col("__ql_3") == F.col("__ql_h"))
    repeats = not drawn.df.where("times > 1").isEmpty()
    return _spread(left, chosen, on, docs.columns, repeats)


def _spread(left: DataFrame, chosen: DataFrame, on: Column, columns: list[str], repeats: bool) -> DataFrame:
    """Join the draws to the rows; equal rows, if there are any, share one list of draws, of which the k-th row takes the k-th."""
    both = left.join(chosen, on)
    if not repeats:
        times = F.sequence(F.lit(1), F.element_at("__ql_n", 1))
        return both.select(*[F.col(f"`{c}`") for c in columns], F.explode(times).alias("copy"))
    alike = W.partitionBy("__ql_id", "__ql_s", "__ql_x", "__ql_h").orderBy(F.lit(1))
    both = both.withColumn("__ql_k", F.row_number().over(alike)).where(F.col("__ql_k") <= F.size("__ql_n"))
    times = F.sequence(F.lit(1), F.element_at("__ql_n", F.col("__ql_k")))
    return both.select(*[F.col(f"`{c}`") for c in columns], F.explode(times).alias("copy"))
