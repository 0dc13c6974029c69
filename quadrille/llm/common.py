"""What the corpus operators share: intermediate tables, keys, and word tokens in Arrow."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes is broadcast; larger ones are joined by shuffle or taken in parts.
BROADCAST_BYTES = 64 << 20

#: Texts are handed to the vectorised code in slices of about so many bytes.
SLICE_BYTES = 4 << 20

_WORD_BREAK = r"[^\pL\pM\pN]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, in
    which all is one machine; elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Table:
    """A DataFrame written to the shared folder and read again: it cuts lineage and survives lost executors.

    Tables that a result still reads can't be dropped by the operator that returns it: see drop_intermediates()."""

    live: dict[str, SparkSession] = {}

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, name)
        self.schema = df.schema
        Table.live[self.path] = self.spark
        df.write.option("compression", "zstd").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files."""
        delete_path(self.spark, self.path)
        Table.live.pop(self.path, None)

    def bytes(self) -> int:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def drop_intermediates() -> None:
    """Delete all tables of this process in the shared folder. For when the results of operators have been written:
    frames that were not written before can't be read after."""
    for path, spark in list(Table.live.items()):
        delete_path(spark, path)
        del Table.live[path]


def guarded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, with columns of its first argument that begin like the operators' own (__ql_) under other names meanwhile."""

    @wraps(operator)
    def run(docs: DataFrame, *args: object, **kwargs: object) -> DataFrame:
        taken, names = {c.lower() for c in docs.columns}, {}
        for c in docs.columns:
            if c.lower().startswith("__ql_"):
                new = f"column_{len(names)}"
                while new in taken:
                    new += "_"
                names[c] = new
        if not names:
            return operator(docs, *args, **kwargs)
        return operator(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def kind_of(df: DataFrame, name: str) -> str:
    """The type of a column, as it stands in a schema."""
    return df.select(f"`{name}`").schema[0].dataType.simpleString()


def integer_ids(df: DataFrame, name: str = "doc_id") -> None:
    """Raise where a column isn't of an integer type (a column of nulls alone is)."""
    kind = kind_of(df, name)
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{name} must be an integer, not {kind}")


def join_small(left: DataFrame, right: Table, on: list[str], how: str = "inner") -> DataFrame:
    """Join a per-key table: broadcast while its files are under BROADCAST_BYTES / 8 (they are
    compressed), else by shuffle, where adaptive execution splits skewed keys."""
    small = right.bytes() * 8 <= BROADCAST_BYTES
    return left.join(F.broadcast(right.df) if small else right.df, on=on, how=how)


def hash128(value: Column) -> list[Column]:
    """Two independent 64-bit hashes; together a key that stays collision-free at 10^14 rows."""
    return [F.xxhash64(value), F.xxhash64(F.lit(0x5BD1E995), value)]


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about SLICE_BYTES each; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start, base = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        yield start, texts.slice(start, end - start)
        start, base = end, int(sizes[end - 1])


_BYTE_VALUES = np.random.default_rng(20251).integers(0, 2**64, 256, np.uint64)


class Words:
    """Lower-cased words of a slice of texts: `ids` into `names`, text i at offsets[i]:offsets[i+1].
    Null and empty texts have no words."""

    def __init__(self, texts: pa.Array):
        clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _WORD_BREAK, " "), " ")
        parts = pc.split_pattern(clean, " ")
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.combine_chunks()
        flat = parts.flatten().dictionary_encode()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        self.names = flat.dictionary
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = np.flatnonzero(pc.equal(clean, "").to_numpy(zero_copy_only=False))
        if len(blank):  # splitting "" gives one empty word
            starts = np.concatenate(([0], np.cumsum(lengths)))
            ids = np.delete(ids, starts[blank])
            lengths[blank] = 0
        self.ids = ids
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each name: a polynomial in random values of its bytes modulo 2^64, scrambled."""
        names = self.names.cast(pa.large_binary())
        if not len(names):
            return np.empty(0, np.uint64)
        _, ends, data = names.buffers()
        ends = np.frombuffer(ends, np.int64)[names.offset : names.offset + len(names) + 1]
        size = np.diff(ends)
        if data is None or not size.any():
            return mix64(size.astype(np.uint64) + np.uint64(seed))
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        start = np.repeat(ends[:-1] - ends[0], size)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
            term = _BYTE_VALUES[raw] * powers[np.arange(len(raw)) - start]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term)))
            total = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            return mix64(total + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2^64 of every run of `size` hashed tokens, by doubling; scrambled."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    out, power, block, have, at = None, None, tokens.astype(np.uint64), 1, 0
    with np.errstate(over="ignore"):
        left = size
        while True:
            if left & 1:  # append the block of length `have` at offset `at`
                piece = block[at : at + n]
                out = piece.copy() if out is None else out * np.uint64(pow(base, have, 1 << 64)) + piece
                at += have
            left >>= 1
            if not left:
                break
            power = np.uint64(pow(base, have, 1 << 64))
            block = block[:-have] * power + block[have:]
            have *= 2
    return mix64(out)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add; names match in any case."""
    taken = {x.lower() for x in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


_BLOCK = 19  # a block of a bitmap has so many bits, as a power of two


class Filter:
    """Which 64-bit hashes may be in a set: a bitmap of 32 bits a member, and of BROADCAST_BYTES at most."""

    def __init__(self, blocks: dict[int, bytes], bits: int):
        self.bits = bits
        self.map = np.zeros(1 << (bits - 3), np.uint8)
        for k, x in blocks.items():
            self.map[k << (_BLOCK - 3) : (k + 1) << (_BLOCK - 3)] = np.frombuffer(x, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = (h.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.map[slot >> 3] >> (slot & 7).astype(np.uint8) & np.uint8(1)).astype(bool)


def filters(sets: list[tuple[DataFrame, int]]) -> list[Broadcast]:
    """Broadcast Filters of columns `key` of hashes, given with the number of their rows; one job for all of them."""
    spark: SparkSession = sets[0][0].sparkSession
    most = int(np.log2(8 * BROADCAST_BYTES))
    bits = [min(most, max(22, int(np.ceil(np.log2(32 * max(n, 1)))))) for _, n in sets]
    slots = [df.select(F.lit(i).alias("i"), F.shiftrightunsigned("key", 64 - b).alias("slot")) for i, ((df, _), b) in enumerate(zip(sets, bits))]
    # distinct, so that no block has more rows than bits
    every = reduce(DataFrame.unionByName, slots).distinct().withColumn("block", F.shiftright("slot", _BLOCK))

    def fill(t: pa.Table) -> pa.Table:
        block = np.zeros(1 << _BLOCK, bool)
        block[t.column("slot").to_numpy() & ((1 << _BLOCK) - 1)] = True
        return pa.table({"i": t.column("i")[:1], "block": t.column("block")[:1], "x": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    found: list[dict[int, bytes]] = [{} for _ in sets]
    for r in every.groupBy("i", "block").applyInArrow(fill, "i int, block long, x binary").collect():
        found[r["i"]][r["block"]] = bytes(r["x"])
    return [spark.sparkContext.broadcast(Filter(x, b)) for x, b in zip(found, bits)]
