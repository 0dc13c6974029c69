"""Substring dedup by level-wise doubling: repeated windows of 25 words, of these 50, of these 100, and so on.

Level 25 is sampled by its content: of the 26 windows of 25 words in each window of 50, the one with the
least hash is the anchor. Equal windows of 50 words have equal anchors at the same place, so nothing of
50 words or over is missed. Anchors are counted with map-side sums, eight bytes each; those that occur once
end there. Around the others the windows of 50 words are compared, all of them, which gives the spans to
the word. Windows that repeat at one length alone are extended to twice that length, until none repeats.
Of a window of 100 words, the 50 that begin or the 50 that end with its least window of 25 words lie within it (or
both do), and repeat if it does; of these halves the repeated ones are remembered, and so on. All windows are
compared whose halves are among them.

What survived a level comes back to the texts as a bitmap of bounded size, and not by a shuffle of texts. A
hash that is in the bitmap by accident costs a comparison and changes no result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Filter, Table, Words, filters, guarded, integer_ids, mix64, slices, window_hashes

BASE = 25
LENGTH = 2 * BASE
#: Anchors in more rows than this (or than a share of all, so that there are at most MANY such) have their windows
#: counted one by one, with map-side sums, instead of meeting in one task.
HOT, MANY = 20_000, 50_000
_UNIT = 6  # bytes of a window's hash beside its anchor's 8
_TOGETHER = BASE + 1  # windows that a packed row has at most
_ROW = "anchor long, doc long, pos int, first int, n int, hashes binary"
_RUN = "doc long, s long, e long, words long, extra boolean, key long"
_WINDOW = "a long, key long, doc long, pos long"


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in each run of `width` values, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        have += step
    return at[:n]


class Anchored:
    """The words of a slice of texts as hashes, and their windows."""

    def __init__(self, words: Words):
        self.tokens = words.hashes()[words.ids]
        self.offsets = words.offsets
        self.text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.end = self.offsets[1:][self.text]  # of each word's text
        self.h25 = window_hashes(self.tokens, BASE)

    def starts(self, length: int) -> np.ndarray:
        """Where windows of this length start, each inside one text."""
        n = max(len(self.tokens) - length + 1, 0)
        return np.flatnonzero(np.arange(n) + length <= self.end[:n])

    def anchors(self, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window of this length that has it, how many have it) of the slice, and all those windows."""
        start = self.starts(length)
        if not len(start):
            return (np.empty(0, np.int64),) * 4
        anchor = least(self.h25, length - BASE + 1)[start]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        return anchor[new], start[new], np.diff(np.r_[new, len(start)]), start

    def extended(self, length: int, known: Filter) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, start) of the windows of this length whose halves beside the anchor, so far as they are within, are known."""
        anchor, _, n, start = self.anchors(length)
        if not len(start):
            return anchor, start
        half = length // 2
        h = window_hashes(self.tokens, half) << np.uint64(16)
        after = known.has(h[np.minimum(anchor, len(h) - 1)])
        before = known.has(h[np.maximum(anchor + BASE - half, 0)])
        at = np.repeat(anchor, n)
        go = (np.repeat(after, n) | (at - start > half)) & (np.repeat(before, n) | (at - start < half - BASE))
        return at[go], start[go]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, h, text) of the rows that can be named; h hashes the id."""
    doc = F.col("doc_id").cast("long")
    return docs.where(F.col("doc_id").isNotNull()).select(doc.alias("doc"), F.xxhash64(doc).alias("h"), F.col("text").alias("text"))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(key, n) of each anchor that is in two rows or more. It counts once a slice of a row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in slices(b.column(2)):
                t = Anchored(Words(part))
                a = t.anchors()[0]
                if len(a):
                    order = np.lexsort((t.h25[a], t.text[a]))
                    h, own = t.h25[a][order], t.text[a][order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64))], names=["key"])

    return rows.mapInArrow(emit, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _blob(windows: np.ndarray, n: np.ndarray) -> pa.Array:
    """_UNIT bytes of each window's hash, n windows a value."""
    data = np.ascontiguousarray(windows).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_UNIT]
    bounds = np.concatenate(([0], np.cumsum(n))) * _UNIT
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def packed_windows(rows: DataFrame, known: Broadcast, hot: Broadcast) -> DataFrame:
    """_ROW of each repeated anchor in each text, but of hot ones: the windows of 50 words around it, as hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, part in slices(b.column(2)):
                t = Anchored(Words(part))
                anchor, first, n, start = t.anchors()
                if not len(anchor):
                    continue
                h = t.h25[anchor]
                go = known.value.has(h) & ~np.isin(h.view(np.int64), hot.value)
                if not go.any():
                    continue
                units = window_hashes(t.tokens, LENGTH)[start[np.repeat(go, n)]]
                anchor, first, n = anchor[go], first[go], n[go]
                own = t.text[anchor]
                cols = [pa.array(t.h25[anchor].view(np.int64)), pa.array(ids[at + own]), *[pa.array(x.astype(np.int32)) for x in (anchor - t.offsets[own], first - anchor, n)], _blob(units, n)]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "doc", "pos", "first", "n", "hashes"])

    return rows.mapInArrow(emit, _ROW)


def _meet(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, doc): the windows that two documents have, as runs. State is kept for the
    anchor that a batch ends in: a window with its documents so far, not its occurrences."""
    carry: tuple[np.ndarray, ...] | None = None
    carry_anchor = None
    for b in batches:
        if not b.num_rows:
            continue
        anchor, doc, pos, first, n = (b.column(i).to_numpy() for i in range(5))
        lone = np.r_[True, anchor[1:] != anchor[:-1]] & np.r_[anchor[1:] != anchor[:-1], True]
        lone[-1] = False  # it may go on in the next batch
        goes_on = carry_anchor is not None and anchor[0] == carry_anchor
        if goes_on:
            lone[0] = False
        keep = np.flatnonzero(~lone)
        raw = np.frombuffer(b"".join(b.column(5).take(pa.array(keep)).to_pylist()), np.uint8).reshape(-1, _UNIT)
        units = np.zeros((len(raw), 8), np.uint8)
        units[:, :_UNIT] = raw
        units = units.view("<u8").ravel()
        sizes = n[keep].astype(np.int64)
        row = np.repeat(keep, sizes)
        k = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            key = units ^ (anchor[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ends = anchor == anchor[-1]
        # of a window that begins or ends with its anchor the hash is kept, for the next level
        place = first[row] + k
        sample = np.where((place == 0) | (place == BASE - length), (units << np.uint64(16)).view(np.int64), 0)
        cols = [key, doc[row], (pos[row] + place).astype(np.int64), sample, np.zeros(len(key), bool), ends[row]]
        if goes_on:
            cols = [np.concatenate(x) for x in zip((*carry, np.full(len(carry[0]), ends[0])), cols)]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        keys, docs, places, samples, done, tail = (x[order] for x in cols)
        lo = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.r_[lo, len(keys)])
        if len(lo):
            shared = np.repeat((docs[lo] != docs[lo + size - 1]) | np.logical_or.reduceat(done, lo), size)
            original = docs == np.repeat(docs[lo], size)  # the lowest id keeps its passage
            out = np.flatnonzero(shared & ~done)
            if len(out):
                yield _runs(docs[out], places[out], ~original[out], samples[out], length)
            # of a shared window one row stays as a mark (its lowest document), of others all rows
            mark = np.zeros(len(keys), bool)
            mark[lo] = True
            stay = tail & (~shared | mark)
            carry = (keys[stay], docs[stay], places[stay], samples[stay], shared[stay])
        else:
            carry = tuple(x[:0] for x in (keys, docs, places, samples, done))
        carry_anchor = anchor[-1]


def _runs(doc: np.ndarray, at: np.ndarray, extra: np.ndarray, sample: np.ndarray, length: int) -> pa.RecordBatch:
    """_RUN rows of windows of this length, neighbours as one; a window with a sample is a row of its own too."""
    order = np.lexsort((at, extra, doc))
    doc, at, extra, sample = doc[order], at[order], extra[order], sample[order]
    step = (doc[1:] != doc[:-1]) | (extra[1:] != extra[:-1]) | (at[1:] > at[:-1] + 1)
    lo = np.flatnonzero(np.r_[True, step])
    hi = np.r_[lo[1:], len(doc)] - 1
    one = np.flatnonzero(sample)
    a, z = np.r_[lo, one], np.r_[hi, one]
    key = pa.array(np.r_[np.zeros(len(lo), np.int64), sample[one]], mask=np.arange(len(a)) < len(lo))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[a]), pa.array(at[a]), pa.array(at[z] + length), pa.array(np.full(len(a), length)), pa.array(extra[a]), key],
        names=["doc", "s", "e", "words", "extra", "key"],
    )


def hot_windows(rows: DataFrame, hot: Broadcast) -> DataFrame:
    """_WINDOW rows of all windows of 50 words of the hot anchors."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, part in slices(b.column(2)):
                t = Anchored(Words(part))
                anchor, _, n, start = t.anchors()
                go = np.repeat(np.isin(t.h25[anchor].view(np.int64), hot.value), n) if len(anchor) else np.zeros(0, bool)
                if go.any():
                    yield pa.RecordBatch.from_arrays(_single(t, np.repeat(anchor, n)[go], start[go], LENGTH, ids, at), names=["a", "key", "doc", "pos"])

    return rows.mapInArrow(emit, _WINDOW)


def _single(t: Anchored, a: np.ndarray, p: np.ndarray, length: int, ids: np.ndarray, at: int) -> list[pa.Array]:
    """Columns of _WINDOW: hashes are as the units of packed windows are."""
    h = window_hashes(t.tokens, length)[p] << np.uint64(16)
    return [pa.array(t.h25[a].view(np.int64)), pa.array(h.view(np.int64)), pa.array(ids[at + t.text[p]]), pa.array(p - t.offsets[t.text[p]])]


def extended(rows: DataFrame, length: int, known: Broadcast, live: Broadcast, hot: Broadcast) -> DataFrame:
    """All windows of this length in live documents whose halves beside the anchor are known to repeat. Those that begin
    with their anchor, or whose anchor is hot, are _WINDOW rows; the others are _ROW rows of at most _TOGETHER windows.
    Equal windows are as far from their anchors, so that an anchor's windows are parted by that distance."""
    names = ["a", "key", "doc", "pos", "anchor", "first", "n", "hashes"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(live.value.has(b.column(1).to_numpy())))
            ids = b.column(0).to_numpy()
            for i, part in slices(b.column(2)):
                t = Anchored(Words(part))
                a, p = t.extended(length, known.value)
                if not len(p):
                    continue
                one = (a == p) | np.isin(t.h25[a].view(np.int64), hot.value)
                if one.any():
                    cols = _single(t, a[one], p[one], length, ids, i)
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(cols[0]), k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]], names=names)
                a, p = a[~one], p[~one]
                if not len(p):
                    continue
                block = (a - p) // _TOGETHER
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (block[1:] != block[:-1])])
                n = np.diff(np.r_[new, len(p)])
                at, own = a[new], t.text[a[new]]
                with np.errstate(over="ignore"):
                    anchor = mix64(t.h25[at] + block[new].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                none, short = pa.nulls(len(n), pa.int64()), lambda x: pa.array(x.astype(np.int32))
                cols = [none, none, pa.array(ids[i + own]), pa.array(at - t.offsets[own]), pa.array(anchor), short(p[new] - at), short(n), _blob(window_hashes(t.tokens, length)[p], n)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(emit, f"{_WINDOW}, anchor long, first int, n int, hashes binary")


def _counted(windows: DataFrame, words: int) -> Table | None:
    """_RUN rows of the _WINDOW rows that two documents have; None if there are none. A window of very many documents is one
    row a task in the sums, and in the join it is one that adaptive execution splits."""
    every = Table(windows, "windows")
    low = every.df.groupBy("a", "key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    met = every.df.join(low, ["a", "key"]).select("doc", F.col("pos").alias("s"), (F.col("pos") + words).alias("e"), F.lit(words).cast("long").alias("words"), (F.col("doc") != F.col("low")).alias("extra"), "key")
    found = Table(met, "repeats")
    every.drop()
    if found.df.isEmpty():
        found.drop()
        return None
    return found


def repeats(docs: DataFrame, hot_rows: int = HOT) -> list[Table]:
    """The repeated windows of docs as _RUN rows, in a table for each level (and one for hot anchors)."""
    rows = _rows(docs)
    spark = docs.sparkSession
    anchors = Table(repeated_anchors(rows), "anchors")
    n, total = anchors.df.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        anchors.drop()
        return []
    limit = max(hot_rows, total // MANY)
    crowded = np.sort(np.array([r[0] for r in anchors.df.where(F.col("n") > limit).select("key").collect()], np.int64))
    hot = spark.sparkContext.broadcast(crowded)
    known = filters([(anchors.df, n)])[0]
    met = lambda packed, length: Table(packed.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(partial(_meet, length), _RUN), "repeats")
    out = [met(packed_windows(rows, known, hot), LENGTH)]
    anchors.drop()
    if len(crowded) and (more := _counted(hot_windows(rows, hot), LENGTH)) is not None:
        out.append(more)
    length, last = LENGTH, [*out]
    while last:
        # hashes of windows that repeat at this length, and the documents that have them, go on to the next
        now = reduce(DataFrame.unionByName, [t.df for t in last]).where("key is not null")
        size = now.count()
        known, live = filters([(now.select("key"), size), (now.select(F.xxhash64("doc").alias("key")), size)])
        length *= 2
        every = Table(extended(rows, length, known, live, hot), "extended")
        single = every.df.where("hashes is null").select("a", "key", "doc", "pos")
        packed = every.df.where("hashes is not null").select("anchor", "doc", F.col("pos").cast("int").alias("pos"), "first", "n", "hashes")
        last = [t for t in (_counted(single, length), met(packed, length)) if t is not None and not t.df.isEmpty()]
        every.drop()
        out += last
    return out


def _islands(runs: DataFrame) -> DataFrame:
    """Runs of a document that overlap or touch, as one span each."""
    by = W.partitionBy("doc").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)
    spans = runs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by))
    spans = spans.groupBy("doc", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.max("words").alias("longest"))
    return spans.select(F.col("doc").alias("doc_id"), "start_word", "end_word", "longest")


def repeated_spans(docs: DataFrame, extra_only: bool = False, hot_rows: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, longest): the spans of each document whose every word is in a passage
    of at least 50 words that another document has too; longest is the greatest level (50, 100, 200, ...)
    at which a window in it still repeats. With extra_only, passages count only in documents other than the one
    with the lowest id.

    Words are runs of letters, marks and digits, in lower case; places count words from 0. Ids are integers. Rows with the
    same id are one document, so a passage that only they have is not shared; their places may overlap. Rows
    with a null id can't be named and take no part. Null, empty and short texts have no spans; a table without rows
    has none. Anchors in more than hot_rows rows are compared by sums instead of in one task, with the same result."""
    integer_ids(docs)
    tables = repeats(docs, hot_rows)
    if not tables:
        return docs.sparkSession.createDataFrame([], "doc_id long, start_word long, end_word long, longest long")
    runs = reduce(DataFrame.unionByName, [t.df for t in tables]).drop("key")
    return _islands(runs.where("extra") if extra_only else runs)


_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in sorted(spans):
        if s < len(places):
            out.append(text[at : places[s][0]])
            at = max(at, places[min(e, len(places)) - 1][1])
    return "".join([*out, text[at:]])


@guarded
def substring_dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with passages of 50 words and over cut from text in every document
    but the one with the lowest id that has them. Rows without such passages, and with null ids, are unchanged."""
    spans = repeated_spans(docs, extra_only=True)
    held, own = "__ql_spans", "__ql_id"
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias(held)).withColumnRenamed("doc_id", own)
    both = docs.join(spans, F.col("doc_id") == F.col(own), "left")

    @F.pandas_udf("string")
    def cut(text, found):  # noqa: ANN001, ANN202
        return text.combine(found, lambda t, s: t if s is None or t is None else cut_words(t, [(x["start_word"], x["end_word"]) for x in s]))

    new = F.when(F.col(held).isNull(), F.col("text")).otherwise(cut("text", held))
    return both.withColumn("text", new).select(*[f"`{c}`" for c in docs.columns])
