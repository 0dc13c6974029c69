"""Benchmark decontamination by greedy string tiling, so that reordered passages count as well."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Table, Words, filters, guarded, hash128, join_small, kind_of, slices, window_hashes

#: A benchmark of so many bytes of text is broadcast (its words, seeds and their index take more than the text); one that is
#: larger is joined.
AT_ONCE = BROADCAST_BYTES // 16
#: The shortest tile, in words, and the share of a test item's words that tiles must cover.
MIN_MATCH, COVERAGE = 4, 0.6
SCHEMA = "doc_id {kind}, item_id long, coverage double, matched_words long, tiles long"


def tiles(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of the tiles, longest first.

    seeds are all (place in item, place in doc) with `size` equal words. Of equal lengths the one that comes
    first in the item, then in the document, is marked first."""
    runs: list[tuple[int, int, int]] = []
    last: dict[int, list[int]] = {}
    for i, j in sorted(seeds):
        run = last.get(j - i)
        if run is not None and run[0] + run[1] - size + 1 == i:
            run[1] += 1
        else:
            last[j - i] = run = [i, size]
            runs.append((j - i, run))  # type: ignore[arg-type]
    heap = [(-r[1], r[0], r[0] + d) for d, r in runs]  # type: ignore[index]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = in_item[i : i + n] | in_doc[j : j + n]
        if not taken.any():
            in_item[i : i + n] = True
            in_doc[j : j + n] = True
            out.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):  # what is still free of it
            if b - a >= size:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return out


def rare_seeds(grams: np.ndarray, often: np.ndarray, size: int, n: int, share: float) -> np.ndarray:
    """The seeds of an item of n words of which a document has one at least, if its tiles cover `share` of the item.

    Seeds are put aside from the most common on, while the words that those put aside cover are too few by themselves;
    the others are what this returns."""
    covered, aside = np.zeros(n, bool), set()
    hashes, first = np.unique(grams, return_index=True)
    for k in np.lexsort((hashes, -often[first])):
        more = covered.copy()
        for i in np.flatnonzero(grams == hashes[k]):
            more[i : i + size] = True
        if more.sum() >= share * n:
            break
        covered = more
        aside.add(int(hashes[k]))
    return np.array([h for h in hashes.tolist() if h not in aside], np.uint64)


class Items:
    """Benchmark items as word ids, and their Karp-Rabin seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None], size: int, share: float):
        self.size, self.share, self.ids = size, share, ids
        words = Words(pa.array(texts, pa.string()))
        self.names = words.names
        self.words = [words.ids[a:b] for a, b in zip(words.offsets, words.offsets[1:])]
        self.hashes = words.hashes()
        self.grams = [window_hashes(self.hashes[w], size) for w in self.words]
        each = [np.unique(g) for g in self.grams]
        keys, often = np.unique(np.concatenate([*each, np.empty(0, np.uint64)]), return_counts=True)
        rare = [rare_seeds(g, often[np.searchsorted(keys, g)], size, len(w), share) for g, w in zip(self.grams, self.words)]
        h, own = np.concatenate([*rare, np.empty(0, np.uint64)]), np.repeat(np.arange(len(rare)), [len(x) for x in rare])
        order = np.argsort(h, kind="stable")
        self.rare, self.owner = h[order], own[order]

    def search(self, words: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, coverage, matched words, tiles) for the texts of a slice that cover at least `share` of an item."""
        size, share = self.size, self.share
        if not len(words.ids) or not len(self.rare):
            return
        place = pc.fill_null(pc.index_in(words.names, self.names), -1).to_numpy(zero_copy_only=False)
        ids = place[words.ids].astype(np.int64)
        n = len(ids) - size + 1
        if n <= 0:
            return
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        at = np.flatnonzero((gaps[size : size + n] == gaps[:n]) & (text[:n] == text[size - 1 :]))
        if not len(at):
            return
        h = window_hashes(self.hashes[ids[at[:, None] + np.arange(size)]].ravel(), size)[::size]
        lo, hi = np.searchsorted(self.rare, h, "left"), np.searchsorted(self.rare, h, "right")
        hit = np.flatnonzero(hi > lo)
        pairs = {(int(text[at[k]]), int(x)) for k in hit.tolist() for x in self.owner[lo[k] : hi[k]]}
        for t, item in sorted(pairs):
            a, z = np.searchsorted(text[at], (t, t + 1))
            j, own = at[a:z] - words.offsets[t], h[a:z]
            target, grams = self.words[item], self.grams[item]
            order = np.argsort(grams, kind="stable")
            left, right = np.searchsorted(grams[order], own, "left"), np.searchsorted(grams[order], own, "right")
            seeds = [(int(i), int(p)) for k, p in enumerate(j) if right[k] > left[k] for i in order[left[k] : right[k]]]
            reach = np.zeros(len(target), bool)
            for i in {i for i, _ in seeds}:
                reach[i : i + size] = True
            if reach.sum() < share * len(target):  # no tiling can cover more than its seeds
                continue
            doc = ids[words.offsets[t] : words.offsets[t + 1]]
            true = [(i, p) for i, p in seeds if (target[i : i + size] == doc[p : p + size]).all()]
            found = tiles(target, doc, true, size)
            covered = sum(x[2] for x in found)
            if covered >= share * len(target) and covered:
                yield t, item, covered / len(target), covered, len(found)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _at_once(items: DataFrame, size: int, share: float) -> Broadcast | None:
    """The items, broadcast if they are within AT_ONCE."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > AT_ONCE:
        return None
    got = items.orderBy("item_id", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Items([r[0] for r in got], [r[1] for r in got], size, share))


def _candidates(docs: DataFrame, items: DataFrame, size: int, share: float) -> Table:
    """(a, b, items) of the texts, by their hashes, that have a rare seed of an item: the items, as (item_id, text).

    Items' seeds are counted, the rare ones of each kept, and joined with those seeds of documents that a bitmap of bounded
    size lets through. Common seeds join nothing."""
    known = Table(items.withColumn("iid", F.monotonically_increasing_id()), "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column(1)):
                w = Words(part)
                tokens = w.hashes()[w.ids]
                for k, (x, y) in enumerate(zip(w.offsets, w.offsets[1:])):
                    g = window_hashes(tokens[x:y], size)
                    if len(g):
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[at + k].as_py()] * len(g), pa.int64()), pa.array(np.arange(len(g))), pa.array(g.view(np.int64)), pa.array(np.full(len(g), y - x))], names=["iid", "pos", "h", "n"])

    grams = Table(known.df.select("iid", "text").mapInArrow(cut, "iid long, pos long, h long, n long"), "grams")
    counts = grams.df.groupBy("h").agg(F.count(F.lit(1)).alias("often"))

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        h = t.column("h").to_numpy().view(np.uint64)
        found = rare_seeds(h, t.column("often").to_numpy(), size, t.column("n")[0].as_py(), share)
        return pa.table({"iid": pa.array([t.column("iid")[0].as_py()] * len(found), pa.int64()), "h": found.view(np.int64)})

    rare = Table(grams.df.join(counts, "h").groupBy("iid").applyInArrow(pick, "iid long, h long"), "rare")
    (wanted,) = filters([(rare.df.select(F.col("h").alias("key")), rare.df.count())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in slices(b.column(2)):
                w = Words(part)
                h = window_hashes(w.hashes()[w.ids], size)
                text = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
                go = np.flatnonzero((text[: len(h)] == text[size - 1 :]) & wanted.value.has(h)) if len(h) else np.zeros(0, np.int64)
                if len(go):
                    one = np.unique(np.stack((text[go], h[go].view(np.int64)), 1), axis=0)
                    rows = pa.array(at + one[:, 0])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(one[:, 1])], names=["a", "b", "h"])

    hashed = docs.select(*[x.alias(n) for x, n in zip(hash128(F.col("text")), "ab")], F.col("text").alias("text"))
    pairs = hashed.mapInArrow(emit, "a long, b long, h long").join(rare.df, "h").select("a", "b", "iid").distinct()
    out = Table(pairs.join(known.df, "iid").groupBy("a", "b").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), "candidates")
    for t in (known, grams, rare):
        t.drop()
    return out


def _tiled(rows: DataFrame, kind: str, part: Broadcast | None, size: int, share: float) -> DataFrame:
    """SCHEMA rows of rows (doc_id, text), against the broadcast items, or (doc_id, text, items), against their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None if part is None else part.value
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            for at, texts in slices(b.column(1)):
                if part is None:
                    # what isn't a candidate of a text isn't found in it, so the items of a slice are searched for together
                    own = reduce(or_, (Counter((x["item_id"], x["text"]) for x in row) for row in b.column(2).slice(at, len(texts)).to_pylist()))
                    flat = list(own.elements())
                    items = Items([k[0] for k in flat], [k[1] for k in flat], size, share)
                found += [(ids[at + t], items.ids[k], c, m, n) for t, k, c, m, n in items.search(Words(texts))]
            cols = list(zip(*found)) if found else [[]] * 5
            kinds = [b.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "coverage", "matched_words", "tiles"])

    return rows.mapInArrow(run, SCHEMA.format(kind=kind))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """SCHEMA rows of the documents whose tiles cover at least `coverage` of a benchmark item's words.

    Words are runs of letters, marks and digits, in lower case. Items with a null text or fewer than
    min_match words are never found (they would be found everywhere); a null item id is carried along, and repeated items
    are found each. Null and empty documents leak nothing; ids may be of any type; repeated rows and null ids each have rows
    of their own; other columns are ignored; an empty table on either side gives none. Every document is held against every
    item that it shares enough seeds with to be found.

    A benchmark within AT_ONCE is broadcast, and documents aren't shuffled. A larger one is joined on seeds, in one pass over
    the documents for that and one for the texts that have candidates, with the same result."""
    items = _items(benchmark)
    part = _at_once(items, min_match, coverage)
    rows = docs.select("doc_id", F.col("text").alias("text"))
    if part is None:
        met = _candidates(docs, items, min_match, coverage)
        a, b = hash128(F.col("text"))
        rows = join_small(rows.withColumns({"a": a, "b": b}), met, ["a", "b"]).select("doc_id", "text", "items")
    return _tiled(rows, kind_of(docs, "doc_id"), part, min_match, coverage)


@guarded
def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, in which find_leaks() finds nothing. Null and empty texts stay."""
    items = _items(benchmark)
    part = _at_once(items, min_match, coverage)
    a, b = hash128(F.col("text"))
    if part is None:
        met = _candidates(docs, items, min_match, coverage)
        texts = docs.select(a.alias("a"), b.alias("b"), F.col("text").alias("text"))
        # a text's hashes stand for its id
        rows = join_small(texts, met, ["a", "b"]).select(F.concat_ws(",", "a", "b").alias("doc_id"), "text", "items").dropDuplicates(["doc_id"])
        leaks = _tiled(rows, "string", None, min_match, coverage)
        leaks = Table(leaks.select(F.col("doc_id").alias("__ql_key")).distinct(), "leaks")
        return join_small(docs.withColumn("__ql_key", F.concat_ws(",", a, b)), leaks, ["__ql_key"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for at, texts in slices(b.column(where)):
                keep[[at + x[0] for x in found.search(Words(texts))]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
