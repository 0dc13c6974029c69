"""SimHash near-dedup: nodes meet in buckets by minima of their sketches and are compared by Hamming distance.

A document is a 256-bit SimHash of its word pairs and a sketch of 128 minima by which edges are verified.
Documents with equal fingerprints are one node. A node is in TABLES buckets, each named by one of its minima: an
edge's ends have at least OVERLAP of them in common, so that both miss each other in all with a probability of 0.6 ** 12
at most. Buckets are compared whole, large ones parted by further minima first, and those that are still too large for
a task are small-world graphs, searched with beams. Verified edges are united."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Table, Words, guarded, hash128, kind_of, mix64, slices

BITS, WORDS64 = 256, 4
BINS = 128
#: Edges are pairs of documents with at most RADIUS differing bits and at least OVERLAP of their word pairs in common.
RADIUS, OVERLAP = 64, 0.4
#: Buckets of a node, and levels of keys; those of the first PLANNED part the table, the others a bucket in its task.
TABLES, PLANNED, LEVELS = 12, 2, 3
#: Nodes of a bucket that one task takes, and of a shard's graph, at most. Queries that a task answers; more queries are
#: more tasks with the same graph.
SHARD_NODES, TASK_QUERIES = 1 << 17, 1 << 19
#: Links that a node makes, and that it may have; entry points; the first beam; the recall that a beam must reach.
LINKS, SLOTS, HUBS, BEAM, RECALL = 12, 32, 2048, 32, 0.97
AUDIT = 1024
_STEP, _BLOCK, _FAR = 4, 1024, 2**14
#: Queries and nodes of a block of exact search.
_SCAN, _NODES = 64, 1 << 13
_NONE = np.uint64(2**64 - 1)
#: Rows of buckets that are never parted in a task, and of those that are compared together with others.
_EXACT, _FEW = 1 << 12, 32
_FEATURES = 1 << 18


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each distinct word pair of each text of a slice; of a text of one word, that word."""
    tokens = words.hashes()[words.ids]
    sizes = np.diff(words.offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        pair = mix64(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:]) if len(tokens) else tokens
    inside = text[:-1] == text[1:]
    alone = words.offsets[:-1][sizes == 1]
    h = np.concatenate((pair[inside], mix64(tokens[alone])))
    t = np.concatenate((text[:-1][inside], text[alone]))
    # repeats within a text are neighbours once its hashes are sorted; all their bits stay, so that a text's
    # features are the same in every slice
    ends = np.flatnonzero(np.r_[t[1:] != t[:-1], True]) + 1 if len(t) else np.zeros(0, np.int64)
    for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        h[a:b].sort()
    new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], t[new]


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes [text, 4] of 64 bits, sketches [text, 128] of 8 bits, number of features) of a slice."""
    n = len(words.offsets) - 1
    h, text = features(words)
    size = np.bincount(text, minlength=n)
    votes = np.zeros((n, BITS), np.int64)
    for a in range(0, len(h), _FEATURES):
        part, own = h[a : a + _FEATURES], text[a : a + _FEATURES]
        wide = np.empty((len(part), WORDS64), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS64):
                x = part * np.uint64((2 * k + 1) * 0xD1342543DE82EF95 % 2**64)
                wide[:, k] = x ^ x >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for i, b in zip(first, np.r_[first[1:], len(own)]):
            votes[own[i]] += _sums(bits[i:b])
    codes = np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(n, WORDS64)
    low = np.full(n * BINS, 2**32 - 1, np.uint32)
    np.minimum.at(low, text * BINS + (h >> np.uint64(57)).astype(np.int64), (h >> np.uint64(24)).astype(np.uint32) & np.uint32(0xFFFFFFFE))
    # 0 is an empty bin
    sketch = np.where(low == 2**32 - 1, 0, 1 + (low >> np.uint32(1)) % np.uint32(255)).astype(np.uint8).reshape(n, BINS)
    return codes, sketch, size


def _sums(bits: np.ndarray) -> np.ndarray:
    """Column sums of rows of 0 and 1: in bytes by 255 rows, eight columns at a time."""
    out = np.zeros(bits.shape[1], np.int64)
    cut = len(bits) // 255 * 255
    if cut:
        out += bits[:cut].reshape(-1, 255, bits.shape[1]).view(np.uint64).sum(1).view(np.uint8).reshape(-1, bits.shape[1]).sum(0, dtype=np.int64)
    if len(bits) > cut:
        out += np.ascontiguousarray(bits[cut:]).view(np.uint64).sum(0).view(np.uint8)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of word pairs in common (Jaccard) that the sketches in the rows of a and b tell."""
    used = ((a > 0) | (b > 0)).sum(1)
    return ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)


class Graph:
    """A navigable small-world graph of 256-bit codes. Codes are inserted in the order given, in batches that
    double the graph: a batch searches what is there, links to its nearest, and these link back."""

    def __init__(self, codes: np.ndarray, beam: int = 2 * BEAM):
        self.codes, self.n = np.ascontiguousarray(codes), len(codes)
        self.links = np.full((self.n, SLOTS), -1, np.int32)
        self.far = np.full((self.n, SLOTS), _FAR, np.int16)
        self.size = min(self.n, HUBS)
        self.beam, self.full = BEAM, 0
        at = self.size
        self._link(np.arange(at), *self._nearest(self.codes[:at], LINKS + 1))
        while at < self.n:
            more = min(self.n, at + min(at, 1 << 14))
            keys = self.search(self.codes[at:more], beam)
            self._link(np.arange(at, more), (keys >> np.uint64(1) & np.uint64(2**32 - 1)).astype(np.int64), (keys >> np.uint64(33)).astype(np.int64))
            self.size = at = more

    def _nearest(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of the k entry points nearest to each code."""
        hubs = self.codes[: min(self.size, HUBS)]
        k = min(k, len(hubs))
        ids, ds = np.empty((len(codes), k), np.int64), np.empty((len(codes), k), np.int64)
        for a in range(0, len(codes), 256):
            d = distances(codes[a : a + 256], hubs).astype(np.int64) << 32 | np.arange(len(hubs))
            best = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1) if k else d[:, :0]
            ids[a : a + 256], ds[a : a + 256] = best & (2**32 - 1), best >> 32
        return ids, ds

    def _link(self, nodes: np.ndarray, near: np.ndarray, d: np.ndarray) -> None:
        """Link nodes to those of `near` (nearest first) that aren't nearer to one chosen before, then to the nearest of the rest."""
        valid = (d < _FAR) & (near != nodes[:, None])
        near, d = np.where(valid, near, 0)[:, : 2 * LINKS + 1], np.where(valid, d, _FAR)[:, : 2 * LINKS + 1]
        for a in range(0, len(nodes), _BLOCK):
            s, cand, dist = nodes[a : a + _BLOCK], near[a : a + _BLOCK], d[a : a + _BLOCK]
            c = self.codes[cand]
            score = dist.copy()
            for j in range(cand.shape[1]):
                apart = np.bitwise_count(c ^ c[:, j : j + 1]).sum(2, dtype=np.int64)
                behind = (apart < dist) & (np.arange(cand.shape[1]) > j) & (score[:, j] == dist[:, j])[:, None]
                score = np.where(behind & (score == dist), dist + 1024, score)
            pick = np.argsort(np.where(dist >= _FAR, _FAR, score), axis=1, kind="stable")[:, :LINKS]
            to, far = np.take_along_axis(cand, pick, 1), np.take_along_axis(dist, pick, 1)
            own = np.repeat(s, to.shape[1]).reshape(to.shape)
            ok = far < _FAR
            self._add(np.concatenate((own[ok], to[ok])), np.concatenate((to[ok], own[ok])), np.concatenate((far[ok], far[ok])))

    def _add(self, at: np.ndarray, to: np.ndarray, d: np.ndarray) -> None:
        """Add links; a node that has more than SLOTS keeps the nearest."""
        nodes = np.unique(at)
        old_to, old_d = self.links[nodes], self.far[nodes]
        have = old_to >= 0
        at = np.concatenate((at, np.repeat(nodes, SLOTS)[have.ravel()]))
        to = np.concatenate((to, old_to[have]))
        d = np.concatenate((d, old_d[have]))
        order = np.lexsort((to, d, at))
        at, to, d = at[order], to[order], d[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (to[1:] != to[:-1])] if len(at) else np.zeros(0, bool)
        at, to, d = at[new], to[new], d[new]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        keep = rank < SLOTS
        self.links[nodes], self.far[nodes] = -1, _FAR
        self.links[at[keep], rank[keep]] = to[keep]
        self.far[at[keep], rank[keep]] = d[keep]

    def search(self, codes: np.ndarray, beam: int) -> np.ndarray:
        """Keys [query, beam], least first: distance << 33 | node << 1, or _NONE."""
        beam = min(beam, max(1, self.size))
        out = np.full((len(codes), beam), _NONE)
        for a in range(0, len(codes), _BLOCK):
            out[a : a + _BLOCK] = self._beam(codes[a : a + _BLOCK], beam)
        return out

    def _beam(self, q: np.ndarray, beam: int) -> np.ndarray:
        if not self.size:
            return np.full((len(q), beam), _NONE)
        ids, ds = self._nearest(q, min(beam, 8))
        keys = np.full((len(q), beam), _NONE)
        keys[:, : ids.shape[1]] = ds.astype(np.uint64) << np.uint64(33) | ids.astype(np.uint64) << np.uint64(1) | np.uint64(1)
        live, one = np.arange(len(q)), np.uint64(1)
        while len(live):
            k = keys[live]
            fresh = (k & one == one) & (k != _NONE)
            some = fresh.any(1)
            live, k, fresh = live[some], k[some], fresh[some]
            if not len(live):
                break
            pick = fresh & (np.cumsum(fresh, axis=1) <= _STEP)
            row, col = np.nonzero(pick)
            node = (k[row, col] >> one & np.uint64(2**32 - 1)).astype(np.int64)
            k[row, col] -= one
            place = np.arange(len(row)) - np.searchsorted(row, row)
            to = np.full((len(live), _STEP, SLOTS), -1, np.int32)
            to[row, place] = self.links[node]
            to = to.reshape(len(live), -1)
            d = np.zeros(to.shape, np.uint64)
            mine = q[live]
            for w in range(WORDS64):
                d += np.bitwise_count(self.codes[:, w][to] ^ mine[:, w : w + 1])
            new = np.where(to >= 0, d << np.uint64(33) | to.astype(np.uint64) << one | one, _NONE)
            new[new > k[:, -1:]] = _NONE
            both = np.sort(np.concatenate((k, new), axis=1), axis=1)
            # an expanded node sorts before the same one found again
            again = both[:, 1:] >> one == both[:, :-1] >> one
            both[:, 1:][again & (both[:, 1:] != _NONE)] = _NONE
            keys[live] = np.sort(both, axis=1)[:, :beam]
        return keys & ~one | np.where(keys == _NONE, one, np.uint64(0))

    def within(self, q: np.ndarray, radius: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs within the radius that a beam finds, and the queries whose beams have no others:
        they are full, or ran out of links, and can't tell whether there are more."""
        keys = self.search(q, beam)
        hit = (keys != _NONE) & (keys >> np.uint64(33) <= np.uint64(radius))
        row, col = np.nonzero(hit)
        return row, (keys[row, col] >> np.uint64(1) & np.uint64(2**32 - 1)).astype(np.int64), np.flatnonzero((hit | (keys == _NONE)).all(1) & (hit.sum(1) < self.size))

    def audit(self, q: np.ndarray, radius: int) -> float:
        """Widen the beam until it finds RECALL of what exact search finds for the queries, and return the recall.
        Queries with full beams, counted in self.full, are searched exactly and don't raise the recall; a beam as
        wide as the graph is exact search."""
        exact = {(i + a, int(x)) for a in range(0, len(q), 64) for i, x in zip(*np.nonzero(distances(q[a : a + 64], self.codes) <= radius))}
        while True:
            row, node, full = self.within(q, radius, self.beam)
            full = full[np.bincount(row, minlength=len(q))[full] == self.beam]  # beams out of links count with what they found
            self.full = len(full)
            whole = set(range(len(q))) - set(full.tolist())
            due = [x for x in exact if x[0] in whole]
            got = len({*zip(row.tolist(), node.tolist())}.intersection(due)) / len(due) if due else 1.0
            if got >= RECALL or self.beam >= self.n:
                return got
            self.beam *= 2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a with each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w : w + 1] ^ b[:, w])
    return out


class Union:
    """Disjoint sets of integers; a set's root is its least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        at = x
        while (y := up.get(at, at)) != at:
            at = y
        while x != at:
            up[x], x = at, up.get(x, x)
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
        return a != b


def edges_of_shard(
    ids: np.ndarray, codes: np.ndarray, sketches: np.ndarray, q_ids: np.ndarray, q_codes: np.ndarray, q_sketches: np.ndarray,
    radius: int = RADIUS, least: float = OVERLAP, report: dict | None = None,
) -> Union:
    """The verified edges between queries and a shard's nodes, united. report gets the audited recall and the beam.

    A query whose beam has nodes within the radius alone is held against every node of the shard: what lies
    beyond need not be reached by way of those found. Pairs that are in one set by then are passed over."""
    order = np.argsort(mix64(ids.view(np.uint64)), kind="stable")
    ids, codes, sketches = ids[order], codes[order], sketches[order]
    graph, sets = Graph(codes), Union()
    some = q_codes[np.argsort(mix64(q_ids.view(np.uint64) + np.uint64(7)), kind="stable")[:AUDIT]]
    recall = graph.audit(np.concatenate((some[: AUDIT // 2], codes[: AUDIT // 2])), radius)
    if report is not None:
        report |= {"recall": recall, "beam": graph.beam}
    for a in range(0, len(q_ids), 1 << 14):
        q = np.arange(a, min(a + (1 << 14), len(q_ids)))
        row, node, full = graph.within(q_codes[q], radius, graph.beam)
        own = q[row]
        other = ids[node] != q_ids[own]
        own, node = own[other], node[other]
        good = overlap(q_sketches[own], sketches[node]) >= least if len(own) else np.zeros(0, bool)
        for x, y in zip(q_ids[own[good]].tolist(), ids[node[good]].tolist()):
            sets.join(x, y)
        if len(full):
            _settle(sets, ids, codes, sketches, q_ids[q[full]], q_codes[q[full]], q_sketches[q[full]], radius, least)
    return sets


def _settle(sets: Union, ids: np.ndarray, codes: np.ndarray, sketches: np.ndarray, q_ids: np.ndarray, q_codes: np.ndarray, q_sketches: np.ndarray, radius: int, least: float) -> None:
    """Unite the queries with all nodes that they have verified edges to, by exact search."""
    root = lambda x: np.array([sets.root(i) for i in x.tolist()], np.int64)
    label = root(ids)
    for a in range(0, len(q_ids), _SCAN):
        mine = root(q_ids[a : a + _SCAN])
        for b in range(0, len(ids), _NODES):
            near = distances(q_codes[a : a + _SCAN], codes[b : b + _NODES]) <= radius
            row, node = np.nonzero(near & (mine[:, None] != label[b : b + _NODES]))
            for c in range(0, len(row), 1 << 16):
                r, n = row[c : c + (1 << 16)], node[c : c + (1 << 16)] + b
                apart = mine[r] != label[n]
                r, n = r[apart], n[apart]
                good = overlap(q_sketches[a + r], sketches[n]) >= least
                pairs = np.unique(np.stack((mine[r[good]], label[n[good]]), 1), axis=0)
                for x, y in pairs.tolist():
                    sets.join(x, y)
                if len(pairs):
                    old = np.unique(pairs)
                    new = root(old)
                    for held in (mine, label):
                        at = np.minimum(np.searchsorted(old, held), len(old) - 1)
                        held[:] = np.where(old[at] == held, new[at], held)


def components(edges: DataFrame) -> Table:
    """(v, root) of every node of the edges (a, b): root is the least node of its component. Stars are made larger
    and smaller by turns (Kiveris et al. 2014); each round is a table in the shared folder."""
    now = Table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "star")
    while True:
        both = now.df.unionByName(now.df.select(F.col("u").alias("v"), F.col("v").alias("u")))
        m = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = Table(both.join(m, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "star")
        m = large.df.groupBy("v").agg(F.min("u").alias("m"))
        small = large.df.join(m, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        after = Table(small.where("u < v").distinct(), "star")
        same = after.df.exceptAll(now.df).isEmpty() and now.df.exceptAll(after.df).isEmpty()
        for t in (now, large):
            t.drop()
        now = after
        if same:
            break
    stars = now.df.select("v", F.col("u").alias("root"))
    return Table(stars.unionByName(stars.select(F.col("root").alias("v"), "root").distinct()), "components")


SKETCHED = "doc_id {kind}, h long, g long, code binary, sketch binary, n int"


def sketched(docs: DataFrame) -> DataFrame:
    """SKETCHED of the rows of docs that have words; h and g hash the text. Whole texts; map only."""
    names = [x.split()[0] for x in SKETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(3)):
                codes, sketch, size = fingerprints(Words(texts))
                some = np.flatnonzero(size)
                held = [b.column(i).slice(at, len(texts)).take(pa.array(some)) for i in range(3)]
                rows = [pa.array([x.tobytes() for x in y[some]], pa.binary()) for y in (codes, sketch)]
                yield pa.RecordBatch.from_arrays([*held, *rows, pa.array(size[some].astype(np.int32))], names=names)

    text = F.col("text")
    return docs.select(F.col("doc_id").alias("doc_id"), *[x.alias(n) for x, n in zip(hash128(text), "hg")], text.alias("text")).mapInArrow(run, SKETCHED.format(kind=kind_of(docs, "doc_id")))


def bucket_keys(sketches: np.ndarray, level: int) -> np.ndarray:
    """[row, TABLES] keys: the first bin that a row has in each table's order of the bins, and what it holds. Two rows
    have a table's key in common with the probability of their overlap, whatever their numbers of bins."""
    out = np.empty((len(sketches), TABLES), np.int64)
    for t in range(TABLES):
        rest = np.arange(len(sketches))
        for b in np.random.default_rng((20257, level, t)).permutation(BINS).tolist():
            held = sketches[rest, b]
            some = held > 0
            out[rest[some], t] = t << 16 | b << 8 | held[some].astype(np.int64)
            rest = rest[~some]
            if not len(rest):
                break
        out[rest, t] = -1
    return out


def link(sets: Union, ids: np.ndarray, codes: np.ndarray, sketches: np.ndarray, radius: int, least: float, level: int) -> None:
    """Unite the ends of the verified edges among the rows of a bucket. Its rows are all compared, unless they are many
    and the keys of the next level part them well."""
    n = len(ids)
    if n > _EXACT and level < LEVELS:
        keys = bucket_keys(sketches, level).T
        if sum((np.unique(key, return_counts=True)[1] ** 2).sum() for key in keys) < n * n // 4:
            for key in keys:
                order = np.argsort(key, kind="stable")
                link_sorted(sets, key[order], ids[order], codes[order], sketches[order], radius, least, level + 1)
            return
    if n > _EXACT and len({sets.root(x) for x in ids.tolist()}) == 1:
        return
    for a in range(0, n, _SCAN):
        mine = slice(a, a + _SCAN)
        found = [np.nonzero(distances(codes[mine], codes[b : b + _NODES]) <= radius) for b in range(a, n, _NODES)]
        if sum(len(row) for row, _ in found) > 1 << 14:
            _settle(sets, ids[a:], codes[a:], sketches[a:], ids[mine], codes[mine], sketches[mine], radius, least)
            continue
        for b, (row, node) in zip(range(0, n, _NODES), found):
            later = node + b > row
            _verify(sets, ids[a:], sketches[a:], row[later], node[later] + b, least)


def link_sorted(sets: Union, key: np.ndarray, ids: np.ndarray, codes: np.ndarray, sketches: np.ndarray, radius: int, least: float, level: int) -> None:
    """link() for each of the buckets that the sorted keys tell."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    after = np.repeat(first + size, size) - np.arange(len(key))  # rows of the bucket from each on
    few = np.repeat(size <= _FEW, size)
    for step in range(1, int(size[size <= _FEW].max(initial=0))):
        i = np.flatnonzero(few & (after > step))
        i = i[np.bitwise_count(codes[i] ^ codes[i + step]).sum(1, dtype=np.int64) <= radius]
        _verify(sets, ids, sketches, i, i + step, least)
    for i in np.flatnonzero(size > _FEW).tolist():
        own = slice(first[i], first[i] + size[i])
        link(sets, ids[own], codes[own], sketches[own], radius, least, level)


def _verify(sets: Union, ids: np.ndarray, sketches: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> None:
    """Unite those of the pairs (a, b) of rows that overlap enough."""
    for c in range(0, len(a), 1 << 14):
        x, y = a[c : c + (1 << 14)], b[c : c + (1 << 14)]
        good = overlap(sketches[x], sketches[y]) >= least
        for i, j in zip(ids[x[good]].tolist(), ids[y[good]].tolist()):
            sets.join(i, j)


_NODE = "id long, code binary, sketch binary"


def keyed(rows: DataFrame, level: int) -> DataFrame:
    """(key, id, code, sketch) of rows (key, id, code, sketch), TABLES times each: their keys of the next level, which tell
    apart what the keys so far do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, _, sketches = _arrays(pa.Table.from_batches([b]))
            with np.errstate(over="ignore"):
                so_far = b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys = mix64(so_far[:, None] + bucket_keys(sketches, level).view(np.uint64)).view(np.int64)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), *b.columns[1:]], names=["key", "id", "code", "sketch"])

    return rows.select("key", "id", "code", "sketch").mapInArrow(run, f"key long, {_NODE}")


def _searched(rows: DataFrame, radius: int, least: float, level: int) -> DataFrame:
    """Edges (a, b), as stars, among the rows (key, id, code, sketch) that have a key in common. State is the key that a batch ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = Union(), []

        def search(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts)
            link_sorted(sets, t.column("key").to_numpy(), *_arrays(t), radius, least, level)

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            at = int(np.searchsorted(key, key[-1]))  # the last key's first row
            if held and (at or held[-1].column(0)[0].as_py() != key[0]):
                search([*held, b.slice(0, at)])
                held = []
            elif at:
                search([b.slice(0, at)])
            held.append(b.slice(at))
        if held:
            search(held)
        pairs = [(sets.root(x), x) for x in [*sets.up]]
        pairs = [x for x in pairs if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, EDGES)


def _parted(rows: DataFrame, sizes: list[tuple[int, int]], radius: int, least: float, shard_nodes: int, task_queries: int) -> DataFrame:
    """Edges among rows that have a key in common, of keys with so many rows: in graphs of shard_nodes, each asked by all rows of the key."""
    plan = F.broadcast(rows.sparkSession.createDataFrame([(k, ceil(n / shard_nodes), ceil(n / task_queries)) for k, n in sizes], "key long, parts int, groups int"))
    hashed = lambda salt, by: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    placed = rows.join(plan, "key")
    own = placed.withColumn("part", hashed(1, "parts")).withColumn("grp", each("groups"))
    ask = placed.withColumn("part", each("parts")).withColumn("grp", hashed(2, "groups"))

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        sets = edges_of_shard(*_arrays(shard), *_arrays(queries), radius, least) if len(shard) and len(queries) else Union()
        pairs = [(sets.root(x), x) for x in [*sets.up]]
        pairs = [x for x in pairs if x[0] != x[1]]
        return pa.table([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    by = ["key", "part", "grp"]
    own, ask = (x.select(*by, "id", "code", "sketch") for x in (own, ask))
    return own.groupBy(*by).cogroup(ask.groupBy(*by)).applyInArrow(run, EDGES)


EDGES = "a long, b long"


def near_edges(nodes: Table, radius: int = RADIUS, least: float = OVERLAP, shard_nodes: int | None = None, task_queries: int = TASK_QUERIES) -> Table:
    """Verified edges (a, b) between nodes (id, code, sketch), as stars. Nodes meet in TABLES buckets each, by minima of
    their sketches. A bucket of more than shard_nodes is parted by the keys of the next level; what PLANNED of them don't
    part is searched in graphs of shard_nodes, every row in each of its bucket's. No row is left out of any bucket."""
    limit = shard_nodes or SHARD_NODES
    rows, large, out = nodes.df.withColumn("key", F.lit(0).cast("long")), [], []
    for level in range(PLANNED):
        rows = keyed(rows, level)
        sizes = [tuple(r) for r in rows.groupBy("key").count().where(F.col("count") > limit).collect()]
        if not sizes:
            out.append(_searched(rows, radius, least, level + 1))
            break
        keys = F.broadcast(nodes.spark.createDataFrame(sizes, "key long, size long").select("key"))
        out.append(_searched(rows.join(keys, "key", "left_anti"), radius, least, level + 1))
        large.append(Table(rows.join(keys, "key", "left_semi"), "near_large"))
        rows = large[-1].df
    else:
        out.append(_parted(rows, sizes, radius, least, limit, task_queries))
    found = Table(reduce(DataFrame.unionByName, out).distinct(), "near_edges")
    for t in large:
        t.drop()
    return found


def audited_recall(nodes: Table, found: Table, radius: int, least: float) -> float:
    """The share of the verified edges of AUDIT nodes, found by comparing them with every node, whose ends are in one
    component (v, root) of found; 1.0 where they have none. The nodes are those with the least hashes."""
    some = nodes.df.orderBy(F.xxhash64(F.lit(7), "id")).limit(AUDIT).select("id", "code", "sketch").toArrow()
    if not len(some):
        return 1.0
    asked = nodes.spark.sparkContext.broadcast(_arrays(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_codes, q_sketches = asked.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, codes, sketches = _arrays(pa.Table.from_batches([b]))
            for a in range(0, len(q_ids), _SCAN):
                row, node = np.nonzero((distances(q_codes[a : a + _SCAN], codes) <= radius) & (q_ids[a : a + _SCAN, None] != ids))
                for c in range(0, len(row), 1 << 14):
                    r, n = row[c : c + (1 << 14)] + a, node[c : c + (1 << 14)]
                    good = overlap(q_sketches[r], sketches[n]) >= least
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r[good]]), pa.array(ids[n[good]])], names=["a", "b"])

    links = nodes.df.select("id", "code", "sketch").mapInArrow(run, EDGES)
    for end in ("a", "b"):
        links = links.join(found.df.select(F.col("v").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return links.agg(F.coalesce(F.avg(F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False)).cast("double")), F.lit(1.0))).first()[0]


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b"".join(t.column(c).to_pylist()) for c in ("code", "sketch")]
    return t.column("id").to_numpy(), np.frombuffer(raw[0], np.uint64).reshape(-1, WORDS64), np.frombuffer(raw[1], np.uint8).reshape(-1, BINS)


class Groups:
    """The groups of near duplicates of a table: `rows` has (doc_id, h, g, root) of each row that has a partner,
    `kept` (root, doc_id, h, g) of the one that stays, with the lowest id (null last), then the least hash of the text,
    `recall` the share of edges of a sample of nodes, found by comparing these with all, that the groups hold."""

    def __init__(self, docs: DataFrame, radius: int = RADIUS, least: float = OVERLAP, shard_nodes: int | None = None):
        every = Table(sketched(docs), "sketched")
        nodes = every.df.groupBy("code", "sketch", "n").agg(F.count(F.lit(1)).alias("rows")).withColumn("id", F.monotonically_increasing_id())
        nodes = Table(nodes, "nodes")
        edges = near_edges(nodes, radius, least, shard_nodes)
        found = components(edges.df)
        self.recall = audited_recall(nodes, found, radius, least)
        if self.recall < RECALL:
            raise RuntimeError(f"the search found {self.recall:.3f} of what exact search finds, under {RECALL}")
        one = nodes.df.join(found.df.withColumnRenamed("v", "id"), "id", "left")
        one = one.where("root is not null or rows > 1").select("code", "sketch", F.coalesce("root", "id").alias("root"))
        rows = Table(every.df.join(one, ["code", "sketch"]).select("doc_id", "h", "g", "root"), "grouped")
        for t in (every, nodes, edges, found):
            t.drop()
        self.rows = rows.df
        first = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h", "g")
        self.kept = self.rows.groupBy("root").agg(F.min(first).alias("k")).select("root", "k.doc_id", "k.h", "k.g")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, least: float = OVERLAP, shard_nodes: int | None = None) -> DataFrame:
    """(doc_id, group_id, keep) of each row that is in a group of two or more; group_id is the id of the row that
    stays (the lowest, null last), and keep is true for it alone among different rows.

    Groups are the connected components of verified edges, exact copies included. A null text, or one without
    letters or digits, has no partner. Rows with null or repeated ids are grouped by their texts like any other, and
    each have their row; rows equal in id and text can't be told apart and are all marked keep, if one is. Ids may be
    of any type that has an order. A table without rows or partners gives none."""
    groups = Groups(docs, radius, least, shard_nodes)
    k = groups.kept.select("root", *[F.col(c).alias(f"k_{c}") for c in ("doc_id", "h", "g")])
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("h") == F.col("k_h")) & (F.col("g") == F.col("k_g"))
    return groups.rows.join(k, "root").select("doc_id", F.col("k_doc_id").alias("group_id"), same.alias("keep"))


@guarded
def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, least: float = OVERLAP, shard_nodes: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns, without all but one row of each group of near_duplicates().

    Rows equal in id and text count as copies: one stays. Ids and hashes of rows that go are broadcast while they are small
    (their files within an eighth of BROADCAST_BYTES), else joined by shuffle."""
    groups = Groups(docs, radius, least, shard_nodes)
    stay = groups.kept.select("root", *[F.col(c).alias(f"k_{c}") for c in ("doc_id", "h", "g")])
    keys = groups.rows.groupBy("doc_id", "h", "g", "root").agg(F.count(F.lit(1)).alias("times")).join(stay, "root")
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("h") == F.col("k_h")) & (F.col("g") == F.col("k_g"))
    own, h, g, one, times, x, y = (f"__ql_{n}" for n in ("id", "h", "g", "one", "times", "x", "y"))
    go = keys.select(F.col("doc_id").alias(own), F.col("h").alias(h), F.col("g").alias(g), same.alias(one), F.col("times").alias(times))
    go = Table(go.where(~F.col(one) | (F.col(times) > 1)), "near_drops")
    on = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(x) == F.col(h)) & (F.col(y) == F.col(g))
    names = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.withColumns(dict(zip((x, y), hash128(F.col("text")))))
    held = F.broadcast(go.df) if go.bytes() * 8 <= BROADCAST_BYTES else go.df
    out = left.join(held, on, "left_anti").select(*names)
    twice = go.df.where(F.col(one))
    if not twice.isEmpty():
        again = left.join(twice, on, "left_semi").dropDuplicates(["doc_id", x, y])
        out = out.unionByName(again.select(*names))
    return out
