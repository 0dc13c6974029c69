"""Near-dedup, decontamination, substring and line dedup against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import common, decontamination, line_dedup, simhash, substring_dedup
from quadrille.llm.common import Words, window_hashes

from .fixtures import empty, frame, messy, prose


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


# 1: SimHash


def clusters(n, copies, flips, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (n, 256), np.uint8)
    near = base[:copies] ^ (rng.random((copies, 256)) < flips)
    return np.packbits(np.concatenate((base, near)), axis=1, bitorder="little").view(np.uint64).reshape(-1, 4)


def test_graph_recall_against_exact_search():
    codes = clusters(20_000, 2_000, 0.12)
    codes = codes[np.random.default_rng(1).permutation(len(codes))]
    graph = simhash.Graph(codes)
    some = codes[:1500]
    assert graph.audit(some, simhash.RADIUS) >= simhash.RECALL
    row, node, _ = graph.within(codes[1500:4000], simhash.RADIUS, graph.beam)
    found = set(zip(row.tolist(), node.tolist()))
    exact = {(i, int(j)) for a in range(0, 2500, 100) for i0, j in zip(*np.nonzero(simhash.distances(codes[1500 + a : 1600 + a], codes) <= simhash.RADIUS)) for i in [int(i0) + a]}
    assert len(found & exact) / len(exact) >= 0.95


def test_graph_of_few_and_equal_codes():
    for n in (1, 2, 5):
        codes = np.zeros((n, 4), np.uint64)
        g = simhash.Graph(codes)
        row, node, _ = g.within(codes[:1], 0, 64)
        assert set(node.tolist()) == set(range(n))


def test_large_group_of_near_copies_is_one_set():
    rng = np.random.default_rng(3)
    codes = np.concatenate((clusters(3000, 0, 0), np.packbits(np.repeat(rng.integers(0, 2, (1, 256), np.uint8), 2000, 0) ^ (rng.random((2000, 256)) < 0.04), axis=1, bitorder="little").view(np.uint64)))
    ids, sketches = np.arange(len(codes)), np.ones((len(codes), simhash.BINS), np.uint8)
    sets = simhash.edges_of_shard(ids, codes, sketches, ids, codes, sketches)
    assert len({sets.root(i) for i in range(3000, 5000)}) == 1


def test_fingerprints_do_not_depend_on_the_slice():
    text = prose(7, 300)
    others = [prose(100 + i, 5 + i % 40) for i in range(1999)]
    alone = simhash.fingerprints(Words(pa.array([text, "one"])))
    for n in (1, 2, 300, 2000):
        batch = [*others[: n - 1], text] if n < 300 else [*others[: n - 2], text, "one"]
        got = simhash.fingerprints(Words(pa.array(batch)))
        for all_, mine in zip(got, alone):
            assert (all_[batch.index(text)] == mine[0]).all()
            if n >= 300:
                assert (all_[n - 1] == mine[1]).all()


def test_dense_families_within_the_radius_are_one_set():
    rng = np.random.default_rng(4)
    for size in (20, 64, 200):
        centre = rng.integers(0, 2, (1, 256), np.uint8)
        moved = centre.copy()
        moved[0, rng.choice(256, 40, replace=False)] ^= 1
        bits = np.concatenate([np.repeat(x, size, 0) ^ (rng.random((size, 256)) < 0.04) for x in (centre, moved)])
        codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        ids, sketches = np.arange(len(codes)), np.ones((len(codes), simhash.BINS), np.uint8)
        sets = simhash.edges_of_shard(ids, codes, sketches, ids, codes, sketches)
        want = simhash.Union()
        for i, j in zip(*np.nonzero(simhash.distances(codes, codes) <= simhash.RADIUS)):
            want.join(int(i), int(j))
        assert [sets.root(i) for i in range(len(codes))] == [want.root(i) for i in range(len(codes))]
        assert len({sets.root(i) for i in range(len(codes))}) == 1


def brute_groups(rows):
    """Connected components of all verified pairs, by position."""
    texts = [r[1] for r in rows]
    codes, sketch, n = simhash.fingerprints(Words(pa.array(texts, pa.string())))
    sets = simhash.Union()
    for i in range(len(rows)):
        for j in range(i):
            if n[i] and n[j] and simhash.distances(codes[i : i + 1], codes[j : j + 1])[0, 0] <= simhash.RADIUS:
                if simhash.overlap(sketch[i : i + 1], sketch[j : j + 1])[0] >= simhash.OVERLAP:
                    sets.join(i, j)
    out = defaultdict(list)
    for i in range(len(rows)):
        if n[i]:
            out[sets.root(i)].append(i)
    return [g for g in out.values() if len(g) > 1]


def test_near_duplicates_are_those_of_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {frozenset(rows[i][0] for i in g) for g in brute_groups(rows)}
    got = defaultdict(set)
    for r in simhash.near_duplicates(docs).collect():
        got[r.group_id].add(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    assert {frozenset(g) for g in got.values()} == want and want
    assert all(min(g) == k for k, g in got.items())
    kept = {r[0] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {x for g in want for x in g if x != min(g)}


def test_near_duplicates_with_small_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, shard_nodes=30).collect()) == one


def test_near_dedup_of_messy_rows(spark):
    rows = messy()
    docs = frame(spark, clash=True)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(kept.values()) == {1}
    gone = {(2, rows[1][1]), (3, rows[2][1])}
    assert set(kept) == {(r[0], r[1]) for r in rows} - gone
    groups = {(r.doc_id, r.group_id, r.keep) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (9, 9, True)}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_groups_do_not_depend_on_batches_or_partitions(spark):
    rows = [(i, prose(1000 + i % 700, 120) + (" more" if i % 5 == 0 else ""), "en", "s", 0) for i in range(1400)]
    docs = frame(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for size, parts in (("100", 7), ("2000", 1)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found.append({tuple(r) for r in simhash.near_duplicates(docs.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and len(found[0]) == 1400 and all(g == i % 700 for i, g, _ in found[0])


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", prose(1, 60)), ("a", prose(1, 60)), ("c", prose(2, 60))], "doc_id string, text string")
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == {("a", "a", True), ("b", "a", False)}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {"a", "c"}
    bench = spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string")
    assert [r.doc_id for r in decontamination.find_leaks(docs, bench).collect()] == ["c"]
    with pytest.raises(TypeError):
        substring_dedup.repeated_spans(docs)


def test_recall_of_each_search_is_kept(spark, small):
    groups = simhash.Groups(spark.read.parquet(f"{small}/documents.parquet"), shard_nodes=30)
    assert simhash.RECALL <= groups.recall <= 1


def test_links_of_all_pairs_are_found_by_few_comparisons(monkeypatch):
    """Of nodes with all bins or few, links at the least overlap too, while few of all pairs are compared."""
    rng, compared, distances = np.random.default_rng(5), [], simhash.distances
    monkeypatch.setattr(simhash, "distances", lambda a, b: compared.append(len(a) * len(b)) or distances(a, b))
    for n in (6_000, 24_000):
        codes, sketches = clusters(n, n // 10, 0.12), rng.integers(1, 256, (n, simhash.BINS), np.uint8)
        sketches[: n // 2][rng.random((n // 2, simhash.BINS)) < 0.9] = 0
        partners = sketches[: n // 10].copy(), sketches[n // 2 : n // 2 + n // 10].copy()
        codes = np.concatenate((codes, codes[n // 2 : n // 2 + n // 10]))
        for x in partners:
            x[(rng.random(x.shape) < rng.choice([0.1, 0.3, 0.5], (len(x), 1))) & (x > 0)] ^= 1
        sketches = np.concatenate((sketches, *partners))
        order = rng.permutation(len(codes))
        ids, codes, sketches = np.arange(len(codes)), codes[order], sketches[order]
        where = np.argsort(order)
        at = [(where[i], where[n + i]) for i in range(n // 10)] + [(where[n // 2 + i], where[n + n // 10 + i]) for i in range(n // 10)]
        due = [(a, b) for a, b in at if distances(codes[a : a + 1], codes[b : b + 1])[0, 0] <= simhash.RADIUS and simhash.overlap(sketches[a : a + 1], sketches[b : b + 1])[0] >= simhash.OVERLAP]
        compared.clear()
        sets = simhash.Union()
        simhash.link(sets, ids, codes, sketches, simhash.RADIUS, simhash.OVERLAP, 0)
        assert sum(compared) < len(ids) ** 2 / 50
        assert len(due) > n // 10 and sum(sets.root(a) == sets.root(b) for a, b in due) >= 0.995 * len(due)


def test_recall_is_that_of_all_pairs(spark, small, monkeypatch):
    """The audit tells links that the search misses: without any keys in common there are none but copies."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert simhash.Groups(docs).recall >= 0.99
    none = lambda rows, radius, least, level: rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    monkeypatch.setattr(simhash, "_searched", none)
    with pytest.raises(RuntimeError):
        simhash.Groups(docs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(edges).df.collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# 2: greedy string tiling


def slow_tiling(item, doc, least):
    """The published algorithm as it is: again and again the longest unmarked matches."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return sum(x[2] for x in out), len(out)
        for i, j in found:
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = b[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiling_is_the_slow_algorithms():
    r = np.random.default_rng(5)
    for _ in range(60):
        item, doc = r.integers(0, 4, r.integers(4, 25)), r.integers(0, 4, r.integers(4, 40))
        seeds = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if (item[i : i + 3] == doc[j : j + 3]).all()]
        got = decontamination.tiles(item, doc, seeds, 3)
        assert (sum(x[2] for x in got), len(got)) == slow_tiling(item.tolist(), doc.tolist(), 3)
        assert all((item[i : i + n] == doc[j : j + n]).all() for i, j, n in got)


def test_leaks_are_those_of_all_pairs(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for d, t in docs:
        doc = words(t)
        grams = {tuple(doc[i : i + 4]) for i in range(len(doc) - 3)}
        for i, x in items:
            item = words(x)
            if sum(tuple(item[k : k + 4]) in grams for k in range(len(item) - 3)) * 4 < 0.6 * len(item):
                continue
            if len(doc) > 1500:
                continue
            covered, _ = slow_tiling(item, doc, 4)
            if covered >= decontamination.COVERAGE * len(item):
                want.add((d, i, covered))
    short = {d for d, t in docs if len(words(t)) <= 1500}
    got = {(r.doc_id, r.item_id, r.matched_words) for r in decontamination.find_leaks(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {x for x in got if x[0] in short} == want and want


def test_reordered_passages_leak_and_others_do_not(spark):
    item = prose(50, 40)
    w = item.split()
    shuffled = " ".join(w[20:40] + ["zzz"] + w[:20])
    rows = [(1, "before " + shuffled + " after"), (2, " ".join(w[:15])), (3, item.upper()), (None, item), (4, None), (5, ""), (3, item.upper()), (6, " ".join(sorted(w)))]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clash=True)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, prose(51, 30))], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == Counter({(1, 1): 1, (3, 1): 2, (None, 1): 1})
    left = decontamination.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6]
    assert decontamination.find_leaks(empty(spark), bench).count() == 0
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.find_leaks(frame(spark), bench).count() == 0


def test_a_large_benchmark_is_joined_with_the_same_result(spark, small, monkeypatch):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    shown = lambda: Counter(map(tuple, decontamination.find_leaks(docs, bench).collect()))
    kept = lambda: Counter(r.doc_id for r in decontamination.drop_leaks(docs, bench).collect())
    one, left = shown(), kept()
    monkeypatch.setattr(decontamination, "AT_ONCE", 100)
    assert shown() == one and kept() == left and one
    messy_docs = frame(spark, [(1, prose(50, 40), "en", "s", 0), (1, prose(50, 40), "en", "s", 0), (None, prose(50, 40), "en", "s", 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0)], clash=True)
    odd = spark.createDataFrame([(1, prose(50, 40)), (1, prose(50, 40)), (2, None), (3, ""), (None, prose(51, 30))], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(messy_docs, odd).collect()) == {(1, 1): 4, (None, 1): 2}
    out = decontamination.drop_leaks(messy_docs, odd)
    assert out.columns == messy_docs.columns and sorted(r.doc_id for r in out.collect()) == [4, 5]


def test_an_item_is_found_by_its_rare_seeds_or_not_at_all():
    """What the common seeds alone cover is under the share: a document without a rare seed can't be found."""
    r = np.random.default_rng(8)
    for _ in range(100):
        n, size, share = int(r.integers(3, 40)), 3, float(r.choice([0.3, 0.6, 1.0]))
        grams = r.integers(0, 12, n - size + 1).astype(np.uint64)
        often = r.integers(1, 5, 12)[grams.astype(int)]
        rare = decontamination.rare_seeds(grams, often, size, n, share)
        words = np.zeros(n, bool)
        for i in np.flatnonzero(~np.isin(grams, rare)):
            words[i : i + size] = True
        assert words.sum() < share * n and len(rare)


# 3: substring dedup


def slow_spans(docs, length=50):
    """Words of each document that are in a window which another document has."""
    seen = defaultdict(set)
    texts = {d: words(t) for d, t in docs if d is not None}
    for d, w in texts.items():
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])].add(d)
    out = set()
    for d, w in texts.items():
        for i in range(len(w) - length + 1):
            if len(seen[tuple(w[i : i + length])]) > 1:
                out |= {(d, k) for k in range(i, i + length)}
    return out


def covered(frame_):
    return {(r.doc_id, k) for r in frame_.collect() for k in range(r.start_word, r.end_word)}


def test_repeated_passages_are_those_of_all_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = slow_spans([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert covered(substring_dedup.repeated_spans(docs)) == want and want


def test_passages_of_all_lengths_and_levels(spark):
    shared = prose(70, 420)
    w = shared.split()
    rows = [(1, shared), (2, "x y z " + " ".join(w[:400]) + " q"), (3, prose(71, 30) + " " + " ".join(w[100:149])), (4, prose(72, 10) + " " + " ".join(w[100:150]) + " tail"), (5, None), (6, ""), (None, shared), (7, prose(73, 300))]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clash=True)
    got = substring_dedup.repeated_spans(docs)
    assert covered(got) == slow_spans(rows)
    longest = {r.doc_id: r.longest for r in got.collect()}
    assert set(longest) == {1, 2, 4} and longest[1] >= 200 and longest[4] == 50
    out = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs).collect() if r.doc_id is not None}
    assert out[1] == shared and out[7] == rows[7][1] and out[3] == rows[2][1] and out[5] is None and out[6] == ""
    assert words(out[2]) == ["x", "y", "z", "q"] and words(out[4])[-1] == "tail" and len(words(out[4])) == 11
    assert substring_dedup.substring_dedup(docs).columns == docs.columns


def slow_longest(docs, spans):
    """The greatest of 50, 100, 200, ... words of a window inside each span that another document has."""
    texts, out = {d: words(t) for d, t in docs if d is not None}, {(d, s): 0 for d, s, _ in spans}
    length = 50
    while length <= max(len(w) for w in texts.values()):
        seen = defaultdict(set)
        for d, w in texts.items():
            for i in range(len(w) - length + 1):
                seen[hash(tuple(w[i : i + length]))].add(d)
        for d, s, e in spans:
            w = texts[d]
            if any(len(seen[hash(tuple(w[i : i + length]))]) > 1 for i in range(s, e - length + 1)):
                out[d, s] = length
        length *= 2
    return out


def test_longest_is_that_of_all_windows(spark, small):
    """Passages of exactly a level's words have one window of it, wherever its least hash is."""
    rows = []
    for i, n in enumerate([99, 100, 100, 100, 101, 130, 199, 200, 200, 205, 400, 400, 410, 805]):
        rows += [(3 * i + j, prose(900 + 3 * i + j, 20 + 7 * j) + " " + prose(800 + i, n) + " " + prose(1200 + 3 * i + j, 30)) for j in (1, 2)]
    made = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for d in (made, docs):
        held = [tuple(r) for r in d.select("doc_id", "text").collect()]
        for hot in (substring_dedup.HOT, 1):
            got = substring_dedup.repeated_spans(d, hot_rows=hot).collect()
            assert {(r.doc_id, r.start_word): r.longest for r in got} == slow_longest(held, [(r.doc_id, r.start_word, r.end_word) for r in got])


def test_hot_anchors_give_the_same_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert {tuple(r) for r in substring_dedup.repeated_spans(docs, hot_rows=2).collect()} == {tuple(r) for r in substring_dedup.repeated_spans(docs).collect()}
    assert {tuple(r) for r in substring_dedup.repeated_spans(docs, True, 3).collect()} == {tuple(r) for r in substring_dedup.repeated_spans(docs, True).collect()}


def test_only_repeated_windows_are_extended(spark, small, monkeypatch):
    """Each window of a level has a first half that another document has too, and all sampled windows with such a half are there."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    levels, counted = {}, substring_dedup._counted

    def spy(windows, length):
        levels[length] = {(r.doc, r.pos) for r in windows.collect()}
        return counted(windows, length)

    monkeypatch.setattr(substring_dedup, "_counted", spy)
    spans = substring_dedup.repeated_spans(docs).collect()
    assert sorted(levels) == [100 << i for i in range(len(levels))] and len(levels) >= 3
    for length, found in levels.items():
        seen = defaultdict(set)
        for d, w in texts.items():
            for i in range(len(w) - length // 2 + 1):
                seen[tuple(w[i : i + length // 2])].add(d)
        assert all(len(seen[tuple(texts[d][p : p + length // 2])]) > 1 and p + length <= len(texts[d]) for d, p in found)
    assert max(r.longest for r in spans) == max(levels) // 2


def test_bitmaps_know_all_members(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 5000, np.int64)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    a, b = common.filters([(df, 5000), (df.limit(0), 0)])
    assert a.value.has(keys).all() and not b.value.has(keys).any()
    assert a.value.has(np.random.default_rng(1).integers(-(2**63), 2**63, 100_000, np.int64)).mean() < 0.01


def test_substring_dedup_of_messy_rows(spark):
    docs = frame(spark)
    assert covered(substring_dedup.repeated_spans(docs)) == slow_spans([(r[0], r[1]) for r in messy() if r[0] != 9])
    assert substring_dedup.substring_dedup(docs).count() == len(messy())
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0


def test_window_hashes_tell_windows_apart():
    t = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    for size in (1, 2, 5, 25, 50):
        h = window_hashes(t, size)
        by = defaultdict(set)
        for i, x in enumerate(h.tolist()):
            by[x].add(tuple(t[i : i + size].tolist()))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({tuple(t[i : i + size].tolist()) for i in range(len(h))})


# 4: line dedup


def slow_lines(rows, least):
    norm = lambda x: re.sub(r"[ \t\r\f\x0b ]+", " ", x.lower()).strip(" ")
    seen = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        for x in (t or "").split("\n") if t is not None else []:
            seen[norm(x)].add(("null", k) if i is None else i)
    hot = {x for x, d in seen.items() if x and len(d) >= least}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if norm(x) not in hot]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_lines_are_dropped_as_by_hand(spark):
    rows = [(i, f"Menu  Home\nown line {i}\n\ntail\t {i % 3}") for i in range(12)] + [(None, "menu home\nx"), (None, "Menu Home"), (3, "menu home\nown line 3"), (20, None), (21, ""), (22, "MENU HOME"), (22, "MENU HOME")]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clash=True)
    for least in (2, 4, 10):
        got = line_dedup.line_dedup(docs, least)
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == slow_lines(rows, least)
    blanks = line_dedup.line_dedup(frame(spark, [(i, "a\u00a0 b" if i % 2 else "a b", "en", "s", 0) for i in range(10)]), 10)
    assert {r.n_dropped for r in blanks.collect()} == {1}
    assert {"n_lines", "n_dropped", "root"} <= set(got.columns) and len(got.columns) == len(docs.columns)
    assert line_dedup.line_dedup(frame(spark)).count() == len(messy())
    assert line_dedup.line_dedup(empty(spark)).count() == 0
