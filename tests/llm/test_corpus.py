"""Sharding, WARC, language ID, token counts, mixing, quality rules and the pipeline."""

import gzip
import io
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import decontamination, language_id, mixing, quality, sharding, token_counts, vocab, warc
from quadrille.llm.common import Table, shared_path

from .fixtures import empty, frame, messy, prose
from .test_dedup import brute_groups, words

# 5: sharding


def test_shards_hold_their_rows_and_meet_the_target(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    target = 20_000
    out = sharding.shard(docs, target_bytes=target)
    assert out.columns == [*docs.columns, "shard", "shard_id"]
    rows = out.select("doc_id", "shard", "shard_id", F.octet_length("text").alias("n")).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.shard].append(r.n)
    assert all(sum(v) <= target or len(v) == 1 for v in sizes.values())
    assert {r.shard: r.shard_id for r in rows} == {s: i for i, s in enumerate(sorted(sizes))}
    # leaves are the ends of a binary tree: both sides of each cut are there
    ends = set(sizes)
    inner = {s[:i] for s in ends for i in range(len(s))}
    assert all(n + b in ends | inner for n in inner for b in "01") and not ends & inner


def test_tree_is_the_same_however_it_is_built(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    far = {(r.doc_id, r.shard) for r in sharding.shard(docs, 20_000, local_rows=16).select("doc_id", "shard").collect()}
    near = {(r.doc_id, r.shard) for r in sharding.shard(docs, 20_000).select("doc_id", "shard").collect()}
    assert far == near


def slow_cut(values, weights):
    best = None
    for v in sorted(set(values))[:-1]:
        low = sum(w for x, w in zip(values, weights) if x <= v)
        if best is None or abs(2 * low - sum(weights)) < best[0]:
            best = (abs(2 * low - sum(weights)), v)
    return None if best is None else best[1]


def test_cut_is_the_weighted_median():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = r.integers(1, 12)
        v, w = r.integers(0, 5, n), r.integers(1, 9, n)
        assert sharding.cut(v, w) == slow_cut(v.tolist(), w.tolist())


def slow_tree(rows, target):
    """The leaf of each row of (vector, bytes), by plain recursion over all of the table."""
    span = [max(v[i] for v, _ in rows) - min(v[i] for v, _ in rows) for i in range(4)]
    out = {}

    def split(own, path):
        total = sum(w for _, w in own)
        widths = [(max(v[i] for v, _ in own) - min(v[i] for v, _ in own)) / max(span[i], 1) * sharding.WEIGHTS[i] for i in range(4)]
        d = widths.index(max(widths))
        values = sorted({v[d] for v, _ in own})
        if total <= target or len(values) < 2:
            out.update({v: path for v, _ in own})
            return
        best = min(values[:-1], key=lambda x: (abs(2 * sum(w for v, w in own if v[d] <= x) - total), x))
        split([r for r in own if r[0][d] <= best], path + "0")
        split([r for r in own if r[0][d] > best], path + "1")

    split(rows, "")
    return out


def test_tree_is_that_of_plain_recursion(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    vec = docs.select("doc_id", F.octet_length("text").alias("w"), *sharding.vector(F.col("lang"), F.col("source"), F.col("text"), F.col("doc_id"))).collect()
    keys = {r.doc_id: tuple(r[d] for d in sharding.DIMS) for r in vec}
    for target in (20_000, 90_000):
        want = slow_tree([(keys[r.doc_id], r.w) for r in vec], target)
        got = {r.doc_id: r.shard for r in sharding.shard(docs, target, local_rows=16).select("doc_id", "shard").collect()}
        assert got == {i: want[k] for i, k in keys.items()}


def test_sharding_of_messy_rows(spark):
    out = sharding.shard(frame(spark, clash=True), target_bytes=1000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in messy())
    by = defaultdict(set)
    for r in rows:
        by[(r.doc_id, r.text, r.lang, r.source)].add(r.shard)
    assert all(len(v) == 1 for v in by.values())
    assert sharding.shard(empty(spark)).count() == 0


# 6: WARC


def test_warc_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {tuple(r) for r in warc.warc_round_trip(pages).collect()}
    first = {}
    for r in sorted(pages.collect()):
        first.setdefault(r.html, tuple(r))
    assert got == set(first.values())


def test_warc_keeps_odd_pages_and_reads_by_range(spark):
    rows = [(1, "http://a/b c\r\nX: y", "<p>é\r\n\r\nWARC/1.0</p>"), (2, None, None), (None, "", ""), (3, "http://ü/%20", "x" * 3_000_000), (2, "http://again", "<p>"), (2, "http://again", "<p>")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, offset int")
    folder = shared_path(spark, "warc-test")
    files = Table(warc.write_warc(pages, folder), "f")
    index = Table(warc.index_warc(spark, files.df), "i").df
    assert index.count() == len(rows)
    assert Counter(tuple(r) for r in warc.read_records(index).collect()) == Counter(rows)
    some = index.where("page_id = 2 and url is not null")
    assert Counter(tuple(r) for r in warc.read_records(some.unionByName(some)).collect()) == Counter(rows[4:] * 2)
    for r in index.collect():  # each range is a gzip member of its own
        with open(r.file.removeprefix("file:").replace("///", "/"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.0")
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_records_are_the_same_bytes_on_every_run(spark):
    for page in ((1, "http://a", "x"), (None, None, None), (None, "http://a", "")):
        assert warc.record(*page) == warc.record(*page) and warc.record(*page) != warc.record(*page, date="2020-01-01T00:00:00Z")
    assert warc.record(None, "a", "x") != warc.record(None, "b", "x")


def test_reads_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_SPAN", 1 << 10)
    pages = spark.createDataFrame([(i, f"http://a/{i}", prose(i, 300)) for i in range(60)], "page_id long, url string, html string")
    files = Table(warc.write_warc(pages.coalesce(1), shared_path(spark, "warc-test")), "f")
    index = Table(warc.index_warc(spark, files.df), "i").df
    got = warc.read_records(index)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pages.collect()))


def test_coalesced_reads_cover_and_respect_limits():
    r = np.random.default_rng(1)
    at, ranges = 0, []
    for _ in range(300):
        at += int(r.integers(0, 200))
        n = int(r.integers(1, 90))
        ranges.append((at, n))
        at += n
    reads = warc.coalesced(ranges, 50, 600)
    assert sorted(i for x in reads for i in x[2]) == list(range(300))
    for start, end, held in reads:
        assert end - start <= 600 or len(held) == 1
        assert all(start <= ranges[i][0] and ranges[i][0] + ranges[i][1] <= end for i in held)


def test_scan_reads_members_across_chunks():
    parts = [gzip.compress(os.urandom(n)) for n in (0, 10, 2_000_000, 5)]
    found = list(warc.scan(io.BytesIO(b"".join(parts))))
    assert [x[1] for x in found] == [len(p) for p in parts] and [x[2] for x in found] == [gzip.decompress(p) for p in parts]
    with pytest.raises((ValueError, EOFError)):
        list(warc.scan(io.BytesIO(parts[2][:-9])))


# 7: language ID


def test_forward_is_the_sum_over_segmentations():
    v = language_id.Pieces(f"{vocab.TOKENIZER_DIR}/{language_id.PIECES}")
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(v.size) * 0.1 + 1e-3, 3).T + 1e-9)

    def total(word):
        def paths(i):
            if i == len(word):
                return np.ones(3)
            return sum((np.exp(logp[list(ids)].sum(0)) * paths(j) for a, j, ids in spans if a == i), np.zeros(3))

        spans = v.spans(word)
        return np.log(paths(0))

    words = ["the", "Straße", "日本語", "x", "naïve—yes!", "🙂🙂", "internationalisation"[:12]]
    got = language_id.forward_many(pa.array([*words, "a" * 300, ""]), v, logp)
    assert np.allclose(got[: len(words)], [total("▁" + w) for w in words])
    assert np.allclose(got[len(words)], language_id.forward("▁" + "a" * 300, v, logp))


def test_expected_counts_are_those_of_all_segmentations():
    v = language_id.Pieces(f"{vocab.TOKENIZER_DIR}/{language_id.PIECES}")
    logp = np.log(np.random.default_rng(4).dirichlet(np.ones(v.size)))
    counts = {"hello": 2.0, "世x": 1.0}
    want = np.zeros(v.size)
    for w, c in counts.items():
        word = "▁" + w
        spans = v.spans(word)

        def paths(i):
            return [[]] if i == len(word) else [[*ids, *rest] for a, j, ids in spans if a == i for rest in paths(j)]

        every = [(p, np.exp(logp[p].sum())) for p in paths(0)]
        for p, x in every:
            np.add.at(want, p, c * x / sum(y for _, y in every))
    parts = language_id.lattices(*language_id._characters(pa.array(list(counts))), v)
    weight = np.array(list(counts.values()))
    assert np.allclose(sum(x.expected(logp, weight[w]) for w, x in parts), want)


def test_language_id_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars >= 40")
    model = language_id.fit(language_id.training_sample(train))
    got = language_id.language_id(test, model).collect()
    assert sum(r.lang == r.predicted for r in got) / len(got) >= 0.95


def test_language_id_of_messy_rows(spark):
    got = language_id.language_id(frame(spark, clash=True)).collect()
    assert len(got) == len(messy())
    assert {r.n_words for r in got if r.predicted is None} == {0}
    assert all(math.isfinite(r.log_prob) for r in got)
    assert language_id.language_id(empty(spark)).count() == 0
    none = language_id.language_id(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].predicted is None and none[0].log_prob == 0.0


# 8: token counts


def test_ledger_is_the_sum_of_its_batches_and_each_counts_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    name = "byte-bpe-multi-50k.v1"
    counts = Table(token_counts.counted(docs, name), "c").df
    ledger = token_counts.Ledger(spark, shared_path(spark, "ledger-test"))
    assert ledger.totals().count() == 0
    assert ledger.commit("a", token_counts.inserts(counts.where("doc_id % 2 = 0")))
    assert not ledger.commit("a", token_counts.inserts(counts))
    assert ledger.commit("b", token_counts.inserts(counts.where("doc_id % 2 = 1")))
    assert ledger.commit("c", token_counts.deletes(counts.where("doc_id % 3 = 0")))
    old, new = counts.where("doc_id = 1"), token_counts.counted(docs.where("doc_id = 1").withColumn("text", F.lit("now short")).withColumn("lang", F.lit("xx")), name)
    assert ledger.commit("d", token_counts.revisions(old, new))
    encode = vocab.ranks(f"{vocab.TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken").encode_ordinary
    want = defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        if r.doc_id % 3:
            text, lang = ("now short", "xx") if r.doc_id == 1 else (r.text, r.lang)
            for i, x in enumerate((1, len(encode(text)), len(text))):
                want[(r.source, lang, name)][i] += x
    totals = lambda: {tuple(r)[:3]: list(r)[3:] for r in ledger.totals().collect()}
    assert totals() == dict(want)
    assert ledger.compact("snapshot")
    assert totals() == dict(want) and not ledger.commit("b", token_counts.inserts(counts))
    assert not ledger.compact("snapshot") and totals() == dict(want)
    ledger.vacuum()
    assert totals() == dict(want) and not ledger.commit("a", token_counts.inserts(counts)) and not ledger.compact("snapshot")
    # a run that dies before the rename leaves nothing that counts, nor one that dies between folding and deleting
    place, ledger._place = ledger._place, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        ledger.compact("second")
    ledger._place = place
    assert totals() == dict(want)
    assert ledger.commit("e", token_counts.inserts(counts.where("doc_id = 1"))) and ledger.compact("second")
    assert ledger.commit("f", token_counts.deletes(counts.where("doc_id = 1"))) and totals() == dict(want)
    ledger.vacuum()
    assert token_counts.Ledger(spark, ledger.path).batches() == ["a", "b", "c", "d", "e", "f", "second", "snapshot"] and totals() == dict(want)
    with pytest.raises(ValueError):
        ledger.commit("a/b", token_counts.inserts(counts))


def test_registered_counts_are_a_recount(spark, small):
    import re

    from quadrille.llm import queries

    docs, toxic = spark.read.parquet(f"{small}/documents.parquet").collect(), {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    want, masked = defaultdict(lambda: [0, 0, 0]), 0
    for r in docs:
        text = re.sub(r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "<address>", r.text, flags=re.A)
        masked += text != r.text
        if r.doc_id not in toxic:
            for name, file in token_counts.TOKENIZERS.items():
                for i, x in enumerate((1, len(vocab.token_ids(f"{vocab.TOKENIZER_DIR}/{file}", [text])[0]), len(text))):
                    want[(r.source, r.lang, name)][i] += x
    assert masked and toxic
    assert {tuple(r)[:3]: list(r)[3:] for r in queries.op8_token_counts(spark, small).collect()} == dict(want)


def test_token_counts_of_messy_rows(spark):
    got = token_counts.counted(frame(spark, clash=True), "byte-bpe-multi-50k.v1").collect()
    assert len(got) == len(messy()) and {r.tokens for r in got if not r.chars} == {0}
    assert token_counts.counted(empty(spark), "piece_bpe_32k.model").count() == 0


# 9: mixing


def slow_mix(rows, weights=None, budget=None):
    """Pareto order sampling as in the docstring, over (id, text, source) rows with distinct ids."""
    import hashlib

    weight = lambda t: len(bin(len(t))) - 2 if t else 0
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, weight(t)))
    n, total = {s: len(v) for s, v in by.items()}, sum(len(v) for v in by.values())
    raw = {s: (round((n[s] / total) ** mixing.TEMPERATURE, 9) if weights is None else weights.get(s, 0.0)) if sum(x for _, x in by[s]) else 0.0 for s in by}
    exact = {s: round((budget or total) * r / sum(raw.values()), 6) for s, r in raw.items() if r}
    take = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (-(exact[s] - take[s]), s))[: (budget or total) - sum(take.values())]:
        take[s] += 1
    out = Counter()
    for s, k in take.items():
        x_total = sum(x for _, x in by[s])
        ranked = []
        for i, x in by[s]:
            e = k * x / x_total
            p = e - math.floor(e)
            u = (int(hashlib.md5(f"{mixing.SEED}:{i}#0".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            out[i] += math.floor(e)
            if p > 0:
                ranked.append(((u / (1 - u)) / (p / (1 - p)), i))
        left = k - sum(math.floor(k * x / x_total) for _, x in by[s])
        for _, i in sorted(ranked)[:left]:
            out[i] += 1
    return +out


def test_mixing_is_the_slow_sampler(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    for kw in ({}, {"weights": {"src0": 1.0, "src1": 3.0}, "budget": 77}, {"budget": 1000}):
        got = Counter(r.doc_id for r in mixing.mix_sources(docs, **kw).select("doc_id").collect())
        assert got == slow_mix(rows, **kw)


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "x" * (10 if i % 2 else 1000), "en", "s", 0) for i in range(400)]
    docs = frame(spark, rows)
    drawn = Counter()
    for k in range(6):
        out = mixing.mix_sources(docs, budget=100, seed=f"seed-{k}").select("doc_id").collect()
        assert len(out) == 100
        drawn += Counter(r.doc_id % 2 for r in out)
    # weights are 4 and 10: 2.5 times as many of the long ones
    assert 2.0 < drawn[0] / drawn[1] < 3.1


def test_mixing_of_messy_rows(spark):
    docs = frame(spark, clash=True)
    out = mixing.mix_sources(docs)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert len(rows) == len(messy()) and all(r.text for r in rows)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(docs, weights={"nowhere": 1.0}).count() == 0


# 10: quality rules


def test_measures_are_those_of_each_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sp, encode = vocab.pieces(f"{vocab.TOKENIZER_DIR}/{quality.PIECES}"), vocab.ranks(f"{vocab.TOKENIZER_DIR}/{quality.WORDS}").encode_ordinary
    for r in quality.measure(docs).collect():
        t = texts[r.doc_id]
        ids = sp.encode(t)
        assert (r.n_chars, r.n_tokens, r.n_pieces) == (len(t), len(encode(t)), len(ids))
        assert math.isclose(r.fallback_share, sum(sp.is_byte(i) for i in ids) / len(ids))
        c = Counter(ids)
        assert math.isclose(r.token_entropy, -sum(x / len(ids) * math.log2(x / len(ids)) for x in c.values()), abs_tol=1e-9)


def test_rules_keep_good_documents_and_reject_junk(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in quality.quality_rules(docs).select("doc_id").collect()}
    good, bad = ({r.doc_id for r in labels.where(f"quality = {q}").collect()} for q in (1, 0))
    assert len(good & kept) >= 0.98 * len(good)
    assert len(bad & kept) < 0.3 * len(bad)
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_bands_hold_the_rows_they_were_fitted_on(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    good = labels.where("quality = 1")
    bands = quality.fit_bands(docs, good, long=128)
    assert set(bands) == {"en", "fr", "de", "es"} and quality.fit_bands(docs, good.limit(0)) == {}
    kept = {r.doc_id for r in quality.quality_rules(docs, bands | {"": quality.BANDS[""]}).collect()}
    assert {r.doc_id for r in good.collect()} <= kept
    # the short are judged too: one word again and again
    junk = frame(spark, [(1, "spam " * 30, "en", "s", 0), (2, "go " * 9, "fr", "s", 0), (3, "Guten Tag", "de", "s", 0)])
    assert {r.doc_id for r in quality.quality_rules(junk).collect()} == {3}


def test_quality_of_messy_rows(spark):
    docs = frame(spark, clash=True)
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert not {4, 5} & set(kept) and 8 not in kept and {1, 2, 3, 7, 10} <= set(kept)
    assert quality.measure(docs).count() == len(messy())
    assert quality.quality_rules(empty(spark)).count() == 0


# the pipeline


def test_stages_take_effect_in_order(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = Table(stage(spark, docs, small), "stage").df
        assert out.columns == docs.columns + (["shard", "shard_id"] if name == "shard" else [])
        if name not in ("mix_sources", "shard"):
            assert 0 < out.count() < before
        before, docs = out.count(), out
    whole = corpus_pipeline.run(spark, small)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, docs.collect()))


def slow_reason(text, lang, sp, encode):
    """The rules of a language's band, one text at a time; None for a text that stays."""
    ids, n = sp.encode(text), len(encode(text))
    if not n:
        return "empty"
    band, c = quality.BANDS[lang], Counter(ids)
    if sum(sp.is_byte(i) for i in ids) / len(ids) > band.max_fallback:
        return "fallback"
    if not band.min_chars_per_token - band.low / n**0.5 <= len(text) / n <= band.max_chars_per_token + band.high / n**0.5:
        return "fertility"
    bits = -sum(x / len(ids) * math.log2(x / len(ids)) for x in c.values())
    return "entropy" if bits < min(band.min_entropy, band.entropy_share * math.log2(len(ids))) else None


def test_pipeline_is_that_of_slow_stages(spark, small):
    """All five stages one text, pair, draw and cut at a time."""
    sp, encode = vocab.pieces(f"{vocab.TOKENIZER_DIR}/{quality.PIECES}"), vocab.ranks(f"{vocab.TOKENIZER_DIR}/{quality.WORDS}").encode_ordinary
    table = spark.read.parquet(f"{small}/documents.parquet")
    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in table.collect())
    docs = [d for d in docs if slow_reason(d[1], d[2], sp, encode) is None]
    gone = {docs[k][0] for g in brute_groups(docs) for k in g} - {min(docs[k][0] for k in g) for g in brute_groups(docs)}
    docs = [d for d in docs if d[0] not in gone]
    items = [words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaks(text):
        doc = words(text)
        at = defaultdict(list)
        for j in range(len(doc) - 3):
            at[tuple(doc[j : j + 4])].append(j)
        for item in items:
            seeds = [(i, j) for i in range(len(item) - 3) for j in at.get(tuple(item[i : i + 4]), ())]
            if len(seeds) * 4 >= decontamination.COVERAGE * len(item):
                found = decontamination.tiles(np.array(item), np.array(doc), seeds, 4)
                if sum(x[2] for x in found) >= decontamination.COVERAGE * len(item):
                    return True
        return False

    left = [d for d in docs if not leaks(d[1])]
    assert 0 < len(left) < len(docs) and gone
    drawn = slow_mix([(d[0], d[1], d[3]) for d in left])
    vec = table.select("doc_id", F.octet_length("text").alias("w"), *sharding.vector(F.col("lang"), F.col("source"), F.col("text"), F.col("doc_id"))).collect()
    keys = {r.doc_id: (tuple(r[d] for d in sharding.DIMS), r.w) for r in vec}
    tree = slow_tree([(keys[i][0], keys[i][1] * n) for i, n in drawn.items()], sharding.TARGET_BYTES)
    want = Counter({(i, tree[keys[i][0]]): n for i, n in drawn.items()})
    assert Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, small).collect()) == want


def test_stages_on_messy_and_empty_tables(spark, small):
    for start in (frame(spark, clash=True), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before = docs.collect()
            docs = Table(stage(spark, docs, small), "stage").df
            own = start.columns
            assert docs.columns == ([c for c in own if c not in ("shard", "shard_id")] + ["shard", "shard_id"] if name == "shard" else own)
            rows, was = [Counter((r.doc_id, r.text, r.source, r.root if "root" in own else 0) for r in x) for x in (docs.collect(), before)]
            if name == "quality_rules":
                good = Counter((r.doc_id, r.n_chars) for r in quality.quality_rules(start).collect())
                assert Counter((i, len(t)) for i, t, *_ in rows.elements()) == good and rows <= was
            elif name == "near_dedup":
                once = list({(i, t) for i, t, *_ in was})
                groups = {min((once[k] for k in g), key=lambda x: (x[0] is None, x[0] or 0)) for g in brute_groups(once)}
                alone = {once[k] for k in range(len(once))} - {once[k] for g in brute_groups(once) for k in g}
                assert {(i, t) for i, t, *_ in rows} == groups | alone and set(rows.values()) <= {1}
            elif name == "mix_sources":
                assert sum(rows.values()) == sum(was.values()) and set(rows) <= set(was)
            else:
                assert rows == was
        assert docs.isEmpty() == start.isEmpty()


def test_prose_is_deterministic():
    assert prose(1, 5) == prose(1, 5)
