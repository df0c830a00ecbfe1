"""Operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import (
    components,
    cotrain,
    fmindex,
    gru,
    hilbert,
    jaccard,
    lm,
    mixing,
    neighbours,
    ordinal,
    surrogates,
    warc,
)
from traceloom.llm import words as wd
from traceloom.llm.common import attach
from traceloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------------ words

def test_words_are_those_of_the_patterns():
    import pyarrow as pa

    texts = ["Ab  c\tD\x0be", "", None, "ü-x 9z\x7f漢", "a" * 3_000_000, " "]
    data, offsets = wd.text_buffer(pa.array(texts))
    for kind, pattern in ((wd.VISIBLE, WORDS), (wd.LETTERS, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        got = collections.defaultdict(list)
        hashes = {}
        for a, b in wd.chunks(offsets, 8):
            f = wd.words(data, offsets, a, b, kind)
            for d, s, e, h in zip(f.doc, f.start, f.end, f.hash, strict=True):
                word = wd.LOWER[data[s:e]].tobytes().decode()
                got[int(d)].append(word)
                assert hashes.setdefault(word, h) == h
        assert len(set(hashes.values())) == len(hashes)
        assert [got[i] for i in range(len(texts))] == [pattern.findall(lowered(t)) for t in texts]


# ------------------------------------------------------------------ sharding

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    cells = spark.range(side**dims).select(
        *[(F.floor(F.col("id") / side**d) % side).cast("int").alias(f"c{d}") for d in range(dims)])
    rows = cells.withColumn("at", hilbert.curve_index([F.col(f"c{d}") for d in range(dims)], bits)).collect()
    rows.sort(key=lambda r: r["at"])
    assert [r["at"] for r in rows] == list(range(side**dims))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[d] - b[d]) for d in range(dims)) == 1


def test_shards_are_even_gapless_and_prune(docs):
    rows = hilbert.shard_documents(docs).cache()
    sizes = collections.Counter(r.shard for r in rows.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows.filter(F.col("shard") == shard).collect()) == list(range(n))
    import zlib

    crc = {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect()}
    assert all((r["size"], r.text_crc32) == crc[r.doc_id] for r in rows.collect())
    points = hilbert.cut_points(rows, ["text_crc32", "doc_id"])
    again = rows.withColumn("other", hilbert.shard_of(points, ["text_crc32", "doc_id"]))
    assert again.filter("other != shard").count() == 0
    zones = hilbert.zone_map(rows, ["size", "doc_id"]).collect()
    for dim, low, high in (("size", 0, 500), ("doc_id", 0, 20)):
        met = [z for z in zones if z[f"min_{dim}"] <= high and z[f"max_{dim}"] >= low]
        assert len(met) < len(zones)


# ------------------------------------------------------------------ mixing

def test_texts_are_cut_at_whole_values(spark):
    rows = [("ftp://one/a",)] + [(f"https://site{i % 40:02d}.example/long/shared/path",) for i in range(1999)]
    rows += [(None,), ("",)]
    table = spark.createDataFrame(rows, "source string")
    got = hilbert.with_cells(table, ["source"]).groupBy("source").agg(
        F.min("source_cell").alias("cell"), F.count_distinct("source_cell").alias("cells"), F.count("*").alias("n"))
    cells = {r.source: r.cell for r in got.collect()}
    assert {r.cells for r in got.collect()} == {1} and len(set(cells.values())) == 16
    values = sorted(v for v in cells if v is not None)
    assert [cells[v] for v in values] == sorted(cells[v] for v in values) and cells[None] == 0
    held = sorted(v for (v,) in rows if v is not None)
    cuts = [held[len(held) * i // 16] for i in range(1, 16)]
    assert all(cells[v] == sum(v >= c for c in cuts) for v in values)


def test_targets_fill_up_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 50, "": 0}
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(table).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in sizes if t not in capped)
                 for s in sizes if s not in capped}
        more = {s for s, x in share.items() if x > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert got[s].target == pytest.approx(share.get(s, 3 * sizes[s]))
        assert got[s].weight == weight[s]


def test_mix_emits_what_it_plans(docs):
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    seen = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert seen == {i: r.copies for i, r in plan.items() if r.copies}
    words = {r.doc_id: len(WORDS.findall(r.text)) for r in docs.collect()}
    assert all(r["size"] == words[i] for i, r in plan.items())
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in plan.values())


def test_salted_join_is_the_broadcast_join(spark):
    left = spark.createDataFrame([(i, None if i % 3 else "k") for i in range(30)], "i int, key string")
    right = spark.createDataFrame([("k", 1), (None, 2)], "key string, v int")
    both = [sorted((tuple(r) for r in attach(left, right, "key", limit).collect()), key=str) for limit in (10, 0)]
    assert both[0] == both[1] and len(both[0]) == 30


# ------------------------------------------------------------------ n-gram join

def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = WORDS.findall(lowered(text))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (2, 60), (5, 80)])
def test_components_are_brute_force(spark, size, percent):
    rng = random.Random(size)
    rows, base = [], [f"w{i}" for i in range(50)]
    common = [rng.choice(base) for _ in range(25)]
    for i in range(240):
        kind = i % 6
        if kind < 3 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 1 + len(words) // 12)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(base)
        else:
            words = [rng.choice(base) for _ in range(rng.choice((1, 2, 3, 4, 8, 40, 90)))]
            words = common + words if kind == 5 else words
        rows.append((i, " ".join(words)))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, size, percent)


def test_tiles_of_a_large_group_lose_no_link(monkeypatch):
    rng = random.Random(5)
    base = list(range(300))
    sets = []
    for _ in range(120):
        own = set(base) - set(rng.sample(base, rng.choice((0, 10, 22, 60))))
        sets.append(np.sort(wd.mix(np.array(sorted(own), dtype=np.uint64))))
    held = [(0 if i < 60 else 1, i, s) for i, s in enumerate(sets)]
    edges = (jaccard._links(held[:60], (0, 0, 0), 85) + jaccard._links(held[60:], (0, 1, 1), 85)
             + jaccard._links(list(held), (0, 0, 1), 85))
    root = list(range(120))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    for a, b in itertools.combinations(range(120), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            assert top(a) == top(b)


def test_one_per_group_keeps_the_first(docs):
    found = {r.doc_id: r.component_id for r in jaccard.components(docs, 5, 80).collect()}
    left = [r.doc_id for r in jaccard.one_per_group(docs, 5, 80).collect()]
    assert sorted(left) == sorted(i for i, c in found.items() if i == c)


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in nodes}


# ------------------------------------------------------------------ decontamination

def test_fm_index_finds_what_scanning_finds():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 6, 3000)
    text[100:160] = text[700:760] = text[2000:2060]
    index = fmindex.FMIndex(text)
    phrases = np.zeros((200, 8), dtype=np.int64)
    length = rng.integers(1, 9, 200)
    for i, n in enumerate(length):
        at = rng.integers(0, 2990)
        own = text[at : at + n] if i % 4 else rng.integers(1, 7, n)
        own = np.where(own == 0, 1, own)
        phrases[i, 8 - n :] = own
    low, high = index.search(phrases, length)
    for i, n in enumerate(length):
        own = phrases[i, 8 - n :]
        want = [a for a in range(len(text) - n + 1) if (text[a : a + n] == own).all()]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


def test_slices_of_the_benchmark_agree(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = fmindex.find(docs, bench)
    many = fmindex.find(docs, bench, limit=200)
    key = lambda r: (r.doc_id, r.n_words, [(s.first_word, s.end_word) for s in r.spans], sorted(r["items"]))
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))


def test_cleaned_texts_hold_no_phrase(spark):
    phrase = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, f"Before it: {phrase.upper()}! After it."), (2, "nothing of that kind"), (3, phrase + " " + phrase),
            (4, "Zeta eta theta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    bench = spark.createDataFrame([("a", phrase), ("b", "quite short")], "item_id string, text string")
    got = {r.doc_id: r for r in fmindex.cleaned(docs, bench).collect()}
    assert got[1].text == "Before it: ! After it." and got[1].n_chars == len(got[1].text)
    assert got[3].text.strip() == "" and got[2].text == rows[1][1] and got[4].text == rows[3][1]
    assert not any(r.spans for r in fmindex.find(spark.createDataFrame(list(got.values())), bench).collect())


def test_cleaned_by_slices_is_cleaned_at_once(spark):
    w = [f"word{i}" for i in range(3000)]
    bench = spark.createDataFrame(
        [(f"i{i}", " ".join(w[i * 8 : i * 8 + 14])) for i in range(40)], "item_id string, text string")
    rows = [(1, "before, " + ", ".join(w[:198]) + "; after"), (2, "x " + " - ".join(w[80:95]) + " y"), (3, None),
            (4, " ".join([*w[:7], *w[16:30], *w[7:14]]))]  # cutting out the middle makes a new passage
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn(
        "n_chars", F.length("text").cast("long"))
    one = sorted(map(tuple, fmindex.cleaned(docs, bench).collect()))
    assert len(list(fmindex._slices(bench, 300))) > 2
    assert sorted(map(tuple, fmindex.cleaned(docs, bench, limit=300).collect())) == one
    assert one[0][1] == "before, ; after" and w[0] in one[3][1]


# ------------------------------------------------------------------ search

def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    big, hit = x.astype(float), 0
    for q in range(0, 1500, 20):
        s = big @ big[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(score - big[q] @ big[v]) < 1e-9 for _, v, score in own)
        hit += len(set(want.tolist()) & {v for _, v, _ in own})
    assert hit / (75 * 20) >= 0.9


def test_parts_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((16, 8)) * 4
    x = centres[np.arange(2048) % 16] + rng.standard_normal((2048, 8)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.nearest(x, np.arange(len(x)), 10)
    part = neighbours.balanced_parts(x, graph, 8)
    assert set(np.bincount(part)) == {256}
    assert (part[graph] == part[:, None]).mean() > 0.8
    assert neighbours.fit(x, 40_000, 20).probes < 32


# ------------------------------------------------------------------ language model

def test_gradients_are_right():
    shape = gru.Shape(3, 2)
    symbols = np.array([1, 2, 0, 3, 4, 0, 1, 1])
    p = {k: v.astype(np.float64) for k, v in gru.start(shape, np.ones(5), width=3).items()}
    rng = np.random.default_rng(0)
    p = {k: v + 0.3 * rng.standard_normal(v.shape) if k != "word_b" else v for k, v in p.items()}
    sizes = np.array([3, 3, 2])
    first = gru.log_likelihood(p, shape, symbols, sizes).sum()
    better = gru.fit({k: v.astype(np.float32) for k, v in p.items()}, shape, np.tile(symbols, 40))
    assert gru.log_likelihood(better, shape, symbols, sizes).sum() > first + 3


def test_probabilities_sum_to_one_and_streams_do_not_matter():
    shape = gru.Shape(70, 4)
    p = gru.start(shape, np.arange(1, 75))
    rng = np.random.default_rng(0)
    p = {k: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float32) if k not in ("word_b",) else v
         for k, v in p.items()}
    total = sum(np.exp(gru.log_likelihood(p, shape, np.array([5, 70, s]), np.array([3]))[0])
                / np.exp(gru.log_likelihood(p, shape, np.array([5, 70]), np.array([2]))[0]) for s in range(74))
    assert total == pytest.approx(1, abs=1e-4)
    sizes = rng.integers(1, 90, 50)
    symbols = rng.integers(1, 74, sizes.sum())
    symbols[np.cumsum(sizes) - 1] = 0
    one = gru.log_likelihood(p, shape, symbols, sizes, streams=1)
    assert np.allclose(one, gru.log_likelihood(p, shape, symbols, sizes, streams=7, window=5), rtol=1e-4)


def test_scores_against_counting(docs):
    import math
    import zlib

    rows = docs.collect()
    count, words = collections.Counter(), lambda t: [*WORDS.findall(lowered(t)), None]
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update(words(r.text))
    total, kinds = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    gain = []
    for r in rows:
        own, g = words(r.text), got[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
        assert g.base_score == pytest.approx(base) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        if g.held_out:
            gain.append(g.score - g.base_score)
    assert np.mean(gain) > 0


def test_network_learns_from_every_training_document(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i % 7}" for _ in range(1 + i % 5))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    monkeypatch.setattr(lm, "_REPLICA_TOKENS", 100)
    seen = spark.sparkContext.accumulator(0)
    replica = lm._replica

    def counting(*given):
        n, new = replica(*given)
        seen.add(n)
        return n, new

    monkeypatch.setattr(lm, "_replica", counting)
    model = lm.train(docs, lm._counts(docs))
    assert seen.value == model.total == sum(2 + i % 5 for i in range(6000))


def test_trainer_leaves_no_symbol_out():
    shape = gru.Shape(40, 2)
    p = gru.start(shape, np.ones(42))
    trainer = gru.Trainer(p, shape)
    trainer.learn(np.r_[np.full(96, 1), 39], 3, 16)
    assert trainer.p["word_b"][0, 39] > trainer.p["word_b"][0, 38]
    n, _ = lm._replica(p, shape, iter([np.full(2 * lm._BLOCK + 5, 1)]))
    assert n == 2 * lm._BLOCK + 5


def test_frequent_words_come_first(spark, monkeypatch):
    end = int(lm._END.astype(np.int64))
    counts = spark.createDataFrame([(i, 1000 // (i + 1)) for i in range(500)] + [(end, 3)], "word long, n long")
    words, n = lm._most_frequent(counts, 40)
    assert words.view(np.int64)[0] == end and len(words) <= 41
    assert sorted(words.view(np.int64)[1:].tolist()) == list(range(len(words) - 1))
    assert (np.diff(n[1:]) <= 0).all()


# ------------------------------------------------------------------ classifiers

def split_accuracy(labels, column, predicted):
    rows = labels.join(predicted, "doc_id").collect()
    return np.mean([bool(r[column]) == bool(r["out"]) for r in rows])


def test_quality_on_labels_kept_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = labels.filter("doc_id % 2 = 0")
    got = cotrain.score(docs, seen).select("doc_id", F.col("good").alias("out"))
    assert split_accuracy(labels.filter("doc_id % 2 = 1"), "quality", got) > 0.95


def test_every_confident_text_teaches(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    table = cotrain.view_table(docs)
    model = cotrain.train(docs, labels, rounds=1, table=table)
    texts = cotrain._texts_once(table)
    rows = texts.collect()
    assert len(rows) == table.select("same").distinct().count()
    text, page = cotrain._read([r.text for r in rows], [r.page for r in rows])
    by_text, by_page, _ = model.score(text, page)
    views = (model.scale.text_features(text, page), model.scale.page_features(page))
    sums = cotrain._told_sums(texts, model, (model.text, model.page))
    for (n, curve, slope), one, x, told in zip(
            sums, (model.text, model.page), views, (by_page, by_text), strict=True):
        sure = (told >= cotrain.SURE) | (told <= 1 - cotrain.SURE)
        z = np.c_[(x[sure] - one.mean) / one.scale, np.ones(sure.sum())]
        p = 1 / (1 + np.exp(-z @ one.weights))
        assert n == sure.sum() > 0
        np.testing.assert_allclose(curve, (z * (p * (1 - p) + 1e-6)[:, None]).T @ z, rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(slope, z.T @ ((told[sure] >= cotrain.SURE) - p), rtol=1e-6, atol=1e-6)


def test_toxicity_on_labels_kept_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = ordinal.train(docs, labels.filter("doc_id % 2 = 0"))
    got = ordinal.score(docs, model).select("doc_id", F.col("toxic").alias("out"))
    assert split_accuracy(labels.filter("doc_id % 2 = 1"), "toxic", got) > 0.97
    assert len(model.cuts) == 3 and (np.diff(model.cuts) > 0).all()


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 6)) < 0.3
    true = np.array([3.0, 2.0, 1.0, 0.0, -1.0, 0.0])
    grade = np.digitize(x @ true + rng.logistic(size=4000), [1.0, 3.0, 5.0])
    row, col = np.nonzero(x)
    weights, cuts = ordinal.fit_ordinal(row, col, grade, 6)
    assert np.abs(weights - true).max() < 0.35 and np.abs(cuts - [1, 3, 5]).max() < 0.35


# ------------------------------------------------------------------ surrogates

def test_surrogates_keep_type_and_coreference(spark):
    text = ("Mr. John Smith (john.smith@mail.example.com, JOHN.SMITH@mail.example.com) and Mrs. Smith called "
            "+1 (377) 555-0271 from 83.229.25.121; card 4497672581733027 or 4497 6725 8173 3027; 1 377-555-0271. "
            "Г-н Иванов, token b44e15e09fd311c3cf3163b66d5a9875b883d8ce, SSN 123-45-6789. Clean words stay.")
    docs = spark.createDataFrame([(1, text), (2, "Dr Smith wrote john.smith@mail.example.com"), (3, "a clean text")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace(docs, b"key").collect()}
    new = got[1].text
    for old in ("John", "Smith", "john.smith", "555-0271", "83.229.25.121", "4497672581733027", "8173 3027",
                "b44e15e09fd311", "123-45-6789", "Иванов"):
        assert old.lower() not in new.lower()
    assert got[3].text == "a clean text" and got[3].n_entities == 0 and new.endswith("Clean words stay.")
    mails = re.findall(r"\S+@[\w.]+", new)
    assert mails[0].strip("(,").lower() == mails[1].strip("),").lower() and mails[1].strip("),").split("@")[0].isupper()
    assert mails[0].strip("(,") in got[2].text
    surname = re.search(r"Mr\. \w+ (\w+)", new)[1]
    assert f"Mrs. {surname}" in new and f"Dr {surname}" in got[2].text
    cards = re.findall(r"card (\d{16}) or ([\d ]{19});", new)[0]
    assert cards[0] == cards[1].replace(" ", "") and surrogates._luhn(cards[0]) == surrogates._luhn("4497672581733027")
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"Г-н [А-Я][а-я]+,", new)
    assert re.search(r"token [0-9a-f]{40},", new)
    assert surrogates.replace(docs, b"key").filter("doc_id = 1").first().text == new
    assert surrogates.replace(docs, b"other").filter("doc_id = 1").first().text != new


def test_clashing_surrogates_are_tried_again(spark, monkeypatch):
    found = spark.createDataFrame([(f"given:m:latin", f"name{i}") for i in range(3000)], "kind string, normal string")
    again = surrogates.retries(found, b"k")
    tries = {r.normal: r.attempt for r in again.collect()}
    new = [surrogates.surrogate(b"k", "given:m:latin", f"name{i}", tries.get(f"name{i}", 0)) for i in range(3000)]
    assert tries and len(set(new)) == 3000


def test_joined_tries_are_the_broadcast_tries(spark, monkeypatch):
    texts = [(i, f"Mr. Abc{chr(97 + i % 26)}{chr(97 + i // 26)} Xyz met Mrs. Lee") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = sorted(map(str, surrogates.replace(docs, b"k").collect()))
    monkeypatch.setattr(surrogates, "BROADCAST_ROWS", -1)
    assert sorted(map(str, surrogates.replace(docs, b"k").collect())) == one


# ------------------------------------------------------------------ WARC

def test_records_read_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = warc.derive(warc.responses(pages))
    warc.write_warc(rows, f"{tmp_path}/out")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    seen, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        head = dict(line.split(": ", 1) for line in raw[at:end].decode().strip().split("\r\n")[1:])
        body = raw[end : end + int(head["Content-Length"])]
        assert head["WARC-Block-Digest"] == warc.digest(body)
        at = end + len(body) + 4
        assert raw[at - 4 : at] == b"\r\n\r\n"
        seen.append((head, body))
    assert len(seen) == 2 * pages.count()
    by_id = {h["WARC-Record-ID"]: h for h, _ in seen}
    assert len(by_id) == len({(r.url, r.html, r.page_id) for r in pages.collect()}) * 2
    payloads = {warc.digest((r.html or "").encode()) for r in pages.collect()}
    for head, body in seen:
        if head["WARC-Type"] == "metadata":
            facts = dict(line.split(": ", 1) for line in body.decode().strip().split("\r\n"))
            assert facts["source-record-id"] == head["WARC-Refers-To"]
            assert by_id[facts["conversion-record-id"]]["WARC-Refers-To"] == head["WARC-Refers-To"]
            assert facts["source-payload-digest"] in payloads and facts["source-status"] == "HTTP/1.1 200 OK"


def test_plain_text():
    page = ("<html lang=de><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x > y --><p class='a>b'>One"
            "<b>Two</b>&nbsp;3<br>4 < 5</p><script>var t='</p>';</script><a href=\"/q?a=1&amp;b=2\">l</a></body>")
    assert warc.plain_text(page) == "OneTwo 3\n4 < 5\nl"
    facts = warc.page_facts(page, "http://h.example/x/")
    assert facts == [("title", "A & B"), ("language", "de"), ("outlink", "http://h.example/q?a=1&b=2")]


# ------------------------------------------------------------------ registered queries

def test_queries_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, (plan, sql) in QUERIES.items():
        if sql is None:
            continue
        got = plan(spark, SF)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted(map(str, (tuple(r) for r in cursor.fetchall())))
        assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == want, name


def test_items_digest(spark):
    rows = QUERIES["op10_fm_decontamination"][0](spark, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.items_sha256 == empty for r in rows} == {True, False}
    assert all(r.contaminated == (r.n_hit > 0) == (r.n_items > 0) for r in rows)
