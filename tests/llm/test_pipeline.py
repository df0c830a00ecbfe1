"""The pipeline, stage by stage, against brute force over what each stage was given."""

import collections
import re

import corpus_pipeline
from traceloom.llm import cotrain, mixing

from test_methods import brute_components, lowered  # noqa: I001

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lowered(text))


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, docs.collect(), {}
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if place < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        after.write.parquet(f"{tmp_path}/{place}")
        given, docs = docs, spark.read.parquet(f"{tmp_path}/{place}")
        seen[name] = (given, before, docs.collect())
        before = seen[name][2]

    given, before, after = seen["quality by co-training"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in cotrain.score(given, labels).collect() if r.good}
    assert {r.doc_id for r in after} == good and len(after) < len(before)

    _, before, after = seen["n-gram Jaccard join"]
    groups = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (n, c) in groups.items() if i == c or not n)
    assert {r.doc_id: r for r in after} == {r.doc_id: r for r in before if groups[r.doc_id][1] == r.doc_id}

    _, before, after = seen["benchmark decontamination"]
    phrases = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(item.text)
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(p) for p in phrases}

    def left(text):
        w = words(text)
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit[i : i + n] = [True] * n
        return [x for x, h in zip(w, hit, strict=True) if not h], any(hit)

    old, changed = {r.doc_id: r for r in before}, 0
    assert len(after) == len(before)
    for r in after:
        want, cut = left(old[r.doc_id].text)
        assert words(r.text) == want
        changed += cut
        assert cut or r == old[r.doc_id]
    assert changed

    given, before, after = seen["source mixing"]
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(given).collect()}
    assert collections.Counter(r.doc_id for r in after) == {i: n for i, n in plan.items() if n}
    assert set(after) <= set(before)

    _, before, after = seen["sharding"]
    assert sorted(map(str, (r.doc_id for r in after))) == sorted(map(str, (r.doc_id for r in before)))
    assert {r.shard for r in after} <= set(range(16)) and len({r.shard for r in after}) > 8
    for shard in range(15):
        low = [r.curve for r in after if r.shard <= shard]
        high = [r.curve for r in after if r.shard > shard]
        assert not low or not high or max(low) <= min(high)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "curve", "shard"} == set(out.columns)
    assert out.count() > 0
