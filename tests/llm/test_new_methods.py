"""Whitening, byte-level BPE and the filter audit against plain versions of the same."""

import base64
import hashlib
import itertools
import random
import re
import sys
from unittest import mock

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from traceloom.llm import audit, bpe, charpoly, common, jaccard, whitening
from traceloom.llm.common import may_hold
from traceloom.llm.queries import AUDIT_SQL

from test_methods import brute_components  # noqa: I001

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
NAN, INF = float("nan"), float("inf")


# ---------------------------------------------------------------- whitening


def matrix_of(rows):
    x = np.array(rows, dtype=object)
    return [[int(v) for v in row] for row in x.T.dot(x)]


def test_polynomial_equals_the_one_from_exact_traces():
    for size, seed in ((1, 0), (2, 1), (5, 2), (9, 3)):
        draw = np.random.RandomState(seed).randint(-10**6, 10**6, (size + 2, size))
        matrix = matrix_of(draw.tolist())
        primes = charpoly.primes_beyond(2 * charpoly.coefficient_bound(sum(matrix[k][k] for k in range(size)), size))
        got = charpoly.combine(charpoly.polynomial_residues(matrix, primes), primes)
        # Faddeev and LeVerrier, in whole numbers.
        a, want = np.array(matrix, dtype=object), [1]
        m = np.zeros((size, size), dtype=object)
        for k in range(1, size + 1):
            m = a.dot(m) + want[-1] * np.eye(size, dtype=int).astype(object)
            want.append(-int(np.trace(a.dot(m))) // k)
        assert got == want[::-1]


def test_residues_of_matrices_with_zero_pivots():
    for matrix in ([[0, 0, 1], [0, 0, 0], [1, 0, 0]], [[0] * 4] * 4, [[2, 0, 0], [0, 2, 0], [0, 0, 3]]):
        got = charpoly.polynomial_residues(matrix, [101, 97])
        for row, prime in zip(got.tolist(), (101, 97)):
            assert row == [round(c) % prime for c in np.poly(np.array(matrix))[::-1]]


def test_repeated_and_zero_roots():
    poly = [round(c) for c in np.polynomial.polynomial.polyfromroots([0, 0, 2, 2, 3, 4])]
    found = [charpoly.isolate(poly, place, 20) for place in range(1, 7)]
    assert [(round(float(root), 9), first, last) for root, first, last in found[:4]] == [
        (4, 1, 1), (3, 2, 2), (2, 3, 4), (2, 3, 4)]
    assert found[4:] == [None, None]
    vectors = [charpoly.component([[2, 0, 0], [0, 2, 0], [0, 0, 3]], charpoly.Decimal(2), k, 20) for k in (1, 2)]
    a, b = (np.array([float(v) for v in x]) for x in vectors)
    assert abs(a @ b) < 1e-15 and abs(a @ a - 1) < 1e-15 and abs(a[2]) < 1e-15


def plain_whitening(rows, most=32):
    x = np.floor(64 * np.array(rows, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    keep = [k for k in range(len(values))[::-1] if values[k] > 1e-9 * values[-1]][:most]
    return ((n * x - total) ** 2).sum(axis=1), centred @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def check_whitening(got, rows, idents, most=32):
    far, white, share = plain_whitening(rows, most)
    assert len(got) == len(rows) * len(share)
    table = {(r.vec_id, r.component): r for r in got}
    for k in range(len(share)):
        mine = np.array([table[i, k + 1].whitened for i in idents])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(mine * sign - white[:, k]).max() < 1e-7
        assert abs(table[idents[0], k + 1].explained / share[k] - 1) < 1e-9
    for place, ident in enumerate(idents):
        assert table[ident, 1].deviation == far[place] and table[ident, 1].n == len(rows)
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9


def test_whitening_equals_a_floating_point_eigen_solver(spark):
    rows = (np.random.RandomState(5).randn(300, 40) * np.linspace(0.1, 3, 40)).astype(np.float32)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    check_whitening(whitening.whitened_components(table.repartition(3)).collect(), rows, list(range(300)))


def test_whitening_of_awkward_rows(spark):
    good = [[0.5, 1.0, 2.0], [1.5, -1.0, 2.0], [1.5, -1.0, 2.0], [0.0, 0.25, 2.0]]
    other = [[1.0, 2.0], [3.0, 1.0], [2.0, 2.0]]
    bad = [None, [NAN, 1.0, 1.0], [1.0, INF, 1.0], [None, 1.0, 1.0], [], [1e300, 1.0, 1.0]]
    rows = [(i, v, "own") for i, v in enumerate([*good, *bad, *other])] + [(None, [9.0], "own")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size string").withColumn("n", F.lit("x"))
    got = whitening.whitened_components(table).collect()
    check_whitening([r for r in got if r.vec_id < 4], good, [0, 1, 2, 3])
    check_whitening([r for r in got if r.vec_id >= 10], other, [10, 11, 12])
    assert {r.vec_id for r in got} == {0, 1, 2, 3, 10, 11, 12}
    whole = whitening.whiten(table, whitening.fit(table)).collect()
    assert len(whole) == len(rows) and {r["size"] for r in whole} == {"own"}
    assert whitening.whitened_components(table.limit(0)).collect() == []


def test_whitening_of_large_entries_stays_exact(spark):
    rows = [[2.0**40 + 1, 1.0], [2.0**40 - 3, 5.0], [2.0**40, 2.0]]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = whitening.whitened_components(table).collect()
    x = [[int(64 * v) + 1_000_000 for v in row] for row in rows]
    total = [sum(column) for column in zip(*x)]
    want = [sum((3 * v - s) ** 2 for v, s in zip(row, total)) for row in x]
    assert [r.deviation for r in got if r.component == 1] == want
    assert max(r.identity_error for r in got) < 1e-9


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as file:
        return bpe.Vocabulary(file.read(), PATTERN, bpe.stand_ins(PATTERN))


def ids_of(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_codes_of_drawn_texts(library, own):
    draw = random.Random(3)
    kinds = [(32, 127), (0x80, 0x2000), (0x3000, 0xD000), (0xE000, 0x10FFFF), (9, 14), (0x16EA0, 0x16EB8)]
    for _ in range(1500):
        text = "".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(draw.choice((1, 5, 80))))
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_codes_of_very_long_pieces(library, own):
    draw = random.Random(4)
    for text in ("a" * 70_000, "ab" * 30_000, "".join(draw.choice("abcd") for _ in range(100_000)), " " * 60_000,
                 "é" * 30_000, "x y " * 40_000, "<|endoftext|>" * 3, "it's we'll I'd　"):
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)


def test_codes_of_texts_with_all_kinds_of_white_space(library, own):
    draw = random.Random(8)
    bits = ["word", "it's", "x", "12", "a,b", "?!", " ", " ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "é", "\x1c"]
    for _ in range(4000):
        text = "".join(draw.choices(bits, k=draw.randrange(1, 12)))
        assert ids_of(own.encode(text)) == library.encode_ordinary(text)


def plain_merge(piece, ranks):
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_of_drawn_vocabularies():
    """Also where a longer token has a smaller rank than its parts, which training never gives."""
    draw = random.Random(6)
    for _ in range(300):
        letters = [bytes([c]) for c in b"abc"]
        longer = {b"".join(draw.choices(letters, k=draw.randrange(2, 6))) for _ in range(12)}
        tokens = letters + sorted(longer)
        numbers = draw.sample(range(200), len(tokens))
        own = bpe.Ranks(dict(zip(tokens, numbers)))
        for _ in range(20):
            piece = b"".join(draw.choices(letters, k=draw.randrange(1, 40)))
            want = [own.of[piece]] if piece in own.of else plain_merge(piece, own.of)
            assert bpe.merge(piece, own) == want
        assert not any(own.words)


def test_coded_documents(spark, documents, library):
    got = bpe.decode(bpe.encode(documents, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(got) == documents.count()
    for row in got:
        assert ids_of(row.encoded.ids) == library.encode_ordinary(row.text or "")
        assert row.encoded.n_tokens == len(row.encoded.ids) // 4
        assert bytes(row.decoded) == (row.text or "").encode() and row.n == "own n"
    digests = bpe.digests(documents, RANKS, PATTERN).collect()
    want = sorted((hashlib.sha256((r.text or "").encode()).hexdigest() for r in got))
    assert sorted(r.decoded_sha256 for r in digests) == want
    none = documents.limit(0)
    assert bpe.digests(none, RANKS, PATTERN).collect() == []


def test_digests_take_one_worker_per_task_and_equal_the_two_steps(spark, documents):
    once = bpe.digests(documents, RANKS, PATTERN)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1
    both = bpe.decode(bpe.encode(documents, RANKS, PATTERN), RANKS, PATTERN).select(
        "doc_id", "encoded.n_tokens", F.sha2("encoded.ids", 256), F.sha2("decoded", 256))
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, map(tuple, both.collect())))


def test_workers_send_results_on_before_a_batch_ends(own):
    texts = pa.array([f"{k} " + "word, " * 2000 for k in range(2000)] + [None, ""])
    packed = pa.array([own.encode(t or "") for t in texts.to_pylist()], pa.binary())
    for step, column in (("encode", texts), ("decode", packed), ("round_trip", texts)):
        sent = list(results_of(step, column))
        assert len(sent) > 1 and max(x.nbytes for x in sent) < 2 * bpe.SENT_BYTES
        whole = pa.concat_arrays(sent)
        want = [("" if t is None else t).encode() for t in texts.to_pylist()]
        if step != "decode":
            assert whole.field("ids").to_pylist() == packed.to_pylist()
            assert whole.field("n_tokens").to_pylist() == [len(x) // 4 for x in packed.to_pylist()]
        if step != "encode":
            assert (whole if step == "decode" else whole.field("decoded")).to_pylist() == want


def results_of(step, column):
    """What the operator's worker yields for one batch, run here without Spark."""
    made = {}
    table = mock.MagicMock()
    with open(RANKS, "rb") as file:
        table.sparkSession.sparkContext.broadcast.return_value.value = (file.read(), PATTERN, bpe.stand_ins(PATTERN))
    with mock.patch.object(bpe.F, "arrow_udf", lambda kind: lambda f: made.setdefault("f", f) and mock.MagicMock()), \
            mock.patch.object(bpe.F, "col"):
        getattr(bpe, step)(table, RANKS, PATTERN)
    return made["f"](iter([column]))


def test_kept_pieces_are_bounded_in_bytes():
    """Pieces of scripts with many tokens a letter fill the store before it holds its number of pieces."""
    kept = bpe._Kept(bpe.KEPT, lambda text: bytes(512))
    for k in range(200_000):
        assert kept[f"{k:032d}"] == bytes(512)
    size = sum(sys.getsizeof(a) + sys.getsizeof(b) for part in (kept, kept.older) for a, b in part.items())
    assert size <= 2 * bpe.KEPT_BYTES + 2000


# ---------------------------------------------------------------- filter audit


def plain_audit(docs, labels):
    low = {}
    for ident, text, _ in docs:
        if ident is not None:
            text = text or ""
            low[text] = min(low.get(text, ident), ident)
    rows = []
    for ident, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": ident is not None and ident > low[text],
        }
        own = [x for x in labels if x[0] == ident and ident is not None]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                gone = [r for r in left if r[1][name]]
                before = [r for r in mine if r[1][name] and any(r[1][o] for o in order[:step])]
                alone = [r for r in mine if r[1][name] and sum(r[1].values()) == 1]
                left = [r for r in left if not r[1][name]]
                shapley[name] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), len(before), len(alone), sum(r[2] for r in gone), sum(r[3] for r in gone), name]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]] if isinstance(row[-1], str) else row[-1]
    return out


DOCS = [
    (9, "one", "en"), (5, "one", "fr"), (7, "one", "en"), (5, "one", "en"), (None, "one", "en"), (1, "one", None),
    (3, None, "en"), (2, "", "de"), (4, "A#B", "en"), (6, "same same same same", "en"), (6, "same same same same", "en"),
    (8, " ".join(f"w{i}" for i in range(250)), "en"), (None, None, None), (10, "x " * 300, "fr"),
]
LABELS = [(9, 1, 0), (9, 0, 1), (5, 1, None), (1, None, 1), (None, 1, 1), (8, 1, 1), (4, 0, 1)]


def files_in_turn(spark, tmp_path, files):
    for place, rows in enumerate(files):
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("own"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    return audit.read_stream(spark, f"{tmp_path}/docs", batches=len(files))


def audited(result):
    return {
        (r.part, r.filter_order, r.step): [
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in result.collect()
    }


@pytest.mark.parametrize("salted", [False, True])
def test_audit_takes_back_what_smaller_ids_undo(spark, tmp_path, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = sorted(DOCS, key=lambda r: -(r[0] or 0))
    stream = files_in_turn(spark, tmp_path, [docs[k : k + 3] for k in range(0, len(docs), 3)])
    assert audited(audit.audit(stream, labels)) == plain_audit(DOCS, LABELS)


def test_many_labels_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Labels of a small file were repeated 32 times and then all sent to the driver to be broadcast."""
    labels = [(i, i % 2, i % 3) for i in range(3000)]
    docs = [*DOCS, *[(11, f"text {i % 40}", "en") for i in range(60)], *[(None, f"text {i}", "en") for i in range(60)]]
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(audit, "_HOT_ROWS", 50)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stream = files_in_turn(spark, tmp_path, [docs[::2], docs[1::2]])
    assert audited(audit.audit(stream, table)) == plain_audit(docs, labels)
    table.coalesce(1).write.parquet(f"{tmp_path}/labels")
    named = audit.label_bits(spark.read.parquet(f"{tmp_path}/labels"))
    rows = spark.read.parquet(f"{tmp_path}/docs")
    for joined in (audit.facts(rows, named, few=False), common.attach(rows, named, "doc_id", limit=0)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # Only ids of very many rows are broadcast, here one.
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2 * ("hot" in plan), plan


def test_audit_of_one_file_and_of_nothing(spark, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    stream = files_in_turn(spark, tmp_path, [DOCS])
    assert audited(audit.audit(stream, labels.limit(0))) == plain_audit(DOCS, [])
    empty = files_in_turn(spark, tmp_path / "empty", [[]])
    assert audited(audit.audit(empty, labels)) == {}


def test_audit_sql_says_the_same():
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", DOCS)
    con.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    names = [d[0] for d in con.execute(AUDIT_SQL).description]
    assert names[3:] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {r[:3]: list(r[3:]) for r in con.fetchall()} == plain_audit(DOCS, LABELS)


def test_lines_that_many_texts_hold_chain_no_large_group(spark, monkeypatch):
    """Texts of two fifths common lines are no near copies, and are not all held against each other."""
    pick = random.Random(4)
    lines = [" ".join(f"c{line}x{i}" for i in range(24)) for line in range(20)]
    rows = []
    for doc in range(500):
        own = " ".join(f"d{doc}y{i}" for i in range(70))
        rows.append((doc, " ".join([own, *pick.sample(lines, 2)])))
    rows += [(1000 + doc, rows[doc][1] + " end") for doc in range(0, 40)]
    placed, tiles = [], jaccard._tiles
    monkeypatch.setattr(jaccard, "_tiles", lambda members, percent: (
        placed.append(members.groupBy("comp").count().agg({"count": "max"}).first()[0]), tiles(members, percent))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)
    assert len(set(c for _, c in got.values())) == 500
    assert placed[0] < 100, placed  # one group of over 200 before


def test_near_copies_without_a_broadcast_of_rows(spark, monkeypatch):
    """Beyond the limit of a broadcast, only texts that may be copies are moved, and nothing else changes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.filter("doc_id % 9 = 0")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted(map(str, jaccard.one_per_group(docs, 5, 80).collect()))
    parts = sorted(map(str, jaccard.components(docs).collect()))
    filtered = []

    def spy(df, *args, how="left_semi"):
        out = common.may_hold(df, *args, how=how)
        filtered.append((how, df.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "may_hold", spy)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert sorted(map(str, jaccard.one_per_group(docs, 5, 80).collect())) == want
    assert sorted(map(str, jaccard.components(docs).collect())) == parts
    assert {how for how, _, _ in filtered} == {"left_semi", "left_anti"}
    assert all(out < rows for _, rows, out in filtered)


def test_a_bitmap_passes_every_key_and_few_others(spark):
    table = spark.range(0, 3000, 3).withColumn("b", F.when(F.col("id") % 2 == 0, F.col("id")))
    rows = spark.range(3000).withColumn("b", F.when(F.col("id") % 2 == 0, F.col("id")))
    held = {r[0] for r in may_hold(rows, table, "id", "b").collect()}
    assert held >= set(range(0, 3000, 3)) and len(held) < 1010
    assert {r[0] for r in may_hold(rows, table, "id", "b", how="left_anti").collect()} == set(range(3000)) - held
    assert may_hold(rows, table.limit(0), "id").count() == 0
