"""Nearest neighbours by inner product over learned partitions.

A sample's neighbour graph is cut into balanced parts by repeated halving, and a small network learns
from it in which parts the neighbours of a vector lie. Every vector is stored in its most probable
part, a query visits its most probable parts, and what it finds there is ranked by exact products.
How many parts a query visits is set by recall against brute force on sample vectors kept apart.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import attach, durable

#: About so many vectors, taken by a hash of the vector, fit the partition and the network.
FIT_ROWS = 8192
#: Vectors per part that are aimed at, and the most parts the sample can teach.
_PART_ROWS = 2048
_MOST_PARTS = 256
_GRAPH = 10
_HIDDEN = 64
RECALL = 0.96
#: Rows of a stored block and of a block of queries that meet in one task.
_BLOCK, _QUERY_BLOCK = 8192, 2048


class Router(NamedTuple):
    """Two layers with a softmax over parts, and how many parts to visit."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def nearest(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest products with each query row of ``x``, itself left out."""
    out = np.empty((len(queries), min(k, len(x) - 1)), dtype=np.int64)
    for at in range(0, len(queries), 512):
        rows = queries[at : at + 512]
        products = x[rows] @ x.T
        products[np.arange(len(rows)), rows] = -np.inf
        part = np.argpartition(-products, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        order = np.argsort(-np.take_along_axis(products, part, axis=1), axis=1)
        out[at : at + 512] = np.take_along_axis(part, order, axis=1)
    return out


def _halves(rows: np.ndarray, graph: np.ndarray, x: np.ndarray, turns: int = 12) -> np.ndarray:
    """True for half of ``rows``: a cut along the widest direction, then swaps that keep edges whole."""
    local = np.full(len(graph), -1)
    local[rows] = np.arange(len(rows))
    near = local[graph[rows]]
    inside = near >= 0
    source = np.repeat(np.arange(len(rows)), near.shape[1])[inside.ravel()]
    target = near.ravel()[inside.ravel()]
    centred = x[rows] - x[rows].mean(axis=0)
    direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    side = np.zeros(len(rows), dtype=bool)
    side[np.argsort(centred @ direction, kind="stable")[len(rows) // 2 :]] = True
    for turn in range(turns):
        sign = np.where(side, 1.0, -1.0)
        pull = np.bincount(source, sign[target], len(rows)) + np.bincount(target, sign[source], len(rows))
        gain = -sign * pull  # above 0: more neighbours on the other side
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left = left[np.argsort(-gain[left], kind="stable")]
        right = right[np.argsort(-gain[right], kind="stable")]
        pairs = min(len(left), len(right))
        good = gain[left[:pairs]] + gain[right[:pairs]] > 0
        move = max(0, int(good.sum()) // (1 if turn % 2 else 2))
        if not move:
            break
        side[left[:move]], side[right[:move]] = True, False
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of every row; parts is a power of two and sizes differ by a few rows at most."""
    out = np.zeros(len(x), dtype=np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        split = []
        for rows in groups:
            side = _halves(rows, graph, x) if len(rows) > 1 else np.zeros(len(rows), dtype=bool)
            split += [rows[~side], rows[side]]
        groups = split
    for number, rows in enumerate(groups):
        out[rows] = number
    return out


def _train(x: np.ndarray, target: np.ndarray, seed: int = 7, passes: int = 40, rate: float = 3e-3):
    rng = np.random.default_rng(seed)
    p = [rng.standard_normal((x.shape[1], _HIDDEN)) * (2 / x.shape[1]) ** 0.5, np.zeros(_HIDDEN),
         rng.standard_normal((_HIDDEN, target.shape[1])) * 0.1, np.zeros(target.shape[1])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            hidden = np.maximum(x[rows] @ p[0] + p[1], 0)
            logits = hidden @ p[2] + p[3]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = (prob / prob.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ p[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return p


def fit(x: np.ndarray, rows: int, k: int) -> Router:
    """Router for ``rows`` distinct vectors from a sample ``x`` of them."""
    parts = 1
    while parts < _MOST_PARTS and (parts < 8 or parts * _PART_ROWS < rows) and parts * 32 <= len(x):
        parts *= 2
    if parts == 1:
        zero = np.zeros((x.shape[1], 1))
        return Router(zero, np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = nearest(x, np.arange(len(x)), _GRAPH)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    around = np.c_[np.arange(len(x)), graph]
    np.add.at(target, (np.repeat(np.arange(len(x)), around.shape[1]), part[around].ravel()), 1 / around.shape[1])
    held = np.arange(len(x)) % 8 == 0
    router = Router(*_train(x[~held], target[~held]), 1)
    # Neighbours of the whole table are nearer than those of the sample: judge by as many as count.
    odds = router.odds(x)
    home, asked = odds.argmax(axis=1), np.flatnonzero(held)[:1024]
    true = nearest(x, asked, max(3, -(-k * len(x) // max(rows, 1))))
    visited = np.argsort(np.argsort(-odds[asked], axis=1), axis=1)
    depth = np.take_along_axis(visited, home[true], axis=1)
    share = np.array([(depth < n).mean() for n in range(1, parts + 1)])
    return router._replace(probes=int(np.argmax(share >= RECALL)) + 1 if (share >= RECALL).any() else parts)


def distinct_vectors(table: DataFrame, id_col: str, vector: str, every: int, most: int) -> DataFrame:
    """vector (float64 bytes), ids (its ``most`` smallest), asked (whether a query holds it).

    Copies are folded where they are read: a task passes on at most ``most`` ids of a vector. Null,
    empty and zero vectors and those with null or non-finite components take no part, nor do ids that
    are null.
    """

    def run(batches):
        kept: dict[bytes, list] = {}
        asked: set[bytes] = set()
        for batch in batches:
            for own, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or not values or None in values:
                    continue
                x = np.array(values, dtype=np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                key = (x + 0.0).tobytes()
                ids = kept.setdefault(key, [])
                ids.append(own)
                if len(ids) > 4 * most:
                    ids.sort()
                    del ids[most:]
                if own % every == 0:
                    asked.add(key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.binary()),
             pa.array([sorted(ids)[:most] for ids in kept.values()], pa.list_(pa.int64())),
             pa.array([key in asked for key in kept], pa.bool_())], names=["vector", "ids", "asked"])

    rows = table.select(F.col(id_col).cast("long"), vector).mapInArrow(
        run, "vector binary, ids array<long>, asked boolean")
    return durable(rows.groupBy("vector").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"),
        F.bool_or("asked").alias("asked")))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _routed(vectors: DataFrame, shared, probes: int, extra: str) -> DataFrame:
    """Each vector once per visited part, with the columns it came with."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            odds = shared.value.odds(_matrix(batch.column("vector")))
            part = np.argsort(-odds, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32).ravel()),
                 *[c.take(pa.array(np.repeat(np.arange(batch.num_rows), part.shape[1]))) for c in batch.columns]],
                names=["part", *batch.schema.names])

    return vectors.mapInArrow(run, f"part int, {extra}")


def _ranker(k: int):
    """Nearest stored vectors of every query of a block pair, in one row per query; ``own`` marks copies of it."""

    def run(key, queries: pa.Table, stored: pa.Table) -> pa.Table:
        q, v = _matrix(queries.column("vector").combine_chunks()), _matrix(stored.column("vector").combine_chunks())
        ids = stored.column("ids").to_pylist()
        place = {raw: j for j, raw in enumerate(stored.column("vector").to_pylist())}
        own = [place.get(raw, -1) for raw in queries.column("vector").to_pylist()]
        found = []
        if len(v):
            for at in range(0, len(q), 256):
                products = q[at : at + 256] @ v.T
                width = min(k, len(v))
                best = np.argpartition(-products, width - 1, axis=1)[:, :width]
                least = np.take_along_axis(products, best, axis=1).min(axis=1)
                for row, floor in enumerate(least):
                    at_least = np.flatnonzero(products[row] >= floor)  # with all that tie
                    pairs = sorted((-float(products[row, j]), i, bool(j == own[at + row]))
                                   for j in at_least for i in ids[j])[:k]
                    found.append([{"score": -s, "vec_id": i, "own": o} for s, i, o in pairs])
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("own", pa.bool_())]))
        vectors = queries.column("vector").combine_chunks() if len(v) else pa.array([], pa.binary())
        return pa.table([vectors, pa.array(found, kind)], names=["vector", "found"])

    return run


_FOUND = "array<struct<score:double,vec_id:long,own:boolean>>"


def _best(found, k: int):
    """The k best of lists of (score, vec_id): high scores first, then small ids."""
    flat = F.flatten(F.collect_list(found))
    order = F.array_sort(flat, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                         .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    return F.slice(order, 1, k)


def _nearest(found: DataFrame, rows: int, k: int) -> DataFrame:
    """The k + 1 best of every asked vector among ``rows`` distinct vectors of one length."""
    spark = found.sparkSession
    share = F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, FIT_ROWS / rows))
    sample = found.filter(share).select("vector").orderBy("vector").collect()
    x = np.frombuffer(b"".join(bytes(r.vector) for r in sample), dtype=np.float64).reshape(len(sample), -1)
    shared = spark.sparkContext.broadcast(fit(x, rows, k))
    stored = durable(_routed(found.select("vector", "ids"), shared, 1, "vector binary, ids array<long>"))
    asked = _routed(found.filter("asked").select("vector"), shared, shared.value.probes, "vector binary")
    size = F.count(F.lit(1))
    blocks = {r.part: max(1, -(-r.n // _BLOCK)) for r in stored.groupBy("part").agg(size.alias("n")).collect()}
    turns = max(1, -(-found.filter("asked").count() // _QUERY_BLOCK))
    count = F.get(F.lit([blocks.get(i, 1) for i in range(max(blocks) + 1)]), F.col("part"))
    count = F.coalesce(count, F.lit(1))
    base = stored.withColumn("block", F.pmod(F.xxhash64("vector"), count).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asks = asked.withColumn("turn", F.pmod(F.xxhash64("vector", F.lit("turn")), F.lit(turns)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    grid = ["part", "block", "turn"]
    hits = asks.groupBy(*grid).cogroup(base.groupBy(*grid)).applyInArrow(
        _ranker(k + 1), f"vector binary, found {_FOUND}")
    per_part = hits.groupBy("vector", F.pmod(F.spark_partition_id(), F.lit(16)).alias("of")).agg(
        _best("found", k + 1).alias("found"))
    return durable(per_part.groupBy("vector").agg(_best("found", k + 1).alias("found")))


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides.

    Equal vectors are stored and asked once with their k + 1 smallest ids, which is all that a
    ranking with ties to smaller ids can use; a repeated query row gives its rows again, with the
    other rows of its id among the candidates. Vectors of every length are searched on their own,
    as no product joins two lengths. A part that holds many vectors is cut into blocks, and so are
    its queries, so a task holds one block of each. An empty table gives no rows.
    """
    found = distinct_vectors(table, id_col, vector, every, k + 1)
    size = F.octet_length("vector")
    sizes = found.groupBy(size.alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("asked").alias("asked")).orderBy("size").collect()
    best = None
    for one in sizes:
        if one["asked"]:
            part = _nearest(found.filter(size == one["size"]), one["n"], k)
            best = part if best is None else best.union(part)
    if best is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def own_vectors(batches):
        for batch in batches:
            pairs = [(i, (np.array(v, dtype=np.float64) + 0.0).tobytes())
                     for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                     if v and None not in v]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.binary())],
                names=["query_id", "vector"])

    named = table.select(F.col(id_col).cast("long").alias("query_id"), vector).filter(
        F.col("query_id") % every == 0).mapInArrow(own_vectors, "query_id long, vector binary")
    joined = attach(named, best, "vector", limit=20_000).filter("found is not null")
    # Only the query's own row goes, once: other rows with its id are candidates like any other.
    itself = F.array_position(
        F.transform("found", lambda f: f["own"] & (f["vec_id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("found", lambda f, i: i + 1 != itself), 1, k)
    return joined.select("query_id", F.posexplode(others).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"))
