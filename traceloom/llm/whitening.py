"""Whitening of embeddings with principal components found by exact algebra.

Vectors become whole numbers, so the scatter matrix is a sum of whole numbers: tasks add up their
rows, and a row per matrix entry and task meets in a sum. Its characteristic polynomial is computed
modulo many primes, a few primes per task, and put together by Chinese remainders; a task per
component isolates its root of the polynomial to many digits and solves for the null space there.
Only what the vectors' length bounds reaches the driver: matrix entries, residues and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import charpoly
from traceloom.llm.common import pieces

SCALE, SHIFT = 64, 1_000_000
MOST = 32
#: Digits of a root; vectors are solved for with twice as many.
DIGITS = 30
_PRIMES_PER_TASK = 32
_LIMB = 60
_EXACT = 1 << 53
_LONG = 1 << 63


class Fit(NamedTuple):
    n: int
    sums: list[int]  # of the scaled entries without the shift
    weights: np.ndarray  # length x components: unit vectors over the roots of their scatter
    vectors: np.ndarray
    explained: list[float]
    eigenvalues: list[float]


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(64 * entry) as long) for every vector length of a column.

    A vector that is null or holds a null, a non-finite entry or one whose whole number does not fit
    into a long, is left out, and so is an empty one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(column.flatten(), float("nan")), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        bad = ~((scaled >= -float(_LONG)) & (scaled < float(_LONG)))
    whole = np.where(bad, 0, scaled).astype(np.int64)
    bad |= whole > _LONG - 1 - SHIFT
    starts = np.r_[0, np.cumsum(lengths)]
    faults = np.r_[0, np.cumsum(bad)]
    fine = (faults[starts[1:]] == faults[starts[:-1]]) & (lengths > 0)
    for length in np.unique(lengths[fine]):
        rows = np.flatnonzero(fine & (lengths == length))
        yield rows, whole[starts[rows][:, None] + np.arange(length)]


def _sums(x: np.ndarray) -> np.ndarray:
    """x.sum(axis=0) exactly, as Python's whole numbers."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    return (x if most * len(x) < _LONG else x.astype(object)).sum(axis=0).astype(object)


def _products(x: np.ndarray) -> np.ndarray:
    """x.T @ x exactly, as Python's whole numbers."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    if most * most * len(x) < _EXACT:
        real = x.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T.dot(x)


def scatter_sums(vectors: DataFrame, column: str) -> DataFrame:
    """(size, i, j, value) of every vector length: counts at (-1, -1), sums at (-1, j), products.

    A value is given as ``high * 2**60 + low``, so that no sum overflows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for some in pieces(iter([batch])):
                for rows, x in whole_vectors(some.column(0)):
                    own = totals.setdefault(x.shape[1], [0, 0, 0])
                    own[0] += len(rows)
                    own[1] = own[1] + _sums(x)
                    own[2] = own[2] + _products(x)
        for size, (n, sums, products) in totals.items():
            i, j = np.triu_indices(size)
            rows = np.r_[-1, np.full(size, -1), i]
            columns = np.r_[-1, np.arange(size), j]
            values = [n, *sums, *products[i, j]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(values), size), pa.int32()),
                    pa.array(rows, pa.int32()),
                    pa.array(columns, pa.int32()),
                    pa.array([Decimal(int(v) >> _LIMB) for v in values], pa.decimal128(38, 0)),
                    pa.array([Decimal(int(v) & (1 << _LIMB) - 1) for v in values], pa.decimal128(38, 0)),
                ],
                names=["size", "i", "j", "high", "low"],
            )

    shape = "size int, i int, j int, high decimal(38,0), low decimal(38,0)"
    return (
        vectors.select(F.col(column).cast("array<double>"))
        .mapInArrow(partial, shape)
        .groupBy("size", "i", "j")
        .agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))
    )


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Whole coefficients of det(x - matrix), lowest power first; a few primes per task."""
    size = len(matrix)
    trace = sum(matrix[k][k] for k in range(size))
    primes = charpoly.primes_beyond(2 * charpoly.coefficient_bound(trace, size))
    shared = spark.sparkContext.broadcast(matrix)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame["id"].to_numpy()
            for part in np.array_split(at, -(-len(at) // _PRIMES_PER_TASK)):
                found = charpoly.polynomial_residues(shared.value, [primes[k] for k in part])
                yield pd.DataFrame({"id": part, "residues": found.tolist()})

    tasks = -(-len(primes) // _PRIMES_PER_TASK)
    rows = spark.range(0, len(primes), 1, tasks).mapInPandas(reduce, "id long, residues array<long>").collect()
    by_prime = {row.id: row.residues for row in rows}
    return charpoly.combine(np.array([by_prime[k] for k in range(len(primes))]), primes)


def components(
    spark: SparkSession, matrix: list[list[int]], most: int = MOST, digits: int = DIGITS
) -> list[tuple[Decimal, list[Decimal]]]:
    """Positive roots of the matrix by falling size, at most ``most``, with unit vectors; a task each."""
    poly = characteristic_polynomial(spark, matrix)
    shared = spark.sparkContext.broadcast((matrix, poly))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, coefficients = shared.value
        for frame in frames:
            for place in frame["id"].tolist():
                found = charpoly.isolate(coefficients, place, digits)
                if found is not None:
                    root, first, _ = found
                    vector = charpoly.component(own, root, place - first + 1, digits)
                    yield pd.DataFrame(
                        {"id": [place], "root": [str(root)], "vector": [[str(v) for v in vector]]}
                    )

    count = min(most, len(matrix))
    rows = spark.range(1, count + 1, 1, count).mapInPandas(solve, "id long, root string, vector array<string>")
    return [
        (Decimal(row.root), [Decimal(v) for v in row.vector])
        for row in sorted(rows.collect(), key=lambda row: row.id)
    ]


def fit(vectors: DataFrame, column: str = "embedding", most: int = MOST) -> dict[int, Fit]:
    """Components of every vector length of a table, over all its vectors of that length."""
    spark = vectors.sparkSession
    entries: dict[int, dict] = {}
    for row in scatter_sums(vectors, column).toLocalIterator():
        entries.setdefault(row.size, {})[row.i, row.j] = (int(row.high) << _LIMB) + int(row.low)
    fits = {}
    for size, sums in sorted(entries.items()):
        n, means = sums[-1, -1], [sums[-1, j] for j in range(size)]
        matrix = [
            [n * sums[min(i, j), max(i, j)] - means[i] * means[j] for j in range(size)] for i in range(size)
        ]
        trace = sum(matrix[k][k] for k in range(size))
        found = components(spark, matrix, most) if trace else []
        with localcontext() as context:
            context.prec = 2 * DIGITS
            weights = [[float(v / root.sqrt()) for v in vector] for root, vector in found]
        fits[size] = Fit(
            n, means, np.array(weights).reshape(len(found), size).T,
            np.array([[float(v) for v in vector] for _, vector in found]).reshape(len(found), size).T,
            [float(root / trace) for root, _ in found], [float(root / n / n) for root, _ in found],
        )
    return fits


def project(x: np.ndarray, of: Fit) -> tuple[list[int | None], np.ndarray]:
    """Squared distances n * x - sums of whole vectors (None beyond a long), and whitened vectors."""
    most = max(abs(int(x.min())), abs(int(x.max())))
    bound = of.n * most + max(map(abs, of.sums))
    if bound < _LONG:
        centred = x * np.int64(of.n) - np.array(of.sums, dtype=np.int64)
    else:
        centred = x.astype(object) * of.n - np.array(of.sums, dtype=object)
    if bound * bound * x.shape[1] < _LONG:
        far = (centred * centred).sum(axis=1).tolist()
    else:
        far = [int(v) for v in (centred.astype(object) ** 2).sum(axis=1)]
        far = [v if v < _LONG else None for v in far]
    return far, centred.astype(np.float64) @ of.weights


def whiten(vectors: DataFrame, fits: dict[int, Fit], column: str = "embedding", into: str = "whitening") -> DataFrame:
    """All rows and columns, and ``into``: struct of size, deviation and whitened (one per component).

    ``into`` is null for a vector that takes no part: one that is null or empty or holds a null, a
    non-finite entry or one beyond a long. Every vector length is whitened by its own fit. Repeated
    rows come out alike, an empty table stays empty, and a column named as ``into`` is replaced. The
    fits are broadcast: length times components numbers each.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    @F.arrow_udf("struct<size: int, deviation: bigint, whitened: array<double>>")
    def projected(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in columns:
            sizes, far, white = ([None] * len(some) for _ in range(3))
            for rows, x in whole_vectors(some):
                if x.shape[1] in shared.value:
                    distances, values = project(x, shared.value[x.shape[1]])
                    for row, distance, value in zip(rows.tolist(), distances, values):
                        sizes[row], far[row], white[row] = x.shape[1], distance, value
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(far, pa.int64()), pa.array(white, pa.list_(pa.float64()))],
                ["size", "deviation", "whitened"], mask=pa.array([s is None for s in sizes]),
            )

    return vectors.withColumn(into, projected(F.col(column).cast("array<double>")))


def identity_errors(whitened: DataFrame, fits: dict[int, Fit], into: str = "whitening") -> dict[int, float]:
    """Per vector length, the largest entry of the whitened vectors' covariance minus the identity.

    Means come first, then products of centred values; tasks add up, one row per entry and task meets.
    """
    rows = whitened.filter(F.size(f"{into}.whitened") > 0).select(f"{into}.size", f"{into}.whitened")

    def sums(centre: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                sizes = np.asarray(batch.column(0))
                for size in np.unique(sizes).tolist():
                    own = batch.column(1).filter(pa.array(sizes == size))
                    values = np.asarray(own.flatten()).reshape(len(own), -1)
                    if centre is None:
                        more = values.sum(axis=0)
                    else:
                        values = values - centre[size]
                        more = (values.T @ values).ravel()
                    totals[size] = totals.get(size, 0) + more
            for size, total in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(total), size), pa.int32()),
                        pa.array(np.arange(len(total)), pa.int32()),
                        pa.array(total, pa.float64()),
                    ],
                    names=["size", "place", "value"],
                )

        found: dict[int, dict] = {}
        added = rows.mapInArrow(partial, "size int, place int, value double")
        for row in added.groupBy("size", "place").agg(F.sum("value").alias("value")).collect():
            found.setdefault(row["size"], {})[row["place"]] = row["value"]
        return {size: np.array([own[k] for k in sorted(own)]) for size, own in found.items()}

    means = {size: total / fits[size].n for size, total in sums(None).items()}
    spreads = sums(means) if means else {}
    errors = {}
    for size, total in spreads.items():
        count = fits[size].weights.shape[1]
        errors[size] = float(np.abs(total.reshape(count, count) / fits[size].n - np.eye(count)).max())
    return errors


def whitened_components(vectors: DataFrame, column: str = "embedding", most: int = MOST) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, error.

    Only vec_id and the vectors are read, so other columns cannot clash. Vectors that take no part
    have no row, nor have vectors of a length whose fit list does not vary.
    """
    spark = vectors.sparkSession
    fits = fit(vectors, column, most)
    rows = whiten(vectors.select("vec_id", column), fits, column).drop(column)
    errors = identity_errors(rows, fits)
    about = [
        (size, k + 1, of.n, share, errors.get(size))
        for size, of in fits.items() for k, share in enumerate(of.explained)
    ]
    table = spark.createDataFrame(
        about, "size int, component int, n long, explained double, identity_error double"
    )
    each = rows.filter("whitening.size IS NOT NULL").select(
        "vec_id", "whitening.size", "whitening.deviation", F.posexplode("whitening.whitened").alias("at", "whitened")
    ).withColumn("component", F.col("at") + 1)
    return each.join(F.broadcast(table), ["size", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
