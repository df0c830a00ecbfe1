"""Sharding along a Hilbert curve over quantised metadata, with DataFrame functions alone.

Every dimension is cut at its own quantiles, the cells become one curve index, rows are ordered by
it, and the order is cut into runs. Rows that are near in all dimensions share a run, so the minima
and maxima that Parquet keeps per file let a reader skip most files for a filter on any dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import durable, with_row_index

BITS = 4


def _curve_table(dims: int) -> list[int]:
    """Steps of the curve: entry (state, cell) holds next state and rank of the cell.

    A state is an entry corner and an axis. A cell is read in the frame of the state (xor with the
    corner, rotation by the axis), its rank is its place in the Gray code, and the next state is the
    frame of the sub-cube at that rank.
    """
    side, mask = 1 << dims, (1 << dims) - 1

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & mask

    gray = [i ^ (i >> 1) for i in range(side)]
    rank = {g: i for i, g in enumerate(gray)}
    corner = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(side)]

    def axis(i: int) -> int:
        if i == 0:
            return 0
        i = i - 1 if i % 2 == 0 else i
        return ((i ^ (i + 1)).bit_length() - 1) % dims

    steps = []
    for state in range(side * dims):
        entry, turn = divmod(state, dims)
        for cell in range(side):
            place = rank[rotate(cell ^ entry, turn + 1)]
            after = entry ^ rotate(corner[place], -(turn + 1))
            steps.append((after * dims + (turn + axis(place) + 1) % dims) * side + place)
    return steps


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of integer cells in [0, 2**bits)."""
    dims = len(cells)
    side = 1 << dims
    steps = F.lit(_curve_table(dims))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def descend(acc: Column, level: Column) -> Column:
        cell = sum(
            (F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * F.lit(1 << i)
             for i, c in enumerate(cells)),
            F.lit(0),
        )
        step = F.get(steps, acc["state"] * side + cell)
        return F.struct(
            F.shiftright(step, dims).alias("state"),
            (acc["index"] * side + step.bitwiseAND(F.lit(side - 1))).cast("long").alias("index"),
        )

    levels = F.lit(list(range(bits - 1, -1, -1)))
    return F.aggregate(levels, start, descend)["index"]


def _text_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """The values at which the running row share of the ordered distinct values passes i / cells.

    Rows are counted per value first, so a value that many rows hold is one row. The values are cut
    into ranges; a value's running count is that of the ranges before plus the values before in its
    own range, and only ``cells`` - 1 values come back.
    """
    counts = durable(
        df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange("value").withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition: bounded by the partition count, not by the data.
    ranges = counts.groupBy("part").agg(F.sum("n").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.join(F.broadcast(ranges), "part").select(
        "value", (F.col("first") + F.sum("n").over(inside)).alias("upto"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    row = reached.agg(*[
        F.min(F.when(F.col("upto") * cells > F.lit(total * i), F.col("value"))) for i in range(1, cells)
    ]).first()
    return [cut for cut in row if cut is not None]


def cell_cuts(df: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, list]:
    """Ascending cuts of every dimension, at most 2**bits - 1, whatever the size of the table.

    Numbers are cut at approximate quantiles over all rows; texts at exact ones, compared as whole
    values in byte order.
    """
    kinds = dict(df.dtypes)
    cells = 1 << bits
    numbers = [d for d in dims if kinds[d] != "string"]
    shares = [i / cells for i in range(1, cells)]
    near = df.agg(F.count(F.lit(1)), *[
        F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(f"cuts_{d}") for d in numbers]).first()
    return {d: list(near[f"cuts_{d}"] or []) if d in numbers else _text_cuts(df, d, cells) for d in dims}


def with_cells(df: DataFrame, dims: list[str], bits: int = BITS, cuts: dict[str, list] | None = None) -> DataFrame:
    """Add ``<dim>_cell`` for every dimension and ``curve``; a null falls into cell 0.

    Tables that must agree row by row take the same ``cuts``.
    """
    cuts = cell_cuts(df, dims, bits) if cuts is None else cuts
    kinds = dict(df.dtypes)
    value = {d: F.col(d) if kinds[d] == "string" else F.col(d).cast("double") for d in dims}
    cell = {
        d: sum(
            (F.coalesce((value[d] >= F.lit(cut)).cast("int"), F.lit(0)) for cut in cuts[d]),
            F.lit(0),
        )
        for d in dims
    }
    out = df.withColumns({f"{d}_cell": cell[d] for d in dims})
    return out.withColumn("curve", curve_index([F.col(f"{d}_cell") for d in dims], bits))


def shard_rows(
    df: DataFrame, dims: list[str], tie: list[str], shards: int = 16, bits: int = BITS,
    cuts: dict[str, list] | None = None,
) -> DataFrame:
    """Add ``curve``, ``shard`` and ``slot``: runs of the curve whose row counts differ by one at most.

    Rows of one curve index are ordered by ``tie``, so a cell that holds a third of the table is cut
    like any other stretch; sorting ranges, not groups, are what tasks hold. ``df`` should be
    narrow: it is sorted and checkpointed once. Repeated rows get slots of their own, nulls sort
    first, an empty table gives an empty result.
    """
    placed = with_row_index(with_cells(df, dims, bits, cuts), "curve", *tie, name="__row")
    total = placed.count()
    shard = F.expr(f"(__row * {shards}) div {max(total, 1)}").cast("int")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard).withColumn("slot", F.col("__row") - first).drop("__row")
    )


def cut_points(placed: DataFrame, tie: list[str]) -> list[tuple]:
    """First (curve, tie) of every shard but the first: one small row per shard."""
    starts = placed.filter("slot = 0 and shard > 0").orderBy("shard")
    return [tuple(row) for row in starts.select("curve", *tie).collect()]


def shard_of(points: list[tuple], tie: list[str]) -> Column:
    """Shard of a row from cut points alone, so that wide rows need no sort or join to get it."""
    names = ["curve", *tie]

    def reached(point: tuple) -> Column:
        least = F.lit(True)
        for name, value in reversed(list(zip(names, point, strict=True))):
            if value is None:
                least = F.col(name).isNotNull() | least
            else:
                above = F.coalesce(F.col(name) > F.lit(value), F.lit(False))
                least = above | (F.coalesce(F.col(name) == F.lit(value), F.lit(False)) & least)
        return least

    return sum((reached(p).cast("int") for p in points), F.lit(0))


def zone_map(placed: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and least and greatest value of every dimension per shard, for pruning files."""
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its files in curve order."""
    placed.repartitionByRange("shard", "curve").sortWithinPartitions("shard", "curve").write.mode(
        "overwrite"
    ).partitionBy("shard").parquet(path)


DOCUMENT_DIMS = ["source", "lang", "size", "doc_id"]
_TIE = ["text_crc32", "doc_id"]


def document_metadata(docs: DataFrame, *more: str) -> DataFrame:
    """The narrow rows that are sorted: dimensions, size and checksum, never the text."""
    text = F.col("text")
    return docs.select(
        *more, "doc_id", "source", "lang",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot and curve index of every document, copies of a text side by side in a cell.

    A null text has size 1 and no checksum; null doc_id, source or lang count as the lowest cell.
    """
    return shard_rows(document_metadata(docs), DOCUMENT_DIMS, _TIE, shards)


def with_document_shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Whole documents with ``curve`` and ``shard``, cut where :func:`shard_documents` cuts.

    Both read the same quantiles. Copies that agree in all ordering columns stay in one shard, so row
    counts may differ by the copies at a cut. Nulls fall into the lowest cells, an empty table gives
    no rows. Columns of these two names that the
    documents already have are replaced; all others are carried along untouched.
    """
    metadata = document_metadata(docs)
    cuts = cell_cuts(metadata, DOCUMENT_DIMS)
    points = cut_points(shard_rows(metadata, DOCUMENT_DIMS, _TIE, shards, cuts=cuts), _TIE)
    rest = [c for c in docs.columns if c.lower() not in ("curve", "shard")]
    whole = docs.withColumn("__doc", F.struct(*rest))
    cells = with_cells(document_metadata(whole, "__doc"), DOCUMENT_DIMS, cuts=cuts)
    return cells.withColumn("shard", shard_of(points, _TIE)).select("__doc.*", "curve", "shard")
