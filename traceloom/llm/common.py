"""Helpers shared by the operators of this folder: lineage cuts and checked joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.session import durable

__all__ = ["attach", "durable", "free_name", "may_hold", "pieces", "unit_interval"]

#: Rows up to which a per-key table may be broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
_SALTS = 32
#: Bits of the whole bitmap of :func:`may_hold` (8 MB) and of one of its rows, as powers of two.
_MAP_BITS, _CELL_BITS = 26, 15


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut, without a copy, into runs of few rows, so that a task's arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table has it in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def unit_interval(seed: str, *keys: str) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the keys alone (52 bits of MD5)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def attach(df: DataFrame, table: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of a per-key table, null keys included, where one key may hold most rows.

    ``table`` is counted: up to ``limit`` rows it is broadcast and ``df`` is not moved. Beyond that
    both sides are shuffled on (key, salt) and the small side is repeated once per salt, so that
    the rows of a hot key are spread over many tasks. Spark takes the repeated side for as small as the
    file it comes from, hence the hint that it is not to be broadcast.
    """
    match = df[key].eqNullSafe(table[key])
    if table.count() <= limit:
        return df.join(F.broadcast(table), match, "left").drop(table[key])
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)).cast("int"))
    many = table.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    on = salted[key].eqNullSafe(many[key]) & (F.col("__salt") == F.col("__of"))
    return salted.join(many.hint("merge"), on, "left").drop(many[key]).drop("__salt", "__of")


def may_hold(df: DataFrame, table: DataFrame, *keys: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose keys ``table`` may hold, or with ``left_anti`` those it surely does not.

    The hashed keys of ``table`` are broadcast as a bitmap of fixed size, however many they are, so
    ``df`` is not moved. Rows that share their bit with another key pass too.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << _MAP_BITS))
    cell = F.shiftright(place, _CELL_BITS)
    bit = place.bitwiseAND(F.lit((1 << _CELL_BITS) - 1))
    maps = table.groupBy(cell.alias("__cell")).agg(F.bitmap_construct_agg(bit).alias("__map"))
    byte = F.hex(F.substring("__map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1)))
    held = F.getbit(F.conv(byte, 16, 10).cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1
    return df.join(F.broadcast(maps), (F.col("__cell") == cell) & held, how)
