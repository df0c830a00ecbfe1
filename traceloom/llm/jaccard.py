"""Exact similarity join of word n-gram sets and its connected components.

Candidates come from a prefix filter with rare shingles first: two sets that are similar enough
share one of the few rarest shingles of each. Candidate groups are ordered by set size and cut into
tiles of neighbouring size bands. Inside a pair of tiles every set has a hashed bitmap; the bits in
which two bitmaps differ bound the overlap from above, and only what passes is intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm import words as wd
from traceloom.llm.common import BROADCAST_ROWS, durable, may_hold, pieces
from traceloom.llm.components import connected

SIZE = 4
PERCENT = 85
#: Shingles whose hash has this many zero bits in front are counted over the whole corpus.
_RARE_BITS = 2
#: The same for the sets that are left by then: half of their shingles are counted.
_LEFT_BITS = 1
_SAME_TEXT = "xxhash64(text)"
#: Work of one tile: shingles plus a share per set.
_TILE = 1 << 18
_TILE_SET = 256


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text, empty ones too."""
    data, offsets = wd.text_buffer(column)
    for first, last in wd.chunks(offsets):
        doc, value = wd.shingles(wd.words(data, offsets, first, last, wd.VISIBLE), size)
        bound = np.searchsorted(doc, np.arange(first, last + 1))
        for row in range(first, last):
            own = np.sort(value[bound[row - first] : bound[row - first + 1]])
            yield row, own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own


def _set_key(own: np.ndarray) -> int:
    """64-bit name of a set: equal sets, equal names."""
    both = np.array([wd.mix(own + np.uint64(0x51)).sum(), len(own)], dtype=np.uint64)
    return int(wd.mix(wd.mix(both[:1]) + both[1:])[0].astype(np.int64))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def set_table(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, same, n, key per document row; n is 0 and key null without words. Written once.

    ``same`` is a hash of the text, by which texts are found again: it does not depend on how the
    rows are dealt out.
    """

    def run(batches):
        for batch in pieces(batches):
            found = [(len(own), _set_key(own) if len(own) else None)
                     for _, own in _sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"),
                 pa.array([n for n, _ in found], pa.int64()),
                 pa.array([k for _, k in found], pa.int64())],
                names=["doc_id", "same", "n", "key"],
            )

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, same long, n long, key long"
    return durable(docs.select("doc_id", F.expr(_SAME_TEXT).alias("same"), "text").mapInArrow(run, kind))


def _entries(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """hash, key, packed sizes: the counted shingles of every distinct set, and a few more where
    they don't fill its prefix. A set is written once per task."""
    most = np.uint64((1 << (64 - bits)) - 1)

    def run(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            hashes, keys, packed = [], [], []
            for _, own in _sets(batch.column("text"), size):
                if not len(own) or (key := _set_key(own)) in seen:
                    continue
                seen.add(key)
                counted = int(np.searchsorted(own, most, side="right"))
                own_n, keep = len(own), max(counted, min(len(own), _prefix(len(own), percent)))
                hashes.append(own[:keep])
                keys.append(np.full(keep, key, dtype=np.int64))
                packed.append(np.full(keep, (own_n << 32) | counted, dtype=np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(keys)),
                     pa.array(np.concatenate(packed))],
                    names=["hash", "key", "packed"],
                )

    return docs.select("text").mapInArrow(run, "hash long, key long, packed long")


def _tile_keys(docs: DataFrame, size: int, percent: int, bits: int = _RARE_BITS) -> DataFrame:
    """hash, key, n: prefix shingles that at least two distinct sets hold.

    Counted are shingles whose hash has ``bits`` zero bits in front. Order of shingles: counted ones by
    the number of sets, then by hash, then all others by hash. A set whose prefix is all its own has no
    similar set and drops out here.
    """
    same = Window.partitionBy("hash")
    shared = (
        _entries(docs, size, percent, bits)
        .withColumns({"low": F.min("key").over(same), "high": F.max("key").over(same),
                      "held": F.count(F.lit(1)).over(same)})
        .filter("low < high")
        .select("hash", "key", "packed", "held")
    )
    # As signed numbers, the counted hashes lie between 0 and 2**(64 - bits).
    other = ~F.col("hash").between(0, (1 << (64 - bits)) - 1) if bits else F.lit(False)
    listed = shared.groupBy("key", "packed").agg(
        F.array_sort(F.collect_set(F.struct(
            other.alias("other"), F.when(other, 0).otherwise(F.col("held")).alias("held"), "hash",
        ))).alias("list")
    )
    n, counted = F.shiftright("packed", 32), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1))
    prefix = n - F.ceil(n * percent / F.lit(100)) + 1
    own = counted - F.size(F.filter("list", lambda x: ~x["other"]))
    keep = F.greatest(F.lit(0).cast("long"), prefix - own).cast("int")
    return listed.select(
        "key", n.alias("n"), F.explode(F.slice("list", F.lit(1), keep)["hash"]).alias("hash")
    )


def _candidates(keys: DataFrame, percent: int) -> DataFrame:
    """Chains of neighbours by size inside every shared shingle: similar sets hang together.

    The rows of a shingle are sorted narrow rows of which a task holds two at a time.
    """
    near = Window.partitionBy("hash").orderBy("n", "key")
    after = F.lead(F.struct("n", "key")).over(near)
    chained = keys.withColumn("after", after).filter(
        (F.col("after.key") != F.col("key")) & (F.col("n") * 100 >= F.col("after.n") * percent)
    )
    return chained.select(F.col("key").alias("a"), F.col("after.key").alias("b")).distinct()


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """key, comp, tile, tiles: a set's tile in size order and all pairs of tiles it has to meet in."""
    order = Window.partitionBy("comp").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") + _TILE_SET).over(order), F.lit(0))
    placed = durable(members.withColumn("tile", F.floor(before / _TILE).cast("int")))
    spans = placed.groupBy("comp", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = spans.alias("a"), spans.alias("b")
    met = a.join(b, (F.col("a.comp") == F.col("b.comp")) & (F.col("a.tile") <= F.col("b.tile"))
                 & (F.col("a.most") * 100 >= F.col("b.least") * percent))
    pairs = durable(met.select(F.col("a.comp").alias("comp"), F.col("a.tile").alias("low"),
                               F.col("b.tile").alias("high")))
    sides = pairs.select("comp", "low", "high", F.explode(
        F.array_distinct(F.array("low", "high"))).alias("tile"))
    return placed.join(sides, ["comp", "tile"])


def _linker(percent: int):
    """Compares the sets of each tile pair; rows arrive ordered by (comp, low, high)."""

    def run(batches):
        held: list = []
        seen: set = set()
        pair = None
        out: list[tuple[int, int]] = []
        for batch in pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("comp", "low", "high", "tile", "key", "own")]
            for comp, low, high, tile, key, own in zip(*columns, strict=True):
                if (comp, low, high) != pair:
                    out += _links(held, pair, percent)
                    held, seen, pair = [], set(), (comp, low, high)
                if key not in seen:
                    seen.add(key)
                    held.append((tile, key, np.frombuffer(own, dtype=np.uint64)))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        out += _links(held, pair, percent)
        yield _edges(out)

    return run


def _edges(out):
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())],
        names=["a", "b"],
    )


def _links(held: list, pair, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets of a tile pair as all links do; sets already joined are not redone."""
    if len(held) < 2:
        return []
    held.sort(key=lambda x: (x[0], len(x[2]), x[1]))
    size = np.array([len(own) for _, _, own in held], dtype=np.int64)
    bits = 1 << max(6, int(2 * size.max() - 1).bit_length())
    maps = np.zeros((len(held), bits // 64), dtype=np.uint64)
    for row, (_, _, own) in enumerate(held):
        flags = np.zeros(bits, dtype=bool)
        flags[((own >> np.uint64(11)) & np.uint64(bits - 1)).astype(np.int64)] = True
        maps[row] = np.packbits(flags).view(np.uint64)
    first = sum(tile == pair[1] for tile, _, _ in held) if pair[1] != pair[2] else 0
    parent = np.arange(len(held))
    group: dict[int, list[int]] = {i: [i] for i in range(len(held))}
    out = []
    # Of two different tiles the first is held against the second, one tile against itself.
    for i in range(first or len(held)):
        js = np.arange(first or i + 1, len(held))
        js = js[parent[js] != parent[i]]
        total = size[i] + size[js]
        need = -(-percent * total // (100 + percent))
        small = np.minimum(size[i], size[js])
        js, need = js[small >= need], need[small >= need]
        if not len(js):
            continue
        apart = np.bitwise_count(maps[js] ^ maps[i]).sum(axis=1, dtype=np.int64)
        may = (size[i] + size[js] - apart) // 2 >= need
        for j, least in zip(js[may].tolist(), need[may].tolist(), strict=True):
            if parent[j] == parent[i]:
                continue
            if len(np.intersect1d(held[i][2], held[j][2], assume_unique=True)) >= least:
                out.append((held[i][1], held[j][1]))
                x, y = int(parent[i]), int(parent[j])
                if len(group[x]) < len(group[y]):
                    x, y = y, x
                parent[group[y]] = x
                group[x] += group.pop(y)
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """same, text of the wanted texts, not moved. Where they are many, a few others come with them."""
    texts = docs.select(F.expr(_SAME_TEXT).alias("same"), "text")
    if wanted.count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(wanted), "same", "left_semi")
    return may_hold(texts, wanted, "same")


def links(docs: DataFrame, sets: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(a, b) between set keys, with the components of all links of at least ``percent``."""
    # A set is rare enough to drop out where its own shingles fill the prefix. Lines that many texts hold
    # leave some sets a few short of it, and those would chain all their like into one group; counted once
    # more, among the sets that are left, nearly all of them drop out.
    chained = _candidates(_tile_keys(docs, size, percent), percent)
    left = chained.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    first = sets.filter("n > 0").groupBy("key").agg(F.min("same").alias("same"), F.first("n").alias("n"))
    some = _texts(docs, durable(left.join(first, "key").select("same")))
    groups = connected(_candidates(_tile_keys(some, size, percent, _LEFT_BITS), percent)).select(
        F.col("node").alias("key"), F.col("root").alias("comp"))
    members = durable(groups.join(first, "key"))

    def run(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            fresh = [i for i, x in enumerate(batch.column("same").to_pylist()) if not (x in seen or seen.add(x))]
            texts = batch.column("text").take(pa.array(fresh, pa.int64()))
            own = [o for _, o in _sets(texts, size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(o) for o in own], pa.int64()),
                 pa.array([o.tobytes() for o in own], pa.binary())], names=["key", "own"])

    # Copies of a text are read once per task; the comparison drops what comes from several tasks.
    arrays = _texts(docs, members.select("same")).mapInArrow(run, "key long, own binary")
    tiles = _tiles(members.drop("same"), percent)
    met = tiles.join(arrays, "key").select("comp", "low", "high", "tile", "key", "own")
    pairs = met.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    return pairs.mapInArrow(_linker(percent), "a long, b long")


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, same, n_shingles, component_id and group for every document row.

    component_id is the smallest doc_id that links reach. Two documents link when their sets of
    ``size``-word shingles have a Jaccard similarity of ``percent`` or more; a text of fewer words is
    one shingle; null and empty texts have none and stay alone; equal sets are joined once and never
    paired; rows with a null doc_id take part and never give the id unless nothing else is there.
    """
    sets = set_table(docs, size)
    roots = connected(links(docs, sets, size, percent))
    named = (
        sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_key = named.select("key", "root").join(least, "root")
    return (
        sets.join(per_key, "key", "left")
        .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "same", F.col("n").alias("n_shingles"), "component_id",
                F.when(F.col("n") > 0, F.col("root")).alias("group"))
    )


def one_per_group(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Documents without those that have an earlier member (by doc_id, then text hash) in their group.

    Documents without words are groups of their own and stay, repeated rows of others go.
    """
    found = durable(components(docs, size, percent).filter("group is not null"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "same")
    first = found.groupBy("group").agg(F.min(order).alias("first"))
    marked = found.join(first, "group").withColumn("kept", order == F.col("first"))
    gone = durable(marked.filter(~F.col("kept")).select("doc_id", "same").distinct())
    again = durable(
        marked.filter("kept").groupBy("doc_id", "same").count().filter("count > 1").select("doc_id", "same"))
    whole = docs.select(F.struct("*").alias("__doc"), F.col("doc_id"), F.expr(_SAME_TEXT).alias("same"))

    left = _without(whole, gone)
    if again.isEmpty():
        return left.select("__doc.*")
    once = _match(_maybe(left, again), again, "left_semi").groupBy("doc_id", "same").agg(
        F.first("__doc").alias("__doc"))
    return _without(left, again).select("__doc.*").union(once.select("__doc.*"))


def _few(rows: DataFrame) -> bool:
    return rows.count() <= BROADCAST_ROWS


def _maybe(whole: DataFrame, rows: DataFrame) -> DataFrame:
    return whole if _few(rows) else may_hold(whole, rows, "doc_id", "same")


def _match(whole: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join on document and text; few rows are broadcast."""
    rows = F.broadcast(rows) if _few(rows) else rows
    return whole.join(rows, whole["doc_id"].eqNullSafe(rows["doc_id"]) & (whole["same"] == rows["same"]), how)


def _without(whole: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents that are not among the rows. Where those are many, only what may be one is shuffled."""
    left = _match(_maybe(whole, rows), rows, "left_anti")
    return left if _few(rows) else left.union(may_hold(whole, rows, "doc_id", "same", how="left_anti"))
