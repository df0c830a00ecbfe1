"""Benchmark decontamination with an FM-index per training shard.

A shard is one batch of documents. Words that no benchmark phrase holds cannot be part of a match,
so they become breaks, and runs too short for any phrase are left out; what remains is indexed:
suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions
sampled every few words. All phrases are searched backwards at once by ranks, occurrences are
located from the samples, and their word ranges are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm import words as wd
from traceloom.llm.common import free_name

WINDOW = 10
#: Benchmark words searched in one pass; a larger benchmark is searched slice by slice.
SLICE_WORDS = 1_000_000
_SAMPLE = 8
_FILTER = (1 << 20) - 1

SPANS = "array<struct<first_word:int,end_word:int,first_byte:long,end_byte:long>>"


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions in suffix order; a break (0) differs from every other break."""
    n = len(symbols)
    breaks = np.flatnonzero(symbols == 0)
    first = symbols.astype(np.int64) + len(breaks)
    first[breaks] = np.arange(len(breaks))
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.r_[head[1:], True]
    open_ = order[~alone]
    step = 1
    while len(open_):
        key = rank[open_] * (n + 2) + rank[np.minimum(open_ + step, n)] + 1
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = rank[open_]
        spot = np.arange(len(open_))
        new = np.r_[True, key[1:] != key[:-1]]
        outer = np.r_[True, group[1:] != group[:-1]]
        start = np.maximum.accumulate(np.where(new, spot, 0))
        base = np.maximum.accumulate(np.where(outer, spot, 0))
        rank[open_] = group + start - base
        open_ = open_[~(new & np.r_[new[1:], True])]
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class WaveletMatrix:
    """Rank and access on a sequence of small integers, one bit vector per bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        row = symbols
        for bit in self.bits:
            one = ((row >> bit) & 1).astype(bool)
            ones = np.zeros(len(row) + 1, dtype=np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((one, ones, len(row) - int(ones[-1])))
            row = np.concatenate([row[~one], row[one]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(upto), upto
        for bit, (_, ones, zeros) in zip(self.bits, self.levels, strict=True):
            set_ = (symbol >> bit) & 1 == 1
            low = np.where(set_, zeros + ones[low], low - ones[low])
            high = np.where(set_, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for one, ones, zeros in self.levels:
            set_ = one[at]
            symbol = symbol * 2 + set_
            at = np.where(set_, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Count and locate phrases in a sequence of word numbers from 1, with 0 for breaks."""

    def __init__(self, symbols: np.ndarray, sample: int = _SAMPLE):
        symbols = np.r_[0, symbols, 0].astype(np.int64)
        order = suffix_array(symbols)
        self.top = int(symbols.max())
        self.bwt = WaveletMatrix(symbols[order - 1], self.top)
        counts = np.bincount(symbols, minlength=self.top + 2)
        self.before = np.r_[0, np.cumsum(counts)]
        # Positions at regular distances and behind every break, so that no walk crosses one.
        keep = (order % sample == 0) | (symbols[order - 1] == 0) | (symbols[order] == 0)
        self.kept = np.r_[0, np.cumsum(keep)].astype(np.int32)
        self.marked = keep
        self.samples = order[keep]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (right-aligned word numbers), found from the last word to the first."""
        last = phrases[:, -1]
        known = last <= self.top
        low = np.where(known, self.before[np.minimum(last, self.top)], 0)
        high = np.where(known, self.before[np.minimum(last, self.top) + 1], 0)
        for step in range(2, phrases.shape[1] + 1):
            live = np.flatnonzero((length >= step) & (low < high))
            if not len(live):
                continue
            symbol = phrases[live, -step]
            inside = symbol <= self.top
            high[live[~inside]] = low[live[~inside]]
            live, symbol = live[inside], symbol[inside]
            start = self.before[symbol]
            low[live] = start + self.bwt.rank(symbol, low[live])
            high[live] = start + self.bwt.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of every row, by steps back to a sampled position."""
        at = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.marked[at])
        while len(walking):
            here = at[walking]
            symbol = self.bwt.access(here)
            at[walking] = self.before[symbol] + self.bwt.rank(symbol, here)
            steps[walking] += 1
            walking = walking[~self.marked[at[walking]]]
        return self.samples[self.kept[at]] + steps - 1  # the text stands behind a leading break


class Phrases:
    """Windows of benchmark items as word numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        data, offsets = wd.text_buffer(pa.array([text for _, text in items], pa.string()))
        found = [wd.words(data, offsets, a, b, wd.LETTERS) for a, b in wd.chunks(offsets)]
        doc = np.concatenate([f.doc for f in found] or [np.zeros(0, dtype=np.int64)])
        value = np.concatenate([f.hash for f in found] or [np.zeros(0, dtype=np.uint64)])
        self.vocabulary = np.unique(value)
        number = np.searchsorted(self.vocabulary, value) + 1
        self.filter = np.zeros(_FILTER + 1, dtype=bool)
        self.filter[(self.vocabulary & np.uint64(_FILTER)).astype(np.int64)] = True
        holders: dict[tuple, set] = {}
        bounds = np.searchsorted(doc, np.arange(len(items) + 1))
        for row, (item, _) in enumerate(items):
            own = number[bounds[row] : bounds[row + 1]].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                holders.setdefault(tuple(own[at : at + window]), set()).add(item)
        self.windows = np.zeros((len(holders), window), dtype=np.int64)
        self.length = np.zeros(len(holders), dtype=np.int64)
        self.items = [sorted(x for x in names if x is not None) for names in holders.values()]
        for row, numbers in enumerate(holders):
            self.windows[row, window - len(numbers) :] = numbers
            self.length[row] = len(numbers)
        self.least = int(self.length.min()) if len(holders) else 0

    def numbers(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), dtype=np.int64)
        if not len(self.vocabulary):
            return out
        maybe = np.flatnonzero(self.filter[(value & np.uint64(_FILTER)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, value[maybe])
        at[at == len(self.vocabulary)] = 0
        out[maybe] = np.where(self.vocabulary[at] == value[maybe], at + 1, 0)
        return out


def scan(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
    """Words of every text of a shard, merged spans and held items of those with a match."""
    data, offsets = wd.text_buffer(column)
    n_words = np.zeros(len(column), dtype=np.int64)
    runs = []
    for a, b in wd.chunks(offsets):
        found = wd.words(data, offsets, a, b, wd.LETTERS)
        first = np.searchsorted(found.doc, np.arange(a, b + 1))
        n_words[a:b] = np.diff(first)
        if not len(phrases.windows):
            continue
        number = phrases.numbers(found.hash)
        known = number > 0
        begins = known & np.r_[True, ~known[:-1] | (found.doc[1:] != found.doc[:-1])]
        start = np.flatnonzero(begins)
        if not len(start):
            continue
        ends = known & np.r_[~known[1:] | (found.doc[1:] != found.doc[:-1]), True]
        size = np.flatnonzero(ends) + 1 - start
        keep = size >= phrases.least
        start, size = start[keep], size[keep]
        if not len(start):
            continue
        # Every run is followed by a break.
        spot = np.repeat(start - np.r_[0, np.cumsum(size + 1)[:-1]], size + 1)
        spot = spot + np.arange(len(spot))
        stop = np.cumsum(size + 1) - 1
        symbol = number[np.minimum(spot, len(number) - 1)]
        symbol[stop] = 0
        spot[stop] -= 1
        word = spot - first[found.doc[spot] - a]
        starts = found.start[spot] - offsets[found.doc[spot]]
        ends_at = found.end[spot] - offsets[found.doc[spot]]
        runs.append((symbol, found.doc[spot], word, starts, ends_at))
    if not runs:
        return n_words, {}, {}
    symbol, doc, word, start, end = (np.concatenate(x) for x in zip(*runs, strict=True))
    index = FMIndex(symbol)
    low, high = index.search(phrases.windows, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(which)) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
    place = index.locate(rows)
    cover = np.zeros(len(symbol) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + phrases.length[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(hit & np.r_[True, ~hit[:-1]])
    stop = np.flatnonzero(hit & np.r_[~hit[1:], True])
    spans: dict[int, list] = {}
    for a, b in zip(edge.tolist(), stop.tolist(), strict=True):
        spans.setdefault(int(doc[a]), []).append(
            (int(word[a]), int(word[b]) + 1, int(start[a]), int(end[b]))
        )
    items: dict[int, set] = {}
    for d, w in np.unique(np.stack([doc[place], which], axis=1), axis=0).tolist():
        items.setdefault(d, set()).update(phrases.items[w])
    return n_words, spans, items


_FIELDS = ("first_word", "end_word", "first_byte", "end_byte")


def _slices(benchmark: DataFrame, limit: int) -> Iterator[list]:
    """The benchmark in parts of bounded words; one part unless it is very large."""
    size = F.coalesce(F.sum(F.char_length("text")), F.lit(0))
    parts = max(1, -(-int(benchmark.agg(size).first()[0]) // (4 * limit)))
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    for part in range(parts):
        chosen = F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part
        yield [tuple(row) for row in named.filter(chosen).collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         limit: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, spans and item ids of matching windows, one row per document row.

    A null or empty text has no words; an item without words is no phrase; an item with a null id
    marks words but is not named; equal items count once; repeated document rows stay apart; with an
    empty benchmark nothing matches.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, __row long, n_words long, spans {SPANS}, items array<string>"
    found = []
    for part in _slices(benchmark, limit):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        found.append(rows.mapInArrow(_finder(shared, window), kind))
    if len(found) == 1:
        return found[0].drop("__row")
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    per_doc = union.groupBy("__row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return per_doc.withColumn("spans", merged("spans")).drop("__row")


def merged(spans: str):
    """Sorted word spans with overlapping and touching ones joined."""
    return F.expr(
        f"""aggregate({spans}, cast(array() as {SPANS}), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).end_word >= x.first_word,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct(
             'first_word', element_at(acc, -1).first_word,
             'end_word', greatest(element_at(acc, -1).end_word, x.end_word),
             'first_byte', element_at(acc, -1).first_byte,
             'end_byte', greatest(element_at(acc, -1).end_byte, x.end_byte)))),
           concat(acc, array(x))))"""
    )


def _finder(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for batch in batches:
            n_words, spans, items = scan(batch.column("text"), phrases)
            rows = range(batch.num_rows)
            cut = [[dict(zip(_FIELDS, s, strict=True)) for s in spans.get(i, ())] for i in rows]
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()),
                                       ("first_byte", pa.int64()), ("end_byte", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__row"), pa.array(n_words, pa.int64()),
                 pa.array(cut, kind),
                 pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string()))],
                names=["doc_id", "__row", "n_words", "spans", "items"],
            )

    return run


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            limit: int = SLICE_WORDS) -> DataFrame:
    """Documents with all removal spans cut out of their texts; other columns and texts as they were.

    Every slice of the benchmark is searched in the whole text, and texts are cut once, at the merged
    spans. ``n_chars``, where there is one, follows the text of cut documents. Null and empty texts
    hold no span, repeated rows are cut alike, columns of any name are carried along; without
    documents or without a benchmark nothing changes.
    """
    out, last = docs, None
    name = free_name(docs, "__marks")  # spans found so far, four numbers each
    marked = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    for part in _slices(benchmark, limit):
        if last is not None:
            out = out.mapInArrow(_marker(last, window, name), marked)
        last = docs.sparkSession.sparkContext.broadcast(part)
    return out.mapInArrow(_cutter(last, window, name), docs.schema)


def _marks(batch: pa.RecordBatch, phrases: Phrases, name: str) -> dict[int, list]:
    """Spans of these phrases and those of earlier slices, by row."""
    _, spans, _ = scan(batch.column("text"), phrases)
    if name in batch.schema.names:
        for row, marks in enumerate(batch.column(name).to_pylist()):
            if marks:
                spans.setdefault(row, []).extend(zip(*[iter(marks)] * 4, strict=True))
    return spans


def _marker(shared, window: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for batch in batches:
            spans = _marks(batch, phrases, name)
            marks = [[n for span in spans.get(row, ()) for n in span] for row in range(batch.num_rows)]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name}
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(marks, pa.list_(pa.int64()))], names=[*columns, name])

    return run


def _cutter(shared, window: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for batch in batches:
            spans = _marks(batch, phrases, name)
            if name in batch.schema.names:
                batch = batch.drop_columns([name])
            if not spans:
                yield batch
                continue
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            chars = batch.schema.get_field_index("n_chars")
            sizes = batch.column(chars).to_pylist() if chars >= 0 else None
            for row, cuts in spans.items():
                raw, kept, from_, upto = texts[row].encode(), [], 0, -1
                for first, end_word, start, end in sorted(cuts):
                    if first > upto:  # touching spans go with what is between them
                        kept.append(raw[from_:start])
                    from_, upto = max(from_, end), max(upto, end_word)
                texts[row] = b"".join([*kept, raw[from_:]]).decode()
                if sizes is not None:
                    sizes[row] = len(texts[row])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[chars] = pa.array(sizes, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run
