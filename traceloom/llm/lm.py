"""Scoring whole documents with a gated recurrent language model.

All training tokens are counted. The most frequent words are symbols of the network; every other
word belongs to one of 64 classes by its last letters, has its share of the class by its count, and
a word never seen has the share of half a count. The network learns from every training document, by
one replica per partition whose weights are averaged, then scores every document in one pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from traceloom.llm import gru
from traceloom.llm import words as wd
from traceloom.llm.common import durable

#: Words that are symbols of the network, the end of a text among them.
WORDS = 1024
TAILS = 64
#: Most frequent words whose counts are sent to all tasks; counts of the others are joined.
LISTED = 1 << 18
#: Partitions with fewer tokens than this are put together for one replica.
_REPLICA_TOKENS = 500_000
#: The first quarter of the documents, by a hash, gives the others a common start.
_QUARTERS = 4
#: Tokens that a replica holds at once, and the most and fewest streams they are cut into.
_BLOCK = 1 << 20
_STREAMS = (256, 32)
_WINDOW, _STEPS = 16, 300
#: Replicas that are averaged in one task.
_LEVEL = 16
_END = np.uint64(0xE05D0C5E9B3A1F40)
_CLASS = np.uint64(TAILS - 1)
_KEPT = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id counts as no text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 5 == 1


def _tokens(column: pa.Array):
    """Per chunk: first row, tokens per row, and the words' hashes with END behind every text.

    The low bits of a hash are the class of the word, told from its last two bytes.
    """
    data, offsets = wd.text_buffer(column)
    for first, last in wd.chunks(offsets):
        found = wd.words(data, offsets, first, last, wd.VISIBLE)
        final = wd.LOWER[data[found.end - 1]].astype(np.uint64) if len(found.end) else found.hash
        if len(found.end):
            before = np.where(found.end - found.start > 1, wd.LOWER[data[found.end - 2]], 0)
            ending = wd.mix(final * np.uint64(256) + before.astype(np.uint64)) & _CLASS
        else:
            ending = final
        value = (found.hash & ~_CLASS) | ending
        count = np.bincount(found.doc - first, minlength=last - first)
        out = np.insert(value, np.cumsum(count), _END)
        yield first, count + 1, out


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        keys, sums, held = [], [], 0

        def folded():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(sums)).astype(np.int64)

        def packed(key, total):
            return pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(total)], names=["word", "n"])

        for batch in batches:
            for _, _, value in _tokens(batch.column("text")):
                key, count = np.unique(value, return_counts=True)
                keys.append(key)
                sums.append(count)
                held += len(key)
                if held > 2 * _KEPT:
                    key, total = folded()
                    if len(key) > _KEPT:
                        yield packed(key, total)
                        keys, sums, held = [], [], 0
                    else:
                        keys, sums, held = [key], [total], len(key)
        if keys:
            yield packed(*folded())

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


class Model(NamedTuple):
    weights: dict
    shape: gru.Shape
    words: np.ndarray  # listed words by falling count, END first
    counts: np.ndarray
    tail_log: np.ndarray  # log10 of all counts of a class, smoothed
    total: int
    distinct: int


class _Lookup:
    """Rank of a word in the list, -1 for others: one table probe, and a search for the few left."""

    def __init__(self, listed: np.ndarray):
        self.mask = np.uint64((1 << max(10, int(4 * len(listed)).bit_length())) - 1)
        slot = ((listed >> np.uint64(8)) & self.mask).astype(np.int64)
        self.rank = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.rank[slot[::-1]] = np.arange(len(listed))[::-1]
        self.key = np.where(self.rank >= 0, listed[self.rank], 0)
        missed = np.flatnonzero(self.rank[slot] != np.arange(len(listed)))
        order = np.argsort(listed[missed])
        self.rest, self.rest_rank = listed[missed][order], missed[order]

    def __call__(self, value: np.ndarray) -> np.ndarray:
        slot = ((value >> np.uint64(8)) & self.mask).astype(np.int64)
        out = np.where(self.key[slot] == value, self.rank[slot], -1)
        if len(self.rest):
            again = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.rest, value[again]), len(self.rest) - 1)
            same = self.rest[at] == value[again]
            out[again[same]] = self.rest_rank[at[same]]
        return out


def _symbols(value: np.ndarray, lookup: _Lookup, words: int) -> tuple[np.ndarray, np.ndarray]:
    rank = lookup(value)
    known = (rank >= 0) & (rank < words)
    return np.where(known, rank, words + (value & _CLASS).astype(np.int64)), rank


def _replica(weights: dict, shape: gru.Shape, texts) -> tuple[int, dict]:
    """Symbols learned, and the weights after one pass over all texts, a bounded block at a time.

    Only a replica of fewer symbols than some hundred small steps take makes more passes.
    """
    trainer, held, size, done = None, [], 0, 0

    def learn():
        symbols = np.concatenate(held)
        streams = int(np.clip(len(symbols) // (_WINDOW * _STEPS), _STREAMS[1], _STREAMS[0]))
        trainer.learn(symbols, streams, _WINDOW)
        return len(symbols)

    for text in texts:
        for at in range(0, len(text), _BLOCK):
            held.append(text[at : at + _BLOCK].astype(np.int32))
            size += len(held[-1])
            if size >= _BLOCK:
                trainer = trainer or gru.Trainer(weights, shape)
                done += learn()
                held, size = [], 0
    if trainer is None:
        if not held:
            return 0, weights
        symbols = np.concatenate(held)
        streams = int(np.clip(len(symbols) // (_WINDOW * _STEPS), _STREAMS[1], _STREAMS[0]))
        return len(symbols), gru.fit(weights, shape, symbols, streams, _WINDOW)
    return done + (learn() if held else 0), trainer.p


def _added(batches):
    """One row with the sums of all rows of a task; rows arrive in the order of their parts."""
    part, n, sums = None, 0, 0.0
    for batch in batches:
        for own, size, flat in zip(*(batch.column(c) for c in ("part", "n", "flat")), strict=True):
            part = own.as_py() // _LEVEL if part is None else part
            n += size.as_py()
            sums = sums + np.frombuffer(flat.as_py(), dtype=np.float64)
    if part is not None:
        yield _sum_row(part, n, sums)


def _sum_row(part: int, n: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())],
        names=["part", "n", "flat"])


_SUMS = "part long, n long, flat binary"


def _fitted(docs: DataFrame, start: dict, shape: gru.Shape, listed: np.ndarray, tokens: int) -> dict:
    """Weights after every document was learned, averaged over the replicas by their symbols.

    Replicas are as many as partitions, unless these are small. Sums are taken in levels, so that the
    driver gets ``_LEVEL`` rows at most.
    """
    context = docs.sparkSession.sparkContext
    words = context.broadcast(listed[: shape.words])
    weights = start
    kind = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("fit")),
                  F.lit(_QUARTERS))
    for turn in (kind == 0, kind > 0):
        sent = context.broadcast(weights)

        def run(batches, sent=sent):
            lookup = _Lookup(words.value)
            n, new = _replica(sent.value, shape, (
                _symbols(value, lookup, shape.words)[0]
                for batch in batches for _, _, value in _tokens(batch.column("text"))))
            if n:
                flat = np.concatenate([new[k].reshape(-1) for k in sorted(new)]).astype(np.float64)
                yield _sum_row(TaskContext.get().partitionId(), n, n * flat)

        whole = docs.filter(turn).select("text").coalesce(max(1, tokens // _REPLICA_TOKENS))
        rows = durable(whole.mapInArrow(run, _SUMS))
        top = rows.agg(F.max("part")).first()[0]
        while top is not None and top >= _LEVEL:
            parts = top // _LEVEL + 1
            rows = rows.repartition(parts, F.floor(F.col("part") / _LEVEL)).sortWithinPartitions(
                "part").mapInArrow(_added, _SUMS)
            top //= _LEVEL
        found = sorted(rows.collect(), key=lambda r: r.part)
        if not found:
            continue
        mean = sum(np.frombuffer(r.flat, dtype=np.float64) for r in found) / sum(r.n for r in found)
        at, weights = 0, {}
        for k in sorted(start):
            weights[k] = mean[at : at + start[k].size].reshape(start[k].shape).astype(np.float32)
            at += start[k].size
    return weights


def _most_frequent(counts: DataFrame, most: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """END, then up to ``most`` words by falling count.

    A histogram of count classes, a fixed number of rows, tells from which count on the words are
    few enough, so that only these leave the executors.
    """
    step = F.floor(F.log2("n") * 64)
    left, least = most, 1 << 20
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    end = int(_END.astype(np.int64))
    rows = counts.filter((step >= least) | (F.col("word") == end)).collect()
    rows.sort(key=lambda r: (r.word != end, -r.n, r.word))
    if not rows or rows[0].word != end:
        rows.insert(0, Row(word=end, n=0))
    return (np.array([r.word for r in rows], dtype=np.int64).view(np.uint64),
            np.array([r.n for r in rows], dtype=np.int64))


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """Model from training documents and their token counts.

    The driver sees the listed words (a fixed number), one row per class, and weights.
    """
    whole = counts.groupBy(F.col("word").bitwiseAND(F.lit(TAILS - 1)).alias("kind")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    listed, n = _most_frequent(counts)
    shape = gru.Shape(min(WORDS, len(listed)), TAILS)
    tail_n, tail_words = np.zeros(TAILS), np.zeros(TAILS)
    for r in whole:
        tail_n[r.kind], tail_words[r.kind] = r.n, r.words
    head = (listed[: shape.words] & _CLASS).astype(np.int64)
    tail_n -= np.bincount(head, n[: shape.words], TAILS)
    tail_words -= np.bincount(head, n[: shape.words] > 0, TAILS)
    start = gru.start(shape, np.r_[n[: shape.words], tail_n])
    total = int(sum(r.n for r in whole))
    return Model(_fitted(docs, start, shape, listed, total), shape, listed, n,
                 np.log10(tail_n + 0.5 * (tail_words + 1)), total, int(sum(r.words for r in whole)))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per document row.

    Scores are log10 probabilities of the whole text and its end. A null or empty text is its end
    alone; repeated rows score alike; without training documents every count is 0.
    """
    rows = docs.select("doc_id", "text")
    training = rows.filter(~held_out())
    counts = durable(_counts(training))
    model = train(training, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        lookup, logs = _Lookup(m.words), np.log10(m.counts + 0.5)
        for batch in batches:
            size, parts = np.zeros(batch.num_rows, dtype=np.int64), []
            sums = {k: np.zeros(batch.num_rows) for k in ("base", "tail", "known", "rest")}
            rest = []
            for first, count, value in _tokens(batch.column("text")):
                symbol, rank = _symbols(value, lookup, m.shape.words)
                size[first : first + len(count)] = count
                parts.append(symbol)
                doc = np.repeat(np.arange(first, first + len(count)), count)
                found = rank >= 0
                worth = np.where(found, logs[rank], 0.0)
                tail = symbol >= m.shape.words
                width = batch.num_rows
                sums["base"] += np.bincount(doc, worth, width)
                sums["known"] += np.bincount(doc, found & (m.counts[rank] > 0), width)
                sums["tail"] += np.bincount(doc, np.where(
                    tail, worth - m.tail_log[(value & _CLASS).astype(np.int64)], 0.0), width)
                sums["rest"] += np.bincount(doc, ~found, width)
                rest.append(value[~found])
            model_log = gru.log_likelihood(
                m.weights, m.shape, np.concatenate(parts) if parts else np.zeros(0, np.int64), size)
            at = np.r_[0, np.cumsum(sums["rest"])].astype(np.int32)
            words = np.concatenate(rest) if rest else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(size),
                 pa.array(sums["known"].astype(np.int64)), pa.array(sums["base"]),
                 pa.array(model_log / np.log(10) + sums["tail"]),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(words.view(np.int64)))],
                names=["row", "doc_id", "n_tokens", "known", "base", "own", "rest"])

    kind = (f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, known long, base double, "
            "own double, rest array<long>")
    scored = durable(
        rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
        .mapInArrow(run, kind)
    )
    others = (
        scored.select("row", F.explode("rest").alias("word")).join(counts, "word", "left")
        .groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
                            F.count("n").alias("more_known"))
    )
    size = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rest").join(others, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * size).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )
