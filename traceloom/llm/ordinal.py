"""Toxicity as ordered severity: cumulative-link regression on sparse word features.

P(grade >= j) is the logistic of weights times features minus threshold j. All thresholds share the
weights, thresholds rise, and the expected severity is the sum of these probabilities. Features are
the presence of words that go with toxic labels.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import words as wd

#: Labelled documents the model is fitted on (taken by a hash of their ids), and its most features.
FIT_ROWS = 20_000
FEATURES = 4096
#: A word is a feature if at least so many labelled texts hold it and it goes with toxic texts at
#: this z-score or more.
_LEAST_TEXTS = 5
_LEAST_Z = 5.0
#: Distinct feature words of a toxic text from which its grade is 2 and 3.
GRADE_CUTS = (2, 4)
_FILTER = (1 << 20) - 1


class Vocabulary:
    """Numbers of known words, found through a bit table first."""

    def __init__(self, listed: np.ndarray):
        self.words = np.sort(listed)
        self.filter = np.zeros(_FILTER + 1, dtype=bool)
        self.filter[(self.words & np.uint64(_FILTER)).astype(np.int64)] = True

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number), each pair once, in order."""
        data, offsets = wd.text_buffer(column)
        out = [np.zeros(0, dtype=np.int64)]
        size = max(1, len(self.words))
        for first, last in wd.chunks(offsets):
            found = wd.words(data, offsets, first, last, wd.LETTERS)
            maybe = np.flatnonzero(self.filter[(found.hash & np.uint64(_FILTER)).astype(np.int64)])
            if not len(maybe):
                continue
            value = found.hash[maybe]
            at = np.minimum(np.searchsorted(self.words, value), size - 1)
            same = self.words[at] == value
            out.append(np.unique(found.doc[maybe[same]] * size + at[same]))
        pairs = np.concatenate(out)
        return pairs // size, pairs % size


class Model(NamedTuple):
    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # rising thresholds, one per grade above 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """text and label of a bounded sample of labelled documents, equal texts once.

    Of several labels of one document the highest counts; null labels and ids don't count.
    """
    per_doc = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.max(label).alias("__label"))
    sample = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return joined.select("text", F.col("__label").alias("label")).dropDuplicates(["text", "label"])


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, texts, toxic: in how many texts of the sample, and of its toxic ones, each word is."""

    def run(batches):
        for batch in batches:
            data, offsets = wd.text_buffer(batch.column("text"))
            bad = batch.column("label").to_numpy(zero_copy_only=False) > 0
            for first, last in wd.chunks(offsets):
                found = wd.words(data, offsets, first, last, wd.LETTERS)
                word, at = np.unique(found.hash, return_inverse=True)
                pair = np.unique(at * (last - first) + found.doc - first)
                at, doc = pair // (last - first), pair % (last - first) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)),
                     pa.array(np.bincount(at, minlength=len(word)).astype(np.int64)),
                     pa.array(np.bincount(at, bad[doc], len(word)).astype(np.int64))],
                    names=["word", "texts", "toxic"])

    return sample.mapInArrow(run, "word long, texts long, toxic long").groupBy("word").agg(
        F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))


def features(sample: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Words that are in more toxic texts than chance allows, the clearest ``most`` of them."""
    size = sample.agg(F.count(F.lit(1)), F.sum((F.col("label") > 0).cast("long"))).first()
    if not size[0] or not size[1] or size[0] == size[1]:
        return np.zeros(0, dtype=np.uint64)
    share = size[1] / size[0]
    expected = F.col("texts") * share
    z = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share))
    top = _word_counts(sample).filter(F.col("texts") >= _LEAST_TEXTS).withColumn("z", z).filter(
        F.col("z") >= _LEAST_Z).orderBy(F.desc("z"), "word").limit(most).collect()
    return np.array([r.word for r in top], dtype=np.int64).view(np.uint64)


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, width: int,
                penalty: float = 1e-3, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by Adam on the cumulative likelihood, weights pulled to zero.

    ``row`` and ``col`` list the features present; grades are whole numbers from 0.
    """
    top = max(1, int(grade.max()) if len(grade) else 1)
    n = max(1, len(grade))
    above = grade[:, None] >= np.arange(1, top + 1)
    share = above.sum(axis=0) / n
    start = np.log((1 - share + 0.5 / n) / (share + 0.5 / n))
    p = np.r_[np.zeros(width), start[0], np.log(np.maximum(np.diff(start), 0.05))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.r_[p[width], np.exp(p[width + 1 :])])
        eta = np.bincount(row, p[:width][col], len(grade)) if len(row) else np.zeros(len(grade))
        s = 1 / (1 + np.exp(-np.clip(eta[:, None] - np.r_[-np.inf, cuts, np.inf], -40, 40)))
        s[:, 0], s[:, -1] = 1, 0
        rows = np.arange(len(grade))
        upper, lower = s[rows, grade], s[rows, grade + 1]
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        d_upper[grade == 0] = 0
        d_lower[grade == top] = 0
        g_eta = -(d_upper - d_lower) / n
        g_cut = np.zeros(top + 2)
        np.add.at(g_cut, grade, d_upper / n)
        np.add.at(g_cut, grade + 1, -d_lower / n)
        g_cut = g_cut[1:-1]
        g = np.zeros_like(p)
        if len(row):
            g[:width] = np.bincount(col, g_eta[row], width) + penalty * p[:width] / max(1, width) ** 0.5
        tail = np.cumsum(g_cut[::-1])[::-1]
        g[width] = tail[0]
        g[width + 1 :] = tail[1:] * np.exp(p[width + 1 :])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:width], np.cumsum(np.r_[p[width], np.exp(p[width + 1 :])])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", graded: bool = False) -> Model:
    """Model from labelled documents.

    With ``graded`` the label is the grade itself. A label of 0 and 1 is graded by the number of
    distinct feature words: 1, then 2 and 3 from ``GRADE_CUTS`` on. What comes to the driver are the
    feature words and the features of the bounded sample. Without two kinds of labels no word is a
    feature and every document gets the same severity; without any label none is toxic.
    """
    sample = labelled(docs, labels, label).persist()
    words = features(sample)
    shared = sample.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known = Vocabulary(shared.value)
        for batch in batches:
            row, col = known.present(batch.column("text"))
            at = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int64()), pa.ListArray.from_arrays(
                    pa.array(at), pa.array(col.astype(np.int32)))], names=["label", "words"])

    rows = sample.mapInArrow(run, "label long, words array<int>").collect()
    sample.unpersist()
    size = np.array([len(r.words) for r in rows], dtype=np.int64)
    grade = np.maximum(0, np.array([r.label for r in rows], dtype=np.int64))
    if not graded:
        more = sum((size >= cut).astype(np.int64) for cut in GRADE_CUTS)
        grade = np.where(grade > 0, 1 + more, 0)
    row = np.repeat(np.arange(len(rows)), size)
    col = np.array([w for r in rows for w in r.words], dtype=np.int64)
    weights, cuts = fit_ordinal(row, col, grade, len(words))
    return Model(np.sort(words), weights, cuts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), p_toxic and toxic per document row.

    A null or empty text has no feature; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known, m = Vocabulary(shared.value.words), shared.value
        for batch in batches:
            row, col = known.present(batch.column("text"))
            eta = np.bincount(row, m.weights[col] if len(col) else None, batch.num_rows)
            above = 1 / (1 + np.exp(-(eta[:, None] - m.cuts)))
            each = np.c_[np.ones(len(eta)), above] - np.c_[above, np.zeros(len(eta))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(axis=1)),
                 pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]),
                 pa.array(above[:, 0] >= 0.5)],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, grade int, p_toxic double, toxic boolean"
    return docs.select("doc_id", "text").mapInArrow(run, kind)
