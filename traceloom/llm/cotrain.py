"""Quality by co-training: two classifiers that see different views label examples for each other.

The text view is the share of hashed character trigrams. The page view is what is known of a page
without reading it: source, language, length and layout. Each round both score the whole table, and
documents of which one view is sure become training examples of the other. In the end both are
calibrated on labelled rows that were kept apart, and their log odds are added.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm import words as wd
from traceloom.llm.common import durable, pieces

#: Labelled documents that the classifiers are fitted on, taken by a hash of their ids.
FIT_ROWS = 10_000
ROUNDS = 3
#: How sure a view must be of a document to label it for the other view.
SURE = 0.95
#: Weight of all pseudo-labels of a view together, in labelled rows; each has weight 1 at most.
TRUST = 1.0
#: Texts that a task sums up at least, so that its sums are small beside them.
_TASK_TEXTS = 8192
#: Newton steps of a round at most; each is one pass over all documents.
STEPS = 5
_TRIGRAMS = 256
_SOURCES, _LANGS = 32, 8
#: Raw counts of a page, in this order.
_COUNTS = ("size", "upper", "digit", "sign", "wide", "line", "space", "words", "repeats")
_PAGE = 2 + len(_COUNTS)
_SHARE_HELD = 5  # one labelled row in five calibrates
#: Bytes and words of average text that every text is mixed with, so that a few words decide little.
_BYTES_ADDED, _WORDS_ADDED = 300, 12


def _text_view(text: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, in steps of 1/255."""
    if len(text) < 3:
        return np.zeros(_TRIGRAMS, dtype=np.uint8)
    text = wd.LOWER[text].astype(np.uint32)
    mixed = (text[:-2] * 0x9E3779B1 + text[1:-1] * 0x85EBCA77 + text[2:] * 0xC2B2AE3D).astype(np.uint32)
    mixed = (mixed ^ (mixed >> 15)) * np.uint32(0x2C1B3C6D)
    share = np.bincount(mixed >> 24, minlength=_TRIGRAMS) / len(mixed)
    return np.minimum(255, np.rint(255 * np.sqrt(share))).astype(np.uint8)


# Byte kinds: 1 upper case, 2 digit, 3 sign, 4 beyond ASCII, 5 line end, 6 other white space.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 4
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KINDS[10], _KINDS[[9, 11, 12, 13, 32]] = 5, 6


def _bucket(value, size: int) -> int:
    raw = b"\0" if value is None else value.encode()
    number = int.from_bytes(raw, "little") % ((1 << 61) - 1)
    return int(wd.mix(np.array([number], dtype=np.uint64))[0] % np.uint64(size))


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch with columns text, source and lang; null counts as empty or unknown.

    The page view is raw: buckets of source and language, then ``_COUNTS``.
    """
    data, offsets = wd.text_buffer(batch.column("text"))
    rows = batch.num_rows
    text, page = np.zeros((rows, _TRIGRAMS), np.uint8), np.zeros((rows, _PAGE), np.float32)
    for place, (name, size) in enumerate((("source", _SOURCES), ("lang", _LANGS))):
        known = {v: _bucket(v, size) for v in set(batch.column(name).to_pylist())}
        page[:, place] = [known[v] for v in batch.column(name).to_pylist()]
    for first, last in wd.chunks(offsets):
        found = wd.words(data, offsets, first, last, wd.VISIBLE)
        again = (found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1])
        page[first:last, 9] = np.bincount(found.doc - first, minlength=last - first)
        page[first:last, 10] = np.bincount(found.doc[1:] - first, again, last - first)
        for row in range(first, last):
            own = data[offsets[row] : offsets[row + 1]]
            text[row] = _text_view(own)
            page[row, 2] = len(own)
            page[row, 3:9] = np.bincount(_KINDS[own], minlength=7)[1:]
    return text, page


class Scale(NamedTuple):
    """Average shares, from the labelled sample, that texts are mixed with."""

    trigrams: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, page: np.ndarray) -> Scale:
        size = page[:, 2].astype(float)
        total = max(1.0, float(size.sum()))
        squares = np.square(text, dtype=np.float32) / 255**2
        return cls(size @ squares / total, page[:, 3:9].sum(axis=0, dtype=float) / total)

    def text_features(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        size = page[:, 2:3].astype(float)
        share = ((text.astype(float) / 255) ** 2 * size + _BYTES_ADDED * self.trigrams) / (size + _BYTES_ADDED)
        repeats = page[:, 10:11] / (page[:, 9:10] + _WORDS_ADDED)
        return np.c_[np.sqrt(share), np.sqrt(repeats)]

    def page_features(self, page: np.ndarray) -> np.ndarray:
        size, lines, words = page[:, 2:3].astype(float), page[:, 7:8], page[:, 9:10]
        share = (page[:, 3:9] + _BYTES_ADDED * self.kinds) / (size + _BYTES_ADDED)
        one = np.zeros((len(page), _SOURCES + _LANGS))
        one[np.arange(len(page)), page[:, 0].astype(int)] = 1
        one[np.arange(len(page)), _SOURCES + page[:, 1].astype(int)] = 1
        return np.c_[one, np.sqrt(share), np.log(size + _BYTES_ADDED), np.log(lines + 3),
                     (size + 6 * _WORDS_ADDED) / (words + _WORDS_ADDED)]


class Linear(NamedTuple):
    """Logistic regression on standardised features, with the slope and shift of its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return self.slope * (z @ self.weights[:-1] + self.weights[-1]) + self.shift


def _curve_slope(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second and first derivative of the log-likelihood of standardised rows, summed over blocks."""
    curve, slope = np.zeros((len(w), len(w))), np.zeros(len(w))
    for at in range(0, len(z), 1024):
        block = np.c_[z[at : at + 1024], np.ones(len(z[at : at + 1024]))]
        p = 1 / (1 + np.exp(-np.clip(block @ w, -30, 30)))
        curve += (block * (p * (1 - p) + 1e-6)[:, None]).T @ block
        slope += block.T @ (y[at : at + 1024] - p)
    return curve, slope


def _moved(w: np.ndarray, curve: np.ndarray, slope: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights after one penalised Newton step, and the largest move."""
    hold = np.full(len(w), penalty)
    hold[-1] = 1e-6
    move = np.linalg.solve(curve + np.diag(hold), slope - hold * w)
    size = float(np.abs(move).max())
    return w + move * min(1.0, 5 / max(1e-9, size)), size


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, mean=0.0, scale=1.0, steps: int = 12) -> np.ndarray:
    """Weights and bias for standardised features."""
    w = np.zeros(x.shape[1] + 1)
    z = (x - mean) / scale
    for _ in range(steps):
        w, size = _moved(w, *_curve_slope(z, y, w), penalty)
        if size < 1e-6:
            break
    return w


_PENALTY = 5.0


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = _PENALTY) -> Linear:
    mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-3
    return Linear(mean, scale, _newton(x, y, penalty, mean, scale))


def calibrated(model: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """Platt scaling on rows the model has not seen; none or one class leaves it as it is."""
    if len(set(y.tolist())) < 2:
        return model
    slope, shift = _newton(model.odds(x)[:, None], y, 1e-3)  # one feature and a bias
    return model._replace(slope=max(1e-3, float(slope)), shift=float(shift))


class Model(NamedTuple):
    text: Linear | None
    page: Linear | None
    prior: float  # log odds of good among labelled rows
    scale: Scale | None = None

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probabilities of good by text, by page and by both views together."""
        if self.text is None:
            even = np.full(len(text), 1 / (1 + np.exp(-self.prior)))
            return even, even, even
        a = self.text.odds(self.scale.text_features(text, page))
        b = self.page.odds(self.scale.page_features(page))
        return tuple(1 / (1 + np.exp(-np.clip(o, -40, 40))) for o in (a, b, a + b - self.prior))


_KIND = "row long, doc_id long, same long, text binary, page binary"


def view_table(docs: DataFrame) -> DataFrame:
    """Both views of every document, about half a kilobyte a row, written once."""

    def run(batches):
        for batch in pieces(batches):
            text, page = views(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("same"),
                 pa.array([t.tobytes() for t in text], pa.binary()),
                 pa.array([p.tobytes() for p in page], pa.binary())],
                names=["row", "doc_id", "same", "text", "page"])

    named = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("same"), "text", "source", "lang")
    return durable(named.mapInArrow(run, _KIND))


def _read(texts, pages) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(texts), np.uint8).reshape(-1, _TRIGRAMS),
            np.frombuffer(b"".join(pages), np.float32).reshape(-1, _PAGE))


def _scored(table: DataFrame, model: Model) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            x = _read(batch.column("text").to_pylist(), batch.column("page").to_pylist())
            p = shared.value.score(*x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("same"),
                 *[pa.array(v) for v in p]],
                names=["row", "doc_id", "same", "p_text", "p_page", "score"])

    kind = "row long, doc_id long, same long, p_text double, p_page double, score double"
    return table.mapInArrow(run, kind)


def _texts_once(table: DataFrame) -> DataFrame:
    """Both views of every different text; of copies with other pages the least page stands."""
    once = durable(table.groupBy("same").agg(F.min(F.struct("page", "text")).alias("v")).select("v.*"))
    return once.coalesce(max(1, -(-once.count() // _TASK_TEXTS)))


def _sums_width(models) -> list[int]:
    return [len(m.weights) for m in models]


def _told_sums(texts: DataFrame, judge: Model, now: tuple[Linear, Linear]) -> list[tuple]:
    """For text and page view: number, curve and slope over all texts that the other view is sure of.

    A task adds up its rows, tasks are added up in a second level, and what reaches the driver are
    sums of fixed size: no text is left out, however many there are.
    """
    shared = texts.sparkSession.sparkContext.broadcast((judge, now))

    def own(batches):
        judge, now = shared.value
        total = [[0.0, np.zeros((n, n)), np.zeros(n)] for n in _sums_width(now)]
        for batch in pieces(batches):
            text, page = _read(batch.column("text").to_pylist(), batch.column("page").to_pylist())
            by_text, by_page, _ = judge.score(text, page)
            features = (judge.scale.text_features(text, page), judge.scale.page_features(page))
            for part, model, x, told in zip(total, now, features, (by_page, by_text), strict=True):
                sure = (told >= SURE) | (told <= 1 - SURE)
                z = (x[sure] - model.mean) / model.scale
                curve, slope = _curve_slope(z, (told[sure] >= SURE).astype(float), model.weights)
                part[0] += float(sure.sum())
                part[1] += curve
                part[2] += slope
        flat = np.concatenate([np.r_[n, c[np.triu_indices(len(c))], s] for n, c, s in total])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["sums"])

    def added(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                one = np.frombuffer(raw)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = texts.mapInArrow(own, "sums binary").repartition(8).mapInArrow(added, "sums binary").collect()
    shared.unpersist()
    out, at = [], 0
    flat = sum((np.frombuffer(bytes(r.sums)) for r in rows), np.zeros(1))
    for n in _sums_width(now):
        half = n * (n + 1) // 2
        if len(flat) == 1:  # no partition, no sums
            out.append((0.0, np.zeros((n, n)), np.zeros(n)))
            continue
        upper = np.zeros((n, n))
        upper[np.triu_indices(n)] = flat[at + 1 : at + 1 + half]
        curve = upper + upper.T - np.diag(np.diag(upper))
        out.append((flat[at], curve, flat[at + 1 + half : at + 1 + half + n]))
        at += 1 + half + n
    return out


def _taught(texts: DataFrame, model: Model, sample: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Both views fitted to the labelled rows and to what the other view of ``model`` is sure of."""
    now = (model.text, model.page)
    for _ in range(STEPS):
        moves, after = [], []
        for one, (x, y), (n, curve, slope) in zip(now, sample, _told_sums(texts, model, now), strict=True):
            share = min(1.0, TRUST * len(y) / max(1.0, n))
            own_curve, own_slope = _curve_slope((x - one.mean) / one.scale, y, one.weights)
            w, size = _moved(one.weights, own_curve + share * curve, own_slope + share * slope, _PENALTY)
            # Rounded, so that sums added in another order after a lost executor end alike.
            after.append(one._replace(weights=np.round(w, 9)))
            moves.append(size)
        now = tuple(after)
        if max(moves) < 1e-3:
            break
    return model._replace(text=now[0], page=now[1])


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, label: str = "quality",
          table: DataFrame | None = None) -> Model:
    """Model from labelled documents and, by co-training, from all documents.

    In every round each view is fitted again to the labelled sample and to all documents of which
    the other view is sure, equal texts once; the pseudo-labels together weigh as much as ``TRUST``
    times the sample, so the fit is alike at every size. The driver holds the bounded labelled sample,
    one row per labelled id (of several with one id the least text hash), and sums of fixed size.
    Null labels don't count, of several labels of a document the lowest does. Without labels every
    score is 0.5; with labels of one class only, all documents score alike.
    """
    table = view_table(docs) if table is None else table
    per_doc = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.min(label).alias("label"))
    sample = durable(per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = (
        table.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
        .agg(F.min(F.struct("same", "page", "text")).alias("v"))
        .select("v.*", "label").orderBy("same", "page", "label").collect()
    )
    if not rows:
        return Model(None, None, 0.0)
    text, page = _read([r.text for r in rows], [r.page for r in rows])
    y = np.array([float(r.label > 0) for r in rows])
    held = np.array([r.same % _SHARE_HELD == 0 for r in rows])
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(set(y[~held].tolist())) < 2:
        return Model(None, None, prior)
    scale = Scale.of(text, page)
    cuts = range(0, len(text), 1024)
    own = [
        np.concatenate([scale.text_features(text[i : i + 1024], page[i : i + 1024]) for i in cuts]),
        scale.page_features(page)]

    def settled(model: Model) -> Model:
        plain = [one._replace(slope=1.0, shift=0.0) for one in (model.text, model.page)]
        a, b = (calibrated(one, x[held], y[held]) for one, x in zip(plain, own, strict=True))
        return model._replace(text=a, page=b)

    model = settled(Model(*[fit_linear(x[~held], y[~held]) for x in own], prior, scale))
    if rounds:
        texts = _texts_once(table)
        for _ in range(rounds):
            model = settled(_taught(texts, model, [(x[~held], y[~held]) for x in own]))
    return model


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, label: str = "quality") -> DataFrame:
    """doc_id, p_text, p_page, score and good (score of 0.5 or more) per document row.

    Empty and null texts are scored by their page view and the bias; repeated rows score alike.
    """
    table = view_table(docs)
    model = train(docs, labels, rounds, label, table)
    return _scored(table, model).select(
        "doc_id", "p_text", "p_page", "score", (F.col("score") >= 0.5).alias("good"))


def kept(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, label: str = "quality") -> DataFrame:
    """Documents with a score of 0.5 or more, with their own columns; texts are not moved.

    Null and empty texts are scored by their page view and the bias, repeated rows alike; columns of
    any name are carried along untouched, an empty table gives no rows. Without labels all stay.
    """
    model = train(docs, labels, rounds, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            good = shared.value.score(*views(batch))[2] >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
