"""A gated recurrent network over word symbols with a class-factored softmax, in numpy.

Symbols are frequent words, in classes of neighbours by frequency, and classes of all other words.
The probability of a symbol is that of its class times that of the word within the class. Texts run
through the network in streams; the state is carried from window to window and starts at zero behind
every end of text, so a text's log-likelihood never depends on the text before it.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

WIDTH = 16
END = 0
_MEMBERS = 64


class Shape(NamedTuple):
    words: int  # symbols 0..words-1 are frequent words, 0 is the end of a text
    tails: int  # symbols words..words+tails-1 are classes of the other words

    @property
    def groups(self) -> int:
        return -(-self.words // _MEMBERS)

    @property
    def classes(self) -> int:
        return self.groups + self.tails

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.words, symbol // _MEMBERS, symbol - self.words + self.groups)


def start(shape: Shape, counts: np.ndarray, seed: int = 0, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Small random weights; the biases give every symbol its share of ``counts``."""
    rng = np.random.default_rng(seed)

    def small(*size):
        return (rng.standard_normal(size) * 0.1).astype(np.float32)

    share = np.log(np.maximum(counts, 0.5))
    members = np.full((shape.groups, _MEMBERS), -30.0, dtype=np.float32)
    members.reshape(-1)[: shape.words] = share[: shape.words]
    sums = np.bincount(shape.class_of(np.arange(len(counts))), np.exp(share), shape.classes)
    return {
        "embed": small(shape.words + shape.tails, 3 * width), "gate": small(width, 2 * width),
        "turn": small(width, width), "bias": np.zeros(3 * width, dtype=np.float32),
        "class_w": small(width, shape.classes) * 0, "class_b": np.log(sums).astype(np.float32),
        "word_w": np.zeros((shape.groups, width, _MEMBERS), dtype=np.float32), "word_b": members,
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _step(p: dict, h: np.ndarray, symbol: np.ndarray):
    width = h.shape[1]
    given = p["embed"][symbol] + p["bias"]
    gates = _sigmoid(given[:, : 2 * width] + h @ p["gate"])
    keep, open_ = gates[:, :width], gates[:, width:]
    turned = h @ p["turn"]
    new = np.tanh(given[:, 2 * width :] + open_ * turned)
    return new + keep * (h - new), keep, open_, turned, new


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of one column per row; all columns' exponentials, in place of x, and their sums."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    return own - np.log(total[:, 0]), x, total


def _output(p: dict, shape: Shape, h: np.ndarray, symbol: np.ndarray, grads: dict | None = None):
    """Log probability of each symbol after each state; with ``grads``, the states' gradients too."""
    kind = shape.class_of(symbol)
    out, d, total = _softmax(h @ p["class_w"] + p["class_b"], kind)
    back = None
    if grads is not None:
        d /= total * len(symbol)
        d[np.arange(len(symbol)), kind] -= 1 / len(symbol)
        grads["class_w"] += h.T @ d
        grads["class_b"] += d.sum(axis=0)
        back = d @ p["class_w"].T
    order = np.argsort(kind.astype(np.int16), kind="stable")
    edge = np.searchsorted(kind[order], np.arange(shape.groups + 1))
    for group in range(shape.groups):
        at = order[edge[group] : edge[group + 1]]
        if not len(at):
            continue
        member = symbol[at] % _MEMBERS
        given = h[at]
        own, d, total = _softmax(given @ p["word_w"][group] + p["word_b"][group], member)
        out[at] += own
        if grads is not None:
            d /= total * len(symbol)
            d[np.arange(len(at)), member] -= 1 / len(symbol)
            grads["word_w"][group] += given.T @ d
            grads["word_b"][group] += d.sum(axis=0)
            back[at] += d @ p["word_w"][group].T
    return out, back


class Trainer:
    """Truncated backpropagation with Adam steps; ``learn`` may be called block after block."""

    def __init__(self, p: dict, shape: Shape, rate: float = 0.01):
        self.p, self.shape, self.rate = {k: v.copy() for k, v in p.items()}, shape, rate
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}
        self.done = 0

    def learn(self, symbols: np.ndarray, streams: int, window: int) -> None:
        """One pass over texts, each closed by END, cut into near equal streams; no symbol is left out.

        Gradients stop at the window's start, the state goes on.
        """
        if not len(symbols):
            return
        p, shape, width = self.p, self.shape, self.p["turn"].shape[0]
        streams = max(1, min(streams, len(symbols) // (2 * window)))
        length = -(-len(symbols) // streams)
        x = np.full(streams * length, END, dtype=symbols.dtype)
        x[: len(symbols)] = symbols
        real = (np.arange(len(x)) < len(symbols)).reshape(streams, length)
        x = x.reshape(streams, length)
        h = np.zeros((streams, width), dtype=np.float32)
        for begin in range(0, length, window):
            part = x[:, begin : begin + window]
            states, kept = [], []
            for t in range(part.shape[1]):
                states.append(h)
                new, *rest = _step(p, h, part[:, t])
                kept.append(rest)
                h = new * (part[:, t] != END)[:, None]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            flat, valid = part.T.reshape(-1), real[:, begin : begin + window].T.reshape(-1)
            if valid.all():
                _, back = _output(p, shape, np.concatenate(states), flat, grads)
            else:  # behind the last text
                back = np.zeros((len(flat), width), dtype=np.float32)
                if valid.any():
                    back[valid] = _output(p, shape, np.concatenate(states)[valid], flat[valid], grads)[1]
            back = back.reshape(part.shape[1], streams, width)
            carry = np.zeros_like(h)
            given = np.empty((part.shape[1], streams, 3 * width), dtype=back.dtype)
            for t in range(part.shape[1] - 1, -1, -1):
                before, (keep, open_, turned, new) = states[t], kept[t]
                carry = carry * (part[:, t] != END)[:, None]
                d_keep = carry * (before - new) * keep * (1 - keep)
                d_new = carry * (1 - keep) * (1 - new * new)
                d_open = d_new * turned * open_ * (1 - open_)
                d_turned = d_new * open_
                gate = np.concatenate([d_keep, d_open], axis=1)
                given[t, :, : 2 * width], given[t, :, 2 * width :] = gate, d_new
                grads["gate"] += before.T @ gate
                grads["turn"] += before.T @ d_turned
                carry = carry * keep + gate @ p["gate"].T + d_turned @ p["turn"].T + back[t]
            given = given.reshape(-1, 3 * width)
            grads["bias"] += given.sum(axis=0)
            order = np.argsort(flat.astype(np.int16), kind="stable")
            ranked = flat[order]
            head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            grads["embed"][ranked[head]] += np.add.reduceat(given[order], head, axis=0)
            self._move(grads)

    def _move(self, grads: dict) -> None:
        self.done += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 1.0 / max(size, 1e-9))
        for k, g in grads.items():
            g *= shrink
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            self.p[k] -= (self.rate * self.first[k] / (1 - 0.9**self.done)
                          / (np.sqrt(self.second[k] / (1 - 0.99**self.done)) + 1e-6)).astype(np.float32)


def fit(p: dict, shape: Shape, symbols: np.ndarray, streams: int = 32, window: int = 16,
        rate: float = 0.01, least: int = 1) -> dict:
    """Weights after passes over all texts; ``least`` is the fewest passes.

    More are made over small inputs until there are some hundred steps.
    """
    trainer = Trainer(p, shape, rate)
    streams = max(1, min(streams, len(symbols) // (2 * window)))
    per_pass = -(-len(symbols) // (streams * window))
    for _ in range(max(least, min(20, -(-300 // max(1, per_pass))))):
        trainer.learn(symbols, streams, window)
    return trainer.p


def log_likelihood(p: dict, shape: Shape, symbols: np.ndarray, sizes: np.ndarray,
                   streams: int = 512, window: int = 32) -> np.ndarray:
    """Natural log probability of every whole text; ``sizes`` are their symbol counts, END included.

    Texts are dealt to streams of near equal length; only streams that go on take part in a step.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    heap = [(0, s) for s in range(min(streams, n))]
    lanes: list[list[int]] = [[] for _ in heap]
    for text in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        lanes[lane].append(text)
        heapq.heappush(heap, (load + int(sizes[text]), lane))
    lanes.sort(key=lambda texts: -sum(int(sizes[t]) for t in texts))
    order = np.array([t for lane in lanes for t in lane])
    flat = symbols[np.repeat(begin[order] - np.r_[0, np.cumsum(sizes[order])[:-1]], sizes[order])
                   + np.arange(int(sizes.sum()))]
    long = np.array([sum(int(sizes[t]) for t in lane) for lane in lanes])
    head = np.r_[0, np.cumsum(long)[:-1]]
    logs = np.zeros(len(flat))
    h = np.zeros((len(lanes), p["turn"].shape[0]), dtype=np.float32)
    for at in range(0, int(long[0]), window):
        live = int(np.searchsorted(-long, -at, side="left"))
        steps = min(window, int(long[0]) - at)
        spot = head[:live, None] + at + np.arange(steps)
        valid = at + np.arange(steps) < long[:live, None]
        x = flat[np.minimum(spot, len(flat) - 1)]
        h = h[:live]
        states = np.empty((live, steps, h.shape[1]), dtype=np.float32)
        for t in range(steps):
            states[:, t] = h
            h = _step(p, h, x[:, t])[0] * (x[:, t] != END)[:, None]
        logs[spot[valid]] = _output(p, shape, states[valid], x[valid])[0]
    out = np.empty(n)
    out[order] = np.add.reduceat(logs, np.r_[0, np.cumsum(sizes[order])[:-1]])
    return out
