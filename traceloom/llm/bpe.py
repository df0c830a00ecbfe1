"""Byte-level BPE: exact encoding of whole texts by a rank file, and decoding.

A text is cut by the vocabulary's pattern. A piece that is a token is done; any other is merged by a
queue of ranks: one bucket per rank holds positions of a doubly linked list of parts, a bitmap in
levels of 64 bits tells by find-first-set which bucket is next, and entries whose parts have changed
meanwhile are skipped. A merge costs one step per level, whatever the length of the piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice
from math import isqrt
from struct import pack
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept encoded per worker and generation, of at most so many characters each.
KEPT, KEPT_CHARS = 300_000, 32
#: Bytes of pieces and ids of a generation, whatever the script; common words stay below with ``KEPT`` pieces.
KEPT_BYTES = 48 << 20
#: Bytes of results at which a worker sends them on; a batch of Spark's may hold 10,000 texts.
SENT_BYTES = 4 << 20
_BLOCK = 50_000
_ENCODED = "struct<n_tokens: bigint, ids: binary>"
_BOTH = "struct<n_tokens: bigint, ids: binary, decoded: binary>"


class Ranks:
    """Ranks of byte strings, and the words of the rank queue's bitmap, all zero between pieces.

    The bitmap has two levels: a word has one bit per rank, the top has one bit per word that is not
    zero. Words are as wide as there are words, whatever the number of ranks.
    """

    def __init__(self, of: dict[bytes, int]):
        self.of = of
        self.longest = max(map(len, of), default=0)
        most = max(of.values(), default=0)
        width = isqrt(most) + 1
        self.words = [0] * width
        self.places = [(rank // width, 1 << rank % width, 1 << rank // width) for rank in range(most + 1)]


def merge(piece: bytes, ranks: Ranks) -> list[int]:
    """Token ids of one piece: always the pair of least rank, the leftmost among equals.

    A part begins at its position and ends where the next one begins. ``buckets`` holds per rank the
    positions whose pair had that rank when they were noted, the least first; an entry is stale when its
    position begins no part any more or the pair there has another rank by now. Calls are written out:
    a piece costs some microseconds, and a corpus has as many pieces as distinct words.
    """
    of, longest, words, places = ranks.of, ranks.longest, ranks.words, ranks.places
    width = len(words)
    find = of.get
    whole = find(piece)
    if whole is not None:
        return [whole]
    end = len(piece)
    after = list(range(1, end + 2))
    before = list(range(-1, end))
    pair = [find(piece[at : at + 2]) for at in range(end - 1)]
    pair.append(None)
    top, buckets = 0, {}
    for at, rank in enumerate(pair):
        if rank is not None:
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [at]
                word, bit, mark = places[rank]
                words[word] |= bit
                top |= mark
            else:
                bucket.append(at)  # positions rise, so this is a heap
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word * width + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            at = heappop(bucket)
        else:
            at = bucket[0]
            del buckets[rank]
            bits &= bits - 1
            words[word] = bits
            if not bits:
                top &= top - 1
        if pair[at] != rank:
            continue
        gone = after[at]
        middle = after[at] = after[gone]
        before[middle] = at
        pair[gone] = pair[at] = None
        if middle < end and (stop := after[middle]) - at <= longest:
            pair[at] = rank = find(piece[at:stop])
            if rank is not None:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [at]
                    word, bit, mark = places[rank]
                    words[word] |= bit
                    top |= mark
                else:
                    heappush(bucket, at)
        left = before[at]
        if left >= 0:
            pair[left] = rank = find(piece[left:middle]) if middle - left <= longest else None
            if rank is not None:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [left]
                    word, bit, mark = places[rank]
                    words[word] |= bit
                    top |= mark
                else:
                    heappush(bucket, left)
    out, at = [], 0
    while at < end:
        out.append(of[piece[at : after[at]]])
        at = after[at]
    return out


def stand_ins(pattern: str) -> bytes:
    """Pairs (code point, another one) where this regex library and tiktoken class letters otherwise.

    The two follow different editions of Unicode. For every class the pattern names, tiktoken itself
    is asked which code points it matches; one that is judged otherwise here is given a stand-in that
    both judge as tiktoken judges it. At most one pair per code point of Unicode.
    """
    import tiktoken

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], dtype=np.uint32)
    everything = points.tobytes().decode("utf-32-le")
    single = {bytes([value]): value for value in range(256)}
    here, there = (np.zeros(0x110000, dtype=np.int64) for _ in range(2))
    for place, kind in enumerate(sorted(set(regex.findall(r"\\[pP]\{\w+\}|\\[sSdDwW]", pattern)))):
        other = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        matched = bytes(other.encode_ordinary(everything)).decode()
        for judged, found in ((here, "".join(regex.findall(kind, everything))), (there, matched)):
            judged[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] |= 1 << place
    odd = points[here[points] != there[points]]
    agreed = points[here[points] == there[points]]
    kinds, at = np.unique(there[agreed], return_index=True)
    stand = dict(zip(kinds.tolist(), agreed[at].tolist()))
    pairs = [(c, stand[int(there[c])]) for c in odd.tolist() if int(there[c]) in stand]
    return np.array(pairs, dtype=np.uint32).tobytes()


class Vocabulary:
    """Ranks of byte strings, the pattern that cuts texts, and the pieces encoded lately."""

    def __init__(self, lines: bytes, pattern: str, stand: bytes = b""):
        self.ranks = Ranks({
            base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token
        })
        top = max(self.ranks.of.values(), default=-1) + 1
        spelt = {rank: token for token, rank in self.ranks.of.items()}
        self.letters = np.frombuffer(b"".join(spelt.get(k, b"") for k in range(top)), dtype=np.uint8)
        self.lengths = np.array([len(spelt.get(k, b"")) for k in range(top)], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)][:-1]
        self.pattern = regex.compile(pattern)
        self.stand = dict(np.frombuffer(stand, dtype=np.uint32).reshape(-1, 2).tolist())
        self.odd = _any_of(list(self.stand))
        self.known = _Kept(KEPT, self._piece)

    def _piece(self, piece: str) -> bytes:
        found = merge(piece.encode(), self.ranks)
        return pack(f"<{len(found)}I", *found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; pieces of long texts are held in blocks."""
        pieces = self.pieces(text)
        if isinstance(pieces, list):
            return b"".join(map(self.known.__getitem__, pieces))
        out = bytearray()
        while block := list(islice(pieces, _BLOCK)):
            out += b"".join(map(self.known.__getitem__, block))
        return bytes(out)

    def pieces(self, text: str) -> list[str] | Iterator[str]:
        """The text's pieces; its odd code points are judged by their stand-ins."""
        if self.odd is not None and not _latin(text) and self.odd.search(text):
            spans = self.pattern.finditer(text.translate(self.stand))
            return (text[m.start() : m.end()] for m in spans)
        if len(text) > _BLOCK:
            return (m.group() for m in self.pattern.finditer(text))
        return self.pattern.findall(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids in turn, copied together in blocks."""
        out = bytearray()
        for at in range(0, len(ids), 4 * _BLOCK):
            some = np.frombuffer(ids[at : at + 4 * _BLOCK], dtype="<u4")
            lengths = self.lengths[some]
            if not lengths.all():
                raise KeyError("an id that the vocabulary lacks")
            ends = np.cumsum(lengths)
            place = np.repeat(self.starts[some] - ends + lengths, lengths) + np.arange(ends[-1])
            out += self.letters[place].tobytes()
        return bytes(out)


def _latin(text: str) -> bool:
    """Whether all code points are below 256, where libraries agree; told by a copy, faster than a search."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _any_of(points: list[int]) -> re.Pattern | None:
    """A pattern that finds any of the code points, written as runs."""
    if not points:
        return None
    points = np.array(sorted(points))
    cuts = np.flatnonzero(np.diff(points) > 1)
    starts, ends = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


class _Kept(dict):
    """Encoded short texts in two generations of fixed size, in texts and in bytes: the older one goes when
    this one is full, and texts that are met again come over from it, so frequent ones stay."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.make, self.bytes = most, make, 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= KEPT_CHARS:
            if len(self) >= self.most or self.bytes >= KEPT_BYTES:
                self.older = dict(self)
                self.clear()
                self.bytes = 0
            self[text] = ids
            self.bytes += getsizeof(text) + getsizeof(ids)
        return ids


@lru_cache(maxsize=2)
def vocabulary(lines: bytes, pattern: str, stand: bytes) -> Vocabulary:
    """Parsed once per worker."""
    return Vocabulary(lines, pattern, stand)


def _shared(spark, path: str, pattern: str):
    """Rank file, pattern and stand-ins, sent once per executor; the vocabulary bounds their size."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast((file.read(), pattern, stand_ins(pattern)))


def in_runs(batches: Iterator[pa.Array], make: Callable[[str | bytes], bytes], none: str | bytes) -> Iterator[list[bytes]]:
    """What ``make`` gives for each value, sent on at ``SENT_BYTES``, not held for a whole batch.

    A worker so holds one batch of Spark's, a run of results and one value's own. ``none`` stands for
    null; lengths of values count too, as what is decoded from a run is as long as its texts.
    """
    for some in batches:
        run, size = [], 0
        for value in some:
            value = value.as_py() or none
            run.append(made := make(value))
            size += len(value) + len(made)
            if size >= SENT_BYTES:
                yield run
                run, size = [], 0
        if run:
            yield run


def _struct(ids: list[bytes], **others: list[bytes]) -> pa.StructArray:
    """The number of ids, the ids and other columns of a run."""
    columns = [pa.array(column, pa.binary()) for column in (ids, *others.values())]
    sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
    return pa.StructArray.from_arrays([sizes, *columns], ["n_tokens", "ids", *others])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "encoded") -> DataFrame:
    """All rows and columns, and ``into``: struct of n_tokens and ids (packed little-endian uint32).

    ``path`` is a file of base64 tokens and ranks, ``pattern`` the expression that cuts a text into
    pieces; both are read where the driver runs. Special tokens are ordinary text. A null text is an
    empty one and has no ids; a long text is one row whose pieces are held in blocks; repeated rows
    are encoded alike; an empty table stays empty. A column named as ``into`` is replaced. Only the
    text travels to Python.
    """
    shared = _shared(docs.sparkSession, path, pattern)

    @F.arrow_udf(_ENCODED)
    def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(*shared.value)
        for ids in in_runs(texts, own.encode, ""):
            yield _struct(ids)

    return docs.withColumn(into, coded(F.col(text)))


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "encoded.ids", into: str = "decoded") -> DataFrame:
    """All rows and columns, and ``into``: the bytes that packed ids stand for; null ids are none.

    An id that the vocabulary lacks raises ``KeyError``; a column named as ``into`` is replaced.
    """
    shared = _shared(coded.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def spelt(packed: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(*shared.value)
        for spelled in in_runs(packed, own.decode, b""):
            yield pa.array(spelled, pa.binary())

    return coded.withColumn(into, spelt(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "coded") -> DataFrame:
    """As :func:`encode`, and in the same struct ``decoded``: the bytes that the ids stand for.

    :func:`decode` after :func:`encode` takes a second worker per task, with a vocabulary of its own,
    and the ids of whole batches back and forth; here a run of ids is decoded where it was made, run by
    run, as turns between the two for each text cost the processor's caches.
    """
    shared = _shared(docs.sparkSession, path, pattern)

    @F.arrow_udf(_BOTH)
    def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(*shared.value)
        for ids in in_runs(texts, own.encode, ""):
            yield _struct(ids, decoded=list(map(own.decode, ids)))

    return docs.withColumn(into, coded(F.col(text)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every text encoded and decoded again: number of ids, SHA-256 of the ids and of the bytes."""
    return round_trip(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        F.col("coded.n_tokens").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )
