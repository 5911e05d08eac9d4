"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest through a heap over linked bytes."""

import base64
import gc
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import values, worker_kept

#: White space of the split pattern's ``\s``, written out: the two regular-expression libraries differ on it.
_BLANK = "\t-\r \x85\xa0  -     　"
#: A text may be cut before white space that follows something else: no pre-token reaches across.
CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
KEPT = 400_000  # chunks that a Python worker remembers
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines.splitlines()) if t}


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    h = h + np.uint64((level + 1) * _STEP & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: on every level the keys that are alone on their place keep it, the others go on.

    A key's number is the rank of its bit among the bits of all levels. ``find`` compares the stored key, so
    strings outside the set are told apart from it.
    """

    def __init__(self, entries: dict[bytes, int], load: float = 1.5):
        keys = list(entries)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two keys have the same 64-bit hash")
        self.sizes, bits, left, number, base = [], [], np.arange(len(keys)), np.empty(len(keys), np.int64), 0
        while len(left):
            size = max(8, int(load * len(left)))
            place = (_mix(hashes[left], len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            kept = alone[place]
            number[left[kept]] = base + rank[place[kept]]
            bits.append(np.where(alone, base + rank, -1).tolist())
            base += int(kept.sum())
            left = left[~kept]
            self.sizes.append(size)
        self.levels = bits
        order = np.argsort(number)
        self.keys = [keys[i] for i in order]
        self.ids = [entries[k] for k in self.keys]

    def find(self, token: bytes) -> int:
        """The id of a token, or -1."""
        h = xxhash.xxh3_64_intdigest(token)
        for level, (size, numbers) in enumerate(zip(self.sizes, self.levels, strict=True)):
            x = (h + (level + 1) * _STEP) & _MASK
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
            x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
            n = numbers[(x ^ x >> 31) % size]
            if n >= 0:
                return self.ids[n] if self.keys[n] == token else -1
        return -1


_NONE = 1 << 22  # no rank: above every rank of a file


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """The rank of every pair of bytes."""
    return [ranks.get(bytes((a, b)), _NONE) for a in range(256) for b in range(256)]


def merge(token: bytes, ranks: dict[bytes, int], pairs: list[int]) -> tuple[int, ...]:
    """BPE of one pre-token: the pair of lowest rank, leftmost first, is joined until none is left.

    The bytes are a linked list; a heap holds the pairs as one number each: rank, where it starts, where it stops.
    An entry is stale if its left part has gone or has grown.
    """
    n = len(token)
    w = n.bit_length()
    low = (1 << w) - 1
    heap = [
        (r << w | i) << w | i + 2
        for i, r in enumerate(map(pairs.__getitem__, [a << 8 | b for a, b in zip(token, token[1:])]))
        if r < _NONE
    ]
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is gone
    before = list(range(-1, n - 1))
    heapify(heap)
    rank = ranks.get
    while heap:
        top = heappop(heap)
        stop, i = top & low, top >> w & low
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            r = rank(token[i : end[stop]])
            if r is not None:
                heappush(heap, (r << w | i) << w | end[stop])
        if i:
            p = before[i]
            r = rank(token[p:stop])
            if r is not None:
                heappush(heap, (r << w | p) << w | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return tuple(out)


class _Known(dict):
    """Ids of chunks and pre-tokens seen so far; those that came first, and so come often, are kept when it is full."""

    def __init__(self, resolve, split, kept: int):
        self.resolve, self.split, self.kept = resolve, split, kept

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= self.kept:
            for k in list(islice(reversed(self), self.kept // 2)):
                del self[k]
        parts = self.split(chunk)
        out = self.resolve(chunk.encode("utf-8", "replace")) if len(parts) == 1 else sum(map(self.__getitem__, parts), ())
        self[chunk] = out
        return out


class Codec:
    """Encodes and decodes by one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.ranks, self.whole, self.pairs = ranks, PerfectHash(ranks), pair_table(ranks)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.known = _Known(self.resolve, regex.compile(pattern).findall, kept)

    def resolve(self, token: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the vocabulary's own id if it has one, else the merges."""
        i = self.whole.find(token)
        return (i,) if i >= 0 else merge(token, self.ranks, self.pairs)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; none for null."""
        return list(chain.from_iterable(map(self.known.__getitem__, CHUNK.findall(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _shared(spark: SparkSession, rank_file: str):
    """The rank file, read once and sent to all tasks: a vocabulary of fixed size, refused over 64 MB."""
    with open(rank_file, "rb") as f:
        lines = f.read((64 << 20) + 1)
    if len(lines) > 64 << 20:
        raise ValueError(f"{rank_file} has more than 64 MB")
    return spark.sparkContext.broadcast(lines)


def _codec(shared, pattern: str) -> Codec:
    """One codec for a Python worker, which serves many tasks."""
    key, kept = ("codec", hash(shared.value), pattern), worker_kept()
    if key not in kept:
        kept.clear()
        kept[key] = Codec(read_ranks(shared.value), pattern)
    return kept[key]


def encode(text: Column, spark: SparkSession, rank_file: str, pattern: str) -> Column:
    """Token ids of each text as ``array<int>``; an empty array for null and for the empty text.

    Texts are cut before white space into chunks. A Python worker resolves each chunk once and remembers up to
    ``KEPT`` of them: a pre-token is looked up in the minimal perfect hash over the vocabulary, and merged over the
    heap if it is not there. Equal texts always give equal ids, whatever is remembered.
    """
    shared = _shared(spark, rank_file)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared, pattern)
        gc.disable()  # the many small tuples form no cycles
        for texts in batches:
            ids = [np.array(codec.encode(t), np.int32) for t in values(texts)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return encoded(text)


def decode(ids: Column, spark: SparkSession, rank_file: str) -> Column:
    """The bytes that an array of ids stands for; null for null. An id outside the file is an error."""
    shared = _shared(spark, rank_file)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytes_of = {i: t for t, i in read_ranks(shared.value).items()}.__getitem__
        for rows in batches:
            ends, there = rows.offsets.to_numpy().tolist(), rows.is_valid().to_pylist()
            flat = rows.values.to_numpy(zero_copy_only=False)
            texts = (b"".join(map(bytes_of, flat[i:j].tolist())) for i, j in pairwise(ends))
            yield pa.array([t if known else None for t, known in zip(texts, there, strict=True)], pa.binary())

    return decoded(ids)
