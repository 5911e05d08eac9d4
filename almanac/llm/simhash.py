"""SimHash near-duplicates: fingerprints become vectors of bit counts, which meet in a grid and are then compared exactly.

A fingerprint's 64 bits are cut into 32 segments of two. The number of set bits of each segment (0, 1 or 2) makes a vector,
and its Manhattan distance from another one is at most the number of bits in which the fingerprints differ. So of two
fingerprints that differ in three bits or fewer, one half's vectors have a distance of at most one: they are equal, or one
is the other with one count raised by one. Each half therefore lists its own grid cell and the cells with one count raised;
every link meets where an own cell and a listed one are the same. The pairs met are compared bit by bit in the join.

A cell with many own entries is not compared as it is: its entries list cells of the other half's halves too, where the
same holds again, and again for their halves. Equal fingerprints are one all along.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import small_batches, values
from almanac.llm.jaccard_join import components
from almanac.session import written

SIZE = 3
RADIUS = 3  # two halves leave one of them a distance of 1; more would need more parts
SEED = 42
CROWD = 128  # a cell with more own entries is divided further
PIECE = 1 << 16  # shingles that are counted at once: 4 MB of bits
LONG = 1 << 20  # bytes of a text that are cut into words at once, about
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in one list, or several if it is long."""
    at = 0
    while len(text) - at > LONG:
        space = _SPACE.search(text, at + LONG)
        if space is None:
            break
        yield text[at : space.start()].lower().split()
        at = space.end()
    yield (text[at:] if at else text).lower().split()


def _hashes(text: bytes | None, size: int) -> Iterator[list[int]]:
    """Hashes of a text's shingles, some at a time."""
    digest, last, short = xxhash.xxh64_intdigest, [], True
    for words in _word_lists(text or b""):
        words = last + words
        if len(words) >= size:
            short = False
            runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
            yield [digest(s, SEED) for s in runs]
        last = words if len(words) < size else words[len(words) - size + 1 :]
    if short and last:
        yield [digest(b" ".join(last), SEED)]


def fingerprints(texts: Iterator[bytes | None], size: int = SIZE) -> list[int]:
    """The 64-bit fingerprint of each text, as a signed number: bits that are set in over half of its shingles' hashes."""
    counts, totals, some, starts, owners = [], [], [], [], []

    def flush() -> None:
        if some:
            bits = np.unpackbits(np.array(some, ">u8").view(np.uint8)).reshape(-1, 64)
            for owner, c in zip(owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64), strict=True):
                counts[owner] += c
        some.clear(), starts.clear(), owners.clear()

    for i, text in enumerate(texts):
        counts.append(np.zeros(64, np.int64))
        totals.append(0)
        for hashes in _hashes(text, size):
            totals[i] += len(hashes)
            for k in range(0, len(hashes), PIECE):
                starts.append(len(some))
                owners.append(i)
                some.extend(hashes[k : k + PIECE])
                if len(some) >= PIECE:
                    flush()
    flush()
    if not counts:
        return []
    over = 2 * np.array(counts) > np.array(totals)[:, None]
    return np.packbits(over, axis=1).view(">i8").ravel().tolist()


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """The fingerprint of a text as a long; zero for null and texts without words."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprints(values(texts.cast(pa.binary())), size), pa.int64())

    return of(text)


def bit_counts(x: Column) -> Column:
    """The set bits of each two-bit segment, in that segment."""
    odd = F.lit(0x5555555555555555)
    a, b = x.bitwiseAND(odd), F.shiftright(x, 1).bitwiseAND(odd)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def _cells(entries: DataFrame, width: int, level: int) -> DataFrame:
    """(cell, x, rest, own, here): what each entry (cell, x, rest, own) lists when the ``width`` bits of ``rest`` are halved.

    ``cell`` grows by the half's number and counts, ``rest`` is the other half. Bit ``level`` of ``own`` says whether the
    cell is the entry's own one or has a count raised, and so does ``here``.
    """
    half = width // 2
    one = lambda i: f"(shiftrightunsigned(rest, {i * half}) & {(1 << half) - 1}L)"
    listed = []
    for i in (0, 1):
        place = f"shiftleft(cell, {half + 1}) + {i << half}L + {one(i)}"
        row = f"x, {one(1 - i)} AS rest"
        listed.append(f"array(struct({place} AS cell, {row}, own + {1 << level} AS own, true AS here))")
        free = f"filter(sequence(0, {half - 2}, 2), j -> (shiftrightunsigned({one(i)}, j) & 3L) < 2)"
        listed.append(f"transform({free}, j -> struct({place} + shiftleft(1L, j) AS cell, {row}, own AS own, false AS here))")
    return entries.selectExpr(f"inline(concat({', '.join(listed)}))")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: the pairs of different fingerprints in ``prints`` (x, distinct) that differ in ``radius`` bits or fewer."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the grid holds for radii up to {RADIUS}")
    entries = prints.select(F.lit(0).cast("bigint").alias("cell"), "x", bit_counts(F.col("x")).alias("rest"), F.lit(0).alias("own"))
    found, width = [], 64
    for level in range(3):
        every = written(_cells(entries, width, level), "cells")
        ours = every.where("here")
        crowded = None
        if level < 2:
            crowded = written(ours.groupBy("cell").count().where(F.col("count") > CROWD).select("cell"), "crowded")
            if crowded.isEmpty():
                crowded = None
            else:
                ours = ours.join(crowded, "cell", "left_anti")
        # for each halving so far, one of the two must be in its own cell
        pairs = ours.selectExpr("cell", "x u", "own uo").join(every.selectExpr("cell", "x v", "own vo"), "cell")
        near = f"u != v AND bit_count(u ^ v) <= {radius} AND (uo | vo) = {(2 << level) - 1}"
        found.append(pairs.where(near).selectExpr("least(u, v) u", "greatest(u, v) v"))
        if crowded is None:
            break
        entries, width = every.join(crowded, "cell", "left_semi").drop("here"), width // 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, size: int = SIZE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, label, component_id) for every row of ``docs``.

    ``label`` is the smallest fingerprint (as a signed number) that links lead to, ``component_id`` the smallest id of the
    rows that share it. Words are parted by ASCII white space after lower-casing A-Z; a text of fewer than ``size`` words is
    one shingle. Null texts and texts without words have the fingerprint zero and link like others. Rows without id are
    linked too, but never give a component its id, which is null if none of its rows has one. Repeated rows stay. No rows:
    an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        rows = written(rows.select("id", fingerprint(F.col("text"), size).alias("fingerprint")), "fingerprints")
    prints = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "prints")
    labels = components(links(prints.select(F.col("fingerprint").alias("x")), radius))
    labelled = prints.join(labels, prints.fingerprint == labels.node, "left")
    labelled = written(labelled.select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = labelled.select("fingerprint", "label").join(least, "label")
    return rows.join(found, "fingerprint").select("id", "fingerprint", "label", "component_id")
