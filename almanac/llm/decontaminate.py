"""Benchmark decontamination: one automaton over the windows of all items, one scan over each text."""

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import WORD_TABLE, utf8, values, word_bytes
from almanac.session import written

WINDOW = 10
BLOCK_BYTES = 4 << 20  # of item text in one automaton
SPAN = "struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>"
FOUND = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<{SPAN}>>"
_ARROW_FOUND = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")]))),
])


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """All runs of ``size`` words; a shorter text is one run; none without words."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def build(items: list[tuple[str, str | None]], size: int = WINDOW):
    """The automaton over all windows; a state's value is (number of words, items)."""
    owners: dict[bytes, set[str]] = {}
    for key, text in items:
        for w in windows(word_bytes(text), size):
            owners.setdefault(w, set()).add(key)
    automaton = ahocorasick.Automaton()
    for w, keys in owners.items():
        # one character for each byte, and blanks at both ends keep matches on whole words
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(keys)))
    if owners:
        automaton.make_automaton()
    return automaton if owners else None


def _offsets(raw: bytes, plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the original text, in code points."""
    inside = np.frombuffer(plain, np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return points[edge[0::2]], points[edge[1::2]]


def scan(text: str | None, automaton, before: dict | None = None) -> dict:
    """Words, hit words, items and spans of one text, together with what earlier blocks found."""
    raw = utf8(text)
    plain = raw.translate(WORD_TABLE)
    words = plain.split()
    items = set(before["items"]) if before else set()
    old = before["spans"] if before else []
    hits = []
    if automaton is not None and words:
        line = " " + b" ".join(words).decode("latin-1") + " "
        hits = list(automaton.iter(line))
    if not hits:
        n_hit = before["n_hit"] if before else 0
        return {"n_words": len(words), "n_hit": n_hit, "items": sorted(items), "spans": old}
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))  # the blank after each word
    last = np.searchsorted(ends, [e for e, _ in hits])
    change = np.zeros(len(words) + 1, np.int64)
    for k, (_, (n, keys)) in zip(last.tolist(), hits, strict=True):
        change[k - n + 1] += 1
        change[k + 1] -= 1
        items.update(keys)
    for s in old:
        change[s["first_word"]] += 1
        change[s["last_word"] + 1] -= 1
    hit = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    start, end = _offsets(raw, plain)
    spans = [
        {"first_word": a, "last_word": b - 1, "start": int(start[a]), "end": int(end[b - 1])}
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)
    ]
    return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items), "spans": spans}


def _scanner(shared, window: int):
    """The scan as a column function; ``shared`` is the broadcast block of items."""

    @F.arrow_udf(FOUND)
    def scanned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = build(shared.value, window)
        for texts, earlier in batches:
            rows = [scan(t, automaton, e) for t, e in zip(values(texts), values(earlier), strict=True)]
            yield pa.array(rows, _ARROW_FOUND)

    return scanned


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``leak``: number of words, hit words, items found, and the spans that are hit.

    A window is ``window`` consecutive words of an item; a shorter item is one window. Spans join overlapping and
    touching hits and carry word numbers and offsets (code points) in the original text.

    The items' total size is measured first. Up to ``block_bytes`` they form one automaton, which is sent to all tasks;
    more items are dealt by hash over blocks of about that size, and each block's scan adds to the spans of the one
    before, so memory doesn't grow with the benchmark. Nothing is shuffled.

    Null and empty texts have no words and no hits. Items without words match nothing; an item without id is reported
    as ``null``; repeated items count once. An empty benchmark hits nothing. A column ``leak`` is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("k"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.withColumn("leak", F.lit(None).cast(FOUND))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("k", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])

        out = out.withColumn("leak", _scanner(shared, window)(F.col(text_col), F.col("leak")))
        if b + 1 < blocks:
            out = written(out, "leaks")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item, with their own columns."""
    return find_leaks(docs, benchmark).where("leak.n_hit = 0").select(*docs.columns)
