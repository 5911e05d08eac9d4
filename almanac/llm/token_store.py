"""Token-id files: Re-Pair grammar compression, with random access to every document.

A shard holds consecutive documents, in ascending id order. Its ids are one sequence, in which frequent pairs of
neighbours are replaced by new symbols, again and again; a document's last symbol never pairs with the next document's
first. A file row has

* ``rules``: the pairs, two little-endian unsigned 32-bit numbers each; rule r stands for symbol ``first_symbol + r``,
* ``lengths``: how many ids each rule expands to, unsigned 32-bit,
* ``symbols``: the compressed sequence, unsigned 32-bit,
* ``ends``: for each document, where its symbols and its ids end in the shard, unsigned 64-bit each,

and for the shard its number, its first document's place, and its documents' ids.
"""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from almanac.llm.common import worker_kept
from almanac.session import shared_dir

SHARD_IDS = 1_000_000  # ids of a shard, about: a shard ends with the document that reaches it
RULES = 4096  # new symbols of a pass, at most; passes go on until no pair is frequent
HASHED = 20  # bits of the hash that pairs are counted by first
LEAST = 4  # a pair that occurs less often isn't worth a rule
_ODD = np.int64(-0x61C8864680B583EB)


def compress(ids: np.ndarray, ends: np.ndarray, first_symbol: int, rules: int = RULES):
    """(rules, lengths, symbols, symbol ends) of documents that end at ``ends`` in ``ids``.

    Each pass replaces many pairs that don't overlap, the most frequent ones first, until none occurs ``LEAST`` times.
    Pairs that only overlap with themselves may stay.
    """
    seq = ids.astype(np.int64)
    close = np.zeros(len(seq), bool)  # the last symbol of a document
    close[ends[ends > 0] - 1] = True
    pairs, length = [], []
    while len(seq) > 1:
        before = len(seq)
        code = seq[:-1] << 32 | seq[1:]
        code[close[:-1]] = -1
        # most pairs are rare: those that share a hash with too few others needn't be sorted
        h = (code * _ODD >> (64 - HASHED)) + (1 << HASHED - 1)
        few = np.bincount(h[code >= 0], minlength=1 << HASHED) < LEAST
        every, counts = np.unique(code[(code >= 0) & ~few[h]], return_counts=True)
        every, counts = every[counts >= LEAST], counts[counts >= LEAST]
        if not len(every):
            break
        best = np.argsort(-counts, kind="stable")[:rules]
        chosen = np.sort(every[best])
        maybe = np.zeros(1 << HASHED, bool)
        maybe[(chosen * _ODD >> (64 - HASHED)) + (1 << HASHED - 1)] = True
        place = np.flatnonzero(maybe[h])
        at = np.minimum(np.searchsorted(chosen, code[place]), len(chosen) - 1)
        there = chosen[at] == code[place]
        place, at = place[there], at[there]
        # of matches that overlap, every other one from the left is replaced
        run = np.concatenate(([True], np.diff(place) > 1))
        start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
        there = (np.arange(len(place)) - start) % 2 == 0
        place, at = place[there], at[there]
        base = first_symbol + len(pairs)
        new = [(int(c >> 32), int(c & 0xFFFFFFFF)) for c in chosen]
        size = lambda s: 1 if s < first_symbol else length[s - first_symbol]
        length += [size(a) + size(b) for a, b in new]
        pairs += new
        seq[place] = base + at
        close[place] |= close[place + 1]
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        seq, close = seq[keep], close[keep]
        if before - len(seq) < LEAST:
            break  # a rule for so few places costs as much as it saves
    at_end = np.concatenate(([0], np.flatnonzero(close) + 1))
    nth = np.cumsum(np.diff(np.concatenate(([0], ends))) > 0)  # documents without ids end where the one before does
    return np.array(pairs, np.uint32).reshape(-1, 2), np.array(length, np.uint32), seq.astype(np.uint32), at_end[nth]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids of a run of symbols: every rule's first half goes to its place, its second half behind it."""
    seq = symbols.astype(np.int64)
    size = np.concatenate([np.ones(first_symbol, np.int64), lengths.astype(np.int64)])
    place = np.concatenate(([0], np.cumsum(size[seq])))
    out = np.empty(place[-1], np.uint32)
    place = place[:-1]
    pairs = rules.astype(np.int64)
    while len(seq):
        plain = seq < first_symbol
        out[place[plain]] = seq[plain]
        seq, place = seq[~plain], place[~plain]
        left, right = pairs[seq - first_symbol].T if len(seq) else (seq, seq)
        seq, place = np.concatenate([left, right]), np.concatenate([place, place + size[left]])
    return out


def read_document(row: dict, n: int) -> np.ndarray:
    """The ids of the n-th document of a file row, without expanding the others."""
    ends = np.frombuffer(row["ends"], np.uint64).reshape(-1, 2).astype(np.int64)
    a, b = (ends[n - 1, 0] if n else 0), ends[n, 0]
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], np.uint32)[a:b]
    return expand(symbols, rules, np.frombuffer(row["lengths"], np.uint32), row["first_symbol"])


def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept, key = worker_kept(), ("tokenizer", hash(text))
    if key not in kept:
        kept.clear()
        kept[key] = Tokenizer.from_str(text)
    return kept[key]


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 2, first_symbol: int = 1 << 17,
          id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every text with the tokenizers library, by its default also where a text holds a special token's string, end it with ``end_id``, and write shards under ``path``.

    Documents are parted by ranges of their id, and within a range sorted by id and text; null ids come first, equal ids
    are told apart by a hash of the text. Null and empty texts are the end id alone. A range makes shards of about
    ``shard_ids`` ids; the text of one document is the least that a task holds. No rows: no shards.

    The tokenizer's file is read once and sent to all tasks (refused over 64 MB). Spark's writer commits the shards, so
    a lost or repeated task leaves nothing behind.
    """
    spark = docs.sparkSession
    if os.path.getsize(tokenizer_file) > 64 << 20:
        raise ValueError(f"{tokenizer_file} has more than 64 MB")
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, made = _tokenizer(shared.value), TaskContext.get().partitionId(), 0
        keys, ids, n = [], [], 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids])
            rules, lengths, symbols, symbol_ends = compress(np.concatenate(ids), ends, first_symbol)
            both = np.stack([symbol_ends, ends], axis=1).astype(np.uint64)
            blobs = [x.tobytes() for x in (rules, lengths, symbols, both)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([int(ends[-1])], pa.int64()),
                 pa.array([first_symbol], pa.int32()), pa.array([keys]).cast(pa.list_(id_type)), *(pa.array([x], pa.binary()) for x in blobs)],
                ["part", "shard", "n_ids", "first_symbol", "doc_ids", "rules", "lengths", "symbols", "ends"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                coded = tokenizer.encode_batch_fast([t or "" for t in some.column(1).to_pylist()], add_special_tokens=False)
                for key, c in zip(some.column(0).to_pylist(), coded, strict=True):
                    keys.append(key)
                    ids.append(np.array([*c.ids, end_id], np.uint32))
                    n += len(ids[-1])
                    if n >= shard_ids:
                        yield shard()
                        keys, ids, n, made = [], [], 0, made + 1
        if n:
            yield shard()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    shards = ordered.mapInArrow(
        sharded,
        f"part int, shard int, n_ids bigint, first_symbol int, doc_ids array<{kind}>, "
        "rules binary, lengths binary, symbols binary, ends binary",
    )
    shards.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document of the shards under ``path``, and how many ids all before it have."""
    shards = spark.read.parquet(path)
    total = shards.select("part", "shard", "n_ids")
    # one number for each range, then for each shard of a range: no task sees more than the numbers of one of both
    parts = total.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    first = total.select("part", "shard", inside.alias("inside")).join(before, "part")
    first = first.select("part", "shard", (F.col("before") + F.col("inside")).alias("first"))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                r = row.to_pylist()[0]
                ends = np.frombuffer(r["ends"], np.uint64).reshape(-1, 2)[:, 1].astype(np.int64)
                symbols = np.frombuffer(r["symbols"], np.uint32)
                rules = np.frombuffer(r["rules"], np.uint32).reshape(-1, 2)
                ids = expand(symbols, rules, np.frombuffer(r["lengths"], np.uint32), r["first_symbol"])
                starts = np.concatenate(([0], ends[:-1])) + r["first"]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(starts), lists], ["doc_id", "start", "ids"])

    return shards.join(first, ["part", "shard"]).mapInArrow(opened, f"doc_id {kind}, start bigint, ids array<int>")


def stored(docs: DataFrame, tokenizer_file: str, path: str | None = None, **options) -> DataFrame:
    """Write the documents to files and read them back."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    write(docs, tokenizer_file, path, **options)
    return read(docs.sparkSession, path)
