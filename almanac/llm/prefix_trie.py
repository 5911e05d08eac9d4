"""Prefix trie of conversations: a skeleton of splitter paths, and sorted shards that finish all other nodes alone.

A turn becomes a token of 24 bytes (a digest of role and text, and the text's length), a conversation the path of its
tokens. Paths are cut into ranges of equal size by (path, id) and sorted, so a node's members lie side by side. A node
whose members reach over the end of a range is a prefix of the last path before it and of the first one after it: these
common prefixes are the splitters' trie, the skeleton. Its shape is one number for each range, the depth that the paths
at its end have in common; that is what is broadcast, and each shard gets the one path at its own end beside it.

A shard goes through its paths with a stack. A node that isn't of the skeleton begins and ends in it and leaves it whole.
Skeleton nodes leave partial counts, which are added up by node. Sums over a skeleton node's subtree are sums over a run of
the skeleton in depth-first order, where a node comes at the range in which it begins: totals by range and sums within one
range are enough.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import small_batches
from almanac.session import written

TOKEN = 24
SHARD = 500_000  # turns of a shard, about
PIECE = 4_096  # bytes of an id list that travel as one row
FLUSH = 5_000  # rows that a shard returns at once
NOTHING = hashlib.sha256().hexdigest()
_FOUND = (
    "kind int, home int, depth bigint, conv_id bigint, parent_home int, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    "n_leaves bigint, saved_tokens bigint, length bigint, shard int, part bigint, ends string"
)
_WHOLE, _PARTIAL, _ENDS = range(3)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens) of ``turns`` (conv_id, turn, role, text): each conversation's turns as tokens in hexadecimal.

    Turns are ordered by ``turn``, null first, and equal ones by the digest of role and text. A null role or text counts as
    empty. Rows without conv_id belong to no conversation and are left out. A conversation's tokens are one row, 48
    characters a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    token = F.concat(digest, F.lpad(F.hex(F.char_length(text).cast("bigint")), 16, "0"))
    place = F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("t"), token.alias("x"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), place.alias("p")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("conv_id", F.transform("p", lambda p: p["x"]).alias("tokens"))


def path_of(tokens: Column) -> Column:
    return F.unhex(F.array_join(tokens, ""))


def _common(p: bytes, q: bytes) -> int:
    """How many tokens two paths begin with alike."""
    most = min(len(p), len(q)) // TOKEN
    if p[: most * TOKEN] == q[: most * TOKEN]:
        return most
    low, high = 0, most  # the first ``low`` tokens are equal, those up to ``high`` aren't all
    while high - low > 1:
        mid = (low + high) // 2
        if p[low * TOKEN : mid * TOKEN] == q[low * TOKEN : mid * TOKEN]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("children", "convs", "ends", "home", "least", "leaves", "length", "on_path", "part", "saved", "text", "waiting")

    def __init__(self, length: int, home: int, on_path: bool):
        self.length, self.home, self.on_path = length, home, on_path  # home: the range a skeleton node begins in, else -1
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.text, self.part = None, "", 0
        self.waiting = []  # finished children whose parent's smallest member isn't known yet


class _Shard:
    """Goes through the sorted paths of one shard and returns rows of ``_FOUND``."""

    def __init__(self, number: int, shape: np.ndarray, last: bytes):
        """``shape``: for each range the depth that its ends share, and that it shares with the next; ``last``: this shard's end."""
        inner, joints = shape
        self.number, self.last, self.path, self.stack, self.out = number, last, None, [], []
        self.left = int(joints[number - 1]) if number else -1
        self.right = int(joints[number])
        self.homes, a = [0] * (self.left + 1), number  # of the skeleton nodes on this shard's left edge
        for d in range(self.left, -1, -1):
            while a and joints[a - 1] >= d and (a == number or inner[a] >= d):
                a -= 1
            self.homes[d] = a

    def add(self, path: bytes, conv: int) -> None:
        first = self.path is None
        self._close(0 if first else _common(self.path, path) + 1)
        for d in range(len(self.stack), len(path) // TOKEN + 1):
            piece = path[(d - 1) * TOKEN : d * TOKEN] if d else b""
            above = self.stack[-1] if self.stack else None
            on_path = d <= self.right and (not d or above.on_path and self.last[(d - 1) * TOKEN : d * TOKEN] == piece)
            home = self.homes[d] if first and d <= self.left else self.number if on_path else -1
            self.stack.append(_Node(int.from_bytes(piece[16:], "big"), home, on_path))
        self.path, node = path, self.stack[-1]
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.home >= 0:
            node.text += f",{conv}"
            if len(node.text) >= PIECE:
                self._send_ends(node, len(self.stack) - 1)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(f",{conv}".encode())

    def end(self) -> None:
        self._close(0)

    def _send_ends(self, node: _Node, depth: int) -> None:
        self.out.append((_ENDS, node.home, depth, *[None] * 8, self.number, node.part, node.text))
        node.part, node.text = node.part + 1, ""

    def _close(self, depth: int) -> None:
        """Ends all nodes of this depth and below."""
        while len(self.stack) > depth:
            node, d = self.stack.pop(), len(self.stack)
            above = self.stack[-1] if self.stack else None
            if node.home >= 0:
                if node.text:
                    self._send_ends(node, d)
                own = (node.convs, node.children, node.leaves, node.saved, node.length)
                self.out.append((_PARTIAL, node.home, d, node.least, above.home if above else None, None, *own, None, None, None))
            else:
                node.leaves += not node.children
                node.saved += (node.convs - 1) * node.length
                for row in node.waiting:
                    self.out.append((*row[:5], node.least, *row[6:]))
                ends = node.ends.hexdigest() if node.ends else NOTHING
                own = (node.convs, node.children, node.leaves, node.saved, None, None, None, ends)
                # a parent in the skeleton is found by its home later; any other one ends in this shard and says its member then
                known = above is None or above.home >= 0
                row = (_WHOLE, None, d, node.least, above.home if above and known else None, None, *own)
                (self.out if known else above.waiting).append(row)
                if above:
                    above.children += 1
            if above:
                above.convs += node.convs
                above.leaves += node.leaves
                above.saved += node.saved
                above.least = node.least if above.least is None else min(above.least, node.least)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    fields = [pa.field(*(f.strip().split()[0], kinds[f.strip().split()[1]])) for f in _FOUND.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def _finished(shape: np.ndarray):
    """From rows (shard, end, path, conv_id) sorted by shard, each with the path at its end first: rows of ``_FOUND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                for number, end, path, conv in zip(*(c.slice(i, 1_000).to_pylist() for c in batch.columns), strict=True):
                    if end:
                        if shard:
                            shard.end()
                            if shard.out:
                                yield _batch(shard.out)
                        shard = _Shard(number, shape, path)
                        continue
                    shard.add(path, conv)
                    if len(shard.out) >= FLUSH:
                        yield _batch(shard.out)
                        shard.out = []
        if shard:
            shard.end()
            if shard.out:
                yield _batch(shard.out)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (home, depth, ends) sorted by node and place: the digest of each node's whole list, in constant memory."""
    at, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], ["home", "depth", "ends"]
        )

    for batch in batches:
        for home, depth, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (home, depth):
                if at:
                    yield done()
                at, digest, ends = (home, depth), hashlib.sha256(), ends[1:]
            digest.update(ends.encode())
    if at:
        yield done()


def _shape(shards: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The ranges' ends (shard, path), and two depths for each range: what its first and its last path have in common, and
    its last path and the first one after it (-1: there is none). Only numbers of ranges and depths come to the driver."""

    @F.arrow_udf("int")
    def shared(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array([_common(x.as_py(), y.as_py()) for x, y in zip(p, q, strict=True)], pa.int32())

    edges = written(shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")), "edges")
    inner = {r["shard"]: r["depth"] for r in edges.select("shard", shared("first", "last").alias("depth")).collect()}
    numbers = sorted(inner)
    follow = shards.sparkSession.createDataFrame([*zip(numbers[:-1], numbers[1:], strict=True)], "shard int, next int")
    pairs = edges.select("shard", "last").join(follow, "shard").join(edges.select(F.col("shard").alias("next"), "first"), "next")
    joints = {r["shard"]: r["depth"] for r in pairs.select("shard", shared("last", "first").alias("depth")).collect()}
    shape = np.full((2, numbers[-1] + 1 if numbers else 0), -1, np.int32)
    for n in range(shape.shape[1]):
        # a range without rows lies inside whatever reaches over the end before it
        shape[:, n] = (inner[n], joints.get(n, -1)) if n in inner else shape[1, n - 1] if n else -1
    return edges.select("shard", F.col("last").alias("path")), shape


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The trie of ``paths`` (conv_id, path), a row for each node.

    A node is a distinct sequence of tokens that some path begins with, the root the empty one. ``conv_id``: the smallest
    member; ``parent_conv_id``: that of the parent (root: null); ``n_convs``: members; ``n_leaves``: childless nodes of its
    subtree; ``saved_tokens``: over its subtree the sum of (members - 1) times the length of the last text; ``ends_sha256``:
    of the ids of paths that end here, ascending and joined by commas. Ids are distinct; no paths: no nodes.
    """
    spark = paths.sparkSession
    paths = written(paths, "paths")
    turns = paths.agg(F.sum(F.length("path"))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (turns or 0) // TOKEN // SHARD)
    ranged = paths.repartitionByRange(parts, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    shards = written(ranged, "shards")
    ends, shape = _shape(shards)
    rows = shards.select("shard", F.lit(False).alias("end"), "path", "conv_id")
    rows = rows.union(ends.select("shard", F.lit(True), "path", F.lit(None).cast("bigint")))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("end"), "path", "conv_id")
    with small_batches(spark):
        found = written(rows.mapInArrow(_finished(shape), _FOUND), "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = found.where(f"kind = {_WHOLE}").withColumnRenamed("ends", "ends_sha256")
    skeleton = written(_skeleton(found, shape), "skeleton")
    members = skeleton.select(F.col("home").alias("_h"), F.col("depth").alias("_d"), F.col("conv_id").alias("_c"))

    def with_parent(df: DataFrame) -> DataFrame:
        match = (F.col("parent_home") == F.col("_h")) & (F.col("depth") - 1 == F.col("_d"))
        return df.drop("parent_conv_id").join(members, match, "left").withColumnRenamed("_c", "parent_conv_id").select(columns)

    inner = whole.where("parent_home is null").select(columns)
    return inner.union(with_parent(whole.where("parent_home is not null"))).union(with_parent(skeleton))


def _skeleton(found: DataFrame, shape: np.ndarray) -> DataFrame:
    """The skeleton's nodes from the partial counts of the shards."""
    keys = ["home", "depth"]
    partial = found.where(f"kind = {_PARTIAL}").groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_home").alias("parent_home"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("length").alias("length"),
    )
    partial = written(partial, "partial")
    # children in the skeleton are in several shards, but begin in one
    below = partial.where("parent_home is not null").groupBy(F.col("parent_home").alias("home"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("outer"))
    own = partial.join(below, keys, "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    own = own.withColumn("own_saved", (F.col("n_convs") - 1) * F.col("length")).withColumn("own_leaf", (F.col("n_children") == 0).cast("bigint"))
    own = written(own, "own")
    totals = {r["home"]: (r["s"], r["l"]) for r in own.groupBy("home").agg(F.sum("own_saved").alias("s"), F.sum("own_leaf").alias("l")).collect()}
    inner, joints = shape
    sums = np.zeros((len(joints) + 1, 2), np.int64)  # before each range
    for i in range(len(joints)):
        sums[i + 1] = sums[i] + totals.get(i, (0, 0))

    @F.arrow_udf("struct<saved:bigint,leaves:bigint>")
    def over_ranges(home: pa.Array, depth: pa.Array) -> pa.Array:
        """What begins in the ranges from ``home`` to the last one whose end the node reaches over."""
        out = []
        for a, d in zip(home.to_pylist(), depth.to_pylist(), strict=True):
            # it ends at the first range whose end it doesn't reach over, or that isn't all its own
            end = a + 1 + int(np.argmax((joints[a + 1 :] < d) | (inner[a + 1 :] < d)))
            out.append(sums[end] - sums[a])
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["saved", "leaves"])

    before = Window.partitionBy("home").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before_saved, before_leaf = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("own_saved", "own_leaf"))
    own = own.withColumn("_s", before_saved).withColumn("_l", before_leaf).withColumn("_t", over_ranges("home", "depth"))
    own = own.withColumn("n_leaves", F.col("leaves") + F.col("_t.leaves") - F.col("_l"))
    own = own.withColumn("saved_tokens", F.col("saved") + F.col("_t.saved") - F.col("_s"))
    # SHA-256 reads its input in order: a node's list passes one task, piece by piece
    pieces = found.where(f"kind = {_ENDS}").select(*keys, "shard", "part", "ends").repartition(*keys)
    lists = pieces.sortWithinPartitions(*keys, "shard", "part").select(*keys, "ends").mapInArrow(_digests, "home int, depth bigint, ends string")
    own = own.join(lists, keys, "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING)))
    return own.select(*keys, "conv_id", "parent_home", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
