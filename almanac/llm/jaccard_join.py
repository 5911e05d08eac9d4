"""N-gram Jaccard join: small sets meet in fixed-size subsets, large ones in inverted lists of their rarest shingles.

Two sets with ``100 * intersection >= 75 * union`` have sizes within a quarter of each other, and ``required(n, m)``
shingles in common. All sets share one order of shingles: those that are frequent come last, the rest by hash.

* **Large sets.** Of two linked sets, the first ``n - ceil(3 n / 4) + l`` shingles of each (its prefix) have l in
  common, so the inverted lists of prefixes hold every link. With l growing with the size, a set with fewer than l lists
  that another set is in can't have a link, and is left out before anything is compared.
* **Small sets.** The smaller of two linked sets has n shingles and shares ``c = required(n, n)`` of them with the other.
  Each set of m shingles lists its subsets of size c for every n from ``ceil(3 m / 4)`` to m; equal subsets meet.
* **The boundary** is the size x with the least cost: subsets listed by sets up to x, and list entries read by sets
  beyond. Sets just below x are in both, since a set above x may link with them.

Lists of the same sets, such as those of a passage that some texts share, are one list with a weight. Lists aren't
expanded into pairs while that can be avoided. In a few rounds every set is compared with one set of another component
from one of its lists, chosen by an order that all lists share; a group of near copies becomes one component after
comparisons in proportion to its size. Sets that are in fewer than l lists with sets of other components drop out after
each round. Then every pair of two components that still has l lists in common is compared, so no link is lost, whatever
the rounds found; the join of the lists compares sketches, so only pairs that may link become rows, and those that
share one of their longest lists become one row.
"""

import gc
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.llm.common import small_batches, utf8
from almanac.session import shared_dir, written

SIZE = 5
PERCENT = 75
FREQUENT = 200_000  # shingles that the order knows to be frequent; what it knows never changes results
LARGEST_SUBSETS = 14  # the boundary is at most here: above, a set has thousands of subsets
ROUNDS = 8
PAIRS = 256  # where lists have so many pairs an entry at most, their sketches are all compared, and no further round is made
FLUSH = 1_000_000  # shingles that are counted together in one task
WORDS = 150_000  # words whose hashes a task remembers
SALTS = 64  # a frequent shingle's list is dealt over so many tasks
BITMAP = 1 << 22
LONGEST = 32  # two sets that share one of their so many longest lists are a row of one list only
SKETCH = 1024  # bits of a set's sketch
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def least_partner(n: int, percent: int = PERCENT) -> int:
    """The smallest size that can link with a set of n."""
    return -(-percent * n // 100)


def required(n: int, m: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def least_shared(n: int) -> int:
    """How many shingles of their prefixes linked sets have in common at least, by the size of the smaller one."""
    return max(1, n // 20)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - least_partner(n, percent) + least_shared(n)


def subset_sizes(m: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a small set of m lists, one for each size of the smaller partner."""
    return sorted({required(n, n, percent) for n in range(max(1, least_partner(m, percent)), m + 1)})


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _folded(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k."""
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = _mixed((total ^ h[i : i + len(total)]) + _A)
    return total


class _Places(dict):
    """A number for each word met, and the word's hash at that place."""

    def __init__(self):
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n


class Shingler:
    """The shingles of texts, as sorted distinct 64-bit hashes. Words are parted by ASCII white space."""

    def __init__(self, size: int = SIZE):
        self.size, self.places = size, _Places()

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.places) > WORDS:
            self.places = _Places()
        words = [utf8(t).lower().split() for t in texts]
        lengths = list(map(len, words))
        at = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(words)), np.int64, sum(lengths))
        h, k, out, start = self.places.hashes[at], self.size, [], 0
        runs = _folded(h, k) if len(h) >= k else h[:0]
        for n in lengths:
            if n >= k:
                some = np.sort(runs[start : start + n - k + 1])
                out.append(some[np.concatenate(([True], some[1:] != some[:-1]))])
            else:
                out.append(_folded(h[start : start + n], n) if n else h[:0])
            start += n
        return out


def shingled(column: pa.Array, shingler: Shingler, step: int = 100) -> Iterator[np.ndarray]:
    for i in range(0, len(column), step):
        yield from shingler(column.slice(i, step).to_pylist())


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit. Sketches differ in at most as many bits as sets in shingles."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def keys_of(shingles: np.ndarray, boundary: int, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Lists that a set is in: hash and whether it is a frequent shingle's. ``frequent`` is sorted."""
    m, out, hot = len(shingles), [], []
    if m and m >= least_partner(boundary + 1, percent):
        wanted = prefix_length(m, percent)
        for some in (shingles[: 2 * wanted], shingles):  # most often the first ones have enough that are rare
            at = np.minimum(np.searchsorted(frequent, some), max(0, len(frequent) - 1))
            common = frequent[at] == some if len(frequent) else np.zeros(len(some), bool)
            if len(some) - common.sum() >= wanted:
                break
        first = np.argsort(common, kind="stable")[:wanted]  # rare ones first, and each kind by hash
        out.append(shingles[first])
        hot.append(common[first])
    if 0 < m <= boundary:
        for c in subset_sizes(m, percent):
            rows = np.array(list(itertools.combinations(range(m), c)))
            total = np.full(len(rows), c, np.uint64)
            for i in range(c):
                total = _mixed((total ^ shingles[rows[:, i]]) + _C)
            out.append(total)
            hot.append(np.zeros(len(rows), bool))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, bool)
    return np.concatenate(out), np.concatenate(hot)


def _survey(size: int, percent: int):
    """Counts of repeated shingles, and for small sizes how many sets there are and how long their lists."""

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets, n = Shingler(size), [], 0

        def flushed() -> pa.RecordBatch:
            every, counts = np.unique(np.concatenate(sets), return_counts=True)
            small: dict[int, list[int]] = {}
            for s in sets:
                if 0 < len(s) <= LARGEST_SUBSETS:
                    seen = np.sort(counts[np.searchsorted(every, s)])[: prefix_length(len(s), percent)]
                    row = small.setdefault(len(s), [0, 0])
                    row[0] += 1
                    row[1] += int(seen.sum())
            keep = counts > 2
            kinds = [0] * int(keep.sum()) + [1] * len(small)
            return pa.RecordBatch.from_arrays([
                pa.array(kinds, pa.int32()),
                pa.array(np.concatenate([every[keep].view(np.int64), np.array(list(small), np.int64)])),
                pa.array(np.concatenate([counts[keep], np.array([v[0] for v in small.values()], np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([np.zeros(int(keep.sum()), np.int64), np.array([v[1] for v in small.values()], np.int64)])),
            ], ["kind", "key", "n", "cost"])

        for batch in batches:
            for s in shingled(batch.column(0), shingler):
                sets.append(s)
                n += len(s)
                if n >= FLUSH:
                    yield flushed()
                    sets, n = [], 0
        if n:
            yield flushed()

    return surveyed


def boundary_of(small: dict[int, tuple[int, int]], percent: int = PERCENT) -> int:
    """The size up to which subsets are listed: the least sum of subsets listed and list entries read."""
    subsets = {m: sum(math.comb(m, c) for c in subset_sizes(m, percent)) for m in small}

    def cost(x: int) -> int:
        light = sum(n * subsets[m] for m, (n, _) in small.items() if m <= x)
        return light + sum(read for m, (_, read) in small.items() if m >= least_partner(x + 1, percent))

    return min(range(LARGEST_SUBSETS + 1), key=lambda x: (cost(x), x))


def _listing(size: int, percent: int, boundary: int, shared):
    """For each row its set's size and 128-bit digest, and the set's keys where the task meets it first."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, frequent, seen = Shingler(size), shared.value, set()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                n, a, b, keys, hot = [], [], [], [], []
                for s in shingled(part.column(1), shingler):
                    d = _digest(s)
                    n.append(len(s))
                    a.append(d[0])
                    b.append(d[1])
                    if d in seen:
                        keys.append(None)
                        hot.append(None)
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(d)
                    k, h = keys_of(s, boundary, frequent, percent)
                    keys.append(k[~h].tobytes())
                    hot.append(k[h].tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                    pa.array(keys, pa.binary()), pa.array(hot, pa.binary()),
                ], ["id", "n", "a", "b", "keys", "hot"])

    return listed


def _dealt(buckets: int):
    """Entries of lists, 16 bytes each, dealt by key into buckets; those of frequent keys by key and set."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).to_numpy().view(np.uint64)
            for hot in (0, 1):
                blobs = batch.column(1 + hot).to_pylist()
                keys = np.frombuffer(b"".join(blobs), np.uint64)
                if not len(keys):
                    continue
                sets = np.repeat(a, [len(x) // 8 for x in blobs])
                bucket = (keys if not hot else _mixed(keys ^ sets % np.uint64(SALTS) + _A)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, both = bucket[order], np.stack([keys[order], sets[order]], axis=1)
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(np.full(len(edge) - 1, hot, np.int32)),
                    pa.array([both[i:j].tobytes() for i, j in itertools.pairwise(edge)], pa.binary()),
                ], ["bucket", "hot", "entries"])

    return dealt


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: each entry once, without keys that only one set has; frequent keys stay."""

    def done(hot: int, blobs: list[bytes]) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        both = both[np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1)))]
        new = np.concatenate(([True], both[1:, 0] != both[:-1, 0]))
        if not hot:
            of = np.cumsum(new) - 1
            both = both[(np.bincount(of) > 1)[of]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "a"])

    at, blobs = None, []
    for batch in batches:
        for bucket, hot, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (bucket, hot) and blobs:
                yield done(at[1], blobs)
                blobs = []
            at = (bucket, hot)
            blobs.append(entries)
    if blobs:
        yield done(at[1], blobs)


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps, which otherwise stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (u, v) is connected with.

    Alternating large-star and small-star steps. Each is a minimum per node, combined before the shuffle, and a join.
    After ``steps`` of both, if given, the label is a smaller node that the node is connected with, not always the smallest,
    and nodes without one are left out.
    """
    edges = written(edges.where("u != v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges")
    before = None
    for step in itertools.count(1):
        both = edges.union(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(v u, m v), struct(u u, m v)))").where("u != v")
        if step == steps:
            return small.selectExpr("greatest(u, v) u", "least(u, v) v").groupBy("u").agg(F.min("v")).toDF("node", "label")
        edges = written(small.selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges")
        # the graph has settled when a step leaves its edges as they were
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.selectExpr("u node", "v label").union(edges.selectExpr("v node", "v label").distinct())
        before = now


def _filter_of(keys: DataFrame, name: str):
    """A broadcast bitmap of the places that the hashes of column ``name`` fall on, eight to a byte."""
    places = keys.select(F.pmod(F.xxhash64(name), F.lit(BITMAP)).alias("p")).distinct().toArrow()
    bits = np.zeros(BITMAP, bool)  # of fixed size; where it fills up it filters less and the join does the rest
    bits[places["p"].to_numpy()] = True
    return keys.sparkSession.sparkContext.broadcast(np.packbits(bits))


def _sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(a, n, s, h): size, sketch and shingles of the sets in ``wanted`` (a, id), each read from one document.

    The document is found by its id. Sets whose rows all have no id are found by their digest among the rows without.
    """

    def maybe(shared):
        @F.arrow_udf("boolean")
        def on(place: pa.Array) -> pa.Array:
            p = place.to_numpy()
            return pa.array((shared.value[p >> 3] >> (7 - (p & 7)) & 1).astype(bool))

        return on

    def lists_of(rows: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def packed(sets: list[np.ndarray]) -> pa.Array:
        a = pa.array([_digest(s)[0] for s in sets], pa.int64())
        return pa.StructArray.from_arrays([a, lists_of([sketch(s) for s in sets]), lists_of(sets)], ["a", "s", "h"])

    @F.arrow_udf("struct<a:bigint,s:array<bigint>,h:array<bigint>>")
    def sets_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(size)
        for texts in batches:
            parts = [packed(list(shingled(texts.slice(i, 500), shingler))) for i in range(0, len(texts), 500)]
            yield pa.concat_arrays(parts) if parts else packed([])

    place = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    named = wanted.where("id is not null")
    there = docs.where("id is not null").where(maybe(_filter_of(named, "id"))(place))
    found = there.join(named, "id").select("a", sets_of("text").alias("s"))
    # of rows that share an id the one with the wanted set counts
    found = found.where("a = s.a").select("a", "s.s", "s.h")
    nameless = wanted.where("id is null").select("a")
    if not nameless.isEmpty():
        digests = docs.where("id is null").select(_set_id(size)(F.col("text")).alias("a"), "text").where("a is not null")
        digests = digests.where(maybe(_filter_of(nameless, "a"))(F.pmod(F.xxhash64("a"), F.lit(BITMAP))))
        # equal sets have the same shingles, so one text of each is enough; only texts of wanted sets travel
        texts = digests.join(nameless, "a").groupBy("a").agg(F.min("text").alias("text"))
        found = found.union(texts.select("a", sets_of("text").alias("s")).select("a", "s.s", "s.h"))
    return found.select("a", F.size("h").alias("n"), "s", "h").dropDuplicates(["a"])


def _near(percent: int):
    """Whether sketches x and y of sets of un and vn shingles allow a link, see ``required``."""
    differ = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(SKETCH // 64))
    return F.expr(f"{differ} <= un + vn - 2 * (({percent} * (un + vn) + {99 + percent}) div {100 + percent})")


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches allow a link."""
    brief = sets.select("a", "n", "s")
    there = pairs.join(brief.selectExpr("a u", "n un", "s x"), "u").join(brief.selectExpr("a v", "n vn", "s y"), "v")
    return there.where(_near(percent)).select("u", "v")


def _linked(close: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link."""
    both = F.size(F.array_intersect("x", "y"))
    return (
        close.join(sets.selectExpr("a u", "h x"), "u")
        .join(sets.selectExpr("a v", "h y"), "v")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("u", "v")
    )


def _merged(lists: DataFrame) -> DataFrame:
    """(key, a, n, w): of the lists with the same sets one, and how many there are; lists of one set go.

    Lists count as the same by 128 bits of hashes of their sets and by their lengths.
    """
    prints = lists.groupBy("key").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("a", F.lit(2))).alias("y")
    )
    one = prints.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("w"))
    return lists.join(one.select("key", "w"), "key").select("key", "a", "n", "w")


def _needed(percent: int):
    """How many lists a set of n shingles has in common with one that it links with, at least, see ``least_shared``."""
    return F.expr(f"greatest(1, (({percent} * n + 99) div 100) div 20)")


def _hopeful(lists: DataFrame, percent: int) -> DataFrame:
    """Entries of sets that are in as many lists as a link needs; the smaller of two linked sets may be of the least size."""
    own = (F.sum("w") if "w" in lists.columns else F.count("*")).over(Window.partitionBy("a"))  # a set has as many entries as its prefix is long, at most
    return lists.withColumn("_own", own).where(F.col("_own") >= _needed(percent)).drop("_own")


def _met(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of different labels that have enough lists in common for a link, and whose sketches allow one.

    Lists have one order, the long ones last. The first list that two linked sets share is followed, in either, by all
    others that they share, so entries with less weight from there on than a link needs are left out. Where two sets
    share some of their longest lists, in which most pairs are, the pair is made in one of these, otherwise in all.
    """
    fits, key = _compatible(percent), F.struct("c", "key")
    there = lists.select("key", "a", "n", "w", "label").join(lists.groupBy("key").agg(F.count("*").alias("c")), "key")
    after = F.sum("w").over(Window.partitionBy("a").orderBy(F.desc("c"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0))
    there = written(there.withColumn("_after", after).where(F.col("_after") >= _needed(percent)), "entries")
    # a set has as many lists as its prefix is long, at most
    longest = F.slice(F.sort_array(F.collect_list(key), asc=False), 1, LONGEST)
    longest = there.groupBy("a").agg(F.transform(longest, lambda x: x["key"]).alias("f"))
    ours = there.join(longest.join(sets.select("a", "s"), "a"), "a")
    pairs = ours.selectExpr("key", "a u", "n un", "label ul", "f uf", "s x").join(ours.selectExpr("key", "a v", "n vn", "label vl", "f vf", "s y"), "key")
    pairs = pairs.where("ul < vl").where(fits("un", "vn")).where(_near(percent))
    return pairs.where("coalesce(get(array_intersect(uf, vf), 0), key) = key").select("u", "v").distinct()


def _compatible(percent: int) -> Callable[[str, str], object]:
    return lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_id, label, component_id) for every row of ``docs``.

    ``set_id`` is the digest of the row's shingles, ``label`` the component of that set; ``component_id`` is the smallest
    id of the component's rows. Equal sets are one set, however often they occur.

    Words are parted by ASCII white space after lower-casing A-Z. A text of fewer than ``size`` words is one shingle; null
    and empty texts have none, link with nothing, and have their own id as component. Rows without id are linked like
    others, but never give a component its id: it is null if none of its rows has one. Repeated rows are exact copies.
    No rows: an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    survey = docs.select("text").mapInArrow(_survey(size, percent), "kind int, key bigint, n bigint, cost bigint")
    with small_batches(spark):
        survey = written(survey.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")), "survey")
    top = survey.where("kind = 0").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    frequent = np.sort(top["key"].to_numpy().view(np.uint64)) if top.num_rows else np.empty(0, np.uint64)
    small = {r["key"]: (r["n"], r["cost"]) for r in survey.where("kind = 1").collect()}  # one row for each small size
    shared = spark.sparkContext.broadcast(frequent)
    listing = _listing(size, percent, boundary_of(small, percent), shared)
    schema = f"id {kind}, n bigint, a bigint, b bigint, keys binary, hot binary"
    path = shared_dir(spark, "keys")
    with small_batches(spark):
        docs.mapInArrow(listing, schema).write.parquet(path)
    keys = spark.read.schema(schema).parquet(path)
    rows = written(keys.select("id", "n", "a", "b"), "sets")
    sets = rows.where("n > 0").groupBy("a").agg(
        F.min("id").alias("id"), F.min("b").alias("b"), F.max("b").alias("b2"), F.max("n").alias("n")
    )
    sets = written(sets, "distinct")
    if sets.where("b != b2").limit(1).count():
        raise ValueError("two sets have the same 64-bit digest")
    buckets = 1 << max(10, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    lists = (
        keys.where("keys is not null and n > 0").select("a", "keys", "hot")
        .mapInArrow(_dealt(buckets), "bucket int, hot int, entries binary")
        .repartition("bucket", "hot")
        .sortWithinPartitions("bucket", "hot")
        .mapInArrow(_repeated, "key bigint, a bigint")
    )
    lists = written(lists, "entries")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)  # the lists have them now
    _release(spark)
    lists = written(_hopeful(lists.join(sets.select("a", "n"), "a"), percent).select("key", "a", "n"), "lists")
    lists = written(_hopeful(_merged(lists), percent), "merged")
    labels = written(_joined(docs, lists, sets, size, percent), "labels")
    ids = sets.join(labels, sets.a == labels.node, "left").select("a", F.coalesce("label", "a").alias("label"), "id")
    least = ids.groupBy("label").agg(F.min("id").alias("component_id"))
    found = ids.select("a", "label").join(least, "label")
    own = rows.select("id", F.col("n").alias("n_shingles"), "a")
    return own.join(found, "a", "left").select(
        "id", "n_shingles", F.col("a").alias("set_id"), "label",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def _joined(docs: DataFrame, lists: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) for every set that links with another one."""
    fits = _compatible(percent)
    wanted = lists.select("a").distinct().join(sets.select("a", "id"), "a")
    spark = docs.sparkSession
    with small_batches(spark):
        shingles = written(_sets(docs, size, wanted), "shingles")
    labels, known = spark.createDataFrame([], "node bigint, label bigint"), None
    for turn in range(ROUNDS + 1):
        now = lists.select("key", "a", "n", "w").join(labels.withColumnRenamed("node", "a"), "a", "left")
        now = now.withColumn("label", F.coalesce("label", "a"))
        # two sets of different components, the same in all lists that have them
        order = F.struct(F.xxhash64("label", F.lit(turn)), F.xxhash64("a", F.lit(turn)), "label", "a", "n")
        chosen = now.groupBy("key").agg(F.min(order).alias("p"), F.max(order).alias("q")).where("p.label != q.label")
        brief = [F.struct(*(F.col(f"{x}.{f}") for f in ("label", "a", "n"))).alias(x) for x in "pq"]
        # all lists that two sets of different components share are still open, so a set in too few of them is done
        lists = written(_hopeful(now.join(chosen.select("key", *brief), "key"), percent), "open")
        _release(spark)
        groups = lists.groupBy("key", "label").count().groupBy("key")
        pairs = groups.agg(F.sum("count").alias("all"), F.sum(F.col("count") ** 2).alias("own"))
        entries, left = pairs.agg(F.sum("all"), F.sum(F.col("all") ** 2 - F.col("own"))).first()
        if not entries:
            break
        last = turn == ROUNDS or turn and left <= PAIRS * entries
        if not last:
            other = F.when(F.col("label") != F.col("p.label"), F.col("p")).otherwise(F.col("q"))
            pairs = lists.select("a", "n", "w", other.alias("o")).where(fits("n", "o.n")).groupBy("a", "o").agg(F.sum("w").alias("count"))
            # of the sets that its lists chose, the one that most of them did
            pairs = pairs.groupBy("a").agg(F.max(F.struct("count", "o")).alias("best"))
            pairs = pairs.selectExpr("least(a, best.o.a) u", "greatest(a, best.o.a) v").distinct()
            close = _close(pairs, shingles, percent)
        else:
            close = _met(lists, shingles, percent)
        links = written(_linked(written(close, "close"), shingles, percent), "links")
        _release(spark)
        if not links.isEmpty():
            known = links if known is None else known.union(links)
            if not last:  # any label of the same component will do until the end
                labels = written(components(known, steps=1), "some")
        if last:
            break
    return components(known) if known is not None else labels


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest ``doc_id``, with its own columns; rows without words stay."""
    found = written(classes(docs, size, percent), "classes")
    group = F.when(F.col("n_shingles") > 0, F.col("label"))
    rows = docs.withColumn("_own", F.struct(*docs.columns)).select("_own")
    first = found.where("n_shingles > 0").groupBy("label").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    # over all rows, those of other components and those without words too: an id that goes must not take another text with it
    repeated = found.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if not repeated:  # ids tell rows apart: the rows to go are known by id
        gone = found.where(group.isNotNull() & (F.col("id") != F.col("component_id"))).select("id").distinct()
        return rows.join(gone, F.col("_own.doc_id") == F.col("id"), "left_anti").select("_own.*")
    # rows without id, or with a repeated one, are told apart by their set
    digest = _set_id(size)
    keyed = rows.withColumn("_a", digest(F.col("_own.text")))
    best = first.join(found.select("label", "set_id", "id").distinct(), "label").where(F.col("first").eqNullSafe(F.col("id")))
    best = best.groupBy("label", "first").agg(F.min("set_id").alias("set_id")).select("set_id", "first")
    kept = keyed.join(best, (F.col("_a") == F.col("set_id")) & F.col("_own.doc_id").eqNullSafe(F.col("first")))
    kept = kept.dropDuplicates(["_a"]).select("_own.*")
    return kept.union(keyed.where(F.col("_a").isNull()).select("_own.*"))


def _set_id(size: int):
    """The digest of a text's shingles as ``classes`` has it; null without words."""

    @F.arrow_udf("bigint")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(size)
        for texts in batches:
            yield pa.array([_digest(s)[0] if len(s) else None for s in shingled(texts, shingler)], pa.int64())

    return digest
