"""Exact top-k search by inner product: a Voronoi kNN join."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.session import written

PIVOTS = 256
GROUPS = 64  # at most so many groups of queries: a vector is copied at most so often
QUERIES = 1_024  # queries of a group, about, while there are fewer than GROUPS groups
SLICE = 20_000  # vectors that one task compares with a group's queries, about
_CELL = "struct<cell:int,distance:double>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): every component x as floor(256 x). Rows without id, null vectors, and vectors with a null or non-finite
    component are left out."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).select("id", F.transform("x", lambda c: F.floor(256 * c)).cast("array<bigint>").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros, which change no inner product."""
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _lifted(m: np.ndarray, top: float, query: bool) -> np.ndarray:
    """One more dimension makes the order by inner product the order by distance: all data get the same length."""
    m = m.astype(np.float64)
    extra = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, top - (m * m).sum(axis=1)))
    return np.hstack([m, extra[:, None]])


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))


def bounds(pivots: np.ndarray, group: np.ndarray, reach: np.ndarray, nearest: list[np.ndarray], wanted: int) -> np.ndarray:
    """(groups, cells): the least distance from its pivot at which a vector of a cell may be needed by a group.

    ``group`` has each cell's query group or -1, ``reach`` the largest distance of a query from its cell's pivot, and
    ``nearest`` the ``wanted`` smallest distances of a cell's data. With the triangle inequality, ``wanted`` vectors
    are within theta of every query of a cell; beyond theta a vector can't be among them.
    """
    between = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)))
    out = np.full((int(group.max(initial=-1)) + 1, len(pivots)), np.inf)
    for i in np.flatnonzero(group >= 0):
        upper = np.sort(np.concatenate([reach[i] + between[i, j] + d for j, d in enumerate(nearest)] or [[]]))
        theta = upper[wanted - 1] if len(upper) >= wanted else np.inf
        slack = 1e-9 * (1 + between[i].max() + reach[i] + (theta if np.isfinite(theta) else 0))
        out[group[i]] = np.minimum(out[group[i]], between[i] - reach[i] - theta - slack)
    return out


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can lose a digit, else in 64-bit integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q @ d.T


def _best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each query its k best rows of other ids: score down, id up."""
    rows, cols, found = [], [], []
    for i in range(0, len(q), 256):
        s = _scores(q[i : i + 256], d)
        for r in range(len(s)):
            other = np.flatnonzero(ids != qid[i + r])
            if len(other) > k:
                least = np.partition(s[r, other], len(other) - k)[len(other) - k]
                other = other[s[r, other] >= least]
            other = other[np.lexsort((ids[other], -s[r, other]))[:k]]
            rows.append(np.full(len(other), qid[i + r]))
            cols.append(ids[other])
            found.append(s[r, other])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, cols, found))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, groups: int = GROUPS, slice_rows: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` (id, v) the k rows of ``vectors`` (id, v) with the
    largest inner product and another id; of equal scores the smaller id comes first. All rows if there are fewer.

    Vectors get one more dimension, so that larger products are smaller distances. Pivots, ``pivots`` vectors with the
    smallest hashes, part the space into cells. From each cell's summary (its radius, its queries' reach, the k + 1
    smallest distances) follows how far from its pivot a vector must be for a group of cells to need it; it is copied
    to those groups only. A group's vectors are dealt over slices by a hash, in proportion to their number, so neither
    a dense cell nor many equal vectors meet in one task; every slice gets the group's queries and returns k rows each.

    Vectors of different lengths are compared as if the shorter one ended in zeros. A candidate that repeats counts
    each time; a query id that repeats is one query, with its smallest vector. No queries or no candidates: no rows.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select("id", "v"), "vectors")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    width, top, there = vectors.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not there:
        return spark.createDataFrame([], schema)
    width = max(width, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    chosen = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).select("v").toArrow()
    centre = np.unique(_lifted(_matrix(chosen["v"].combine_chunks(), width), top, False), axis=0)
    shared = spark.sparkContext.broadcast(centre)  # pivots x width numbers

    def celled(query: bool):
        @F.arrow_udf(_CELL)
        def cell(v: pa.Array) -> pa.Array:
            c, d = _nearest(_lifted(_matrix(v, width), top, query), shared.value)
            return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)), pa.array(d)], ["cell", "distance"])

        return cell("v").alias("c")

    queries = written(queries.select("id", "v", celled(True)), "queries")
    placed = written(vectors.select("id", "v", celled(False)), "placed")
    reach = {r[0]: (r[1], r[2]) for r in queries.groupBy("c.cell").agg(F.max("c.distance"), F.count("*")).collect()}
    if not reach:
        return spark.createDataFrame([], schema)
    near = placed.select("c.*").withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("distance")))
    near = near.where(F.col("r") <= k + 1).collect()  # at most k + 1 numbers for each pivot
    nearest = [np.array([r["distance"] for r in near if r["cell"] == j]) for j in range(len(centre))]
    # cells with queries go into groups of neighbours: along the line through the first pivot's distances
    cells = sorted(reach, key=lambda c: float(((centre[c] - centre[0]) ** 2).sum()))
    group = np.full(len(centre), -1)
    parts = min(groups, len(cells), math.ceil(sum(n for _, n in reach.values()) / QUERIES))
    group[cells] = np.arange(len(cells)) * parts // len(cells)
    need = bounds(centre, group, np.array([reach.get(c, (0.0, 0))[0] for c in range(len(centre))]), nearest, k + 1)
    limits = spark.sparkContext.broadcast(need)  # groups x pivots numbers

    @F.arrow_udf("array<int>")
    def wanted(c: pa.Array) -> pa.Array:
        cell, distance = (c.field(i).to_numpy() for i in (0, 1))
        return pa.array([np.flatnonzero(limits.value[:, j] <= d).astype(np.int32) for j, d in zip(cell, distance, strict=True)], pa.list_(pa.int32()))

    copies = placed.select("id", "v", F.explode(wanted("c")).alias("g"))
    sizes = {r[0]: r[1] for r in copies.groupBy("g").count().collect()}  # a row for each group
    slices = F.create_map(*[F.lit(x) for g, n in sorted(sizes.items()) for x in (g, math.ceil(n / slice_rows))])
    of_cell = F.create_map(*[F.lit(x) for c in cells for x in (int(c), int(group[c]))])
    copies = copies.select("g", F.pmod(F.xxhash64("id", "v"), slices[F.col("g")]).alias("s"), "id", "v", F.lit(False).alias("q"))
    asked = queries.select("id", "v", of_cell[F.col("c.cell")].alias("g")).where(slices[F.col("g")].isNotNull())
    asked = asked.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), slices[F.col("g")].cast("bigint") - 1)).alias("s"), "id", "v", F.lit(True).alias("q"))

    def solved(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # one slice and its group's queries
        ids, v = rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks(), width)
        q = rows["q"].to_numpy()
        found = _best(ids[q], v[q], ids[~q], v[~q], k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    parts = copies.union(asked).groupBy("g", "s").applyInArrow(solved, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
