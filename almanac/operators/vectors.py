"""Nearest vectors for whole tables of queries, exact and by inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from almanac.functions.vectors import cosine_distance, nearest, unit_rows
from almanac.operators.blocks import block_pairs
from almanac.operators.ordering import top_n_per_key
from almanac.session import written

K = 5  # fixed value: hits per question
TARGET = 0.98  # share of the nearest vectors of sampled queries that probes and shortlists are set to reach, each
TRIED = 256  # sampled queries
SAMPLE = 50_000  # vectors that centres and code words are fitted on, at most about
WORDS = 64  # code words of a piece

# Queries are sent to every task only up to this many numbers (32 MB as doubles).
BROADCAST_NUMBERS = 4_000_000
QUERY_BLOCK = 2_048
CORPUS_BLOCK = 16_384
_HITS = "query_id long, vec_id long, distance double"


def _hits(query_ids: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, distance.shape[1]),
            "vec_id": ids.ravel(),
            "distance": distance.ravel(),
        }
    )


def _score(k: int):
    """Best k of a corpus block for every query of a query block."""

    def score(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or corpus.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype(
                {"query_id": "int64", "vec_id": "int64"}
            )
        distance = 1.0 - unit_rows(queries["embedding"]) @ unit_rows(corpus["embedding"]).T
        best, ids = nearest(distance, corpus["vec_id"].to_numpy(), k)
        return _hits(queries["query_id"].to_numpy(), best, ids)

    return score


def _scan_corpus(rows: list, corpus: DataFrame, k: int) -> DataFrame:
    """Few queries: every task scans its part of the corpus and keeps k per query."""
    query_ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
    shared = corpus.sparkSession.sparkContext.broadcast((query_ids, unit_rows([r["embedding"] for r in rows])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = shared.value
        best = np.empty((len(ids), 0))
        found = np.empty((len(ids), 0), dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            distance = 1.0 - queries @ unit_rows(batch["embedding"]).T
            here = np.broadcast_to(batch["vec_id"].to_numpy(), distance.shape)
            best, found = nearest(np.hstack([best, distance]), np.hstack([found, here]), k)
        if best.shape[1]:
            yield _hits(ids, best, found)

    return corpus.select("vec_id", "embedding").mapInPandas(scan, _HITS)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    best = top_n_per_key(candidates, ["query_id"], [F.col("distance"), F.col("vec_id")], k, "position")
    return best.select("query_id", "position", "vec_id", "distance")


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int = K, broadcast_numbers: int = BROADCAST_NUMBERS
) -> DataFrame:
    """The k nearest corpus vectors by cosine distance, for every query.

    ``queries`` has ``query_id, embedding``, ``corpus`` has ``vec_id,
    embedding``. A query table counted as small goes to every task; any other
    is met block by block.
    """
    queries, corpus = queries.select("query_id", "embedding"), corpus.select("vec_id", "embedding")
    size = queries.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    if size <= broadcast_numbers:
        candidates = _scan_corpus(queries.collect(), corpus, k)
    else:
        candidates = block_pairs(
            queries, corpus, "query_id", "vec_id", QUERY_BLOCK, CORPUS_BLOCK, _score(k), _HITS
        )
    return _ranked(candidates, k)


@dataclass
class Index:
    """Inverted lists of unit vectors, and codes of what is left of a vector beside its list's centre."""

    centres: np.ndarray  # (lists, width)
    words: np.ndarray  # (pieces, words, width of a piece)
    rows: DataFrame  # vec_id, embedding, list_id, code
    sizes: np.ndarray  # vectors of each list
    probes: int  # lists that a query looks at, and vectors that codes pick for the exact comparison
    shortlist: int


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1) - 2 * points @ centres.T
    return square.argmin(axis=1)


def _means(points: np.ndarray, k: int, seed: int, steps: int = 15) -> np.ndarray:
    """Centres of at most ``k`` groups of the points; a centre without points keeps its place."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(steps):
        of = _near(points, centres)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _pieces(width: int) -> int:
    """Into how many pieces a vector is cut for its code: of eight numbers, or of as many as divide it."""
    return next(p for p in (width // 8, width // 4, width // 2, width, 1) if p and width % p == 0)


def _settings(fitted: np.ndarray, centres: np.ndarray, words: np.ndarray, n: int, k: int) -> tuple[int, int]:
    """How many lists and how long a shortlist it takes to find most neighbours of some sampled vectors among the sample."""
    tried = fitted[:: max(1, len(fitted) // TRIED)][:TRIED]
    of = _near(fitted, centres)
    cut = (fitted - centres[of]).reshape(len(fitted), len(words), -1)
    coded = centres[of] + np.concatenate([words[p][_near(cut[:, p], words[p])] for p in range(len(words))], axis=1)
    order = np.argsort((centres**2).sum(axis=1) - 2 * tried @ centres.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list among a query's
    lists, ranks = [], []
    for i, q in enumerate(tried):
        near = np.argsort(-(fitted @ q), kind="stable")[: k + 1]
        by_code = np.argsort(np.argsort(-(coded @ q), kind="stable"))
        lists += place[i, of[near]].tolist()
        ranks += by_code[near].tolist()
    return int(np.quantile(lists, TARGET)) + 1, max(k, math.ceil((np.quantile(ranks, TARGET) + 1) * n / len(fitted)))


def build_index(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7, k: int = K) -> Index:
    """An index of all rows of ``corpus`` (vec_id, embedding), about sqrt(rows) lists unless told otherwise.

    Centres and code words are fitted on at most about ``sample`` vectors, chosen by a hash of their id; every vector
    is then put into the list of its nearest centre, once. How many lists and codes a query of ``k`` looks at is set from the
    neighbours of sampled vectors. Vectors without length are in the first list.
    """
    corpus = corpus.select("vec_id", "embedding")
    n = corpus.count()
    lists = max(1, round(math.sqrt(n))) if lists is None else lists
    chosen = corpus if n <= sample else corpus.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    fitted = unit_rows([r["embedding"] for r in chosen.orderBy("vec_id").collect()])
    fitted = fitted[np.isfinite(fitted).all(axis=1)]
    if not len(fitted):
        fitted = np.zeros((1, max(1, corpus.agg(F.max(F.size("embedding"))).first()[0] or 1)))  # no direction at all: one list
    centres = _means(fitted, lists, seed)
    rest = fitted - centres[_near(fitted, centres)]
    pieces = _pieces(fitted.shape[1])
    cut = rest.reshape(len(rest), pieces, -1)
    words = np.stack([_means(cut[:, p], WORDS, seed + p) for p in range(pieces)])
    shared = corpus.sparkSession.sparkContext.broadcast((centres, words))

    @F.pandas_udf("struct<list_id:int,code:binary>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centres, words = shared.value
        for batch in batches:
            if batch.empty:
                yield pd.DataFrame({"list_id": pd.Series([], dtype="int32"), "code": pd.Series([], dtype=object)})
                continue
            x = unit_rows(batch)
            of = _near(x, centres)
            cut = (x - centres[of]).reshape(len(x), len(words), -1)
            codes = np.stack([_near(cut[:, p], words[p]) for p in range(len(words))], axis=1).astype(np.uint8)
            yield pd.DataFrame({"list_id": of.astype(np.int32), "code": [c.tobytes() for c in codes]})

    rows = written(corpus.withColumn("_p", placed("embedding")).select("vec_id", "embedding", "_p.list_id", "_p.code"), "vector-index")
    sizes = np.zeros(len(centres), np.int64)
    for r in rows.groupBy("list_id").count().collect():  # one row for each list
        sizes[r["list_id"]] = r["count"]
    return Index(centres, words, rows, sizes, *_settings(fitted, centres, words, n, k))


def _probed(queries: DataFrame, index: Index, k: int, probes: int) -> DataFrame:
    """(query_id, embedding, list_id): the nearest lists of each query, and further ones until they hold ``k`` vectors."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.sizes))

    @F.pandas_udf("array<int>")
    def nearest_lists(batch: pd.Series) -> pd.Series:
        centres, sizes = shared.value
        if batch.empty:
            return pd.Series([], dtype=object)
        square = (centres**2).sum(axis=1) - 2 * unit_rows(batch) @ centres.T
        order = np.argsort(square, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        enough = np.maximum((held < k).sum(axis=1) + 1, probes)
        return pd.Series([o[:n].astype(np.int32) for o, n in zip(order, enough)])

    return queries.withColumn("list_id", F.explode(nearest_lists("embedding")))


def _score_codes(index: Index, wanted: int):
    """The ``wanted`` vectors of a part of a list whose codes are nearest to each query."""
    shared = index.rows.sparkSession.sparkContext.broadcast((index.centres, index.words))

    def score(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or part.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []}).astype({"query_id": "int64", "vec_id": "int64"})
        centres, words = shared.value
        q = unit_rows(queries["embedding"])
        tables = np.einsum("qpw,pkw->qpk", q.reshape(len(q), len(words), -1), words)
        codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
        near = q @ centres[int(part["list_id"].iloc[0])]
        distance = 1.0 - near[:, None] - sum(tables[:, p, codes[:, p]] for p in range(len(words)))
        best, ids = nearest(distance, part["vec_id"].to_numpy(), wanted)
        return _hits(queries["query_id"].to_numpy(), best, ids)

    return score


def vector_topk_ivf(
    queries: DataFrame, corpus: DataFrame, k: int = K, lists: int | None = None, probes: int | None = None,
    shortlist: int | None = None, exact: bool = False, index: Index | None = None,
) -> DataFrame:
    """Top k among the vectors of the nearest lists.

    A query looks at its ``probes`` nearest lists, and at more until they hold k vectors. Codes pick the ``shortlist``
    nearest vectors, which are then compared exactly; both are the index's own unless given. ``exact`` compares all vectors of the lists: with all
    lists the result is that of ``vector_topk``. A list is cut into parts of bounded size, and a query visits all of them,
    so one large list doesn't end up in one task.
    """
    queries = queries.select("query_id", "embedding")
    index = index or build_index(corpus, lists, k=k)
    if not index.sizes.any():
        return queries.sparkSession.createDataFrame([], "query_id long, position int, vec_id long, distance double")
    probes = index.probes if probes is None else probes
    wanted = max(k, index.shortlist if shortlist is None else shortlist)
    parts = F.array(*(F.lit(max(1, math.ceil(n / CORPUS_BLOCK))) for n in index.sizes.tolist()))
    n_parts = F.get(parts, F.col("list_id"))
    theirs = index.rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int"))
    mine = _probed(queries, index, k, probes).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    if exact:
        score, brief = _score(k), theirs.drop("code")
    else:
        score, brief = _score_codes(index, wanted), theirs.drop("embedding")
    candidates = mine.groupBy("list_id", "part").cogroup(brief.groupBy("list_id", "part")).applyInPandas(score, _HITS)
    if not exact:
        brief = top_n_per_key(candidates, ["query_id"], [F.col("distance"), F.col("vec_id")], wanted, "_n")
        pairs = brief.select("query_id", "vec_id").join(index.rows.select("vec_id", F.col("embedding").alias("_v")), "vec_id")
        pairs = pairs.join(queries, "query_id")
        candidates = pairs.select("query_id", "vec_id", cosine_distance(F.col("embedding"), F.col("_v")).alias("distance"))
    return _ranked(candidates, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg(
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )


# What stands between context texts, and the answer without any.
CONTEXT_RULE = "\n\n---\n\n"
NO_CONTEXT = "Não encontrei informação relevante nos documentos indexados."


def rag_context(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query the hit texts in rank order, and the ids of their chunks.

    ``chunks`` has ``vec_id, chunk_id, text``; a query has at most k hits.
    """
    texts = hits.join(chunks.select("vec_id", "chunk_id", "text"), "vec_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text")))
    grouped = texts.groupBy("query_id").agg(ordered.alias("_hits"))
    return (
        queries.select("query_id")
        .join(grouped, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(
                F.array_join(F.transform("_hits", lambda h: h["text"]), CONTEXT_RULE), F.lit(NO_CONTEXT)
            ).alias("context"),
            F.coalesce(
                F.transform("_hits", lambda h: h["chunk_id"]), F.array().cast("array<string>")
            ).alias("sources"),
        )
    )
