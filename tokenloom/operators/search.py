"""Cosine scores and exact nearest neighbours.

Vectors meet in blocks: a task holds a block of queries as one matrix and
multiplies batches of documents with it. For top-k, pairs that single precision
rules out are scored no further, and only k candidates per query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.vectors import as_matrix, cosine, unit_rows
from tokenloom.operators.embed import vector_length
from tokenloom.session import broadcast_if_small, materialize, scratch_path

#: Scores are compared at this precision, so that ties break by id on every run.
SCORE_DIGITS = 6
#: Bytes of the queries broadcast at once.
QUERY_BLOCK_BYTES = 64 * 1024 * 1024
#: Document rows multiplied at once.
CHUNK_ROWS = 1_024
QUERY_CHUNK = 1_024
#: Candidates per query from which all of a chunk's scores are worked out, and bytes of the vectors gathered at once below that.
DENSE, PAIR_BYTES = 64, 8 << 20


def _prepare(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))


def _score_schema(query_id: str, doc_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, T.LongType()),
            T.StructField(doc_id, T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scores(queries: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Rounded cosines of unit rows; the sum removes negative zero."""
    return np.round(queries @ documents.T, SCORE_DIGITS) + 0.0


def _chunks(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for begin in range(0, len(ids), CHUNK_ROWS):
        yield ids[begin : begin + CHUNK_ROWS], unit_rows(as_matrix(vectors.slice(begin, CHUNK_ROWS)))


def _emit(names: list[str], query_ids: np.ndarray, doc_ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(doc_ids), pa.array(scores)], [*names, "score"])


class Best:
    """The best ``k`` documents of each query seen so far by one task.

    Single-precision scores sieve: only documents that could reach a query's k-th best
    score, by more than the error of such a score, are scored in double precision.
    ``least`` holds scores that a query's results are known to reach.
    """

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.queries, self.k = queries, k
        self.fast = queries.astype(np.float32)
        self.floor = np.full(len(queries), -np.inf) if least is None else least.copy()
        self.ids = np.zeros((len(queries), 0), dtype=np.int64)
        self.scores = np.zeros((len(queries), 0))
        # Rounding of scores, and of sums of single-precision products of unit vectors.
        self.slack = 2 * 10.0**-SCORE_DIGITS + (queries.shape[1] + 16) * 2.0**-23

    def add(self, doc_ids: np.ndarray, documents: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Show unit vectors to the queries ``rows`` (ascending; all of them by default)."""
        wider = min(self.k - self.ids.shape[1], len(doc_ids))
        if wider > 0:
            self.ids = np.pad(self.ids, ((0, 0), (0, wider)), constant_values=np.iinfo(np.int64).max)
            self.scores = np.pad(self.scores, ((0, 0), (0, wider)), constant_values=-np.inf)
        by_id = np.argsort(doc_ids, kind="stable")
        doc_ids, documents = doc_ids[by_id], documents[by_id]
        fast = documents.astype(np.float32).T
        for begin in range(0, len(self.queries) if rows is None else len(rows), QUERY_CHUNK):
            if rows is None:
                own = np.arange(begin, min(begin + QUERY_CHUNK, len(self.queries)))
                near = self.fast[begin : begin + QUERY_CHUNK] @ fast
            else:
                own = rows[begin : begin + QUERY_CHUNK]
                near = self.fast[own] @ fast
            asked = (self.floor[own] - self.slack).astype(np.float32)
            hit = np.flatnonzero(near.max(axis=1) >= asked)
            if not len(hit):
                continue
            own = own[hit]
            i, j = np.divmod(np.flatnonzero(near[hit] >= asked[hit, None]), len(doc_ids))
            if len(i) > DENSE * len(own):
                i, j, scores = self._dense(own, documents)
            else:
                scores = self._sparse(own[i], j, documents)
            self._keep(own, i, doc_ids[j], scores)

    def _dense(self, own: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of all documents for each of a few queries: places of query and document, scores."""
        new, n = _scores(self.queries[own], documents), len(documents)
        if n > self.k:
            # One integer orders by score, then by position, which is id order here.
            key = np.rint(new * 10**SCORE_DIGITS).astype(np.int64) * -n + np.arange(n)
            j = np.argpartition(key, self.k - 1, axis=1)[:, : self.k]
        else:
            j = np.broadcast_to(np.arange(n), new.shape)
        return np.repeat(np.arange(len(own)), j.shape[1]), j.ravel(), np.take_along_axis(new, j, axis=1).ravel()

    def _sparse(self, rows: np.ndarray, places: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Scores of single pairs."""
        scores = np.empty(len(rows))
        step = max(1, PAIR_BYTES // (8 * documents.shape[1]))
        for begin in range(0, len(rows), step):
            part = slice(begin, begin + step)
            scores[part] = np.einsum("ij,ij->i", self.queries[rows[part]], documents[places[part]])
        return np.round(scores, SCORE_DIGITS) + 0.0

    def _keep(self, own: np.ndarray, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates of the queries ``own[i]`` into what these have."""
        width = self.ids.shape[1]
        place = np.concatenate([np.repeat(np.arange(len(own)), width), i])
        ids = np.concatenate([self.ids[own].ravel(), ids])
        scores = np.concatenate([self.scores[own].ravel(), scores])
        order = np.lexsort((ids, -scores, place))
        place = place[order]
        first = np.searchsorted(place, np.arange(len(own)))
        order = order[np.arange(len(place)) - first[place] < width]
        self.ids[own], self.scores[own] = ids[order].reshape(-1, width), scores[order].reshape(-1, width)
        if width == self.k:
            self.floor[own] = np.maximum(self.floor[own], self.scores[own, -1])

    def rows(self, names: list[str], query_ids: np.ndarray) -> pa.RecordBatch:
        known = self.scores > -np.inf
        return _emit(names, np.repeat(query_ids, known.sum(axis=1)), self.ids[known], self.scores[known])


def _score(documents: DataFrame, names: list[str], shared: Broadcast, k: int | None, min_score: float | None) -> DataFrame:
    """Documents where they stand against one broadcast block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        chunks = (c for b in batches for c in _chunks(b.column("id").to_numpy(), b.column("vec")))
        if k is not None:
            best = Best(queries, k)
            for doc_ids, vectors in chunks:
                best.add(doc_ids, vectors)
            yield best.rows(names, query_ids)
            return
        for doc_ids, vectors in chunks:
            for begin in range(0, len(query_ids), QUERY_CHUNK):
                scores = _scores(queries[begin : begin + QUERY_CHUNK], vectors)
                i, j = np.nonzero(scores >= min_score)
                yield _emit(names, query_ids[begin + i], doc_ids[j], scores[i, j])

    return documents.mapInArrow(run, _score_schema(*names))


def _pair_up(q_df: DataFrame, d_df: DataFrame, names: list[str], k: int | None, min_score: float | None = None, stored: bool = False) -> DataFrame:
    """Scores of each task's best ``k`` documents per query, or all of at least ``min_score``.

    The documents never move. Queries go to them in blocks of QUERY_BLOCK_BYTES, one
    broadcast at a time; with several blocks both sides are stored first (the documents where
    they are not ``stored`` yet), so that no block works them out again, and each block's result is stored and its broadcast dropped before the next.
    """
    spark = q_df.sparkSession
    dim = q_df.agg(F.max(F.size("vec")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not dim["rows"]:
        return spark.createDataFrame([], _score_schema(*names))
    n_blocks = max(1, -(-dim["rows"] * (dim["n"] * 8 + 8) // QUERY_BLOCK_BYTES))
    if n_blocks > 1:
        blocks = scratch_path(spark, "queries")
        q_df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).write.partitionBy("block").parquet(blocks)
        dealt = spark.read.schema("id bigint, vec array<double>, block int").parquet(blocks)
        d_df = d_df if stored else materialize(d_df, "documents")
    parts = []
    for block in range(n_blocks):
        own = q_df if n_blocks == 1 else dealt.filter(F.col("block") == block).drop("block")
        table = own.toArrow().combine_chunks()  # about QUERY_BLOCK_BYTES
        if not table.num_rows:
            continue
        shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), unit_rows(as_matrix(table.column("vec").combine_chunks()))))
        found = _score(d_df, names, shared, k, min_score)
        if n_blocks > 1:
            found = materialize(found if k is None else _ranked(found, names, k).drop("rank"), "scores")
            shared.destroy()
        parts.append(found)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _ranked(scores: DataFrame, names: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(names[0]).orderBy(F.desc("score"), F.asc(names[1]))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pair_scores(
    pairs: DataFrame,
    q_df: DataFrame,
    d_df: DataFrame,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The cosine of given (query, document) pairs, rounded to 6 digits. As many rows as pairs."""
    q = q_df.select(F.col(query_id), F.col(vector_col).alias("__q"))
    dim = vector_length(q, "__q") or 0
    d = d_df.select(F.col(doc_id), F.col(vector_col).alias("__d"))
    both = pairs.select(query_id, doc_id).join(broadcast_if_small(q, dim * 8 + 8), query_id).join(d, doc_id)
    return both.select(query_id, doc_id, (F.round(cosine(F.col("__q"), F.col("__d")), SCORE_DIGITS) + F.lit(0.0)).alias("score"))


def cosine_scores(
    q_df: DataFrame,
    d_df: DataFrame,
    min_score: float,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Every query with every document that reaches ``min_score``, rounded to 6 digits."""
    return _pair_up(_prepare(q_df, query_id, vector_col), _prepare(d_df, doc_id, vector_col), [query_id, doc_id], None, min_score)


def nearest_k(
    q_df: DataFrame,
    d_df: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector_col: str = "embedding",
    stored: bool = False,
) -> DataFrame:
    """The best ``k`` documents per query, ties by document id, with their ``rank``.

    ``stored`` tells that the documents are a stored table, cheap to read again for each block of queries.
    """
    if k < 1:
        raise ValueError("k must be positive")
    names = [query_id, doc_id]
    return _ranked(_pair_up(_prepare(q_df, query_id, vector_col), _prepare(d_df, doc_id, vector_col), names, k, stored=stored), names, k)
