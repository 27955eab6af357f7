"""Exact nearest neighbours that skip documents (E7): cells of a fitted partition, with bounds.

Unit vectors are assigned to the nearest of some centres and stored by cell, and
within a cell by their distance to the centre. For a query and a stretch of such
documents the triangle inequality bounds the cosine from above; stretches that cannot
reach the query's k-th best score so far are not multiplied. A first pass over each
query's nearest cells sets that score, a second one visits whatever is left, so the
rows are those of ``nearest_k``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.vectors import as_matrix, unit_rows
from tokenloom.operators.search import QUERY_BLOCK_BYTES, SCORE_DIGITS, Best, _prepare, _ranked, _score_schema
from tokenloom.session import scratch_path

#: Rows the centres are fitted on, at most.
SAMPLE_ROWS = 50_000
#: Documents of one stretch: they are skipped or multiplied together.
STRETCH = 256
#: Rounding of scores and of distances: no document is skipped that could still tie.
SLACK = 2 * 10.0**-SCORE_DIGITS


@dataclass(frozen=True)
class Cells:
    """An index: ``table(cell, distance, id, vec)`` sorted by cell and distance, the centres, rows and radius of each cell."""

    table: DataFrame
    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray


def build_cells(d_df: DataFrame, n_cells: int, doc_id: str = "doc_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Cells:
    """Fit the centres on a seeded sample of at most ``sample_rows`` rows, then put every row into its cell."""
    spark = d_df.sparkSession
    rows = _prepare(d_df, doc_id, vector_col)

    def unit(column: pa.Array) -> pa.Array:
        flat = unit_rows(as_matrix(column))
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1]))
        return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))

    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    sample = chosen.select(array_to_vector(F.arrow_udf(unit, "array<double>")("vec")).alias("features"))
    if sample.isEmpty():
        raise ValueError("there are no documents")
    model = KMeans(k=max(2, n_cells), seed=seed, maxIter=10).fit(sample)
    centres = np.array(model.clusterCenters())
    shared = spark.sparkContext.broadcast(centres)  # n_cells vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(as_matrix(batch.column("vec")))
                square = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)
                cell = square.argmin(axis=1)
                distance = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(distance), *batch.columns], ["cell", "distance", "id", "vec"])

    schema = "cell int, distance double, id bigint, vec array<double>"
    path = scratch_path(spark, "cells")
    # A cell may hold a third of all rows: a hash of the id deals each cell over several tasks.
    placed = rows.mapInArrow(assign, schema).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    placed.repartition("cell", "part").sortWithinPartitions("cell", "distance").drop("part").write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    facts = table.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # a row per cell
    count, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for r in facts:
        count[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    return Cells(table, centres, count, radius)


def _most(distance: np.ndarray, low: np.ndarray | float, high: np.ndarray | float) -> np.ndarray:
    """The highest cosine a document can have that is between ``low`` and ``high`` from a centre ``distance`` away from the query."""
    gap = np.maximum(np.maximum(distance - high, low - distance), 0)
    return 1 - gap * gap / 2


def _visit(cells: Cells, names: list[str], shared: Broadcast, k: int, wanted: np.ndarray) -> DataFrame:
    """Best ``k`` of the wanted cells' documents per query and task, and one row without a query: the number of scores worked out."""
    table = cells.table.filter(F.col("cell").isin([int(c) for c in np.flatnonzero(wanted)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, distance, visits, least, blank = shared.value
        best, scored = Best(queries, k, least), 0
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            far, doc_ids = batch.column("distance").to_numpy(), batch.column("id").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for at in range(begin, end, STRETCH):
                    stop = min(at + STRETCH, end)
                    c = int(cell[at])
                    reached = _most(distance[:, c], far[at:stop].min(), far[at:stop].max()) >= best.floor - SLACK
                    rows = np.flatnonzero((reached | blank) & visits[:, c])
                    if len(rows):
                        scored += len(rows) * (stop - at)
                        best.add(doc_ids[at:stop], unit_rows(as_matrix(batch.column("vec").slice(at, stop - at))), rows)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([scored], pa.int64()), pa.array([None], pa.float64())], [*names, "score"])
        yield best.rows(names, query_ids)

    return table.mapInArrow(run, _score_schema(*names))


def nearest_in_cells(
    q_df: DataFrame,
    cells: Cells,
    k: int = 10,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector_col: str = "embedding",
    first_cells: int = 2,
) -> tuple[DataFrame, dict[str, float]]:
    """The rows of ``nearest_k``, and the share of all scores that had to be worked out.

    Queries go in blocks of QUERY_BLOCK_BYTES; each block reads the cells it needs twice.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = q_df.sparkSession
    names = [query_id, doc_id]
    queries = _prepare(q_df, query_id, vector_col)
    n_queries = queries.count()
    dim = cells.centres.shape[1]
    blocks = max(1, -(-n_queries * (dim + 2 * len(cells.rows)) * 8 // QUERY_BLOCK_BYTES))
    path = scratch_path(spark, "cell-scores")
    schema = _score_schema(*names)
    scored = 0
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about QUERY_BLOCK_BYTES
        if not own.num_rows:
            continue
        ids, x = own.column("id").to_numpy(), unit_rows(as_matrix(own.column("vec").combine_chunks()))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        distance = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ cells.centres.T + (cells.centres**2).sum(axis=1), 0))
        # Zero vectors have a cosine of 0 with everything, which no distance bounds.
        blank = ~x.any(axis=1)
        nearest = np.argsort(np.where(cells.rows > 0, distance, np.inf), axis=1)
        visits = np.zeros(distance.shape, dtype=bool)
        np.put_along_axis(visits, nearest[:, :first_cells], True, axis=1)
        visits[blank] = True
        least = np.full(len(ids), -2.0)
        for turn in range(2):
            folder = f"{path}/block-{block}/turn-{turn}"
            shared = spark.sparkContext.broadcast((ids, x, distance, visits, least, blank))
            _visit(cells, names, shared, k, visits.any(axis=0) & (cells.rows > 0)).write.parquet(folder)
            shared.destroy()
            found = spark.read.schema(schema).parquet(folder)
            scored += found.filter(F.col(query_id).isNull()).agg(F.sum(doc_id)).first()[0] or 0
            if turn == 0:
                ranked = _ranked(found.filter(F.col(query_id).isNotNull()), names, k)
                kth = ranked.filter(F.col("rank") == k).groupBy(query_id).agg(F.min("score").alias("score")).collect()  # a row per query of the block
                at = np.searchsorted(ids, [r[query_id] for r in kth])
                least[at] = [r["score"] for r in kth]
                visits = ~visits & (_most(distance, 0.0, cells.radius) >= least[:, None] - SLACK) & (cells.rows > 0)
                if not visits.any():
                    break
    if not n_queries:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0)), {"share": 0.0}
    every = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path).filter(F.col(query_id).isNotNull())
    return _ranked(every, names, k), {"share": scored / max(1, n_queries * int(cells.rows.sum()))}
