"""The index that skips documents returns what the full search returns."""

import numpy as np
import pytest

from tokenloom.operators import cells, search


def table(spark, ids, matrix, name):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, matrix)], f"{name} bigint, embedding array<double>")


def blobs(rng, n, dim, centres, spread):
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("n_cells", "k", "first_cells"), [(12, 5, 1), (3, 40, 3), (1, 1, 1)])
def test_same_rows_as_the_full_search(spark, n_cells, k, first_cells):
    rng = np.random.default_rng(n_cells)
    vectors = blobs(rng, 600, 16, 10, 0.1)
    vectors[50:60] = vectors[0]  # ties, to be broken by id
    vectors[70] = 0.0
    documents = table(spark, rng.permutation(600), vectors, "doc_id").repartition(4)
    asked = np.vstack([vectors[:25], rng.normal(size=(5, 16)), np.zeros((1, 16)), vectors[:1]])
    queries = table(spark, [*range(100, 131), 7], asked, "query_id")
    index = cells.build_cells(documents, n_cells, sample_rows=200)
    assert index.rows.sum() == 600 and index.table.count() == 600
    found, facts = cells.nearest_in_cells(queries, index, k, first_cells=first_cells)
    assert rows_of(found) == rows_of(search.nearest_k(queries, documents, k))
    assert 0 < facts["share"] <= 1
    if n_cells == 12:
        assert facts["share"] < 0.6  # most documents of distant cells are never multiplied


def test_query_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = blobs(rng, 200, 8, 5, 0.2)
    documents = table(spark, range(200), vectors, "doc_id")
    queries = table(spark, range(40), vectors[:40], "query_id")
    index = cells.build_cells(documents, 5)
    whole = rows_of(cells.nearest_in_cells(queries, index, 3)[0])
    monkeypatch.setattr(cells, "QUERY_BLOCK_BYTES", 1_500)
    monkeypatch.setattr(cells, "STRETCH", 7)
    assert rows_of(cells.nearest_in_cells(queries, index, 3)[0]) == whole


def test_small_cases(spark):
    documents = table(spark, [1, 2], np.array([[1.0, 0.0], [0.0, 1.0]]), "doc_id")
    queries = table(spark, [5], np.array([[1.0, 0.1]]), "query_id")
    index = cells.build_cells(documents, 2)
    assert [(r.doc_id, r["rank"]) for r in cells.nearest_in_cells(queries, index, 10)[0].orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert cells.nearest_in_cells(queries.limit(0), index, 3)[0].count() == 0
    with pytest.raises(ValueError, match="no documents"):
        cells.build_cells(documents.limit(0), 2)
    with pytest.raises(ValueError, match="positive"):
        cells.nearest_in_cells(queries, index, 0)
