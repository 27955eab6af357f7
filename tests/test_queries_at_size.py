"""What queries read, and how it is cut, on tables larger than one range."""

import duckdb
from pyspark.sql import functions as F

from tokenloom.operators import distill
from tokenloom.plans import queries
from tokenloom.plans.oracles import all_oracles

SF = "/root/testdata/sf0.001"


def test_batches_are_numbered_over_stored_vectors(spark, monkeypatch):
    assert "ArrowEvalPython" not in queries._batched_pairs(spark, SF)._jdf.queryExecution().toString()

    def refused(*a):
        raise AssertionError("the texts are encoded for the length of their vectors")

    monkeypatch.setattr(distill, "vector_length", refused)
    assert queries.matryoshka_contrastive_d3(spark, SF).count() == queries.matryoshka_loss_d3(spark, SF).count() == 3


def test_a_language_of_several_files_keeps_its_row_numbers(spark, monkeypatch):
    monkeypatch.setattr(queries, "POSITION_ROWS", 40)
    texts, vectors = queries._position_files(spark, SF)
    for path, kind in ((texts, spark.read.text), (vectors, spark.read.parquet)):
        files = kind(path).groupBy(F.input_file_name()).count().collect()
        assert len(files) > 10 and max(r["count"] for r in files) <= 45
    found = queries.pair_by_position_s5(spark, SF).toPandas()
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    expected = connection.execute(all_oracles()["pair_by_position_s5"]).df()[list(found.columns)]
    keys = list(found.columns)
    found, expected = (f.sort_values(keys).reset_index(drop=True) for f in (found, expected))
    assert len(found) == len(expected) and (found == expected).all().all()
