import pytest
from pyspark.sql import functions as F

from tokenloom.operators import corpus, ordering
from tokenloom.sources.catalog import Catalog, standard_catalog


def test_text_field_and_rename(spark):
    df = spark.createDataFrame([("q1", 1), ("q2", 2)], "question string, n int")
    assert [r.text for r in corpus.text_field(df, "question").collect()] == ["q1", "q2"]
    pruned = corpus.rename_and_prune(df, {"question": "text"})
    assert pruned.columns == ["text"] and pruned.count() == 2


def test_join_array_text_drops_blank_and_keeps_source(spark):
    df = spark.createDataFrame([(["a", "b"],), ([" ", "\t"],), ([],)], "definitions array<string>")
    out = corpus.join_array_text(df, "definitions")
    assert [(r.definitions, r.text) for r in out.collect()] == [(["a", "b"], "a b")]


def test_unpivot(spark):
    df = spark.createDataFrame([(0, "p", "h"), (1, "h", "p"), (2, "p", "n")], "id int, premise string, hypothesis string")
    rows = corpus.unpivot_text(df, ["premise", "hypothesis"], "id").orderBy("id", "pos")
    assert [r.text for r in rows.collect()] == ["p", "h", "h", "p", "p", "n"]
    first = corpus.unpivot_first_seen(df, ["premise", "hypothesis"], "id").orderBy("id", "pos")
    assert [(r.id, r.pos, r.text) for r in first.collect()] == [(0, 0, "p"), (0, 1, "h"), (2, 1, "n")]


def test_union_keeps_duplicates(spark):
    one = spark.createDataFrame([("a",)], "text string")
    assert corpus.union_subsets([one, one, one]).count() == 3
    with pytest.raises(ValueError):
        corpus.union_subsets([])


@pytest.fixture(params=[ordering.ONE_RANGE_ROWS, 0])
def ranges(request, monkeypatch):
    """Small tables as one range, and cut like large ones."""
    monkeypatch.setattr(ordering, "ONE_RANGE_ROWS", request.param)


def test_batches(spark, ranges):
    df = spark.createDataFrame([(i,) for i in (5, 1, 4, 2, 3)], "n bigint")
    rows = corpus.assign_batches(df, 2, "n").orderBy("n").collect()
    assert [r.batch_id for r in rows] == [0, 0, 1, 1, 2]
    assert corpus.assign_batches(df.limit(0), 2, "n").count() == 0
    with pytest.raises(ValueError):
        corpus.assign_batches(df, 0, "n")


def test_batches_with_a_lopsided_key(spark, ranges):
    # Two thirds of the keys lie close together; every batch is still full.
    keys = spark.range(3_000).select(F.when(F.col("id") < 2_000, F.col("id")).otherwise(F.col("id") * 10**9).alias("n"))
    rows = corpus.assign_batches(keys, 100, "n")
    sizes = rows.groupBy("batch_id").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    found = sizes.orderBy("batch_id").collect()
    assert [r.c for r in found] == [100] * 30
    assert all(a.high < b.low for a, b in zip(found, found[1:]))


def test_limit_batches(spark, ranges):
    df = spark.range(50).select(F.col("id").alias("n"))
    assert sorted(r.n for r in corpus.limit_batches(df, 3, 4, "n").collect()) == list(range(12))
    # A limit of nothing still processes one batch.
    assert corpus.limit_batches(df, 0, 4, "n").count() == 4
    assert corpus.limit_batches(df, 30, 4, "n").count() == 50
    assert corpus.limit_batches(df.limit(0), 3, 4, "n").count() == 0


def test_text_keys_order_too(spark, ranges):
    names = [f"key-{i:04d}é" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string").repartition(4)
    rows = corpus.assign_batches(df, 50, "n").collect()
    assert all(r.batch_id == names.index(r.n) // 50 for r in rows)
    assert sorted(r.n for r in corpus.limit_batches(df, 2, 9, "n").collect()) == names[:18]


def test_shuffle_is_repeatable(spark):
    df = spark.range(200)
    once = [r.id for r in corpus.shuffle_rows(df, "id").collect()]
    again = [r.id for r in corpus.shuffle_rows(df.repartition(5), "id").collect()]
    other = [r.id for r in corpus.shuffle_rows(df, "id", seed=1).collect()]
    assert once == again and sorted(once) == list(range(200))
    assert once != list(range(200)) and once != other


def test_catalog_reports_all_unknown_names_before_running(spark):
    ran = []
    catalog = Catalog()
    catalog.register("a", lambda s: ran.append(1) or s.createDataFrame([("x",)], "text string"))
    with pytest.raises(KeyError, match="b.*c"):
        catalog.load(spark, ["a", "b", "c"])
    assert not ran
    assert [tuple(r) for r in catalog.load(spark, ["a"]).collect()] == [("x", "a")]


def test_standard_catalog(spark, tmp_path):
    catalog = standard_catalog(str(tmp_path))
    assert len(catalog.names()) == 15
    spark.createDataFrame([(0, "p", "h"), (1, "p", "n")], "row_id int, premise string, hypothesis string").write.parquet(
        str(tmp_path / "snli")
    )
    for subset in ("pqa_artificial", "pqa_unlabeled"):
        spark.createDataFrame([("q", 1)], "question string, n int").write.parquet(str(tmp_path / "PubMedQA" / subset))
    rows = catalog.load(spark, ["snli", "PubMedQA"]).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in rows} == {"snli": 3, "PubMedQA": 2}
