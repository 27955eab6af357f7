import json

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import ordering
from tokenloom.sources import positions, shards
from tokenloom.streaming import streams


@pytest.fixture
def rows(spark):
    data = [(f"example {i}", i, [float(i), 1.0, 2.0, 3.0]) for i in range(10)]
    return spark.createDataFrame(data, "text string, meta int, embedding array<double>")


def test_round_trip(spark, rows, tmp_path):
    out = str(tmp_path / "set")
    facts = shards.write_shards(rows.coalesce(1), out, 3, model_name="teacher", dataset_name="made up")
    assert facts == {"n_rows": 10, "dim": 4}
    back = shards.read_shards(spark, [out], columns=("text", "meta", "embedding"))
    assert back.schema["embedding"].dataType.simpleString() == "array<float>"
    assert {(r.text, r.meta, r.embedding[0]) for r in back.collect()} == {(f"example {i}", str(i), float(i)) for i in range(10)}
    per_file = shards.shard_row_count(spark, [out]).collect()
    assert sorted(r.n_rows for r in per_file) == [1, 3, 3, 3]
    assert json.loads((tmp_path / "set" / "metadata.json").read_text()) == {"model_name": "teacher", "dataset_name": "made up"}
    assert "10 rows" in (tmp_path / "set" / "README.md").read_text()


def test_shard_limit_counts_per_path(spark, rows, tmp_path):
    paths = [str(tmp_path / name) for name in ("one", "two")]
    for path in paths:
        shards.write_shards(rows.coalesce(1), path, 3, model_name="m", dataset_name="d")
    assert shards.read_shards(spark, paths, limit_shards=2).count() == 12
    assert shards.read_shards(spark, paths).columns == ["text", "embedding"]
    files = shards.list_shards(spark, paths, 2)
    assert len(files) == 4 and files == sorted(files)


def test_no_shards_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, [str(tmp_path)])


def test_bad_writes(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        shards.write_shards(rows.limit(0), str(tmp_path / "a"), model_name="m", dataset_name="d")
    ragged = rows.withColumn("embedding", F.slice("embedding", 1, F.when(F.col("meta") == 3, 2).otherwise(4)))
    with pytest.raises(Exception, match="ragged"):
        shards.write_shards(ragged, str(tmp_path / "b"), model_name="m", dataset_name="d")
    # Nothing became visible.
    assert not list((tmp_path / "b").rglob("*.parquet")) or not [p for p in (tmp_path / "b").rglob("*.parquet") if "_temporary" not in str(p)]
    with pytest.raises(ValueError, match="positive"):
        shards.write_shards(rows, str(tmp_path / "c"), 0, model_name="m", dataset_name="d")
    with pytest.raises(ValueError, match="mode"):
        shards.write_shards(rows, str(tmp_path / "c"), mode="ignore", model_name="m", dataset_name="d")


def test_readers_see_the_old_set_until_the_new_one_is_whole(spark, rows, tmp_path, monkeypatch):
    out = str(tmp_path / "set")
    named = {"model_name": "m", "dataset_name": "d"}
    shards.write_shards(rows.coalesce(1), out, 3, **named)
    with pytest.raises(FileExistsError):
        shards.write_shards(rows, out, **named)
    seen = []

    def look(session, path, content, put=shards.replace_text):
        # The new data and sidecars are all there; readers do not see them yet.
        seen.append((shards.read_shards(spark, [out]).count(), shards.shard_row_count(spark, [out]).count(), shards.dataset_model_name(spark, [out])))
        if len(seen) == 1:
            raise RuntimeError("broken off")
        put(session, path, content)

    monkeypatch.setattr(shards, "replace_text", look)
    more = rows.unionByName(rows).coalesce(1)
    for _ in range(2):
        try:
            shards.write_shards(more, out, 3, mode="overwrite", model_name="other", dataset_name="d")
        except RuntimeError:
            assert shards.read_shards(spark, [out]).count() == 10
    assert seen == [(10, 4, "m")] * 2
    assert shards.read_shards(spark, [out]).count() == 20 and shards.dataset_model_name(spark, [out]) == "other"
    # The set that was read until now is kept, what the broken write left is not.
    assert len(list((tmp_path / "set" / "train").iterdir())) == 2
    facts = shards.dataset_facts(spark, [out]).first()
    on_disk = sum(p.stat().st_size for p in (tmp_path / "set" / "train" / json.loads((tmp_path / "set" / shards.MANIFEST).read_text())["versions"][0]["name"]).glob("*.parquet"))
    assert (facts.n_rows, facts.n_files, facts.n_bytes, facts.dim, facts.model_name) == (20, 7, on_disk, 4, "other")
    assert facts.columns == "text: string, meta: string, embedding: array<float>"
    with pytest.raises(FileNotFoundError, match="manifest"):
        shards.dataset_facts(spark, [str(tmp_path)])


def test_appended_versions(spark, rows, tmp_path):
    out = str(tmp_path / "set")
    named = {"model_name": "m", "dataset_name": "d", "mode": "append"}
    for version in ("one", "two", "one"):  # the last one is there already
        shards.write_shards(rows.coalesce(1), out, 4, version=version, **named)
    assert shards.read_shards(spark, [out]).count() == 20
    assert sorted(r.n_rows for r in shards.shard_row_count(spark, [out]).collect()) == [2, 2, 4, 4, 4, 4]
    assert shards.shard_row_count(spark, [out], 1).collect()[0].n_rows == 4
    assert "20 rows" in (tmp_path / "set" / "README.md").read_text()
    with pytest.raises(ValueError, match="length 4, not 2"):
        shards.write_shards(rows.withColumn("embedding", F.slice("embedding", 1, 2)), out, **named)
    # A folder of files without a manifest is read by listing it.
    plain = str(tmp_path / "plain")
    rows.coalesce(1).write.parquet(f"{plain}/train")
    assert shards.read_shards(spark, [out, plain]).count() == 30
    assert shards.shard_row_count(spark, [out, plain]).agg({"n_rows": "sum"}).first()[0] == 30


def test_training_view(rows):
    assert shards.training_view(rows).columns == ["sentence", "label"]
    assert shards.training_view(rows, ("sentence",)).columns == ["sentence"]
    assert shards.training_view(rows, ("text", "label")).columns == ["text", "label"]


def test_pairs(spark):
    texts = spark.createDataFrame([("s0", 0, "a"), ("s0", 1, "b")], "shard string, row int, text string")
    vectors = spark.createDataFrame([("s0", 0, [1.0]), ("s0", 1, [2.0])], "shard string, row int, embedding array<double>")
    paired = shards.pair_by_position(texts, vectors).orderBy("row").collect()
    assert [(r.text, r.embedding) for r in paired] == [("a", [1.0]), ("b", [2.0])]
    with pytest.raises(Exception, match="no vector for shard s0, row 1"):
        shards.pair_by_position(texts, vectors.filter("row = 0")).collect()
    with pytest.raises(ValueError, match="no texts"):
        shards.pair_by_position(texts.limit(0), vectors)


@pytest.mark.parametrize("split", ["64m", "300"])
def test_pairs_from_files(spark, tmp_path, split):
    """Lines of text and vectors that share file names and nothing else, read in one split per file or in many."""
    texts, vectors = tmp_path / "texts", tmp_path / "vectors"
    texts.mkdir()
    held = {}
    for name, n in (("a", 150), ("b", 1), ("c", 40)):
        lines = [json.dumps({"text": f"{name} line {i} " + "x" * (i % 17), "meta": i}) for i in range(n)]
        (texts / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        held |= {(name, i): float(i) for i in range(n)}
        values = spark.createDataFrame([([float(i), 0.0],) for i in range(n + 5)], "embedding array<double>")
        values.coalesce(1).write.parquet(str(vectors / "stage" / name))
        part = next((vectors / "stage" / name).glob("*.parquet"))
        (vectors / f"{name}.parquet").write_bytes(part.read_bytes())
    stems = [str(vectors / f"{name}.parquet") for name in "abc"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = positions.json_rows(spark, [str(texts)], "text string, meta int")
        assert split == "64m" or lines.rdd.getNumPartitions() > 3
        found = positions.pair_files(lines, positions.parquet_rows(spark, stems)).collect()
        assert {(r.shard, r.row): r.embedding[0] for r in found} == held
        assert all(r.meta == r.row and r.text.startswith(f"{r.shard} line {r.row} ") for r in found)
        with pytest.raises(Exception, match="no vector for shard c, row"):
            positions.pair_files(lines, positions.parquet_rows(spark, stems[:2])).collect()
        with pytest.raises(ValueError, match="several files are called 'a'"):
            (texts / "more").mkdir(exist_ok=True)
            (texts / "more" / "a.jsonl").write_text("{}\n")
            positions.line_rows(spark, [str(texts)])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_blank_lines_count(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\n\n\nfour\n")
    found = positions.line_rows(spark, [str(tmp_path)]).collect()
    assert sorted((r.row, r.value) for r in found) == [(0, "one"), (1, ""), (2, ""), (3, "four")]


def test_model_name(spark, rows, tmp_path):
    for name, model in [("a", "m"), ("b", "m"), ("c", "other")]:
        shards.write_shards(rows, str(tmp_path / name), model_name=model, dataset_name=name)
    path = lambda n: str(tmp_path / n)
    assert shards.dataset_model_name(spark, [path("a"), path("b")]) == "m"
    assert shards.dataset_model_name(spark, [path("nothing")]) is None
    with pytest.raises(ValueError, match="m.*other"):
        shards.dataset_model_name(spark, [path("a"), path("c")])


def test_profile_and_vocabulary(spark, rows, tmp_path):
    row = shards.dataset_profile(rows).first()
    assert (row.n_rows, row.min_dim, row.max_dim, row.n_bytes) == (10, 4, 4, 10 * (9 + 4 + 4 * 8))
    holes = spark.createDataFrame([(None, None, None), ("é", 1, [1.0])], "text string, meta long, embedding array<float>")
    assert shards.dataset_profile(holes).first().n_bytes == 2 + 8 + 4
    assert shards.dataset_profile(holes.limit(0)).first().n_bytes == 0
    assert "embedding: array<double>" in row.columns
    counts = spark.createDataFrame([("a", 2)], "token string, frequency bigint")
    for name in ("x", "y"):
        shards.write_vocabulary(counts, str(tmp_path / name))
    assert shards.read_vocabulary(spark, [str(tmp_path / "x"), str(tmp_path / "y")]).count() == 2


def test_streams_drain_to_the_batch_result(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    rows.select("text").union(rows.select("text")).repartition(4).write.parquet(source)
    stream = lambda: streams.stream_shards(spark, source, "text string", 1)
    counts = {r.token: r.frequency for r in streams.drained_token_counts(stream()).collect()}
    assert counts["example"] == 20 and counts["3"] == 2
    out = streams.drain(streams.stream_first_seen(stream()))
    assert spark.read.parquet(out).count() == 10
    shuffled = str(tmp_path / "shuffled")
    streams.stream_shuffled(stream(), shuffled, "text").awaitTermination()
    assert spark.read.parquet(shuffled).count() == 20


def test_a_restarted_stream_stores_nothing_twice(spark, rows, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.coalesce(1).write.parquet(source)
    schema = rows.schema
    for _ in range(2):
        stream = streams.stream_shards(spark, source, schema, 1)
        streams.stream_write_shards(stream, out, 4, model_name="m", dataset_name="d", checkpoint=state).awaitTermination()
    assert shards.read_shards(spark, [out]).count() == 10


def test_a_second_run_into_the_same_folder_goes_on(spark, tmp_path):
    """State lives below the output: draining again, in other batches, adds nothing."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).select(F.col("id").cast("string").alias("text")).repartition(10).write.parquet(source)
    for files in (1, 100):
        streams.drain(streams.stream_shards(spark, source, "text string", files), out)
    assert spark.read.parquet(out).count() == 10


def test_metadata_missing_beside_named_sets(spark, rows, tmp_path):
    shards.write_shards(rows, str(tmp_path / "named"), model_name="m", dataset_name="d")
    with pytest.warns(UserWarning, match="no metadata"):
        assert shards.dataset_model_name(spark, [str(tmp_path / "named"), str(tmp_path / "bare")]) == "m"


def test_rows_wait_in_a_buffer_between_micro_batches(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(5):
        spark.range(20 * i, 20 * i + 20).selectExpr("id", f"{i} AS came").coalesce(1).write.parquet(str(source / f"f{i}"))
    stream = lambda: streams.stream_shards(spark, str(source), "id bigint, came int", 1)
    runs = []
    for name in ("x", "y"):
        out = str(tmp_path / name)
        streams.stream_buffer_shuffled(stream(), out, "id", 30)
        rows = spark.read.schema("id bigint, came int, batch_id string").parquet(out)
        runs.append({r.id: r.batch_id for r in rows.collect()})
        assert rows.count() == 100 and len(runs[-1]) == 100
        sizes = {r.batch_id: r["count"] for r in rows.groupBy("batch_id").count().collect()}
        assert sorted(sizes.values()) == [10, 20, 20, 20, 30]
        mixed = rows.groupBy("batch_id").agg(F.count_distinct("came").alias("n"), F.min("came").alias("first")).collect()
        assert all(r.n > 1 for r in mixed)
        assert any(r.batch_id.endswith("rest") and r.first < 4 for r in mixed)  # some waited for several batches
    assert runs[0] == runs[1]
    # The next micro-batches find an empty buffer and lose nothing.
    spark.range(100, 110).selectExpr("id", "5 AS came").coalesce(1).write.parquet(str(source / "f5"))
    streams.stream_buffer_shuffled(stream(), out, "id", 30)
    rows = spark.read.schema("id bigint, came int, batch_id string").parquet(out)
    assert rows.count() == 110 and rows.select("id").distinct().count() == 110


@pytest.mark.parametrize("one_range", [ordering.ONE_RANGE_ROWS, 0])
def test_a_batch_that_runs_again_starts_from_the_same_buffer(spark, tmp_path, monkeypatch, one_range):
    monkeypatch.setattr(ordering, "ONE_RANGE_ROWS", one_range)
    out = str(tmp_path / "out")
    buffer = streams.ShuffleBuffer(spark, out, "id", 10)
    parts = [spark.range(15 * i, 15 * i + 15) for i in range(3)]
    for batch in (0, 1, 1, 2, 2):
        buffer.take(parts[batch], batch)
    for _ in range(2):
        buffer.drain()
    rows = spark.read.schema("id bigint, batch_id string").parquet(out)
    assert rows.count() == 45 and rows.select("id").distinct().count() == 45
    with pytest.raises(ValueError, match="room"):
        streams.ShuffleBuffer(spark, out, "id", 0)


def test_equal_rows_all_leave_the_buffer(spark, tmp_path):
    buffer = streams.ShuffleBuffer(spark, str(tmp_path / "out"), "id", 7)
    same = spark.range(20).selectExpr("id % 2 AS id", "CAST(NULL AS string) AS text")
    for batch in range(2):
        buffer.take(same, batch)
    buffer.drain()
    assert spark.read.schema("id bigint, text string").parquet(str(tmp_path / "out")).count() == 40


def test_state_that_forgets_levels_off(spark, tmp_path):
    """Event time goes on by an hour a file: with an end to the state the number of keys in it stops growing."""
    source = tmp_path / "in"
    files = 8
    for i in range(files):
        rows = spark.range(30).selectExpr(f"concat('k', {i}, '-', id % 15) AS text", f"timestamp_seconds({3600 * i} + id) AS at")
        rows.coalesce(1).write.parquet(str(source / f"f{i}"))
    sizes = {}
    for within in (None, "90 minutes"):
        stream = streams.stream_shards(spark, str(source), "text string, at timestamp", 1)
        kept = streams.stream_first_seen(stream, within=within, time_col="at")
        query = streams.per_batch(kept.select("text"), str(tmp_path / f"out-{within}"), streams._overwrite)
        query.awaitTermination()
        sizes[within] = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert spark.read.parquet(str(tmp_path / f"out-{within}")).count() == 15 * files
    assert max(sizes[None]) == 15 * files
    assert max(sizes["90 minutes"]) <= 15 * 4


def test_repeats_inside_the_time_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    for i, (text, minute) in enumerate([("a", 0), ("a", 30), ("b", 31), ("a", 60)]):
        spark.range(1).selectExpr(f"'{text}' AS text", f"timestamp_seconds({60 * minute}) AS at").coalesce(1).write.parquet(str(source / f"f{i}"))
    stream = streams.stream_shards(spark, str(source), "text string, at timestamp", 1)
    out = streams.drain(streams.stream_first_seen(stream, within="2 hours", time_col="at").select("text"), str(tmp_path / "out"))
    assert sorted(r.text for r in spark.read.parquet(out).select("text").collect()) == ["a", "b"]
    arrived = streams.stream_first_seen(streams.stream_shards(spark, str(source), "text string, at timestamp", 1), within="1 day")
    out = streams.drain(arrived.select("text"), str(tmp_path / "arrived"))
    assert spark.read.parquet(out).count() == 2
