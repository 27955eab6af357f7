"""How the queries lay out their inputs."""

from tokenloom.plans import queries
from tokenloom.streaming import streams

SF = "/root/testdata/sf0.001"


def test_streamed_tables_have_files_for_all_cores(spark, monkeypatch):
    monkeypatch.setattr(queries, "STREAM_FILE_BYTES", 20_000)
    monkeypatch.setattr(queries, "_PATHS", {})
    out = streams.drain(queries._streamed(spark, SF, "documents").select("doc_id", "text"))
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stored = spark.read.schema("doc_id bigint, text string, batch_id string").parquet(out)
    rows = stored.select("doc_id", "text")
    assert rows.exceptAll(documents).isEmpty() and documents.exceptAll(rows).isEmpty()
    assert stored.select("batch_id").distinct().count() == queries.STREAM_FILES
    (path, per_batch), = queries._PATHS.values()
    files = spark.read.parquet(path).inputFiles()
    assert per_batch > 1 and len(files) == per_batch * queries.STREAM_FILES
