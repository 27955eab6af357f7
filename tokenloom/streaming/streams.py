"""The batch operators on Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.text import pretokenize
from tokenloom.operators.corpus import shuffle_rows
from tokenloom.operators.embed import static_encode
from tokenloom.operators.ordering import with_range
from tokenloom.session import read_text, remove, replace_text, scratch_path
from tokenloom.sources.shards import ROWS_PER_SHARD, write_shards

#: Files per micro-batch unless the caller says otherwise.
FILES_PER_TRIGGER = 100
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_shards(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    max_files: int = FILES_PER_TRIGGER,
    pattern: str = "*.parquet",
) -> DataFrame:
    """The shards below ``path`` as a stream, ``max_files`` at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path)


def stream_token_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Running token counts, for ``complete`` or ``update`` mode."""
    tokens = stream.select(F.explode(pretokenize(F.col(text_col))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("frequency"))


def stream_first_seen(stream: DataFrame, key: str = "text", within: str | None = None, time_col: str | None = None) -> DataFrame:
    """Each key once. The state keeps a 256-bit hash of every key.

    Without ``within`` that is exact and grows with the number of keys. With it, say
    ``"2 days"``, a key is forgotten that long after the row that was kept: a repeat
    inside that time is dropped for sure, a later one may be kept again, and the state
    levels off. Time is ``time_col``, or the arrival of the row.
    """
    hashed = stream.withColumn("__key", F.unhex(F.sha2(F.col(key).cast("string"), 256)))
    if within is None:
        return hashed.dropDuplicates(["__key"]).drop("__key")
    timed = hashed.withColumn("__time", F.current_timestamp() if time_col is None else F.col(time_col).cast("timestamp"))
    return timed.withWatermark("__time", within).dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__time")


def per_batch(
    stream: DataFrame,
    out: str,
    write: Callable[[DataFrame, str], None],
    checkpoint: str | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Run ``write(batch, folder)`` for each micro-batch, with a folder per batch.

    A retried batch writes the same folder again, and the state lives below ``out``
    unless the caller keeps it elsewhere: a second run goes on where the first ended,
    so nothing is stored twice. State of large streams is kept by RocksDB.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{out}/_state"

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return writer.trigger(availableNow=True).foreachBatch(sink).start()
    finally:  # a query keeps the settings it started with
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def _overwrite(batch: DataFrame, folder: str) -> None:
    batch.write.mode("overwrite").parquet(folder)


def drain(
    stream: DataFrame,
    out: str | None = None,
    write: Callable[[DataFrame, str], None] = _overwrite,
    checkpoint: str | None = None,
    output_mode: str = "append",
) -> str:
    """Process everything that has arrived and return the folder with the results."""
    out = out or scratch_path(stream.sparkSession, "stream-out")
    per_batch(stream, out, write, checkpoint, output_mode).awaitTermination()
    return out


def drained_token_counts(stream: DataFrame, text_col: str = "text", checkpoint: str | None = None) -> DataFrame:
    """X1 run to the end: each micro-batch writes the counts it changed; the latest is the largest."""
    out = drain(stream_token_counts(stream, text_col), checkpoint=checkpoint, output_mode="update")
    changes = stream.sparkSession.read.schema("token string, frequency bigint").parquet(out)
    return changes.groupBy("token").agg(F.max("frequency").alias("frequency"))


def stream_encode(
    stream: DataFrame, vocab: DataFrame, weights: DataFrame, out: str, checkpoint: str | None = None, **options
) -> StreamingQuery:
    """Encode each micro-batch with the batch operator."""

    def encode(batch: DataFrame, folder: str) -> None:
        _overwrite(static_encode(batch, vocab, weights, **options), folder)

    return per_batch(stream, out, encode, checkpoint)


def stream_write_shards(
    stream: DataFrame,
    out: str,
    rows_per_shard: int = ROWS_PER_SHARD,
    *,
    model_name: str,
    dataset_name: str,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Write shards as they come into one data set: each micro-batch is a version, published whole.

    A batch that is run again finds its version in the manifest and writes nothing twice.
    """

    def shards(batch: DataFrame, folder: str) -> None:
        if not batch.isEmpty():
            version = f"batch-{folder.rsplit('=', 1)[-1]}"
            write_shards(batch, out, rows_per_shard, model_name=model_name, dataset_name=dataset_name, mode="append", version=version)

    return per_batch(stream, out, shards, checkpoint)


def stream_shuffled(
    stream: DataFrame, out: str, key: str, seed: int = 42, checkpoint: str | None = None
) -> StreamingQuery:
    """P10 on a stream: the rows of each micro-batch in seeded order."""
    return per_batch(stream, out, lambda batch, folder: _overwrite(shuffle_rows(batch, key, seed), folder), checkpoint)


#: Rows that wait in a shuffle buffer unless the caller says otherwise (fixed value of the shuffle).
BUFFER_ROWS = 50_000


def _split_pool(pool: DataFrame, keep: int, path: str) -> DataFrame:
    """The pool with ``__held``: true for the ``keep`` rows of the lowest ``__draw``, stored at ``path``.

    Counts per range of the draw say which range is cut; only its rows are ordered.
    """
    ranged = with_range(pool, "__draw")
    before, cut, room = 0, float("-inf"), 0
    for r in sorted(ranged.groupBy("__range").count().collect()):  # a row per range
        if before < keep:
            cut, room = r["__range"], keep - before
        before += r["count"]
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__draw"))
    whole = ranged.filter(F.col("__range") != cut).withColumn("__held", F.col("__range") < cut)
    part = ranged.filter(F.col("__range") == cut).withColumn("__held", inside <= room)
    whole.unionByName(part).drop("__range").write.mode("overwrite").parquet(path)
    return pool.sparkSession.read.parquet(path)


class ShuffleBuffer:
    """P10 on a stream: a buffer of ``rows`` rows between micro-batches.

    Each micro-batch joins the buffer; a seeded draw says which rows stay, the others
    leave in seeded order. So a row may leave many batches after it came. Draws depend
    on seed, batch and key alone. The buffer is a stored table per batch: a batch that
    is run again starts from the same buffer and writes the same rows, once.
    """

    def __init__(self, spark: SparkSession, out: str, key: str, rows: int = BUFFER_ROWS, seed: int = 42) -> None:
        if rows < 1:
            raise ValueError("the buffer needs room for a row")
        self.spark, self.out, self.key, self.rows, self.seed = spark, out, key, rows, seed
        self.log = f"{out}/_buffer/log.json"

    def _entries(self) -> list[dict]:
        return json.loads(read_text(self.spark, self.log) or "[]")

    def _record(self, entries: list[dict], batch: int, drained: bool) -> None:
        replace_text(self.spark, self.log, json.dumps([*entries, {"batch": batch, "drained": drained}]))

    def _pool(self, batch: int) -> str:
        return f"{self.out}/_buffer/pool-{batch}"

    def _held(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(self._pool(entry["batch"])).filter("__held").drop("__held", "__draw")

    def _emit(self, rows: DataFrame, folder: str, batch: int) -> None:
        shuffle_rows(rows, self.key, self.seed + batch).write.mode("overwrite").parquet(folder)

    def take(self, arrived: DataFrame, batch: int) -> None:
        """One micro-batch: into the buffer, what has no room out."""
        entries = self._entries()
        earlier = [e for e in entries if e["batch"] < batch]
        waiting = earlier[-1] if earlier and not earlier[-1]["drained"] else None
        pool = arrived if waiting is None else arrived.unionByName(self._held(waiting))
        # Equal rows have equal draws: which of them stays makes no difference.
        draw = F.xxhash64(F.col(self.key), F.lit(self.seed), F.lit(batch), F.xxhash64(*[F.col(f"`{c}`") for c in arrived.columns]))
        split = _split_pool(pool.withColumn("__draw", draw), self.rows, self._pool(batch))
        self._emit(split.filter("not __held").drop("__held", "__draw"), f"{self.out}/batch_id={batch}", batch)
        if all(e["batch"] != batch for e in entries):
            self._record(entries, batch, False)
        for e in earlier[:-1]:  # the buffer before the last one is needed no more
            remove(self.spark, self._pool(e["batch"]))

    def drain(self) -> None:
        """Let out what waits, once the stream has ended; the next micro-batch starts with an empty buffer."""
        entries = self._entries()
        if entries and not entries[-1]["drained"]:
            batch = entries[-1]["batch"]
            self._emit(self._held(entries[-1]), f"{self.out}/batch_id={batch}-rest", -1 - batch)
            self._record(entries, batch, True)


def stream_buffer_shuffled(
    stream: DataFrame, out: str, key: str, buffer_rows: int = BUFFER_ROWS, seed: int = 42, checkpoint: str | None = None, last: bool = True
) -> str:
    """P10 on a stream: everything that has arrived, shuffled through a buffer; with ``last`` the buffer is emptied at the end."""
    buffer = ShuffleBuffer(stream.sparkSession, out, key, buffer_rows, seed)
    drain(stream, out, lambda batch, folder: buffer.take(batch, int(folder.rsplit("=", 1)[-1])), checkpoint)
    if last:
        buffer.drain()
    return out
