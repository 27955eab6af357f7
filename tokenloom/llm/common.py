"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.session import materialize, remove, scratch_path

#: A group is hot when it holds more than one in HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot groups.
HOT_SHARE = 1_000
#: Text handled at once inside a task; a longer single text is handled alone, and whole.
CHUNK_BYTES = 2 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def once(value: Column) -> Column:
    """``value``, marked as not to be copied: the planner then works it out in one place and pushes no filter through it."""
    return F.when(F.spark_partition_id() >= 0, value)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def inputs(n: int) -> list[str]:
    """Internal names of packed input columns."""
    return [f"in_{i}" for i in range(n)]


def pack(df: DataFrame, **computed: Column) -> DataFrame:
    """The input columns under internal names beside the computed ones: no name can clash, unused ones are pruned."""
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, inputs(len(df.columns)), strict=True)]
    return df.select(*own, *[v.alias(k) for k, v in computed.items()])


def unpack(df: DataFrame, names: list[str], **computed: Column) -> DataFrame:
    """The packed columns under their names, then the computed ones, which replace columns of the same name."""
    taken = {n.lower() for n in computed}
    kept = [F.col(n).alias(c) for c, n in zip(names, inputs(len(names)), strict=True) if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in computed.items()])


class Scratch:
    """Tables of one operator in a folder of its own, each removed once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.held = spark, scratch_path(spark, name), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.folder}/{len(self.held)}-{name}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(stored)] = (path, stored)  # the frame is kept, so that its id stays its own
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, self.held[id(table)][0])


def file_places(docs: DataFrame) -> Column | None:
    """A number of each row made of its Parquet file and its place in it, if ``docs`` holds just the rows of some files; else ``None``."""
    # Places in a file are below 10^15; two files share a hash as seldom as two digests meet.
    file = F.xxhash64("_metadata.file_path").cast("decimal(38,0)")
    number = (file * F.lit(10**15) + F.col("_metadata.row_index")).cast("decimal(38,0)")
    try:
        docs.select(number)
    except AnalysisException:
        return None
    files = docs.inputFiles()
    whole = files and docs.sparkSession.read.parquet(*files).count() == docs.count()  # from the footers
    return number if whole else None


def numbered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """whole_row (the columns of ``docs``), text, doc_id and row_number, a number of each row that does not change when it is read again.

    Rows that a Parquet reader knows by file and place keep that as their number; others are stored with one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row")
    place = file_places(docs)
    if place is not None:
        stored = docs.select(whole, place.alias("row_number"))
    else:
        stored = materialize(docs.select(whole).withColumn("row_number", F.monotonically_increasing_id()), "numbered")
    return stored.select("whole_row", F.col(f"whole_row.`{text}`").alias("text"), F.col(f"whole_row.`{doc_id}`").alias("doc_id"), "row_number")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left-join each row with its group (one row per ``key`` in ``groups``), whatever the largest group holds.

    Groups of more than 1/HOT_SHARE of all rows are broadcast: there are fewer than HOT_SHARE of them,
    whatever the data. The other rows are shuffled by key; rows already answered get a key of their own,
    so that they spread evenly. ``groups`` should be a stored table, as it is read three times.
    """
    fields = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(size)).first()[0] or 0
    value = F.struct(*fields)
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).select(F.col(key), value.alias("hot_group"))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total)).select(F.col(key).alias("cold_key"), value.alias("cold_group"))
    answered = rows.join(F.broadcast(hot), key, "left")
    spread = F.concat(F.lit("answered "), F.monotonically_increasing_id().cast("string"))
    keyed = answered.withColumn("cold_key", F.when(F.col("hot_group").isNull(), F.col(key)).otherwise(spread))
    joined = keyed.join(cold, "cold_key", "left")
    group = F.coalesce("hot_group", "cold_group")
    return joined.select(*rows.columns, *[group[c].alias(c) for c in fields])


def slices(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column that hold about ``limit`` bytes each, at least one row."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, end
        start = end


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and the n + 1 offsets; null is empty."""
    data = [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
    offsets = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum([len(v) for v in data], out=offsets[1:])
    return np.frombuffer(b"".join(data), dtype=np.uint8), offsets


def by_hash(*cols: Column) -> Column:
    """A pseudo-random order key that every run computes alike."""
    return F.xxhash64(*cols)
