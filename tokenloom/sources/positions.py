"""A row's place in its file, from the file readers' own metadata: what pairs texts and vectors that were written separately."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import broadcast_if_small
from tokenloom.sources.shards import pair_by_position

ShardName = Callable[[Column], Column]


def file_stem(path: Column) -> Column:
    """The file's name without folders and extensions."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def _one_file_each(files: DataFrame, shard: ShardName) -> None:
    """An error where two files of one side have one name: their rows could not be told apart."""
    names = files.sparkSession.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(shard(F.col("path")).alias("shard"))
    twice = names.groupBy("shard").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are called {twice[0]['shard']!r}")


def parquet_rows(spark: SparkSession, paths: Sequence[str], shard: ShardName = file_stem) -> DataFrame:
    """The columns of Parquet files, with ``shard`` and ``row``: the reader numbers the rows of a file itself, in any split."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*paths)
    _one_file_each(rows, shard)
    columns = [c for c in rows.columns if c not in ("shard", "row")]
    return rows.select(*columns, shard(F.col("_metadata.file_path")).alias("shard"), F.col("_metadata.row_index").alias("row"))


def _numbered_in_split(lines: DataFrame) -> DataFrame:
    """Add ``at``: the number of lines before a line in its split. A task reads each of its splits from end to end, in order."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").dictionary_encode()
            begin = batch.column("begin").to_numpy()
            codes = path.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (begin[1:] != begin[:-1])]))
            at = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
            ends = [(path.dictionary[int(codes[i])].as_py(), int(begin[i])) for i in (0, -1)]
            if ends[0] == last:  # the batch goes on with the split of the one before
                at[: first[1] if len(first) > 1 else batch.num_rows] += seen
            last, seen = ends[1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    return lines.mapInArrow(number, T.StructType([*lines.schema.fields, T.StructField("at", T.LongType())]))


def line_rows(spark: SparkSession, paths: Sequence[str], shard: ShardName = file_stem, pattern: str = "*") -> DataFrame:
    """``value`` (a line, blank ones too) of text files, with ``shard`` and ``row``, the line's number in its file.

    A file may be read in several splits: lines per split give each split its
    offset, a line's place in its split is counted where it is read. Nothing is
    sorted, and no text moves.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(list(paths))
    _one_file_each(lines, shard)
    placed = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))
    counts = placed.groupBy("path", "begin").agg(F.count(F.lit(1)).alias("n"))
    # A row per split.
    order = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "begin", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    numbered = _numbered_in_split(placed).join(broadcast_if_small(offsets, 512), ["path", "begin"])
    return numbered.select("value", shard(F.col("path")).alias("shard"), (F.col("offset") + F.col("at")).alias("row"))


def json_rows(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, shard: ShardName = file_stem, pattern: str = "*") -> DataFrame:
    """The fields of files with one JSON object per line, with ``shard`` and ``row``."""
    rows = line_rows(spark, paths, shard, pattern).select(F.from_json("value", schema).alias("__record"), "shard", "row")
    names = [f"__record.`{c}`" for c in rows.schema["__record"].dataType.names if c not in ("shard", "row")]
    return rows.select(*names, "shard", "row")


def pair_files(texts: DataFrame, vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Texts and vectors of the same place in files of the same name, both from this module's readers.

    A text without a vector is an error when the result is read; vectors past the last
    text are left out, as no line asks for them.
    """
    return pair_by_position(texts, vectors.select("shard", "row", vector_col), vector_col=vector_col)
