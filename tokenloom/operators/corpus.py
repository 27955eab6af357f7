"""Corpus shaping: projections, unpivots, unions, batches and shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import strip_space
from tokenloom.operators.ordering import first_rows, running_position


def text_field(df: DataFrame, column: str) -> DataFrame:
    """One column becomes ``text``; everything else is dropped."""
    return df.select(F.col(column).alias("text"))


def join_array_text(df: DataFrame, array_col: str, sep: str = " ") -> DataFrame:
    """Join a string array into ``text`` and drop blank rows; source columns stay."""
    joined = df.withColumn("text", F.array_join(array_col, sep))
    return joined.filter(F.length(strip_space(F.col("text"))) > 0)


def unpivot_text(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """The given columns as rows ``(order_col, pos, text)``."""
    texts = F.array(*[F.col(c) for c in columns])
    return df.select(F.col(order_col), F.posexplode(texts).alias("pos", "text"))


def unpivot_first_seen(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """Like P4, but each text only where it occurs first.

    The minimum combines before the shuffle, so a text repeated millions of
    times reaches the reducer once per task.
    """
    rows = unpivot_text(df, columns, order_col)
    first = rows.groupBy("text").agg(F.min(F.struct(order_col, "pos")).alias("__first"))
    return first.select(f"__first.{order_col}", "__first.pos", "text")


def union_subsets(dfs: Sequence[DataFrame]) -> DataFrame:
    """P5: all rows of all subsets, duplicates kept."""
    if not dfs:
        raise ValueError("no subsets given")
    return reduce(lambda a, b: a.unionByName(b), dfs)


def rename_and_prune(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ("text",)) -> DataFrame:
    """Rename columns, then keep only the named ones."""
    return df.withColumnsRenamed(dict(mapping)).select(*keep)


def limit_batches(df: DataFrame, n: int, batch_size: int, order_col: str) -> DataFrame:
    """The rows of the first ``n`` batches; at least one batch is always processed.

    Counts per value range of the key say which range holds the last row; only that range is sorted.
    """
    return first_rows(df, max(1, n) * batch_size, order_col)


def assign_batches(df: DataFrame, batch_size: int, order_col: str, name: str = "batch_id") -> DataFrame:
    """Number consecutive batches of ``batch_size`` rows; the last one may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    numbered = running_position(df, order_col, name="__position")
    batch = F.floor(F.col("__position") / batch_size).cast("bigint")
    return numbered.withColumn(name, batch).drop("__position")


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """P10: a repeatable shuffle: sort by a seeded hash of the key, not by a random draw."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
