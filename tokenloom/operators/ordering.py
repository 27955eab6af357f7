"""Numbering rows of a table of any size without sorting it in one task.

Rows fall into value ranges of the order key; counts per range give every range
its offset, and only the rows inside one range are sorted together. The ranges
are fixed numbers in the plan, so a recomputed task always lands in the same one.
"""

from __future__ import annotations

import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import broadcast_if_small

#: Rows of one range, about; a range is sorted in one task.
RANGE_ROWS = 1_000_000
#: A table of no more rows is one range: cutting it would cost more than sorting it.
ONE_RANGE_ROWS = 100_000


def numeric_key(df: DataFrame, order_col: str) -> Column:
    """A number that never orders two keys the other way round; equal ones are told apart within their range.

    For text it is made of the bytes that follow what all keys begin with.
    """
    if not isinstance(df.schema[order_col].dataType, T.StringType):
        return F.col(order_col).cast("double")
    ends = df.agg(F.min(order_col).alias("low"), F.max(order_col).alias("high")).first()
    same = len(os.path.commonprefix([(ends["low"] or "").encode(), (ends["high"] or "").encode()]))
    digits = F.hex(F.substring(F.col(order_col).cast("binary"), same + 1, 6))
    return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double")


def with_range(df: DataFrame, order_col: str, name: str = "__range", range_rows: int | None = None) -> DataFrame:
    """Add the number of the equal-share value range the key falls into; ``range_rows``: about how many rows a range has."""
    spark = df.sparkSession
    n_rows = df.select(order_col).count()
    if n_rows <= (ONE_RANGE_ROWS if range_rows is None else range_rows):
        return df.withColumn(name, F.lit(0.0))
    key = numeric_key(df, order_col)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-n_rows // RANGE_ROWS)) if range_rows is None else -(-n_rows // range_rows)
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, shares, 4 * n).alias("cuts")).first()
    cuts = sorted(set(row["cuts"] or []))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    keyed = df.withColumn("__key", key)
    bucketizer = Bucketizer(splits=splits, inputCol="__key", outputCol=name)
    return bucketizer.transform(keyed).drop("__key")


def first_rows(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first ``n`` rows in key order, for any ``n``: whole ranges, and a part of one more."""
    ranged = with_range(df, order_col)
    total, last, before = 0, None, 0
    for r in sorted(ranged.groupBy("__range").count().collect()):  # a row per range
        if total < n:
            last, before = r["__range"], total
        total += r["count"]
    if last is None:
        return df
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order_col))
    part = ranged.filter(F.col("__range") == last).withColumn("__rank", rank).filter(F.col("__rank") <= n - before)
    return ranged.filter(F.col("__range") < last).drop("__range").unionByName(part.drop("__range", "__rank"))


def running_position(df: DataFrame, order_col: str, weight: str | None = None, name: str = "position") -> DataFrame:
    """Add the number of rows (or the sum of ``weight``) before each row in key order.

    ``order_col`` is a number or text without repeats.
    """
    ranged = with_range(df, order_col)
    amount = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    totals = ranged.groupBy("__range").agg(F.sum(amount).alias("__total"))
    # One row per RANGE_ROWS rows: a small window.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__range"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    inside = (
        Window.partitionBy("__range").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(broadcast_if_small(offsets, 64), "__range")
        .withColumn(name, F.col("__offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("__range", "__offset")
    )
