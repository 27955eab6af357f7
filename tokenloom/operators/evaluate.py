"""Evaluation: correlation, NDCG, model comparison, agreement (M1-M4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tokenloom.functions.vectors import cosine
from tokenloom.operators.ordering import RANGE_ROWS
from tokenloom.operators.search import nearest_k
from tokenloom.session import broadcast_if_small, materialize


def _cuts(compact: DataFrame, columns: Sequence[str]) -> tuple[Row, int]:
    """In one pass: per column the mean and the values that cut it into ranges of about RANGE_ROWS rows; the number of rows."""
    spark = compact.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-compact.count() // RANGE_ROWS))
    shares = [i / n for i in range(1, n)]
    weight = F.sum("__w")
    found = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        found += [(F.sum(F.col("__w") * value) / weight).alias(f"mean{i}"), F.percentile_approx(value, shares, 4 * n).alias(f"cuts{i}")]
    return compact.agg(weight.alias("n"), *found).first(), n


def _average_ranks(compact: DataFrame, columns: Sequence[str], facts: Row) -> DataFrame:
    """``which, value, rank``: the average rank of each value of each column, for rows that stand for ``__w`` rows each.

    All columns are numbered in one pass: their distinct values, weighted by their
    counts, are ordered within ranges, and the ranges' totals give the offsets.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    counts = compact.select("__w", F.inline(listed)).groupBy("which", "value").agg(F.sum("__w").alias("n"))
    cut = F.lit(0.0)
    for i in range(len(columns)):
        splits = [float("-inf"), *sorted(set(facts[f"cuts{i}"] or [0.0])), float("inf")]
        counts = Bucketizer(splits=splits, inputCol="value", outputCol=f"__cut{i}", handleInvalid="keep").transform(counts)
        cut = F.when(F.col("which") == i, F.col(f"__cut{i}")).otherwise(cut)
    counts = counts.select("which", "value", "n", cut.alias("cut"))
    totals = counts.groupBy("which", "cut").agg(F.sum("n").alias("total"))
    # A row per RANGE_ROWS values.
    order = Window.partitionBy("which").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("which", "cut", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("which", "cut").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return counts.join(offsets, ["which", "cut"]).select("which", "value", (before + (F.col("n") + 1) / 2).alias("rank"))


def sts_correlation(pairs: DataFrame, score_col: str = "score", gold_col: str = "gold") -> DataFrame:
    """M1: Pearson and Spearman correlation of two columns, in one row; pairs with a null do not count.

    Equal pairs are counted first, so a value that most rows share is a few
    rows in the joins. The counts are stored: ranking reads them several times,
    and the scores behind them may be costly. Mean ranks need no pass: they are half of n + 1.
    """
    columns = (score_col, gold_col)
    known = pairs.select(*columns).dropna()
    compact = materialize(known.groupBy(*columns).agg(F.count("*").alias("__w")), "scores")
    facts, _ = _cuts(compact, columns)
    ranks = materialize(_average_ranks(compact, columns, facts), "ranks")
    ranked = compact
    for i, c in enumerate(columns):
        own = ranks.filter(F.col("which") == i).select(F.col("value").alias(f"__value{i}"), F.col("rank").alias(f"__rank{i}"))
        # One of the columns may have a handful of values: its ranks go to the rows as long as they fit.
        ranked = ranked.join(broadcast_if_small(own, 64), F.col(c).cast("double") == F.col(f"__value{i}"))

    def weighted_corr(x: str, y: str, mean_x: float, mean_y: float) -> Column:
        dx, dy = F.col(x).cast("double") - mean_x, F.col(y).cast("double") - mean_y
        top = F.sum(F.col("__w") * dx * dy)
        return top / F.sqrt(F.sum(F.col("__w") * dx * dx) * F.sum(F.col("__w") * dy * dy))

    means = [float(facts[f"mean{i}"] or 0.0) for i in range(2)]
    middle = ((facts["n"] or 0) + 1) / 2
    return ranked.agg(
        weighted_corr(score_col, gold_col, *means).alias("pearson"),
        weighted_corr("__rank0", "__rank1", middle, middle).alias("spearman"),
    )


def ndcg_at_k(
    hits: DataFrame,
    qrels: DataFrame,
    k: int = 10,
    dataset_col: str = "dataset",
    query_id: str = "query_id",
    doc_id: str = "doc_id",
) -> DataFrame:
    """M2: NDCG at ``k`` per data set, over the queries that have a relevant document.

    ``hits(dataset, query_id, doc_id, rank)`` with ranks from 1, ``qrels(dataset,
    query_id, doc_id, rel)``. Result: ``dataset, ndcg, n_queries``.
    """
    keys = [dataset_col, query_id]
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    found = (
        hits.filter(F.col("rank") <= k)
        .join(qrels.filter(F.col("rel") > 0), [*keys, doc_id])
        .groupBy(*keys)
        .agg(F.sum(gain).alias("dcg"))
    )
    # The ideal list needs the k largest grades only; grades are few, so count them
    # instead of sorting every relevant document of a query in one task.
    grades = qrels.filter(F.col("rel") > 0).groupBy(*keys, "rel").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    placed = grades.withColumn("before", before).filter(F.col("before") < k)
    last = F.least(F.col("before") + F.col("n"), F.lit(k))
    ranks = F.sequence(F.col("before") + 1, last)
    discount = F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    ideal = placed.groupBy(*keys).agg(F.sum(F.col("rel") * discount).alias("idcg"))
    per_query = ideal.join(found, keys, "left").select(
        dataset_col, (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg")
    )
    return per_query.groupBy(dataset_col).agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n_queries"))


def mean_over_datasets(scores: DataFrame, score_col: str = "ndcg") -> DataFrame:
    """M2: the plain mean over data sets."""
    return scores.agg(F.avg(score_col).alias(f"mean_{score_col}"))


def compare_models(
    scores: DataFrame,
    models: Sequence[str] = ("teacher", "student"),
    dataset_col: str = "dataset",
    model_col: str = "model",
    score_col: str = "score",
) -> DataFrame:
    """M3: the models' scores side by side per data set, and the gap of the first two."""
    wide = scores.groupBy(dataset_col).pivot(model_col, list(models)).agg(F.avg(score_col))
    return wide.withColumn("gap", F.col(models[0]) - F.col(models[1]))


def mean_agreement(student: DataFrame, teacher: DataFrame, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """M4: the mean cosine between the two models' vectors of the same text."""
    s = student.select(id_col, F.col(vector_col).alias("__s"))
    t = teacher.select(id_col, F.col(vector_col).alias("__t"))
    return s.join(t, id_col).agg(F.avg(cosine(F.col("__s"), F.col("__t"))).alias("mean_cosine"), F.count("*").alias("n"))


def list_overlap(a_hits: DataFrame, b_hits: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """M4: per query of either ranking, the share that their lists have in common: of ``k``, or of the shorter list if it has fewer."""

    def side(hits: DataFrame, name: str) -> DataFrame:
        return hits.select(query_id, doc_id, F.lit(1).alias(name))

    both = side(a_hits, "__a").join(side(b_hits, "__b"), [query_id, doc_id], "full")
    counts = both.groupBy(query_id).agg(F.count("__a").alias("__na"), F.count("__b").alias("__nb"), F.count(F.col("__a") + F.col("__b")).alias("__n"))
    room = F.greatest(F.least("__na", "__nb", F.lit(k)), F.lit(1))
    return counts.select(query_id, (F.col("__n") / room).alias("overlap"))


def teacher_agreement(
    student_queries: DataFrame,
    student_docs: DataFrame,
    teacher_queries: DataFrame,
    teacher_docs: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
) -> DataFrame:
    """M4: overlap of the two models' top-k lists per query."""
    mine = nearest_k(student_queries, student_docs, k, query_id, doc_id)
    theirs = nearest_k(teacher_queries, teacher_docs, k, query_id, doc_id)
    return list_overlap(mine, theirs, k, query_id, doc_id)
