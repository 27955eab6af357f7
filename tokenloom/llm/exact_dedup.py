"""Exact deduplication by skew-safe combining.

Every stage groups by digest *and* full text, so two texts that share a digest
are never merged: Spark first combines equal texts inside each task, then merges
salted digest groups (a third of all rows being one text is spread over the
salts), then combines the winners of the salts. What leaves a stage is one row
per text and salt, however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ascii_lower, join_groups, numbered, pack, unpack
from tokenloom.session import materialize

SALTS = 16


def text_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, row: str | None = None) -> DataFrame:
    """One row per distinct normalised text: digest, text, keep_id, group_size.

    With ``row``, a column of row numbers, also keep_row: the least number among the rows of the largest id.
    """
    norm = ascii_lower(F.col(text))
    # The largest of these stays; null ids are the smallest.
    order = F.struct(F.col(doc_id).alias("id"), (-F.col(row)).alias("back")) if row else F.col(doc_id)
    rows = docs.select(
        F.sha2(norm, 256).alias("digest"),
        norm.alias("norm"),
        F.pmod(F.xxhash64(F.col(row or doc_id)), F.lit(salts)).alias("salt"),
        order.alias("order"),
    )
    salted = rows.groupBy("digest", "norm", "salt").agg(F.max("order").alias("order"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.max("order").alias("order"), F.sum("n").alias("group_size"))
    kept = [F.col("order.id").alias("keep_id"), (-F.col("order.back")).alias("keep_row")] if row else [F.col("order").alias("keep_id")]
    return groups.select("digest", "norm", *kept, "group_size")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, row: str | None = None) -> DataFrame:
    """Every input row with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as
    empty. Of equal texts the row with the largest id stays; ids that are null
    come last, and stay only in a group that has no other. Rows that repeat an id
    *and* its text are one document: they share ``kept``. With ``row``, a column of
    stored row numbers, one row of each group is ``kept`` and no other. Columns of
    these names in the input are replaced; all others pass through.
    """
    groups = text_groups(docs, text, doc_id, salts, row)
    fields = ["keep_id", *(["keep_row"] if row else [])]
    # The texts were compared; from here on a digest stands for its text unless two texts share it.
    by_digest = materialize(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), *[F.max(c).alias(c) for c in fields], F.sum("group_size").alias("group_size")
        ),
        "digests",
    )
    norm = ascii_lower(F.col(text))
    rows = pack(docs, digest=F.sha2(norm, 256), id=F.col(doc_id), **({"row": F.col(row)} if row else {}))
    joined = join_groups(rows, by_digest, "digest", "group_size")
    if not by_digest.where("texts > 1").isEmpty():
        shared = by_digest.where("texts > 1").select("digest")
        apart = materialize(groups.join(shared, "digest", "left_semi"), "shared-digests")
        again = joined.where("texts > 1").drop("texts", *fields, "group_size")
        again = again.withColumn("norm", ascii_lower(F.col(f"in_{docs.columns.index(text)}"))).join(apart, ["digest", "norm"]).drop("norm")
        joined = joined.where("texts = 1").drop("texts").unionByName(again)
    return unpack(
        joined,
        docs.columns,
        keep_id=F.col("keep_id"),
        group_size=F.col("group_size"),
        kept=F.col("row") == F.col("keep_row") if row else F.col("id").eqNullSafe(F.col("keep_id")),
        text_sha256=F.col("digest"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group, with the columns it came with: of the largest id, and of rows that repeat that id any one."""
    tagged = exact_dedup(numbered(docs, text, doc_id), row="row_number")
    return tagged.where("kept").select(*[F.col(f"whole_row.`{c}`").alias(c) for c in docs.columns])
