"""Vocabulary tables: counting, merging, pruning and adding tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import pretokenize
from tokenloom.operators.ordering import running_position
from tokenloom.operators.pieces import split_distinct
from tokenloom.operators.tokens import Characters, shared_characters, slice_counts
from tokenloom.session import materialize

#: Pieces that pruning keeps.
SPECIAL_PIECES = ("[UNK]", "[PAD]")


def token_counts(df: DataFrame, text_col: str = "text", ordered: bool = True) -> DataFrame:
    """V1: occurrences of every pre-token, most frequent first.

    Slices of texts are counted by their distinct stretches and combined before the shuffle, so a
    hot token costs one row per task.
    """
    known = shared_characters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = Characters(*known.value)
        for batch in batches:
            yield from (pa.RecordBatch.from_arrays([*c], ["token", "n"]) for c in slice_counts(batch.column(0), characters))

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = texts.mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "token") if ordered else counts


def document_frequency(df: DataFrame, text_col: str = "text") -> DataFrame:
    """V2: rows that contain each token. One row is one document."""
    tokens = df.select(F.explode(F.array_distinct(pretokenize(F.col(text_col)))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("document_frequency"))


def vocabulary_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """V1 and V2 together in one pass and one shuffle.

    Sorting a row's tokens lets each one see whether it repeats its neighbour.
    """
    rows = df.select(F.sort_array(pretokenize(F.col(text_col))).alias("__sorted"))

    def flagged(token: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("__sorted", i - 1) != token)
        return F.struct(token.alias("token"), first.alias("first"))

    tokens = rows.select(F.inline(F.transform("__sorted", flagged)))
    return tokens.groupBy("token").agg(
        F.count("*").alias("frequency"), F.count_if("first").alias("document_frequency")
    )


def merge_vocabularies(dfs: Sequence[DataFrame]) -> DataFrame:
    """V3: all rows of several count tables; a repeated token stays repeated."""
    if not dfs:
        raise ValueError("no vocabularies given")
    return reduce(lambda a, b: a.unionByName(b), [d.select("token", "frequency") for d in dfs])


def piece_usage(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """V4: how often each piece would be used when encoding the counted tokens."""
    totals = counts.groupBy(F.col("token").alias("word")).agg(F.sum("frequency").alias("frequency"))
    # The words are distinct by now: each is split where it stands.
    ids = split_distinct(totals, vocab, carry=("frequency",))
    # Outer: a plain explode adds a filter on the ids that would run the splitting again.
    used = (
        ids.select(F.explode_outer("ids").alias("id"), "frequency").groupBy("id").agg(F.sum("frequency").alias("usage"))
    )
    return vocab.select("piece", "id").join(used, "id", "left").select(
        "piece", "id", F.coalesce("usage", F.lit(0)).cast("bigint").alias("usage")
    )


def renumber(vocab: DataFrame) -> DataFrame:
    """Dense ids in the old order, numbered range by range."""
    placed = running_position(vocab.select("piece", "id"), "id", name="__new")
    return placed.select("piece", F.col("__new").cast("int").alias("id"))


def prune_vocab(
    vocab: DataFrame, usage: DataFrame, min_freq: int, protect: Sequence[str] = SPECIAL_PIECES
) -> DataFrame:
    """V5: drop pieces used less than ``min_freq`` times; one piece always survives."""
    # Stored, a row per piece: numbering reads the table several times, and the usage behind it is costly.
    rated = materialize(vocab.select("piece", "id").join(usage.select("id", "usage"), "id"), "rated")
    kept = (F.col("usage") >= min_freq) | F.col("piece").isin(list(protect))
    found = rated.agg(F.max(kept).alias("any"), F.max("id").alias("last")).first()
    return renumber(rated.filter(kept if found["any"] else F.col("id") == found["last"]))


def add_top_tokens(vocab: DataFrame, counts: DataFrame, new_size: int, filter_numbers: bool = True) -> DataFrame:
    """V6: append the most frequent new tokens until the vocabulary has ``new_size`` pieces."""
    base = vocab.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    missing = new_size - base["n"]
    pieces = vocab.select("piece", F.col("id").cast("int").alias("id"))
    if missing <= 0:
        return pieces
    candidates = counts
    if filter_numbers:
        candidates = candidates.filter(~F.col("token").rlike("^\\p{Nd}+$"))
    best = (
        candidates.join(pieces.select(F.col("piece").alias("token")), "token", "left_anti")
        .groupBy("token")
        .agg(F.max("frequency").alias("frequency"))
    )
    # How many tokens each frequency has says which frequencies are in, and the ids each of them gets: most tokens
    # are rare, so this table of frequencies is far smaller than that of the tokens.
    best = materialize(best, "new-tokens")
    sizes = materialize(best.groupBy("frequency").agg(F.count("*").alias("__n")).withColumn("__down", -F.col("frequency")), "frequencies")
    placed = running_position(sizes, "__down", weight="__n", name="__before").filter(F.col("__before") < missing)
    ranked = best.join(placed.select("frequency", "__before"), "frequency")
    # Only the tokens of one frequency are ordered together; the rarest that is in may have many, of which the first are kept.
    rank = F.row_number().over(Window.partitionBy("frequency").orderBy("token"))
    ranked = ranked.withColumn("__rank", rank).filter(F.col("__before") + F.col("__rank") <= missing)
    first_id = 0 if base["last"] is None else base["last"] + 1
    new_id = (F.col("__before") + F.col("__rank") + (first_id - 1)).cast("int")
    return pieces.unionByName(ranked.select(F.col("token").alias("piece"), new_id.alias("id")))


def expand_vocab(
    vocab: DataFrame, counts: DataFrame, min_freq: int, new_size: int, filter_numbers: bool = True
) -> DataFrame:
    """V7: prune rare pieces (only if ``min_freq`` is positive), then add frequent tokens."""
    if min_freq > 0:
        # Stored: adding tokens looks at the pruned table several times.
        vocab = materialize(prune_vocab(vocab, piece_usage(counts, vocab), min_freq), "pruned")
    return add_top_tokens(vocab, counts, new_size, filter_numbers)


def lowercase_vocab(vocab: DataFrame, specials: Sequence[str] = SPECIAL_PIECES) -> DataFrame:
    """Lower-case every piece but the special ones; colliding pieces share the lowest id."""
    special = F.col("piece").isin(list(specials))
    lowered = F.when(special, F.col("piece")).otherwise(F.lower(F.col("piece")))
    return vocab.groupBy(lowered.alias("piece")).agg(F.min("id").alias("id"))


__all__ = [
    "SPECIAL_PIECES",
    "add_top_tokens",
    "document_frequency",
    "expand_vocab",
    "lowercase_vocab",
    "merge_vocabularies",
    "piece_usage",
    "prune_vocab",
    "renumber",
    "token_counts",
    "vocabulary_table",
]
