"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark go into a hash table held as one constant: an array
of buckets, each with the windows that hash there. Each document hashes its own
windows, looks the bucket up by position, and compares the full words of a window
whose hash is found. Nothing is shuffled and no row leaves its task. A benchmark
larger than one table is taken in blocks, every document against every block.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import ascii_lower, inputs, once, pack, unpack
from tokenloom.session import materialize

WIDTH = 10
#: Windows in one table; a larger benchmark takes several passes.
BLOCK_WINDOWS = 50_000
#: Everything that is not a digit, a letter or beyond ASCII parts words (after lower-casing).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TABLE = "array<array<struct<h:bigint,w:array<string>,items:array<string>>>>"


def words(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def window_at(tokens: Column, start: Column, length: int) -> Column:
    """``length`` elements from ``start``; element by element, as slice() copies the whole array first."""
    return F.array(*[F.get(tokens, start + k) for k in range(length)])


def window_hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(length)])


def starts(tokens: Column, length: int) -> Column:
    """0 .. the last place where a window of ``length`` fits; empty if none does."""
    n = F.size(tokens)
    return F.when(n >= length, F.sequence(F.lit(0), n - F.lit(length))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """One row per distinct window: length, w (its words), h (hash), items (ids as text)."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("tokens"))
    long_ = items.where(F.size("tokens") >= width).select(
        "item", F.explode(F.transform(starts(F.col("tokens"), width), lambda i: window_at(F.col("tokens"), i, width))).alias("w")
    )
    short = items.where((F.size("tokens") < width) & (F.size("tokens") > 0)).select("item", F.col("tokens").alias("w"))
    return (
        long_.unionByName(short)
        .groupBy("w")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
        .select(
            F.size("w").alias("length"),
            "w",
            F.xxhash64("hashes").alias("h"),
            F.xxhash64(F.get("hashes", F.lit(0)), F.get("hashes", F.lit(1))).alias("head"),
            "items",
        )
    )


def hash_table(rows: list, buckets: int) -> Column:
    """The windows of one length as a constant array of buckets."""
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for r in rows:
        table[r["h"] % buckets].append({"h": r["h"], "w": list(r["w"]), "items": list(r["items"])})
    return F.from_json(F.lit(json.dumps(table)), TABLE)


def head_flags(rows: list) -> tuple[Column, int]:
    """A constant array of 0 and 1: where the first two words of some window hash to."""
    heads = {r["head"] for r in rows}
    size = 1 << max(4, (16 * len(heads)).bit_length())
    flags = ["0"] * size
    for h in heads:
        flags[h % size] = "1"
    return F.from_json(F.lit("[" + ",".join(flags) + "]"), "array<tinyint>"), size


def hits_of(tokens: Column, hashes: Column, length: int, rows: list) -> Column:
    """array<struct<i, length, items>>: the places of a document where windows of ``length`` stand."""
    buckets = 1 << max(4, (8 * len(rows)).bit_length())
    table = hash_table(rows, buckets)

    def bucket(h: Column) -> Column:
        return F.get(table, F.pmod(h, F.lit(buckets)).cast("int"))

    def hashed(i: Column) -> Column:
        return window_hash(hashes, i, length)

    places = starts(tokens, length)
    if length > 1:  # most places fail on their first two words, which cost a fifth of the whole window
        flags, size = head_flags(rows)
        places = F.filter(places, lambda i: F.get(flags, F.pmod(window_hash(hashes, i, 2), F.lit(size)).cast("int")) == 1)
    candidates = F.filter(places, lambda i: F.exists(bucket(hashed(i)), lambda e: e["h"] == hashed(i)))
    verified = F.transform(
        candidates,
        lambda i: F.struct(
            i.alias("i"),
            F.lit(length).alias("length"),
            F.flatten(
                F.transform(F.filter(bucket(hashed(i)), lambda e: e["w"] == window_at(tokens, i, length)), lambda e: e["items"])
            ).alias("items"),
        ),
    )
    return F.filter(verified, lambda x: F.size(x["items"]) > 0)


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    width: int = WIDTH,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Every input row with n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    A window is ``width`` consecutive words of an item; an item of fewer words,
    but not none, is one window. A word of a document is hit when it lies in an
    occurrence of any window. ``hit_spans`` lists the occurrences as struct(start,
    length) in words. Null and empty texts have no words; an item without an id
    counts under the empty id; repeated items and rows count each as themselves.
    Columns of these names in the input are replaced, all others pass through.
    """
    names = docs.columns
    windows = materialize(
        benchmark_windows(benchmark, text, item_id, width).withColumn("block", F.lit(0)), "windows"
    )
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    frame = pack(docs, tokens=once(words(F.col(text)))).withColumn("hashes", once(F.transform("tokens", lambda x: F.xxhash64(x))))
    frame = frame.withColumn("hits", F.array().cast("array<struct<i:int,length:int,items:array<string>>>"))
    for k in range(blocks):
        rows = windows.where(F.pmod("h", F.lit(blocks)) == k).collect() if n else []
        for length in sorted({r["length"] for r in rows}):
            same = [r for r in rows if r["length"] == length]
            frame = frame.withColumn("hits", once(F.concat("hits", hits_of(F.col("tokens"), F.col("hashes"), length, same))))
        if blocks > 1:
            frame = materialize(frame, "scanned")
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["i"], x["i"] + x["length"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    found = frame.select(*inputs(len(names)), "tokens", "hits", F.size(places).cast("long").alias("n_hit"), items.alias("items"))
    return unpack(
        found,
        names,
        n_words=F.size("tokens").cast("long"),
        n_hit=F.col("n_hit"),
        n_items=F.size("items").cast("long"),
        items_sha256=F.sha2(F.concat_ws(",", "items").cast("binary"), 256),
        contaminated=F.col("n_hit") > 0,
        hit_spans=F.array_sort(F.transform("hits", lambda x: F.struct(x["i"].alias("start"), x["length"].alias("length")))),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row"), F.col(text).alias("text"))
    found = find_benchmark(packed, benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), width=width)
    return found.where(~F.col("contaminated")).select(*[F.col(f"whole_row.`{c}`").alias(c) for c in names])


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Every document, its text replaced by the normalised words that were not hit, joined by a space."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row"), F.col(text).alias("text"))
    found = find_benchmark(packed, benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), width=width)
    gone = F.array_distinct(F.flatten(F.transform("hit_spans", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    tokens = words(F.col("text"))
    at = F.array_except(F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>")), gone)
    left = F.concat_ws(" ", F.transform(at, lambda i: F.get(tokens, i)))
    cleaned = F.when(F.col("contaminated"), left).otherwise(F.col("text"))
    return found.select(*[(cleaned if c == text else F.col(f"whole_row.`{c}`")).alias(c) for c in names])
