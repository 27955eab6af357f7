"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of about ``block_docs`` documents by a hash of the
row. A source's quota is an exact number of block copies. A binary tree over the
output shards splits the vector of quotas: at each node the left half's share is
one multivariate hypergeometric draw, seeded by the node, so that any task can
work out any shard's exact quotas by walking down from the root. Shards own
disjoint ranges of each source's permuted block sequence, and order their
documents locally. Documents meet only the plan of their own block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import inputs, join_groups, pack, unpack
from tokenloom.llm.tokens import count_words
from tokenloom.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
BLOCK_DOCS, SHARD_BLOCKS = 1024, 64
SEED = 20_231
#: Tables with one row per source are broadcast up to this many sources (about 10 MB).
MAX_BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``cap`` times a size is shared again."""
    size = np.asarray(sizes, dtype=np.float64)
    weight = np.asarray([weights[i % len(weights)] for i in range(len(size))])
    out = np.zeros(len(size))
    full = np.zeros(len(size), dtype=bool)
    while not full.all():
        left = share * size.sum() - cap * size[full].sum()
        out = np.where(full, cap * size, left * weight / weight[~full].sum())
        over = ~full & (out > cap * size)
        if not over.any():
            break
        full |= over
        out = np.where(full, cap * size, out)
    return out.tolist()


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a shard's blocks begin in each source's sequence, and how many it has of each."""
    total = int(quotas.sum())
    before = np.zeros(len(quotas), dtype=np.int64)
    own = quotas.astype(np.int64)
    low, high = 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        room = total * mid // shards - total * low // shards
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(own, room, method="marginals")
        if shard < mid:
            own, high = left, mid
        else:
            before, own, low = before + left, own - left, mid
    return before, own


def fill_gap(sizes: np.ndarray, gap: float) -> np.ndarray:
    """Which documents, in the given order, bring a block's total near ``gap``."""
    taken = np.zeros(len(sizes), dtype=bool)
    for i, n in enumerate(sizes):
        if n <= gap:
            taken[i] = True
            gap -= n
    rest = np.flatnonzero(~taken)
    if len(rest):
        nearest = rest[np.argmin(np.abs(sizes[rest] - gap))]
        taken[nearest] = abs(sizes[nearest] - gap) < gap
    return taken


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block_docs: int = BLOCK_DOCS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """Every input row with size, source_size, target, taken and copies.

    ``copies`` is array<struct<copy, shard, place>>: the shards that hold the row
    and its place there; ``taken`` is its size times their number, which is never
    above ``cap`` times the size. Sources come in code-point order, null last, and
    weigh ``weights`` in turn. A null text has size 0; rows of size 0 and rows
    that are equal in id and text share one fate. An empty table gives an empty
    result. Columns of these names are replaced, all others pass through.
    Reruns agree: every draw is seeded and every order is a hash of the row.
    """
    spark = docs.sparkSession
    src = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text))
    units = materialize(docs.select(src.alias("src"), count_words(F.col(text)).alias("size"), key.alias("u")), "units")
    stats = units.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")).collect()  # a row per source
    stats.sort(key=lambda r: r["src"].encode())
    target = targets([r["words"] for r in stats], weights, share, cap)
    rows = []
    for r, t in zip(stats, target, strict=True):
        whole = int(min(cap, t // r["words"])) if r["words"] else 0
        rows.append((r["src"], r["docs"], r["words"], t, whole, t - whole * r["words"], -(-r["docs"] // block_docs)))
    sources = spark.createDataFrame(rows, "src string, docs long, source_size long, target double, whole int, extra double, blocks long")

    def with_source(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(sources), "src") if len(rows) <= MAX_BROADCAST_SOURCES else join_groups(df, sources, "src", "docs")
        unit = F.col("u").cast("double") / F.lit(2.0**64) + 0.5
        return joined.withColumn("block", F.least(F.col("blocks") - 1, F.floor(unit * F.col("blocks"))))

    blocks = with_source(units).groupBy("src", "block").agg(
        F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("extra").alias("extra")
    )
    blocks = materialize(blocks, "blocks")

    def order(tag: int) -> Window:
        return Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + tag), "src", "block"), "block")

    upto = F.sum("words").over(order(9).rowsBetween(Window.unboundedPreceding, 0))
    planned = blocks.select(
        "*",
        upto.alias("upto"),
        F.count(F.lit(1)).over(Window.partitionBy("src")).alias("present"),
        (F.row_number().over(order(9)) - 1).alias("rank_extra"),
        *[(F.row_number().over(order(c)) - 1).alias(f"rank_{c}") for c in range(int(cap))],
    )
    planned = planned.withColumn("full", (F.col("words") > 0) & (F.col("upto") <= F.col("extra"))).withColumn(
        "edge", (F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("words") < F.col("extra"))
    )
    planned = materialize(planned, "planned")

    drawn = planned.select(
        "src",
        "block",
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.when(
                            F.col("whole") > c,
                            F.struct(F.lit(c).alias("copy"), (F.col("present") * c + F.col(f"rank_{c}")).alias("at")),
                        )
                        for c in range(int(cap))
                    ],
                    F.when(
                        F.col("full") | F.col("edge"),
                        F.struct(F.col("whole").alias("copy"), (F.col("present") * F.col("whole") + F.col("rank_extra")).alias("at")),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("c"),
    ).select("src", "block", F.col("c.copy").alias("copy"), F.col("c.at").alias("raw"))
    # Blocks of no words may stand between the full ones: ranks are made dense again.
    dense = F.row_number().over(Window.partitionBy("src").orderBy("raw")) - 1
    drawn = materialize(drawn.select("src", "block", "copy", dense.cast("long").alias("at")), "drawn")
    counts = {r["src"]: r["n"] for r in drawn.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [r[0] for r in rows if r[0] in counts]
    quotas = np.asarray([counts[n] for n in names], dtype=np.int64)
    shards = max(1, -(-int(quotas.sum()) // shard_blocks)) if names else 1

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                before, own = shard_quotas(quotas, shards, int(shard), seed)
                yield pd.DataFrame(
                    {
                        "src": np.repeat(np.asarray(names, dtype=object), own),
                        "at": np.concatenate([np.arange(b, b + n) for b, n in zip(before, own, strict=True)] or [np.zeros(0, np.int64)]),
                        "shard": np.int64(shard),
                    }
                )

    owners = spark.range(shards).mapInPandas(leaves, "src string, at long, shard long")
    plan = drawn.join(owners, ["src", "at"]).groupBy("src", "block").agg(F.collect_list(F.struct("copy", "shard")).alias("copies"))

    edge = planned.where("edge").select("src", "block", (F.col("extra") - F.col("upto") + F.col("words")).alias("gap"))
    inside = with_source(units).select("src", "block", "u", "size").join(edge, ["src", "block"])
    inside = inside.groupBy("src", "block", "u").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        taken = fill_gap(pdf["size"].to_numpy(), float(pdf["gap"].iloc[0]))
        return pd.DataFrame({"src": [pdf["src"].iloc[0]], "block": [pdf["block"].iloc[0]], "chosen": [pdf["u"].to_numpy()[taken].tolist()]})

    chosen = inside.groupBy("src", "block").applyInPandas(near, "src string, block long, chosen array<bigint>")
    plan = materialize(plan.join(chosen, ["src", "block"], "left"), "plan")

    packed = with_source(pack(docs, src=src, size=count_words(F.col(text)), u=key))
    joined = packed.join(plan, ["src", "block"], "left")
    mine = F.filter(
        F.coalesce("copies", F.array().cast("array<struct<copy:int,shard:bigint>>")),
        lambda c: F.col("chosen").isNull() | (c["copy"] < F.col("whole")) | F.array_contains("chosen", F.col("u")),
    )
    placed = F.array_sort(
        F.transform(
            mine,
            lambda c: F.struct(
                c["copy"].alias("copy"), c["shard"].alias("shard"), F.xxhash64(F.lit(seed), c["shard"], c["copy"], F.col("u")).alias("place")
            ),
        )
    )
    done = joined.select(*inputs(len(docs.columns)), "size", "source_size", "target", placed.alias("copies"))
    return unpack(
        done,
        docs.columns,
        size=F.col("size"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        taken=F.col("size") * F.size("copies"),
        copies=F.col("copies"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per taken copy: the input's columns, then copy, shard and place, which orders the shard."""
    names = [c for c in docs.columns if c.lower() not in ("copy", "shard", "place")]
    mixed = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mixed_row"), "text", "source", "doc_id"), **options)
    exploded = mixed.select("mixed_row", F.explode("copies").alias("c"))
    return exploded.select(*[F.col(f"mixed_row.`{c}`").alias(c) for c in names], "c.copy", "c.shard", "c.place")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the mix, one folder per shard, each shuffled locally."""
    rows = mixed_rows(docs, **options)
    rows.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
