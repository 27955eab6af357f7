"""N-gram Jaccard join by rare-first prefix filtering, and the groups its links make.

A document is the set of its word n-grams. Sets are ordered rare first by one
global order; two sets that are similar enough share an n-gram within short
prefixes, so only prefixes are joined. Length, positional and suffix filters drop
candidates before the two whole sets meet, once per pair. The positional filter asks
that a shared n-gram could be the first one that two sets have in common: a pair is
found there, and its later meetings in other buckets mostly fail.

Equal sets are one class from the start, so copies are never paired. Buckets of a
few classes that share a prefix n-gram are joined outright. Large groups
of near copies are not expanded into all pairs: over larger buckets the join runs in rounds,
first of one leader per bucket, then of ever
more leaders, and a pair is left out when earlier links have already put both
into one group. The last round joins every pair that could still connect two
groups, so the groups are exactly those of all links. A parity bitmap of each set
stands beside its prefix, so that most false candidates never leave the join; in the
larger buckets its width is in proportion to the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, inputs, join_groups, numbered, pack, slices, unpack
from tokenloom.llm.tokens import hashed_words, mix64
from tokenloom.session import fits_broadcast, materialize, remove, scratch_path, small_batches

WIDTH = 3
#: Least similarity as a fraction of whole numbers: 100 * shared >= 90 * union. Width and share are defaults, which callers may change.
SHARE, OF = 90, 100
#: Counters of the n-gram frequency sketch, and the parts it is summed in.
COUNTERS, PARTS, SALTS = 1 << 24, 64, 32
#: Rounds in which one leader meets its whole bucket; then the leaders of a bucket grow by this factor per round.
STARS, GROWTH = 3, 8
#: Until the last round, which looks at everything left, a class shows up in its largest buckets only.
PICKED = 3
#: Classes of a bucket whose pairs are all looked at, before any round.
FEW = 8
#: Pairs of a round, per row of the prefixes, below which all that is left is looked at at once.
LINEAR = 4
SUFFIX_DEPTH = 2
#: Bytes of a class in a broadcast.
CLASS_BYTES = 64
#: Words of the parity bitmap that bounds how much two sets can share.
BITMAP = 4
#: In the larger buckets a set has so many bits per n-gram, in a power of two of words, and this many words at most.
WIDE_BITS, WIDE_WORDS = 4, 64
#: Text that a worker hashes at once; the arrays over its bytes take some fifty times that. A longer single text is hashed alone.
TEXT_BYTES = 1 << 19
#: A task counts n-grams in two bytes each; counters that have come so far are emptied into a list.
FULL = 1 << 15


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one set after the other, and the n + 1 offsets.

    A text of fewer words has its whole word sequence as its only n-gram; one without words has none.
    """
    words, at = hashed_words(column)
    n = np.diff(at)
    texts = len(n)
    spans = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(texts), spans)
    first = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    size = np.minimum(n[owner], width)
    value = np.zeros(len(owner), dtype=np.uint64)
    for k in range(width):
        inside = size > k
        value[inside] = mix64(value[inside] * np.uint64(0x9E3779B97F4A7C15) + words[first[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(texts + 1))


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, share: int = SHARE) -> np.ndarray:
    """The least number of shared n-grams that links sets of these sizes."""
    return -(-share * (n + m) // (OF + share))


def prefix_length(n: np.ndarray, share: int = SHARE) -> np.ndarray:
    """How many of the rarest n-grams must be looked at: a linked set shares at least one of them."""
    return n - -(-share * n // OF) + 1


def tally(total: np.ndarray, at: np.ndarray, full: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds one to the two-byte counters ``at``, once for each time they are named; (counters, counts) that reach FULL go to ``full``."""
    for i in range(0, len(at), FULL):  # all counters are below FULL, so that none overflows
        part = at[i : i + FULL]
        np.add.at(total, part, np.uint16(1))
        reached = np.unique(part[total[part] >= FULL])
        if len(reached):
            full.append((reached, total[reached].astype(np.int64)))
            total[reached] = 0


def frequency_sketch(texts: DataFrame, width: int, counters: int = COUNTERS) -> np.ndarray:
    """How often n-grams occur, by hash, over all rows: for each counter a rounded logarithm of its count.

    Two n-grams that share a counter only look more frequent than they are, which changes the order of
    n-grams and so the work, never the result. Its size is fixed: ``counters`` bytes.
    """
    step = counters // PARTS
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}

    def squeezed(counts: np.ndarray) -> dict:
        wide = next(w for w in kinds if counts.max() < 1 << (8 * w - (w == 8)))
        return {"wide": [wide], "counts": [zstandard.ZstdCompressor(level=1).compress(counts.astype(kinds[wide]).tobytes())]}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, full = np.zeros(counters, dtype=np.uint16), [(np.zeros(0, dtype=np.int64),) * 2]
        for batch in batches:
            for a, b in slices(batch.column(0), TEXT_BYTES):
                values, _ = shingle_sets(batch.column(0).slice(a, b - a), width)
                tally(total, (values & np.uint64(counters - 1)).astype(np.int64), full)
        salt = TaskContext.get().partitionId() % SALTS
        places, counts = (np.concatenate(x) for x in zip(*full, strict=True))
        for p in range(PARTS):
            own = total[p * step : (p + 1) * step].astype(np.int64)
            inside = places // step == p
            np.add.at(own, places[inside] - p * step, counts[inside])
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": [p], "salt": [salt]} | squeezed(own))

    def added(group: pa.Table) -> np.ndarray:
        total = np.zeros(step, dtype=np.int64)
        for wide, counts in zip(group["wide"], group["counts"], strict=True):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts.as_py()), dtype=kinds[wide.as_py()])
        return total

    def add(group: pa.Table) -> pa.Table:
        sums = squeezed(added(group))
        return pa.table({"part": group["part"][:1], "wide": pa.array(sums["wide"], pa.int64()), "counts": pa.array(sums["counts"], pa.binary())})

    def level(group: pa.Table) -> pa.Table:
        total = added(group)
        levels = np.where(total > 0, 1 + np.floor(4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        return pa.table({"part": group["part"][:1], "level": pa.array([levels.tobytes()], pa.binary())})

    sent = texts.mapInArrow(count, "part long, salt long, wide long, counts binary")
    salted = sent.groupBy("part", "salt").applyInArrow(add, "part long, wide long, counts binary")
    rows = salted.groupBy("part").applyInArrow(level, "part long, level binary").collect()  # counters bytes in all
    out = np.zeros(counters, dtype=np.uint8)
    for r in rows:
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["level"], dtype=np.uint8)
    return out


def bitmaps(values: np.ndarray, owner: np.ndarray, texts: int, words: int = BITMAP) -> np.ndarray:
    """Per set 64 * ``words`` bits, each the parity of the n-grams that hash there.

    Two bitmaps differ in no more bits than their sets differ in n-grams. With half as many words
    (a power of two) a bitmap is the exclusive or of its halves.
    """
    width = 64 * words
    place = (mix64(values ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(width - 1)).astype(np.int64)
    parity = np.bincount(owner * width + place, minlength=texts * width) & 1
    return np.packbits(parity.astype(np.uint8).reshape(texts, width), axis=1).view(np.int64)


def set_column(text: Column, width: int, levels: Broadcast | None = None, share: int = SHARE) -> Column:
    """struct<n, high, low[, prefix, bits]>: size and 128-bit digest of a text's set, its rarest n-grams in order, its bitmap."""
    kind = [("n", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]
    kind += [("prefix", pa.binary()), ("bits", pa.list_(pa.int64()))] if levels else []

    @F.arrow_udf("struct<n:int,high:bigint,low:bigint" + (",prefix:binary,bits:array<bigint>>" if levels else ">"))
    def made(column: pa.Array) -> pa.Array:
        outs = []
        for a, b in slices(column, TEXT_BYTES):
            values, at = shingle_sets(column.slice(a, b - a), width)
            sizes = np.diff(at)
            fields = [pa.array(sizes.astype(np.int32))]
            for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                run = np.zeros(len(values) + 1, dtype=np.uint64)
                np.cumsum(mix64(values ^ np.uint64(salt)), out=run[1:])
                fields.append(pa.array((run[at[1:]] - run[at[:-1]]).view(np.int64)))
            if levels:
                owner = np.repeat(np.arange(len(sizes)), sizes)
                ordered = values[rare_first(values, owner, levels.value)]
                ends = at[:-1] + np.where(sizes > 0, prefix_length(sizes, share), 0)
                raw = ordered.tobytes()
                fields.append(pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1], ends, strict=True)], pa.binary()))
                bits = bitmaps(values, owner, len(sizes))
                starts = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BITMAP)
                fields.append(pa.ListArray.from_arrays(starts, pa.array(bits.ravel())))
            outs.append(pa.StructArray.from_arrays(fields, names=[k for k, _ in kind]))
        return pa.concat_arrays(outs) if outs else pa.array([], pa.struct(kind))

    return made.asNondeterministic()(text)


def wide_bits(text: Column, width: int) -> Column:
    """A bitmap in proportion to the text's set: sets of hundreds of n-grams that share seven tenths of them fill a narrow one up."""

    @F.arrow_udf("array<bigint>")
    def made(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for a, b in slices(column, TEXT_BYTES):
            values, at = shingle_sets(column.slice(a, b - a), width)
            for i, j in zip(at[:-1], at[1:], strict=True):
                words = BITMAP
                while words < WIDE_WORDS and 64 * words < WIDE_BITS * (j - i):
                    words *= 2
                out.append(bitmaps(values[i:j], np.zeros(j - i, dtype=np.int64), 1, words).ravel())
        ends = np.cumsum([0, *[len(o) for o in out]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *out])))

    return made.asNondeterministic()(text)


def rare_first(values: np.ndarray, owner: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The order of n-grams within their sets: rare first by the sketch, then by hash."""
    return np.lexsort((values, levels[(values & np.uint64(len(levels) - 1)).astype(np.int64)], owner))


def prefix_rows(classes: DataFrame) -> DataFrame:
    """One row per n-gram of each class's prefix: gram, rep, n, pos (its place in the ordered set)."""

    @F.arrow_udf("array<bigint>")
    def unpacked(column: pa.Array) -> pa.Array:
        raw = column.to_pylist()
        ends = np.cumsum([0, *[len(r) // 8 for r in raw]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype=np.int64)))

    listed = classes.select("rep", "n", unpacked.asNondeterministic()("prefix").alias("grams"))
    return listed.select("rep", "n", F.posexplode("grams").alias("pos", "gram"))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """No more n-grams than this can be shared by two sorted sets: both are cut at a middle value, and each part can share no more than its shorter side has."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    middle = y[len(y) // 2]
    i, j = int(np.searchsorted(x, middle)), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    """Whether two whole sets (sorted) are similar enough."""
    need = int(least_overlap(len(a), len(b), share))
    if suffix_bound(a, b, SUFFIX_DEPTH) < need:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def verify(pairs: DataFrame, texts: DataFrame, width: int, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) that are links, from both whole texts."""

    @F.arrow_udf("boolean")
    def check(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros(len(x), dtype=bool)
        for a, b in slices(x, TEXT_BYTES // 2):
            u, at = shingle_sets(x.slice(a, b - a), width)
            v, bt = shingle_sets(y.slice(a, b - a), width)
            out[a:b] = [linked(u[at[i] : at[i + 1]], v[bt[i] : bt[i + 1]], share) for i in range(b - a)]
        return pa.array(out)

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(check.asNondeterministic()("x", "y")).select("a", "b")


def merge_groups(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, group) after the links: each group's label is its smallest member. ``labels``, a scratch table, goes.

    Links are lifted to the groups they join; groups then take the least label next to them and
    follow it to that label's own label until nothing changes. Tables between the steps
    are written to the shared folder.
    """
    a, b = labels.select(F.col("rep").alias("a"), F.col("group").alias("ga")), labels.select(F.col("rep").alias("b"), F.col("group").alias("gb"))
    lifted = links.join(a, "a").join(b, "b").where("ga <> gb").select(F.least("ga", "gb").alias("u"), F.greatest("ga", "gb").alias("v")).distinct()
    edges = scratch.put(lifted, "group-links")
    if edges.isEmpty():
        scratch.drop(edges)
        return labels
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nodes = scratch.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "group-labels")
    settled = False
    while not settled:
        # The least label among the neighbours and itself, then that label's own label.
        seen = both.join(nodes.select(F.col("u").alias("v"), F.col("low").alias("next")), "v").select("u", "next")
        own = nodes.select("u", F.col("low").alias("next"))
        least = seen.unionByName(own).groupBy("u").agg(F.min("next").alias("low"))
        jump = least.select(F.col("u").alias("low"), F.col("low").alias("far"))
        stepped = scratch.put(
            least.join(jump, "low", "left").select("u", F.least("low", F.coalesce("far", "low")).alias("low")), "group-labels"
        )
        settled = stepped.join(nodes.withColumnRenamed("low", "was"), "u").where("low <> was").isEmpty()
        scratch.drop(nodes)
        nodes = stepped
    moved = nodes.select(F.col("u").alias("group"), "low")
    out = scratch.put(labels.join(moved, "group", "left").select("rep", F.coalesce("low", "group").alias("group")), "groups")
    scratch.drop(labels, edges, nodes)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, str, str]:
    """``df`` stored in buckets of ``key`` in the shared folder: later joins on the key do not move it again. Also its table's name and path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table), table, path


def class_texts(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the classes in ``wanted`` (high, low, rep): a text of each.

    Where the wanted classes fit a broadcast, the other texts are left out before any text moves.
    """
    made = docs.select(set_column(F.col(text), width).alias("s"), F.col(text).alias("text")).where("s.n > 0")
    made = made.select(F.col("s.high").alias("high"), F.col("s.low").alias("low"), "text")
    if fits_broadcast(wanted, CLASS_BYTES):
        met = made.join(F.broadcast(wanted), ["high", "low"])
        return met.groupBy("rep").agg(F.first("text").alias("text"))
    return made.groupBy("high", "low").agg(F.first("text").alias("text")).join(wanted, ["high", "low"]).select("rep", "text")


def shared_buckets(shared: DataFrame, order: str = "gram") -> DataFrame:
    """(gram, size, weight): of the n-grams that stand in two prefixes or more, one for each set of classes that share some.

    N-grams of one passage mostly stand in the same prefixes. A pair that meets at one of them meets at
    all, and the filters hold at the first of them for a pair that links and has no rarer n-gram in common,
    so it stands for the others; ``weight`` is how many it stands for. The first is the one with the least
    ``order``: places in the prefixes follow one global order, so all classes agree on it. Sets are compared
    by size and 128 bits.
    """
    members = [F.bit_xor(F.xxhash64("rep", F.lit(salt))).alias(f"members{salt}") for salt in (1, 2)]
    sizes = shared.groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("place"), *members)
    first = F.min_by("gram", "place").alias("gram")
    return sizes.groupBy("size", "members1", "members2").agg(first, F.count(F.lit(1)).alias("weight")).select("gram", "size", "weight")


def class_groups(classes: DataFrame, docs: DataFrame, text: str, width: int, share: int, scratch: Scratch) -> DataFrame:
    """(rep, group) of every class that may be linked with another; ``classes`` has rep, high, low, n, prefix, bits."""
    prefix = prefix_rows(classes)
    # Most n-grams stand in one prefix: they go before anything else is worked out.
    often = prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram")
    met_again = scratch.put(prefix.join(often, "gram"), "shared")
    shared = met_again.join(shared_buckets(met_again, "pos"), "gram").join(classes.select("rep", "bits"), "rep")
    # In a bucket of a few classes all pairs are looked at, which is in proportion to its rows. Most buckets are of this
    # kind, by chance, and most of their pairs fail the filters: such classes need no text.
    few = shared.where(F.col("size") <= FEW).select("gram", "rep", "n", "pos", "bits", F.col("rep").alias("group"))
    others = few.select("gram", *[F.col(c).alias(f"l_{c}") for c in ("rep", "n", "pos", "bits", "group")])
    met = few.join(others, "gram").where((F.col("rep") < F.col("l_rep")) & may_link(share))
    pairs = scratch.put(met.select(F.col("rep").alias("a"), F.col("l_rep").alias("b")).distinct(), "pairs")
    mine = Window.partitionBy("rep")
    largest_first = F.row_number().over(mine.orderBy(F.desc("size"), "gram"))
    # A class whose n-grams are mostly shared stands in the middle of its group: it comes first as a leader.
    rows = shared.where(F.col("size") > FEW).select(
        "gram", "rep", "n", "pos", "bits", F.xxhash64("rep").alias("h"), (largest_first <= PICKED).alias("picked"), (-F.sum("weight").over(mine)).alias("own")
    )
    rows = scratch.put(rows, "prefixes")
    scratch.drop(met_again)
    members = rows.select("rep").unionByName(pairs.select(F.col("a").alias("rep"))).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = scratch.put(classes.select("high", "low", "rep").join(members, "rep"), "members")
    texts, table, place = bucketed(class_texts(docs, text, width, wanted), "rep", "texts")
    # Members of one family of texts meet in many buckets and pass a narrow bitmap: here it is worth a wide one.
    narrow, rows = rows, scratch.put(rows.drop("bits").join(texts.select("rep", wide_bits(F.col("text"), width).alias("bits")), "rep"), "prefixes")
    scratch.drop(narrow)
    labels = scratch.put(wanted.select("rep", F.col("rep").alias("group")), "groups")
    try:
        if not pairs.isEmpty():
            links = scratch.put(verify(pairs, texts, width, share), "links")
            labels = merge_groups(labels, links, scratch)
            scratch.drop(links)
        return _rounds(rows, labels, pairs, texts, width, share, scratch)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        remove(docs.sparkSession, place)


def _rounds(rows: DataFrame, labels: DataFrame, tried: DataFrame, texts: DataFrame, width: int, share: int, scratch: Scratch) -> DataFrame:
    """The groups after all rounds over the larger buckets, ``rows`` (gram, rep, n, pos, bits, h, picked, own); ``tried`` are pairs seen before."""
    total = rows.count()
    spread, last = 0, False  # spread: how far the number of leaders has grown
    turn = 0
    while True:
        own_rows = rows if last else rows.where("picked")
        placed = own_rows.join(labels, "rep")
        fields = ("rep", "n", "pos", "bits", "group")
        first = F.struct("own", "h", *fields)
        state = placed.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("size"), F.min(first).alias("lead"))
        # A bucket whose members are all in one group is done.
        state = state.where("low <> high").select("gram", "size", "lead")
        open_ = placed.join(state, "gram").select("gram", *fields, "own", "h", "size", "lead")
        open_ = scratch.put(open_.withColumn("outside", F.col("group") != F.col("lead.group")), "round")
        facts = open_.agg(F.max("size").alias("largest"), F.sum(F.when(F.col("outside"), F.col("size")).otherwise(0)).alias("work")).first()
        largest = facts["largest"] or 0
        if not largest:
            scratch.drop(open_)
            if last:
                return labels
            last, turn = True, max(turn, STARS)
            continue
        if turn >= STARS and not last and facts["work"] <= LINEAR * total:
            # What is left in the picked buckets is in proportion to the rows: no need for ever more leaders.
            last = True
            scratch.drop(open_)
            continue

        def led(lead: str) -> list[Column]:
            return [F.col(f"{lead}.{c}").alias(f"l_{c}") for c in fields]  # noqa: B023

        others = [f"l_{c}" for c in fields]
        if turn == 0:  # each bucket against its first member
            met = open_.select(*fields, *led("lead"))
        elif turn < STARS:  # and against the first one outside that member's group
            second = open_.where("outside").groupBy("gram").agg(F.min(first).alias("second"))
            met = open_.join(second, "gram").select(*fields, *led("second"))
        else:
            unit = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
            chosen = F.lit(True) if last else unit < F.lit(float(GROWTH**spread)) / F.col("size")
            leaders = open_.where(chosen).select("gram", *[F.col(c).alias(f"l_{c}") for c in (*fields, "outside")])
            # The group of a bucket's first member may be large; it is never joined with itself.
            once = (~F.col("outside") | (F.col("l_rep") < F.col("rep"))) if last else F.lit(True)
            met = leaders.where("l_outside").join(open_, "gram").where(may_link(share) & once).select(*fields, *others)
            if not last:  # where all lead, both orders of a pair come up
                met = met.unionByName(leaders.where("not l_outside").join(open_.where("outside"), "gram").where(may_link(share)).select(*fields, *others))
        pairs = met.where(may_link(share)).select(F.least("rep", "l_rep").alias("a"), F.greatest("rep", "l_rep").alias("b")).distinct()
        pairs = scratch.put(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        scratch.drop(open_)
        tried = tried.unionByName(pairs)
        if not pairs.isEmpty():
            links = scratch.put(verify(pairs, texts, width, share), "links")
            labels = merge_groups(labels, links, scratch)
            scratch.drop(links)
        if last:
            return labels
        turn += 1
        if turn >= STARS:
            spread += 1
            # Once all members of the picked buckets have led, or none is left open, the last round looks at all buckets.
            last = GROWTH**spread >= largest


def may_link(share: int = SHARE) -> Column:
    """The length, positional and bitmap filters for two classes that meet at an n-gram of both prefixes.

    They hold for classes that link at the first n-gram the two have in common, and need not hold at later ones:
    a pair of a family of texts meets at many n-grams and is looked at, if at all, at few.
    """
    n, m = F.col("n").cast("long"), F.col("l_n").cast("long")
    long_enough = F.least(n, m) * OF >= F.greatest(n, m) * share
    need = F.expr(f"({share} * (cast(n as bigint) + l_n) + {OF + share - 1}) div {OF + share}")
    # At the first shared n-gram there is none before it: itself, and what either has behind it.
    most = F.least(F.col("n") - F.col("pos"), F.col("l_n") - F.col("l_pos"))
    return (F.col("group") != F.col("l_group")) & long_enough & (most >= need) & (n + m - bits_apart("bits", "l_bits") >= 2 * need)


def bits_apart(a: str, b: str) -> Column:
    """In how many bits two bitmaps differ; the wider one is folded to the other's words."""

    def folded(bits: str, other: str) -> Column:
        words = F.size(other)
        parity = F.transform(
            F.sequence(F.lit(0), words - 1),
            lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, words), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(bits, j))),
        )
        return F.when(F.size(bits) <= words, F.col(bits)).otherwise(parity)

    both = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda total, x: total + x)


def jaccard_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, share: int = SHARE, row: str | None = None
) -> DataFrame:
    """Every input row with n_shingles (its set's size) and component_id; sets of n-grams of ``width`` words link from ``share`` percent on.

    ``component_id`` is the smallest doc_id that links reach, the row's own included.
    Texts without words, null ones among them, have an empty set and link with
    nothing. Rows without an id take part, but give no name: a group of such rows
    only has the id null. Rows that repeat an id go each by their own text. N-grams
    are compared by 64-bit hashes, whole sets by 128-bit digests of those. Columns
    of these names are replaced, all others pass through. With ``row``, a column of
    stored row numbers, there is also ``kept``: true for each empty set and for one row
    of each group, of its smallest id (null ids come last).
    """
    number = F.col(row) if row else F.lit(0).cast("long")
    with small_batches(docs.sparkSession):
        levels = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs.select(text), width))  # COUNTERS bytes
        made = docs.select(F.col(doc_id).cast("long").alias("id"), number.alias("row"), set_column(F.col(text), width, levels, share).alias("s")).where("s.n > 0")
        classes = made.groupBy(F.col("s.high").alias("high"), F.col("s.low").alias("low")).agg(
            F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("least"), F.count(F.lit(1)).alias("rows"), F.first("s.n").alias("n"), F.first("s.prefix").alias("prefix"), F.first("s.bits").alias("bits")
        )
        scratch = Scratch(docs.sparkSession, "near-copies")
        classes = scratch.put(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
        levels.destroy()  # nothing orders n-grams any more
        groups = class_groups(classes, docs, text, width, share, scratch)
        named = classes.select("high", "low", "least", "rows", "rep").join(groups, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
        ids = named.groupBy("group").agg(F.min("least").alias("least")).select("group", F.col("least.id").alias("component"), F.col("least.row").alias("keep_row"))
        key = F.format_string("%016x%016x", "high", "low")
        named = materialize(named.join(ids, "group").select(key.alias("key"), "component", "keep_row", "rows"), "named-classes")
        remove(docs.sparkSession, scratch.folder)
    packed = pack(docs, id=F.col(doc_id).cast("long"), row=number, s=set_column(F.col(text), width))
    packed = packed.select(
        *inputs(len(docs.columns)), "id", "row", F.col("s.n").alias("n"), F.format_string("%016x%016x", "s.high", "s.low").alias("key")
    )
    # Empty sets are in no class: each gets a key of its own.
    packed = packed.withColumn("key", F.when(F.col("n") > 0, F.col("key")).otherwise(F.concat(F.lit("empty "), F.monotonically_increasing_id())))
    found = join_groups(packed, named, "key", "rows")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    kept = {"kept": (F.col("n") == 0) | (F.col("row") == F.col("keep_row"))} if row else {}
    return unpack(found, docs.columns, n_shingles=F.col("n").cast("long"), component_id=component, **kept)


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """One row of each group, with the columns it came with: of the smallest id, and of rows that repeat that id any one."""
    found = jaccard_groups(numbered(docs, text, doc_id), width=width, share=share, row="row_number")
    return found.where("kept").select(*[F.col(f"whole_row.`{c}`").alias(c) for c in docs.columns])
