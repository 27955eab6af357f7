"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision node has a binary context tree
over the preceding bytes, whose nodes hold Krichevsky-Trofimov estimates. The
weighted probability of the training text at a node gives the weight of stopping
there against going deeper, and a byte's code length mixes the estimates of all
depths by these weights. The counts of byte strings and of words come from the
whole training corpus, combined inside tasks first. The tree is whole and stays
in stored tables; only the values of the strings used most are broadcast, as a
cache, and the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import flat_bytes, slices
from tokenloom.llm.tokens import LOWERED, word_bounds, word_hashes
from tokenloom.session import materialize

DEPTH = 4
#: Byte strings and words in the broadcast tables, at most; all others are looked up by joins.
MAX_STRINGS, MAX_WORDS = 600_000, 1 << 19
#: Rows of the tree worked out at once inside a task. Strings that differ in two bytes only are never
#: apart: there are 2^16 of them at most.
TREE_ROWS = 1 << 18
#: Text scored or counted at once inside a task.
CHUNK = 1 << 20
#: 0xFF is in no UTF-8 text: it stands before a text and ends it.
EDGE = 0xFF
#: The key of the token that ends a text.
END_TOKEN = np.uint64(0x5E0D5E0D5E0D5E0D)
WORD, STRING = 0, 1


def byte_strings(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with its context as one number (the byte lowest, then backwards), and where each text begins.

    Every text counts its bytes and one end.
    """
    texts = len(offsets) - 1
    lengths = np.diff(offsets)
    gap = depth + 1
    stream = np.full(len(data) + texts * gap, EDGE, dtype=np.uint8)
    inside = np.arange(len(data)) + np.repeat(depth + gap * np.arange(texts), lengths)
    stream[inside] = data
    keys = stream.astype(np.uint64)
    for d in range(1, depth + 1):
        keys[d:] |= stream[:-d].astype(np.uint64) << np.uint64(8 * d)
    counted = np.ones(len(stream), dtype=bool)
    starts = offsets[:-1] + gap * np.arange(texts)
    for d in range(depth):
        counted[starts + d] = False
    return keys[counted], np.append(offsets[:-1] + np.arange(texts), offsets[-1] + texts)


class Counter:
    """Counts of 64-bit keys, merged now and then so that memory follows the distinct keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.pending += len(part[0])
        if self.pending > 1_000_000 and len(self.parts) > 4:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        found, at = np.unique(keys, return_inverse=True)
        self.parts = [(found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64))]
        self.pending = 0
        return self.parts[0]


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_bytes(column)
    return LOWERED[data], offsets


def count_corpus(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind (WORD or STRING), key, n and uses over all rows of a table of texts.

    A second column, if there is one, says which rows are learned from: only these
    count for ``n``. Strings of the other rows are listed too, and ``uses`` counts
    all rows.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("uses", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {(WORD, True): Counter(), (STRING, True): Counter(), (STRING, False): Counter()}
        texts = 0
        for batch in batches:
            column = batch.column(0)
            learned = np.ones(len(column), dtype=bool)
            if batch.num_columns > 1:
                learned = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            texts += int(learned.sum())
            for own in (True, False):
                chosen = column.filter(pa.array(learned == own))
                for a, b in slices(chosen, CHUNK):
                    data, offsets = folded(chosen.slice(a, b - a))
                    if own:
                        first, last, _ = word_bounds(data, offsets)
                        counters[WORD, True].add(word_hashes(data, first, last))
                    counters[STRING, own].add(byte_strings(data, offsets, depth)[0])
        for (kind, own), counter in counters.items():
            keys, counts = counter.merge()
            for i in range(0, len(keys), 1 << 18):
                k, c = keys[i : i + (1 << 18)].view(np.int64), counts[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c * own), pa.array(c)], schema=schema)
        if texts:
            yield pa.RecordBatch.from_pylist([{"kind": WORD, "key": int(END_TOKEN), "n": texts, "uses": texts}], schema)

    counted = texts.mapInArrow(count, "kind int, key long, n long, uses long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def least_count(counts: DataFrame, most: int, steps: int = 1_024) -> int:
    """The least n such that no more than ``most`` rows have a count of n or above.

    Rows are counted by ranges of n, then by narrower ranges inside the one where the sum passes ``most``;
    each turn sends ``steps`` rows to the driver at most, whatever the counts are.
    """
    low, high, above = 0, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0  # ``above`` rows, no more than ``most``, have ``high`` or more
    while True:
        width = -(-(high - low) // steps)
        inside = counts.where((F.col("n") >= low) & (F.col("n") < high))
        ranges = inside.groupBy(F.expr(f"(n - {low}L) div {width}L").alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # steps rows at most
        for r in sorted(ranges, key=lambda r: -r["step"]):
            if above + r["rows"] > most:
                low, high = low + r["step"] * width, min(high, low + (r["step"] + 1) * width)
                break
            above += r["rows"]
        else:
            return low
        if high - low == 1:
            return high


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2), by products for small n and Stirling's series above."""
    return _log_gamma(n, 0.5, 0.5 * np.log(np.pi))


def log_factorial(n: np.ndarray) -> np.ndarray:
    return _log_gamma(n, 1.0, 0.0)


def _log_gamma(n: np.ndarray, shift: float, first: float) -> np.ndarray:
    small = np.concatenate([[first], first + np.cumsum(np.log(np.arange(255) + shift))])
    x = np.maximum(n, 64) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 256, small[np.minimum(n, 255).astype(np.int64)], series)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a string with so many zeros and ones."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - np.log(np.pi) - log_factorial(zeros + ones)


def decisions(strings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of the lowest byte: the node (context and bits before) and the bit."""
    symbol = strings & np.uint64(255)
    context = strings & ~np.uint64(255)
    for k in range(8):
        node = context | np.uint64(1 << k) | (symbol >> np.uint64(8 - k))
        yield node, (symbol >> np.uint64(7 - k)) & np.uint64(1)


def mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * (depth + 1))) - 1)


def subtree(strings: dict[int, tuple[np.ndarray, np.ndarray]], top: int, depth: int) -> dict[int, dict[str, np.ndarray]]:
    """Nodes by depth from ``depth`` up to ``top``: key, one (chance of a one), stop (weight of stopping), weighted."""
    out: dict[int, dict[str, np.ndarray]] = {}
    for d in range(depth, top - 1, -1):
        keys, n = strings[d]
        nodes, bits = (np.concatenate(x) for x in zip(*decisions(keys), strict=True)) if len(keys) else (np.zeros(0, np.uint64),) * 2
        key, at = np.unique(nodes, return_inverse=True)
        times = np.tile(n, 8).astype(np.float64)
        ones = np.bincount(at, weights=times * bits, minlength=len(key))
        zeros = np.bincount(at, weights=times, minlength=len(key)) - ones
        stop = kt_block(zeros, ones)
        weighted = stop
        if d < depth:
            child = out[d + 1]
            parent = np.searchsorted(key, child["key"] & mask(d))
            deeper = np.bincount(parent, weights=child["weighted"], minlength=len(key))
            weighted = np.logaddexp(stop, deeper) - np.log(2)
        out[d] = {
            "key": key,
            "zeros": zeros,
            "ones": ones,
            "one": (ones + 0.5) / (zeros + ones + 1),
            "stop": np.exp(stop - np.log(2) - weighted) if d < depth else np.ones(len(key)),
            "weighted": weighted,
        }
    return out


def log10_of(strings: np.ndarray, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each string's byte after its context; ``nodes`` by depth are (key, one, stop).

    A node that was never seen has no counts anywhere below, so it says one half.
    """
    total = np.zeros(len(strings))
    for full, bit in decisions(strings):
        chance = np.full(len(strings), 0.5)
        for d in range(len(nodes) - 1, -1, -1):
            key, one, stop = nodes[d]
            if not len(key):
                continue
            node = full & mask(d)
            at = np.minimum(np.searchsorted(key, node), len(key) - 1)
            seen = key[at] == node
            own = np.where(bit == 1, one[at], 1 - one[at])
            chance = np.where(seen, stop[at] * own + (1 - stop[at]) * chance, 0.5)
        total += np.log10(chance)
    return total


class Lookup:
    """Values of 64-bit keys: keys sorted by hash, and where each hash begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        h = self.hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.begin = np.searchsorted(h[order], np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (0 where missing) and whether each key is there."""
        out, found = np.zeros(len(wanted), dtype=self.values.dtype), np.zeros(len(wanted), dtype=bool)
        if not len(self.keys):
            return out, found
        h = self.hash(wanted)
        at, end = self.begin[h], self.begin[h + np.uint64(1)]
        same = (at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
        out[same], found[same] = self.values[at[same]], True
        open_ = np.flatnonzero(~same & (at + 1 < end))
        at, end = at[open_] + 1, end[open_]
        while len(open_):
            same = self.keys[at] == wanted[open_]
            out[open_[same]], found[open_[same]] = self.values[at[same]], True
            go = ~same & (at + 1 < end)
            open_, at, end = open_[go], at[go] + 1, end[go]
        return out, found


def lowest_nodes(keys: np.ndarray, n: np.ndarray, depth: int) -> dict[int, dict[str, np.ndarray]]:
    """The nodes of the two deepest levels for strings whose contexts are whole but for the last byte."""
    shorter, at = np.unique(keys & mask(depth - 1), return_inverse=True)
    return subtree({depth - 1: (shorter, np.bincount(at, weights=n, minlength=len(shorter))), depth: (keys, n)}, depth - 1, depth)


def whole_places(batches: Iterator[pa.RecordBatch], rows: int = TREE_ROWS) -> Iterator[dict[str, np.ndarray]]:
    """Columns of some ``rows`` rows at once, of batches sorted by ``place``; rows of one place are never apart."""
    waiting: list[pa.RecordBatch] = []

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: table[c].to_numpy() for c in table.column_names}

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < rows:
            continue
        table = pa.Table.from_batches(waiting)
        place = table["place"].to_numpy()
        cut = int(np.searchsorted(place, place[-1]))
        waiting = table.slice(cut).combine_chunks().to_batches()
        if cut:
            yield columns(table.slice(0, cut))
    if sum(b.num_rows for b in waiting):
        yield columns(pa.Table.from_batches(waiting))


def build_tree(counts: DataFrame, depth: int = DEPTH, max_strings: int = MAX_STRINGS) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Every counted string with its log10 probability (string, uses, value), and the most used ones as a cache (key, value).

    The whole tree is worked out, whatever its size: the two deepest levels where the
    strings stand, spread by the context but for its last two bytes (strings that
    share all but one byte of it are 2^16 at most and met together), the levels above
    by sums over the nodes below. A string that was not learned from has zero counts:
    its nodes say one half and weigh nothing. ``depth`` is 2 at least.
    """
    if depth < 2:
        raise ValueError("the depth is 2 at least")
    strings = counts.where(F.col("kind") == STRING).select(F.col("key").alias("string"), "n", "uses")

    def context(string: str) -> Column:
        return F.shiftrightunsigned(string, 8).bitwiseAND(F.lit(int(mask(depth - 3))))

    byte = F.shiftrightunsigned("string", 8 * (depth - 1)).bitwiseAND(F.lit(255))
    placed = strings.select((F.shiftleft(context("string"), 9) + 1 + byte).alias("place"), "string", "n", "uses")

    def spread_out(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.shiftrightunsigned("place", 9)).sortWithinPartitions("place")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_places(batches):
            top = lowest_nodes(held["string"].view(np.uint64), held["n"], depth)[depth - 1]
            node, at = np.unique(top["key"] & mask(depth - 2), return_inverse=True)
            sums = [np.bincount(at, weights=top[c], minlength=len(node)) for c in ("zeros", "ones", "weighted")]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *map(pa.array, sums)], names=["node", "zeros", "ones", "deeper"])

    def weighed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            zeros, ones = f["zeros"].to_numpy(), f["ones"].to_numpy()
            own = kt_block(zeros, ones)
            weighted = np.logaddexp(own, f["deeper"].to_numpy()) - np.log(2)
            one, stop = (ones + 0.5) / (zeros + ones + 1), np.exp(own - np.log(2) - weighted)
            yield pd.DataFrame({"node": f["node"], "zeros": zeros, "ones": ones, "one": one, "stop": stop, "weighted": weighted})

    sums = spread_out(placed.select("place", "string", "n")).mapInArrow(tops, "node long, zeros double, ones double, deeper double")
    levels: dict[int, DataFrame] = {}
    for d in range(depth - 2, -1, -1):
        sums = sums.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "deeper")])
        levels[d] = materialize(sums.mapInPandas(weighed, "node long, zeros double, ones double, one double, stop double, weighted double"), "nodes")
        if d:
            sums = levels[d].select(F.col("node").bitwiseAND(F.lit(int(mask(d - 1)))).alias("node"), "zeros", "ones", F.col("weighted").alias("deeper"))
    # What a node and those above it say of a one, and the weight that is left for the nodes below.
    path = levels[0].select("node", (F.col("stop") * F.col("one")).alias("said"), (1 - F.col("stop")).alias("left"))
    for d in range(1, depth - 1):
        own = levels[d].withColumn("above", F.col("node").bitwiseAND(F.lit(int(mask(d - 1)))))
        path = own.join(path.withColumnRenamed("node", "above"), "above").select(
            "node", (F.col("said") + F.col("left") * F.col("stop") * F.col("one")).alias("said"), (F.col("left") * (1 - F.col("stop"))).alias("left")
        )
    upper = path.select(
        F.shiftleft(context("node"), 9).alias("place"),
        F.col("node").alias("string"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("uses"),
        F.when(F.col("left") < 1, F.col("said") / (1 - F.col("left"))).otherwise(0.5).alias("one"),
        (1 - F.col("left")).alias("stop"),
    )
    # In each context its upper nodes stand first.
    met = spread_out(upper.unionByName(placed.withColumn("one", F.lit(0.0)).withColumn("stop", F.lit(0.0))))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        above = none
        for held in whole_places(batches):
            keys, is_node = held["string"].view(np.uint64), held["place"] & 511 == 0
            above = tuple(np.concatenate([x, y[is_node]]) for x, y in zip(above, (keys, held["one"], held["stop"]), strict=True))
            order = np.argsort(above[0])
            above = tuple(x[order] for x in above)
            own = keys[~is_node]
            if len(own):
                nodes = lowest_nodes(own, held["n"][~is_node], depth)
                whole = [none] * (depth - 2) + [above] + [(nodes[d]["key"], nodes[d]["one"], nodes[d]["stop"]) for d in (depth - 1, depth)]
                columns = own.view(np.int64), held["uses"][~is_node], log10_of(own, whole)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["string", "uses", "value"])
            last = np.uint64(held["place"][-1] >> 9)
            same = (above[0] >> np.uint64(8)) & mask(depth - 3) == last
            above = tuple(x[same] for x in above)

    values = materialize(met.mapInArrow(valued, "string long, uses long, value double"), "values")
    least = least_count(values.select(F.col("uses").alias("n")), max_strings)
    common = values.where(F.col("uses") >= least).select("string", "value").toArrow()  # max_strings rows at most
    return values.where(F.col("uses") < least), {"key": common.column(0).to_numpy().view(np.uint64), "value": common.column(1).to_numpy()}


def score_texts(docs: DataFrame, train: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), depth: int = DEPTH) -> DataFrame:
    """The columns ``keep`` of every row, with n_tokens, n_known, train_tokens, base_score and score.

    Rows for which ``train`` holds are learned from. ``score`` is the tree's log10
    probability of the lower-cased text's bytes and its end; ``base_score`` sums
    smoothed word frequencies. A null text is empty: one token, the end. With
    nothing to learn from every bit has probability one half and the base score is
    0. The tree is whole: values of strings outside the broadcast cache are joined.
    Repeated rows are scored each; columns of the computed names in ``keep`` are
    not allowed to clash and are dropped.
    """
    spark = docs.sparkSession
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = tuple(c for c in keep if c.lower() not in new)
    counts = materialize(count_corpus(docs.select(text, F.coalesce(train, F.lit(False)).alias("learned")), depth), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    totals = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = int(totals["n"] or 0), int(totals["v"])
    least = least_count(words, MAX_WORDS)
    common = words.where(F.col("n") >= least).toArrow()  # MAX_WORDS rows at most
    far_values, known = build_tree(counts, depth)
    shared = spark.sparkContext.broadcast(
        {
            "words": (common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy()),
            "known": (known["key"], known["value"]),
        }
    )
    state: dict = {}
    result = pa.struct(
        [("n_tokens", pa.int64()), ("common_sum", pa.float64()), ("common_known", pa.int64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("far", pa.list_(pa.int64()))]
    )

    @F.arrow_udf("struct<n_tokens:bigint,common_sum:double,common_known:bigint,score:double,rare:array<bigint>,far:array<bigint>>")
    def scored(column: pa.Array) -> pa.Array:
        if not state:
            parts = shared.value
            state["words"] = Lookup(*parts["words"])
            state["known"] = Lookup(*parts["known"])
        outs = []
        for a, b in slices(column, CHUNK):
            data, offsets = folded(column.slice(a, b - a))
            texts = b - a
            keys, at = byte_strings(data, offsets, depth)
            value, seen = state["known"](keys)
            far = np.flatnonzero(~seen)
            far_cuts = np.searchsorted(far, at).astype(np.int32)
            tree = np.add.reduceat(value, at[:-1])
            first, last, begin = word_bounds(data, offsets)
            hashes = word_hashes(data, first, last)
            # The end of each text is looked up like a word, after the text's own.
            ends = begin[1:] + np.arange(texts)
            every = np.full(len(hashes) + texts, END_TOKEN, dtype=np.uint64)
            is_word = np.ones(len(every), dtype=bool)
            is_word[ends] = False
            every[is_word] = hashes
            starts = np.append(0, ends + 1)
            n, there = state["words"](every)
            logs = np.where(there, np.log10(n + 0.5), 0.0)
            rare = np.flatnonzero(~there)
            cuts = np.searchsorted(rare, starts).astype(np.int32)
            outs.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array(np.diff(starts)),
                        pa.array(np.add.reduceat(logs, starts[:-1])),
                        pa.array(np.add.reduceat(there.astype(np.int64), starts[:-1])),
                        pa.array(tree),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(every[rare].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(far_cuts), pa.array(keys[far].view(np.int64))),
                    ],
                    fields=list(result),
                )
            )
        return pa.concat_arrays(outs) if outs else pa.array([], result)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], scored.asNondeterministic()(F.col(text)).alias("__s")).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "scored")
    rare = rows.select("__row", F.explode("__s.rare").alias("key")).groupBy("__row", "key").agg(F.count(F.lit(1)).alias("times"))
    joined = rare.join(words.where(F.col("n") < least), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = joined.groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    # Each far string is used less than the cached ones: none is a large key.
    far = rows.select("__row", F.explode("__s.far").alias("string")).join(far_values.select("string", "value"), "string")
    far_sums = far.groupBy("__row").agg(F.sum("value").alias("far_sum"))
    size = float(np.log10(tokens + 0.5 * (types + 1)))
    return rows.join(sums, "__row", "left").join(far_sums, "__row", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__s.n_tokens").alias("n_tokens"),
        (F.col("__s.common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("__s.common_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("__s.n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("__s.score") + F.coalesce("far_sum", F.lit(0.0))).alias("score"),
    )
