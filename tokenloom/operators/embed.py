"""Embedding tables: alignment, initialisation, encoding, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import clean_cut
from tokenloom.functions.vectors import as_lists, as_matrix, l2_normalize, unit_rows
from tokenloom.mapped import MappedArray, share
from tokenloom.operators.corpus import limit_batches as first_batches
from tokenloom.operators.pieces import CONTINUATION, encode_ids, headed_words, id_lists, split_distinct, text_id_lists, truncate_pieces
from tokenloom.operators.pieces import _choose as _choose_pieces
from tokenloom.session import MAX_BROADCAST_BYTES, python_workers, remove, scratch_path

#: Copies of the weight table in the shuffled route; a hot id is spread over this many tasks.
SALTS = 32
#: Bytes of one range of a mapped weight table, and the largest table that is put on every node's disk.
RANGE_BYTES, MAX_MAPPED_BYTES = 64 << 20, 64 << 30
#: Bytes of table rows gathered at once inside a task, and of the sums it fills.
GATHER_BYTES, SUM_BYTES = 8 << 20, 64 << 20
#: Ids of a batch pooled at once inside a task.
IDS_AT_ONCE = 1_000_000
#: Cells of a matrix of counts (rows by table rows in use), and how many cells an id may cost before gathering its row is cheaper.
COUNT_CELLS, CELLS_AN_ID = 2_000_000, 16


EmbedFn = Callable[[list[str]], np.ndarray]


def vector_length(df: DataFrame, vector_col: str) -> int | None:
    """The length of the longest vector, ``None`` without rows or with null vectors only."""
    found = df.agg(F.max(F.size(vector_col)).alias("n")).first()["n"]
    return int(found) if found is not None and found >= 0 else None


def check_dims(a: DataFrame, b: DataFrame, a_col: str = "embedding", b_col: str = "embedding") -> int | None:
    """The common vector length; an error if the two sides differ or one is ragged."""

    def lengths(df: DataFrame, col: str, side: str) -> DataFrame:
        return df.agg(F.min(F.size(col)).alias("low"), F.max(F.size(col)).alias("high")).select(
            F.lit(side).alias("side"), "low", "high"
        )

    found = {r["side"]: (r["low"], r["high"]) for r in lengths(a, a_col, "a").union(lengths(b, b_col, "b")).collect()}
    for side, (low, high) in found.items():
        if low != high:
            raise ValueError(f"ragged vectors on side {side}: lengths from {low} to {high}")
    sizes = {low for low, _ in found.values() if low is not None}
    if len(sizes) > 1:
        raise ValueError(f"vector lengths differ: {found['a'][0]} and {found['b'][0]}")
    return next(iter(sizes), None)


def align_vocab(
    new_vocab: DataFrame,
    old_vocab: DataFrame,
    word_prefix: str = "",
    subword_prefix: str = CONTINUATION,
    special_ids: Sequence[int] = (),
    special_ends: Sequence[int] = (),
) -> DataFrame:
    """For each new piece its ids in the old vocabulary.

    Tried in turn: the piece itself, the piece without its prefixes, the
    encoding of what is left. ``special_ids`` and ``special_ends`` are put before
    and after an encoding, as a tokeniser with special tokens does. Result:
    ``piece, id, ids, match_kind``.
    """

    def without(col: Column, prefix: str) -> Column:
        if not prefix:
            return col
        return F.when(F.startswith(col, F.lit(prefix)), F.substring(col, len(prefix) + 1, 2**31 - 1)).otherwise(col)

    stripped = without(without(F.col("piece"), word_prefix), subword_prefix)
    new = new_vocab.select("piece", "id").withColumn("__stripped", stripped)
    exact = old_vocab.select("piece", F.col("id").alias("__exact"))
    loose = old_vocab.select(F.col("piece").alias("__stripped"), F.col("id").alias("__loose"))
    matched = new.join(exact, "piece", "left").join(loose, "__stripped", "left")
    rest = matched.filter(F.col("__exact").isNull() & F.col("__loose").isNull())
    words = rest.select(F.col("__stripped").alias("word")).distinct()
    split = split_distinct(words, old_vocab).withColumnsRenamed({"word": "__stripped", "ids": "__split"})
    if special_ids or special_ends:
        begin, end = (F.array(*[F.lit(i) for i in x]).cast("array<int>") for x in (special_ids, special_ends))
        split = split.withColumn("__split", F.concat(begin, F.col("__split"), end))
    single = F.coalesce("__exact", "__loose")
    kind = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "stripped")
    return matched.join(split, "__stripped", "left").select(
        "piece",
        "id",
        F.coalesce(F.when(single.isNotNull(), F.array(single)), F.col("__split")).alias("ids"),
        F.coalesce(kind, F.lit("encoded")).alias("match_kind"),
    )


def init_weights(aligned: DataFrame, old_weights: DataFrame) -> DataFrame:
    """A vector per new piece: the mean of its old pieces' vectors."""
    # A few old ids (the unknown piece, single letters) stand in most lists: the table is salted.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    ids = aligned.select("id", F.explode_outer("ids").alias("old_id"), salt.alias("salt"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    old = old_weights.select(F.col("id").alias("old_id"), array_to_vector("vec").alias("__vec"), every.alias("salt"))
    mean = Summarizer.mean(F.col("__vec"))
    return ids.join(old, ["old_id", "salt"]).groupBy("id").agg(vector_to_array(mean).alias("vec"))


def init_from_teacher(
    vocab: DataFrame, make_teacher: Callable[[], EmbedFn], dim: int, subword_prefix: str = CONTINUATION, batch_size: int = 512
) -> DataFrame:
    """A vector per new piece: the teacher's for the piece's text, without the prefix that marks a continuation."""
    inner = F.startswith(F.col("piece"), F.lit(subword_prefix)) & F.lit(bool(subword_prefix))
    bare = F.when(inner, F.substring("piece", len(subword_prefix) + 1, 2**31 - 1)).otherwise(F.col("piece"))
    rows = apply_teacher(vocab.select("id", bare.alias("text")), make_teacher, dim, batch_size)
    return rows.select("id", F.col("embedding").alias("vec"))


def places(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``asked`` first stands in ``keys`` (ascending), and whether it does at all."""
    low, span = int(keys[0]), int(keys[-1]) - int(keys[0]) + 1
    if span > 4 * len(keys) or span > len(asked):
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked
    # Dense keys asked for many times: a table of them.
    table = np.full(span, -1, dtype=np.int64)
    table[keys[::-1] - low] = np.arange(len(keys))[::-1]  # of equal keys the first one counts
    inside = (asked >= low) & (asked < low + span)
    at = table[np.where(inside, asked - low, 0)]
    return np.maximum(at, 0), inside & (at >= 0)


def counted_blocks(at: np.ndarray, owner: np.ndarray, rows: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]] | None:
    """The ids of ``rows`` rows as matrices of counts: (first row, row behind the last, table rows in use, counts of them by row).

    ``at`` are places in a table of ``size`` rows, ``owner`` their rows, ascending. ``None`` where few of the cells would be filled.
    """
    used = np.flatnonzero(np.bincount(at, minlength=size)) if size <= COUNT_CELLS else np.unique(at)
    if not len(used) or rows * len(used) > CELLS_AN_ID * len(at):
        return None
    code, _ = places(used, at)
    step = max(1, COUNT_CELLS // len(used))

    def blocks() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for begin in range(0, rows, step):
            end = min(rows, begin + step)
            i, j = np.searchsorted(owner, [begin, end])
            cells = (owner[i:j] - begin) * len(used) + code[i:j]
            counts = np.bincount(cells, minlength=(end - begin) * len(used)).reshape(end - begin, len(used))
            yield begin, end, used, counts.astype(np.float64)

    return blocks()


def _add_rows(sums: np.ndarray, counts: np.ndarray, flat: np.ndarray, owner: np.ndarray, keys: np.ndarray, matrix: np.ndarray) -> None:
    """Add the table rows of the ids ``flat`` to the sums of their owners (ascending); ids without a row do not count."""
    if not len(keys) or not len(flat):
        return
    at, known = places(keys, flat)
    at, owner = at[known], owner[known]
    blocks = counted_blocks(at, owner, len(sums), len(keys))
    if blocks is not None:
        for begin, end, used, times in blocks:
            sums[begin:end] += times @ matrix[used].astype(np.float64)
            counts[begin:end] += times.sum(axis=1).astype(np.int64)
        return
    step = max(1, GATHER_BYTES // (8 * sums.shape[1]))
    for begin in range(0, len(at), step):
        own = owner[begin : begin + step]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[first]] += np.add.reduceat(matrix[at[begin : begin + step]], first, axis=0, dtype=np.float64)
        counts[own[first]] += np.diff(np.append(first, len(own)))


def _mean_rows(ids: pa.Array, ranges: Sequence[tuple[np.ndarray, np.ndarray]], dim: int) -> pa.Array:
    """Per list of ids the mean of their rows in a table that comes in ranges, each taken in turn."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    parts, begin = [as_lists(np.zeros((0, dim)))], 0
    step = max(1, SUM_BYTES // (8 * dim))
    while begin < len(ids):
        # A few rows at once, and of them no more than have IDS_AT_ONCE ids; a longer row stands alone.
        stop = int(np.searchsorted(offsets, offsets[begin] + IDS_AT_ONCE, side="right")) - 1
        bounds = offsets[begin : max(begin + 1, min(stop, begin + step)) + 1]
        rows = len(bounds) - 1
        begin += rows
        sums, counts = np.zeros((rows, dim)), np.zeros(rows, dtype=np.int64)
        owner = np.repeat(np.arange(rows), np.diff(bounds))
        for keys, matrix in ranges:
            _add_rows(sums, counts, flat[bounds[0] : bounds[-1]], owner, keys, matrix)
        parts.append(as_lists(sums / np.maximum(counts, 1)[:, None]))
    return pa.concat_arrays(parts)


@dataclass(frozen=True)
class SharedTable:
    """A weight table as tasks get it: one range in a broadcast, or several that are mapped from the node's files."""

    dim: int
    ranges: Broadcast | tuple[tuple[MappedArray, MappedArray], ...]

    def open(self) -> list[tuple[np.ndarray, np.ndarray]]:
        if isinstance(self.ranges, Broadcast):
            return [self.ranges.value]
        return [(keys.open(), matrix.open()) for keys, matrix in self.ranges]


#: Weight tables already sent to the executors: a loop over batches that passes the same frame sends it once.
_SHARED: WeakKeyDictionary[DataFrame, dict[str, SharedTable]] = WeakKeyDictionary()


def _ids_and_rows(weights: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The table on the driver, by ascending id, in its own number type."""
    table = weights.select(F.col("id").cast("bigint"), "vec").toArrow()
    keys, vec = table.column("id").to_numpy(), table.column("vec").combine_chunks()
    order = np.argsort(keys, kind="stable")
    matrix = as_matrix(vec) if len(keys) else np.zeros((0, dim))
    if pa.types.is_float32(vec.type.value_type):
        matrix = matrix.astype(np.float32)
    return keys[order], matrix[order]


def table_bytes(weights: DataFrame) -> tuple[int, int]:
    """(vector length, bytes of ids and vectors in the table's own number type)."""
    dim = vector_length(weights, "vec")
    if dim is None:
        raise ValueError("the weight table is empty")
    number = 4 if isinstance(weights.schema["vec"].dataType.elementType, T.FloatType) else 8
    return dim, weights.count() * (dim * number + 8)


def shared_table(weights: DataFrame, strategy: str, dim: int, size: int) -> SharedTable:
    """Ids and vectors on every executor, sent once per table.

    ``mapped`` sends the table range by range: the driver holds one of them at a time, a
    node has one copy of each for all its Python workers, and a task touches them in turn.
    """
    sent = _SHARED.setdefault(weights, {})
    if strategy not in sent:
        spark = weights.sparkSession
        if strategy == "lookup":
            sent[strategy] = SharedTable(dim, spark.sparkContext.broadcast(_ids_and_rows(weights, dim)))
        else:
            n = max(1, -(-size // RANGE_BYTES))
            path = scratch_path(spark, "table-ranges")
            cut = weights.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("range"))
            cut.repartition(n, "range").write.partitionBy("range").parquet(path)
            stored = spark.read.schema(cut.schema).parquet(path)
            parts = (_ids_and_rows(stored.filter(F.col("range") == r), dim) for r in range(n))
            sent[strategy] = SharedTable(dim, tuple((share(spark, [keys]), share(spark, [matrix])) for keys, matrix in parts))
            remove(spark, path)
    return sent[strategy]


def release_table(weights: DataFrame) -> None:
    """Take a table that is no longer needed off the executors (files of a mapped one stay until the session ends)."""
    for held in _SHARED.pop(weights, {}).values():
        if isinstance(held.ranges, Broadcast):
            held.ranges.destroy()


def _choose(weights: DataFrame, strategy: str) -> tuple[str, int, int]:
    """(route, vector length, bytes) of a table; an error for a broadcast past the bound."""
    if strategy not in ("auto", "lookup", "mapped", "join"):
        raise ValueError(f"unknown strategy {strategy!r}: use 'auto', 'lookup', 'mapped' or 'join'")
    dim, size = table_bytes(weights)
    if strategy in ("auto", "lookup"):
        # Each Python worker holds a broadcast table for itself.
        workers = python_workers(weights.sparkSession)
        if size * workers <= MAX_BROADCAST_BYTES:
            return "lookup", dim, size
        if strategy == "lookup":
            raise ValueError(f"{size} bytes in each of {workers} Python workers are past the broadcast bound of {MAX_BROADCAST_BYTES} bytes")
        strategy = "mapped" if size <= MAX_MAPPED_BYTES else "join"
    return strategy, dim, size


def pool_ids(df: DataFrame, weights: DataFrame, id_col: str = "doc_id", strategy: str = "auto") -> DataFrame:
    """Add ``embedding``: the mean of the table rows of ``ids``; no ids give a zero vector.

    ``lookup`` broadcasts the table, ``mapped`` puts it on every node range by range;
    both fill each row's sum in place and shuffle nothing. ``join`` serves tables that no
    node has room for: repeats are counted per row first, and the table is salted because
    a few ids occur in nearly every row.
    """
    strategy, dim, size = _choose(weights, strategy)
    if strategy != "join":
        shared = shared_table(weights, strategy, dim, size)

        def mean(batch: pa.Array) -> pa.Array:
            return _mean_rows(batch, shared.open(), dim)

        # Declared non-deterministic so that the planner never evaluates it twice.
        return df.withColumn("embedding", F.arrow_udf(mean, "array<double>").asNondeterministic()(F.col("ids")))
    counts = (
        df.select(id_col, F.explode_outer("ids").alias("id"))
        .groupBy(id_col, "id")
        .agg(F.count("*").cast("double").alias("n"))
        .withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    )
    salted = weights.select("id", array_to_vector("vec").alias("__vec")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    )
    mean_vec = Summarizer.mean(F.col("__vec"), F.col("n"))
    means = counts.join(salted, ["id", "salt"]).groupBy(id_col).agg(vector_to_array(mean_vec).alias("embedding"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.join(means, id_col, "left").withColumn("embedding", F.coalesce("embedding", zero))


def _encode_in_place(
    df: DataFrame, of: Callable[[pa.Array], Iterator[pa.Array]], weights: DataFrame, table: tuple[str, int, int], max_len: int | None, text_col: str, normalize: bool
) -> DataFrame:
    """Words to vectors in one Python worker per task: no ids go back and forth, and of whole texts no words either."""
    headed, words = headed_words(df, max_len, text_col)
    words = F.col("__head") if max_len is None else words
    strategy, dim, size = table
    shared = shared_table(weights, strategy, dim, size)

    def encode(batch: pa.Array) -> pa.Array:
        ranges, parts = shared.open(), [as_lists(np.zeros((0, dim)))]
        for ids in of(batch):
            means = _mean_rows(ids, ranges, dim)
            parts.append(as_lists(unit_rows(as_matrix(means))) if normalize else means)
        return pa.concat_arrays(parts)

    # Declared non-deterministic so that the planner never evaluates it twice.
    return headed.withColumn("embedding", F.arrow_udf(encode, "array<double>").asNondeterministic()(words)).drop("__head")


def static_encode(
    df: DataFrame,
    vocab: DataFrame,
    weights: DataFrame,
    max_len: int | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    strategy: str = "auto",
    normalize: bool = False,
    one_worker: bool = False,
) -> DataFrame:
    """Add ``embedding``, the mean of the whole text's token vectors (repeats count).

    ``max_len`` cuts the text as training does; ``normalize`` gives vectors of length 1, as
    the finished model does. ``one_worker`` goes from words to vectors in one Python worker
    per task, instead of one for each step, where no route is a join.
    """
    route = _choose_pieces(vocab, strategy) if one_worker else "join"
    if route != "join" and (table := _choose(weights, strategy))[0] != "join":
        of = text_id_lists(vocab, route) if max_len is None else id_lists(vocab, route, max_len)
        return _encode_in_place(df, of, weights, table, max_len, text_col, normalize)
    encoded = encode_ids(df, vocab, max_len, text_col, id_col, strategy)
    pooled = pool_ids(encoded, weights, id_col, strategy).drop("ids")
    return pooled.withColumn("embedding", l2_normalize(F.col("embedding"))) if normalize else pooled


def apply_teacher(
    df: DataFrame, make_teacher: Callable[[], EmbedFn], dim: int, batch_size: int = 512, text_col: str = "text"
) -> DataFrame:
    """Add ``embedding`` from a teacher that is built once per task and fed ``batch_size`` texts at a time."""
    columns = [f for f in df.schema.fields if f.name != "embedding"]
    schema = T.StructType([*columns, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    names = [f.name for f in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teacher = make_teacher()
        for batch in batches:
            for begin in range(0, batch.num_rows, batch_size):
                part = batch.slice(begin, batch_size)
                vectors = np.asarray(teacher(part.column(text_col).to_pylist()), dtype=np.float32)
                if vectors.shape != (part.num_rows, dim):
                    raise ValueError(f"the teacher returned {vectors.shape}, expected {(part.num_rows, dim)}")
                yield pa.RecordBatch.from_arrays([*part.columns, as_lists(vectors, pa.float32())], [*names, "embedding"])

    return df.select(*names).mapInArrow(run, schema)


def embed_corpus(
    df: DataFrame,
    make_teacher: Callable[[], EmbedFn],
    dim: int,
    vocab: DataFrame,
    batch_size: int = 512,
    max_length: int = 512,
    n_special: int = 2,
    limit_batches: int | None = None,
    order_col: str = "doc_id",
    text_col: str = "text",
    max_chars: int = 10_000,
) -> DataFrame:
    """Clean, cut and truncate the text, then embed it. Other columns pass through.

    One map-only stage: rows stay where they were read.
    """
    rows = df if limit_batches is None else first_batches(df, limit_batches, batch_size, order_col)
    cut = rows.withColumn(text_col, clean_cut(F.col(text_col), max_chars))
    truncated = truncate_pieces(cut, vocab, max_length, n_special, text_col, order_col)
    return apply_teacher(truncated, make_teacher, dim, batch_size, text_col)


def route_encode(
    df: DataFrame,
    role_col: str,
    query_role: str,
    student: Callable[[DataFrame], DataFrame],
    teacher: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Query rows go through the student, all others through the teacher.

    Both callables add ``embedding``; its length must agree.
    """
    is_query = F.coalesce(F.col(role_col) == query_role, F.lit(False))
    columns = [*df.columns, F.col("embedding").cast("array<double>").alias("embedding")]
    queries = student(df.filter(is_query)).select(*columns)
    documents = teacher(df.filter(~is_query)).select(*columns)
    return queries.unionByName(documents)
