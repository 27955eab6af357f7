"""Losses and the fitting of the token table to teacher vectors."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.vectors import COSINE_FLOOR, as_lists, as_matrix, cosine, slice_dims, unit_rows
from tokenloom.operators.embed import _choose, _mean_rows, counted_blocks, pool_ids, release_table, shared_table, vector_length
from tokenloom.operators.pieces import row_slices
from tokenloom.session import broadcast_if_small, materialize, read_text, remove, replace_text, scratch_path

# Loss names and the temperature of the contrastive loss.
LOSSES = ("cosine", "distillation_cosine")
TEMPERATURE = 0.07

#: Rows of one batch that meet in one task; larger batches are split.
BLOCK_ROWS = 4_096
FIT_MANIFEST = "steps.json"
#: Bytes of gradient sums a task holds before it passes them on.
MAX_HELD_BYTES = 128 << 20
#: Ids of rows whose gradients a task works out at once.
IDS_OF_A_STEP = 250_000


def select_loss(name: str) -> str:
    """The loss name, or an error that lists the valid ones."""
    if name not in LOSSES:
        raise ValueError(f"no loss is called {name!r}; choose {' or '.join(LOSSES)}")
    return name


def cosine_loss(pairs: DataFrame, student: str = "student", teacher: str = "teacher") -> DataFrame:
    """One minus the mean cosine; the teacher is cut to the student's length."""
    return pairs.agg((1 - F.avg(cosine(F.col(student), F.col(teacher)))).alias("loss"))


def _grid_rows(rows: DataFrame, tau: float) -> DataFrame:
    """``batch, id, loss, expected`` of ``rows(batch, id, s, t)`` whose batches are too large for one task.

    A batch is cut into blocks; each student block meets each teacher block of its
    batch in one task. A cosine over ``tau`` is at most ``1 / tau``, so that fixed
    shift keeps the exponentials in range and the blocks' sums simply add up: exact
    for batches of any size.
    """
    # A batch may be one huge key: the counts go to the rows, not the rows to the counts, as long as they fit.
    blocks = rows.groupBy("batch").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("__blocks"))
    rows = rows.join(broadcast_if_small(materialize(blocks, "batch-sizes"), 64), "batch")
    own = F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("__blocks") - 1)

    # A row is a student in row ``own`` of the grid of blocks and a teacher in
    # column ``own``. Where they cross it is both: one block costs one copy.
    def cells(k: Column) -> Column:
        as_student = F.struct(own.alias("i"), k.alias("j"), F.lit(True).alias("learns"), (k == own).alias("teaches"))
        as_teacher = F.struct(k.alias("i"), own.alias("j"), F.lit(False).alias("learns"), F.lit(True).alias("teaches"))
        return F.when(k == own, F.array(as_student)).otherwise(F.array(as_student, as_teacher))

    placed = rows.select("batch", "id", "s", "t", F.inline(F.flatten(F.transform(every, cells))))
    sent = placed.select(
        "batch", "i", "j", "id", F.when(F.col("learns"), F.col("s")).alias("s"), F.when(F.col("teaches"), F.col("t")).alias("t")
    )
    batch_type, id_type = (rows.schema[c].dataType.simpleString() for c in ("batch", "id"))
    schema = f"batch {batch_type}, id {id_type}, total double, expected array<double>, own double"

    def cell(table: pa.Table) -> pa.Table:
        students = table.filter(table.column("s").is_valid())
        teachers = table.filter(table.column("t").is_valid())
        x = unit_rows(as_matrix(students.column("s").combine_chunks()))
        y = as_matrix(teachers.column("t").combine_chunks())
        y = unit_rows(y[:, : x.shape[1]]) if len(y) else np.zeros((0, x.shape[1]))
        sim = x @ y.T / tau
        weight = np.exp(sim - 1 / tau)
        at = {v: n for n, v in enumerate(teachers.column("id").to_pylist())}
        partner = [at.get(v) for v in students.column("id").to_pylist()]
        own_sim = [None if p is None else float(sim[n, p]) for n, p in enumerate(partner)]
        return pa.table(
            {
                "batch": students.column("batch"),
                "id": students.column("id"),
                "total": weight.sum(axis=1),
                "expected": as_lists(weight @ y),
                "own": pa.array(own_sim, type=pa.float64()),
            }
        )

    parts = sent.groupBy("batch", "i", "j").applyInArrow(cell, schema)
    merged = parts.groupBy("batch", "id").agg(
        F.sum("total").alias("total"),
        vector_to_array(Summarizer.sum(array_to_vector("expected"))).alias("expected"),
        F.max("own").alias("own"),
    )
    loss = 1 / tau + F.log("total") - F.col("own")
    return merged.select("batch", "id", loss.alias("loss"), F.transform("expected", lambda v: v / F.col("total")).alias("expected"))


def _segments(batch: pa.Array) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    codes = batch.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])


def _stacked(vectors: pa.Array, starts: np.ndarray, rows: int) -> np.ndarray:
    """The vectors of several runs of ``rows`` each, as (runs, rows, length)."""
    at = vectors.offsets.to_numpy().astype(np.int64) - vectors.offsets[0].as_py()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    size = int(at[starts[0] + 1] - at[starts[0]])
    place = at[starts][:, None] + np.arange(rows * size)
    return flat[place].astype(np.float64).reshape(len(starts), rows, size)


def _softmax(table: pa.Table, dims: Sequence[int] | None, tau: float, expected: bool) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray | None]]:
    """(places of rows, prefix length, losses, expected teacher vectors) of whole batches that lie one behind the other.

    Batches of one shape are worked out together: their similarities are the blocks of a
    block-diagonal matrix, and the sums of the softmax run within the blocks.
    """
    bounds = _segments(table.column("batch").combine_chunks())
    columns = [table.column(c).combine_chunks() for c in ("s", "t")]
    sizes = [np.diff(c.offsets.to_numpy()) for c in columns]
    for size in sizes:  # as everywhere, vectors of one batch have one length
        runs = np.repeat(size[bounds[:-1]], np.diff(bounds))
        if any(c.null_count for c in columns) or (runs != size).any():
            raise ValueError("vectors of different lengths")
    shapes = np.stack([np.diff(bounds), *[size[bounds[:-1]] for size in sizes]], axis=1)
    for shape in np.unique(shapes, axis=0):
        alike = bounds[:-1][(shapes == shape).all(axis=1)]
        rows = int(shape[0])
        step = max(1, BLOCK_ROWS * 64 // (rows * rows))
        for begin in range(0, len(alike), step):
            starts = alike[begin : begin + step]
            s, t = (_stacked(c, starts, rows) for c in columns)
            for d in dims or [s.shape[2]]:
                x, y = (unit_rows(v[:, :, :d].reshape(-1, min(d, v.shape[2]))).reshape(len(starts), rows, -1) for v in (s, t[:, :, : s.shape[2]]))
                sim = x @ y.transpose(0, 2, 1) / tau
                weight = np.exp(sim - 1 / tau)
                total = weight.sum(axis=2)
                loss = 1 / tau + np.log(total) - np.einsum("kii->ki", sim)
                mean = (weight @ y / total[:, :, None]).reshape(len(starts) * rows, -1) if expected else None
                yield (starts[:, None] + np.arange(rows)).ravel(), d, loss.ravel(), mean


def _segment_rows(rows: DataFrame, tau: float, dims: Sequence[int] | None, expected: bool) -> DataFrame:
    """``batch, id, dim, loss[, expected]`` of ``rows(batch, id, s, t)`` whose batches fit a task, any number of them per call.

    Rows are put together by batch; a batch that an Arrow table breaks off waits for the next table.
    """
    batch_type, id_type = (rows.schema[c].dataType.simpleString() for c in ("batch", "id"))
    names = ["batch", "id", "dim", "loss", *(["expected"] if expected else [])]
    schema = f"batch {batch_type}, id {id_type}, dim int, loss double" + (", expected array<double>" if expected else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for place, d, loss, mean in _softmax(table, dims, tau, expected):
                own = table.take(pa.array(place))
                parts = [own.column("batch").combine_chunks(), own.column("id").combine_chunks(), pa.array(np.full(len(place), d, dtype=np.int32)), pa.array(loss)]
                yield pa.RecordBatch.from_arrays([*parts, as_lists(mean)] if expected else parts, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = int(_segments(table.column("batch").combine_chunks())[-2])
            if last:
                yield from finished(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from finished(held)

    return rows.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, schema)


def contrastive_rows(
    pairs: DataFrame,
    batch_col: str,
    id_col: str,
    student: str,
    teacher: str,
    tau: float = TEMPERATURE,
    batch_rows: int | None = None,
    dims: Sequence[int] | None = None,
    expected: bool = True,
) -> DataFrame:
    """Per row of a batch: its loss and, if wanted, the teacher vector it expects under the softmax.

    Batches that fit a task are worked out whole, many at a time; larger ones are cut
    into blocks. ``batch_rows`` is the size that the numbering gave the batches, if the
    caller knows it; otherwise the rows are stored and counted. With ``dims`` there is a
    row, with its ``dim``, for each of these prefixes of the vectors.
    """
    if 2 / tau > 700:
        raise ValueError(f"tau {tau} is too small for double precision")
    rows = pairs.select(F.col(batch_col).alias("batch"), F.col(id_col).alias("id"), F.col(student).alias("s"), F.col(teacher).alias("t"))
    columns = ["batch", "id", *(["dim"] if dims else []), "loss", *(["expected"] if expected else [])]
    names = [F.col(c).alias({"batch": batch_col, "id": id_col}.get(c, c)) for c in columns]
    if batch_rows is not None and batch_rows <= BLOCK_ROWS:
        return _segment_rows(rows, tau, dims, expected).select(*names)
    rows = materialize(rows, "batches")
    large = materialize(rows.groupBy("batch").count().filter(F.col("count") > BLOCK_ROWS).select(F.col("batch").alias("__large")), "large-batches")
    if large.isEmpty():
        return _segment_rows(rows, tau, dims, expected).select(*names)
    # A batch of this kind has more than BLOCK_ROWS rows, so there are few of them.
    marked = rows.join(broadcast_if_small(large, 64), F.col("batch").eqNullSafe(F.col("__large")), "left")
    cut = marked.filter("__large is not null").drop("__large")
    for_dims = dims or [None]
    parts = []
    for d in for_dims:
        own = cut if d is None else cut.withColumn("s", slice_dims(F.col("s"), d)).withColumn("t", slice_dims(F.col("t"), d))
        parts.append(_grid_rows(own, tau).withColumn("dim", F.lit(d).cast("int")).select(*columns))
    whole = _segment_rows(marked.filter("__large is null").drop("__large"), tau, dims, expected).select(*columns)
    return reduce(lambda a, b: a.unionByName(b), parts, whole).select(*names)


def contrastive_loss(
    pairs: DataFrame,
    batch_col: str = "batch_id",
    id_col: str = "doc_id",
    student: str = "student",
    teacher: str = "teacher",
    tau: float = TEMPERATURE,
    batch_rows: int | None = None,
    dims: Sequence[int] | None = None,
) -> DataFrame:
    """Per batch (and prefix length), the cross-entropy of ``cos / tau`` against the row's own teacher vector."""
    rows = contrastive_rows(pairs, batch_col, id_col, student, teacher, tau, batch_rows, dims, expected=False)
    return rows.groupBy(batch_col, *(["dim"] if dims else [])).agg(F.avg("loss").alias("loss"))


def matryoshka_dims(dim: int) -> list[int]:
    """Prefix lengths: 16 doubling below half the length, then the length. Up to 16: the length alone."""
    # 16 * 2**k < dim for k below log2(dim / 16), which is the bit length of (dim - 1) // 16.
    return [16 << k for k in range(((dim - 1) // 16).bit_length())] + [dim]


def matryoshka_loss(
    pairs: DataFrame,
    loss: str = "cosine",
    dims: Sequence[int] | None = None,
    student: str = "student",
    teacher: str = "teacher",
    batch_col: str = "batch_id",
    id_col: str = "doc_id",
    batch_rows: int | None = None,
) -> DataFrame:
    """D3: the loss of each vector prefix; ``matryoshka_total`` sums them.

    Result: ``dim, loss`` (mean over batches for the contrastive loss). Each row is read once for all prefixes.
    """
    select_loss(loss)
    if dims is None:
        dims = matryoshka_dims(vector_length(pairs, student) or 0)
    if loss == "cosine":
        cosines = [F.avg(cosine(slice_dims(F.col(student), d), slice_dims(F.col(teacher), d))) for d in dims]
        # One scan for all prefixes.
        losses = [F.struct(F.lit(d).alias("dim"), (1 - c).alias("loss")) for d, c in zip(dims, cosines)]
        return pairs.agg(F.array(*losses).alias("__losses")).select(F.inline("__losses"))
    per_batch = contrastive_loss(pairs, batch_col, id_col, student, teacher, batch_rows=batch_rows, dims=dims)
    return per_batch.groupBy("dim").agg(F.avg("loss").alias("loss"))


def matryoshka_total(losses: DataFrame) -> DataFrame:
    """D3: the sum over the prefixes."""
    return losses.agg(F.sum("loss").alias("loss"))


def learning_rate(step: int, total_steps: int, peak: float, warmup: float = 0.1, floor: float = 0.1) -> float:
    """Linear warm-up, then half a cosine down to ``floor`` times the peak."""
    warm = math.ceil(total_steps * warmup)
    if step < warm:
        return peak * step / max(1, warm)
    progress = (step - warm) / max(1, total_steps - warm)
    return peak * (floor + (1 - floor) * 0.5 * (1 + math.cos(math.pi * progress)))


def _projected(mean: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Push a gradient on unit vectors back through the division by the norm."""
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    unit = np.divide(mean, norm, out=np.zeros_like(mean), where=norm > 0)
    tangent = pull - np.einsum("ij,ij->i", unit, pull)[:, None] * unit
    return np.divide(tangent, norm, out=np.zeros_like(mean), where=norm > 0)


def cosine_gradient(mean: Column, teacher: Column, dims: Sequence[int]) -> Column:
    """Per row, the gradient of ``1 - cos`` with respect to the pooled vector, summed over prefixes."""

    @F.arrow_udf("array<double>")
    def gradient(means: pa.Array, teachers: pa.Array) -> pa.Array:
        m, t = as_matrix(means), as_matrix(teachers)
        out = np.zeros_like(m)
        for d in dims:
            out[:, :d] -= _projected(m[:, :d], unit_rows(t[:, :d]))
        return as_lists(out)

    return gradient(mean, teacher)


def _contrastive_gradient(rows: DataFrame, dims: Sequence[int], id_col: str, tau: float) -> DataFrame:
    """``id_col, __grad`` for the contrastive loss of one batch, summed over prefixes."""
    keyed = rows.select(id_col, "embedding", "__teacher", F.explode(F.array(*[F.lit(d) for d in dims])).alias("dim"))
    keyed = keyed.select(
        id_col,
        F.col("dim").alias("__batch"),
        slice_dims(F.col("embedding"), F.col("dim")).alias("__s"),
        slice_dims(F.col("__teacher"), F.col("dim")).alias("__t"),
    )
    expected = contrastive_rows(keyed, "__batch", id_col, "__s", "__t", tau)
    full = max(dims)

    @F.arrow_udf("array<double>")
    def gradient(means: pa.Array, teachers: pa.Array, expectations: pa.Array) -> pa.Array:
        # Prefixes of different lengths share a batch: pad them with zeros first.
        def padded(lists: pa.Array) -> np.ndarray:
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), full))
            out[np.arange(full)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            return out

        pull = (padded(expectations) - unit_rows(padded(teachers))) / tau
        return as_lists(_projected(padded(means), pull))

    grads = keyed.join(expected, ["__batch", id_col]).select(
        id_col, array_to_vector(gradient(F.col("__s"), F.col("__t"), F.col("expected"))).alias("__g")
    )
    return grads.groupBy(id_col).agg(vector_to_array(Summarizer.sum(F.col("__g"))).alias("__grad"))


def _token_sums(rows: DataFrame) -> DataFrame:
    """Sum row gradients onto the tokens of the rows: ``id, step``.

    Tasks add up their own rows first, so a token found in every row leaves a
    task once, not once per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            ids = pa.array(list(held), type=pa.int64())
            sums = as_lists(np.vstack(list(held.values())))
            held.clear()
            return pa.RecordBatch.from_arrays([ids, sums], ["id", "step"])

        for batch in batches:
            grads = as_matrix(batch.column("__grad"))
            ids = batch.column("ids")
            sizes = np.diff(ids.offsets.to_numpy())
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(flat, kind="stable")
            share = 1.0 / np.maximum(sizes, 1)
            for part in np.array_split(order, max(1, len(order) // 50_000)):
                if not len(part):
                    continue
                tokens, first = np.unique(flat[part], return_index=True)
                sums = np.add.reduceat(grads[owner[part]] * share[owner[part]][:, None], first, axis=0)
                for token, total in zip(tokens.tolist(), sums):
                    held[token] = held[token] + total if token in held else total
                if len(held) * grads.shape[1] * 8 > MAX_HELD_BYTES:
                    yield flush()
        if held:
            yield flush()

    partial = rows.select("ids", "__grad").mapInArrow(run, "id bigint, step array<double>")
    total = Summarizer.sum(array_to_vector("step"))
    return partial.groupBy("id").agg(vector_to_array(total).alias("step"))


def _step_in_place(rows: DataFrame, weights: DataFrame, dims: Sequence[int], table: tuple[str, int, int], seen: Observation | None) -> DataFrame:
    """``id, step`` of the cosine loss from ``rows(ids, __teacher)``: means, gradients and their sums in one Python worker per task.

    For tables whose gradient sums a task can hold. What a row's ids count is worked out as a matrix of counts
    where the vocabulary is small beside the texts; the ids leave the JVM once.
    """
    strategy, dim, size = table
    shared = shared_table(weights, strategy, dim, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ((keys, matrix),) = shared.open()
        sums, met = np.zeros((len(keys), dim)), np.zeros(len(keys), dtype=bool)
        loss, n = 0.0, 0
        for batch in batches:
            done = 0
            for ids in row_slices(batch.column("ids"), IDS_OF_A_STEP):
                m = as_matrix(_mean_rows(ids, [(keys, matrix)], dim))
                t = as_matrix(batch.column("__teacher").slice(done, len(ids)))
                done += len(ids)
                d = min(dim, t.shape[1])
                norms = np.linalg.norm(m[:, :d], axis=1) * np.linalg.norm(t[:, :d], axis=1)
                loss += float((1 - np.einsum("ij,ij->i", m[:, :d], t[:, :d]) / np.maximum(norms, COSINE_FLOOR)).sum())
                n += len(ids)
                grad = np.zeros_like(m)
                for d in dims:
                    grad[:, :d] -= _projected(m[:, :d], unit_rows(t[:, :d]))
                sizes = np.diff(ids.offsets.to_numpy())
                grad /= np.maximum(sizes, 1)[:, None]
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                known = keys[at] == flat
                at, owner = at[known], np.repeat(np.arange(len(ids)), sizes)[known]
                met[at] = True
                blocks = counted_blocks(at, owner, len(ids), len(keys))
                if blocks is not None:
                    for begin, end, used, times in blocks:
                        sums[used] += times.T @ grad[begin:end]
                    continue
                order = np.argsort(at, kind="stable")
                for part in np.array_split(order, max(1, len(order) // 50_000)):
                    if len(part):
                        tokens, first = np.unique(at[part], return_index=True)
                        sums[tokens] += np.add.reduceat(grad[owner[part]], first, axis=0)
        if n:  # a row without an id has the loss of the task
            found = np.flatnonzero(met)
            steps = pa.concat_arrays([as_lists(sums[found]), pa.array([None], pa.list_(pa.float64()))])
            names = ["id", "step", "loss", "n"]
            none = [None] * len(found)
            columns = [pa.array([*keys[found].tolist(), None], pa.int64()), steps, pa.array([*none, loss], pa.float64()), pa.array([*none, n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    partial = rows.select("ids", "__teacher").mapInArrow(run, "id bigint, step array<double>, loss double, n bigint")
    if seen is not None:
        partial = partial.observe(seen, (F.sum("loss") / F.sum("n")).alias("loss"))
    partial = partial.filter("id is not null")
    return partial.groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("step"))).alias("step"))


def gradient_step(
    rows: DataFrame,
    weights: DataFrame,
    lr: float,
    n_rows: int,
    loss: str = "cosine",
    dims: Sequence[int] | None = None,
    id_col: str = "doc_id",
    tau: float = TEMPERATURE,
    seen: Observation | None = None,
) -> DataFrame:
    """One descent step over ``rows(id_col, ids, teacher)``: the new ``id, vec`` table.

    ``seen`` observes ``loss``, the mean cosine loss of the rows under the table as it was.
    """
    dims = list(dims) if dims else [vector_length(weights, "vec")]
    rows, table = rows.withColumnRenamed("teacher", "__teacher"), _choose(weights, "auto")
    if select_loss(loss) == "cosine" and table[0] == "lookup" and weights.count() * table[1] * 8 <= MAX_HELD_BYTES:
        steps = _step_in_place(rows, weights, dims, table, seen)
    else:
        pooled = pool_ids(rows, weights, id_col)
        if seen is not None:
            measured = pooled.withColumn("__loss", 1 - cosine(F.col("embedding"), F.col("__teacher")))
            pooled = measured.observe(seen, F.avg("__loss").alias("loss")).drop("__loss")
        if loss == "cosine":
            graded = pooled.withColumn("__grad", cosine_gradient(F.col("embedding"), F.col("__teacher"), dims))
        else:
            graded = pooled.join(_contrastive_gradient(pooled, dims, id_col, tau), id_col)
        steps = _token_sums(graded)
    moved = F.zip_with(
        F.col("vec"), F.col("step"), lambda w, g: w.cast("double") - F.lit(lr / n_rows) * g
    )
    return weights.join(steps, "id", "left").select(
        "id", F.coalesce(F.when(F.col("step").isNotNull(), moved), F.col("vec").cast("array<double>")).alias("vec")
    )


@dataclass(frozen=True)
class FitSettings:
    """How to fit. ``steps`` whole-data steps, each from a fixed share ``parts`` of the rows (1: all of them)."""

    loss: str = "cosine"
    steps: int = 20
    parts: int = 1
    lr: float = 1.0
    warmup: float = 0.1
    floor: float = 0.1
    matryoshka: bool = True
    seed: int = 42


def fit_weights(
    tokens: DataFrame,
    teacher: DataFrame,
    weights: DataFrame,
    settings: FitSettings = FitSettings(),
    id_col: str = "doc_id",
    vector_col: str = "embedding",
    folder: str | None = None,
    measure: Callable[[DataFrame], dict[str, float]] | None = None,
    stop_after: int | None = None,
) -> DataFrame:
    """Fit the table so that pooled token vectors point the way the teacher's do.

    A handful of large steps instead of many small ones: each reads its share of
    all rows once, sums gradients inside its tasks and shuffles one row per token and
    task. Rows are put into shares by a seeded hash of their id, so that no rows need
    numbering. A step ends in a written table - a fixed lineage, and a restart point
    if executors are lost - and the table before it is then removed.

    With ``folder``, a shared one, the rows, the last table and a manifest of the
    finished steps stay there. A run with the same settings goes on after the last
    step in the manifest and ends as an unbroken one does; other settings, or another
    number of rows, are an error. Each step leaves a row for ``fit_history``: its rate,
    the mean cosine loss of its rows before the step, and what ``measure`` says of
    the table after it, say M1 and M2. ``stop_after`` ends a run after so many steps in all.
    """
    select_loss(settings.loss)
    spark = weights.sparkSession
    dim = vector_length(weights, "vec")
    dims = matryoshka_dims(dim) if settings.matryoshka else [dim]
    done: list[dict] = []
    state = None if folder is None else read_text(spark, f"{folder}/{FIT_MANIFEST}")
    if state is None:
        joined = tokens.select(id_col, "ids").join(teacher.select(id_col, F.col(vector_col).alias("teacher")), id_col)
        share = F.pmod(F.xxhash64(F.col(id_col), F.lit(settings.seed)), F.lit(settings.parts)).cast("int")
        place = scratch_path(spark, "fit-rows") if folder is None else f"{folder}/rows"
        joined.withColumn("__part", share).write.mode("overwrite").parquet(place)
    else:
        place, kept, asked = f"{folder}/rows", json.loads(state), tokens.count()
        if kept["settings"] != asdict(settings) or kept["n_rows"] != asked:
            raise ValueError(f"the run in {folder} has other settings or rows: {kept['settings']}, {kept['n_rows']} rows")
        done = kept["steps"]
    rows = spark.read.parquet(place)
    sizes = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # a row per share
    if not sizes:
        raise ValueError("there are no rows to fit to")
    if folder is not None and state is None:
        asked = tokens.count()
        replace_text(spark, f"{folder}/{FIT_MANIFEST}", json.dumps({"settings": asdict(settings), "n_rows": asked, "steps": []}))
    table = weights.select("id", F.col("vec").cast("array<double>").alias("vec"))
    previous: str | None = None
    if done:
        previous = f"{folder}/table-{len(done)}"
        table = spark.read.schema("id bigint, vec array<double>").parquet(previous)
    for step in range(len(done), settings.steps if stop_after is None else min(stop_after, settings.steps)):
        part = sorted(sizes)[step % len(sizes)]
        rate = learning_rate(step + 1, settings.steps, settings.lr, settings.warmup, settings.floor)
        mine = rows.filter(F.col("__part") == part).drop("__part") if settings.parts > 1 else rows.drop("__part")
        path = scratch_path(spark, f"fit-step{step}") if folder is None else f"{folder}/table-{step + 1}"
        seen = None if folder is None else Observation()
        moved = gradient_step(mine, table, rate, sizes[part], settings.loss, dims, id_col, seen=seen)
        moved.write.mode("overwrite").parquet(path)
        release_table(table)
        table = spark.read.schema("id bigint, vec array<double>").parquet(path)
        if folder is not None:
            loss = seen.get["loss"]
            measures = {} if measure is None else {k: float(v) for k, v in measure(table).items()}
            done.append({"step": step + 1, "rate": rate, "loss": loss, "measures": measures})
            # The step counts from here on: its table is whole, its measures are known.
            replace_text(spark, f"{folder}/{FIT_MANIFEST}", json.dumps({"settings": asdict(settings), "n_rows": asked, "steps": done}))
        if previous is not None:
            remove(spark, previous)
        previous = path
    return table


def fit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a run that keeps its state in ``folder``, ids beside the teacher's vector: a measure that reads them joins nothing."""
    return spark.read.parquet(f"{folder}/rows")


def fit_history(spark: SparkSession, folder: str) -> DataFrame:
    """``step, rate, loss, measures`` of the finished steps of a run that keeps its state in ``folder``."""
    state = read_text(spark, f"{folder}/{FIT_MANIFEST}")
    steps = [] if state is None else json.loads(state)["steps"]
    schema = "step int, rate double, loss double, measures map<string,double>"
    return spark.createDataFrame([(s["step"], s["rate"], s["loss"], s["measures"]) for s in steps], schema)


def fit_two_stages(
    documents: tuple[DataFrame, DataFrame],
    queries: tuple[DataFrame, DataFrame],
    weights: DataFrame,
    first: FitSettings = FitSettings(),
    second: FitSettings = FitSettings(lr=0.1),
    id_col: str = "doc_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Documents first, then queries at a lower rate, starting from the first stage's table."""
    after_documents = fit_weights(*documents, weights, first, id_col, vector_col)
    return fit_weights(*queries, after_documents, second, id_col, vector_col)
