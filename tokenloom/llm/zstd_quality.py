"""Quality classifier by compression: zstandard dictionaries of good and bad labelled text.

Two dictionaries of equal size are built from one half of a bounded labelled
sample. A text is cut into short blocks, each block is compressed with either
dictionary, and the difference of the two sizes over their sum, averaged over the
blocks, says which kind of text it resembles. The other half of the sample
calibrates that difference alone to a probability by logistic regression, in
which each class weighs what it weighs among all labels, however many of its
rows the sample holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import slices

#: The fit reads at most so many labelled rows, and so many bytes, of each class.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 8 << 20
#: A longer labelled text is learned from by its first so many characters, so that no single one fills the sample. It is scored whole.
SAMPLE_CHARS = 1 << 15
#: Bytes of a dictionary at most, and of the pieces of texts that it is made of.
DICTIONARY_BYTES, PIECE = 112 << 10, 128
#: Blocks are short, so that what a block shares with a dictionary outweighs what it shares with itself.
BLOCK = 64
#: Added to the sizes of each block, and blocks without a leaning that are added to each text: short texts stay near the share of good labels.
DAMP_BYTES, DAMP_BLOCKS = 64.0, 5.0
LEVEL = 3
THRESHOLD = 0.7


def build_dictionary(texts: list[bytes], limit: int = DICTIONARY_BYTES) -> bytes:
    """Text that the compressor may refer to: a first piece of each text, then a second one, and so on, up to ``limit`` bytes."""
    pieces: list[bytes] = []
    held, at, longest = 0, 0, max(map(len, texts), default=0)
    while at < longest and held < limit:
        turn = [t[at : at + PIECE] for t in texts if len(t) > at]
        pieces += turn
        held += sum(map(len, turn))
        at += PIECE
    return b"".join(pieces)[:limit]


def build_dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """A dictionary of either kind, both of the same size: that of the smaller one."""
    size = min(len(build_dictionary(good)), len(build_dictionary(bad)))
    return build_dictionary(good, size), build_dictionary(bad, size)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(dictionary), write_content_size=False, write_dict_id=False)
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


class Difference:
    """The normalised differences of a whole text's compressed blocks, each from -1 (like the bad texts) to 1 (like the good ones): their sum and number."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = compressor(good), compressor(bad)
        self.frame = len(self.good.compress(b""))  # bytes of an empty block

    def __call__(self, text: bytes) -> tuple[float, int]:
        total, blocks = 0.0, 0
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            good, bad = len(self.good.compress(part)) - self.frame, len(self.bad.compress(part)) - self.frame
            total += (bad - good) / (good + bad + DAMP_BYTES)
            blocks += 1
        return total, blocks


def mean_difference(total: np.ndarray, blocks: np.ndarray, centre: float) -> np.ndarray:
    """The mean over a text's blocks and DAMP_BLOCKS blocks at the centre."""
    return (total + DAMP_BLOCKS * centre) / (blocks + DAMP_BLOCKS)


def calibrate(total: np.ndarray, blocks: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """Intercept and slope over the mean difference, and the centre: the difference that leaves the share of label 1 as it is."""
    share = float(weight @ y / weight.sum())
    centre, w = 0.0, np.zeros(2)
    for _ in range(20):
        w = logistic(mean_difference(total, blocks, centre), y, weight)
        if abs(w[1]) < 1e-6:  # the difference tells nothing
            return [float(np.log(share / (1 - share))), 0.0], 0.0
        centre = float((np.log(share / (1 - share)) - w[0]) / w[1])
    return w.tolist(), centre


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and slope of a weighted logistic regression, by Newton steps that are halved until they lower the loss."""
    x = np.column_stack([np.ones(len(x)), x])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, value: int) -> list[bytes]:
    """Texts of one class, their first SAMPLE_CHARS characters, in hash order of the id, up to the sample's rows and bytes."""
    ids = labels.where((F.col("quality") == value) & F.col("doc_id").isNotNull() & usable).select("doc_id").distinct()
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # bounded: SAMPLE_ROWS ids
    rows = docs.join(F.broadcast(first), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) > 0)
    # Of rows that repeat an id the least text, so that the bound holds for rows as well.
    rows = rows.groupBy("doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    upto = F.sum("bytes").over(_hash_order())
    sized = rows.select("doc_id", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("h"))
    inside = sized.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id").distinct()
    texts = rows.join(F.broadcast(inside), "doc_id").select("doc_id", "text").collect()
    return [r["text"].encode() for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"]))]


def _hash_order():
    from pyspark.sql import Window

    # SAMPLE_ROWS ids at most, so that one task is enough.
    return Window.partitionBy(F.lit(0)).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)


def class_sizes(labels: DataFrame, usable: Column) -> tuple[int, int]:
    """How many documents are labelled 0 and 1."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & usable).select("quality", "doc_id").distinct()
    counts = {r["quality"]: r["count"] for r in ids.groupBy("quality").count().collect()}  # two rows
    return counts.get(0, 0), counts.get(1, 0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> dict:
    """Both dictionaries and the calibration, from labelled rows for which ``usable`` (over doc_id) holds."""
    halves: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for value in (0, 1):
        texts = labelled_sample(docs, labels, usable, value)
        halves[value] = texts[::2], texts[1::2]
    good, bad = build_dictionaries(halves[1][0], halves[0][0])
    held = {v: len(halves[v][1]) for v in (0, 1)}
    if not held[0] or not held[1]:  # nothing to tell apart: the share of label 1 among what was seen, or a half
        seen = [v for v in (0, 1) for half in halves[v] for _ in half]
        share = (sum(seen) + 1) / (len(seen) + 2)
        return {"good": good, "bad": bad, "weights": [float(np.log(share / (1 - share))), 0.0], "centre": 0.0}
    difference = Difference(good, bad)
    x = np.asarray([difference(t) for v in (0, 1) for t in halves[v][1]], dtype=np.float64)
    y = np.repeat([0.0, 1.0], [held[0], held[1]])
    sizes = class_sizes(labels, usable)
    each = [sizes[v] / sum(sizes) * len(y) / held[v] for v in (0, 1)]
    weights, centre = calibrate(x[:, 0], x[:, 1], y, np.repeat(each, [held[0], held[1]]))
    return {"good": good, "bad": bad, "weights": weights, "centre": centre}


def size_difference(text: Column, model: dict) -> Column:
    """The mean normalised difference of each whole text's compressed blocks; null counts as empty."""
    state: dict = {}

    @F.arrow_udf("double")
    def measured(column: pa.Array) -> pa.Array:
        if "d" not in state:
            state["d"] = Difference(model["good"], model["bad"])
        parts = (column.slice(a, b - a).cast(pa.large_binary()).to_pylist() for a, b in slices(column))  # not all texts twice
        x = np.asarray([state["d"](t or b"") for part in parts for t in part], dtype=np.float64).reshape(-1, 2)
        return pa.array(mean_difference(x[:, 0], x[:, 1], model["centre"]))

    return measured.asNondeterministic()(text)


def classify(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Every input row with score (0 to 1), predicted (1 if score >= threshold) and size_difference, which the score is a function of.

    Null and empty texts get the score of an empty text, the share of label 1. Rows without a label, or
    with a label other than 0 and 1, are only scored; a row labelled both ways
    counts for both. With no usable label every score is one half. Columns of
    these names are replaced, all others pass through.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), usable)
    taken = {"score", "predicted", "size_difference"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    intercept, slope = model["weights"]
    odds = F.lit(intercept) + F.lit(slope) * F.col("size_difference")
    scored = docs.select(*rest, size_difference(F.col("text"), model).alias("size_difference"))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select(*rest, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "size_difference")


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted 1, with the columns they came with."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("judged_row"), "doc_id", "text")
    kept = classify(packed, labels, usable, threshold).where("predicted = 1")
    return kept.select(*[F.col(f"judged_row.`{c}`").alias(c) for c in names])
