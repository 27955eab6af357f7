"""Ranked lexical search the other way round: the items wait in an index, the documents stream past.

The inverted index (term -> items that ask for it) is broadcast. Each document's
term counts run through it once, and every task keeps one heap of the ``k`` best
documents per item, so that a task sends out k rows per item however many
documents it reads. The heaps are then merged.

Documents are split into terms once: the counts of the terms that some item asks
for are stored, the corpus statistics (documents, terms, document frequencies) are
sums over that table, and scoring reads it again. Items past the size of one index
are taken in blocks, every document against every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import flat_bytes, slices
from tokenloom.llm.tokens import LOWERED, word_bounds
from tokenloom.session import remove, scratch_path

#: Bytes of item terms in one index; more items take more passes.
INDEX_BYTES = 16 << 20
#: Scores and postings held at once inside a task; a single document with more is scored alone.
CELLS = 1 << 21
#: Everything that is not an ASCII digit or letter or beyond ASCII parts terms.
BETWEEN = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
#: Fixed weights of the ranking.
SCALE, LENGTH_SHARE, SATURATION = 1000, 90, 8


def terms_of(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The terms of each text, one after the other, and where each text's terms begin (n + 1 values)."""
    data, offsets = flat_bytes(column)
    data = LOWERED[data]
    first, last, at = word_bounds(data, offsets, BETWEEN)
    ends = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(last - first, out=ends[1:])
    kept = data[~BETWEEN[data]]
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))]
    return pa.Array.from_buffers(pa.large_binary(), len(first), buffers), at


def grouped(keys: np.ndarray, groups: int) -> np.ndarray:
    """Where each of ``groups`` groups begins in sorted ``keys`` (groups + 1 values)."""
    return np.searchsorted(keys, np.arange(groups + 1))


def item_terms(items: DataFrame, text: str, item_id: str) -> DataFrame:
    """item_id, terms (distinct): one row per item that has a term."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                found, at = terms_of(batch.column("text").slice(a, b - a))
                found = found.to_pylist()
                own = [sorted(set(found[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema[item_id].dataType.simpleString()
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(split, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)


def term_counts(docs: DataFrame, text: str, doc_id: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the document), terms and counts (of the vocabulary's terms in it), for documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most INDEX_BYTES of terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                found, at = terms_of(batch.column("text").slice(a, b - a))
                texts, n = b - a, np.diff(at)
                coded = found.dictionary_encode()
                term = np.array([known.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
                term = term[coded.indices.to_numpy()] if len(found) else term
                owner = np.repeat(np.arange(texts), n)[term >= 0]
                key, tf = np.unique(owner * max(1, len(known)) + term[term >= 0], return_counts=True)
                starts = grouped(key // max(1, len(known)), texts).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(v)) for v in ((key % max(1, len(known))).astype(np.int32), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The length normalisation m of documents with ``n`` terms, in whole numbers."""
    base = 100 - LENGTH_SHARE
    if len(n) and LENGTH_SHARE * int(n.max()) * documents >= 1 << 63:  # past 64 bits in between, not in the result
        return np.array([base + LENGTH_SHARE * int(x) * documents // total for x in n], dtype=np.int64)
    return base + LENGTH_SHARE * n * documents // total


class Heaps:
    """The k best (score, document) of every item; equal scores by ascending id, rows without an id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items)  # a document must reach this score
        self.item = np.zeros(0, dtype=np.int64)
        self.score, self.doc, self.unnamed = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        doc, unnamed = np.concatenate([self.doc, doc]), np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((doc, unnamed, -score, item))
        item = item[order]
        begins = grouped(item, len(self.least))
        kept = np.arange(len(item)) - begins[item] < self.k
        order, self.item = order[kept], item[kept]
        self.score, self.doc, self.unnamed = score[order], doc[order], unnamed[order]
        begins = grouped(self.item, len(self.least))
        full = np.flatnonzero(np.diff(begins) == self.k)
        self.least[full] = self.score[begins[full + 1] - 1]


def best_documents(
    counts: DataFrame, postings: list[np.ndarray], numbers: np.ndarray, weights: np.ndarray, documents: int, total: int, k: int
) -> DataFrame:
    """row (the item's entry in ``numbers``), doc_id, score: the k best of each task, for all items of one index."""
    starts = np.zeros(len(postings) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in postings], out=starts[1:])
    shared = counts.sparkSession.sparkContext.broadcast((starts, np.concatenate(postings), numbers, weights))

    def scores(part: pa.RecordBatch, term: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Documents times items; ``term`` are the documents' terms one after the other, ``size`` their numbers."""
        starts, flat, numbers, weights = shared.value
        tf = part.column("counts").flatten().to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        m = length_factor(part.column("n").to_numpy(), documents, total)[owner]
        gain = weights[term] * ((SCALE**3 * tf) // (SCALE * tf + SATURATION * m))
        askers = starts[term + 1] - starts[term]
        place = np.arange(askers.sum()) - np.repeat(np.cumsum(askers) - askers, askers)
        cell = np.repeat(owner, askers) * len(numbers) + flat[np.repeat(starts[term], askers) + place]
        # Sums stay far below 2^53, where doubles are whole numbers.
        return np.bincount(cell, np.repeat(gain, askers).astype(np.float64), len(size) * len(numbers)).reshape(len(size), -1)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _, numbers, _ = shared.value
        heaps = Heaps(len(numbers), k)
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            term = lists.flatten().to_numpy().astype(np.int64)
            met = np.zeros(len(term) + 1, dtype=np.int64)
            np.cumsum(starts[term + 1] - starts[term], out=met[1:])
            work = np.cumsum(np.maximum(np.diff(met[ends]), len(numbers)))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + CELLS, side="right")))
                part = batch.slice(a, b - a)
                score = scores(part, term[ends[a] : ends[b]], np.diff(ends[a : b + 1]))
                doc, item = np.nonzero(score >= heaps.least)
                if len(doc):
                    ids = part.column("doc_id")
                    unnamed = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
                    heaps.offer(item, score[doc, item], ids.fill_null(0).to_numpy(zero_copy_only=False)[doc], unnamed[doc])
                a = b
        if len(heaps.item):
            ids = pa.array(heaps.doc, mask=heaps.unnamed)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[heaps.item]), ids, pa.array(heaps.score.astype(np.int64))], ["row", "doc_id", "score"])

    return counts.mapInArrow(rank, "row long, doc_id long, score long")


def index_of(rows: list[Row]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Numbers of the terms, and for each the places of the items that ask for it."""
    vocabulary: dict[bytes, int] = {}
    postings: list[list[int]] = []
    for place, r in enumerate(rows):
        for term in map(bytes, r["terms"]):
            at = vocabulary.setdefault(term, len(postings))
            if at == len(postings):
                postings.append([])
            postings[at].append(place)
    return vocabulary, [np.array(p, dtype=np.int64) for p in postings]


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its ``k`` best documents with a score above 0, or all, if fewer.

    Terms are maximal runs of ASCII digits and letters (A-Z lower-cased) and
    characters beyond ASCII. Null, empty and wordless texts have no terms: as
    documents they are found by no item and count in no statistic, as items they
    find nothing. A document's repeats of a term count, an item's do not. Equal
    scores rank by ascending doc_id, rows without one last. Repeated rows each rank
    for themselves, repeated items (and items without an id) each have ranks of
    their own. Texts of any length count whole. Other columns are not read, so
    names cannot clash; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    own = scratch_path(spark, "search")
    kind = items.schema[item_id].dataType.simpleString()
    # Each item gets a number, stored with it: ids may repeat.
    item_terms(items, text, item_id).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{own}/items")
    asked = spark.read.schema(f"item_id {kind}, terms array<binary>, row long").parquet(f"{own}/items")
    weight = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 1))).first()[0] or 0
    blocks = -(-weight // index_bytes)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # about index_bytes of terms
        if not rows:
            continue
        vocabulary, postings = index_of(rows)
        term_counts(docs, text, doc_id, vocabulary).write.parquet(f"{own}/counts-{b}")
        counts = spark.read.schema("doc_id long, n long, terms array<int>, counts array<long>").parquet(f"{own}/counts-{b}")
        size = counts.agg(F.count("n").alias("documents"), F.sum("n").alias("total")).first()
        frequency = np.zeros(len(postings), dtype=np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row per term of the index
            frequency[r["term"]] = r["count"]
        n = size["documents"]
        weights = np.array([math.floor(SCALE * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)
        numbers = np.array([r["row"] for r in rows], dtype=np.int64)
        found = best_documents(counts, postings, numbers, weights, n, size["total"] or 1, k)
        found.write.mode("append").parquet(f"{own}/heaps")
        remove(spark, f"{own}/counts-{b}")
    if not blocks:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    heaps = spark.read.schema("row long, doc_id long, score long").parquet(f"{own}/heaps")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
