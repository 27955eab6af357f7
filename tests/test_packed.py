"""Packed vocabularies against a plain dictionary, and at a size past any dictionary's room."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.operators import embed, pieces
from tokenloom.operators.packed import PIECE_BYTES, PackedPieces, split_words
from tokenloom.session import materialize
from tests.conftest import texts

UNKNOWN = 999


def plain_split(word, known, max_chars):
    """The greedy rule for one word, by slices of text."""
    if word in known:
        return [(known[word], len(word))]
    found, at = [], 0
    while at < len(word) <= max_chars:
        ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in known]
        if not ends:
            return [(UNKNOWN, len(word))]
        found.append((known[("##" if at else "") + word[at : ends[0]]], ends[0] - at))
        at = ends[0]
    return found or [(UNKNOWN, len(word))]


LETTERS = st.text(alphabet="ab#é漢\U0001f600", max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, max_size=25), st.lists(st.text(alphabet="ab#é漢\U0001f600", max_size=9), max_size=20), st.integers(1, 9))
def test_splits_equal_the_plain_rule(made, words, max_chars):
    known = {}
    for i, p in enumerate(made + ["##" + p for p in made[::2]]):
        known.setdefault(p, i)
    listed = made + ["##" + p for p in made[::2]]
    packed = PackedPieces.build(pa.array(listed, pa.string()), np.arange(len(listed)))
    ids, covered, bounds = split_words(pa.array(words, pa.string()), packed, UNKNOWN, "##", max_chars)
    found = [list(zip(ids[i:j].tolist(), covered[i:j].tolist())) for i, j in zip(bounds[:-1], bounds[1:])]
    # The empty piece is nobody's: an empty word is unknown unless a piece is empty too.
    assert found == [plain_split(w, known, max_chars) for w in words]


def test_five_million_pieces_stay_on_the_map_only_route(spark):
    n = 5_000_000
    text = F.concat(F.when(F.col("id") % 2 == 1, "##").otherwise(""), F.lower(F.hex(F.xxhash64("id") % 100_000_000_000)))
    unknown = spark.range(1).select(F.lit("[UNK]").alias("piece"), F.lit(n).alias("id"))
    vocab = materialize(spark.range(n).select(text.alias("piece"), F.col("id").cast("int").alias("id")).unionByName(unknown), "five-million")
    size = pieces.packed_bytes(vocab)
    assert size < 48 * n
    assert pieces._choose(vocab, "auto") == "mapped"
    known = vocab.filter("id < 4000").orderBy("id").collect()
    words = [known[i].piece + known[i + 1].piece[2:] for i in range(0, 4000, 2) if not known[i].piece.startswith("##")]
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*words, "[UNK", "~"])], "doc_id long, text string")
    encoded = pieces.encode_ids(df, vocab)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    by_route = [{r.doc_id: r.ids for r in rows.collect()} for rows in (encoded, pieces.encode_ids(df.filter("doc_id < 50"), vocab, strategy="join"))]
    assert len(by_route[0]) == len(words) + 2
    assert all(by_route[0][i] == ids for i, ids in by_route[1].items())
    shared = pieces._SHARED[vocab]["mapped"].arrays
    held = sum(int(np.prod(a.shape)) * np.dtype(a.dtype).itemsize for a in shared)
    assert held <= size + 64 and PIECE_BYTES <= 22


def test_encoding_takes_one_worker(spark, vocab):
    """Words become vectors in one Python node, which gives the rows of the joins."""
    table = spark.createDataFrame([(r.id, [float(r.id), 1.0]) for r in vocab.collect()], "id int, vec array<double>")
    rows = texts(spark, "hello walking world", "", None, "zebra a1!", "walk " * 300)
    found = embed.static_encode(rows, vocab, table, normalize=True, one_worker=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    joined = embed.static_encode(rows, vocab, table, normalize=True, strategy="join")
    expected = {r.doc_id: r.embedding for r in joined.collect()}
    for r in found.collect():
        assert r.embedding == pytest.approx(expected[r.doc_id])


def test_slices_of_rows():
    lists = pa.array([[1, 2], [], [3, 4, 5, 6], [7], [8], []], pa.list_(pa.int32())).slice(1)
    parts = list(pieces.row_slices(lists, 2))
    assert [p.to_pylist() for p in parts] == [[[]], [[3, 4, 5, 6]], [[7], [8], []]]
