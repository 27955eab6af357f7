"""The tokens of whole batches against the column functions, and what the queries built on them read and run."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import texts
from tokenloom.functions import text
from tokenloom.operators import embed, pieces, tokens, vocab as V
from tokenloom.plans import queries

SF = "/root/testdata/sf0.001"
CODES = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]


@pytest.fixture(scope="module")
def odd(spark):
    """Every character there is, and strings that mix blanks, marks, syllables and controls."""
    rnd = random.Random(3)
    common = [32, 10, 9, 13, 65, 97, 0x301, 0xE9, 0xAC01, 0x3A3, 0x130, 0x3000, 0x4E00, 44, 0, 0xFFFD]
    mixed = ["".join(chr(rnd.choice(CODES if rnd.random() < 0.2 else common)) for _ in range(200)) for _ in range(100)]
    every = ["".join(map(chr, CODES[i : i + 2000])) for i in range(0, len(CODES), 2000)]
    return [None, "", "  ", "\n\n", "a\nb", "Hello,  World!\t a\x00b c\r\nd", "x" * 101 + "Y, " + "漢字" * 50, *mixed, *every]


@pytest.fixture(scope="module")
def expected(spark, odd):
    rows = texts(spark, *odd).repartition(8).select("doc_id", text.pretokenize(F.col("text")).alias("words")).collect()
    return [words for _, words in sorted(tuple(r) for r in rows)]


def test_tokens_of_batches_equal_the_column_function(spark, monkeypatch, odd, expected):
    monkeypatch.setattr(tokens, "BYTES_AT_ONCE", 5_000)
    characters = tokens.Characters(*tokens.shared_characters(spark).value)
    found = []
    for batch in (pa.array(odd), pa.array(["left out", *odd, "too"])[1:-1], pa.array([], pa.string())):
        found.clear()
        for stretches, rows_at in tokens.text_slices(batch):
            words, words_at = tokens.stretch_tokens(stretches.dictionary, characters)
            words.validate(full=True)
            words, used = words.to_pylist(), stretches.indices.to_pylist()
            for begin, end in zip(rows_at[:-1], rows_at[1:]):
                found.append([w for i in used[begin:end] for w in words[words_at[i] : words_at[i + 1]]])
        assert found == expected[: len(batch)]


def test_counts_equal_exploded_words(spark, odd):
    df = texts(spark, *odd, *odd[:50])
    counts = V.token_counts(df, ordered=False)
    plain = df.select(F.explode(text.pretokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    assert counts.schema == plain.schema
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    assert V.token_counts(texts(spark, None, ""), ordered=False).count() == 0


@pytest.mark.parametrize("strategy", ["lookup", "mapped"])
def test_whole_texts_have_the_vectors_of_their_ids(spark, vocab, strategy):
    df = texts(spark, None, "", "walking,  hello\nzoo hello", "a" * 101 + " Café 漢", *["world abc"] * 3)
    weights = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3, 80)], "id int, vec array<double>")
    found = embed.static_encode(df, vocab, weights, strategy=strategy, one_worker=True).orderBy("doc_id").collect()
    ids = pieces.encode_ids(df, vocab, strategy="join").orderBy("doc_id").collect()
    for row, expected in zip(found, ids, strict=True):
        known = [i for i in expected.ids if 3 <= i < 80]
        mean = [np.mean(known), 1.0] if known else [0.0, 0.0]
        assert row.doc_id == expected.doc_id and np.allclose(row.embedding, mean)


def test_places_equal_a_sorted_search():
    rnd = np.random.default_rng(5)
    for keys in ([4], [3, 3, 5, 9], [-2, 0, 1, 1, 7], [0, 10**12]):
        keys = np.array(keys)
        for asked in (rnd.integers(-5, 14, 200), np.array([3, 7])):
            at, known = embed.places(keys, asked)
            assert (known == np.isin(asked, keys)).all()
            assert (at[known] == np.searchsorted(keys, asked)[known]).all() and at.min() >= 0 and at.max() < len(keys)


def test_queries_cut_each_distinct_stretch_once_and_search_stored_vectors(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # No text is taken apart token by token in the JVM, and the search works out no vector again.
    assert "regexp_extract_all" not in plan(queries._encoded(spark, SF))
    assert "regexp_extract_all" not in plan(V.token_counts(queries._documents(spark, SF)))
    nearest = plan(queries.nearest_documents(spark, SF))
    assert "MapInArrow" in nearest and "ArrowEvalPython" not in nearest
