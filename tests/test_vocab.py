import pytest

from tokenloom.operators import vocab as V
from tokenloom.session import materialize
from tests.conftest import texts


def counts(spark, **frequencies):
    return spark.createDataFrame(list(frequencies.items()), "token string, frequency bigint")


def test_token_counts(spark):
    df = texts(spark, "to be, or not to be", "not now", None, "be!")
    assert [tuple(r) for r in V.token_counts(df).collect()][:3] == [("be", 3), ("not", 2), ("to", 2)]
    frequency = {"be": 3, "not": 2, "to": 2, "or": 1, "now": 1, ",": 1, "!": 1}
    rows = {"be": 2, "not": 2, "to": 1, "or": 1, "now": 1, ",": 1, "!": 1}
    assert {tuple(r) for r in V.document_frequency(df).collect()} == set(rows.items())
    assert {tuple(r) for r in V.vocabulary_table(df).collect()} == {(t, n, rows[t]) for t, n in frequency.items()}


def test_merge_keeps_repeats(spark):
    assert V.merge_vocabularies([counts(spark, a=1), counts(spark, a=2)]).count() == 2


def test_piece_usage_sums_repeats(spark, vocab):
    merged = V.merge_vocabularies([counts(spark, hello=3, walking=2), counts(spark, hello=4, zoo=5)])
    used = {r.piece: r.usage for r in V.piece_usage(merged, vocab).collect()}
    assert used["hello"] == 7 and used["walk"] == used["##ing"] == 2 and used["[UNK]"] == 5
    assert used["a"] == 0 and len(used) == vocab.count()


def test_prune(spark, vocab):
    usage = V.piece_usage(counts(spark, hello=3, walking=2), vocab)
    kept = [(r.piece, r.id) for r in V.prune_vocab(vocab, usage, 3).orderBy("id").collect()]
    assert kept == [("[UNK]", 0), ("[PAD]", 1), ("hello", 2)]
    # One piece survives even the highest threshold: the one with the highest id.
    last = V.prune_vocab(vocab, usage, 10_000, protect=()).collect()
    assert [(r.piece, r.id) for r in last] == [("walk", 0)]


def test_add_top_tokens(spark, vocab):
    size = vocab.count()
    offered = counts(spark, hello=61, fresh=26, newer=19, third=19).union(
        spark.createDataFrame([("40417", 83), ("٣٤", 77), ("newer", 38)], "token string, frequency bigint")
    )
    added = V.add_top_tokens(vocab, offered, size + 2).filter(f"id >= {size}").orderBy("id").collect()
    assert [(r.piece, r.id) for r in added] == [("newer", size), ("fresh", size + 1)]
    with_numbers = V.add_top_tokens(vocab, offered, size + 1, filter_numbers=False)
    assert with_numbers.filter(f"id = {size}").first().piece == "40417"
    assert V.add_top_tokens(vocab, offered, size).count() == size
    assert V.add_top_tokens(vocab, counts(spark, **{"7": 2, "1999": 31, "08": 31}), size + 4).count() == size


def test_expand(spark, vocab):
    offered = counts(spark, hello=9, fresh=5)
    assert V.expand_vocab(vocab, offered, 0, vocab.count() + 1).count() == vocab.count() + 1
    grown = V.expand_vocab(vocab, offered, 5, 9).orderBy("id").collect()
    assert grown[0].piece == "[UNK]" and [r.id for r in grown] == list(range(len(grown)))
    assert "fresh" in {r.piece for r in grown}


def test_pruning_works_the_usage_out_once(spark, vocab):
    """Numbering reads the rated pieces several times; the words behind them are split once."""
    split = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            split.add(batch.num_rows)
            yield batch

    offered = counts(spark, hello=9, walking=7, fresh=5).mapInArrow(seen, "token string, frequency bigint")
    V.expand_vocab(vocab, materialize(counts(spark, hello=9), "counts"), 5, 9).count()
    V.prune_vocab(vocab, V.piece_usage(offered, vocab), 5).count()
    assert split.value == 3


def test_lowercase(spark):
    df = spark.createDataFrame([("[UNK]", 0), ("Ab", 1), ("ab", 2), ("C", 3)], "piece string, id int")
    assert sorted(tuple(r) for r in V.lowercase_vocab(df).collect()) == [("[UNK]", 0), ("ab", 1), ("c", 3)]
    with pytest.raises(ValueError):
        V.merge_vocabularies([])
