import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordPiece
from tokenizers.normalizers import BertNormalizer
from tokenizers.pre_tokenizers import BertPreTokenizer

from tokenloom.functions import names, text
from tokenloom.operators import pieces
from tests.conftest import texts


def column(df, col):
    return [r[0] for r in df.select(col, "doc_id").orderBy("doc_id").collect()]


def test_clean_cut_strips_and_cuts(spark):
    df = texts(spark, " \t word \n", "", None, "x" * 10_001, " \t\n", "a\U0001f600b")
    assert column(df, text.clean_cut(F.col("text"))) == ["word", "", "", "x" * 10_000, "", "a\U0001f600b"]
    assert column(df, text.clean_cut(F.col("text"), 2))[-1] == "a\U0001f600"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Hello, World!", ["hello", ",", "world", "!"]),
        ("Café CAFÉ", ["cafe", "cafe"]),
        ("a\x00b\u200bc", ["abc"]),
        ("漢字か゚", ["漢", "字", "か"]),
        ("€5 $5", ["€5", "$", "5"]),
        ("ΣΑΣ İ", ["σασ", "i"]),
        ("한국", [unicodedata.normalize("NFD", "한국")]),
        ("x \u200b y", ["x", "y"]),
        ("a≠b", ["a", "=", "b"]),
        ("", []),
        (None, []),
    ],
)
def test_pretokenize(spark, raw, expected):
    found = column(texts(spark, raw), text.pretokenize(F.col("text")))[0]
    assert found == expected
    assert len(column(texts(spark, raw), text.raw_tokens(F.col("text")))[0]) == len(expected)


def test_normalize_keeps_spaces_and_spaces_out_cjk(spark):
    assert column(texts(spark, "A\tÉ　漢b"), text.bert_normalize(F.col("text"))) == ["a e  漢 b"]


def test_truncate_words(spark):
    df = texts(spark, "one, two three", "  one", "", "漢字 a")
    assert column(df, text.truncate_words(F.col("text"), 2)) == ["one,", "  one", "", "漢字"]
    assert column(df, text.truncate_words(F.col("text"), 0)) == ["", "", "", ""]


def test_names(spark):
    df = texts(spark, "group/data", "data", "")
    assert column(df, names.short_name(F.col("text"))) == ["data", "data", ""]
    assert column(df, names.path_safe_name(F.col("text"))) == ["group__data", "data", ""]


def reference_tokenizer(vocab):
    table = {r.piece: r.id for r in vocab.collect()}
    tokenizer = Tokenizer(WordPiece(table, unk_token="[UNK]", max_input_chars_per_word=100))
    tokenizer.normalizer = BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=None, lowercase=True)
    tokenizer.pre_tokenizer = BertPreTokenizer()
    return tokenizer


ALPHABET = "abchelowrdizgnkt .,!$€éÉß漢́​\x00\t\nΣ≠"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(ALPHABET, max_size=60), min_size=20, max_size=20))
def test_encoding_equals_the_public_tokenizer(spark, vocab, values):
    values = [*values, "a" * 101, "walking hello zoo", ""]
    tokenizer = reference_tokenizer(vocab)
    expected = [tokenizer.encode(v).ids[:12] for v in values]
    df = texts(spark, *values)
    for strategy in ("lookup", "mapped", "join"):
        found = column(pieces.encode_ids(df, vocab, 12, strategy=strategy), "ids")
        assert found == expected


def test_wordpiece_cases(spark, vocab):
    words = ["hello", "walking", "zoo", "a" * 100, "a" * 101, "helloz"]
    ids = {r.piece: r.id for r in vocab.collect()}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = {r.word: r.ids for r in pieces.wordpiece(df, vocab).collect()}
    assert found["hello"] == [ids["hello"]]
    assert found["walking"] == [ids["walk"], ids["##ing"]]
    assert found["zoo"] == found["helloz"] == found["a" * 101] == [ids["[UNK]"]]
    assert found["a" * 100] == [ids["a"]] + [ids["##a"]] * 99


def test_missing_unknown_piece_is_an_error(spark, vocab):
    with pytest.raises(ValueError, match="UNK"):
        pieces.wordpiece(spark.createDataFrame([("a",)], "word string"), vocab.filter("piece <> '[UNK]'"))
    with pytest.raises(ValueError, match="strategy"):
        pieces.encode_ids(texts(spark, "a"), vocab, strategy="guess")


@pytest.mark.parametrize("strategy", ["lookup", "mapped", "join"])
def test_truncate_pieces(spark, vocab, strategy):
    values = ["hello world", "  walking, hello", "cafés abc", "", "zzz hello", None]
    df = texts(spark, *values)
    found = column(pieces.truncate_pieces(df, vocab, 4, 2, strategy=strategy), "text")
    # "cafés" is cut inside the word: the accent does not change its length.
    assert found == ["hello world", "  walking", "ca", "", "zzz hello", ""]
    again = column(pieces.truncate_pieces(texts(spark, *found), vocab, 4, 2, strategy=strategy), "text")
    assert again == found
    full = column(pieces.encode_ids(df, vocab, 2), "ids")
    assert column(pieces.encode_ids(texts(spark, *found), vocab, 2), "ids") == full


def test_truncate_pieces_needs_room(spark, vocab):
    with pytest.raises(ValueError, match="room"):
        pieces.truncate_pieces(texts(spark, "a"), vocab, 2, 2)
