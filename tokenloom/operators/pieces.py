"""Word pieces: greedy longest-match splitting and what builds on it.

Three routes give the same answer:

* ``lookup``: the vocabulary, packed into some 30 bytes a piece, is broadcast, so
  each row is encoded where it stands: no token is ever shuffled. A batch looks up
  its *distinct* words only, all of them at once.
* ``mapped``: the same with one file per node, which all Python workers map, for
  vocabularies too large for a copy in each worker.
* ``join``: the vocabulary joins the candidate spans of each word. For vocabularies
  past any node's room, and to hold the other two against.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import lead_length, pretokenize, raw_tokens, truncate_words
from tokenloom.mapped import MappedArray, share
from tokenloom.operators.packed import PIECE_BYTES, PackedPieces, split_words
from tokenloom.operators.tokens import Characters, shared_characters, stretch_tokens, text_slices
from tokenloom.session import MAX_BROADCAST_BYTES, broadcast_if_small, python_workers

# Fixed values of the sub-word model.
UNKNOWN = "[UNK]"
CONTINUATION = "##"
MAX_WORD_CHARS = 100

#: Bytes one vocabulary row takes in a broadcast join.
ROW_BYTES = 256
#: Largest packed vocabulary that is put on every node's disk: some hundred million pieces.
MAX_MAPPED_BYTES = 4 << 30
#: Words of a batch encoded at once inside a task, whatever the length of its texts.
WORDS_AT_ONCE = 500_000


def _vocabulary_facts(vocab: DataFrame) -> tuple[int, int]:
    """(id of the unknown piece, length of the longest piece)."""
    facts = vocab.agg(
        F.max(F.when(F.col("piece") == UNKNOWN, F.col("id"))).alias("unknown"),
        F.max(F.length("piece")).alias("longest"),
    ).first()
    if facts["unknown"] is None:
        raise ValueError(f"the vocabulary has no {UNKNOWN} piece")
    return int(facts["unknown"]), min(int(facts["longest"]), MAX_WORD_CHARS)


def wordpiece(
    words: DataFrame,
    vocab: DataFrame,
    carry: Sequence[str] = (),
    lengths: bool = False,
    cluster: Sequence[str] | None = ("word",),
) -> DataFrame:
    """T4: split each word greedily into the longest pieces of the vocabulary.

    ``words`` holds ``word`` and the ``carry`` columns, which together identify a
    row; the result adds ``ids``. A word with a gap, or of more than 100
    characters, becomes the single unknown piece. ``lengths`` also adds the
    number of characters each piece covers.

    The words are shuffled once, by ``cluster``, while they are still short
    (``None``: they already are); spans and their groupings then stay in place.
    """
    unknown, longest = _vocabulary_facts(vocab)
    pieces = broadcast_if_small(vocab.select("piece", F.col("id").cast("int").alias("id")), ROW_BYTES)
    whole = pieces.select(F.col("piece").alias("word"), F.col("id").alias("__whole"))
    keys = [*carry, "word"]
    base = words.select(*keys)
    if cluster is not None:
        # A fixed number of partitions: spans multiply the rows, so size alone says too little.
        n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        base = base.repartition(n, *cluster)
    base = base.join(whole, "word", "left")

    size = F.length("word")
    # Most words are pieces themselves; only the others are cut into spans.
    needs_spans = F.col("__whole").isNull() & (size >= 1) & (size <= MAX_WORD_CHARS)
    starts = F.explode_outer(F.when(needs_spans, F.sequence(F.lit(1), size)))
    cut = base.select(*keys, "__whole", starts.alias("start"))
    span_lengths = F.sequence(F.lit(1), F.least(size - F.col("start") + 1, F.lit(longest)))
    cut = cut.select(*keys, "__whole", "start", F.explode_outer(span_lengths).alias("n"))
    prefix = F.when(F.col("start") > 1, CONTINUATION).otherwise("")
    candidates = cut.withColumn("piece", F.concat(prefix, F.substring("word", F.col("start"), F.col("n"))))
    matched = candidates.join(pieces, "piece", "left")
    # Length and id in one number: the longest match is a plain maximum.
    packed = F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("id")
    best = matched.groupBy(*keys, "__whole", "start").agg(F.max(packed).alias("best"))
    by_start = F.sort_array(F.collect_list(F.struct("start", "best")))
    per_word = best.groupBy(*keys, "__whole").agg(by_start.alias("__best"))

    def advance(state: Column, m: Column) -> Column:
        n = F.shiftright(m["best"], 32).cast("int")
        piece = m["best"].bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        moved = F.struct(
            (state["at"] + n).alias("at"),
            F.concat(state["ids"], F.array(piece)).alias("ids"),
            F.concat(state["lens"], F.array(n)).alias("lens"),
        )
        return F.when((state["at"] == m["start"]) & m["best"].isNotNull(), moved).otherwise(state)

    no_ints = F.array().cast("array<int>")
    begin = F.struct(F.lit(1).alias("at"), no_ints.alias("ids"), no_ints.alias("lens"))
    walk = F.when(F.col("__best")[0]["start"].isNotNull(), F.aggregate("__best", begin, advance))
    walked = per_word.withColumn("__walk", walk)
    # A gap leaves the walk short of the end.
    complete = F.col("__walk.at") == size + 1
    single = F.coalesce(F.col("__whole"), F.lit(unknown))
    out = [F.when(complete, F.col("__walk.ids")).otherwise(F.array(single)).alias("ids")]
    if lengths:
        out.append(F.when(complete, F.col("__walk.lens")).otherwise(F.array(size)).alias("lens"))
    return walked.select(*keys, *out)


@dataclass(frozen=True)
class SharedPieces:
    """A packed vocabulary as tasks get it: in a broadcast, or mapped from the node's file."""

    arrays: Broadcast | tuple[MappedArray, ...]

    def open(self) -> PackedPieces:
        if isinstance(self.arrays, Broadcast):
            return PackedPieces(*self.arrays.value)
        return PackedPieces(*[a.open() for a in self.arrays])


#: Vocabularies already sent to the executors: a loop over batches that passes the same frame sends it once.
_SHARED: WeakKeyDictionary[DataFrame, dict[str, SharedPieces]] = WeakKeyDictionary()


def packed_bytes(vocab: DataFrame) -> int:
    """What a vocabulary takes when packed."""
    return vocab.agg(F.sum(F.octet_length("piece") + F.lit(PIECE_BYTES))).first()[0] or 0


def shared_pieces(vocab: DataFrame, strategy: str) -> SharedPieces:
    """The vocabulary on every executor, sent once per table."""
    sent = _SHARED.setdefault(vocab, {})
    if strategy not in sent:
        table = vocab.select("piece", F.col("id").cast("int")).toArrow().combine_chunks()  # its bound was checked
        packed = PackedPieces.build(table.column("piece").combine_chunks(), table.column("id").to_numpy())
        spark = vocab.sparkSession
        if strategy == "lookup":
            sent[strategy] = SharedPieces(spark.sparkContext.broadcast(packed.arrays()))
        else:
            sent[strategy] = SharedPieces(tuple(share(spark, [a]) for a in packed.arrays()))
    return sent[strategy]


def split_distinct(words: DataFrame, vocab: DataFrame, carry: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """T4 for a table of distinct words, where they stand: ``carry``, ``word`` and ``ids``.

    The join route shuffles by word *and* row; distinct words are one row each, so no word is hot.
    """
    strategy = _choose(vocab, strategy)
    if strategy == "join":
        return wordpiece(words, vocab, carry, cluster=["word", *carry])
    # A word that is null or empty has no piece; it is the unknown one, as in the join.
    return words.select(*carry, "word", _lookup(F.array("word"), vocab, 0, strategy).alias("ids"))


def row_slices(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """The rows of a list array in slices of at most ``most`` elements; a longer list stands alone."""
    ends, begin = lists.offsets.to_numpy().astype(np.int64), 0
    while begin < len(lists):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1)
        yield lists.slice(begin, stop - begin)
        begin = stop


def _per_word(batch: pa.Array, packed: PackedPieces, unknown: int, part: int) -> tuple[pa.Array, np.ndarray]:
    """One list per word, of ids (part 0) or piece lengths (part 1), and where each row's words begin."""
    coded = batch.flatten().dictionary_encode(null_encoding="encode")
    *values, bounds = split_words(coded.dictionary, packed, unknown, CONTINUATION, MAX_WORD_CHARS)
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values[part]))
    offsets = batch.offsets.to_numpy()
    return lists.take(coded.indices), offsets - offsets[0]


def id_lists(vocab: DataFrame, strategy: str, max_len: int | None = None) -> Callable[[pa.Array], Iterator[pa.Array]]:
    """What turns rows of words into rows of at most ``max_len`` ids, WORDS_AT_ONCE words at a time, by the vocabulary on every executor."""
    unknown, _ = _vocabulary_facts(vocab)
    shared = shared_pieces(vocab, strategy)

    def ids(batch: pa.Array) -> Iterator[pa.Array]:
        packed = shared.open()
        for part in row_slices(batch, WORDS_AT_ONCE):
            lists, rows_at = _per_word(part, packed, unknown, 0)
            starts = lists.offsets.to_numpy()[rows_at]
            sizes = np.diff(starts)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if max_len is not None:
                place = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
                flat, sizes = flat[place < max_len], np.minimum(sizes, max_len)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, type=pa.int32()))

    return ids


def text_id_lists(vocab: DataFrame, strategy: str) -> Callable[[pa.Array], Iterator[pa.Array]]:
    """What turns texts into rows of all their ids; of a slice of texts only the distinct stretches are cut into words and pieces."""
    unknown, _ = _vocabulary_facts(vocab)
    shared, known = shared_pieces(vocab, strategy), shared_characters(vocab.sparkSession)

    def ids(batch: pa.Array) -> Iterator[pa.Array]:
        packed, characters = shared.open(), Characters(*known.value)
        for stretches, rows_at in text_slices(batch):
            tokens, tokens_at = stretch_tokens(stretches.dictionary, characters)
            words = tokens.dictionary_encode()
            flat, _, bounds = split_words(words.dictionary, packed, unknown, CONTINUATION, MAX_WORD_CHARS)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat)).take(words.indices)
            of_stretch = pa.ListArray.from_arrays(lists.offsets.take(pa.array(tokens_at)), lists.flatten())
            taken = of_stretch.take(stretches.indices)
            yield pa.ListArray.from_arrays(taken.offsets.take(pa.array(rows_at)), taken.flatten())

    return ids


def _lookup(words: Column, vocab: DataFrame, part: int, strategy: str, max_len: int | None = None) -> Column:
    """Pieces of a row's words, from the vocabulary on every executor.

    Part 0 gives one list of at most ``max_len`` ids per row; part 1 one list of
    piece lengths per word.
    """
    # Declared non-deterministic so that the planner never evaluates it twice.
    if part == 0:
        of = id_lists(vocab, strategy, max_len)

        def ids(batch: pa.Array) -> pa.Array:
            return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *of(batch)])

        return F.arrow_udf(ids, "array<int>").asNondeterministic()(words)
    unknown, _ = _vocabulary_facts(vocab)
    shared = shared_pieces(vocab, strategy)

    def lengths(batch: pa.Array) -> pa.Array:
        packed, parts = shared.open(), [pa.array([], pa.list_(pa.list_(pa.int32())))]
        for rows in row_slices(batch, WORDS_AT_ONCE):
            lists, rows_at = _per_word(rows, packed, unknown, 1)
            parts.append(pa.ListArray.from_arrays(pa.array(rows_at), lists))
        return pa.concat_arrays(parts)

    return F.arrow_udf(lengths, "array<array<int>>").asNondeterministic()(words)


def _choose(vocab: DataFrame, strategy: str) -> str:
    """The route for this vocabulary; an error for an unknown one, and for a broadcast past the bound."""
    if strategy not in ("auto", "lookup", "mapped", "join"):
        raise ValueError(f"unknown strategy {strategy!r}: use 'auto', 'lookup', 'mapped' or 'join'")
    if strategy in ("mapped", "join"):
        return strategy
    size, workers = packed_bytes(vocab), python_workers(vocab.sparkSession)
    if size * workers <= MAX_BROADCAST_BYTES:
        return "lookup"
    if strategy == "lookup":
        raise ValueError(f"{size} bytes in each of {workers} Python workers are past the broadcast bound of {MAX_BROADCAST_BYTES} bytes")
    return "mapped" if size <= MAX_MAPPED_BYTES else "join"


def _joined_pieces(df: DataFrame, words: Column, vocab: DataFrame, id_col: str, part: int) -> DataFrame:
    """Add ``__pieces``, one list per word of the row, by joins."""
    # One shuffle by row key up front: every later grouping finds its rows in place.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(id_col, words.alias("__words")).repartition(n, id_col)
    # Outer, or the planner would add a filter on the words and compute them twice.
    tokens = keyed.select(id_col, F.posexplode_outer("__words").alias("pos", "word"))
    split = wordpiece(tokens, vocab, carry=(id_col, "pos"), lengths=part == 1, cluster=None)
    value = F.when(F.col("pos").isNotNull(), F.struct("pos", F.col("lens" if part == 1 else "ids").alias("v")))
    ordered = F.sort_array(F.collect_list(value))
    per_row = split.groupBy(id_col).agg(F.transform(ordered, lambda s: s["v"]).alias("__pieces"))
    none = F.array().cast("array<array<int>>")
    return df.join(per_row, id_col, "left").withColumn("__pieces", F.coalesce("__pieces", none))


def _head(text: Column, n: int) -> Column:
    """A cut that keeps the first ``n`` pre-tokens whole; only long texts are worth cutting."""
    return F.when(F.length(text) > 8 * n, truncate_words(text, n)).otherwise(F.coalesce(text, F.lit("")))


def headed_words(df: DataFrame, max_len: int | None, text_col: str) -> tuple[DataFrame, Column]:
    """``df`` with ``__head``, the text that is looked at, and the words of it."""
    if max_len is None:
        return df.withColumn("__head", F.coalesce(F.col(text_col), F.lit(""))), pretokenize(F.col("__head"))
    return df.withColumn("__head", _head(F.col(text_col), max_len)), F.slice(pretokenize(F.col("__head")), 1, max_len)


def encode_ids(
    df: DataFrame,
    vocab: DataFrame,
    max_len: int | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    strategy: str = "auto",
) -> DataFrame:
    """Add ``ids``, the piece ids of the whole text without special tokens, or the first ``max_len`` of them.

    Every word gives at least one id, so words past ``max_len`` are never looked at.
    """
    headed, words = headed_words(df, max_len, text_col)
    strategy = _choose(vocab, strategy)
    if strategy != "join":
        return headed.withColumn("ids", _lookup(words, vocab, 0, strategy, max_len)).drop("__head")
    pieces = _joined_pieces(headed, words, vocab, id_col, part=0)
    every = F.flatten("__pieces")
    return pieces.withColumn("ids", every if max_len is None else F.slice(every, 1, max_len)).drop("__head", "__pieces")


def truncate_pieces(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int = 512,
    n_special: int = 2,
    text_col: str = "text",
    id_col: str = "doc_id",
    strategy: str = "auto",
) -> DataFrame:
    """Cut the text after the last piece that fits into ``max_length`` tokens.

    The cut may fall inside a word; where normalising changed the word's length
    the whole word is kept.
    """
    room = max_length - n_special
    if room < 1:
        raise ValueError("max_length leaves no room for text")
    head = F.col("__head")
    headed = df.withColumn("__head", truncate_words(F.col(text_col), room))
    headed = headed.withColumn("__words", pretokenize(head))
    strategy = _choose(vocab, strategy)
    if strategy != "join":
        pieces = headed.withColumn("__pieces", _lookup(F.col("__words"), vocab, 1, strategy))
    else:
        pieces = _joined_pieces(headed, F.col("__words"), vocab, id_col, part=1)
    words = F.arrays_zip(
        raw_tokens(head).alias("raw"), F.col("__words").alias("word"), F.col("__pieces").alias("lens")
    )

    def keep(state: Column, w: Column) -> Column:
        left = F.lit(room) - state["used"]
        raw_len = F.length(w["raw"])
        lead = lead_length(w["raw"])
        inside = F.aggregate(F.slice(w["lens"], F.lit(1), left), F.lit(0), lambda a, n: a + n)
        same_length = raw_len - lead == F.length(w["word"])
        part_len = F.when(same_length, lead + inside).otherwise(raw_len)
        step = F.when(F.size(w["lens"]) <= left, raw_len).otherwise(part_len)
        fuller = F.struct(
            (state["used"] + F.least(F.size(w["lens"]), left)).alias("used"), (state["end"] + step).alias("end")
        )
        return F.when(left > 0, fuller).otherwise(state)

    begin = F.struct(F.lit(0).alias("used"), F.lit(0).alias("end"))
    end = F.aggregate("__zipped", begin, keep)["end"]
    cut = F.substring(F.col(text_col), F.lit(1), F.col("__end"))
    return (
        pieces.withColumn("__zipped", words)
        .withColumn("__end", end)
        .withColumn(text_col, F.coalesce(cut, F.lit("")))
        .drop("__head", "__words", "__pieces", "__zipped", "__end")
    )
