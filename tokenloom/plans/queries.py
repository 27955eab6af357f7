"""One runnable query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import names, text, vectors
from tokenloom.operators import cells, corpus, distill, embed, evaluate, ordering, pieces, search, vocab
from tokenloom.session import broadcast_if_small, materialize, scratch_path, spread
from tokenloom.sources import embed_run, positions, shards
from tokenloom.sources.catalog import Catalog
from tokenloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL twins.
TOP_WORDS = 2_000
LEFT_OUT = "q"
MAX_IDS = 512
CUT_PIECES = 128
MIN_USAGE = 50
NEW_SIZE = 5_000
BATCH = 64
STEP_RATE = 0.5
MIN_SCORE = 0.25
STREAM_FILES = 4
#: Rows of all languages that share the number of a positional file.
POSITION_ROWS = 20_000
#: Bytes of one file of a streamed table.
STREAM_FILE_BYTES = 8 << 20
DROPPED_PIECES = ("##a", "##e")

_QUERIES: dict[str, Query] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}
_PATHS: dict[tuple[str, str, str], tuple[str, int]] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries share: written once per session, like the saved vocabulary it stands for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = materialize(build(), name)
    return _TABLES[key]


def counts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the documents."""
    return _stored(
        spark, sf_dir, "counts", lambda: vocab.token_counts(_documents(spark, sf_dir), ordered=False)
    )


def piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-piece vocabulary: characters, continued characters and the most frequent words."""

    def build() -> DataFrame:
        counts = counts_table(spark, sf_dir)
        top = (
            counts.filter(F.length("token") > 1)
            .orderBy(F.desc("frequency"), "token")
            .limit(TOP_WORDS)
            .select(F.lit(3).alias("kind"), F.col("token").alias("piece"))
        )
        chars = counts.select(F.explode(F.split("token", "")).alias("c")).filter(F.col("c") != LEFT_OUT).distinct()
        plain = chars.select(F.lit(1).alias("kind"), F.col("c").alias("piece"))
        inner = chars.select(F.lit(2).alias("kind"), F.concat(F.lit("##"), F.col("c")).alias("piece"))
        unknown = spark.range(1).select(F.lit(0).alias("kind"), F.lit("[UNK]").alias("piece"))
        # Two thousand words and the characters in use: a small table, numbered in one window.
        order = Window.orderBy("kind", "piece")
        every = unknown.union(plain).union(inner).union(top)
        return every.select("piece", (F.row_number().over(order) - 1).cast("int").alias("id"))

    return _stored(spark, sf_dir, "pieces", build)


def weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per piece: the stored vectors, repeated when there are fewer of them."""

    def build() -> DataFrame:
        rows = _embeddings(spark, sf_dir)
        n = rows.count()
        keyed = piece_table(spark, sf_dir).withColumn("vec_id", F.pmod(F.col("id").cast("bigint"), F.lit(n)))
        return keyed.join(rows.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("id", "vec")

    return _stored(spark, sf_dir, "weights", build)


def _rounded(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def _long(df: DataFrame, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """A vector as rows ``(keys, pos, value)``, to compare it number by number."""
    rows = df.select(*keys, F.posexplode(vector_col).alias("pos", "value"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), _rounded(F.col("value").cast("double")).alias("value"))


def _joined_ids(col: str = "ids") -> Column:
    return F.array_join(F.transform(col, lambda i: i.cast("string")), " ")


def _teacher_of(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row with a stored vector: the vectors are repeated when there are fewer of them."""
    stored = _embeddings(spark, sf_dir)
    n = stored.count()
    keyed = rows.withColumn("vec_id", F.pmod(F.col(key), F.lit(n)))
    return keyed.join(stored.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def _embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _teacher_of(spark, sf_dir, _table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    out = scratch_path(spark, "shards")
    shards.write_shards(_embedded_documents(spark, sf_dir), out, 300, model_name="stored-vectors", dataset_name="documents")
    return out


# Sources and sinks


@query
def read_shards_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.read_shards(spark, [_written(spark, sf_dir)], columns=("doc_id", "text", "embedding"))
    return _long(rows.select("doc_id", F.sha2("text", 256).alias("text"), "embedding"), ["doc_id", "text"])


@query
def shard_row_count_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = shards.shard_row_count(spark, [_written(spark, sf_dir)])
    return per_file.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 300).alias("within_limit"))


@query
def training_view_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = shards.training_view(_embedded_documents(spark, sf_dir))
    return _long(view.select(F.sha2("sentence", 256).alias("sentence"), "label"), ["sentence"], "label")


@query
def write_shards_s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "lang", "embedding")
    return _long(shards.read_shards(spark, [_written(spark, sf_dir)], columns=columns), ["doc_id", "lang"])


def _position_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Texts as lines of JSON and vectors as Parquet, written one after the other: files per language, numbered by ranges of doc_id, by doc_id within them."""
    texts, vectors = scratch_path(spark, "texts"), scratch_path(spark, "vectors")

    def ordered(df: DataFrame) -> DataFrame:
        named = df.withColumn("shard", F.coalesce("lang", F.lit("none")))
        return named.repartition("shard", "part").sortWithinPartitions("shard", "part", "doc_id").drop("lang")

    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # The ranges are numbers in the plan: both sides are cut at the same ids.
    documents = ordering.with_range(documents, "doc_id", "part", POSITION_ROWS).withColumn("part", F.format_string("%06d", F.col("part").cast("int")))
    ordered(documents).select("shard", "part", F.to_json(F.struct("text")).alias("value")).write.partitionBy("shard", "part").text(texts)
    stored = _teacher_of(spark, sf_dir, documents.select("doc_id", "lang", "part"))
    ordered(stored).select("shard", "part", "embedding").write.partitionBy("shard", "part").parquet(vectors)
    return texts, vectors


@query
def pair_by_position_s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and vectors that share nothing but file names and line numbers."""
    texts, vectors = _position_files(spark, sf_dir)

    def shard(path: Column) -> Column:
        return F.regexp_extract(path, "(shard=[^/]*/part=[^/]*)/", 1)

    lines = positions.json_rows(spark, [texts], "text string", shard, "*.txt")
    stored = positions.parquet_rows(spark, [vectors], shard)
    paired = positions.pair_files(lines, stored)
    # A language's rows go on from file to file; a row per file.
    language = F.regexp_extract("shard", "shard=([^/]*)/", 1)
    before = Window.partitionBy("language").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = stored.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("language", language)
    offsets = files.select("shard", "language", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = paired.join(broadcast_if_small(offsets, 512), "shard")
    rows = placed.select(F.col("language").alias("shard"), (F.col("row") + F.col("offset")).alias("row"), F.sha2("text", 256).alias("text"), "embedding")
    return _long(rows, ["shard", "row", "text"])


@query
def stream_shards_s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drain(_streamed(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return spark.read.schema("doc_id bigint, text string, lang string").parquet(out).select("doc_id", "text", "lang")


@query
def dataset_model_name_s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = [_written(spark, sf_dir), _written(spark, sf_dir)]
    name = shards.dataset_model_name(spark, outs)
    return shards.shard_row_count(spark, outs).agg(F.lit(name).alias("model_name"), F.sum("n_rows").alias("n_rows"))


@query
def dataset_profile_s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.dataset_profile(_embeddings(spark, sf_dir)).select("n_rows", "min_dim", "max_dim", "n_bytes", "columns")


@query
def dataset_facts_s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a written set from its manifest; the bytes are held against the files themselves."""
    out = _written(spark, sf_dir)
    sizes = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/train").select("_metadata.file_path", "_metadata.file_size").distinct()
    on_disk = sizes.agg(F.sum("file_size").alias("on_disk"))
    facts = shards.dataset_facts(spark, [out]).join(on_disk, F.lit(True))  # one row each
    return facts.select("model_name", "dataset_name", "n_rows", "dim", "columns", (F.col("n_bytes") == F.col("on_disk")).alias("bytes_agree"))


@query
def write_vocabulary_s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    shards.write_vocabulary(vocab.vocabulary_table(_documents(spark, sf_dir)), path)
    return shards.read_vocabulary(spark, path)


# Corpus shaping


@query
def text_field_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.text_field(_table(spark, sf_dir, "conversations"), "text")


@query
def join_array_text_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    joined = corpus.join_array_text(lines, "lines")
    return joined.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), "text")


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    pairs = turns.withColumnRenamed("text", "premise").join(following, ["conv_id", "turn"])
    return pairs.withColumn("place", F.struct("conv_id", "turn"))


@query
def unpivot_first_seen_p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.unpivot_first_seen(_turn_pairs(spark, sf_dir), ["premise", "hypothesis"], "place")
    return rows.select("place.conv_id", "place.turn", F.col("pos").cast("bigint").alias("pos"), "text")


@query
def unpivot_text_p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.unpivot_text(_turn_pairs(spark, sf_dir), ["premise", "hypothesis"], "place")
    return rows.select("place.conv_id", "place.turn", F.col("pos").cast("bigint").alias("pos"), "text")


@query
def union_subsets_p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ["documents", "benchmark", "conversations"]
    return corpus.union_subsets([corpus.text_field(_table(spark, sf_dir, t), "text") for t in tables])


@query
def rename_and_prune_p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rename_and_prune(_table(spark, sf_dir, "pages"), {"html": "text"})


@query
def source_catalog_p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog()
    for name, column in [("documents", "text"), ("benchmark", "text"), ("conversations", "text"), ("pages", "url")]:
        catalog.register(name, lambda s, name=name, column=column: corpus.text_field(_table(s, sf_dir, name), column))
    rows = catalog.load(spark, ["documents", "benchmark", "conversations", "pages"])
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query
def limit_batches_p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.limit_batches(_documents(spark, sf_dir), 3, BATCH, "doc_id")


@query
def assign_batches_p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.assign_batches(_table(spark, sf_dir, "events").select("event_id"), BATCH, "event_id")


@query
def shuffle_rows_p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shuffle_rows(_documents(spark, sf_dir), "doc_id")


@query
def origin_names_p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", names.short_name(url).alias("short_name"), names.path_safe_name(url).alias("path_name")
    )


# Text functions


@query
def clean_cut_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.clean_cut(F.col("text")).alias("text"))


@query
def bert_normalize_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.bert_normalize(F.col("text")).alias("text"))


@query
def pretokenize_t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _documents(spark, sf_dir).select("doc_id", F.posexplode(text.pretokenize(F.col("text"))).alias("pos", "token"))
    return tokens.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


@query
def wordpiece_t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = counts_table(spark, sf_dir).select(F.col("token").alias("word"))
    return pieces.split_distinct(words, piece_table(spark, sf_dir)).select("word", _joined_ids().alias("ids"))


@query
def truncate_words_t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = text.truncate_words(text.clean_cut(F.col("text")), MAX_IDS)
    return _documents(spark, sf_dir).select("doc_id", cut.alias("text"))


@query
def truncate_pieces_t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.truncate_pieces(_documents(spark, sf_dir), piece_table(spark, sf_dir), CUT_PIECES, 2)


@query
def encode_ids_t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_ids(_documents(spark, sf_dir), piece_table(spark, sf_dir), MAX_IDS)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n"), _joined_ids().alias("ids"))


@query
def lowercase_vocab_t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    cased = _documents(spark, sf_dir).select(words.alias("piece"), "doc_id").groupBy("piece").agg(F.min("doc_id").alias("id"))
    return vocab.lowercase_vocab(cased)


# Vocabulary


@query
def token_counts_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.token_counts(_documents(spark, sf_dir))


@query
def document_frequency_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.document_frequency(_documents(spark, sf_dir))


def _merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [spread(_table(spark, sf_dir, t).select("text")) for t in ("benchmark", "conversations")]
    others = [vocab.token_counts(t, ordered=False) for t in tables]
    return vocab.merge_vocabularies([counts_table(spark, sf_dir), *others])


@query
def merge_vocabularies_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_counts(spark, sf_dir)


@query
def piece_usage_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.piece_usage(_merged_counts(spark, sf_dir), piece_table(spark, sf_dir))


@query
def prune_vocab_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = piece_table(spark, sf_dir)
    return vocab.prune_vocab(known, vocab.piece_usage(counts_table(spark, sf_dir), known), MIN_USAGE)


@query
def add_top_tokens_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.add_top_tokens(piece_table(spark, sf_dir), _merged_counts(spark, sf_dir), NEW_SIZE)


@query
def expand_vocab_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = materialize(_merged_counts(spark, sf_dir), "merged")
    return vocab.expand_vocab(piece_table(spark, sf_dir), merged, MIN_USAGE, NEW_SIZE)


# Embeddings


def _vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = piece_table(spark, sf_dir)
    # Stored: the new vocabulary is read several times.
    new = _stored(spark, sf_dir, "new-pieces", lambda: vocab.add_top_tokens(old, counts_table(spark, sf_dir), NEW_SIZE))
    return new, old.filter(~F.col("piece").isin(*DROPPED_PIECES))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.align_vocab(*_vocabularies(spark, sf_dir))


@query
def align_vocab_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("piece", "id", _joined_ids().alias("ids"), "match_kind")


@query
def init_weights_e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(embed.init_weights(_aligned(spark, sf_dir), weight_table(spark, sf_dir)), ["id"], "vec")


def _letter_teacher() -> embed.EmbedFn:
    """A stand-in teacher whose vectors SQL can repeat: text length and letter counts."""
    return lambda texts: np.array([[len(t), t.count("a"), t.count("e"), t.count(" ")] for t in texts], dtype=np.float32)


@query
def embed_corpus_e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    out = embed.embed_corpus(rows, _letter_teacher, 4, piece_table(spark, sf_dir), BATCH, CUT_PIECES)
    parts = [F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(4)]
    return out.select("doc_id", "lang", "text", *parts)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.static_encode(_documents(spark, sf_dir), piece_table(spark, sf_dir), weight_table(spark, sf_dir), one_worker=True).drop("text")


@query
def static_encode_e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_encoded(spark, sf_dir), ["doc_id"])


@query
def exported_encode_e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished model: mean over the whole text, then length 1; over the short conversation turns."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("key"))
    rows = embed.static_encode(
        turns, piece_table(spark, sf_dir), weight_table(spark, sf_dir), id_col="key", normalize=True, one_worker=True
    )
    return _long(rows, ["conv_id", "turn"])


@query
def l2_normalize_e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = vectors.slice_dims(F.col("embedding"), 16)
    return _long(_embeddings(spark, sf_dir).select("vec_id", vectors.l2_normalize(short).alias("embedding")), ["vec_id"])


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = Summarizer.mean(array_to_vector("embedding"))
    rows = _embeddings(spark, sf_dir).groupBy("label").agg(vector_to_array(mean).alias("embedding"))
    return rows.select(F.col("label").cast("bigint").alias("query_id"), "embedding")


def _as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")


def _as_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")


@query
def cosine_scores_e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the centre of its own label and of the next one."""
    label = F.col("label").cast("bigint")
    both = F.explode(F.array(label, F.pmod(label + 1, F.lit(10))))
    pairs = _embeddings(spark, sf_dir).select(both.alias("query_id"), F.col("vec_id").alias("doc_id"))
    return search.pair_scores(pairs, _centroids(spark, sf_dir), _as_documents(spark, sf_dir))


@query
def similar_scores_e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a label's centre and a vector that reaches a cosine."""
    return search.cosine_scores(_centroids(spark, sf_dir), _as_documents(spark, sf_dir), MIN_SCORE)


@query
def nearest_k_e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.nearest_k(_as_queries(spark, sf_dir), _as_documents(spark, sf_dir), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def cells_search_e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours from an index that skips documents."""
    index = cells.build_cells(_as_documents(spark, sf_dir), 16)
    found, _ = cells.nearest_in_cells(_as_queries(spark, sf_dir), index, 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def route_encode_e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.concat_ws("-", "conv_id", "turn").alias("key")
    )

    def student(rows: DataFrame) -> DataFrame:
        return embed.static_encode(rows, piece_table(spark, sf_dir), weight_table(spark, sf_dir), id_col="key", one_worker=True)

    def teacher(rows: DataFrame) -> DataFrame:
        return _teacher_of(spark, sf_dir, rows, "conv_id")

    return _long(embed.route_encode(turns, "role", "user", student, teacher), ["conv_id", "turn", "role"])


@query
def check_dims_e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    student = _encoded(spark, sf_dir)
    dim = embed.check_dims(student, _embeddings(spark, sf_dir))
    return student.agg(F.lit(dim).cast("bigint").alias("dim"), F.count("*").alias("n_rows"))


@query
def slice_dims_e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select("vec_id", vectors.slice_dims(F.col("embedding"), 16).alias("embedding"))
    return _long(rows, ["vec_id"])


# Distillation


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    student = _encoded(spark, sf_dir).withColumnRenamed("embedding", "student")
    return _teacher_of(spark, sf_dir, student).withColumnRenamed("embedding", "teacher")


@query
def cosine_loss_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.cosine_loss(_pairs(spark, sf_dir)).select(_rounded("loss").alias("loss"))


def _batched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbering reads its rows several times: the vectors are stored, or every text would be encoded for each of them.
    return corpus.assign_batches(materialize(_pairs(spark, sf_dir), "pairs"), BATCH, "doc_id")


def _prefixes(spark: SparkSession, sf_dir: str) -> list[int]:
    """The prefix lengths of a student's vector, which is as long as the table's: no text is encoded to find out."""
    return distill.matryoshka_dims(embed.vector_length(weight_table(spark, sf_dir), "vec"))


@query
def contrastive_loss_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = distill.contrastive_loss(_batched_pairs(spark, sf_dir), batch_rows=BATCH)
    return losses.select("batch_id", _rounded("loss").alias("loss"))


@query
def matryoshka_loss_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = distill.matryoshka_loss(_pairs(spark, sf_dir), dims=_prefixes(spark, sf_dir))
    return losses.select(F.col("dim").cast("bigint").alias("dim"), _rounded("loss").alias("loss"))


@query
def matryoshka_contrastive_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = distill.matryoshka_loss(_batched_pairs(spark, sf_dir), "distillation_cosine", _prefixes(spark, sf_dir), batch_rows=BATCH)
    return losses.select(F.col("dim").cast("bigint").alias("dim"), _rounded("loss").alias("loss"))


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_ids(_documents(spark, sf_dir), piece_table(spark, sf_dir)).drop("text")
    return _teacher_of(spark, sf_dir, encoded).withColumnRenamed("embedding", "teacher")


@query
def gradient_step_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_rows = _table(spark, sf_dir, "documents").count()
    moved = distill.gradient_step(_training_rows(spark, sf_dir), weight_table(spark, sf_dir), STEP_RATE, n_rows)
    return _long(moved, ["id"], "vec")


@query
def fit_weights_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole-data steps at a constant rate over all documents."""
    tokens = pieces.encode_ids(_documents(spark, sf_dir), piece_table(spark, sf_dir)).drop("text")
    teacher = _teacher_of(spark, sf_dir, _table(spark, sf_dir, "documents").select("doc_id"))
    settings = distill.FitSettings(steps=2, lr=STEP_RATE, warmup=0.0, floor=1.0, matryoshka=False)
    fitted = distill.fit_weights(tokens, teacher, weight_table(spark, sf_dir), settings)
    return _long(fitted, ["id"], "vec")


def _resumed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The run of ``fit_weights_d4``, broken off after its first step and taken up again."""
    folder = scratch_path(spark, "fit")
    tokens = materialize(pieces.encode_ids(_documents(spark, sf_dir), piece_table(spark, sf_dir)).drop("text"), "fit-tokens")
    teacher = _teacher_of(spark, sf_dir, _table(spark, sf_dir, "documents").select("doc_id"))
    settings = distill.FitSettings(steps=2, lr=STEP_RATE, warmup=0.0, floor=1.0, matryoshka=False)

    def agreement(table: DataFrame) -> dict[str, float]:
        pooled = embed.pool_ids(distill.fit_rows(spark, folder), table)
        return {"mean_cosine": pooled.agg(F.avg(vectors.cosine(F.col("embedding"), F.col("teacher"))).alias("c")).first()["c"]}

    for stop in (1, None):
        fitted = distill.fit_weights(tokens, teacher, weight_table(spark, sf_dir), settings, folder=folder, measure=agreement, stop_after=stop)
    return fitted, folder


@query
def fit_resumed_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_resumed(spark, sf_dir)[0], ["id"], "vec")


@query
def fit_history_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per step: its rate, the loss before it, the agreement with the teacher after it."""
    steps = distill.fit_history(spark, _resumed(spark, sf_dir)[1])
    return steps.select(F.col("step").cast("bigint").alias("step"), "rate", _rounded("loss").alias("loss"), _rounded(F.col("measures")["mean_cosine"]).alias("mean_cosine"))


# Evaluation


@query
def sts_correlation_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"), F.col("label").alias("next_label"))
    score = F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6)
    gold = (F.col("label") == F.col("next_label")).cast("double")
    pairs = rows.join(following, "vec_id").select(score.alias("score"), gold.alias("gold"))
    return evaluate.sts_correlation(pairs).select(_rounded("pearson").alias("pearson"), _rounded("spearman").alias("spearman"))


def _half(label: Column) -> Column:
    return F.when(label < 5, "low").otherwise("high").alias("dataset")


@query
def ndcg_at_k_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest_k(_centroids(spark, sf_dir), _as_documents(spark, sf_dir), 10)
    hits = hits.withColumn("dataset", _half(F.col("query_id")))
    label = F.col("label").cast("bigint")
    qrels = _embeddings(spark, sf_dir).select(
        _half(label), label.alias("query_id"), F.col("vec_id").alias("doc_id"), (F.pmod("vec_id", F.lit(3)) + 1).alias("rel")
    )
    scores = evaluate.ndcg_at_k(hits, qrels)
    return scores.select("dataset", _rounded("ndcg").alias("ndcg"), "n_queries")


def _model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = _centroids(spark, sf_dir).select(F.col("query_id").alias("dataset"), F.col("embedding").alias("centre"))
    rows = _embeddings(spark, sf_dir).select(F.col("label").cast("bigint").alias("dataset"), "embedding")
    both = rows.join(centre, "dataset")
    full = vectors.cosine(F.col("embedding"), F.col("centre"))
    short = vectors.cosine(vectors.slice_dims(F.col("embedding"), 16), vectors.slice_dims(F.col("centre"), 16))
    models = F.array(
        F.struct(F.lit("teacher").alias("model"), full.alias("score")),
        F.struct(F.lit("student").alias("model"), short.alias("score")),
    )
    return both.select("dataset", models.alias("models")).select("dataset", F.inline("models"))


@query
def compare_models_m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evaluate.compare_models(_model_scores(spark, sf_dir))
    return wide.select("dataset", *[_rounded(c).alias(c) for c in ("teacher", "student", "gap")])


@query
def mean_agreement_m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    teacher = _teacher_of(spark, sf_dir, _table(spark, sf_dir, "documents").select("doc_id"))
    found = evaluate.mean_agreement(_encoded(spark, sf_dir), teacher)
    return found.select(_rounded("mean_cosine").alias("mean_cosine"), "n")


@query
def list_overlap_m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    def short(df: DataFrame) -> DataFrame:
        return df.withColumn("embedding", vectors.slice_dims(F.col("embedding"), 16))

    queries, documents = _as_queries(spark, sf_dir), _as_documents(spark, sf_dir)
    return evaluate.teacher_agreement(short(queries), short(documents), queries, documents, 10)


# Streaming


def _stream_files(rows: DataFrame) -> int:
    """Files per micro-batch: one for every STREAM_FILE_BYTES of the batch's share of a stored table."""
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    n_bytes = files.agg(F.sum("file_size")).first()[0] or 0
    return max(1, -(-n_bytes // (STREAM_FILES * STREAM_FILE_BYTES)))


def _streamed(spark: SparkSession, sf_dir: str, name: str, one_file: bool = False) -> DataFrame:
    """A table as a stream in STREAM_FILES micro-batches, each of so many files that all cores read it; or of one file each."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}-files-{one_file}")
    table = _table(spark, sf_dir, name)
    if key not in _PATHS:
        per_batch = 1 if one_file else _stream_files(table)
        path = scratch_path(spark, f"{name}-files")
        table.repartition(STREAM_FILES * per_batch).write.parquet(path)
        _PATHS[key] = path, per_batch
    path, per_batch = _PATHS[key]
    return streams.stream_shards(spark, path, table.schema, max_files=per_batch)


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "documents").select("doc_id", "text")


@query
def stream_token_counts_x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained_token_counts(_document_stream(spark, sf_dir))


@query
def stream_encode_x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "encoded")
    known, weights = piece_table(spark, sf_dir), weight_table(spark, sf_dir)
    streams.stream_encode(_document_stream(spark, sf_dir), known, weights, out, one_worker=True).awaitTermination()
    rows = spark.read.schema("doc_id bigint, embedding array<double>").parquet(out)
    return _long(rows, ["doc_id"])


@query
def stream_write_shards_x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream-shards")
    stream = _streamed(spark, sf_dir, "embeddings")
    streams.stream_write_shards(stream, out, 300, model_name="stored-vectors", dataset_name="embeddings").awaitTermination()
    return _long(shards.read_shards(spark, [out], columns=("vec_id", "embedding")), ["vec_id"])


@query
def stream_first_seen_x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drain(streams.stream_first_seen(_document_stream(spark, sf_dir).select("text")))
    return spark.read.schema("text string").parquet(out).select("text")


@query
def stream_first_seen_within_x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of a type, with a state that forgets; the time span covers the table, so none comes twice."""
    events = _streamed(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.concat_ws("-", "user_id", "event_type").alias("key"))
    out = streams.drain(streams.stream_first_seen(events, "key", within="3650 days", time_col="ts").drop("key", "ts"))
    return spark.read.schema("user_id bigint, event_type string").parquet(out).select("user_id", "event_type")


@query
def stream_shuffle_p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a shuffle buffer of a tenth of the table: every row once, in an order that mixes micro-batches."""
    # A file stands for its micro-batch.
    files = _streamed(spark, sf_dir, "documents", one_file=True).select("doc_id", "text", F.col("_metadata.file_path").alias("file"))
    room = max(1, _table(spark, sf_dir, "documents").count() // 10)
    out = streams.stream_buffer_shuffled(files, scratch_path(spark, "buffered"), "doc_id", room)
    rows = spark.read.schema("doc_id bigint, text string, file string, batch_id string").parquet(out)
    mixed = rows.groupBy("batch_id").agg(F.count_distinct("file").alias("files")).agg((F.max("files") > 1).alias("mixed"))
    return rows.select("doc_id", "text").join(mixed, F.lit(True))  # one row


# The whole chain


@query
def nearest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to each distinct text of the users' turns, both by static embedding."""
    known, weights = piece_table(spark, sf_dir), weight_table(spark, sf_dir)
    turns = _table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    asked = materialize(turns.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("first")).withColumn("query_id", F.monotonically_increasing_id()), "asked")
    # Both are read several times: stored vectors are also dealt to a few large tasks, which look up less and hand on fewer candidates.
    queries = materialize(embed.static_encode(asked, known, weights, id_col="query_id", one_worker=True).select("query_id", "embedding"), "queries")
    found = search.nearest_k(queries, materialize(_encoded(spark, sf_dir), "documents"), 10, stored=True)
    named = found.join(asked.select("query_id", "first.conv_id", "first.turn"), "query_id")
    return named.select("conv_id", "turn", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The users' turns by the student (the finished model), the documents by the teacher's stored vectors."""
    # A turn's number within its conversation is below the factor, which is taken from the table itself.
    conversations = _table(spark, sf_dir, "conversations")
    factor = conversations.agg(F.max("turn")).first()[0] + 1
    turns = conversations.select((F.col("conv_id") * factor + F.col("turn")).alias("key"), "role", "text", "conv_id", "turn")
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit("document").alias("role"), "text")
    rows = turns.filter(F.col("role") == "user").unionByName(documents, allowMissingColumns=True)

    def student(part: DataFrame) -> DataFrame:
        return embed.static_encode(part, piece_table(spark, sf_dir), weight_table(spark, sf_dir), id_col="key", normalize=True, one_worker=True)

    encoded = embed.route_encode(rows, "role", "user", student, lambda part: _teacher_of(spark, sf_dir, part, "key"))
    queries = encoded.filter(F.col("role") == "user").withColumnRenamed("key", "query_id")
    return queries, encoded.filter(F.col("role") == "document").select(F.col("key").alias("doc_id"), "embedding")


def _routed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, documents = _routed(spark, sf_dir)
    names = queries.select("query_id", "conv_id", "turn")
    return search.nearest_k(queries.select("query_id", "embedding"), documents, 10).join(names, "query_id")


@query
def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search as the finished model does it: student queries over documents that the teacher embedded."""
    hits = _routed_hits(spark, sf_dir)
    return hits.select("conv_id", "turn", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def routed_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG of that search; a document that shares its stored vector with the conversation is relevant."""
    hits = _routed_hits(spark, sf_dir).withColumn("dataset", F.concat(F.lit("turn "), F.least("turn", F.lit(3)).cast("string")))
    n = _embeddings(spark, sf_dir).count()
    vec = F.pmod(F.col("doc_id"), F.lit(n)).alias("vec_id")
    documents = _table(spark, sf_dir, "documents").select("doc_id", vec)
    asked = hits.select("dataset", "query_id", F.pmod("conv_id", F.lit(n)).alias("vec_id")).distinct()
    qrels = asked.join(documents, "vec_id").select("dataset", "query_id", "doc_id", F.lit(1).alias("rel"))
    scores = evaluate.ndcg_at_k(hits, qrels)
    return scores.select("dataset", _rounded("ndcg").alias("ndcg"), "n_queries")


@query
def init_from_teacher_e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed.init_from_teacher(piece_table(spark, sf_dir), _letter_teacher, 4)
    return _long(found, ["id"], "vec")


@query
def align_special_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with special tokens around each encoding."""
    new, old = _vocabularies(spark, sf_dir)
    found = embed.align_vocab(new, old, special_ids=(0,), special_ends=(0, 1))
    return found.select("piece", "id", _joined_ids().alias("ids"), "match_kind")


@query
def embed_sources_e3_s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources embedded and written as data sets, then read back."""
    catalog = Catalog()
    for name in ("benchmark", "conversations"):
        catalog.register(name, lambda s, name=name: corpus.text_field(_table(s, sf_dir, name), "text"))
    folders = embed_run.embed_sources(
        spark, catalog, ["benchmark", "conversations"], _letter_teacher, 4, piece_table(spark, sf_dir), scratch_path(spark, "embedded"), "letter/teacher", 300
    )
    parts = [F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(4)]
    found = [shards.read_shards(spark, [folder]).select(F.lit(name).alias("source"), "text", *parts) for name, folder in folders.items()]
    return corpus.union_subsets(found)
