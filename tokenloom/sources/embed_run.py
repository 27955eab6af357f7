"""Embed chosen sources with a teacher and write each as a data set of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.embed import EmbedFn, embed_corpus
from tokenloom.sources.catalog import Catalog
from tokenloom.sources.shards import ROWS_PER_SHARD, write_shards


def embed_sources(
    spark: SparkSession,
    catalog: Catalog,
    names: Iterable[str],
    make_teacher: Callable[[], EmbedFn],
    dim: int,
    vocab: DataFrame,
    out: str,
    model_name: str,
    rows_per_shard: int = ROWS_PER_SHARD,
    **options,
) -> dict[str, str]:
    """E3 then S4 for each source: the folders ``out/<model>/<source>`` by source name.

    All names are checked before the first source is read. ``options`` go to ``embed_corpus``.
    """
    model_folder = model_name.replace("/", "__")
    folders = {}
    for name in catalog.validate(names):
        rows = catalog.get(name)(spark).select("text")
        # The order key of rows without one: it only matters to a limit on batches.
        keyed = rows.withColumn("row_id", F.monotonically_increasing_id())
        embedded = embed_corpus(keyed, make_teacher, dim, vocab, order_col="row_id", **options).drop("row_id")
        folders[name] = f"{out}/{model_folder}/{name}"
        write_shards(embedded, folders[name], rows_per_shard, model_name=model_name, dataset_name=name)
    return folders
