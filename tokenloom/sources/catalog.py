"""Named text sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.corpus import (
    join_array_text,
    rename_and_prune,
    text_field,
    union_subsets,
    unpivot_first_seen,
    unpivot_text,
)

Builder = Callable[[SparkSession], DataFrame]

# The source names users ask for, and the column or columns their text is in.
SINGLE_FIELD = {
    "gooaq": "question",
    "miracl": "anchor",
    "squad": "question",
    "mldr": "anchor",
    "msmarco": "text",
    "msmarco_docs": "text",
    "swim-ir-monolingual": "query",
    "mr-tydi": "anchor",
}
# Subsets that make up one source.
LOTTE_SUBSETS = [
    "lifestyle_forum-queries",
    "lifestyle_search-queries",
    "recreation_forum-queries",
    "recreation_search-queries",
    "science_forum-queries",
    "science_search-queries",
    "technology_forum-queries",
    "technology_search-queries",
    "writing_forum-queries",
    "writing_search-queries",
]
PUBMED_SUBSETS = ["pqa_artificial", "pqa_unlabeled"]


class Catalog:
    """Source builders by name. Builders run only when asked for, and only if every name is known."""

    def __init__(self) -> None:
        self._builders: dict[str, Builder] = {}

    def register(self, name: str, builder: Builder) -> None:
        self._builders[name] = builder

    def names(self) -> list[str]:
        return list(self._builders)

    def validate(self, names: Iterable[str]) -> list[str]:
        """The names as a list; all unknown ones are reported together."""
        names = list(names)
        unknown = [n for n in names if n not in self._builders]
        if unknown:
            raise KeyError(f"unknown sources: {unknown}; available: {sorted(self._builders)}")
        return names

    def get(self, name: str) -> Builder:
        self.validate([name])
        return self._builders[name]

    def load(self, spark: SparkSession, names: Iterable[str]) -> DataFrame:
        """The texts of several sources with their ``source``; write it with ``partitionBy("source")``."""
        chosen = self.validate(names)
        if not chosen:
            raise ValueError("no sources given")
        parts = [self._builders[n](spark).select("text", F.lit(n).alias("source")) for n in chosen]
        return reduce(lambda a, b: a.unionByName(b), parts)


def standard_catalog(root: str, order_col: str = "row_id") -> Catalog:
    """The 15 standard sources over local copies: ``root/<name>`` or ``root/<name>/<subset>`` as Parquet.

    Where the order of texts matters the rows carry ``order_col``.
    """
    catalog = Catalog()

    def table(name: str) -> Builder:
        return lambda spark: spark.read.parquet(f"{root}/{name}")

    def shaped(name: str, shape: Callable[[DataFrame], DataFrame]) -> None:
        catalog.register(name, lambda spark: shape(table(name)(spark)))

    shaped("english-words-definitions", lambda df: join_array_text(df, "definitions"))
    catalog.register("fineweb", table("fineweb"))
    for name, column in SINGLE_FIELD.items():
        shaped(name, lambda df, column=column: text_field(df, column))
    catalog.register("lotte", lambda spark: union_subsets([table(f"lotte/{s}")(spark) for s in LOTTE_SUBSETS]))
    shaped("snli", lambda df: unpivot_first_seen(df, ["premise", "hypothesis"], order_col))
    shaped("paws", lambda df: unpivot_text(df, ["sentence1", "sentence2"], order_col))
    catalog.register(
        "PubMedQA",
        lambda spark: union_subsets(
            [rename_and_prune(table(f"PubMedQA/{s}")(spark), {"question": "text"}) for s in PUBMED_SUBSETS]
        ),
    )
    shaped("trivia_qa", lambda df: rename_and_prune(df, {"question": "text"}))
    return catalog
