"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled sample accepts exactly the strings
that occur there. A text is parsed greedily into the longest strings a language's
automaton accepts; phrases times the bits of a pointer into the sample, per
symbol, estimate the cross entropy, and the language with the least wins. All
languages and thousands of text segments step through one transition table
together, so that a step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import flat_bytes, slices

#: Each language learns from at most so many whole texts, of at most so many bytes each and together.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, SAMPLE_BYTES = 64, 1 << 14, 48 << 10
#: Where all its texts are longer, from so many characters of each, from the first letter on.
PIECE_CHARS = SAMPLE_DOC_BYTES // 4
#: Greedy parsing starts anew after so many symbols, so that long texts are parsed in parallel.
SEGMENT = 1024
UNDETERMINED = "und"


def fold() -> np.ndarray:
    """Bytes of lower-cased text to symbols: letters and bytes beyond ASCII stay, all else is one gap symbol."""
    table = np.full(256, 0x20, dtype=np.uint8)
    letters = np.r_[ord("a") : ord("z") + 1, 128:256]
    table[letters] = letters
    return table


FOLD = fold()


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts one after the other, runs of gaps as one, and the n + 1 offsets."""
    data, offsets = flat_bytes(pc.utf8_lower(column))
    folded = FOLD[data]
    keep = folded != 0x20
    if len(keep):
        keep[1:] |= keep[:-1].copy()
        keep[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    return folded[keep], at[offsets]


def suffix_automaton(texts: list[bytes]) -> np.ndarray:
    """Transitions (state, symbol, next) of the automaton of all substrings of the texts; the root is 0."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for text in texts:
        last = 0
        for c in text:
            known = edges[last].get(c)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                    continue
                twin = len(edges)
                edges.append(dict(edges[known]))
                link.append(link[known])
                length.append(length[last] + 1)
                link[known] = twin
                p = last
                while p >= 0 and edges[p].get(c) == known:
                    edges[p][c] = twin
                    p = link[p]
                last = twin
                continue
            new = len(edges)
            edges.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = twin
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
            last = new
    return np.asarray([(s, c, t) for s, e in enumerate(edges) for c, t in e.items()], dtype=np.int32).reshape(-1, 3)


class Parser:
    """Counts the phrases of texts against every language at once."""

    def __init__(self, languages: list[str], edges: list[np.ndarray], sizes: list[int]):
        self.languages = languages
        self.pointer_bits = np.log2(np.maximum(np.asarray(sizes, dtype=np.float64), 2))
        seen = np.unique(np.concatenate([e[:, 1] for e in edges]))
        self.code = np.zeros(256, dtype=np.uint8)  # 0: a symbol that no language knows
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        states = [int(e[:, [0, 2]].max()) + 1 for e in edges]
        base = 1 + np.cumsum([0, *states[:-1]])  # row 0 is where no phrase goes on
        table = np.zeros((1 + sum(states), self.width), dtype=np.int32)
        for b, e in zip(base, edges, strict=True):
            table[b + e[:, 0], self.code[e[:, 1]]] = b + e[:, 2]
        self.table, self.roots = table.ravel(), base.astype(np.int32)
        first = table[base]
        self.first = np.where(first == 0, self.roots[:, None], first)

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (columns) in each language (rows)."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[owner] + number * SEGMENT
        size = np.minimum(SEGMENT, offsets[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        codes = np.append(self.code[symbols], np.zeros(SEGMENT, dtype=np.uint8))
        count = np.ones((len(self.languages), len(size)), dtype=np.int32)
        state = np.repeat(self.roots[:, None], len(size), axis=1)
        for step in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size, -step, side="left"))
            c = codes[begin[:active] + step]
            goes = self.table[state[:, :active].astype(np.int64) * self.width + c]
            ended = goes == 0
            count[:, :active] += ended
            np.copyto(goes, self.first[:, c], where=ended)
            state[:, :active] = goes
        out = np.zeros((len(self.languages), len(sizes)), dtype=np.float64)
        for k in range(len(self.languages)):
            out[k] = np.bincount(owner, weights=count[k], minlength=len(sizes))
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of least cross entropy for each text, and how clearly it won (0 to 1)."""
        best, score = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        for a, b in slices(column, 8 << 20):
            symbols, offsets = symbols_of(column.slice(a, b - a))
            bits = self.phrases(symbols, offsets) * self.pointer_bits[:, None]
            best[a:b] = bits.argmin(axis=0)
            gap = (bits - bits.min(axis=0)) / np.maximum(np.diff(offsets), 1)  # bits per symbol
            score[a:b] = 1 / np.exp2(-np.minimum(gap * 8, 60)).sum(axis=0)
        return [self.languages[k] for k in best], score


def learn(docs: DataFrame, usable: Column) -> list[tuple[str, int, bytes]]:
    """(language, symbols, packed transitions) from a bounded sample of rows for which ``usable`` holds.

    Of each language the first SAMPLE_DOCS rows by a hash of the id are eligible, and
    whole texts are taken in that order up to SAMPLE_BYTES; where none has
    SAMPLE_DOC_BYTES or less, a piece of each.
    """
    too_long = (F.octet_length("text") > SAMPLE_DOC_BYTES).alias("too_long")
    eligible = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "doc_id", too_long, F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    )
    # A rank limit is applied within each task before the shuffle, so that a common language sends few rows.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("too_long", "h", "doc_id"))
    chosen = eligible.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("lang", "doc_id", "too_long", "rank")
    found = docs.select("lang", "doc_id", too_long, "text").join(F.broadcast(chosen), ["lang", "doc_id", "too_long"])
    piece = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{PIECE_CHARS - 1}}}", 0)
    texts = found.select("lang", "rank", "too_long", F.when(F.col("too_long"), piece).otherwise(F.col("text")).alias("text"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["too_long"] == pdf["too_long"].min()].sort_values(["rank", "text"]).drop_duplicates("rank")
        symbols, offsets = symbols_of(pa.array(pdf["text"].tolist(), pa.string()))
        taken = max(1, int(np.searchsorted(offsets[1:], SAMPLE_BYTES, side="right")))
        parts = [symbols[offsets[i] : offsets[i + 1]].tobytes() for i in range(taken)]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [int(offsets[taken])], "edges": [suffix_automaton(parts).tobytes()]})

    rows = texts.groupBy("lang").applyInPandas(build, "lang string, n long, edges binary").collect()  # SAMPLE_BYTES bounds each
    return sorted((r["lang"], r["n"], bytes(r["edges"])) for r in rows)


def predict_language(docs: DataFrame, usable: Column) -> DataFrame:
    """Every input row with lang_pred and score, from its whole text alone.

    ``usable`` (over the input's columns) says which rows may be learned from; of
    those only rows with a lang count. A text that is null or has no letter gets
    ``und`` and score 0, and so does every text if nothing could be learned. Equal
    texts get equal answers; ties go to the first language in order. Columns of
    these names are replaced, all others pass through.
    """
    spark = docs.sparkSession
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    model = learn(docs, usable)
    if not model:
        return docs.select(*rest, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # bounded by languages times SAMPLE_BYTES
    state: dict = {}
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(column: pa.Array) -> pa.Array:
        if "parser" not in state:
            parts = shared.value
            state["parser"] = Parser(
                [x[0] for x in parts], [np.frombuffer(x[2], dtype=np.int32).reshape(-1, 3) for x in parts], [x[1] for x in parts]
            )
        lang, score = state["parser"].predict(column)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], fields=list(kind))

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select(*rest, has_letter.alias("__letter"), predicted.asNondeterministic()(F.col("text")).alias("__found"))
    return found.select(
        *rest,
        F.when(F.col("__letter"), F.col("__found.lang")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(F.col("__letter"), F.col("__found.score")).otherwise(F.lit(0.0)).alias("score"),
    )

