"""How the tokens of two tokenizers cover each other, and how often each pair of ids does so in the whole corpus.

Two encodings of one text cut the same bytes. Wherever a token of either ends, a
segment ends; each segment lies in one token of A and one of B, so segments are
the links, and ends that both have in common cut the groups. Both follow from
sorted arrays of byte ends, for thousands of texts at once.

Corpus counts use no row per link. The distinct id pairs are put into a minimal
perfect hash (levels of bit arrays, after which every pair has a number of its own
below the number of pairs; the pairs themselves, in that order, verify each
lookup). Every task counts into one dense vector indexed by it; the vectors are
summed part by part, first by salt, then finally. A second pass aligns the stored
tokens again and looks the counts up. Pairs past the size of one table are taken
in blocks by hash, each with a hash and a vector of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import flat_bytes, inputs, pack, slices, unpack
from tokenloom.llm.tokens import mix64
from tokenloom.session import scratch_path

BYTE_TOKENIZER, PIECE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct pairs in one table: 24 bytes each in every Python worker.
BLOCK_PAIRS = 4_000_000
#: Pairs whose levels of bits are made in one task.
SHARD_PAIRS = 1 << 18
#: Bits per pair of a level; pairs that meet another go to the next one.
ROOM = 2
#: Numbers in one part of a count vector, and the salts it is summed in first.
PART, SALTS = 1 << 13, 32
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: Distinct pairs a task gathers before it hands them on.
GATHERED = 1 << 20
#: Fixed pattern by which a byte-level vocabulary splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- the two tokenizers -------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """A byte-level vocabulary (the text of its file): ids of space + text, bytes of an id."""

    def __init__(self, content: str):
        model = json.loads(content)
        letters = byte_letters()
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.content, self.bytes_of = content, [b""] * (max(model["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        # Where ids follow the order of the merges, the rank encoder gives the same tokens, several times faster.
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        ids = [model["model"]["vocab"][m] for m in merged]
        self.fast = None
        if ids == list(range(256, 256 + len(ids))) and model["pre_tokenizer"].get("type") == "ByteLevel":
            import tiktoken

            self.fast = tiktoken.Encoding("byte", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def whole(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.slow = Tokenizer.from_str(self.content)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self.fast is None:
            return self.whole(" " + text)
        try:
            return self.fast.encode_ordinary(" " + text)
        except BaseException as error:  # the splitter's stack ends on runs of a million spaces; it says so by a panic
            if isinstance(error, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self.whole(" " + text)


class PieceTokenizer:
    """A vocabulary of pieces (the bytes of its file), which puts the space before the text itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, read where only the driver needs to see it, or through Spark where it is in a store."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


_MADE: dict[str, tuple[ByteTokenizer, PieceTokenizer]] = {}


def tokenizer_pair(files: Broadcast, key: str) -> tuple[ByteTokenizer, PieceTokenizer]:
    """The two tokenizers of these files, made once per Python worker; ``key`` tells files apart."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = ByteTokenizer(files.value[0].decode()), PieceTokenizer(files.value[1])
    return _MADE[key]


def joined(ids: np.ndarray, at: np.ndarray, table: pa.LargeBinaryArray) -> list[bytes]:
    """The bytes of each text's tokens, put together; ``at`` says where each text's tokens begin (n + 1 values)."""
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(ids) + 1]
    raw = memoryview(taken.buffers()[2] or b"")
    return [bytes(raw[ends[i] : ends[j]]) for i, j in zip(at[:-1], at[1:], strict=True)]


def encoded(texts: list[str], one: ByteTokenizer | PieceTokenizer, table: pa.LargeBinaryArray) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's ids and the bytes they stand for."""
    ids = [np.array(one.encode(t), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
    at = np.cumsum([0, *map(len, ids)])
    return ids, joined(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), at, table)


def token_columns(docs: DataFrame, text: str, keep: list[str], files: Broadcast, key: str, width: np.dtype) -> DataFrame:
    """The kept columns (packed), row, and a, b: the ids of both tokenizers as bytes, empty where either does not spell space + text."""

    @F.arrow_udf("struct<a:binary,b:binary>")
    def tokens(column: pa.Array) -> pa.Array:
        pair = tokenizer_pair(files, key)
        tables = [pa.array(t.bytes_of, pa.large_binary()) for t in pair]
        out: tuple[list[bytes], list[bytes]] = ([], [])
        for i, j in slices(column):
            texts = column.slice(i, j - i).to_pylist()
            (a, spelt_a), (b, spelt_b) = (encoded(texts, t, table) for t, table in zip(pair, tables, strict=True))
            for t, x, y, u, v in zip(texts, a, b, spelt_a, spelt_b, strict=True):
                same = bool(t) and u == v == b" " + t.encode()
                out[0].append(x.astype(width).tobytes() if same else b"")
                out[1].append(y.astype(width).tobytes() if same else b"")
        return pa.StructArray.from_arrays([pa.array(v, pa.binary()) for v in out], names=["a", "b"])

    packed = pack(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(f"{text} (whole)")))
    source = F.col(inputs(len(keep) + 1)[-1])
    made = packed.withColumn("tokens", tokens.asNondeterministic()(source))
    return made.select(*inputs(len(keep)), F.monotonically_increasing_id().alias("row"), "tokens.a", "tokens.b")


# --- alignment ----------------------------------------------------------------------------------------------------


class Aligned:
    """The links and groups of a run of texts, from the ids and byte lengths of their tokens."""

    def __init__(self, a: pa.Array, b: pa.Array, sizes: tuple[np.ndarray, np.ndarray], width: np.dtype):
        (raw_a, at_a), (raw_b, at_b) = flat_bytes(a), flat_bytes(b)
        wide = np.dtype(width).itemsize
        self.a, self.b = raw_a.view(width).astype(np.int64), raw_b.view(width).astype(np.int64)
        self.at_a, self.at_b = at_a // wide, at_b // wide
        # Both spell the same bytes, so their ends count along one line, text after text.
        ends_a, ends_b = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        again = np.zeros(len(both), dtype=bool)
        again[1:] = both[1:] == both[:-1]
        segments, common = both[~again], both[again]
        bounds = np.concatenate([[0], ends_a])[self.at_a]
        self.at_link = np.searchsorted(segments, bounds, side="right")
        self.n_groups = np.diff(np.searchsorted(common, bounds, side="right"))
        self.pairs = (self.a[np.searchsorted(ends_a, segments)] << 32) | self.b[np.searchsorted(ends_b, segments)]
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)

    def digests(self, names: pa.LargeStringArray) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2``, hashed; ``names`` has each id with a comma, then with a bar, then with a semicolon."""
        ids = len(names) // 3
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        groups = np.arange((self.group_a[-1] if len(self.a) else -1) + 2)
        text = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        text[np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a)] = self.a + ids * last_a
        text[np.arange(len(self.b)) + np.searchsorted(self.group_a, groups, side="left")[1:][self.group_b]] = self.b + 2 * ids * last_b
        taken = names.take(pa.array(text))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(text) + 1]
        raw, at = memoryview(taken.buffers()[2] or b""), ends[self.at_a + self.at_b]
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text the sum of a number of each link."""
        run = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=run[1:])
        return run[self.at_link[1:]] - run[self.at_link[:-1]]


# --- minimal perfect hash -----------------------------------------------------------------------------------------


def home(pairs: np.ndarray) -> np.ndarray:
    """A number from 0 to 2^40 - 1, by which pairs are dealt to blocks and shards."""
    return (mix64(pairs.view(np.uint64)) >> np.uint64(24)).astype(np.int64)


def at_level(pairs: np.ndarray, level: int) -> np.ndarray:
    return mix64(pairs.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def bit_levels(pairs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits (64-bit words) in which each of the distinct pairs has one to itself, and the pairs in the order of their bits."""
    levels, ordered = [], []
    while len(pairs):
        words = -(-ROOM * len(pairs) // 64)
        place = (at_level(pairs, len(levels)) % np.uint64(64 * words)).astype(np.int64)
        alone = np.bincount(place, minlength=64 * words) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        own = alone[place]
        ordered.append(pairs[own][np.argsort(place[own])])
        pairs = pairs[~own]
    return levels, np.concatenate(ordered) if ordered else pairs


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct pairs, made of shards; ``find`` verifies the pair that has the number."""

    def __init__(self, shards: list[tuple[list[np.ndarray], np.ndarray]], blocks: int):
        self.blocks = blocks
        depth = max((len(levels) for levels, _ in shards), default=0)
        self.words = np.zeros((depth, len(shards)), dtype=np.int64)
        self.begin = np.zeros((depth, len(shards)), dtype=np.int64)
        flat, total = [], 0
        for s, (levels, _) in enumerate(shards):
            for k, words in enumerate(levels):
                self.words[k, s], self.begin[k, s] = len(words), total
                flat.append(words)
                total += len(words)
        self.bits = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint64)
        self.before = np.zeros(len(self.bits) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.bits), out=self.before[1:])
        self.pairs = np.concatenate([pairs for _, pairs in shards]) if shards else np.zeros(0, dtype=np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 for those that are not in the table."""
        out = np.full(len(pairs), -1, dtype=np.int64)
        if not len(self.pairs):
            return out
        left = np.arange(len(pairs))
        shard = home(pairs) // self.blocks % self.words.shape[1]
        for k in range(len(self.words)):
            words = self.words[k, shard[left]]
            left, words = left[words > 0], words[words > 0]
            place = (at_level(pairs[left], k) % (np.uint64(64) * words.astype(np.uint64))).astype(np.int64)
            word, bit = self.begin[k, shard[left]] + place // 64, (place % 64).astype(np.uint64)
            set_ = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[set_]] & ((np.uint64(1) << bit[set_]) - np.uint64(1))
            out[left[set_]] = self.before[word[set_]] + np.bitwise_count(below)
            left = left[~set_]
        found = out >= 0
        out[found] = np.where(self.pairs[out[found]] == pairs[found], out[found], -1)
        return out


def perfect_hash(pairs: DataFrame, block: int, blocks: int, shard_pairs: int) -> PerfectHash:
    """The hash of the pairs of one block; its shards are made in tasks."""
    own = pairs.where(F.pmod("home", F.lit(blocks)) == block)
    shards = max(1, -(-own.count() // shard_pairs))

    def build(group: pa.Table) -> pa.Table:
        levels, ordered = bit_levels(np.sort(group["pair"].to_numpy()))
        number = group["shard"][:1]
        return pa.table({"shard": number, "levels": pa.array([[w.tobytes() for w in levels]], pa.list_(pa.binary())), "pairs": pa.array([ordered.tobytes()], pa.binary())})

    dealt = own.select("pair", F.expr(f"home div {blocks} % {shards}").alias("shard"))
    rows = dealt.groupBy("shard").applyInArrow(build, "shard long, levels array<binary>, pairs binary").collect()  # some 9 bytes a pair of the block
    made = {r["shard"]: ([np.frombuffer(w, dtype=np.uint64) for w in r["levels"]], np.frombuffer(r["pairs"], dtype=np.int64)) for r in rows}
    none: tuple[list[np.ndarray], np.ndarray] = ([], np.zeros(0, dtype=np.int64))
    return PerfectHash([made.get(s, none) for s in range(shards)], blocks)


# --- counting -----------------------------------------------------------------------------------------------------


def distinct_pairs(tokens: DataFrame, sizes: Broadcast, width: np.dtype) -> DataFrame:
    """pair, home: each id pair that some link holds, once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for i, j in slices(batch.column("a")):
                part = batch.slice(i, j - i)
                seen = np.union1d(seen, Aligned(part.column("a"), part.column("b"), sizes.value, width).pairs)
                if len(seen) > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(home(seen))], ["pair", "home"])
                    seen = seen[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(home(seen))], ["pair", "home"])

    return tokens.select("a", "b").mapInArrow(gather, "pair long, home long").distinct()


def summed(group: pa.Table) -> np.ndarray:
    total = np.zeros(PART, dtype=np.int64)
    for counts in group["counts"]:
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts.as_py()), dtype=np.int64)
    return total


def squeezed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def pair_counts(tokens: DataFrame, table: Broadcast, sizes: Broadcast, width: np.dtype) -> DataFrame:
    """part, counts: the vector of link counts by the pairs' numbers, in compressed parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-len(table.value.pairs) // PART) * PART, dtype=np.int64)
        for batch in batches:
            for i, j in slices(batch.column("a")):
                part = batch.slice(i, j - i)
                pairs, n = np.unique(Aligned(part.column("a"), part.column("b"), sizes.value, width).pairs, return_counts=True)
                number = table.value.find(pairs)
                total[number[number >= 0]] += n[number >= 0]
        salt = TaskContext.get().partitionId() % SALTS
        for p, own in enumerate(total.reshape(-1, PART)):
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": [p], "salt": [salt], "counts": [squeezed(own)]})

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"part": group["part"][:1], "counts": pa.array([squeezed(summed(group))], pa.binary())})

    sent = tokens.select("a", "b").mapInArrow(count, "part long, salt long, counts binary")
    salted = sent.groupBy("part", "salt").applyInArrow(add, "part long, counts binary")
    return salted.groupBy("part").applyInArrow(add, "part long, counts binary")


def vector(parts: DataFrame, pairs: int) -> np.ndarray:
    """The counts of one block's pairs, on the driver: 8 bytes a pair."""
    out = np.zeros(-(-pairs // PART) * PART, dtype=np.int64)
    for r in parts.toLocalIterator():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), dtype=np.int64)
    return out[:pairs]


def align_tokens(
    docs: DataFrame,
    text: str = "text",
    byte_file: str = BYTE_TOKENIZER,
    piece_file: str = PIECE_TOKENIZER,
    block_pairs: int = BLOCK_PAIRS,
    shard_pairs: int = SHARD_PAIRS,
) -> DataFrame:
    """Every input row, without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A is a byte-level vocabulary applied to space + text, B a vocabulary of pieces
    that adds this space itself; strings of special tokens inside a text are plain
    text. A link is a pair of overlapping tokens; the count of an id pair is the
    number of links of the whole corpus that hold it, and a link is among the best
    if no other pair with its B id counts more (ties are all best). Texts that are
    null, empty, or not spelt by the tokens of both have no tokens: zeros and an
    empty ``groups_sha256``; they count in nothing. Texts of any length go whole
    through both tokenizers. Repeated rows each count. An empty table gives an empty
    one. Columns of these names are replaced, all others pass through.
    """
    spark = docs.sparkSession
    content = read_file(spark, byte_file), read_file(spark, piece_file)
    key = hashlib.sha256(content[0] + content[1]).hexdigest()
    one, other = ByteTokenizer(content[0].decode()), PieceTokenizer(content[1])
    ids = max(len(one.bytes_of), len(other.bytes_of))
    width = np.dtype(np.uint16 if ids <= 1 << 16 else np.uint32)
    context = spark.sparkContext
    files = context.broadcast(content)
    sizes = context.broadcast(tuple(np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (one, other)))
    own = scratch_path(spark, "alignment")
    keep = [c for c in docs.columns if c.lower() != text.lower()]

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{own}/{name}")
        return spark.read.schema(df.schema).parquet(f"{own}/{name}")

    tokens = stored(token_columns(docs, text, keep, files, key, width), "tokens")
    pairs = stored(distinct_pairs(tokens, sizes, width), "pairs")
    blocks = max(1, -(-pairs.count() // block_pairs))
    best = np.zeros(len(other.bytes_of), dtype=np.int64)

    def counted(block: int, table: PerfectHash) -> np.ndarray:
        return vector(spark.read.schema("part long, counts binary").parquet(f"{own}/counts-{block}"), len(table.pairs))

    tables: dict[int, PerfectHash] = {}
    for k in range(blocks):
        table = perfect_hash(pairs, k, blocks, shard_pairs)
        shared = context.broadcast(table)
        stored(pair_counts(tokens, shared, sizes, width), f"counts-{k}")
        shared.destroy()
        np.maximum.at(best, table.pairs & 0xFFFFFFFF, counted(k, table))
        if blocks == 1:
            tables[k] = table

    def looked_up(k: int) -> Broadcast:
        table = tables.get(k) or perfect_hash(pairs, k, blocks, shard_pairs)
        counts = counted(k, table)
        return context.broadcast((table, counts, counts == best[table.pairs & 0xFFFFFFFF]))

    kind = pa.struct([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in MEASURES])

    def measures(shared: Broadcast) -> Column:
        @F.arrow_udf("struct<" + ",".join(f"{c}:{'string' if c == 'groups_sha256' else 'bigint'}" for c in MEASURES) + ">")
        def measured(a: pa.Array, b: pa.Array) -> pa.Array:
            table, counts, tops = shared.value
            names = pa.array([f"{i}{end}" for end in ",|;" for i in range(ids)], pa.large_string())
            outs = []
            for i, j in slices(a):
                run = Aligned(a.slice(i, j - i), b.slice(i, j - i), sizes.value, width)
                distinct, place = np.unique(run.pairs, return_inverse=True)
                number = table.find(distinct)
                known = number >= 0
                count, top = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
                count[known], top[known] = counts[number[known]], tops[number[known]]
                columns = [np.diff(run.at_a), np.diff(run.at_b), run.n_groups, np.diff(run.at_link), run.sums(top[place]), run.sums(count[place])]
                outs.append([*[pa.array(v.astype(np.int64)) for v in columns], pa.array(run.digests(names), pa.string())])
            return pa.concat_arrays([pa.StructArray.from_arrays(v, names=MEASURES) for v in outs]) if outs else pa.array([], kind)

        return measured.asNondeterministic()("a", "b")

    packed = [F.col(c) for c in inputs(len(keep))]
    found = tokens.select(*packed, "row", measures(looked_up(0)).alias("m")).select(*packed, "row", "m.*")
    if blocks > 1:  # the pairs of the other blocks add theirs
        parts = found.select("row", "n_best", "count_sum")
        for k in range(1, blocks):
            parts = stored(parts, f"sums-{k}")
            shared = looked_up(k)
            more = tokens.select("row", measures(shared).alias("m")).select("row", "m.n_best", "m.count_sum")
            parts = parts.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        found = found.drop("n_best", "count_sum").join(parts, "row")
    return unpack(found, keep, **{c: F.col(c) for c in MEASURES})
