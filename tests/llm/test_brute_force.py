"""Inner steps of the trained operators against plain enumeration."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tokenloom.llm import context_tree, parse_language, pii_semicrf, zstd_quality
from tokenloom.llm.common import crc_mod

# --- the semi-Markov field: every segmentation written out ----------------------------------------------------------


def segmentations(n, segments, kinds, at=0):
    """All ways through n atoms, as lists of (segment, kind); an atom outside entities is skipped."""
    if at == n:
        yield []
        return
    yield from segmentations(n, segments, kinds, at + 1)
    for s, (i, j) in enumerate(segments):
        if i == at:
            for k in range(kinds):
                for rest in segmentations(n, segments, kinds, j):
                    yield [(s, k), *rest]


@pytest.mark.parametrize("text", ["12 34 56", "a@b.c 7", "+1 (55) 6", "x [at] y.z"])
def test_field_sums_and_best_path(text):
    found = list(pii_semicrf.regions(text))
    assert found
    region = pii_semicrf.Region(text, *found[0])
    n, kinds = len(region.bounds) - 1, len(pii_semicrf.KINDS)
    rng = random.Random(text)
    weights = {f: [rng.uniform(-1.5, 1) for _ in range(kinds)] for i, j in region.segments for f in region.features(i, j)}
    score = np.array([sum(np.array(weights[f]) for f in region.features(i, j)) for i, j in region.segments]).reshape(-1, kinds)
    # Two segments of a short region at most are looked at together: all ways through it stay few.
    ways = [(sum(score[s, k] for s, k in way), way) for way in segmentations(n, region.segments, kinds)]
    total = np.logaddexp.reduce([v for v, _ in ways])
    forward, backward = pii_semicrf.log_sums(region, np.logaddexp.reduce(score, axis=1))
    assert forward[-1] == pytest.approx(total) and backward[0] == pytest.approx(total)
    best = max(ways, key=lambda w: w[0])[1]
    sure = []
    for s, k in best:
        share = np.exp(np.logaddexp.reduce([v for v, way in ways if (s, k) in way]) - total)
        if share >= pii_semicrf.MIN_POSTERIOR:
            i, j = region.segments[s]
            sure.append((k, region.bounds[i], region.bounds[j]))
    assert sorted(pii_semicrf.decode(region, weights)) == sorted(sure)


# --- cross-parsing: every phrase found by searching the text --------------------------------------------------------


def plain_phrases(symbols, learned):
    """Greedy longest phrases, anew every SEGMENT symbols."""
    count = 0
    for begin in range(0, len(symbols), parse_language.SEGMENT):
        phrase = b""
        count += 1
        for c in symbols[begin : begin + parse_language.SEGMENT]:
            longer = phrase + bytes([c])
            if any(longer in t for t in learned):
                phrase = longer
            else:
                count += 1
                phrase = bytes([c]) if any(bytes([c]) in t for t in learned) else b""
    return count


def test_phrases_and_winner():
    rng = random.Random(5)
    learned = {"x": [bytes(rng.choice(b"abc ") for _ in range(300)) for _ in range(3)], "y": [bytes(rng.choice(b"bcd ") for _ in range(400))], "z": [b"dddd abab", b"e"]}
    names, sizes = list(learned), [sum(map(len, t)) for t in learned.values()]
    parser = parse_language.Parser(names, [parse_language.suffix_automaton(t) for t in learned.values()], sizes)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("abc", "bcd ", "abq", "zz", "dabe") for n in (1, 5, 60, 1025, 2500)]
    symbols, offsets = parse_language.symbols_of(pa.array(texts))
    wanted = np.array([[plain_phrases(bytes(symbols[i:j]), learned[k]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)] for k in names])
    assert (parser.phrases(symbols, offsets) == wanted).all()
    bits = wanted * np.log2(sizes)[:, None]
    found, score = parser.predict(pa.array(texts))
    assert found == [names[k] for k in bits.argmin(axis=0)]
    assert ((score > 0) & (score <= 1)).all()


# --- the compression classifier: plain calls of the library ---------------------------------------------------------


def test_quality_scores(spark):
    rng = random.Random(9)
    good = ["the river runs below old houses", "a garden grows behind the wall", "people walk along quiet streets"]
    rows, labels = [], []
    for i in range(400):
        clean = i % 2
        text = " ".join(rng.choice(good) for _ in range(rng.randint(2, 60))) if clean else " ".join("".join(rng.choice("#$%&xyz!") for _ in range(rng.randint(2, 12))) for _ in range(rng.randint(2, 200)))
        rows.append((i, text))
        labels.append((i, clean))
    rows += [(1000, None), (1001, ""), (1002, "ä" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    usable = crc_mod(F.col("doc_id"), 4) != 2
    model = zstd_quality.fit(docs, marked, usable)
    # The sample: usable labelled texts of a class, all of them, as they are fewer than its bound.
    for value in (0, 1):
        wanted = [t.encode() for i, t in rows[:400] if i % 2 == value and zlib.crc32(str(i).encode()) % 4 != 2]
        assert sorted(zstd_quality.labelled_sample(docs, marked, usable, value)) == sorted(wanted)
    assert len(model["good"]) == len(model["bad"]) <= zstd_quality.DICTIONARY_BYTES

    def size(block, dictionary):
        params = zstandard.ZstdCompressionParameters.from_level(
            zstd_quality.LEVEL, source_size=zstd_quality.BLOCK, dict_size=len(dictionary), write_content_size=False, write_dict_id=False
        )
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        fresh = zstandard.ZstdCompressor(dict_data=known, compression_params=params)
        return len(fresh.compress(block)) - len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(b""))

    found = {r["doc_id"]: r for r in zstd_quality.classify(docs, marked, usable).collect()}
    assert len(found) == len(rows)
    right = 0
    for i, text in rows[::7] + rows[-3:]:
        raw = (text or "").encode()
        parts = [raw[at : at + zstd_quality.BLOCK] for at in range(0, len(raw), zstd_quality.BLOCK)]
        sizes = [(size(p, model["good"]), size(p, model["bad"])) for p in parts]
        difference = (sum((b - a) / (a + b + 64) for a, b in sizes) + 5 * model["centre"]) / (len(parts) + 5)
        assert found[i]["size_difference"] == pytest.approx(difference, abs=1e-12)
        odds = model["weights"][0] + model["weights"][1] * difference
        assert found[i]["score"] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.7)
        right += i < 1000 and found[i]["predicted"] == i % 2
    assert right >= 0.95 * len(rows[::7]) - 3


def test_dictionaries_take_pieces_in_turn(monkeypatch):
    monkeypatch.setattr(zstd_quality, "PIECE", 3)
    assert zstd_quality.build_dictionary([b"abcdefgh", b"xy", b"123456"], 100) == b"abcxy123def456gh"
    assert zstd_quality.build_dictionary([b"abcdefgh", b"xy"], 4) == b"abcx" and zstd_quality.build_dictionary([], 4) == b""
    good, bad = zstd_quality.build_dictionaries([b"a" * 50], [b"b" * 7, b"c" * 2])
    assert len(good) == len(bad) == 9


def test_logistic_is_least_and_weighs_rows():
    x, y = np.array([-1.0, -0.4, 0.1, 0.3, 0.9, 0.2]), np.array([0.0, 0, 1, 0, 1, 1])
    weight = np.array([1.0, 2, 1, 3, 1, 1])
    fitted = zstd_quality.logistic(x, y, weight)

    def loss(a, b):
        z = a + b * x
        return weight @ (np.logaddexp(0, z) - y * z) + 5e-4 * (a * a + b * b)

    grid = [(fitted[0] + da, fitted[1] + db) for da in np.linspace(-2, 2, 41) for db in np.linspace(-2, 2, 41)]
    assert loss(*fitted) <= min(loss(*g) for g in grid) + 1e-12
    # A row of weight 2 is two rows.
    twice = zstd_quality.logistic(np.repeat(x, weight.astype(int)), np.repeat(y, weight.astype(int)), np.ones(9))
    assert np.allclose(fitted, twice)


def test_quality_on_held_out_labels_whatever_the_sample_holds(spark, monkeypatch):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    tested = docs.join(labels.where(held).select("doc_id", "quality"), "doc_id")

    def with_all_documents():
        model = zstd_quality.fit(docs, labels, ~held)
        intercept, slope = model["weights"]
        score = 1 / (1 + F.exp(-(intercept + slope * zstd_quality.size_difference(F.col("text"), model))))
        return [(r["quality"], int(r["score"] >= 0.7), r["score"]) for r in tested.select("quality", score.alias("score")).collect()]

    full = with_all_documents()
    good, bad = [r for r in full if r[0] == 1], [r for r in full if r[0] == 0]
    print(len(good), sum(1 - p for _, p, _ in good), len(bad), sum(p for _, p, _ in bad))
    assert sum(1 - p for _, p, _ in good) <= 0.02 * len(good) and sum(p for _, p, _ in bad) <= 0.1 * len(bad)
    monkeypatch.setattr(zstd_quality, "SAMPLE_ROWS", 400)
    capped = with_all_documents()
    print(np.mean([s for _, _, s in full]), np.mean([s for _, _, s in capped]))
    assert abs(np.mean([s for _, _, s in full]) - np.mean([s for _, _, s in capped])) < 0.01


@pytest.mark.parametrize("steps", [2, 7, 1_024])
def test_the_broadcast_bound_binds_for_counts_of_any_size(spark, steps):
    rng = random.Random(4)
    tables = [[rng.randint(200_000, 2**40) for _ in range(60)], [5] * 40 + [9] * 3, [300_000] * 20, []]
    for counts in tables:
        rows = spark.createDataFrame([(c,) for c in counts], "n long").repartition(2).cache()
        for most in (0, 10, 45):
            wanted = next(n for n in sorted({0, *counts, *[c + 1 for c in counts]}) if sum(c >= n for c in counts) <= most)
            found = context_tree.least_count(rows, most, steps)
            assert found == wanted and sum(c >= found for c in counts) <= most
        rows.unpersist()
