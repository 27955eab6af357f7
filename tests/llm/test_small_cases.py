"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom import session
from tokenloom.llm import arc_warc, context_tree, decontaminate, exact_dedup, html_cut, jaccard_join, mixing, parse_language, pii_semicrf, zstd_quality
from tokenloom.llm.common import crc_mod, file_places, numbered

DOC = "doc_id long, text string, lang string, source string, score double, kept boolean, size string"
PAGE = "page_id long, url string, html string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(20_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 0.5, True, "s"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", None, None, None),
    (3, None, None, None, None, None, None),
    (4, "", "de", "b", None, None, None),
    (5, " \t\n ", "de", "b", None, None, None),
    (6, LONG, "en", "a", None, None, None),
    (7, LONG + " tail", "en", None, None, None, None),
    (8, "one", "de", "c", None, None, None),
    (8, "one", "de", "c", None, None, None),
    (None, "one", "de", "c", None, None, None),
    (None, "größe ÄÖ straße", "de", "\U0001f600", None, None, None),
    (9, "Größe ÄÖ straße", "de", "", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def by_id(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    return found


def test_exact_dedup(docs, none):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "size", "keep_id", "group_size", "kept", "text_sha256"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    for r in rows:
        ids = groups[lower(r["text"])]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
        assert r["text_sha256"] == hashlib.sha256(lower(r["text"]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 6, 7, 8, 9}


def test_one_row_of_each_group_stays(spark):
    """Rows that repeat an id, and rows without one, are copies like any others."""
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:59], last]) for last in ("x", "y", "z")]
    other = ["other " + t.replace("w", "v") for t in near]
    rows = [(5, near[0]), (5, near[0]), (5, near[1]), (7, near[2]), (None, other[0]), (None, other[0]), (None, other[1]), (None, other[2])]
    frame = spark.createDataFrame(rows + [(8, ""), (8, ""), (None, None)], "doc_id long, text string").repartition(3)
    exact = exact_dedup.drop_copies(frame).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact) == sorted([(5, near[0]), (5, near[1]), (7, near[2]), *[(0, t) for t in other], (8, "")])
    kept = jaccard_join.keep_one_of_each(frame.where("length(text) > 0")).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 5]
    assert jaccard_join.keep_one_of_each(frame).count() == 5


def test_equal_digests_of_different_texts_stay_apart(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda col, bits: F.lit("same"))
    rows = exact_dedup.exact_dedup(docs).collect()
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[lower(r[1])] += 1
    assert len(rows) == len(ROWS)
    assert all(r["group_size"] == sizes[lower(r["text"])] for r in rows)


def naive_windows(tokens, width=10):
    if len(tokens) < width:
        return [tuple(tokens)] if tokens else []
    return [tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]


def test_decontamination(spark, docs, none):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [
        (1, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        (2, "ALPHA, beta; gamma delta epsilon zeta eta theta iota kappa"),
        (10, "gamma delta"),
        (11, "gamma delta"),
        (3, "one"),
        (4, None),
        (5, ""),
        (None, "straße"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (50_000, 2):
        rows = decontaminate.find_benchmark(docs, bench, block_windows=block).collect()
        assert len(rows) == len(ROWS)
        for r in rows:
            tokens = re.findall(pattern, lower(r["text"]))
            hit, found = set(), set()
            for item, text in items:
                for w in set(naive_windows(re.findall(pattern, lower(text)))):
                    at = [i for i in range(len(tokens) - len(w) + 1) if tuple(tokens[i : i + len(w)]) == w]
                    found |= {"" if item is None else str(item)} if at else set()
                    hit |= {p for i in at for p in range(i, i + len(w))}
            digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(tokens), len(hit), len(found), digest, bool(hit))
    assert decontaminate.find_benchmark(none, bench).count() == 0
    assert decontaminate.find_benchmark(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6, 7}
    cut = by_id(decontaminate.cut_spans(docs, bench).collect())
    assert cut[1][0]["text"] == "" and cut[6][0]["text"] == LONG and cut[9][0]["text"] == "größe ÄÖ".replace("Ä", "Ä")


def naive_groups(rows, width=3, share=90):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= share * len(x | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def check_groups(rows, out, *rule):
    sets, group = naive_groups(rows, *rule)
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    wanted = sorted((str(r[0]), r[1] or "", len(s), str(least.get(g) if s else r[0])) for r, s, g in zip(rows, sets, group, strict=True))
    found = sorted((str(r["doc_id"]), r["text"] or "", r["n_shingles"], str(r["component_id"])) for r in out.collect())
    assert found == wanted


def test_jaccard_groups(docs, none):
    out = jaccard_join.jaccard_groups(docs)
    assert out.columns == [*docs.columns, "n_shingles", "component_id"]
    check_groups(ROWS, out)
    assert jaccard_join.jaccard_groups(none).count() == 0
    assert jaccard_join.keep_one_of_each(docs).columns == docs.columns


def test_jaccard_chains_and_large_groups(spark):
    """A group of near copies larger than the first round's leaders reach, and a chain whose ends do not link."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 40], f"edit{i}", *base[i % 40 :]])) for i in range(150)]
    chain = [f"c{i}" for i in range(160)]
    rows += [(1000 + k, " ".join(chain[3 * k : 3 * k + 100])) for k in range(12)]
    rows += [(2000 + k, " ".join(f"u{k}x{j}" for j in range(30)) + " a common passage of some words") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_groups(rows, jaccard_join.jaccard_groups(frame))


@pytest.mark.parametrize(("linear", "few"), [(4, 8), (0, 1)])
def test_jaccard_buckets_of_texts_that_do_not_link(spark, monkeypatch, linear, few):
    """Families whose members share most rare n-grams but stay below the share, with a few that link, by five words and 80 %."""
    import random

    monkeypatch.setattr(jaccard_join, "LINEAR", linear)  # 0: ever more leaders, as for large buckets
    monkeypatch.setattr(jaccard_join, "FEW", few)  # 1: all buckets go through the rounds
    rng, rows = random.Random(3), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(150)]
        for k in range(40):
            text = list(base)
            for at in rng.sample(range(150), rng.choice((1, 3, 5, 9, 12))):
                text[at] = f"e{family}x{k}x{at}"
            rows.append((100 * family + k, " ".join(text)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + k, " ".join(f"q{k}x{i}" for i in range(rng.randint(5, 200))) + " " + passage) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard_join.jaccard_groups(frame, width=5, share=80)
    check_groups(rows, out, 5, 80)
    assert 40 < out.select("component_id").distinct().count() < len(rows)


def test_one_n_gram_stands_for_those_of_the_same_classes(spark):
    rows = [(g, r) for r in (1, 2, 3) for g in range(10)] + [(g, r) for r in (1, 2) for g in range(20, 25)] + [(90, 1), (91, 2), (92, 3), (50, 3), (50, 4)]
    shared = [r for r in rows if r[0] < 90]
    found = jaccard_join.shared_buckets(spark.createDataFrame(shared, "gram long, rep long")).collect()
    assert sorted((r["gram"], r["size"], r["weight"]) for r in found) == [(0, 3, 10), (20, 2, 5), (50, 2, 1)]


def test_rows_of_files_are_numbered_in_place(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    stored = spark.read.parquet(path)
    assert file_places(stored) is not None
    for other in (docs, stored.where("doc_id > 3"), stored.unionByName(stored), stored.select(F.explode(F.array(F.lit(1), F.lit(2))), "doc_id")):
        assert file_places(other) is None
    numbers = [r["row_number"] for r in numbered(stored, "text", "doc_id").collect()]
    assert len(set(numbers)) == len(ROWS) and numbers == [r["row_number"] for r in numbered(stored, "text", "doc_id").collect()]
    for drop in (exact_dedup.drop_copies, jaccard_join.keep_one_of_each):
        a, b = (sorted(map(str, drop(frame).collect())) for frame in (stored, docs))
        assert len(a) == len(b)


def test_mixing(spark, docs, none):
    out = mixing.mix(docs, block_docs=2, shard_blocks=2)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * len(r["copies"]) <= 2 * r["size"]
    again = mixing.mix(docs.repartition(5), block_docs=2, shard_blocks=2).select("doc_id", "taken", F.to_json("copies")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out.select("doc_id", "taken", F.to_json("copies")).collect()))
    assert mixing.mix(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 90), f"s{min(i % 7, 3)}") for i in range(3_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame, block_docs=64, shard_blocks=8)
    total = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.01 for r in total)
    copies = out.select(F.explode("copies").alias("c")).groupBy("c.shard").count().collect()
    assert len(copies) > 3


def test_targets_and_quotas():
    assert mixing.targets([10, 10, 10]) == [20.0, 8.333333333333334, 16.666666666666668]
    assert mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([]) == []
    import numpy as np

    quotas = np.array([5, 0, 117, 31])
    parts = [mixing.shard_quotas(quotas, 7, k, 3) for k in range(7)]
    assert (sum(own for _, own in parts) == quotas).all()
    for k in range(1, 7):
        assert (parts[k][0] == parts[k - 1][0] + parts[k - 1][1]).all()


def test_pii_patterns_against_plain_regular_expressions():
    texts = [
        "a.b@c.de, x@y @z.org q@r.s.t- u@v..w a@b@c.d",
        "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 49927398716 1  2",
        "+1 (017) 555-7713 + 12345678 +1234567 +49 30 1234567890123 +1-(2)3456-78- +1+12345678",
        "é@x.y ü1.2.3.4ß",
        "a" * 5000 + "@" + "1" * 5000 + " " + "+" * 500 + "." * 500,
    ]
    for t in texts:
        wanted = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        wanted += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if 16 <= len(digits) <= 19 and total % 10 == 0:
                wanted.append((2, m.start(), m.end()))
        wanted += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert pii_semicrf.base_spans(t) == wanted


def test_pii(spark, docs, none):
    found = pii_semicrf.find_personal_data(docs)
    assert found.columns == [*docs.columns, "pii"] and found.count() == len(ROWS)
    assert found.where(F.size("pii") > 0).count() == 0
    assert pii_semicrf.find_personal_data(none).count() == 0
    rows = [(i, f"write to user{i}@host{i % 9}.example.com or call +1 ({100 + i}) 555-{1000 + i} from 10.0.{i}.7 now") for i in range(60)]
    rows.append((99, "write to someone [at] host3.example.com please, room 12, page 345"))
    out = pii_semicrf.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    columns = pii_semicrf.digest_columns(F.col("pii"))
    got = {r["doc_id"]: r for r in out.select("doc_id", *[v.alias(k) for k, v in columns.items()]).collect()}
    assert all((got[i]["n_email"], got[i]["n_ip"], got[i]["n_card"], got[i]["n_phone"]) == (1, 1, 0, 1) for i in range(60))
    assert got[99]["n_email"] == 0 and got[99]["spans"] == "email:9:39"


def test_language(spark, docs, none):
    out = parse_language.predict_language(docs, F.lit(True))
    rows = by_id(out.collect())
    assert out.columns == ["doc_id", "text", "lang", "source", "kept", "size", "lang_pred", "score"]
    assert all(rows[i][0]["lang_pred"] == "und" and rows[i][0]["score"] == 0 for i in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for rs in rows.values() for r in rs)
    assert parse_language.predict_language(none, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in parse_language.predict_language(docs, F.lit(False)).collect()} == {"und"}


def test_a_language_of_long_texts_only_is_learned(spark):
    short = [(i, "the quick brown fox jumps over the lazy dog and runs away", "en") for i in range(8)]
    long_text = "123 " * 6_000 + "zażółć gęślą jaźń pchnąć w tę łódź jeża lub ośm skrzyń fig " * 400
    docs = spark.createDataFrame([*short, (20, long_text, "pl"), (21, "the same fox " * 3_000, "en")], "doc_id long, text string, lang string")
    model = {lang: n for lang, n, _ in parse_language.learn(docs, F.lit(True))}
    assert set(model) == {"en", "pl"} and 0 < model["pl"] <= parse_language.SAMPLE_DOC_BYTES
    assert model["en"] == 8 * len(short[0][1])
    assert parse_language.predict_language(docs, F.lit(True)).where("doc_id = 20").first()["lang_pred"] == "pl"


def test_suffix_automaton_accepts_exactly_the_substrings():
    texts = [b"abracadabra", b"banana", b"bandana"]
    edges = defaultdict(dict)
    for s, c, t in parse_language.suffix_automaton(texts).tolist():
        edges[s][c] = t

    def accepts(word):
        state = 0
        for c in word:
            if c not in edges[state]:
                return False
            state = edges[state][c]
        return True

    inside = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    assert all(accepts(w) for w in inside)
    outside = {w + bytes([c]) for w in inside for c in b"abcdnr"} - inside
    assert outside and not any(accepts(w) for w in outside)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    out = zstd_quality.classify(docs, labels, F.lit(True))
    assert out.columns == ["doc_id", "text", "lang", "source", "kept", "size", "score", "predicted", "size_difference"]
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    unlabelled = zstd_quality.classify(docs, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert zstd_quality.classify(none, labels, F.lit(True)).count() == 0
    assert zstd_quality.keep_good(docs, labels, F.lit(True)).columns == docs.columns


def test_a_very_long_text_does_not_end_the_quality_sample(spark):
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    long_id = ids.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long_text = F.repeat(F.lit("word "), 2_000_000)
    docs = ids.withColumn("text", F.when(F.col("doc_id") == long_id, long_text).otherwise(F.concat(F.lit("text of document "), "doc_id")))
    labels = ids.withColumn("quality", F.lit(1))
    assert len(zstd_quality.labelled_sample(docs, labels, F.lit(True), 1)) == 40


def test_samples_have_one_row_of_an_id(spark, monkeypatch):
    rows = [(i % 3, f"call +1 (017) 555-771{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert len(zstd_quality.labelled_sample(docs, labels, F.lit(True), 1)) == 3
    seen = []
    monkeypatch.setattr(pii_semicrf, "training_examples", lambda texts: seen.extend(texts) or [])
    pii_semicrf.fit(docs)
    assert len(seen) == 3
    monkeypatch.setattr(html_cut, "parse", lambda page: seen.append(page) or [])
    html_cut.fit(docs, "text", "doc_id")
    assert len(seen) == 6


def test_context_tree(docs, none):
    train = crc_mod(F.col("doc_id"), 5) != 1
    rows = context_tree.score_texts(docs, train, keep=("doc_id", "text", "score")).collect()
    counts = defaultdict(int)
    for r in ROWS:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1:
            for w in [*words(r[1]), None]:
                counts[w] += 1
    total, types = sum(counts.values()), len(counts)
    import math

    assert len(rows) == len(ROWS)
    for r in rows:
        tokens = [*words(r["text"]), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in counts for w in tokens), total)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert context_tree.score_texts(none, train).count() == 0
    assert context_tree.build_tree(context_tree.count_corpus(docs.select("text")), max_strings=20)[-1]["key"].size <= 20
    untrained = context_tree.score_texts(docs, F.lit(False)).where("doc_id = 8").first()
    assert untrained["base_score"] == 0 and abs(untrained["score"] - 32 * math.log10(0.5)) < 1e-6


def test_scores_are_of_the_whole_tree(docs, monkeypatch):
    """However few strings the cache holds, every counted string is in the tree that scores."""
    import numpy as np
    import pyarrow as pa

    train = crc_mod(F.col("doc_id"), 5) != 1

    def strings_of(texts):
        return context_tree.byte_strings(*context_tree.folded(pa.array(texts, pa.string())))

    learned = [r[1] for r in ROWS if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    found, n = np.unique(strings_of(learned)[0], return_counts=True)
    strings = {}
    for d in range(context_tree.DEPTH, -1, -1):
        u, at = np.unique(found & context_tree.mask(d), return_inverse=True)
        strings[d] = (u, np.bincount(at, weights=n).astype(np.int64))
    tree = context_tree.subtree(strings, 0, context_tree.DEPTH)
    nodes = [(tree[d]["key"], tree[d]["one"], tree[d]["stop"]) for d in range(context_tree.DEPTH + 1)]
    for most in (20, 600_000):
        monkeypatch.setattr(context_tree.build_tree, "__defaults__", (context_tree.DEPTH, most))
        rows = context_tree.score_texts(docs, train, keep=("text",)).collect()
        assert len(rows) == len(ROWS)
        for r in rows:
            wanted = context_tree.log10_of(strings_of([r["text"]])[0], nodes).sum()
            assert abs(r["score"] - wanted) < 1e-6 * max(1, abs(wanted))


def test_weighted_tree_is_the_sequential_one():
    """Counts in a batch give the probability that sequential context-tree weighting gives, bit by bit."""
    import math

    import numpy as np

    def sequential(bits, depth):
        """Product of the conditional probabilities of a depth-limited binary tree over whole-symbol contexts."""
        nodes = {}

        def weighted(path):
            a, b, pe, kids = nodes.get(path, (0, 0, 0.0, set()))
            if len(path) == depth:
                return pe
            return np.logaddexp(math.log(0.5) + pe, math.log(0.5) + sum(weighted((*path, k)) for k in kids))

        for context, bit in bits:
            for d in range(depth + 1):
                path = context[:d]
                a, b, pe, kids = nodes.get(path, (0, 0, 0.0, set()))
                pe += math.log(((b if bit else a) + 0.5) / (a + b + 1))
                kids = kids | ({context[d]} if d < depth else set())
                nodes[path] = (a + (not bit), b + bit, pe, kids)
        return weighted(())

    text = b"abracadabra abracadabra"
    depth = 2
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    keys, _ = context_tree.byte_strings(data, offsets, depth)
    strings = {}
    found, n = np.unique(keys, return_counts=True)
    for d in range(depth, -1, -1):
        u, at = np.unique(found & context_tree.mask(d), return_inverse=True)
        strings[d] = (u, np.bincount(at, weights=n).astype(np.int64))
    tree = context_tree.subtree(strings, 0, depth)
    symbols = [*text, 0xFF]
    padded = [0xFF] * depth + symbols
    for node, weight in zip(tree[0]["key"].tolist(), tree[0]["weighted"].tolist(), strict=True):
        bits = []
        for i, s in enumerate(symbols):
            for k in range(8):
                if ((1 << k) | (s >> (8 - k))) == node:
                    bits.append(((padded[i + depth - 1], padded[i + depth - 2]), (s >> (7 - k)) & 1))
        assert abs(sequential(bits, depth) - weight) < 1e-9


PAGES = [
    (1, "http://a.example/x y", "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; more</h1><p>First   para<br>line.</p><p>Second <b>bold</b>word.</p></article><footer>(c) me</footer></body></html>", "t"),
    (2, None, None, None),
    (3, "", "", None),
    (4, "http://b.example/", "<p>Only a paragraph of plain prose, which says a thing or two.</p>", None),
    (5, "http://c.example/", "x < y & z <b>unclosed <p>A paragraph with enough words to be prose, surely.<!-- never closed", None),
    (6, "http://d.example/", "HTTP/1.1 404\r\n\r\nWARC/1.0\r\nfiledesc://x " + "z" * 1500, None),
    (7, "http://d.example/", "HTTP/1.1 404\r\n\r\nWARC/1.0\r\nfiledesc://x " + "z" * 1500, None),
    (7, "http://d.example/", "HTTP/1.1 404\r\n\r\nWARC/1.0\r\nfiledesc://x " + "z" * 1500, None),
    (None, "http://e.example/", "HTTP/1.1 404\r\n\r\nWARC/1.0\r\nfiledesc://x " + "z" * 1500, None),
    (8, "http://f.example/", "<div>" * 3000 + "deep" + "</div>" * 2999 + "<p>" * 3000, None),
]


def test_main_text(spark):
    pages = spark.createDataFrame(PAGES, PAGE)
    out = html_cut.extract_main_text(pages)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    rows = {r["page_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "Head & more First para line. Second boldword."
    assert rows[2]["text"] == "" and rows[3]["n_chars"] == 0
    assert rows[4]["text"].startswith("Only a paragraph") and rows[4]["n_chars"] == len(rows[4]["text"])
    assert out.count() == len(PAGES) and html_cut.extract_main_text(pages.limit(0)).count() == 0


def test_boilerplate_kinds():
    page = """<body class=page><header class="site-header"><div>Site name</div></header><div class="cookie-notice"><p>We use cookies, as everyone does these days.</p></div>
    <div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><main><p>The first paragraph of the story, long enough to be read.</p><aside>Read also this</aside>
    <form><label>Mail</label><input><button>Send</button></form><div class="ad">Buy this now, it is cheap.</div><p>&Auml;nd the second &#8211; with&nbsp;more words in it.</p>
    <section class="comments"><p>A reader writes a long comment about the story above.</p></section></main><div class=sidebar><p>Other stories that are popular here today.</p></div>
    <footer><p>Copyright by nobody at all.</p></footer></body>"""
    assert html_cut.main_text(page, html_cut.PRIOR) == "The first paragraph of the story, long enough to be read. Änd the second – with more words in it."


def test_cut_is_minimal():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        odds = [rng.choice([-2, -1, -0.5, 0.25, 0.5, 1, 2]) * rng.random() for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels):
            cut = sum(max(0, o) if not x else max(0, -o) for o, x in zip(odds, labels, strict=True))  # noqa: B023
            return cut + sum(w for i, j, w in edges if labels[i] != labels[j])  # noqa: B023

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(html_cut.minimum_cut(odds, edges)) - best) < 1e-9


def test_cut_of_a_chain_is_minimal():
    import random

    rng = random.Random(8)
    for n in (1, 2, 50, 3000):
        odds = [rng.uniform(-1, 1) for _ in range(n)]
        between = [rng.random() for _ in range(n - 1)]
        # The least cost of a chain whose last node is boilerplate, or content.
        low, high = max(0.0, odds[0]), max(0.0, -odds[0])
        for o, w in zip(odds[1:], between, strict=True):
            low, high = min(low, high + w) + max(0.0, o), min(high, low + w) + max(0.0, -o)
        labels = html_cut.minimum_cut(odds, [(i, i + 1, w) for i, w in enumerate(between)])
        cost = sum(max(0.0, -o) if x else max(0.0, o) for o, x in zip(odds, labels, strict=True))
        cost += sum(w for w, a, b in zip(between, labels, labels[1:], strict=False) if a != b)
        assert cost == pytest.approx(min(low, high))


def without_marks(page):
    import re

    bare = re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(?:nav|footer|header|article|aside|main|section)\b[^>]*>", r"<\1div>", bare)


def test_the_cut_labels_pages_that_say_nothing_of_themselves(spark):
    """Learned on pages with their marks; then blocks of other pages, with and without their marks, by terminals alone and by the cut."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    weights = html_cut.fit(pages)
    sample = {r[0] for r in pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(html_cut.SAMPLE_PAGES).collect()}
    moved = alone = cut = total = 0
    for r in pages.collect():
        if r["page_id"] in sample:
            continue
        marked, bare = html_cut.parse(r["html"]), html_cut.parse(without_marks(r["html"]))
        article = [bool(b.node.flags & html_cut.ARTICLE and not b.node.flags & html_cut.NEGATIVE) for b in marked]
        assert html_cut.minimum_cut(*html_cut.graph(marked, weights))[: len(marked)] == article
        odds, edges = html_cut.graph(bare, weights)
        assert len(odds) == len(bare) == len(marked)  # no element says what it is
        found = html_cut.minimum_cut(odds, edges)
        moved += sum(f != (o > 0) for f, o in zip(found, odds, strict=True))
        alone += sum(a != (o > 0) for a, o in zip(article, odds, strict=True))
        cut += sum(a != f for a, f in zip(article, found, strict=True))
        total += len(bare)
    print(total, moved, alone, cut)
    assert moved > 0 and cut < alone < 0.001 * total


def test_long_pages_take_time_in_proportion():
    import time

    def seconds(n):
        page, begin = "<div>a</div><p>b c</p>" * n, time.perf_counter()
        html_cut.main_text(page, html_cut.PRIOR)
        return time.perf_counter() - begin

    assert min(seconds(5_000) for _ in range(2)) < 2


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, PAGE).repartition(2)
    rows = arc_warc.archive_pages(pages).collect()
    assert len(rows) == len(PAGES)
    wanted = sorted((str(p[0]), len((p[2] or "").encode()), hashlib.sha1((p[2] or "").encode()).hexdigest()) for p in PAGES)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in rows) == wanted
    large = [r for r in rows if r["payload_bytes"] > 1000 and r["page_id"] in (6, 7, None)]
    originals = [r for r in large if r["record_type"] == "response"]
    assert len(originals) == 1 and originals[0]["page_id"] == 7
    assert all(r["refers_to"] == 7 and r["refers_to_record"] == originals[0]["record_id"] for r in large if r["record_type"] == "revisit")
    assert len({r["record_id"] for r in rows}) == len(PAGES)
    assert arc_warc.archive_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("archive_bytes", "revisit_bytes"), [(1 << 24, 1 << 26), (3_000, 200), (1, 1)])
def test_archives_of_few_bytes_and_odd_urls(spark, archive_bytes, revisit_bytes):
    """Records that look like headers, a large page, archives and revisits cut in several places: the same records."""
    same = "<p>" + "same " * 400 + "</p>"
    pages = [(i, f"filedesc://{i}.arc" if i % 3 else f"http://x/{i} a\tb", same if i % 2 else f"<p>{i}</p>") for i in range(30)]
    pages += [(30, "filedesc://9", "y" * (1 << 20)), (31, "WARC/1.1", "WARC/1.1\r\n\r\n\r\n"), (32, "", "1 0 tokenloom\n")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = {r["page_id"]: r for r in arc_warc.archive_pages(frame, archive_bytes=archive_bytes, revisit_bytes=revisit_bytes).collect()}
    assert len(rows) == len(pages)
    for page_id, url, html in pages:
        r = rows[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html.encode()).hexdigest())
        revisit = html == same and page_id != 29
        assert (r["record_type"], r["refers_to"]) == ("revisit" if revisit else "response", 29 if revisit else None)
        assert r["uri"] == (url.replace(" ", "%20").replace("\t", "%09") or "-")


def test_archives_end_before_their_bound():
    made = [b"x" * n for n in (40, 40, 40, 500, 1, 1)]
    rows = [b["value"][0].as_py() for b in arc_warc.archives((lambda _, m=m: m for m in made), 100)]
    assert [len(r) for r in rows] == [81, 40, 500, 3]


def test_arc_header_lines():
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    one = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 8\n1 0 me\n\n\nhttp://x/ 1.2.3.4 19970102030405 text/html %d\n%s\n" % (len(body), body)
    (r,) = arc_warc.read_arc(one)
    assert (r.uri, r.payload, r.warc_date, r.status) == ("http://x/", b"hello", "1997-01-02T03:04:05Z", None)
    two = b"filedesc://b.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 b.arc 8\n2 0 me\n\n\ndns:x 1.2.3.4 19970102030405 text/dns 200 abc - 77 b.arc 4\nabcd\n"
    (r,) = arc_warc.read_arc(two)
    assert (r.is_http, r.payload, r.status, r.mime) == (False, b"abcd", "200", "text/dns")
    text = arc_warc.warc_record(r, None) + b"\r\n\r\n"
    ((headers, block),) = arc_warc.read_warc(text)
    assert headers["warc-type"] == "resource" and block == b"abcd" and headers["warc-date"] == "1997-01-02T03:04:05Z"
    with pytest.raises(ValueError, match="header line"):
        list(arc_warc.read_arc(b"no length here\nxyz"))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(arc_warc.read_arc(b"filedesc://a.arc 0.0.0.0 1997 text/plain 6\n7 0 me"))
    for date, full in (("1996", "1996-01-01T00:00:00Z"), ("199607", "1996-07-01T00:00:00Z"), ("19960708091011", "1996-07-08T09:10:11Z")):
        (r,) = arc_warc.read_arc(b"http://x/ 1.2.3.4 %s text/html 2\nab\n" % date.encode())
        assert r.warc_date == full


def test_jaccard_family_of_texts_that_share_seven_tenths(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for i in range(30):  # each has words of its own in 14 places, which break 70 of some 400 n-grams
        own = list(base)
        for k in range(14):
            own[20 + 26 * k + rng.randrange(20)] = f"own{i}x{k}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    looked_at, verify = [], jaccard_join.verify

    def counted(pairs, *rest):
        looked_at.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verify", counted)
    found = jaccard_join.jaccard_groups(frame, width=5, share=80).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found)
    assert sum(looked_at) < 30  # of 435 pairs


def test_bitmaps_of_different_widths(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 300, 280, 2000)]
    frame = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            maps = [jaccard_join.bitmaps(s, np.zeros(len(s), dtype=np.int64), 1, w).ravel() for s, w in ((a, (4, 16, 8, 64)[i]), (b, (4, 16, 8, 64)[j]))]
            least = min(len(m) for m in maps)
            own = [jaccard_join.bitmaps(s, np.zeros(len(s), dtype=np.int64), 1, least).ravel() for s in (a, b)]
            apart = int(np.unpackbits((own[0] ^ own[1]).view(np.uint8)).sum())
            assert apart <= len(np.setxor1d(a, b))
            frame.append(([int(v) for v in maps[0]], [int(v) for v in maps[1]], apart))
    rows = spark.createDataFrame(frame, "x array<long>, y array<long>, apart int")
    assert rows.where(jaccard_join.bits_apart("x", "y") != rows["apart"]).count() == 0


@pytest.mark.parametrize("share", [80, 90])
def test_jaccard_family_meets_at_first_common_n_grams(spark, share):
    """Members of a family meet at many n-grams and pass at few of them; a pair that links passes at its first one, merged buckets or not."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(40):  # most break some 55 n-grams of 300; a few next to none
        own = list(base)
        for k in range(1 if i % 8 == 0 else 11):
            own[15 + 25 * k + rng.randrange(20)] = f"own{i}x{k}"
        texts.append(" ".join(own))
    values, at = jaccard_join.shingle_sets(pa.array(texts), 5)
    sets, sizes = [set(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)], np.diff(at)
    levels = np.minimum(np.bincount((values & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=1 << 20), 255).astype(np.uint8)
    ordered = values[jaccard_join.rare_first(values, np.repeat(np.arange(40), sizes), levels)]
    rows = []
    for i, (a, n) in enumerate(zip(at[:-1], sizes, strict=True)):
        prefix = ordered[a : a + int(jaccard_join.prefix_length(n, share))].view(np.int64)
        rows += [(int(g), i, int(n), p, [0] * 4, i) for p, g in enumerate(prefix)]
    frame = spark.createDataFrame(rows, "gram long, rep long, n int, pos int, bits array<long>, group long").cache()
    links = {(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])}
    assert links
    for placed in (frame, frame.join(jaccard_join.shared_buckets(frame, "pos").select("gram"), "gram")):
        others = placed.select("gram", *[F.col(c).alias(f"l_{c}") for c in ("rep", "n", "pos", "bits", "group")])
        met = [(r["rep"], r["l_rep"]) for r in placed.join(others, "gram").where(F.col("rep") > F.col("l_rep")).where(jaccard_join.may_link(share)).collect()]
        assert links <= set(met)
        assert len(met) < 780  # of 780 pairs, most of which meet at five n-grams or more


def test_the_rarest_n_gram_stands_for_those_of_the_same_classes(spark):
    rows = [(5, 1, 0), (1, 1, 3), (5, 2, 1), (1, 2, 4), (3, 2, 0), (3, 3, 0)]
    found = jaccard_join.shared_buckets(spark.createDataFrame(rows, "gram long, rep long, pos int"), "pos").collect()
    assert sorted((r["gram"], r["size"], r["weight"]) for r in found) == [(3, 2, 1), (5, 2, 2)]


def test_n_grams_are_counted_in_bounded_memory(monkeypatch):
    """Beside its two bytes a counter a task needs little, however much text a batch holds."""

    class Texts:
        def mapInArrow(self, count, schema):
            self.count = count
            return self

        def groupBy(self, *keys):
            return self

        def applyInArrow(self, add, schema):
            return self

        def collect(self):
            return []

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(2_000)]  # 7 MB
    batch = pa.RecordBatch.from_pydict({"text": texts})
    monkeypatch.setattr(jaccard_join, "TaskContext", Task)
    frame = Texts()
    jaccard_join.frequency_sketch(frame, 3)
    tracemalloc.start()
    try:
        sent = sum(b.num_rows for b in frame.count(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent == jaccard_join.PARTS
    assert peak < 2 * jaccard_join.COUNTERS + (40 << 20)


def test_n_grams_beyond_two_bytes_are_counted(spark):
    counters, often = 1 << 10, 150_000
    texts = spark.range(often, numPartitions=1).select(F.when(F.col("id") < often - 5, "a b c").otherwise("d e f").alias("text"))
    levels = jaccard_join.frequency_sketch(texts, 3, counters)
    (abc, def_), _ = jaccard_join.shingle_sets(pa.array(["a b c", "d e f"]), 3)
    expected = np.zeros(counters, dtype=np.uint8)
    for gram, times in ((abc, often - 5), (def_, 5)):
        expected[int(gram) & (counters - 1)] = 1 + int(4 * np.log2(times))
    assert levels.tolist() == expected.tolist()


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    texts = spark.range(4_000, numPartitions=1).select(F.repeat(F.lit("some words "), 400).alias("text"))  # 17 MB
    setting = session.BATCH_SETTING
    before = spark.conf.get(setting, None)
    with session.small_batches(spark):
        inside = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in inside) == 4_000
    assert max(r["bytes"] for r in inside) < 1.5 * session.BATCH_BYTES
    assert spark.conf.get(setting, None) == before
    spark.conf.set(setting, "1m")  # a caller's own bound stays
    try:
        with session.small_batches(spark):
            assert spark.conf.get(setting) == "1m"
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting)


def test_near_copies_are_sought_over_small_batches(spark, monkeypatch):
    seen, sketch = [], jaccard_join.frequency_sketch

    def looked(*args):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None))
        return sketch(*args)

    monkeypatch.setattr(jaccard_join, "frequency_sketch", looked)
    frame = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_groups(frame).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert int(seen[0]) <= 16 << 20
