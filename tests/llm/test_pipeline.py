"""The pipeline against a brute-force version of each stage on its own input."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import mixing, zstd_quality
from tokenloom.llm.common import crc_mod
from tokenloom.session import materialize


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def corpus():
    rng = random.Random(11)
    names = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(700)]
    plain = [" ".join(rng.choice(names) for _ in range(rng.randint(15, 90))) for _ in range(150)]
    item = " ".join(rng.choice(names) for _ in range(14))
    texts = list(plain)
    texts += [t.capitalize() for t in plain[:20]]
    for t in plain[20:40]:
        w = (t + " " + t[::-1]).split()
        texts += [" ".join(w), " ".join([*w[:-1], "other"])]
    texts += [" ".join([*plain[i].split()[:9], item, "end"]) for i in range(40, 46)]
    texts += [" | ".join(rng.choice(names).upper() + "!!" for _ in range(60)) for _ in range(60)]
    texts += [None, "", " "]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int("!!" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2 and t]
    return docs, labels, [(1, item), (2, "never found in any of these documents at all, whatever happens")]


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    sf_dir = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs, columns = [], frame.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = frame.collect()
        inputs.append({r["doc_id"]: r for r in rows})
        assert len(inputs[-1]) == len(rows)
        if name != "mixing":
            assert stage(spark, frame, sf_dir).columns == columns
        frame = materialize(stage(spark, frame, sf_dir), name)
    whole, good, exact, near, clean = inputs

    judged = zstd_quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 4) != 2)
    assert set(good) == {r["doc_id"] for r in judged.collect() if r["predicted"] == 1}
    plain = [i for i, r in whole.items() if r["text"] and len(r["text"]) > 80 and "!!" not in r["text"]]
    assert len(set(plain) - set(good)) <= len(plain) // 50 and not any("!!" in (r["text"] or "") for r in good.values())

    assert set(exact) == {max(j for j, o in good.items() if lower(o["text"]) == lower(r["text"])) for r in good.values()}

    width, share = corpus_pipeline.NEAR_WIDTH, corpus_pipeline.NEAR_SHARE

    def shingles(text):
        w = lower(text).split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: shingles(r["text"]) for i, r in exact.items()}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert set(near) == set(group.values())

    window = " ".join(items[0][1].split()[:10])
    assert set(clean) == {i for i, r in near.items() if window not in " ".join(re.findall("[0-9a-z]+", lower(r["text"])))}

    sizes, taken = {}, {}
    for r in clean.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(lower(r["text"]).split())
    for r in frame.collect():
        assert r["text"] == clean[r["doc_id"]]["text"]
        taken[r["source"]] = taken.get(r["source"], 0) + len(lower(r["text"]).split())
    target = dict(zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)]), strict=True))
    assert all(abs(taken[s] / target[s] - 1) < 0.02 for s in sizes)


def test_empty_documents(spark, tmp_path):
    docs, labels, items = corpus()
    sf_dir = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").limit(0).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_near_copies_by_five_words(spark):
    """Copies of 80 % by five words that are below 90 % by three."""
    first = [f"a{i}" for i in range(500)]
    second = [f"b{i}" for i in range(1000)]
    spread = [f"new{i}" if i % 50 == 25 else w for i, w in enumerate(first)]
    block = [f"new{i}" if 300 <= i < 390 else w for i, w in enumerate(second)]
    far = [f"far{i}" if i % 40 == 25 else w for i, w in enumerate(first)]
    rows = [(i, " ".join(w)) for i, w in enumerate([first, spread, second, block, far])]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]
