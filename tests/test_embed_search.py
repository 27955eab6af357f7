import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import vectors
from tokenloom.operators import embed, evaluate, pieces, search
from tokenloom.session import materialize
from tests.conftest import texts


@pytest.fixture(scope="module")
def weights(spark, vocab):
    ids = [r.id for r in vocab.collect()]
    return spark.createDataFrame([(i, [float(3 * i), 3.0 * i + 1, 3.0 * i + 2]) for i in ids], "id int, vec array<float>").cache()


def vector_table(spark, matrix, name="doc_id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], f"{name} bigint, embedding array<double>")


@pytest.mark.parametrize("strategy", ["lookup", "mapped", "join"])
def test_static_encode_is_the_mean(spark, vocab, weights, strategy):
    df = texts(spark, "hello world hello", "", "walking", None, "a" * 101)
    table = {r.id: np.array(r.vec) for r in weights.collect()}
    ids = {r.doc_id: r.ids for r in pieces.encode_ids(df, vocab).collect()}
    rows = embed.static_encode(df, vocab, weights, strategy=strategy).collect()
    assert len(rows) == 5
    for row in rows:
        expected = np.mean([table[i] for i in ids[row.doc_id]], axis=0) if ids[row.doc_id] else np.zeros(3)
        np.testing.assert_allclose(row.embedding, expected, atol=1e-5)


def test_table_ids_without_a_row_do_not_count(spark, weights):
    df = spark.createDataFrame([(0, [1, 99_999]), (1, [99_999]), (2, [2, 3])], "doc_id bigint, ids array<int>")
    by_route = [
        [r.embedding for r in embed.pool_ids(df, weights, strategy=s).orderBy("doc_id").collect()] for s in ("lookup", "mapped", "join")
    ]
    assert by_route[0] == by_route[1] == by_route[2] == [[3.0, 4.0, 5.0], [0.0] * 3, [7.5, 8.5, 9.5]]


def test_filter_after_encoding_does_not_encode_twice(spark, vocab, weights):
    encoded = embed.static_encode(texts(spark, "hello"), vocab, weights)
    exploded = encoded.select("doc_id", F.explode("embedding"))
    plan = exploded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 2


def test_check_dims(spark):
    a, b = vector_table(spark, np.ones((2, 4))), vector_table(spark, np.ones((2, 3)))
    assert embed.check_dims(a, a) == 4
    with pytest.raises(ValueError, match="4 and 3"):
        embed.check_dims(a, b)
    with pytest.raises(ValueError, match="ragged"):
        embed.check_dims(a.union(b), a)


def test_align_and_init(spark, vocab, weights):
    old = {r.piece: r.id for r in vocab.collect()}
    new = spark.createDataFrame([("hello", 0), ("##walk", 1), ("walking", 2), ("zz", 3)], "piece string, id int")
    aligned = {r.piece: (r.ids, r.match_kind) for r in embed.align_vocab(new, vocab).collect()}
    assert aligned == {
        "hello": ([old["hello"]], "exact"),
        "##walk": ([old["walk"]], "stripped"),
        "walking": ([old["walk"], old["##ing"]], "encoded"),
        "zz": ([old["[UNK]"]], "encoded"),
    }
    start = {r.id: r.vec for r in embed.init_weights(embed.align_vocab(new, vocab), weights).collect()}
    assert start[2] == pytest.approx(np.mean([[3 * i, 3 * i + 1, 3 * i + 2] for i in aligned["walking"][0]], axis=0).tolist())
    prefixed = spark.createDataFrame([("_hello", 0)], "piece string, id int")
    assert embed.align_vocab(prefixed, vocab, word_prefix="_").first().match_kind == "stripped"


def test_embed_corpus(spark, vocab):
    def make_teacher():
        return lambda values: np.array([[len(v), v.count("l")] for v in values], dtype=np.float32)

    df = texts(spark, " hello world ", "walking walking", "").withColumn("lang", F.lit("en"))
    rows = embed.embed_corpus(df, make_teacher, 2, vocab, batch_size=2, max_length=4).orderBy("doc_id").collect()
    assert [(r.text, r.lang, r.embedding) for r in rows] == [
        ("hello world", "en", [11.0, 3.0]), ("walking", "en", [7.0, 1.0]), ("", "en", [0.0, 0.0])
    ]
    assert embed.embed_corpus(df, make_teacher, 2, vocab, batch_size=2, limit_batches=1).count() == 2
    with pytest.raises(Exception, match="the teacher returned"):
        embed.embed_corpus(df, make_teacher, 3, vocab).collect()


def test_route(spark):
    df = spark.createDataFrame([(0, "user"), (1, "bot"), (2, None)], "doc_id bigint, role string")
    fixed = lambda v: lambda d: d.withColumn("embedding", F.array(F.lit(v)))
    out = embed.route_encode(df, "role", "user", fixed(1.0), fixed(2.0))
    assert {r.doc_id: r.embedding for r in out.collect()} == {0: [1.0], 1: [2.0], 2: [2.0]}


def test_normalize_and_slices(spark):
    df = vector_table(spark, [[3.0, 4.0], [0.0, 0.0]])
    assert [r[0] for r in df.orderBy("doc_id").select(vectors.l2_normalize(F.col("embedding"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(vectors.slice_dims(F.col("embedding"), 1)).first()[0] == [3.0]
    assert df.select(F.avg(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))))).first()[0] == pytest.approx(0.3)


def brute_force(queries, documents, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.round(unit(queries) @ unit(documents).T, 6) + 0.0
    return {q: sorted(((-s, d) for d, s in enumerate(row)))[:k] for q, row in enumerate(scores)}


@pytest.mark.parametrize("grid", [False, True])
def test_nearest_k_equals_brute_force(spark, monkeypatch, grid):
    rng = np.random.default_rng(3)
    queries, documents = rng.normal(size=(40, 5)), rng.normal(size=(300, 5))
    # A third of the documents are copies: equal scores, split by id.
    documents[100:200] = documents[0]
    documents[299] = 0
    if grid:
        monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", 600)
    q, d = vector_table(spark, queries, "query_id"), vector_table(spark, documents).repartition(3)
    expected = brute_force(queries, documents, 7)
    found = search.nearest_k(q, d, 7).collect()
    assert len(found) == 40 * 7
    for row in found:
        assert (-row.score, row.doc_id) == expected[row.query_id][row["rank"] - 1]
    scores = search.cosine_scores(q, d, -1.0)
    assert scores.count() == 40 * 300
    high = {(r.query_id, r.doc_id): r.score for r in search.cosine_scores(q, d, 0.3).collect()}
    assert high == {(r.query_id, r.doc_id): r.score for r in scores.collect() if r.score >= 0.3}
    pairs = scores.where("(query_id + doc_id) % 7 = 0").select("query_id", "doc_id")
    assert all(r.score == pytest.approx(dict((d, -s) for s, d in brute_force(queries, documents, 300)[r.query_id])[r.doc_id], abs=2e-6) for r in search.pair_scores(pairs.where("query_id < 3"), q, d).collect())
    if not grid:
        # Documents stay where they are: the only exchange ranks the tasks' candidates.
        plan = search.nearest_k(q, d, 7)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(query_id") == 1 and plan.count("Exchange") <= 2
    assert search.nearest_k(q, d.limit(2), 7).count() == 80
    assert search.nearest_k(q.limit(0), d, 7).count() == 0


def test_ndcg(spark):
    hits = spark.createDataFrame(
        [("d", 0, 1, 1), ("d", 0, 2, 2), ("d", 1, 9, 1)], "dataset string, query_id int, doc_id int, rank int"
    )
    qrels = spark.createDataFrame(
        [("d", 0, 2, 1), ("d", 0, 5, 3), ("d", 1, 8, 1), ("d", 2, 8, 0)], "dataset string, query_id int, doc_id int, rel int"
    )
    row = evaluate.ndcg_at_k(hits, qrels).first()
    ideal = 3 + 1 / np.log2(3)
    assert row.n_queries == 2 and row.ndcg == pytest.approx((1 / np.log2(3) / ideal + 0) / 2)
    assert evaluate.mean_over_datasets(evaluate.ndcg_at_k(hits, qrels)).first()[0] == pytest.approx(row.ndcg)


def test_correlation(spark):
    pairs = [(0.1, 0.0), (0.4, 1.0), (0.4, 2.0), (0.9, 2.0), (0.2, 0.0)]
    df = spark.createDataFrame(pairs, "score double, gold double")
    row = evaluate.sts_correlation(df).first()
    ranks = np.array([[1, 1.5], [3.5, 3], [3.5, 4.5], [5, 4.5], [2, 1.5]])
    assert row.pearson == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])
    assert row.spearman == pytest.approx(np.corrcoef(ranks.T)[0, 1])


def test_compare_and_agree(spark):
    scores = spark.createDataFrame(
        [("a", "teacher", 0.7), ("a", "student", 0.5), ("b", "teacher", 0.6)], "dataset string, model string, score double"
    )
    rows = {r.dataset: r for r in evaluate.compare_models(scores).collect()}
    assert rows["a"].gap == pytest.approx(0.2) and rows["b"].student is None
    same = vector_table(spark, np.eye(4))
    assert evaluate.mean_agreement(same, same).first().mean_cosine == pytest.approx(1.0)
    q = same.withColumnRenamed("doc_id", "query_id")
    overlap = evaluate.teacher_agreement(q, same, q, same, 2)
    assert {r.overlap for r in overlap.collect()} == {1.0}


def test_both_routes_agree_on_doubles(spark):
    """Neither route rounds a table of doubles to floats: sums of these numbers are exact, so the results are equal bit by bit."""
    weights = spark.createDataFrame([(i, [1 + i * 2.0**-40, i * 2.0**-30]) for i in range(8)], "id int, vec array<double>")
    rows = spark.createDataFrame([(0, [1, 3]), (1, [0, 2, 5, 7]), (2, [4])], "doc_id long, ids array<int>")
    a, b, c = ({r.doc_id: r.embedding for r in embed.pool_ids(rows, weights, strategy=s).collect()} for s in ("lookup", "mapped", "join"))
    assert a == b == c and a[2] == [1 + 4 * 2.0**-40, 4 * 2.0**-30]


def test_lookup_past_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(embed, "MAX_BROADCAST_BYTES", 10)
    weights = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(8)], "id int, vec array<double>")
    with pytest.raises(ValueError, match="bound"):
        embed.pool_ids(spark.createDataFrame([(0, [1])], "doc_id long, ids array<int>"), weights, strategy="lookup")


def test_the_bound_counts_every_worker_and_the_tables_own_numbers(spark, monkeypatch):
    rows = [(i, [1.0, 2.0]) for i in range(8)]
    workers = spark.sparkContext.defaultParallelism
    for kind, number in (("float", 4), ("double", 8)):
        weights = spark.createDataFrame(rows, f"id int, vec array<{kind}>")
        size = 8 * (2 * number + 8)
        assert embed.table_bytes(weights) == (2, size)
        monkeypatch.setattr(embed, "MAX_BROADCAST_BYTES", size * workers)
        assert embed._choose(weights, "auto")[0] == "lookup"
        monkeypatch.setattr(embed, "MAX_BROADCAST_BYTES", size * workers - 1)
        assert embed._choose(weights, "auto")[0] == "mapped"
        monkeypatch.setattr(embed, "MAX_MAPPED_BYTES", size - 1)
        assert embed._choose(weights, "auto")[0] == "join"
        monkeypatch.undo()


def random_rows(spark, n_ids, rows, longest):
    """Rows of ids, one of them long, one empty, one null, some ids unknown."""
    draw = np.random.default_rng(3)
    lists = [draw.integers(0, n_ids + n_ids // 50 + 1, draw.integers(1, longest)).tolist() for _ in range(rows)]
    lists += [[], None, draw.integers(0, n_ids, 20 * longest).tolist()]
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartition(4).cache()


def test_many_ranges_and_small_steps_agree(spark, monkeypatch):
    """Rows of a task, ranges of the table and gathers all cut in several places."""
    for name, value in (("RANGE_BYTES", 400), ("SUM_BYTES", 100), ("GATHER_BYTES", 60)):
        monkeypatch.setattr(embed, name, value)
    weights = spark.createDataFrame([(3 * i, [float(i), 0.5, -1.0 / (i + 1)]) for i in range(200)], "id int, vec array<double>")
    rows = random_rows(spark, 600, 40, 30)
    by_route = [{r.doc_id: np.array(r.embedding) for r in embed.pool_ids(rows, weights, strategy=s).collect()} for s in ("lookup", "mapped", "join")]
    assert len(by_route[0]) == 43
    for key, value in by_route[0].items():
        np.testing.assert_allclose(by_route[1][key], value, atol=1e-12)
        np.testing.assert_allclose(by_route[2][key], value, atol=1e-12)


def test_a_table_of_the_published_size_encodes_in_place(spark):
    """107,962 rows of 1,024 floats: past what eight workers may each hold, so mapped range by range, without a shuffle."""
    n, dim = 107_962, 1_024
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(2001)) / 1000 - 1).cast("float"))
    weights = materialize(spark.range(n).select(F.col("id").cast("int").alias("id"), value.alias("vec")), "published")
    assert embed._choose(weights, "auto")[0] == "mapped"
    rows = random_rows(spark, n, 60, 50)
    pooled = embed.pool_ids(rows, weights)
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" in plan and "Broadcast" not in plan
    assert embed._SHARED[weights]["mapped"].ranges[0][1].shape[0] * 4 * dim <= 1.2 * embed.RANGE_BYTES
    assert "Exchange" not in plan.split("InMemoryRelation")[0]
    found = {r.doc_id: np.array(r.embedding) for r in pooled.collect()}
    keys, matrix = embed._ids_and_rows(weights, dim)
    for r in rows.collect():
        known = [i for i in r.ids or [] if i < n]
        expected = matrix[known].astype(np.float64).mean(axis=0) if known else np.zeros(dim)
        np.testing.assert_allclose(found[r.doc_id], expected, atol=1e-9)


def test_overlap_of_short_lists(spark):
    hits = spark.createDataFrame([(1, 5), (1, 6)], "query_id long, doc_id long")
    assert evaluate.list_overlap(hits, hits, 10).first().overlap == 1.0
    other = spark.createDataFrame([(2, 5)], "query_id long, doc_id long")
    assert {r.query_id: r.overlap for r in evaluate.list_overlap(hits, other, 10).collect()} == {1: 0.0, 2: 0.0}


def test_best_scores_few_pairs(monkeypatch):
    """Documents that single precision rules out are not scored in double precision; copies and near ties are ranked as by brute force."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 24))
    documents = search.unit_rows(np.vstack([base, base[:50], base[:50] + 1e-7, rng.normal(size=(7_500, 24))]))
    queries, ids = search.unit_rows(base[:80]), rng.permutation(8_000).astype(np.int64)
    scored = []

    def counted(q, d, plain=search._scores):
        scored.append(len(q) * len(d))
        return plain(q, d)

    monkeypatch.setattr(search, "_scores", counted)
    best = search.Best(queries, 5)
    for begin in range(0, len(ids), search.CHUNK_ROWS):
        part = slice(begin, begin + search.CHUNK_ROWS)
        best.add(ids[part], documents[part])
    every = np.round(queries @ documents.T, search.SCORE_DIGITS) + 0.0
    order = np.lexsort((np.broadcast_to(ids, every.shape), -every), axis=1)[:, :5]
    assert (best.ids == ids[order]).all()
    assert np.array_equal(best.scores, np.take_along_axis(every, order, axis=1))
    assert sum(scored) < every.size / 4


def test_blocks_work_documents_out_once(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", 400)
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    queries = plain.limit(40).withColumnRenamed("doc_id", "query_id")
    found = search.nearest_k(queries, plain.mapInArrow(counting, plain.schema), 3)
    assert {(r.query_id, r.doc_id, r.rank) for r in found.collect()} >= {(i, i, 1) for i in range(40)}
    assert read.value == 60
