import numpy as np
import pytest
from pyspark.sql import Observation

from tokenloom.operators import distill, embed


def pairs(spark, student, teacher, batch=None):
    rows = [
        (i, 0 if batch is None else batch[i], [float(v) for v in s], [float(v) for v in t])
        for i, (s, t) in enumerate(zip(student, teacher))
    ]
    return spark.createDataFrame(rows, "doc_id bigint, batch_id bigint, student array<double>, teacher array<double>")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def contrastive(student, teacher, tau=0.07):
    sim = unit(student) @ unit(teacher[:, : student.shape[1]]).T / tau
    return np.mean(np.log(np.exp(sim).sum(axis=1)) - np.diag(sim))


def test_losses(spark):
    rng = np.random.default_rng(0)
    student, teacher = rng.normal(size=(20, 4)), rng.normal(size=(20, 6))
    df = pairs(spark, student, teacher)
    expected = 1 - np.mean(np.sum(unit(student) * unit(teacher[:, :4]), axis=1))
    assert distill.cosine_loss(df).first().loss == pytest.approx(expected)
    assert distill.contrastive_loss(df).first().loss == pytest.approx(contrastive(student, teacher))
    zero = pairs(spark, np.zeros((1, 4)), np.ones((1, 4)))
    assert distill.cosine_loss(zero).first().loss == pytest.approx(1.0)


def test_contrastive_loss_of_a_batch_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(distill, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    student, teacher = rng.normal(size=(90, 4)), rng.normal(size=(90, 4))
    batch = [0] * 60 + [1] * 30
    found = {r.batch_id: r.loss for r in distill.contrastive_loss(pairs(spark, student, teacher, batch)).collect()}
    assert found[0] == pytest.approx(contrastive(student[:60], teacher[:60]))
    assert found[1] == pytest.approx(contrastive(student[60:], teacher[60:]))
    with pytest.raises(ValueError, match="tau"):
        distill.contrastive_loss(pairs(spark, student, teacher), tau=0.001)


def test_matryoshka(spark):
    assert distill.matryoshka_dims(64) == [16, 32, 64]
    assert distill.matryoshka_dims(1024) == [16, 32, 64, 128, 256, 512, 1024]
    assert distill.matryoshka_dims(16) == [16] and distill.matryoshka_dims(3) == [3]
    rng = np.random.default_rng(2)
    student, teacher = rng.normal(size=(12, 40)), rng.normal(size=(12, 40))
    df = pairs(spark, student, teacher)
    for loss, fn in (("distillation_cosine", contrastive),):
        found = distill.matryoshka_loss(df, loss)
        expected = {d: fn(student[:, :d], teacher[:, :d]) for d in (16, 32, 40)}
        assert {r.dim: r.loss for r in found.collect()} == pytest.approx(expected)
        assert distill.matryoshka_total(found).first().loss == pytest.approx(sum(expected.values()))
    assert {r.dim for r in distill.matryoshka_loss(df).collect()} == {16, 32, 40}


def test_unknown_loss_lists_the_valid_ones():
    with pytest.raises(ValueError, match="cosine.*distillation_cosine"):
        distill.select_loss("other")


def test_learning_rate():
    rates = [distill.learning_rate(s, 100, 1.0) for s in range(101)]
    assert rates[0] == 0 and rates[5] == pytest.approx(0.5) and rates[10] == pytest.approx(1.0)
    assert rates[100] == pytest.approx(0.1) and all(a >= b for a, b in zip(rates[10:], rates[11:]))


def training(spark, dim=20, n=12, vocab=9):
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, vocab, size=rng.integers(1, 6)).tolist() for _ in range(n)]
    table, teacher = rng.normal(size=(vocab, dim)), rng.normal(size=(n, dim))
    rows = spark.createDataFrame(
        [(i, ids[i], [float(v) for v in teacher[i]]) for i in range(n)], "doc_id bigint, ids array<int>, teacher array<double>"
    )
    weights = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(table)], "id int, vec array<double>")
    return ids, table, teacher, rows, weights


@pytest.mark.parametrize("loss", distill.LOSSES)
def test_gradient_equals_finite_differences(spark, loss):
    ids, table, teacher, rows, weights = training(spark)
    dims = [16, 20]

    def value(w):
        total = 0.0
        pooled = np.array([w[i].mean(axis=0) for i in ids])
        for d in dims:
            s, t = pooled[:, :d], teacher[:, :d]
            total += contrastive(s, t) if loss == "distillation_cosine" else 1 - np.mean(np.sum(unit(s) * unit(t), axis=1))
        return total

    moved = distill.gradient_step(rows, weights, 1.0, len(ids), loss, dims)
    after = np.array([r.vec for r in moved.orderBy("id").collect()])
    # The table travels as floats, hence the tolerance.
    for token, pos in [(0, 0), (3, 5), (8, 19), (4, 16)]:
        eps = 1e-5
        up, down = table.copy(), table.copy()
        up[token, pos] += eps
        down[token, pos] -= eps
        slope = (value(up) - value(down)) / (2 * eps)
        assert table[token, pos] - after[token, pos] == pytest.approx(slope, abs=2e-5)


@pytest.mark.parametrize("loss", distill.LOSSES)
def test_fitting_lowers_the_loss(spark, loss):
    ids, table, teacher, rows, weights = training(spark, n=16)
    settings = distill.FitSettings(loss=loss, steps=4, parts=2, lr=0.5, matryoshka=False)
    vectors = rows.selectExpr("doc_id", "teacher AS embedding")
    fitted = distill.fit_weights(rows.select("doc_id", "ids"), vectors, weights, settings)

    def loss_of(w):
        pooled = embed.pool_ids(rows, w).withColumnRenamed("embedding", "student").selectExpr("*", "0 AS batch_id")
        fn = distill.cosine_loss if loss == "cosine" else distill.contrastive_loss
        return fn(pooled).first().loss

    assert fitted.count() == len(table)
    assert loss_of(fitted) < loss_of(weights)
    with pytest.raises(ValueError, match="no rows"):
        distill.fit_weights(rows.select("doc_id", "ids").limit(0), vectors, weights)


def test_two_stages(spark):
    *_, rows, weights = training(spark)
    data = (rows.select("doc_id", "ids"), rows.selectExpr("doc_id", "teacher AS embedding"))
    quick = distill.FitSettings(steps=1)
    assert distill.fit_two_stages(data, data, weights, quick, quick).count() == weights.count()


def batch_of(spark, rng, sizes, dim, teacher_dim):
    n = sum(sizes)
    student, teacher = rng.normal(size=(n, dim)), rng.normal(size=(n, teacher_dim))
    batch = np.repeat(np.arange(len(sizes)), sizes)
    order = rng.permutation(n)
    df = pairs(spark, student[order], teacher[order], batch[order].tolist()).repartition(5)
    return student, teacher, batch, df


@pytest.mark.parametrize("batch_rows", [None, 7])
def test_many_small_batches_of_several_sizes(spark, batch_rows):
    """Segments of one table: sizes 1 to 7, batches broken off by Arrow tables, two prefix lengths."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 8, 60).tolist()
    student, teacher, batch, df = batch_of(spark, rng, sizes, 20, 24)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = {(r.batch_id, r.dim): r.loss for r in distill.contrastive_loss(df, batch_rows=batch_rows, dims=[16, 20]).collect()}
        rows = distill.contrastive_rows(df, "batch_id", "doc_id", "student", "teacher", batch_rows=batch_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == 2 * len(sizes)
    for b in range(len(sizes)):
        own = batch == b
        for d in (16, 20):
            assert found[b, d] == pytest.approx(contrastive(student[own][:, :d], teacher[own][:, :d]))
    assert len(rows) == len(batch) and all(len(r.expected) == 20 for r in rows)


def test_large_and_small_batches_together(spark, monkeypatch):
    rng = np.random.default_rng(9)
    student, teacher, batch, df = batch_of(spark, rng, [70, 5, 1, 40, 12], 6, 6)
    whole = {r.doc_id: (r.loss, r.expected) for r in distill.contrastive_rows(df, "batch_id", "doc_id", "student", "teacher").collect()}
    monkeypatch.setattr(distill, "BLOCK_ROWS", 16)
    cut = {r.doc_id: (r.loss, r.expected) for r in distill.contrastive_rows(df, "batch_id", "doc_id", "student", "teacher").collect()}
    assert set(whole) == set(cut) and len(cut) == len(batch)
    for key, (loss, expected) in whole.items():
        assert cut[key][0] == pytest.approx(loss)
        np.testing.assert_allclose(cut[key][1], expected, atol=1e-12)
    by_dim = {(r.batch_id, r.dim): r.loss for r in distill.contrastive_loss(df, dims=[3, 6]).collect()}
    assert by_dim[0, 3] == pytest.approx(contrastive(student[:70, :3], teacher[:70, :3])) and len(by_dim) == 10


def test_a_broken_off_fit_goes_on(spark, tmp_path):
    *_, rows, weights = training(spark, n=20)
    tokens, teacher = rows.select("doc_id", "ids"), rows.selectExpr("doc_id", "teacher AS embedding")
    settings = distill.FitSettings(steps=5, parts=2, lr=0.5)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    calls = []

    def measure(table):
        calls.append(table.count())
        return {"rows": float(calls[-1]), "largest": table.selectExpr("max(array_max(vec)) AS m").first().m}

    plain = distill.fit_weights(tokens, teacher, weights, settings)
    unbroken = distill.fit_weights(tokens, teacher, weights, settings, folder=whole, measure=measure)
    assert len(calls) == 5
    distill.fit_weights(tokens, teacher, weights, settings, folder=broken, measure=measure, stop_after=2)

    def fails(table):
        raise RuntimeError("broken off")

    with pytest.raises(RuntimeError, match="broken off"):  # the third step's table is written, but does not count
        distill.fit_weights(tokens, teacher, weights, settings, folder=broken, measure=fails)
    assert distill.fit_history(spark, broken).count() == 2
    resumed = distill.fit_weights(tokens, teacher, weights, settings, folder=broken, measure=measure)
    tables = [{r.id: np.array(r.vec) for r in t.collect()} for t in (plain, unbroken, resumed)]
    for other in tables[1:]:
        assert set(other) == set(tables[0])
        for key, value in tables[0].items():
            np.testing.assert_allclose(other[key], value, atol=1e-12)
    histories = [[(r.step, r.rate, round(r.loss, 9), r.measures["rows"]) for r in distill.fit_history(spark, f).orderBy("step").collect()] for f in (whole, broken)]
    assert histories[0] == histories[1] and [h[0] for h in histories[0]] == [1, 2, 3, 4, 5]
    calls.clear()
    assert distill.fit_weights(tokens, teacher, weights, settings, folder=broken, measure=measure).count() == weights.count()
    assert not calls  # nothing was left to do
    with pytest.raises(ValueError, match="other settings"):
        distill.fit_weights(tokens, teacher, weights, distill.FitSettings(steps=5, parts=3), folder=broken)
    assert distill.fit_history(spark, str(tmp_path / "none")).count() == 0


def test_a_step_in_one_worker_equals_the_step_by_columns(spark, monkeypatch):
    """Ids that repeat, ids without a vector, a row without ids; by counts and by gathering."""
    rng = np.random.default_rng(11)
    ids = [rng.integers(0, 12, size=rng.integers(1, 60)).tolist() for _ in range(40)] + [[]]
    table, teacher = rng.normal(size=(9, 20)), rng.normal(size=(41, 24))
    rows = spark.createDataFrame([(i, ids[i], teacher[i].tolist()) for i in range(41)], "doc_id bigint, ids array<int>, teacher array<double>")
    weights = spark.createDataFrame([(2 * i, r.tolist()) for i, r in enumerate(table)], "id int, vec array<double>")
    found = []

    def refused(*a):
        raise AssertionError("the ids left the JVM a second time")

    for cells, held in ((16, 128 << 20), (0, 128 << 20), (16, 0)):
        monkeypatch.setattr(embed, "CELLS_AN_ID", cells)
        monkeypatch.setattr(distill, "MAX_HELD_BYTES", held)
        with monkeypatch.context() as m:
            if held:
                m.setattr(distill, "_token_sums", refused)
            seen = Observation()
            moved = distill.gradient_step(rows, weights, 1.0, len(ids), dims=[16, 20], seen=seen)
            found.append(({r.id: np.array(r.vec) for r in moved.collect()}, seen.get["loss"]))
    for other, loss in found[:2]:
        assert loss == pytest.approx(found[2][1]) and set(other) == set(found[2][0])
        for key, value in found[2][0].items():
            np.testing.assert_allclose(other[key], value, atol=1e-9)
