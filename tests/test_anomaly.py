import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import metrics
from assayer.operators.features import COMPONENTS, Scaler, card_features, normals, random_scores
from assayer.operators.forest import ForestConfig, fit_forest, grow_tree, mean_path, tree_samples
from assayer.operators.identity import with_identity
from assayer.operators.reconstruct import AutoencoderConfig, _gradient, _initial, fit_autoencoder, fit_pca
from assayer.operators.supervised import fit_logistic
from assayer.operators.thresholds import best_f1, caught, flagged, review_budget, train_percentile
from assayer.plans.train import TrainConfig, train_and_compare
from assayer.sources.models import ModelBundle, ModelMissing, bundle_available, calibration_scores, load_bundle, save_bundle


def vectors(spark, x):
    rows = [(i, str(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "__position bigint, __row_key string, features array<float>").repartition(4)


def card(spark, n=2000, seed=0):
    rng = np.random.default_rng(seed)
    time, amount = np.sort(rng.uniform(0, 172800, n)), rng.gamma(2, 30, n)
    v = rng.normal(size=(n, 28))
    labels = (np.arange(n) % 50 == 7).astype(int)
    v[labels == 1, :5] += 4
    rows = [(i, float(time[i]), float(amount[i]), int(labels[i]), *map(float, v[i])) for i in range(n)]
    schema = "id bigint, Time double, Amount double, Class int, " + ", ".join(f"{c} double" for c in COMPONENTS)
    return with_identity(spark.createDataFrame(rows, schema).withColumn("__position", F.col("id")), ["id"])


def scores(spark, values, labels):
    return spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(zip(values, labels))],
                                 "__position bigint, score double, label int")


def test_features_and_midnight(spark):
    df = card(spark, 2).withColumn("Time", F.when(F.col("id") == 0, 86399.0).otherwise(86401.0)).withColumn("Amount", F.lit(-5.0))
    assert len(card_features()) == 31
    a, b = df.select(*[c.alias(n) for n, c in card_features().items() if n in ("log_amount", "hour_sin", "hour_cos")]).collect()
    assert abs(a["hour_sin"] - b["hour_sin"]) + abs(a["hour_cos"] - b["hour_cos"]) < 0.1 and a["log_amount"] == 0


def test_scaler_sees_only_its_rows(spark):
    df = card(spark, 400)
    scaler = Scaler.fit(normals(df, "Class"), card_features())
    plain = normals(df, "Class").toPandas()
    assert scaler.means[0] == pytest.approx(plain["V1"].mean())
    assert scaler.deviations[0] == pytest.approx(plain["V1"].std(ddof=0))
    with pytest.raises(ValueError):
        scaler.transform(df, {"V1": F.col("V1")})
    constant = Scaler.fit(df, {"c": F.lit(3.0)})
    assert constant.transform(df, {"c": F.lit(3.0)}).first()["features"] == [0.0]


def test_gradient(spark):
    sizes = [3, 4, 2, 4, 3]
    rng = np.random.default_rng(1)
    x, state = rng.normal(size=(5, 3)), _initial(sizes, 1)
    _, grad = _gradient(x, state.flat, sizes)
    for i in range(0, len(state.flat), 7):
        step = np.zeros_like(state.flat)
        step[i] = 1e-6
        slope = (_gradient(x, state.flat + step, sizes)[0] - _gradient(x, state.flat - step, sizes)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def trained(spark):
    """Rows on a three-dimensional plane in eight dimensions."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 8)) * 0.6
    config = AutoencoderConfig(hidden=(16,), latent=4, batch_size=64, max_epochs=40, lr=3e-3, workers=2, passes=1)
    return x, config, fit_autoencoder(vectors(spark, x), 8, config)


def test_autoencoder_learns_and_explains(spark, trained):
    x, config, model = trained
    assert model.history[-1][2] < 0.5 * model.history[0][2] and model.best_epoch > 5
    odd = x[:200].copy()
    odd[:, 3] += 15
    inlying = model.score(vectors(spark, x)).agg(F.median("score")).first()[0]
    outlying = model.score(vectors(spark, odd)).agg(F.median("score")).first()[0]
    assert outlying > 10 * inlying
    explained = model.explain(vectors(spark, odd)).collect()
    worst = [int(np.argmax(r["errors"])) for r in explained]
    assert max(set(worst), key=worst.count) == 3
    assert explained[0]["score"] == pytest.approx(np.mean(explained[0]["errors"]))


def test_autoencoder_does_not_depend_on_the_layout(spark, trained, monkeypatch):
    from assayer.operators import reconstruct
    x, _, _ = trained
    df = vectors(spark, x)
    for short in (AutoencoderConfig(hidden=(16,), latent=4, batch_size=64, max_epochs=4, workers=5, passes=2),
                  AutoencoderConfig(hidden=(16,), latent=4, batch_size=64, max_epochs=2, workers=18, passes=1, dropout=0.2)):
        models = [fit_autoencoder(df.repartition(n), 8, short) for n in (1, 4, 7)]
        assert all(np.array_equal(models[0].flat, m.flat) for m in models[1:])
        assert [h[0] for h in models[0].history] == list(range(short.passes, short.max_epochs + 1, short.passes))


def test_worker_chunks_do_not_follow_batches(trained, monkeypatch):
    from assayer.operators import reconstruct
    x, held = trained[0].astype(np.float32), np.arange(3000) % 10 == 0
    config, sizes = AutoencoderConfig(hidden=(16,), latent=4, batch_size=64, passes=2), [8, 16, 4, 16, 8]
    monkeypatch.setattr(reconstruct, "CHUNK_ROWS", 700)
    results = []
    for size in (3000, 1, 641):
        worker = reconstruct._Worker(3, _initial(sizes, 1), 1e-3, config, sizes, 1)
        for i in range(0, 3000, size):
            worker.take(x[i:i + size], held[i:i + size])
        results.append(worker.result().to_pylist()[0])
    assert results[0]["rows"] == 2700 and results[0]["val_rows"] == 300
    assert all(r["state"] == results[0]["state"] for r in results)


def test_dropout_gradient():
    sizes, x = [3, 6, 2, 6, 3], np.random.default_rng(1).normal(size=(50, 3))
    flat = _initial(sizes, 1).flat

    def loss(at):
        return _gradient(x, at, sizes, np.random.default_rng(5), 0.4)

    grad = loss(flat)[1]
    assert loss(flat)[0] != _gradient(x, flat, sizes)[0]
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert grad[i] == pytest.approx((loss(flat + step)[0] - loss(flat - step)[0]) / 2e-6, abs=1e-5)


def test_pca(spark, trained):
    x = trained[0]
    model = fit_pca(vectors(spark, x), 3)
    assert model.score(vectors(spark, x)).agg(F.max("score")).first()[0] < 1e-6
    assert model.score(vectors(spark, x + np.eye(8)[2] * 5)).agg(F.min("score")).first()[0] > 0.1


def test_mean_path():
    assert mean_path(np.array([1, 2, 256])) == pytest.approx([0.0, 1.0, 10.244770920])


def test_tree_keeps_short_leaves():
    x = np.array([[0.0], [0.0], [0.0], [9.0]])
    feature, threshold, path = grow_tree(x, 3, np.random.default_rng(0))
    assert path[2] == 1.0 and path[1] == pytest.approx(1 + mean_path(3))
    assert set(path[7:11]) == {path[1]} and set(path[11:15]) == {path[2]}


def test_forest(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1500, 5)), rng.normal(size=(15, 5)) + 7])
    df = vectors(spark, x)
    config = ForestConfig(trees=60, sample=256)
    model = fit_forest(df, config)
    got = {r["__position"]: r["score"] for r in model.score(df).collect()}
    assert all(0 < s < 1 for s in got.values())
    assert np.mean([got[i] for i in range(1500, 1515)]) > np.mean([got[i] for i in range(1500)]) + 0.15
    again = fit_forest(df.repartition(7), config)
    assert np.array_equal(model.path, again.path)


def test_forest_samples(spark):
    df = vectors(spark, np.zeros((5000, 1)))
    samples, size = tree_samples(df, ForestConfig(trees=20, sample=100), 5000)
    assert size == 100
    assert all(100 <= r["count"] < 300 for r in samples.groupBy("tree").count().collect())
    samples, _ = tree_samples(df, ForestConfig(trees=3, sample=100), 50_000)  # as if the table were larger
    assert samples.count() > 0
    assert tree_samples(df, ForestConfig(trees=2, sample=9000), 5000)[0].count() == 10_000


def test_budget_and_percentile(spark):
    ramp = spark.range(10_000).select((F.col("id") / 9999).alias("score"))
    threshold = review_budget(ramp)
    assert abs(ramp.filter(F.col("score") >= threshold.value).count() - 50) <= 2
    assert (threshold.name, threshold.is_oracle) == ("budget@0.50%", False)
    assert train_percentile(ramp).name == "train_p99"


def test_best_f1_takes_the_lowest_tie(spark):
    oracle = best_f1(scores(spark, [4, 3, 2, 1], [1, 0, 0, 1]))
    assert oracle.is_oracle and oracle.value == 1.0  # F1 is 2/3 at both 4 and 1
    rng = np.random.default_rng(5)
    s = rng.random(500)
    assert best_f1(scores(spark, s, s > 0.9)).value == pytest.approx(s[s > 0.9].min())


def test_metrics_by_hand(spark):
    df = scores(spark, [0.9, 0.8, 0.8, 0.4, 0.1], [1, 0, 1, 0, 1])
    row = metrics.ranking_metrics(df).first()
    assert row["pr_auc"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert row["roc_auc"] == pytest.approx((2 + 1 + 0.5 + 0) / 6)
    full = metrics.evaluate_scores(df, review_budget(df, 0.25)).first()
    assert full["alerts"] == full["true_positives"] + full["false_positives"]
    assert full["review_hours"] == pytest.approx(full["alerts"] * 90 / 3600)
    assert full["precision_at_5"] == pytest.approx(0.6) and full["recall_at_5"] == 1.0
    none = metrics.confusion(df, 5.0).first()
    assert (none["precision"], none["f1"], none["review_hours_per_fraud_found"]) == (0.0, 0.0, float("inf"))
    assert caught(flagged(df, 0.8)).first().asDict() == {"n_labelled_positives": 3, "n_caught": 2}


def test_random_scores_have_base_rate_precision(spark):
    df = spark.range(20_000).select(F.col("id").alias("__position"), (F.col("id") % 100 == 0).cast("int").alias("label"))
    row = metrics.ranking_metrics(random_scores(df, F.col("__position"))).first()
    assert abs(row["pr_auc"] - row["prevalence"]) < 0.006


def test_bootstrap_replicates_against_a_plain_version(spark):
    rows = [(i, 0.5 if i % 3 == 0 else float(i % 37), int(i % 5 == 0)) for i in range(400)] + [(900, None, 1)]
    df = spark.createDataFrame(rows, "k long, score double, label int")
    want, keys = {}, [str(k) for k, _, _ in rows]
    weights = metrics.poisson_weights(keys, 25, 7)
    for r in range(25):
        w = weights[:, r]
        area = pos = n = 0.0
        for s in sorted({float("-inf") if s is None else s for _, s, _ in rows}, reverse=True):
            at = [i for i, row in enumerate(rows) if (float("-inf") if row[1] is None else row[1]) == s]
            n, mine = n + w[at].sum(), sum(int(w[i]) * rows[i][2] for i in at)
            pos += mine
            area += mine * pos / max(n, 1)
        above = sum(int(w[i]) for i, (_, s, y) in enumerate(rows) if y and s is not None and s >= 20.0)
        want[r] = (area / pos, above / pos, int(pos))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (1, 6):
            got = metrics.bootstrap_replicates(df.repartition(parts), 20.0, F.col("k"), 25, 7).collect()
            assert {r.replicate: (pytest.approx(r.pr_auc), pytest.approx(r.recall), r.positives) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bootstrap_brackets_the_estimate(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(600) < 0.2).astype(int)
    df = scores(spark, rng.random(600) + 0.5 * y, y)
    row = metrics.bootstrap_interval(df, 0.9, F.col("__position"), 60).first()
    ap = metrics.ranking_metrics(df).first()["pr_auc"]
    assert row["pr_auc_low"] < ap < row["pr_auc_high"] and row["n_resamples"] == 60
    assert 0 < row["recall_low"] < row["recall_high"] <= 1


def test_logistic_separates(spark):
    df = card(spark, 1500)
    x = Scaler.fit(df, card_features()).transform(df, card_features(), ["Class"])
    scored = fit_logistic(x, "Class").score(x).withColumn("label", F.col("Class"))
    assert metrics.ranking_metrics(scored).first()["roc_auc"] > 0.98
    with pytest.raises(ValueError):
        fit_logistic(normals(x, "Class"), "Class")


def test_train_compare_save_and_load(spark, tmp_path):
    config = TrainConfig(autoencoder=AutoencoderConfig(max_epochs=6, batch_size=256),
                         forest=ForestConfig(trees=20, sample=256), resamples=12)
    result = train_and_compare(card(spark), card_features(), "Class", "Time", "id", config)
    table = {r["model"]: r for r in result.table.collect()}
    assert len(table) == 7
    assert table["Logistic Regression (supervised ceiling)"]["pr_auc"] > table["Random (floor)"]["pr_auc"] + 0.3
    assert all(r["overstatement"] >= -1e-12 for r in result.overstatement().collect())
    assert result.train_percentile_demo.first()["threshold_name"] == "train_p99"
    folder = str(tmp_path / "model")
    assert not bundle_available(spark, folder)
    with pytest.raises(ModelMissing):
        load_bundle(spark, folder)
    save_bundle(spark, result.bundle, folder)
    loaded = load_bundle(spark, folder)
    df = loaded.scaler.transform(card(spark, 50, seed=9), card_features())
    for a, b in ((result.bundle.autoencoder, loaded.autoencoder), (result.bundle.forest, loaded.forest)):
        one, two = ([round(r["score"], 9) for r in m.score(df).orderBy("__position").collect()] for m in (a, b))
        assert one == two
    assert calibration_scores(loaded, "autoencoder").count() == 400
    assert calibration_scores(loaded, "unknown") is None
    assert calibration_scores(ModelBundle(loaded.scaler, loaded.autoencoder), "autoencoder") is None


def test_a_task_orders_slices_of_a_worker(spark, trained, monkeypatch):
    from assayer.operators import reconstruct
    df = vectors(spark, trained[0])
    short = AutoencoderConfig(hidden=(16,), latent=4, batch_size=64, max_epochs=4, workers=3, passes=2)
    whole = fit_autoencoder(df, 8, short)
    monkeypatch.setattr(reconstruct, "SLICE_ROWS", 100)
    sizes = reconstruct.dealt_to_workers(df, short).groupBy("worker", "slice").agg(F.sum("rows").alias("n")).collect()
    assert len(sizes) == 30 and sum(r["n"] for r in sizes) == 3000 and max(r["n"] for r in sizes) < 200
    assert np.array_equal(fit_autoencoder(df, 8, short).flat, whole.flat)


def counted_rounds(monkeypatch):
    """(rows trained on, held-out rows) of every round that a fit runs."""
    from assayer.operators import reconstruct
    seen, plain = [], reconstruct._one_row

    def counting(parts, workers):
        row = plain(parts, workers)
        seen.append((row["rows"], row["val_rows"]))
        return row

    monkeypatch.setattr(reconstruct, "_one_row", counting)
    return seen


def test_no_round_is_trained_that_cannot_change_the_model(spark, trained, monkeypatch):
    df = vectors(spark, trained[0]).persist()
    short = dict(hidden=(16,), latent=4, batch_size=64, lr=3e-3, workers=3, passes=2)
    one = fit_autoencoder(df, 8, AutoencoderConfig(max_epochs=2, **short))
    seen = counted_rounds(monkeypatch)
    near = fit_autoencoder(df, 8, AutoencoderConfig(max_epochs=40, min_delta=5.0, **short))  # any loss is within it
    assert [n > 0 for n, _ in seen] == [True, False] and near.best_epoch == 2 and near.history[0][2] < 5.0
    assert np.array_equal(near.flat, one.flat)
    for settings in (dict(max_epochs=8), dict(max_epochs=40, patience=4, min_delta=0.05)):
        seen.clear()
        model = fit_autoencoder(df, 8, AutoencoderConfig(**settings, **short))
        assert sum(n > 0 for n, _ in seen) == len(model.history)  # none after the round that the last verdict is on
        assert not np.isnan(model.history[-1][2]) and len({v for _, v in seen}) == 1
    df.unpersist()


def test_a_verdict_of_its_own_changes_nothing(spark, trained, monkeypatch):
    df = vectors(spark, trained[0]).persist()
    short = dict(hidden=(16,), latent=4, batch_size=64, lr=3e-3, workers=3, passes=2, max_epochs=8)
    seen = counted_rounds(monkeypatch)
    plain = fit_autoencoder(df, 8, AutoencoderConfig(patience=8, **short))
    rounds = len(seen)
    eager = fit_autoencoder(df, 8, AutoencoderConfig(patience=2, min_delta=1e-9, **short))  # every round may be the last
    assert len(seen) - rounds > rounds and len(eager.history) == len(plain.history) == 4
    assert np.array_equal(plain.flat, eager.flat) and plain.history == eager.history
    df.unpersist()


def test_fit_without_held_out_rows(spark, trained, monkeypatch):
    seen = counted_rounds(monkeypatch)
    model = fit_autoencoder(vectors(spark, trained[0][:300]), 8, AutoencoderConfig(max_epochs=3, passes=1, workers=2, batch_size=64, val_fraction=0.0))
    assert [h[0] for h in model.history] == [1, 2, 3] and {v for _, v in seen} == {0} and all(n == 300 for n, _ in seen)


def test_scores_of_lists_by_block(spark, trained, monkeypatch):
    import pyarrow as pa
    from assayer.operators import reconstruct
    x, _, model = trained
    got = {r["__position"]: r["score"] for r in model.score(vectors(spark, x)).collect()}
    single = x.astype(np.float32).astype(np.float64)
    want = ((model.rebuild(single) - single) ** 2).mean(axis=1)
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-9, atol=0)
    monkeypatch.setattr(reconstruct, "CACHED_ROWS", 7)
    again = model.score(vectors(spark, x).repartition(2).filter("__position < 100"))
    assert np.allclose([r["score"] for r in again.orderBy("__position").collect()], want[:100], rtol=1e-9, atol=0)
    lists = pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0]], pa.list_(pa.float32()))
    assert np.array_equal(reconstruct._flat_matrix(lists.slice(1)), [[3.0, np.nan], [5.0, 6.0]], equal_nan=True)
    assert reconstruct._flat_matrix(lists.slice(3)).shape == (0, 0)


def test_dealt_rows_leave_their_position_behind(spark, trained):
    from assayer.operators import reconstruct
    df = vectors(spark, trained[0]).withColumn("__position", F.struct(F.lit("a file").alias("file"), F.col("__position").alias("row")))
    dealt = reconstruct.dealt_to_workers(df, AutoencoderConfig(workers=3))
    node, moved = dealt._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if "Repartition" in node.nodeName():
            moved.append({node.output().apply(i).name() for i in range(node.output().size())})
        node = node.children().head()
    assert moved[1] == {"features", "val", "place", "tie"}  # before these rows are dealt out by the test's own repartition
    assert dealt.agg(F.sum("rows")).first()[0] == 3000


def test_draws_below_a_share(spark):
    from assayer.functions.hashing import DRAW_RANGE, drawn_below, uniform
    seen = spark.range(1, 2000).select(uniform(F.col("id"), "a", 7).alias("u")).first()["u"]
    shares = [0.0, 1e-20, 0.1, 0.5, seen, seen + 1 / DRAW_RANGE, 0.999, 1.0, 2.0, -1.0]
    tests = [F.count_if(drawn_below(s, F.col("id"), "a", 7) != (uniform(F.col("id"), "a", 7) < s)).alias(f"s{i}") for i, s in enumerate(shares)]
    assert set(spark.range(1, 2000).agg(*tests).first()) == {0}


def test_batches_by_rows_only_where_the_byte_limit_cannot_bite(spark):
    from assayer.session import BATCH_BYTES, BATCH_ROWS, batches_by_rows
    kept, rows = spark.conf.get(BATCH_BYTES, None), spark.conf.get(BATCH_ROWS, None)
    spark.conf.unset(BATCH_BYTES)
    try:
        def inside(row_bytes):
            with batches_by_rows(spark, row_bytes):
                return spark.conf.get(BATCH_BYTES, None)

        assert inside(80) == str(2**31 - 1) and inside(1 << 20) is None
        with pytest.raises(ValueError), batches_by_rows(spark, 80):
            raise ValueError
        assert spark.conf.get(BATCH_BYTES, None) is None
        spark.conf.set(BATCH_ROWS, "0")  # no limit of rows
        assert inside(80) is None
        spark.conf.unset(BATCH_ROWS)
        spark.conf.set(BATCH_BYTES, "1000000")
        assert inside(80) == spark.conf.get(BATCH_BYTES)
        assert spark.conf.get(BATCH_BYTES).startswith("1000000")
    finally:
        for name, value in ((BATCH_BYTES, kept), (BATCH_ROWS, rows)):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_rows_are_dealt_out_under_their_own_batches(spark, trained, monkeypatch):
    from assayer.operators import reconstruct
    from assayer.session import BATCH_BYTES
    seen, plain, one = [], reconstruct.dealt_to_workers, reconstruct._one_row
    monkeypatch.setattr(reconstruct, "dealt_to_workers", lambda *a: (seen.append(spark.conf.get(BATCH_BYTES, None)), plain(*a))[1])
    monkeypatch.setattr(reconstruct, "_one_row", lambda *a: (seen.append(spark.conf.get(BATCH_BYTES, None)), one(*a))[1])
    fit_autoencoder(vectors(spark, trained[0][:300]), 8, AutoencoderConfig(max_epochs=1, passes=1, workers=2))
    assert seen[0] == str(2**31 - 1) and set(seen[1:]) == {None}  # blocks are large, rows are not
