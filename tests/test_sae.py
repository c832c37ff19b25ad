import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclens.functions import vectors
from veclens.operators import copies
from veclens.operators.interpret import top_tokens
from veclens.operators.sae import NORMALIZATIONS, SaeModel, SaeParams, SaeTable, TopCells, normalize_decoder, running_mean
from veclens.operators.split import epoch_batches, train_val_split
from veclens.plans import train
from veclens.plans.train import Adam, Sae, batch_gradients, next_mean, write_report

D, S, N = 6, 20, 90


def some_params(normalize="expected_average_only_in", apply_b_dec=True, seed=0):
    rng = np.random.default_rng(seed)
    return SaeParams(
        rng.normal(size=(S, D)), rng.normal(size=S), rng.normal(size=(S, D)), rng.normal(size=D),
        rng.normal(size=D), normalize, apply_b_dec, True,
    )


def forward(params, x):
    """Plain dense forward pass."""
    c = x
    if params.normalize_activations == "expected_average_only_in":
        c = x - params.activation_mean
    elif params.normalize_activations == "layer_norm":
        c = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    if params.apply_b_dec_to_input:
        c = c - params.b_dec
    acts = np.maximum(c @ params.w_enc.T + params.b_enc, 0)
    return acts, acts @ params.w_dec + params.b_dec


@pytest.fixture(scope="module")
def data(spark):
    x = np.random.default_rng(5).normal(size=(N, D)).astype(np.float32)
    rows = spark.createDataFrame(
        [(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)],
        "token_idx BIGINT, prompt_id INT, activation ARRAY<FLOAT>",
    ).repartition(5)
    return rows, x.astype(float)


def dense(rows, key="token_idx"):
    acts = np.zeros((N, S))
    for row in rows.collect():
        for cell in row["features"]:
            acts[row[key], cell["feature_id"]] = cell["act"]
    return acts


@pytest.mark.parametrize("normalize", NORMALIZATIONS)
@pytest.mark.parametrize("apply_b_dec", [False, True])
def test_transform_equals_dense_forward(data, normalize, apply_b_dec):
    rows, x = data
    params = some_params(normalize, apply_b_dec)
    acts, rebuilt = forward(params, x)
    result = SaeModel(params).transform(rows)
    assert result.columns == [*rows.columns, "features", "reconstruction"]
    np.testing.assert_allclose(dense(result), acts, atol=1e-9)
    found = np.array([row["reconstruction"] for row in result.orderBy("token_idx").collect()])
    np.testing.assert_allclose(found, rebuilt, atol=1e-9)
    decoded = SaeModel(params).decode(SaeModel(params).encode(rows, ["token_idx"]), ["token_idx"])
    found = np.array([row["reconstruction"] for row in decoded.orderBy("token_idx").collect()])
    np.testing.assert_allclose(found, rebuilt, atol=1e-9)


def test_weights_as_files_and_in_blocks(data, monkeypatch):
    """Beyond the broadcast limit weights travel as files; blocks change nothing."""
    rows, x = data
    params = some_params()
    acts, _ = forward(params, x)
    model = SaeModel(params, broadcast_limit=0)
    monkeypatch.setattr("veclens.operators.sae.CELLS_PER_STEP", 64)
    np.testing.assert_allclose(dense(model.encode(rows, ["token_idx"])), acts, atol=1e-9)
    metrics = model.row_metrics(rows, ["token_idx"]).orderBy("token_idx").collect()
    assert [row["l0"] for row in metrics] == (acts > 0).sum(1).tolist()


def test_partials_and_subset(data):
    rows, x = data
    params = some_params()
    acts, _ = forward(params, x)
    found = {
        row["feature_id"]: row
        for row in SaeModel(params).feature_partials(rows).groupBy("feature_id").agg(
            F.max("max_act").alias("m"), F.sum("sum_act").alias("s"), F.sum("n_active").alias("n")).collect()
    }
    assert found.pop(-1)["n"] == N
    for f, row in found.items():
        assert row["m"] == pytest.approx(acts[:, f].max())
        assert row["s"] == pytest.approx(acts[:, f].sum())
        assert row["n"] == (acts[:, f] > 0).sum()
    cells = SaeModel(params).cells(rows, ["token_idx"], feature_ids=[7, 3]).collect()
    assert {c["feature_id"] for c in cells} <= {3, 7}
    for c in cells:
        assert c["act"] == pytest.approx(acts[c["token_idx"], c["feature_id"]])


@pytest.mark.parametrize("k", [1, 4, 50])
def test_top_tokens_with_ties_equal_a_sort(spark, k):
    """Repeated vectors tie; the smaller indices win."""
    x = np.random.default_rng(8).normal(size=(12, D))[np.arange(200) % 12]
    rows = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(x)], "token_idx BIGINT, activation ARRAY<DOUBLE>"
    ).repartition(3)
    params = some_params("none", False)
    acts, _ = forward(params, x)
    expected = set()
    for f in range(S):
        order = sorted(np.flatnonzero(acts[:, f] > 0), key=lambda i: (-round(acts[i, f], 9), i))[:k]
        expected |= {(f, rank, int(i)) for rank, i in enumerate(order, 1)}
    model = SaeModel(params)
    exact = model.cells(rows, ["token_idx"]).withColumn("act", F.round("act", 9))
    assert exact.count() == (acts > 0).sum()
    found = {(r["feature_id"], r["rank"], r["token_idx"]) for r in top_tokens(model, rows, k).collect()}
    assert {(f, rank) for f, rank, _ in found} == {(f, rank) for f, rank, _ in expected}
    by_rank = {(f, rank): i for f, rank, i in found}
    for f, rank, i in expected:
        assert acts[by_rank[f, rank], f] == pytest.approx(acts[i, f])
    one = top_tokens(model, rows, k, feature_id=3).collect()
    assert [r["token_idx"] for r in sorted(one, key=lambda r: r["rank"])] == [
        i for _, i in sorted((rank, i) for f, rank, i in found if f == 3)
    ]


def test_padding_fills_a_short_list(data):
    rows, x = data
    params = some_params()
    params.b_enc[5] = -1e9
    padded = top_tokens(SaeModel(params), rows, 3, feature_id=5, pad=True).collect()
    assert [(r["token_idx"], r["act"]) for r in padded] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert top_tokens(SaeModel(params), rows, 3, feature_id=5).count() == 0


def test_wrong_width_is_an_error(spark):
    rows = spark.createDataFrame([(0, [1.0] * (D - 1))], "token_idx BIGINT, activation ARRAY<FLOAT>")
    with pytest.raises(Exception, match="every vector must have 6 values"):
        SaeModel(some_params()).encode(rows, ["token_idx"]).collect()


def test_unknown_normalization():
    with pytest.raises(ValueError):
        some_params("batch_norm")


def test_save_and_load(spark, data, tmp_path, monkeypatch):
    rows, _ = data
    monkeypatch.setattr("veclens.operators.sae.MODEL_BLOCK_BYTES", 16 * D * 3)
    params = some_params("layer_norm")
    SaeModel(params).save(str(tmp_path / "model"), {"epoch": 3})
    loaded = SaeModel.load(str(tmp_path / "model"), spark).parameters
    for name, array in params.arrays().items():
        np.testing.assert_array_equal(getattr(loaded, name), array)
    assert (loaded.normalize_activations, loaded.apply_b_dec_to_input) == ("layer_norm", True)
    assert loaded.mean_initialized and loaded.metadata == {"epoch": 3}
    left = SaeModel(params).row_metrics(rows, ["token_idx"]).orderBy("token_idx").collect()
    assert left == SaeModel(loaded).row_metrics(rows, ["token_idx"]).orderBy("token_idx").collect()


def test_a_model_kept_as_a_table_gives_the_same_results(spark, data, tmp_path):
    rows, x = data
    params = some_params()
    SaeModel(params).save(str(tmp_path / "model"))
    model = SaeModel.load(str(tmp_path / "model"), spark, driver_limit=0)
    assert isinstance(model.parameters, SaeTable)
    acts, rebuilt = forward(params, x)
    result = model.transform(rows)
    np.testing.assert_allclose(dense(result), acts, atol=1e-9)
    found = np.array([row["reconstruction"] for row in result.orderBy("token_idx").collect()])
    np.testing.assert_allclose(found, rebuilt, atol=1e-9)
    for cell in model.cells(rows, ["token_idx"], feature_ids=[7, 3]).collect():
        assert cell["act"] == pytest.approx(acts[cell["token_idx"], cell["feature_id"]])
    model.save(str(tmp_path / "again"))
    again = SaeModel.load(str(tmp_path / "again"), spark).parameters
    np.testing.assert_array_equal(again.w_dec, params.w_dec)


def test_a_table_is_read_once_by_all_workers(spark, data, tmp_path):
    """Many tasks in several workers map one copy; the decoder is a second read, a changed table a new copy."""
    import pyarrow as pa

    rows, _ = data
    params = replace(some_params(), **{k: v.astype(np.float32) for k, v in some_params().arrays().items()})
    SaeModel(params).save(str(tmp_path / "model"))
    assert dict(spark.read.parquet(str(tmp_path / "model" / "weights")).dtypes)["w_enc"] == "array<float>"

    def shares(path):
        table = SaeModel.load(path, spark, driver_limit=0).parameters
        return table.share(spark, None, False, 0), table.share(spark, None, True, 0)

    def seen(load):
        def run(batches):
            for batch in batches:
                w = load()
                sums = float(w["w_enc"].sum()) + float(w.get("w_dec", np.zeros(1)).sum())
                yield pa.RecordBatch.from_pydict({"s": [sums], "kind": [str(w["w_enc"].dtype)], "mapped": [isinstance(w["w_enc"], np.memmap)]})
        return spark.range(0, 64, 1, 16).mapInArrow(run, "s double, kind string, mapped boolean").distinct().collect()

    encoder, both = shares(str(tmp_path / "model"))
    found = seen(encoder)
    assert encoder.reads.value == 1
    assert [tuple(r) for r in found] == [(float(params.w_enc.sum()), "float32", True)]
    seen(both)
    seen(both)
    assert both.reads.value == 1
    SaeModel(replace(params, w_enc=params.w_enc + 1)).save(str(tmp_path / "model"))
    again, _ = shares(str(tmp_path / "model"))
    assert seen(again)[0].s == pytest.approx(float((params.w_enc + 1).sum()), rel=1e-5)


def test_old_copies_go(tmp_path):
    def one(arrays):
        arrays["a"][:] = 1

    held = copies.mapped("0", {"a": (4,)}, np.float32, one, tmp_path)
    for i in range(1, 6):
        copies.mapped(str(i), {"a": (4,)}, np.float32, one, tmp_path)
    assert len(list(tmp_path.glob("copy-*"))) <= copies.KEPT_COPIES + 2
    assert held["a"].tolist() == [1] * 4  # what is mapped stays

    def broken(arrays):
        raise OSError("lost")

    with pytest.raises(OSError):
        copies.mapped("9", {"a": (4,)}, np.float32, broken, tmp_path)
    assert copies.mapped("9", {"a": (4,)}, np.float32, one, tmp_path)["a"].tolist() == [1] * 4


def test_a_task_sends_k_cells_per_feature(spark, monkeypatch):
    """However many batches a task has; ties and merges change nothing."""
    monkeypatch.setattr("veclens.operators.sae.ROWS_PER_STEP", 7)
    x = np.round(np.random.default_rng(8).normal(size=(500, D)), 1)[np.random.default_rng(1).integers(0, 90, 500)]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "token_idx BIGINT, activation ARRAY<DOUBLE>").coalesce(1)
    params, k = some_params("none", False), 4
    model = SaeModel(params)
    sent = model.top_cells(rows, "token_idx", k)
    assert sent.groupBy("feature_id").count().agg(F.max("count")).first()[0] == k
    acts, _ = forward(params, x)
    exact = {(r["feature_id"], r["token_idx"]): r["act"] for r in model.cells(rows, ["token_idx"]).collect()}
    for f in range(S):
        expected = sorted((-v, i) for (g, i), v in exact.items() if g == f)[:k]
        got = sorted((-r["act"], r["token_idx"]) for r in sent.where(F.col("feature_id") == f).collect()) if f % 5 == 0 else expected
        assert [v for v, _ in got] == pytest.approx([v for v, _ in expected])
    buffer = TopCells(1, 2)
    buffer.take(np.zeros(4, int), np.array([1.0, 2.0, 2.0, 2.0]), np.array([0, 9, 3, 5]))
    buffer.merge()
    assert (buffer.index.tolist(), buffer.bar.tolist()) == ([3, 5], [2.0])


def loss(params, x, l1):
    acts, rebuilt = forward(params, x)
    return ((rebuilt - x) ** 2).mean() + l1 * acts.mean()


@pytest.mark.parametrize("normalize", NORMALIZATIONS)
@pytest.mark.parametrize("apply_b_dec", [False, True])
def test_gradients_equal_finite_differences(normalize, apply_b_dec):
    params, x, l1, h = some_params(normalize, apply_b_dec), np.random.default_rng(1).normal(size=(7, D)), 0.3, 1e-6
    gradients, _ = batch_gradients(x, params.arrays(), normalize, apply_b_dec, len(x), l1)
    rng = np.random.default_rng(2)
    for name, gradient in gradients.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in gradient.shape)
            values = []
            for sign in (1, -1):
                moved = getattr(params, name).copy()
                moved[at] += sign * h
                values.append(loss(replace(params, **{name: moved}), x, l1))
            assert gradient[at] == pytest.approx((values[0] - values[1]) / (2 * h), abs=1e-5)


def test_fit_equals_a_plain_training_loop(spark, data):
    """The distributed fit against the same steps on one machine."""
    rows, x = data
    options = {"lr": 0.02, "batch_size": 16, "epochs": 2, "train_split": 0.8, "l1_coeff": 0.01}
    fitted = Sae(S, **options).fit(rows)
    from veclens.operators.sae import initial_weights, params_from_rows
    from veclens.operators.split import epoch_batches, train_val_split

    params = params_from_rows(initial_weights(spark, D, S, 42), D, S)
    optimizer, best, history = Adam(params, 0.02), None, []
    split = train_val_split(rows.select("token_idx"), 0.8)
    for epoch in (1, 2):
        placed = epoch_batches(split, epoch, 16).toPandas()
        figures = []
        for _, batch in placed[placed.split == "train"].groupby("batch_id"):
            xb = x[batch.token_idx]
            params = replace(params, activation_mean=next_mean(params, xb.mean(0)), mean_initialized=True)
            acts, rebuilt = forward(params, xb)
            figures.append([((rebuilt - xb) ** 2).mean(), acts.mean(), (acts > 0).sum(1).mean()])
            gradients, _ = batch_gradients(xb, params.arrays(), params.normalize_activations, False, len(xb), 0.01)
            params = normalize_decoder(optimizer.update(params, gradients))
        history.append(np.mean(figures, axis=0))
        losses = []
        for _, batch in placed[placed.split == "val"].groupby("batch_id"):
            xb = x[batch.token_idx]
            losses.append(((forward(params, xb)[1] - xb) ** 2).mean())
        history.append([np.mean(losses)])
        if best is None or np.mean(losses) < best[0]:
            best = (np.mean(losses), params)
    for name in ("w_enc", "b_enc", "w_dec", "b_dec", "activation_mean"):
        np.testing.assert_allclose(getattr(fitted.parameters, name), getattr(best[1], name), atol=1e-9)
    found = fitted.history.orderBy("epoch", "split").collect()
    np.testing.assert_allclose([found[0][2:], found[2][2:]], [history[0], history[2]], atol=1e-9)
    assert [found[1]["recon_loss"], found[3]["recon_loss"]] == pytest.approx([history[1][0], history[3][0]])


def jobs_of(spark, run):
    """What ``run`` returns, and the number of Spark jobs it starts."""
    context, group = spark.sparkContext, "counted"
    context.setJobGroup(group, group)
    try:
        return run(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("options", [{"batch_size": 4}, {"batch_size": 3, "steps_per_job": 2, "tasks_per_job": 3}])
def test_small_steps_share_a_job_and_change_nothing(spark, data, monkeypatch, options):
    """Blocks of steps, or of windows of local steps, against a job for each; batches and windows end short."""
    rows, _ = data
    options |= {"lr": 0.02, "epochs": 2, "train_split": 0.83, "l1_coeff": 0.01}
    fitted, n_jobs = jobs_of(spark, lambda: Sae(S, **options).fit(rows))
    unit = 1 if options["batch_size"] == 4 else 6
    work = unit * options["batch_size"] * 1024
    monkeypatch.setattr(train, "BLOCK_WORK", 3 * work)  # several blocks an epoch, the last one short
    in_blocks = Sae(S, **options).fit(rows)
    monkeypatch.setattr(train, "STEP_WORK", 0)
    alone, n_alone = jobs_of(spark, lambda: Sae(S, **options).fit(rows))
    kept = [fitted.parameters, in_blocks.parameters, alone.parameters]
    weights = [next(p.rows(spark)).orderBy("feature_id").collect() for p in kept]
    for other, found in zip(kept[1:], weights[1:]):
        for name in ("w_enc", "b_enc", "w_dec"):
            np.testing.assert_allclose([r[name] for r in found], [r[name] for r in weights[0]], atol=1e-9)
        np.testing.assert_allclose(other.b_dec, kept[0].b_dec, atol=1e-9)
        np.testing.assert_allclose(other.activation_mean, kept[0].activation_mean, atol=1e-9)
    histories = [[tuple(r) for r in m.history.orderBy("epoch", "split").collect()] for m in (fitted, in_blocks, alone)]
    for history in histories[1:]:
        assert [r[:2] for r in history] == [r[:2] for r in histories[0]]
        np.testing.assert_allclose([r[2:] for r in history], [r[2:] for r in histories[0]], atol=1e-9)
    assert n_jobs < n_alone - 10


def test_a_null_value_in_a_vector_is_an_error(spark):
    rows = spark.createDataFrame([(i, [1.0, None if i == 5 else float(i)]) for i in range(20)], "token_idx BIGINT, activation ARRAY<FLOAT>")
    with pytest.raises(Exception, match="null value"):
        Sae(3, batch_size=4, epochs=1, train_split=1.0).fit(rows)


def test_large_steps_stay_jobs_of_their_own():
    config = train.TrainingConfig(128, batch_size=256)
    assert config.block(64) == 512 and replace(config, steps_per_job=4, tasks_per_job=2, batch_size=64).block(64) == 2048
    assert train.TrainingConfig(57344).block(7168) == 0 and replace(config, batch_size=8192 * 16).block(64) == 0


def moved(df, column):
    """Exchanges of the plan that carry the column."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return len(re.findall(rf"\) Exchange\s*\nInput \[\d+\]: \[[^\]]*\b{column}#", text))


def test_an_epoch_moves_vectors_once(spark, data, monkeypatch):
    """Batches of an epoch are laid out, and validation read, with one shuffle of vectors in all."""
    rows, _ = data
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors_only = rows.select("token_idx", "activation")
        split = train_val_split(vectors_only.select("token_idx"), 0.8)
        placed = epoch_batches(split, 1, 10)
        with train.bucketed(vectors_only, "token_idx", 3) as stored:
            own = placed.where("split = 'train'")
            laid = train.in_ranges(train.in_batches(stored, own), own, 4)
            assert moved(train.in_batches(stored, own), "activation") == 0
            assert moved(laid, "activation") == 1
            assert moved(train.in_batches(vectors_only, own), "activation") == 1 + moved(vectors_only, "activation")  # what buckets save
            read = laid.withColumn("part", F.spark_partition_id()).collect()
        expected = {r["token_idx"]: r["batch_id"] for r in own.collect()}
        assert {r["token_idx"]: r["batch_id"] for r in read} == expected
        parts = {}
        for r in read:
            parts.setdefault(r["batch_id"], set()).add(r["part"])
        assert all(len(p) == 1 for p in parts.values()) and len(set.union(*parts.values())) == 4
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("veclens_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 3000])
def test_running_mean_of_groups(spark, n, monkeypatch):
    monkeypatch.setattr("veclens.operators.sae.MEAN_GROUP", 100)
    x = np.random.default_rng(n).normal(size=(n, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "batch_id BIGINT, batch_mean ARRAY<DOUBLE>")
    mean = x[0]
    for v in x[1:]:
        mean = 0.99 * mean + 0.01 * v
    assert running_mean(rows).first()[0] == pytest.approx(mean.tolist())


@pytest.mark.parametrize("steps_per_job", [1, 3])
def test_fit_lowers_the_loss_and_keeps_unit_norms(spark, data, tmp_path, steps_per_job):
    rows, _ = data
    options = {"lr": 0.02, "batch_size": 12, "epochs": 4, "train_split": 0.8}
    model = Sae(S, steps_per_job=steps_per_job, tasks_per_job=2, **options).fit(rows)
    train = [row["recon_loss"] for row in model.history.where("split = 'train'").orderBy("epoch").collect()]
    assert train[-1] < train[0]
    model.save(str(tmp_path / "model"))
    saved = SaeModel.load(str(tmp_path / "model"), spark).parameters
    np.testing.assert_allclose(np.linalg.norm(saved.w_dec, axis=1), 1, atol=1e-9)
    best = model.parameters.metadata["best_results"]
    val = {r["epoch"]: r for r in model.history.where("split = 'val'").collect()}
    assert best["val_loss"] == min(r["recon_loss"] for r in val.values())
    assert best["val_l0"] == val[best["epoch"]]["l0"]
    write_report(spark, model, str(tmp_path / "report"), {"num_shards": 4})
    assert spark.read.json(str(tmp_path / "report" / "report")).count() == 1
    assert spark.read.parquet(str(tmp_path / "report" / "history")).count() == 8


def test_empty_validation_split_gives_nulls(data):
    rows, _ = data
    model = Sae(S, batch_size=64, epochs=1, train_split=1.0).fit(rows)
    val = model.history.where("split = 'val'").first()
    assert val["recon_loss"] is None and val["l0"] is None


def test_half_rounding_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([
        rng.normal(size=500), rng.normal(size=200) * 1e-6, rng.normal(size=200) * 1e4,
        [0.0, -0.0, 65504, 65519, 65520, -70000, 2**-24, 2**-25, 3 * 2**-25, 2**-14, 1 + 2**-11, 1 + 3 * 2**-11],
    ]).astype(np.float32)
    df = spark.createDataFrame([(values.tolist(),)], "v ARRAY<FLOAT>")
    found = np.array(df.select(vectors.to_half("v").alias("h")).first()["h"], dtype=np.float32)
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(found, values.astype(np.float16).astype(np.float32))
    ok = df.select(vectors.fits_half("v").alias("ok")).first()["ok"]
    assert ok is False
