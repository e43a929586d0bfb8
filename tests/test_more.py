import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.operators import encoder, metrics
from mosaica.sources import readers
from mosaica.streaming.metrics_log import log_metrics


def test_metrics_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"epoch": i, "loss": 0.5 * i}) for i in range(3)))
    stream = spark.readStream.schema("epoch int, loss double").json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        log_metrics(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.epoch for r in readers.read_epoch_metrics(spark, str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_caches_and_models(spark, tmp_path):
    d = spark.createDataFrame([("m0", "u", True), ("m1", "v", True), ("m2", "u", False)], "model string, unit_id string, held_out boolean")
    d.write.partitionBy("model").parquet(str(tmp_path / "c"))
    assert {r.model for r in readers.open_caches(spark, str(tmp_path / "c")).collect()} == {"m0", "m1"}
    d.where("model <> 'm1'").write.partitionBy("model").parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError, match="two models"):
        readers.open_caches(spark, str(tmp_path / "e"))
    summary = spark.createDataFrame([(0, "a.ckpt"), (1, "b.ckpt")], "outer int, checkpoint string")
    oof = spark.createDataFrame([(0, "u"), (0, "v"), (1, "w")], "outer int, unit_id string")
    assert {(r.model, tuple(r.held_out)) for r in readers.resolve_models(summary, oof).collect()} == {("fold0", ("u", "v")), ("fold1", ("w",))}
    with pytest.raises(ValueError, match="no models"):
        readers.resolve_models(summary.limit(0), oof)
    d.withColumn("schema_version", F.lit(3)).write.parquet(str(tmp_path / "i"))
    assert readers.read_index(spark, str(tmp_path / "i")).count() == 3
    d.withColumn("schema_version", F.lit(2)).write.parquet(str(tmp_path / "j"))
    with pytest.raises(ValueError, match="version"):
        readers.read_index(spark, str(tmp_path / "j"))


def test_linear_head_separates(spark):
    r = np.random.default_rng(0)
    rows = [(r.normal(3.0 * (i % 2), 1.0, 4).tolist(), i % 2, float(i % 2) * 2 + 1) for i in range(200)]
    d = spark.createDataFrame(rows, "space array<double>, target int, value double")
    w, b = encoder.fit_linear_head(d, "classification")
    x = np.array([v for v, _, _ in rows])
    assert (w[0] == 0).all() and ((x @ w.T + b).argmax(1) == [t for _, t, _ in rows]).mean() > 0.95
    w, b = encoder.fit_linear_head(d, "regression", target="value")
    assert np.corrcoef(x @ w[0] + b[0], [v for _, _, v in rows])[0, 1] > 0.9


def test_encoder_forward_by_hand():
    x, src, dst = np.array([[1.0], [2.0]]), np.array([0, 1]), np.array([1, 0])
    one = np.ones((1, 1))
    layer = {"edge": np.zeros((2, 1)), "w1": one, "b1": np.zeros(1), "w2": one, "b2": np.zeros(1)}
    h = encoder.encode_graph(x, None, src, dst, np.zeros((2, 2)), {"in": one, "layers": [layer, layer], "jk": "concat"})
    assert h.tolist() == [[1.0, 3.0, 6.0], [2.0, 3.0, 6.0]]


def test_cox_head_finds_planted_weights(spark):
    r = np.random.default_rng(5)
    z = r.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + [3.0, 0.0, -1.0]
    w = np.array([0.9, -0.1, 0.0])
    t = np.round(r.exponential(1 / np.exp((z - z.mean(0)) @ w)), 2)
    d = spark.createDataFrame([(v.tolist(), float(a), int(i % 5 > 0)) for i, (v, a) in enumerate(zip(z, t, strict=True))], "space array<double>, time double, event int")
    got, bias = encoder.fit_cox_head(d, reg=1e6)
    assert np.abs((got[0] - w) * z.std(0)).max() < 0.2 and np.allclose((z @ got[0] + bias).mean(), 0, atol=1e-6)
    with pytest.raises(ValueError, match="no event"):
        encoder.fit_cox_head(d.withColumn("event", d["event"] * 0))


def test_metric_edges(spark):
    one = spark.createDataFrame([(0.7, 0.3, 0, 0), (0.2, 0.8, 1, 0)], "prob_0 double, prob_1 double, pred int, target int")
    m = metrics.class_metrics(one, 2).first()
    assert m.acc == 0.5 and m.bal_acc is None and m.auroc is None
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "pred double, target double")
    assert metrics.regression_metrics(flat, [("pred", "target")]).first().r2 is None
    w = {r["class"]: r["weight"] for r in metrics.class_weights(spark.createDataFrame([(0,), (0,), (1,)], "label int"), 3).collect()}
    assert w[1] == pytest.approx(2 * w[0]) and sum(w.values()) == pytest.approx(3)
    with pytest.raises(ValueError):
        metrics.output_dim("classification", 1)


def test_reducers(spark):
    from mosaica import config
    from mosaica.operators import cluster

    r = np.random.default_rng(4)
    d = spark.createDataFrame([(i, (r.normal(size=3) * [9, 1, 0.1]).tolist()) for i in range(50)], "cell_id long, space array<double>")
    same, none = cluster.reduced(d, config.ReducerConfig())
    assert none is None and same.columns == d.columns
    cfg = config.ReducerConfig("pca", 2, "train")
    out, state = cluster.reduced(d, cfg, train=d.where("cell_id < 40"))
    assert len(out.first().space) == 2 and abs(state[1][0][0]) > 0.9
    again, _ = cluster.reduced(d, config.ReducerConfig("pca", 2, state_from="x"), state=state)
    assert again.collect() == out.collect()
    for bad in (lambda: cluster.reduced(d, cfg), lambda: cluster.reduced(d, config.ReducerConfig("pca", 3), state=state), lambda: cluster.reduced(d, config.ReducerConfig("pca", 2, state_from="x"))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("low", "stride", "want"), [(28.01, 100.0, [(0, 0), (1, 1)]), (106.03, 50.0, [(0, 0), (1, 2), (1, 3)])])
def test_tiles_of_cells_whose_distance_rounds_below_a_side(spark, low, stride, want):
    from mosaica.operators import units

    k = want[-1][1]
    cells = spark.createDataFrame([("u", 0, low, 0.0), ("u", 1, low + k * stride, 0.0)], "region_id string, cell_id long, x double, y double")
    got = units.grid_tiles(cells, 100.0, stride).select("cell_id", "ix").collect()
    assert sorted(map(tuple, got)) == want


def test_tiles_of_cells_on_sides_are_those_of_the_sql(spark, tmp_path):
    """Cells whose distances from the corner are whole numbers of strides but for rounding, in both directions."""
    import duckdb

    from mosaica import catalog

    c = duckdb.connect()
    c.execute(
        "create view events as select u * 100 + k as event_id, timestamp '2024-01-01' + to_minutes(u * 7 + (k // 10) * 6000 + (k % 2) * u) as ts, u as user_id, "
        "'view' as event_type, round(u * 1.37 % 50, 2) + (k % 10) * 30 as value, '{\"k\": 1}' as props from range(0, 300) a(u), range(0, 20) b(k)"
    )
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    for name in ("grid_tiles", "grid_tiles_overlap", "grid_tiles_gaps"):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        assert len(got) and got == sorted(c.execute(catalog.ORACLES[name]).fetchall()), name


def test_cells_without_a_region_or_position_have_no_tile_as_in_the_sql(spark, tmp_path):
    import duckdb

    from mosaica import catalog

    c = duckdb.connect()
    c.execute(
        "create view events as select k as event_id, timestamp '2024-01-01' + to_minutes(k * 7) as ts, case when k % 3 > 0 then k % 2 end as user_id, "
        "'view' as event_type, case when k % 7 > 0 then k * 4.1 when k % 2 = 0 then 'nan'::double end as value, '{\"k\": 1}' as props from range(0, 90) b(k)"
    )
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = sorted(map(tuple, catalog.QUERIES["grid_tiles"](spark, str(tmp_path)).collect()), key=str)
    assert len(got) and got == sorted(c.execute(catalog.ORACLES["grid_tiles"]).fetchall(), key=str)
