"""What commands leave for each other: written, read back, checked."""

import math

import numpy as np
import pytest

from mosaica import config
from mosaica.operators import encoder, metrics
from mosaica.plans.commands import NicheAnalysis
from mosaica.sources import store


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(0)
    rows = [(f"u{i % 3}", f"p{i % 2}", i, "ab"[i % 2], float(r.random() * 50), float(r.random() * 50)) for i in range(60)]
    return spark.createDataFrame(rows, "unit_id string, patient_id string, cell_id long, cell_type string, x double, y double")


def test_units_and_their_selection(spark, cells, tmp_path):
    from mosaica.operators.graph import delaunay_edges

    spec, path = config.InputSpec(("f",), ("a", "b")), str(tmp_path / "units")
    store.write_units(cells, delaunay_edges(cells), spec, path)
    got = store.read_units(spark, path, spec)
    assert sorted((r.unit_id, r.n_cells) for r in got.index.collect()) == [("u0", 20), ("u1", 20), ("u2", 20)]
    one = got.some(spark.createDataFrame([("u1",)], "unit_id string"))
    assert one.cells.count() == 20 and {r.unit_id for r in one.edges.collect()} == {"u1"} and 0 < one.edges.count() < got.edges.count()
    with pytest.raises(ValueError, match="not there"):
        got.some(spark.createDataFrame([("zz",)], "unit_id string"))
    with pytest.raises(ValueError, match="differs"):
        store.read_units(spark, path, config.InputSpec(("g",)))
    first = store.cached_interior(got.cells, got.edges, config.InteriorConfig(True), 1, str(tmp_path))
    again = store.cached_interior(got.cells.where("false"), got.edges, config.InteriorConfig(True), 1, str(tmp_path))
    assert 0 < first.count() == again.count() <= 60


def test_cache_resumes_by_stamp(spark, tmp_path):
    units = spark.createDataFrame([("u",), ("v",)], "unit_id string")
    scores = spark.createDataFrame([("u", 1, [1.0], [2.0]), ("u", 2, [1.0], [2.0])], "unit_id string, cell_id long, embedding array<double>, attention_space array<double>")
    a, b = (store.CellCache(str(tmp_path / "c"), "m", s) for s in ("x1", "x2"))
    assert a.pending(units).count() == 2
    a.add(scores)
    a.add(scores)  # a run that failed after it wrote
    assert [r.unit_id for r in a.pending(units).collect()] == ["v"] and b.pending(units).count() == 2
    b.add(scores)
    got = a.load(spark, units.where("unit_id = 'u'"), ("embedding",))
    assert got.count() == 2 and "attention_space" not in got.columns
    with pytest.raises(ValueError, match="no scores"):
        a.load(spark, units)
    votes = spark.createDataFrame([("m", "u", 1), ("m", "u", 2), ("n", "u", 1), ("n", "u", 2)], "model string, unit_id string, cell_id long")
    store.check_aligned(votes)
    with pytest.raises(ValueError, match="different cells"):
        store.check_aligned(votes.where("not (model = 'n' and cell_id = 2)"))


def test_weights_and_niche_models(spark, tmp_path):
    w, spec = encoder.random_weights(2, 3, 2), config.InputSpec(("f", "g"))
    store.write_weights(spark, w, spec, str(tmp_path / "w"))
    back = store.read_weights(spark, str(tmp_path / "w"), spec)
    assert (back["encoder"]["layers"][1]["w1"] == w["encoder"]["layers"][1]["w1"]).all() and (back["head"] == w["head"]).all()
    with pytest.raises(ValueError, match="differs"):
        store.read_weights(spark, str(tmp_path / "w"), config.InputSpec())
    sample = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2, 0.1], i % 2) for i in range(10)], "cell_id long, space array<double>, cluster int")
    numbers = spark.createDataFrame([(0, 2), (1, 1)], "cluster int, niche int")
    store.NicheModel(sample, numbers, config.ClusteringConfig(assign_k=3, metric="euclidean")).write(str(tmp_path / "n"))
    new = spark.createDataFrame([(100, [0.9, 0.1, 0.0]), (101, [0.0, 1.0, 0.0])], "cell_id long, space array<double>")
    assert {r.cell_id: r.niche for r in store.NicheModel.read(spark, str(tmp_path / "n")).predict(new).collect()} == {100: 1, 101: 2}


def test_result_sets(spark, cells, tmp_path):
    table = spark.createDataFrame([(1, 0.5)], "niche int, share double")
    analysis = NicheAnalysis(cells, table, table, table, table, {"contacts": table})
    store.write_analysis(analysis, str(tmp_path / "a"), {"clustering": config.ClusteringConfig()})
    assert store.read_set(spark, str(tmp_path / "a"), ["niches", "descriptors_contacts"])["niches"].count() == 1
    assert store.read_json(spark, str(tmp_path / "a" / "settings"))["clustering"]["min_cluster_size"] == 300
    values = spark.createDataFrame([("u0", "a|b", 1.0), ("u1", "a|b", 2.0), ("u1", "b|b", 3.0)], "unit_id string, metric string, value double")
    store.write_statistics({"enrichment": (values, table)}, str(tmp_path / "s"))
    wide = store.read_set(spark, str(tmp_path / "s"), ["enrichment_wide"])["enrichment_wide"]
    assert {r.unit_id: (r.a_b, r.b_b) for r in wide.collect()} == {"u0": (1.0, None), "u1": (2.0, 3.0)}
    with pytest.raises(ValueError, match="no table"):
        store.write_set({"x": None}, str(tmp_path / "x"))


def test_losses_and_label_range(spark):
    d = spark.createDataFrame([(2.0, 0.0, 0), (0.0, 1.0, 0), (1.0, 3.0, 1), (9.0, 9.0, None)], "logit_0 double, logit_1 double, target int")
    parts = [math.log(1 + math.exp(-2)), math.log(1 + math.exp(1)), math.log(1 + math.exp(-2))]
    assert metrics.cross_entropy(d, 2).first().loss == pytest.approx(sum(parts) / 3)
    assert metrics.cross_entropy(d, 2, {1: 3.0}).first().loss == pytest.approx((parts[0] + parts[1] + 3 * parts[2]) / 3)
    h = spark.createDataFrame([(0.0, 0.5), (0.0, 3.0)], "p double, t double")
    assert metrics.huber(h, [("p", "t")]).first().loss == pytest.approx((0.125 + 2.5) / 2)
    metrics.check_classes({"train": d.select(d.target.alias("label"))}, 2)
    with pytest.raises(ValueError, match="val: labels"):
        metrics.check_classes({"train": d.select(d.target.alias("label")), "val": d.select((d.target + 1).alias("label"))}, 2)


def test_tasks_and_regimes():
    assert config.TaskConfig().selection == config.SelectionConfig()
    assert config.TaskConfig("regression", ("y",)).selection.mode == "min"
    assert config.regime("attention_only").lr_scales["encoder"] == 0 and config.regime("finetune_reg").augmentation.enabled
    for bad in (lambda: config.TaskConfig("survival", ("time",)), lambda: config.TaskConfig("regression"), lambda: config.regime("warm"), lambda: config.FinetuneConfig(lr_scales={"encoder": 1.0}), lambda: config.TaskConfig.from_dict({"loss": "mae"})):
        with pytest.raises(ValueError):
            bad()
