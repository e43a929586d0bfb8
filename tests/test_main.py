"""Commands from the command line, and attention trained on frozen cells."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica import config
from mosaica.__main__ import main
from mosaica.operators import attention, encoder, graph
from mosaica.sources import readers, store


def test_commands_in_a_row(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(f"r{i % 4}", f"p{i % 2}", i, "abc"[int(r.integers(3))], float(r.random() * 90), float(r.random() * 90), 0.5) for i in range(320)]
    cells = spark.createDataFrame(rows, "region_id string, patient_id string, cell_id long, cell_type string, x double, y double, feature double")
    src, units, out = (str(tmp_path / n) for n in ("src", "units", "out"))
    cells.write.parquet(f"{src}/cells")
    main(["build", "--in", src, "--out", units], spark)
    got = store.read_units(spark, units)
    assert got.index.count() == 4 and got.spec.cell_types == ("a", "b", "c")
    spark.createDataFrame([("p0", True), ("p1", False)], "patient_id string, positive boolean").write.parquet(f"{units}/labels")
    main(["spatial-stats", "--in", units, "--out", out, "--config", json.dumps({"spatial_stats": {"analyses": ["enrichment", "cross_l"], "min_patients": 1}})], spark)
    assert store.read_set(spark, out, ["enrichment_tests"])["enrichment_tests"].count() == 6
    scores = got.cells.select("unit_id", "patient_id", "cell_id", "cell_type", "x", "y", F.array("x", "y").alias("space"), F.array(F.lit(0.0), F.col("x") / 100).alias("instance_logits"), F.array(F.lit(0.0), F.col("y") / 100).alias("attention_logits"), (F.col("patient_id") == "p0").cast("int").alias("target"), (F.col("patient_id") == "p0").alias("positive"))
    scores.write.parquet(f"{src}/scores")
    got.edges.write.parquet(f"{src}/edges")
    main(["predict", "--in", src, "--out", str(tmp_path / "p")], spark)
    assert store.read_set(spark, str(tmp_path / "p"), ["units"])["units"].count() == 4
    cfg = {"clustering": {"min_cluster_size": 20, "method": "kmeans", "n_clusters": 3, "metric": "euclidean"}, "descriptors": {"analyses": ["contacts"], "min_contacts": 5}}
    main(["niches", "--in", src, "--out", str(tmp_path / "n"), "--config", json.dumps(cfg)], spark)
    assert store.read_set(spark, str(tmp_path / "n"), ["niches"])["niches"].count() == 3
    with pytest.raises(SystemExit):
        main(["dance", "--in", src, "--out", out], spark)


def test_attention_gradient_by_differences():
    r = np.random.default_rng(3)
    z, logits = r.normal(size=(7, 5)), r.normal(size=(7, 3))
    w = attention.initial_attention(5, 3, config.AttentionConfig(4, 3), seed=1)
    _, grad = attention.bag_gradient(z, logits, 2, 1.7, w)
    for name, g in grad.items():
        for at in np.ndindex(w[name].shape):
            up, down = (w | {name: w[name].copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert g[at] == pytest.approx((attention.bag_gradient(z, logits, 2, 1.7, up)[0] - attention.bag_gradient(z, logits, 2, 1.7, down)[0]) / 2e-6, abs=1e-6)


def test_attention_learns_which_cells_count(spark):
    r = np.random.default_rng(2)
    rows = []
    for u in range(24):
        for k in range(8):
            marked = k == 0
            z = r.normal(0, 0.3, 3) + [3.0 * marked, 0, 0]
            logit = (4.0 if u % 2 else -4.0) if marked else float(r.normal(0, 4))  # only the marked cell tells the class
            rows.append((f"u{u}", u % 2, z.tolist(), [0.0, logit]))
    d = spark.createDataFrame([*rows, ("none", None, [0.0] * 3, [0.0, 0.0])], "unit_id string, target int, embedding array<double>, instance_logits array<double>")
    w, losses = attention.train_attention(d, 2, epochs=20, rate=0.1)
    assert losses[-1] < 0.5 * losses[0]
    score, _ = encoder.gated_attention(np.array([[3.0, 0, 0], [0.0, 0, 0]]), w)
    assert score[0, 1] > score[1, 1] + 1
    with pytest.raises(ValueError, match="no unit"):
        attention.train_attention(d.where("unit_id = 'none'"), 2)
    with pytest.raises(ValueError, match="outside"):
        attention.train_attention(d.withColumn("target", F.lit(5)), 2)


def test_configured_edges_heads_and_named_models(spark):
    cells = spark.createDataFrame([("u", 0, 0.0, 0.0), ("u", 1, 30.0, 40.0)], "unit_id string, cell_id long, x double, y double")
    e = spark.createDataFrame([("u", 0, 1)], "unit_id string, src long, dst long")
    assert graph.configured_features(e, cells, config.GraphConfig(("neighbor", "distance"))).first().features == [0.0, 50.0]
    z, hidden = np.array([[1.0, -2.0]]), [(np.eye(2), np.zeros(2))]
    assert encoder.instance_logits(z, {"hidden": hidden, "head": np.ones((2, 1)), "head_b": np.zeros(1)})[0, 0] == pytest.approx(1 - 0.02)
    got = readers.named_models(spark, {"b": "y", "a": "x"}, {"a": ["v", "u", "v"]}).collect()
    assert [(r.model, r.checkpoint, r.held_out) for r in got] == [("a", "x", ["u", "v"]), ("b", "y", [])]
    for bad in (({}, None), ({"a": "x"}, {"z": ["u"]})):
        with pytest.raises(ValueError):
            readers.named_models(spark, *bad)
