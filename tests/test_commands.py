from pyspark.sql import functions as F

from mosaica.config import BuildConfig, ClusteringConfig, DescriptorConfig, SpatialStatsConfig, TilingConfig
from mosaica.operators import graph
from mosaica.plans import commands
from mosaica.sources import fixture


def cohort(spark, data):
    c = fixture.cells(spark, data).withColumn("patient_id", F.col("sample_id"))
    return c, graph.delaunay_edges(c).persist(), c.select("patient_id", (F.col("label") == 1).alias("positive")).distinct()


def test_units(spark, data):
    c = fixture.cells(spark, data).withColumnRenamed("unit_id", "region_id")
    assert commands.build_units(c).count() == c.count()
    t = commands.build_units(c, BuildConfig(unit="tile", min_cells=1), TilingConfig(60, 60))
    assert t.count() == c.count() and t.select("unit_id").distinct().count() > c.select("region_id").distinct().count()


def test_spatial_stats(spark, data):
    c, e, labels = cohort(spark, data)
    out = commands.spatial_stats(c, e, labels, SpatialStatsConfig(reference=("purchase",), min_patients=3, n_neighbourhoods=3, window=4))
    assert set(out) == {"enrichment", "neighbourhoods", "contacts", "cross_l"}
    for values, tests in out.values():
        assert values.count() > 0 and tests.where("p between 0 and 1").count() > 0


def test_niches(spark, data):
    c, e, _ = cohort(spark, data)
    s = c.withColumn("space", F.array("x", "y")).withColumn("instance_logits", F.array(F.col("x") / 100, F.col("y") / 100)).withColumn("attention_logits", F.array(F.col("feature") / 50, F.lit(0.0)))
    s = s.withColumn("positive", F.col("label") == 1)
    outcomes = c.select("patient_id", (F.col("user_id") * 7 % 13).cast("double").alias("time"), (F.col("user_id") % 2).cast("double").alias("event")).distinct()
    clusters = commands.cluster_cells(s, ClusteringConfig(method="kmeans", n_clusters=3, metric="euclidean"))
    a = commands.analyse_niches(s, e, (0.0, 0.0), descriptors=DescriptorConfig(min_cells=4, n_radii=3), outcomes=outcomes, clusters=clusters)
    assert [r.niche for r in a.table.collect()] == [1, 2, 3]
    assert abs(a.shares.groupBy("unit_id").agg(F.sum("share").alias("s")).agg(F.max("s")).first()[0] - 1) < 1e-9
    assert set(a.descriptors) == {"moran", "enrichment", "contacts", "cross_l"} and all(d.count() > 0 for d in a.descriptors.values())
    assert a.cox.count() == 3 and a.margins.count() == 3


def test_predictions_and_folds(spark, data):
    s = fixture.scores(spark, data).withColumn("unit_id", F.col("unit_id").cast("string")).withColumn("patient_id", F.col("patient_id").cast("string"))
    units, patients = commands.predict_units(s, "classification", 2)
    _, merged = commands.predict_units(s, "classification", 2, merge_patients=True)
    assert units.count() == 20 and patients.count() == merged.count() == 10
    oof = units.withColumn("outer", F.col("unit_id").cast("int") % 2)
    oof = oof.withColumn("target", (F.col("unit_id").cast("int") % 3 == 0).cast("int"))
    per, summary = commands.nested_cv_summary(oof, "classification", "auroc")
    assert per.count() == 2 and summary.first().n_folds == 2


def test_replication(spark, data):
    from mosaica import catalog

    assigned = {f"m{m}": catalog._assigned(spark, data, m).withColumn("held_out", F.col("unit_id") % 2 == m).persist() for m in (0, 1)}
    from mosaica.operators import niches

    tables = {m: niches.niche_table(a).where("niche <> 0") for m, a in assigned.items()}
    out = commands.replicate_niches(tables, assigned, [0.15, 0.3, 0.6])
    assert out["metaclusters"].count() > 0 and out["scan"].count() == 3
    for name in ("matched", "composition", "unit_shares", "patient_tests", "transfer", "votes"):
        assert out[name].count() > 0
