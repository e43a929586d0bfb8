"""Commands over parquet tables: python -m mosaica COMMAND --in DIR --out DIR [--config FILE].

The configuration is JSON: a dictionary of parameters for each class that a
command names. Tables are read from DIR by name and results are written as a
set of tables with the settings they were made with.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from mosaica.config import BuildConfig, ClusteringConfig, DescriptorConfig, GraphConfig, InputSpec, SpatialStatsConfig, SurvivalConfig, TilingConfig
from mosaica.operators import graph
from mosaica.plans import commands
from mosaica.plans.ship import ship
from mosaica.sources import store


def build(spark: SparkSession, source: str, out: str, cfg: dict) -> None:
    """cells, and polygons if they are there, to units with their graphs."""
    polygons = spark.read.parquet(f"{source}/polygons") if store.exists(spark, f"{source}/polygons") else None
    units = commands.build_units(spark.read.parquet(f"{source}/cells"), BuildConfig.from_dict(cfg.get("build")), TilingConfig.from_dict(cfg.get("tiling")), polygons)
    g = GraphConfig.from_dict(cfg.get("graph"))
    edges = graph.edge_features(graph.delaunay_edges(units), units, *g.log_distance_bounds, g.neighbor_cutoff)
    types = tuple(sorted(r[0] for r in units.select("cell_type").distinct().collect() if r[0] is not None))
    store.write_units(units, edges, InputSpec(("feature",) if "feature" in units.columns else (), types, g.edge_features), out)


def statistics(spark: SparkSession, source: str, out: str, cfg: dict) -> None:
    """Units and labels to the values and tests of spatial statistics."""
    c = SpatialStatsConfig.from_dict(cfg.get("spatial_stats"))
    units = store.read_units(spark, source)
    store.write_statistics(commands.spatial_stats(units.cells, units.edges, spark.read.parquet(f"{source}/labels"), c), out, {"spatial_stats": c})


def niches(spark: SparkSession, source: str, out: str, cfg: dict) -> None:
    """scores and edges, and outcomes if they are there, to niches and their description."""
    parts = {"clustering": ClusteringConfig.from_dict(cfg.get("clustering")), "descriptors": DescriptorConfig.from_dict(cfg.get("descriptors")), "survive": SurvivalConfig.from_dict(cfg.get("survival"))}
    outcomes = spark.read.parquet(f"{source}/outcomes") if store.exists(spark, f"{source}/outcomes") else None
    bias = tuple(cfg.get("bias", (0.0, 0.0)))
    found = commands.analyse_niches(spark.read.parquet(f"{source}/scores"), spark.read.parquet(f"{source}/edges"), bias, outcomes=outcomes, **parts)
    store.write_analysis(found, out, parts)


def predict(spark: SparkSession, source: str, out: str, cfg: dict) -> None:
    """scores to predictions of units and patients."""
    units, patients = commands.predict_units(spark.read.parquet(f"{source}/scores"), cfg.get("kind", "classification"), int(cfg.get("classes", 2)), bool(cfg.get("merge_patients", False)))
    store.write_set({"units": units, "patients": patients}, out)


def crossvalidation(spark: SparkSession, source: str, out: str, cfg: dict) -> None:
    """Out-of-fold predictions (oof) to their values by fold and their summary."""
    oof = spark.read.parquet(f"{source}/oof")
    store.write_folds_result(*commands.nested_cv_summary(oof, cfg.get("kind", "classification"), cfg.get("metric", "auroc")), oof, out)


def metaclusters(spark: SparkSession, source: str, out: str, cfg: dict) -> None:
    """niches and assigned, each with a column model, to matched niches and what becomes of them."""
    tables, assigned = spark.read.parquet(f"{source}/niches"), spark.read.parquet(f"{source}/assigned")
    models = sorted(r[0] for r in tables.select("model").distinct().collect())
    of = lambda df: {m: df.where(df["model"] == m).drop("model") for m in models}
    thresholds = cfg.get("thresholds") or [round(0.15 + 0.01 * k, 2) for k in range(46)]
    store.write_set(commands.replicate_niches(of(tables), of(assigned), thresholds, int(cfg.get("min_models", 2))), out)


COMMANDS = {"build": build, "spatial-stats": statistics, "niches": niches, "predict": predict, "cross-validation": crossvalidation, "metaclusters": metaclusters}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mosaica", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--in", dest="source", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", help="a JSON file, or JSON itself")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"mosaica {args.command}").getOrCreate()
    ship(spark)
    given = args.config or "{}"
    cfg = json.loads(given) if given.lstrip().startswith("{") else store.read_json(spark, given)
    COMMANDS[args.command](spark, args.source, args.out, cfg)


if __name__ == "__main__":
    main()
