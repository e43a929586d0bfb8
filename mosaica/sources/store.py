"""Tables that one command writes and a later one reads: units with their graphs, score caches, niche models, weights, result sets."""

from __future__ import annotations

import base64
import io
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.config import Closed, ClusteringConfig, InputSpec, InteriorConfig, fingerprint
from mosaica.operators import cluster, graph, niches
from mosaica.sources.readers import SCHEMA_VERSION, read_index
from mosaica.sources.sinks import pending_units, read_scores, report, write_scores, write_table, write_text

Tables = dict[str, DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    write_text(spark, json.dumps(value, sort_keys=True), path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


# ---- units and their graphs ----------------------------------------------------------------------------------------


def write_units(cells: DataFrame, edges: DataFrame, spec: InputSpec, path: str) -> None:
    """Cells and edges of units, an index of a row for each unit with the version of the layout, and what a model must match."""
    write_table(cells, f"{path}/cells")
    write_table(edges, f"{path}/edges")
    kept = [c for c in ("region_id", "sample_id", "patient_id", "label_id") if c in cells.columns]
    n_edges = edges.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_edges"))
    index = cells.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_cells"), *[F.first(c).alias(c) for c in kept]).join(n_edges, "unit_id", "left")
    write_table(index.withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("long"))).withColumn("schema_version", F.lit(SCHEMA_VERSION)), f"{path}/index")
    write_json(cells.sparkSession, spec.as_dict(), f"{path}/spec")


@dataclass
class Units:
    """Units as `write_units` left them, all or some."""

    index: DataFrame
    cells: DataFrame
    edges: DataFrame
    spec: InputSpec

    def some(self, unit_ids: DataFrame) -> Units:
        """The units of a column unit_id; one that is not there is an error."""
        wanted = unit_ids.select("unit_id").distinct()
        if not wanted.join(self.index, "unit_id", "left_anti").isEmpty():
            raise ValueError("a unit that is asked for is not there")
        return Units(*(d.join(wanted, "unit_id", "left_semi") for d in (self.index, self.cells, self.edges)), self.spec)


def read_units(spark: SparkSession, path: str, expected: InputSpec | None = None) -> Units:
    """Units of a folder; another version of the layout, or an input that a model does not expect, is an error."""
    spec = InputSpec.from_dict(read_json(spark, f"{path}/spec"))
    if expected is not None:
        spec.check_matches(expected, "the input")
    return Units(read_index(spark, f"{path}/index"), spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/edges"), spec)


def cached_interior(cells: DataFrame, edges: DataFrame, cfg: InteriorConfig, depth: int, path: str) -> DataFrame:
    """(unit_id, cell_id) of units' interiors: found once for each configuration and depth, then read."""
    spark, at = cells.sparkSession, f"{path}/interior-{fingerprint(cfg, str(depth))}"
    if not exists(spark, f"{at}/_SUCCESS"):
        write_table(graph.interior_cells(cells, edges, depth if cfg.n_hops is None else cfg.n_hops, cfg.hull_tolerance, cfg.keep_largest_component), at)
    return spark.read.parquet(at)


# ---- score caches --------------------------------------------------------------------------------------------------


@dataclass
class CellCache:
    """Scores of a model's cells in a folder, stamped with what they depend on; units that are there are not scored again."""

    path: str
    model: str
    stamp: str

    def pending(self, units: DataFrame) -> DataFrame:
        spark = units.sparkSession
        if not exists(spark, f"{self.path}/model={self.model}/stamp={self.stamp}"):
            return units
        done = read_scores(spark, self.path, self.model, self.stamp).select("unit_id", F.lit(self.stamp).alias("stamp"))
        return pending_units(units, done, self.stamp)

    def add(self, scores: DataFrame) -> None:
        write_scores(scores, self.path, self.model, self.stamp)

    def load(self, spark: SparkSession, units: DataFrame | None = None, spaces: tuple[str, ...] | None = None) -> DataFrame:
        """Scores of all units or of those asked for, which must all be there; of the named vector columns if any are named."""
        out = read_scores(spark, self.path, self.model, self.stamp)
        if units is not None:
            wanted = units.select("unit_id").distinct()
            if not wanted.join(out, "unit_id", "left_anti").isEmpty():
                raise ValueError(f"{self.path}: a unit has no scores of model {self.model}")
            out = out.join(wanted, "unit_id", "left_semi")
        if spaces is not None:
            if lost := sorted(set(spaces) - set(out.columns)):
                raise ValueError(f"{self.path} lacks {lost}")
            out = out.drop(*({"embedding", "attention_space"} - set(spaces)))
        return out


def check_aligned(votes: DataFrame) -> None:
    """An error if a unit's cells are not the same for all models that have it; `votes`: (model, unit_id, cell_id)."""
    per = votes.groupBy("unit_id", "model").agg(F.count_distinct("cell_id").alias("n"), F.sum(F.xxhash64("cell_id").cast("decimal(38,0)")).alias("h"))
    wrong = per.groupBy("unit_id").agg(F.count_distinct("n").alias("n"), F.count_distinct("h").alias("h")).where("n > 1 or h > 1")
    if not wrong.isEmpty():
        raise ValueError("the caches of the models hold different cells")


# ---- models --------------------------------------------------------------------------------------------------------


def write_weights(spark: SparkSession, weights: dict, spec: InputSpec, path: str) -> None:
    """Weights, as nested dictionaries and lists of arrays, with the input that they expect."""

    def packed(value: object) -> object:
        if isinstance(value, dict):
            return {k: packed(v) for k, v in value.items()}
        if isinstance(value, list):
            return [packed(v) for v in value]
        if isinstance(value, np.ndarray):
            out = io.BytesIO()
            np.save(out, value, allow_pickle=False)
            return {"__array": base64.b64encode(out.getvalue()).decode()}
        return value

    write_json(spark, {"weights": packed(weights), "spec": spec.as_dict()}, path)


def read_weights(spark: SparkSession, path: str, spec: InputSpec | None = None) -> dict:
    """Weights as they were written; if given, `spec` must be the input that they expect."""

    def unpacked(value: object) -> object:
        if isinstance(value, dict):
            if set(value) == {"__array"}:
                return np.load(io.BytesIO(base64.b64decode(value["__array"])), allow_pickle=False)
            return {k: unpacked(v) for k, v in value.items()}
        return [unpacked(v) for v in value] if isinstance(value, list) else value

    held = read_json(spark, path)
    if spec is not None:
        InputSpec.from_dict(held["spec"]).check_matches(spec, "the input of the weights")
    return unpacked(held["weights"])


@dataclass
class NicheModel:
    """A clustering that can be applied to new cells: the sample with its clusters, their numbers, and the projection before it."""

    sample: DataFrame
    numbers: DataFrame
    cfg: ClusteringConfig
    pca: tuple[np.ndarray, np.ndarray] | None = None

    def predict(self, cells: DataFrame) -> DataFrame:
        """(cell_id, niche) of cells with a column `space`, by vote of the nearest of the sample."""
        s = cells.select("cell_id", "space")
        if self.pca is not None:
            s = cluster.pca_transform(s, self.pca)
        voted = niches.knn_vote(s, self.sample, self.cfg.assign_k, cosine=self.cfg.metric == "cosine")
        return voted.join(F.broadcast(self.numbers.select("cluster", "niche")), "cluster").select("cell_id", "niche")

    def write(self, path: str) -> None:
        spark = self.sample.sparkSession
        write_table(self.sample, f"{path}/sample")
        write_table(self.numbers, f"{path}/numbers")
        write_weights(spark, {"pca": list(self.pca) if self.pca is not None else None, "cfg": self.cfg.as_dict()}, InputSpec(), f"{path}/model")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> NicheModel:
        held = read_weights(spark, f"{path}/model")
        pca = tuple(held["pca"]) if held["pca"] is not None else None
        return cls(spark.read.parquet(f"{path}/sample"), spark.read.parquet(f"{path}/numbers"), ClusteringConfig.from_dict(held["cfg"]), pca)


# ---- result sets ---------------------------------------------------------------------------------------------------


def write_set(tables: Tables, path: str, settings: dict[str, Closed] | None = None, kind: str = "parquet", text: str | None = None) -> None:
    """Tables by name, the settings they were made with and, if given, a report; tables that are None are left out."""
    spark = None
    for name, df in tables.items():
        if df is not None:
            spark = df.sparkSession
            write_table(df, f"{path}/{name}", kind)
    if spark is None:
        raise ValueError("no table to write")
    write_json(spark, {k: v.as_dict() for k, v in (settings or {}).items()}, f"{path}/settings")
    if text is not None:
        write_text(spark, text, f"{path}/report")


def read_set(spark: SparkSession, path: str, names: list[str]) -> Tables:
    """Tables of a set that was written as parquet."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_analysis(analysis, path: str, settings: dict[str, Closed] | None = None) -> None:
    """All tables of a niche analysis, its settings and its report."""
    tables = {"cells": analysis.assigned, "niches": analysis.table, "shares": analysis.shares, "margins": analysis.margins, "colocalisation": analysis.colocalisation, "cox": analysis.cox, "groups": analysis.groups}
    tables |= {f"descriptors_{k}": v for k, v in analysis.descriptors.items()}
    write_set(tables, path, settings, text=report(analysis.table, analysis.descriptors.get("moran"), analysis.cox))


def write_statistics(results: dict[str, tuple[DataFrame, DataFrame]], path: str, settings: dict[str, Closed] | None = None) -> None:
    """The values of units and the tests of each analysis, and the values once more with a column for each metric."""
    tables: Tables = {}
    for name, (values, tests) in results.items():
        names = sorted(r[0] for r in values.select("metric").distinct().collect())  # metrics are pairs of types, radii or neighbourhoods
        tables |= {f"{name}_values": values, f"{name}_tests": tests, f"{name}_wide": values.groupBy("unit_id").pivot("metric", names).agg(F.first("value"))}
    write_set({k: v.toDF(*[c.replace("|", "_").replace(" ", "_") for c in v.columns]) for k, v in tables.items()}, path, settings)


def write_folds_result(per_fold: DataFrame, summary: DataFrame, oof: DataFrame, path: str, settings: dict[str, Closed] | None = None) -> None:
    """What a nested cross-validation leaves: each fold's value, the summary, the out-of-fold predictions."""
    write_set({"folds": per_fold, "summary": summary, "oof": oof}, path, settings)
