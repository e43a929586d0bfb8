"""Readers of cohort files: cells, manifests, labels, folds, polygons, metrics, caches."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "h5ad": "h5ad", "sce": "sce", "rds": "sce", "parquet": "parquet"}
#: Formats whose libraries are not part of Spark; export them to parquet first.
NOT_READ = ("h5ad", "sce")
SCHEMA_VERSION = 3


def input_type_of(path: str, declared: str | None = None) -> str:
    """The kind of a cell file: what is declared, else what the suffix says; unknown kinds are an error."""
    key = (declared or "").strip().lower() or os.path.splitext(path)[1].lstrip(".").lower()
    if key not in KINDS:
        raise ValueError(f"unknown input type {key!r} of {path}")
    return KINDS[key]


def _headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return _headers(spark.read.option("header", True).option("sep", sep).csv(path))


def sound_cells(cells: DataFrame) -> DataFrame:
    """`cells` where a position or feature that is missing or not finite is an error when read."""
    bad = F.lit(False)
    for c in ("x", "y"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if "features" in cells.columns:
        bad = bad | F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return cells.withColumn("x", F.when(bad, F.raise_error(F.lit("a coordinate or feature is not finite")).cast("double")).otherwise(F.col("x")))


def numbered(df: DataFrame) -> tuple[DataFrame, Column]:
    """(`df` with what its rows' numbers come from, those numbers as text): from 0 in the order in which the rows are read.

    A row knows its partition and its place there; how many rows come before a
    partition is counted once, and the counts, one for each partition, are
    broadcast.
    """
    at = df.withColumn("__at", F.monotonically_increasing_id())
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r.n) for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(starts, "__part bigint, __before bigint")
    out = at.withColumn("__place", place).join(F.broadcast(table), part == F.col("__part"), "left")
    return out, (F.col("__before") + F.col("__place")).cast("string")


def load_cells(
    spark: SparkSession,
    path: str,
    kind: str | None = None,
    coords: tuple[str, str] = ("x", "y"),
    cell_type: str | None = "cell_type",
    cell_id: str | None = None,
    features: str | list[str] | None = "all",
    sep: str = ",",
) -> tuple[DataFrame, list[str]]:
    """(cells, feature names): (cell_id, x, y, cell_type, features array<double>) of a CSV, TSV or parquet file.

    Headers are stripped. Without an id column cells are numbered from 0 in
    file order. Types are text; a blank one reads "nan". "all" features are the
    numeric columns that aren't used otherwise; a list keeps its order, and a
    name that the file lacks is an error.
    """
    kind = kind or input_type_of(path)
    if kind in NOT_READ:
        raise ValueError(f"{kind} files need a library that Spark lacks; export {path} to parquet")
    if kind == "parquet":
        df = _headers(spark.read.parquet(path))
    else:
        df = _headers(spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else sep).option("inferSchema", True).csv(path))
    lost = [c for c in coords if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks {lost}")
    used = {*coords, cell_type, cell_id}
    numeric = [c for c, t in df.dtypes if re.match("int|bigint|double|float|smallint|tinyint|boolean|decimal|long", t) and c not in used]
    names = numeric if features == "all" else list(features or [])
    if wrong := [c for c in names if c not in df.columns]:
        raise ValueError(f"{path} lacks features {wrong}")
    if cell_id and cell_id in df.columns:
        ids = F.col(cell_id).cast("string")
    else:
        df, ids = numbered(df)
    kinds = F.coalesce(F.col(cell_type).cast("string"), F.lit("nan")) if cell_type and cell_type in df.columns else F.lit(None).cast("string")
    out = df.select(ids.alias("cell_id"), *[F.col(c).cast("double").alias(n) for c, n in zip(coords, ("x", "y"), strict=True)], kinds.alias("cell_type"), F.array(*[F.col(c).cast("double") for c in names]).cast("array<double>").alias("features"))
    return sound_cells(out), names


def clean_manifest(raw: DataFrame, folder: str = "") -> DataFrame:
    """(sample_id, input_path, region_id, ...): text, stripped; a blank region is the sample; regions are unique; relative paths start at the folder."""
    df = raw.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in raw.columns])
    lost = {"sample_id", "input_path"} - set(df.columns)
    if lost:
        raise ValueError(f"the manifest lacks {sorted(lost)}")
    region = F.col("region_id") if "region_id" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("region_id", F.coalesce(F.when(region != "", region), F.col("sample_id")))
    twice = F.count(F.lit(1)).over(Window.partitionBy("region_id")) > 1
    df = df.withColumn("region_id", F.when(twice, F.raise_error(F.lit("region ids must be unique"))).otherwise(F.col("region_id")))
    if folder:
        df = df.withColumn("input_path", F.when(F.col("input_path").rlike(r"^(/|[a-z0-9]+:)"), F.col("input_path")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("input_path"))))
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return clean_manifest(_strings(spark, path), path.rpartition("/")[0])


def encode_labels(raw: DataFrame, id_col: str, targets: list[str], patient_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, codes): (label_id, <targets>, patient_id) and (column, value, code).

    Ids are stripped and unique. A column of numbers stays; any other becomes
    codes of its sorted values, taken from all rows. Rows that lack a target go.
    """
    df = raw.withColumn("label_id", F.trim(F.col(id_col).cast("string")))
    twice = F.count(F.lit(1)).over(Window.partitionBy("label_id")) > 1
    df = df.withColumn("label_id", F.when(twice, F.raise_error(F.lit("label ids must be unique"))).otherwise(F.col("label_id")))
    codes = None
    for t in targets:
        text = F.when(F.trim(F.col(t).cast("string")) != "", F.trim(F.col(t).cast("string")))
        wrong = raw.where(text.isNotNull() & text.try_cast("double").isNull()).limit(1).count()
        if wrong:
            own = raw.select(text.alias("value")).where("value is not null").distinct()
            own = own.select(F.lit(t).alias("column"), "value", (F.row_number().over(Window.orderBy("value")) - 1).cast("double").alias("code"))
            codes = own if codes is None else codes.unionByName(own)
            df = df.withColumn("__v", text).join(F.broadcast(own.select(F.col("value").alias("__v"), F.col("code").alias("__c"))), "__v", "left").drop("__v", t).withColumnRenamed("__c", t)
        else:
            df = df.withColumn(t, text.cast("double"))
    patient = F.col(patient_col).cast("string") if patient_col else F.lit(None).cast("string")
    out = df.dropna(subset=targets).select("label_id", *targets, patient.alias("patient_id"))
    return out, codes if codes is not None else raw.sparkSession.createDataFrame([], "column string, value string, code double")


def read_labels(spark: SparkSession, path: str, id_col: str, targets: list[str], patient_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    return encode_labels(_strings(spark, path), id_col, targets, patient_col)


def whole_classes(labels: DataFrame, target: str) -> DataFrame:
    """`labels` with the target as int; one that isn't whole is an error."""
    v = F.col(target)
    return labels.withColumn(target, F.when(v != F.floor(v), F.raise_error(F.lit(f"{target} has a class that is not a whole number"))).otherwise(v.cast("int")))


def read_ids(spark: SparkSession, value: str | list[str]) -> DataFrame:
    """(id): a list, a JSON list, or a text file with an id per line, blank lines dropped."""
    if not isinstance(value, str):
        return spark.createDataFrame([(str(v),) for v in value], "id string")
    if value.endswith(".json"):
        return spark.read.text(value, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id"))
    return spark.read.text(value).select(F.trim("value").alias("id")).where("id <> ''")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(fold, id) of a JSON list of lists; an id in two folds is an error, one repeated in a fold is not."""
    from mosaica.operators.splits import folds_table, overlapping_ids

    out = folds_table(spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("folds")))
    if not overlapping_ids(out).isEmpty():
        raise ValueError("an id is in more than one fold")
    return out


def _wkt_rings(text: str) -> list[list[list[tuple[float, float]]]]:
    out = []
    for body in re.findall(r"\(\(.*?\)\)", re.sub(r"^\s*(MULTI)?POLYGON\s*", "", text, flags=re.I)):
        out.append([[tuple(map(float, p.split()[:2])) for p in ring.split(",")][:-1] for ring in re.findall(r"\(([^()]+)\)", body)])
    return out


def _geo_rings(g: dict) -> list:
    if g["type"] == "FeatureCollection":
        return [r for f in g["features"] for r in _geo_rings(f)]
    if g["type"] == "Feature":
        return _geo_rings(g["geometry"])
    if g["type"] == "Polygon":
        return [[[tuple(p[:2]) for p in ring[:-1]] for ring in g["coordinates"]]]
    if g["type"] == "MultiPolygon":
        return [[[tuple(p[:2]) for p in ring[:-1]] for poly in g["coordinates"] for ring in poly]]
    raise ValueError(f"not a polygon: {g['type']}")


def load_polygons(spark: SparkSession, path: str, region_id: str) -> DataFrame:
    """(region_id, number, rings) of a GeoJSON file, or of a text file with a WKT polygon per line; a file without any is an error. Polygons of one region are few."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if text.lstrip().startswith("{"):
        rings = _geo_rings(json.loads(text))
    else:
        rings = [[r for poly in _wkt_rings(line) for r in poly] for line in text.splitlines() if line.strip()]
    if not rings:
        raise ValueError(f"{path} has no polygons")
    rows = [(region_id, i, [[(float(x), float(y)) for x, y in ring] for ring in p]) for i, p in enumerate(rings)]
    return spark.createDataFrame(rows, "region_id string, number int, rings array<array<struct<x: double, y: double>>>")


def read_outcomes(spark: SparkSession, path: str, patient: str = "patient_id", time: str = "time", event: str = "event") -> DataFrame:
    df = _strings(spark, path)
    return df.select(F.col(patient).alias("patient_id"), F.col(time).cast("double").alias("time"), F.col(event).cast("double").alias("event"))


def read_epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file with a JSON object per line; blank lines don't count, and a file that isn't there has none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "epoch long")
    return spark.read.json(path)


def open_caches(spark: SparkSession, path: str) -> DataFrame:
    """Scores of all models below `path` (partitions model=...), of which at least two must have held-out units; others go."""
    df = spark.read.option("basePath", path).parquet(path)
    ok = df.where("held_out").select("model").distinct()
    if ok.limit(2).count() < 2:
        raise ValueError("at least two models with held-out units are needed")
    return df.join(F.broadcast(ok), "model", "left_semi")


def resolve_models(summary: DataFrame, oof: DataFrame) -> DataFrame:
    """(model, checkpoint, held_out): each outer fold's checkpoint with the units it predicted.

    `summary`: (outer, checkpoint); `oof`: (outer, unit_id). No fold is an error.
    """
    held = oof.groupBy("outer").agg(F.sort_array(F.collect_set("unit_id")).alias("held_out"))
    out = summary.join(held, "outer", "left").select(F.concat(F.lit("fold"), F.col("outer").cast("string")).alias("model"), "checkpoint", F.coalesce("held_out", F.array().cast("array<string>")).alias("held_out"))
    if out.isEmpty():
        raise ValueError("no models")
    return out


def named_models(spark: SparkSession, checkpoints: dict[str, str], held_out: dict[str, list[str]] | None = None) -> DataFrame:
    """(model, checkpoint, held_out) of models named by hand; none is an error, and so are held-out units of a model that isn't named."""
    if not checkpoints:
        raise ValueError("no models")
    if lost := sorted(set(held_out or {}) - set(checkpoints)):
        raise ValueError(f"held-out units of models that have no checkpoint: {lost}")
    rows = [(m, c, sorted(set((held_out or {}).get(m, [])))) for m, c in sorted(checkpoints.items())]
    return spark.createDataFrame(rows, "model string, checkpoint string, held_out array<string>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The unit index of a processed cohort; another version is an error."""
    df = spark.read.parquet(path)
    v = df.select("schema_version").distinct().limit(2).collect()
    if [r[0] for r in v] != [SCHEMA_VERSION]:
        raise ValueError(f"index of version {[r[0] for r in v]}; {SCHEMA_VERSION} is needed")
    return df
