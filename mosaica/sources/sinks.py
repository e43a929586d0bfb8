"""Where results go: tables, per-unit scores that resume, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.operators.metrics import frame_metrics


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition: str | None = None) -> None:
    """A result table as parquet, CSV with a header, or JSON; replaced as a whole, after it has been written in full."""
    w = df.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition)
    if kind == "csv":
        w.option("header", True).csv(path)
    else:
        getattr(w, kind)(path)


def pending_units(units: DataFrame, done: DataFrame, stamp: str) -> DataFrame:
    """Units without a finished result of the same stamp."""
    return units.join(done.where(F.col("stamp") == stamp).select("unit_id").distinct(), "unit_id", "left_anti")


def write_scores(scores: DataFrame, path: str, model: str, stamp: str) -> None:
    """Add scores of units to a model's partition of one stamp, which `read_scores` and `pending_units` look for; another stamp's are left where they are."""
    scores.write.mode("append").parquet(f"{path}/model={model}/stamp={stamp}")


def read_scores(spark: SparkSession, path: str, model: str, stamp: str) -> DataFrame:
    """A model's scores of one stamp; a unit that was written twice, as by a run that failed later, counts once for each cell."""
    return spark.read.parquet(f"{path}/model={model}/stamp={stamp}").dropDuplicates(["unit_id", "cell_id"])


def append_metrics(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Epoch metrics as JSON lines; undefined values are left out. A numbered batch has a folder of its own, which a second try replaces."""
    cols = [F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    out = df.select(*cols).write
    if batch is None:
        out.mode("append").json(path)
    else:
        out.mode("overwrite").json(f"{path}/batch={batch}")


def report(niches: DataFrame, moran: DataFrame | None = None, cox: DataFrame | None = None) -> str:
    """A short account in Markdown: the niche table, the ten strongest Moran's I with q below 0.05, the ten smallest Cox p. Bounded by niches and these limits."""
    out = ["# Niches", ""]

    def add(title: str, df: DataFrame) -> None:
        rows = df.collect()
        out.extend([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)])
        out.extend("| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)
        out.append("")

    add("Table", niches)
    if moran is not None:
        add("Moran's I", moran.where("q < 0.05").orderBy(F.desc("mean_i")).limit(10))
    if cox is not None:
        add("Cox", cox.orderBy(F.asc_nulls_last("p")).limit(10))
    return "\n".join(out)


def write_predictions(frame: DataFrame, path: str, kind: str, n_units: int | None = None) -> DataFrame | None:
    """Write a prediction table and, if every unit has a target, its metrics, which are returned."""
    write_table(frame, f"{path}/predictions", "csv")
    labelled = frame.where(F.col("target").isNotNull()).count() if "target" in frame.columns else 0
    if not labelled or labelled != (n_units or frame.count()):
        return None
    found = frame_metrics(frame, kind)
    write_table(found, f"{path}/metrics", "json")
    return found


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
