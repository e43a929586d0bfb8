"""Attention pooling and what each cell adds to its unit's prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaica.functions.scalars import argmax_array, softmax_over


def long_scores(scores: DataFrame, classes: int, *keep: str) -> DataFrame:
    """One row per cell and class: class, logit, attention."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col("instance_logits")[c].alias("logit"), F.col("attention_logits")[c].alias("attention")) for c in range(classes)])
    return scores.select("unit_id", "cell_id", *keep, F.explode(rows).alias("r")).select("unit_id", "cell_id", *keep, "r.*")


def attention_weights(scores: DataFrame, classes: int, key: str = "unit_id") -> DataFrame:
    """(key, cell_id, class, weight): softmax of attention over the cells of a bag, per class."""
    keep = () if key == "unit_id" else (key,)
    long = long_scores(scores, classes, *keep)
    return long.withColumn("weight", softmax_over("attention", key, "class"))


def bag_logits(scores: DataFrame, classes: int, key: str = "unit_id") -> DataFrame:
    """(key, class, logit): attention-weighted sums of cell logits, ordered by bag.

    Two aggregates with map-side combination and a broadcastable maximum: no
    window holds the cells of a bag.
    """
    long = long_scores(scores, classes, *(() if key == "unit_id" else (key,)))
    top = long.groupBy(key, "class").agg(F.max("attention").alias("top"))
    e = long.join(top, [key, "class"]).withColumn("e", F.exp(F.col("attention") - F.col("top")))
    return e.groupBy(key, "class").agg((F.sum(F.col("e") * F.col("logit")) / F.sum("e")).alias("logit")).orderBy(key, "class")


def cell_margins(scores: DataFrame, classes: int, bias: tuple[float, ...], positive: int = 1) -> DataFrame:
    """(unit_id, cell_id, margin): a cell's weighted logit above the bias, positive class less the mean of the rest, times the number of cells of its unit.

    With one output it is that output's. Margins over a unit average to the
    unit's logit above the bias.
    """
    w = attention_weights(scores, classes)
    table = F.array(*[F.lit(float(b)) for b in bias])
    part = F.col("weight") * (F.col("logit") - F.element_at(table, F.col("class") + 1))
    sign = F.lit(1.0) if classes == 1 else F.when(F.col("class") == positive, F.lit(1.0)).otherwise(F.lit(-1.0 / (classes - 1)))
    keys = ["unit_id", "cell_id"]
    summed = w.groupBy(*keys).agg(F.sum(part * sign).alias("m"))
    n = F.count(F.lit(1)).over(Window.partitionBy("unit_id"))
    return summed.select(*keys, (F.col("m") * n).alias("margin"))


def probabilities(logits: Column) -> Column:
    """Softmax of an array."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def prediction_frame(logits: DataFrame, kind: str, outputs: int, key: str = "unit_id") -> DataFrame:
    """Predictions of bags from (key, class, logit): prob_c and pred for classes, pred or pred_c for regression, risk for survival."""
    wide = logits.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "logit"))), lambda r: r["logit"]).alias("__l"))
    if kind == "classification":
        p = wide.withColumn("__p", probabilities(F.col("__l")))
        return p.select(key, *[F.col("__p")[c].alias(f"prob_{c}") for c in range(outputs)], argmax_array("__p").alias("pred"))
    if kind == "regression":
        names = ["pred"] if outputs == 1 else [f"pred_{c}" for c in range(outputs)]
        return wide.select(key, *[F.col("__l")[c].alias(n) for c, n in enumerate(names)])
    if kind == "survival":
        return wide.select(key, F.col("__l")[0].alias("risk"))
    raise ValueError(f"unknown kind of target: {kind}")


def score_columns(frame: DataFrame) -> list[str]:
    """Columns with predictions: prob_*, pred_* and risk."""
    return [c for c in frame.columns if c.startswith(("prob_", "pred_")) or c == "risk"]


def patient_frame(frame: DataFrame, targets: tuple[str, ...] = ("target",), patient: str = "patient_id") -> DataFrame:
    """Predictions of patients: means of scores over units, number of units, targets; the class is argued anew.

    A target that varies within a patient is an error.
    """
    cols = score_columns(frame)
    agg = [F.countDistinct("unit_id").alias("n_units"), *[F.avg(c).alias(c) for c in cols]]
    for t in targets:
        one = F.when(F.count_distinct(t) > 1, F.raise_error(F.lit(f"{t} varies within a patient"))).otherwise(F.min(t))
        agg.append(one.alias(t))
    out = frame.groupBy(patient).agg(*agg)
    probs = [c for c in cols if c.startswith("prob_")]
    return out.withColumn("pred", argmax_array(F.array(*probs))) if probs else out
