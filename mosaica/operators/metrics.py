"""Losses and metrics of prediction tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_weights(labels: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """(class, weight): rows over (classes present times rows of the class), 1 for an absent class, scaled to mean 1."""
    spark = labels.sparkSession
    n = labels.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("c"))
    total = n.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("present"))
    every = spark.range(classes).select(F.col("id").cast("int").alias("class"))
    raw = every.join(n, "class", "left").crossJoin(F.broadcast(total)).withColumn("w", F.coalesce(F.col("n") / (F.col("present") * F.col("c")), F.lit(1.0)))
    mean = raw.agg(F.avg("w").alias("m"))
    return raw.crossJoin(F.broadcast(mean)).select("class", (F.col("w") / F.col("m")).alias("weight"))


def auroc(df: DataFrame, score: str, positive: str, *keys: str) -> DataFrame:
    """(keys, auroc): share of pairs in order, ties a half; null where one kind is missing. Ranks are by distinct score."""
    per = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col(positive).cast("long")).alias("t1"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(score)
    per = per.withColumn("rank", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("t") - 1) / 2.0)
    s = per.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum("t1").alias("n1"), F.sum(F.col("rank") * F.col("t1")).alias("r"))
    n1, n0 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    return s.select(*keys, F.when((n1 > 0) & (n0 > 0), (F.col("r") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"))


def class_metrics(frame: DataFrame, classes: int, target: str = "target") -> DataFrame:
    """One row: loss (mean log loss, unweighted), acc, bal_acc, auroc (binary, else the mean of one against the rest).

    bal_acc and auroc are null where one class only is there; classes without
    rows don't count in either. Rows without a target are left out.
    """
    f = frame.where(F.col(target).isNotNull()).withColumn("t", F.col(target).cast("int"))
    probs = F.array(*[F.col(f"prob_{c}") for c in range(classes)])
    hit = (F.col("pred") == F.col("t")).cast("double")
    base = f.agg(F.avg(-F.ln(F.greatest(F.element_at(probs, F.col("t") + 1), F.lit(1e-12)))).alias("loss"), F.avg(hit).alias("acc"), F.count_distinct("t").alias("k"))
    recall = f.groupBy("t").agg(F.avg(hit).alias("r")).agg(F.avg("r").alias("bal"))
    if classes == 2:
        auc = auroc(f.withColumn("p", F.col("t") == 1), "prob_1", "p").select("auroc")
    else:
        rows = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"prob_{c}").alias("s"), (F.col("t") == c).alias("p")) for c in range(classes)])
        auc = auroc(f.select(F.explode(rows).alias("r")).select("r.*"), "s", "p", "c").agg(F.avg("auroc").alias("auroc"))
    out = base.crossJoin(F.broadcast(recall)).crossJoin(F.broadcast(auc))
    two = F.col("k") > 1
    return out.select("loss", "acc", F.when(two, F.col("bal")).alias("bal_acc"), F.when(two, F.col("auroc")).alias("auroc"))


def regression_metrics(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row over (prediction, target) columns: loss, rmse, mae, r2 (null if any target is constant) and pearson, each the mean over columns."""
    agg = []
    for i, (p, t) in enumerate(pairs):
        e = F.col(p) - F.col(t)
        agg += [F.avg(e * e).alias(f"mse{i}"), F.avg(F.abs(e)).alias(f"mae{i}"), F.var_pop(t).alias(f"var{i}"), F.try_divide(F.covar_pop(p, t), F.sqrt(F.var_pop(p)) * F.sqrt(F.var_pop(t))).alias(f"r{i}")]
    one = frame.agg(*agg)
    k = len(pairs)
    mean = lambda f: sum((f(i) for i in range(k)), F.lit(0.0)) / k
    const = F.least(*[F.col(f"var{i}") for i in range(k)]) if k > 1 else F.col("var0")
    r2 = mean(lambda i: 1 - F.col(f"mse{i}") / F.col(f"var{i}"))
    return one.select(mean(lambda i: F.col(f"mse{i}")).alias("loss"), F.sqrt(mean(lambda i: F.col(f"mse{i}"))).alias("rmse"), mean(lambda i: F.col(f"mae{i}")).alias("mae"), F.when(const > 0, r2).alias("r2"), mean(lambda i: F.col(f"r{i}")).alias("pearson"))


def concordance(df: DataFrame, risk: str = "risk", time: str = "time", event: str = "event") -> DataFrame:
    """One row: the share of comparable pairs in which the higher risk dies first, ties a half.

    i and j compare if i died and j lived longer, or was censored at the same
    time. Rows are summed by distinct risk, time and event first; deaths then
    meet all later rows, which is quadratic in the number of patients and meant
    for cohorts, not for cells.
    """
    d = df.select(F.col(risk).alias("r"), F.col(time).alias("t"), F.col(event).cast("boolean").alias("e")).where("r is not null and t is not null")
    i, j = d.where("e").groupBy("r", "t").agg(F.count(F.lit(1)).alias("n")).alias("i"), d.groupBy("r", "t", "e").agg(F.count(F.lit(1)).alias("n")).alias("j")
    ok = (F.col("i.t") < F.col("j.t")) | ((F.col("i.t") == F.col("j.t")) & ~F.col("j.e"))
    w = F.when(F.col("i.r") > F.col("j.r"), 1.0).when(F.col("i.r") == F.col("j.r"), 0.5).otherwise(0.0)
    n = (F.col("i.n") * F.col("j.n")).cast("double")
    out = i.join(j, ok).agg(F.sum(n).alias("pairs"), F.sum(n * w).alias("won"))
    return out.select(F.when(F.col("pairs") > 0, F.col("won") / F.col("pairs")).alias("c_index"), F.coalesce(F.col("pairs"), F.lit(0.0)).cast("long").alias("n_pairs"))


def cox_loss(df: DataFrame, risk: str = "risk", time: str = "time", event: str = "event", l2: float = 0.0) -> DataFrame:
    """One row: the negative Breslow log partial likelihood over the number of events, plus l2 times the mean squared risk; 0 without events.

    Rows are summed by distinct time first; the running sum over the risk sets
    goes over distinct times only.
    """
    d = df.select(F.col(risk).cast("double").alias("r"), F.col(time).alias("t"), F.col(event).cast("int").alias("e"))
    top = d.agg(F.max("r").alias("top"))
    per = d.crossJoin(F.broadcast(top)).groupBy("t").agg(F.sum(F.exp(F.col("r") - F.col("top"))).alias("s"), F.sum("e").alias("d"), F.sum(F.col("e") * F.col("r")).alias("er"), F.first("top").alias("top"), F.sum(F.col("r") * F.col("r")).alias("r2"), F.count(F.lit(1)).alias("n"))
    at_risk = F.sum("s").over(Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("log", F.ln(at_risk) + F.col("top"))
    out = per.agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("log") - F.col("er")).alias("nll"), F.sum("r2").alias("r2"), F.sum("n").alias("n"))
    return out.select((F.when(F.col("d") > 0, F.col("nll") / F.col("d")).otherwise(0.0) + l2 * F.col("r2") / F.col("n")).alias("loss"), F.col("d").cast("long").alias("n_events"))


def cross_entropy(frame: DataFrame, classes: int, weights: dict[int, float] | None = None, target: str = "target") -> DataFrame:
    """One row: the mean over rows of a class's weight (1 without) times the log loss of columns logit_0 on; rows without a target are left out."""
    logits = F.array(*[F.col(f"logit_{c}").cast("double") for c in range(classes)])
    top = F.array_max(logits)
    log_sum = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    weight = F.element_at(F.array(*[F.lit(float((weights or {}).get(c, 1.0))) for c in range(classes)]), F.col(target).cast("int") + 1)
    return frame.where(F.col(target).isNotNull()).agg(F.avg(weight * (log_sum - F.element_at(logits, F.col(target).cast("int") + 1))).alias("loss"))


def huber(frame: DataFrame, pairs: list[tuple[str, str]], delta: float = 1.0) -> DataFrame:
    """One row: the Huber loss, a mean over rows and (prediction, target) columns."""
    if delta <= 0:
        raise ValueError("delta must be positive")
    total = F.lit(0.0)
    for p, t in pairs:
        gap = F.abs(F.col(p) - F.col(t))
        total = total + F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))
    return frame.agg((F.avg(total) / len(pairs)).alias("loss"))


def check_classes(splits: dict[str, DataFrame], classes: int, label: str = "label") -> None:
    """An error if a split has a label that is no class 0 to classes - 1; nulls don't count."""
    for name, df in splits.items():
        wrong = df.where(F.col(label).isNotNull() & ((F.col(label) < 0) | (F.col(label) >= classes) | (F.col(label) != F.floor(label))))
        if bad := sorted(r[0] for r in wrong.select(label).distinct().limit(10).collect()):
            raise ValueError(f"{name}: labels {bad} are outside 0..{classes - 1}")


def frame_metrics(frame: DataFrame, kind: str, target: str = "target") -> DataFrame:
    """Metrics of a prediction table by its column names; classes from prob_*, regression from pred or pred_*, survival from risk."""
    if kind == "classification":
        k = len([c for c in frame.columns if c.startswith("prob_")])
        return class_metrics(frame, k, target)
    if kind == "regression":
        many = sorted(c for c in frame.columns if c.startswith("pred_"))
        pairs = [(c, f"target_{c.removeprefix('pred_')}") for c in many] or [("pred", target)]
        return regression_metrics(frame, pairs)
    return concordance(frame)


def output_dim(kind: str, classes: int = 2, targets: int = 1) -> int:
    if kind == "classification":
        if classes < 2:
            raise ValueError("classification needs two classes")
        return classes
    return targets if kind == "regression" else 1


def best_epoch(metrics: DataFrame, metric: str, mode: str = "max", run: str = "run") -> DataFrame:
    """(run, best_epoch), counted from 1: the earliest epoch with the best metric; without it the least val/loss; without that the last."""
    m = metrics.where(F.col("epoch").isNotNull())
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    loss = clean("`val/loss`") if "val/loss" in metrics.columns else F.lit(None).cast("double")
    v = clean(f"`{metric}`") if metric in metrics.columns else F.lit(None).cast("double")
    m = m.withColumn("__v", v * (1 if mode == "max" else -1)).withColumn("__l", -loss)
    out = m.groupBy(run).agg(F.max_by("epoch", F.when(F.col("__v").isNotNull(), F.struct("__v", -F.col("epoch")))).alias("a"), F.max_by("epoch", F.when(F.col("__l").isNotNull(), F.struct("__l", -F.col("epoch")))).alias("b"), F.max("epoch").alias("c"))
    return out.select(run, (F.coalesce("a", "b", "c") + 1).cast("int").alias("best_epoch"))


def reduce_epochs(epochs: DataFrame, how: str, minimum: int, *keys: str) -> DataFrame:
    """(keys, epochs): median, mean or maximum of best epochs, rounded half to even, at least `minimum`."""
    f = {"median": F.expr("percentile(best_epoch, 0.5)"), "mean": F.avg("best_epoch"), "max": F.max("best_epoch").cast("double")}[how]
    return epochs.groupBy(*keys).agg(F.greatest(F.bround(f, 0).cast("int"), F.lit(minimum)).alias("epochs"))


def cv_summary(folds: DataFrame, metric: str = "value", name: str = "metric") -> DataFrame:
    """(metric, mean, sd, n_folds) over finite values of folds; sd of a sample, null with one."""
    ok = folds.where(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < math.inf))
    return ok.groupBy(name).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(F.lit(1)).alias("n_folds"))
