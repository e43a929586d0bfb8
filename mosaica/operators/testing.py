"""Group tests: patients' values, ranks, false discovery, clustered resampling."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaica.functions.scalars import normal_two_sided


def with_q(df: DataFrame, p: str = "p", within: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    """`df` with Benjamini-Hochberg q values of `p`, over all rows or within groups; null p gets null and doesn't count.

    The rank of equal p values is their last place; the running minimum goes
    from the largest p down.
    """
    keys = [*within] or ["__all"]
    base = df if within else df.withColumn("__all", F.lit(0))
    base = base.withColumn("__known", F.col(p).isNotNull())
    rank = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__known").orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    m = F.count(p).over(Window.partitionBy(*keys))
    raw = base.withColumn("__raw", F.col(p) * m / rank)
    down = Window.partitionBy(*keys, "__known").orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.when(F.col("__known"), F.least(F.lit(1.0), F.min("__raw").over(down)))
    return raw.withColumn(out, q).drop("__all", "__known", "__raw")


def patient_labels(units: DataFrame, positive: str = "positive", patient: str = "patient_id") -> DataFrame:
    """(patient_id, positive): whether any unit is; units without a label count as negative."""
    return units.groupBy(patient).agg(F.coalesce(F.bool_or(positive), F.lit(False)).alias("positive"))


def patient_means(per_unit: DataFrame, *keys: str, value: str = "value", patient: str = "patient_id") -> DataFrame:
    """Means over a patient's units, undefined values skipped."""
    return per_unit.groupBy(patient, *keys).agg(F.avg(value).alias(value))


@lru_cache(maxsize=256)
def _exact_tail(n1: int, n2: int) -> tuple[float, ...]:
    """P(U >= u) for u = 0.. n1 n2 under the null hypothesis without ties."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):  # the Gaussian binomial coefficient, factor by factor
        for k in range(n1 * n2, n2 + i - 1, -1):
            counts[k] -= counts[k - n2 - i]
        for k in range(i, n1 * n2 + 1):
            counts[k] += counts[k - i]
    total, out, rest = math.comb(n1 + n2, n1), [], 0
    for c in reversed(counts):
        rest += c
        out.append(rest / total)
    return tuple(reversed(out))


def group_tests(values: DataFrame, groups: DataFrame, metric: str = "metric", patient: str = "patient_id", value: str = "value", min_per_group: int = 10, exact: bool = True) -> DataFrame:
    """One row per metric: n and mean of positives and others, difference, AUROC, two-sided p and q, ordered by p.

    The rank test runs where both groups have `min_per_group` values. p is
    exact where the smaller group has up to 8 values and none are tied, and the
    normal approximation with correction for ties and continuity elsewhere, or
    everywhere without `exact`. Patients without a group count as others. q is over
    all metrics tested.
    """
    v = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(groups.select(patient, "positive"), patient, "left")
    v = v.select(metric, F.col(value).cast("double").alias("v"), F.coalesce("positive", F.lit(False)).alias("g"))
    # equal values share a middle rank: count what lies below by distinct value
    per_value = v.groupBy(metric, "v").agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("g").cast("long")).alias("t1"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(metric).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per_value.withColumn("rank", below + (F.col("t") + 1) / 2.0)
    s = ranked.groupBy(metric).agg(
        F.sum("t").alias("n"), F.sum("t1").alias("n1"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.sum(F.col("v") * F.col("t1")).alias("s1"), F.sum(F.col("v") * (F.col("t") - F.col("t1"))).alias("s0")
    )
    n1, n2 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    tested = (F.col("n1") >= min_per_group) & (F.col("n") - F.col("n1") >= min_per_group)
    out = s.withColumn("p", F.when(tested & (sd > 0), F.least(normal_two_sided(z), F.lit(1.0))).when(tested, F.lit(1.0)))
    out = out.select(
        metric, F.col("n1").alias("n_positive"), (F.col("n") - F.col("n1")).alias("n_other"), F.try_divide("s1", n1).alias("mean_positive"), F.try_divide("s0", n2).alias("mean_other"), (F.try_divide("s1", n1) - F.try_divide("s0", n2)).alias("difference"), F.when(tested, F.col("u") / (n1 * n2)).alias("auroc"), "u", "ties", "p"
    )
    if exact:

        @F.pandas_udf("double")
        def exact_p(u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series, p: pd.Series) -> pd.Series:
            def one(u, a, b, ties, p):
                if pd.isna(p) or ties or min(a, b) > 8:
                    return p
                return min(1.0, 2 * _exact_tail(int(min(a, b)), int(max(a, b)))[int(max(u, a * b - u))])

            return pd.Series([one(*x) for x in zip(u, a, b, ties, p, strict=True)])

        out = out.withColumn("p", exact_p("u", "n_positive", "n_other", "ties", "p"))
    return with_q(out.drop("u", "ties"), "p").orderBy(F.asc_nulls_last("p"), metric)


def bootstrap_mean(values: DataFrame, *keys: str, value: str = "value", cluster: str = "patient_id", n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(keys, mean, low, high, n_clusters): mean with a 95 % interval over resampled clusters.

    A resample draws as many clusters as there are, with replacement, and takes
    the sum of their sums over the sum of their sizes. Draws are two Lehmer
    steps on integers, the same in every engine. The interval is null with one
    cluster. Values that are null or not finite don't count. Rows are clusters
    times resamples; raw values are summed by cluster before.
    """
    v = values.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    per = v.groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = per.withColumn("k", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    draw = per.select(*keys, "n", F.col("k").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    mixed = F.col("b").cast("long") * 7919 + F.col("j").cast("long") * 104729 + 17 + seed
    draw = draw.withColumn("k", ((((mixed * 48271) % 2147483647) * 16807) % 2147483647 % F.col("n")).cast("int"))
    if keys:
        got = draw.select(*keys, "b", "k").join(per.select(*keys, "k", "s", "c"), [*keys, "k"])
    else:
        got = draw.select("b", "k").join(per.select("k", "s", "c"), "k")
    ratio = got.groupBy(*keys, "b").agg((F.sum("s") / F.sum("c")).alias("r"))
    bounds = ratio.groupBy(*keys).agg(F.expr("percentile(r, 0.025)").alias("low"), F.expr("percentile(r, 0.975)").alias("high"))
    mean = per.groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("mean"), F.count(F.lit(1)).alias("n_clusters"))
    out = mean.join(bounds, list(keys)) if keys else mean.crossJoin(F.broadcast(bounds))
    one = F.col("n_clusters") > 1
    return out.select(*keys, "mean", F.when(one, F.col("low")).alias("low"), F.when(one, F.col("high")).alias("high"), "n_clusters")
