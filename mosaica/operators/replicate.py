"""Niches of several models: matching, transfer and a shared basis."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaica.operators.cluster import hash_sample, kmeans_assign, kmeans_fit
from mosaica.operators.testing import bootstrap_mean


def hellinger_pairs(compositions: DataFrame, key: str = "niche", kind: str = "cell_type", value: str = "fraction") -> DataFrame:
    """(a, b, distance), a < b: Hellinger distances of compositions in long form.

    sum (sqrt p - sqrt q)^2 = sum p + sum q - 2 sum sqrt(p q), so only types
    that two compositions share are joined.
    """
    c = compositions.select(F.col(key).alias("k"), F.col(kind).alias("t"), F.col(value).alias("v"))
    total = c.groupBy("k").agg(F.sum("v").alias("s"))
    a, b = c.select(F.col("k").alias("a"), "t", F.col("v").alias("va")), c.select(F.col("k").alias("b"), "t", F.col("v").alias("vb"))
    both = a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.sum(F.sqrt(F.col("va") * F.col("vb"))).alias("bc"))
    grid = total.select(F.col("k").alias("a"), F.col("s").alias("sa")).join(total.select(F.col("k").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b"))
    out = grid.join(both, ["a", "b"], "left")
    return out.select("a", "b", F.sqrt(F.greatest(0.5 * (F.col("sa") + F.col("sb") - 2 * F.coalesce("bc", F.lit(0.0))), F.lit(0.0))).alias("distance"))


def linkage(names: list, models: list, distance: dict[tuple, float]) -> list[tuple[float, int, int]]:
    """Merges (mean distance, kept, absorbed) of average linkage among groups without a model in common, closest first.

    A group goes by its first item; of equal means the pair that comes first
    in order merges. Pairs wait in a queue; the sum of distances between two
    groups is the sum of those of their parts, and entries of groups that have
    changed since are passed over. Means never fall from one merge to the
    next, so that a threshold cuts the list. Runs on the driver: items are the
    niches of a few models.
    """
    size, owners, version = dict.fromkeys(range(len(names)), 1), {i: {m} for i, m in enumerate(models)}, dict.fromkeys(range(len(names)), 0)
    total: dict[frozenset, float] = {}
    for i, a in enumerate(names):
        for j in range(i):
            total[frozenset((i, j))] = distance[(names[j], a)] if (names[j], a) in distance else distance[(a, names[j])]
    queue: list[tuple] = []

    def offer(i: int, j: int) -> None:
        i, j = min(i, j), max(i, j)
        if owners[i].isdisjoint(owners[j]):
            heapq.heappush(queue, (round(total[frozenset((i, j))] / (size[i] * size[j]), 12), i, j, version[i], version[j]))

    for pair in total:
        offer(*pair)
    steps = []
    while queue:
        mean, i, j, vi, vj = heapq.heappop(queue)
        if version.get(i) != vi or version.get(j) != vj:
            continue
        steps.append((mean, i, j))
        size[i] += size.pop(j)
        owners[i] |= owners.pop(j)
        del version[j]
        version[i] += 1
        for k in size:
            if k != i:
                total[frozenset((i, k))] += total[frozenset((j, k))]
                offer(i, k)
    return steps


def cut_linkage(n: int, steps: list[tuple[float, int, int]], threshold: float) -> list[int]:
    """Group numbers of n items after the merges below the threshold: larger groups first, equals by their first item."""
    members = {i: [i] for i in range(n)}
    for mean, kept, gone in steps:
        if mean >= threshold:
            break
        members[kept] += members.pop(gone)
    out = [0] * n
    for number, first in enumerate(sorted(members, key=lambda i: (-len(members[i]), i)), 1):
        for i in members[first]:
            out[i] = number
    return out


def match_niches(names: list, models: list, distance: dict[tuple, float], thresholds: list[float], min_models: int = 2) -> tuple[list[int], float, list[tuple[float, int, int]]]:
    """(group of each niche, threshold, scan): the first threshold with most groups found in `min_models` models, then fewest groups.

    All thresholds cut one list of merges.
    """
    steps = linkage(names, models, distance)
    cuts = [cut_linkage(len(names), steps, t) for t in thresholds]
    reach = [Counter(g for g, _ in {(g, m) for g, m in zip(cut, models, strict=True)}) for cut in cuts]
    scan = [(t, sum(n >= min_models for n in r.values()), len(r)) for t, r in zip(thresholds, reach, strict=True)]
    best = max(range(len(scan)), key=lambda k: (scan[k][1], -scan[k][2]))
    return cuts[best], thresholds[best], scan


def metacluster_table(members: DataFrame, compositions: DataFrame, min_models: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tables of metaclusters and of their composition.

    `members`: (metacluster, model, niche, n_cells, share, association, margin);
    `compositions`: (model, niche, cell_type, fraction). Composition weighs
    niches by their cells; share, association and margin are plain means, with
    sample deviations; sign_share is the share of members whose margin has the
    sign of the mean.
    """
    mean = Window.partitionBy("metacluster")
    m = members.withColumn("mm", F.avg("margin").over(mean))
    table = m.groupBy("metacluster").agg(
        F.count_distinct("model").alias("n_models"),
        F.count(F.lit(1)).alias("n_members"),
        *[f(c).alias(f"{p}{c}") for c in ("share", "association", "margin") for p, f in (("mean_", F.avg), ("sd_", F.stddev_samp))],
        F.avg((F.signum("margin") == F.signum("mm")).cast("double")).alias("sign_share"),
    )
    table = table.withColumn("replicated", F.col("n_models") >= min_models)
    weight = members.groupBy("metacluster").agg(F.sum("n_cells").alias("w"))
    comp = compositions.join(members.select("metacluster", "model", "niche", "n_cells"), ["model", "niche"]).groupBy("metacluster", "cell_type").agg(F.sum(F.col("n_cells") * F.col("fraction")).alias("s")).join(weight, "metacluster")
    return table, comp.select("metacluster", "cell_type", (F.col("s") / F.col("w")).alias("fraction"))


def meta_of(assigned: DataFrame, mapping: DataFrame) -> DataFrame:
    """`assigned` (with model and niche) with metacluster: that of (model, niche), 0 for Background and niches without one."""
    return assigned.join(F.broadcast(mapping.select("model", "niche", "metacluster")), ["model", "niche"], "left").withColumn("metacluster", F.coalesce("metacluster", F.lit(0)))


def held_out_shares(meta: DataFrame) -> DataFrame:
    """(unit_id, metacluster, share) over all of a unit's cells; Background counts below the line only; every metacluster for every unit."""
    n = meta.groupBy("unit_id", "metacluster").agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("unit_id").agg(F.sum("n").alias("total"))
    names = n.where("metacluster <> 0").select("metacluster").distinct()
    return size.join(F.broadcast(names)).join(n, ["unit_id", "metacluster"], "left").select("unit_id", "metacluster", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def adjusted_rand(pairs: DataFrame, a: str = "a", b: str = "b", *keys: str, least: int = 11) -> DataFrame:
    """(keys, ari, n) of two labellings of the same cells, from the contingency table; null below `least` cells."""
    c = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    ij = c.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    ra = c.groupBy(*keys, a).agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(two(F.col("m"))).alias("ra"))
    rb = c.groupBy(*keys, b).agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(two(F.col("m"))).alias("rb"))
    out = ij.join(ra, list(keys)).join(rb, list(keys)) if keys else ij.crossJoin(ra).crossJoin(rb)
    e = F.try_divide(F.col("ra") * F.col("rb"), two(F.col("n")))
    top = (F.col("ra") + F.col("rb")) / 2 - e
    ari = F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("ij") - e) / top)
    return out.select(*keys, F.when(F.col("n") >= least, ari).alias("ari"), F.col("n").cast("long").alias("n"))


def consensus_votes(votes: DataFrame) -> DataFrame:
    """(patient_id, metacluster, vote): the share of models that assign a cell, then means over a unit's cells and over a patient's units.

    `votes`: (model, unit_id, patient_id, cell_id, metacluster). Cells that no
    model assigns to a metacluster count as 0.
    """
    n_models = votes.groupBy("unit_id").agg(F.count_distinct("model").alias("models"), F.count_distinct("cell_id").alias("cells"), F.first("patient_id").alias("patient_id"))
    got = votes.where("metacluster <> 0").groupBy("unit_id", "metacluster").agg(F.count(F.lit(1)).alias("n"))
    names = votes.where("metacluster <> 0").select("metacluster").distinct()
    per_unit = n_models.join(F.broadcast(names)).join(got, ["unit_id", "metacluster"], "left")
    per_unit = per_unit.withColumn("v", F.coalesce("n", F.lit(0)) / (F.col("models") * F.col("cells")))
    return per_unit.groupBy("patient_id", "metacluster").agg(F.avg("v").alias("vote"))


def transfer_table(votes: DataFrame) -> DataFrame:
    """(model, split, metacluster, share, association, margin): cells of each metacluster in a model's held-out and other units; association is above the base rate."""
    pos = F.coalesce("positive", F.lit(False)).cast("double")
    base = votes.groupBy("model", "held_out").agg(F.avg(pos).alias("base"), F.count(F.lit(1)).alias("total"))
    own = votes.where("metacluster <> 0").groupBy("model", "held_out", "metacluster").agg(F.count(F.lit(1)).alias("n"), F.avg(pos).alias("p"), F.avg("margin").alias("margin"))
    out = own.join(base, ["model", "held_out"])
    return out.select("model", F.when(F.col("held_out"), "held_out").otherwise("other").alias("split"), "metacluster", (F.col("n") / F.col("total")).alias("share"), (F.col("p") - F.col("base")).alias("association"), "margin")


def basis_margins(groups: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(model, grp, mean, low, high, n_clusters) of units' mean margins in each group of a shared basis, resampled by patient."""
    per_unit = groups.groupBy("model", "grp", "unit_id", "patient_id").agg(F.avg("margin").alias("value"))
    return bootstrap_mean(per_unit, "model", "grp", n_boot=n_boot, seed=seed)


def shared_basis(cells: DataFrame, k: int = 20, sample_size: int = 300_000, seed: int = 0, n_boot: int = 2000, space: str = "space") -> tuple[DataFrame, DataFrame]:
    """(cells with grp, margins): groups G1 to Gk that k-means finds in the vectors of all models, and the models' margins in them.

    `cells`: (model, unit_id, patient_id, cell_id, margin) with vectors of one
    input, which are standardised with the sample's means and deviations (a
    component without any varies by 1). The fit sees a hash sample; all cells
    go to the nearest centre.
    """
    vector = array_to_vector(F.transform(space, lambda x: x.cast("double")))
    sample = hash_sample(cells.select("cell_id", space), sample_size, seed).select(vector.alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(sample)
    flat = lambda d: d.withColumn(space, vector_to_array("scaled")).drop("raw", "scaled")
    centres = kmeans_fit(flat(scaler.transform(sample)), k, seed, space, cosine=False)
    grouped = kmeans_assign(flat(scaler.transform(cells.withColumn("raw", vector))), centres, space, cosine=False)
    out = grouped.withColumn("grp", F.concat(F.lit("G"), (F.col("cluster") + 1).cast("string"))).drop("cluster", space)
    return out, basis_margins(out, n_boot, seed)
