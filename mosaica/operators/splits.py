"""Splits and folds of groups of units."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def random_split(groups: DataFrame, ratios: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 0, stratum: str | None = None, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(group_id, split): groups in an order that seed and id settle, dealt per stratum by largest remainder.

    Each part gets the floor of its share; what is left goes to the largest
    fractions, the first of equals. Then, in order, a part with a positive
    ratio and no group gets one from the largest part of the stratum (the first
    of equals), if that has more than one.
    """
    if len(ratios) != len(names) or min(ratios) < 0 or sum(ratios) <= 0:
        raise ValueError("one ratio for each split, none below 0 and not all 0")
    g = groups.select("group_id", (F.col(stratum) if stratum else F.lit(0)).alias("s")).distinct()
    w = Window.partitionBy("s").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("group_id").cast("string"))), "group_id")
    g = g.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s")))
    total = float(sum(ratios))
    share = [F.col("n") * (r / total) for r in ratios]
    floors = [F.floor(F.round(s, 9)) for s in share]
    rest = F.col("n") - sum(floors[1:], floors[0])
    frac = F.array(*[F.struct((-F.round(s - f, 9)).alias("f"), F.lit(i).alias("i")) for i, (s, f) in enumerate(zip(share, floors, strict=True))])
    order = F.transform(F.sort_array(frac), lambda x: x["i"])
    sizes = [f + (F.array_position(order, F.lit(i)) <= rest).cast("long") for i, f in enumerate(floors)]
    g = g.withColumn("sizes", F.array(*sizes))

    def moved_to(i: int) -> Column:
        largest = F.array_position("sizes", F.array_max("sizes")) - 1
        return F.transform("sizes", lambda x, k: x + (k == i).cast("long") - (k == largest).cast("long"))

    for i, ratio in enumerate(ratios):
        if ratio > 0:
            moved = moved_to(i)
            g = g.withColumn("sizes", F.when((F.col("sizes")[i] == 0) & (F.array_max("sizes") > 1), moved).otherwise(F.col("sizes")))
    out, bound = F.lit(names[-1]), F.lit(0)
    picks = []
    for i, name in enumerate(names):
        bound = bound + F.col("sizes")[i]
        picks.append((name, bound))
    for name, b in reversed(picks):
        out = F.when(F.col("k") <= b, F.lit(name)).otherwise(out)
    return g.select("group_id", out.alias("split"))


def folds_table(folds: DataFrame) -> DataFrame:
    """(fold, id) from a column `folds` of arrays of arrays; an empty fold has one row without an id."""
    return folds.select(F.posexplode("folds").alias("fold", "ids")).select("fold", F.explode_outer("ids").alias("id"))


def overlapping_ids(folds: DataFrame) -> DataFrame:
    """Ids in more than one fold; one that a fold repeats is none."""
    return folds.groupBy("id").agg(F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")


def check_folds(folds: DataFrame, units: DataFrame) -> DataFrame:
    """(fold, n_units, n_classes) after checks: an empty fold, or a unit or group in two folds, is an error.

    `units`: (unit_id, group_id, label); an id that is none of them is an error
    too. One class in a fold is for the caller to warn of.
    """
    if not overlapping_ids(folds.where("id is not null")).isEmpty():
        raise ValueError("a unit is in two folds")
    joined = folds.join(units, folds["id"] == units["unit_id"], "left")
    if not joined.where("id is not null and unit_id is null").isEmpty():
        raise ValueError("a fold has an id that is no unit")
    if not joined.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1 and group_id is not null").isEmpty():
        raise ValueError("a group is in two folds")
    out = joined.groupBy("fold").agg(F.count("unit_id").alias("n_units"), F.count_distinct("label").alias("n_classes"))
    if not out.where("n_units = 0").isEmpty():
        raise ValueError("a fold has no unit")
    return out


def explicit_split(units: DataFrame, train: list[str], val: list[str], test: list[str] | None = None) -> DataFrame:
    """(unit_id, split) from lists of unit or group ids; a unit in two lists is an error, test may be left out.

    `units`: (unit_id, group_id). An id that names a group stands for all its
    units; units in no list have no row, and an id that is neither is an error.
    """
    spark = units.sparkSession
    rows = [(str(i), name) for name, ids in (("train", train), ("val", val), ("test", test or [])) for i in ids]
    listed = spark.createDataFrame(rows, "id string, split string").distinct()
    by_unit = units.join(listed, units["unit_id"].cast("string") == listed["id"])
    by_group = units.join(listed, units["group_id"].cast("string") == listed["id"])
    found = by_unit.unionByName(by_group)
    if not listed.join(found.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("a split lists an id that is neither unit nor group")
    out = found.groupBy("unit_id").agg(F.min("split").alias("split"), F.count_distinct("split").alias("n"))
    if not out.where("n > 1").isEmpty():
        raise ValueError("a unit is in two splits")
    return out.drop("n")


def unit_table(units: DataFrame, split: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """`units` with split (null where it has none) and, with `roots` (unit_id, cell_id), n_roots."""
    out = units.join(split.select("unit_id", "split"), "unit_id", "left")
    if roots is None:
        return out
    n = roots.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_roots"))
    return out.join(n, "unit_id", "left").withColumn("n_roots", F.coalesce("n_roots", F.lit(0).cast("long")))


def strata(units: DataFrame, most: int = 10) -> DataFrame:
    """(group_id, stratum): the class of each group; all null if a group has several or none, classes aren't whole, or there are more than `most`."""
    g = units.groupBy("group_id").agg(F.count_distinct("label").alias("k"), F.min("label").alias("c"), F.sum(F.col("label").isNull().cast("int")).alias("lost"))
    whole = g.agg((F.max((F.col("k") != 1).cast("int")) + F.max((F.col("lost") > 0).cast("int")) + F.max((F.col("c") != F.floor("c")).cast("int")) + (F.count_distinct("c") > most).cast("int")).alias("bad"))
    return g.crossJoin(F.broadcast(whole)).select("group_id", F.when(F.col("bad") == 0, F.col("c")).alias("stratum"))


def inner_folds(units: list[tuple[str, str, int | None]], k: int, seed: int = 0) -> list[list[str]]:
    """k folds of unit ids that keep groups together and, where classes are known, spread them evenly.

    `units`: (unit, group, class). Groups, largest first and equals in an order
    that the seed settles, go to the fold where class counts stay most even.
    Runs on the driver: groups are few.
    """
    if k < 2:
        raise ValueError("at least two folds")
    by_group: dict[str, list] = {}
    for unit, group, cls in sorted(units):
        by_group.setdefault(group, []).append((unit, cls))
    if len(by_group) < k:
        raise ValueError(f"{len(by_group)} groups for {k} folds")
    classes = sorted({c for _, _, c in units if c is not None})
    vec = lambda us: [sum(c == x for _, c in us) for x in classes] or [len(us)]
    order = sorted(by_group, key=lambda g: (-len(by_group[g]), hashlib.md5(f"{seed}|{g}".encode()).hexdigest()))
    load, out = [[0] * max(1, len(classes)) for _ in range(k)], [[] for _ in range(k)]
    for g in order:
        v = vec(by_group[g])
        cost = [(sum((load[f][i] + v[i]) ** 2 - load[f][i] ** 2 for i in range(len(v))), len(out[f]), f) for f in range(k)]
        f = min(cost)[2]
        load[f] = [a + b for a, b in zip(load[f], v, strict=True)]
        out[f] += [u for u, _ in by_group[g]]
    return [sorted(f) for f in out]
