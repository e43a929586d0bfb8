"""Units of analysis: regions, tiles and polygons of cells; labels and selections of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(cells: DataFrame, factor: float) -> DataFrame:
    """Positions times a factor; where it is 1 nothing changes."""
    return cells.withColumn("x", F.col("x") * factor).withColumn("y", F.col("y") * factor)


def min_cells(cells: DataFrame, least: int, unit: str = "unit_id") -> DataFrame:
    """Cells of units that have at least `least`."""
    return cells.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(unit))).where(F.col("__n") >= least).drop("__n")


def _steps(v: str, low: Column, size: float, stride: float) -> Column:
    """Indices i >= 0 with low + i * stride <= v < low + i * stride + size. Quotients may round to the other side of a whole number, so an index more is tried at either end; the comparisons decide."""
    start = F.greatest(F.floor((F.col(v) - low - size) / stride) - 1, F.lit(0))
    stop = F.greatest(F.floor((F.col(v) - low) / stride) + 1, start)
    return F.filter(F.sequence(start, stop), lambda i: (low + i * stride <= F.col(v)) & (F.col(v) < low + i * stride + size))


def grid_tiles(cells: DataFrame, size: float, stride: float | None = None, region: str = "region_id") -> DataFrame:
    """Cells by tile: tile_id `<region>_tile%03d` and its indices ix, iy.

    Tiles are half-open squares anchored at the region's least coordinates. A
    stride below the size makes them overlap and a cell falls into several; a
    larger one loses cells. Tiles without cells get no number; numbers run by
    ix, then iy, before any filter on their size. Cells without a region are in
    no tile.
    """
    stride = stride or size
    w = Window.partitionBy(region)
    box = cells.where(F.col(region).isNotNull()).withColumn("__x0", F.min("x").over(w)).withColumn("__y0", F.min("y").over(w))
    out = box
    for v, i in (("x", "ix"), ("y", "iy")):
        out = out.withColumn(i, F.explode(_steps(v, F.col(f"__{v}0"), size, stride)))
    number = F.dense_rank().over(w.orderBy("ix", "iy")) - 1
    return out.withColumn("tile_id", F.concat(F.col(region), F.lit("_tile"), F.lpad(number.cast("string"), 3, "0"))).drop("__x0", "__y0")


def _inside(x: Column, y: Column, sides: Column) -> Column:
    """Strictly inside by the even-odd rule; a point on a side is outside."""

    def meet(state: Column, s: Column) -> Column:
        cross = (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
        on = (cross == 0) & x.between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & y.between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
        passes = ((s["ay"] > y) != (s["by"] > y)) & ((cross > 0) == (s["by"] > s["ay"]))
        return F.struct((state["on"] | on).alias("on"), (state["hit"] != passes).alias("hit"))

    none = F.struct(F.lit(False).alias("on"), F.lit(False).alias("hit"))
    return F.aggregate(sides, none, meet, lambda s: ~s["on"] & s["hit"])


def polygon_members(cells: DataFrame, polygons: DataFrame, region: str = "region_id") -> DataFrame:
    """Cells strictly inside each polygon: (region, polygon_id `<region>_polygon%03d`, cells' columns).

    `polygons`: (region, number, rings array<array<struct<x, y>>>); numbers
    follow the order of the file and stay, whatever cells are in. Sides are
    made once for each polygon; a box filter comes before the exact test.
    """
    flat = F.flatten("rings")
    xs, ys = F.transform(flat, lambda q: q["x"]), F.transform(flat, lambda q: q["y"])

    def ring_sides(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))

    p = polygons.withColumn("__b", F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1")))
    p = p.withColumn("__sides", F.flatten(F.transform("rings", ring_sides)))
    near = cells.join(p.drop("rings"), region).where("x > __b.x0 and x < __b.x1 and y > __b.y0 and y < __b.y1")
    out = near.where(_inside(F.col("x").cast("double"), F.col("y").cast("double"), F.col("__sides")))
    return out.withColumn("polygon_id", F.concat(F.col(region), F.lit("_polygon"), F.lpad(F.col("number").cast("string"), 3, "0"))).drop("__b", "__sides", "number")


def inside_any(cells: DataFrame, polygons: DataFrame, region: str = "region_id") -> DataFrame:
    """Cells inside at least one polygon of their region, each once."""
    ids = polygon_members(cells.select(region, "cell_id", "x", "y"), polygons, region).select(region, "cell_id").distinct()
    return cells.join(ids, [region, "cell_id"], "left_semi")


def vocabulary(cells: DataFrame, column: str = "cell_type") -> DataFrame:
    """(value, code): distinct values in order, coded from 0; one row per kind of cell, so a single window is in place."""
    v = cells.select(F.col(column).alias("value")).where("value is not null").distinct()
    return v.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def encode(cells: DataFrame, codes: DataFrame, column: str = "cell_type") -> DataFrame:
    """`cells` with `code`; a value that the vocabulary lacks is an error, a null has none."""
    out = cells.join(codes.select(F.col("value").alias("__v"), F.col("code").alias("code")), F.col(column) == F.col("__v"), "left").drop("__v")
    wrong = F.col(column).isNotNull() & F.col("code").isNull()
    return out.withColumn("code", F.when(wrong, F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col(column)))).otherwise(F.col("code")))


def select_units(units: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Units of which any of unit, region and sample id is listed."""
    listed = ids.select(F.col(id_col).cast("string").alias("__i")).distinct()
    own = units.select("unit_id", F.explode(F.array_distinct(F.array("unit_id", "region_id", "sample_id"))).alias("__i"))
    return units.join(own.join(listed, "__i", "left_semi").select("unit_id").distinct(), "unit_id", "left_semi")


def resolve_labels(units: DataFrame, labels: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Units with the label columns of the first of unit, region and sample id that has a label; `label_id` is null where none has."""
    own = labels.select(label_id).distinct()
    out = units
    for i, key in enumerate(("unit_id", "region_id", "sample_id")):
        out = out.join(own.select(F.col(label_id).alias(f"__l{i}")), F.col(key) == F.col(f"__l{i}"), "left")
    out = out.withColumn(label_id, F.coalesce("__l0", "__l1", "__l2")).drop("__l0", "__l1", "__l2")
    return out.join(labels, label_id, "left")


def usable(units: DataFrame, labelled_only: bool = True, label_id: str = "label_id") -> DataFrame:
    return units.where(F.col(label_id).isNotNull()) if labelled_only else units


def patient_or_unit(units: DataFrame) -> DataFrame:
    """`patient` is the unit's patient or else the unit itself."""
    return units.withColumn("patient", F.coalesce("patient_id", "unit_id"))


def patient_or_region(units: DataFrame) -> DataFrame:
    """`patient` is the unit's patient or else its region."""
    return units.withColumn("patient", F.coalesce("patient_id", "region_id"))


def resolve_units(units: DataFrame, selection: str | list[str] | None = None) -> DataFrame:
    """Unit ids in order: held-out ones (None or "held_out"; none is an error), all, or those listed."""
    if selection == "all":
        out = units
    elif selection is None or selection == "held_out":
        out = units.where("held_out")
        if out.isEmpty():
            raise ValueError("no held-out units")
    else:
        found = units.where(F.col("unit_id").isin(*selection))
        lost = set(selection) - {r[0] for r in found.select("unit_id").collect()}
        if lost:
            raise ValueError(f"unknown units: {sorted(lost)}")
        out = found
    return out.select("unit_id").distinct().orderBy("unit_id")


def positive_units(units: DataFrame, kind: str, target: str = "target", positive_class: int = 1) -> DataFrame:
    """(unit_id, positive): the class, an event, or above the median over units."""
    t = F.col(target)
    if kind == "classification":
        return units.select("unit_id", (t == positive_class).alias("positive"))
    if kind == "survival":
        return units.select("unit_id", (F.col("event").cast("double") > 0).alias("positive"))
    if kind == "regression":
        median = units.agg(F.expr(f"percentile({target}, 0.5)").alias("m"))
        return units.crossJoin(F.broadcast(median)).select("unit_id", (t > F.col("m")).alias("positive"))
    raise ValueError(f"unknown kind of target: {kind}")


def grouped_types(cells: DataFrame, groups: dict[str, str], column: str = "cell_type") -> DataFrame:
    """Fine types replaced by their group; types without one stay."""
    if not groups:
        return cells
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return cells.withColumn(column, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def bounding_boxes(cells: DataFrame) -> DataFrame:
    """(unit_id, width, height, diagonal)."""
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return cells.groupBy("unit_id").agg(w.alias("width"), h.alias("height")).withColumn("diagonal", F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")))


def radius_grid(cells: DataFrame, n: int, largest: float | None = None) -> DataFrame:
    """(step, radius): n equal steps up to `largest`, or to a quarter of the median diagonal of the units."""
    top = cells.sparkSession.range(1).select(F.lit(largest).cast("double").alias("top")) if largest else bounding_boxes(cells).agg((F.expr("percentile(diagonal, 0.5)") * 0.25).alias("top"))
    return top.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"), "top").select("step", (F.col("top") / n * F.col("step")).alias("radius"))
