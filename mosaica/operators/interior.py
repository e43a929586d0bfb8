"""Interiors of large units: what `graph.interior_cells` keeps, from the cells near the rim and a proof that all others hang together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaica.operators import graph
from mosaica.plans.groups import map_groups

#: In mean distances of cells: side of the squares that must all hold a cell; how far from its points (by more than a square's diagonal) cells are proven connected; how far beyond the strip its cells' neighbours may lie, and how far beyond those cells are needed.
SQUARE, DISC, NEIGHBOURS, BEYOND = 5.0, 7.5, 15.0, 25.0
#: How far around a square nearest cells are sought.
MARGIN = 4.0
#: Depth that the rim may reach for each hop.
HOP = 4.0
_STATS = "unit_id string, m double, first long, near binary, loose binary, hx binary, hy binary, sx binary, sy binary"
_FRAME = "unit_id string, ok boolean, m double, first long, reach double, hx array<double>, hy array<double>"


def _hull_points(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the hull, from the points that are not well inside the polygon of the farthest in 16 directions."""
    turn = np.arange(16) * (np.pi / 8)
    far = np.unique([int((x * c + y * s).argmax()) for c, s in zip(np.cos(turn), np.sin(turn), strict=True)])
    h = graph._hull(x[far], y[far]) if len(far) > 2 else np.zeros(0, np.int64)
    if len(h) < 3:
        return graph._hull(x, y) if len(x) > 2 else np.arange(len(x))
    some = np.flatnonzero(_depth(x, y, x[far[h]], y[far[h]]) <= 1e-6 * max(np.ptp(x), np.ptp(y)))
    return some[graph._hull(x[some], y[some])]


def _depth(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """How far points lie inside a convex ring that turns left: the least distance from the line of a side, below 0 outside."""
    ux, uy = np.roll(hx, -1) - hx, np.roll(hy, -1) - hy
    size = np.sqrt(ux * ux + uy * uy)
    out = np.full(len(x), np.inf)
    for ax, ay, u, v, s in zip(hx, hy, ux, uy, size, strict=True):
        np.minimum(out, (u * (y - ay) - v * (x - ax)) / s, out=out)
    return out


def _nearest(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distances of points from the nearest of the others for the points `of` (infinite for one alone), on squares that double until those around a point hold its nearest."""
    out = np.full(len(x), np.inf)
    first = graph._first_of_place(x, y)
    if len(first) < len(x):
        place, many = np.unique(np.stack([x, y], 1), axis=0, return_inverse=True, return_counts=True)[1:]
        out[first] = _nearest(x[first], y[first], np.flatnonzero(np.isin(first, of)))
        out[many[place.reshape(-1)] > 1] = 0.0
        return out
    n, wide, high = len(x), float(np.ptp(x)), float(np.ptp(y))
    if n < 2:
        return out
    side = max(np.sqrt(wide / n * high), max(wide, high) / n)
    for _ in range(20):
        square = graph._square_of(x, y, side, 1)[0]
        if max(wide, high) / side > 2**26 or np.bincount(np.unique(square, return_inverse=True)[1]).max() <= 32:
            break
        side /= 2
    todo = of
    while len(todo):
        gx, gy = (np.floor((v - v.min()) / side).astype(np.int64) + 1 for v in (x, y))
        rows = int(gy.max()) + 2
        square = gx * rows + gy
        order = np.argsort(square, kind="stable")
        at = square[order]
        low = np.stack([np.searchsorted(at, square[todo] + d * rows - 1) for d in (-1, 0, 1)], 1)
        size = np.stack([np.searchsorted(at, square[todo] + d * rows + 2) for d in (-1, 0, 1)], 1) - low
        ends = np.cumsum(size, 1)
        by = np.argsort(ends[:, 2], kind="stable")
        left, whole = [], 2 * side > max(wide, high)
        i = 0
        while i < len(by):
            width = int(ends[by[min(len(by) - 1, i + 2047)], 2])
            r = by[i : i + max(1, min(2048, 131_072 // max(width, 1)))]
            i += len(r)
            k = np.arange(int(ends[r[-1], 2]))
            run = (k >= ends[r, :1]).astype(np.int64) + (k >= ends[r, 1:2])
            c = order[np.minimum(np.take_along_axis(low[r] - ends[r] + size[r], run, 1) + k, n - 1)]
            p = todo[r]
            d2 = (x[p, None] - x[c]) ** 2 + (y[p, None] - y[c]) ** 2
            d2[(k >= ends[r, 2:]) | (c == p[:, None])] = np.inf
            best = np.sqrt(d2.min(1))
            done = (best <= side * (1 - 1e-9)) | whole
            out[p[done]] = best[done]
            left.append(p[~done])
        todo = np.sort(np.concatenate(left))
        side *= 2
    return out


def _stats(pdf: pd.DataFrame, boxes: list) -> pd.DataFrame | None:
    """What a square says of its unit: distances of its cells from their nearest, those that may be less than they are known to be apart, corners of its hull, and the small squares that hold cells."""
    own = pdf["own"].to_numpy()
    if not own.any():
        return None
    key = int(pdf["key"].iloc[0])
    box, at = boxes[key >> 40], (key >> 20 & 0xFFFFF, key & 0xFFFFF)
    x, y, m = pdf["x"].to_numpy(), pdf["y"].to_numpy(), box.reach / graph.REACH
    of = np.flatnonzero(own)
    ox, oy = x[of], y[of]
    sure = np.full(len(of), np.inf)
    for v, low, last, i in ((ox, box.x0, box.xn, at[0]), (oy, box.y0, box.yn, at[1])):
        # a little less than what is dealt, for rounding
        if i > 0:
            np.minimum(sure, v - (low + i * box.side - 0.999 * MARGIN * m), out=sure)
        if i < last:
            np.minimum(sure, low + (i + 1) * box.side + 0.999 * MARGIN * m - v, out=sure)
    near = np.sqrt(_nearest(x, y, of)[of] ** 2)
    loose = near > sure
    h = _hull_points(ox, oy)
    small = np.unique(np.stack([np.floor(v / (SQUARE * m)).astype(np.int64) for v in (ox, oy)], 1), axis=0)
    row = {"unit_id": box.unit_id, "m": m, "first": len(graph._first_of_place(ox, oy)), "near": near[~loose].tobytes(), "loose": sure[loose].tobytes()}
    return pd.DataFrame([row | {"hx": ox[h].tobytes(), "hy": oy[h].tobytes(), "sx": small[:, 0].tobytes(), "sy": small[:, 1].tobytes()}])


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells (key, x, y, own), with their unit's box beside them, in its squares, with copies in squares that they lie within a margin of; `key` holds the numbers of unit and square."""
    m, placed = F.col("reach") / graph.REACH, cells
    for v in "xy":
        at = lambda d, v=v: F.least(F.greatest(F.floor((F.col(v) - F.col(f"{v}0") + d) / F.col("side")), F.lit(0)), F.col(f"{v}n"))
        placed = placed.withColumns({f"{v}i": at(F.lit(0.0)), f"{v}a": at(-MARGIN * m), f"{v}b": at(MARGIN * m)})
    key = lambda i, j: F.shiftleft(F.col("u").cast("long"), 40) + F.shiftleft(i, 20) + j
    own = placed.select(key(F.col("xi"), F.col("yi")).alias("key"), "x", "y", F.lit(True).alias("own"))
    guests = placed.where("xa < xb or ya < yb").withColumn("xt", F.explode(F.sequence("xa", "xb"))).withColumn("yt", F.explode(F.sequence("ya", "yb"))).where("xt <> xi or yt <> yi")
    return own.unionByName(guests.select(key(F.col("xt"), F.col("yt")).alias("key"), "x", "y", F.lit(False).alias("own")))


def _strip(m: float, n_hops: int) -> float:
    return (HOP * n_hops + DISC) * m


def _frame(pdf: pd.DataFrame, n_hops: int, tolerance: float) -> pd.DataFrame:
    """A unit's hull, its rim's width and whether all cells beyond the strip are sure to hang together."""
    every = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in pdf[c]])
    m = float(pdf["m"].iloc[0])
    near, loose, x, y = (every(c, float) for c in ("near", "loose", "hx", "hy"))
    h = graph._hull(x, y) if len(x) > 2 else np.zeros(0, np.int64)
    hx, hy = x[h], y[h]
    middle = float(np.median(np.concatenate([near, loose])))
    n = len(near) + len(loose)
    ok = len(h) > 2 and (not len(loose) or (len(near) > n // 2 and np.partition(near, n // 2)[n // 2] <= loose.min()))
    reach = tolerance * middle
    ok = bool(ok and reach <= HOP * n_hops * m)
    if ok:
        s = SQUARE * m
        sx, sy = every("sx", np.int64), every("sy", np.int64)
        low, rows = int(sy.min()), int(np.ptp(sy)) + 1
        full = np.unique((sx - sx.min()) * rows + sy - low)
        mid_y = (np.arange(rows) + low + 0.5) * s
        for i in range(int(np.ptp(sx)) + 1):
            deep = _depth(np.full(rows, (i + int(sx.min()) + 0.5) * s), mid_y, hx, hy) > _strip(m, n_hops) - 0.71 * s
            if not np.isin(i * rows + np.flatnonzero(deep), full).all():
                ok = False
                break
    return pd.DataFrame([{"unit_id": pdf["unit_id"].iloc[0], "ok": ok, "m": m, "first": int(pdf["first"].sum()), "reach": reach, "hx": hx.tolist(), "hy": hy.tolist()}])


def _by_depth(batches: Iterator[pd.DataFrame], frames: dict, n_hops: int, core: bool) -> Iterator[pd.DataFrame]:
    """Cells beyond the strip or, with their depth and whether they are of the rim's first row, those near enough to it to matter."""
    for pdf in batches:
        outs = []
        unit, x, y = (pdf[c].to_numpy() for c in ("u", "x", "y"))
        for u in np.unique(unit).tolist():
            m, reach, hx, hy = frames[u]
            strip = _strip(m, n_hops)
            most = strip + (NEIGHBOURS + BEYOND) * m
            i = np.flatnonzero(unit == u)
            cx, cy = (hx.min() + hx.max()) / 2, (hy.min() + hy.max()) / 2
            sure = max(float(_depth(np.array([cx]), np.array([cy]), hx, hy)[0]) - most - m, 0.0)
            deep = (x[i] - cx) ** 2 + (y[i] - cy) ** 2 < sure * sure
            some = i[~deep]
            depth = _depth(x[some], y[some], hx, hy)
            if core:
                outs.append(pdf.iloc[np.sort(np.concatenate([i[deep], some[depth > strip]]))])
                continue
            some, depth = some[depth <= most], depth[depth <= most]
            rim = np.zeros(len(some), bool)
            low = np.flatnonzero(depth <= reach + m)
            rim[low] = graph._hull_gaps(x[some[low]], y[some[low]], hx, hy) <= reach
            outs.append(pdf.iloc[some].assign(depth=depth, rim=rim))
        outs = [o for o in outs if len(o)]
        if outs:
            yield pd.concat(outs, ignore_index=True)


def _near_rim(pdf: pd.DataFrame, n_hops: int) -> pd.DataFrame | None:
    """Of a square: cells of the strip with their depth and 1 for the first of a place (kind 2), their edges (0) where settled here, and cells (1) that must be triangulated with others of the unit."""
    m = float(pdf["reach"].iloc[0]) / graph.REACH
    strip = _strip(m, n_hops)
    wide = pdf["own"].to_numpy() & (pdf["depth"].to_numpy() <= strip + NEIGHBOURS * m)
    if not wide.any():
        return None
    unit, kind = pdf["key"].iloc[0].rsplit("|", 2)[0], pdf["cell_id"]
    first = graph._first_of_place(pdf["x"].to_numpy(), pdf["y"].to_numpy())
    every = pdf.assign(first=np.isin(np.arange(len(pdf)), first) * 1.0)[pdf["own"] & (pdf["depth"] <= strip)]
    out = [pd.DataFrame({"kind": 2, "a": every["cell_id"], "b": every["cell_id"], "x": every["depth"], "y": every["first"], "flag": every["rim"]})]
    pdf = pdf.iloc[first]
    x, y, depth, ids = (pdf[c].to_numpy() for c in ("x", "y", "depth", "cell_id"))
    known, reach = pdf[["k0", "k1", "k2", "k3"]].iloc[0].to_numpy(float), float(pdf["reach"].iloc[0])
    wide = pdf["own"].to_numpy() & (depth <= strip + NEIGHBOURS * m)
    own = wide & (depth <= strip)
    sure, p, q = graph._rings(x, y, np.flatnonzero(wide), known, reach)
    pairs = np.stack([p, q], 1)[own[p]]
    around = graph._enclosed(x, y, reach)
    here = own & ~sure & around
    if here.any():
        some = np.flatnonzero(graph._near(x, y, here, reach))
        extra = some[graph.delaunay_pairs(x[some], y[some])]
        pairs = np.concatenate([pairs, extra[here[extra].any(1)]])
    out.append(pd.DataFrame({"kind": 0, "a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]], "x": 0.0, "y": 0.0, "flag": False}))
    take, open_ = graph._open_cells(x, y, wide & ~around, (sure, p, q), known, reach)
    out.append(pd.DataFrame({"kind": 1, "a": ids[take], "b": ids[take], "x": x[take], "y": y[take], "flag": (open_ & own)[take]}))
    out = pd.concat([o for o in out if len(o)] or out[:1], ignore_index=True).assign(unit_id=unit)
    return out.astype({"a": kind.dtype, "b": kind.dtype})[["unit_id", "kind", "a", "b", "x", "y", "flag"]]


def _picked(pdf: pd.DataFrame, frames: dict, first: dict, n_hops: int, largest: bool) -> pd.DataFrame:
    """A unit's interior cells of the strip (code 0), and one row (of any cell) that says whether those beyond it belong to the interior (1), or not (2), or that the unit needs all its edges (3)."""
    unit, kind = pdf["unit_id"].iloc[0], pdf["kind"].to_numpy()
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    cells, rim, depth = (pdf[c].to_numpy()[kind == 2] for c in ("a", "flag", "x"))
    beyond = int(first[unit] - pdf["y"].to_numpy()[kind == 2].sum())
    order = np.argsort(cells, kind="stable")
    cells, rim, depth = cells[order], rim[order].astype(bool), depth[order]

    def answer(code: int, ids: np.ndarray = cells[:0]) -> pd.DataFrame:
        ids = np.concatenate([ids, a[:1]])
        return pd.DataFrame({"unit_id": unit, "cell_id": ids, "code": np.append(np.zeros(len(ids) - 1, np.int32), np.int32(code))})

    some = pdf[kind == 1].groupby("a", sort=True, as_index=False).agg({"x": "first", "y": "first", "flag": "max"})
    pairs = graph.delaunay_pairs(some["x"].to_numpy(), some["y"].to_numpy())
    pairs = pairs[some["flag"].to_numpy(bool)[pairs].any(1)]
    extra = some["a"].to_numpy()
    n = len(cells)

    def place(ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(cells, ids), max(n - 1, 0))
        return np.where(cells[at] == ids, at, n) if n else np.zeros(len(ids), np.int64)

    src, dst = (place(np.concatenate([e, extra[pairs[:, i]]])) for i, e in enumerate((a[kind == 0], b[kind == 0])))
    src, dst = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], 1), axis=0).T
    rim = np.append(rim, False)
    for _ in range(n_hops - 1):
        rim[np.concatenate([dst[rim[src]], src[rim[dst]]])] = True
    if beyond < 1 or rim[n] or (depth[rim[:n]] > HOP * n_hops * frames[unit][0]).any():
        return answer(3)
    inner = ~rim
    if not largest:
        return answer(1, cells[inner[:n]])
    own = inner[src] & inner[dst]
    lab = graph._labels(n + 1, src[own], dst[own])
    size = np.bincount(lab[inner], weights=np.append(np.ones(n), beyond)[inner], minlength=n + 1)
    best = int(size.argmax())
    if size[best] < 2 or (size == size[best]).sum() > 1:
        return answer(3)
    return answer(1 if lab[n] == best else 2, cells[(inner & (lab == best))[:n]])


def interior_cells_in_tiles(cells: DataFrame, n_hops: int, tolerance: float = 1.0, largest: bool = True, tile: int = graph.TILE) -> DataFrame:
    """What `graph.interior_cells` keeps of units by their own Delaunay edges, for units that need not be triangulated, nor fit in a task: cells are dealt by squares of about `tile` cells.

    A first pass finds each unit's hull and the median distance of its cells
    from their nearest; one task a unit holds those distances, 8 bytes a cell.
    Only a strip along the hull is triangulated, with what its cells' triangles
    need (`_near_rim`). Cells deeper than that hang together, which the first
    pass proves: cells within a circle are joined by edges within it, and
    circles without a cell of the rim, each sharing cells with the next, lead
    from any deep cell to any other where every small square holds a cell. The
    strip, and the deep cells as one, are walked in one task a unit. Units of
    one square, and those where the proof fails (gaps, a rim that grows too
    deep), take all their edges and one task. The driver holds the hulls of
    large units; positions are kept, since they are read four times. Cells without a position are left out.
    """
    kind = cells.schema["cell_id"].dataType.simpleString()
    spark = cells.sparkSession
    read = cells.select("unit_id", "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")

    read = read.persist()
    boxes = graph._boxes(read, tile).persist()
    large = boxes.where(F.col("n") > tile).collect() if n_hops > 0 else []
    n_units = boxes.count()
    boxes.unpersist()

    def whole(df: DataFrame) -> DataFrame:
        return graph.interior_cells(df, graph.delaunay_edges_in_tiles(df, tile), n_hops, tolerance, largest)

    if not large:
        return whole(read)
    box = spark.createDataFrame([(i, *b) for i, b in enumerate(large)], T.StructType([T.StructField("u", T.IntegerType()), *boxes.schema]))
    numbered = lambda units: read.join(F.broadcast(box.where(F.col("u").isin(units)).select("unit_id", "u")), "unit_id")
    dealt = _dealt(read.join(F.broadcast(box), "unit_id"))
    stats = map_groups(dealt, "key", partial(_stats, boxes=large), _STATS)
    found = map_groups(stats, "unit_id", partial(_frame, n_hops=n_hops, tolerance=tolerance), _FRAME).where("ok").collect()
    if not found:
        return whole(read)
    frames = {f.unit_id: (f.m, f.reach, np.array(f.hx), np.array(f.hy)) for f in found}
    first = {f.unit_id: f.first for f in found}
    number = {b.unit_id: i for i, b in enumerate(large)}
    by_number = {number[u]: f for u, f in frames.items()}
    pick = partial(_by_depth, frames=by_number, n_hops=n_hops)
    near = numbered(list(by_number)).select("u", "cell_id", "x", "y").mapInPandas(partial(pick, core=False), f"u int, cell_id {kind}, x double, y double, depth double, rim boolean")
    near = near.join(F.broadcast(box.select("u", "unit_id")), "u").drop("u")
    parts = map_groups(graph._squares(near, tile, box.drop("u"), "depth", "rim"), "key", partial(_near_rim, n_hops=n_hops), f"unit_id string, kind int, a {kind}, b {kind}, x double, y double, flag boolean", ("cell_id",))
    picked = map_groups(parts, "unit_id", partial(_picked, frames=frames, first=first, n_hops=n_hops, largest=largest), f"unit_id string, cell_id {kind}, code int").persist()
    codes = {r.unit_id: r.code for r in picked.where("code > 0").collect()}
    done = [u for u, c in codes.items() if c < 3]
    listed = F.broadcast(spark.createDataFrame([(u,) for u in done], "unit_id string"))
    out = picked.where("code = 0").join(listed, "unit_id", "left_semi").select("unit_id", "cell_id")
    deep = [u for u in done if codes[u] == 1]
    twice = {u for u in deep if largest and first[u] < large[number[u]].n}
    for units, again in (([number[u] for u in deep if u not in twice], False), ([number[u] for u in twice], True)):
        if units:
            core = numbered(units).select("u", "cell_id", "x", "y").mapInPandas(partial(pick, core=True), f"u int, cell_id {kind}, x double, y double")
            core = core.groupBy("u", "x", "y").agg(F.min("cell_id").alias("cell_id")) if again else core
            out = out.unionByName(core.join(F.broadcast(box.select("u", "unit_id")), "u").select("unit_id", "cell_id"))
    return out.unionByName(whole(read.join(listed, "unit_id", "left_anti"))) if len(done) < n_units else out
