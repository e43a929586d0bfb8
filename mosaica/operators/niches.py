"""Niches: numbering, tables, votes and what they contain.

Assignments are rows (unit_id, cell_id, niche, cell_type, margin, positive);
niche 0 is Background.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaica.functions.scalars import niche_name
from mosaica.operators import stats
from mosaica.operators.graph import with_ends


def number_niches(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, niche): clusters by falling mean margin (the mean over units of units' means), from 1; noise (-1) is 0."""
    per_unit = clusters.groupBy(cluster, "unit_id").agg(F.avg("margin").alias("m"))
    score = per_unit.groupBy(cluster).agg(F.round(F.avg("m"), 12).alias("score"))
    real = score.where(F.col(cluster) >= 0).withColumn("niche", F.row_number().over(Window.orderBy(F.desc("score"), cluster)))
    return real.select(cluster, "niche", "score").unionByName(score.where(F.col(cluster) < 0).select(cluster, F.lit(0).alias("niche"), "score"))


def unit_niche_shares(assigned: DataFrame, niches: DataFrame | None = None) -> DataFrame:
    """(unit_id, niche, share): each unit with every niche, those it lacks as 0."""
    n = assigned.groupBy("unit_id", "niche").agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy("unit_id").agg(F.sum("n").alias("total"))
    every = niches or n.select("niche").distinct()
    return size.join(F.broadcast(every)).join(n, ["unit_id", "niche"], "left").select("unit_id", "niche", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def niche_fractions(assigned: DataFrame) -> DataFrame:
    """(niche, cell_type, fraction, tissue, ratio): composition of niches against that of all cells."""
    n = assigned.groupBy("niche", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    tissue = n.groupBy("cell_type").agg(F.sum("n").alias("all"))
    f = n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("niche")))
    total = tissue.agg(F.sum("all").alias("total"))
    t = tissue.crossJoin(F.broadcast(total)).select("cell_type", (F.col("all") / F.col("total")).alias("tissue"))
    return f.join(F.broadcast(t), "cell_type").select("niche", "cell_type", "fraction", "tissue", (F.col("fraction") / F.col("tissue")).alias("ratio"))


def niche_table(assigned: DataFrame, present: float = 0.01, enriched: float = 1.5) -> DataFrame:
    """One row per niche, Background last.

    share and n_cells of all cells; n_units with a share strictly above
    `present`; association, the share of its cells in positive units (units
    without a label are negative) beside base_rate, that of all cells; margin,
    the mean over units of units' means; sign_consistency, the share of units
    whose mean has the sign of the margin; composition, its three most frequent
    types with percents; enriched types, with a ratio strictly above the
    threshold, by falling ratio.
    """
    pos = F.coalesce(F.col("positive"), F.lit(False)).cast("double")
    per_unit = assigned.groupBy("niche", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum(pos).alias("p"), F.avg("margin").alias("m"))
    size = assigned.groupBy("unit_id").agg(F.count(F.lit(1)).alias("size"))
    u = per_unit.join(size, "unit_id").withColumn("share_u", F.col("n") / F.col("size"))
    mean = u.groupBy("niche").agg(F.avg("m").alias("margin"))
    u = u.join(F.broadcast(mean), "niche")
    whole = assigned.agg(F.count(F.lit(1)).alias("total"), F.avg(pos).alias("base_rate"))
    base = u.groupBy("niche").agg(
        F.sum("n").alias("n_cells"),
        F.sum((F.col("share_u") > present).cast("long")).alias("n_units"),
        (F.sum("p") / F.sum("n")).alias("association"),
        F.first("margin").alias("margin"),
        F.avg((F.signum("m") == F.signum("margin")).cast("double")).alias("sign_consistency"),
    ).crossJoin(F.broadcast(whole))
    f = niche_fractions(assigned)
    by_share = F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("fraction"), "cell_type"))
    percent = F.round(100 * F.col("fraction")).cast("int")
    top = f.withColumn("k", by_share).where("k <= 3").withColumn("pc", percent).where("pc > 0").groupBy("niche").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "cell_type", "pc"))), lambda r: F.concat(r["cell_type"].cast("string"), F.lit(" "), r["pc"].cast("string"), F.lit("%"))), ", ").alias("composition"))
    rich = f.where(F.round("ratio", 9) > enriched).groupBy("niche").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.round("ratio", 9)).alias("o"), "cell_type"))), lambda r: r["cell_type"].cast("string")), ", ").alias("enriched"))
    out = base.join(F.broadcast(top), "niche", "left").join(F.broadcast(rich), "niche", "left")
    out = out.select("niche", niche_name("niche").alias("name"), (F.col("n_cells") / F.col("total")).alias("share"), "n_cells", "n_units", "association", "base_rate", "margin", "sign_consistency", F.coalesce("composition", F.lit("")).alias("composition"), F.coalesce("enriched", F.lit("")).alias("enriched"))
    return out.orderBy((F.col("niche") == 0).cast("int"), "niche")


def niche_contacts(assigned: DataFrame, edges: DataFrame, min_contacts: int = 100, label: str = "cell_type") -> DataFrame:
    """(niche, ta, tb, n_contacts, value), ta <= tb: log2 of a pair's share of contacts in the niche over that in the tissue.

    Every niche but Background has a row for every pair of types. Niche
    contacts have both ends in it; the tissue has all edges, Background and
    mixed ones too. n_contacts counts edges; value is null where it is below
    `min_contacts` or 0, or where the tissue has no such contact.
    """
    types = assigned.select(F.col(label).alias("t")).where("t is not null").distinct()
    pairs = types.select(F.col("t").alias("ta")).join(F.broadcast(types.select(F.col("t").alias("tb"))), F.col("ta") <= F.col("tb"))
    every = assigned.where("niche <> 0").select("niche").distinct().join(F.broadcast(pairs))
    e = with_ends(edges, assigned, label, "niche")
    two = e.select("a_niche", "b_niche", F.explode(F.array(F.struct(F.col(f"a_{label}").alias("ta"), F.col(f"b_{label}").alias("tb")), F.struct(F.col(f"b_{label}").alias("ta"), F.col(f"a_{label}").alias("tb")))).alias("t")).select("a_niche", "b_niche", "t.*")
    counted = two.groupBy("a_niche", "b_niche", "ta", "tb").agg(F.count(F.lit(1)).alias("n"))
    tissue = counted.groupBy("ta", "tb").agg(F.sum("n").alias("n_tissue"))
    total = counted.agg(F.sum("n").alias("total"))
    own = counted.where("a_niche = b_niche and a_niche <> 0").select(F.col("a_niche").alias("niche"), "ta", "tb", "n")
    ends = own.groupBy("niche").agg(F.sum("n").alias("ends"))
    grid = every.join(F.broadcast(tissue), ["ta", "tb"], "left").join(own, ["niche", "ta", "tb"], "left").join(ends, "niche", "left").crossJoin(F.broadcast(total)).na.fill(0, ["n", "n_tissue"])
    edge_n = F.when(F.col("ta") == F.col("tb"), F.col("n") / 2).otherwise(F.col("n")).cast("long")
    enough = (edge_n >= min_contacts) & (F.col("n") > 0) & (F.col("n_tissue") > 0)
    value = F.when(enough, F.log2(F.col("n") / F.col("ends") / (F.col("n_tissue") / F.col("total"))))
    return grid.select("niche", "ta", "tb", edge_n.alias("n_contacts"), value.alias("value"))


def niche_units(assigned: DataFrame, edges: DataFrame, min_cells: int = 20) -> tuple[DataFrame, DataFrame]:
    """Cells and edges of (niche, unit) subgraphs with at least `min_cells`, Background left out; their unit_id is `niche|unit`."""
    n = F.count(F.lit(1)).over(Window.partitionBy("unit_id", "niche"))
    cells = assigned.where("niche <> 0").withColumn("__n", n).where(F.col("__n") >= min_cells).drop("__n")
    e = with_ends(edges, cells.select("unit_id", "cell_id", "niche"), "niche").where("a_niche = b_niche")
    name = lambda c: F.concat_ws("|", F.col(c).cast("string"), F.col("unit_id").cast("string"))
    return cells.withColumn("unit_id", name("niche")), e.select(name("a_niche").alias("unit_id"), "src", "dst")


def niche_moran(assigned: DataFrame, edges: DataFrame, min_cells: int = 20) -> DataFrame:
    """(niche, t, ...): Moran's I of types within niches, pooled over units."""
    cells, inner = niche_units(assigned, edges, min_cells)
    per = stats.morans_i(cells, inner).withColumn("niche", F.split("unit_id", r"\|")[0].cast("int"))
    return stats.moran_pooled(per, "niche", "t")


def niche_enrichment(assigned: DataFrame, edges: DataFrame, min_cells: int = 20) -> DataFrame:
    """(niche, ta, tb, mean_z, mean_log2_ratio, n_units), ta <= tb: contact enrichment within niches, means over units; n_units counts units with a z."""
    cells, inner = niche_units(assigned, edges, min_cells)
    per = stats.enrichment_analytic(cells, inner).where("ta <= tb").withColumn("niche", F.split("unit_id", r"\|")[0].cast("int"))
    out = per.groupBy("niche", "ta", "tb").agg(F.avg("z").alias("mean_z"), F.avg("log2_ratio").alias("mean_log2_ratio"), F.count("z").alias("n_units"))
    return out.where("n_units > 0")


def vote_column(sample: DataFrame, k: int, vector: Column, cosine: bool = True, space: str = "space") -> Column:
    """A column with the most frequent cluster among the k sample points nearest to each vector; noise votes too.

    Distances are squared Euclidean, of unit vectors with `cosine`, rounded to
    nine digits; ties go to the smaller id, then to the smaller cluster. The
    sample (cell_id, cluster, space) is broadcast: its bound is the
    clustering's sample size. Batches meet it in blocks of a matrix product,
    which picks the k nearest and what comes close to them; those distances
    are taken again from differences.
    """
    rows = sample.select("cell_id", F.col("cluster").cast("int").alias("cluster"), F.transform(space, lambda x: x.cast("double")).alias("v")).orderBy("cell_id").toPandas()
    shared = sample.sparkSession.sparkContext.broadcast((np.array(rows["v"].tolist(), float).reshape(len(rows), -1), rows["cluster"].to_numpy()))

    def scaled(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(1, keepdims=True)) if cosine else np.ones((len(x), 1))
        return x / np.where(n > 0, n, 1)

    @F.arrow_udf("int")
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        points, cluster = shared.value
        points = scaled(points)
        sq, few = (points**2).sum(1), min(k, len(points))
        for column in batches:
            out = []
            x = scaled(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))
            step = max(1, 4_000_000 // max(1, len(points)))
            for at in range(0, len(x), step):
                own = x[at : at + step]
                d = (own**2).sum(1)[:, None] + sq - 2 * own @ points.T
                bound = np.partition(d, few - 1, axis=1)[:, few - 1] + 1e-8 * (1 + sq.max())
                for row, near in zip(own, d <= bound[:, None], strict=True):
                    some = np.flatnonzero(near)
                    gap = np.round(((points[some] - row) ** 2).sum(1), 9)
                    best = cluster[some[np.lexsort((some, gap))[:few]]]
                    names, n = np.unique(best, return_counts=True)
                    out.append(names[n.argmax()])
            yield pa.array(out, pa.int32())

    return vote(vector)


def knn_vote(points: DataFrame, sample: DataFrame, k: int, space: str = "space", cosine: bool = True) -> DataFrame:
    """(cell_id, cluster) of all points, as `vote_column` has it. An empty sample votes for nothing: null."""
    if sample.isEmpty():
        return points.select("cell_id", F.lit(None).cast("int").alias("cluster"))
    return points.select("cell_id", vote_column(sample, k, F.transform(space, lambda x: x.cast("double")), cosine, space).alias("cluster"))


def render_units(assigned: DataFrame, n: int) -> DataFrame:
    """Units to show: half of `n` (rounded up) with the highest mean margin, the rest with the lowest."""
    m = assigned.groupBy("unit_id").agg(F.round(F.avg("margin"), 12).alias("m"))
    hi = m.orderBy(F.desc("m"), "unit_id").limit(-(-n // 2))
    lo = m.orderBy("m", "unit_id").limit(n // 2)
    return hi.unionByName(lo).select("unit_id").distinct()
