"""The workflow's commands as functions over tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.config import BuildConfig, ClusteringConfig, DescriptorConfig, SpatialStatsConfig, SurvivalConfig, TilingConfig
from mosaica.operators import attribution, cluster, graph, metrics, niches, replicate, stats, survival, testing, units


def build_units(cells: DataFrame, cfg: BuildConfig = BuildConfig(), tiling: TilingConfig = TilingConfig(), polygons: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Cells with unit_id: regions, tiles or polygons of at least min_cells, positions scaled. Polygons also bound regions and tiles."""
    c = units.scaled(cells, cfg.coord_scale_um)
    if cfg.unit == "polygon":
        if polygons is None:
            raise ValueError("polygon units need polygons")
        c = units.polygon_members(c, polygons).withColumnRenamed("polygon_id", "unit_id")
    else:
        c = c if polygons is None else units.inside_any(c, polygons)
        if cfg.unit == "tile":
            c = units.grid_tiles(c, tiling.size, tiling.stride).drop("ix", "iy").withColumnRenamed("tile_id", "unit_id")
        else:
            c = c.withColumn("unit_id", F.col("region_id"))
    return units.min_cells(c, cfg.min_cells)


def spatial_stats(cells: DataFrame, edges: DataFrame, labels: DataFrame, cfg: SpatialStatsConfig = SpatialStatsConfig()) -> dict[str, tuple[DataFrame, DataFrame]]:  # noqa: B008
    """Per analysis the values of units and the tests between groups.

    `cells` carry patient_id; `labels`: (patient_id or unit_id, positive).
    Neighbourhood shares are log-ratio transformed patient means.
    """
    by = "patient_id" if cfg.compare_by == "patient" else "unit_id"
    owner = cells.select("unit_id", "patient_id").distinct() if by == "patient_id" else None
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    for name in cfg.analyses:
        if name == "enrichment":
            v = stats.enrichment_analytic(cells, edges).where("ta <= tb").select("unit_id", F.concat("ta", F.lit("|"), "tb").alias("metric"), F.col("log2_ratio").alias("value"))
        elif name == "contacts":
            if not cfg.reference:
                continue
            v = stats.contact_fractions(cells, edges, list(cfg.reference)).select("unit_id", F.concat("ta", F.lit("|"), "tb").alias("metric"), F.col("fraction").alias("value"))
        elif name == "cross_l":
            v = stats.cross_l(cells, list(cfg.radii))
            v = v.where(F.col("ta").isin(*cfg.reference)) if cfg.reference else v.where("ta <= tb")
            v = v.select("unit_id", F.concat("ta", F.lit("|"), "tb", F.lit("|"), F.col("radius").cast("string")).alias("metric"), "value")
        else:
            w = stats.window_composition(cells, cfg.window)
            types = [r[0] for r in units.vocabulary(cells).orderBy("code").collect()]
            wide = w.groupBy("unit_id", "cell_id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("share"))), F.lit(0.0)) for t in types]).alias("space"))
            centres = cluster.kmeans_fit(cluster.hash_sample(wide, cfg.sample_size, cfg.seed), cfg.n_neighbourhoods, cfg.seed, cosine=False)
            cn = cluster.kmeans_assign(wide, centres, cosine=False).withColumnRenamed("cluster", "cn")
            v = stats.shares(cn, len(centres)).select("unit_id", F.col("name").alias("metric"), F.col("share").alias("value"))
        if owner is not None:
            g = testing.patient_means(v.join(owner, "unit_id"), "metric")
        else:
            g = v
        if name == "neighbourhoods":
            g = stats.centred_log_ratio(g, by, "value").withColumn("value", F.col("clr")).drop("clr")
        out[name] = (v, testing.group_tests(g, labels, patient=by, min_per_group=cfg.min_patients))
    return out


@dataclass
class NicheAnalysis:
    """All tables of one analysis."""

    assigned: DataFrame
    table: DataFrame
    shares: DataFrame
    margins: DataFrame
    colocalisation: DataFrame
    descriptors: dict[str, DataFrame] = field(default_factory=dict)
    cox: DataFrame | None = None
    groups: DataFrame | None = None


def cluster_cells(scores: DataFrame, cfg: ClusteringConfig = ClusteringConfig()) -> DataFrame:  # noqa: B008
    """(cell_id, cluster) of all cells: a sample is clustered, by density or by k-means, and the rest goes by vote of its neighbours there.

    `scores` have the vectors of the configured space as attention_space or
    embedding, or have one column `space`.
    """
    column = {"attention": "attention_space", "embedding": "embedding"}[cfg.space]
    s = scores.select("cell_id", F.col(column if column in scores.columns else "space").alias("space"))
    if cfg.pca:
        s = cluster.pca_transform(s, cluster.pca_fit(cluster.hash_sample(s, cfg.sample_size, cfg.seed), cfg.pca))
    cosine = cfg.metric == "cosine"
    if cfg.method == "kmeans":
        some = cluster.hash_sample(s, cfg.sample_size, cfg.seed)
        fit = cluster.kmeans_assign(some, cluster.kmeans_fit(some, cfg.n_clusters, cfg.seed, cosine=cosine), cosine=cosine)
    else:
        fit = cluster.fit_density(s, cfg.sample_size, cfg.min_cluster_size, cfg.min_samples, cfg.seed, cfg.selection == "leaf", cosine=cosine)
    rest = s.join(fit.select("cell_id"), "cell_id", "left_anti")
    return niches.knn_vote(rest, fit, cfg.assign_k, cosine=cosine).unionByName(fit.select("cell_id", F.col("cluster").cast("int").alias("cluster")))


def analyse_niches(
    scores: DataFrame,
    edges: DataFrame,
    bias: tuple[float, ...],
    clustering: ClusteringConfig = ClusteringConfig(),  # noqa: B008
    descriptors: DescriptorConfig = DescriptorConfig(),  # noqa: B008
    outcomes: DataFrame | None = None,
    survive: SurvivalConfig = SurvivalConfig(),  # noqa: B008
    clusters: DataFrame | None = None,
) -> NicheAnalysis:
    """From cell scores (unit_id, patient_id, cell_id, cell_type, x, y, space, logits, positive) to niches and their description."""
    classes = len(bias)
    margins = attribution.cell_margins(scores, classes, bias)
    found = clusters if clusters is not None else cluster_cells(scores, clustering)
    base = scores.join(margins, ["unit_id", "cell_id"]).join(found, "cell_id")
    number = niches.number_niches(base).select("cluster", "niche")
    a = base.join(F.broadcast(number), "cluster")
    e = graph.short_edges(edges, scores, descriptors.max_edge_length)
    per_unit = a.groupBy("niche", "unit_id", "patient_id").agg(F.avg("margin").alias("value"))
    boot = testing.bootstrap_mean(per_unit, "niche", seed=clustering.seed)
    shares = niches.unit_niche_shares(a)
    out = NicheAnalysis(a, niches.niche_table(a), shares, boot, stats.colocalisation(a.where("niche <> 0"), e, "niche"))
    for name in descriptors.analyses:
        if name == "moran":
            m = niches.niche_moran(a, e, descriptors.min_cells)
            from mosaica.functions.scalars import normal_two_sided

            out.descriptors[name] = testing.with_q(m.withColumn("p", normal_two_sided("z")))
        elif name == "enrichment":
            out.descriptors[name] = niches.niche_enrichment(a, e, descriptors.min_cells)
        elif name == "contacts":
            out.descriptors[name] = niches.niche_contacts(a, e, descriptors.min_contacts)
        else:
            radii = [r.radius for r in units.radius_grid(scores, descriptors.n_radii, descriptors.max_radius).orderBy("step").collect()]
            cells, _ = niches.niche_units(a, e, descriptors.min_cells)
            v = stats.cross_l(cells, radii).withColumn("niche", F.split("unit_id", r"\|")[0].cast("int"))
            out.descriptors[name] = stats.best_radius(v, "niche")
    if outcomes is not None:
        patient = a.select("unit_id", "patient_id").distinct()
        p = shares.join(patient, "unit_id").withColumn("niche", F.col("niche").cast("string"))
        p = testing.patient_means(p, "niche", value="share")
        out.cox, out.groups = survival.niche_survival(p, outcomes, survive.pseudo_share, survive.score)
    return out


def predict_units(scores: DataFrame, kind: str, classes: int, merge_patients: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(unit predictions, patient predictions): pooled by attention; patients by the mean of their units, or as one bag each."""
    meta_cols = [c for c in ("patient_id", "target") if c in scores.columns]
    meta = scores.select("unit_id", *meta_cols).distinct()
    frame = attribution.prediction_frame(attribution.bag_logits(scores, classes), kind, classes).join(meta, "unit_id", "left")
    if "patient_id" not in meta_cols:
        return frame, None
    known = frame.where("patient_id is not null")
    patients = attribution.patient_frame(known, ("target",) if "target" in meta_cols else ())
    if merge_patients:
        own = scores.where("patient_id is not null")
        merged = attribution.prediction_frame(attribution.bag_logits(own, classes, "patient_id"), kind, classes, "patient_id")
        new = [c for c in merged.columns if c != "patient_id"]
        patients = patients.drop(*new).join(merged, "patient_id", "left")
    return frame, patients


def nested_cv_summary(oof: DataFrame, kind: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """(per fold, summary) of out-of-fold predictions with a column `outer`; the summary has mean and sd over folds and the pooled value.

    Folds are few, so each is measured in a driver loop over fold numbers.
    """
    folds = sorted(r[0] for r in oof.select("outer").distinct().collect())
    rows = [(str(f), metrics.frame_metrics(oof.where(F.col("outer") == f), kind).first()[metric]) for f in folds]
    rows = [(f, float(v) if v is not None else None) for f, v in rows]
    per = oof.sparkSession.createDataFrame(rows, "outer string, value double").withColumn("metric", F.lit(metric))
    pooled = metrics.frame_metrics(oof, kind).select(F.col(metric).cast("double").alias("pooled"))
    return per, metrics.cv_summary(per).crossJoin(F.broadcast(pooled))


def replicate_niches(tables: dict[str, DataFrame], assigned: dict[str, DataFrame], thresholds: list[float], min_models: int = 2) -> dict[str, DataFrame]:
    """Match niches of several models and follow them into held-out units.

    `tables`: model -> (niche, n_cells, share, association, margin);
    `assigned`: model -> cells with unit_id, patient_id, cell_id, niche,
    cell_type, positive, margin and held_out.
    """
    models = sorted(tables)
    spark = tables[models[0]].sparkSession
    comp = None
    for m in models:
        f = niches.niche_fractions(assigned[m].where("niche <> 0")).select(F.lit(m).alias("model"), "niche", "cell_type", "fraction")
        comp = f if comp is None else comp.unionByName(f)
    named = comp.withColumn("key", F.concat_ws("|", "model", F.col("niche").cast("string")))
    dist = {(r.a, r.b): r.distance for r in replicate.hellinger_pairs(named, "key").collect()}
    names = sorted({k for p in dist for k in p})
    group, threshold, scan = replicate.match_niches(names, [n.rsplit("|", 1)[0] for n in names], dist, thresholds, min_models)
    mapping = spark.createDataFrame([(n.rsplit("|", 1)[0], int(n.rsplit("|", 1)[1]), g) for n, g in zip(names, group, strict=True)], "model string, niche int, metacluster int")
    members = None
    for m in models:
        t = tables[m].select(F.lit(m).alias("model"), "niche", "n_cells", "share", "association", "margin")
        members = t if members is None else members.unionByName(t)
    members = members.join(F.broadcast(mapping), ["model", "niche"])
    table, composition = replicate.metacluster_table(members, comp, min_models)
    cells = None
    for m in models:
        a = assigned[m].withColumn("model", F.lit(m))
        cells = a if cells is None else cells.unionByName(a)
    meta = replicate.meta_of(cells, mapping)
    held = replicate.held_out_shares(meta.where("held_out"))
    patients = testing.patient_means(held.join(meta.select("unit_id", "patient_id").distinct(), "unit_id"), "metacluster", value="share")
    tested = testing.group_tests(patients, testing.patient_labels(meta.select("unit_id", "patient_id", "positive").distinct()), "metacluster", value="share", min_per_group=3)
    return {
        "matched": members.withColumn("threshold", F.lit(threshold)),
        "scan": spark.createDataFrame([(float(a), b, c) for a, b, c in scan], "threshold double, n_replicated int, n_groups int"),
        "metaclusters": table,
        "composition": composition,
        "unit_shares": held,
        "patient_tests": tested,
        "transfer": replicate.transfer_table(meta),
        "votes": replicate.consensus_votes(meta),
    }
