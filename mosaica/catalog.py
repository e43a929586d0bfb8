"""Queries by name over the fixture cohort, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.config import ClusteringConfig, SamplerConfig
from mosaica.functions.scalars import NUDGE, l2_normalised, log_distance, niche_name, normal_two_sided_sql, safe_name, tidy
from mosaica.operators import attribution, cluster, graph, interior, metrics, niches, replicate, splits, stats, survival, testing, units
from mosaica.sources import fixture, readers
from mosaica.sources.fixture import CELLS_SQL, EDGES_SQL, ENDS_SQL, HEAD_BIAS, OUTCOMES_SQL, SCORES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with one zero, so that engines can be compared."""
    return df.select(*[tidy(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"(round(({x}) + {NUDGE!r}, {digits}) + 0e0)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return fixture.cells(spark, d)


def _edges(cells: DataFrame) -> DataFrame:
    """Edges of a query, kept since statistics read them more than once; a cohort has them as a table."""
    return graph.delaunay_edges(cells).persist()


# ---- scans, units, labels ------------------------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT unit_id, sample_id, cell_id, cell_type, {r('x')} AS x, {r('y')} AS y, feature, label FROM raw")
def cells_scan(spark, d):
    return rounded(readers.sound_cells(fixture.raw_cells(spark, d)).select("unit_id", "sample_id", "cell_id", "cell_type", "x", "y", "feature", "label"))


@query(f"WITH {CELLS_SQL} SELECT unit_id, count(*) AS n FROM cells GROUP BY unit_id")
def cells_min_filter(spark, d):
    return units.min_cells(fixture.raw_cells(spark, d), 10).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS_SQL}, v AS (SELECT DISTINCT cell_type AS value FROM raw) SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM v")
def vocabulary(spark, d):
    return units.vocabulary(fixture.raw_cells(spark, d))


@query(f"WITH {CELLS_SQL}, v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT cell_type AS value FROM raw)) SELECT CAST(code AS INTEGER) AS code, count(*) AS n FROM cells JOIN v ON cell_type = value GROUP BY code")
def vocabulary_encode(spark, d):
    return units.encode(_cells(spark, d), units.vocabulary(fixture.raw_cells(spark, d))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _tiles_sql(size: int, stride: int) -> str:
    return f"""WITH {CELLS_SQL},
    box AS (SELECT unit_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cells GROUP BY unit_id),
    tx AS (SELECT unit_id, i AS ix, x0 + i * {stride} AS tx0 FROM box, range(0, 1000) t(i) WHERE x0 + i * {stride} < x1 + {stride}),
    ty AS (SELECT unit_id, i AS iy, y0 + i * {stride} AS ty0 FROM box, range(0, 1000) t(i) WHERE y0 + i * {stride} < y1 + {stride}),
    m AS (SELECT c.unit_id, c.cell_id, ix, iy FROM cells c JOIN tx ON tx.unit_id = c.unit_id AND c.x >= tx0 AND c.x < tx0 + {size}
          JOIN ty ON ty.unit_id = c.unit_id AND c.y >= ty0 AND c.y < ty0 + {size})
    SELECT unit_id || '_tile' || lpad(CAST(dense_rank() OVER (PARTITION BY unit_id ORDER BY ix, iy) - 1 AS VARCHAR), 3, '0') AS tile_id, cell_id FROM m"""


@query(_tiles_sql(100, 100))
def grid_tiles(spark, d):
    return units.grid_tiles(_cells(spark, d), 100.0, region="unit_id").select("tile_id", "cell_id")


@query(_tiles_sql(100, 50))
def grid_tiles_overlap(spark, d):
    return units.grid_tiles(_cells(spark, d), 100.0, 50.0, region="unit_id").select("tile_id", "cell_id")


@query(_tiles_sql(60, 90))
def grid_tiles_gaps(spark, d):
    return units.grid_tiles(_cells(spark, d), 60.0, 90.0, region="unit_id").select("tile_id", "cell_id")


def _triangles(spark, cells):
    # two overlapping triangles per unit
    rings = lambda *p: F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p]))
    u = cells.select("unit_id").distinct()
    first, second = rings((0.0, 0.0), (300.0, 0.0), (0.0, 160.0)), rings((10.0, 10.0), (120.0, 150.0), (250.0, 20.0))
    return u.select("unit_id", F.lit(0).alias("number"), first.alias("rings")).unionByName(u.select("unit_id", F.lit(1).alias("number"), second.alias("rings")))


_IN0 = "(x > 0 AND y > 0 AND 160e0 * x + 300e0 * y < 48000e0)"
_IN1 = "((120e0 - 10e0) * (y - 10e0) - (150e0 - 10e0) * (x - 10e0) < 0 AND (250e0 - 120e0) * (y - 150e0) - (20e0 - 150e0) * (x - 120e0) < 0 AND (10e0 - 250e0) * (y - 20e0) - (10e0 - 20e0) * (x - 250e0) < 0)"


@query(f"WITH {CELLS_SQL} SELECT unit_id || '_polygon000' AS polygon_id, cell_id FROM cells WHERE {_IN0} UNION ALL SELECT unit_id || '_polygon001', cell_id FROM cells WHERE {_IN1}")
def polygon_members(spark, d):
    cells = _cells(spark, d)
    return units.polygon_members(cells, _triangles(spark, cells), region="unit_id").select("polygon_id", "cell_id")


@query(f"WITH {CELLS_SQL} SELECT unit_id, cell_id FROM cells WHERE {_IN0} OR {_IN1}")
def polygons_inside_any(spark, d):
    cells = _cells(spark, d)
    return units.inside_any(cells, _triangles(spark, cells), region="unit_id").select("unit_id", "cell_id")


_UNITS_SQL = f"""{CELLS_SQL},
un AS (SELECT DISTINCT unit_id, unit_id AS region_id, sample_id, user_id, user_id % 3 = 0 AS no_patient FROM cells),
lab AS (
  SELECT unit_id AS label_id, 1e0 AS target, 'P' || sample_id AS patient FROM un WHERE user_id % 2 = 0
  UNION ALL SELECT DISTINCT sample_id, 0e0, 'P' || sample_id FROM un WHERE user_id % 5 <> 0)"""


def _units(spark, d):
    return _cells(spark, d).select("unit_id", F.col("unit_id").alias("region_id"), "sample_id", "user_id").distinct()


def _labels(u):
    own = u.where("user_id % 2 = 0").select(F.col("unit_id").alias("label_id"), F.lit(1.0).alias("target"), F.concat(F.lit("P"), "sample_id").alias("patient"))
    return own.unionByName(u.where("user_id % 5 <> 0").select(F.col("sample_id").alias("label_id"), F.lit(0.0).alias("target"), F.concat(F.lit("P"), "sample_id").alias("patient")).distinct())


@query(f"WITH {CELLS_SQL}, m AS (SELECT DISTINCT sample_id, unit_id, user_id FROM cells) SELECT sample_id, '/data/' || sample_id || '.csv' AS input_path, CASE WHEN user_id % 7 = 0 THEN sample_id ELSE unit_id END AS region_id FROM m WHERE user_id % 7 <> 0 OR unit_id LIKE '%_w0'")
def manifest_resolve(spark, d):
    u = _units(spark, d).where("user_id % 7 <> 0 or unit_id like '%_w0'")
    raw = u.select(F.concat(F.lit(" "), "sample_id").alias("sample_id"), F.concat("sample_id", F.lit(".csv ")).alias("input_path"), F.when(F.col("user_id") % 7 == 0, F.lit(" ")).otherwise(F.col("unit_id")).alias("region_id"))
    return readers.clean_manifest(raw, "/data")


@query(f"WITH {_UNITS_SQL} SELECT un.unit_id, coalesce(a.label_id, b.label_id) AS label_id, coalesce(a.target, b.target) AS target FROM un LEFT JOIN lab a ON a.label_id = un.unit_id LEFT JOIN lab b ON b.label_id = un.sample_id")
def label_resolve(spark, d):
    u = _units(spark, d)
    return units.resolve_labels(u, _labels(u)).select("unit_id", "label_id", "target")


@query(f"WITH {_UNITS_SQL} SELECT count(*) AS n FROM un WHERE EXISTS (SELECT 1 FROM lab WHERE label_id IN (un.unit_id, un.sample_id))")
def usable_units(spark, d):
    u = _units(spark, d)
    return units.usable(units.resolve_labels(u, _labels(u))).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELLS_SQL}, k AS (SELECT DISTINCT sample_id, CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'mid' END AS grade, user_id % 4 AS stage FROM cells)
SELECT sample_id AS label_id, CASE grade WHEN 'high' THEN 0e0 WHEN 'low' THEN 1e0 ELSE 2e0 END AS grade, CAST(stage AS DOUBLE) AS stage, 'P' || sample_id AS patient_id FROM k WHERE grade IS NOT NULL""")
def label_codes(spark, d):
    raw = _units(spark, d).select("sample_id", "user_id").distinct()
    grade = F.when(F.col("user_id") % 4 == 0, "high").when(F.col("user_id") % 4 == 1, "low").when(F.col("user_id") % 4 == 2, "mid").otherwise(" ")
    raw = raw.select(F.concat("sample_id", F.lit(" ")).alias("id"), grade.alias("grade"), (F.col("user_id") % 4).cast("string").alias("stage"), F.concat(F.lit("P"), "sample_id").alias("patient"))
    return readers.encode_labels(raw, "id", ["grade", "stage"], "patient")[0]


@query(f"WITH {_UNITS_SQL}, ids AS (SELECT unit_id AS id FROM un WHERE user_id % 11 = 0 UNION SELECT sample_id FROM un WHERE user_id % 13 = 0) SELECT unit_id FROM un WHERE unit_id IN (SELECT id FROM ids) OR sample_id IN (SELECT id FROM ids)")
def select_any_id(spark, d):
    u = _units(spark, d)
    ids = u.where("user_id % 11 = 0").select(F.col("unit_id").alias("id")).union(u.where("user_id % 13 = 0").select("sample_id"))
    return units.select_units(u, ids).select("unit_id")


@query(f"WITH {_UNITS_SQL} SELECT unit_id, CASE WHEN no_patient THEN unit_id ELSE 'P' || sample_id END AS patient FROM un")
def patient_default_unit(spark, d):
    u = _units(spark, d).withColumn("patient_id", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("P"), "sample_id")))
    return units.patient_or_unit(u).select("unit_id", "patient")


@query(f"WITH {_UNITS_SQL} SELECT unit_id, CASE WHEN no_patient THEN 'R' || sample_id ELSE 'P' || sample_id END AS patient FROM un")
def patient_default_region(spark, d):
    u = _units(spark, d).withColumn("patient_id", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("P"), "sample_id"))).withColumn("region_id", F.concat(F.lit("R"), "sample_id"))
    return units.patient_or_region(u).select("unit_id", "patient")


@query(f"WITH {_UNITS_SQL} SELECT unit_id FROM un WHERE user_id % 3 = 1")
def resolve_held_out(spark, d):
    return units.resolve_units(_units(spark, d).withColumn("held_out", F.col("user_id") % 3 == 1), "held_out")


@query(f"WITH {CELLS_SQL}, t AS (SELECT unit_id, avg(feature) AS t FROM cells GROUP BY unit_id) SELECT unit_id, t > (SELECT quantile_cont(t, 0.5) FROM t) AS positive FROM t")
def positive_regression(spark, d):
    u = _cells(spark, d).groupBy("unit_id").agg(F.avg("feature").alias("target"))
    return units.positive_units(u, "regression")


@query(f"WITH {CELLS_SQL} SELECT unit_id, CASE cell_type WHEN 'click' THEN 'act' WHEN 'view' THEN 'act' ELSE cell_type END AS t, count(*) AS n FROM cells GROUP BY ALL")
def grouped_types(spark, d):
    g = units.grouped_types(_cells(spark, d), {"click": "act", "view": "act"})
    return g.groupBy("unit_id", F.col("cell_type").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS_SQL}, b AS (SELECT unit_id, max(x) - min(x) AS w, max(y) - min(y) AS h FROM cells GROUP BY unit_id), t AS (SELECT quantile_cont(sqrt(w * w + h * h), 0.5) * 0.25 AS top FROM b) SELECT CAST(i AS INTEGER) AS step, {r('top / 20 * i')} AS radius FROM t, range(1, 21) s(i)")
def radius_grid(spark, d):
    return rounded(units.radius_grid(_cells(spark, d), 20))


@query(f"WITH {CELLS_SQL} SELECT DISTINCT unit_id || '/a b:' || cell_type AS name, unit_id || '_a_b_' || cell_type AS safe FROM cells")
def safe_names(spark, d):
    n = F.concat("unit_id", F.lit("/a b:"), "cell_type")
    return _cells(spark, d).select(n.alias("name"), safe_name(n).alias("safe")).distinct()


# ---- splits and folds ----------------------------------------------------------------------------------------------


@query("SELECT fold, 'u' || CAST(id AS VARCHAR) AS id FROM (SELECT CAST(c_custkey % 3 AS INTEGER) AS fold, c_custkey AS id FROM customer)")
def folds_explode(spark, d):
    c = fixture.table(spark, d, "customer").select((F.col("c_custkey") % 3).alias("f"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"))
    lists = c.groupBy("f").agg(F.collect_list("id").alias("ids")).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "ids"))), lambda x: x["ids"]).alias("folds"))
    return splits.folds_table(lists)


@query("WITH f AS (SELECT c_custkey % 3 AS fold, c_custkey AS id FROM customer UNION ALL SELECT 0, c_custkey FROM customer WHERE c_custkey % 6 < 2) SELECT id, count(DISTINCT fold) AS n_folds FROM f GROUP BY id HAVING count(DISTINCT fold) > 1")
def folds_overlap_check(spark, d):
    c = fixture.table(spark, d, "customer").select((F.col("c_custkey") % 3).alias("fold"), F.col("c_custkey").alias("id"))
    return splits.overlapping_ids(c.union(c.where("id % 6 < 2").select(F.lit(0).cast("long"), "id")))


def _split_sql(stratum: str) -> str:
    """Largest remainder by stratum, then a group from the largest part for each part without one."""
    deal = "l0"
    steps = ""
    for i in (1, 2, 3):
        steps += f", s{i} AS (SELECT * EXCLUDE (l{i - 1}), CASE WHEN l{i - 1}[{i}] = 0 AND list_max(l{i - 1}) > 1 THEN list_transform(range(1, 4), lambda k: l{i - 1}[k] + CAST(k = {i} AS INTEGER) - CAST(k = list_position(l{i - 1}, list_max(l{i - 1})) AS INTEGER)) ELSE l{i - 1} END AS l{i} FROM {'s' + str(i - 1) if i > 1 else 'b'})"
    return f"""WITH g AS (
  SELECT c_custkey AS group_id, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY md5('5|' || CAST(c_custkey AS VARCHAR)), c_custkey) AS k,
         count(*) OVER (PARTITION BY {stratum}) AS n FROM customer),
q AS (SELECT *, floor(round(n * 0.7e0, 9)) AS f0, floor(round(n * 0.15e0, 9)) AS f1, round(n * 0.7e0, 9) - floor(round(n * 0.7e0, 9)) AS r0, round(n * 0.15e0, 9) - floor(round(n * 0.15e0, 9)) AS r1 FROM g),
z AS (SELECT *, n - f0 - 2 * f1 AS rest, round(r0, 9) >= round(r1, 9) AS first FROM q),
a AS (SELECT *, f0 + CASE WHEN rest >= 1 AND first OR rest >= 3 THEN 1 ELSE 0 END AS a,
             f1 + CASE WHEN rest >= 2 OR rest >= 1 AND NOT first THEN 1 ELSE 0 END AS c FROM z),
b AS (SELECT group_id, k, [CAST(a AS BIGINT), CAST(c AS BIGINT), CAST(n - a - c AS BIGINT)] AS {deal} FROM a){steps}
SELECT group_id, CASE WHEN k <= l3[1] THEN 'train' WHEN k <= l3[1] + l3[2] THEN 'val' ELSE 'test' END AS split FROM s3"""


@query(_split_sql("c_nationkey"))
def random_split(spark, d):
    g = fixture.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_nationkey").alias("s"))
    return splits.random_split(g, (0.7, 0.15, 0.15), 5, "s")


@query(_split_sql("(c_custkey // 3 - (c_custkey // 3) % 2)"))
def random_split_small_strata(spark, d):
    # strata of six groups or, at the ends of the table, fewer
    c = F.floor(F.col("c_custkey") / 3)
    g = fixture.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), (c - c % 2).alias("s"))
    return splits.random_split(g, (0.7, 0.15, 0.15), 5, "s")


@query(_split_sql("c_custkey // 3"))
def random_split_three_groups(spark, d):
    g = fixture.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.floor(F.col("c_custkey") / 3).alias("s"))
    return splits.random_split(g, (0.7, 0.15, 0.15), 5, "s")


@query("SELECT CAST(c_custkey % 50 AS BIGINT) AS group_id, CAST(max(c_custkey % 50 % 4) AS DOUBLE) AS stratum FROM customer GROUP BY 1")
def strata(spark, d):
    c = fixture.table(spark, d, "customer")
    return splits.strata(c.select((F.col("c_custkey") % 50).alias("group_id"), (F.col("c_custkey") % 50 % 4).cast("double").alias("label")))


@query("SELECT CAST(c_custkey % 3 AS INTEGER) AS fold, count(*) AS n_units, count(DISTINCT c_nationkey) AS n_classes FROM customer GROUP BY 1")
def outer_folds_check(spark, d):
    c = fixture.table(spark, d, "customer")
    f = c.select((F.col("c_custkey") % 3).cast("int").alias("fold"), F.col("c_custkey").alias("id"))
    return splits.check_folds(f, c.select(F.col("c_custkey").alias("unit_id"), F.col("c_custkey").alias("group_id"), F.col("c_nationkey").alias("label")))


# ---- graphs --------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT unit_id, src, dst FROM edges")
def delaunay_edges(spark, d):
    return _edges(_cells(spark, d))


@query(f"WITH {EDGES_SQL}{ENDS_SQL} SELECT unit_id, src, dst, {r('d')} AS distance, {r('least(greatest((ln(greatest(d, 1e-12)) - 2) / 3e0, 0e0), 1e0)')} AS log_distance, CASE WHEN d <= 20 THEN 1e0 ELSE 0e0 END AS neighbor FROM ends")
def edge_features(spark, d):
    c = _cells(spark, d)
    return rounded(graph.edge_features(_edges(c), c))


@query(f"WITH {EDGES_SQL}{ENDS_SQL} SELECT unit_id, count(*) AS n FROM ends WHERE d <= 60 GROUP BY unit_id")
def short_edges(spark, d):
    c = _cells(spark, d)
    return graph.short_edges(_edges(c), c, 60.0).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


_DEG = ", dg AS (SELECT unit_id, src AS cell_id, count(*) AS degree FROM (SELECT unit_id, src FROM edges UNION ALL SELECT unit_id, dst FROM edges) GROUP BY ALL)"


@query(f"WITH {EDGES_SQL}{_DEG} SELECT c.unit_id, c.cell_id, coalesce(degree, 0) AS degree FROM cells c LEFT JOIN dg ON dg.unit_id = c.unit_id AND dg.cell_id = c.cell_id")
def node_degree(spark, d):
    c = _cells(spark, d)
    return graph.degrees(_edges(c), c)


_IMP = """, im AS (SELECT unit_id, cell_id, degree, greatest((v - avg(v) OVER w) / (max(v) OVER w - avg(v) OVER w + 1e-8), 0e0) AS importance
  FROM (SELECT c.unit_id, c.cell_id, coalesce(degree, 0) AS degree, ln(1e0 + coalesce(degree, 0)) AS v FROM cells c LEFT JOIN dg ON dg.unit_id = c.unit_id AND dg.cell_id = c.cell_id) WINDOW w AS (PARTITION BY unit_id))"""


@query(f"WITH {EDGES_SQL}{_DEG}{_IMP} SELECT unit_id, cell_id, degree, {r('importance')} AS importance FROM im")
def degree_importance(spark, d):
    c = _cells(spark, d)
    return rounded(graph.degree_importance(_edges(c), c))


_EGO = """, bw AS (SELECT unit_id, src, dst FROM edges UNION ALL SELECT unit_id, dst, src FROM edges),
e0 AS (SELECT unit_id, cell_id AS root_id, cell_id AS node_id, 0 AS hop FROM cells),
e1 AS (SELECT e0.unit_id, root_id, bw.dst AS node_id, 1 AS hop FROM e0 JOIN bw ON bw.unit_id = e0.unit_id AND bw.src = node_id),
e2 AS (SELECT DISTINCT e1.unit_id, root_id, bw.dst AS node_id, 2 AS hop FROM e1 JOIN bw ON bw.unit_id = e1.unit_id AND bw.src = node_id),
ego AS (SELECT unit_id, root_id, node_id, min(hop) AS hop FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY ALL)"""


@query(f"WITH {EDGES_SQL}{_EGO} SELECT unit_id, root_id, count(*) AS n, CAST(sum(CASE WHEN hop = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_far FROM ego GROUP BY unit_id, root_id")
def khop_ego_sizes(spark, d):
    c = _cells(spark, d)
    return graph.ego_nodes(_edges(c), c, 2).groupBy("unit_id", "root_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("hop") == 2).cast("long")).alias("n_far"))


@query(f"WITH {EDGES_SQL}{_EGO} SELECT unit_id, root_id, node_id, hop FROM ego WHERE root_id % 10 = 0")
def ego_nodes(spark, d):
    c = _cells(spark, d)
    return graph.ego_nodes(_edges(c), c.where("cell_id % 10 = 0"), 2)


@query(f"WITH {EDGES_SQL}{_EGO} SELECT unit_id, root_id, node_id, hop FROM ego")
def ego_nodes_all_roots(spark, d):
    c = _cells(spark, d)
    return graph.ego_nodes(_edges(c), c, 2)


@query(f"WITH {EDGES_SQL}{_EGO} SELECT ego.unit_id, ego.root_id, count(*) AS n FROM ego JOIN edges e ON e.unit_id = ego.unit_id AND e.src = ego.node_id JOIN ego g ON g.unit_id = ego.unit_id AND g.root_id = ego.root_id AND g.node_id = e.dst GROUP BY ALL")
def ego_induced_edges(spark, d):
    c = _cells(spark, d)
    e = _edges(c)
    return graph.ego_edges(e, graph.ego_nodes(e, c, 2)).groupBy("unit_id", "root_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {EDGES_SQL}{_EGO},
near AS (SELECT ego.unit_id, ego.root_id, ego.node_id FROM ego JOIN cells a ON a.unit_id = ego.unit_id AND a.cell_id = node_id JOIN cells b ON b.unit_id = ego.unit_id AND b.cell_id = root_id
  WHERE ego.root_id % 5 = 0 AND (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 45 OR node_id = ego.root_id)),
inner_e AS (SELECT n.unit_id, n.root_id, bw.src, bw.dst FROM near n JOIN bw ON bw.unit_id = n.unit_id AND bw.src = n.node_id JOIN near m ON m.unit_id = n.unit_id AND m.root_id = n.root_id AND m.node_id = bw.dst),
reach AS (SELECT unit_id, root_id, root_id AS node_id FROM near WHERE node_id = root_id UNION SELECT r.unit_id, r.root_id, i.dst FROM reach r JOIN inner_e i ON i.unit_id = r.unit_id AND i.root_id = r.root_id AND i.src = r.node_id)
SELECT unit_id, root_id, node_id FROM reach""")
def ego_radius(spark, d):
    c = _cells(spark, d)
    e = _edges(c)
    return graph.ego_radius(graph.ego_nodes(e, c.where("cell_id % 5 = 0"), 2), e, c, 2, 15.0, 15.0)


@query(ORACLES["ego_radius"].replace("ego.root_id % 5 = 0 AND ", ""))
def ego_radius_all_roots(spark, d):
    c = _cells(spark, d)
    return graph.ego_radius_in_units(graph.delaunay_edges(c), c, c, 2, 15.0, 15.0)


_HULL = """, pr AS (SELECT a.unit_id, a.cell_id AS src, b.cell_id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb FROM cells a JOIN cells b ON a.unit_id = b.unit_id AND a.cell_id < b.cell_id),
hull AS (SELECT unit_id, src, dst, ax, ay, bx, yb FROM (
  SELECT pr.*, min((bx - ax) * (c.y - ay) - (yb - ay) * (c.x - ax)) AS lo, max((bx - ax) * (c.y - ay) - (yb - ay) * (c.x - ax)) AS hi
  FROM pr JOIN cells c ON c.unit_id = pr.unit_id AND c.cell_id NOT IN (pr.src, pr.dst) GROUP BY pr.unit_id, src, dst, ax, ay, bx, yb) WHERE lo > 0 OR hi < 0)"""


@query(f"WITH {CELLS_SQL}{_HULL} SELECT unit_id, src, dst FROM hull")
def hull_edges(spark, d):
    return graph.hull_edges(_cells(spark, d))


@query(f"""WITH {EDGES_SQL}{_HULL},
nn AS (SELECT a.unit_id, a.cell_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM cells a JOIN cells b ON a.unit_id = b.unit_id AND a.cell_id <> b.cell_id GROUP BY ALL),
med AS (SELECT unit_id, quantile_cont(d, 0.5) AS m FROM nn GROUP BY unit_id),
seg AS (SELECT c.unit_id, c.cell_id, c.x, c.y, h.*, greatest(0e0, least(1e0, ((c.x - ax) * (bx - ax) + (c.y - ay) * (yb - ay)) / ((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)))) AS t FROM cells c JOIN (SELECT unit_id AS hu, ax, ay, bx, yb FROM hull) h ON h.hu = c.unit_id),
gap AS (SELECT unit_id, cell_id, min(sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (yb - ay)) * (y - ay - t * (yb - ay)))) AS g FROM seg GROUP BY ALL),
rim AS (SELECT gap.unit_id, cell_id FROM gap JOIN med ON med.unit_id = gap.unit_id WHERE g <= m),
left_over AS (SELECT c.unit_id, c.cell_id FROM cells c WHERE NOT EXISTS (SELECT 1 FROM rim WHERE rim.unit_id = c.unit_id AND rim.cell_id = c.cell_id))
SELECT unit_id, cell_id FROM left_over UNION ALL SELECT unit_id, cell_id FROM cells WHERE unit_id NOT IN (SELECT unit_id FROM left_over)""")
def interior_cells(spark, d):
    c = _cells(spark, d)
    return graph.interior_cells(c, _edges(c), 1, 1.0, largest=False)


@query()
def interior_component(spark, d):
    c = _cells(spark, d)
    return graph.interior_cells(c, _edges(c), 2)


@query(f"""WITH RECURSIVE {EDGES_SQL}{ENDS_SQL},
bw AS (SELECT unit_id, src, dst FROM both_ways WHERE d <= 25),
walk AS (SELECT unit_id, cell_id, cell_id AS seen FROM cells UNION SELECT w.unit_id, w.cell_id, bw.dst FROM walk w JOIN bw ON bw.unit_id = w.unit_id AND bw.src = w.seen)
SELECT unit_id, cell_id, min(seen) AS component FROM walk GROUP BY unit_id, cell_id""")
def components(spark, d):
    c = _cells(spark, d)
    return graph.components(c, graph.short_edges(_edges(c), c, 25.0))


def _u(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) AS DOUBLE) / {float(16**12)!r})"


@query(f"WITH {CELLS_SQL} SELECT unit_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY {_u('3', 'unit_id', 'cell_id')}, cell_id) AS k FROM cells) WHERE k <= 8")
def root_sample_uniform(spark, d):
    return graph.root_sample(_cells(spark, d), 8, 3)


@query(f"WITH {CELLS_SQL}, w AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY unit_id, cell_type) AS weight FROM cells) SELECT unit_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY -ln(greatest({_u('3', 'unit_id', 'cell_id')}, 1e-15)) / weight, cell_id) AS k FROM w) WHERE k <= 8")
def root_sample_weighted(spark, d):
    c = graph.inverse_frequency(_cells(spark, d))
    return graph.root_sample(c, 8, 3, F.col("weight"))


@query(f"WITH {CELLS_SQL}, w AS (SELECT *, 1e0 / sqrt(count(*) OVER (PARTITION BY unit_id, cell_type)) AS weight FROM cells) SELECT unit_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY -ln(greatest({_u('3', 'unit_id', 'cell_id')}, 1e-15)) / weight, cell_id) AS k FROM w) WHERE k <= 8")
def root_sample_sqrt(spark, d):
    return graph.unit_roots(_cells(spark, d), SamplerConfig(roots_per_unit=8, root_weighting="sqrt_inverse"), seed=3)


@query(f"WITH {CELLS_SQL} SELECT unit_id, cell_id FROM cells")
def root_sample_all(spark, d):
    return graph.unit_roots(_cells(spark, d), SamplerConfig(roots_per_unit=None), seed=3)


@query(f"WITH {CELLS_SQL}, n AS (SELECT unit_id, least(count(*), 12) AS n_roots FROM cells GROUP BY unit_id) SELECT unit_id, n_roots, CAST(ceil(n_roots / 5e0) AS BIGINT) AS n_batches FROM n")
def loader_sizes(spark, d):
    return graph.loader_sizes(_cells(spark, d), 12, 5)


@query(f"WITH {CELLS_SQL}, n AS (SELECT unit_id, least(count(*), 12) AS n_roots FROM cells GROUP BY unit_id) SELECT CAST(sum(n_roots) AS BIGINT) AS n_roots, CAST(ceil(sum(n_roots) / 5e0) AS BIGINT) AS n_batches FROM n")
def loader_sizes_merged(spark, d):
    return graph.loader_sizes(_cells(spark, d), 12, 5, merged=True)


@query(f"WITH {EDGES_SQL} SELECT unit_id, src, dst FROM edges WHERE {_u('9', 'unit_id', 'src', 'dst')} >= 1 - (1 - 0.2e0) * (1 - 0.2e0)")
def drop_edges_hash(spark, d):
    return graph.drop_edges(_edges(_cells(spark, d)), 0.2, 9)


@query(f"WITH {CELLS_SQL}, m AS (SELECT *, {_u('4', 'unit_id', 'cell_id')} < 0.3e0 AS hit FROM cells) SELECT unit_id, cell_id, CASE WHEN NOT hit THEN cell_type END AS cell_type, CASE WHEN hit THEN 0e0 ELSE feature END AS feature FROM m")
def mask_nodes_hash(spark, d):
    return graph.mask_nodes(_cells(spark, d), 0.3, 4).select("unit_id", "cell_id", "cell_type", "feature")


@query(f"""WITH {EDGES_SQL}{_DEG}{_IMP},
v AS (SELECT e.unit_id, e.src, e.dst, (a.importance + b.importance) / 2 AS v FROM (SELECT unit_id, src, dst FROM edges UNION ALL SELECT unit_id, dst, src FROM edges) e JOIN im a ON a.unit_id = e.unit_id AND a.cell_id = e.src JOIN im b ON b.unit_id = e.unit_id AND b.cell_id = e.dst),
s AS (SELECT *, greatest((v - avg(v) OVER w) / (max(v) OVER w - avg(v) OVER w + 1e-8), 0e0) AS s FROM v WINDOW w AS (PARTITION BY unit_id)),
k AS (SELECT unit_id, src, dst FROM s WHERE {_u('2', 'unit_id', 'src', 'dst')} > least((1 - s) * 0.25e0, 0.45e0))
SELECT a.unit_id, a.src, a.dst FROM k a JOIN k b ON a.unit_id = b.unit_id AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""")
def drop_importance_hash(spark, d):
    c = _cells(spark, d)
    return graph.drop_importance(_edges(c), c, 0.25, 0.45, 2)


@query(f"""WITH {EDGES_SQL}{_DEG}{_IMP},
m AS (SELECT c.*, {_u('2', 'c.unit_id', 'c.cell_id')} < least((1 - i.importance) * 0.25e0, 0.45e0) AS hit FROM cells c JOIN im i ON i.unit_id = c.unit_id AND i.cell_id = c.cell_id)
SELECT unit_id, cell_id, CASE WHEN NOT hit THEN cell_type END AS cell_type, CASE WHEN hit THEN 0e0 ELSE feature END AS feature FROM m""")
def mask_importance_hash(spark, d):
    c = _cells(spark, d)
    return graph.mask_importance(c, _edges(c), 0.25, 0.45, 2).select("unit_id", "cell_id", "cell_type", "feature")


# ---- statistics of units -------------------------------------------------------------------------------------------

_CC = ", cc AS (SELECT unit_id, ta, tb, count(*) AS n FROM both_ways GROUP BY ALL)"
_TK = ", tk AS (SELECT unit_id, cell_type AS t, count(*) AS k FROM cells GROUP BY ALL), tp AS (SELECT a.unit_id, a.t AS ta, b.t AS tb, a.k AS na, b.k AS nb FROM tk a JOIN tk b ON a.unit_id = b.unit_id)"
_GS = """, dsum AS (SELECT unit_id, CAST(sum(degree) / 2 AS BIGINT) AS m, CAST(sum(degree * degree) AS BIGINT) AS d2 FROM (SELECT unit_id, src, count(*) AS degree FROM both_ways GROUP BY ALL) GROUP BY unit_id),
gs AS (SELECT c.unit_id, c.n, coalesce(m, 0) AS m, coalesce(d2, 0) AS d2 FROM (SELECT unit_id, count(*) AS n FROM cells GROUP BY unit_id) c LEFT JOIN dsum ON dsum.unit_id = c.unit_id)"""
_GRAPH = f"{EDGES_SQL}{ENDS_SQL}{_CC}{_TK}{_GS}"


@query(f"WITH {_GRAPH} SELECT unit_id, ta, tb, n FROM cc")
def contact_counts(spark, d):
    c = _cells(spark, d)
    return stats.contact_counts(c, _edges(c))


@query(f"WITH {_GRAPH}, f AS (SELECT tp.unit_id, tp.ta, tp.tb, coalesce(n, 0) AS n, sum(n) OVER (PARTITION BY tp.unit_id) AS total FROM tp LEFT JOIN cc ON cc.unit_id = tp.unit_id AND cc.ta = tp.ta AND cc.tb = tp.tb WHERE tp.ta IN ('purchase', 'signup')) SELECT unit_id, ta, tb, {r('n / total')} AS fraction FROM f")
def contact_fractions(spark, d):
    c = _cells(spark, d)
    return rounded(stats.contact_fractions(c, _edges(c), ["purchase", "signup"]))


_ENR = """, en0 AS (SELECT tp.*, coalesce(cc.n, 0) AS obs, gs.n AS nc, CAST(gs.m AS DOUBLE) AS m, CAST(gs.d2 AS DOUBLE) - 2 * gs.m AS tw FROM tp JOIN gs ON gs.unit_id = tp.unit_id LEFT JOIN cc ON cc.unit_id = tp.unit_id AND cc.ta = tp.ta AND cc.tb = tp.tb),
en1 AS (SELECT *, CAST(nc AS DOUBLE) * (nc - 1) AS f2, CAST(nc AS DOUBLE) * (nc - 1) * (nc - 2) AS f3, CAST(nc AS DOUBLE) * (nc - 1) * (nc - 2) * (nc - 3) AS f4, m * (m - 1) - tw AS apart FROM en0),
en2 AS (SELECT *, CASE WHEN ta = tb THEN m * na * (na - 1) / f2 ELSE 2 * m * na * nb / f2 END AS e1 FROM en1),
en3 AS (SELECT *, CASE WHEN ta = tb THEN 2 * e1 ELSE e1 END AS mean,
  CASE WHEN ta = tb THEN 4 * (e1 + tw * (CAST(na AS DOUBLE) * (na - 1) * (na - 2)) / f3 + apart * (CAST(na AS DOUBLE) * (na - 1) * (na - 2) * (na - 3)) / f4 - e1 * e1)
       ELSE e1 + tw * na * nb * (na + nb - 2) / f3 + apart * 4 * na * (na - 1) * nb * (nb - 1) / f4 - e1 * e1 END AS var FROM en2),
en AS (SELECT unit_id, ta, tb, obs, mean, sqrt(greatest(var, 0e0)) AS sd, CASE WHEN sqrt(greatest(var, 0e0)) > 1e-9 THEN (obs - mean) / sqrt(greatest(var, 0e0)) END AS z, log2((obs + 1) / (mean + 1)) AS ratio FROM en3)"""


@query(f"WITH {_GRAPH}{_ENR} SELECT unit_id, ta, tb, obs AS observed, {r('mean')} AS mean, {r('sd', 4)} AS sd, CASE WHEN sd > 1e-3 THEN {r('z', 4)} END AS z, {r('ratio')} AS log2_ratio FROM en")
def enrichment_analytic(spark, d):
    c = _cells(spark, d)
    e = stats.enrichment_analytic(c, _edges(c))
    return e.select("unit_id", "ta", "tb", "observed", tidy("mean").alias("mean"), tidy("sd", 4).alias("sd"), F.when(F.col("sd") > 1e-3, tidy("z", 4)).alias("z"), tidy("log2_ratio").alias("log2_ratio"))


@query(f"""WITH {_GRAPH},
slots AS (SELECT unit_id, cell_type AS t, row_number() OVER (PARTITION BY unit_id ORDER BY cell_id) AS slot FROM cells),
dr AS (SELECT unit_id, cell_id, CAST(p AS INTEGER) AS perm, row_number() OVER (PARTITION BY unit_id, p ORDER BY {_u('1', 'p', 'cell_id')}, cell_id) AS slot FROM cells, range(0, 20) q(p)),
dl AS (SELECT dr.unit_id, perm, cell_id, t FROM dr JOIN slots s ON s.unit_id = dr.unit_id AND s.slot = dr.slot),
pc AS (SELECT b.unit_id, x.t AS ta, y.t AS tb, x.perm, CAST(count(*) AS DOUBLE) AS c FROM both_ways b JOIN dl x ON x.unit_id = b.unit_id AND x.cell_id = b.src JOIN dl y ON y.unit_id = b.unit_id AND y.cell_id = b.dst AND y.perm = x.perm GROUP BY ALL),
ps AS (SELECT unit_id, ta, tb, sum(c) AS s, sum(c * c) AS s2 FROM pc GROUP BY ALL)
SELECT tp.unit_id, tp.ta, tp.tb, coalesce(n, 0) AS observed, {r('coalesce(s, 0) / 20')} AS mean, {r('sqrt(greatest(coalesce(s2, 0) / 20 - coalesce(s, 0) / 20 * (coalesce(s, 0) / 20), 0e0))', 4)} AS sd
FROM tp LEFT JOIN ps ON ps.unit_id = tp.unit_id AND ps.ta = tp.ta AND ps.tb = tp.tb LEFT JOIN cc ON cc.unit_id = tp.unit_id AND cc.ta = tp.ta AND cc.tb = tp.tb""")
def enrichment_permutation(spark, d):
    c = _cells(spark, d)
    e = stats.enrichment_permutation(c, _edges(c), 20, 1)
    return e.select("unit_id", "ta", "tb", "observed", tidy("mean").alias("mean"), tidy("sd", 4).alias("sd"))


# Moran's I straight from its definition, on values instead of counts
_MOR = """, val AS (SELECT c.unit_id, tk.t, c.cell_id, CASE WHEN c.cell_type = tk.t THEN 1e0 ELSE 0e0 END AS x FROM cells c JOIN tk ON tk.unit_id = c.unit_id),
dev AS (SELECT *, x - avg(x) OVER (PARTITION BY unit_id, t) AS z FROM val),
mo AS (SELECT unit_id, t, count(*) AS n, sum(z * z) AS ss, sum(z * z * z * z) AS s4 FROM dev GROUP BY ALL),
cr AS (SELECT e.unit_id, a.t, sum(a.z * b.z) AS c FROM edges e JOIN dev a ON a.unit_id = e.unit_id AND a.cell_id = e.src JOIN dev b ON b.unit_id = e.unit_id AND b.cell_id = e.dst AND b.t = a.t GROUP BY ALL),
mi0 AS (SELECT mo.unit_id, mo.t, CAST(mo.n AS DOUBLE) AS n, ss, CAST(gs.m AS DOUBLE) AS m, CAST(gs.d2 AS DOUBLE) AS d2, coalesce(c, 0) AS c, mo.n * s4 / (ss * ss) AS kurt FROM mo JOIN gs ON gs.unit_id = mo.unit_id LEFT JOIN cr ON cr.unit_id = mo.unit_id AND cr.t = mo.t WHERE ss > 1e-12 AND gs.m > 0 AND mo.n >= 4),
mi1 AS (SELECT *, n / (2 * m) * 2 * c / ss AS i, -1 / (n - 1) AS e, (n * ((n * n - 3 * n + 3) * 4 * m - n * 4 * d2 + 3 * 4 * m * m) - kurt * ((n * n - n) * 4 * m - 2 * n * 4 * d2 + 6 * 4 * m * m)) / ((n - 1) * (n - 2) * (n - 3) * 4 * m * m) - 1 / ((n - 1) * (n - 1)) AS v FROM mi0),
mi AS (SELECT tk.unit_id, tk.t, CASE WHEN v > 1e-15 THEN i END AS i, CASE WHEN v > 1e-15 THEN e END AS e, CASE WHEN v > 1e-15 THEN v END AS v FROM tk LEFT JOIN mi1 ON mi1.unit_id = tk.unit_id AND mi1.t = tk.t)"""


@query(f"WITH {_GRAPH}{_MOR} SELECT unit_id, t, {r('i')} AS i FROM mi")
def morans_i(spark, d):
    c = _cells(spark, d)
    return rounded(stats.morans_i(c, _edges(c)).select("unit_id", "t", "i"))


@query(f"WITH {_GRAPH}{_MOR} SELECT unit_id, t, {r('e')} AS expected, {r('v')} AS variance FROM mi")
def moran_moments(spark, d):
    c = _cells(spark, d)
    return rounded(stats.morans_i(c, _edges(c)).select("unit_id", "t", "expected", "variance"))


@query(f"WITH {_GRAPH}{_MOR}, p AS (SELECT t, avg(i) AS mean_i, avg(e) AS mean_expected, stddev_samp(i) / sqrt(count(i)) AS sem, count(i) AS n_units, sum(v) AS v FROM mi WHERE i IS NOT NULL GROUP BY t), z AS (SELECT *, (mean_i - mean_expected) / (sqrt(v) / n_units) AS z FROM p) SELECT t, {r('mean_i')} AS mean_i, {r('mean_expected')} AS mean_expected, {r('sem')} AS sem, n_units, {r('z')} AS z, {r(normal_two_sided_sql('z'))} AS p FROM z")
def moran_pooled(spark, d):
    from mosaica.functions.scalars import normal_two_sided

    c = _cells(spark, d)
    return rounded(stats.moran_pooled(stats.morans_i(c, _edges(c)), "t").withColumn("p", normal_two_sided("z")))


_CL = """, np AS (SELECT a.unit_id, a.cell_type AS ta, b.cell_type AS tb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM cells a JOIN cells b ON a.unit_id = b.unit_id AND a.cell_id <> b.cell_id),
rad AS (SELECT unnest([20e0, 50e0, 100e0]) AS radius),
cn AS (SELECT unit_id, ta, tb, radius, count(*) AS c FROM np, rad WHERE d <= radius GROUP BY ALL),
al AS (SELECT unit_id, radius, sum(c) AS c FROM cn GROUP BY ALL),
bx AS (SELECT unit_id, count(*) AS n, greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-12) AS area FROM cells GROUP BY unit_id),
cl AS (SELECT tp.unit_id, tp.ta, tp.tb, rad.radius, CASE WHEN na >= 2 AND nb >= 2 THEN
  sqrt(area * coalesce(cn.c, 0) / CASE WHEN tp.ta = tp.tb THEN na * (na - 1) ELSE na * nb END / pi()) - sqrt(area * coalesce(al.c, 0) / (n * (n - 1)) / pi()) END AS value
  FROM tp CROSS JOIN rad JOIN bx ON bx.unit_id = tp.unit_id LEFT JOIN cn ON cn.unit_id = tp.unit_id AND cn.ta = tp.ta AND cn.tb = tp.tb AND cn.radius = rad.radius LEFT JOIN al ON al.unit_id = tp.unit_id AND al.radius = rad.radius)"""
RADII = [20.0, 50.0, 100.0]


@query(f"WITH {CELLS_SQL}{_TK}{_CL} SELECT unit_id, ta, tb, radius, {r('value')} AS value FROM cl")
def cross_l(spark, d):
    return rounded(stats.cross_l(_cells(spark, d), RADII))


@query(f"WITH {CELLS_SQL}{_TK}{_CL}, pp AS (SELECT ta, tb, radius, avg(value) AS mean_value, count(*) AS n_units FROM cl WHERE value IS NOT NULL GROUP BY ALL), pr AS (SELECT radius, round(avg(abs(mean_value)), 9) AS s FROM pp GROUP BY radius) SELECT 'all' AS scope, radius, ta, tb, {r('mean_value')} AS mean_value, n_units FROM pp WHERE radius = (SELECT radius FROM pr ORDER BY s DESC, radius LIMIT 1)")
def cross_l_rstar(spark, d):
    return rounded(stats.best_radius(stats.cross_l(_cells(spark, d), RADII).withColumn("scope", F.lit("all")), "scope"))


@query(f"WITH {_GRAPH}, dd AS (SELECT unit_id, ta AS t, sum(n) AS d FROM cc GROUP BY ALL), tt AS (SELECT unit_id, greatest(sum(n), 1) AS total FROM cc GROUP BY unit_id) SELECT tp.unit_id, tp.ta, tp.tb, {r('log2((coalesce(n, 0) + 1) / (CAST(coalesce(a.d, 0) AS DOUBLE) * coalesce(b.d, 0) / coalesce(total, 1) + 1))')} AS value FROM tp LEFT JOIN cc ON cc.unit_id = tp.unit_id AND cc.ta = tp.ta AND cc.tb = tp.tb LEFT JOIN dd a ON a.unit_id = tp.unit_id AND a.t = tp.ta LEFT JOIN dd b ON b.unit_id = tp.unit_id AND b.t = tp.tb LEFT JOIN tt ON tt.unit_id = tp.unit_id")
def colocalisation(spark, d):
    c = _cells(spark, d)
    return rounded(stats.colocalisation(c, _edges(c)))


_WIN = """, kn AS (SELECT a.unit_id, a.cell_id, b.cell_type AS t, row_number() OVER (PARTITION BY a.unit_id, a.cell_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.cell_id) AS k FROM cells a JOIN cells b ON a.unit_id = b.unit_id AND a.cell_id <> b.cell_id),
wm AS (SELECT unit_id, cell_id, t FROM kn WHERE k <= 5 UNION ALL SELECT unit_id, cell_id, cell_type FROM cells),
wn AS (SELECT unit_id, cell_id, t, count(*) AS c FROM wm GROUP BY ALL),
wc AS (SELECT unit_id, cell_id, t, c / sum(c) OVER (PARTITION BY unit_id, cell_id) AS share FROM wn)"""
CENTRES = [{"view": 0.8, "click": 0.2}, {"purchase": 0.5, "signup": 0.5}, {"error": 0.6, "click": 0.2, "view": 0.2}]
_CN = _WIN + """, wd AS (SELECT unit_id, cell_id, coalesce(sum(share) FILTER (t = 'click'), 0) AS c, coalesce(sum(share) FILTER (t = 'error'), 0) AS e, coalesce(sum(share) FILTER (t = 'purchase'), 0) AS p, coalesce(sum(share) FILTER (t = 'signup'), 0) AS s, coalesce(sum(share) FILTER (t = 'view'), 0) AS v FROM wc GROUP BY ALL),
g AS (SELECT unit_id, cell_id, (c - 0.2e0) * (c - 0.2e0) + e * e + p * p + s * s + (v - 0.8e0) * (v - 0.8e0) AS g0, c * c + e * e + (p - 0.5e0) * (p - 0.5e0) + (s - 0.5e0) * (s - 0.5e0) + v * v AS g1,
  (c - 0.2e0) * (c - 0.2e0) + (e - 0.6e0) * (e - 0.6e0) + p * p + s * s + (v - 0.2e0) * (v - 0.2e0) AS g2 FROM wd),
cna AS (SELECT unit_id, cell_id, CASE WHEN g0 <= g1 AND g0 <= g2 THEN 0 WHEN g1 <= g2 THEN 1 ELSE 2 END AS cn FROM g),
cns AS (SELECT unit_id, 'CN' || CAST(k + 1 AS VARCHAR) AS name, count(*) FILTER (cn = k) / count(*) AS share FROM cna, range(0, 3) q(k) GROUP BY unit_id, k)"""


@query(f"WITH {CELLS_SQL}{_WIN} SELECT unit_id, cell_id, t, {r('share')} AS share FROM wc")
def window_composition(spark, d):
    return rounded(stats.window_composition(_cells(spark, d), 5))


def _cn(spark, d):
    return stats.assign_centres(stats.window_composition(_cells(spark, d), 5), CENTRES)


@query(f"WITH {CELLS_SQL}{_CN} SELECT unit_id, cell_id, CAST(cn AS INTEGER) AS cn FROM cna")
def cn_assign(spark, d):
    return _cn(spark, d)


@query(f"WITH {CELLS_SQL}{_CN} SELECT unit_id, name, {r('share')} AS share FROM cns")
def cn_shares(spark, d):
    return rounded(stats.shares(_cn(spark, d), 3))


@query(f"WITH {CELLS_SQL}{_CN}, pm AS (SELECT split_part(unit_id, '_', 1) AS patient_id, name, avg(share) AS share FROM cns GROUP BY ALL) SELECT patient_id, name, {r('ln(share + 1e-3) - avg(ln(share + 1e-3)) OVER (PARTITION BY patient_id)')} AS clr FROM pm")
def clr_shares(spark, d):
    s = stats.shares(_cn(spark, d), 3).withColumn("patient_id", F.split("unit_id", "_")[0])
    return rounded(stats.centred_log_ratio(testing.patient_means(s, "name", value="share"), "patient_id").select("patient_id", "name", "clr"))


# ---- large units: no SQL, whose triangles and pairs grow with the cube and square of a unit; tests hold them to invariants ----


@query()
def large_delaunay(spark, d):
    return graph.delaunay_edges_in_tiles(fixture.large_cells(spark, d)).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_edges"))


@query()
def large_cross_l(spark, d):
    return rounded(stats.cross_l(fixture.large_cells(spark, d), [5.0, 10.0, 20.0]))


@query()
def large_windows(spark, d):
    return rounded(stats.window_composition_in_tiles(fixture.large_cells(spark, d), 10).groupBy("unit_id", "t").agg(F.avg("share").alias("share")))


@query()
def large_interior(spark, d):
    return interior.interior_cells_in_tiles(fixture.large_cells(spark, d), 4).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_cells"))


# ---- tests ---------------------------------------------------------------------------------------------------------

_PM = f"{_GRAPH}{_MOR}, pv AS (SELECT split_part(unit_id, '_', 1) AS patient_id, t AS metric, avg(i) AS value FROM mi GROUP BY ALL)"


def _patient_values(spark, d):
    c = _cells(spark, d)
    m = stats.morans_i(c, _edges(c)).select(F.split("unit_id", "_")[0].alias("patient_id"), F.col("t").alias("metric"), F.col("i").alias("value"))
    return testing.patient_means(m, "metric")


@query(f"WITH {_PM} SELECT patient_id, metric, {r('value')} AS value FROM pv")
def patient_means(spark, d):
    return rounded(_patient_values(spark, d))


@query(f"WITH {CELLS_SQL} SELECT sample_id AS patient_id, bool_or(label = 1 AND unit_id LIKE '%_w1') AS positive FROM (SELECT DISTINCT sample_id, unit_id, label FROM cells) GROUP BY 1")
def patient_labels(spark, d):
    u = _cells(spark, d).select(F.col("sample_id").alias("patient_id"), "unit_id", ((F.col("label") == 1) & F.col("unit_id").endswith("_w1")).alias("positive")).distinct()
    return testing.patient_labels(u)


_GT = f"""{_PM}, rk AS (SELECT metric, round(value, 9) AS value, CAST(patient_id AS INTEGER) % 2 = 1 AS g FROM pv WHERE value IS NOT NULL),
rr AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS rank, count(*) OVER (PARTITION BY metric, value) AS t FROM rk),
ag AS (SELECT metric, CAST(count(*) FILTER (g) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT g) AS DOUBLE) AS n2, sum(rank) FILTER (g) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties, avg(value) FILTER (g) AS m1, avg(value) FILTER (NOT g) AS m0 FROM rr GROUP BY metric),
uu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM ag WHERE n1 >= 5 AND n2 >= 5),
zz AS (SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5e0, 0e0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM uu),
pp AS (SELECT *, least(1e0, {normal_two_sided_sql('z')}) AS p FROM zz),
qq AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, metric) AS raw FROM pp)"""


def _tests(spark, d):
    v = _patient_values(spark, d).withColumn("value", F.round("value", 9))
    g = v.select("patient_id", (F.col("patient_id").cast("int") % 2 == 1).alias("positive")).distinct()
    return testing.group_tests(v, g, min_per_group=5, exact=False)


@query(f"WITH {_GT} SELECT metric, {r('u / (n1 * n2)')} AS auroc FROM uu")
def mann_whitney_auroc(spark, d):
    return rounded(_tests(spark, d).where("p is not null").select("metric", "auroc"))


@query(f"WITH {_GT} SELECT metric, CAST(n1 AS BIGINT) AS n_positive, CAST(n2 AS BIGINT) AS n_other, {r('m1')} AS mean_positive, {r('m0')} AS mean_other, {r('m1 - m0')} AS difference, {r('p')} AS p, {r('least(1e0, min(raw) OVER (ORDER BY p DESC, metric DESC ROWS UNBOUNDED PRECEDING))')} AS q FROM qq")
def group_tests(spark, d):
    t = _tests(spark, d).where("p is not null")
    return rounded(t.select("metric", "n_positive", "n_other", "mean_positive", "mean_other", "difference", "p", "q"))


@query(f"WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 7919 % 1000) / 1000e0 END AS p FROM customer), k AS (SELECT *, p * count(p) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM c WHERE p IS NOT NULL) SELECT c.id, {r('q')} AS q FROM c LEFT JOIN (SELECT id, least(1e0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM k) k ON c.id = k.id")
def bh_qvalues(spark, d):
    c = fixture.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, (F.col("c_custkey") * 7919 % 1000) / 1000.0).alias("p"))
    return rounded(testing.with_q(c, "p").select("id", "q"))


# ---- attention, predictions, metrics -------------------------------------------------------------------------------


def _scores(spark, d, model=0):
    return fixture.scores(spark, d, model)


_AT = f"""{SCORES_SQL}, lg AS (SELECT unit_id, patient_id, cell_id, cell_type, target, c AS class, CASE c WHEN 0 THEN l0 ELSE l1 END AS logit, CASE c WHEN 0 THEN a0 ELSE a1 END AS att FROM sc, range(0, 2) q(c)),
aw AS (SELECT *, exp(att - max(att) OVER w) / sum(exp(att)) OVER w * exp(max(att) OVER w) AS weight FROM lg WINDOW w AS (PARTITION BY unit_id, class)),
bl AS (SELECT unit_id, class, sum(weight * logit) AS logit FROM aw GROUP BY ALL),
mg AS (SELECT unit_id, patient_id, cell_id, cell_type, target, sum(CASE class WHEN 1 THEN 1 ELSE -1 END * weight * (logit - CASE class WHEN 0 THEN 0.05e0 ELSE -0.05e0 END)) * count(*) OVER (PARTITION BY unit_id) AS margin FROM aw GROUP BY unit_id, patient_id, cell_id, cell_type, target),
pf AS (SELECT unit_id, exp(a) / (exp(a) + exp(b)) AS prob_0, exp(b) / (exp(a) + exp(b)) AS prob_1, CASE WHEN b > a THEN 1 ELSE 0 END AS pred FROM (SELECT unit_id, max(logit) FILTER (class = 0) AS a, max(logit) FILTER (class = 1) AS b FROM bl GROUP BY unit_id))"""


@query(f"WITH {_AT} SELECT unit_id, cell_id, CAST(class AS INTEGER) AS class, {r('weight', 8)} AS weight FROM aw")
def attention_weights(spark, d):
    return rounded(attribution.attention_weights(_scores(spark, d), 2).select("unit_id", "cell_id", "class", "weight"), 8)


@query(f"WITH {_AT} SELECT unit_id, CAST(class AS INTEGER) AS class, {r('logit')} AS logit FROM bl")
def bag_logits(spark, d):
    return rounded(attribution.bag_logits(_scores(spark, d), 2))


@query(f"WITH {_AT} SELECT patient_id, CAST(class AS INTEGER) AS class, {r('sum(exp(att) * logit) / sum(exp(att))')} AS logit FROM lg GROUP BY patient_id, class")
def merged_bag(spark, d):
    return rounded(attribution.bag_logits(_scores(spark, d), 2, key="patient_id"))


@query(f"WITH {_AT} SELECT unit_id, cell_id, {r('margin')} AS margin FROM mg")
def cell_margins(spark, d):
    return rounded(attribution.cell_margins(_scores(spark, d), 2, HEAD_BIAS))


def _frame(spark, d):
    s = _scores(spark, d)
    meta = s.select("unit_id", "patient_id", "target").distinct()
    return attribution.prediction_frame(attribution.bag_logits(s, 2), "classification", 2).join(F.broadcast(meta), "unit_id", "left")


@query(f"WITH {_AT} SELECT unit_id, {r('prob_0')} AS prob_0, {r('prob_1')} AS prob_1, CAST(pred AS INTEGER) AS pred FROM pf")
def prediction_frame(spark, d):
    return rounded(_frame(spark, d).select("unit_id", "prob_0", "prob_1", "pred"))


@query(f"WITH {_AT}, p AS (SELECT unit_id % 10 AS patient_id, count(*) AS n_units, avg(prob_0) AS p0, avg(prob_1) AS p1, min(unit_id % 2) AS target FROM pf GROUP BY 1) SELECT CAST(patient_id AS INTEGER) AS patient_id, n_units, {r('p0')} AS prob_0, {r('p1')} AS prob_1, CAST(target AS INTEGER) AS target, CAST(CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM p")
def patient_frame(spark, d):
    return rounded(attribution.patient_frame(_frame(spark, d)))


@query(f"WITH {SCORES_SQL}, n AS (SELECT cell_type AS class, count(*) AS c FROM sc WHERE cell_type < 8 GROUP BY 1), w AS (SELECT k AS class, coalesce((SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * c), 1e0) AS w FROM range(0, 10) q(k) LEFT JOIN n ON n.class = k) SELECT CAST(class AS INTEGER) AS class, {r('w / (SELECT avg(w) FROM w)')} AS weight FROM w")
def class_weights(spark, d):
    return rounded(metrics.class_weights(_scores(spark, d).where("cell_type < 8"), 10, "cell_type"))


@query(f"""WITH {_AT}, f AS (SELECT pf.*, unit_id % 2 AS t FROM pf), a AS (SELECT avg(-ln(greatest(CASE t WHEN 0 THEN prob_0 ELSE prob_1 END, 1e-12))) AS loss, avg(CASE WHEN pred = t THEN 1e0 ELSE 0e0 END) AS acc FROM f),
b AS (SELECT avg(h) AS bal FROM (SELECT t, avg(CASE WHEN pred = t THEN 1e0 ELSE 0e0 END) AS h FROM f GROUP BY t)),
c AS (SELECT avg(CASE WHEN p.prob_1 > n.prob_1 THEN 1e0 WHEN p.prob_1 = n.prob_1 THEN 0.5e0 ELSE 0e0 END) AS auroc FROM f p, f n WHERE p.t = 1 AND n.t = 0)
SELECT {r('loss')} AS loss, {r('acc')} AS acc, {r('bal')} AS bal_acc, {r('auroc')} AS auroc FROM a, b, c""")
def class_metrics(spark, d):
    return rounded(metrics.frame_metrics(_frame(spark, d), "classification"))


@query(f"WITH {SCORES_SQL} SELECT {r('avg((l0 - a0) * (l0 - a0))')} AS loss, {r('sqrt(avg((l0 - a0) * (l0 - a0)))')} AS rmse, {r('avg(abs(l0 - a0))')} AS mae, {r('1 - avg((l0 - a0) * (l0 - a0)) / var_pop(a0)')} AS r2, {r('corr(l0, a0)')} AS pearson FROM sc")
def regression_metrics(spark, d):
    s = _scores(spark, d).select(F.col("instance_logits")[0].alias("pred"), F.col("attention_logits")[0].alias("target"))
    return rounded(metrics.frame_metrics(s, "regression"))


@query(f"WITH {OUTCOMES_SQL}, o AS (SELECT round(share / 1000) AS r, time AS t, event AS e FROM oc), k AS (SELECT CASE WHEN i.r > j.r THEN 1e0 WHEN i.r = j.r THEN 0.5e0 ELSE 0e0 END AS w FROM o i, o j WHERE i.e AND (i.t < j.t OR (i.t = j.t AND NOT j.e))) SELECT {r('avg(w)')} AS c_index, count(*) AS n_pairs FROM k")
def concordance(spark, d):
    return rounded(metrics.concordance(fixture.outcomes(spark, d).withColumn("risk", F.round(F.col("share") / 1000))))


@query(f"WITH {OUTCOMES_SQL}, o AS (SELECT share / 100000 AS r, time AS t, event AS e FROM oc), k AS (SELECT *, sum(exp(r)) OVER (ORDER BY t DESC RANGE UNBOUNDED PRECEDING) AS s FROM o) SELECT {r('sum(CASE WHEN e THEN ln(s) - r ELSE 0 END) / count(*) FILTER (e)')} AS loss, count(*) FILTER (e) AS n_events FROM k")
def cox_loss(spark, d):
    return rounded(metrics.cox_loss(fixture.outcomes(spark, d).withColumn("risk", F.col("share") / 100000)))


# ---- vectors and clusters ------------------------------------------------------------------------------------------


@query(f"SELECT vec_id AS cell_id, {r('CAST(embedding[1] AS DOUBLE) / n')} AS e0, {r('CAST(embedding[64] AS DOUBLE) / n')} AS e63 FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")
def l2_normalise(spark, d):
    return rounded(_scores(spark, d).withColumn("v", l2_normalised("space")).select("cell_id", F.col("v")[0].alias("e0"), F.col("v")[63].alias("e63")))


@query(f"WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings) SELECT a.i, b.i AS j, {r('covar_samp(a.x, b.x)')} AS cov FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i")
def pca_covariance(spark, d):
    return rounded(cluster.covariance(_scores(spark, d)))


_VOTE = """, uv AS (SELECT vec_id AS cell_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings),
vs AS (SELECT * FROM uv ORDER BY md5('0|' || CAST(cell_id AS VARCHAR)), cell_id LIMIT 100000),
dk AS (SELECT a.cell_id, b.label AS cluster, row_number() OVER (PARTITION BY a.cell_id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), b.cell_id) AS k FROM uv a, vs b),
vt AS (SELECT cell_id, cluster, count(*) AS n FROM dk WHERE k <= 5 GROUP BY ALL)"""


@query(f"WITH {SCORES_SQL}{_VOTE} SELECT cell_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, cluster) AS r FROM vt) WHERE r = 1")
def knn_vote(spark, d):
    # the hash sample of the configured size votes, on all cells
    s = _scores(spark, d)
    return niches.knn_vote(s, cluster.hash_sample(s.withColumn("cluster", F.col("cell_type")), ClusteringConfig().sample_size, 0), 5)


@query(f"WITH {SCORES_SQL}, g AS (SELECT cell_id, round((l0 - 0.1e0) * (l0 - 0.1e0) + (l1 - 0.1e0) * (l1 - 0.1e0), 9) AS g0, round((l0 + 0.1e0) * (l0 + 0.1e0) + l1 * l1, 9) AS g1, round(l0 * l0 + (l1 + 0.2e0) * (l1 + 0.2e0), 9) AS g2 FROM sc) SELECT cell_id, CAST(CASE WHEN g0 <= g1 AND g0 <= g2 THEN 0 WHEN g1 <= g2 THEN 1 ELSE 2 END AS INTEGER) AS cluster FROM g")
def kmeans_assign(spark, d):
    import numpy as np

    return cluster.kmeans_assign(_scores(spark, d), np.array([[0.1, 0.1], [-0.1, 0.0], [0.0, -0.2]]), "instance_logits", cosine=False).select("cell_id", "cluster")


@query()
def kmeans_fit(spark, d):
    s = _scores(spark, d)
    return cluster.kmeans_assign(s, cluster.kmeans_fit(s, 5)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def pca_project(spark, d):
    s = _scores(spark, d)
    out = cluster.pca_transform(s, cluster.pca_fit(s, 2))
    return out.select("cell_id", tidy(F.col("space")[0]).alias("pc1"), tidy(F.col("space")[1]).alias("pc2"))


@query()
def density_niches(spark, d):
    from mosaica.plans.commands import cluster_cells

    return cluster_cells(_scores(spark, d))


# ---- niches --------------------------------------------------------------------------------------------------------


def _assigned(spark, d, model=0):
    s = _scores(spark, d, model)
    m = attribution.cell_margins(s, 2, HEAD_BIAS)
    return s.select("unit_id", "patient_id", "cell_id", (F.col("cell_type") % 4).alias("niche"), (F.col("cell_id") % 3).cast("int").alias("cell_type"), (F.col("target") == 1).alias("positive")).join(m, ["unit_id", "cell_id"])


_AS = f"{_AT}, ass AS (SELECT unit_id, patient_id, cell_id, CAST(cell_type % 4 AS INTEGER) AS niche, CAST(cell_id % 3 AS INTEGER) AS cell_type, target = 1 AS positive, margin FROM mg)"


@query(f"WITH {_AT}, k AS (SELECT cell_type - 1 AS cluster, unit_id, avg(margin) AS m FROM mg GROUP BY ALL), s AS (SELECT cluster, round(avg(m), 12) AS s FROM k GROUP BY cluster) SELECT CAST(cluster AS INTEGER) AS cluster, CAST(CASE WHEN cluster < 0 THEN 0 ELSE row_number() OVER (PARTITION BY cluster < 0 ORDER BY s DESC, cluster) END AS INTEGER) AS niche, {r('s')} AS score FROM s")
def niche_numbering(spark, d):
    s = _scores(spark, d).select("unit_id", "cell_id", (F.col("cell_type") - 1).alias("cluster"))
    return rounded(niches.number_niches(s.join(attribution.cell_margins(_scores(spark, d), 2, HEAD_BIAS), ["unit_id", "cell_id"])))


_NT = f"""{_AS}, pu AS (SELECT niche, unit_id, count(*) AS n, avg(margin) AS m, count(*) / (SELECT count(*) FROM ass b WHERE b.unit_id = a.unit_id) AS share_u FROM ass a GROUP BY niche, unit_id),
nm AS (SELECT niche, avg(m) AS margin FROM pu GROUP BY niche),
nt AS (SELECT pu.niche, sum(n) AS n_cells, count(*) FILTER (share_u > 0.2e0) AS n_units, any_value(margin) AS margin, avg(CASE WHEN sign(m) = sign(margin) THEN 1e0 ELSE 0e0 END) AS sign_consistency FROM pu JOIN nm ON nm.niche = pu.niche GROUP BY pu.niche),
aso AS (SELECT niche, avg(CASE WHEN positive THEN 1e0 ELSE 0e0 END) AS association FROM ass GROUP BY niche),
fr AS (SELECT niche, cell_type, count(*) / sum(count(*)) OVER (PARTITION BY niche) AS f FROM ass GROUP BY niche, cell_type),
ts AS (SELECT cell_type, count(*) / (SELECT count(*) FROM ass) AS t FROM ass GROUP BY cell_type),
tc AS (SELECT niche, string_agg(CAST(cell_type AS VARCHAR) || ' ' || CAST(pc AS VARCHAR) || '%', ', ' ORDER BY k) AS composition FROM (SELECT niche, cell_type, CAST(round(100 * f) AS INTEGER) AS pc, row_number() OVER (PARTITION BY niche ORDER BY f DESC, cell_type) AS k FROM fr) WHERE k <= 3 AND pc > 0 GROUP BY niche),
te AS (SELECT niche, string_agg(CAST(fr.cell_type AS VARCHAR), ', ' ORDER BY round(f / t, 9) DESC, fr.cell_type) AS enriched FROM fr JOIN ts ON ts.cell_type = fr.cell_type WHERE round(f / t, 9) > 1.05e0 GROUP BY niche)"""


@query(f"WITH {_NT} SELECT nt.niche, CASE WHEN nt.niche = 0 THEN 'Background' ELSE 'Niche ' || CAST(nt.niche AS VARCHAR) END AS name, {r('n_cells / (SELECT count(*) FROM ass)')} AS share, CAST(n_cells AS BIGINT) AS n_cells, n_units, {r('association')} AS association, {r('(SELECT avg(CASE WHEN positive THEN 1e0 ELSE 0e0 END) FROM ass)')} AS base_rate, {r('margin')} AS margin, {r('sign_consistency')} AS sign_consistency, coalesce(composition, '') AS composition, coalesce(enriched, '') AS enriched FROM nt JOIN aso ON aso.niche = nt.niche LEFT JOIN tc ON tc.niche = nt.niche LEFT JOIN te ON te.niche = nt.niche")
def niche_table(spark, d):
    return rounded(niches.niche_table(_assigned(spark, d), 0.2, 1.05))


@query(f"WITH {_AS}, g AS (SELECT u.unit_id, k.niche FROM (SELECT DISTINCT unit_id FROM ass) u, (SELECT DISTINCT niche FROM ass) k) SELECT g.unit_id, g.niche, {r('count(a.cell_id) / (SELECT count(*) FROM ass b WHERE b.unit_id = g.unit_id)')} AS share FROM g LEFT JOIN ass a ON a.unit_id = g.unit_id AND a.niche = g.niche GROUP BY g.unit_id, g.niche")
def unit_niche_shares(spark, d):
    return rounded(niches.unit_niche_shares(_assigned(spark, d)))


_BOOT = """, cl AS (SELECT {key}patient_id, sum(value) AS s, count(*) AS c FROM vals GROUP BY ALL),
ck AS (SELECT *, row_number() OVER ({part}ORDER BY patient_id) - 1 AS k, count(*) OVER ({part2}) AS n FROM cl),
dr AS (SELECT {key}b, ((((b * 7919 + k * 104729 + 17) * 48271) % 2147483647) * 16807) % 2147483647 % n AS k FROM ck, range(0, {n}) q(b)),
rt AS (SELECT {dkey}b, sum(s) / sum(c) AS r FROM dr JOIN ck ON ck.k = dr.k{on} GROUP BY ALL)"""


@query(f"WITH {_AS}, vals AS (SELECT niche, patient_id, margin AS value FROM (SELECT niche, unit_id, patient_id, avg(margin) AS margin FROM ass GROUP BY ALL))" + _BOOT.format(key="niche, ", part="PARTITION BY niche ", part2="PARTITION BY niche", n=200, dkey="dr.niche, ", on=" AND ck.niche = dr.niche") + f", b AS (SELECT niche, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM rt GROUP BY niche), m AS (SELECT niche, sum(s) / sum(c) AS mean, count(*) AS n_clusters FROM cl GROUP BY niche) SELECT m.niche, {r('mean')} AS mean, {r('low')} AS low, {r('high')} AS high, n_clusters FROM m JOIN b ON b.niche = m.niche")
def margin_bootstrap(spark, d):
    u = _assigned(spark, d).groupBy("niche", "unit_id", "patient_id").agg(F.avg("margin").alias("value"))
    return rounded(testing.bootstrap_mean(u, "niche", n_boot=200))


def _event_niches(spark, d):
    c = _cells(spark, d)
    return c.withColumn("niche", (F.floor(F.col("x") / 60) % 3).cast("int")).withColumn("positive", F.col("label") == 1)


_EN = f"{EDGES_SQL}{ENDS_SQL}, nc AS (SELECT *, CAST(floor(x / 60) % 3 AS INTEGER) AS niche FROM cells)"


@query(f"""WITH {_EN}, en AS (SELECT b.*, a.niche AS na, c.niche AS nb FROM both_ways b JOIN nc a ON a.unit_id = b.unit_id AND a.cell_id = b.src JOIN nc c ON c.unit_id = b.unit_id AND c.cell_id = b.dst),
names AS (SELECT DISTINCT cell_type AS t FROM nc), nn AS (SELECT DISTINCT niche FROM nc WHERE niche <> 0),
pr AS (SELECT niche, a.t AS ta, b.t AS tb FROM nn, names a, names b WHERE a.t <= b.t),
tis AS (SELECT ta, tb, count(*) AS n FROM en GROUP BY ta, tb),
own AS (SELECT na AS niche, ta, tb, count(*) AS n FROM en WHERE na = nb GROUP BY ALL),
g AS (SELECT pr.*, coalesce(own.n, 0) AS n, coalesce(tis.n, 0) / (SELECT count(*) FROM en) AS tissue, (SELECT sum(n) FROM own o WHERE o.niche = pr.niche) AS ends,
        CAST(CASE WHEN pr.ta = pr.tb THEN coalesce(own.n, 0) / 2 ELSE coalesce(own.n, 0) END AS BIGINT) AS n_contacts
      FROM pr LEFT JOIN own ON own.niche = pr.niche AND own.ta = pr.ta AND own.tb = pr.tb LEFT JOIN tis ON tis.ta = pr.ta AND tis.tb = pr.tb)
SELECT niche, ta, tb, n_contacts, CASE WHEN n_contacts >= 100 AND tissue > 0 THEN {r('log2(n / ends / tissue)')} END AS value FROM g""")
def niche_contacts(spark, d):
    a = _event_niches(spark, d)
    return rounded(niches.niche_contacts(a, _edges(a), 100))


_NU = f"""{_EN}, kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY unit_id, niche) AS k FROM nc WHERE niche <> 0) WHERE k >= 5),
cells2 AS (SELECT CAST(niche AS VARCHAR) || '|' || unit_id AS unit_id, niche, cell_id, cell_type, x, y FROM kept),
edges2 AS (SELECT a.unit_id, e.src, e.dst FROM edges e JOIN cells2 a ON a.cell_id = e.src JOIN cells2 b ON b.cell_id = e.dst AND b.unit_id = a.unit_id)"""


def _swap(sql: str) -> str:
    """The statistics' SQL over the subgraphs of niches."""
    for a, b in ((" cells ", " cells2 "), (" cells)", " cells2)"), (" edges ", " edges2 "), (" both_ways ", " bw2 "), (" cells GROUP", " cells2 GROUP")):
        sql = sql.replace(a, b)
    return sql


_BW2 = ", bw2 AS (SELECT e.unit_id, e.src, e.dst, a.cell_type AS ta, b.cell_type AS tb FROM (SELECT unit_id, src, dst FROM edges2 UNION ALL SELECT unit_id, dst, src FROM edges2) e JOIN cells2 a ON a.unit_id = e.unit_id AND a.cell_id = e.src JOIN cells2 b ON b.unit_id = e.unit_id AND b.cell_id = e.dst)"
_NG = _NU + _BW2 + _swap(_CC + _TK + _GS)


@query(f"WITH {_NG}{_swap(_MOR)}, p AS (SELECT CAST(split_part(unit_id, '|', 1) AS INTEGER) AS niche, t, avg(i) AS mean_i, avg(e) AS mean_expected, stddev_samp(i) / sqrt(count(i)) AS sem, count(i) AS n_units, sum(v) AS v FROM mi WHERE i IS NOT NULL GROUP BY 1, 2) SELECT niche, t, {r('mean_i')} AS mean_i, {r('mean_expected')} AS mean_expected, {r('sem')} AS sem, n_units, {r('(mean_i - mean_expected) / (sqrt(v) / n_units)')} AS z FROM p")
def niche_moran(spark, d):
    a = _event_niches(spark, d)
    return rounded(niches.niche_moran(a, _edges(a), 5))


@query(f"WITH {_NG}{_swap(_ENR)} SELECT CAST(split_part(unit_id, '|', 1) AS INTEGER) AS niche, ta, tb, {r('avg(z)', 4)} AS mean_z, {r('avg(ratio)')} AS mean_log2_ratio, count(z) AS n_units FROM en WHERE ta <= tb GROUP BY 1, 2, 3 HAVING count(z) > 0")
def niche_enrichment(spark, d):
    a = _event_niches(spark, d)
    e = niches.niche_enrichment(a, _edges(a), 5)
    return e.select("niche", "ta", "tb", tidy("mean_z", 4).alias("mean_z"), tidy("mean_log2_ratio").alias("mean_log2_ratio"), "n_units")


@query(f"WITH {_AS}, m AS (SELECT unit_id, round(avg(margin), 12) AS m FROM ass GROUP BY unit_id) SELECT unit_id FROM (SELECT *, row_number() OVER (ORDER BY m DESC, unit_id) AS hi, row_number() OVER (ORDER BY m, unit_id) AS lo FROM m) WHERE hi <= 4 OR lo <= 3")
def render_units(spark, d):
    return niches.render_units(_assigned(spark, d), 7)


@query("SELECT DISTINCT CAST(label AS INTEGER) AS niche, CASE WHEN label = 0 THEN 'Background' ELSE 'Niche ' || CAST(label AS VARCHAR) END AS name FROM embeddings")
def niche_names(spark, d):
    return fixture.table(spark, d, "embeddings").select(F.col("label").alias("niche"), niche_name("label").alias("name")).distinct()


@query(f"SELECT c_custkey AS id, {r('least(greatest((ln(greatest(abs(c_acctbal), 1e-12)) - 2) / 3e0, 0e0), 1e0)')} AS v FROM customer")
def log_distance_feature(spark, d):
    return rounded(fixture.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), log_distance(F.abs("c_acctbal"), 2.0, 5.0).alias("v")))


# ---- survival ------------------------------------------------------------------------------------------------------


def _outcomes(spark, d):
    return fixture.outcomes(spark, d).withColumn("group", (F.col("patient_id") % 3).cast("int"))


_OC = f"{OUTCOMES_SQL}, o AS (SELECT *, CAST(patient_id % 3 AS INTEGER) AS grp, ln(share + 1e-3) AS lv FROM oc), oz AS (SELECT *, (lv - avg(lv) OVER ()) / stddev_pop(lv) OVER () AS z FROM o), rt AS (SELECT time AS t, count(*) FILTER (event) AS d, CAST(sum(count(*)) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM o GROUP BY time)"


@query(f"WITH {_OC} SELECT t, n AS at_risk, d AS events, CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w = 1 THEN 0e0 ELSE {r('exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0e0 END) OVER w)')} END AS survival FROM rt WHERE d > 0 WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)")
def km_curve(spark, d):
    return rounded(survival.kaplan_meier(_outcomes(spark, d)))


@query(f"WITH {_OC}, ev AS (SELECT * FROM rt WHERE d > 0), g AS (SELECT ev.t, ev.d, ev.n, grp, count(*) AS ng FROM ev JOIN o ON o.time >= ev.t GROUP BY ALL) SELECT g.grp AS \"group\", (SELECT count(*) FROM o WHERE o.grp = g.grp AND event) AS observed, {r('sum(d * ng / n)')} AS expected FROM g GROUP BY g.grp")
def logrank_oe(spark, d):
    return rounded(survival.logrank_oe(_outcomes(spark, d)))


@query(f"""WITH {_OC}, ev AS (SELECT * FROM rt WHERE d > 0),
ng AS (SELECT ev.t, CAST(ev.d AS DOUBLE) AS d, CAST(ev.n AS DOUBLE) AS n, count(*) FILTER (grp = 0) / CAST(ev.n AS DOUBLE) AS a, count(*) FILTER (grp = 1) / CAST(ev.n AS DOUBLE) AS b FROM ev JOIN o ON o.time >= ev.t GROUP BY ev.t, ev.d, ev.n),
f AS (SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0e0 END AS f FROM ng),
s AS (SELECT (SELECT count(*) FROM o WHERE event AND grp = 0) - sum(d * a) AS x, (SELECT count(*) FROM o WHERE event AND grp = 1) - sum(d * b) AS y, sum(f * a * (1 - a)) AS v, sum(f * b * (1 - b)) AS w, -sum(f * a * b) AS c FROM f),
k AS (SELECT (w * x * x - 2 * c * x * y + v * y * y) / (v * w - c * c) AS stat FROM s)
SELECT {r('stat')} AS statistic, {r('exp(-stat / 2)')} AS p FROM k""")
def logrank_test(spark, d):
    stat, p = survival.logrank(_outcomes(spark, d))
    return rounded(spark.createDataFrame([(stat, p)], "statistic double, p double"))


@query(f"WITH {_OC}, k AS (SELECT *, sum(exp(z * 0.1e0)) OVER w AS s0, sum(exp(z * 0.1e0) * z) OVER w AS s1, sum(exp(z * 0.1e0) * z * z) OVER w AS s2 FROM oz WINDOW w AS (ORDER BY time DESC RANGE UNBOUNDED PRECEDING)) SELECT {r('sum(z * 0.1e0 - ln(s0))', 4)} AS loglik, {r('sum(z - s1 / s0)', 4)} AS score, {r('sum(s2 / s0 - s1 / s0 * (s1 / s0))', 4)} AS information FROM k WHERE event")
def cox_score_info(spark, d):
    return rounded(survival.cox_score(survival.share_zscore(_outcomes(spark, d)), 0.1), 4)


@query(f"WITH {_OC} SELECT patient_id, {r('z')} AS z FROM oz")
def share_zscore(spark, d):
    return rounded(survival.share_zscore(_outcomes(spark, d)).select("patient_id", "z"))


@query(f"WITH {_OC} SELECT patient_id, CAST((round(share, 2) >= (SELECT quantile_cont(round(share, 2), 0.3333333333333333) FROM o)) AS INTEGER) + CAST((round(share, 2) >= (SELECT quantile_cont(round(share, 2), 0.6666666666666666) FROM o)) AS INTEGER) AS tertile FROM o")
def score_tertiles(spark, d):
    o = _outcomes(spark, d).select("patient_id", F.round("share", 2).alias("score"))
    return survival.score_groups(o).select("patient_id", "tertile")


@query()
def cox_by_group(spark, d):
    return survival.cox_univariate(survival.share_zscore(_outcomes(spark, d), "share", 1e-3, "group"), "group")


# ---- replication ---------------------------------------------------------------------------------------------------


@query(f"WITH {_NT}, k AS (SELECT DISTINCT niche FROM fr), g AS (SELECT a.niche AS a, b.niche AS b, t.cell_type FROM k a JOIN k b ON a.niche < b.niche CROSS JOIN (SELECT DISTINCT cell_type FROM fr) t) SELECT a, b, {r('sqrt(0.5e0 * sum((sqrt(coalesce(p.f, 0)) - sqrt(coalesce(q.f, 0))) * (sqrt(coalesce(p.f, 0)) - sqrt(coalesce(q.f, 0)))))')} AS distance FROM g LEFT JOIN fr p ON p.niche = a AND p.cell_type = g.cell_type LEFT JOIN fr q ON q.niche = b AND q.cell_type = g.cell_type GROUP BY a, b")
def hellinger_pairs(spark, d):
    return rounded(replicate.hellinger_pairs(niches.niche_fractions(_assigned(spark, d))))


def _members(spark, d):
    """Niches of two models with metaclusters by their number."""
    out = None
    for m in (0, 1):
        a = _assigned(spark, d, m).where("niche <> 0")
        size = a.agg(F.count(F.lit(1)).alias("total"))
        t = a.groupBy("niche").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("positive").cast("double")).alias("association"), F.avg("margin").alias("margin")).crossJoin(size)
        t = t.select(F.concat(F.lit("m"), F.lit(m).cast("string")).alias("model"), "niche", F.when(F.col("niche") == 3, 1).otherwise(F.col("niche")).alias("metacluster"), "n_cells", (F.col("n_cells") / F.col("total")).alias("share"), "association", "margin")
        out = t if out is None else out.unionByName(t)
    return out


_AT1 = _AT.replace("WHEN 0 THEN l0 ELSE l1", "WHEN 0 THEN m0 ELSE m1").replace("WHEN 0 THEN a0 ELSE a1", "WHEN 0 THEN b0 ELSE b1")
for _n in ("lg", "aw", "bl", "mg", "pf"):
    _AT1 = _AT1.replace(f"{_n} AS (", f"{_n}1 AS (").replace(f"FROM {_n} ", f"FROM {_n}1 ").replace(f"FROM {_n})", f"FROM {_n}1)")


def _two_models() -> str:
    tail = _AT1[_AT1.index("lg1 AS (") :]
    return f"""{_AT}, {tail},
am AS (SELECT 'm0' AS model, CAST(cell_type % 4 AS INTEGER) AS niche, target, margin FROM mg UNION ALL SELECT 'm1', CAST(cell_type % 4 AS INTEGER), target, margin FROM mg1),
mb AS (SELECT model, niche, CASE WHEN niche = 3 THEN 1 ELSE niche END AS metacluster, count(*) AS n_cells, count(*) / sum(count(*)) OVER (PARTITION BY model) AS share, avg(target) AS association, avg(margin) AS margin FROM am WHERE niche <> 0 GROUP BY model, niche)"""


@query(f"WITH {_two_models()}, mm AS (SELECT *, avg(margin) OVER (PARTITION BY metacluster) AS g FROM mb) SELECT metacluster, count(DISTINCT model) AS n_models, count(*) AS n_members, {r('avg(share)')} AS mean_share, {r('stddev_samp(share)')} AS sd_share, {r('avg(association)')} AS mean_association, {r('stddev_samp(association)')} AS sd_association, {r('avg(margin)')} AS mean_margin, {r('stddev_samp(margin)')} AS sd_margin, {r('avg(CASE WHEN sign(margin) = sign(g) THEN 1e0 ELSE 0e0 END)')} AS sign_share, count(DISTINCT model) >= 2 AS replicated FROM mm GROUP BY metacluster")
def metacluster_table(spark, d):
    comp = spark.createDataFrame([], "model string, niche int, cell_type int, fraction double")
    return rounded(replicate.metacluster_table(_members(spark, d), comp)[0])


@query(f"WITH {_NT}, f AS (SELECT CASE WHEN fr.niche = 3 THEN 1 ELSE fr.niche END AS metacluster, cell_type, n_cells, f FROM fr JOIN nt ON nt.niche = fr.niche WHERE fr.niche <> 0), w AS (SELECT CASE WHEN niche = 3 THEN 1 ELSE niche END AS metacluster, sum(n_cells) AS w FROM nt WHERE niche <> 0 GROUP BY 1) SELECT f.metacluster, cell_type, {r('sum(n_cells * f) / any_value(w)')} AS fraction FROM f JOIN w ON w.metacluster = f.metacluster GROUP BY f.metacluster, cell_type")
def metacluster_composition(spark, d):
    comp = niches.niche_fractions(_assigned(spark, d)).select(F.lit("m0").alias("model"), "niche", "cell_type", "fraction")
    return rounded(replicate.metacluster_table(_members(spark, d).where("model = 'm0'"), comp)[1])


def _meta(spark, d):
    mapping = _members(spark, d).select("model", "niche", "metacluster").where("niche <> 2")
    both = [_assigned(spark, d, m).withColumn("model", F.lit(f"m{m}")) for m in (0, 1)]
    return replicate.meta_of(both[0].unionByName(both[1]), mapping)


_MV = f"{_AS}, mv AS (SELECT m.model, unit_id, patient_id, cell_id, CASE WHEN niche IN (1, 3) THEN 1 ELSE 0 END AS metacluster, positive, unit_id % 2 = m.k AS held_out FROM ass, (SELECT 'm0' AS model, 0 AS k UNION ALL SELECT 'm1', 1) m)"


@query(f"WITH {_MV} SELECT unit_id, 1 AS metacluster, {r('avg(metacluster)')} AS share FROM mv WHERE held_out GROUP BY unit_id")
def held_out_shares(spark, d):
    m = _meta(spark, d).where("(model = 'm0') = (unit_id % 2 = 0)")
    return rounded(replicate.held_out_shares(m))


@query(f"WITH {_MV}, u AS (SELECT unit_id, patient_id, avg(metacluster) AS v FROM mv GROUP BY ALL) SELECT patient_id, 1 AS metacluster, {r('avg(v)')} AS vote FROM u GROUP BY patient_id")
def votes_consensus(spark, d):
    return rounded(replicate.consensus_votes(_meta(spark, d)))


@query(f"WITH {_MV} SELECT model, CASE WHEN held_out THEN 'held_out' ELSE 'other' END AS split, 1 AS metacluster, {r('avg(metacluster)')} AS share, {r('avg(CASE WHEN positive THEN 1e0 ELSE 0e0 END) FILTER (metacluster = 1) - avg(CASE WHEN positive THEN 1e0 ELSE 0e0 END)')} AS association FROM mv GROUP BY model, held_out")
def transfer_table(spark, d):
    m = _meta(spark, d).withColumn("held_out", (F.col("model") == "m0") == (F.col("unit_id") % 2 == 0))
    return rounded(replicate.transfer_table(m).drop("margin"))


@query(f"WITH e AS (SELECT label AS a, CAST(vec_id % 7 AS INTEGER) AS b FROM embeddings), ij AS (SELECT sum(n * (n - 1) / 2e0) AS ij, CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM e GROUP BY a, b)), ra AS (SELECT sum(n * (n - 1) / 2e0) AS v FROM (SELECT count(*) AS n FROM e GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2e0) AS v FROM (SELECT count(*) AS n FROM e GROUP BY b)) SELECT {r('(ij - ra.v * rb.v / (n * (n - 1) / 2e0)) / ((ra.v + rb.v) / 2 - ra.v * rb.v / (n * (n - 1) / 2e0))')} AS ari, n FROM ij, ra, rb")
def adjusted_rand(spark, d):
    e = fixture.table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).cast("int").alias("b"))
    return rounded(replicate.adjusted_rand(e))


@query(f"WITH {_AS}, vals AS (SELECT grp, patient_id, value FROM (SELECT CAST(cell_id % 4 AS INTEGER) AS grp, unit_id, patient_id, avg(margin) AS value FROM ass GROUP BY ALL))" + _BOOT.format(key="grp, ", part="PARTITION BY grp ", part2="PARTITION BY grp", n=100, dkey="dr.grp, ", on=" AND ck.grp = dr.grp") + f", b AS (SELECT grp, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM rt GROUP BY grp), m AS (SELECT grp, sum(s) / sum(c) AS mean, count(*) AS n_clusters FROM cl GROUP BY grp) SELECT 'm0' AS model, m.grp, {r('mean')} AS mean, {r('low')} AS low, {r('high')} AS high, n_clusters FROM m JOIN b ON b.grp = m.grp")
def basis_margins(spark, d):
    g = _assigned(spark, d).withColumn("grp", (F.col("cell_id") % 4).cast("int")).withColumn("model", F.lit("m0"))
    return rounded(replicate.basis_margins(g, 100))


@query()
def matched_niches(spark, d):
    rows, comp = [], None
    for m in (0, 1):
        f = niches.niche_fractions(_assigned(spark, d, m).where("niche <> 0")).select(F.concat(F.lit(f"m{m}|"), F.col("niche").cast("string")).alias("niche"), "cell_type", "fraction")
        comp = f if comp is None else comp.unionByName(f)
    dist = {(x.a, x.b): x.distance for x in replicate.hellinger_pairs(comp).collect()}
    names = sorted({k for p in dist for k in p})
    groups, threshold, _ = replicate.match_niches(names, [n.split("|")[0] for n in names], dist, [0.15 + 0.01 * i for i in range(46)])
    rows = [(n, g, float(threshold)) for n, g in zip(names, groups, strict=True)]
    return spark.createDataFrame(rows, "niche string, metacluster int, threshold double")


# ---- cross-validation ----------------------------------------------------------------------------------------------

_EP = "(VALUES ('a', 0, 0.5e0, 2e0), ('a', 1, 0.9e0, 1e0), ('a', 2, 0.9e0, 0.5e0), ('b', 0, NULL, 3e0), ('b', 1, NULL, 1e0), ('b', 2, NULL, 1e0), ('c', 0, NULL, NULL), ('c', 4, NULL, NULL)) t(run, epoch, m, l)"


def _epochs(spark):
    rows = [("a", 0, 0.5, 2.0), ("a", 1, 0.9, 1.0), ("a", 2, 0.9, 0.5), ("b", 0, None, 3.0), ("b", 1, None, 1.0), ("b", 2, None, 1.0), ("c", 0, None, None), ("c", 4, None, None)]
    return spark.createDataFrame(rows, "run string, epoch int, `val/auroc` double, `val/loss` double")


@query(f"SELECT run, CAST(coalesce(first(epoch ORDER BY m DESC, epoch) FILTER (m IS NOT NULL), first(epoch ORDER BY l, epoch) FILTER (l IS NOT NULL), max(epoch)) + 1 AS INTEGER) AS best_epoch FROM {_EP} GROUP BY run")
def best_epoch(spark, d):
    return metrics.best_epoch(_epochs(spark), "val/auroc")


@query("SELECT 'all' AS scope, CAST(2 AS INTEGER) AS epochs")
def reduce_epochs(spark, d):
    return metrics.reduce_epochs(metrics.best_epoch(_epochs(spark), "val/auroc").withColumn("scope", F.lit("all")), "median", 1, "scope")


@query(f"SELECT 'auroc' AS metric, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, count(*) AS n_folds FROM (VALUES (0.5e0), (0.75e0), (0.9e0)) t(v)")
def cv_summary(spark, d):
    f = spark.createDataFrame([("auroc", 0.5), ("auroc", 0.75), ("auroc", float("nan")), ("auroc", 0.9)], "metric string, value double")
    return rounded(metrics.cv_summary(f))


@query()
def score_cells(spark, d):
    from mosaica.operators import encoder

    c = units.encode(_cells(spark, d), units.vocabulary(fixture.raw_cells(spark, d)))
    e = graph.edge_features(_edges(c), c)
    out = encoder.score_cells(c, e, encoder.random_weights(1, 5, 2), ("feature",), SamplerConfig(depth=2))
    return out.select("unit_id", "cell_id", tidy(F.col("instance_logits")[0], 4).alias("l0"), tidy(F.col("attention_logits")[1], 4).alias("a1"))


def spatial_tests(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: enrichment, Moran's I and cross-L per unit, patient means, group tests with q values."""
    c = _cells(spark, d)
    e = _edges(c)
    enr = stats.enrichment_analytic(c, e).where("ta <= tb").select("unit_id", F.concat(F.lit("enrichment "), "ta", F.lit("|"), "tb").alias("metric"), F.col("log2_ratio").alias("value"))
    mor = stats.morans_i(c, e).select("unit_id", F.concat(F.lit("moran "), "t").alias("metric"), F.col("i").alias("value"))
    cl = stats.cross_l(c, RADII).where("ta <= tb").select("unit_id", F.concat(F.lit("cross_l "), "ta", F.lit("|"), "tb", F.lit("|"), F.col("radius").cast("string")).alias("metric"), "value")
    v = enr.unionByName(mor).unionByName(cl).withColumn("patient_id", F.split("unit_id", "_")[0])
    labels = c.select(F.col("sample_id").alias("patient_id"), (F.col("label") == 1).alias("positive")).distinct()
    return testing.group_tests(testing.patient_means(v, "metric"), testing.patient_labels(labels), min_per_group=3)


@query()
def flagship(spark, d):
    return spatial_tests(spark, d)

