"""The cohort that queries run on: cells, scores and outcomes over general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaica.functions.scalars import hash_uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one week of a month as the cells of a unit."""
    week = F.floor((F.day("ts") - 1) / 7).cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("_w"), week.cast("string")).alias("unit_id"),
        F.col("user_id").cast("string").alias("sample_id"),
        F.col("user_id").alias("user_id"),
        F.col("event_id").alias("cell_id"),
        F.col("event_type").alias("cell_type"),
        F.col("value").cast("double").alias("x"),
        (((F.day("ts") - 1) % 7) * 24 + F.hour("ts") + F.minute("ts") / F.lit(60.0)).alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("feature"),
        (F.col("user_id") % 2).cast("int").alias("label"),
    )


def cells(spark: SparkSession, sf_dir: str, min_cells: int = 10) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("unit_id"))
    return raw_cells(spark, sf_dir).withColumn("n", n).where(F.col("n") >= min_cells).drop("n")


CELLS_SQL = """
ev AS (SELECT *, CAST(floor((day(ts) - 1) / 7e0) AS INTEGER) AS wk FROM events),
raw AS (
  SELECT CAST(user_id AS VARCHAR) || '_w' || CAST(wk AS VARCHAR) AS unit_id, CAST(user_id AS VARCHAR) AS sample_id, user_id,
         event_id AS cell_id, event_type AS cell_type, CAST(value AS DOUBLE) AS x,
         ((day(ts) - 1) % 7) * 24 + hour(ts) + minute(ts) / 60e0 AS y,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS feature, CAST(user_id % 2 AS INTEGER) AS label
  FROM ev),
cells AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM raw) WHERE n >= 10)"""

EDGES_SQL = (
    CELLS_SQL
    + """,
tri AS (
  SELECT a.unit_id, a.cell_id AS ia, b.cell_id AS ib, c.cell_id AS ic, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb, c.x AS cx, c.y AS cy,
         (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn
  FROM cells a JOIN cells b ON a.unit_id = b.unit_id AND a.cell_id < b.cell_id
  JOIN cells c ON c.unit_id = a.unit_id AND b.cell_id < c.cell_id),
open_tri AS (
  SELECT * FROM tri WHERE turn <> 0 AND NOT EXISTS (
    SELECT 1 FROM (SELECT d.*, sign(tri.turn) * (((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((bx - d.x) * (cy - d.y) - (cx - d.x) * (yb - d.y))
        - ((bx - d.x) * (bx - d.x) + (yb - d.y) * (yb - d.y)) * ((ax - d.x) * (cy - d.y) - (cx - d.x) * (ay - d.y))
        + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (yb - d.y) - (bx - d.x) * (ay - d.y))) AS inside
      FROM cells d WHERE d.unit_id = tri.unit_id AND d.cell_id NOT IN (tri.ia, tri.ib, tri.ic)) d
    WHERE inside > 1e-9 OR inside >= -1e-9 AND (d.cell_id < tri.ia OR ((cx - bx) * (d.y - yb) - (cy - yb) * (d.x - bx)) * tri.turn < 0))),
edges AS (
  SELECT unit_id, ia AS src, ib AS dst FROM open_tri UNION SELECT unit_id, ib, ic FROM open_tri UNION SELECT unit_id, ia, ic FROM open_tri)"""
)

ENDS_SQL = """,
ends AS (
  SELECT e.unit_id, e.src, e.dst, a.cell_type AS ta, b.cell_type AS tb, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM edges e JOIN cells a ON a.unit_id = e.unit_id AND a.cell_id = e.src JOIN cells b ON b.unit_id = e.unit_id AND b.cell_id = e.dst),
both_ways AS (SELECT unit_id, src, dst, ta, tb, d FROM ends UNION ALL SELECT unit_id, dst, src, tb, ta, d FROM ends)"""


def scores(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    """Model outputs per cell over the vectors; model 1 takes other components."""
    e = [F.element_at("embedding", i + 1 + 4 * model).cast("double") for i in range(4)]
    unit = (F.col("vec_id") % 20).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        unit.alias("unit_id"),
        (unit % 10).alias("patient_id"),
        F.col("label").alias("cell_type"),
        F.col("embedding").alias("space"),
        F.array(e[0], e[1]).alias("instance_logits"),
        F.array(e[2], e[3]).alias("attention_logits"),
        (unit % 2).alias("target"),
    )


SCORES_SQL = """
sc AS (
  SELECT vec_id AS cell_id, CAST(vec_id % 20 AS INTEGER) AS unit_id, CAST(vec_id % 20 % 10 AS INTEGER) AS patient_id, label AS cell_type, embedding AS space,
         CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1, CAST(embedding[3] AS DOUBLE) AS a0, CAST(embedding[4] AS DOUBLE) AS a1,
         CAST(embedding[5] AS DOUBLE) AS m0, CAST(embedding[6] AS DOUBLE) AS m1, CAST(embedding[7] AS DOUBLE) AS b0, CAST(embedding[8] AS DOUBLE) AS b1,
         CAST(vec_id % 20 % 2 AS INTEGER) AS target FROM embeddings)"""

HEAD_BIAS = (0.05, -0.05)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient_id, time, event, covariate): days to a customer's last order, whether it is final, and the mean price."""
    o = table(spark, sf_dir, "orders")
    start = o.agg(F.min("o_orderdate").alias("start"))
    last = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    mean = F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
    ranked = o.withColumn("k", F.row_number().over(last)).withColumn("mean_price", mean).where("k = 1")
    return ranked.crossJoin(F.broadcast(start)).select(
        F.col("o_custkey").alias("patient_id"), F.datediff("o_orderdate", "start").cast("double").alias("time"), (F.col("o_orderstatus") == "F").alias("event"), F.col("mean_price").alias("share")
    )


OUTCOMES_SQL = """
oc AS (
  SELECT o_custkey AS patient_id, CAST(date_diff('day', CAST(start AS DATE), CAST(o_orderdate AS DATE)) AS DOUBLE) AS time, o_orderstatus = 'F' AS event, mean_price AS share
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k,
               avg(o_totalprice) OVER (PARTITION BY o_custkey) AS mean_price, min(o_orderdate) OVER () AS start FROM orders)
  WHERE k = 1)"""


def large_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of seven large units, the lines of orders by line number, spread evenly at one cell for 100 square units of area: 10^4 to 10^5 cells a unit at sf0.1."""
    lines = table(spark, sf_dir, "lineitem")
    sizes = lines.groupBy("l_linenumber").agg((F.sqrt(F.count(F.lit(1)).cast("double")) * 10).alias("side"))
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    at = lambda axis: F.round(hash_uniform(F.lit(axis), *key) * F.col("side"), 6)
    return lines.join(F.broadcast(sizes), "l_linenumber").select(
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("unit_id"),
        F.xxhash64(*key).alias("cell_id"),
        F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("cell_type"),
        at("x").alias("x"),
        at("y").alias("y"),
        F.col("l_quantity").cast("double").alias("feature"),
    )
