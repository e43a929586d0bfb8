"""Helpers shared by the operators: shared folders, checkpoints and linking."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rounds after which star contractions are taken to have gone wrong; their number grows with the logarithm of the longest path.
MAX_STAR_ROUNDS = 60
#: Narrow rows in a checkpoint's file, where their number is known.
ROWS_PER_FILE = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from spark.checkpoint.dir. Only where that is unset and everything
    runs in one process (tests) a temporary folder is made and set for the rest
    of the session; on a cluster it is an error to leave it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if not found:
        if current is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = current or tempfile.mkdtemp(prefix="mosaica-")
    if current is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until `df` has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint; `rows`, where known, keeps small results in few files."""
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    return df.checkpoint(eager=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_training_fold(doc_id: Column) -> Column:
    """True where crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected `edges`: (node, component), component being the smallest node.

    Star contractions on edges (u, v), u > v, until every u has one edge and no
    v has any. In a round each v gives way to the least smaller neighbour it
    has (large-star), then u and its smaller neighbours link to the least of
    them (small-star). A node may have any number of larger neighbours: they
    are joined with one row for each v and dealt anew by u, so that adaptive
    execution can split the join at such a node. Smaller neighbours are few
    (never more than a node was given), so a window over u is safe. Self-edges
    and null ends are ignored; nodes without edges don't occur.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = e.count()
    if n > 0:
        e = e.coalesce(max(1, -(-n // ROWS_PER_FILE)))
    by_u = Window.partitionBy("u")
    for _ in range(MAX_STAR_ROUNDS):
        least = settle(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), n)
        single = (least.agg(F.max("k")).first()[0] or 1) == 1
        up = least.select(F.col("u").alias("v"), "m")
        if single and e.join(up, "v", "left_semi").isEmpty():
            break
        large = e.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).repartition("u").distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = settle(small.where("u <> v").distinct(), n)
        n = e.count()
    else:
        raise RuntimeError("star contraction did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
