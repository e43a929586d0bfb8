"""Clusters and projections of cell vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.config import ReducerConfig
from mosaica.functions.scalars import l2_normalised


def hash_sample(df: DataFrame, n: int, seed: int, key: str = "cell_id") -> DataFrame:
    """The n rows with the least hashes of seed and key, an exact sample that any engine would draw."""
    h = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def covariance(df: DataFrame, space: str = "space") -> DataFrame:
    """(i, j, cov) with i <= j: sample covariance of vector components.

    Components meet within a row only, so the shuffle carries partial sums of
    a matrix, whatever the number of rows.
    """
    a = F.transform(space, lambda x: x.cast("double"))
    pairs = df.select(a.alias("v")).select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y")).where("i <= j")
    return pairs.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def pca_fit(df: DataFrame, k: int, space: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """(mean, components [k, d]): leading eigenvectors of the covariance, the largest entry of each positive."""
    row = df.select(F.posexplode(space).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    mean = np.array([r.m for r in row])
    c = np.zeros((len(mean), len(mean)))
    for r in covariance(df, space).collect():
        c[r.i, r.j] = c[r.j, r.i] = r.cov
    w, v = np.linalg.eigh(c)
    top = v[:, np.argsort(-w, kind="stable")[:k]].T
    return mean, top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def pca_transform(df: DataFrame, model: tuple[np.ndarray, np.ndarray], space: str = "space", out: str = "space") -> DataFrame:
    """Centred projections as arrays of doubles; components are literals of a bounded model."""
    mean, comp = model
    centred = F.zip_with(F.transform(space, lambda x: x.cast("double")), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    base = df.withColumn("__c", centred)
    rows = [F.aggregate(F.zip_with("__c", F.array(*[F.lit(float(x)) for x in r]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for r in comp]
    return base.withColumn(out, F.array(*rows)).drop("__c")


def reduced(df: DataFrame, cfg: ReducerConfig, train: DataFrame | None = None, state: tuple[np.ndarray, np.ndarray] | None = None, space: str = "space") -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    """(`df` with its vectors as the configuration has them, what they were projected with).

    A given state, as of an earlier cohort (`state_from`), is used as it is;
    else the projection is fitted on all rows, or on `train` if so configured.
    """
    if cfg.name == "identity":
        return df, None
    if state is None:
        if cfg.state_from is not None:
            raise ValueError(f"the state of {cfg.state_from} must be read and given")
        if cfg.fit_on == "train" and train is None:
            raise ValueError("a fit on training rows needs them")
        state = pca_fit(train if cfg.fit_on == "train" else df, cfg.n_components, space)
    if len(state[1]) != cfg.n_components:
        raise ValueError(f"the state has {len(state[1])} components, not {cfg.n_components}")
    return pca_transform(df, state, space, space), state


def kmeans_fit(df: DataFrame, k: int, seed: int = 0, space: str = "space", cosine: bool = True) -> np.ndarray:
    """Centres [k, d] by Spark's k-means (k-means|| start), of unit vectors with `cosine`; in a fixed order."""
    v = l2_normalised(space) if cosine else F.transform(space, lambda x: x.cast("double"))
    model = KMeans(k=k, seed=seed, featuresCol="f", maxIter=50).fit(df.select(array_to_vector(v).alias("f")))
    return np.array(sorted(c.tolist() for c in model.clusterCenters()))


def kmeans_assign(df: DataFrame, centres: np.ndarray, space: str = "space", cosine: bool = True) -> DataFrame:
    """Column cluster: the nearest centre by squared distance (rounded to nine digits), the first of equals."""
    v = l2_normalised(space) if cosine else F.transform(space, lambda x: x.cast("double"))
    base = df.withColumn("__v", v)
    gaps = [F.round(F.aggregate(F.zip_with("__v", F.array(*[F.lit(float(x)) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 9) for c in centres]
    d = F.array(*gaps)
    return base.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int")).drop("__v")


def density_clusters(x: np.ndarray, min_cluster_size: int, min_samples: int = 1, leaf: bool = False) -> np.ndarray:
    """HDBSCAN of a bounded sample: cluster numbers, -1 for noise.

    The minimum spanning tree of mutual reachability (Prim, one row of
    distances at a time), its hierarchy condensed by the least cluster size,
    and clusters chosen by excess of mass, or as the leaves. The whole sample
    is never one cluster.
    """
    n = len(x)
    size = min(min_cluster_size, n)
    if n < 2:
        return np.full(n, -1)
    core = np.zeros(n)
    if min_samples > 1:
        for i in range(n):
            core[i] = np.partition(((x - x[i]) ** 2).sum(1), min(min_samples, n) - 1)[min(min_samples, n) - 1] ** 0.5
    near, to, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    cur, tree = 0, []
    sq = (x**2).sum(1)
    slack = 1e-10 * float(sq.max())
    for _ in range(n - 1):
        left[cur] = False
        # one product tells which points may come nearer; only those have their distance computed
        some = np.flatnonzero(left & (sq + sq[cur] - 2 * (x @ x[cur]) < near**2 + slack))
        d = np.maximum(np.maximum(((x[some] - x[cur]) ** 2).sum(1) ** 0.5, core[some]), core[cur])
        closer = d < near[some]
        near[some[closer]], to[some[closer]] = d[closer], cur
        cur = int(np.where(left, near, np.inf).argmin())
        tree.append((float(near[cur]), int(to[cur]), cur))
    tree.sort(key=lambda e: e[0])
    # dendrogram: node n + k joins two nodes at a distance
    root, kids, dist, count = list(range(n)), {}, {}, [1] * n
    top = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (d, a, b) in enumerate(tree):
        p, q = find(a), find(b)
        kids[n + k], dist[n + k] = (top[p], top[q]), d
        count.append(count[top[p]] + count[top[q]])
        root[q] = p
        top[p] = n + k

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            m = todo.pop()
            if m < n:
                out.append(m)
            else:
                todo += kids[m]
        return out

    lam = lambda d: 1 / d if d > 0 else np.inf
    clusters = [{"birth": 0.0, "parent": -1, "kids": [], "mass": 0.0, "members": []}]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            clusters[c]["members"].append(node)
            continue
        a, b = kids[node]
        at = lam(dist[node])
        big = [m for m in (a, b) if count[m] >= size]
        gain = lambda k: k * (min(at, 1e12) - min(clusters[c]["birth"], 1e12))
        if len(big) == 2:
            clusters[c]["mass"] += gain(count[node])
            for m in (a, b):
                clusters.append({"birth": at, "parent": c, "kids": [], "mass": 0.0, "members": []})
                clusters[c]["kids"].append(len(clusters) - 1)
                todo.append((m, len(clusters) - 1))
        else:
            for m in (a, b):
                if count[m] < size:
                    out = points(m)
                    clusters[c]["mass"] += gain(len(out))
                    clusters[c]["members"] += out
                else:
                    todo.append((m, c))
    chosen = [False] * len(clusters)
    best = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(best[k] for k in clusters[c]["kids"])
        if not clusters[c]["kids"]:
            chosen[c], best[c] = True, clusters[c]["mass"]
        elif not leaf and clusters[c]["mass"] > below:
            chosen[c], best[c] = True, clusters[c]["mass"]
        else:
            best[c] = below
    out = np.full(n, -1)
    number, todo = 0, [(k, -1) for k in reversed(clusters[0]["kids"])]
    while todo:
        c, own = todo.pop()
        if own < 0 and chosen[c]:
            own, number = number, number + 1
        if own >= 0:
            out[clusters[c]["members"]] = own
        todo += [(k, own) for k in reversed(clusters[c]["kids"])]
    return out


def fit_density(df: DataFrame, sample_size: int, min_cluster_size: int, min_samples: int = 1, seed: int = 0, leaf: bool = False, space: str = "space", cosine: bool = True) -> DataFrame:
    """(cell_id, space, cluster) of a hash sample clustered on the driver, as unit vectors with `cosine`; its size is the bound that makes it fit there, and its work grows with the square of it."""
    sample = hash_sample(df.select("cell_id", space), sample_size, seed).orderBy("cell_id").toPandas()
    x = np.array(sample[space].tolist(), float).reshape(len(sample), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True) if cosine else np.ones((len(x), 1))
    sample["cluster"] = density_clusters(x / np.where(norm > 0, norm, 1), min_cluster_size, min_samples, leaf)
    kind = dict(df.dtypes)
    return df.sparkSession.createDataFrame(sample.assign(cluster=sample["cluster"].astype("int32")), f"cell_id {kind['cell_id']}, {space} {kind[space]}, cluster int")
