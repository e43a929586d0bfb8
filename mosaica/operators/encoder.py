"""Forward pass of a message-passing encoder with given weights, over the ego graph of each root."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.config import SamplerConfig


def _act(x: np.ndarray, name: str) -> np.ndarray:
    return {"relu": lambda: np.maximum(x, 0), "leaky_relu": lambda: np.where(x > 0, x, 0.01 * x), "tanh": lambda: np.tanh(x), "none": lambda: x}[name]()


def _norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * gain + bias


def encode_graph(x: np.ndarray, kinds: np.ndarray | None, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, w: dict) -> np.ndarray:
    """Node states after all layers.

    h0 is the type's embedding plus W x. A layer adds to (1 + eps) h the sum
    over neighbours of relu(h_u + W_e e_uv), applies a perceptron of two
    layers, a norm, and an activation except after the last layer. States are
    joined by `jk`: last, sum, max or concat; a linear map follows if given.
    Edges come in both directions.
    """
    h = x @ w["in"] if x.shape[1] else np.zeros((len(x), w["in"].shape[1]))
    if kinds is not None and "types" in w:
        h = h + w["types"][kinds]
    states = [h]
    for k, layer in enumerate(w["layers"]):
        m = np.maximum(h[src] + edge @ layer["edge"], 0)
        got = np.zeros_like(h)
        np.add.at(got, dst, m)
        z = (1 + layer.get("eps", 0.0)) * h + got
        z = np.maximum(z @ layer["w1"] + layer["b1"], 0) @ layer["w2"] + layer["b2"]
        if "gain" in layer:
            z = _norm(z, layer["gain"], layer["shift"])
        h = z if k == len(w["layers"]) - 1 else _act(z, w.get("activation", "relu"))
        states.append(h)
    jk = w.get("jk", "last")
    out = {"last": lambda: states[-1], "sum": lambda: sum(states), "max": lambda: np.maximum.reduce(states), "concat": lambda: np.concatenate(states, 1)}[jk]()
    return out @ w["out"] if "out" in w else out


def gated_attention(h: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """(attention logits, attention space): a projection, then tanh and sigmoid gates multiplied and mapped to classes; the space is what goes into tanh."""
    p = _act(h @ w["proj"] + w["proj_b"], "leaky_relu")
    space = p @ w["v"] + w["v_b"]
    gate = 1 / (1 + np.exp(-(p @ w["u"] + w["u_b"])))
    return (np.tanh(space) * gate) @ w["c"] + w["c_b"], space


def instance_logits(z: np.ndarray, w: dict) -> np.ndarray:
    """A linear head (`head`, `head_b`), after hidden layers with leaky units if there are any (`hidden`: pairs of weights and bias)."""
    for weight, bias in w.get("hidden", ()):
        z = _act(z @ weight + bias, "leaky_relu")
    return z @ w["head"] + w["head_b"]


class Graph:
    """A unit's graph as sorted lists of neighbours: `edge[first[v] : first[v + 1]]` are the rows of v's edges, `to` their other ends."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray) -> None:
        self.edge = np.lexsort((dst, src))
        self.to = dst[self.edge]
        self.first = np.searchsorted(src[self.edge], np.arange(n + 1))
        self.n = n

    def steps(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a list of nodes: which of them each edge leaves from, and the edge's place."""
        size = self.first[node + 1] - self.first[node]
        origin = np.repeat(np.arange(len(node)), size)
        return origin, self.first[node][origin] + np.arange(len(origin)) - np.repeat(np.cumsum(size) - size, size)


def ego_graphs(g: Graph, roots: np.ndarray, depth: int, few: int = -1, seed: int = 0, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(root number, node) of the nodes within `depth` edges of each root, sorted.

    With `few`, each node passes on at most that many of its neighbours in a
    hop, drawn by seed, root, node and neighbour. `keep` (root, node), if
    given, bounds where a walk may go.
    """
    key = np.arange(len(roots)) * g.n + roots
    front, seen = key, key
    for hop in range(depth):
        origin, at = g.steps(front % g.n)
        root = front[origin] // g.n
        new = root * g.n + g.to[at]
        if few >= 0 and len(new):
            with np.errstate(over="ignore"):
                draw = (new.astype(np.uint64) + np.uint64(seed * 7919 + hop)) * np.uint64(0x9E3779B97F4A7C15) + front[origin].astype(np.uint64)
                draw = (draw ^ (draw >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            order = np.lexsort((draw ^ (draw >> np.uint64(29)), origin))
            rank = np.arange(len(order)) - np.searchsorted(origin[order], origin[order])
            new = new[order[rank < few]]
        new = np.setdiff1d(new, seen)
        if keep is not None:
            new = np.intersect1d(new, keep, assume_unique=True)
        if not len(new):
            break
        front, seen = new, np.union1d(seen, new)
    return seen // g.n, seen % g.n


def ego_edges_of(g: Graph, root: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges with both ends in an ego graph: places of the ends among (root, node) and the rows of the edges."""
    key = root * g.n + node
    origin, at = g.steps(node)
    other = root[origin] * g.n + g.to[at]
    place = np.minimum(np.searchsorted(key, other), len(key) - 1)
    own = key[place] == other
    return origin[own], place[own], g.edge[at[own]]


#: Nodes of the ego graphs that are encoded at once, about.
NODES = 20_000


def score_cells(cells: DataFrame, edges: DataFrame, weights: dict, features: tuple[str, ...], sampler: SamplerConfig = SamplerConfig(), readout: str = "mean", roots: DataFrame | None = None, seed: int = 0) -> DataFrame:  # noqa: B008
    """(unit_id, cell_id, embedding, attention_space, instance_logits, attention_logits) of every root of every unit.

    A root's ego graph holds the nodes within `sampler.depth` edges and the
    edges between them (of `num_neighbors` drawn neighbours a node and hop, if
    that is not below 0; within the radius, if that is enabled, and then, if so
    configured, only what hangs together with the root). It is encoded on its
    own, and its nodes are read out. `roots` (unit_id, cell_id) are all cells
    where not given. `edges`: (unit_id, src, dst, log_distance, neighbor).
    Weights are broadcast; a unit with its edges fits in a task.
    """
    spark = cells.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    kind = cells.schema["cell_id"].dataType.simpleString()
    coded = "code" in cells.columns
    base = cells if roots is None else cells.join(roots.select("unit_id", "cell_id", F.lit(True).alias("__root")), ["unit_id", "cell_id"], "left")
    node = F.struct("cell_id", (F.col("code") if coded else F.lit(0)).alias("code"), F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>").alias("f"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.lit(True) if roots is None else F.coalesce("__root", F.lit(False))).alias("root"))
    c = base.groupBy("unit_id").agg(F.sort_array(F.collect_list(node)).alias("c"))
    e = edges.groupBy("unit_id").agg(F.collect_list(F.struct("src", "dst", F.array("log_distance", "neighbor").alias("a"))).alias("e"))
    reach = sampler.ego_radius.radius(sampler.depth) if sampler.ego_radius.enabled else None

    def score(batches):
        w = shared.value
        for pdf in batches:
            for unit, nodes, links in zip(pdf["unit_id"], pdf["c"], pdf["e"], strict=True):
                ids = [r["cell_id"] for r in nodes]
                at = {k: i for i, k in enumerate(ids)}
                links = links if links is not None else []
                s, d = np.array([[at[r["src"]], at[r["dst"]]] for r in links], np.int64).reshape(-1, 2).T
                a = np.array([list(r["a"]) for r in links], float).reshape(-1, 2)
                g, attr = Graph(len(ids), np.concatenate([s, d]), np.concatenate([d, s])), np.concatenate([a, a])
                x = np.array([list(r["f"]) for r in nodes], float).reshape(len(ids), -1)
                codes = np.array([r["code"] or 0 for r in nodes]) if coded else None
                px, py = (np.array([r[k] for r in nodes], float) for k in ("x", "y"))
                wanted = np.flatnonzero([bool(r["root"]) for r in nodes])
                step = max(1, min(sampler.batch_size, NODES // max(1, len(ids) // 8)))
                for k in range(0, len(wanted), step):
                    some = wanted[k : k + step]
                    root, own = ego_graphs(g, some, sampler.depth, sampler.num_neighbors, seed)
                    if reach is not None:
                        near = np.hypot(px[own] - px[some[root]], py[own] - py[some[root]]) <= reach
                        root, own = root[near], own[near]
                        if sampler.ego_radius.keep_root_component:
                            root, own = ego_graphs(g, some, len(ids), keep=root * g.n + own)
                    src, dst, row = ego_edges_of(g, root, own)
                    h = encode_graph(x[own], codes[own] if coded else None, src, dst, attr[row], w["encoder"])
                    starts = np.searchsorted(root, np.arange(len(some)))
                    z = (np.maximum if readout == "max" else np.add).reduceat(h, starts, axis=0)
                    if readout == "mean":
                        z = z / np.diff(np.append(starts, len(root)))[:, None]
                    logits = instance_logits(z, w)
                    att, space = gated_attention(z, w["attention"])
                    yield pd.DataFrame({"unit_id": unit, "cell_id": [ids[i] for i in some], "embedding": list(z.astype(np.float32)), "attention_space": list(space.astype(np.float32)), "instance_logits": list(logits), "attention_logits": list(att)})

    schema = f"unit_id string, cell_id {kind}, embedding array<float>, attention_space array<float>, instance_logits array<double>, attention_logits array<double>"
    return c.join(e, "unit_id", "left").select("unit_id", "c", "e").mapInPandas(score, schema)


def random_weights(features: int, types: int, classes: int, hidden: int = 16, layers: int = 2, seed: int = 0) -> dict:
    """Weights of the right shapes for tests and benchmarks."""
    r = np.random.default_rng(seed)
    g = lambda *s: r.normal(0, 0.3, s)
    layer = lambda: {"edge": g(2, hidden), "w1": g(hidden, 2 * hidden), "b1": g(2 * hidden), "w2": g(2 * hidden, hidden), "b2": g(hidden), "gain": np.ones(hidden), "shift": np.zeros(hidden)}
    attention = {"proj": g(hidden, 8), "proj_b": g(8), "v": g(8, 4), "v_b": g(4), "u": g(8, 4), "u_b": g(4), "c": g(4, classes), "c_b": g(classes)}
    return {"encoder": {"in": g(features, hidden), "types": g(max(1, types), hidden), "layers": [layer() for _ in range(layers)]}, "head": g(hidden, classes), "head_b": g(classes), "attention": attention}


def fold_scaler(coef: np.ndarray, intercept: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias on raw features of a linear model fitted on standardised ones."""
    w = coef / scale
    return w, intercept - (coef * mean / scale).sum(-1)


def fit_linear_head(cells: DataFrame, kind: str, space: str = "space", target: str = "target", reg: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a linear head on cell embeddings: L2 logistic regression for classes (two classes: row 0 is zero), ridge for regression.

    Embeddings are standardised for the fit and the scaler is folded in.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = cells.where(F.col(target).isNotNull()).select(array_to_vector(F.transform(space, lambda x: x.cast("double"))).alias("raw"), F.col(target).cast("double").alias("label"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(data)
    x = scaler.transform(data)
    sample_scale = scaler.std.toArray()
    if kind == "regression":
        m = LinearRegression(regParam=reg, elasticNetParam=0.0).fit(x)
        return fold_scaler(m.coefficients.toArray()[None], np.array([m.intercept]), scaler.mean.toArray(), np.where(sample_scale > 0, sample_scale, 1))
    m = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False).fit(x)
    w, b = fold_scaler(m.coefficientMatrix.toArray(), m.interceptVector.toArray(), scaler.mean.toArray(), np.where(sample_scale > 0, sample_scale, 1))
    return (np.vstack([np.zeros_like(w), w]), np.array([0.0, *b])) if len(w) == 1 else (w, b)


def fit_cox_head(cells: DataFrame, space: str = "space", time: str = "time", event: str = "event", reg: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(weights [1, d], bias [1]) of a Cox head on cell embeddings: the partial likelihood with `|w|^2 / (2 reg)`, ties by Breslow's method.

    Embeddings are standardised for the fit and the scaler is folded in; the
    bias only centres them. Each of the Newton rounds sums weights, weighted
    vectors and their products by distinct time in Spark; the driver sees a row
    of d^2 numbers for each distinct time. Steps are halved while they lose
    likelihood. No event is an error.
    """
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = cells.where(F.col(time).isNotNull() & F.col(event).isNotNull()).select(array_to_vector(F.transform(space, lambda x: x.cast("double"))).alias("raw"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"))
    scaler = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(data)
    rows = scaler.transform(data).select(vector_to_array("z").alias("z"), "t", "e").persist()
    if not rows.where("e > 0").limit(1).count():
        rows.unpersist()
        raise ValueError("no event to fit to")
    d = len(scaler.mean)

    def sums(w: np.ndarray):
        def run(batches):
            for pdf in batches:
                z = np.array(pdf["z"].tolist(), float).reshape(-1, d)
                r = z @ w
                for t, at in pdf.groupby("t").indices.items():
                    k, weight = z[at], np.exp(r[at])
                    hit = pdf["e"].to_numpy()[at] > 0
                    moments = np.concatenate([[weight.sum(), hit.sum(), r[at][hit].sum()], weight @ k, k[hit].sum(0), ((weight[:, None] * k).T @ k).reshape(-1)])
                    yield pd.DataFrame({"t": [t], "m": [moments.tolist()]})

        parts = rows.mapInPandas(run, "t double, m array<double>").select("t", F.posexplode("m").alias("i", "x")).groupBy("t", "i").agg(F.sum("x").alias("x"))
        table = parts.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m")).orderBy(F.desc("t")).toPandas()
        m = np.array(table["m"].tolist(), float)
        s0, s1, s2 = m[:, 0].cumsum(), m[:, 3 : 3 + d].cumsum(0), m[:, 3 + 2 * d :].cumsum(0).reshape(-1, d, d)
        n = m[:, 1]
        mean = s1 / s0[:, None]
        loss = float((n * np.log(s0)).sum() - m[:, 2].sum() + w @ w / (2 * reg))
        grad = (n[:, None] * mean).sum(0) - m[:, 3 + d : 3 + 2 * d].sum(0) + w / reg
        curve = (n[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0) + np.eye(d) / reg
        return loss, grad, curve

    w = np.zeros(d)
    loss, grad, curve = sums(w)
    for _ in range(rounds):
        step = np.linalg.solve(curve, grad)
        if np.abs(step).max() < 1e-8:
            break
        for half in range(30):
            new = w - step / 2**half
            got = sums(new)
            if got[0] <= loss + 1e-12:
                break
        w, (loss, grad, curve) = new, got
    rows.unpersist()
    scale = scaler.std.toArray()
    return fold_scaler(w[None], np.zeros(1), scaler.mean.toArray(), np.where(scale > 0, scale, 1))
