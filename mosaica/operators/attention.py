"""Attention trained on frozen cells: the regime in which encoder and head stay as they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.config import AttentionConfig
from mosaica.operators.encoder import gated_attention
from mosaica.operators.metrics import check_classes
from mosaica.plans.groups import map_groups

SLOPE = 0.01


def initial_attention(width: int, classes: int, cfg: AttentionConfig = AttentionConfig(), seed: int = 0) -> dict[str, np.ndarray]:  # noqa: B008
    """Weights of an attention over embeddings of `width`; deviations of the square root of 2 (or, by default init, 1/3) over a layer's inputs."""
    r = np.random.default_rng(seed)
    gain = 2.0 if cfg.init == "kaiming" else 1 / 3
    layer = lambda a, b: r.normal(0, np.sqrt(gain / a), (a, b))
    p, h = cfg.projection_dim, cfg.hidden_dim
    return {"proj": layer(width, p), "proj_b": np.zeros(p), "v": layer(p, h), "v_b": np.zeros(h), "u": layer(p, h), "u_b": np.zeros(h), "c": layer(h, classes), "c_b": np.zeros(classes)}


def bag_gradient(z: np.ndarray, logits: np.ndarray, target: int, weight: float, w: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted log loss of one unit and its gradient by every weight of the attention.

    A class's bag logit is the mean of its cells' logits by the softmax, over
    the unit's cells, of the attention for that class.
    """
    score, _ = gated_attention(z, w)
    share = np.exp(score - score.max(0))
    share /= share.sum(0)
    bag = (share * logits).sum(0)
    p = np.exp(bag - bag.max())
    p /= p.sum()
    d_bag = weight * (p - (np.arange(len(p)) == target))
    d_score = d_bag * share * (logits - bag)
    pre = z @ w["proj"] + w["proj_b"]
    q = np.where(pre > 0, pre, SLOPE * pre)
    t, g = np.tanh(q @ w["v"] + w["v_b"]), 1 / (1 + np.exp(-(q @ w["u"] + w["u_b"])))
    d_both = d_score @ w["c"].T
    d_t, d_g = d_both * g * (1 - t * t), d_both * t * g * (1 - g)
    d_pre = (d_t @ w["v"].T + d_g @ w["u"].T) * np.where(pre > 0, 1, SLOPE)
    grad = {"proj": z.T @ d_pre, "proj_b": d_pre.sum(0), "v": q.T @ d_t, "v_b": d_t.sum(0), "u": q.T @ d_g, "u_b": d_g.sum(0), "c": (t * g).T @ d_score, "c_b": d_score.sum(0)}
    return -weight * float(np.log(max(p[target], 1e-300))), grad


def train_attention(cells: DataFrame, classes: int, weights: dict[int, float] | None = None, cfg: AttentionConfig = AttentionConfig(), epochs: int = 25, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:  # noqa: B008
    """(attention weights, loss of each epoch) by Adam on the mean weighted log loss of all units.

    `cells`: (unit_id, target, embedding, instance_logits), the logits of a
    frozen head. Each epoch passes over the cells once, unit by unit in tasks;
    a task returns one sum of gradients. Units without a target are left out;
    a unit's cells fit in a task.
    """
    data = cells.where(F.col("target").isNotNull()).select("unit_id", F.col("target").cast("int").alias("target"), F.transform("embedding", lambda x: x.cast("double")).alias("z"), F.transform("instance_logits", lambda x: x.cast("double")).alias("l")).persist()
    first = data.select("z").first()
    if first is None:
        data.unpersist()
        raise ValueError("no unit has a target")
    check_classes({"train": data}, classes, "target")
    w = initial_attention(len(first.z), classes, cfg, seed)
    names, n_units = sorted(w), data.select("unit_id").distinct().count()
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    losses = []
    for step in range(1, epochs + 1):
        shared = data.sparkSession.sparkContext.broadcast(w)

        def slope(pdf: pd.DataFrame, shared=shared) -> pd.DataFrame:
            z, logits = (np.array(pdf[c].tolist(), float).reshape(len(pdf), -1) for c in ("z", "l"))
            target = int(pdf["target"].iloc[0])
            loss, grad = bag_gradient(z, logits, target, (weights or {}).get(target, 1.0), shared.value)
            return pd.DataFrame({"g": [np.concatenate([[loss], *(grad[k].reshape(-1) for k in names)]).tolist()]})

        parts = map_groups(data, "unit_id", slope, "g array<double>")
        sums = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy() / n_units
        losses.append(float(sums[0]))
        at = 1
        for k in names:
            grad = sums[at : at + w[k].size].reshape(w[k].shape) + decay * w[k]
            at += w[k].size
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * grad, 0.999 * square[k] + 0.001 * grad * grad
            w[k] = w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        shared.unpersist()
    data.unpersist()
    return w, losses
