"""Quality of a text: attention-based multiple-instance learning.

Each text is a bag of passages. A passage is encoded from its words, hashed, the
kinds of its bytes and the repetition of its words; a gated attention weighs
passages, and the weighted mean of their encodings is scored. Encoder, attention
and score are learned together from the labels of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm import minhash
from mosaica.llm.bpe import slices

PASSAGE = 64
#: Labelled documents to learn from at most, those with the least hashes of their ids.
SAMPLE = 6_000
#: Passages of a document to learn from at most, evenly spread over it; scores see all.
PASSAGES = 32
WIDTH, GATE, EPOCHS, SEED = 16, 8, 60, 7

_KIND = np.zeros(256, np.int64)
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND[:32] = 0
_KIND[32] = 1
_KIND[10] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("A") : ord("Z") + 1] = 4
_KIND[ord("0") : ord("9") + 1] = 5
_KIND[128:] = 6
_KIND[_MARKS] = 7 + np.arange(len(_MARKS))
KINDS = 7 + len(_MARKS)
#: Buckets of hashed words.
WORDS = 128
STATISTICS = KINDS + WORDS
#: Added to the deviation by which a bucket's share is divided; other features have 0.02.
WORD_SLACK = 1.0
FEATURES = STATISTICS + 5


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of PASSAGE words, text by text, and the number of passages of each text (one at least)."""
    raw = [t.encode() for t in texts]
    joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    part = np.frombuffer(joined.tobytes().translate(minhash._TABLE), np.uint8) != 32
    edge = np.flatnonzero(part[1:] != part[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    limits = np.cumsum([0] + [len(r) + 1 for r in raw]) + 1
    first = np.searchsorted(starts, limits)
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(count)])
    of_text = np.repeat(np.arange(len(texts)), n_words)
    within = np.arange(len(starts)) - first[of_text]
    of_word = base[of_text] + within // PASSAGE
    total = int(base[-1])
    out = np.zeros((total, FEATURES), np.float32)
    # bytes of a text before its first word belong to its first passage, others to the passage of the word before
    marks = np.zeros(len(joined), np.int64)
    np.maximum.at(marks, limits[:-1] - 1, base[:-1])
    marks[starts] = of_word
    of_byte = np.maximum.accumulate(marks)
    text_byte = np.ones(len(joined), bool)
    text_byte[limits - 1] = False  # the blanks between texts are no part of them
    hist = np.bincount((of_byte * KINDS + _KIND[joined])[text_byte], minlength=total * KINDS).reshape(total, KINDS)
    size = np.maximum(1, hist.sum(1))
    out[:, :KINDS] = np.sqrt(hist / size[:, None])
    if len(starts):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(minhash._BYTE[joined] * minhash._powers(minhash._BASE, len(joined)), dtype=np.uint64)])
            word = (sums[ends] - sums[starts]) * minhash._powers(minhash._INVERSE, len(joined))[starts]
        words = np.maximum(1, np.bincount(of_word, minlength=total))
        bucket = (minhash.mix(word) >> np.uint64(57)).astype(np.int64)  # the top seven bits: one of WORDS
        out[:, KINDS:STATISTICS] = np.sqrt(np.bincount(of_word * WORDS + bucket, minlength=total * WORDS).reshape(total, WORDS) / words[:, None])
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])])
        pair = np.unique(np.stack([of_word.astype(np.uint64), word]), axis=1)[0].astype(np.int64)
        out[:, STATISTICS] = np.bincount(of_word, same, total) / words
        out[:, STATISTICS + 1] = np.bincount(pair, minlength=total) / words
        length = ends - starts
        out[:, STATISTICS + 2] = np.bincount(of_word, length, total) / words / 10
        out[:, STATISTICS + 3] = np.log1p(np.bincount(of_word, minlength=total)) / 4
        caps = (joined[starts] >= 65) & (joined[starts] <= 90)
        out[:, STATISTICS + 4] = np.bincount(of_word, caps, total) / words
    return out, count


def _bags(x: np.ndarray, count: np.ndarray, p: dict) -> tuple:
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
    a = e / np.repeat(np.add.reduceat(e, starts), count)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return starts, h, t, g, a, z, z @ p["c"] + p["d"]


def score_bags(x: np.ndarray, count: np.ndarray, p: dict) -> np.ndarray:
    """Probability of label 1 for each bag."""
    return 1 / (1 + np.exp(-np.clip(_bags(x, count, p)[-1].astype(np.float64), -40, 40)))


def gradient(x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray, p: dict) -> dict:
    """Of the weighted sum of the bags' log losses, by every learned parameter."""
    starts, h, t, g, a, z, logit = _bags(x, count, p)
    r = (1 / (1 + np.exp(-logit)) - y) * weight
    dz = np.repeat(r, count)[:, None] * p["c"]
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
    dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return {"W": ((x - p["mean"]) / p["scale"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ r, "d": r.sum()}


def train_bags(x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict:
    """Learn encoder, attention and score by Adam on the log loss, classes weighing the same."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    p = {"W": rng.normal(0, d**-0.5, (d, WIDTH)), "b": np.zeros(WIDTH), "V": rng.normal(0, 0.3, (WIDTH, GATE)), "U": rng.normal(0, 0.3, (WIDTH, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, WIDTH), "d": np.zeros(())}
    slack = np.full(d, 0.02)
    if d == FEATURES:
        slack[KINDS:STATISTICS] = WORD_SLACK  # buckets are many: few labels must not make much of one
    fixed = {"mean": x.mean(0), "scale": x.std(0) + slack}
    m, v, step = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    offsets = np.concatenate([[0], np.cumsum(count)])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            some = order[at : at + 256]
            rows = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in some])
            n, xs = count[some], x[rows]
            grad = gradient(xs, n, y[some], weight[some] / len(some), p | fixed)
            step += 1
            for k, q in grad.items():
                q = q + 1e-4 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(q, np.float32) for k, q in (p | fixed).items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most: int = PASSAGES) -> dict | float:
    """Learn from at most `sample` labelled rows and `most` passages of each, which bounds what the driver holds; a constant score where labels of one kind only, or none, are there.

    Labels other than 0 and 1 and labels that contradict each other don't
    count. Without labels the constant is 1: nothing speaks against a text.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    rows = known.select(F.xxhash64("id").alias("h"), "id", "y").orderBy("h", "id").limit(sample).select("id", "y").collect()
    if len({r.y for r in rows}) < 2:
        return float(rows[0].y) if rows else 1.0
    small = spark.createDataFrame(rows, known.select("id", "y").schema)  # `sample` rows at most: fit for broadcast

    def encode(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in slices(texts, 500_000):
                x, count = passages(texts[a:b])
                ends = np.cumsum(count)
                picked = [x[e - n + (np.arange(min(n, most)) * n // min(n, most))] for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].array, "y": pdf["y"].iloc[a:b].array, "n": np.minimum(count, most), "x": [p.tobytes() for p in picked]})

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(small), "id")
    kind = known.schema["id"].dataType.simpleString()
    got = found.select("id", "y", "text").mapInPandas(encode, f"id {kind}, y int, n long, x binary").toPandas().sort_values(["id", "x"])
    if got["y"].nunique() < 2:
        return float(got["y"].iloc[0]) if len(got) else 1.0
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES)
    return train_bags(x, got["n"].to_numpy(), got["y"].to_numpy())


def score_column(spark: SparkSession, model: dict | float, text: str | Column) -> Column:
    """A column of scores, 0 to 1, of whole texts; null and empty texts are bags of one passage without words."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = shared.value
        for column in batches:
            texts = [t if isinstance(t, str) else "" for t in column]
            out = np.full(len(texts), p if isinstance(p, float) else 0.0)
            if not isinstance(p, float):
                for a, b in slices(texts, 500_000):
                    out[a:b] = score_bags(*passages(texts[a:b]), p)
            yield pd.Series(out)

    return scored(text)


def score(docs: DataFrame, model: dict | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id and score."""
    return docs.select(F.col(id_col), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
