"""Near-duplicate documents by word shingles.

Signatures come from one permutation: each shingle hash falls into one bin, the
least hash of a bin is its value, and empty bins borrow from others by a second
hash (optimal densification). Bands of bins make buckets. Each bucket gives
star-shaped edges to its least document only, so the number of edges is bounded
by documents times bands. Edges whose signatures agree in fewer than half of
the bins go. What remains connects groups of candidates. Within a group links
are confirmed on full shingle sets: large groups against a hub first, and what
is not linked to it against all, block against block; only a spanning forest of
the links found leaves a block. Identical sets are joined before, so that copies
cost nothing further.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import components, settle

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
#: Bins in which a document agrees with its bucket's hub to be grouped with it. Linked documents agree in four of five, but for chance;
#: a pair is missed only if in every bucket that it shares the least document is one with which either of the two agrees in fewer.
AGREE = BINS // 2
#: Documents in a block of a candidate group.
BLOCK = 256
#: Characters that are hashed at once.
CHARS = 500_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        filled = 1
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * _U(pow(base, filled, 2**64))
            filled += take
    return out


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of `size` words; with fewer words, of the whole sequence."""
    raw = [(t or "").encode().translate(_TABLE) for t in texts]
    joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    part = joined != 32
    edge = np.flatnonzero(part[1:] != part[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), dtype=np.uint64)])
        word = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(joined))[starts] + (ends - starts).astype(np.uint64))
        limits = np.cumsum([0] + [len(r) + 1 for r in raw]) + 1
        first = np.searchsorted(starts, limits)
        n_words = np.diff(first)
        rolled = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for k in range(size):
            rolled = mix(rolled * _U(_BASE) + word[k : k + len(rolled)])
        out = []
        for i, n in enumerate(n_words.tolist()):
            a = first[i]
            if n >= size:
                out.append(np.unique(rolled[a : a + n - size + 1]))
            elif n:
                h = np.zeros(1, np.uint64)
                for k in range(n):
                    h = mix(h * _U(_BASE) + word[a + k])
                out.append(mix(h + _U(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _borrow() -> np.ndarray:
    """For each bin, the order in which it tries others: the same for all documents."""
    with np.errstate(over="ignore"):
        keys = mix(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) * _U(0x9E3779B97F4A7C15) + _U(12345))
    return np.argsort(keys, axis=1, kind="stable")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS 64-bit values for each set; zeros for empty sets."""
    out = np.zeros((len(sets), BINS), np.uint64)
    have = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            bins = (s >> _U(56)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))  # sorted: the first of a bin is the least
            out[i, bins[at]] = s[at]
            have[i, bins[at]] = True
    order = _borrow()
    todo = np.flatnonzero(have.any(1) & ~have.all(1))
    base, base_have = out.copy(), have.copy()
    for k in range(BINS):
        if not len(todo):
            break
        r, c = np.nonzero(~have[todo])
        r = todo[r]
        src = order[c, k]
        ok = base_have[r, src]
        with np.errstate(over="ignore"):
            out[r[ok], c[ok]] = base[r[ok], src[ok]]
        have[r[ok], c[ok]] = True
        todo = todo[~have[todo].all(1)]
    return out


def _slices(texts, chars=CHARS):
    start = room = 0
    for i, t in enumerate(texts):
        room += len(t or "")
        if room >= chars:
            yield start, i + 1
            start, room = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _texts(pdf: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in pdf["text"]]


def features(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, s1, s2: a 128-bit digest of the set, sig: a byte for each bin, bands)."""

    def run(batches):
        for pdf in batches:
            texts = _texts(pdf)
            for a, b in _slices(texts):
                sets = shingle_sets(texts[a:b], size)
                sig = signatures(sets)
                with np.errstate(over="ignore"):
                    band = np.zeros((len(sets), BANDS), np.uint64)
                    for k in range(ROWS):
                        band = mix(band * _U(_BASE) + sig[:, k : BANDS * ROWS : ROWS])
                    band = mix(band + np.arange(BANDS, dtype=np.uint64))
                    digest = [(np.add.reduce(s), np.bitwise_xor.reduce(mix(s + _U(99)))) if len(s) else (_U(0), _U(0)) for s in sets]
                small = (mix(sig) >> _U(56)).astype(np.uint8)
                yield pd.DataFrame(
                    {
                        "id": pdf["id"].iloc[a:b].array,
                        "n_shingles": [len(s) for s in sets],
                        "s1": np.array([d[0] for d in digest], np.uint64).view(np.int64),
                        "s2": np.array([d[1] for d in digest], np.uint64).view(np.int64),
                        "sig": [r.tobytes() for r in small],
                        "bands": list(band.view(np.int64)),
                    }
                )

    return docs.mapInPandas(run, "id long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) of a spanning forest of the links among n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(i, r) for i in range(n) if (r := find(i)) != i]


def links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (one on side 0, one on side 1 or, if there is one side only, any two) with 100 * common >= percent * union."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    value = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else new
    owner, col = owner[shared], col[shared]
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    col = np.unique(col, return_inverse=True)[1]
    two = bool(side.any()) and not side.all()
    rows_a, rows_b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(sets)),) * 2
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[rows_a], place_b[rows_b] = np.arange(len(rows_a)), np.arange(len(rows_b))
    common = np.zeros((len(rows_a), len(rows_b)), np.float32)
    step = 4096
    by_col = np.argsort(col, kind="stable")
    owner, col = owner[by_col], col[by_col]
    for c in range(0, int(col[-1]) + 1, step):
        a, b = np.searchsorted(col, [c, c + step])
        o, k = owner[a:b], col[a:b] - c
        left = np.zeros((len(rows_a), step), np.float32)
        ok = place_a[o] >= 0
        left[place_a[o[ok]], k[ok]] = 1
        if two:
            right = np.zeros((len(rows_b), step), np.float32)
            ok = place_b[o] >= 0
            right[place_b[o[ok]], k[ok]] = 1
        else:
            right = left
        common += left @ right.T
    both = common.astype(np.int64)
    union = n[rows_a][:, None] + n[rows_b][None, :] - both
    hit = (100 * both >= percent * union) & (both > 0)
    if not two:
        hit = np.triu(hit, 1)
    a, b = np.nonzero(hit)
    return rows_a[a], rows_b[b]


def _hashed(members: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """`members` (id, grp, blocks, own) with the hashes of their sets."""

    def run(batches):
        for pdf in batches:
            text = _texts(pdf)
            for a, b in _slices(text):
                sets = shingle_sets(text[a:b], size)
                yield pdf.iloc[a:b][["id", "grp", "blocks", "own"]].assign(hashes=[s.tobytes() for s in sets])

    texts = docs.select("id", "text").join(members, "id").select("id", "grp", "blocks", "own", "text")
    return texts.mapInPandas(run, "id long, grp long, blocks int, own int, hashes binary")


def _compare(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as forests, among the rows of each (grp, i, j), or between their two sides."""
    dealt = dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side")

    def run(batches):
        key, ids, found, side = None, [], [], []

        def close():
            if len(ids) < 2:
                return None
            a, b = links(found, np.array(side), percent)
            edges = _forest(len(ids), a, b)
            return pd.DataFrame({"a": [ids[x] for x, _ in edges], "b": [ids[y] for _, y in edges]}) if edges else None

        for pdf in batches:
            for row in zip(pdf["grp"], pdf["i"], pdf["j"], pdf["id"], pdf["side"], pdf["hashes"], strict=True):
                if row[:3] != key:
                    if (out := close()) is not None:
                        yield out
                    key, ids, found, side = row[:3], [], [], []
                ids.append(row[3])
                side.append(row[4])
                found.append(np.frombuffer(row[5], np.uint64))
        if (out := close()) is not None:
            yield out

    return dealt.select("grp", "i", "j", "id", "side", "hashes").mapInPandas(run, "a long, b long")


def _hubs(placed: DataFrame, sig: DataFrame) -> DataFrame:
    """(grp, hub): of each group the document whose signature agrees most with that of a block's majority.

    Copies stray from what they were made of in different places, so the
    majority comes near the original. The choice decides the work only.
    """

    def majority(batches):
        key, held = None, []

        def close():
            x = np.frombuffer(b"".join(held), np.uint8).reshape(-1, BINS)
            votes = np.zeros((BINS, 256), np.int64)
            np.add.at(votes, (np.tile(np.arange(BINS), len(x)), x.reshape(-1)), 1)
            return pd.DataFrame({"grp": [key], "usual": [votes.argmax(1).astype(np.uint8).tobytes()]})

        for pdf in batches:
            for grp, own in zip(pdf["grp"], pdf["sig"], strict=True):
                if grp != key:
                    if held:
                        yield close()
                    key, held = grp, []
                held.append(own)
        if held:
            yield close()

    def agreement(batches):
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, BINS) == np.frombuffer(b"".join(pdf["usual"]), np.uint8).reshape(-1, BINS)
                yield pdf[["id", "grp"]].assign(n=x.sum(1))

    signed = placed.join(sig, "id")
    first = signed.where("own = 0").select("grp", "blocks", "sig").repartition("grp").sortWithinPartitions("grp")
    usual = first.select("grp", "sig").mapInPandas(majority, "grp long, usual binary")
    spread = usual.join(placed.select("grp", "blocks").distinct(), "grp").select("grp", "usual", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    scored = signed.join(spread, ["grp", "own"]).select("id", "grp", "sig", "usual").mapInPandas(agreement, "id long, grp long, n long")
    return scored.groupBy("grp").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"))


def verify(members: DataFrame, docs: DataFrame, sig: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the documents of each candidate group, as forests: (a, b).

    `members`: (id, grp); `sig`: (id, sig). A group that fits a block is
    compared at once. In a larger one all documents meet one hub first, a row
    each; those linked to it are one component whatever else links them, and
    only the rest meets all documents, block against block. So a group of
    copies of one document costs about its number of rows, however many these
    are, and no link is lost.
    """
    sizes = settle(members.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    placed = members.join(sizes, "grp").select("id", "grp", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    placed = settle(placed)
    every = settle(_hashed(placed, docs, size))  # texts move once
    out = _compare(every.where("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}), percent)
    large, sets = placed.where("blocks > 1"), every.where("blocks > 1")
    if large.isEmpty():
        return out

    hubs = settle(_hubs(large, sig))
    centre = sets.join(hubs, "grp").where("id = hub").select("id", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.lit(0).alias("side"), "hashes")
    star = centre.unionByName(sets.select("id", "grp", "own", F.lit(1).alias("side"), "hashes")).repartition("grp", "own").sortWithinPartitions("grp", "own", "side")

    def meet(batches):
        key, hub, own = None, None, np.zeros(0, np.uint64)
        for pdf in batches:
            rows = []
            for grp, block, doc, side, data in zip(pdf["grp"], pdf["own"], pdf["id"], pdf["side"], pdf["hashes"], strict=True):
                if (grp, block) != key:
                    key, hub, own = (grp, block), None, np.zeros(0, np.uint64)
                x = np.frombuffer(data, np.uint64)
                if side == 0:
                    hub, own = doc, x
                else:
                    both = len(np.intersect1d(own, x, assume_unique=True)) if hub is not None else 0
                    rows.append((doc, hub, both > 0 and 100 * both >= percent * (len(own) + len(x) - both)))
            yield pd.DataFrame(rows, columns=["id", "hub", "linked"]).astype({"hub": "Int64"})

    met = settle(star.select("grp", "own", "id", "side", "hashes").mapInPandas(meet, "id long, hub long, linked boolean"))
    out = out.union(met.where("linked and id <> hub").select("id", "hub"))
    rest = settle(sets.join(met.where("not linked").select("id"), "id"))
    if rest.isEmpty():
        return out
    parts = settle(rest.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    of_rest = rest.join(parts, "grp").select("grp", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "id", "hashes")
    spread = parts.join(sizes, "grp").select("grp", "parts", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    of_all = sets.join(spread, ["grp", "own"]).select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "hashes")
    return out.union(_compare(of_rest.unionByName(of_all), percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per id: (id, n_shingles, component_id, kept).

    Words are runs of anything but blanks, A-Z lower-cased; a text's set holds
    its distinct shingles of `shingle` words, or the whole sequence if it has
    fewer. Two documents are linked if 100 * common >= percent * union.
    component_id is the smallest id reachable by links. Texts without words,
    null ones too, have an empty set and are linked with nothing. Rows with a
    null id are left out. Rows that share an id are one node: what links to one
    links to both, and n_shingles is the largest.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    seen = settle(features(base, shingle))
    full = seen.where("n_shingles > 0")

    # identical sets: one document stands for all
    same = settle(full.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    copies = settle(full.select("id", "s1", "s2", "n_shingles").join(same, ["s1", "s2", "n_shingles"]).select(F.col("id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())
    alone = settle(full.join(copies.select(F.col("a").alias("id")), "id", "left_anti").select("id", "sig", "bands"))

    rows = alone.select("id", F.explode("bands").alias("bucket"))
    hubs = settle(rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub < most").drop("most"))
    stars = settle(rows.join(hubs, "bucket").where("id <> hub").select("id", "hub").distinct())

    def agreeing(batches):
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(-1, BINS) == np.frombuffer(b"".join(pdf["y"]), np.uint8).reshape(-1, BINS)
                yield pdf.loc[x.sum(1) >= AGREE, ["a", "b"]]

    sig = alone.select("id", "sig")
    sided = stars.join(sig, "id").select(F.col("id").alias("a"), "hub", F.col("sig").alias("x"))
    sided = sided.join(sig.withColumnRenamed("id", "hub"), "hub").select("a", F.col("hub").alias("b"), "x", F.col("sig").alias("y"))
    groups = components(sided.mapInPandas(agreeing, "a long, b long"))
    members = settle(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")))

    linked = verify(members, base, sig, shingle, percent)
    parts = settle(components(linked.union(copies)))
    out = seen.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")).join(parts.withColumnRenamed("node", "id"), "id", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.y) AS component_id, w.doc_id = min(reach.y) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id
"""
