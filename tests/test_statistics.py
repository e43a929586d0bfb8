import math

import numpy as np
import pytest

from mosaica.functions.scalars import chi2_sf
from mosaica.operators import attribution, cluster, metrics, niches, replicate, splits, stats, survival, testing


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, cell_id long, cell_type string, x double, y double")


def test_contact_counts_double_the_diagonal(spark):
    c = cells_of(spark, [("u", 0, "A", 0.0, 0.0), ("u", 1, "A", 1.0, 0.0), ("u", 2, "B", 0.0, 1.0)])
    e = spark.createDataFrame([("u", 0, 1), ("u", 1, 2)], "unit_id string, src long, dst long")
    assert {(r.ta, r.tb): r.n for r in stats.contact_counts(c, e).collect()} == {("A", "A"): 2, ("A", "B"): 1, ("B", "A"): 1}


def test_enrichment_moments_match_drawn_permutations(spark):
    r = np.random.default_rng(1)
    n = 14
    types = ["A"] * 6 + ["B"] * 5 + ["C"] * 3
    c = cells_of(spark, [("u", i, types[i], float(r.random()), float(r.random())) for i in range(n)])
    e = sorted({tuple(sorted(map(int, p))) for p in r.integers(0, n, (30, 2)) if p[0] != p[1]})
    edges = spark.createDataFrame([("u", a, b) for a, b in e], "unit_id string, src long, dst long")
    got = {(x.ta, x.tb): (x.mean, x.sd) for x in stats.enrichment_analytic(c, edges).collect()}
    t, draws = np.array(types), {k: [] for k in got}
    for _ in range(6000):
        p = r.permutation(t)
        for a, b in draws:
            draws[a, b].append(sum((p[i] == a and p[j] == b) + (p[j] == a and p[i] == b) for i, j in e))
    for k, (mean, sd) in got.items():
        assert mean == pytest.approx(np.mean(draws[k]), rel=0.05, abs=0.05)
        assert sd == pytest.approx(np.std(draws[k]), rel=0.06, abs=0.05)


def test_moran_is_null_where_nothing_varies(spark):
    c = cells_of(spark, [("u", i, "A", float(i), 0.0) for i in range(5)])
    e = spark.createDataFrame([("u", i, i + 1) for i in range(4)], "unit_id string, src long, dst long")
    assert stats.morans_i(c, e).first().i is None


def test_q_values_skip_missing_p(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None)], "k int, p double")
    assert [r.q for r in testing.with_q(d).orderBy("k").collect()] == [pytest.approx(0.02), pytest.approx(0.04), None]


def test_group_test_of_a_planted_difference(spark):
    rows = [("m", f"p{i}", float(i), i >= 6) for i in range(12)] + [("flat", f"p{i}", 1.0, i >= 6) for i in range(12)]
    d = spark.createDataFrame(rows, "metric string, patient_id string, value double, positive boolean")
    out = {r.metric: r for r in testing.group_tests(d.drop("positive"), d.select("patient_id", "positive").distinct(), min_per_group=3, exact=True).collect()}
    assert out["m"].auroc == 1 and out["flat"].auroc == 0.5 and out["flat"].p == 1
    assert out["m"].p == pytest.approx(2 / math.comb(12, 6))


def test_group_tests_with_one_sided_or_single_values(spark):
    d = spark.createDataFrame([("one", "p0", 1.0), ("same", "p0", 1.0), ("same", "p1", 2.0)], "metric string, patient_id string, value double")
    g = spark.createDataFrame([("p0", True), ("p1", True)], "patient_id string, positive boolean")
    assert [(r.p, r.mean_other) for r in testing.group_tests(d, g, min_per_group=1).collect()] == [(None, None), (None, None)]
    pair = spark.createDataFrame([(1, 1)], "a int, b int")
    assert replicate.adjusted_rand(pair).first().ari is None


def test_exact_tail_is_a_distribution():
    t = testing._exact_tail(3, 4)
    assert t[0] == 1 and t[12] == pytest.approx(1 / math.comb(7, 3)) and sum(a - b for a, b in zip(t, (*t[1:], 0))) == pytest.approx(1)


def test_bootstrap_of_one_cluster_has_no_interval(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "patient_id string, value double")
    r = testing.bootstrap_mean(d, n_boot=20).first()
    assert (r["mean"], r.low, r.high) == (2.0, None, None)
    two = spark.createDataFrame([(f"p{i}", float(i % 5)) for i in range(60)], "patient_id string, value double")
    r = testing.bootstrap_mean(two, n_boot=200).first()
    assert r.low < 2.0 < r.high


def test_margins_average_to_the_bag_margin(spark):
    r = np.random.default_rng(0)
    rows = [("a" if i < 10 else "b", i, r.normal(size=2).tolist(), r.normal(size=2).tolist()) for i in range(30)]
    s = spark.createDataFrame(rows, "unit_id string, cell_id long, instance_logits array<double>, attention_logits array<double>")
    m = {x.unit_id: x.m for x in attribution.cell_margins(s, 2, (0.2, -0.1)).groupBy("unit_id").agg({"margin": "avg"}).toDF("unit_id", "m").collect()}
    bags = {(x["unit_id"], x["class"]): x["logit"] for x in attribution.bag_logits(s, 2).collect()}
    for u in "ab":
        assert m[u] == pytest.approx((bags[u, 1] + 0.1) - (bags[u, 0] - 0.2))


def test_target_that_varies_in_a_patient_is_an_error(spark):
    f = spark.createDataFrame([("u", "p", 0.4, 0), ("v", "p", 0.6, 1)], "unit_id string, patient_id string, prob_0 double, target int")
    with pytest.raises(Exception, match="varies"):
        attribution.patient_frame(f).collect()


def test_concordance_and_cox_loss(spark):
    t, e, x = [5.0, 3.0, 3.0, 8.0, 1.0, 5.0], [1, 1, 0, 0, 1, 1], [0.1, 0.9, 0.4, -0.5, 1.2, 0.1]
    d = spark.createDataFrame(list(zip(x, t, e, strict=True)), "risk double, time double, event int")
    won = n = 0.0
    for i in range(6):
        for j in range(6):
            if i != j and e[i] and (t[i] < t[j] or t[i] == t[j] and not e[j]):
                n += 1
                won += 1 if x[i] > x[j] else 0.5 if x[i] == x[j] else 0
    assert metrics.concordance(d).first().c_index == pytest.approx(won / n)
    want = -sum(x[i] - math.log(sum(math.exp(x[j]) for j in range(6) if t[j] >= t[i])) for i in range(6) if e[i]) / sum(e)
    assert metrics.cox_loss(d).first().loss == pytest.approx(want)
    assert metrics.cox_loss(d.withColumn("event", d["event"] * 0)).first().loss == 0


def test_survival_curve_ends_at_zero(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1)], "time double, event int")
    assert [(r.t, r.survival) for r in survival.kaplan_meier(d).orderBy("t").collect()] == [(1.0, pytest.approx(2 / 3)), (3.0, 0.0)]


def test_cox_finds_a_planted_hazard(spark):
    r = np.random.default_rng(3)
    z = r.normal(size=300)
    t = r.exponential(1 / np.exp(0.8 * z))
    b, se = survival.cox_fit(z, t, np.ones(300))
    assert abs(b - 0.8) < 3 * se
    d = spark.createDataFrame([("n", float(a), float(c), 1) for a, c in zip(z, t, strict=True)], "niche string, z double, time double, event int")
    assert survival.cox_univariate(d, "niche").first().beta == pytest.approx(b)
    assert abs(survival.cox_score(d, b).first().score) < 1e-4


def test_logrank(spark):
    d = spark.createDataFrame([(float(i), 1, "a" if i < 10 else "b") for i in range(20)], "time double, event int, group string")
    stat, p = survival.logrank(d)
    assert stat > 10 and p < 0.01
    assert math.isnan(survival.logrank(d.where("group = 'a'"))[0])
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6)


def test_density_clusters_find_blobs_and_noise():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(0, 0.3, (40, 2)), r.normal(8, 0.3, (40, 2)), r.normal((0, 8), 0.3, (40, 2)), [[40.0, 40.0]]])
    lab = cluster.density_clusters(x, 15)
    parts = [set(lab[i : i + 40]) - {-1} for i in (0, 40, 80)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3 and lab[-1] == -1
    assert (cluster.density_clusters(x[:1], 5) == -1).all()


def test_linkage_keeps_models_apart():
    d = {("a", "b"): 0.01, ("a", "c"): 0.1, ("b", "c"): 0.2}
    steps = replicate.linkage(["a", "b", "c"], ["m1", "m1", "m2"], d)
    assert steps == [(0.1, 0, 2)]
    assert replicate.cut_linkage(3, steps, 0.3) == [1, 2, 1]
    assert replicate.cut_linkage(3, steps, 0.1) == [1, 2, 3]


def test_linkage_is_greedy_by_mean_distances():
    """Against a plain search for the closest allowed pair of groups, means taken from the items each time."""
    r = np.random.default_rng(4)
    for _ in range(20):
        n = 9
        names, models = [f"n{i}" for i in range(n)], [f"m{i}" for i in r.integers(0, 4, n)]
        d = {(a, b): float(round(r.random(), 2)) for i, a in enumerate(names) for b in names[i + 1 :]}
        steps = replicate.linkage(names, models, d)
        groups = [{i} for i in range(n)]
        for mean, kept, gone in steps:
            def cost(a, b):
                if {models[i] for i in a} & {models[i] for i in b}:
                    return math.inf
                return round(sum(d[min(names[i], names[j]), max(names[i], names[j])] for i in a for j in b) / len(a) / len(b), 12)

            groups.sort(key=min)
            least, a, b = min((cost(a, b), min(a), min(b)) for k, a in enumerate(groups) for b in groups[k + 1 :])
            assert (mean, kept, gone) == (pytest.approx(least, abs=1e-9), a, b)
            first, second = next(g for g in groups if min(g) == a), next(g for g in groups if min(g) == b)
            groups.remove(second)
            first |= second
        groups.sort(key=min)
        assert all({models[i] for i in a} & {models[i] for i in b} for k, a in enumerate(groups) for b in groups[k + 1 :])
        assert [m for m, _, _ in steps] == sorted(m for m, _, _ in steps)
        group, threshold, scan = replicate.match_niches(names, models, d, [0.2, 0.4, 0.6])
        assert [(t, len(set(replicate.cut_linkage(n, steps, t)))) for t in (0.2, 0.4, 0.6)] == [(t, k) for t, _, k in scan]
        assert group == replicate.cut_linkage(n, steps, threshold)


def test_cox_fit_with_ties_and_without_a_maximum():
    r = np.random.default_rng(0)
    z, t, e = r.normal(size=60), r.integers(1, 12, 60).astype(float), r.integers(0, 2, 60).astype(float)

    def loglik(b):
        return sum(b * z[i] - math.log(sum(math.exp(b * z[j]) for j in range(60) if t[j] >= t[i])) for i in range(60) if e[i])

    b, se = survival.cox_fit(z, t, e)
    assert loglik(b) >= max(loglik(b - 1e-3), loglik(b + 1e-3))
    assert se == pytest.approx(1 / math.sqrt((2 * loglik(b) - loglik(b - 1e-3) - loglik(b + 1e-3)) / 1e-6), rel=1e-3)
    apart = np.array([0.0, 1.0, 2.0, 3.0])
    assert math.isnan(survival.cox_fit(apart, 4 - apart, np.ones(4))[0])
    assert math.isnan(survival.cox_fit(np.ones(5), np.arange(5.0), np.ones(5))[0])


def test_exact_p_is_the_default_for_small_samples(spark):
    rows = [("m", f"p{i}", float(v), i < 3) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])]
    d = spark.createDataFrame(rows, "metric string, patient_id string, value double, positive boolean")
    got = testing.group_tests(d.drop("positive"), d.select("patient_id", "positive"), min_per_group=3).first()
    assert got.p == pytest.approx(2 / 56) and got.auroc == 0
    tied = d.withColumn("value", d["value"] % 4)
    plain = testing.group_tests(tied.drop("positive"), d.select("patient_id", "positive"), min_per_group=3).first().p
    assert plain == testing.group_tests(tied.drop("positive"), d.select("patient_id", "positive"), min_per_group=3, exact=False).first().p


def test_contacts_are_judged_pair_by_pair(spark):
    # nine cells in a line, all of one niche: seven contacts of two types and one of another
    kinds = "ababababc"
    a = spark.createDataFrame([("u", i, 1, k) for i, k in enumerate(kinds)], "unit_id string, cell_id long, niche int, cell_type string")
    e = spark.createDataFrame([("u", i, i + 1) for i in range(8)], "unit_id string, src long, dst long")
    got = {(r.ta, r.tb): (r.n_contacts, r.value) for r in niches.niche_contacts(a, e, 5).collect()}
    assert got[("a", "b")] == (7, pytest.approx(0.0)) and got[("b", "c")] == (1, None) and got[("c", "c")] == (0, None) and len(got) == 6
    assert {r.value for r in niches.niche_contacts(a, e, 0).where("n_contacts = 0").collect()} == {None}


def test_shared_basis_groups_cells_of_all_models(spark):
    r = np.random.default_rng(1)
    rows = [(f"m{i % 2}", f"u{i % 6}", f"p{i % 3}", i, float(i % 4), [10.0 * (i % 4) + r.normal(0, 0.1), 5000.0 * (i % 4 // 2), 7.0]) for i in range(200)]
    d = spark.createDataFrame(rows, "model string, unit_id string, patient_id string, cell_id long, margin double, space array<double>")
    cells, margins = replicate.shared_basis(d, k=4, n_boot=50)
    by = {}
    for x in cells.collect():
        by.setdefault(x.grp, set()).add(int(x.margin))
    assert sorted(by) == ["G1", "G2", "G3", "G4"] and all(len(v) == 1 for v in by.values())
    assert {(x.model, x.grp) for x in margins.collect()} == {(f"m{k % 2}", g) for g, v in by.items() for k in v}


def test_numbers_follow_margins_and_noise_is_background(spark):
    rows = [(c, u, m) for c, m in ((0, 0.0), (1, 2.0), (2, -2.0), (-1, 5.0)) for u in ("a", "b")]
    d = spark.createDataFrame(rows, "cluster int, unit_id string, margin double")
    assert {r.cluster: r.niche for r in niches.number_niches(d).collect()} == {1: 1, 0: 2, 2: 3, -1: 0}


def test_splits_and_folds(spark):
    u = [(f"u{i}", f"g{i // 2}", i // 2 % 2) for i in range(24)]
    folds = splits.inner_folds(u, 3)
    assert sorted(x for f in folds for x in f) == sorted(x[0] for x in u)
    where = {x: k for k, f in enumerate(folds) for x in f}
    assert all(where[f"u{2 * i}"] == where[f"u{2 * i + 1}"] for i in range(12))
    assert all({c for n, _, c in u if where[n] == k} == {0, 1} for k in range(3))
    g = spark.createDataFrame([(f"g{i}", i % 2) for i in range(10)], "group_id string, s int")
    n = {r.split: r["count"] for r in splits.random_split(g, (0.6, 0.2, 0.2), 0, "s").groupBy("split").count().collect()}
    assert n == {"train": 6, "val": 2, "test": 2}
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "group_id string")
    assert sorted(r.split for r in splits.random_split(three, (0.7, 0.15, 0.15)).collect()) == ["test", "train", "val"]
    units = spark.createDataFrame([("a", "g1", 0), ("b", "g2", 1), ("c", "g2", 1)], "unit_id string, group_id string, label int")
    empty = splits.folds_table(spark.createDataFrame([([["a"], []],)], "folds array<array<string>>"))
    with pytest.raises(ValueError, match="has no unit"):
        splits.check_folds(empty, units)
    with pytest.raises(ValueError, match="is no unit"):
        splits.check_folds(spark.createDataFrame([(0, "a"), (1, "z")], "fold int, id string"), units)
    got = {r.unit_id: r.split for r in splits.unit_table(units, splits.explicit_split(units, ["a"], ["g2"])).collect()}
    assert got == {"a": "train", "b": "val", "c": "val"}
    for bad in ((["a"], ["zz"]), (["b"], ["g2"])):
        with pytest.raises(ValueError, match="neither|two splits"):
            splits.explicit_split(units, *bad)
    two = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "fold int, id string")
    with pytest.raises(ValueError, match="two folds"):
        splits.check_folds(two, spark.createDataFrame([("a", "a", 1)], "unit_id string, group_id string, label int"))


def test_density_niches_finds_a_rare_niche(spark, tmp_path):
    from mosaica import catalog

    r = np.random.default_rng(3)
    # three directions; the last has 2.6 % of the vectors, more than the least cluster size of 300
    group = np.repeat([0, 1, 2], [5845, 5845, 310])
    v = np.eye(8)[group] + r.normal(0, 0.02, (len(group), 8))
    rows = [(i, g, x) for i, (g, x) in enumerate(zip(group.tolist(), v.tolist(), strict=True))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {x.cell_id: x.cluster for x in catalog.density_niches(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rare = {got[i] for i in range(11690, 12000)} - {-1}
    assert rare and not rare & {got[i] for i in range(11690)}
