"""Kernels against brute force on small inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.core.newton import grouped_logistic
from riskspark.core.tails import erfc, f_sf, normal_sf, t_quantiles, t_two_sided_p
from riskspark.operators import calibration as C
from riskspark.operators import consensus as G
from riskspark.operators import corr as R
from riskspark.operators import dca as V
from riskspark.operators import discrimination as D
from riskspark.operators import screen as N
from riskspark.operators import selection as L
from riskspark.operators import significance as S
from riskspark.operators import thresholds as T


def frame(spark, y, p, **extra):
    rows = [(i, int(a), float(b) if b is not None else None) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "id bigint, y_true int, y_prob double")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < 0.1 + 0.5 * p).astype(int)
    return y, p


def test_erfc_and_tails(spark):
    xs = [-3.0, -1.0, 0.0, 0.3, 1.5, 4.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("e"), normal_sf(F.col("x")).alias("s")).collect():
        assert abs(r.e - math.erfc(r.x)) < 2e-7
        assert abs(r.s - 0.5 * math.erfc(r.x / math.sqrt(2))) < 2e-7
    # published table values
    assert [round(v, 3) for v in t_quantiles(0.975, [1, 2, 5, 10, 30])] == [12.706, 4.303, 2.571, 2.228, 2.042]
    r = spark.range(1).select(t_two_sided_p(F.lit(2.228139), F.lit(10.0)).alias("t"), f_sf(F.lit(4.964603), F.lit(1.0), F.lit(10.0)).alias("f")).first()
    assert abs(r.t - 0.05) < 1e-6 and abs(r.f - 0.05) < 1e-6


def test_auroc_and_ap_against_definition(spark, sample):
    y, p = sample
    r = D.discrimination(frame(spark, y, p)).first()
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(r.auroc - want) < 1e-12
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        rec, prec = y[hit].sum() / y.sum(), y[hit].mean()
        ap += (rec - last) * prec
        last = rec
    assert abs(r.prauc - ap) < 1e-12
    flip = D.auroc(frame(spark, y, 1 - p)).first().auroc
    assert abs(flip - (1 - r.auroc)) < 1e-12


@pytest.mark.parametrize("y, p, auroc", [([0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9], 1.0), ([0, 1, 0, 1], [0.5] * 4, 0.5)])
def test_limits(spark, y, p, auroc):
    assert D.auroc(frame(spark, y, p)).first().auroc == auroc


def test_one_class_empty_and_bad_scores(spark):
    r = D.discrimination(frame(spark, [1, 1], [0.2, 0.3])).first()
    assert r.auroc is None and r.youden is None
    assert D.auroc(frame(spark, [0, 1, 1, 0], [0.1, 0.9, None, float("nan")])).first().auroc == 1.0
    assert T.choose_threshold(frame(spark, [1, 1], [0.2, 0.3])).first().threshold == 0.5


def brute_roc(y, p):
    pts = [(math.inf, 0, 0)]
    for t in sorted(set(p), reverse=True):
        pts.append((t, int(y[p >= t].sum()), int((1 - y)[p >= t].sum())))
    body = pts[1:]
    keep = [i for i in range(len(body)) if i in (0, len(body) - 1) or body[i + 1][1] - 2 * body[i][1] + body[i - 1][1] or body[i + 1][2] - 2 * body[i][2] + body[i - 1][2]]
    return [pts[0], *[body[i] for i in keep]]


def test_thresholds_against_pruned_curve(spark, sample):
    y, p = sample
    pts = brute_roc(y, p)
    P, Nn = y.sum(), (1 - y).sum()
    j = [tp / P - fp / Nn for _, tp, fp in pts]
    on = [t for (t, *_), v in zip(pts, j) if abs(v - max(j)) < 1e-10]
    want = (max(on) + min(on)) / 2
    df = frame(spark, y, p)
    assert abs(T.choose_threshold(df).first().threshold - want) < 1e-12
    ok = [(tp / P, t) for t, tp, fp in pts if 1 - fp / Nn >= 0.9]
    best = max(v for v, _ in ok)
    first = next(t for v, t in ok if v == best)
    assert abs(T.choose_threshold(df, objective="fixed_spec", target=0.9).first().threshold - first) < 1e-12
    first = next(t for t, tp, _ in pts if tp / P >= 0.8)
    assert abs(T.choose_threshold(df, objective="fixed_sens", target=0.8).first().threshold - first) < 1e-12
    q = T.threshold_from_controls(df, spec=0.9).first().threshold
    assert q == np.quantile(p[y == 0], 0.9, method="higher")


def test_decision_curve(spark, sample):
    y, p = sample
    c = {round(r.threshold, 6): r for r in V.decision_curve(frame(spark, y, p), [0.1, 0.25, 0.5]).collect()}
    for t, r in c.items():
        tp, fp = (y[p >= t] == 1).sum(), (y[p >= t] == 0).sum()
        assert abs(r.net_benefit_model - (tp - fp * t / (1 - t)) / len(y)) < 1e-12 and r.tp == tp and r.tn == (y[p < t] == 0).sum()
    perfect = V.decision_curve(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), [0.5]).first()
    assert perfect.net_benefit_model == 0.5


@pytest.mark.parametrize(
    "nb, crossing, last", [([0.2, 0.1, -0.1], 0.25, 0.25), ([0.3, 0.2, 0.1], None, 0.3), ([-0.2, -0.1, -0.3], None, None), ([-0.01, -0.2, -0.3], 0.1, None)]
)
def test_crossings(spark, nb, crossing, last):
    df = spark.createDataFrame([(t, v) for t, v in zip([0.1, 0.2, 0.3], nb)], "threshold double, net_benefit_model double")
    a, b = V.dca_curve_crossing(df).first().crossing, V.dca_zero_crossing(df).first().zero_crossing
    for got, want in ((a, crossing), (b, last)):
        assert (got is None and want is None) or abs(got - want) < 1e-12


def logistic_mle(x, y, w=None):
    b = np.zeros(x.shape[1])
    w = np.ones(len(y)) if w is None else w
    for _ in range(100):
        mu = 1 / (1 + np.exp(-x @ b))
        h = (x * (w * mu * (1 - mu))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (w * (y - mu)))
    return b


def test_grouped_newton_and_calibrators(spark, sample):
    y, p = sample
    p = np.clip(p, 0.01, 0.99)
    z = np.log(p / (1 - p))
    df = frame(spark, y, p)
    r = C.calibration_line(df).first()
    assert np.allclose([r.intercept, r.slope], logistic_mle(np.c_[np.ones(len(z)), z], y), atol=1e-6)
    r = C.fit_calibrator(df, "beta").first()
    want = logistic_mle(np.c_[np.ones(len(z)), np.log(p), np.log(1 - p)], y)
    assert np.allclose([r.b0, r.b1, r.b2], want, atol=1e-5)
    r = C.fit_calibrator(df, "logistic_intercept").first()
    mean = np.mean(1 / (1 + np.exp(-(z + r.b0))))
    assert abs(mean - y.mean()) < 1e-8
    few = C.fit_calibrator(df.limit(20), "logistic_full")
    kept = C.apply_calibrator(df, few).filter("y_prob_calibrated <> y_prob").count()
    assert kept == 0


def test_isotonic_is_monotone(spark, sample):
    y, p = sample
    df = frame(spark, y, p)
    got = C.apply_isotonic(df, C.fit_isotonic(df)).orderBy("y_prob").collect()
    v = [r.y_prob_calibrated for r in got]
    assert all(a <= b + 1e-12 for a, b in zip(v, v[1:])) and 0 <= min(v) and max(v) <= 1
    one = df.filter("y_true = 1")
    assert C.apply_isotonic(one, C.fit_isotonic(one)).filter("y_prob_calibrated <> y_prob").count() == 0


def test_smooth_errors_are_those_of_the_cubic(spark, sample):
    y, p = sample
    curve = np.clip(np.polyval(np.polyfit(p, y, 3), p), 0, 1)
    err = np.abs(curve - p)
    for limit in (None, 5):
        r = C.smooth_errors(frame(spark, y, p), limit=limit).first()
        assert abs(r.ici - err.mean()) < 1e-9 and abs(r.e50 - np.percentile(err, 50)) < 1e-9 and abs(r.e90 - np.percentile(err, 90)) < 1e-9
    few = frame(spark, y[:5], p[:5])
    assert tuple(C.smooth_errors(few).first()) == (None, None, None)


def test_separated_groups_do_not_break_newton(spark):
    rows = [("sep", 0.0, 0, 5), ("sep", 1.0, 5, 0), ("ok", 0.0, 2, 3), ("ok", 1.0, 3, 2)]
    df = spark.createDataFrame(rows, "g string, x double, pos int, neg int")
    out = {r.g: r for r in grouped_logistic(df, ["g"], [F.lit(1.0), F.col("x")]).collect()}
    assert abs(out["ok"].b0 - math.log(2 / 3)) < 1e-8 and math.isfinite(out["sep"].b1)


def test_wald_is_finite_for_a_constant_feature(spark):
    long = spark.createDataFrame([(i, i % 2, f, v) for i in range(40) for f, v in (("const", 1.0), ("x", float(i % 7)))], "id int, y int, feature string, x double")
    got = {r.feature: r for r in N.wald_screen(long).collect()}
    assert got["x"].wald_statistic is not None


def test_mann_whitney_finds_planted_signal_and_counts_missing(spark):
    rows = [(i, int(i < 30), f"f{k}", None if (k == 3 and i % 2) else float((i * 37 + k * 11) % 101) + (100.0 if k == 0 and i < 30 else 0.0)) for i in range(200) for k in range(4)]
    long = spark.createDataFrame(rows, "id int, y int, feature string, x double")
    got = N.mann_whitney_screen(long).orderBy("rank").collect()
    assert got[0].feature == "f0" and {r.feature: r.nonmissing_frac for r in got}["f3"] == 0.5


def test_signed_rank_exact(spark):
    d = [0.5, -0.1, 0.3, 0.7, 0.2, -0.4]
    rows = [(i, c, 1.0 + (v if c == "a" else 0.0)) for i, v in enumerate(d) for c in ("a", "b")]
    r = S.wilcoxon_pairs(spark.createDataFrame(rows, "fold int, combo string, auprc double")).first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(sum(k for k, v in zip(ranks, d) if v > 0), sum(k for k, v in zip(ranks, d) if v < 0))
    sums = [sum(k for k, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=6)]
    assert r.statistic == w and abs(r.p_value - min(1, 2 * np.mean([s <= w for s in sums]))) < 1e-12


def test_kendall_without_pairs(spark):
    rng = np.random.default_rng(3)
    x, z = np.arange(1, 61), rng.permutation(60) + 1
    a = spark.createDataFrame([(str(i), int(r)) for i, r in enumerate(x)], "feature string, rank int")
    b = spark.createDataFrame([(str(i), int(r)) for i, r in enumerate(z)], "feature string, rank int")
    r = S.rank_agreement(a, b, [10]).first()
    pairs = list(itertools.combinations(range(60), 2))
    tau = np.mean([np.sign((x[i] - x[j]) * (z[i] - z[j])) for i, j in pairs])
    assert abs(r.kendall - tau) < 1e-12 and abs(r.spearman - np.corrcoef(x, z)[0, 1]) < 1e-12


def test_greedy_walk_and_components(spark):
    rng = np.random.default_rng(5)
    names = [f"f{i:02d}" for i in range(40)]
    edges = sorted({tuple(sorted(rng.choice(40, 2, replace=False))) for _ in range(45)})
    pairs = spark.createDataFrame([(names[i], names[j], 0.9) for i, j in edges], "a string, b string, abs_corr double")
    ranked = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, rank int")
    near = {n: set() for n in names}
    for i, j in edges:
        near[names[i]].add(names[j])
        near[names[j]].add(names[i])
    walk = []
    for n in names:
        if not near[n] & set(walk):
            walk.append(n)
    got = [r.feature for r in R.greedy_independent(ranked, pairs).orderBy("rank").collect()]
    assert got == walk
    kept = spark.createDataFrame([("f39", 1)], "feature string, rank int")
    walk = ["f39"]
    for n in names:
        if n not in walk and not near[n] & set(walk):
            walk.append(n)
    panel = [r.feature for r in R.refill_panel(kept, ranked, pairs, 12, 0.5).orderBy("position").collect()]
    assert panel == walk[:12]
    label = {n: n for n in names}
    for _ in names:
        for n in names:
            label[n] = min([label[n], *[label[m] for m in near[n]]])
    nodes = ranked.select(F.col("feature").alias("node"))
    assert {r.node: r.component for r in R.components(pairs, nodes).collect()} == label


def test_correlation_with_missing_and_constant(spark):
    rng = np.random.default_rng(1)
    x = rng.random((50, 3))
    rows = [(i, None if i == 3 else float(a), float(b), float(c), 1.0, None, float("nan") if i == 5 else float(i // 7)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, k double, none double, t double")
    a = x[:, 0].copy()
    a[3] = np.median(np.delete(a, 3))
    t = np.array([i // 7 for i in range(50)], float)
    t[5] = np.median(np.delete(t, 5))
    wide = pd.DataFrame({"a": a, "b": x[:, 1], "c": x[:, 2], "k": 1.0, "none": np.nan, "t": t})
    for method in ("pearson", "spearman"):
        want = wide.corr(method=method).abs()
        for options in ({"block": 2}, {"block": 4, "task_bytes": 1}, {}, {"limit": 1}):
            got = {(r.a, r.b): r.abs_corr for r in R.correlation_pairs(df, list(wide), method, **options).collect()}
            assert len(got) == 15
            for (i, j), v in got.items():
                assert (v is None) == bool(np.isnan(want.loc[i, j])) and (v is None or abs(v - want.loc[i, j]) < 1e-12)
        some = R.correlation_pairs(df, list(wide), method, block=2, threshold=0.1).collect()
        assert {(r.a, r.b) for r in some} == {pair for pair, v in got.items() if v is not None and v >= 0.1}
    assert R.correlation_pairs(df.filter("id < 0"), ["a", "b"]).count() == 0


def test_rank_aggregate_by_hand(spark):
    rows = [("m1", "x", 1), ("m1", "y", 2), ("m2", "x", 2), ("m2", "z", 1)]
    df = spark.createDataFrame(rows, "model string, feature string, final_rank int")
    got = {r.feature: r for r in G.rank_aggregate(df).collect()}
    assert abs(got["x"].consensus_score - math.sqrt(2 / 1 * 2 / 2)) < 1e-9
    assert abs(got["z"].consensus_score - math.sqrt(2 / 3 * 2 / 1)) < 1e-9
    assert got["x"].consensus_rank == 1 and got["y"].n_models_present == 1
    assert abs(got["y"].rank_std - np.std([2, 3], ddof=1)) < 1e-12


def test_p_value_is_never_zero(spark):
    nulls = spark.createDataFrame([("m", 0.5 + i / 1000) for i in range(99)] + [("m", float("nan"))], "model string, null_auroc double")
    obs = spark.createDataFrame([("m", 0.99)], "model string, observed double")
    r = S.empirical_p(nulls, obs).first()
    assert r.n_perms == 99 and r.p_value == 1 / 100
    empty = spark.createDataFrame([("m", 1, float("nan"), 0.7)], "model string, split_seed int, null_auroc double, observed double")
    assert S.pooled_null(empty).first().p_value == 1.0


def test_seed_stability_and_size_rules(spark):
    df = spark.createDataFrame([("a", 0.8), ("a", 0.82), ("b", 0.5), ("b", 0.9), ("c", 0.7)], "model string, auroc_val double")
    got = {r.model: r.stable for r in L.seed_stability(df, ["model"]).collect()}
    assert got == {"a": True, "b": False, "c": True}
    ess = spark.createDataFrame([("m", "x", 0.05, 0.01, 5), ("m", "y", 0.001, 0.02, 5), ("m", "z", 0.0, 0.0, 1)], "model string, feature string, mean_delta double, std_delta double, n_folds int")
    assert {r.feature: r.passenger for r in L.filter_passengers(ess).collect()} == {"x": False, "y": True, "z": False}


def test_brier_parts_add_up(spark, sample):
    y, p = sample
    r = C.brier_decomposition(frame(spark, y, p)).first()
    assert abs(r.brier_score - (r.reliability - r.resolution + r.uncertainty)) < 1e-12
    assert abs(r.uncertainty - y.mean() * (1 - y.mean())) < 1e-12


def test_binned_logits_interval_covers_point(spark, sample):
    y, p = sample
    for r in C.binned_logits(frame(spark, y, p), n_bins=5, n_boot=100).collect():
        assert r.logit_obs_lo <= r.logit_obs <= r.logit_obs_hi and r.logit_obs_sd > 0


def test_permutation_null_centres_on_half(spark):
    rows = [(i, int(i % 3 == 0), "f", float((i * 7919) % 1009)) for i in range(300)]
    long = spark.createDataFrame(rows, "id int, y int, feature string, x double")
    v = [r.null_auroc for r in S.permutation_null(long, 12, F.col("id") % 2 == 0).collect()]
    assert len(v) == 12 and all(min(abs(x - a) for a in (v[0], 1 - v[0])) < 1e-9 for x in v)
