"""Batched fits against single Spark ML pipelines, keyed isotonic calibration, dense ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.core import irls
from riskspark.core.irls import Spec, fit_logistic_batch, score_batch
from riskspark.core.order import dense_rank
from riskspark.operators import batched as B
from riskspark.operators import calibration as C
from riskspark.operators import importance as I
from riskspark.operators import models as M

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1] + [0, 5, 100, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * (x[:, 1] - 5) + 0.3)))).astype(int)
    data = [(i, int(y[i]), *(None if (i + j) % 29 == 0 and j < 2 else float(v) for j, v in enumerate(x[i])), int(i % 5), float(1 + i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "id long, y int, a double, b double, c double, d double, part int, w double").cache()


def single(train, name, features, weight=None, **params):
    return M.build_pipeline(name, features, y="y", weight=weight, maxIter=2000, tol=1e-14, **params).fit(train)


def batch_rows(rows, members):
    return B.vectors(rows, FEATURES, "id", "y", ["part"]).withColumn("members", members)


@pytest.mark.parametrize("name,params", [("LR_L2", {"regParam": 0.05}), ("LR_L2", {"regParam": 0.0}), ("LR_EN", {"regParam": 0.02}), ("LR_L1", {"regParam": 0.01})])
def test_all_folds_equal_single_fits(spark, rows, name, params):
    members = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("part")), lambda f: B.member(f))
    here = batch_rows(rows, members).withColumn("targets", F.array("part"))
    fits = fit_logistic_batch(here, {f: B.spec_of(name, range(4), **params) for f in range(5)}, 4)
    got = {(r.id): r.y_prob for r in score_batch(here, fits, 4, ["id"]).collect()}
    assert len(got) == 400
    for f in (0, 3):
        model = single(rows.filter(F.col("part") != f), name, FEATURES, **params)
        lr = model.stages[-1]
        assert fits[f].converged and np.allclose(fits[f].coef, lr.coefficients.toArray(), atol=1e-6) and abs(fits[f].intercept - lr.intercept) < 1e-6
        for r in M.score(rows.filter(F.col("part") == f), model).collect():
            assert abs(got[r.id] - r.y_prob) < 1e-6


def test_weights_and_panels_equal_single_fits(spark, rows, monkeypatch):
    # Waves of one model each give the same.
    members = F.array(B.member(F.lit(0), F.col("w")), B.member(F.lit(1)), B.member(F.lit(2), F.col("w")))
    here = B.vectors(rows.withColumn("k", F.lit(1)), FEATURES, "id", "y", ["w"]).withColumn("members", members)
    specs = {0: Spec((0, 1, 2, 3), 0.03), 1: Spec((3, 1), 0.1), 2: Spec((0,), 0.01, 0.5)}
    fits = fit_logistic_batch(here, specs, 4)
    for m, (features, weight, params) in {0: (FEATURES, "w", {"regParam": 0.03}), 1: (["d", "b"], None, {"regParam": 0.1}), 2: (["a"], "w", {"regParam": 0.01, "elasticNetParam": 0.5})}.items():
        lr = single(rows, "LR_L2", features, weight, **params).stages[-1]
        assert np.allclose(fits[m].coef, lr.coefficients.toArray(), atol=1e-6) and abs(fits[m].intercept - lr.intercept) < 1e-6
    monkeypatch.setattr(irls, "WAVE_BYTES", 1)
    again = fit_logistic_batch(here, specs, 4)
    assert all(np.allclose(fits[m].coef, again[m].coef, atol=1e-10) for m in fits)


def test_odd_batches(spark, rows):
    flat = rows.withColumns({"c": F.lit(7.0), "d": F.lit(None).cast("double")})
    here = B.vectors(flat, FEATURES, "id", "y").withColumn("members", F.when(F.col("id") < 300, F.array(B.member(F.lit(0)))).otherwise(F.array(B.member(F.lit(0)), B.member(F.lit(2)))))
    fits = fit_logistic_batch(here, {m: Spec((0, 1, 2, 3), 0.01) for m in range(3)}, 4)
    assert fits[0].converged and fits[0].coef[2] == fits[0].coef[3] == 0 and fits[0].n == 400 and fits[2].n == 100
    assert not fits[1].converged and fits[1].n == 0
    # Separated classes without a penalty never settle, and say so.
    apart = spark.createDataFrame([(i, int(i > 9), float(i)) for i in range(20)], "id long, y int, x double")
    here = B.vectors(apart, ["x"], "id", "y").withColumn("members", F.array(B.member(F.lit(0))))
    assert not fit_logistic_batch(here, {0: Spec((0,), 0.0)}, 1, max_iter=12)[0].converged
    assert fit_logistic_batch(here.filter("id < 0"), {0: Spec((0,), 0.1)}, 1)[0].n == 0


def test_nested_folds_match_a_loop(spark, rows):
    grid = [{"regParam": 0.01}, {"regParam": 0.3}, {"regParam": 5.0}]
    out = B.nested_cv_batch(rows, "LR_L2", FEATURES[:3], grid, k=3, inner=2, seed=4, extra=["d"])
    folds = {r.id: r.fold for r in out["oof"].collect()}
    assert len(folds) == 400 and out["trials"].count() == 9
    best = {r.fold: float(r.value) for r in out["params"].collect()}
    tops = out["trials"].groupBy("fold").agg(F.max_by("trial", F.struct("inner_auroc", -F.col("trial"))).alias("t")).collect()
    assert best == {r.fold: grid[r.t]["regParam"] for r in tops}
    model = single(rows.filter(F.col("id").isin([i for i, f in folds.items() if f != 1])), "LR_L2", FEATURES, regParam=best[1])
    want = {r.id: r.y_prob for r in M.score(rows, model).collect()}
    assert all(abs(r.y_prob - want[r.id]) < 1e-6 for r in out["oof"].filter("fold = 1").collect())
    assert out["importance"].filter("fold = 1 AND converged").count() == 5
    half = B.nested_cv_batch(rows, "LR_L2", FEATURES, [*grid, {"regParam": 50.0}], k=2, inner=3, halving=True)
    used = sorted(r.folds_used for r in half["trials"].filter("fold = 0").collect())
    assert used == [1, 1, 2, 3]
    again = B.nested_cv_batch(rows.repartition(7), "LR_L2", FEATURES, [*grid, {"regParam": 50.0}], k=2, inner=3, halving=True)
    assert sorted(map(tuple, half["params"].select("fold", "value").collect())) == sorted(map(tuple, again["params"].select("fold", "value").collect()))


def test_search_space_fills_the_ranges():
    points = B.search_space("LR_EN", 64, seed=3)
    logs = sorted(np.log10(p["regParam"]) for p in points)
    assert points == B.search_space("LR_EN", 64, seed=3) and points != B.search_space("LR_EN", 64, seed=4)
    assert -4 <= logs[0] < -3.8 and 1.8 < logs[-1] <= 2 and max(np.diff(logs)) < 0.3
    assert all(3 <= p["maxDepth"] <= 12 and isinstance(p["maxDepth"], int) for p in B.search_space("RF", 40))


def test_elimination_follows_single_refits(spark, rows):
    train, val = rows.filter("part < 3"), rows.filter("part >= 3")
    out = I.recursive_elimination(train, val, "LR_L2", FEATURES, 2, cv_folds_=2, regParam=0.02)
    first = single(train, "LR_L2", FEATURES, regParam=0.02).stages[-1].coefficients.toArray()
    ranks = {r.feature: r.elimination_rank for r in out["ranking"].collect()}
    assert ranks[FEATURES[int(np.argmin(np.abs(first)))]] == 1 and sorted(v for v in ranks.values() if v) == [1, 2]
    sizes = {r.size: r for r in out["curve"].collect()}
    assert sorted(sizes) == [2, 4] and all(r.auroc_cv is not None and r.auroc_val > 0.5 for r in sizes.values())
    drop = I.drop_column_importance(train, val, "LR_L2", FEATURES, [["a"], ["b"], ["c"], ["c", "c"]], regParam=0.02).collect()
    assert sorted(r["rank"] for r in drop)[-1] == 3 and len({r["rank"] for r in drop if r.cluster.startswith("c")}) == 1


def test_factorial_cells(spark, rows):
    df = rows.withColumn("outcome", F.when(F.col("y") == 0, "Controls").when(F.col("id") % 2 == 0, "Incident").otherwise("Prevalent"))
    design = spark.createDataFrame([("p", 1, 20, 2, 0.5), ("q", 2, 20, 4, 0.5)], "cell string, seed int, n_cases int, ratio int, prevalent_frac double")
    scored, weights = B.factorial_batch(df.filter("part < 4"), design, df.filter("part = 4"), {"LR_L2": {}, "LR_L1": {"regParam": 0.05}}, FEATURES)
    assert scored.count() == 4 * df.filter("part = 4").count() and weights.count() == 16
    report = B.case_type_report(scored, ["cell", "model"]).collect()
    assert len(report) == 12 and all((r.auroc is None) == (r.outcome == "Controls") for r in report)


def max_min(points):
    """Isotonic fit by its max-min formula; points (p, pos, n) in order."""
    out = []
    for i in range(len(points)):
        best = -1.0
        for a in range(i + 1):
            least = min(sum(q[1] for q in points[a : b + 1]) / sum(q[2] for q in points[a : b + 1]) for b in range(i, len(points)))
            best = max(best, least)
        out.append(best)
    return out


@pytest.mark.parametrize("range_rows", [1_000_000, 7])
def test_isotonic_equals_its_formula(spark, range_rows):
    rng = np.random.default_rng(2)
    data = []
    for g, n, grid in (("x", 300, 40), (None, 90, 1000), ("down", 200, 30), ("few", 20, 10), ("one", 80, 30)):
        p = np.round(rng.random(n) * grid) / grid
        y = (rng.random(n) < (1 - p if g == "down" else p**2)).astype(int) * (g != "one")
        data += [(g, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(data, "g string, id int, y_true int, y_prob double")
    cal = C.fit_isotonic(df, ["g"], range_rows=range_rows)
    for g in ("x", None, "down"):
        hist = {}
        for k, _, a, b in data:
            if k == g:
                pos, n = hist.get(b, (0, 0))
                hist[b] = (pos + a, n + 1)
        points = [(b, *hist[b]) for b in sorted(hist)]
        blocks = cal.filter(F.col("g").eqNullSafe(F.lit(g))).orderBy("lo").collect()
        for (b, _, _), want in zip(points, max_min(points)):
            [hit] = [r for r in blocks if r.lo <= b <= r.hi]
            assert abs(hit.value - want) < 1e-12
        assert all(a.value < b.value and a.next_lo == b.lo and a.next_value == b.value for a, b in zip(blocks, blocks[1:]))
    for limit in (None, 5):
        done = C.apply_isotonic(df, cal, ["g"], limit=limit).collect()
        assert len(done) == len(data) and all(r.y_prob_calibrated == r.y_prob for r in done if r.g in ("few", "one"))
    ask = spark.createDataFrame([("x", v) for v in (-1.0, 0.01, 0.5, 0.512, 2.0, None, float("nan"))], "g string, y_prob double")
    got = {r.y_prob: r.y_prob_calibrated for r in C.apply_calibrator(ask, C.fit_calibrator(df, "isotonic", ["g"]), ["g"]).collect()}
    blocks = cal.filter("g = 'x'").orderBy("lo").collect()
    assert got[-1.0] == blocks[0].value and got[2.0] == blocks[-1].value and got[None] is None
    x = [v for r in blocks for v in (r.lo, r.hi)]
    assert abs(got[0.512] - np.interp(0.512, x, [r.value for r in blocks for _ in (0, 1)])) < 1e-12


@pytest.mark.parametrize("limit", [None, 3])
def test_dense_rank_with_missing_values_last(spark, limit):
    rows = [("g", 2.0), ("g", None), ("g", 2.0), ("g", 1.0), ("g", float("nan")), (None, 5.0), (None, 7.0), (None, 7.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted((r.g or "", -1.0 if r.v is None or r.v != r.v else r.v, r["rank"]) for r in dense_rank(df, ["g"], "v", limit=limit).collect())
    assert got == [("", -1.0, 3), ("", 5.0, 2), ("", 7.0, 1), ("", 7.0, 1), ("g", -1.0, 3), ("g", -1.0, 3), ("g", 1.0, 2), ("g", 2.0, 1), ("g", 2.0, 1)]
    up = {r.v: r["rank"] for r in dense_rank(df.filter("g = 'g' AND v >= 1 AND NOT isnan(v)"), [], "v", ascending=True, limit=limit).collect()}
    assert up == {1.0: 1, 2.0: 2}
