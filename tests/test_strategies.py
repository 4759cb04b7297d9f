"""Calibration strategies: the registry, the rule of once only, averaged fold calibrators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import calibration as C
from riskspark.operators import calibration_strategy as S


@pytest.fixture(scope="module")
def oof(spark):
    rng = np.random.default_rng(8)
    rows = []
    for model in ("LR_EN", "RF", "LinSVM_cal"):
        z = rng.normal(size=300)
        y = (rng.random(300) < 1 / (1 + np.exp(-z))).astype(int)
        rows += [(model, i, i % 3, int(a), float(1 / (1 + np.exp(-2 * b - 1)))) for i, (a, b) in enumerate(zip(y, z))]
    return spark.createDataFrame(rows, "model string, id int, fold int, y_true int, y_prob double").cache()


def test_strategies_and_their_limits():
    assert S.strategy_for("RF", "oof_posthoc", "beta") == S.OofPosthoc("beta")
    assert S.strategy_for("RF", "per_fold", "beta", 3) == S.PerFold("sigmoid", 3)
    assert S.strategy_for("RF", "per_fold").label() == "isotonic (per_fold)"
    assert S.strategy_for("RF", "oof_posthoc", overrides={"RF": "none"}).label() == "none"
    assert all(S.strategy_for(None, n).skips("LinSVM_cal") for n in S.STRATEGIES) and not S.OofPosthoc().skips("LR_EN")
    for wrong in (lambda: S.OofPosthoc("sigmoid"), lambda: S.PerFold("beta"), lambda: S.PerFold("isotonic", 1), lambda: S.strategy_for("RF", "other")):
        with pytest.raises(ValueError):
            wrong()


def test_nothing_is_calibrated_twice(oof):
    once = S.calibrate(oof, oof, "oof_posthoc", "logistic_full")
    got = {r.model: (r.n, r.moved) for r in once.groupBy("model").agg(F.count_distinct("calibrated_by").alias("n"), F.max(F.abs(F.col("y_prob") - F.col("y_prob_calibrated"))).alias("moved")).collect()}
    assert got["LinSVM_cal"] == (0, 0.0) and got["RF"][0] == 1 and got["RF"][1] > 0.05
    marked = once.drop("y_prob").withColumnRenamed("y_prob_calibrated", "y_prob")
    again = S.calibrate(oof, marked, "oof_posthoc", "logistic_full")
    assert again.count() == once.count() and again.filter("y_prob <> y_prob_calibrated").count() == 0
    assert S.calibrate(oof, oof, "none").filter("calibrated_by IS NOT NULL OR y_prob <> y_prob_calibrated").count() == 0


def test_fold_calibrators_are_averaged(oof):
    # Each subject scored by the base models of all three folds.
    scored = oof.drop("fold").withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(3)]))).withColumn("y_prob", F.col("y_prob") * (1 - 0.1 * F.col("fold")))
    got = S.calibrate(oof, scored, "per_fold", "sigmoid", keys=["model"])
    cal = C.fit_calibrator(oof.filter("model <> 'LinSVM_cal'"), "logistic_full", ["model", "fold"])
    want = C.apply_calibrator(scored.filter("model <> 'LinSVM_cal'"), cal, ["model", "fold"]).groupBy("model", "id").agg(F.avg("y_prob_calibrated").alias("w"))
    both = got.filter("model <> 'LinSVM_cal'").join(want, ["model", "id"])
    assert both.count() == 600 and both.filter(F.abs(F.col("w") - F.col("y_prob_calibrated")) > 1e-12).count() == 0


def test_ensemble_scores_are_calibrated(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 2))
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(900)], "id int, y int, a double, b double")
    # A far too strong penalty makes raw scores flat.
    out = S.calibrated_ensemble(df.filter("id < 600"), df.filter("id >= 600"), "LR_L2", ["a", "b"], S.PerFold("sigmoid", 4), regParam=5.0)
    line = {c: C.calibration_line(out.withColumnRenamed("y", "y_true"), p=c).first().slope for c in ("y_prob", "y_prob_calibrated")}
    assert out.count() == 300 and line["y_prob"] > 3 and 0.5 < line["y_prob_calibrated"] < 1.6
    assert S.effective_folds(df.filter("y = 0 OR id < 5"), 5) <= 5 and S.effective_folds(df.filter("y = 0"), 5) == 2


def test_a_strategy_of_ones_own(oof):
    class Half(S.NoCalibration):
        def skips(self, model):
            return False

        def label(self):
            return "half"

        def fit(self, rows, *args):
            return rows.limit(1)

        def apply(self, scored, calibrators, keys, fold, p):
            return scored.withColumn("y_prob_calibrated", F.col(p) / 2)

    S.register_strategy("half", lambda method=None, folds=0: Half())
    try:
        out = S.calibrate(oof, oof, "half")
        assert out.filter("calibrated_by = 'half' AND y_prob_calibrated = y_prob / 2").count() == 900
    finally:
        del S.STRATEGIES["half"]
