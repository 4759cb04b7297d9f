"""Model layer: invariants on a small cohort with planted signal."""

import pytest
from pyspark.sql import functions as F

from riskspark.operators import importance as I
from riskspark.operators import models as M
from riskspark.operators.discrimination import auroc
from riskspark.operators.stages import CurveEvaluator, FeatureScreen, register_metric
from riskspark.plans.evaluate import evaluate_split

FEATURES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def cohort(spark):
    u = lambda s: F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(10007)) / 10007.0
    df = spark.range(400).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("noise"), F.when(F.col("id") % 7 == 0, "x").otherwise("z").alias("sex"), u(4).alias("r"))
    return df.withColumn("y", (F.col("r") < F.lit(0.05) + 0.8 * F.col("a") * F.col("b")).cast("int")).drop("r").cache()


def test_logistic_beats_chance_and_importance_sums_to_one(spark, cohort):
    m = M.build_pipeline("LR_L2", FEATURES, categorical=["sex"], maxIter=30).fit(cohort)
    s = M.score(cohort, m)
    assert auroc(s, [], "y").first().auroc > 0.65
    imp = {r.feature: r.importance for r in I.linear_importance(spark, [m], FEATURES).collect()}
    assert imp["noise"] < min(imp["a"], imp["b"]) and sum(imp.values()) <= 1.0 + 1e-9


def test_linear_shap_adds_up_to_the_margin(spark, cohort):
    m = M.build_pipeline("LR_L2", FEATURES, maxIter=30).fit(cohort)
    total = I.linear_shap(m, cohort, cohort, FEATURES).groupBy("id").agg(F.sum("shap").alias("s"))
    raw = m.transform(cohort).select("id", M.vector_to_array("rawPrediction")[1].alias("z"))
    d = raw.join(total, "id").select((F.col("z") - F.col("s")).alias("d")).agg(F.stddev_pop("d").alias("sd")).first()
    assert d.sd < 1e-9


def test_permutation_importance_ranks_noise_last(cohort):
    m = M.build_pipeline("LR_L2", FEATURES, maxIter=30).fit(cohort)
    got = I.permutation_importance(m, cohort, FEATURES, repeats=3).orderBy("rank").collect()
    assert got[-1].feature == "noise" and got[0].n_repeats == 3


def test_elimination_drops_noise_first(cohort):
    out = I.recursive_elimination(cohort.filter("id % 2 = 0"), cohort.filter("id % 2 = 1"), "LR_L2", FEATURES, 1, "linear", cv_folds_=2, maxIter=20)
    first = out["ranking"].filter("elimination_rank = 1").first()
    assert first.feature == "noise"
    assert sorted(r.size for r in out["curve"].collect()) == [1, 2, 3] and "auroc_cv" in out["curve"].columns


@pytest.mark.parametrize("strategy, want", [("linear", [6, 5, 4, 3, 2]), ("geometric", [6, 3, 2]), ("fine", [6, 4, 3, 2])])
def test_eval_sizes(strategy, want):
    assert I.eval_sizes(6, 2, strategy) == want


def test_nested_folds_score_every_row_once(cohort):
    out = M.nested_cv_oof(cohort, "LR_L2", FEATURES, [{"maxIter": 10}], k=2, repeats=2)
    assert out["oof"].count() == 800 and out["oof"].select("id", "repeat").distinct().count() == 800
    assert M.oof_mean(out["oof"]).count() == 400 and out["calibrator"].first().fitted


def test_stack_matrix_reports_missing_and_mismatch(spark):
    rows = [(1, 0, "m", 0.1), (1, 0, "k", 0.2), (2, 1, "m", 0.3), (3, 1, "m", 0.4), (3, 0, "k", 0.5)]
    s = spark.createDataFrame(rows, "id int, y_true int, model string, y_prob double")
    assert {r.id for r in M.stack_violations(s, 2).collect()} == {2, 3}


def test_evaluator_screen_and_custom_metric(cohort):
    m = M.build_pipeline("LR_L2", FEATURES, maxIter=20).fit(cohort)
    scored = m.transform(cohort)
    ev = CurveEvaluator("auroc").evaluate(scored)
    assert abs(ev - auroc(M.score(cohort, m), [], "y").first().auroc) < 1e-12
    register_metric("n_scores", lambda: F.count(F.lit(1)).cast("double"))
    assert CurveEvaluator("n_scores").evaluate(scored) > 100
    kept = FeatureScreen(FEATURES, "f_classif", top=2).fit(cohort)
    assert set(kept.kept) == {"a", "b"} and "noise" not in kept.transform(cohort).columns


def test_threshold_comes_from_validation_rows_only(spark, cohort):
    rows = cohort.select("id", F.col("y").alias("y_true"), F.col("a").alias("y_prob"), F.lit("m").alias("model"), F.when(F.col("id") % 2 == 0, "VAL").otherwise("TEST").alias("split"))
    one = evaluate_split(rows).first().threshold
    moved = rows.withColumn("y_prob", F.when(F.col("split") == "TEST", F.col("y_prob") / 2).otherwise(F.col("y_prob")))
    assert evaluate_split(moved).first().threshold == one
