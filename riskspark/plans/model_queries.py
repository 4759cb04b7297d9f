"""Queries that fit models with Spark ML on the whole subject table, and score exports."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..core.order import hash_order

from ..core.irls import fit_logistic_batch, score_batch
from ..core.session import cut_lineage
from ..operators import batched as B
from ..operators import importance as I
from ..operators import models as M
from ..sources import tables as S
from .evaluate import evaluate_split, holdout_report, with_target_prevalence
from .inference_queries import CELLS, cells
from .metrics_queries import ADJ, adjusted
from .registry import query
from .tables import FEATURES, RUNS, SCORED, SUBJECTS, runs, scored, subjects, table

FAST = {"maxIter": 20}


def labelled(spark, sf):
    """Subjects with label y, complete numeric covariates and a fixed train/test mark."""
    s = subjects(spark, sf).withColumn("y", (F.col("outcome") != "Controls").cast("int"))
    return s.withColumn("part", F.when(hash_order("part", "id") % 10 < 7, "train").otherwise("test"))


def parts_of(spark, sf):
    # the fits read their rows many times, and the texts behind them once
    rows = cut_lineage(labelled(spark, sf))
    return rows.filter("part = 'train'"), rows.filter("part = 'test'")


@query("fit_learners")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    out = []
    for name, p in (("LR_EN", FAST), ("LR_L1", FAST), ("LR_L2", FAST), ("RF", {"numTrees": 10, "maxDepth": 4}), ("GBT", {"maxIter": 4, "maxDepth": 3})):
        m = M.build_pipeline(name, FEATURES, ["age", "bmi"], ["sex"], **p).fit(train)
        out.append(M.score(test, m, ("id", "y"), 0.25, 0.05).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


@query("one_hot_lang", "SELECT doc_id AS id, (SELECT count(DISTINCT lang) - 1 FROM documents) AS width, dense_rank() OVER (ORDER BY lang) - 1 AS hot FROM documents")
def _(spark, sf):
    """Encoded columns of a category: how many there are, and which one is 1 (0: none, the first level)."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    cells = vector_to_array("lang__h")
    out = M.DropFirstEncoder(["lang"]).fit(docs).transform(docs)
    return out.select(F.col("doc_id").alias("id"), F.size(cells).cast("long").alias("width"), F.array_position(cells, F.lit(1.0)).alias("hot"))


@query("svm_calibrated")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    return M.score_svm(test, M.fit_svm_calibrated(train, FEATURES, 2, maxIter=10))


@query("prevalence_stage", f"WITH {SCORED} SELECT id, model, 1e0 / (1e0 + exp(-(ln(least(greatest(y_prob, 1e-9), 1e0 - 1e-9) / (1e0 - least(greatest(y_prob, 1e-9), 1e0 - 1e-9))) + ln(0.01e0 / 0.99e0) - ln(0.2e0 / 0.8e0)))) AS y_prob_adjusted FROM scored", "y_prob_adjusted")
def _(spark, sf):
    return M.PrevalenceAdjuster(0.2, 0.01).transform(scored(spark, sf)).select("id", "model", "y_prob_adjusted")


@query("nested_cv_oof")
def _(spark, sf):
    out = M.nested_cv_oof(labelled(spark, sf), "LR_L2", FEATURES, [{"regParam": 0.01, **FAST}, {"regParam": 0.5, **FAST}], k=2, inner=2, select=4, weight_scheme="log")
    return out["oof"]


@query("nested_cv_search")
def _(spark, sf):
    """Nine drawn settings, halved after each inner fold, and what each outer fold went through."""
    return M.nested_cv_oof(labelled(spark, sf), "LR_EN", FEATURES, 9, k=2, inner=3, halving=True)["trials"]


@query("batched_fit_balance", f"""WITH {SUBJECTS}, y AS (SELECT id, CASE WHEN outcome <> 'Controls' THEN 1 ELSE 0 END AS y FROM subjects), f AS (SELECT unnest(range(3)) AS fold)
    SELECT cast(fold AS int) AS fold, count(*) AS n, avg(y) AS observed, avg(y) AS predicted FROM y JOIN f ON y.id % 3 <> f.fold GROUP BY ALL""", "observed predicted")
def _(spark, sf):
    """A settled fit predicts the observed share on its own training rows; three training sets in one batch."""
    others = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda f: f != F.col("id") % 3)
    rows = B.vectors(labelled(spark, sf), FEATURES, "id", "y")
    rows = rows.withColumns({"members": F.transform(others, lambda f: B.member(f)), "targets": F.transform(others, lambda f: f.cast("int"))})
    fits = fit_logistic_batch(rows, {f: B.spec_of("LR_EN", range(len(FEATURES)), regParam=0.02) for f in range(3)}, len(FEATURES))
    scored = score_batch(rows, fits, len(FEATURES), ["y"])
    return scored.groupBy(F.col("model").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("observed"), F.avg("y_prob").alias("predicted"))


@query("factorial_report")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    design = spark.createDataFrame([("a", 1, 15, 2, 0.5), ("b", 1, 15, 4, 0.5)], "cell string, seed int, n_cases int, ratio int, prevalent_frac double")
    return B.case_type_report(B.factorial_batch(train, design, test, {"LR_L2": {}, "LR_L1": {}}, FEATURES)[0], ["cell", "model"])


@query("calibrated_ensemble")
def _(spark, sf):
    from ..operators.calibration_strategy import PerFold, calibrated_ensemble

    train, test = parts_of(spark, sf)
    return calibrated_ensemble(train, test, "LR_L2", FEATURES, PerFold("sigmoid", 3), regParam=0.02)


@query("stacking")
def _(spark, sf):
    s = scored(spark, sf)
    names = ["repeat", "symbol", "brevity"]
    st = M.stack_fit(s.filter("split = 'TRAIN'"), names, True, "logistic_full")
    return M.stack_predict(st, s.filter("split <> 'TRAIN'"))


@query("ensemble_holdout")
def _(spark, sf):
    return M.ensemble_holdout(scored(spark, sf), ["repeat", "symbol", "brevity"], F.col("split") != "TEST", F.col("split") == "TEST")


@query("average_ensemble", f"WITH {SCORED} SELECT id, y_true, avg(y_prob) AS y_prob FROM scored GROUP BY ALL", "y_prob")
def _(spark, sf):
    return M.average_ensemble(scored(spark, sf))


@query("oof_mean", f"WITH {SCORED} SELECT split, id, y, avg(y_prob) AS y_prob FROM (SELECT split, id, y_true AS y, y_prob FROM scored) GROUP BY ALL", "y_prob")
def _(spark, sf):
    return M.oof_mean(scored(spark, sf).withColumnRenamed("y_true", "y"), keys=["split"])


@query("linear_importance")
def _(spark, sf):
    train, _ = parts_of(spark, sf)
    return I.linear_importance(spark, [M.build_pipeline("LR_L2", FEATURES, **FAST).fit(train)], FEATURES)


@query("tree_importance")
def _(spark, sf):
    train, _ = parts_of(spark, sf)
    return I.tree_importance(spark, M.build_pipeline("RF", FEATURES, numTrees=10, maxDepth=4).fit(train), FEATURES)


@query("permutation_importance")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    model = M.build_pipeline("LR_L2", FEATURES, **FAST).fit(train)
    return I.permutation_importance(model, test, FEATURES, [["repeat_resid"], ["symbol_resid", "digits_resid"], ["brevity_resid", "lines_resid", "upper_resid"]], 3)


@query("drop_column_importance")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    return I.drop_column_importance(train, test, "LR_L2", FEATURES, [["repeat_resid"], ["symbol_resid", "digits_resid"]], **FAST)


@query("linear_shap")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    model = M.build_pipeline("LR_L2", FEATURES, **FAST).fit(train)
    return I.linear_shap(model, test, train.filter("y = 0"), FEATURES)


@query("background_sensitivity")
def _(spark, sf):
    train, _ = parts_of(spark, sf)
    return I.background_sensitivity(M.build_pipeline("LR_L2", FEATURES, **FAST).fit(train), train, FEATURES, 50)


@query("learning_curve")
def _(spark, sf):
    return M.learning_curve(labelled(spark, sf), "LR_L2", FEATURES, [0.5, 1.0], 2, **FAST)


@query("recursive_elimination")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    return I.recursive_elimination(train, test, "LR_L2", FEATURES, 2, **FAST)["curve"]


@query("rfecv_folds")
def _(spark, sf):
    return I.rfecv_folds(labelled(spark, sf), "LR_L2", FEATURES, 2, 2, inner=2, **FAST)


@query("saturation_sweep")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    return I.saturation_sweep(train, test, {"given": FEATURES, "reversed": FEATURES[::-1]}, [2], k=2, n_boot=40, **FAST)


@query("model_bootstrap_stability")
def _(spark, sf):
    return I.model_bootstrap_stability(labelled(spark, sf), "LR_L2", FEATURES, 3, 3, **FAST)


@query("final_refit")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    return M.final_refit(train, test, "LR_L2", FEATURES, n_boot=60, **FAST)[1]


@query("cv_objective")
def _(spark, sf):
    return M.cv_objective(labelled(spark, sf), FEATURES, 200, 2, **FAST)


@query("run_factorial")
def _(spark, sf):
    train, test = parts_of(spark, sf)
    design = spark.createDataFrame([("a", 1, 15, 2, 0.5), ("b", 1, 15, 4, 0.5)], "cell string, seed int, n_cases int, ratio int, prevalent_frac double")
    out = M.run_factorial(train, design, test, {"LR_L2": FAST}, FEATURES)
    from ..operators.discrimination import discrimination

    return discrimination(out, ["cell", "model"], "y")


@query("meta_calibration_benchmark")
def _(spark, sf):
    from ..operators.splits import repeated_splits

    s = scored(spark, sf)
    subj = s.select("id", F.col("y_true").cast("string").alias("stratum")).distinct()
    return M.meta_calibration_benchmark(s, ["repeat", "symbol", "brevity"], repeated_splits(subj, 0.0, 0.4, 1, 5))


@query("evaluate_split")
def _(spark, sf):
    return evaluate_split(with_target_prevalence(scored(spark, sf), 0.05, ["model"]))


@query("holdout_report")
def _(spark, sf):
    return holdout_report(scored(spark, sf))


# ---------------------------------------------------------------- sources that shape tables
@query("compile_cells", f"""WITH {CELLS}, m AS (SELECT DISTINCT recipe_id, model FROM cells), s AS (SELECT recipe_id, model, max(auroc_mean) AS auroc FROM cells WHERE model <> 'RF' GROUP BY ALL)
    SELECT recipe_id, model, auroc AS summary_auroc FROM m LEFT JOIN s USING (recipe_id, model)""", "summary_auroc")
def _(spark, sf):
    c = cells(spark, sf)
    got = c.filter("model <> 'RF'").groupBy("recipe_id", "model").agg(F.max("auroc_mean").alias("auroc"))
    return S.compile_cells(c.select("recipe_id", "model").distinct(), got, ["recipe_id", "model"])


@query("missing_cells", f"WITH {CELLS} SELECT DISTINCT recipe_id, model FROM cells WHERE model = 'RF'")
def _(spark, sf):
    c = cells(spark, sf)
    return S.missing_cells(c.select("recipe_id", "model").distinct(), c.filter("model <> 'RF'"), ["recipe_id", "model"])


@query("compile_runs", f"WITH {RUNS} SELECT experiment, model, split_seed, auroc, max(auroc) OVER (PARTITION BY experiment, model) AS agg_best FROM runs", "auroc agg_best")
def _(spark, sf):
    r = runs(spark, sf).select("experiment", "model", "split_seed", "auroc")
    return S.compile_runs(r, r.groupBy("experiment", "model").agg(F.max("auroc").alias("best")), ["experiment", "model"])


@query("export_scores", f"WITH {ADJ} SELECT id, y_true, y_prob AS risk_raw, y_adj AS risk_adjusted, y_prob * 100 AS risk_raw_pct, y_adj * 100 AS risk_adjusted_pct, 'adjusted' AS active_variant, y_adj AS risk_score FROM adj", "risk_raw risk_adjusted risk_raw_pct risk_adjusted_pct risk_score")
def _(spark, sf):
    return S.export_scores(adjusted(spark, sf), {"raw": "y_prob", "adjusted": "y_prob_adjusted"}, "adjusted")


@query("splits_differ", f"WITH {SCORED} SELECT DISTINCT id, split_seed AS seed, split, 'new' AS side FROM scored WHERE id % 40 = 0 AND split <> 'TEST' UNION ALL SELECT DISTINCT id, split_seed, 'TEST', 'stored' FROM scored WHERE id % 40 = 0 AND split <> 'TEST'")
def _(spark, sf):
    a = scored(spark, sf).select("id", F.col("split_seed").alias("seed"), "split").distinct()
    b = a.withColumn("split", F.when(F.col("id") % 40 == 0, "TEST").otherwise(F.col("split")))
    return S.splits_differ(a, b)


@query("params_wide", "SELECT o_orderpriority AS model, o_orderkey AS trial_num, cast(o_custkey % 11 AS varchar) AS depth, o_orderstatus AS loss FROM orders")
def _(spark, sf):
    from .tables import trials

    return S.params_wide(trials(spark, sf), ["depth", "loss"], ["model", "trial_num"])
