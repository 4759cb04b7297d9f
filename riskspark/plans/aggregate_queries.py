"""Queries over result tables: summaries, stability, importances, curves, window idioms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.keys import join_on
from ..core.order import average_rank, dense_rank
from ..operators import aggregate as A
from .registry import query
from .tables import CURVES, IMP, LINES, RUNS, SCORED, TRIALS, curves, importances, points_sql, runs, scored, scored_lines, table, trials
from .tables import AUROC, PRAUC, YOUDEN, sens_sql

EM = ["experiment", "model"]


def stats_sql(c: str, name: str | None = None) -> str:
    n = name or c
    half = f"1.96e0 * stddev_samp({c}) / sqrt(count({c}))"
    return f"avg({c}) AS {n}_mean, stddev_samp({c}) AS {n}_std, avg({c}) - {half} AS {n}_ci_lo, avg({c}) + {half} AS {n}_ci_hi"


@query("summary_stats", f"WITH {RUNS} SELECT experiment, model, count(*) AS n_splits, {stats_sql('auroc')}, {stats_sql('brier')} FROM runs GROUP BY ALL",
       "auroc_mean auroc_std auroc_ci_lo auroc_ci_hi brier_mean brier_std brier_ci_lo brier_ci_hi")
def _(spark, sf):
    return A.summary_stats(runs(spark, sf), ["auroc", "brier"], EM)


@query("summary_long", f"""WITH {RUNS} SELECT 'auroc' AS metric, avg(auroc) AS mean, stddev_samp(auroc) AS std, min(auroc) AS min, max(auroc) AS max, count(auroc) AS n FROM runs
    UNION ALL SELECT 'auprc', avg(auprc), stddev_samp(auprc), min(auprc), max(auprc), count(auprc) FROM runs""", "mean std min max")
def _(spark, sf):
    return A.summary_long(runs(spark, sf), ["auroc", "auprc"])


STAB = f"""WITH {IMP}, stab AS (SELECT model, feature, n_selected, n_splits, n_selected / n_splits AS selection_fraction, n_selected / n_splits >= 0.3e0 AS is_stable FROM
  (SELECT model, feature, count(DISTINCT split_seed) AS n_selected FROM imp WHERE selected GROUP BY ALL) JOIN (SELECT model, count(DISTINCT split_seed) AS n_splits FROM imp GROUP BY ALL) USING (model))"""


def stability(spark, sf):
    i = importances(spark, sf)
    return A.feature_stability(i.filter("selected"), 0.3, ["model"], splits=i)


@query("feature_stability", f"{STAB} SELECT * FROM stab", "selection_fraction")
def _(spark, sf):
    return stability(spark, sf)


@query("feature_report", f"""WITH {IMP}, a AS (SELECT model, feature, avg(selection_freq) AS freq_mean, stddev_samp(selection_freq) AS freq_std, min(selection_freq) AS freq_min, max(selection_freq) AS freq_max,
      count(*) AS n, avg(effect) AS effect_mean, stddev_samp(effect) AS effect_std, avg(p_value) AS p_mean, stddev_samp(p_value) AS p_std FROM imp GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY freq_mean DESC, feature) AS rank FROM a""",
       "freq_mean freq_std freq_min freq_max effect_mean effect_std p_mean p_std")
def _(spark, sf):
    return A.feature_report(importances(spark, sf))


@query("screening_summary", f"WITH {IMP} SELECT model, feature, count(*) AS n_seeds, avg(effect) AS effect_mean, stddev_samp(effect) AS effect_std, avg(p_value) AS p_value_mean, stddev_samp(p_value) AS p_value_std FROM imp GROUP BY ALL",
       "effect_mean effect_std p_value_mean p_value_std")
def _(spark, sf):
    return A.mean_std_by(importances(spark, sf), ["model", "feature"], ["effect", "p_value"])


PARAMS = f"WITH {TRIALS}, params AS (SELECT model, split_id, trial_num, 'depth' AS param, json_extract_string(params, '$.depth') AS value FROM trials UNION ALL SELECT model, split_id, trial_num, 'loss', json_extract_string(params, '$.loss') FROM trials)"


def params_long(spark, sf):
    from ..sources.tables import flatten_params

    return flatten_params(trials(spark, sf).select("model", "split_id", "trial_num", "params"))


@query("flatten_params", f"{PARAMS} SELECT * FROM params")
def _(spark, sf):
    return params_long(spark, sf)


@query("params_summary", f"""{PARAMS}, v AS (SELECT model, param, value, count(*) AS k FROM params GROUP BY ALL)
    SELECT model, param, cast(sum(k) AS bigint) AS n, CASE WHEN param = 'depth' THEN sum(k * try_cast(value AS double)) / sum(k) END AS mean,
      CASE WHEN param = 'depth' THEN (SELECT stddev_samp(cast(p.value AS double)) FROM params p WHERE p.model = v.model AND p.param = 'depth') END AS std,
      CASE WHEN param = 'depth' THEN min(try_cast(value AS double)) END AS min, CASE WHEN param = 'depth' THEN max(try_cast(value AS double)) END AS max,
      CASE WHEN param = 'loss' THEN min({{'k': -k, 'v': value}})['v'] END AS mode, CASE WHEN param = 'loss' THEN count(*) END AS n_unique,
      CASE WHEN param = 'loss' THEN string_agg(value, ',' ORDER BY value) END AS values FROM v GROUP BY model, param""", "mean std min max")
def _(spark, sf):
    return A.params_summary(params_long(spark, sf))


ZERO = """SELECT {keys}, feature, sum({v}) / nf AS mean_importance, CASE WHEN nf > 1 THEN sqrt((sum(({v} - m) * ({v} - m)) + (nf - count(*)) * max(m) * max(m)) / (nf - 1)) END AS std_importance,
  count(CASE WHEN {v} > 0 THEN 1 END) AS n_folds_nonzero, nf AS n_folds FROM (SELECT *, sum({v}) OVER (PARTITION BY {keys}, feature) / nf AS m FROM
  (SELECT s.*, (SELECT count(DISTINCT {fold}) FROM {src} z WHERE z.model = s.model) AS nf FROM {src} s)) GROUP BY {keys}, feature, nf"""
IMPZ = f"WITH {IMP}, zz AS ({ZERO.format(keys='model', v='importance', fold='split_seed', src='imp')})"


@query("importance_over_folds", f"{IMPZ} SELECT * FROM zz", "mean_importance std_importance")
def _(spark, sf):
    return A.importance_over_folds(importances(spark, sf), ["model"], "split_seed")


@query("importance_across_splits", f"{IMPZ} SELECT *, n_folds_nonzero / n_folds AS stability, row_number() OVER (PARTITION BY model ORDER BY mean_importance DESC, feature) AS rank FROM zz", "mean_importance std_importance stability")
def _(spark, sf):
    return A.importance_across_splits(importances(spark, sf), ["model"], "split_seed")


CLUS = """clus AS (SELECT l_returnflag AS model, l_linenumber AS fold, 's' || l_suppkey AS feature, max(l_extendedprice) / 1e5 AS importance,
  CASE WHEN l_suppkey % 3 = 0 THEN ['s' || l_suppkey, 't' || l_suppkey] END AS cluster_features FROM lineitem GROUP BY ALL)"""


def cluster_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.col("l_suppkey").cast("string")
    return li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold"), "l_suppkey").agg((F.max("l_extendedprice") / 1e5).alias("importance")).select(
        "model", "fold", F.concat(F.lit("s"), s).alias("feature"), "importance", F.when(F.col("l_suppkey") % 3 == 0, F.array(F.concat(F.lit("s"), s), F.concat(F.lit("t"), s))).alias("cluster_features")
    )


@query("grouped_importance_over_folds", f"""WITH {CLUS}, sp AS (SELECT model, fold, unnest(coalesce(cluster_features, [feature])) AS feature, importance / len(coalesce(cluster_features, [feature])) AS importance FROM clus),
    zz AS ({ZERO.format(keys='model', v='importance', fold='fold', src='sp')}) SELECT * FROM zz""", "mean_importance std_importance")
def _(spark, sf):
    return A.importance_over_folds(cluster_rows(spark, sf))


@query("cluster_importance_over_folds", f"""WITH {CLUS}, a AS (SELECT model, array_to_string(list_sort(cluster_features), '|') AS cluster, avg(importance) AS mean_importance, stddev_samp(importance) AS std_importance, count(DISTINCT fold) AS n_folds
    FROM clus WHERE cluster_features IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_importance DESC, cluster) AS rank FROM a""", "mean_importance std_importance")
def _(spark, sf):
    return A.cluster_importance_over_folds(cluster_rows(spark, sf).filter("cluster_features IS NOT NULL"))


SHAP = """shap AS (SELECT l_returnflag AS model, l_linenumber AS fold, 's' || l_suppkey AS feature, (l_discount - 0.05e0) * l_quantity AS shap, l_linestatus FROM lineitem)"""


def shap_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("feature"), ((F.col("l_discount") - F.lit(0.05)) * F.col("l_quantity")).alias("shap"), "l_linestatus")


@query("shap_over_folds", f"""WITH {SHAP}, f AS (SELECT model, fold, feature, avg(abs(shap)) AS v FROM shap GROUP BY ALL),
    g AS (SELECT a.model, a.feature, b.fold, coalesce(f.v, 0e0) AS v FROM (SELECT DISTINCT model, feature FROM f) a JOIN (SELECT DISTINCT model, fold FROM f) b USING (model) LEFT JOIN f ON f.model = a.model AND f.feature = a.feature AND f.fold = b.fold)
    SELECT model, feature, avg(v) AS mean_abs_shap, stddev_samp(v) AS std_abs_shap, median(v) AS median_abs_shap, count(CASE WHEN v > 0 THEN 1 END) AS n_folds_nonzero, count(*) AS n_folds FROM g GROUP BY ALL""",
       "mean_abs_shap std_abs_shap median_abs_shap")
def _(spark, sf):
    return A.shap_over_folds(shap_rows(spark, sf))


@query("shap_across_splits", f"""WITH {IMP}, n AS (SELECT model, count(DISTINCT split_seed) AS n_splits FROM imp GROUP BY ALL),
    a AS (SELECT model, feature, list_reduce(list_sort(list(effect)), lambda x, y: x + y) / count(effect) AS mean, stddev_samp(effect) AS std, count(DISTINCT split_seed) AS n_present, n_splits, count(DISTINCT split_seed) / n_splits AS stability
      FROM imp JOIN n USING (model) WHERE effect IS NOT NULL GROUP BY model, feature, n_splits)
    SELECT *, cast(row_number() OVER (PARTITION BY model ORDER BY mean DESC, feature) AS int) AS rank_pooled, cast(rank() OVER (PARTITION BY model ORDER BY mean * stability DESC) AS int) AS rank_stability FROM a""",
       "mean std stability")
def _(spark, sf):
    return A.shap_across_splits(importances(spark, sf), value="effect")


@query("shap_metadata_summary", f"WITH {SHAP} SELECT model, fold, count(*) AS n_rows, count(DISTINCT feature) AS n_feature, count(DISTINCT l_linestatus) AS n_l_linestatus FROM shap GROUP BY ALL")
def _(spark, sf):
    return A.metadata_counts(shap_rows(spark, sf), ["model", "fold"], ["feature", "l_linestatus"])


@query("feature_overlap_ratio", f"""WITH {IMP}, a AS (SELECT model, feature, count(DISTINCT split_seed) AS k FROM imp GROUP BY ALL), n AS (SELECT model, count(DISTINCT split_seed) AS n FROM imp GROUP BY ALL)
    SELECT model, count(CASE WHEN k = n THEN 1 END) AS n_common, count(*) AS n_union, count(CASE WHEN k = n THEN 1 END) / count(*) AS overlap FROM a JOIN n USING (model) GROUP BY ALL""", "overlap")
def _(spark, sf):
    return A.feature_overlap_ratio(importances(spark, sf), ["model"])


DROPC = """dropc AS (SELECT l_returnflag AS model, 'c' || l_suppkey AS cluster, l_linenumber AS fold, CASE WHEN count(*) % 5 <> 0 THEN max(l_discount) - 0.097e0 END AS delta_auroc, min(l_discount) + 0.004e0 AS delta_retuned FROM lineitem GROUP BY ALL)"""


def drop_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("model"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("cluster"), F.col("l_linenumber").alias("fold")).agg(
        F.when(F.count(F.lit(1)) % 5 != 0, F.max("l_discount") - 0.097).alias("delta_auroc"), (F.min("l_discount") + 0.004).alias("delta_retuned")
    )


@query("drop_column_over_folds", f"""WITH {DROPC}, a AS (SELECT model, cluster, median(delta_auroc) AS delta, stddev_samp(delta_auroc) AS std, min(delta_auroc) AS min, max(delta_auroc) AS max, count(delta_auroc) AS n_folds,
      count(*) - count(delta_auroc) AS n_errors, avg(delta_retuned) AS retuned FROM dropc GROUP BY ALL) SELECT *, coalesce(abs(delta) < 0.005e0 AND retuned > 0.005e0, false) AS compensated FROM a""", "delta std min max retuned")
def _(spark, sf):
    return A.drop_column_over_folds(drop_rows(spark, sf), "median")


@query("cross_model_essentiality", f"""WITH {DROPC}, d AS (SELECT cluster, model, max(delta_auroc) AS delta FROM dropc GROUP BY ALL)
    SELECT cluster, max(CASE WHEN model = 'A' THEN delta END) AS delta_A, max(CASE WHEN model = 'N' THEN delta END) AS delta_N, max(CASE WHEN model = 'R' THEN delta END) AS delta_R,
      count(delta) AS n_models, avg(delta) AS mean_delta, stddev_samp(delta) AS std_delta, max(delta) AS max_delta, min(delta) AS min_delta, count(delta) >= 2 AS universal FROM d GROUP BY ALL""",
       "delta_A delta_N delta_R mean_delta std_delta max_delta min_delta")
def _(spark, sf):
    return A.cross_model_essentiality(A.drop_column_over_folds(drop_rows(spark, sf), "max"), ["A", "N", "R"])


@query("essentiality_summary", f"""WITH {DROPC}, d AS (SELECT cluster, model, max(delta_auroc) AS delta FROM dropc GROUP BY ALL), e AS (SELECT cluster, avg(delta) AS m, max(delta) AS x, count(delta) >= 2 AS u FROM d GROUP BY ALL)
    SELECT count(*) AS n_clusters, count(CASE WHEN u THEN 1 END) AS n_universal, avg(m) AS mean_delta, max(x) AS max_delta FROM e""", "mean_delta max_delta")
def _(spark, sf):
    return A.essentiality_summary(A.cross_model_essentiality(A.drop_column_over_folds(drop_rows(spark, sf), "max"), ["A", "N", "R"]))


@query("ensemble_coef_stats", f"WITH {RUNS} SELECT experiment, model AS base_model, avg(auroc) AS mean, stddev_pop(auroc) AS std, min(auroc) AS min, max(auroc) AS max, count(auroc) AS n FROM runs GROUP BY ALL", "mean std min max")
def _(spark, sf):
    return A.ensemble_coef_stats(runs(spark, sf).withColumnsRenamed({"model": "base_model", "auroc": "coef"}), ["experiment"])


@query("ensemble_gain", f"""WITH {RUNS}, a AS (SELECT experiment, model, avg(auroc) AS v FROM runs GROUP BY ALL), b AS (SELECT experiment, max(CASE WHEN model = 'N' THEN v END) AS ensemble, max(CASE WHEN model <> 'N' THEN v END) AS best_base FROM a GROUP BY ALL)
    SELECT *, (ensemble - best_base) / best_base * 100 AS gain_pct FROM b""", "ensemble best_base gain_pct")
def _(spark, sf):
    return A.ensemble_gain(runs(spark, sf), "N", ["experiment"])


@query("learning_curve_summary", f"""WITH {CURVES}, a AS (SELECT experiment, model, seed, size, avg(auroc_val) AS v FROM curves GROUP BY ALL)
    SELECT experiment, model, size, avg(v) AS mean, stddev_samp(v) AS sd, CASE WHEN count(v) > 1 THEN quantile_cont(v, 0.025) END AS lo, CASE WHEN count(v) > 1 THEN quantile_cont(v, 0.975) END AS hi, count(v) AS n_runs FROM a GROUP BY ALL""", "mean sd lo hi")
def _(spark, sf):
    return A.learning_curve_summary(curves(spark, sf), EM, "seed", "size", "auroc_val")


@query("panel_model_matrix", f"WITH {CURVES} SELECT size AS panel, model, avg(auroc_val) AS mean, stddev_pop(auroc_val) AS sd, count(*) AS n FROM curves GROUP BY ALL", "mean sd")
def _(spark, sf):
    return A.panel_model_matrix(curves(spark, sf).withColumnRenamed("size", "panel"), value="auroc_val")


@query("panel_model_wide", f"WITH {CURVES} SELECT size AS panel, avg(CASE WHEN model = 'A' THEN auroc_val END) AS A, avg(CASE WHEN model = 'N' THEN auroc_val END) AS N, avg(CASE WHEN model = 'R' THEN auroc_val END) AS R FROM curves GROUP BY ALL", "A N R")
def _(spark, sf):
    return A.panel_model_wide(curves(spark, sf).withColumnRenamed("size", "panel"), ["A", "N", "R"], value="auroc_val")


@query("select_winner")
def _(spark, sf):
    cv = runs(spark, sf).select("experiment", F.col("model").alias("strategy"), F.lit("log").alias("weight_scheme"), F.col("split_seed").alias("fold"), F.col("auroc").alias("auprc"), F.col("auprc").alias("n_nonzero"))
    return A.select_winner(cv, ["experiment"])


@query("branch_decision", f"""WITH {RUNS}, a AS (SELECT experiment, model, 'base' AS config, avg(auroc) AS mean, stddev_samp(auroc) / sqrt(count(auroc)) AS se FROM runs GROUP BY ALL),
    t AS (SELECT *, max(mean) OVER (PARTITION BY experiment) AS tm FROM a), u AS (SELECT experiment, max(tm) AS tm, max(CASE WHEN mean = tm THEN se END) AS ts FROM t GROUP BY ALL)
    SELECT experiment, model, config, mean, se, mean + 1.96e0 * se >= u.tm - 1.96e0 * ts AS kept FROM a JOIN u USING (experiment)""", "mean se")
def _(spark, sf):
    return A.branch_decision(runs(spark, sf).withColumn("config", F.lit("base")), ["experiment"], value="auroc")


@query("distribution_stats", f"""WITH {LINES} SELECT model, split_seed, count(*) AS n, avg(y_prob) AS mean, stddev_pop(y_prob) AS sd, median(y_prob) AS median, quantile_cont(y_prob, 0.75) - quantile_cont(y_prob, 0.25) AS iqr FROM lines GROUP BY ALL""", "mean sd median iqr")
def _(spark, sf):
    return A.distribution_stats(scored_lines(spark, sf), ["model", "split_seed"])


def budget_sql(cuts) -> str:
    per = " UNION ALL ".join(f"SELECT model, split_id, {t} AS cutoff, max(CASE WHEN trial_num < {t} THEN auroc END) AS v, max(CASE WHEN trial_num < 500 THEN auroc END) AS b FROM trials GROUP BY model, split_id" for t in cuts)
    return f"""WITH {TRIALS}, p AS ({per}), a AS (SELECT model, cutoff, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS se, count(v) AS n_splits, avg(b) AS b FROM p GROUP BY ALL)
    SELECT model, cutoff, mean, se, mean - 1.96e0 * se AS lo, mean + 1.96e0 * se AS hi, n_splits, mean - b AS gain FROM a"""


@query("best_within_budget", budget_sql([100, 500, 1000]), "mean se lo hi gain")
def _(spark, sf):
    return A.best_within_budget(trials(spark, sf), [1000, 100], base=500)


SETS = """sets AS (SELECT DISTINCT l_returnflag AS model, l_linestatus AS seed, l_linenumber AS size, 'p' || l_partkey AS feature FROM lineitem)"""


def curve_sets(spark, sf):
    """One row per size and feature."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("seed"), F.col("l_linenumber").alias("size"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("feature"))


@query("retention_frequency", f"""WITH {SETS}, n AS (SELECT model, count(DISTINCT (seed, size)) AS n FROM sets GROUP BY ALL) SELECT model, feature, count(*) AS n_sizes, count(*) / max(n) AS retention FROM sets JOIN n USING (model) GROUP BY model, feature""", "retention")
def _(spark, sf):
    return A.retention_frequency(curve_sets(spark, sf), features="feature")


@query("aggregate_curves", f"""WITH {CURVES}, t AS (SELECT experiment, model, count(DISTINCT seed) AS n_seeds_total FROM curves GROUP BY ALL),
    a AS (SELECT experiment, model, size, count(DISTINCT seed) AS n_seeds, avg(auroc_val) AS auroc_val, stddev_samp(auroc_val) AS auroc_val_std, quantile_cont(auroc_val, 0.025) AS ci_lo, quantile_cont(auroc_val, 0.975) AS ci_hi FROM curves GROUP BY ALL),
    b AS (SELECT *, bool_or(n_seeds = n_seeds_total) OVER (PARTITION BY experiment, model) AS anyfull FROM a JOIN t USING (experiment, model))
    SELECT * EXCLUDE (anyfull), n_seeds AS n_by_seed FROM b WHERE CASE WHEN anyfull THEN n_seeds = n_seeds_total ELSE n_seeds * 2 >= n_seeds_total END""", "auroc_val auroc_val_std ci_lo ci_hi")
def _(spark, sf):
    out = A.aggregate_curves(curves(spark, sf), ["auroc_val"], EM)
    return out.withColumn("n_by_seed", F.size("by_seed").cast("bigint")).drop("by_seed")


@query("mean_elimination_rank", f"""WITH {IMP}, r AS (SELECT model, split_seed, feature, CASE WHEN selected THEN n END AS rk FROM imp), m AS (SELECT model, split_seed, max(rk) AS m FROM r GROUP BY ALL)
    SELECT model, feature, avg(coalesce(rk, m + 1)) AS mean_rank, count(*) AS n_seeds FROM r JOIN m USING (model, split_seed) GROUP BY ALL""", "mean_rank")
def _(spark, sf):
    i = importances(spark, sf).withColumn("elimination_rank", F.when(F.col("selected"), F.col("n")))
    return A.mean_elimination_rank(i, seed="split_seed")


@query("rfecv_consensus", f"""WITH {IMP}, s AS (SELECT * FROM imp WHERE selected), n AS (SELECT model, count(DISTINCT split_seed) AS n_folds, count(*) AS k FROM s GROUP BY ALL),
    a AS (SELECT model, feature, count(DISTINCT split_seed) AS n_selected FROM s GROUP BY ALL)
    SELECT model, feature, n_selected, n_folds, n_selected / n_folds AS frequency, n_selected / n_folds >= 0.5e0 AS kept, k / n_folds AS mean_size, row_number() OVER (PARTITION BY model ORDER BY n_selected DESC, feature) AS rank FROM a JOIN n USING (model)""", "frequency mean_size")
def _(spark, sf):
    return A.rfecv_consensus(importances(spark, sf).filter("selected").withColumnRenamed("split_seed", "fold"), 0.5)


@query("cross_fold_consistency", f"""WITH {IMP} SELECT model AS strategy, feature, count(CASE WHEN abs(coef) > 1e-8 THEN 1 END) AS folds_nonzero, avg(coef) AS mean_coef, stddev_samp(coef) AS std_coef,
    (max(CASE WHEN coef > 1e-8 THEN 1 ELSE 0 END) + max(CASE WHEN coef < -1e-8 THEN 1 ELSE 0 END)) = 1 AS sign_consistent FROM imp GROUP BY ALL""", "mean_coef std_coef")
def _(spark, sf):
    return A.cross_fold_consistency(importances(spark, sf).withColumnsRenamed({"model": "strategy", "split_seed": "fold"}))


@query("model_comparison", f"""WITH {RUNS}, a AS (SELECT experiment, model, avg(auroc) AS auroc, avg(brier) AS brier FROM runs GROUP BY ALL)
    SELECT *, round(auroc, 12) = round(max(auroc) OVER (PARTITION BY experiment), 12) AS best_auroc, round(brier, 12) = round(min(brier) OVER (PARTITION BY experiment), 12) AS best_brier FROM a""", "auroc brier")
def _(spark, sf):
    return A.model_comparison(runs(spark, sf), ["auroc"], ["brier"], ["experiment"])


COEF = f"""WITH {IMP}, cf AS (SELECT model, feature, max(coef) AS coef, count(*) / 7e0 AS stability FROM imp GROUP BY ALL)"""


def some_importances(spark, sf):
    """Largest importance of each feature, NULL for one in ten features (those whose name ends in 7)."""
    given = F.when(~F.endswith("feature", F.lit("7")), F.col("importance"))
    return importances(spark, sf).groupBy("model", "feature").agg(F.max(given).alias("mean_importance"))


def coef_rows(spark, sf):
    return importances(spark, sf).groupBy("model", "feature").agg(F.max("coef").alias("coef"), (F.count(F.lit(1)) / 7.0).alias("stability"))


@query("multimodel_rank", f"""{COEF}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(coef) DESC) + (count(*) OVER (PARTITION BY model, abs(coef)) - 1) / 2e0 AS rk FROM cf),
    a AS (SELECT feature, avg(rk) AS mean_rank, count(DISTINCT model) AS n_models, max(CASE WHEN model = 'A' THEN coef END) AS coef_A, max(CASE WHEN model = 'N' THEN coef END) AS coef_N, max(CASE WHEN model = 'R' THEN coef END) AS coef_R,
      min(sign(coef)) = max(sign(coef)) AS same_sign, min(stability) AS min_stability FROM r GROUP BY ALL HAVING count(DISTINCT model) >= 2)
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY mean_rank, feature) AS position FROM a) WHERE position <= 30""", "mean_rank coef_A coef_N coef_R min_stability")
def _(spark, sf):
    return A.multimodel_rank(coef_rows(spark, sf), ["A", "N", "R"])


@query("average_rank", f"{COEF} SELECT DISTINCT model, coef, count(*) OVER (PARTITION BY model, coef) AS n, rank() OVER (PARTITION BY model ORDER BY coef) + (count(*) OVER (PARTITION BY model, coef) - 1) / 2e0 AS avg_rank FROM cf", "coef avg_rank")
def _(spark, sf):
    return average_rank(coef_rows(spark, sf), ["model"], "coef")


@query("starting_panel", f"""{STAB}, mi AS (SELECT model, feature, max(CASE WHEN NOT ends_with(feature, '7') THEN importance END) AS mi FROM imp GROUP BY ALL)
    SELECT * FROM (SELECT model, feature, coalesce(mi, 0e0) AS score, row_number() OVER (PARTITION BY model ORDER BY coalesce(mi, 0e0) DESC, feature) AS rank FROM stab LEFT JOIN mi USING (model, feature) WHERE selection_fraction >= 0.4e0) WHERE rank <= 50""", "score")
def _(spark, sf):
    mi = some_importances(spark, sf)
    return A.starting_panel(stability(spark, sf), mi, 0.4, 50)


@query("marginal_gain", f"WITH {CURVES}, a AS (SELECT experiment, model, size, avg(auroc_val) AS mean FROM curves GROUP BY ALL) SELECT *, mean - lag(mean) OVER (PARTITION BY experiment, model ORDER BY size) AS gain FROM a", "mean gain")
def _(spark, sf):
    return A.marginal_gain(curves(spark, sf), EM, "size", "auroc_val")


@query("membership_patterns", f"WITH {IMP}, p AS (SELECT feature, array_to_string(list_sort(list_distinct(list(model))), '+') AS pattern FROM imp WHERE selected GROUP BY ALL) SELECT pattern, count(*) AS n_features FROM p GROUP BY ALL")
def _(spark, sf):
    return A.membership_patterns(importances(spark, sf).filter("selected"))


@query("ensemble_rows", f"""WITH {SCORED}, en AS (SELECT id, y_true, 'ENSEMBLE' AS model, avg(y_prob) AS y_prob FROM scored GROUP BY id, y_true), al AS (SELECT id, y_true, model, y_prob FROM scored UNION ALL SELECT id, y_true, model, y_prob FROM en),
    {points_sql('al', 'model')} SELECT model, {AUROC} AS auroc, {PRAUC} AS prauc, {YOUDEN} AS youden, {sens_sql(0.95)} AS alpha FROM pts GROUP BY ALL""", "auroc prauc youden alpha")
def _(spark, sf):
    return A.ensemble_rows(scored(spark, sf).select("id", "y_true", "model", "y_prob"))


# ---------------------------------------------------------------- windows, sets
TR = f"WITH {TRIALS}"
BY_MODEL = "(PARTITION BY model ORDER BY trial_num)"


@query("running_best", f"""{TR}, r AS (SELECT *, max(auroc) OVER (PARTITION BY model ORDER BY trial_num ROWS UNBOUNDED PRECEDING) AS best, auroc - lag(auroc) OVER {BY_MODEL} AS delta_prev,
    auroc - first_value(auroc) OVER {BY_MODEL} AS delta_base FROM trials) SELECT model, trial_num, auroc, best, delta_prev, delta_base, coalesce(auroc > lag(best) OVER {BY_MODEL}, true) AS improved FROM r""", "auroc best delta_prev delta_base")
def _(spark, sf):
    return A.running_best(trials(spark, sf).select("model", "trial_num", "auroc"), ["model"], "trial_num", "auroc")


@query("trailing_streak", f"{TR}, l AS (SELECT model, max(CASE WHEN auroc >= 0.9e0 THEN trial_num END) AS last FROM trials GROUP BY ALL) SELECT model, count(CASE WHEN last IS NULL OR trial_num > last THEN 1 END) AS streak FROM trials JOIN l USING (model) GROUP BY ALL")
def _(spark, sf):
    return A.trailing_streak(trials(spark, sf), ["model"], "trial_num", F.col("auroc") < 0.9)


@query("tail_std", f"{TR}, r AS (SELECT *, row_number() OVER {BY_MODEL} AS rn, count(*) OVER (PARTITION BY model) AS n FROM trials) SELECT model, stddev_pop(auroc) AS tail_std, count(*) AS n_tail FROM r WHERE rn > n - greatest(2, ceil(0.2e0 * n)) GROUP BY ALL", "tail_std")
def _(spark, sf):
    return A.tail_std(trials(spark, sf), ["model"], "trial_num", "auroc")


@query("pareto_scan", f"""{TR}, r AS (SELECT *, min(brier) OVER (PARTITION BY model ORDER BY auroc DESC, brier, trial_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM trials) SELECT model, trial_num, auroc, brier FROM r WHERE m IS NULL OR brier < m""", "auroc brier")
def _(spark, sf):
    return A.pareto_scan(trials(spark, sf).select("model", "trial_num", "auroc", "brier"), ["model"], "auroc", "brier", "trial_num")


@query("distinct_top_k", f"{TR}, b AS (SELECT model, params, max(auroc) AS auroc FROM trials GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY auroc DESC, params) AS rank FROM b) WHERE rank <= 5", "auroc")
def _(spark, sf):
    return A.distinct_top_k(trials(spark, sf), 5, ["model"])


@query("first_rows", f"{TR} SELECT model, trial_num, split_id, auroc FROM trials QUALIFY row_number() OVER (PARTITION BY model ORDER BY trial_num) = 1", "auroc")
def _(spark, sf):
    return A.first_rows(trials(spark, sf).select("model", "trial_num", "split_id", "auroc"), ["model"], ["trial_num"])


@query("top_k", f"{COEF} SELECT model, feature, coef, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(coef) DESC NULLS LAST, feature) AS rank FROM cf) WHERE rank <= 20", "coef")
def _(spark, sf):
    rows = coef_rows(spark, sf).select("model", "feature", "coef")
    return A.top_k(rows, 20, ["model"], [F.abs("coef").desc_nulls_last(), F.col("feature")])


@query("min_rank", f"{COEF} SELECT model, feature, stability, cast(rank() OVER (PARTITION BY model ORDER BY stability DESC) AS int) AS rk FROM cf", "stability")
def _(spark, sf):
    return A.min_rank(coef_rows(spark, sf).select("model", "feature", "stability"), ["model"], "stability", "rk")


@query("dense_rank", f"{COEF} SELECT model, feature, v, cast(dense_rank() OVER (PARTITION BY model ORDER BY v DESC NULLS LAST) AS int) AS rk FROM (SELECT model, feature, CASE WHEN stability >= 0.1e0 THEN stability END AS v FROM cf)", "v")
def _(spark, sf):
    rows = coef_rows(spark, sf).select("model", "feature", F.when(F.col("stability") >= 0.1, F.col("stability")).alias("v"))
    return dense_rank(rows, ["model"], "v", "rk").withColumn("rk", F.col("rk").cast("int"))


@query("jaccard_matrix", f"""WITH {IMP}, s AS (SELECT DISTINCT model, feature FROM imp WHERE selected), n AS (SELECT model, count(*) AS n FROM s GROUP BY ALL)
    SELECT a.model AS a, b.model AS b, (SELECT count(*) FROM s x JOIN s y USING (feature) WHERE x.model = a.model AND y.model = b.model) AS n_both,
      a.n + b.n - (SELECT count(*) FROM s x JOIN s y USING (feature) WHERE x.model = a.model AND y.model = b.model) AS n_either,
      (SELECT count(*) FROM s x JOIN s y USING (feature) WHERE x.model = a.model AND y.model = b.model) / (a.n + b.n - (SELECT count(*) FROM s x JOIN s y USING (feature) WHERE x.model = a.model AND y.model = b.model)) AS jaccard
    FROM n a JOIN n b ON a.model < b.model""", "jaccard")
def _(spark, sf):
    return A.jaccard_matrix(importances(spark, sf).filter("selected"))


@query("prefix_panels", f"""{COEF}, r AS (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY abs(coef) DESC, feature) AS rank FROM cf) SELECT model, size, rank, feature FROM r JOIN (SELECT unnest([5, 10, 20]) AS size) ON rank <= size""")
def _(spark, sf):
    from ..core.order import ordinal_rank

    ranked = ordinal_rank(coef_rows(spark, sf), ["model"], [F.abs("coef").desc(), F.col("feature")])
    return A.prefix_panels(ranked, [5, 10, 20])


# ---------------------------------------------------------------- joins
@query("join_left_report", f"{STAB} SELECT model, feature, selection_fraction, s.effect FROM stab LEFT JOIN (SELECT model, feature, max(effect) AS effect FROM imp GROUP BY ALL) s USING (model, feature)", "selection_fraction effect")
def _(spark, sf):
    screen = importances(spark, sf).groupBy("model", "feature").agg(F.max("effect").alias("effect"))
    return join_on(stability(spark, sf), screen, ["model", "feature"], "left").select("model", "feature", "selection_fraction", "effect")


@query("join_outer_models", f"{COEF} SELECT feature, a.coef AS a_coef, r.coef AS r_coef FROM (SELECT * FROM cf WHERE model = 'A') a FULL JOIN (SELECT * FROM cf WHERE model = 'R') r USING (feature)", "a_coef r_coef")
def _(spark, sf):
    c = coef_rows(spark, sf)
    a = c.filter("model = 'A'").select("feature", F.col("coef").alias("a_coef"))
    r = c.filter("model = 'R'").select("feature", F.col("coef").alias("r_coef"))
    return a.join(r, "feature", "full_outer")


@query("stack_matrix", f"""WITH {SCORED} SELECT id, y_true, max(CASE WHEN model = 'repeat' THEN y_prob END) AS "repeat", max(CASE WHEN model = 'symbol' THEN y_prob END) AS symbol, max(CASE WHEN model = 'brevity' THEN y_prob END) AS brevity FROM scored GROUP BY ALL""", '"repeat" symbol brevity')
def _(spark, sf):
    from ..operators.models import stack_matrix

    return stack_matrix(scored(spark, sf), ["repeat", "symbol", "brevity"])


@query("stack_violations", f"""WITH {SCORED}, b AS (SELECT id, model, CASE WHEN model = 'symbol' AND id % 50 = 0 THEN 1 - y_true ELSE y_true END AS y_true FROM scored WHERE NOT (model = 'brevity' AND id % 70 = 3))
    SELECT id, count(DISTINCT model) AS n_models, count(DISTINCT y_true) AS n_labels FROM b GROUP BY ALL HAVING count(DISTINCT model) <> 3 OR count(DISTINCT y_true) <> 1""")
def _(spark, sf):
    from ..operators.models import stack_violations

    s = scored(spark, sf).filter(~((F.col("model") == "brevity") & (F.col("id") % 70 == 3)))
    s = s.withColumn("y_true", F.when((F.col("model") == "symbol") & (F.col("id") % 50 == 0), 1 - F.col("y_true")).otherwise(F.col("y_true")))
    return stack_violations(s, 3)
