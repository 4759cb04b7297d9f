"""Queries over scored tables: ranking metrics, thresholds, decision curves, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import adjust_prevalence
from ..operators import calibration as C
from ..operators import dca as V
from ..operators import discrimination as D
from ..operators import thresholds as T
from ..operators.curves import GRID_120, pr_band, roc_band
from .registry import query
from .tables import (
    AUROC, LINES, PRAUC, SCORED, TWO, YOUDEN, points_sql, scored, scored_lines, sens_sql, spec_thr_sql, two_sided_sql,
)

M = ["model"]
PTS = f"WITH {SCORED}, {points_sql('scored', 'model')}"
LPTS = f"WITH {LINES}, {points_sql('lines', 'model, split_seed')}"
LK = ["model", "split_seed"]


@query("auroc", f"{LPTS} SELECT model, split_seed, {AUROC} AS auroc FROM pts GROUP BY ALL", "auroc")
def _(spark, sf):
    return D.auroc(scored_lines(spark, sf), LK)


@query("prauc", f"{LPTS} SELECT model, split_seed, {PRAUC} AS prauc FROM pts GROUP BY ALL", "prauc")
def _(spark, sf):
    return D.prauc(scored_lines(spark, sf), LK)


@query("youden_j", f"{LPTS} SELECT model, split_seed, {YOUDEN} AS youden FROM pts GROUP BY ALL", "youden")
def _(spark, sf):
    return D.youden_j(scored_lines(spark, sf), LK)


@query("sens_at_spec", f"{PTS} SELECT model, {sens_sql(0.95)} AS sens_at_spec FROM pts GROUP BY ALL", "sens_at_spec")
def _(spark, sf):
    return D.sens_at_spec(scored(spark, sf), M, target=0.95)


@query(
    "tpr_at_fpr",
    f"{PTS} SELECT model, CASE WHEN {TWO} THEN coalesce(max(CASE WHEN keep AND fpr <= 0.05e0 THEN tpr END), 0e0) END AS tpr_at_fpr FROM pts GROUP BY ALL",
    "tpr_at_fpr",
)
def _(spark, sf):
    return D.tpr_at_fpr(scored(spark, sf), M, target=0.05)


BRIER = "avg((y_prob - y_true) * (y_prob - y_true))"
CLIPPED = "least(greatest(y_prob, 1e-15), 1e0 - 1e-15)"


@query(
    "error_metrics",
    f"""WITH {LINES} SELECT model, split_seed, {BRIER} AS brier,
    avg(-(y_true * ln({CLIPPED}) + (1 - y_true) * ln(1e0 - {CLIPPED}))) AS log_loss FROM lines GROUP BY ALL""",
    "brier log_loss",
)
def _(spark, sf):
    return D.error_metrics(scored_lines(spark, sf), LK)


@query(
    "discrimination",
    f"{PTS} SELECT model, {AUROC} AS auroc, {PRAUC} AS prauc, {YOUDEN} AS youden, {sens_sql(0.95)} AS alpha FROM pts GROUP BY ALL",
    "auroc prauc youden alpha",
)
def _(spark, sf):
    return D.discrimination(scored(spark, sf), M)


@query(
    "discrimination_lines",
    f"WITH {LINES}, {points_sql('lines', 'model')} SELECT model, {AUROC} AS auroc, {PRAUC} AS prauc, {YOUDEN} AS youden, {sens_sql(0.95)} AS alpha FROM pts GROUP BY ALL",
    "auroc prauc youden alpha",
)
def _(spark, sf):
    return D.discrimination(scored_lines(spark, sf), M)


ADJ = f"""{SCORED}, adj0 AS (
  SELECT *, avg(cast(y_true AS double)) OVER (PARTITION BY model) AS prev,
    ln(least(greatest(y_prob, 1e-9), 1e0 - 1e-9) / (1e0 - least(greatest(y_prob, 1e-9), 1e0 - 1e-9))) AS lo FROM scored),
adj AS (
  SELECT *, CASE WHEN prev > 0 AND prev < 1 THEN least(greatest(1e0 / (1e0 + exp(-(lo + ln(0.05e0 / 0.95e0) - ln(prev / (1e0 - prev))))), 1e-9), 1e0 - 1e-9) ELSE y_prob END AS y_adj FROM adj0)"""


def adjusted(spark, sf):
    rows = scored(spark, sf)
    prev = rows.groupBy("model").agg(F.avg(F.col("y_true").cast("double")).alias("prev"))
    return rows.join(prev, "model").withColumn(
        "y_prob_adjusted", adjust_prevalence("y_prob", F.col("prev"), F.lit(0.05))
    )


@query("adjust_prevalence", f"WITH {ADJ} SELECT id, model, y_adj AS y_prob_adjusted FROM adj", "y_prob_adjusted")
def _(spark, sf):
    return adjusted(spark, sf).select("id", "model", "y_prob_adjusted")


@query(
    "pooled_metrics",
    f"""WITH {ADJ}, {points_sql('adj', 'model', 'y_adj')},
    plain AS (SELECT model, avg((y_adj - y_true) * (y_adj - y_true)) AS brier, count(*) AS n_samples,
      cast(sum(y_true) AS bigint) AS n_positive, avg(cast(y_true AS double)) AS prevalence FROM adj GROUP BY ALL)
    SELECT * FROM plain JOIN (SELECT model, {AUROC} AS auroc, {PRAUC} AS prauc, {YOUDEN} AS youden,
      {sens_sql(0.9)} AS sens_at_spec_90, {sens_sql(0.95)} AS sens_at_spec_95 FROM pts GROUP BY ALL) USING (model)""",
    "brier prevalence auroc prauc youden sens_at_spec_90 sens_at_spec_95",
)
def _(spark, sf):
    return D.pooled_metrics(adjusted(spark, sf), M)


@query(
    "score_by_group",
    f"WITH {SCORED} SELECT model, category, count(*) AS n, avg(y_prob) AS mean_score FROM scored GROUP BY ALL", "mean_score",
)
def _(spark, sf):
    return D.score_by_group(scored(spark, sf), M)


@query("roc_points", f"{PTS} SELECT model, p AS threshold, fpr, tpr FROM pts WHERE keep", "threshold fpr tpr")
def _(spark, sf):
    return D.roc_points(scored(spark, sf), M)


@query("pr_points", f"{PTS} SELECT model, p AS threshold, tpr AS recall, prec AS precision FROM pts", "threshold recall precision")
def _(spark, sf):
    return D.pr_points(scored(spark, sf), M)


# ---------------------------------------------------------------- thresholds
def fbeta_sql(b2: float) -> str:
    f = f"CASE WHEN {b2!r}e0 * prec + tpr > 0 THEN {1 + b2!r}e0 * prec * tpr / ({b2!r}e0 * prec + tpr) ELSE 0e0 END"
    return f"(-max({{'f': {f}, 'np': -p}})['np'])"


@query("max_f1", f"{PTS} SELECT model, {fbeta_sql(1.0)} AS threshold FROM pts GROUP BY ALL", "threshold")
def _(spark, sf):
    return T.choose_threshold(scored(spark, sf), M, "max_f1")


@query("max_fbeta", f"{PTS} SELECT model, {fbeta_sql(4.0)} AS threshold FROM pts GROUP BY ALL", "threshold")
def _(spark, sf):
    return T.choose_threshold(scored(spark, sf), M, "max_fbeta", beta=2.0)


def youden_thr_sql(pts: str = "pts", keys: str = "model") -> str:
    return f"""SELECT {keys}, CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 AND max(top) >= 1e-10
      THEN (max(CASE WHEN keep AND abs(tpr - fpr - top) < 1e-10 THEN p END) + min(CASE WHEN keep AND abs(tpr - fpr - top) < 1e-10 THEN p END)) / 2e0
      ELSE 0.5e0 END AS threshold
    FROM (SELECT *, greatest(0e0, max(CASE WHEN keep THEN tpr - fpr END) OVER (PARTITION BY {keys})) AS top FROM {pts}) GROUP BY {keys}"""


@query("youden_threshold", f"{PTS} {youden_thr_sql()}", "threshold")
def _(spark, sf):
    return T.choose_threshold(scored(spark, sf), M)


@query("threshold_for_specificity", f"{PTS} SELECT model, {spec_thr_sql(0.95)} AS threshold FROM pts GROUP BY ALL", "threshold")
def _(spark, sf):
    return T.choose_threshold(scored(spark, sf), M, "fixed_spec", target=0.95)


@query(
    "threshold_for_sensitivity",
    f"{PTS} SELECT model, CASE WHEN {TWO} THEN max(CASE WHEN keep AND tpr >= 0.9e0 THEN p END) ELSE min(p) - 1e-12 END AS threshold FROM pts GROUP BY ALL",
    "threshold",
)
def _(spark, sf):
    return T.choose_threshold(scored(spark, sf), M, "fixed_sens", target=0.9)


@query(
    "threshold_for_precision",
    f"{PTS} SELECT model, coalesce(max(CASE WHEN prec >= 0.5e0 THEN p END), {fbeta_sql(1.0)}) AS threshold FROM pts GROUP BY ALL",
    "threshold",
)
def _(spark, sf):
    return T.choose_threshold(scored(spark, sf), M, "fixed_ppv", target=0.5)


@query(
    "choose_threshold",
    f"{PTS} SELECT model, {fbeta_sql(1.0)} AS threshold, 'fallback' AS objective FROM pts GROUP BY ALL UNION ALL SELECT model, threshold, 'youden' FROM ({youden_thr_sql()})",
    "threshold",
)
def _(spark, sf):
    s = scored(spark, sf)
    a = T.choose_threshold(s, M, "no_such_rule").withColumn("objective", F.lit("fallback"))
    return a.unionByName(T.choose_threshold(s, M, "youden").withColumn("objective", F.lit("youden")))


@query(
    "threshold_from_controls",
    f"""WITH {LINES}, c AS (SELECT model, y_prob, row_number() OVER (PARTITION BY model ORDER BY y_prob) AS rn,
      count(*) OVER (PARTITION BY model) AS n FROM lines WHERE y_true = 0)
    SELECT model, y_prob AS threshold, n AS n_controls FROM c WHERE rn = cast(ceil(0.95e0 * (n - 1)) AS bigint) + 1""",
    "threshold",
)
def _(spark, sf):
    return T.threshold_from_controls(scored_lines(spark, sf), M, 0.95)


@query(
    "top_risk_capture",
    f"""WITH {SCORED}, r AS (SELECT model, y_true, row_number() OVER (PARTITION BY model ORDER BY y_prob DESC, id) AS rn,
       count(*) OVER (PARTITION BY model) AS n, sum(y_true) OVER (PARTITION BY model) AS cases FROM scored),
    k AS (SELECT *, cast(greatest(1, least(n, ceil(frac * n))) AS bigint) AS n_top FROM r, (SELECT unnest([0.01e0, 0.05e0, 0.1e0]) AS frac))
    SELECT model, frac, n_top, cast(sum(y_true) AS bigint) AS cases_in_top, cast(max(n_top) - sum(y_true) AS bigint) AS controls_in_top,
      sum(y_true) / max(cases) AS case_capture FROM k WHERE rn <= n_top GROUP BY model, frac, n_top""",
    "frac case_capture",
)
def _(spark, sf):
    return T.top_risk_capture(scored(spark, sf), [0.01, 0.05, 0.1], M)


CONF = """cast(sum(CASE WHEN hit THEN y_true ELSE 0 END) AS bigint) AS tp, cast(sum(CASE WHEN hit THEN 1 - y_true ELSE 0 END) AS bigint) AS fp,
  cast(sum(y_true) AS bigint) AS np, cast(sum(1 - y_true) AS bigint) AS nn"""
CONF_OUT = """tp, fp, nn - fp AS tn, np - tp AS fn, coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0e0) AS precision,
  coalesce(CASE WHEN np > 0 THEN tp / np END, 0e0) AS sensitivity, coalesce(CASE WHEN tp + fp + np > 0 THEN 2 * tp / (tp + fp + np) END, 0e0) AS f1,
  CASE WHEN nn > 0 THEN (nn - fp) / nn END AS specificity, CASE WHEN nn > 0 THEN 1e0 - (nn - fp) / nn END AS fpr"""
CONF_D = "precision sensitivity f1 specificity fpr threshold"


@query(
    "confusion_at",
    f"""WITH {LINES}, g AS (SELECT model, threshold, {CONF} FROM (SELECT *, y_prob >= threshold AS hit FROM lines, (SELECT unnest([0.3e0, 0.5e0, 0.6e0]) AS threshold)) GROUP BY ALL)
    SELECT model, threshold, {CONF_OUT} FROM g""",
    CONF_D,
)
def _(spark, sf):
    s = scored_lines(spark, sf)
    thr = s.select("model").distinct().select("model", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.6))).alias("threshold"))
    return T.confusion_at(s, thr, M)


@query(
    "multi_specificity",
    f"""{PTS}, t AS (SELECT model, 0.9e0 AS target_spec, {spec_thr_sql(0.9)} AS threshold FROM pts GROUP BY ALL
      UNION ALL SELECT model, 0.95e0, {spec_thr_sql(0.95)} FROM pts GROUP BY ALL
      UNION ALL SELECT model, 0.99e0, {spec_thr_sql(0.99)} FROM pts GROUP BY ALL),
    g AS (SELECT model, target_spec, threshold, {CONF} FROM (SELECT *, y_prob >= threshold AS hit FROM scored JOIN t USING (model)) GROUP BY ALL)
    SELECT model, target_spec, threshold, sensitivity, precision, specificity FROM (SELECT model, target_spec, threshold, {CONF_OUT} FROM g)""",
    "target_spec threshold sensitivity precision specificity",
)
def _(spark, sf):
    return T.multi_specificity(scored(spark, sf), [0.95, 0.9, 0.99], M)


BUNDLE = f"""{PTS}, t AS (SELECT model, 'youden' AS threshold_type, threshold FROM ({youden_thr_sql()})
      UNION ALL SELECT model, 'spec_target', {spec_thr_sql(0.95)} FROM pts GROUP BY ALL
      UNION ALL SELECT DISTINCT model, 'dca', 0.1e0 FROM pts),
    g AS (SELECT model, threshold_type, threshold, {CONF} FROM (SELECT *, y_prob >= threshold AS hit FROM scored JOIN t USING (model)) GROUP BY ALL)
    SELECT model, threshold_type, threshold, {CONF_OUT} FROM g"""


@query("threshold_bundle", BUNDLE, CONF_D)
def _(spark, sf):
    return T.threshold_bundle(scored(spark, sf), M, 0.95, 0.1)


@query(
    "threshold_transfer",
    f"""WITH {SCORED}, val AS (SELECT * FROM scored WHERE split = 'VAL'), {points_sql('val', 'model')}, t AS ({youden_thr_sql()}),
    g AS (SELECT model, threshold, {CONF} FROM (SELECT *, y_prob >= threshold AS hit FROM scored JOIN t USING (model) WHERE split = 'TEST') GROUP BY ALL)
    SELECT model, threshold, {CONF_OUT} FROM g""",
    CONF_D,
)
def _(spark, sf):
    return T.threshold_transfer(scored(spark, sf), M)


@query(
    "waterfall_samples",
    f"""{PTS}, t AS ({youden_thr_sql()}),
    k AS (SELECT model, id, y_prob, CASE WHEN y_prob >= threshold AND y_true = 1 THEN 'TP' WHEN y_prob >= threshold THEN 'FP' WHEN y_true = 1 THEN 'FN' ELSE 'TN' END AS outcome_type,
      threshold FROM scored JOIN t USING (model)),
    r AS (SELECT *, row_number() OVER (PARTITION BY model, outcome_type ORDER BY CASE WHEN outcome_type = 'TN' THEN abs(y_prob - threshold) ELSE -y_prob END, id) AS pick FROM k)
    SELECT model, outcome_type, cast(pick AS int) AS pick, id, y_prob FROM r WHERE pick <= 2""",
    "y_prob",
)
def _(spark, sf):
    s = scored(spark, sf)
    return T.waterfall_samples(s, T.choose_threshold(s, M), M, 2)


@query(
    "score_range_check",
    f"""WITH {SCORED} SELECT split, count(*) AS n, cast(sum(CASE WHEN y_prob IS NULL OR isnan(y_prob) THEN 1 ELSE 0 END) AS bigint) AS n_not_finite,
    cast(sum(CASE WHEN y_prob BETWEEN 0 AND 1 THEN 0 ELSE 1 END) AS bigint) AS n_bad FROM scored GROUP BY ALL""",
)
def _(spark, sf):
    return T.score_range_check(scored(spark, sf), ["split"])


# ------------------------------------------------------------ decision curves
GRID = V.dca_thresholds(0.02, 0.8, 0.02)
GRID_SQL = "(SELECT unnest([" + ", ".join(f"{t!r}e0" for t in GRID) + "]) AS threshold)"


def curve_sql(src: str = "scored", keys: str = "model", tag: str = "") -> str:
    return f"""cnt{tag} AS (SELECT {keys}, threshold, cast(sum(CASE WHEN y_prob >= threshold THEN y_true ELSE 0 END) AS bigint) AS tp,
      cast(sum(CASE WHEN y_prob >= threshold THEN 1 - y_true ELSE 0 END) AS bigint) AS fp, cast(sum(y_true) AS bigint) AS np, cast(sum(1 - y_true) AS bigint) AS nn
      FROM {src}, {GRID_SQL} GROUP BY ALL),
    curve{tag} AS (SELECT *, tp / (np + nn) - fp / (np + nn) * (threshold / (1e0 - threshold)) AS net_benefit_model,
      np / (np + nn) - (1e0 - np / (np + nn)) * (threshold / (1e0 - threshold)) AS net_benefit_all FROM cnt{tag})"""


CURVE = f"WITH {SCORED}, {curve_sql()}"
DCA_OUT = """threshold, threshold * 100 AS threshold_pct, net_benefit_model, net_benefit_all, 0e0 AS net_benefit_none,
  CASE WHEN net_benefit_all > 0 THEN net_benefit_model / net_benefit_all END AS relative_utility, tp, fp, nn - fp AS tn, np - tp AS fn, tp + fp AS n_treat,
  CASE WHEN np > 0 THEN tp / np END AS sensitivity, CASE WHEN nn > 0 THEN (nn - fp) / nn END AS specificity"""
DCA_D = "threshold threshold_pct net_benefit_model net_benefit_all relative_utility sensitivity specificity"


@query("dca_thresholds", f"""WITH {SCORED}, e AS (SELECT model, avg(cast(y_true AS double)) AS prev FROM scored GROUP BY ALL),
    t AS (SELECT unnest([{", ".join(f"{t!r}e0" for t in V.dca_thresholds(prevalence=0.05, step=0.01))}]) AS threshold)
    SELECT model, threshold, prev >= threshold AS prevalence_above FROM e, t""", "threshold")
def _(spark, sf):
    prev = scored(spark, sf).groupBy("model").agg(F.avg(F.col("y_true").cast("double")).alias("prev"))
    grid = F.explode(F.array(*[F.lit(t) for t in V.dca_thresholds(prevalence=0.05, step=0.01)])).alias("threshold")
    return prev.select("model", "prev", grid).select("model", "threshold", (F.col("prev") >= F.col("threshold")).alias("prevalence_above"))


@query("decision_curve", f"{CURVE} SELECT model, {DCA_OUT} FROM curve", DCA_D)
def _(spark, sf):
    return V.decision_curve(scored(spark, sf), GRID, M)


@query(
    "decision_curve_lines",
    f"WITH {LINES}, {curve_sql('lines', 'model, split_seed')} SELECT model, split_seed, {DCA_OUT} FROM curve", DCA_D,
)
def _(spark, sf):
    return V.decision_curve(scored_lines(spark, sf), GRID, LK)


LEADS = "lead(threshold) OVER (PARTITION BY model ORDER BY threshold) AS t2, lead(net_benefit_model) OVER (PARTITION BY model ORDER BY threshold) AS nb2"


@query(
    "dca_zero_crossing",
    f"""{CURVE}, l AS (SELECT model, threshold AS t1, net_benefit_model AS nb, {LEADS} FROM curve),
    z AS (SELECT * FROM l WHERE nb > 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY t1 DESC) = 1)
    SELECT model, CASE WHEN t2 IS NULL OR nb2 = nb THEN t1 ELSE t1 + (t2 - t1) * (-nb / (nb2 - nb)) END AS zero_crossing
    FROM (SELECT DISTINCT model FROM l) LEFT JOIN z USING (model)""",
    "zero_crossing",
)
def _(spark, sf):
    return V.dca_zero_crossing(V.decision_curve(scored(spark, sf), GRID, M), M)


@query(
    "dca_curve_crossing",
    f"""{CURVE}, l AS (SELECT model, threshold AS t1, net_benefit_model AS nb, {LEADS} FROM curve),
    z AS (SELECT * FROM l WHERE nb2 IS NOT NULL AND sign(nb) <> sign(nb2) QUALIFY row_number() OVER (PARTITION BY model ORDER BY t1) = 1),
    near AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY model ORDER BY abs(nb), t1) = 1)
    SELECT model, CASE WHEN z.t1 IS NOT NULL THEN CASE WHEN abs(z.nb2 - z.nb) > 1e-10 THEN z.t1 - z.nb * (z.t2 - z.t1) / (z.nb2 - z.nb) END
      WHEN abs(near.nb) < 0.05e0 THEN near.t1 END AS crossing FROM near LEFT JOIN z USING (model)""",
    "crossing",
)
def _(spark, sf):
    return V.dca_curve_crossing(V.decision_curve(scored(spark, sf), GRID, M), M)


@query(
    "dca_table",
    f"""{CURVE} SELECT model AS series, threshold, net_benefit_model AS net_benefit FROM curve
    UNION ALL SELECT 'treat_all', threshold, min(net_benefit_all) FROM curve WHERE model = 'brevity' GROUP BY threshold
    UNION ALL SELECT DISTINCT 'treat_none', threshold, 0e0 FROM curve""",
    "threshold net_benefit",
)
def _(spark, sf):
    return V.dca_table(scored(spark, sf), GRID)


@query(
    "dca_summary",
    f"""{CURVE}, l AS (SELECT *, lead(threshold) OVER w - threshold AS dt, (lead(net_benefit_model) OVER w + net_benefit_model) / 2e0 AS m2,
      (lead(net_benefit_all) OVER w + net_benefit_all) / 2e0 AS a2 FROM curve WINDOW w AS (PARTITION BY model ORDER BY threshold))
    SELECT model, count(*) AS n_thresholds, min(CASE WHEN net_benefit_model > net_benefit_all THEN threshold END) AS beats_all_from,
      max(CASE WHEN net_benefit_model > net_benefit_all THEN threshold END) AS beats_all_to,
      min(CASE WHEN net_benefit_model > 0 THEN threshold END) AS beats_none_from, max(CASE WHEN net_benefit_model > 0 THEN threshold END) AS beats_none_to,
      sum(m2 * dt) AS integrated_nb_model, sum(a2 * dt) AS integrated_nb_all, sum((m2 - a2) * dt) AS integrated_nb_improvement,
      max(CASE WHEN abs(threshold - 0.1e0) <= 0.001001e0 THEN net_benefit_model END) AS nb_model_at_10p0pct,
      max(CASE WHEN abs(threshold - 0.1e0) <= 0.001001e0 THEN net_benefit_all END) AS nb_all_at_10p0pct
    FROM l GROUP BY ALL""",
    "beats_all_from beats_all_to beats_none_from beats_none_to integrated_nb_model integrated_nb_all integrated_nb_improvement nb_model_at_10p0pct nb_all_at_10p0pct",
)
def _(spark, sf):
    return V.dca_summary(V.decision_curve(scored(spark, sf), GRID, M), M, [0.1])


BAND = "count(v) AS n_splits, avg(v) AS mean, stddev_pop(v) AS sd, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi"


@query(
    "dca_band",
    f"WITH {LINES}, {curve_sql('lines', 'model, split_seed')} SELECT model, threshold, {BAND.replace('(v', '(net_benefit_model')} FROM curve GROUP BY ALL",
    "threshold mean sd lo hi",
)
def _(spark, sf):
    return V.dca_band(scored_lines(spark, sf), GRID, M, "split_seed")


BAND_GRID_SQL = "(SELECT unnest([" + ", ".join(f"{g!r}e0" for g in GRID_120) + "]) AS g)"
INTERP = """CASE WHEN x0 IS NULL THEN v1 WHEN x0 = g OR x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (g - x0) / (x1 - x0) END"""


def interp_sql(src: str, keys: str, sign: str = "") -> str:
    return f"""ends AS (SELECT {keys}, g, max({{'x': x, 'o': {sign}v, 'v': v}}) FILTER (WHERE x <= g) AS lo, min({{'x': x, 'o': {sign}v, 'v': v}}) FILTER (WHERE x > g) AS hi
      FROM {src}, {BAND_GRID_SQL} GROUP BY ALL),
    interp AS (SELECT {keys}, g, lo['x'] AS x0, lo['v'] AS v0, hi['x'] AS x1, hi['v'] AS v1 FROM ends)"""


ROC_SRC = "roc AS (SELECT model, split_seed, fpr AS x, tpr AS v FROM pts WHERE keep AND n_pos > 0 AND n_neg > 0 UNION ALL SELECT DISTINCT model, split_seed, 0e0, 0e0 FROM pts WHERE n_pos > 0 AND n_neg > 0)"


@query(
    "roc_band",
    f"""{LPTS}, {ROC_SRC}, {interp_sql('roc', 'model, split_seed')}
    SELECT model, grid, {BAND} FROM (SELECT model, split_seed, g AS grid, CASE WHEN g = 0 THEN 0e0 ELSE {INTERP} END AS v FROM interp) GROUP BY ALL""",
    "grid mean sd lo hi",
)
def _(spark, sf):
    return roc_band(scored_lines(spark, sf), M, "split_seed")


@query(
    "pr_band",
    f"""{LPTS}, pr AS (SELECT model, split_seed, tpr AS x, prec AS v FROM pts WHERE n_pos > 0 AND n_neg > 0 UNION ALL SELECT DISTINCT model, split_seed, 0e0, 1e0 FROM pts WHERE n_pos > 0 AND n_neg > 0),
    {interp_sql('pr', 'model, split_seed', '-')}
    SELECT model, grid, {BAND} FROM (SELECT model, split_seed, g AS grid, {INTERP} AS v FROM interp) GROUP BY ALL""",
    "grid mean sd lo hi",
)
def _(spark, sf):
    return pr_band(scored_lines(spark, sf), M, "split_seed")


# ---------------------------------------------------------------- calibration
BIN = "(" + " + ".join(f"cast(p >= {e!r}e0 AS int)" for e in C.edges(10)) + ")"
LHIST = f"WITH {LINES}, {points_sql('lines', 'model, split_seed')}, b AS (SELECT model, split_seed, {BIN} AS bin, sum(pos + neg) AS n, sum(pos) AS pos, sum(p * (pos + neg)) AS sp FROM hist GROUP BY ALL)"


@query("ece", f"{LHIST} SELECT model, split_seed, sum(abs(sp / n - pos / n) * n / tot) AS ece FROM (SELECT *, sum(n) OVER (PARTITION BY model, split_seed) AS tot FROM b) GROUP BY ALL", "ece")
def _(spark, sf):
    return C.ece(scored_lines(spark, sf), LK)


@query(
    "brier_decomposition",
    f"""{LHIST}, c AS (SELECT *, sum(n) OVER w AS tot, sum(pos) OVER w / sum(n) OVER w AS bar FROM b WINDOW w AS (PARTITION BY model, split_seed)),
    d AS (SELECT model, split_seed, sum(n / tot * (pos / n - sp / n) ** 2) AS reliability, sum(n / tot * (pos / n - bar) ** 2) AS resolution, max(bar * (1 - bar)) AS uncertainty FROM c GROUP BY ALL)
    SELECT *, reliability - resolution + uncertainty AS brier_score FROM d""",
    "reliability resolution uncertainty brier_score",
)
def _(spark, sf):
    return C.brier_decomposition(scored_lines(spark, sf), LK)


@query(
    "spiegelhalter",
    f"""WITH {SCORED}, s AS (SELECT model, split, sum((y_true - y_prob) * (1 - 2 * y_prob)) AS num, sum(y_prob * (1 - y_prob) * (1 - 2 * y_prob) ** 2) AS var,
      min(y_true) AS a, max(y_true) AS b FROM scored GROUP BY ALL),
    z AS (SELECT model, split, CASE WHEN var > 0 AND a <> b THEN num / sqrt(var) END AS z FROM s)
    SELECT model, split, z, {two_sided_sql('z')} AS p_value, coalesce({two_sided_sql('z')} > 0.05e0, false) AS is_calibrated FROM z""",
    "z p_value",
)
def _(spark, sf):
    return C.spiegelhalter(scored(spark, sf), ["model", "split"])


@query("calibration_bins", f"{LHIST} SELECT model, split_seed, cast(bin AS int) AS bin, sp / n AS mean_score, pos / n AS observed_rate, cast(n AS bigint) AS n FROM b", "mean_score observed_rate")
def _(spark, sf):
    return C.calibration_bins(scored_lines(spark, sf), LK)


def qbin_sql(src: str, n_bins: int, keys: str = "model") -> str:
    qs = ", ".join(repr(i / n_bins) for i in range(1, n_bins))
    return f"""qe AS (SELECT {keys}, list_distinct(list_concat(quantile_cont(y_prob, [{qs}]), [])) AS e, min(y_prob) AS lo, max(y_prob) AS hi FROM {src} GROUP BY ALL),
    qb AS (SELECT s.*, len(list_filter(list_distinct(e), lambda x: x <= y_prob AND x > lo AND x < hi)) AS bin FROM {src} s JOIN qe USING ({keys}))"""


@query(
    "calibration_bins_quantile",
    f"""WITH {SCORED}, {qbin_sql('scored', 10)} SELECT model, cast(bin AS int) AS bin, avg(y_prob) AS mean_score, avg(y_true) AS observed_rate, count(*) AS n FROM qb GROUP BY ALL""",
    "mean_score observed_rate",
)
def _(spark, sf):
    return C.calibration_bins(scored(spark, sf), M, 10, "quantile")


@query(
    "adaptive_ece",
    f"""WITH RECURSIVE {SCORED}, {qbin_sql('scored', 10)},
    qs AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY bin) AS i, count(*) OVER (PARTITION BY model) AS nb, n, k, s
      FROM (SELECT model, bin, count(*) AS n, sum(y_true) * 1e0 AS k, sum(y_prob) AS s FROM qb GROUP BY ALL)),
    walk AS (SELECT model, 0::bigint AS i, 0e0 AS k, 0e0 AS s, 0e0 AS gap FROM (SELECT DISTINCT model FROM qs)
      UNION ALL SELECT w.model, q.i, CASE WHEN w.k + q.k >= 5 THEN 0e0 ELSE w.k + q.k END, CASE WHEN w.k + q.k >= 5 THEN 0e0 ELSE w.s + q.s END,
        w.gap + CASE WHEN w.k + q.k >= 5 THEN abs(w.s + q.s - w.k - q.k) ELSE 0e0 END FROM walk w JOIN qs q ON q.model = w.model AND q.i = w.i + 1)
    SELECT w.model, (gap + abs(s - k)) / tot AS adaptive_ece FROM walk w JOIN (SELECT model, max(nb) AS nb, sum(n) AS tot FROM qs GROUP BY ALL) t ON t.model = w.model AND w.i = t.nb""",
    "adaptive_ece",
)
def _(spark, sf):
    return C.adaptive_ece(scored(spark, sf), M)


@query(
    "calibration_band",
    f"{LHIST} SELECT model, cast(bin AS int) AS bin, {BAND} FROM (SELECT model, bin, pos / n AS v FROM b) GROUP BY ALL", "mean sd lo hi",
)
def _(spark, sf):
    return C.calibration_band(scored_lines(spark, sf), M, "split_seed")


@query(
    "smooth_errors",
    f"""WITH {SCORED}, g AS (SELECT model, y_true AS y, y_prob AS p, avg(y_prob) OVER w AS mu, stddev_pop(y_prob) OVER w AS sd FROM scored WHERE y_prob IS NOT NULL WINDOW w AS (PARTITION BY model)),
    z AS (SELECT model, y, p, (p - mu) / sd AS u FROM g),
    m AS (SELECT model, avg(u ** 3) AS m3, avg(u ** 4) AS m4, avg(u ** 5) AS m5, avg(u ** 6) AS m6, avg(y) AS t0, avg(y * u) AS t1, avg(y * u ** 2) AS t2, avg(y * u ** 3) AS t3 FROM z GROUP BY model HAVING count(DISTINCT p) >= 10),
    n2 AS (SELECT *, m4 - m3 * m3 - 1 AS n2, t2 - m3 * t1 - t0 AS y2, (m5 - m3 * m4 - m3) / (m4 - m3 * m3 - 1) AS c2 FROM m),
    f AS (SELECT *, y2 / n2 AS d2, (t3 - c2 * y2 - m4 * t1 - m3 * t0) / (m6 - c2 * c2 * n2 - m4 * m4 - m3 * m3) AS d3 FROM n2),
    e AS (SELECT model, abs(least(greatest(t0 + t1 * u + d2 * (u * u - m3 * u - 1) + d3 * (u * u * u - c2 * (u * u - m3 * u - 1) - m4 * u - m3), 0e0), 1e0) - p) AS err FROM z JOIN f USING (model))
    SELECT model, avg(err) AS ici, quantile_cont(err, 0.5) AS e50, quantile_cont(err, 0.9) AS e90 FROM e GROUP BY ALL""",
    "ici e50 e90",
)
def _(spark, sf):
    return C.smooth_errors(scored(spark, sf), M)


@query("calibration_table")
def _(spark, sf):
    return C.calibration_table(scored(spark, sf), M)


@query("fit_calibrator")
def _(spark, sf):
    s = scored(spark, sf)
    parts = [C.fit_calibrator(s, m, M) for m in C.METHODS[1:]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("apply_calibrator")
def _(spark, sf):
    s = scored(spark, sf)
    return C.apply_calibrator(s, C.fit_calibrator(s.filter("split = 'TRAIN'"), "logistic_full", M), M).select("id", "model", "y_prob_calibrated")


# Isotonic values by their max-min formula: T runs over block starts, suffix minima over block ends.
ISO = f"""WITH {SCORED}, h AS (SELECT model, y_prob AS p, sum(y_true) AS pos, count(*) AS n FROM scored WHERE y_prob IS NOT NULL GROUP BY ALL),
    c AS (SELECT model, p, row_number() OVER w AS i, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, pos, n FROM h WINDOW w AS (PARTITION BY model ORDER BY p)),
    t AS (SELECT a.model, a.i AS a, b.i AS b, (b.cp - a.cp + a.pos) / cast(b.cn - a.cn + a.n AS double) AS v FROM c a JOIN c b ON a.model = b.model AND b.i >= a.i),
    m AS (SELECT model, a, b, min(v) OVER (PARTITION BY model, a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS v FROM t),
    iso AS (SELECT model, b AS i, max(v) AS v FROM m GROUP BY ALL)"""


@query("isotonic_calibrator", f"{ISO} SELECT s.id, s.model, s.y_prob, v AS y_prob_calibrated FROM scored s JOIN c ON c.model = s.model AND c.p = s.y_prob JOIN iso ON iso.model = c.model AND iso.i = c.i", "y_prob y_prob_calibrated")
def _(spark, sf):
    s = scored(spark, sf)
    return C.apply_calibrator(s, C.fit_calibrator(s, "isotonic", M), M).select("id", "model", "y_prob", "y_prob_calibrated")


@query("isotonic_blocks", f"""{ISO} SELECT model, min(p) AS lo, max(p) AS hi, cast(sum(n) AS bigint) AS n, cast(sum(pos) AS bigint) AS pos, sum(pos) / cast(sum(n) AS double) AS value FROM c JOIN iso USING (model, i) GROUP BY model, round(v, 12)""", "lo hi value")
def _(spark, sf):
    return C.fit_isotonic(scored(spark, sf), M).select("model", "lo", "hi", "n", "pos", "value")


@query("calibrate_by_strategy", f"""{ISO} SELECT s.model, s.id, s.y_true, s.y_prob, CASE WHEN s.model = 'repeat' THEN s.y_prob ELSE v END AS y_prob_calibrated,
    CASE WHEN s.model <> 'repeat' THEN 'isotonic (oof_posthoc)' END AS calibrated_by FROM scored s JOIN c ON c.model = s.model AND c.p = s.y_prob JOIN iso ON iso.model = c.model AND iso.i = c.i""", "y_prob y_prob_calibrated")
def _(spark, sf):
    from ..operators.calibration_strategy import calibrate

    s = scored(spark, sf)
    once = calibrate(s, s, "oof_posthoc", "isotonic", {"repeat": "none"})
    # A second pass changes nothing: what is calibrated, or is not to be, stays.
    return calibrate(s, once.drop("y_prob_calibrated"), "oof_posthoc", "isotonic", {"repeat": "none"}).drop("y_prob_calibrated").join(once.select("model", "id", "y_prob_calibrated"), M + ["id"])


@query("per_fold_calibrate")
def _(spark, sf):
    return C.per_fold_calibrate(scored(spark, sf), M, "split_seed")


@query("fit_winner_calibrator")
def _(spark, sf):
    s = scored(spark, sf)
    auc = D.auroc(s, M)
    best = auc.agg(F.max_by("model", "auroc").alias("model"))
    return C.fit_winner_calibrator(s, best, M, "logistic_intercept", fold="split_seed")


@query("prevalence_check")
def _(spark, sf):
    return C.prevalence_check(scored(spark, sf), [0.05, 0.2, 0.5], M)
