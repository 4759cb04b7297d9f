"""Operating thresholds, confusion counts and threshold bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..core.keys import finite, join_on, ratio
from ..core.order import ordinal_rank, place_rows, running
from .discrimination import _fpr, _tpr, two_classes
from .hist import clean_scores, points_of


def fbeta_threshold_agg(beta: float = 1.0) -> Column:
    """Lowest threshold among those with the best F-beta."""
    b2 = (beta if beta > 0 else 1.0) ** 2
    prec = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    rec = F.when(F.col("n_pos") > 0, _tpr()).otherwise(F.lit(1.0))
    denom = F.lit(b2) * prec + rec
    f = F.when(denom > 0, F.lit(1.0 + b2) * prec * rec / denom).otherwise(F.lit(0.0))
    best = F.max(F.struct(f.alias("f"), (-F.col("p")).alias("np")))
    return -best["np"]


def _with_top_j(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    j = F.when(F.col("keep"), _tpr() - _fpr())
    top = points.groupBy(*keys).agg(F.greatest(F.max(j), F.lit(0.0)).alias("__top"))
    return join_on(points, top, keys).withColumn("__j", j)


def youden_threshold(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    on = F.abs(F.col("__j") - F.col("__top")) < F.lit(1e-10)
    mid = (F.max(F.when(on, F.col("p"))) + F.min(F.when(on, F.col("p")))) / F.lit(2.0)
    start_on_plateau = F.max("__top") < F.lit(1e-10)
    return _with_top_j(points, keys).groupBy(*keys).agg(
        F.when(two_classes() & ~start_on_plateau, mid).otherwise(F.lit(0.5)).alias("threshold")
    )


def specificity_threshold_agg(target: float = 0.95) -> Column:
    """Highest kept threshold reaching the best sensitivity with enough specificity."""
    ok = F.col("keep") & ((F.lit(1.0) - _fpr()) >= F.lit(target)) & (F.col("tp") > 0)
    best = F.max(F.when(ok, F.struct(F.col("tp"), F.col("p"))))
    return F.when(two_classes() & best.isNotNull(), best["p"]).otherwise(F.max("p") + F.lit(1e-12))


def sensitivity_threshold_agg(target: float = 0.95) -> Column:
    """Highest kept threshold with enough sensitivity."""
    ok = F.col("keep") & (_tpr() >= F.lit(target))
    return F.when(two_classes(), F.max(F.when(ok, F.col("p")))).otherwise(F.min("p") - F.lit(1e-12))


def precision_threshold_agg(target: float) -> Column:
    """Highest threshold with enough precision, else the best-F1 threshold."""
    if not 0 < target <= 1:
        return fbeta_threshold_agg(1.0)
    ok = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double") >= F.lit(target)
    return F.coalesce(F.max(F.when(ok, F.col("p"))), fbeta_threshold_agg(1.0))


def threshold_from_controls(df: DataFrame, keys: Sequence[str] = (), spec: float = 0.95, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """The 'higher' quantile of the control scores, read off their running count."""
    keys = list(keys)
    rows = clean_scores(df, y, p).filter(F.col(y) == 0)
    hist = rows.groupBy(*keys, F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("p").asc()]
    placed, place = place_rows(hist, keys, order, measure=df, limit=limit)
    cum = running(placed, keys, order, {"upto": ("sum", F.col("n"))}, place)
    n = hist.groupBy(*keys).agg(F.sum("n").alias("n_controls"))
    need = F.ceil(F.lit(spec) * (F.col("n_controls") - 1)) + 1
    return (
        join_on(cum, n, keys).filter(F.col("upto") >= need).groupBy(*keys)
        .agg(F.min("p").alias("threshold"), F.max("n_controls").alias("n_controls"))
    )


# Objective name -> aggregate over curve points.
OBJECTIVES = {
    "max_f1": lambda **k: fbeta_threshold_agg(1.0),
    "max_fbeta": lambda beta=1.0, **k: fbeta_threshold_agg(beta),
    "fixed_spec": lambda target=0.95, **k: specificity_threshold_agg(target),
    "fixed_sens": lambda target=0.95, **k: sensitivity_threshold_agg(target),
    "fixed_ppv": lambda target=0.5, **k: precision_threshold_agg(target),
}


def choose_threshold(df: DataFrame, keys: Sequence[str] = (), objective: str | None = None, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None, **kw) -> DataFrame:
    """Threshold per key: Youden when no objective is given, best F1 for an unknown one."""
    points = points_of(df, keys, y, p, limit=limit)
    if objective in (None, "", "youden"):
        return youden_threshold(points, keys)
    agg = OBJECTIVES.get(objective, OBJECTIVES["max_f1"])(**kw)
    return points.groupBy(*keys).agg(agg.alias("threshold"))


def confusion_columns(tp: Column, fp: Column, n_pos: Column, n_neg: Column) -> dict[str, Column]:
    """Counts and rates at a threshold; empty denominators give 0, no negatives give NULL specificity."""
    fn, tn = n_pos - tp, n_neg - fp
    zero = F.lit(0.0)
    spec = ratio(tn, n_neg)
    return {
        "tp": tp, "fp": fp, "tn": tn, "fn": fn,
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "sensitivity": F.coalesce(ratio(tp, n_pos), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        "specificity": spec,
        "fpr": F.lit(1.0) - spec,
    }


def confusion_at(df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", threshold: str = "threshold", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at each row of ``thresholds`` (keys, by..., threshold).

    Rows are first reduced to the score histogram; the threshold table has a few
    rows per key, so the product stays (distinct scores x thresholds per key)
    and is summed map-side.
    """
    from .hist import score_histogram

    keys, by = list(keys), list(by)
    hist = score_histogram(df, keys, y, p)
    both = join_on(hist, thresholds.select(*keys, *by, threshold), keys)
    hit = F.col("p") >= F.col(threshold)
    sums = both.groupBy(*keys, *by, threshold).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("__tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("__fp"),
        F.sum("pos").alias("__np"), F.sum("neg").alias("__nn"),
    )
    cols = confusion_columns(*(F.col(c) for c in ("__tp", "__fp", "__np", "__nn")))
    return sums.select(*keys, *by, threshold, *[c.alias(n) for n, c in cols.items()])


def multi_specificity(df: DataFrame, targets: Sequence[float], keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Threshold, sensitivity, precision and specificity for each target; one-class groups drop out."""
    keys = list(keys)
    points = points_of(df, keys, y, p, limit=limit)
    wide = points.groupBy(*keys).agg(
        two_classes().alias("__ok"), *[specificity_threshold_agg(t).alias(f"t{i}") for i, t in enumerate(sorted(targets))]
    ).filter("__ok")
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("target_spec"), F.col(f"t{i}").alias("threshold")) for i, t in enumerate(sorted(targets))])
    thr = wide.select(*keys, F.inline(pairs))
    return confusion_at(df, thr, keys, y, p, by=["target_spec"]).select(
        *keys, "target_spec", "threshold", "sensitivity", "precision", "specificity"
    )


def threshold_bundle(df: DataFrame, keys: Sequence[str] = (), target_spec: float = 0.95, dca_threshold: float | None = None, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """One row per key and threshold type: Youden, specificity target, optional decision-curve point."""
    keys = list(keys)
    points = points_of(df, keys, y, p, limit=limit)
    yd = youden_threshold(points, keys).select(*keys, F.lit("youden").alias("threshold_type"), "threshold")
    sp = points.groupBy(*keys).agg(specificity_threshold_agg(target_spec).alias("threshold"))
    parts = [yd, sp.select(*keys, F.lit("spec_target").alias("threshold_type"), "threshold")]
    if dca_threshold is not None:
        parts.append(sp.select(*keys, F.lit("dca").alias("threshold_type"), F.lit(float(dca_threshold)).alias("threshold")))
    thr = reduce(DataFrame.unionByName, parts)
    return confusion_at(df, thr, keys, y, p, by=["threshold_type"])


def threshold_transfer(df: DataFrame, keys: Sequence[str] = (), split: str = "split", chosen_on: str = "VAL", applied_to: str = "TEST", objective: str | None = None, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None, **kw) -> DataFrame:
    """Choose on one split, count on another: the test rows never influence the threshold."""
    thr = choose_threshold(df.filter(F.col(split) == chosen_on), keys, objective, y, p, limit=limit, **kw)
    return confusion_at(df.filter(F.col(split) == applied_to), thr, keys, y, p)


def top_risk_capture(df: DataFrame, fracs: Sequence[float], keys: Sequence[str] = (), id_col: str = "id", y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Cases and controls among the top ceil(frac n) scores; ties by id.

    Scores above the cut are counted from the curve points; only the rows that
    share the cut score are ordered by id.
    """
    keys = list(keys)
    rows = clean_scores(df, y, p)
    points = points_of(df, keys, y, p, limit=limit)
    n = points.groupBy(*keys).agg(F.max("n_pos").alias("total_cases"), (F.max("n_pos") + F.max("n_neg")).alias("n"))
    cut = n.select(*keys, "total_cases", "n", F.explode(F.array(*[F.lit(float(f)) for f in fracs])).alias("frac"))
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("frac") * F.col("n")))).cast("bigint")
    cut = cut.withColumn("n_top", k).drop("n")
    seen = F.col("tp") + F.col("fp")
    at = join_on(points, cut, keys).filter(seen >= F.col("n_top")).groupBy(*keys, "frac", "n_top", "total_cases").agg(
        F.max(F.struct("p", (F.col("tp") - F.col("pos")).alias("cases_above"), (seen - F.col("pos") - F.col("neg")).alias("above"))).alias("s")
    ).select(*keys, "frac", "n_top", "total_cases", "s.*")
    ties = rows.select(*keys, (F.col(p).cast("double") + F.lit(0.0)).alias("p"), id_col, F.col(y).cast("bigint").alias("__y"))
    ties = join_on(ties, at.select(*keys, "p").distinct(), [*keys, "p"], "left_semi")
    ties = ordinal_rank(ties, [*keys, "p"], [F.col(id_col)], "__rn", measure=df, limit=limit)
    got = join_on(ties, at, [*keys, "p"]).filter(F.col("__rn") <= F.col("n_top") - F.col("above"))
    out = got.groupBy(*keys, "frac", "n_top", "total_cases", "cases_above").agg(F.sum("__y").alias("__t"))
    cases = F.col("cases_above") + F.col("__t")
    return out.select(
        *keys, "frac", "n_top", cases.alias("cases_in_top"), (F.col("n_top") - cases).alias("controls_in_top"),
        ratio(cases, F.col("total_cases")).alias("case_capture"),
    )


def waterfall_samples(df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = (), n_each: int = 1, id_col: str = "id", y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Per key the best-scored TP, FP and FN, and the TN nearest to the threshold."""
    keys = list(keys)
    rows = join_on(clean_scores(df, y, p), thresholds.select(*keys, "threshold"), keys)
    hit, case = F.col(p) >= F.col("threshold"), F.col(y) == 1
    kind = F.when(hit & case, "TP").when(hit, "FP").when(case, "FN").otherwise("TN")
    near = F.when(kind == "TN", F.abs(F.col(p) - F.col("threshold"))).otherwise(-F.col(p))
    rows = rows.select(*keys, id_col, y, p, kind.alias("outcome_type"), near.alias("__near"))
    if n_each == 1:
        # one sample per class is an aggregate, no ordering needed
        pick = rows.groupBy(*keys, "outcome_type").agg(F.min(F.struct("__near", id_col, p)).alias("s"))
        return pick.select(*keys, "outcome_type", F.lit(1).alias("pick"), F.col(f"s.{id_col}").alias(id_col), F.col(f"s.{p}").alias(p))
    ranked = ordinal_rank(rows, [*keys, "outcome_type"], [F.col("__near"), F.col(id_col)], "pick", measure=df, limit=limit)
    return ranked.filter(F.col("pick") <= n_each).select(*keys, "outcome_type", F.col("pick").cast("int").alias("pick"), id_col, p)


def score_range_check(df: DataFrame, keys: Sequence[str] = (), p: str = "y_prob") -> DataFrame:
    """Rows, and rows whose score is missing, not finite or outside [0, 1]."""
    good = finite(F.col(p)) & F.col(p).between(0.0, 1.0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(finite(F.col(p)), 0).otherwise(1)).alias("n_not_finite"),
        F.sum(F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1)).alias("n_bad"),
    )
