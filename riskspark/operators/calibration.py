"""Calibration errors, bins, tests and recalibration of scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.keys import join_on, ratio
from ..core.newton import grouped_logistic
from ..core.quantile import quantiles
from ..core.tails import two_sided_p
from ..functions.scalar import adjust_prevalence, clip, inv_logit, jeffreys, logit
from .dca import band
from .discrimination import curve_metrics
from .hist import clean_scores, curve_points, score_histogram
from .isotonic import apply_isotonic, fit_isotonic


def edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(1, n_bins)]


def uniform_bin(p: Column, n_bins: int = 10) -> Column:
    """0-based bin over [0, 1]; inner edges belong to the upper bin."""
    out = F.lit(0)
    for e in edges(n_bins):
        out = out + (p >= F.lit(e)).cast("int")
    return out


def _bin_sums(hist: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return hist.groupBy(*keys, uniform_bin(F.col("p"), n_bins).alias("bin")).agg(
        F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("p") * n).alias("sum_p")
    )


def ece(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Expected calibration error over uniform bins; scores outside [0, 1] count in the total only."""
    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    n = F.col("pos") + F.col("neg")
    total = hist.groupBy(*keys).agg(F.sum(n).alias("__all"))
    bins = join_on(_bin_sums(hist.filter(F.col("p").between(0.0, 1.0)), keys, n_bins), total, keys)
    gap = F.abs(F.col("sum_p") / F.col("n") - F.col("pos") / F.col("n")) * F.col("n") / F.col("__all")
    return bins.groupBy(*keys).agg(F.sum(gap).alias("ece"))


def brier_decomposition(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Reliability, resolution, uncertainty; the score is rel - res + unc over bin means."""
    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    base = hist.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("__n"), F.sum("pos").alias("__p"))
    bins = join_on(_bin_sums(hist, keys, n_bins), base, keys)
    o, q, bar = F.col("pos") / F.col("n"), F.col("sum_p") / F.col("n"), F.col("__p") / F.col("__n")
    w = F.col("n") / F.col("__n")
    out = bins.groupBy(*keys).agg(
        F.sum(w * (o - q) * (o - q)).alias("reliability"), F.sum(w * (o - bar) * (o - bar)).alias("resolution"),
        F.max(bar * (F.lit(1.0) - bar)).alias("uncertainty"),
    )
    return out.withColumn("brier_score", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def spiegelhalter(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """z test of calibration; NULL for one class or no variance."""
    rows = clean_scores(df, y, p)
    w = F.lit(1.0) - F.lit(2.0) * F.col(p)
    agg = rows.groupBy(*keys).agg(
        F.sum((F.col(y) - F.col(p)) * w).alias("__num"), F.sum(F.col(p) * (F.lit(1.0) - F.col(p)) * w * w).alias("__var"),
        F.min(y).alias("__lo"), F.max(y).alias("__hi"),
    )
    z = F.when((F.col("__var") > 0) & (F.col("__lo") != F.col("__hi")), F.col("__num") / F.sqrt("__var"))
    return agg.select(*keys, z.alias("z")).withColumn("p_value", two_sided_p(F.col("z"))).withColumn(
        "is_calibrated", F.coalesce(F.col("p_value") > 0.05, F.lit(False))
    )


def _score_counts(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hist.select(*keys, "p", (F.col("pos") + F.col("neg")).alias("n"))


def quantile_edges(hist: DataFrame, keys: Sequence[str], n_bins: int, *, measure: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(keys, edges): distinct quantile edges of the scores, n_bins + 1 at most."""
    qs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    wide = quantiles(_score_counts(hist, keys), keys, "p", qs, measure=measure, limit=limit)
    return wide.select(*keys, F.array_sort(F.array_distinct(F.array(*qs))).alias("edges"))


def quantile_binned(hist: DataFrame, keys: Sequence[str], n_bins: int, *, measure: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Histogram rows with their quantile bin (inner edges belong to the upper bin)."""
    e = quantile_edges(hist, keys, n_bins, measure=measure, limit=limit)
    both = join_on(hist, e, keys)
    inner = F.slice(F.col("edges"), F.lit(2), F.greatest(F.array_size("edges") - 2, F.lit(0)))
    bin_ = F.size(F.filter(inner, lambda x: x <= F.col("p")))
    return both.withColumn("bin", bin_).drop("edges")


def calibration_bins(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, strategy: str = "uniform", y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Mean score, observed rate and count of each non-empty bin."""
    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    if strategy == "uniform":
        bins = _bin_sums(hist, keys, n_bins)
    else:
        n = F.col("pos") + F.col("neg")
        bins = quantile_binned(hist, keys, n_bins, measure=df, limit=limit).groupBy(*keys, "bin").agg(
            F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("p") * n).alias("sum_p")
        )
    return bins.select(
        *keys, "bin", ratio(F.col("sum_p"), F.col("n")).alias("mean_score"),
        ratio(F.col("pos"), F.col("n")).alias("observed_rate"), "n",
    )


def calibration_band(df: DataFrame, keys: Sequence[str], split: str, n_bins: int = 10, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Observed rate per split and bin, then mean, sd and percentiles over splits."""
    return band(calibration_bins(df, [*keys, split], n_bins, "uniform", y, p), [*keys, "bin"], "observed_rate")


def adaptive_ece(df: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, min_events: int = 5, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Quantile bins merged left to right until each holds enough positives."""
    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    n = F.col("pos") + F.col("neg")
    bins = quantile_binned(hist, keys, n_bins, measure=df, limit=limit).groupBy(*keys, "bin").agg(
        F.sum(n).cast("double").alias("n"), F.sum("pos").cast("double").alias("k"), F.sum(F.col("p") * n).alias("s")
    )
    # at most n_bins entries per key
    arr = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "k", "s"))).alias("b"), F.sum("n").alias("total"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "k", "s", "gap")])

    def step(acc: Column, x: Column) -> Column:
        nn, kk, ss = acc["n"] + x["n"], acc["k"] + x["k"], acc["s"] + x["s"]
        close = kk >= F.lit(float(min_events))
        gap = acc["gap"] + F.when(close, F.abs(ss - kk)).otherwise(F.lit(0.0))
        keep = lambda v: F.when(close, F.lit(0.0)).otherwise(v)
        return F.struct(keep(nn).alias("n"), keep(kk).alias("k"), keep(ss).alias("s"), gap.alias("gap"))

    # |mean score - rate| * share = |sum of scores - positives| / all rows; what
    # is left open after the last bin forms the last group.
    total = F.aggregate(F.col("b"), zero, step, lambda a: a["gap"] + F.abs(a["s"] - a["k"]))
    return arr.select(*keys, (total / F.col("total")).alias("adaptive_ece"))


def smooth_errors(df: DataFrame, keys: Sequence[str] = (), min_distinct: int = 10, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """ICI, E50 and E90: mean, median and 90th percentile of |curve - score|, the curve clipped to [0, 1].

    The curve is the cubic smoothing spline of the labels with a residual bound of one per row.  Residuals
    of binary labels around their mean never reach that bound, so the spline needs no inner knot and is the
    least-squares cubic.  It follows from sums of powers: two aggregates, and no curve in one
    place.  Groups with fewer than ``min_distinct`` distinct scores give NULL.
    """
    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    n = (F.col("pos") + F.col("neg")).cast("double")
    mean = hist.groupBy(*keys).agg(F.sum(n).alias("__n"), (F.sum(F.col("p") * n) / F.sum(n)).alias("__m"), F.count(F.lit(1)).alias("__d"))
    rows = join_on(hist, mean, keys).filter(F.col("__d") >= min_distinct)
    gap = F.col("p") - F.col("__m")
    sd = rows.groupBy(*keys).agg(F.sqrt(F.sum(gap * gap * n) / F.max("__n")).alias("__sd"))
    rows = join_on(rows, sd, keys).withColumn("u", gap / F.col("__sd"))
    power = lambda k: F.pow(F.col("u"), F.lit(float(k)))
    sums = [(F.sum(power(k) * n) / F.max("__n")).alias(f"m{k}") for k in (3, 4, 5, 6)] + [(F.sum(power(k) * F.col("pos")) / F.max("__n")).alias(f"t{k}") for k in range(4)]
    m = {k: F.col(f"m{k}") for k in (3, 4, 5, 6)}
    t = {k: F.col(f"t{k}") for k in range(4)}
    # Orthogonal polynomials of u, which has mean 0 and variance 1: 1, u, u^2 - m3 u - 1 and one of third degree.
    fit = rows.groupBy(*keys).agg(*sums).withColumn("n2", m[4] - m[3] * m[3] - 1)
    fit = fit.withColumns({"c2": (m[5] - m[3] * m[4] - m[3]) / F.col("n2"), "y2": t[2] - m[3] * t[1] - t[0]})
    fit = fit.withColumns({"n3": m[6] - F.col("c2") * F.col("c2") * F.col("n2") - m[4] * m[4] - m[3] * m[3], "y3": t[3] - F.col("c2") * F.col("y2") - m[4] * t[1] - m[3] * t[0]})
    fit = fit.select(*keys, "t0", "t1", "m3", "m4", "c2", (F.col("y2") / F.col("n2")).alias("d2"), (F.col("y3") / F.col("n3")).alias("d3"))
    u = F.col("u")
    q2 = u * u - m[3] * u - 1
    curve = t[0] + t[1] * u + F.col("d2") * q2 + F.col("d3") * (u * u * u - F.col("c2") * q2 - m[4] * u - m[3])
    errs = join_on(rows.select(*keys, "u", "p", n.alias("n")), fit, keys).select(*keys, F.abs(clip(curve, 0.0, 1.0) - F.col("p")).alias("err"), "n")
    per = errs.groupBy(*keys).agg((F.sum(F.col("err") * F.col("n")) / F.sum("n")).alias("ici"))
    counts = errs.groupBy(*keys, "err").agg(F.sum("n").cast("bigint").alias("n"))
    q = quantiles(counts, keys, "err", {"e50": 0.5, "e90": 0.9}, measure=df, limit=limit)
    out = join_on(mean.select(*keys), join_on(per, q, keys), keys, "left")
    return out.select(*keys, "ici", "e50", "e90")


def calibration_line(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", settled_only: bool = True) -> DataFrame:
    """Intercept and slope of the logistic regression of the label on logit(score); NULL for a fit that has not settled.

    Without ``settled_only`` such a fit (classes that the score separates have no finite one) gives the values of its last step.
    """
    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    fit = grouped_logistic(hist, keys, [F.lit(1.0), logit("p")], with_steps=True)
    if settled_only:
        fit = fit.withColumns({c: F.when(F.col("converged"), F.col(c)) for c in ("b0", "b1")})
    both = hist.groupBy(*keys).agg((F.sum("pos") > 0).alias("a"), (F.sum("neg") > 0).alias("b"))
    out = join_on(fit, both, keys)
    ok = F.col("a") & F.col("b")
    return out.select(*keys, F.when(ok, F.col("b0")).alias("intercept"), F.when(ok, F.col("b1")).alias("slope"))


def calibration_table(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Calibration line, ECE, adaptive ECE, smoothed errors, z test and Brier parts per key."""
    out = ece(df, keys, 10, y, p)
    for part in (
        adaptive_ece(df, keys, 10, 5, y, p, limit=limit), smooth_errors(df, keys, y=y, p=p, limit=limit),
        spiegelhalter(df, keys, y, p), brier_decomposition(df, keys, 10, y, p), calibration_line(df, keys, y, p),
    ):
        out = join_on(out, part, list(keys), "left")
    return out


def binned_logits(df: DataFrame, keys: Sequence[str] = (), id_col: str = "id", n_bins: int = 10, n_boot: int = 200, seed: int = 42, y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Per quantile bin: logit of the mean score, logit of the smoothed rate, bootstrap sd and CI."""
    from .resample import draw_targets

    keys = list(keys)
    hist = score_histogram(df, keys, y, p)
    e = quantile_edges(hist, keys, n_bins, measure=df, limit=limit)
    rows = join_on(clean_scores(df, y, p).select(*keys, id_col, F.col(y).cast("bigint").alias("__y"), F.col(p).alias("__p")), e, keys)
    inner = F.slice(F.col("edges"), F.lit(2), F.greatest(F.array_size("edges") - 2, F.lit(0)))
    rows = rows.withColumn("bin", F.size(F.filter(inner, lambda x: x <= F.col("__p")))).drop("edges")
    by = [*keys, "bin"]
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("k"), F.avg("__p").alias("mean_score"))
    # A resample of a bin only needs its number of positives: draws aimed at
    # index <= k count as positives, so no row has to be looked up.
    draws = draw_targets(rows, by, id_col, n_boot, seed)
    boot = join_on(draws, stats.select(*by, "k"), by).groupBy(*by, "b").agg(
        F.sum(F.when(F.col("target") < F.col("k"), 1).otherwise(0)).alias("kb"), F.count(F.lit(1)).alias("nb")
    ).withColumn("lb", logit(jeffreys("kb", "nb")))
    ci = boot.groupBy(*by).agg(
        F.percentile("lb", F.lit(0.025)).alias("logit_obs_lo"), F.percentile("lb", F.lit(0.975)).alias("logit_obs_hi"), F.stddev_pop("lb").alias("logit_obs_sd")
    )
    out = join_on(stats, ci, by)
    return out.select(*by, "n", logit("mean_score").alias("logit_pred"), logit(jeffreys("k", "n")).alias("logit_obs"), "logit_obs_lo", "logit_obs_hi", "logit_obs_sd")


METHODS = ("isotonic", "logistic_full", "logistic_intercept", "beta")


def fit_calibrator(df: DataFrame, method: str, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", min_rows: int = 50, settled_only: bool = True) -> DataFrame:
    """Recalibration per key: columns method, b0..b2, ``fitted`` and ``converged``; isotonic: blocks, see ``isotonic``.

    Groups with fewer than ``min_rows`` finite rows or one class, and groups whose fit was still
    moving after its last step, stay unfitted and later leave scores unchanged.  Without ``settled_only``
    the latter count as fitted with the values of that step.
    """
    keys = list(keys)
    if method == "isotonic":
        return fit_isotonic(df, keys, y, p, min_rows)
    hist = score_histogram(df, keys, y, p)
    if method == "logistic_full":
        fit = grouped_logistic(hist, keys, [F.lit(1.0), logit("p")], with_steps=True).withColumn("b2", F.lit(0.0))
    elif method == "logistic_intercept":
        fit = grouped_logistic(hist, keys, [F.lit(1.0)], offset=logit("p"), with_steps=True).withColumns({"b1": F.lit(1.0), "b2": F.lit(0.0)})
    elif method == "beta":
        q = clip(F.col("p"), 1e-7, 1.0 - 1e-7)
        fit = grouped_logistic(hist, keys, [F.lit(1.0), F.log(q), F.log(F.lit(1.0) - q)], with_steps=True)
    else:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    n = hist.groupBy(*keys).agg(F.sum("pos").alias("__np"), F.sum("neg").alias("__nn"))
    ok = (F.col("__np") + F.col("__nn") >= min_rows) & (F.col("__np") > 0) & (F.col("__nn") > 0)
    fitted = ok & F.col("converged") if settled_only else ok
    return join_on(fit, n, keys).select(*keys, F.lit(method).alias("method"), "b0", "b1", "b2", fitted.alias("fitted"), "converged")


def apply_calibrator(df: DataFrame, calibrator: DataFrame, keys: Sequence[str] = (), p: str = "y_prob", out: str = "y_prob_calibrated") -> DataFrame:
    """Calibrated score, clipped to [0, 1]; unfitted or unknown groups keep their score."""
    keys = list(keys)
    if "next_value" in calibrator.columns:
        return apply_isotonic(df, calibrator, keys, p, out)
    both = join_on(df, calibrator.select(*keys, "method", "b0", "b1", "b2", "fitted"), keys, "left")
    q = clip(F.col(p), 1e-7, 1.0 - 1e-7)
    beta = F.col("b0") + F.col("b1") * F.log(q) + F.col("b2") * F.log(F.lit(1.0) - q)
    line = F.col("b0") + F.col("b1") * logit(p)
    eta = F.when(F.col("method") == "beta", beta).otherwise(line)
    val = F.when(F.coalesce(F.col("fitted"), F.lit(False)), clip(inv_logit(eta), 0.0, 1.0)).otherwise(F.col(p))
    return both.withColumn(out, F.when(F.col(p).isNotNull(), val)).drop("method", "b0", "b1", "b2", "fitted")


def fit_winner_calibrator(oof: DataFrame, winners: DataFrame, on: Sequence[str], method: str, id_col: str = "id", fold: str = "fold", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Calibrator of the winning configuration on the first fold of each subject."""
    rows = oof.join(winners.select(*on).distinct(), list(on), "left_semi")
    first = rows.groupBy(*on, id_col).agg(F.min(F.struct(F.col(fold), F.col(y), F.col(p))).alias("s"))
    return fit_calibrator(first.select(*on, F.col(f"s.{y}").alias(y), F.col(f"s.{p}").alias(p)), method, list(on), y, p)


def per_fold_calibrate(oof: DataFrame, keys: Sequence[str], fold: str, method: str = "logistic_full", id_col: str = "id", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Each subject's score calibrated by the calibrators of the other folds, averaged.

    All (key, held-out fold) calibrators are fitted in one grouped job.
    """
    keys = list(keys)
    folds = oof.select(*keys, F.col(fold).alias("__cf")).distinct()
    train = join_on(oof, folds, keys).filter(F.col("__cf") != F.col(fold))
    cal = fit_calibrator(train, method, [*keys, "__cf"], y, p)
    done = apply_calibrator(join_on(oof, folds, keys).filter(F.col("__cf") == F.col(fold)), cal, [*keys, "__cf"], p)
    return done.groupBy(*keys, id_col, y).agg(F.avg("y_prob_calibrated").alias("y_prob_calibrated"))


def prevalence_check(df: DataFrame, targets: Sequence[float], keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Mean raw and adjusted scores per target prevalence, errors, AUROC and calibration line before and after."""
    keys = list(keys)
    rows = clean_scores(df, y, p)
    base = rows.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("sample_prevalence"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_prevalence")
    cross = join_on(rows, base, keys).select(*keys, "sample_prevalence", y, p, grid)
    adj = cross.withColumn("__adj", adjust_prevalence(p, F.col("sample_prevalence"), F.col("target_prevalence")))
    by = [*keys, "target_prevalence"]
    t = F.col("target_prevalence")
    stats = adj.groupBy(*by).agg(
        F.max("sample_prevalence").alias("sample_prevalence"), F.avg(p).alias("mean_raw"), F.avg("__adj").alias("mean_adjusted")
    ).withColumns({"abs_error": F.abs(F.col("mean_adjusted") - t), "rel_error": F.abs(F.col("mean_adjusted") - t) / t})
    for tag, score in (("raw", p), ("adjusted", "__adj")):
        hist = score_histogram(adj, by, y, score)
        auc = curve_metrics(curve_points(hist, by, measure=df, p=p if tag == "raw" else None, limit=limit), by, ["auroc"]).withColumnRenamed("auroc", f"auroc_{tag}")
        line = calibration_line(adj, by, y, score).withColumnsRenamed({"intercept": f"intercept_{tag}", "slope": f"slope_{tag}"})
        stats = join_on(join_on(stats, auc, by), line, by)
    return stats
