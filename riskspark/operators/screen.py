"""Univariate feature screens over the long table (id, y, feature, x).

All features are tested in one job; a test only needs class counts at each
distinct value, so rows shrink map-side before they are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.keys import col_of, finite, join_on, ratio
from ..core.newton import grouped_logistic
from ..core.order import ordinal_rank, place_rows, running
from ..core.tails import f_sf, two_sided_p


def value_counts(long: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x", weight: Column | str | None = None) -> DataFrame:
    """(keys, feature, x, n0, n1): class counts at each distinct value."""
    w = F.lit(1).cast("bigint") if weight is None else col_of(weight)
    rows = long.filter(finite(F.col(x).cast("double")) & F.col(y).isin(0, 1))
    return rows.groupBy(*keys, "feature", (F.col(x).cast("double") + F.lit(0.0)).alias("x")).agg(
        F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("n0"), F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("n1")
    )


def mann_whitney(long: DataFrame, min_total: int = 20, min_class: int = 10, keys: Sequence[str] = (), y: str = "y", x: str = "x", weight: Column | str | None = None, *, measure: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Two-sided rank-sum p (ties and continuity corrected), |mean difference|, non-missing share."""
    by = [*keys, "feature"]
    counts = value_counts(long, keys, y, x, weight)
    order = [F.col("x").asc()]
    placed, place = place_rows(counts, by, order, measure=long if measure is None else measure, limit=limit)
    t = F.col("n0") + F.col("n1")
    cum = running(placed, by, order, {"__u": ("sum", t)}, place)
    mid = F.col("__u") - (t - 1) / 2.0
    td = t.cast("double")
    agg = cum.groupBy(*by).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("n1") * mid).alias("__r1"), F.sum(td * td * td - td).alias("__ties"),
        F.sum(F.col("x") * F.col("n0")).alias("__s0"), F.sum(F.col("x") * F.col("n1")).alias("__s1"),
    ).filter((F.col("n0") + F.col("n1") >= min_total) & (F.col("n0") >= min_class) & (F.col("n1") >= min_class))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u1 = F.col("__r1") - n1 * (n1 + 1) / 2
    mu = n0 * n1 / 2
    sd = F.sqrt(n0 * n1 / 12.0 * (n + 1 - F.col("__ties") / (n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(u1, n0 * n1 - u1) - mu - 0.5) / sd)
    total = long.groupBy(*by).agg((F.count(F.lit(1)) if weight is None else F.sum(col_of(weight))).alias("__all"))
    out = join_on(agg, total, by)
    return out.select(
        *by, F.when(z < 0, F.lit(1.0)).otherwise(two_sided_p(z)).alias("p_value"),
        F.abs(F.col("__s1") / n1 - F.col("__s0") / n0).alias("effect_size"), ((n0 + n1) / F.col("__all")).alias("nonmissing_frac"),
    )


def ranked_screen(stats: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), top: int = 0, *, measure: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    out = ordinal_rank(stats, keys, [*order, F.col("feature")], "rank", measure=measure, limit=limit)
    return out.filter(F.col("rank") <= top) if top > 0 else out


def mann_whitney_screen(long: DataFrame, top: int = 0, min_n: int = 10, keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """Features by p, then larger effect; ``top`` <= 0 keeps all."""
    stats = mann_whitney(long, 2 * min_n, min_n, keys, limit=limit)
    return ranked_screen(stats, [F.col("p_value").asc_nulls_last(), F.col("effect_size").desc()], keys, top, measure=long, limit=limit)


def univariate_strength(long: DataFrame, keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """p and |mean difference| where at least 30 rows and 5 per class exist."""
    return mann_whitney(long, 30, 5, keys, limit=limit).select(*keys, "feature", "p_value", "effect_size")


def f_statistics(long: DataFrame, keys: Sequence[str] = (), min_class: int = 1, y: str = "y", x: str = "x") -> DataFrame:
    """Two-group ANOVA F and p; features constant within both classes drop out."""
    by = [*keys, "feature"]
    rows = long.filter(finite(F.col(x).cast("double")) & F.col(y).isin(0, 1))
    per = rows.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    pick = lambda c, k: F.max(F.when(F.col(y) == k, F.col(c)))
    wide = per.groupBy(*by).agg(*[pick(c, k).alias(f"{c}{k}") for c in ("n", "m", "v") for k in (0, 1)])
    wide = wide.filter((F.col("n0") >= min_class) & (F.col("n1") >= min_class) & ((F.col("v0") > 0) | (F.col("v1") > 0)))
    n = F.col("n0") + F.col("n1")
    between = F.col("n0") * F.col("n1") / n * (F.col("m1") - F.col("m0")) * (F.col("m1") - F.col("m0"))
    within = F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1")
    out = wide.select(*by, F.try_divide(between, F.try_divide(within, n - 2)).alias("f_score"), (n - 2).cast("double").alias("__d"), F.abs(F.col("m1") - F.col("m0")).alias("effect_size"))
    return out.select(*by, "f_score", "effect_size", f_sf(F.col("f_score"), F.lit(1.0), F.col("__d")).alias("p_value"))


def f_screen(long: DataFrame, top: int = 0, keys: Sequence[str] = (), min_class: int = 10, *, limit: int | None = None) -> DataFrame:
    return ranked_screen(f_statistics(long, keys, min_class), [F.col("f_score").desc()], keys, top, measure=long, limit=limit)


def kbest(long: DataFrame, k: int, keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """The k features with the largest F."""
    stats = f_statistics(long, keys).select(*keys, "feature", "f_score")
    return ranked_screen(stats, [F.col("f_score").desc()], keys, max(1, k), measure=long, limit=limit)


def wald_statistics(long: DataFrame, keys: Sequence[str] = (), max_iter: int = 25, tol: float = 1e-8, y: str = "y", x: str = "x") -> DataFrame:
    """|slope / se| of the univariate logistic fit on z-scores, all features per Newton step; NULL for a fit that has not settled."""
    by = [*keys, "feature"]
    filled = long.withColumn(x, F.coalesce(F.when(finite(F.col(x).cast("double")), F.col(x).cast("double")), F.lit(0.0)))
    counts = value_counts(filled, keys, y, x)
    n = F.col("n0") + F.col("n1")
    m = counts.groupBy(*by).agg(F.sum(n).alias("__n"), (F.sum(F.col("x") * n) / F.sum(n)).alias("__m"), F.sum("n1").alias("__p"))
    both = join_on(counts, m, by)
    sd = both.groupBy(*by).agg(F.sqrt(F.sum((F.col("x") - F.col("__m")) * (F.col("x") - F.col("__m")) * n) / F.max("__n")).alias("__sd"))
    both = join_on(both, sd, by).filter((F.col("__p") > 0) & (F.col("__p") < F.col("__n")))
    z = (F.col("x") - F.col("__m")) / F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(F.lit(1.0))
    fit = grouped_logistic(both, by, [F.lit(1.0), z], pos="n1", neg="n0", max_iter=max_iter, tol=tol, with_se=True, with_steps=True)
    settled = lambda c: F.when(F.col("converged"), c)
    stat = settled(F.when(F.col("se1") > 0, F.abs("b1") / F.col("se1")).otherwise(F.lit(0.0)))
    return fit.select(*by, settled(F.col("b1")).alias("beta"), settled(F.col("se1")).alias("se"), stat.alias("wald_statistic")).withColumn("p_value", two_sided_p(F.col("wald_statistic")))


def wald_screen(long: DataFrame, top: int = 0, keys: Sequence[str] = (), max_iter: int = 25, tol: float = 1e-8, *, limit: int | None = None) -> DataFrame:
    return ranked_screen(wald_statistics(long, keys, max_iter, tol), [F.col("wald_statistic").desc_nulls_last()], keys, top, measure=long, limit=limit)


SCREENS = {"mannwhitney": mann_whitney_screen, "f_classif": f_screen, "wald": wald_screen}


def screen(long: DataFrame, method: str = "mannwhitney", top: int = 0, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Ranked features by the named method, at most ``top`` of them when positive."""
    if method not in SCREENS:
        raise ValueError(f"unknown screening method {method}; one of {sorted(SCREENS)}")
    return SCREENS[method](long, top, keys=keys, **kw)


def selection_frequency(log: DataFrame, keys: Sequence[str] = (), selected: str = "selected", split: Sequence[str] = ()) -> DataFrame:
    """Share of splits that name the feature; a split counts a feature once.

    A log has one row per split with a list, or (``split``: its columns) one row per split and feature.
    """
    if split:
        n = log.select(*keys, *split).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        named = log.select(*keys, *split, F.col(selected).alias("feature")).distinct()
    else:
        n = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        named = log.select(*keys, F.explode(F.array_distinct(selected)).alias("feature"))
    hit = named.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n_selected"))
    return join_on(hit, n, list(keys)).select(*keys, "feature", "n_selected", ratio(F.col("n_selected"), F.col("__n")).alias("selection_freq"))


def rank_by_frequency(freq: DataFrame, keys: Sequence[str] = (), value: str = "selection_freq", *, limit: int | None = None) -> DataFrame:
    return ordinal_rank(freq, keys, [F.col(value).desc(), F.col("feature")], "rank", limit=limit)


def stable_panel(log: DataFrame, n_repeats: int, threshold: float = 0.75, keys: Sequence[str] = (), repeat: str = "repeat", selected: str = "selected", fallback: int = 20, *, limit: int | None = None) -> DataFrame:
    """Frequency over the per-repeat unions; the top ``fallback`` features (a rule of the method) when none is stable.

    ``selected``: a list column, or one feature a row.
    """
    keys = list(keys)
    one = F.explode(selected) if dict(log.dtypes)[selected].startswith("array") else F.col(selected)
    seen = log.filter(F.col(repeat) < n_repeats).select(*keys, repeat, one.alias("feature"))
    freq = seen.groupBy(*keys, "feature").agg((F.count_distinct(repeat) / F.lit(float(n_repeats))).alias("selection_freq"))
    return keep_stable(freq, threshold, keys, fallback, measure=log, limit=limit)


def keep_stable(freq: DataFrame, threshold: float, keys: Sequence[str] = (), fallback: int = 20, *, measure: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    keys = list(keys)
    ranked = ordinal_rank(freq, keys, [F.col("selection_freq").desc(), F.col("feature")], "rank", measure=None, limit=limit)
    top = freq.groupBy(*keys).agg(F.max("selection_freq").alias("__top"))
    out = join_on(ranked, top, keys)
    kept = F.when(F.col("__top") >= threshold, F.col("selection_freq") >= threshold).otherwise(F.col("rank") <= fallback)
    return out.withColumn("kept", kept).drop("__top")


def bootstrap_memberships(long: DataFrame, n_boot: int, top: int, seed: int = 42, keys: Sequence[str] = (), id_col: str = "id", min_n: int = 10, *, limit: int | None = None) -> DataFrame:
    """(keys, b, feature, rank): the top features of each class-stratified resample.

    Draw weights are made once per subject and joined to the long table, so a
    replicate is a set of weights, not a copy of the features' values.
    """
    from .resample import draw_weights

    keys = list(keys)
    subjects = long.select(*keys, id_col, "y").distinct()
    w = draw_weights(subjects, keys, id_col, n_boot, seed, ["y"]).select(*keys, id_col, "b", "weight")
    rows = join_on(long, w, [*keys, id_col])
    stats = mann_whitney(rows, 2 * min_n, min_n, [*keys, "b"], weight="weight", measure=long, limit=limit)
    return ranked_screen(stats, [F.col("p_value").asc_nulls_last(), F.round("effect_size", 9).desc()], [*keys, "b"], top, measure=long, limit=limit).select(*keys, "b", "feature", "rank")


def bootstrap_stability(long: DataFrame, n_boot: int, top: int, threshold: float = 0.75, seed: int = 42, keys: Sequence[str] = (), id_col: str = "id", fallback: int = 20, *, limit: int | None = None) -> DataFrame:
    """Share of resamples whose top list names the feature, with the kept flag."""
    mem = bootstrap_memberships(long, n_boot, top, seed, keys, id_col, limit=limit)
    freq = mem.groupBy(*keys, "feature").agg((F.count(F.lit(1)) / F.lit(float(n_boot))).alias("selection_freq"))
    return keep_stable(freq, threshold, keys, fallback, limit=limit)


# ---------------------------------------------------------------- fold panels, ordering rules
def fold_panels(coefs: DataFrame, cv: DataFrame, freq: DataFrame | None = None, keys: Sequence[str] = (), tol: float = 1e-8, *, limit: int | None = None) -> DataFrame:
    """Per strategy, under its best weight scheme: mean and population sd of coefficients over
    all folds (absent = 0), fold stability, sign consistency, rank by (stability, |mean|)."""
    keys = list(keys)
    per = cv.groupBy(*keys, "strategy", "weight_scheme").agg(F.avg("auprc").alias("m"))
    best = per.groupBy(*keys, "strategy").agg(F.max(F.struct("m", "weight_scheme")).alias("s")).select(*keys, "strategy", F.col("s.weight_scheme").alias("weight_scheme"))
    n = cv.groupBy(*keys, "strategy", "weight_scheme").agg(F.count_distinct("fold").alias("n_folds"))
    rows = join_on(join_on(coefs, best, [*keys, "strategy", "weight_scheme"]), n, [*keys, "strategy", "weight_scheme"])
    c = F.col("coef")
    agg = rows.groupBy(*keys, "strategy", "weight_scheme", "feature").agg(
        F.sum(c).alias("__s"), F.max("n_folds").alias("n_folds"), F.count(F.lit(1)).alias("__k"), F.avg(c).alias("__m"), F.var_pop(c).alias("__v"),
        F.sum(F.when(F.abs(c) > tol, 1).otherwise(0)).alias("__nz"), F.max(F.when(c > tol, 1).otherwise(0)).alias("__p"), F.max(F.when(c < -tol, 1).otherwise(0)).alias("__n"),
    )
    mean = F.col("__s") / F.col("n_folds")
    gap = F.col("__m") - mean
    m2 = F.col("__k") * (F.col("__v") + gap * gap) + (F.col("n_folds") - F.col("__k")) * mean * mean
    out = agg.select(
        *keys, "strategy", "weight_scheme", "feature", mean.alias("mean_coef"), F.sqrt(m2 / F.col("n_folds")).alias("std_coef"),
        (F.col("__nz") / F.col("n_folds")).alias("fold_stability"), (F.col("__p") + F.col("__n") == 1).alias("sign_consistent"),
    )
    if freq is not None:
        out = join_on(out, freq.select(*keys, "feature", "selection_freq"), [*keys, "feature"], "left")
    return ordinal_rank(out, [*keys, "strategy"], [F.col("fold_stability").desc(), F.abs("mean_coef").desc(), F.col("feature")], "rank", measure=coefs, limit=limit)


def core_panel(panels: DataFrame, winner: str, threshold: float = 0.8, keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """Stable, sign-consistent features of the winning strategy by |mean coefficient|."""
    rows = panels.filter((F.col("strategy") == winner) & (F.col("fold_stability") >= threshold) & F.col("sign_consistent")).drop("rank")
    return ordinal_rank(rows, keys, [F.abs("mean_coef").desc(), F.col("feature")], "rank", limit=limit)


def purity_scores(coefs: DataFrame, base: str, other: str, keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """Mean coefficient per strategy, noise and purity per model; combined mean of model-scaled purities, ranked."""
    from ..functions.scalar import purity

    keys = list(keys)
    pick = lambda s: F.avg(F.when(F.col("strategy") == s, F.col("coef")))
    wide = coefs.groupBy(*keys, "model", "feature").agg(pick(base).alias("base"), pick(other).alias("other")).filter("base IS NOT NULL AND other IS NOT NULL")
    wide = wide.withColumns(purity(F.col("base"), F.col("other")))
    top = wide.groupBy(*keys, "model").agg(F.max("purity_score").alias("__top"))
    both = join_on(wide, top, [*keys, "model"])
    scaled = F.coalesce(ratio(F.col("purity_score"), F.col("__top")), F.lit(0.0))
    agg = both.groupBy(*keys, "feature").agg(F.avg(scaled).alias("combined"), F.count(F.lit(1)).alias("n_models"), F.max(F.col("sign_flip").cast("int")).alias("any_flip"))
    return ordinal_rank(agg, keys, [F.round("combined", 9).desc(), F.col("feature")], "rank", measure=coefs, limit=limit)


def order_by_rule(features: DataFrame, rule: str, keys: Sequence[str] = (), q_threshold: float | None = 0.05, stability_threshold: float = 1.0, *, limit: int | None = None) -> DataFrame:
    """Panel orderings: consensus (with q filter), abs_coef (stable and consistent), stored rank, elimination, purity."""
    if rule == "consensus":
        rows = features if q_threshold is None else features.filter(F.col("q_value") <= q_threshold)
        order = [F.col("consensus_score").desc()]
    elif rule == "abs_coef":
        rows = features.filter((F.col("stability_freq") >= stability_threshold) & F.col("sign_consistent"))
        order = [F.abs("mean_coef").desc()]
    elif rule in ("stored_rank", "elimination"):
        rows, order = features, [F.col("stored_rank").asc()]
    elif rule == "purity":
        rows, order = features, [F.col("combined").desc()]
    else:
        raise ValueError(f"unknown ordering rule {rule}")
    return ordinal_rank(rows.select(*features.columns), keys, [*order, F.col("feature")], "position", limit=limit)
