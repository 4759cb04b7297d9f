"""Aggregations over result tables (metrics, importances, curves, trials).

Every operator takes key columns, so any number of experiments is summarised in
one job.  Rows a fold or model lacks count as zero through moment arithmetic,
not through a cross join of features and folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.keys import finite, join_on, ratio
from ..core.order import hash_order, ordinal_rank, place_rows, running
from ..core.quantile import quantiles

Z95 = 1.96


def summary_stats(df: DataFrame, metrics: Sequence[str], group: Sequence[str] = ("model",)) -> DataFrame:
    """n_splits and mean, sd, mean -/+ 1.96 sd/sqrt(n) of each metric on its non-null values."""
    cols = [F.count(F.lit(1)).alias("n_splits")]
    for m in metrics:
        half = Z95 * F.try_divide(F.stddev_samp(m), F.sqrt(F.count(m)))
        cols += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), (F.avg(m) - half).alias(f"{m}_ci_lo"), (F.avg(m) + half).alias(f"{m}_ci_hi")]
    return df.groupBy(*group).agg(*cols)


def summary_long(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, std, min, max, n) over all rows."""
    parts = [F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"), F.count(m).alias("n")) for m in metrics]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def feature_stability(selections: DataFrame, threshold: float = 0.75, keys: Sequence[str] = (), split: str = "split_seed", feature: str = "feature", splits: DataFrame | None = None) -> DataFrame:
    """Share of splits selecting each feature; ``splits`` lists splits that selected nothing too."""
    keys = list(keys)
    base = selections if splits is None else splits
    n = base.groupBy(*keys).agg(F.count_distinct(split).alias("n_splits"))
    hit = selections.filter(F.col(feature).isNotNull()).groupBy(*keys, feature).agg(F.count_distinct(split).alias("n_selected"))
    out = join_on(hit, n, keys).withColumn("selection_fraction", ratio(F.col("n_selected"), F.col("n_splits")))
    return out.withColumn("is_stable", F.col("selection_fraction") >= threshold)


def feature_report(reports: DataFrame, keys: Sequence[str] = ("model",), feature: str = "feature", *, limit: int | None = None) -> DataFrame:
    """Selection frequency, effect and p over seeds, ranked by mean frequency (ties by name)."""
    keys = list(keys)
    f, e, p = "selection_freq", "effect", "p_value"
    agg = reports.groupBy(*keys, feature).agg(
        F.avg(f).alias("freq_mean"), F.stddev_samp(f).alias("freq_std"), F.min(f).alias("freq_min"), F.max(f).alias("freq_max"), F.count(f).alias("n"),
        F.avg(e).alias("effect_mean"), F.stddev_samp(e).alias("effect_std"), F.avg(p).alias("p_mean"), F.stddev_samp(p).alias("p_std"),
    )
    return ordinal_rank(agg, keys, [F.col("freq_mean").desc(), F.col(feature)], "rank", measure=reports, limit=limit)


def mean_std_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and sample sd of every named statistic (screening summaries over seeds)."""
    out = [F.count(F.lit(1)).alias("n_seeds")]
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*out)


def params_summary(params: DataFrame, keys: Sequence[str] = ("model",), param: str = "param", value: str = "value") -> DataFrame:
    """Numeric parameters: mean, sd, min, max.  Text: most frequent value, number and list of values."""
    by = [*keys, param]
    num = F.col(value).try_cast("double")
    per_value = params.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.max(num).alias("x"))
    text = F.max(F.when(F.col("x").isNull(), 1).otherwise(0)) == 1
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("x"))
    mean = m / n
    agg = per_value.groupBy(*by).agg(
        text.alias("__text"), n.alias("n"), mean.alias("mean"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("__ss"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.count(F.lit(1)).alias("n_unique"),
        F.min(F.struct((-F.col("n")).alias("k"), F.col("v"))).alias("__mode"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("x").isNull(), F.col("v")))), ",").alias("__vals"),
    )
    var = (F.col("__ss") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)
    number = ~F.col("__text")
    return agg.select(
        *by, "n", F.when(number, F.col("mean")).alias("mean"), F.when(number & (F.col("n") > 1), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"),
        F.when(number, F.col("min")).alias("min"), F.when(number, F.col("max")).alias("max"),
        F.when(~number, F.col("__mode.v")).alias("mode"), F.when(~number, F.col("n_unique")).alias("n_unique"), F.when(~number, F.col("__vals")).alias("values"),
    )


def spread_clusters(rows: DataFrame, value: str = "importance", members: str = "cluster_features", feature: str = "feature") -> DataFrame:
    """Cluster rows become one row per member with an equal share of the value."""
    size = F.array_size(members)
    return rows.withColumn("__m", F.when(size > 0, F.col(members)).otherwise(F.array(F.col(feature)))).select(
        *[c for c in rows.columns if c not in (feature, value, members)], F.explode("__m").alias(feature), (F.col(value) / F.array_size("__m")).alias(value)
    )


def zero_filled(rows: DataFrame, keys: Sequence[str], fold: str, feature: str, value: str) -> DataFrame:
    """Per feature: mean and sample sd over all folds of the key, absent folds counting 0."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count_distinct(fold).alias("n_folds"))
    v = F.coalesce(F.col(value), F.lit(0.0))
    per = rows.groupBy(*keys, feature).agg(
        F.sum(v).alias("__s"), F.count(F.lit(1)).alias("__k"), F.avg(v).alias("__m"), F.var_pop(v).alias("__v"), F.sum(F.when(v > 0, 1).otherwise(0)).alias("n_folds_nonzero")
    )
    both = join_on(per, n, keys)
    mean = F.col("__s") / F.col("n_folds")
    gap = F.col("__m") - mean
    m2 = F.col("__k") * (F.col("__v") + gap * gap) + (F.col("n_folds") - F.col("__k")) * mean * mean
    return both.select(
        *keys, feature, mean.alias("mean_importance"), F.when(F.col("n_folds") > 1, F.sqrt(m2 / (F.col("n_folds") - 1))).alias("std_importance"),
        "n_folds_nonzero", "n_folds",
    )


def importance_over_folds(rows: DataFrame, keys: Sequence[str] = ("model",), fold: str = "fold", feature: str = "feature", value: str = "importance") -> DataFrame:
    """Fold importances averaged with zero for absent features; cluster rows are shared out."""
    src = spread_clusters(rows, value, feature=feature) if "cluster_features" in rows.columns else rows
    per = src.groupBy(*keys, fold, feature).agg(F.sum(value).alias(value))
    return zero_filled(per, keys, fold, feature, value)


def cluster_importance_over_folds(rows: DataFrame, keys: Sequence[str] = ("model",), fold: str = "fold", value: str = "importance", members: str = "cluster_features", *, limit: int | None = None) -> DataFrame:
    """Mean, sd and folds of each identical cluster, ranked by mean."""
    sig = F.array_join(F.array_sort(members), "|").alias("cluster")
    agg = rows.groupBy(*keys, sig).agg(F.avg(value).alias("mean_importance"), F.stddev_samp(value).alias("std_importance"), F.count_distinct(fold).alias("n_folds"))
    return ordinal_rank(agg, keys, [F.col("mean_importance").desc(), F.col("cluster")], "rank", measure=rows, limit=limit)


def importance_across_splits(rows: DataFrame, keys: Sequence[str] = ("model",), split: str = "split_seed", feature: str = "feature", value: str = "importance", *, limit: int | None = None) -> DataFrame:
    """Zero-filled importance over splits with its stability and rank."""
    agg = zero_filled(rows, keys, split, feature, value).withColumn("stability", ratio(F.col("n_folds_nonzero"), F.col("n_folds")))
    return ordinal_rank(agg, keys, [F.col("mean_importance").desc(), F.col(feature)], "rank", measure=rows, limit=limit)


def scale_conflicts(rows: DataFrame, keys: Sequence[str], scale: str = "output_scale") -> DataFrame:
    """Groups that mix explanation scales; they must not be averaged."""
    return rows.groupBy(*keys).agg(F.count_distinct(scale).alias("n_scales")).filter("n_scales > 1")


def shap_over_folds(rows: DataFrame, keys: Sequence[str] = ("model",), fold: str = "fold", feature: str = "feature", value: str = "shap", scale: str | None = None) -> DataFrame:
    """Mean |value| per fold, then mean, sd, median and nonzero folds with zero for absent folds."""
    if scale is not None and not scale_conflicts(rows, keys, scale).isEmpty():
        raise ValueError("mixed output scales within a group")
    keys = list(keys)
    per = rows.groupBy(*keys, fold, feature).agg(F.avg(F.abs(value)).alias("v"))
    stats = zero_filled(per, keys, fold, feature, "v")
    # one entry per fold
    lists = per.groupBy(*keys, feature).agg(F.collect_list("v").alias("__l"))
    both = join_on(stats, lists, [*keys, feature])
    full = F.array_sort(F.concat("__l", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), (F.col("n_folds") - F.array_size("__l")).cast("int")))))
    both = both.withColumn("__l", full)
    mid = lambda k: F.element_at("__l", k.cast("int"))
    med = (mid(F.floor((F.col("n_folds") + 1) / 2)) + mid(F.floor(F.col("n_folds") / 2) + 1)) / 2.0
    return both.select(*keys, feature, F.col("mean_importance").alias("mean_abs_shap"), F.col("std_importance").alias("std_abs_shap"), med.alias("median_abs_shap"), F.col("n_folds_nonzero"), "n_folds")


def shap_across_splits(rows: DataFrame, keys: Sequence[str] = ("model",), split: str = "split_seed", feature: str = "feature", value: str = "mean_abs_shap", *, limit: int | None = None) -> DataFrame:
    """Mean and sd over the splits that have the feature, stability, place by mean (ties by name) and rank by mean x stability."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count_distinct(split).alias("n_splits"))
    # one entry per split, summed in one order, so that equal values give equal means and ranks
    values = F.array_sort(F.collect_list(F.col(value).cast("double")))
    agg = rows.filter(F.col(value).isNotNull()).groupBy(*keys, feature).agg(values.alias("__l"), F.stddev_samp(value).alias("std"), F.count_distinct(split).alias("n_present"))
    agg = agg.withColumn("mean", F.aggregate("__l", F.lit(0.0), lambda a, x: a + x) / F.size("__l")).select(*keys, feature, "mean", "std", "n_present")
    agg = join_on(agg, n, keys).withColumn("stability", ratio(F.col("n_present"), F.col("n_splits")))
    agg = agg.withColumn("__ms", F.col("mean") * F.col("stability"))
    out = ordinal_rank(agg, keys, [F.col("mean").desc(), F.col(feature)], "rank_pooled", measure=rows, limit=limit)
    out = out.withColumn("rank_pooled", F.col("rank_pooled").cast("int"))
    return min_rank(out, keys, "__ms", "rank_stability", measure=rows, limit=limit).drop("__ms")


def min_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, descending: bool = True, *, measure: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """1 + number of rows with a strictly better value; ties share the smallest rank."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    placed, place = place_rows(counts, keys, order, measure=df if measure is None else measure, limit=limit)
    cum = running(placed, keys, order, {"__u": ("sum", F.col("__c"))}, place)
    ranks = cum.select(*keys, value, (F.col("__u") - F.col("__c") + 1).cast("int").alias(name))
    return join_on(df, ranks, [*keys, value])


def metadata_counts(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: rows and distinct values of the metadata columns."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def feature_overlap_ratio(rows: DataFrame, keys: Sequence[str] = (), split: str = "split_seed", feature: str = "feature", value: str | None = None) -> DataFrame:
    """Features present in every split over features present in any."""
    keys = list(keys)
    rows = rows if value is None else rows.filter(F.col(value).isNotNull())
    n = rows.groupBy(*keys).agg(F.count_distinct(split).alias("__n"))
    per = join_on(rows.groupBy(*keys, feature).agg(F.count_distinct(split).alias("__k")), n, keys)
    agg = per.groupBy(*keys).agg(F.sum(F.when(F.col("__k") == F.col("__n"), 1).otherwise(0)).alias("n_common"), F.count(F.lit(1)).alias("n_union"))
    return agg.withColumn("overlap", ratio(F.col("n_common"), F.col("n_union")))


def drop_column_over_folds(rows: DataFrame, how: str = "mean", keys: Sequence[str] = ("model", "cluster"), delta: str = "delta_auroc", retuned: str = "delta_retuned") -> DataFrame:
    """Fold deltas of left-out clusters: centre, spread, failures and the compensation flag."""
    centre = {"mean": F.avg(delta), "median": F.percentile(delta, F.lit(0.5)), "max": F.max(delta)}[how]
    agg = rows.groupBy(*keys).agg(
        centre.alias("delta"), F.stddev_samp(delta).alias("std"), F.min(delta).alias("min"), F.max(delta).alias("max"),
        F.count(delta).alias("n_folds"), F.sum(F.when(F.col(delta).isNull(), 1).otherwise(0)).alias("n_errors"), F.avg(retuned).alias("retuned"),
    )
    return agg.withColumn("compensated", F.coalesce((F.abs("delta") < 0.005) & (F.col("retuned") > 0.005), F.lit(False)))


def ensemble_coef_stats(rows: DataFrame, keys: Sequence[str] = (), name: str = "base_model", coef: str = "coef") -> DataFrame:
    return rows.groupBy(*keys, name).agg(
        F.avg(coef).alias("mean"), F.stddev_pop(coef).alias("std"), F.min(coef).alias("min"), F.max(coef).alias("max"), F.count(coef).alias("n")
    )


def ensemble_gain(metrics: DataFrame, ensemble: str, keys: Sequence[str] = (), model: str = "model", value: str = "auroc") -> DataFrame:
    """Percentage gain of the ensemble over the best base model."""
    per = metrics.groupBy(*keys, model).agg(F.avg(value).alias("v"))
    ens = F.max(F.when(F.col(model) == ensemble, F.col("v")))
    best = F.max(F.when(F.col(model) != ensemble, F.col("v")))
    return per.groupBy(*keys).agg(ens.alias("ensemble"), best.alias("best_base"), (F.try_divide(ens - best, best) * 100).alias("gain_pct"))


def learning_curve_summary(runs: DataFrame, keys: Sequence[str] = ("model",), run: str = "run", size: str = "train_size", value: str = "score") -> DataFrame:
    """Mean per (run, size), then mean, sd and percentiles over runs; one run gives no interval."""
    per = runs.groupBy(*keys, run, size).agg(F.avg(value).alias("v"))
    agg = per.groupBy(*keys, size).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"), F.count("v").alias("n_runs"))
    many = F.col("n_runs") > 1
    return agg.withColumns({"lo": F.when(many, F.col("lo")), "hi": F.when(many, F.col("hi"))})


def panel_model_matrix(rows: DataFrame, keys: Sequence[str] = (), panel: str = "panel", model: str = "model", value: str = "auroc") -> DataFrame:
    return rows.groupBy(*keys, panel, model).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def panel_model_wide(rows: DataFrame, models: Sequence[str], keys: Sequence[str] = (), panel: str = "panel", model: str = "model", value: str = "auroc") -> DataFrame:
    """One column per model; the model list is given, so no extra job looks for it."""
    return rows.groupBy(*keys, panel).pivot(model, list(models)).agg(F.avg(value))


def select_winner(cv: DataFrame, keys: Sequence[str] = (), strategy: str = "strategy", scheme: str = "weight_scheme", fold: str = "fold", value: str = "auprc", size: str = "n_nonzero", margin: float = 0.02, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Best mean over folds; a sparser runner-up within the margin wins if the paired fold
    bootstrap of the difference covers 0.

    Combinations and folds are few per key; the fold differences of a key travel as one list in hash
    order and are resampled where they are, with the same draws as the row bootstrap.
    """
    from .resample import resampled_means

    keys = list(keys)
    combo = [*keys, strategy, scheme]
    stats = cv.groupBy(*combo).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(size).alias("avg_size"))
    w = Window.partitionBy(*keys).orderBy(F.col("mean").desc(), F.col(strategy), F.col(scheme))
    top = stats.withColumn("rk", F.row_number().over(w)).filter("rk <= 2")
    folds = cv.join(top.select(*combo, "rk"), combo)
    diff = folds.groupBy(*keys, fold).agg(
        (F.max(F.when(F.col("rk") == 1, F.col(value))) - F.max(F.when(F.col("rk") == 2, F.col(value)))).alias("d")
    ).filter(F.col("d").isNotNull())
    lists = diff.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(hash_order(seed, fold), fold, F.col("d").cast("double").alias("d")))).alias("__d"))
    boot = lists.select(*keys, resampled_means(n_boot, seed, (0.025, 0.975))(F.col("__d.d")).alias("__q"))
    ci = boot.select(*keys, F.col("__q")[0].alias("ci_lo"), F.col("__q")[1].alias("ci_hi"))
    pick = lambda c, k: F.max(F.when(F.col("rk") == k, F.col(c)))
    pair = top.groupBy(*keys).agg(*[pick(c, k).alias(f"{c}{k}") for k in (1, 2) for c in (strategy, scheme, "mean", "std", "avg_size")])
    out = join_on(pair, ci, keys, "left")
    swap = (F.col("mean1") - F.col("mean2") <= margin) & (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0) & (F.col("avg_size2") < F.col("avg_size1"))
    swap = F.coalesce(swap, F.lit(False))
    cols = [F.when(swap, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in (strategy, scheme, "mean", "std", "avg_size")]
    return out.select(*keys, *cols, "ci_lo", "ci_hi", swap.alias("runner_up_won"))


def branch_decision(cv: DataFrame, keys: Sequence[str] = (), model: str = "model", config: str = "config", value: str = "auprc") -> DataFrame:
    """Keep models whose best mean + 1.96 se reaches the winner's mean - 1.96 se."""
    keys = list(keys)
    per = cv.groupBy(*keys, model, config).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("se"))
    best = per.groupBy(*keys, model).agg(F.max(F.struct("mean", "se", config)).alias("s")).select(*keys, model, F.col(f"s.{config}").alias(config), "s.mean", "s.se")
    top = best.groupBy(*keys).agg(F.max(F.struct("mean", "se")).alias("t"))
    both = join_on(best, top, keys)
    return both.select(*keys, model, config, "mean", "se", (F.col("mean") + Z95 * F.col("se") >= F.col("t.mean") - Z95 * F.col("t.se")).alias("kept"))


def distribution_stats(df: DataFrame, keys: Sequence[str] = (), value: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Mean, median, IQR and population sd of the finite scores."""
    keys = list(keys)
    rows = df.filter(finite(F.col(value)))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    q = quantiles(counts, keys, "v", {"median": 0.5, "__q1": 0.25, "__q3": 0.75}, measure=df, limit=limit)
    return join_on(base, q, keys).withColumn("iqr", F.col("__q3") - F.col("__q1")).drop("__q1", "__q3")


def best_within_budget(trials: DataFrame, cutoffs: Sequence[int], keys: Sequence[str] = ("model",), split: str = "split_id", trial: str = "trial_num", value: str = "auroc", base: int = 50) -> DataFrame:
    """Best score with trial < T per split, then mean, se, interval over splits and the gain over T = base."""
    keys = list(keys)
    cuts = sorted({*cutoffs, base})
    per = trials.groupBy(*keys, split).agg(*[F.max(F.when(F.col(trial) < t, F.col(value))).alias(f"t{t}") for t in cuts])
    long = per.select(*keys, split, F.col(f"t{base}").alias("__b"), F.inline(F.array(*[F.struct(F.lit(t).alias("cutoff"), F.col(f"t{t}").alias("v")) for t in cuts])))
    agg = long.groupBy(*keys, "cutoff").agg(F.avg("v").alias("mean"), F.try_divide(F.stddev_samp("v"), F.sqrt(F.count("v"))).alias("se"), F.count("v").alias("n_splits"), F.avg("__b").alias("__b"))
    return agg.select(*keys, "cutoff", "mean", "se", (F.col("mean") - Z95 * F.col("se")).alias("lo"), (F.col("mean") + Z95 * F.col("se")).alias("hi"), "n_splits", (F.col("mean") - F.col("__b")).alias("gain"))


def retention_frequency(curve: DataFrame, keys: Sequence[str] = ("model",), seed: str = "seed", size: str = "size", features: str = "features") -> DataFrame:
    """Share of curve sizes in which a feature appears, pooled over seeds by their number of sizes.

    ``features``: a list column, or one feature a row.
    """
    keys = list(keys)
    n = curve.select(*keys, seed, size).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    one = F.explode(features) if dict(curve.dtypes)[features].startswith("array") else F.col(features)
    hit = curve.select(*keys, seed, size, one.alias("feature")).distinct().groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n_sizes"))
    return join_on(hit, n, keys).select(*keys, "feature", "n_sizes", ratio(F.col("n_sizes"), F.col("__n")).alias("retention"))


def aggregate_curves(curves: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model",), seed: str = "seed", size: str = "size", main: str = "auroc_val") -> DataFrame:
    """Sizes present in all seeds (else in at least half): mean, sd of metrics, percentiles and per-seed list of the main one."""
    keys = list(keys)
    n = curves.groupBy(*keys).agg(F.count_distinct(seed).alias("n_seeds_total"))
    agg = curves.groupBy(*keys, size).agg(
        F.count_distinct(seed).alias("n_seeds"), *[x for m in metrics for x in (F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_std"))],
        F.percentile(main, F.lit(0.025)).alias("ci_lo"), F.percentile(main, F.lit(0.975)).alias("ci_hi"),
        F.transform(F.array_sort(F.collect_list(F.struct(seed, main))), lambda s: s[main]).alias("by_seed"),
    )
    both = join_on(agg, n, keys)
    full = both.groupBy(*keys).agg(F.max(F.col("n_seeds") == F.col("n_seeds_total")).alias("__any"))
    both = join_on(both, full, keys)
    ok = F.when(F.col("__any"), F.col("n_seeds") == F.col("n_seeds_total")).otherwise(F.col("n_seeds") * 2 >= F.col("n_seeds_total"))
    return both.filter(ok).drop("__any")


def mean_elimination_rank(ranks: DataFrame, keys: Sequence[str] = ("model",), seed: str = "seed", feature: str = "feature", rank: str = "elimination_rank") -> DataFrame:
    """Mean elimination rank over seeds; survivors (NULL) get the seed's maximum + 1."""
    keys = list(keys)
    top = ranks.groupBy(*keys, seed).agg(F.max(rank).alias("__m"))
    both = join_on(ranks, top, [*keys, seed])
    return both.groupBy(*keys, feature).agg(F.avg(F.coalesce(F.col(rank), F.col("__m") + 1)).alias("mean_rank"), F.count(F.lit(1)).alias("n_seeds"))


def rfecv_consensus(folds: DataFrame, threshold: float = 0.8, keys: Sequence[str] = ("model",), fold: str = "fold", feature: str = "feature", *, limit: int | None = None) -> DataFrame:
    """Feature frequency over folds with the kept flag and the mean fold panel size."""
    keys = list(keys)
    n = folds.groupBy(*keys).agg(F.count_distinct(fold).alias("n_folds"), F.count(F.lit(1)).alias("__rows"))
    per = folds.groupBy(*keys, feature).agg(F.count_distinct(fold).alias("n_selected"))
    both = join_on(per, n, keys).withColumn("frequency", ratio(F.col("n_selected"), F.col("n_folds")))
    both = both.withColumns({"kept": F.col("frequency") >= threshold, "mean_size": ratio(F.col("__rows"), F.col("n_folds"))}).drop("__rows")
    return ordinal_rank(both, keys, [F.col("frequency").desc(), F.col(feature)], "rank", measure=folds, limit=limit)


def cross_fold_consistency(coefs: DataFrame, keys: Sequence[str] = ("strategy",), fold: str = "fold", feature: str = "feature", coef: str = "coef", eps: float = 1e-8) -> DataFrame:
    """Folds with a nonzero coefficient, its mean and sd, and whether all signs agree."""
    c = F.col(coef)
    agg = coefs.groupBy(*keys, feature).agg(
        F.sum(F.when(F.abs(c) > eps, 1).otherwise(0)).alias("folds_nonzero"), F.avg(c).alias("mean_coef"), F.stddev_samp(c).alias("std_coef"),
        F.max(F.when(c > eps, 1).otherwise(0)).alias("__p"), F.max(F.when(c < -eps, 1).otherwise(0)).alias("__n"),
    )
    return agg.withColumn("sign_consistent", F.col("__p") + F.col("__n") == 1).drop("__p", "__n")


def model_comparison(metrics: DataFrame, higher: Sequence[str], lower: Sequence[str] = (), keys: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Mean metrics per model with a flag on the best of each; means that agree in 12 decimals are equal."""
    keys = list(keys)
    per = metrics.groupBy(*keys, model).agg(*[F.avg(m).alias(m) for m in (*higher, *lower)])
    best = per.groupBy(*keys).agg(*[F.max(m).alias(f"__{m}") for m in higher], *[F.min(m).alias(f"__{m}") for m in lower])
    both = join_on(per, best, keys)
    return both.select(*keys, model, *higher, *lower, *[(F.round(m, 12) == F.round(f"__{m}", 12)).alias(f"best_{m}") for m in (*higher, *lower)])


def multimodel_rank(coefs: DataFrame, models: Sequence[str], keys: Sequence[str] = (), top: int = 30, feature: str = "feature", coef: str = "coef", stability: str = "stability", *, limit: int | None = None) -> DataFrame:
    """Average rank of |coef| within each model; the ``top`` features of at least two models by mean rank."""
    from ..core.order import average_rank

    keys = list(keys)
    rows = coefs.withColumn("__a", -F.abs(coef))
    ranks = average_rank(rows, [*keys, "model"], "__a", "rk", limit=limit).drop("n")
    both = join_on(rows, ranks, [*keys, "model", "__a"])
    wide = [F.max(F.when(F.col("model") == m, F.col(coef))).alias(f"coef_{m}") for m in models]
    agg = both.groupBy(*keys, feature).agg(
        F.avg("rk").alias("mean_rank"), F.count_distinct("model").alias("n_models"), *wide,
        (F.min(F.signum(coef)) == F.max(F.signum(coef))).alias("same_sign"), F.min(stability).alias("min_stability"),
    ).filter("n_models >= 2")
    out = ordinal_rank(agg, keys, [F.col("mean_rank"), F.col(feature)], "position", measure=coefs, limit=limit)
    return out.filter(F.col("position") <= top)


def cross_model_essentiality(rows: DataFrame, models: Sequence[str], keys: Sequence[str] = (), cluster: str = "cluster", model: str = "model", delta: str = "delta") -> DataFrame:
    """One delta column per model and its spread; universal clusters appear in at least half the models."""
    d = F.col(delta)
    wide = [F.max(F.when(F.col(model) == m, d)).alias(f"delta_{m}") for m in models]
    agg = rows.groupBy(*keys, cluster).agg(*wide, F.count(d).alias("n_models"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("std_delta"), F.max(d).alias("max_delta"), F.min(d).alias("min_delta"))
    return agg.withColumn("universal", F.col("n_models") >= -(-len(models) // 2))


def essentiality_summary(ess: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ess.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum(F.when(F.col("universal"), 1).otherwise(0)).alias("n_universal"), F.avg("mean_delta").alias("mean_delta"), F.max("max_delta").alias("max_delta"))


def starting_panel(stability: DataFrame, importance: DataFrame | None, threshold: float, n: int, keys: Sequence[str] = ("model",), feature: str = "feature", *, limit: int | None = None) -> DataFrame:
    """Stable features by mean importance (by selection share without importances), the first n with their score."""
    keys = list(keys)
    rows = stability.filter(F.col("selection_fraction") >= threshold)
    if importance is not None:
        rows = join_on(rows, importance.select(*keys, feature, F.col("mean_importance").alias("__i")), [*keys, feature], "left")
        rows = rows.withColumn("score", F.coalesce(F.col("__i"), F.lit(0.0))).drop("__i")
    else:
        rows = rows.withColumn("score", F.col("selection_fraction"))
    out = ordinal_rank(rows.select(*keys, feature, "score"), keys, [F.col("score").desc(), F.col(feature)], "rank", measure=stability, limit=limit)
    return out.filter(F.col("rank") <= n)


def marginal_gain(sweep: DataFrame, keys: Sequence[str] = ("model",), size: str = "panel_size", value: str = "auroc") -> DataFrame:
    """Mean score per size and its change from the previous size (a curve has few sizes)."""
    agg = sweep.groupBy(*keys, size).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(*keys).orderBy(size)
    return agg.withColumn("gain", F.col("mean") - F.lag("mean").over(w))


def membership_patterns(sets: DataFrame, keys: Sequence[str] = (), owner: str = "model", feature: str = "feature") -> DataFrame:
    """How many features each exact combination of owners shares."""
    per = sets.groupBy(*keys, feature).agg(F.array_join(F.array_sort(F.collect_set(owner)), "+").alias("pattern"))
    return per.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n_features"))


def ensemble_rows(df: DataFrame, keys: Sequence[str] = (), id_col: str = "id", y: str = "y_true", p: str = "y_prob", model: str = "model", *, limit: int | None = None) -> DataFrame:
    """Metric row of the mean score over models next to those of the base models."""
    from .discrimination import discrimination

    mean = df.groupBy(*keys, id_col, y).agg(F.avg(p).alias(p)).withColumn(model, F.lit("ENSEMBLE"))
    both = df.select(*keys, id_col, y, p, model).unionByName(mean.select(*keys, id_col, y, p, model))
    return discrimination(both, [*keys, model], y, p, limit=limit)


# ------------------------------------------------------- window idioms on logs
def running_best(trials: DataFrame, keys: Sequence[str], order: str, value: str, *, limit: int | None = None) -> DataFrame:
    """Best value so far, change from the previous row, change from the first row."""
    from ..core.order import neighbours

    keys = list(keys)
    o = [F.col(order)]
    placed, place = place_rows(trials, keys, o, limit=limit)
    out = running(placed, keys, o, {"best": ("max", F.col(value))}, place)
    out = neighbours(out, keys, o, prev={"__prev": value, "__pbest": "best"}, place=place)
    first = trials.groupBy(*keys).agg(F.min_by(value, order).alias("__first"))
    out = join_on(out, first, keys)
    out = out.withColumns({"delta_prev": F.col(value) - F.col("__prev"), "delta_base": F.col(value) - F.col("__first"), "improved": F.coalesce(F.col(value) > F.col("__pbest"), F.lit(True))})
    return out.drop("__prev", "__pbest", "__first", *([place] if place else []))


def trailing_streak(log: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str = "streak") -> DataFrame:
    """Length of the run of flagged rows at the end of each log: one aggregate, no order needed."""
    agg = log.withColumn("__f", F.coalesce(flag, F.lit(False)))
    last = agg.groupBy(*keys).agg(F.max(F.when(~F.col("__f"), F.col(order))).alias("__last"))
    both = join_on(agg, last, keys)
    after = F.col("__last").isNull() | (F.col(order) > F.col("__last"))
    return both.groupBy(*keys).agg(F.sum(F.when(after, 1).otherwise(0)).alias(name))


def tail_std(log: DataFrame, keys: Sequence[str], order: str, value: str, frac: float = 0.2, *, limit: int | None = None) -> DataFrame:
    """Population sd of the last max(2, ceil(frac n)) rows; 0 for logs under five rows."""
    keys = list(keys)
    n = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = join_on(ordinal_rank(log, keys, [F.col(order)], "__rn", limit=limit), n, keys)
    k = F.greatest(F.lit(2), F.ceil(F.col("__n") * frac))
    return rows.filter(F.col("__rn") > F.col("__n") - k).groupBy(*keys).agg(F.when(F.max("__n") < 5, F.lit(0.0)).otherwise(F.stddev_pop(value)).alias("tail_std"), F.count(F.lit(1)).alias("n_tail"))


def pareto_scan(df: DataFrame, keys: Sequence[str], gain: str, cost: str, id_col: str, *, limit: int | None = None) -> DataFrame:
    """Rows, best gain first, whose cost beats every earlier row."""
    keys = list(keys)
    order = [F.col(gain).desc(), F.col(cost), F.col(id_col)]
    placed, place = place_rows(df, keys, order, limit=limit)
    out = running(placed, keys, order, {"__m": ("min", F.col(cost))}, place)
    from ..core.order import neighbours

    out = neighbours(out, keys, order, prev={"__before": "__m"}, place=place)
    out = out.filter(F.col("__before").isNull() | (F.col(cost) < F.col("__before")))
    return out.drop("__m", "__before", *([place] if place else []))


def distinct_top_k(trials: DataFrame, k: int, keys: Sequence[str], params: str = "params", value: str = "auroc", *, limit: int | None = None) -> DataFrame:
    """The k best distinct parameter settings by their best score."""
    best = trials.groupBy(*keys, params).agg(F.max(value).alias(value))
    return ordinal_rank(best, keys, [F.col(value).desc(), F.col(params)], "rank", measure=trials, limit=limit).filter(F.col("rank") <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order: a map-side minimum, no sort."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("s")).select(*keys, "s.*")


def top_k(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[Column], *, limit: int | None = None) -> DataFrame:
    return ordinal_rank(df, keys, order, "rank", limit=limit).filter(F.col("rank") <= k)


def jaccard_matrix(sets: DataFrame, keys: Sequence[str] = (), owner: str = "model", feature: str = "feature", owners: DataFrame | None = None, empty: float | None = None) -> DataFrame:
    """Jaccard index of every pair of feature sets (a < b).

    Shared members are counted per pair of owners through the owner list of each
    feature, so pairs arise per feature and are summed map-side; owners are few.
    Two empty sets give ``empty``.
    """
    keys = list(keys)
    base = sets.select(*keys, owner, feature).distinct()
    who = (base if owners is None else owners).select(*keys, owner).distinct()
    size = base.groupBy(*keys, owner).agg(F.count(F.lit(1)).alias("n"))
    who = join_on(who, size, [*keys, owner], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a = who.select(*keys, F.col(owner).alias("a"), F.col("n").alias("na"))
    b = who.select(*keys, F.col(owner).alias("b"), F.col("n").alias("nb"))
    pairs = join_on(a, b, keys).filter("a < b")
    lists = base.groupBy(*keys, feature).agg(F.array_sort(F.collect_set(owner)).alias("o"))
    two = F.flatten(F.transform("o", lambda x: F.transform(F.filter("o", lambda z: z > x), lambda z: F.struct(x.alias("a"), z.alias("b")))))
    both = lists.select(*keys, F.inline(two)).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    out = join_on(pairs, both, [*keys, "a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("n_both")
    none = F.lit(empty).cast("double")
    return out.select(*keys, "a", "b", "n_both", union.alias("n_either"), F.coalesce(ratio(F.col("n_both"), union), none).alias("jaccard"))


def prefix_panels(ranked: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ("model",), feature: str = "feature", rank: str = "rank") -> DataFrame:
    """One row per (size, rank, feature): the first ``size`` features of each ranking."""
    rows = ranked.filter(F.col(rank) <= max(sizes))
    grid = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: F.col(rank) <= s)
    return rows.select(*keys, F.explode(grid).alias("size"), rank, feature)
