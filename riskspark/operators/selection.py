"""Panel sizes, gates and frontiers over sweep tables.

Sweep tables hold one row per configuration; every rule works for all keys
(experiment, model, ordering) in one job.  Windows cover the few sizes or
configurations of one curve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.keys import join_on
from ..core.order import hash_order
from ..core.tails import normal_ppf, normal_sf, t_ppf, two_sided_p
from .significance import bh_adjust, holm_adjust

Z95 = 1.96


def recommended_sizes(curve: DataFrame, keys: Sequence[str] = ("model",), size: str = "size", value: str = "auroc_val", shares: Sequence[float] = (0.95, 0.90, 0.85)) -> DataFrame:
    """Smallest size reaching each share of the best score."""
    keys = list(keys)
    top = curve.groupBy(*keys).agg(F.max(value).alias("__top"))
    both = join_on(curve, top, keys)
    return both.groupBy(*keys).agg(*[F.min(F.when(F.col(value) >= F.col("__top") * s, F.col(size))).alias(f"min_size_{int(round(s * 100))}pct") for s in shares])


def knee_point(curve: DataFrame, keys: Sequence[str] = ("model",), size: str = "size", value: str = "auroc_val") -> DataFrame:
    """Size farthest from the chord of the min-max scaled curve; the largest size when flat or short."""
    keys = list(keys)
    ends = curve.groupBy(*keys).agg(
        F.min(size).alias("__s0"), F.max(size).alias("__s1"), F.min(value).alias("__v0"), F.max(value).alias("__v1"), F.count(F.lit(1)).alias("__n"),
        F.max_by(value, size).alias("__vl"), F.min_by(value, size).alias("__vs"),
    )
    both = join_on(curve, ends, keys)
    span = F.col("__v1") - F.col("__v0")
    x = (F.col(size) - F.col("__s0")) / (F.col("__s1") - F.col("__s0"))
    y = (F.col(value) - F.col("__v0")) / span
    y1, y2 = (F.col("__vl") - F.col("__v0")) / span, (F.col("__vs") - F.col("__v0")) / span
    # chord from the largest size (x = 1) to the smallest (x = 0)
    a, b, c = y2 - y1, F.lit(1.0), -y2
    dist = F.abs(a * x + b * y + c) / F.sqrt(a * a + b * b)
    usable = (F.col("__n") >= 3) & (F.col("__s1") > F.col("__s0")) & (span > 0)
    far = F.max(F.when(usable, F.struct(F.round(dist, 12).alias("d"), F.col(size).alias("s"))))
    return both.groupBy(*keys).agg(F.coalesce(far["s"], F.max(size)).alias("knee_point"))


def seed_stability(rows: DataFrame, keys: Sequence[str], value: str = "auroc_val", threshold: float = 0.05) -> DataFrame:
    """Coefficient of variation over seeds; fewer than two values count as stable."""
    v = F.when(~F.isnan(value), F.col(value))
    agg = rows.groupBy(*keys).agg(F.count(v).alias("n_seeds"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("__sd"))
    few = F.col("n_seeds") < 2
    cv = F.when(few, F.lit(0.0)).when(F.col("mean") > 0, F.col("__sd") / F.col("mean"))
    return agg.select(*keys, "n_seeds", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(few, F.lit(0.0)).otherwise(F.col("__sd")).alias("std"), cv.alias("cv")).withColumn("stable", F.coalesce(F.col("cv") < threshold, F.lit(False)))


def filter_passengers(ess: DataFrame, keys: Sequence[str] = ("model",), feature: str = "feature", mean: str = "mean_delta", std: str = "std_delta", n: str = "n_folds") -> DataFrame:
    """Essentiality rows with the lower t bound of the mean drop; passengers reach 0 or below."""
    lo = F.col(mean) - t_ppf(0.975)((F.col(n) - 1).cast("double")) * F.try_divide(F.col(std), F.sqrt(F.col(n).cast("double")))
    lo = F.when(F.col(n) >= 2, lo)
    return ess.select(*keys, feature, mean, std, n, lo.alias("ci_lower"), F.coalesce(lo <= 0, F.lit(False)).alias("passenger"))


def select_panel(curve: DataFrame, full: DataFrame, keys: Sequence[str] = ("model",), seed: str = "seed", size: str = "size", value: str = "auroc_val", full_value: str = "full_auroc", delta: float = 0.02, delta_sensitivity: float = 0.01, cv_threshold: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """Decision row per size: stable over seeds and not inferior to the full model on paired seeds.

    The smallest accepted size (and that under the stricter margin) is attached to each row.
    """
    keys = list(keys)
    both = join_on(curve.select(*keys, seed, size, value), full.select(*keys, seed, full_value), [*keys, seed])
    d = F.col(full_value) - F.col(value)
    agg = both.groupBy(*keys, size).agg(
        F.count(d).alias("n_seeds"), F.avg(value).alias("mean_auroc"), F.stddev_samp(value).alias("__sd"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("__dsd")
    )
    cv = F.when(F.col("n_seeds") < 2, F.lit(0.0)).otherwise(F.try_divide("__sd", "mean_auroc"))
    se = F.when(F.col("n_seeds") > 1, F.col("__dsd") / F.sqrt("n_seeds")).otherwise(F.lit(0.0))
    agg = agg.withColumns({"cv": cv, "__se": se}).withColumn("ci_upper", F.col("delta") + normal_ppf(1 - alpha) * F.col("__se"))
    p = F.when(F.col("__se") > 0, normal_sf((F.lit(delta) - F.col("delta")) / F.col("__se"))).otherwise(F.when(F.col("delta") <= delta, 0.0).otherwise(1.0))
    agg = agg.withColumns({"p_value": p, "stable": F.col("cv") < cv_threshold})
    agg = agg.withColumns({"accepted": F.col("stable") & (F.col("ci_upper") <= delta), "__strict": F.col("stable") & (F.col("ci_upper") <= delta_sensitivity)})
    best = agg.groupBy(*keys).agg(F.min(F.when(F.col("accepted"), F.col(size))).alias("selected_size"), F.min(F.when(F.col("__strict") & F.col("accepted"), F.col(size))).alias("sensitivity_size"))
    reason = F.when(~F.col("stable"), "unstable").when(~F.col("accepted"), "inferior").otherwise("")
    return join_on(agg, best, keys).select(*keys, size, "n_seeds", "mean_auroc", "cv", "delta", "ci_upper", "p_value", "stable", "accepted", reason.alias("reason"), "selected_size", "sensitivity_size")


def size_three_criterion(sweep: DataFrame, keys: Sequence[str] = ("model",), size: str = "panel_size", mean: str = "auroc_mean", std: str = "auroc_std", n_seeds: int = 30, delta: float = 0.02, min_criteria: int = 2) -> DataFrame:
    """Per size: not inferior to the best, within one standard error of it, next gain not significant.

    The smallest size passing enough criteria is attached; without one, the best size.
    """
    keys = list(keys)
    agg = sweep.groupBy(*keys, size).agg(F.avg(mean).alias("m"), F.avg(std).alias("s"))
    w = Window.partitionBy(*keys).orderBy(size)
    root = math.sqrt(n_seeds)
    agg = agg.withColumns({"__m2": F.lead("m").over(w), "__s2": F.lead("s").over(w)})
    se2 = F.sqrt(F.col("s") * F.col("s") + F.col("__s2") * F.col("__s2")) / root
    raw = F.when(F.col("__m2").isNotNull(), F.when(se2 > 0, two_sided_p((F.col("__m2") - F.col("m")) / se2)).otherwise(F.lit(1.0)))
    agg = agg.withColumn("gain_p", raw)
    holm = holm_adjust(agg.filter("gain_p IS NOT NULL").select(*keys, size, "gain_p"), keys, "gain_p", size, "gain_p_holm").select(*keys, size, "gain_p_holm")
    best = agg.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("nm"), F.col(size).alias("bs"), F.col("s").alias("bsd"))).alias("b"))
    rows = join_on(join_on(agg, holm, [*keys, size], "left"), best, keys)
    top, bse, se = -F.col("b.nm"), F.col("b.bsd") / root, F.col("s") / root
    pooled = F.sqrt(bse * bse + se * se)
    z = F.when(pooled > 0, (top - F.col("m") - delta) / pooled).otherwise(F.lit(0.0))
    rows = rows.withColumns({
        "noninferior": z < normal_ppf(0.05), "within_1se": F.col("m") >= top - bse, "gain_flat": F.coalesce(F.col("gain_p_holm") > 0.05, F.lit(True)),
    })
    rows = rows.withColumn("n_pass", sum((F.col(c).cast("int") for c in ("within_1se", "gain_flat")), F.col("noninferior").cast("int")))
    pick = rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("n_pass") >= min_criteria, F.col(size))), F.max("b.bs")).alias("optimal_size"))
    return join_on(rows, pick, keys).select(*keys, size, F.col("m").alias("mean"), "gain_p", "gain_p_holm", "noninferior", "within_1se", "gain_flat", "n_pass", "optimal_size")


def size_by_stability(features: DataFrame, keys: Sequence[str] = ("model",), threshold: float = 1.0) -> DataFrame:
    ok = (F.col("stability_freq") >= threshold) & F.col("sign_consistent")
    return features.groupBy(*keys).agg(F.sum(F.when(ok, 1).otherwise(0)).alias("panel_size"))


def size_by_significance(features: DataFrame, keys: Sequence[str] = ("model",), q: str = "q_value", threshold: float = 0.05) -> DataFrame:
    return features.groupBy(*keys).agg(F.sum(F.when(F.col(q) <= threshold, 1).otherwise(0)).alias("panel_size"))


def size_fixed(features: DataFrame, size: int, keys: Sequence[str] = ("model",)) -> DataFrame:
    if size < 1:
        raise ValueError("panel size must be at least 1")
    return features.groupBy(*keys).agg(F.max(F.lit(size)).alias("panel_size"))


def peak_noninferiority(sweep: DataFrame, keys: Sequence[str] = ("ordering", "model"), size: str = "panel_size", value: str = "auprc", lo: str = "auprc_lo", hi: str = "auprc_hi", alpha: float = 0.05) -> DataFrame:
    """z of each size against the peak, FDR-adjusted; smallest size that is not inferior."""
    keys = list(keys)
    rows = sweep.withColumn("se", (F.col(hi) - F.col(lo)) / 3.92)
    peak = rows.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("nv"), F.col(size).alias("ps"), F.col("se").alias("pse"))).alias("pk"))
    both = join_on(rows, peak, keys).withColumn("peak_value", -F.col("pk.nv")).withColumn("peak_size", F.col("pk.ps"))
    d = F.col("peak_value") - F.col(value)
    z = F.try_divide(d, F.sqrt(F.col("se") * F.col("se") + F.col("pk.pse") * F.col("pk.pse")))
    both = both.withColumns({"delta_from_peak": d, "z_vs_peak": z}).withColumn("p_inferior", F.when(F.col(size) == F.col("peak_size"), F.lit(0.5)).otherwise(normal_sf(F.col("z_vs_peak"))))
    adj = bh_adjust(both.drop("pk"), keys, "p_inferior", size, None, "p_adj").withColumn("noninferior", F.col("p_adj") >= alpha)
    opt = adj.groupBy(*keys).agg(F.min(F.when(F.col("noninferior"), F.col(size))).alias("pareto_opt"))
    return join_on(adj, opt, keys).select(*keys, size, value, "se", "delta_from_peak", "z_vs_peak", "p_inferior", "p_adj", "noninferior", "peak_size", "peak_value", "pareto_opt")


def size_vs_prevalence(sweep: DataFrame, prevalence: float, keys: Sequence[str] = ("model",), size: str = "panel_size", value: str = "auprc", lo: str = "auprc_lo", hi: str = "auprc_hi", n_boot: int = 1000, delta: float = 0.02, min_criteria: int = 2, alpha: float = 0.05) -> DataFrame:
    """Is the score of a size above the prevalence?  FDR over sizes, plus the three-criterion size."""
    keys = list(keys)
    rows = sweep.withColumn("se", (F.col(hi) - F.col(lo)) / 3.92).withColumn("z", F.try_divide(F.col(value) - F.lit(float(prevalence)), F.col("se")))
    rows = rows.withColumn("p_value", normal_sf(F.col("z")))
    adj = bh_adjust(rows, keys, "p_value", size, None, "p_adj").withColumn("significant", F.col("p_adj") < alpha)
    three = size_three_criterion(rows.select(*keys, size, F.col(value).alias("auroc_mean"), (F.col("se") * math.sqrt(n_boot)).alias("auroc_std")), keys, size, n_seeds=n_boot, delta=delta, min_criteria=min_criteria)
    opt = three.groupBy(*keys).agg(F.max("optimal_size").alias("pareto_opt"))
    small = adj.groupBy(*keys).agg(F.min(F.when(F.col("significant"), F.col(size))).alias("pareto_min"))
    return join_on(join_on(adj, opt, keys), small, keys).select(*keys, size, value, "z", "p_value", "p_adj", "significant", "pareto_opt", "pareto_min")


# ---------------------------------------------------------------- gates
# Complexity order of learners and calibrators, simplest first.
MODEL_COMPLEXITY = {"LR_EN": 1, "LinSVM_cal": 2, "RF": 3, "XGBoost": 4}
CALIBRATION_COMPLEXITY = {"logistic_intercept": 1, "beta": 2, "isotonic": 3}
PANEL_PATTERN = r"_p(\d+)"


def _lookup(col: str, table: dict[str, int]) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(F.col(col) == k, F.lit(v))
    return out.otherwise(F.lit(len(table) + 1))


def hash_normal(seed: int, *cols: Column | str) -> Column:
    """Standard normal from two seeded hashes (polar form of the unit square)."""
    u = [(hash_order(f"{seed}{tag}", *cols) + F.lit(0.5)) / F.lit(4294967296.0) for tag in ("a", "b")]
    return F.sqrt(F.lit(-2.0) * F.log(u[0])) * F.cos(F.lit(2.0 * math.pi) * u[1])


def recipe_comparison(cells: DataFrame, n_seeds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairwise z tests between recipes of one type; the smaller panel wins a tie.

    Means are taken per (recipe, model) and then over models.  Recipes per key are few.
    """
    keys = list(keys)
    s = recipe_summary(cells, n_seeds, keys)
    cols = ("recipe_id", "auroc_mean", "auroc_se", "panel_size")
    a = s.select(*keys, "recipe_type", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = s.select(*keys, "recipe_type", *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = join_on(a, b, [*keys, "recipe_type"])
    better = (F.col("a_auroc_mean") > F.col("b_auroc_mean")) | ((F.col("a_auroc_mean") == F.col("b_auroc_mean")) & (F.col("a_recipe_id") < F.col("b_recipe_id")))
    pairs = pairs.filter(better)
    diff = F.col("a_auroc_mean") - F.col("b_auroc_mean")
    se = F.sqrt(F.col("a_auroc_se") * F.col("a_auroc_se") + F.col("b_auroc_se") * F.col("b_auroc_se"))
    out = pairs.withColumns({"auroc_diff": diff, "se_diff": se})
    out = out.withColumn("z", F.when(F.col("se_diff") > 0, F.col("auroc_diff") / F.col("se_diff")).otherwise(F.lit(0.0)))
    out = out.withColumns({"p_value": two_sided_p(F.col("z")), "ci_includes_zero": F.abs("auroc_diff") < Z95 * F.col("se_diff")})
    tie = F.col("ci_includes_zero") & F.col("a_panel_size").isNotNull() & F.col("b_panel_size").isNotNull()
    winner = F.when(tie, F.when(F.col("a_panel_size") <= F.col("b_panel_size"), F.col("a_recipe_id")).otherwise(F.col("b_recipe_id")))
    return out.select(*keys, "recipe_type", F.col("a_recipe_id").alias("recipe_a"), F.col("b_recipe_id").alias("recipe_b"), "auroc_diff", "se_diff", "z", "p_value", "ci_includes_zero", winner.alias("parsimony_winner"))


def recipe_summary(cells: DataFrame, n_seeds: int, keys: Sequence[str] = ()) -> DataFrame:
    per = cells.groupBy(*keys, "recipe_id", "model").agg(F.avg("auroc_mean").alias("m"), (F.avg("auroc_std") / math.sqrt(n_seeds)).alias("se"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("recipe_id").rlike("^R[0-9]"), "shared").otherwise("model_specific").alias("recipe_type")
    agg = per.groupBy(*keys, kind, "recipe_id").agg(F.avg("m").alias("auroc_mean"), F.avg("se").alias("auroc_se"), F.count_distinct("model").alias("n_models"), F.sum("n").alias("n_cells"))
    return agg.withColumn("panel_size", F.regexp_extract("recipe_id", PANEL_PATTERN, 1).try_cast("int"))


def best_recipes(cells: DataFrame, n_seeds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Best recipe per type; among the best and the smaller ones tied with it, the smallest panel."""
    keys = list(keys)
    s, c = recipe_summary(cells, n_seeds, keys), recipe_comparison(cells, n_seeds, keys)
    by = [*keys, "recipe_type"]
    top = s.groupBy(*by).agg(F.min(F.struct((-F.col("auroc_mean")).alias("m"), F.col("recipe_id").alias("r"))).alias("t")).select(*by, F.col("t.r").alias("__best"))
    ties = join_on(c, top, by).filter(F.col("ci_includes_zero") & (F.col("recipe_a") == F.col("__best")) & F.col("parsimony_winner").isNotNull())
    cand = ties.select(*by, F.col("parsimony_winner").alias("recipe_id")).unionByName(top.select(*by, F.col("__best").alias("recipe_id"))).distinct()
    rows = join_on(cand, s, [*by, "recipe_id"])
    pick = rows.groupBy(*by).agg(F.min(F.struct(F.coalesce("panel_size", F.lit(2**31 - 1)).alias("p"), (-F.col("auroc_mean")).alias("m"), F.col("recipe_id").alias("r"))).alias("s"))
    return pick.select(*by, F.col("s.r").alias("recipe_id"), (-F.col("s.m")).alias("auroc_mean"))


def model_pareto(cells: DataFrame, n_seeds: int, keys: Sequence[str] = ("recipe_id",), n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Share of normal perturbations in which a model is dominated (AUROC up, reliability down); simplest robust model."""
    keys = list(keys)
    s = cells.groupBy(*keys, "model").agg(
        F.avg("auroc_mean").alias("auroc_mean"), F.avg("reliability").alias("reliability_mean"), (F.avg("auroc_std") / math.sqrt(n_seeds)).alias("auroc_se"),
        (F.coalesce(F.stddev_samp("reliability"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("reliability_se"),
    )
    tag = [*keys, "model", "b"]
    rep = s.select(*keys, "model", "auroc_mean", "reliability_mean", "auroc_se", "reliability_se", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    rep = rep.select(*keys, "model", "b", (F.col("auroc_mean") + F.col("auroc_se") * hash_normal(seed, *tag)).alias("a"), (F.col("reliability_mean") + F.col("reliability_se") * hash_normal(seed + 1, *tag)).alias("r"))
    # the models of one replicate form one small array
    arr = rep.groupBy(*keys, "b").agg(F.collect_list(F.struct("model", "a", "r")).alias("g"))
    beaten = F.transform("g", lambda x: F.struct(x["model"].alias("model"), F.exists("g", lambda o: (o["a"] >= x["a"]) & (o["r"] <= x["r"]) & ((o["a"] > x["a"]) | (o["r"] < x["r"]))).alias("dom")))
    frac = arr.select(*keys, F.inline(beaten)).groupBy(*keys, "model").agg(F.avg(F.col("dom").cast("double")).alias("frac_dominated"))
    out = join_on(s, frac, [*keys, "model"]).withColumns({
        "robust_dominated": F.col("frac_dominated") >= 0.95, "robust_nondominated": (1.0 - F.col("frac_dominated")) >= 0.50, "complexity": _lookup("model", MODEL_COMPLEXITY),
    })
    pick = out.groupBy(*keys).agg(
        F.min(F.when(F.col("robust_nondominated"), F.struct("complexity", "model"))).alias("__nd"), F.min(F.struct((-F.col("auroc_mean")).alias("m"), F.col("model"))).alias("__top")
    ).select(*keys, F.coalesce(F.col("__nd.model"), F.col("__top.model")).alias("__sel"))
    return join_on(out, pick, keys).withColumn("selected", F.col("model") == F.col("__sel")).drop("__sel")


def imbalance_utility(cells: DataFrame, n_seeds: int, keys: Sequence[str] = ("recipe_id", "model", "calibration"), n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Utility 0.5 AUPRC + 0.5 inverted reliability (both min-max scaled); the plain setting wins when intervals overlap."""
    keys = list(keys)
    opt = ["weighting", "downsampling"]
    s = cells.groupBy(*keys, *opt).agg(
        F.avg("prauc_mean").alias("auprc_mean"), F.avg("reliability").alias("reliability_mean"), (F.avg("prauc_std") / math.sqrt(n_seeds)).alias("auprc_se"),
        (F.coalesce(F.stddev_samp("reliability"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("reliability_se"),
    )

    def utility(rows: DataFrame, by: list[str], a: str, r: str, name: str) -> DataFrame:
        ends = rows.groupBy(*by).agg(F.min(a).alias("__a0"), F.max(a).alias("__a1"), F.min(r).alias("__r0"), F.max(r).alias("__r1"))
        both = join_on(rows, ends, by)
        an = F.when(F.col("__a1") > F.col("__a0"), (F.col(a) - F.col("__a0")) / (F.col("__a1") - F.col("__a0"))).otherwise(F.lit(0.5))
        rn = F.when(F.col("__r1") > F.col("__r0"), (F.col("__r1") - F.col(r)) / (F.col("__r1") - F.col("__r0"))).otherwise(F.lit(0.5))
        return both.withColumn(name, 0.5 * an + 0.5 * rn).drop("__a0", "__a1", "__r0", "__r1")

    s = utility(s, keys, "auprc_mean", "reliability_mean", "utility")
    tag = [*keys, *opt, "b"]
    rep = s.select(*keys, *opt, "auprc_mean", "auprc_se", "reliability_mean", "reliability_se", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    rep = rep.withColumns({"__a": F.col("auprc_mean") + F.col("auprc_se") * hash_normal(seed, *tag), "__r": F.col("reliability_mean") + F.col("reliability_se") * hash_normal(seed + 1, *tag)})
    ci = utility(rep, [*keys, "b"], "__a", "__r", "__u").groupBy(*keys, *opt).agg(F.percentile("__u", F.lit(0.025)).alias("ci_lo"), F.percentile("__u", F.lit(0.975)).alias("ci_hi"))
    out = join_on(s, ci, [*keys, *opt])
    plain = (F.col("weighting") == "none") & (F.col("downsampling") == 1.0)
    pick = out.groupBy(*keys).agg(
        F.min(F.struct((-F.round("utility", 12)).alias("u"), F.col("weighting").alias("w"), F.col("downsampling").alias("d"), F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"))).alias("t"),
        F.min(F.when(plain, F.struct(F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi")))).alias("pl"),
    )
    use_plain = F.coalesce((F.col("pl.hi") >= F.col("t.lo")) & (F.col("t.hi") >= F.col("pl.lo")), F.lit(False))
    pick = pick.select(*keys, F.when(use_plain, F.lit("none")).otherwise(F.col("t.w")).alias("__w"), F.when(use_plain, F.lit(1.0)).otherwise(F.col("t.d")).alias("__d"))
    return join_on(out, pick, keys).withColumn("selected", (F.col("weighting") == F.col("__w")) & (F.col("downsampling") == F.col("__d"))).drop("__w", "__d")


def calibration_choice(cells: DataFrame, n_seeds: int, keys: Sequence[str] = ("recipe_id", "model", "weighting", "downsampling"), n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Lowest reliability error; among intervals overlapping the best, the simplest calibrator."""
    keys = list(keys)
    s = cells.groupBy(*keys, "calibration").agg(F.avg("reliability").alias("reliability_mean"), (F.coalesce(F.stddev_samp("reliability"), F.lit(0.0)) / math.sqrt(n_seeds)).alias("se"), F.count(F.lit(1)).alias("n_cells"))
    tag = [*keys, "calibration", "b"]
    rep = s.select(*keys, "calibration", "reliability_mean", "se", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    ci = rep.withColumn("__v", F.col("reliability_mean") + F.col("se") * hash_normal(seed, *tag)).groupBy(*keys, "calibration").agg(F.percentile("__v", F.lit(0.025)).alias("ci_lo"), F.percentile("__v", F.lit(0.975)).alias("ci_hi"))
    out = join_on(s, ci, [*keys, "calibration"]).withColumn("complexity", _lookup("calibration", CALIBRATION_COMPLEXITY))
    best = out.groupBy(*keys).agg(F.min(F.struct("reliability_mean", "calibration", "ci_lo", "ci_hi")).alias("t"))
    both = join_on(out, best, keys).withColumn("overlaps_best", (F.col("ci_lo") <= F.col("t.ci_hi")) & (F.col("ci_hi") >= F.col("t.ci_lo")))
    pick = both.groupBy(*keys).agg(F.min(F.when(F.col("overlaps_best"), F.struct("complexity", "calibration"))).alias("s")).select(*keys, F.col("s.calibration").alias("__c"))
    return join_on(both.drop("t"), pick, keys).withColumn("selected", F.col("calibration") == F.col("__c")).drop("__c")


def seed_confirmation(cells: DataFrame, winners: DataFrame, on: Sequence[str], keys: Sequence[str] = (), selection: tuple[int, int] = (100, 119), confirmation: tuple[int, int] = (120, 129)) -> DataFrame:
    """Score drop from selection seeds to confirmation seeds against one standard error."""
    rows = join_on(cells, winners.select(*keys, *on).distinct(), [*keys, *on], "left_semi")
    first, second = F.col("seed").between(*selection), F.col("seed").between(*confirmation)
    v = F.col("auroc_mean")
    agg = rows.groupBy(*keys, *on).agg(
        F.avg(F.when(first, v)).alias("selection_auroc"), F.avg(F.when(second, v)).alias("confirmation_auroc"),
        F.try_divide(F.stddev_samp(F.when(first, v)), F.sqrt(F.count(F.when(first, v)))).alias("selection_se"),
    )
    agg = agg.withColumn("auroc_drop", F.col("selection_auroc") - F.col("confirmation_auroc"))
    bad = F.col("auroc_drop") > F.col("selection_se")
    return agg.withColumn("status", F.when(bad.isNull(), "confirmation_pending").when(bad, "confirmation_drop").otherwise("confirmed"))


def variance_ratio(cells: DataFrame, winners: DataFrame, on: Sequence[str], within: Sequence[str], limit_ratio: float = 1.5) -> DataFrame:
    """Without per-seed rows: spread of the winner against the other settings of its recipe and model."""
    rest = [c for c in on if c not in within]
    win = join_on(cells, winners.select(*on), list(on), "left_semi").groupBy(*within).agg(F.avg("auroc_std").alias("winner_std"))
    near = join_on(cells, winners.select(*within).distinct(), list(within), "left_semi")
    other = join_on(near, winners.select(*within, *rest), list(on), "left_anti").groupBy(*within).agg(F.avg("auroc_std").alias("runner_std"))
    out = join_on(win, other, list(within), "left")
    r = F.when(F.col("runner_std") > 0, F.col("winner_std") / F.col("runner_std"))
    return out.withColumn("variance_ratio", r).withColumn("stability_flag", F.when(F.coalesce(F.col("variance_ratio") > limit_ratio, F.lit(False)), "UNSTABLE").otherwise("OK"))


def ensemble_gate(cells: DataFrame, nondominated: DataFrame, winner: DataFrame, settings: Sequence[str], n_seeds: int, keys: Sequence[str] = (), delta: float = 0.02) -> DataFrame:
    """Gain of averaging the non-dominated models over the single winner.

    Each model contributes its cell at the winner's settings, else its best cell.
    """
    keys, settings = list(keys), list(settings)
    w = winner.select(*keys, *[F.col(c).alias(f"__w_{c}") for c in settings], F.col("model").alias("__w_model"))
    nd = join_on(cells, nondominated.select(*keys, "model").distinct(), [*keys, "model"], "left_semi")
    nd = join_on(nd, w, keys)
    same = F.lit(True)
    for c in settings:
        same = same & (F.col(c) == F.col(f"__w_{c}"))
    one = nd.groupBy(*keys, "model").agg(F.min(F.struct(F.when(same, 0).otherwise(1).alias("o"), (-F.col("auroc_mean")).alias("m"), F.col("auroc_std").alias("s"))).alias("c"))
    ens = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.avg(-F.col("c.m")).alias("ensemble_auroc"), (F.avg("c.s") / math.sqrt(n_seeds)).alias("__es"), F.array_join(F.array_sort(F.collect_list("model")), " + ").alias("ensemble_models"))
    at = join_on(cells, w, keys).filter(same & (F.col("model") == F.col("__w_model"))).groupBy(*keys).agg(F.max(F.struct("auroc_mean", "auroc_std")).alias("c"), F.max("__w_model").alias("single_model"))
    at = at.select(*keys, "single_model", F.col("c.auroc_mean").alias("single_auroc"), (F.col("c.auroc_std") / math.sqrt(n_seeds)).alias("__ss"))
    out = join_on(ens, at, keys).withColumn("gain", F.col("ensemble_auroc") - F.col("single_auroc"))
    se = F.sqrt(F.col("__es") * F.col("__es") + F.col("__ss") * F.col("__ss"))
    out = out.withColumns({"gain_lo": F.col("gain") - Z95 * se, "gain_hi": F.col("gain") + Z95 * se}).drop("__es", "__ss")
    status = F.when(F.col("n_models") < 2, "skipped").when((F.col("gain") > delta) & (F.col("gain_lo") > 0), "ensemble_recommended").otherwise("single_model_preferred")
    return out.withColumn("status", status)


# ---------------------------------------------------------------- tuning trials
def trial_frontier(trials: DataFrame, keys: Sequence[str] = ("model",), gain: str = "auroc", cost: str = "brier", id_col: str = "trial_num", *, limit: int | None = None) -> DataFrame:
    """Trials no other trial beats on both goals: the steps of one ordered scan."""
    from .aggregate import pareto_scan

    return pareto_scan(trials, keys, gain, cost, id_col, limit=limit)


def frontier_choice(front: DataFrame, strategy: str = "knee", keys: Sequence[str] = ("model",), gain: str = "auroc", cost: str = "brier", id_col: str = "trial_num") -> DataFrame:
    """One trial of the frontier: nearest to the ideal point, best sum, or best gain."""
    keys = list(keys)
    ends = front.groupBy(*keys).agg(F.min(gain).alias("__g0"), F.max(gain).alias("__g1"), F.min(cost).alias("__c0"), F.max(cost).alias("__c1"))
    both = join_on(front, ends, keys)
    g = (F.col(gain) - F.col("__g0")) / (F.col("__g1") - F.col("__g0") + 1e-10)
    c = 1.0 - (F.col(cost) - F.col("__c0")) / (F.col("__c1") - F.col("__c0") + 1e-10)
    key = {"knee": F.sqrt((1.0 - g) * (1.0 - g) + (1.0 - c) * (1.0 - c)), "balanced": -(g + c), "extreme_auroc": -F.col(gain)}[strategy]
    pick = both.groupBy(*keys).agg(F.min(F.struct(F.round(key, 10).alias("k"), F.col(id_col), F.col(gain), F.col(cost))).alias("s"))
    return pick.select(*keys, F.col(f"s.{id_col}").alias(id_col), F.col(f"s.{gain}").alias(gain), F.col(f"s.{cost}").alias(cost))


def plateau_trial(trials: DataFrame, threshold: float, keys: Sequence[str] = ("model",), order: str = "trial_num", value: str = "auroc", space_dim: int = 5, cap_factor: float = 1.5, min_cap: int = 20, max_cap: int = 500, patience_share: float = 0.5, min_patience: int = 5, max_patience: int = 50, *, limit: int | None = None) -> DataFrame:
    """First trial whose running best is within the threshold of the final best, its confidence, and the derived cap and patience."""
    from ..core.order import place_rows, running

    keys = list(keys)
    o = [F.col(order)]
    placed, place = place_rows(trials, keys, o, limit=limit)
    run = running(placed, keys, o, {"best": ("max", F.col(value)), "__i": ("sum", F.lit(1))}, place)
    fin = trials.groupBy(*keys).agg(F.max(value).alias("__f"), F.count(F.lit(1)).alias("n_trials"))
    both = join_on(run, fin, keys)
    agg = both.groupBy(*keys).agg(F.min(F.when(F.abs(F.col("best") - F.col("__f")) <= threshold, F.col("__i") - 1)).alias("plateau"), F.max("n_trials").alias("n_trials"))
    conf = F.when(F.col("plateau").isNull(), "low").when(F.col("plateau") <= 0.7 * F.col("n_trials"), "high").when(F.col("plateau") < F.col("n_trials"), "medium").otherwise("low")
    k = F.col("plateau") + 1
    cap = F.greatest(F.lit(max(min_cap, 2 * space_dim)), F.least(F.ceil(cap_factor * k), F.lit(max_cap)))
    patience = F.greatest(F.lit(min_patience), F.least(F.ceil(patience_share * k), F.lit(max_patience)))
    return agg.withColumns({"confidence": conf, "trial_cap": cap, "patience": patience})
