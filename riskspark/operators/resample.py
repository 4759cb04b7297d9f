"""Exact-size bootstrap as rows: draws, weights and percentile intervals.

A replicate of a group of n rows has n slots.  Slot j of replicate b aims at row
index ``draw(seed, b, group, j) mod n`` where rows are indexed in hash order.
Slots are generated next to the rows (explode, no shuffle), collapsed to weights
per (group, index, replicate) and joined back on the index, so neither a hot key
nor the rare class ends in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..core.keys import join_on
from ..core.order import PRIME, ROUND_CONSTANTS, fifth, hash_rank, mixed_key, power_mix
from ..core.session import cut_lineage, spread
from .discrimination import CURVE_METRICS, curve_metrics
from .hist import clean_scores, curve_points, score_histogram

def indexed(df: DataFrame, by: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Rows with a 0-based hash-order index ``idx`` and their group size ``n_grp``, ready to be multiplied."""
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_grp"))
    ranked = hash_rank(df, by, id_col, seed, "idx").withColumn("idx", F.col("idx") - 1)
    return spread(join_on(ranked, n, by))


def draw_targets(df: DataFrame, by: Sequence[str], id_col: str, n_boot: int, seed: int, *, rows: DataFrame | None = None) -> DataFrame:
    """(by, b, target): one row per slot and replicate."""
    base = rows if rows is not None else indexed(df, by, id_col, seed)
    slots = base.select(*by, "idx", "n_grp", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    low, high = F.col("idx") % PRIME, F.expr(f"idx div {PRIME}")
    # same slots in different groups may share draws; groups have their own rows
    slots = power_mix(slots, "__u", [F.lit(seed), F.col("b"), low, high])
    slots = power_mix(slots, "__v", [F.col("__u")])
    target = (F.col("__u") * PRIME + F.col("__v")) % F.col("n_grp")
    return slots.select(*by, "b", target.alias("target"))


def draw_weights(df: DataFrame, keys: Sequence[str], id_col: str, n_boot: int, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` that were drawn, with replicate ``b`` and ``weight`` >= 1."""
    by = [*keys, *strata]
    base = indexed(df, by, id_col, seed)
    draws = draw_targets(df, by, id_col, n_boot, seed, rows=base)
    weights = draws.groupBy(*by, F.col("target").alias("idx"), "b").agg(F.count(F.lit(1)).alias("weight"))
    # Spark takes the replicates of a small table for as small as the table, and would broadcast them
    return join_on(base.drop("n_grp"), weights.hint("merge"), [*by, "idx"]).drop("idx")


def resampled_means(n_boot: int, seed: int, probs: Sequence[float]):
    """Quantiles of the means of ``n_boot`` draws from the values of a list; entry i of the list has index i in ``draw_targets``."""
    heads = np.array([[mixed_key(seed, b)] for b in range(n_boot)], np.int64)

    kept: dict[int, np.ndarray] = {}  # lists of one length share their draws

    def targets(n: int, b: int, step: int) -> np.ndarray:
        if n in kept:
            return kept[n]
        at = np.arange(n, dtype=np.int64)
        u = fifth((heads[b : b + step] + at % PRIME + ROUND_CONSTANTS[2]) % PRIME)
        u = fifth((u + at // PRIME + ROUND_CONSTANTS[3]) % PRIME)
        target = (u * PRIME + fifth((u + ROUND_CONSTANTS[0]) % PRIME)) % n
        if step >= n_boot and len(kept) < 16:
            kept[n] = target
        return target

    def quantiles(v: np.ndarray) -> list[float]:
        means = np.empty(n_boot)
        step = max(1, (1 << 18) // len(v))
        for b in range(0, n_boot, step):
            means[b : b + step] = v[targets(len(v), b, step)].mean(1)
        means.sort()
        where = [p * (n_boot - 1) for p in probs]
        low = [int(w) for w in where]
        return [float(means[i] + (w - i) * (means[min(i + 1, n_boot - 1)] - means[i])) for i, w in zip(low, where, strict=True)]

    @F.pandas_udf("array<double>")
    def of_lists(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: quantiles(np.asarray(v, float)))

    return of_lists


def _replicate_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], y: str, p: str, measure: DataFrame, limit: int | None) -> DataFrame:
    by = [*keys, "b"]
    hist = score_histogram(rows, by, y, p, weight="weight")
    return curve_metrics(curve_points(hist, by, measure=measure, p=p, limit=limit), by, metrics)


def _long(df: DataFrame, by: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value)) for m in names])
    return df.select(*by, F.inline(pairs))


def bootstrap_ci(df: DataFrame, keys: Sequence[str] = (), id_col: str = "id", metrics: Sequence[str] = ("auroc",), n_boot: int = 1000, seed: int = 42, y: str = "y_true", p: str = "y_prob", stratify: bool = True, *, limit: int | None = None) -> DataFrame:
    """Percentile interval per key and metric.

    NULL when the scores hardly vary, a class has fewer than two rows, or fewer
    than max(20, n_boot / 2) replicates are finite.
    """
    keys = list(keys)
    # read several times below; the table behind it is computed once
    rows = cut_lineage(clean_scores(df, y, p).select(*keys, id_col, y, p))
    full = curve_metrics(curve_points(score_histogram(rows, keys, y, p), keys, measure=rows, p=p, limit=limit), keys, metrics)
    guard = rows.groupBy(*keys).agg(
        F.coalesce(F.var_pop(p) >= 1e-10, F.lit(False)).alias("__v"),
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__a"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("__b"),
    )
    drawn = draw_weights(rows, keys, id_col, n_boot, seed, [y] if stratify else [])
    rep = _replicate_metrics(drawn, keys, metrics, y, p, rows, limit)
    by = [*keys, "metric"]
    # a replicate list per (key, metric) holds n_boot numbers
    ci = _long(rep, keys, metrics, "v").groupBy(*by).agg(
        F.avg("v").alias("boot_mean"), F.stddev_samp("v").alias("boot_std"),
        F.percentile("v", F.lit(0.025)).alias("ci_lo"), F.percentile("v", F.lit(0.975)).alias("ci_hi"), F.count("v").alias("n_finite"),
    )
    out = join_on(join_on(_long(full, keys, metrics, "estimate"), ci, by, "left"), guard, keys)
    ok = F.col("__v") & (F.col("__a") >= 2) & (F.col("__b") >= 2) & (F.col("n_finite") >= max(20, n_boot // 2))
    cols = [F.when(ok, F.col(c)).alias(c) for c in ("boot_mean", "boot_std", "ci_lo", "ci_hi")]
    return out.select(*by, "estimate", *cols, F.coalesce("n_finite", F.lit(0)).alias("n_finite"))


def paired_replicates(df: DataFrame, keys: Sequence[str], id_col: str, metric: str, n_boot: int, seed: int, y: str, p1: str, p2: str, stratify: bool, *, limit: int | None = None) -> DataFrame:
    """(keys, b, m1, m2) of one metric for two score columns on the same draws."""
    keys = list(keys)
    rows = cut_lineage(clean_scores(clean_scores(df, y, p1), y, p2).select(*keys, id_col, y, p1, p2))
    drawn = draw_weights(rows, keys, id_col, n_boot, seed, [y] if stratify else [])
    both = drawn.select(*keys, "b", y, "weight", F.inline(F.array(
        F.struct(F.lit(1).alias("side"), F.col(p1).alias("__p")), F.struct(F.lit(2).alias("side"), F.col(p2).alias("__p"))
    )))
    by = [*keys, "b", "side"]
    scores = rows.select(F.explode(F.array(F.col(p1).cast("double"), F.col(p2).cast("double"))).alias("__p"))
    pts = curve_points(score_histogram(both, by, y, "__p", weight="weight"), by, measure=scores, p="__p", limit=limit)
    m = pts.groupBy(*by).agg(CURVE_METRICS[metric]().alias("m"))
    return m.groupBy(*keys, "b").agg(
        F.max(F.when(F.col("side") == 1, F.col("m"))).alias("m1"), F.max(F.when(F.col("side") == 2, F.col("m"))).alias("m2")
    )


def _full_difference(df: DataFrame, keys: Sequence[str], metric: str, y: str, p1: str, p2: str, limit: int | None) -> DataFrame:
    rows = clean_scores(clean_scores(df, y, p1), y, p2)
    sides = [
        curve_metrics(curve_points(score_histogram(rows, keys, y, p), keys, measure=df, p=p, limit=limit), keys, [metric]).withColumnRenamed(metric, n)
        for p, n in ((p1, "__m1"), (p2, "__m2"))
    ]
    return join_on(sides[0], sides[1], keys).select(*keys, (F.col("__m1") - F.col("__m2")).alias("full_diff"))


def bootstrap_diff_ci(df: DataFrame, p1: str, p2: str, keys: Sequence[str] = (), id_col: str = "id", metric: str = "auroc", n_boot: int = 500, seed: int = 42, y: str = "y_true", *, limit: int | None = None) -> DataFrame:
    """Full-sample difference and its percentile interval on paired, class-stratified draws."""
    keys = list(keys)
    rep = paired_replicates(df, keys, id_col, metric, n_boot, seed, y, p1, p2, True, limit=limit)
    d = F.col("m1") - F.col("m2")
    ci = rep.groupBy(*keys).agg(F.percentile(d, F.lit(0.025)).alias("ci_lo"), F.percentile(d, F.lit(0.975)).alias("ci_hi"), F.count(d).alias("n_finite"))
    out = join_on(_full_difference(df, keys, metric, y, p1, p2, limit), ci, keys, "left")
    ok = F.col("n_finite") >= max(20, n_boot // 2)
    return out.select(*keys, "full_diff", F.when(ok, F.col("ci_lo")).alias("ci_lo"), F.when(ok, F.col("ci_hi")).alias("ci_hi"), "n_finite")


def noninferiority(df: DataFrame, p_ref: str, p_new: str, keys: Sequence[str] = (), id_col: str = "id", delta: float = 0.02, alpha: float = 0.05, n_boot: int = 500, seed: int = 42, y: str = "y_true", pooled_over: str | None = None, *, limit: int | None = None) -> DataFrame:
    """One-sided test that the new score loses at most ``delta`` AUROC.

    Draws are not stratified; one-class draws drop out.  With ``pooled_over`` (a
    seed column) the draws are made per seed, n_boot / seeds each, and pooled.
    """
    keys = list(keys)
    inner = [*keys, pooled_over] if pooled_over else keys
    per = n_boot
    if pooled_over:
        seeds = df.agg(F.count_distinct(pooled_over).alias("n")).first().n
        per = max(1, n_boot // max(1, seeds))
    rep = paired_replicates(df, inner, id_col, "auroc", per, seed, y, p_ref, p_new, False, limit=limit)
    d = F.col("m1") - F.col("m2")
    agg = rep.filter(d.isNotNull()).groupBy(*keys).agg(
        F.avg(d).alias("mean_diff"), F.percentile(d, F.lit(1.0 - alpha)).alias("upper"),
        F.avg(F.when(d > delta, 1.0).otherwise(0.0)).alias("p_value"), F.count(d).alias("n_draws"),
    )
    return agg.withColumn("noninferior", F.col("upper") <= F.lit(delta))
