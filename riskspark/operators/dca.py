"""Decision curves: net benefit over a threshold grid.

Scores are counted once per grid cell (binary search inside the scan, sums
map-side), so a curve never multiplies rows by thresholds; the suffix sums run
over at most grid-size rows per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.keys import join_on, ratio
from ..functions.scalar import net_benefit, treat_all
from .hist import clean_scores


def dca_thresholds(lo: float = 0.001, hi: float = 0.10, step: float = 0.001, prevalence: float | None = None) -> list[float]:
    """Evenly spaced thresholds; a prevalence sets the range to a tenth .. ten times itself."""
    if prevalence is not None:
        if not 0 <= prevalence <= 1:
            raise ValueError("prevalence must lie in [0, 1]")
        if 0 < prevalence < 1:
            lo, hi = max(1e-4, prevalence / 10), min(0.5, prevalence * 10)
    lo, hi, step = max(1e-4, float(lo)), min(0.999, float(hi)), max(1e-4, float(step))
    if lo >= hi:
        return [lo, hi]
    n = math.floor((hi - lo) / step) + 1
    if n == 1:
        return [lo]
    width = (hi - lo) / (n - 1)
    return [lo + i * width for i in range(n - 1)] + [hi]


def grid_counts(df: DataFrame, grid: Sequence[float], keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """tp, fp, class totals at every grid threshold (score >= threshold)."""
    keys = list(keys)
    cuts = sorted({float(t) for t in grid})
    rows = clean_scores(df, y, p).select(*keys, F.col(y).cast("bigint").alias("__y"), F.col(p).cast("double").alias("__p"))
    inf = float("inf")
    cells = Bucketizer(splits=[-inf, *cuts, inf], inputCol="__p", outputCol="__cell").transform(rows)
    cells = cells.groupBy(*keys, F.col("__cell").cast("int").alias("__cell")).agg(
        F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg")
    )
    # Column arrays of at most grid-size entries per key keep the rest of the
    # curve on one row per key.
    per_key = cells.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.map_from_entries(F.collect_list(F.struct("__cell", "pos"))).alias("__mp"),
        F.map_from_entries(F.collect_list(F.struct("__cell", "neg"))).alias("__mn"),
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("__cell"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])
    long = per_key.select("*", F.inline(steps))
    long = long.select(
        *keys, "n_pos", "n_neg", "__cell", "threshold",
        F.coalesce(F.col("__mp")[F.col("__cell")], F.lit(0)).alias("pos"),
        F.coalesce(F.col("__mn")[F.col("__cell")], F.lit(0)).alias("neg"),
    )
    w = Window.partitionBy(*keys).orderBy(F.col("__cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)}).drop("pos", "neg", "__cell")


def decision_curve(df: DataFrame, grid: Sequence[float], keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", prevalence: float | None = None) -> DataFrame:
    """Net benefit of the model, of treating all and none, with counts and rates."""
    keys = list(keys)
    c = grid_counts(df, [t for t in grid if 0 < t < 1], keys, y, p)
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    prev = F.lit(float(prevalence)) if prevalence is not None else F.col("n_pos") / n
    t = F.col("threshold")
    c = c.withColumns({
        "net_benefit_model": net_benefit(F.col("tp"), F.col("fp"), n, t),
        "net_benefit_all": treat_all(prev, t),
    })
    return c.select(
        *keys, "threshold", (t * 100).alias("threshold_pct"), "net_benefit_model", "net_benefit_all",
        F.lit(0.0).alias("net_benefit_none"),
        F.when(F.col("net_benefit_all") > 0, F.col("net_benefit_model") / F.col("net_benefit_all")).alias("relative_utility"),
        "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"),
        (F.col("tp") + F.col("fp")).alias("n_treat"),
        ratio(F.col("tp"), F.col("n_pos")).alias("sensitivity"),
        ratio(F.col("n_neg") - F.col("fp"), F.col("n_neg")).alias("specificity"),
    )


def _grid_window(keys: Sequence[str]):
    # one curve holds one row per grid threshold
    return Window.partitionBy(*keys).orderBy("threshold")


def dca_zero_crossing(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last threshold with positive net benefit, interpolated to the next one; NULL if never positive."""
    keys = list(keys)
    w = _grid_window(keys)
    c = curve.select(*keys, "threshold", F.col("net_benefit_model").alias("nb"))
    c = c.withColumns({"t2": F.lead("threshold").over(w), "nb2": F.lead("nb").over(w)})
    last = F.max(F.when(F.col("nb") > 0, F.struct("threshold", "nb", "t2", "nb2"))).alias("s")
    s = F.col("s")
    flat = s["t2"].isNull() | (s["nb2"] == s["nb"])
    cross = F.when(flat, s["threshold"]).otherwise(s["threshold"] + (s["t2"] - s["threshold"]) * (-s["nb"] / (s["nb2"] - s["nb"])))
    return c.groupBy(*keys).agg(last).select(*keys, F.when(s.isNotNull(), cross).alias("zero_crossing"))


def dca_curve_crossing(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First sign change of a stored curve; else the point nearest to zero when within 0.05."""
    keys = list(keys)
    w = _grid_window(keys)
    c = curve.select(*keys, "threshold", F.col("net_benefit_model").alias("nb"))
    c = c.withColumns({"t2": F.lead("threshold").over(w), "nb2": F.lead("nb").over(w)})
    change = F.col("nb2").isNotNull() & (F.signum("nb") != F.signum("nb2"))
    agg = c.groupBy(*keys).agg(
        F.min(F.when(change, F.struct("threshold", "nb", "t2", "nb2"))).alias("s"),
        F.min(F.struct(F.abs("nb").alias("a"), F.col("threshold").alias("t"))).alias("near"),
    )
    s = F.col("s")
    cross = F.when(F.abs(s["nb2"] - s["nb"]) > 1e-10, s["threshold"] + (-s["nb"]) * (s["t2"] - s["threshold"]) / (s["nb2"] - s["nb"]))
    near = F.when(F.col("near.a") < 0.05, F.col("near.t"))
    return agg.select(*keys, F.when(s.isNotNull(), cross).otherwise(near).alias("crossing"))


def dca_table(df: DataFrame, grid: Sequence[float], keys: Sequence[str] = (), model: str = "model", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Long net benefit: one series per model plus treat_all and treat_none."""
    keys = list(keys)
    c = decision_curve(df, grid, [*keys, model], y, p)
    models = c.select(*keys, F.col(model).alias("series"), "threshold", F.col("net_benefit_model").alias("net_benefit"))
    base = c.groupBy(*keys, "threshold").agg(F.min(F.struct(F.col(model), F.col("net_benefit_all").alias("v"))).alias("s"))
    pair = F.inline(F.array(
        F.struct(F.lit("treat_all").alias("series"), F.col("s.v").alias("net_benefit")),
        F.struct(F.lit("treat_none").alias("series"), F.lit(0.0).alias("net_benefit")),
    ))
    refs = base.select(*keys, "threshold", pair)
    return models.unionByName(refs)


def dca_summary(curve: DataFrame, keys: Sequence[str] = (), report_points: Sequence[float] = (0.005, 0.01, 0.02, 0.05)) -> DataFrame:
    """Ranges where the model beats the defaults, trapezoid integrals, values at report points."""
    keys = list(keys)
    w = _grid_window(keys)
    m, a, t = F.col("net_benefit_model"), F.col("net_benefit_all"), F.col("threshold")
    c = curve.withColumns({
        "__dt": F.lead(t).over(w) - t,
        "__m2": (F.lead(m).over(w) + m) / 2.0,
        "__a2": (F.lead(a).over(w) + a) / 2.0,
    })
    aggs = [
        F.count(F.lit(1)).alias("n_thresholds"),
        F.min(F.when(m > a, t)).alias("beats_all_from"), F.max(F.when(m > a, t)).alias("beats_all_to"),
        F.min(F.when(m > 0, t)).alias("beats_none_from"), F.max(F.when(m > 0, t)).alias("beats_none_to"),
        F.sum(F.col("__m2") * F.col("__dt")).alias("integrated_nb_model"),
        F.sum(F.col("__a2") * F.col("__dt")).alias("integrated_nb_all"),
        F.sum((F.col("__m2") - F.col("__a2")) * F.col("__dt")).alias("integrated_nb_improvement"),
    ]
    for pt in report_points:
        near = F.abs(t - F.lit(pt)) <= F.lit(0.001 + 1e-5 * pt)
        first = F.min(F.when(near, F.struct(t, m.alias("m"), a.alias("a"))))
        tag = f"{pt * 100:.1f}".replace(".", "p")
        aggs += [first["m"].alias(f"nb_model_at_{tag}pct"), first["a"].alias(f"nb_all_at_{tag}pct")]
    return c.groupBy(*keys).agg(*aggs)


def band(curves: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, population sd and 2.5/97.5 percentiles over splits at each grid point."""
    return curves.groupBy(*by).agg(
        F.count(value).alias("n_splits"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
        F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"),
    )


def dca_band(df: DataFrame, grid: Sequence[float], keys: Sequence[str], split: str, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Decision curve per split, then the band over splits."""
    c = decision_curve(df, grid, [*keys, split], y, p)
    return band(c, [*keys, "threshold"], "net_benefit_model")


def interpolate_to_grid(points: DataFrame, keys: Sequence[str], x: str, v: str, grid: Sequence[float], falling: bool = False) -> DataFrame:
    """Piecewise-linear values of keyed (x, v) curves on a fixed grid, ends held.

    Each grid value needs two curve points only: the last one at or below it and
    the first one above it, found with one aggregate over grid cells.  Among
    points with equal x a curve moves up, or down when ``falling``.
    """
    keys = list(keys)
    cuts = sorted(float(g) for g in grid)
    inf = float("inf")
    along = -F.col("__v") if falling else F.col("__v")
    rows = points.select(*keys, F.col(x).cast("double").alias("__x"), F.col(v).cast("double").alias("__v"), (-F.col(x).cast("double")).alias("__nx"))
    # cells are open below and closed above, hence the search on -x
    cells = Bucketizer(splits=[-inf, *[-c for c in reversed(cuts)], inf], inputCol="__nx", outputCol="__b").transform(rows)
    point = F.struct(F.col("__x"), along.alias("__o"), F.col("__v"))
    ends = cells.groupBy(*keys, (F.lit(len(cuts)) - F.col("__b").cast("int")).alias("__c")).agg(F.min(point).alias("__lo"), F.max(point).alias("__hi"))
    base = ends.select(*keys).distinct()
    frame = base.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("__c"))
    full = join_on(frame, ends, [*keys, "__c"], "left")
    # at most grid-size + 1 rows per key
    up = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy("__c").rowsBetween(0, Window.unboundedFollowing)
    full = full.withColumns({
        "__below": F.last("__hi", ignorenulls=True).over(up),
        "__above": F.first("__lo", ignorenulls=True).over(down),
    }).filter(F.col("__c") > 0)
    at = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("__c"))
    full = full.withColumn("grid", at)
    x0, v0, x1, v1 = (F.col(c) for c in ("__below.__x", "__below.__v", "__above.__x", "__above.__v"))
    line = v0 + (v1 - v0) * (F.col("grid") - x0) / (x1 - x0)
    val = F.when(x0.isNull(), v1).when((x0 == F.col("grid")) | x1.isNull(), v0).otherwise(line)
    return full.select(*keys, "grid", val.alias("value"))
