"""Permutation p-values, multiplicity, paired contrasts and agreement of rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..core.keys import finite, join_on, ratio
from ..core.order import average_rank, hash_within, id_digest, place_rows, running
from ..core.quantile import quantiles
from ..core.session import cut_lineage, spread
from ..core.tails import t_two_sided_p, two_sided_p

Z95 = 1.96


def empirical_p(nulls: DataFrame, observed: DataFrame, keys: Sequence[str] = ("model",), null: str = "null_auroc", obs: str = "observed") -> DataFrame:
    """(1 + nulls at or above the observed value) / (1 + nulls)."""
    keys = list(keys)
    rows = join_on(nulls.filter(finite(F.col(null))), observed.select(*keys, obs), keys)
    agg = rows.groupBy(*keys).agg(F.max(obs).alias(obs), F.count(F.lit(1)).alias("n_perms"), F.sum(F.when(F.col(null) >= F.col(obs), 1).otherwise(0)).alias("__ge"))
    return agg.select(*keys, obs, "n_perms", ((F.col("__ge") + 1) / (F.col("n_perms") + 1)).alias("p_value"))


def null_summary(nulls: DataFrame, observed: DataFrame, keys: Sequence[str] = ("model", "split_seed"), null: str = "null_auroc", obs: str = "observed", *, limit: int | None = None) -> DataFrame:
    """Observed value, p, moments and exact median of the null values."""
    keys = list(keys)
    p = empirical_p(nulls, observed, keys, null, obs)
    rows = nulls.filter(finite(F.col(null)))
    stats = rows.groupBy(*keys).agg(F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_std"), F.min(null).alias("null_min"), F.max(null).alias("null_max"))
    counts = rows.groupBy(*keys, F.col(null).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    median = quantiles(counts, keys, "v", {"null_median": 0.5}, measure=nulls, limit=limit)
    return join_on(join_on(p, stats, keys), median, keys)


def pooled_null(results: DataFrame, keys: Sequence[str] = ("model",), alpha: float = 0.05, seed: str = "split_seed", null: str = "null_auroc", obs: str = "observed") -> DataFrame:
    """Pool nulls over seeds against the mean observed value; no usable null gives p = 1."""
    keys = list(keys)
    base = results.groupBy(*keys).agg(F.avg(F.when(finite(F.col(obs)), F.col(obs))).alias("observed"), F.count_distinct(seed).alias("__seeds"))
    rows = join_on(results.select(*keys, F.col(null).alias("__null")), base, keys)
    ok = finite(F.col("__null"))
    agg = rows.groupBy(*keys).agg(
        F.max("observed").alias("__obs"), F.sum(F.when(ok, 1).otherwise(0)).alias("n_perms"), F.max("__seeds").alias("__seeds"),
        F.sum(F.when(ok & (F.col("__null") >= F.col("observed")), 1).otherwise(0)).alias("__ge"),
    )
    some = F.col("n_perms") > 0
    p = F.when(some & F.col("__obs").isNotNull(), (F.col("__ge") + 1) / (F.col("n_perms") + 1)).otherwise(F.lit(1.0))
    return agg.select(*keys, F.when(some, F.col("__obs")).alias("observed"), "n_perms", F.when(some, F.col("__seeds")).otherwise(F.lit(0)).cast("bigint").alias("n_seeds"), p.alias("p_value")).withColumn("significant", F.col("p_value") < alpha)


def _sorted_ranks(df: DataFrame, keys: Sequence[str], p: str, tie: str, limit: int | None) -> tuple[DataFrame, str | None, list[str]]:
    keys = list(keys)
    order = [F.col(p).asc(), F.col(tie).asc()]
    placed, place = place_rows(df, keys, order, limit=limit)
    out = running(placed, keys, order, {"__rk": ("sum", F.lit(1))}, place)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return join_on(out, n, keys), place, keys


def bh_adjust(df: DataFrame, keys: Sequence[str] = (), p: str = "p_value", tie: str = "feature", universe: int | None = None, out: str = "q_value", *, limit: int | None = None) -> DataFrame:
    """Step-up false discovery rate; ``universe`` pads with tests of p = 1 without changing ranks."""
    rows, place, keys = _sorted_ranks(df.filter(F.col(p).isNotNull()), keys, p, tie, limit)
    m = F.greatest(F.col("__n"), F.lit(universe)) if universe else F.col("__n")
    rows = rows.withColumn("__raw", F.col(p) * m / F.col("__rk"))
    back = rows.withColumn("__place", -F.col(place)) if place else rows
    back = running(back, keys, [F.col(p).desc(), F.col(tie).desc()], {out: ("min", F.col("__raw"))}, "__place" if place else None)
    return back.withColumn(out, F.least(F.lit(1.0), out)).drop("__rk", "__n", "__raw", *(["__place"] if place else []))


def holm_adjust(df: DataFrame, keys: Sequence[str] = (), p: str = "p_value", tie: str = "feature", out: str = "p_holm", *, limit: int | None = None) -> DataFrame:
    """Step-down family-wise adjustment."""
    rows, place, keys = _sorted_ranks(df.filter(F.col(p).isNotNull()), keys, p, tie, limit)
    rows = rows.withColumn("__raw", F.col(p) * (F.col("__n") - F.col("__rk") + 1))
    rows = running(rows, keys, [F.col(p).asc(), F.col(tie).asc()], {out: ("max", F.col("__raw"))}, place)
    return rows.withColumn(out, F.least(F.lit(1.0), out)).drop("__rk", "__n", "__raw", *([place] if place else []))


def _delta_stats(deltas: DataFrame, by: Sequence[str], with_p: bool = True) -> DataFrame:
    agg = deltas.filter(F.col("delta").isNotNull()).groupBy(*by).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("__sd"))
    se = F.col("__sd") / F.sqrt("n")
    out = agg.withColumns({
        "ci_lo": F.col("mean_delta") - Z95 * se, "ci_hi": F.col("mean_delta") + Z95 * se,
        "cohens_d": F.when(F.col("__sd") > 0, F.col("mean_delta") / F.col("__sd")).otherwise(F.lit(0.0)),
        "t_stat": F.when((F.col("n") >= 2) & (F.col("__sd") > 0), F.col("mean_delta") / se),
    })
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("t_stat").isNotNull(), t_two_sided_p(F.col("t_stat"), (F.col("n") - 1).cast("double"))))
    return out.drop("__sd")


def paired_contrasts(df: DataFrame, factors: dict[str, tuple], metrics: Sequence[str], keys: Sequence[str] = (), seed: str = "seed", with_p: bool = True) -> DataFrame:
    """Main effect of each factor on each metric: per-seed mean difference high - low, tested over seeds."""
    keys = list(keys)
    parts = []
    for f, (lo, hi) in factors.items():
        d = [(F.avg(F.when(F.col(f) == hi, F.col(m))) - F.avg(F.when(F.col(f) == lo, F.col(m)))).alias(m) for m in metrics]
        per = df.groupBy(*keys, seed).agg(*d)
        long = per.select(*keys, seed, F.lit(f).alias("effect"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in metrics])))
        parts.append(long)
    return _delta_stats(reduce(DataFrame.unionByName, parts), [*keys, "effect", "metric"], with_p)


def interactions(df: DataFrame, factors: dict[str, tuple], metrics: Sequence[str], keys: Sequence[str] = (), seed: str = "seed", with_p: bool = True) -> DataFrame:
    """Differences of differences for all pairs of factors, and the three-way term of the first three."""
    keys, names = list(keys), list(factors)

    def cell(m: str, levels: dict[str, object]) -> Column:
        cond = reduce(lambda a, b: a & b, [F.col(f) == v for f, v in levels.items()])
        return F.avg(F.when(cond, F.col(m)))

    def two(m: str, a: str, b: str, fixed: dict) -> Column:
        (al, ah), (bl, bh) = factors[a], factors[b]
        return (cell(m, {a: ah, b: bh, **fixed}) - cell(m, {a: al, b: bh, **fixed})) - (cell(m, {a: ah, b: bl, **fixed}) - cell(m, {a: al, b: bl, **fixed}))

    terms: dict[str, dict[str, Column]] = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            terms[f"{a}:{b}"] = {m: two(m, a, b, {}) for m in metrics}
    if len(names) >= 3:
        a, b, c = names[:3]
        lo, hi = factors[c]
        terms[f"{a}:{b}:{c}"] = {m: two(m, a, b, {c: hi}) - two(m, a, b, {c: lo}) for m in metrics}
    structs = [F.struct(F.lit(t).alias("effect"), F.lit(m).alias("metric"), v.alias("delta")) for t, ms in terms.items() for m, v in ms.items()]
    per = df.groupBy(*keys, seed).agg(F.array(*structs).alias("__a")).select(*keys, seed, F.inline("__a"))
    return _delta_stats(per, [*keys, "effect", "metric"], with_p)


@F.pandas_udf(T.DoubleType())
def _signed_rank_exact(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of the smaller signed-rank sum of untied differences; one table per number of them."""
    out = np.full(len(w), np.nan)
    stat, count = w.to_numpy(float), n.to_numpy(float)
    given = ~(np.isnan(stat) | np.isnan(count))
    for k in np.unique(count[given]).astype(int):
        share = np.zeros(k * (k + 1) // 2 + 1)
        share[0] = 1.0
        for r in range(1, k + 1):  # halved in each step: shares of the 2**k sign patterns, no overflow
            later = share.copy()
            later[r:] += share[: len(share) - r]
            share = later / 2
        at = given & (count == k)
        out[at] = np.minimum(1.0, 2.0 * np.cumsum(share)[stat[at].astype(int)])
    return pd.Series(out, index=w.index)


def wilcoxon_pairs(cv: DataFrame, keys: Sequence[str] = (), combo: str = "combo", fold: str = "fold", value: str = "auprc", min_nonzero: int = 5, method: str = "exact") -> DataFrame:
    """Signed-rank test over folds for every pair of combinations (a < b).

    ``method``: ``exact`` counts sign patterns where no difference is tied or zero, at any
    number of folds, and uses the normal form with the tie correction elsewhere; ``normal``
    uses that form throughout.  Combinations are configurations, so pairs are few.
    """
    if method not in ("exact", "normal"):
        raise ValueError("method is exact or normal")
    keys = list(keys)
    a = cv.select(*keys, fold, F.col(combo).alias("a"), F.col(value).alias("__va"))
    b = cv.select(*keys, fold, F.col(combo).alias("b"), F.col(value).alias("__vb"))
    d = join_on(a, b, [*keys, fold]).filter("a < b").withColumn("d", F.col("__va") - F.col("__vb"))
    by = [*keys, "a", "b"]
    base = d.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.count("d").alias("n_folds"))
    nz = d.filter("d <> 0").withColumn("__abs", F.round(F.abs("d"), 12))
    ranks = average_rank(nz, by, "__abs", "rk")
    both = join_on(nz, ranks, [*by, "__abs"])
    sums = both.groupBy(*by).agg(
        F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("__wp"), F.sum(F.when(F.col("d") < 0, F.col("rk")).otherwise(0.0)).alias("__wm"),
        F.count(F.lit(1)).alias("n_nonzero"), F.sum((F.col("n") * F.col("n") - 1).cast("double")).alias("__t"),
    )
    out = join_on(base, sums, by, "left").withColumn("n_nonzero", F.coalesce("n_nonzero", F.lit(0)))
    n = F.col("n_nonzero").cast("double")
    ok = F.col("n_nonzero") >= min_nonzero
    stat = F.when(ok, F.least("__wp", "__wm"))
    z = F.try_divide(stat - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__t") / 48))
    exact = ok & (F.col("__t") == 0) & (F.col("n_nonzero") == F.col("n_folds"))
    p = F.when(ok, two_sided_p(z))
    if method == "exact":
        p = F.when(exact, _signed_rank_exact(F.when(exact, stat), F.when(exact, n))).otherwise(p)
    return out.select(*by, "mean_diff", "n_nonzero", stat.alias("statistic"), p.alias("p_value"))


def variance_decomposition(df: DataFrame, factors: Sequence[str], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of squares of a balanced full-factorial layout, up to the last interaction, and the rest.

    One cube gives the sums of every margin; a term is its between-cell sum of
    squares minus those of the terms it contains.
    """
    keys, names = list(keys), list(factors)
    k = len(names)
    cells = df.groupBy(*keys, *names).agg(F.count(value).alias("__c"), F.sum(value).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q"))
    sets = F.explode(F.array(*[F.lit(i) for i in range(2**k)])).alias("__set")
    spread = cells.select(*keys, "__c", "__s", "__q", *names, sets)
    level = F.concat_ws("|", *[F.when(F.col("__set").bitwiseAND(1 << i) != 0, F.col(f).cast("string")).otherwise(F.lit("*")) for i, f in enumerate(names)])
    margins = spread.groupBy(*keys, "__set", level.alias("__lv")).agg(F.sum("__c").alias("c"), F.sum("__s").alias("s"), F.sum("__q").alias("q"))
    per = margins.groupBy(*keys, "__set").agg(F.sum(F.try_divide(F.col("s") * F.col("s"), F.col("c"))).alias("b"), F.sum("q").alias("q"))
    wide = per.groupBy(*keys).agg(*[F.max(F.when(F.col("__set") == i, F.col("b"))).alias(f"b{i}") for i in range(2**k)], F.max("q").alias("q"))
    between = {i: F.col(f"b{i}") - F.col("b0") for i in range(2**k)}
    ss: dict[int, Column] = {}
    for i in sorted(range(1, 2**k), key=lambda x: (bin(x).count("1"), x)):
        ss[i] = reduce(lambda a, j: a - ss[j], [j for j in ss if j & i == j], between[i])
    total = F.col("q") - F.col("b0")
    rows = [F.struct(F.lit(":".join(f for b, f in enumerate(names) if i >> b & 1)).alias("term"), v.alias("ss")) for i, v in ss.items()]
    rows.append(F.struct(F.lit("residual").alias("term"), (total - between[2**k - 1]).alias("ss")))
    return wide.select(*keys, total.alias("__t"), F.inline(F.array(*rows))).select(*keys, "term", "ss", (F.try_divide("ss", "__t") * 100).alias("pct"))


#: Ranks in a block of ``_inversions``.
RANKS_PER_TASK = 1 << 18


def _inversions(rows: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """(keys, __inv): pairs with x < x' and z > z', for ranks x and z from 1.

    Both ranks are cut into blocks. Pairs in one block of x are counted there, pairs in one block of z (of
    different blocks of x) there, and all others by the sizes of the cells that the blocks make.
    """
    cell = [F.expr(f"({c} - 1) div {block}").alias(n) for c, n in (("x", "__xb"), ("z", "__zb"))]
    rows = rows.select(*keys, "x", "z", *cell)
    types = "".join(f"`{k}` {t}, " for k, t in rows.select(*keys).dtypes)

    def counted_by(*order: str):
        def fn(table: pa.Table) -> pa.Table:
            by = np.lexsort([table.column(c).to_numpy() for c in reversed(order)])
            z = np.unique(table.column("z").to_numpy()[by], return_inverse=True)[1]
            inv = 0
            # digit by digit from the highest, ones before zeros among rows that share the higher digits
            for bit in reversed(range(int(z.max()).bit_length())):
                z = z[np.argsort(z >> (bit + 1), kind="stable")]
                one = z >> bit & 1
                seen = np.cumsum(one)
                first = np.r_[True, z[1:] >> (bit + 1) != z[:-1] >> (bit + 1)]
                start = np.maximum.accumulate(np.where(first, np.arange(len(z)), 0))
                inv += int(((seen - (seen - one)[start])[one == 0]).sum())
            return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "__inv": pa.array([inv], pa.int64())})

        return fn

    near = rows.groupBy(*keys, "__xb").applyInArrow(counted_by("x", "z"), types + "__inv long")
    beside = rows.groupBy(*keys, "__zb").applyInArrow(counted_by("__xb", "z"), types + "__inv long")
    cells = rows.groupBy(*keys, "__xb", "__zb").agg(F.count(F.lit(1)).alias("__n"))
    sides = cells.groupBy(*keys).agg(F.max("__xb").alias("__mx"), F.max("__zb").alias("__mz"))
    grid = sides.select(*keys, "__mz", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__mx"))).alias("__xb"))
    grid = grid.select(*keys, "__xb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__mz"))).alias("__zb"))
    full = join_on(grid, cells, [*keys, "__xb", "__zb"], "left").fillna(0, ["__n"])
    earlier = Window.partitionBy(*keys, "__zb").orderBy("__xb").rowsBetween(Window.unboundedPreceding, -1)
    larger = Window.partitionBy(*keys, "__xb").orderBy(F.col("__zb").desc()).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("__e", F.sum("__n").over(earlier)).withColumn("__e", F.sum("__e").over(larger))
    apart = full.select(*keys, (F.col("__n") * F.coalesce("__e", F.lit(0))).alias("__inv"))
    return near.unionByName(beside).unionByName(apart).groupBy(*keys).agg(F.sum("__inv").alias("__inv"))


def rank_agreement(a: DataFrame, b: DataFrame, top: Sequence[int] = (10, 20, 50), keys: Sequence[str] = (), feature: str = "feature", rank: str = "rank", *, limit: int | None = None) -> DataFrame:
    """Spearman, Kendall tau and top-k Jaccard of two rankings without ties.

    Discordant pairs are counted in blocks of ``block`` ranks (``_inversions``), and each ranking is computed once.
    """
    keys = list(keys)
    left = cut_lineage(a.select(*keys, feature, F.col(rank).alias("ra")))
    right = cut_lineage(b.select(*keys, feature, F.col(rank).alias("rb")))
    both = cut_lineage(join_on(left, right, [*keys, feature]))
    xa = average_rank(both, keys, "ra", "x", limit=limit).drop("n")
    xb = average_rank(both, keys, "rb", "z", limit=limit).drop("n")
    rows = join_on(join_on(both, xa, [*keys, "ra"]), xb, [*keys, "rb"])
    rows = cut_lineage(rows.select(*keys, F.col("x").cast("bigint").alias("x"), F.col("z").cast("bigint").alias("z")))
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_common"), F.corr(F.col("x").cast("double"), F.col("z").cast("double")).alias("spearman"))
    inv = _inversions(rows, keys, RANKS_PER_TASK if limit is None else max(1, limit))
    out = join_on(agg, inv, keys, "left")
    pairs = F.col("n_common").cast("double") * (F.col("n_common") - 1)
    out = out.withColumn("kendall", F.when(pairs > 0, F.lit(1.0) - F.lit(4.0) * F.coalesce("__inv", F.lit(0)) / pairs)).drop("__inv")
    for k in top:
        ta = left.filter(F.col("ra") <= k).select(*keys, feature).withColumn("__a", F.lit(1))
        tb = right.filter(F.col("rb") <= k).select(*keys, feature).withColumn("__b", F.lit(1))
        u = ta.unionByName(tb, allowMissingColumns=True).groupBy(*keys, feature).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
        j = u.groupBy(*keys).agg(ratio(F.sum(F.when((F.col("__a") == 1) & (F.col("__b") == 1), 1).otherwise(0)), F.count(F.lit(1))).alias(f"jaccard_{k}"))
        out = join_on(out, j, keys, "left")
    return out


def permuted_labels(df: DataFrame, n_perms: int, keys: Sequence[str] = (), id_col: str = "id", y: str = "y", seed: int = 0) -> DataFrame:
    """(keys, perm, id, y_perm): labels re-paired by hash order within each permutation.

    The first n_pos rows of a random order carry label 1, which is a uniform
    permutation of a binary label.
    """
    keys = list(keys)
    npos = df.groupBy(*keys).agg(F.sum(F.col(y).cast("bigint")).alias("__np"))
    rows = df.select(*keys, id_col, id_digest(id_col).alias("__digest"))
    rows = spread(rows).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))).alias("perm"))
    limits = npos.select(*keys, F.col("__np").alias("__pos"), F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))).alias("perm"))
    out = hash_within(rows, [*keys, "perm"], id_col, F.col("perm") + F.lit(seed), limits, ["__pos"], digest="__digest")
    return out.select(*keys, "perm", id_col, F.col("__pos").cast("int").alias("y_perm"))


def permutation_null(long: DataFrame, n_perms: int, train: Column, keys: Sequence[str] = (), id_col: str = "id", seed: int = 0, *, limit: int | None = None) -> DataFrame:
    """Null AUROC of the univariate logistic model of each feature, all permutations in one grouped fit.

    Training labels are shuffled, the model is refitted and held-out rows are
    scored with their true labels.  ``train`` marks the training rows of the
    long table (id, y, feature, x).  A fit that has not settled is marked in ``converged`` and has no AUROC.
    """
    from ..core.newton import grouped_logistic
    from .discrimination import auroc

    keys = list(keys)
    rows = long.filter(F.col("x").isNotNull())
    tr, te = rows.filter(train), rows.filter(~train)
    perm = permuted_labels(tr.select(*keys, id_col, "y").distinct(), n_perms, keys, id_col, "y", seed)
    by = [*keys, "perm", "feature"]
    fitrows = join_on(tr.select(*keys, id_col, "feature", "x"), perm, [*keys, id_col]).groupBy(*by, "x").agg(
        F.sum("y_perm").alias("pos"), F.sum(1 - F.col("y_perm")).alias("neg")
    )
    fit = grouped_logistic(fitrows, by, [F.lit(1.0), F.col("x")], max_iter=50, max_step=5.0, with_steps=True).drop("n_iter")
    scored = join_on(te.select(*keys, id_col, "y", "feature", "x"), fit, [*keys, "feature"])
    scored = scored.withColumn("eta", F.round(F.col("b0") + F.col("b1") * F.col("x"), 12))
    out = join_on(auroc(scored, by, "y", "eta", limit=limit), fit.select(*by, "converged"), by)
    return out.select(*by, F.when(F.col("converged"), F.col("auroc")).alias("null_auroc"), "converged")
