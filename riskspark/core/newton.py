"""Grouped Newton for tiny logistic models: every group advances in the same job.

Each iteration is one distributed aggregate (gradient and Hessian sums per
group, combined map-side) and a checkpoint of the parameter table, whose rows
are the groups.  Used with 1 to 3 parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import join_on
from .session import cut_lineage, small_side

def _solve(h: list[list[Column]], g: list[Column]) -> tuple[list[Column], Column]:
    """Solve a symmetric system of order 1..3 by cofactors; returns (step, det)."""
    k = len(g)
    if k == 1:
        return [F.try_divide(g[0], h[0][0])], h[0][0]
    if k == 2:
        det = h[0][0] * h[1][1] - h[0][1] * h[0][1]
        return [
            F.try_divide(h[1][1] * g[0] - h[0][1] * g[1], det),
            F.try_divide(h[0][0] * g[1] - h[0][1] * g[0], det),
        ], det
    cof = [[None] * 3 for _ in range(3)]
    for i in range(3):
        for j in range(3):
            r = [x for x in range(3) if x != i]
            c = [x for x in range(3) if x != j]
            minor = h[r[0]][c[0]] * h[r[1]][c[1]] - h[r[0]][c[1]] * h[r[1]][c[0]]
            cof[i][j] = minor if (i + j) % 2 == 0 else -minor
    det = h[0][0] * cof[0][0] + h[0][1] * cof[0][1] + h[0][2] * cof[0][2]
    return [F.try_divide(sum((cof[i][j] * g[j] for j in range(1, 3)), cof[i][0] * g[0]), det) for i in range(3)], det


def grouped_logistic(
    rows: DataFrame,
    keys: Sequence[str],
    design: Sequence[Column],
    *,
    pos: str = "pos",
    neg: str = "neg",
    offset: Column | None = None,
    start: Sequence[float] | None = None,
    max_iter: int = 25,
    tol: float = 1e-8,
    eta_cap: float = 30.0,
    max_step: float | None = None,
    with_se: bool = False,
    with_steps: bool = False,
) -> DataFrame:
    """Unpenalised logistic fit per key; columns b0..bk-1 (and se of each when asked).

    ``rows`` holds positive and negative counts per design point.  Groups whose
    information matrix is singular keep their last parameters.  ``max_step``
    shortens long steps; without it the plain Newton sequence is followed.
    ``with_steps`` adds n_iter and ``converged``: false for groups still moving after ``max_iter`` steps.
    """
    keys = list(keys)
    k = len(design)
    start = list(start) if start is not None else [0.0] * k
    names = [f"b{i}" for i in range(k)]
    data = rows.select(
        *keys, *[d.cast("double").alias(f"__x{i}") for i, d in enumerate(design)],
        (offset if offset is not None else F.lit(0.0)).cast("double").alias("__off"),
        F.col(pos).cast("double").alias("__pos"), F.col(neg).cast("double").alias("__neg"),
    )
    # every iteration rereads the design points, never the tables behind them
    data = cut_lineage(data)
    params = data.groupBy(*keys).agg(*[F.lit(float(s)).alias(n) for s, n in zip(start, names)])
    params = params.withColumn("n_iter", F.lit(0)).withColumn("__done", F.lit(False))
    params = cut_lineage(params)
    n_groups = params.count()
    hess = [(i, j) for i in range(k) for j in range(i, k)]
    for it in range(1, max_iter + 1):
        both = join_on(data, small_side(params, n_groups), keys)
        eta = F.col("__off")
        for i, n in enumerate(names):
            eta = eta + F.col(n) * F.col(f"__x{i}")
        eta = F.greatest(F.lit(-eta_cap), F.least(F.lit(eta_cap), eta))
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        both = both.withColumn("__mu", mu)
        n = F.col("__pos") + F.col("__neg")
        resid = F.col("__pos") - n * F.col("__mu")
        w = n * F.col("__mu") * (F.lit(1.0) - F.col("__mu"))
        sums = [F.sum(resid * F.col(f"__x{i}")).alias(f"__g{i}") for i in range(k)]
        sums += [F.sum(w * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"__h{i}{j}") for i, j in hess]
        agg = both.groupBy(*keys).agg(*sums, *[F.max(c).alias(c) for c in (*names, "n_iter", "__done")])
        h = [[F.col(f"__h{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
        step, det = _solve(h, [F.col(f"__g{i}") for i in range(k)])
        ok = ~F.col("__done") & (F.abs(det) > F.lit(1e-300))
        for s in step:
            ok = ok & s.isNotNull() & ~F.isnan(s)
        if max_step is not None:
            biggest = F.greatest(*[F.abs(s) for s in step], F.lit(1e-300))
            step = [s * F.least(F.lit(1.0), F.lit(max_step) / biggest) for s in step]
        moved = {n: F.when(ok, F.col(n) + step[i]).otherwise(F.col(n)) for i, n in enumerate(names)}
        size = F.greatest(*[F.coalesce(F.abs(s), F.lit(0.0)) for s in step], F.lit(0.0))
        nxt = agg.select(
            *keys, *[c.alias(n) for n, c in moved.items()],
            F.when(ok, F.lit(it)).otherwise(F.col("n_iter")).alias("n_iter"),
            (~ok | (size < F.lit(tol))).alias("__done"),
        )
        params = cut_lineage(nxt)
        if params.filter("NOT __done").isEmpty():
            break
    out = params.withColumnRenamed("__done", "converged") if with_steps else params.drop("__done", "n_iter")
    if with_se:
        both = join_on(data, small_side(out, n_groups), keys)
        eta = F.col("__off")
        for i, n in enumerate(names):
            eta = eta + F.col(n) * F.col(f"__x{i}")
        eta = F.greatest(F.lit(-eta_cap), F.least(F.lit(eta_cap), eta))
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        w = (F.col("__pos") + F.col("__neg")) * mu * (F.lit(1.0) - mu)
        agg = both.groupBy(*keys).agg(*[F.sum(w * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"__h{i}{j}") for i, j in hess])
        h = [[F.col(f"__h{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
        ses = []
        for i in range(k):
            unit = [F.lit(1.0 if j == i else 0.0) for j in range(k)]
            sol, det = _solve(h, unit)
            ses.append(F.when(F.abs(det) > 1e-300, F.sqrt(F.greatest(sol[i], F.lit(0.0)))).alias(f"se{i}"))
        out = join_on(out, agg.select(*keys, *ses), keys)
    return out
