"""Many penalised logistic models in one job.

A row carries its features once and names the models it trains, with a weight each.  A step
of all open models is one pass: a task forms, for each model, the gradient and the packed
Gram matrix of the rows it holds, Spark sums them by model, and each sum is solved where
it lands.  Rows are never repeated by models, and what reaches the driver are coefficients.

The objective is that of Spark ML: mean weighted log loss + reg * (alpha |b| + (1 - alpha) b'b / 2) on
standardised features, the intercept free.  Ridge models take Newton steps, others
coordinate descent on the same quadratic; a step that raises the objective is halved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .quantile import quantiles
from .session import cut_lineage

#: Gram matrices held by one task, in bytes; more models are fitted in several waves.
WAVE_BYTES = 64 << 20


@dataclass
class Spec:
    """A model to fit: which features (positions), and the penalty."""

    features: tuple[int, ...]
    reg: float = 0.01
    alpha: float = 0.0


@dataclass
class Fit:
    """Coefficients on features standardised as (x - mean) / sd after filling; ``converged`` is False after ``max_iter`` steps."""

    features: tuple[int, ...]
    fill: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    coef: np.ndarray
    intercept: float = 0.0
    n_iter: int = 0
    converged: bool = False
    # Weighted spread of the standardised features (the penalty's scale), sum of weights, rows.
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: float = 0.0
    n: int = 0

    def design(self, x: np.ndarray) -> np.ndarray:
        """Intercept and standardised features of rows of all features; a constant feature is 0."""
        part = x[:, self.features]
        part = np.where(np.isnan(part), self.fill, part)
        z = np.divide(part - self.mean, self.sd, out=np.zeros_like(part), where=self.sd > 0)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ np.concatenate([[self.intercept], self.coef])


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64())
    return np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), p)


def _members(column: pa.ListArray, names: Sequence[str]) -> tuple[np.ndarray, ...]:
    """(row, then the named fields) of all entries of a list of structs, in order of the first field."""
    counts = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
    rows = np.repeat(np.arange(len(column)), counts)
    order = np.argsort(fields[0], kind="stable")
    return (rows[order], *(f[order] for f in fields))


def _runs(model: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(model, from, to) of the runs of a sorted array."""
    ids, starts = np.unique(model, return_index=True)
    yield from zip(ids.tolist(), starts.tolist(), np.append(starts, len(model))[1:].tolist(), strict=True)


def _by_model(column: pa.ListArray, wanted: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(model, rows, weights) of the wanted models with rows in the batch."""
    rows, model, weight = _members(column, ("model", "weight"))
    for m, lo, hi in _runs(model):
        if m in wanted:
            yield m, rows[lo:hi], weight[lo:hi]


def _summed(parts: DataFrame) -> DataFrame:
    total = parts.groupBy("model").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
    return total.select("model", vector_to_array("s").alias("s"))


def _emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["model", "s"])


def _moments(p: int, wanted: set[int], center: np.ndarray, fills: dict[int, np.ndarray]):
    """Counts and first two moments by model, plain and weighted, around ``center``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("v"), p)
            for m, rows, w in _by_model(batch.column("members"), wanted):
                part = x[rows]
                part = np.where(np.isnan(part), fills[m] if m in fills else 0.0, part) - center
                square = part * part
                got = np.concatenate([[len(rows), w.sum(), (w * w).sum()], part.sum(0), square.sum(0), w @ part, w @ square])
                sums[m] = sums[m] + got if m in sums else got
        yield from _emit(sums)

    return run


def _gram(p: int, fits: dict[int, Fit]):
    """Loss, gradient and packed Gram matrix by model at the present coefficients."""
    wanted = set(fits)
    corner = {q: np.triu_indices(q) for q in {len(f.features) + 1 for f in fits.values()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = _matrix(batch.column("v"), p), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            for m, rows, w in _by_model(batch.column("members"), wanted):
                f = fits[m]
                a, target = f.design(x[rows]), y[rows]
                eta = a @ np.concatenate([[f.intercept], f.coef])
                mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                loss = w @ (np.logaddexp(0.0, eta) - target * eta)
                g = a.T @ (w * (target - mu))
                h = a.T @ (a * (w * mu * (1.0 - mu))[:, None])
                got = np.concatenate([[loss], g, h[corner[len(g)]]])
                sums[m] = sums[m] + got if m in sums else got
        yield from _emit(sums)

    return run


def _penalty(f: Fit, spec: Spec, coef: np.ndarray) -> float:
    b = coef * f.spread
    return spec.reg * (spec.alpha * np.abs(b).sum() + (1.0 - spec.alpha) / 2.0 * (b @ b))


def _solve(f: Fit, spec: Spec, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The next intercept and coefficients: minimum of the quadratic around the present ones."""
    b = np.concatenate([[f.intercept], f.coef])
    ridge = np.concatenate([[0.0], spec.reg * (1.0 - spec.alpha) * f.spread**2])
    free = np.concatenate([[True], f.sd > 0])
    lasso = np.concatenate([[0.0], spec.reg * spec.alpha * f.spread])
    g, h = g / f.weight, h / f.weight
    new = np.where(free, b, 0.0)
    if spec.reg * spec.alpha == 0:
        at = np.flatnonzero(free)
        a = h[np.ix_(at, at)] + np.diag(ridge[at])
        step, *_ = np.linalg.lstsq(a, (g - ridge * b)[at], rcond=None)
        new[at] = b[at] + step
        return new[0], new[1:]
    # Coordinate descent; ``slope`` is kept at the quadratic's gradient without penalties.
    slope = g.copy()
    for _ in range(1000):
        moved = 0.0
        for j in np.flatnonzero(free):
            if h[j, j] + ridge[j] <= 0:
                continue
            pull = slope[j] + h[j, j] * new[j]
            at = math.copysign(max(abs(pull) - lasso[j], 0.0), pull) / (h[j, j] + ridge[j])
            d = at - new[j]
            if d:
                slope -= h[:, j] * d
                new[j], moved = at, max(moved, abs(d))
        if moved < 1e-13:
            break
    return new[0], new[1:]


def _advance(fits: dict[int, Fit], specs: dict[int, Spec], state: dict[int, tuple[float, np.ndarray]], tol: float):
    """Summed rows to (model, accepted, objective, next coefficients): a step back to the last accepted point if the objective rose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"model": [], "accepted": [], "objective": [], "b": [], "moved": []}
            for m, s in zip(batch.column("model").to_pylist(), batch.column("s").to_pylist(), strict=True):
                f, spec, s = fits[m], specs[m], np.asarray(s)
                q = len(f.features) + 1
                g, h = s[1 : q + 1], np.zeros((q, q))
                h[np.triu_indices(q)] = s[q + 1 :]
                h = h + np.triu(h, 1).T
                objective = s[0] / f.weight + _penalty(f, spec, f.coef)
                now = np.concatenate([[f.intercept], f.coef])
                last, kept = state[m]
                accepted = bool(objective <= last + 1e-14 * abs(last)) if math.isfinite(last) else True
                if accepted:
                    intercept, coef = _solve(f, spec, g, h)
                    b = np.concatenate([[intercept], coef])
                else:
                    b = (now + kept) / 2.0
                moved = float(np.abs(b - now).max()) if accepted else float(np.abs(b - kept).max())
                for c, v in zip(out, (m, accepted, float(objective), b.tolist(), moved), strict=True):
                    out[c].append(v)
            types = [pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return run


def _medians(rows: DataFrame, p: int, *, limit: int | None = None) -> dict[int, np.ndarray]:
    """Exact median of each feature with missing values, for each model over the rows it trains on."""
    gaps = rows.agg(*[F.max((F.col("v")[j].isNull() | F.isnan(F.col("v")[j])).cast("int")).alias(str(j)) for j in range(p)]).first()
    holed = [j for j in range(p) if gaps[j]]
    if not holed:
        return {}
    values = F.array(*[F.struct(F.lit(j).alias("feature"), F.col("v")[j].alias("x")) for j in holed])
    each = rows.select(F.inline(values), F.col("members.model").alias("models")).filter("x IS NOT NULL AND NOT isnan(x)")
    counts = each.select("feature", "x", F.explode("models").alias("model")).groupBy("model", "feature", "x").agg(F.count(F.lit(1)).alias("n"))
    out: dict[int, np.ndarray] = {}
    for r in quantiles(counts, ["model", "feature"], "x", {"med": 0.5}, measure=counts, limit=limit).collect():  # one row per model and feature
        out.setdefault(r.model, np.zeros(p))[r.feature] = r.med
    return out


def members_of(*models: Column) -> Column:
    """Array of (model, weight) from struct columns, NULL ones left out."""
    return F.filter(F.array(*models), lambda s: s.isNotNull())


def fit_logistic_batch(rows: DataFrame, specs: dict[int, Spec], p: int, *, max_iter: int = 100, tol: float = 1e-9, limit: int | None = None) -> dict[int, Fit]:
    """Fit all ``specs``; ``rows``: v (array of p doubles, may hold NULL or NaN), y (0 or 1), members (array of model int, weight double > 0).

    Missing values take the model's own median, features are scaled by the model's own rows (sample sd),
    as a pipeline fitted on those rows would.  A model without rows keeps zero coefficients, not converged.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows.select("v", F.col("y").cast("double").alias("y"), "members").filter(F.size("members") > 0))
    fills = _medians(rows, p, limit=limit)
    center = rows.agg(*[F.avg(F.when(~F.isnan(F.col("v")[j]), F.col("v")[j])).alias(str(j)) for j in range(p)]).first()
    center = np.array([c or 0.0 for c in center])
    fits: dict[int, Fit] = {}
    for wave in _waves(specs):
        fits |= _fit_wave(spark, rows, {m: specs[m] for m in wave}, p, center, fills, max_iter, tol)
    return fits


def _waves(specs: dict[int, Spec]) -> Iterator[list[int]]:
    wave, held = [], 0
    for m in sorted(specs):
        size = 8 * (len(specs[m].features) + 2) ** 2
        if wave and held + size > WAVE_BYTES:
            yield wave
            wave, held = [], 0
        wave.append(m)
        held += size
    if wave:
        yield wave


def _fit_wave(spark: SparkSession, rows: DataFrame, specs: dict[int, Spec], p: int, center: np.ndarray, fills: dict[int, np.ndarray], max_iter: int, tol: float) -> dict[int, Fit]:
    fits = {}
    for r in _summed(rows.mapInArrow(_moments(p, set(specs), center, fills), "model int, s array<double>")).collect():  # one row per model
        s = np.asarray(r.s)
        n, sw, sw2 = s[:3]
        plain, square, wplain, wsquare = s[3:].reshape(4, p)
        at = list(specs[r.model].features)
        sd = np.sqrt(np.maximum(square - plain * plain / n, 0.0) / max(n - 1.0, 1.0))
        sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(center)), sd, 0.0)
        left = sw - sw2 / sw
        wsd = np.sqrt(np.maximum(wsquare - wplain * wplain / sw, 0.0) / (left if left > 0 else 1.0))
        fill = fills[r.model] if r.model in fills else np.zeros(p)
        spread = np.divide(wsd, sd, out=np.zeros(p), where=sd > 0)
        fits[r.model] = Fit(tuple(at), fill[at], (center + plain / n)[at], sd[at], np.zeros(len(at)), spread=spread[at], weight=float(sw), n=int(n))
    state = {m: (math.inf, np.zeros(len(f.features) + 1)) for m, f in fits.items()}
    open_ = set(fits)
    for it in range(1, max_iter + 1):
        now = {m: fits[m] for m in open_}
        total = _summed(rows.mapInArrow(_gram(p, now), "model int, s array<double>"))
        steps = total.mapInArrow(_advance(now, {m: specs[m] for m in now}, {m: state[m] for m in now}, tol), "model int, accepted boolean, objective double, b array<double>, moved double")
        for r in steps.collect():  # coefficients of the open models
            f = fits[r.model]
            if r.accepted:
                state[r.model] = (r.objective, np.concatenate([[f.intercept], f.coef]))
            f.intercept, f.coef, f.n_iter = float(r.b[0]), np.asarray(r.b[1:]), it
            if r.moved < tol:
                f.converged = True
                open_.discard(r.model)
        if not open_:
            break
    for m, spec in specs.items():
        if m not in fits:
            q = len(spec.features)
            fits[m] = Fit(spec.features, np.zeros(q), np.zeros(q), np.zeros(q), np.zeros(q))
    return fits


def score_batch(rows: DataFrame, fits: dict[int, Fit], p: int, keep: Sequence[str], out: str = "y_prob") -> DataFrame:
    """(keep..., model, out): each row scored by the models in its ``targets`` (array of int)."""
    keep = list(keep)
    source = rows.select(*keep, F.col("v").alias("__v"), F.transform("targets", lambda m: F.struct(m.cast("int").alias("model"))).alias("__t"))
    wanted = set(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("__v"), p)
            at, model = _members(batch.column("__t"), ("model",))
            for m, lo, hi in _runs(model):
                if m in wanted:
                    some = at[lo:hi]
                    prob = 1.0 / (1.0 + np.exp(-np.clip(fits[m].margin(x[some]), -700, 700)))
                    cols = [c.take(pa.array(some)) for c in batch.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(some), m, np.int32)), pa.array(prob)], [*keep, "model", out])

    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "model int", f"`{out}` double"])
    return source.mapInArrow(run, schema)


def fits_table(spark: SparkSession, fits: dict[int, Fit], names: Sequence[str]) -> DataFrame:
    """(model, feature, coef, n, n_iter, converged), the intercept as feature ''; coefficients are for standardised features."""
    rows = []
    for m, f in sorted(fits.items()):
        tail = (f.n, f.n_iter, f.converged)
        rows.append((m, "", float(f.intercept), *tail))
        rows += [(m, names[j], float(c), *tail) for j, c in zip(f.features, f.coef, strict=True)]
    return spark.createDataFrame(rows, "model int, feature string, coef double, n long, n_iter int, converged boolean")
