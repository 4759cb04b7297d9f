"""When and on what a calibrator is fitted: strategies behind one registry, and the rule that nothing is calibrated twice.

A scored table says by which strategy a score was calibrated (``calibrated_by``, NULL for raw
scores).  Rows that say so already, and learners that calibrate themselves, pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..core.irls import fit_logistic_batch, score_batch
from ..core.session import cut_lineage
from .batched import _with, member, spec_of, vectors
from .calibration import METHODS, apply_calibrator, fit_calibrator
from .splits import cv_folds

#: Learners whose scores are calibrated inside their own fit.
SELF_CALIBRATED = {"LinSVM_cal"}
#: Methods of per-fold calibration and the calibrators behind them.
FOLD_METHODS = {"isotonic": "isotonic", "sigmoid": "logistic_full"}


@dataclass(frozen=True)
class NoCalibration:
    """Scores stay as they are."""

    name = "none"
    method = None
    folds = 0
    wants_oof = wants_folds = False

    def skips(self, model: str) -> bool:
        return True

    def label(self) -> str:
        return "none"


@dataclass(frozen=True)
class PerFold:
    """One calibrator for each inner fold, on rows its base model has not seen; their calibrated scores are averaged."""

    method: str = "isotonic"
    folds: int = 5
    name = "per_fold"
    wants_oof, wants_folds = False, True

    def __post_init__(self):
        if self.method not in FOLD_METHODS:
            raise ValueError(f"method must be one of {sorted(FOLD_METHODS)}, got {self.method!r}")
        if self.folds < 2:
            raise ValueError(f"folds must be 2 or more, got {self.folds}")

    def skips(self, model: str) -> bool:
        return model in SELF_CALIBRATED

    def label(self) -> str:
        return f"{self.method} ({self.name})"

    def fit(self, oof: DataFrame, keys: Sequence[str], fold: str, y: str, p: str, min_rows: int) -> DataFrame:
        return fit_calibrator(oof, FOLD_METHODS[self.method], [*keys, fold], y, p, min_rows)

    def apply(self, scored: DataFrame, calibrators: DataFrame, keys: Sequence[str], fold: str, p: str) -> DataFrame:
        return apply_calibrator(scored, calibrators, [*keys, fold], p)


@dataclass(frozen=True)
class OofPosthoc:
    """One calibrator per model on its pooled out-of-fold scores."""

    method: str = "logistic_intercept"
    name = "oof_posthoc"
    folds = 0
    wants_oof, wants_folds = True, False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {sorted(METHODS)}, got {self.method!r}")

    def skips(self, model: str) -> bool:
        return model in SELF_CALIBRATED

    def label(self) -> str:
        return f"{self.method} ({self.name})"

    def fit(self, oof: DataFrame, keys: Sequence[str], fold: str, y: str, p: str, min_rows: int) -> DataFrame:
        return fit_calibrator(oof, self.method, keys, y, p, min_rows)

    def apply(self, scored: DataFrame, calibrators: DataFrame, keys: Sequence[str], fold: str, p: str) -> DataFrame:
        return apply_calibrator(scored, calibrators, keys, p)


#: Name -> factory(method, folds).
STRATEGIES: dict[str, Callable] = {
    "none": lambda method=None, folds=0: NoCalibration(),
    "per_fold": lambda method="isotonic", folds=5: PerFold("isotonic" if method == "isotonic" else "sigmoid", folds),
    "oof_posthoc": lambda method="logistic_intercept", folds=0: OofPosthoc(method),
}


def register_strategy(name: str, factory: Callable) -> None:
    """Add a strategy: factory(method, folds) -> object with name, method, folds, wants_oof, wants_folds, skips, label, fit, apply."""
    STRATEGIES[name] = factory


def strategy_for(model: str | None, name: str, method: str | None = None, folds: int = 5, overrides: dict[str, str] | None = None):
    """The strategy of a model: its own by ``overrides``, else the common one; unknown names are an error."""
    name = (overrides or {}).get(model, name)
    if name not in STRATEGIES:
        raise ValueError(f"unknown calibration strategy {name!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[name](method or ("isotonic" if name == "per_fold" else "logistic_intercept"), folds)


def calibrate(oof: DataFrame, scored: DataFrame, name: str, method: str | None = None, overrides: dict[str, str] | None = None, keys: Sequence[str] = ("model",), fold: str = "fold", id_col: str = "id", y: str = "y_true", p: str = "y_prob", min_rows: int = 50) -> DataFrame:
    """``scored`` with ``y_prob_calibrated`` and ``calibrated_by``, each model by its strategy.

    ``oof``: out-of-fold scores (keys, fold, y, p) that calibrators are fitted on.  Per-fold strategies
    expect a row of ``scored`` for each inner model (``fold``) and return their mean for each subject.
    Scores marked in ``calibrated_by`` are neither fitted on nor changed.
    """
    keys = list(keys)
    if "calibrated_by" not in scored.columns:
        scored = scored.withColumn("calibrated_by", F.lit(None).cast("string"))
    raw = oof.filter("calibrated_by IS NULL") if "calibrated_by" in oof.columns else oof
    models = [r.model for r in scored.select("model").distinct().orderBy("model").collect()]  # a short list of learners
    chosen = {m: strategy_for(m, name, method, overrides=overrides) for m in models}
    out = None
    for s in dict.fromkeys(chosen.values()):
        mine = F.col("model").isin([m for m in models if chosen[m] == s and not s.skips(m)])
        rest = F.col("model").isin([m for m in models if chosen[m] == s and s.skips(m)])
        parts = [scored.filter(rest | (F.col("model").isin([m for m in models if chosen[m] == s]) & F.col("calibrated_by").isNotNull())).withColumn("y_prob_calibrated", F.col(p))]
        if any(not s.skips(m) for m in models if chosen[m] == s):
            todo = scored.filter(mine & F.col("calibrated_by").isNull())
            done = s.apply(todo, cut_lineage(s.fit(raw.filter(mine), keys, fold, y, p, min_rows)), keys, fold, p)
            if s.wants_folds:
                done = done.groupBy(*keys, id_col, y).agg(F.avg(p).alias(p), F.avg("y_prob_calibrated").alias("y_prob_calibrated"))
            parts.append(done.withColumn("calibrated_by", F.lit(s.label())))
        for x in parts:
            x = x.select(*keys, id_col, y, p, "y_prob_calibrated", "calibrated_by")
            out = x if out is None else out.unionByName(x)
    return out


def effective_folds(df: DataFrame, folds: int, y: str = "y") -> int:
    """At most as many folds as the rarer class has rows, two at least."""
    n = df.agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("b")).first()
    return min(folds, max(2, min(n.a or 0, n.b or 0)))


def calibrated_ensemble(train: DataFrame, test: DataFrame, name: str, features: Sequence[str], strategy: PerFold, seed: int = 0, y: str = "y", id_col: str = "id", min_rows: int = 50, **params) -> DataFrame:
    """Test scores (id, y, y_prob, y_prob_calibrated, calibrated_by) of a linear learner with per-fold calibration.

    The base models of all inner folds are one batch; each has a calibrator fitted on the fold it left
    out, and a test row's score is the mean of their calibrated scores.
    """
    p = len(features)
    rows = vectors(train, features, id_col, y)
    k = effective_folds(rows, strategy.folds)
    parts = cv_folds(rows, k, 1, seed, "y").select("id", F.col("fold").cast("int").alias("fold"))
    rows = cut_lineage(_with(rows, parts))
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    here = rows.select("id", "y", "v", F.transform(others, lambda f: member(f)).alias("members"), F.array("fold").alias("targets"))
    fits = fit_logistic_batch(here, {f: spec_of(name, range(p), **params) for f in range(k)}, p)
    oof = score_batch(here, fits, p, ["id", "y"]).withColumnsRenamed({"model": "fold", "y": "y_true"}).withColumn("model", F.lit(name))
    held = vectors(test, features, id_col, y).withColumn("targets", F.sequence(F.lit(0), F.lit(k - 1)))
    scored = score_batch(held, fits, p, ["id", "y"]).withColumnsRenamed({"model": "fold", "y": "y_true"}).withColumn("model", F.lit(name))
    cal = cut_lineage(strategy.fit(oof, ["model"], "fold", "y_true", "y_prob", min_rows))
    done = strategy.apply(scored, cal, ["model"], "fold", "y_prob").groupBy("id", "y_true").agg(F.avg("y_prob").alias("y_prob"), F.avg("y_prob_calibrated").alias("y_prob_calibrated"))
    return done.select(F.col("id").alias(id_col), F.col("y_true").alias(y), "y_prob", "y_prob_calibrated", F.lit(strategy.label()).alias("calibrated_by"))
