"""Model fitting and scoring: pipelines, folds, stacking.

Resampled fits of linear learners are batched (``batched``): all folds, settings and cells
advance in one job a step.  Other learners are Spark ML jobs, in loops over a bounded number
of configurations; everything measured on the scores is one keyed job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..core.keys import join_on
from ..core.quantile import quantiles
from ..core.session import cut_lineage
from ..functions.scalar import adjust_prevalence, logit
from .batched import LINEAR, factorial_batch, learning_curve_batch, nested_cv_batch, search_space
from .calibration import apply_calibrator, fit_calibrator
from .discrimination import auroc, discrimination
from .splits import class_weights, cv_folds


# ---------------------------------------------------------------- stacking input
def stack_matrix(scores: DataFrame, models: Sequence[str], keys: Sequence[str] = (), id_col: str = "id", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """One row per subject with a score column per base model."""
    return scores.groupBy(*keys, id_col, y).pivot("model", list(models)).agg(F.avg(p))


def stack_violations(scores: DataFrame, n_models: int, keys: Sequence[str] = (), id_col: str = "id", y: str = "y_true") -> DataFrame:
    """Subjects some base model lacks, or whose labels disagree between models."""
    per = scores.groupBy(*keys, id_col).agg(F.count_distinct("model").alias("n_models"), F.count_distinct(y).alias("n_labels"))
    return per.filter((F.col("n_models") != n_models) | (F.col("n_labels") != 1))


# ---------------------------------------------------------------- learners
# Name -> factory of an unfitted Spark ML classifier.
LEARNERS: dict[str, Callable[..., Estimator]] = {
    "LR_EN": lambda **k: LogisticRegression(**{"regParam": 0.01, "elasticNetParam": 0.5, "maxIter": 50, **k}),
    "LR_L1": lambda **k: LogisticRegression(**{"regParam": 0.01, "elasticNetParam": 1.0, "maxIter": 50, **k}),
    "LR_L2": lambda **k: LogisticRegression(**{"regParam": 0.01, "elasticNetParam": 0.0, "maxIter": 50, **k}),
    "LinSVM_cal": lambda **k: LinearSVC(**{"regParam": 0.01, "maxIter": 50, **k}),
    "RF": lambda **k: RandomForestClassifier(**{"numTrees": 50, "maxDepth": 6, "seed": 42, **k}),
    "GBT": lambda **k: GBTClassifier(**{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **k}),
}


def learner(name: str, y: str = "y", weight: str | None = None, **params) -> Estimator:
    est = LEARNERS[name](**params).setFeaturesCol("features").setLabelCol(y)
    return est.setWeightCol(weight) if weight else est


class _MedianParams(Params):
    columns = Param(Params._dummy(), "columns", "columns to fill", TypeConverters.toListString)
    fill = Param(Params._dummy(), "fill", "value of each column", TypeConverters.toListFloat)


class MedianImputer(Estimator, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    """Columns ``<name>__i`` with missing values (NULL, NaN) replaced by the exact, interpolated median; 0 for a column without values."""

    def __init__(self, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def _fit(self, dataset: DataFrame) -> MedianModel:
        names = self.getOrDefault("columns")
        pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(names)]))
        counts = dataset.select(pairs).filter("x IS NOT NULL AND NOT isnan(x)").groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
        found = {r.c: r.med for r in quantiles(cut_lineage(counts), ["c"], "x", {"med": 0.5}).collect()}  # one row per column
        return MedianModel(names, [float(found.get(i, 0.0)) for i in range(len(names))])


class MedianModel(Model, _MedianParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, columns: Sequence[str] = (), fill: Sequence[float] = ()):
        super().__init__()
        self._set(columns=list(columns), fill=list(fill))

    @property
    def values(self) -> dict[str, float]:
        return dict(zip(self.getOrDefault("columns"), self.getOrDefault("fill"), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = lambda c: F.col(c).cast("double")
        return dataset.withColumns({f"{c}__i": F.when(value(c).isNull() | F.isnan(value(c)), F.lit(v)).otherwise(value(c)) for c, v in self.values.items()})


class DropFirstEncoder(Estimator):
    """One-hot columns ``<name>__h`` over the sorted levels seen in the fit, without the first.

    The first level, NULL and levels not seen in the fit are all zeros.  Levels are as
    few as the categories of a column.
    """

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> DropFirstModel:
        found = dataset.select(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in self.columns]).first()
        return DropFirstModel({c: list(found[c])[1:] for c in self.columns})


class DropFirstModel(Model):
    def __init__(self, levels: dict[str, list[str]]):
        super().__init__()
        self.levels = levels

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def hot(c: str, levels: list[str]) -> Column:
            marks = [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for v in levels]
            return array_to_vector(F.array(*marks).cast("array<double>"))

        return dataset.withColumns({f"{c}__h": hot(c, v) for c, v in self.levels.items()})


def preprocess(numeric: Sequence[str], categorical: Sequence[str] = (), impute: bool = True, scale: bool = True) -> list:
    """Exact median imputation, z-scores, one-hot with the first level dropped and unknown levels ignored."""
    stages: list = []
    num = list(numeric)
    if impute:
        stages.append(MedianImputer(num))
        num = [f"{c}__i" for c in num]
    stages.append(VectorAssembler(inputCols=num, outputCol="__num", handleInvalid="keep"))
    out = "__num"
    if scale:
        stages.append(StandardScaler(inputCol="__num", outputCol="__z", withMean=True, withStd=True))
        out = "__z"
    parts = [out]
    if categorical:
        stages.append(DropFirstEncoder(categorical))
        parts += [f"{c}__h" for c in categorical]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def build_pipeline(name: str, features: Sequence[str], numeric: Sequence[str] = (), categorical: Sequence[str] = (), y: str = "y", weight: str | None = None, selector: dict | None = None, **params) -> Pipeline:
    """Preprocessing and classifier; run ``screen`` and ``kbest`` first and pass the features they keep.

    ``selector``: settings of a ``ModelSelector`` between them, by the same learner unless it names another.
    """
    stages, last = preprocess([*features, *numeric], categorical), learner(name, y, weight, **params)
    if selector is not None:
        from .stages import ModelSelector

        stages.append(ModelSelector(**{"modelName": name, "labelCol": y, **selector}))
        last = last.setFeaturesCol("selected")
    return Pipeline(stages=[*stages, last])


def select_features(train: DataFrame, features: Sequence[str], method: str = "mannwhitney", top: int | None = None, k: int | None = None, y: str = "y", id_col: str = "id") -> list[str]:
    """Screen, then keep the k best by F.  The lists are as short as the column list of the table."""
    from .screen import kbest, screen

    long = train.select(id_col, y, *features).unpivot([id_col, y], list(features), "feature", "x")
    kept = [r.feature for r in screen(long, method, top or 0).select("feature", "rank").orderBy("rank").collect()]
    if k is None or k >= len(kept):
        return kept
    return [r.feature for r in kbest(long.filter(F.col("feature").isin(kept)), k).orderBy("rank").collect()]


def probability(df: DataFrame, name: str = "y_prob") -> DataFrame:
    """Positive-class probability, or the margin of a learner without one."""
    if "probability" in df.columns:
        return df.withColumn(name, vector_to_array("probability")[1])
    return df.withColumn(name, vector_to_array("rawPrediction")[1])


def score(df: DataFrame, model: Transformer, keep: Sequence[str] = ("id", "y"), sample_prevalence: float | None = None, target_prevalence: float | None = None) -> DataFrame:
    """Raw score and, given both prevalences, the adjusted one."""
    out = probability(model.transform(df)).select(*keep, "y_prob")
    if sample_prevalence is None or target_prevalence is None:
        return out
    return out.withColumn("y_prob_adjusted", adjust_prevalence("y_prob", F.lit(float(sample_prevalence)), F.lit(float(target_prevalence))))


class PrevalenceAdjuster(Transformer):
    """Pipeline stage that shifts a score column to a target prevalence."""

    def __init__(self, sample: float, target: float, input_col: str = "y_prob", output_col: str = "y_prob_adjusted"):
        super().__init__()
        self.sample, self.target, self.input_col, self.output_col = sample, target, input_col, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.output_col, adjust_prevalence(self.input_col, F.lit(float(self.sample)), F.lit(float(self.target))))


def fit_svm_calibrated(train: DataFrame, features: Sequence[str], k: int = 3, seed: int = 0, y: str = "y", id_col: str = "id", **params) -> tuple[PipelineModel, DataFrame]:
    """Linear SVM and the logistic calibration of its out-of-fold margins (squashed to (0, 1) first)."""
    folds = cv_folds(train, k, 1, seed, y, id_col=id_col).select(F.col("id").alias("__id"), "fold")
    rows = cut_lineage(train.join(folds, F.col(id_col) == F.col("__id")).drop("__id"))
    pipe = build_pipeline("LinSVM_cal", features, y=y, **params)
    parts = []
    for f in range(k):
        m = pipe.fit(rows.filter(F.col("fold") != f))
        parts.append(squash(score(rows.filter(F.col("fold") == f), m, (id_col, y))))
    oof = reduce(DataFrame.unionByName, parts)
    return pipe.fit(rows), fit_calibrator(oof, "logistic_full", y=y)


def squash(df: DataFrame, p: str = "y_prob") -> DataFrame:
    return df.withColumn(p, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(p))))


def score_svm(df: DataFrame, fitted: tuple[PipelineModel, DataFrame], keep: Sequence[str] = ("id", "y")) -> DataFrame:
    raw = squash(score(df, fitted[0], keep))
    return apply_calibrator(raw, fitted[1]).drop("y_prob").withColumnRenamed("y_prob_calibrated", "y_prob")


# ---------------------------------------------------------------- nested folds
def nested_cv_oof(df: DataFrame, name: str, features: Sequence[str], grid: Sequence[dict] | int, k: int = 5, inner: int = 3, repeats: int = 1, seed: int = 0, y: str = "y", id_col: str = "id", numeric: Sequence[str] = (), categorical: Sequence[str] = (), select: int | None = None, weight_scheme: str = "none", halving: bool = False) -> dict[str, DataFrame]:
    """Repeated stratified folds with an inner search per outer fold.

    Returns tables: ``oof`` (repeat, fold, id, y, y_prob), ``params`` (repeat, fold, param, value,
    inner_auroc), ``selected`` (repeat, fold, feature) and the pooled ``calibrator``; linear
    learners also ``trials`` and ``importance`` per fold.  ``grid``: settings, or how many to draw from the learner's
    search space.  Linear learners without categories are fitted in one batch, with ``halving`` inner fold by inner fold;
    for others all inner scores of an outer fold are measured in one job.
    """
    spark = df.sparkSession
    if isinstance(grid, int):
        grid = search_space(name, grid, seed)
    if name in LINEAR and not categorical:
        out = nested_cv_batch(df, name, features, grid, k, inner, repeats, seed, y, id_col, numeric, select, weight_scheme, halving)
        out["oof"] = cut_lineage(out["oof"])
        return out | {"calibrator": fit_calibrator(oof_mean(out["oof"], id_col, y), "logistic_full", y=y)}
    outer = cv_folds(df, k, repeats, seed, y, id_col=id_col).select(F.col("id").alias("__id"), "repeat", "fold")
    cols = [id_col, y, *features, *numeric, *categorical]
    rows = cut_lineage(df.select(*cols).join(outer, F.col(id_col) == F.col("__id")).drop("__id"))
    oof, params, selected = [], [], []
    for rep in range(repeats):
        for f in range(k):
            here = F.col("repeat") == rep
            train = rows.filter(here & (F.col("fold") != f)).select(*cols)
            test = rows.filter(here & (F.col("fold") == f)).select(*cols)
            kept = select_features(train, features, k=select, y=y, id_col=id_col) if select else list(features)
            if weight_scheme != "none":
                train = class_weights(train, weight_scheme, y=y)
            weight = "weight" if weight_scheme != "none" else None
            best, best_auc = dict(grid[0]), None
            if len(grid) > 1:
                inner_ids = cv_folds(train, inner, 1, seed + 1 + f, y, id_col=id_col).select(F.col("id").alias("__id"), F.col("fold").alias("__f"))
                tr = cut_lineage(train.join(inner_ids, F.col(id_col) == F.col("__id")).drop("__id"))
                scores = []
                for g, point in enumerate(grid):
                    pipe = build_pipeline(name, kept, numeric, categorical, y, weight, **point)
                    for i in range(inner):
                        m = pipe.fit(tr.filter(F.col("__f") != i))
                        scores.append(score(tr.filter(F.col("__f") == i), m, (id_col, y)).withColumn("g", F.lit(g)))
                got = auroc(reduce(DataFrame.unionByName, scores), ["g"], y).collect()  # one row per grid point
                top = max(got, key=lambda r: (r.auroc if r.auroc is not None else -1.0, -r.g))
                best, best_auc = dict(grid[top.g]), top.auroc
            model = build_pipeline(name, kept, numeric, categorical, y, weight, **best).fit(train)
            oof.append(score(test, model, (id_col, y)).withColumns({"repeat": F.lit(rep), "fold": F.lit(f)}))
            params += [(rep, f, p, str(v), best_auc) for p, v in sorted(best.items())]
            selected += [(rep, f, x) for x in kept]
    scored = cut_lineage(reduce(DataFrame.unionByName, oof))
    return {
        "oof": scored, "params": spark.createDataFrame(params, "repeat int, fold int, param string, value string, inner_auroc double"),
        "selected": spark.createDataFrame(selected, "repeat int, fold int, feature string"),
        "calibrator": fit_calibrator(oof_mean(scored, id_col, y), "logistic_full", y=y),
    }


def oof_mean(oof: DataFrame, id_col: str = "id", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Mean out-of-fold score over repeats."""
    return oof.groupBy(*keys, id_col, y).agg(F.avg("y_prob").alias("y_prob"))


# ---------------------------------------------------------------- stacking
def stack_fit(scores: DataFrame, models: Sequence[str], use_logit: bool = True, calibrate: str | None = None, id_col: str = "id", y: str = "y_true", folds: int = 3, **params) -> dict:
    """Logistic meta model on the mean scores of the base models, optionally calibrated.

    The calibrator sees out-of-fold meta scores only (``folds`` class-stratified folds), never a
    score of a row that its meta model was fitted on.
    """
    wide = stack_features(scores, models, use_logit, id_col, y)
    pipe = Pipeline(stages=[*preprocess(list(models), impute=False), learner("LR_L2", y, **params)])
    if calibrate:
        ids = cv_folds(wide, folds, 1, 0, y, id_col=id_col).select(F.col("id").alias("__id"), "fold")
        wide = cut_lineage(wide.join(ids, F.col(id_col) == F.col("__id")).drop("__id"))
    meta, cal = pipe.fit(wide), None
    if calibrate:
        parts = [score(wide.filter(F.col("fold") == f), pipe.fit(wide.filter(F.col("fold") != f)), (id_col, y)) for f in range(folds)]
        cal = fit_calibrator(reduce(DataFrame.unionByName, parts), calibrate, y=y)
    return {"models": list(models), "logit": use_logit, "meta": meta, "calibrator": cal}


def stack_features(scores: DataFrame, models: Sequence[str], use_logit: bool, id_col: str, y: str) -> DataFrame:
    wide = stack_matrix(scores, models, id_col=id_col, y=y).dropna(subset=list(models))
    return wide.withColumns({m: logit(m) for m in models}) if use_logit else wide


def stack_predict(stack: dict, scores: DataFrame, id_col: str = "id", y: str = "y_true") -> DataFrame:
    out = score(stack_features(scores, stack["models"], stack["logit"], id_col, y), stack["meta"], (id_col, y))
    if stack["calibrator"] is None:
        return out
    return apply_calibrator(out, stack["calibrator"]).drop("y_prob").withColumnRenamed("y_prob_calibrated", "y_prob")


def average_ensemble(scores: DataFrame, keys: Sequence[str] = (), id_col: str = "id", y: str = "y_true", p: str = "y_prob") -> DataFrame:
    return scores.groupBy(*keys, id_col, y).agg(F.avg(p).alias(p))


# ---------------------------------------------------------------- experiments
def learning_curve(df: DataFrame, name: str, features: Sequence[str], fractions: Sequence[float], k: int = 3, seed: int = 0, y: str = "y", id_col: str = "id", **params) -> DataFrame:
    """(fold, fraction, n_train, split, auroc): nested training subsets in hash order inside each class."""
    from ..core.order import hash_rank

    if name in LINEAR:
        return learning_curve_batch(df, name, features, fractions, k, seed, y, id_col, **params)
    folds = cv_folds(df, k, 1, seed, y, id_col=id_col).select(F.col("id").alias("__id"), "fold")
    rows = cut_lineage(df.select(id_col, y, *features).join(folds, F.col(id_col) == F.col("__id")).drop("__id"))
    parts, sizes = [], []
    pipe = build_pipeline(name, features, y=y, **params)
    for f in range(k):
        train = hash_rank(rows.filter(F.col("fold") != f), [y], id_col, seed, "__rn")
        n = train.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
        train = cut_lineage(join_on(train, n, [y]))
        for frac in fractions:
            sub = train.filter(F.col("__rn") <= F.ceil(F.col("__n") * frac))
            m = pipe.fit(sub)
            tag = {"fold": F.lit(f), "fraction": F.lit(float(frac))}
            parts.append(score(sub, m, (id_col, y)).withColumns({**tag, "split": F.lit("train")}))
            parts.append(score(rows.filter(F.col("fold") == f), m, (id_col, y)).withColumns({**tag, "split": F.lit("validation")}))
            sizes.append(sub.groupBy().agg(F.count(F.lit(1)).alias("n_train")).withColumns(tag))
    auc = auroc(reduce(DataFrame.unionByName, parts), ["fold", "fraction", "split"], y)
    return auc.join(reduce(DataFrame.unionByName, sizes), ["fold", "fraction"])


def final_refit(dev: DataFrame, test: DataFrame, name: str, features: Sequence[str], params: DataFrame | None = None, n_boot: int = 200, seed: int = 42, y: str = "y", id_col: str = "id", **fixed) -> tuple[PipelineModel, DataFrame]:
    """Refit on all development rows with median parameters; test metrics with bootstrap intervals."""
    from .resample import bootstrap_ci

    point = dict(fixed)
    if params is not None:
        med = params.withColumn("v", F.col("value").try_cast("double")).filter("v IS NOT NULL").groupBy("param").agg(F.median("v").alias("v"))
        point.update({r.param: int(r.v) if r.param in ("maxDepth", "numTrees", "maxIter") else r.v for r in med.collect()})  # one row per parameter
    model = build_pipeline(name, features, y=y, **point).fit(dev)
    scored = cut_lineage(score(test, model, (id_col, y)))
    return model, bootstrap_ci(scored, [], id_col, ("auroc", "prauc"), n_boot, seed, y)


def cv_objective(df: DataFrame, features: Sequence[str], max_rows: int, k: int = 3, ratio: float | None = None, seed: int = 0, y: str = "y", id_col: str = "id", **params) -> DataFrame:
    """Out-of-fold AUROC of one parameter setting on a balanced subsample."""
    from .splits import subsample_balanced

    sub = subsample_balanced(df.select(id_col, y, *features), max_rows, seed, y, id_col)
    out = nested_cv_oof(sub, "LR_L2", features, [params], k, seed=seed, y=y, id_col=id_col)
    return auroc(out["oof"], [], y)


def run_factorial(df: DataFrame, design: DataFrame, test: DataFrame, models: dict[str, dict], features: Sequence[str], id_col: str = "id", outcome: str = "outcome") -> DataFrame:
    """Held-out scores per (cell, model): cell samples by hash rank; linear models of all cells are one batch."""
    from .splits import factorial_sample

    linear = {m: point for m, point in models.items() if m in LINEAR}
    parts = []
    if linear:
        parts.append(factorial_batch(df, design, test, linear, features, id_col, outcome)[0].select(id_col, "y", outcome, "y_prob", "cell", "model"))
    models = {m: point for m, point in models.items() if m not in LINEAR}
    if not models:
        return parts[0]
    rows = cut_lineage(factorial_sample(df, design, id_col, outcome).select("cell", F.col("id").alias("__id")).join(df.select(id_col, outcome, *features), F.col("__id") == F.col(id_col)).drop("__id"))
    y = (F.col(outcome) != "Controls").cast("int")
    rows = rows.withColumn("y", y)
    held = test.withColumn("y", y)
    cells = [r.cell for r in design.select("cell").distinct().orderBy("cell").collect()]  # the design table is the driver's own list
    for c in cells:
        for m, point in models.items():
            fit = build_pipeline(m, features, **point).fit(rows.filter(F.col("cell") == c))
            parts.append(score(held, fit, (id_col, "y", outcome)).withColumns({"cell": F.lit(c), "model": F.lit(m)}))
    return reduce(DataFrame.unionByName, parts)


def meta_calibration_benchmark(scores: DataFrame, models: Sequence[str], seeds: DataFrame, id_col: str = "id", y: str = "y_true") -> DataFrame:
    """Stack with and without calibration over repeated splits; one metric row each.

    ``seeds`` is a split assignment (id, seed, split); all its seeds are used.
    """
    parts = []
    seen = [r.seed for r in seeds.select("seed").distinct().orderBy("seed").collect()]  # seeds are a short list
    for s in seen:
        ids = seeds.filter(F.col("seed") == s).select(F.col("id").alias("__id"), "split")
        rows = scores.drop("split").join(ids, F.col(id_col) == F.col("__id")).drop("__id")
        for cal in (None, "logistic_full"):
            st = stack_fit(rows.filter("split = 'TRAIN'"), models, True, cal, id_col, y)
            parts.append(stack_predict(st, rows.filter("split = 'TEST'"), id_col, y).withColumns({"seed": F.lit(s), "calibrated": F.lit(cal is not None)}))
    both = reduce(DataFrame.unionByName, parts)
    from .calibration import ece

    keys = ["seed", "calibrated"]
    return join_on(discrimination(both, keys, y), ece(both, keys, y=y), keys)


def ensemble_holdout(scores: DataFrame, models: Sequence[str], dev: Column, hold: Column, id_col: str = "id", y: str = "y_true") -> DataFrame:
    """Metrics of the base models, their average and their stack on held-out rows."""
    base = scores.filter(hold)
    st = stack_fit(scores.filter(dev), models, id_col=id_col, y=y)
    parts = [
        base.select(id_col, y, "y_prob", "model"), average_ensemble(base, id_col=id_col, y=y).withColumn("model", F.lit("AVERAGE")),
        stack_predict(st, base, id_col, y).withColumn("model", F.lit("STACK")),
    ]
    return discrimination(reduce(DataFrame.unionByName, [p.select(id_col, y, "y_prob", "model") for p in parts]), ["model"], y)
