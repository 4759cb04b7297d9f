"""Importance, explanation and elimination of features of fitted models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.keys import join_on
from ..core.order import dense_rank, hash_rank, ordinal_rank
from ..core.session import cut_lineage
from .batched import LINEAR, bootstrap_coefficients, eliminate_batch, panel_scores, vectors
from .discrimination import auroc, auroc_agg, brier_agg, prauc_agg, sens_at_spec_agg
from .hist import clean_scores, points_of
from .models import MedianModel, build_pipeline, score


def _coefficients(model: PipelineModel) -> list[float]:
    return [float(v) for v in model.stages[-1].coefficients.toArray()]


def linear_importance(spark: SparkSession, models: Sequence[PipelineModel], features: Sequence[str]) -> DataFrame:
    """|coefficient| on z-scored inputs over their sum; several calibration-fold models are averaged first.

    A model has one coefficient per feature column, so the lists are short.
    """
    rows = [_coefficients(m) for m in models]
    mean = [abs(sum(c[i] for c in rows) / len(rows)) for i in range(len(features))]
    total = sum(mean)
    return spark.createDataFrame(
        [(f, v / total if total else v, "abs_coef") for f, v in zip(features, mean)], "feature string, importance double, importance_type string"
    )


def tree_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Impurity importances of the feature columns; numeric covariates behind them are left out."""
    v = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v[i]), "impurity") for i, f in enumerate(features)], "feature string, importance double, importance_type string")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], clusters: Sequence[Sequence[str]] | None = None, repeats: int = 5, seed: int = 42, y: str = "y", id_col: str = "id", *, limit: int | None = None) -> DataFrame:
    """Drop in AUROC when the columns of a cluster are permuted together.

    For each (cluster, repeat) rows are re-paired with donors by hash rank; all
    permuted copies are scored in one transform and measured by key.
    """
    groups = [list(c) for c in (clusters if clusters is not None else [[f] for f in features])]
    rows = cut_lineage(hash_rank(df.select(id_col, y, *features), [], id_col, seed, "__idx"))
    copies = rows.select(id_col, "__idx", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("cluster"), F.explode(F.array(F.lit(0))).alias("__z")).drop("__z")
    copies = copies.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    order = hash_rank(copies, ["cluster", "repeat"], id_col, seed, "__pos", salt=["cluster", "repeat"])
    donors = rows.select(F.col("__idx").alias("__pos"), *[F.col(f).alias(f"__d_{f}") for f in features])
    both = join_on(order.select(id_col, "cluster", "repeat", "__pos"), donors, ["__pos"])
    both = join_on(both, rows.drop("__idx"), [id_col])
    swapped = both.select(
        id_col, y, "cluster", "repeat",
        *[F.when(F.col("cluster").isin([i for i, g in enumerate(groups) if f in g]), F.col(f"__d_{f}")).otherwise(F.col(f)).alias(f) for f in features],
    )
    base = auroc(score(rows, model, (id_col, y)), [], y, limit=limit).select(F.col("auroc").alias("baseline"))
    per = auroc(score(swapped, model, (id_col, y, "cluster", "repeat")), ["cluster", "repeat"], y, limit=limit)
    drop = per.join(F.broadcast(base), F.lit(True), "inner").withColumn("d", F.col("baseline") - F.col("auroc"))  # one row
    names = F.array(*[F.lit("|".join(sorted(g))) for g in groups])
    agg = drop.groupBy("cluster").agg(F.avg("d").alias("mean_importance"), F.stddev_samp("d").alias("std_importance"), F.max("baseline").alias("baseline"), F.count("d").alias("n_repeats"))
    agg = agg.select(F.element_at(names, F.col("cluster") + 1).alias("feature"), "mean_importance", "std_importance", "baseline", "n_repeats")
    return ordinal_rank(agg, [], [F.col("mean_importance").desc(), F.col("feature")], "rank", limit=limit)


def _metric_rows(scored: DataFrame, keys: Sequence[str], y: str, limit: int | None = None) -> DataFrame:
    ranked = points_of(scored, keys, y, limit=limit).groupBy(*keys).agg(auroc_agg().alias("auroc"), prauc_agg().alias("prauc"), sens_at_spec_agg(0.95).alias("sens95"))
    plain = clean_scores(scored, y).groupBy(*keys).agg(brier_agg(y).alias("brier"))
    return join_on(ranked, plain, list(keys))


def drop_column_importance(train: DataFrame, test: DataFrame, name: str, features: Sequence[str], clusters: Sequence[Sequence[str]] | None = None, y: str = "y", id_col: str = "id", *, limit: int | None = None, **params) -> DataFrame:
    """Refit without each cluster: loss in AUROC, AP and Brier against the full model; dense rank by loss in AUROC, missing ones last.

    Linear learners refit all panels in one batch.
    """
    groups = [list(c) for c in (clusters if clusters is not None else [[f] for f in features])]
    train, test = cut_lineage(train.select(id_col, y, *features)), cut_lineage(test.select(id_col, y, *features))
    panels = {i: [f for f in features if f not in g] for i, g in enumerate([[], *groups])}
    panels = {i: kept for i, kept in panels.items() if kept}
    if name in LINEAR:
        tests, _, _ = panel_scores(train, test, name, list(features), list(panels.values()), y=y, id_col=id_col, **params)
        code = F.array(*[F.lit(i) for i in panels])
        scored = tests.select(id_col, y, "y_prob", code[F.col("panel")].alias("k"))
    else:
        parts = [score(test, build_pipeline(name, kept, y=y, **params).fit(train), (id_col, y)).withColumn("k", F.lit(i)) for i, kept in panels.items()]
        scored = reduce(DataFrame.unionByName, parts)
    rows = _metric_rows(scored, ["k"], y, limit)
    full = rows.filter("k = 0").select(*[F.col(c).alias(f"f_{c}") for c in ("auroc", "prauc", "brier")])
    both = rows.filter("k > 0").join(F.broadcast(full), F.lit(True), "inner")  # one row
    names = F.array(*[F.lit("|".join(sorted(g))) for g in groups])
    out = both.select(
        F.element_at(names, F.col("k")).alias("cluster"), (F.col("f_auroc") - F.col("auroc")).alias("delta_auroc"), (F.col("f_prauc") - F.col("prauc")).alias("delta_prauc"),
        (F.col("brier") - F.col("f_brier")).alias("delta_brier"), F.col("f_auroc").alias("full_auroc"),
    )
    return dense_rank(out, [], "delta_auroc", "rank", limit=limit)


def linear_shap(model: PipelineModel, df: DataFrame, background: DataFrame, features: Sequence[str], id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Exact values of a linear model: coefficient x (z - mean z of the background), long form.

    Missing features are imputed as the model does, in the rows and in the background.
    """
    coef = _coefficients(model)[: len(features)]
    scaler = next(s for s in model.stages if type(s).__name__ == "StandardScalerModel")
    sd = [float(v) for v in scaler.std.toArray()]
    fill = {}
    for stage in model.stages:
        if isinstance(stage, MedianModel):
            fill = stage.values
    filled = [F.coalesce(F.when(~F.isnan(f), F.col(f).cast("double")), F.lit(fill.get(f))).alias(f) for f in features]
    mean = background.select(*filled).agg(*[F.avg(f).alias(f"__m_{f}") for f in features])
    rows = df.select(id_col, *keep, *filled).join(F.broadcast(mean), F.lit(True), "inner")  # one row
    val = [((F.col(f) - F.col(f"__m_{f}")) * F.lit(c / s if s else 0.0)).alias(f) for f, c, s in zip(features, coef, sd)]
    return rows.select(id_col, *keep, *val).unpivot([id_col, *keep], list(features), "feature", "shap")


def background_sensitivity(model: PipelineModel, df: DataFrame, features: Sequence[str], n: int, seed: int = 42, y: str = "y", id_col: str = "id", top: Sequence[int] = (3,)) -> DataFrame:
    """Agreement of the mean |value| ranking between background strategies."""
    from .significance import rank_agreement
    from .splits import background_sample

    ranks = {}
    for s in ("random", "controls_only", "stratified"):
        bg = background_sample(df.select(id_col, y, *features), s, n, seed, y, id_col)
        mean = linear_shap(model, df, bg, features, id_col).groupBy("feature").agg(F.avg(F.abs("shap")).alias("v"))
        ranks[s] = ordinal_rank(mean, [], [F.col("v").desc(), F.col("feature")], "rank")
    names = list(ranks)
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            parts.append(rank_agreement(ranks[a], ranks[b], top).withColumns({"a": F.lit(a), "b": F.lit(b)}))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- elimination
def eval_sizes(start: int, smallest: int, strategy: str = "geometric") -> list[int]:
    """Panel sizes to evaluate, falling from ``start`` to ``smallest``.

    linear: every size; geometric: halves; fine: halves with three quarters between.
    """
    if strategy not in ("geometric", "fine", "linear"):
        raise ValueError(f"unknown strategy {strategy}")
    if start <= smallest:
        return [start]
    if strategy == "linear":
        return list(range(start, smallest - 1, -1))
    sizes, at = {start, smallest}, start
    while at > smallest:
        sizes.add(at)
        if strategy == "fine":
            sizes.add(max(smallest, at * 3 // 4))
        at = max(smallest, at // 2)
    return sorted(sizes, reverse=True)


def _least_important(model: PipelineModel, name: str, features: Sequence[str], n: int) -> list[str]:
    last = model.stages[-1]
    vals = [abs(v) for v in _coefficients(model)] if hasattr(last, "coefficients") else [float(v) for v in last.featureImportances.toArray()]
    return [f for _, f in sorted(zip(vals, features))[:n]]


def recursive_elimination(train: DataFrame, val: DataFrame, name: str, features: Sequence[str], smallest: int = 2, strategy: str = "geometric", per_step: int = 1, cv_folds_: int = 0, seed: int = 0, y: str = "y", id_col: str = "id", *, limit: int | None = None, **params) -> dict[str, DataFrame]:
    """Refit and drop the least important features until ``smallest`` remain.

    ``curve``: metrics at each evaluated size (validation AUROC, AP, Brier,
    sensitivity at 95% specificity, optional cross-validated AUROC).  ``ranking``:
    order of elimination; survivors have none.  Wide tables may drop several per step.
    """
    from .splits import cv_folds

    spark = train.sparkSession
    if name in LINEAR:
        return _eliminate_linear(train, val, name, list(features), smallest, strategy, per_step, cv_folds_, seed, y, id_col, limit, **params)
    cols = [id_col, y, *features]
    train, val = cut_lineage(train.select(*cols)), cut_lineage(val.select(*cols))
    sizes = eval_sizes(len(features), smallest, strategy)
    if cv_folds_:
        train = train.drop("fold")
        ids = cv_folds(train, cv_folds_, 1, seed, y, id_col=id_col).select(F.col("id").alias("__id"), "fold")
        train = cut_lineage(train.join(ids, F.col(id_col) == F.col("__id")).drop("__id"))
    left, gone, order = list(features), [], 1
    scored, cvs, lists = [], [], []
    while True:
        pipe = build_pipeline(name, left, y=y, **params)
        model = pipe.fit(train)
        if len(left) in sizes:
            scored.append(score(val, model, (id_col, y)).withColumn("size", F.lit(len(left))))
            lists.append((len(left), list(left)))
            for f in range(cv_folds_):
                m = pipe.fit(train.filter(F.col("fold") != f))
                cvs.append(score(train.filter(F.col("fold") == f), m, (id_col, y)).withColumns({"size": F.lit(len(left)), "fold": F.lit(f)}))
        if len(left) <= smallest:
            break
        target = max([s for s in sizes if s < len(left)], default=smallest)
        for f in _least_important(model, name, left, min(per_step, len(left) - target)):
            gone.append((f, order))
            left.remove(f)
            order += 1
    curve = _metric_rows(reduce(DataFrame.unionByName, scored), ["size"], y, limit).withColumnsRenamed({"auroc": "auroc_val", "prauc": "prauc_val", "brier": "brier_val", "sens95": "sens95_val"})
    curve = curve.join(F.broadcast(spark.createDataFrame(lists, "size int, features array<string>")), "size")
    if cvs:
        per = auroc(reduce(DataFrame.unionByName, cvs), ["size", "fold"], y, limit=limit).groupBy("size").agg(F.avg("auroc").alias("auroc_cv"), F.stddev_samp("auroc").alias("auroc_cv_std"))
        curve = curve.join(per, "size", "left")
    ranking = spark.createDataFrame([*gone, *[(f, None) for f in left]], "feature string, elimination_rank int")
    return {"curve": curve, "ranking": ranking}


def _eliminate_linear(train: DataFrame, val: DataFrame, name: str, features: list[str], smallest: int, strategy: str, per_step: int, inner: int, seed: int, y: str, id_col: str, limit: int | None, **params) -> dict[str, DataFrame]:
    """``recursive_elimination`` with the fits of a round, also those of the inner folds, in one batch."""
    from .splits import cv_folds

    spark = train.sparkSession
    own, other = vectors(train, features, id_col, y), vectors(val, features, id_col, y)
    if inner:
        ids = cv_folds(own, inner, 1, seed, "y").select("id", F.col("fold").alias("part"))
        own = join_on(own, ids, ["id"])
    else:
        own = own.withColumn("part", F.lit(None).cast("int"))
    none = F.array().cast("array<struct<group:int,part:int>>")
    own = own.select("id", "y", "v", F.array(F.struct(F.lit(0).alias("group"), F.col("part").cast("int").alias("part"))).alias("tr"), F.array().cast("array<int>").alias("te"))
    both = own.unionByName(other.select("id", "y", "v", none.alias("tr"), F.array(F.lit(0)).alias("te")))
    held, oof, gone, panels = eliminate_batch(both, name, features, 1, eval_sizes(len(features), smallest, strategy), smallest, per_step, inner, **params)
    curve = _metric_rows(held, ["size"], "y", limit).withColumnsRenamed({"auroc": "auroc_val", "prauc": "prauc_val", "brier": "brier_val", "sens95": "sens95_val"})
    lists = [(size, panel) for (_, size), panel in panels.items()]
    curve = curve.join(F.broadcast(spark.createDataFrame(lists, "size int, features array<string>")), "size")  # one row per size
    if inner:
        per = auroc(oof, ["size", "part"], "y", limit=limit).groupBy("size").agg(F.avg("auroc").alias("auroc_cv"), F.stddev_samp("auroc").alias("auroc_cv_std"))
        curve = curve.join(per, "size", "left")
    left = [f for f in features if f not in {g for g, _ in gone[0]}]
    ranking = spark.createDataFrame([*gone[0], *[(f, None) for f in left]], "feature string, elimination_rank int")
    return {"curve": curve, "ranking": ranking}


def rfecv_folds(df: DataFrame, name: str, features: Sequence[str], k: int = 3, smallest: int = 2, seed: int = 0, y: str = "y", id_col: str = "id", inner: int = 3, **params) -> DataFrame:
    """(fold, feature, size, auroc_inner, auroc_val): features of the best size in each fold.

    The size is chosen by ``inner`` folds of the training part alone (the smaller of equal ones);
    the held-out part is scored at that size and has no say in it.
    """
    from .splits import cv_folds

    if name in LINEAR:
        return _rfecv_linear(df, name, list(features), k, smallest, seed, y, id_col, inner, **params)
    ids = cv_folds(df, k, 1, seed, y, id_col=id_col).select(F.col("id").alias("__id"), "fold")
    rows = cut_lineage(df.select(id_col, y, *features).join(ids, F.col(id_col) == F.col("__id")).drop("__id"))
    parts = []
    for f in range(k):
        out = recursive_elimination(rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f), name, features, smallest, cv_folds_=inner, seed=seed + 1, y=y, id_col=id_col, **params)
        best = out["curve"].agg(F.max(F.struct("auroc_cv", (-F.col("size")).alias("n"), "auroc_val", "features")).alias("s"))
        parts.append(best.select(F.lit(f).alias("fold"), (-F.col("s.n")).alias("size"), F.col("s.auroc_cv").alias("auroc_inner"), F.col("s.auroc_val").alias("auroc_val"), F.explode("s.features").alias("feature")))
    return reduce(DataFrame.unionByName, parts)


def _rfecv_linear(df: DataFrame, name: str, features: list[str], k: int, smallest: int, seed: int, y: str, id_col: str, inner: int, **params) -> DataFrame:
    """``rfecv_folds`` with all folds eliminating in step."""
    from .splits import cv_folds

    spark = df.sparkSession
    rows = cut_lineage(vectors(df, features, id_col, y))
    places = cut_lineage(cv_folds(rows, k, 1, seed, "y").select("id", "y", "fold"))
    train = places.select("id", "y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("group"))
    parts = cv_folds(train, inner, 1, seed + 1, "y", ["group"]).select("id", "group", F.col("fold").alias("part"))
    lists = parts.groupBy("id").agg(F.collect_list(F.struct(F.col("group").cast("int").alias("group"), F.col("part").cast("int").alias("part"))).alias("tr"))
    both = join_on(join_on(rows, lists, ["id"]), places.select("id", F.array(F.col("fold").cast("int")).alias("te")), ["id"])
    sizes = eval_sizes(len(features), smallest)
    held, oof, _, panels = eliminate_batch(both, name, features, k, sizes, smallest, 1, inner, **params)
    cv = auroc(oof, ["group", "size", "part"], "y").groupBy("group", "size").agg(F.avg("auroc").alias("auroc_cv"))
    curve = join_on(cv, auroc(held, ["group", "size"], "y").withColumnRenamed("auroc", "auroc_val"), ["group", "size"])
    lists = spark.createDataFrame([(g, size, panel) for (g, size), panel in panels.items()], "group int, size int, features array<string>")
    curve = curve.join(F.broadcast(lists), ["group", "size"])  # one row per fold and size
    best = curve.groupBy("group").agg(F.max(F.struct("auroc_cv", (-F.col("size")).alias("n"), "auroc_val", "features")).alias("s"))
    return best.select(F.col("group").alias("fold"), (-F.col("s.n")).alias("size"), F.col("s.auroc_cv").alias("auroc_inner"), F.col("s.auroc_val").alias("auroc_val"), F.explode("s.features").alias("feature"))


def saturation_sweep(train: DataFrame, test: DataFrame, orderings: dict[str, Sequence[str]], sizes: Sequence[int], name: str = "LR_L2", k: int = 3, n_boot: int = 100, seed: int = 42, y: str = "y", id_col: str = "id", **params) -> DataFrame:
    """CV AUPRC (mean, sd) and test AUPRC with bootstrap interval for each ordering and prefix size; linear learners in one batch."""
    from .splits import cv_folds

    features = sorted({f for o in orderings.values() for f in o})
    by = ["ordering", "panel_size"]
    if name in LINEAR:
        jobs = [(o, int(s)) for o in orderings for s in sizes]
        scored, oof, _ = panel_scores(train, test, name, features, [list(orderings[o])[:s] for o, s in jobs], k, seed, y, id_col, **params)
        names = train.sparkSession.createDataFrame([(i, o, s) for i, (o, s) in enumerate(jobs)], "panel int, ordering string, panel_size int")
        tell = lambda x: x.join(F.broadcast(names), "panel").drop("panel")  # noqa: E731  one row per panel
        return _sweep_report(tell(oof), cut_lineage(tell(scored)), by, n_boot, seed, y, id_col)
    ids = cv_folds(train, k, 1, seed, y, id_col=id_col).select(F.col("id").alias("__id"), "fold")
    train = cut_lineage(train.select(id_col, y, *features).join(ids, F.col(id_col) == F.col("__id")).drop("__id"))
    test = cut_lineage(test.select(id_col, y, *features))
    cvs, tests = [], []
    for o, names in orderings.items():
        for s in sizes:
            pipe = build_pipeline(name, list(names)[:s], y=y, **params)
            tag = {"ordering": F.lit(o), "panel_size": F.lit(int(s))}
            tests.append(score(test, pipe.fit(train), (id_col, y)).withColumns(tag))
            for f in range(k):
                m = pipe.fit(train.filter(F.col("fold") != f))
                cvs.append(score(train.filter(F.col("fold") == f), m, (id_col, y)).withColumns({**tag, "fold": F.lit(f)}))
    return _sweep_report(reduce(DataFrame.unionByName, cvs), cut_lineage(reduce(DataFrame.unionByName, tests)), by, n_boot, seed, y, id_col)


def _sweep_report(oof: DataFrame, tests: DataFrame, by: list[str], n_boot: int, seed: int, y: str, id_col: str) -> DataFrame:
    from .discrimination import prauc
    from .resample import bootstrap_ci

    cv = prauc(oof, [*by, "fold"], y).groupBy(*by).agg(F.avg("prauc").alias("cv_auprc_mean"), F.stddev_samp("prauc").alias("cv_auprc_std"))
    ci = bootstrap_ci(tests, by, id_col, ("prauc",), n_boot, seed, y)
    return join_on(cv, ci.select(*by, F.col("estimate").alias("test_auprc"), F.col("ci_lo").alias("test_auprc_lo"), F.col("ci_hi").alias("test_auprc_hi")), by)


def model_bootstrap_stability(df: DataFrame, name: str, features: Sequence[str], n_boot: int, top: int, threshold: float = 0.5, seed: int = 42, y: str = "y", id_col: str = "id", **params) -> DataFrame:
    """Refit on resamples (draw weights as instance weights); share of resamples with the feature among the top |coefficients|.

    A linear learner; all resamples are one batch.  Refits still moving after the last step count
    as named, and ``n_unsettled`` says how many there were.
    """
    coefs = cut_lineage(bootstrap_coefficients(df, name, features, n_boot, seed, y, id_col, **params))
    ranked = ordinal_rank(coefs.withColumn("abs_coef", F.abs("coef")), ["b"], [F.col("abs_coef").desc(), F.col("feature")], "__rk").filter(F.col("__rk") <= top)
    unsettled = coefs.filter("NOT converged").agg(F.count_distinct("b").alias("n_unsettled"))
    agg = ranked.groupBy("feature").agg((F.count(F.lit(1)) / F.lit(float(n_boot))).alias("selection_freq"), F.avg("abs_coef").alias("mean_abs_coef"))
    agg = agg.withColumn("kept", F.col("selection_freq") >= threshold).join(F.broadcast(unsettled), F.lit(True), "inner")  # one row
    return ordinal_rank(agg, [], [F.col("selection_freq").desc(), F.col("mean_abs_coef").desc(), F.col("feature")], "rank")
