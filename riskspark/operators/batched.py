"""Resampled linear models, all fitted together: folds, grids, panels, replicates and cells as keys of one job.

Rows become one feature vector each; which model trains on a row, and with what weight, is
a short list beside it.  ``core.irls`` advances all models in one pass a step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.irls import Fit, Spec, fit_logistic_batch, fits_table, score_batch
from ..core.keys import join_on
from ..core.order import hash_rank
from ..core.session import cut_lineage
from .discrimination import auroc
from .splits import class_weights, cv_folds

#: Learners whose fits are batched, with their L1 share.
LINEAR = {"LR_EN": 0.5, "LR_L1": 1.0, "LR_L2": 0.0}


def spec_of(name: str, features: Sequence[int], **params) -> Spec:
    return Spec(tuple(features), float(params.get("regParam", 0.01)), float(params.get("elasticNetParam", LINEAR[name])))


def vectors(df: DataFrame, names: Sequence[str], id_col: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, y, keep..., v): the named columns as one array of doubles, missing values left in."""
    return df.select(F.col(id_col).alias("id"), F.col(y).cast("int").alias("y"), *keep, F.array(*[F.col(c).cast("double") for c in names]).alias("v"))


def _listed(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    """(id, name): one list of structs per subject, as long as the models that use it."""
    return rows.groupBy("id").agg(F.collect_list(F.struct(*cols)).alias(name))


def _with(rows: DataFrame, *lists: DataFrame) -> DataFrame:
    for x in lists:
        rows = join_on(rows, x, ["id"], "left")
    return rows


def member(model: Column, weight: Column | float = 1.0) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return F.struct(model.cast("int").alias("model"), w.cast("double").alias("weight"))


# ---------------------------------------------------------------- search spaces
#: Ranges of the search, per learner: (low, high, scale).
SPACES: dict[str, dict[str, tuple[float, float, str]]] = {
    "LR_EN": {"regParam": (1e-4, 1e2, "log"), "elasticNetParam": (0.05, 0.95, "linear")},
    "LR_L1": {"regParam": (1e-4, 1e2, "log")},
    "LR_L2": {"regParam": (1e-4, 1e2, "log")},
    "RF": {"numTrees": (20, 200, "int"), "maxDepth": (3, 12, "int")},
    "GBT": {"maxIter": (10, 60, "int"), "maxDepth": (2, 6, "int"), "stepSize": (0.02, 0.3, "log")},
    "LinSVM_cal": {"regParam": (1e-4, 1e2, "log")},
}
_PRIMES = (2, 3, 5, 7, 11, 13)


def radical_inverse(i: int, base: int) -> float:
    out, scale = 0.0, 1.0 / base
    while i:
        i, digit = divmod(i, base)
        out += digit * scale
        scale /= base
    return out


def search_space(name: str, n: int, seed: int = 0, ranges: dict[str, tuple[float, float, str]] | None = None) -> list[dict]:
    """``n`` settings spread evenly over the learner's ranges: a Halton sequence shifted by the seed."""
    out = []
    for i in range(n):
        point = {}
        for d, (param, (low, high, scale)) in enumerate(sorted((ranges or SPACES[name]).items())):
            shift = radical_inverse(seed + 1, 7 + 2 * d) if seed else 0.0
            u = (radical_inverse(i + 1, _PRIMES[d % len(_PRIMES)]) + shift) % 1.0
            if scale == "log":
                point[param] = float(low * (high / low) ** u)
            else:
                point[param] = int(low + math.floor(u * (high - low + 1))) if scale == "int" else float(low + u * (high - low))
        out.append(point)
    return out


# ---------------------------------------------------------------- nested folds
def nested_cv_batch(df: DataFrame, name: str, features: Sequence[str], grid: Sequence[dict], k: int = 5, inner: int = 3, repeats: int = 1, seed: int = 0, y: str = "y", id_col: str = "id", extra: Sequence[str] = (), select: int | None = None, weight_scheme: str = "none", halving: bool = False) -> dict[str, DataFrame]:
    """Nested folds of a linear learner: one job a step for all inner fits, another one for all outer fits.

    Tables: ``oof`` (repeat, fold, id, y, y_prob), ``params`` (repeat, fold, param, value,
    inner_auroc), ``trials`` (repeat, fold, trial, inner_auroc, folds_used), ``selected`` (repeat, fold,
    feature), ``importance`` (repeat, fold, feature, coef, converged), the intercept as feature ''.
    With ``halving`` the inner folds come one after the other, and each outer fold goes on with the better half of
    its settings.  Settings tie by their place in the grid.
    """
    spark = df.sparkSession
    names = [*features, *extra]
    p, g = len(names), len(grid)
    rows = cut_lineage(vectors(df, names, id_col, y))
    places = cv_folds(rows, k, repeats, seed, "y").withColumn("outer", F.col("repeat") * k + F.col("fold"))
    places = cut_lineage(places.select("id", "y", "repeat", "outer"))
    folds = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: (F.col("repeat") * k + f).cast("int"))
    train = places.select("id", "y", F.explode(F.filter(folds, lambda o: o != F.col("outer"))).alias("outer"))
    train = class_weights(train, weight_scheme, ["outer"])
    inside = cv_folds(train, inner, 1, seed + 1, "y", ["outer"]).select("id", "outer", F.col("fold").alias("part"))
    train = join_on(train, inside, ["id", "outer"])
    lists = cut_lineage(_with(rows, _listed(train, "tr", "outer", "part", "weight"), places.groupBy("id").agg(F.collect_list("outer").alias("te"))))
    outers = [(r, f, r * k + f) for r in range(repeats) for f in range(k)]
    panels = _fold_panels(rows, train, features, select)
    spots = {o: tuple(names.index(f) for f in [*panels.get(o, list(features)), *extra]) for _, _, o in outers}

    left = {o: list(range(g)) for _, _, o in outers}
    marks: dict[tuple[int, int], list[float]] = {}
    if g > 1:
        rounds = [[i] for i in range(inner)] if halving else [list(range(inner))]
        for parts in rounds:
            code = {(o, s, i): n for n, (o, s, i) in enumerate((o, s, i) for o in left for s in left[o] for i in parts)}
            back = {n: key for key, n in code.items()}
            table = F.create_map(*[x for o in left for x in (F.lit(o), F.array(*[F.array(*[F.lit(code[o, s, i]) for i in parts]) for s in left[o]]))])
            spots_of = F.array(*[F.lit(i) for i in parts])
            # For each outer training set of a row: its models are those that leave out another part than the row's.
            uses = lambda t: F.flatten(F.transform(table[t["outer"]], lambda s: F.filter(F.transform(s, lambda m, j: F.when(spots_of[j] != t["part"], member(m, t["weight"]))), lambda x: x.isNotNull())))
            tests = lambda t: F.flatten(F.transform(table[t["outer"]], lambda s: F.filter(F.transform(s, lambda m, j: F.when(spots_of[j] == t["part"], m)), lambda x: x.isNotNull())))
            here = lists.select("id", "y", "v", F.flatten(F.transform("tr", uses)).alias("members"), F.flatten(F.transform("tr", tests)).alias("targets"))
            fits = fit_logistic_batch(here, {n: spec_of(name, spots[o], **grid[s]) for n, (o, s, _) in back.items()}, p)
            scored = score_batch(here, fits, p, ["y"])
            for r in auroc(scored, ["model"], "y").collect():  # one row per model
                o, s, _ = back[r.model]
                marks.setdefault((o, s), []).append(r.auroc if r.auroc is not None else -1.0)
            if halving:
                for o, some in left.items():
                    some.sort(key=lambda s: (-_mean(marks.get((o, s), [])), s))
                    left[o] = sorted(some[: max(1, (len(some) + 1) // 2)])
    best = {o: min(some, key=lambda s: (-_mean(marks.get((o, s), [])), s)) for o, some in left.items()}
    here = lists.select("id", "y", "v", F.transform("tr", lambda t: member(t["outer"], t["weight"])).alias("members"), F.col("te").alias("targets"))
    fits = fit_logistic_batch(here, {o: spec_of(name, spots[o], **grid[best[o]]) for o in spots}, p)
    oof = score_batch(here, fits, p, ["id", "y"]).select((F.col("model") / k).cast("int").alias("repeat"), (F.col("model") % k).cast("int").alias("fold"), F.col("id").alias(id_col), F.col("y").alias(y), "y_prob")
    score = lambda o, s: _mean(marks[o, s]) if (o, s) in marks else None
    params = [(r, f, param, str(v), score(o, best[o])) for r, f, o in outers for param, v in sorted(grid[best[o]].items())]
    trials = [(r, f, s, score(o, s), len(marks[o, s])) for r, f, o in outers for s in range(g) if (o, s) in marks]
    return {
        "oof": oof,
        "params": spark.createDataFrame(params, "repeat int, fold int, param string, value string, inner_auroc double"),
        "trials": spark.createDataFrame(trials, "repeat int, fold int, trial int, inner_auroc double, folds_used int"),
        "selected": spark.createDataFrame([(r, f, names[j]) for r, f, o in outers for j in spots[o] if j < len(features)], "repeat int, fold int, feature string"),
        "importance": fits_table(spark, fits, names).select((F.col("model") / k).cast("int").alias("repeat"), (F.col("model") % k).cast("int").alias("fold"), "feature", "coef", "converged"),
    }


def _mean(v: Sequence[float]) -> float:
    return sum(v) / len(v) if v else -1.0


def _fold_panels(rows: DataFrame, train: DataFrame, features: Sequence[str], k: int | None) -> dict[int, list[str]]:
    """Features each training set keeps: screened by rank sums, then the k best by F.  All sets in one job."""
    if not k:
        return {}
    from .screen import kbest, screen

    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("v")[j].alias("x")) for j, f in enumerate(features)])).alias("s")
    long = join_on(rows.select("id", "v"), train.select("id", "outer", "y"), ["id"]).select("id", "outer", "y", pairs).select("id", "outer", "y", "s.feature", "s.x")
    kept = screen(long, "mannwhitney", 0, ["outer"]).select("outer", "feature", "rank")
    out: dict[int, list[str]] = {}
    for r in kept.orderBy("outer", "rank").collect():  # a short list per training set
        out.setdefault(r.outer, []).append(r.feature)
    if any(len(v) > k for v in out.values()):
        best: dict[int, list[str]] = {}
        for r in kbest(join_on(long, kept.select("outer", "feature"), ["outer", "feature"], "left_semi"), k, ["outer"]).orderBy("outer", "rank").collect():
            best.setdefault(r.outer, []).append(r.feature)
        out = {o: best[o] if len(v) > k else v for o, v in out.items()}
    return out


# ---------------------------------------------------------------- learning curves
def learning_curve_batch(df: DataFrame, name: str, features: Sequence[str], fractions: Sequence[float], k: int = 3, seed: int = 0, y: str = "y", id_col: str = "id", **params) -> DataFrame:
    """(fold, fraction, split, auroc, n_train): nested training subsets in hash order inside each class."""
    p, n = len(features), len(fractions)
    rows = vectors(df, features, id_col, y)
    places = cut_lineage(cv_folds(rows, k, 1, seed, "y").select("id", "y", "fold"))
    train = places.select("id", "y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("outer"))
    ranked = hash_rank(train, ["outer", "y"], "id", seed, "rn")
    sizes = train.groupBy("outer", "y").agg(F.count(F.lit(1)).alias("n"))
    inside = F.explode(F.array(*[F.when(F.col("rn") <= F.ceil(F.col("n") * float(q)), F.col("outer") * n + j) for j, q in enumerate(fractions)])).alias("model")
    uses = cut_lineage(join_on(ranked, sizes, ["outer", "y"]).select("id", inside).filter("model IS NOT NULL"))
    here = _with(rows, _listed(uses, "uses", "model"), places.select("id", "fold"))
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.col("fold") * n + j)
    here = cut_lineage(here.select("id", "y", "v", "fold", F.coalesce(F.transform("uses", lambda u: member(u["model"])), F.array().cast("array<struct<model:int,weight:double>>")).alias("members"), F.concat(F.coalesce("uses.model", F.array().cast("array<int>")), own).alias("targets")))
    fits = fit_logistic_batch(here, {m: spec_of(name, range(p), **params) for m in range(k * n)}, p)
    scored = score_batch(here, fits, p, ["y", "fold"])
    curve = auroc(scored.withColumn("split", F.when(F.floor(F.col("model") / n) == F.col("fold"), "validation").otherwise("train")), ["model", "split"], "y")
    count = uses.groupBy("model").agg(F.count(F.lit(1)).alias("n_train"))
    out = join_on(curve, count, ["model"])
    shares = F.array(*[F.lit(float(q)) for q in fractions])
    return out.select(F.floor(F.col("model") / n).cast("int").alias("fold"), shares[F.col("model") % n].alias("fraction"), "split", "auroc", "n_train")


# ---------------------------------------------------------------- panels
def panel_scores(train: DataFrame, test: DataFrame, name: str, features: Sequence[str], panels: Sequence[Sequence[str]], k: int = 0, seed: int = 0, y: str = "y", id_col: str = "id", **params) -> tuple[DataFrame, DataFrame | None, dict[int, Fit]]:
    """Fits of all panels (lists of features) on the training rows, and in ``k`` folds of them, in one batch.

    Test scores (panel, id, y, y_prob), out-of-fold scores (panel, fold, y, y_prob) and the fits on all training rows by panel.
    """
    p, n = len(features), len(panels)
    rows = vectors(train, features, id_col, y)
    full = F.array(*[member(F.lit(j * (k + 1) + k)) for j in range(n)])
    if k:
        places = cv_folds(rows, k, 1, seed, "y").select("id", "fold")
        rows = _with(rows, places)
        folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
        each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.transform(folds, lambda f: member(j * (k + 1) + f))))
        targets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j * (k + 1) + F.col("fold")).cast("int"))
        rows = rows.select("id", "y", "v", F.concat(full, each).alias("members"), targets.alias("targets"))
    else:
        rows = rows.select("id", "y", "v", full.alias("members"))
    rows = cut_lineage(rows)
    spots = [[features.index(f) for f in panel] for panel in panels]
    fits = fit_logistic_batch(rows, {j * (k + 1) + f: spec_of(name, spots[j], **params) for j in range(n) for f in range(k + 1)}, p)
    whole = {j: fits[j * (k + 1) + k] for j in range(n)}
    held = vectors(test, features, id_col, y).withColumn("targets", F.sequence(F.lit(0), F.lit(n - 1)))
    tests = score_batch(held, whole, p, ["id", "y"]).select(F.col("model").alias("panel"), F.col("id").alias(id_col), F.col("y").alias(y), "y_prob")
    oof = None
    if k:
        oof = score_batch(rows, fits, p, ["y"]).select((F.col("model") / (k + 1)).cast("int").alias("panel"), (F.col("model") % (k + 1)).alias("fold"), F.col("y").alias(y), "y_prob")
    return tests, oof, whole


# ---------------------------------------------------------------- resamples and cells
def bootstrap_coefficients(df: DataFrame, name: str, features: Sequence[str], n_boot: int, seed: int = 42, y: str = "y", id_col: str = "id", **params) -> DataFrame:
    """(b, feature, coef, converged) of refits on class-stratified resamples, all in one batch; a resample is a list of weights."""
    from .resample import draw_weights

    rows = vectors(df, features, id_col, y)
    drawn = draw_weights(rows.select("id", "y"), [], "id", n_boot, seed, ["y"])
    here = _with(rows, _listed(drawn, "drawn", "b", "weight"))
    members = F.coalesce(F.transform("drawn", lambda d: member(d["b"], d["weight"])), F.array().cast("array<struct<model:int,weight:double>>"))
    fits = fit_logistic_batch(here.select("v", "y", members.alias("members")), {b: spec_of(name, range(len(features)), **params) for b in range(n_boot)}, len(features))
    return fits_table(df.sparkSession, fits, features).filter("feature <> ''").select(F.col("model").alias("b"), "feature", "coef", "converged")


def factorial_batch(df: DataFrame, design: DataFrame, test: DataFrame, models: dict[str, dict], features: Sequence[str], id_col: str = "id", outcome: str = "outcome", control: str = "Controls") -> tuple[DataFrame, DataFrame]:
    """Every (cell, model) of a design in one batch: held-out scores (cell, model, id, y, outcome, y_prob) and importances.

    Importances (cell, model, feature, importance) are |coefficient| on standardised features, the cells' own.
    """
    from .splits import factorial_sample

    spark = df.sparkSession
    cells = [r.cell for r in design.select("cell").distinct().orderBy("cell").collect()]  # the design table is the driver's own list
    jobs = [(c, m) for c in cells for m in models]
    y = (F.col(outcome) != control).cast("int")
    rows = vectors(df.withColumn("__y", y), features, id_col, "__y")
    code = F.create_map(*[x for i, c in enumerate(cells) for x in (F.lit(c), F.lit(i))])
    drawn = factorial_sample(df, design, id_col, outcome).select("id", code[F.col("cell")].alias("cell"))
    here = _with(rows, _listed(drawn, "drawn", "cell"))
    n = len(models)
    members = F.flatten(F.transform("drawn", lambda d: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: member(d["cell"] * n + j))))
    here = here.select("v", "y", F.coalesce(members, F.array().cast("array<struct<model:int,weight:double>>")).alias("members"))
    fits = fit_logistic_batch(here, {i: spec_of(m, range(len(features)), **models[m]) for i, (_, m) in enumerate(jobs)}, len(features))
    held = vectors(test.withColumn("__y", y), features, id_col, "__y", [outcome]).withColumn("targets", F.sequence(F.lit(0), F.lit(len(jobs) - 1)))
    names = spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate(jobs)], f"__m int, cell {dict(design.dtypes)['cell']}, model string")
    scored = score_batch(held, fits, len(features), ["id", "y", outcome]).withColumnRenamed("model", "__m")
    tell = lambda x: x.join(F.broadcast(names), "__m").drop("__m")  # noqa: E731  one row per fit
    weights = fits_table(spark, fits, features).filter("feature <> ''").select(F.col("model").alias("__m"), "feature", F.abs("coef").alias("importance"))
    return tell(scored).withColumnRenamed("id", id_col), tell(weights)


def case_type_report(scored: DataFrame, keys: Sequence[str], outcome: str = "outcome", control: str = "Controls") -> DataFrame:
    """Mean, median and spread of scores per case type, and the AUROC of each type against the controls."""
    keys = list(keys)
    spread = scored.groupBy(*keys, outcome).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_prob").alias("mean_score"), F.median("y_prob").alias("median_score"), F.stddev_samp("y_prob").alias("std_score")
    )
    types = scored.filter(F.col(outcome) != control).select(*keys, F.col(outcome).alias("__type")).distinct()
    against = join_on(scored, types, keys).filter((F.col(outcome) == control) | (F.col(outcome) == F.col("__type")))
    auc = auroc(against.withColumn("__y", (F.col(outcome) != control).cast("int")), [*keys, "__type"], "__y").withColumnRenamed("__type", outcome)
    return join_on(spread, auc.select(*keys, outcome, "auroc"), [*keys, outcome], "left")


# ---------------------------------------------------------------- elimination
def eliminate_batch(df: DataFrame, name: str, features: Sequence[str], groups: int, sizes: Sequence[int], smallest: int, per_step: int = 1, inner: int = 0, **params) -> tuple[DataFrame, DataFrame | None, dict[int, list[tuple[str, int]]], dict[tuple[int, int], list[str]]]:
    """Eliminations of several training sets in step: each round fits the present panels of all groups together.

    ``df``: id, y, v, tr (array of struct group, part), te (array of group).  Returns held-out scores (group, size,
    id, y, y_prob), inner out-of-fold scores (group, size, part, y, y_prob), order of elimination and panels by (group, size).
    """
    p, each = len(features), inner + 1
    member_list = F.flatten(F.transform("tr", lambda t: F.filter(F.transform(F.sequence(F.lit(0), F.lit(inner)), lambda i: F.when(i != F.coalesce(t["part"], F.lit(-1)), member(t["group"] * each + i))), lambda x: x.isNotNull())))
    parts = F.transform(F.filter("tr", lambda t: t["part"] >= 0), lambda t: (t["group"] * each + t["part"]).cast("int"))
    rows = cut_lineage(df.select("id", "y", "v", F.coalesce(member_list, F.array().cast("array<struct<model:int,weight:double>>")).alias("members"), F.coalesce(parts, F.array().cast("array<int>")).alias("targets"), F.transform("te", lambda g: (g * each + inner).cast("int")).alias("held")))
    left = {g: list(range(p)) for g in range(groups)}
    gone: dict[int, list[tuple[str, int]]] = {g: [] for g in left}
    panels: dict[tuple[int, int], list[str]] = {}
    held, oof = None, None
    while True:
        now = [g for g in left if left[g]]
        size = len(left[now[0]])
        measured = size in sizes
        specs = {g * each + i: spec_of(name, left[g], **params) for g in now for i in (range(each) if measured else [inner])}
        fits = fit_logistic_batch(rows, specs, p)
        if measured:
            tag = lambda x: x.withColumns({"group": (F.col("model") / each).cast("int"), "size": F.lit(size)})
            some = tag(score_batch(rows.withColumn("targets", F.coalesce("held", F.array().cast("array<int>"))), fits, p, ["id", "y"]))
            held = some if held is None else held.unionByName(some)
            if inner:
                some = tag(score_batch(rows, fits, p, ["y"])).withColumn("part", F.col("model") % each)
                oof = some if oof is None else oof.unionByName(some)
            panels |= {(g, size): [features[j] for j in left[g]] for g in now}
        if size <= smallest:
            return held, oof, gone, panels
        target = max([s for s in sizes if s < size], default=smallest)
        drop = min(per_step, size - target)
        for g in now:
            f = fits[g * each + inner]
            worst = sorted(zip((abs(c) for c in f.coef), (features[j] for j in f.features), f.features, strict=True))[:drop]
            for _, feature, j in worst:
                gone[g].append((feature, len(gone[g]) + 1))
                left[g].remove(j)
