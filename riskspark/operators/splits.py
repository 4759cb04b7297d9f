"""Cohort construction: strata, repeated splits, sampling and weights.

Random choices are ranks in seeded hash order (``hash_rank``): the same under
any partitioning, exact in size, and a class holding most rows still spreads
over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from ..core.keys import join_on, ratio
from ..core.order import hash_rank, hash_within, id_digest, ordinal_rank
from ..core.quantile import quantiles
from ..core.session import spread
from .cohort import CONTROL, INCIDENT, PREVALENT

SCHEMES = ("outcome+sex+age3", "outcome+sex+age2", "outcome+age3", "outcome+sex", "outcome")


def age_bins(age: Column, scheme: str) -> Column:
    """Right-closed age classes; values outside the ranges form the level 'nan'."""
    if scheme == "age3":
        bounds = [(0, 40, "young"), (40, 60, "middle"), (60, 150, "old")]
    elif scheme == "age2":
        bounds = [(0, 60, "lt60"), (60, 150, "ge60")]
    else:
        raise ValueError(f"unknown age scheme {scheme}")
    out = F
    for lo, hi, name in bounds:
        out = out.when((age > lo) & (age <= hi), name)
    return out.otherwise("nan")


def fill_median(df: DataFrame, col: str, *, limit: int | None = None) -> DataFrame:
    """NULLs of a numeric column replaced by its exact median."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    med = quantiles(counts, [], "v", {"__med": 0.5}, measure=df, limit=limit)
    return df.join(F.broadcast(med), F.lit(True), "left").withColumn(col, F.coalesce(F.col(col).cast("double"), "__med")).drop("__med")


def make_strata(scheme: str, outcome: str = "outcome", sex: str = "sex", age: str = "age") -> Column:
    """outcome[_sex][_age class]; expects the age column already filled."""
    parts = [F.coalesce(F.col(outcome), F.lit("UnknownOutcome"))]
    if "+sex" in scheme:
        parts.append(F.coalesce(F.col(sex).cast("string"), F.lit("UnknownSex")))
    if "+age" in scheme:
        parts.append(age_bins(F.col(age), scheme.rsplit("+", 1)[1]))
    return F.concat_ws("_", *parts)


def collapse_rare(df: DataFrame, stratum: str = "stratum", min_count: int = 2, outcome: str = "outcome") -> DataFrame:
    """Strata with fewer than min_count rows become outcome_RARE.

    The stratum sizes are a small aggregate joined back, not a window over rows.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    rare = F.concat(F.coalesce(F.col(outcome), F.lit("UnknownOutcome")), F.lit("_RARE"))
    return join_on(df, sizes, [stratum]).withColumn(stratum, F.when(F.col("__n") < min_count, rare).otherwise(F.col(stratum))).drop("__n")


def scheme_minimums(df: DataFrame, min_count: int = 2, outcome: str = "outcome", sex: str = "sex", age: str = "age") -> DataFrame:
    """(scheme, n_strata, min_size) after collapsing, for all schemes in one job."""
    cols = F.array(*[F.struct(F.lit(s).alias("scheme"), make_strata(s, outcome, sex, age).alias("stratum")) for s in SCHEMES])
    sizes = df.select(F.col(outcome), F.inline(cols)).groupBy("scheme", "stratum", outcome).agg(F.count(F.lit(1)).alias("n"))
    rare = F.concat(F.coalesce(F.col(outcome), F.lit("UnknownOutcome")), F.lit("_RARE"))
    name = F.when(F.col("n") < min_count, rare).otherwise(F.col("stratum"))
    final = sizes.groupBy("scheme", name.alias("stratum")).agg(F.sum("n").alias("n"))
    return final.groupBy("scheme").agg(F.count(F.lit(1)).alias("n_strata"), F.min("n").alias("min_size"))


def working_strata(df: DataFrame, min_count: int = 2, outcome: str = "outcome", sex: str = "sex", age: str = "age", *, limit: int | None = None) -> tuple[DataFrame, str]:
    """Finest scheme whose smallest stratum holds at least 2 rows; else the outcome alone."""
    filled = fill_median(df, age, limit=limit)
    mins = {r.scheme: r.min_size for r in scheme_minimums(filled, min_count, outcome, sex, age).collect()}  # 5 rows
    scheme = next((s for s in SCHEMES if mins.get(s, 0) >= 2), "outcome")
    rows = filled.withColumn("stratum", make_strata(scheme, outcome, sex, age))
    return collapse_rare(rows, "stratum", min_count, outcome), scheme


def _largest_remainder(counts: DataFrame, keys: Sequence[str], stratum: str, n: str, total: str, name: str) -> DataFrame:
    """Distribute ``total`` over strata in proportion to ``n``; ties by stratum name.

    One row per stratum: the window covers the strata of a key, not its rows.
    """
    w = Window.partitionBy(*keys)
    share = F.col(total) * F.col(n) / F.sum(n).over(w)
    out = counts.withColumn("__share", share).withColumn(name, F.floor("__share"))
    out = out.withColumn("__left", F.col(total) - F.sum(name).over(w))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(F.col("__share") - F.col(name), 9).desc(), F.col(stratum)))
    return out.withColumn("__rk", rank).withColumn(name, (F.col(name) + F.when(F.col("__rk") <= F.col("__left"), 1).otherwise(0)).cast("bigint")).drop("__share", "__left", "__rk")


def split_allocation(df: DataFrame, stratum: str, val: float, test: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per stratum for TEST and VAL (the rest is TRAIN)."""
    if val + test >= 1.0:
        raise ValueError("val + test must be below 1")
    keys = list(keys)
    temp = (val if val and val > 0 else 0.0) + test
    counts = df.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("n_stratum"))
    w = Window.partitionBy(*keys)  # one row per stratum
    total = F.sum("n_stratum").over(w)
    counts = counts.withColumn("__temp", F.ceil(F.round(F.lit(temp) * total, 9)))
    counts = _largest_remainder(counts, keys, stratum, "n_stratum", "__temp", "n_temp")
    if val and val > 0:
        counts = counts.withColumn("__test", F.ceil(F.round(F.lit(test / temp) * F.col("__temp"), 9)))
        counts = _largest_remainder(counts, keys, stratum, "n_temp", "__test", "n_test").drop("__test")
    else:
        counts = counts.withColumn("n_test", F.col("n_temp"))
    return counts.drop("__temp")


def repeated_splits(df: DataFrame, val: float, test: float, n_splits: int, seed_start: int = 0, stratum: str = "stratum", id_col: str = "id", y: str | None = None) -> DataFrame:
    """(id, seed, split, stratum[, y]) for n_splits seeds in one job.

    In hash order inside (seed, stratum) the first rows are TEST, the next VAL,
    the rest TRAIN.  One order serves both cuts, and rows are only compared with
    the two cuts: seeds x rows are neither shuffled nor sorted.
    """
    alloc = split_allocation(df, stratum, val, test)
    seeds = F.explode(F.sequence(F.lit(seed_start), F.lit(seed_start + n_splits - 1))).alias("seed")
    rows = df.select(F.col(id_col).alias("id"), stratum, *([y] if y else []), id_digest(id_col).alias("__digest"))
    rows = spread(rows).select("*", seeds)
    limits = alloc.select(stratum, F.col("n_test").alias("__in_test"), F.col("n_temp").alias("__in_temp"), seeds)
    both = hash_within(rows, ["seed", stratum], "id", F.col("seed"), limits, ["__in_test", "__in_temp"], digest="__digest")
    split = F.when(F.col("__in_test"), "TEST").when(F.col("__in_temp"), "VAL").otherwise("TRAIN")
    return both.select("id", "seed", split.alias("split"), stratum, *([y] if y else []))


def stratified_split(df: DataFrame, val: float, test: float, seed: int, stratum: str = "stratum", id_col: str = "id", y: str | None = None) -> DataFrame:
    return repeated_splits(df, val, test, 1, seed, stratum, id_col, y)


def split_size_check(assign: DataFrame, y: str = "y", keys: Sequence[str] = ("seed",)) -> DataFrame:
    """Splits with fewer than 2 cases or 2 controls."""
    s = split_summary(assign, [*keys, "split"], y)
    return s.withColumn("valid", (F.col("n_pos") >= 2) & (F.col("n") - F.col("n_pos") >= 2))


def split_summary(assign: DataFrame, keys: Sequence[str] = ("seed", "split"), y: str = "y") -> DataFrame:
    """Rows, positives and prevalence per split."""
    out = assign.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("n_pos"))
    return out.withColumn("prevalence", ratio(F.col("n_pos"), F.col("n")))


def target_prevalence(assign: DataFrame, source: str, fixed: float | None = None, keys: Sequence[str] = ("seed",), y: str = "y") -> DataFrame:
    """Prevalence to adjust to: a fixed value or that of one split."""
    if source == "fixed":
        if fixed is None or not 0 < fixed < 1:
            raise ValueError("a fixed prevalence in (0, 1) is required")
        val: Column = F.max(F.lit(float(fixed)))
    else:
        val = F.avg(F.when(F.col("split") == source.upper(), F.col(y).cast("double")))
    return assign.groupBy(*keys).agg(val.alias("target_prevalence"))


def order_value(df: DataFrame, col: str) -> tuple[Column, str]:
    """Timestamp if the column holds any readable date, else a number."""
    kind = dict(df.dtypes)[col]
    if kind.startswith("timestamp") or kind == "date":
        return F.col(col).cast("timestamp"), "time"
    text = F.col(col).cast("string")
    ts = F.try_to_timestamp(text)
    if not df.filter(ts.isNotNull()).select(F.lit(1)).isEmpty():
        return ts, "time"
    return text.try_cast("double"), "number"


def temporal_order(df: DataFrame, col: str, id_col: str = "id", name: str = "position", *, limit: int | None = None) -> DataFrame:
    """Global chronological position; missing values first, ties by id."""
    val, _ = order_value(df, col)
    rows = df.withColumn("__t", val)
    return ordinal_rank(rows, [], [F.col("__t").asc_nulls_first(), F.col(id_col).asc()], name, limit=limit).drop("__t")


def temporal_split(df: DataFrame, col: str, val: float, test: float, id_col: str = "id", *, limit: int | None = None) -> DataFrame:
    """First rows TRAIN, next VAL, last TEST by time; at least one test and one training row."""
    pos = temporal_order(df, col, id_col, limit=limit)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    nt = F.greatest(F.lit(1), F.bround(F.lit(float(test)) * F.col("__n"), 0)).cast("bigint")
    nv = F.bround(F.lit(float(val)) * F.col("__n"), 0).cast("bigint") if val and val > 0 else F.lit(0)
    sizes = n.withColumn("__nt", nt).withColumn("__nv", F.greatest(F.lit(0), F.least(nv, F.col("__n") - F.col("__nt") - 1)))
    both = pos.join(F.broadcast(sizes), F.lit(True), "inner")  # one row
    split = F.when(F.col("position") > F.col("__n") - F.col("__nt"), "TEST").when(F.col("position") > F.col("__n") - F.col("__nt") - F.col("__nv"), "VAL").otherwise("TRAIN")
    return both.select(F.col(id_col).alias("id"), "position", split.alias("split"))


def downsample_controls(df: DataFrame, ratio_: float | None, seed: int, keys: Sequence[str] = (), id_col: str = "id", outcome: str = "outcome", cases: Sequence[str] = (INCIDENT,), controls: str = CONTROL) -> DataFrame:
    """All rows that are not controls, and round(cases x ratio) controls in hash order.

    No-op for a missing ratio, no cases, or fewer controls than the target.
    """
    if ratio_ is None or ratio_ <= 0:
        return df
    keys = list(keys)
    rows = df.withColumn("__c", F.coalesce(F.col(outcome) == controls, F.lit(False)))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.col(outcome).isin(*cases), 1).otherwise(0)).alias("__cases"))
    target = F.when(F.col("__cases") > 0, F.bround(F.col("__cases") * F.lit(float(ratio_)), 0).cast("bigint")).otherwise(F.col("__n"))
    both_kinds = F.array(F.struct(F.lit(True).alias("__c"), target.alias("__keep")), F.struct(F.lit(False).alias("__c"), F.col("__n").alias("__keep")))
    out = hash_within(rows, [*keys, "__c"], id_col, seed, n.select(*keys, F.inline(both_kinds)), ["__keep"])
    return out.filter("__keep").drop("__c", "__keep")


def _each(df: DataFrame, column: str):
    """Generator of the distinct values of a column, a short list such as seeds."""
    kind = df.schema[column].dataType
    values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]).cast(ArrayType(kind))).alias(column)


def add_prevalent_to_train(assign: DataFrame, subjects: DataFrame, frac: float, seed: int, id_col: str = "id", outcome: str = "outcome") -> DataFrame:
    """TRAIN rows for max(1, round(frac n)) prevalent cases under every seed of ``assign``."""
    prev = subjects.filter(F.col(outcome) == PREVALENT).select(F.col(id_col).alias("id"))
    if frac <= 0:
        return assign.select("id", "seed", "split")
    seeds = _each(assign, "seed")
    rows = prev.select("id", seeds)
    if frac < 1:
        n = prev.agg(F.count(F.lit(1)).alias("__n"))
        keep = F.least(F.col("__n"), F.greatest(F.lit(1), F.bround(F.lit(float(frac)) * F.col("__n"), 0).cast("bigint")))
        limits = n.select(seeds, keep.alias("__keep"))
        rows = hash_within(rows, ["seed"], "id", F.col("seed"), limits, ["__keep"], salt=[F.lit(f"prev{seed}")]).filter("__keep")
    return assign.select("id", "seed", "split").unionByName(rows.select("id", "seed", F.lit("TRAIN").alias("split")))


def create_holdout(df: DataFrame, frac: float, stratum: str = "stratum", id_col: str = "id", seed: int = 42, time_col: str | None = None, *, limit: int | None = None) -> DataFrame:
    """(id, split) with HOLDOUT and DEV: stratified, or the last rows in time."""
    if time_col:
        a = temporal_split(df, time_col, 0.0, frac, id_col, limit=limit)
    else:
        a = stratified_split(df, 0.0, frac, seed, stratum, id_col)
    return a.select("id", F.when(F.col("split") == "TEST", "HOLDOUT").otherwise("DEV").alias("split"))


def development_rows(df: DataFrame, holdout: DataFrame, id_col: str = "id") -> DataFrame:
    """Everything outside the locked holdout."""
    return df.join(holdout.filter("split = 'HOLDOUT'").select(F.col("id").alias("__h")), F.col(id_col) == F.col("__h"), "left_anti")


STRATEGIES = {
    "incident_only": (INCIDENT,),
    "incident_prevalent": (INCIDENT, PREVALENT),
    "prevalent_only": (PREVALENT,),
}


def training_population(df: DataFrame, outcome: str = "outcome", strategies: Sequence[str] = tuple(STRATEGIES)) -> DataFrame:
    """Rows repeated per training strategy that uses them, with the label y."""
    arr = F.array(*[
        F.when(F.col(outcome).isin(CONTROL, *STRATEGIES[s]), F.struct(F.lit(s).alias("strategy"), F.col(outcome).isin(*STRATEGIES[s]).cast("int").alias("y")))
        for s in strategies
    ])
    return df.select("*", F.inline(F.filter(arr, lambda x: x.isNotNull())))


def cv_folds(df: DataFrame, k: int, repeats: int, seed: int, y: str = "y", keys: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """(keys, id, y, repeat, fold): every row in one test fold per repeat, classes balanced."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    rows = df.select(*keys, F.col(id_col).alias("id"), y, rep)
    ranked = hash_rank(rows, [*keys, "repeat", y], "id", seed, "__rn", salt=["repeat"])
    return ranked.select(*keys, "id", y, "repeat", ((F.col("__rn") - 1) % k).cast("int").alias("fold"))


def class_weights(df: DataFrame, scheme: str, keys: Sequence[str] = (), y: str = "y", floor: bool = True) -> DataFrame:
    """Row weights: none, balanced n/(2 n_class), sqrt or log of the class ratio.

    ``floor`` keeps the positive weight of sqrt and log at 1 or more.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__n1"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("__n0")
    )
    r = F.try_divide("__n0", "__n1")
    total = F.col("__n0") + F.col("__n1")
    if scheme == "none":
        pos = neg = F.lit(1.0)
    elif scheme == "balanced":
        pos = total / (2.0 * F.greatest(F.col("__n1"), F.lit(1)))
        neg = total / (2.0 * F.greatest(F.col("__n0"), F.lit(1)))
    elif scheme in ("sqrt", "log"):
        w = F.sqrt(r) if scheme == "sqrt" else F.log(r)
        pos, neg = F.when(F.col("__n1") == 0, F.lit(1.0)).otherwise(F.greatest(w, F.lit(1.0)) if floor else w), F.lit(1.0)
    else:
        raise ValueError(f"unknown weight scheme {scheme}")
    return join_on(df, n, keys).withColumn("weight", F.when(F.col(y) == 1, pos).otherwise(neg)).drop("__n0", "__n1")


def positive_scale(df: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """max(1, negatives / positives) per key, for boosted trees."""
    r = ratio(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)))
    return df.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.coalesce(r, F.lit(1.0))).alias("scale_pos_weight"))


def _take(df: DataFrame, group: Sequence[str], limits: DataFrame, seed: int, id_col: str) -> DataFrame:
    return hash_within(df, group, id_col, seed, limits, ["__take"]).filter("__take").drop("__take")


def subsample_balanced(df: DataFrame, max_rows: int, seed: int, y: str = "y", id_col: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Up to half the rows positive, the rest negative; all rows when they fit."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"))
    pos = F.least(F.lit(max_rows // 2), F.col("n1"))
    fits = F.col("n") <= max_rows
    take = F.array(
        F.struct(F.lit(1).alias(y), F.when(fits, F.col("n")).otherwise(pos).cast("bigint").alias("__take")),
        F.struct(F.lit(0).alias(y), F.when(fits, F.col("n")).otherwise(F.lit(max_rows) - pos).cast("bigint").alias("__take")),
    )
    return _take(df, [*keys, y], n.select(*keys, F.inline(take)), seed, id_col)


def background_sample(df: DataFrame, strategy: str, n: int, seed: int, y: str = "y", id_col: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Reference rows: random, controls first (filled from the rest), or in class proportion."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0"))
    if strategy == "random":
        return _take(df, keys, size.select(*keys, F.least(F.lit(n), F.col("n")).alias("__take")), seed, id_col)
    if strategy == "controls_only":
        rest = F.least(F.lit(n), F.col("n")) - F.least(F.lit(n), F.col("n0"))
        take = F.array(
            F.struct(F.lit(0).alias(y), F.least(F.lit(n), F.col("n0")).cast("bigint").alias("__take")),
            F.struct(F.lit(1).alias(y), rest.cast("bigint").alias("__take")),
        )
    elif strategy == "stratified":
        want = F.least(F.lit(n), F.col("n"))
        share = lambda c: F.greatest(F.lit(1), F.floor(want * c / F.col("n"))).cast("bigint")
        take = F.array(
            F.struct(F.lit(0).alias(y), share(F.col("n0")).alias("__take")), F.struct(F.lit(1).alias(y), share(F.col("n") - F.col("n0")).alias("__take"))
        )
    else:
        raise ValueError(f"unknown background strategy {strategy}")
    return _take(df, [*keys, y], size.select(*keys, F.inline(take)), seed, id_col)


def factorial_sample(df: DataFrame, design: DataFrame, id_col: str = "id", outcome: str = "outcome") -> DataFrame:
    """Rows of each design cell (cell, seed, n_cases, ratio, prevalent_frac).

    One hash order per (seed, outcome pool) serves all cells that share a seed:
    the rows any cell needs are cut out first, and only those are ranked.
    """
    pools = F.array(
        F.struct(F.lit(INCIDENT).alias(outcome), F.col("n_cases").cast("bigint").alias("__take")),
        F.struct(F.lit(PREVALENT).alias(outcome), F.bround(F.col("prevalent_frac") * F.col("n_cases"), 0).cast("bigint").alias("__take")),
        F.struct(F.lit(CONTROL).alias(outcome), (F.col("ratio") * F.col("n_cases")).cast("bigint").alias("__take")),
    )
    wanted = design.select("cell", "seed", F.inline(pools))
    most = wanted.groupBy("seed", outcome).agg(F.max("__take").alias("__most"))
    rows = df.filter(F.col(outcome).isin(CONTROL, INCIDENT, PREVALENT)).select("*", _each(design, "seed"))
    used = hash_within(rows, ["seed", outcome], id_col, F.col("seed"), most, ["__most"]).filter("__most").drop("__most")
    ranked = hash_rank(used, ["seed", outcome], id_col, F.col("seed"), "__rn")
    both = join_on(ranked, wanted, ["seed", outcome])
    return both.filter(F.col("__rn") <= F.col("__take")).select("cell", "seed", F.col(id_col).alias("id"), outcome)


def split_metadata(assign: DataFrame, filters: DataFrame | None = None, y: str = "y", keys: Sequence[str] = ("seed", "split")) -> DataFrame:
    """Per split: rows, positives, prevalence and id digest, with the filter counts of the run."""
    from .cohort import split_id

    out = join_on(split_summary(assign, keys, y), split_id(assign, keys).drop("n"), keys)
    return out.join(F.broadcast(filters), F.lit(True), "inner") if filters is not None else out  # one row
