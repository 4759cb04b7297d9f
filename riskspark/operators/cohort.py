"""Subject tables: column roles, row filters, validation, summaries, fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core.keys import join_on, ratio

CONTROL, INCIDENT, PREVALENT = "Controls", "Incident", "Prevalent"
LABELS = (CONTROL, INCIDENT, PREVALENT)

# Scenario -> (labels kept, positive labels)
SCENARIOS = {
    "IncidentOnly": ((CONTROL, INCIDENT), (INCIDENT,)),
    "PrevalentOnly": ((CONTROL, PREVALENT), (PREVALENT,)),
    "IncidentPlusPrevalent": (LABELS, (INCIDENT, PREVALENT)),
}
NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def resolve_columns(
    columns: Sequence[str],
    *,
    id_col: str = "id",
    outcome: str = "outcome",
    date: str | None = "event_date",
    suffix: str = "_resid",
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    default_numeric: Sequence[str] = ("age", "bmi"),
    default_categorical: Sequence[str] = ("sex", "site"),
) -> dict[str, list[str]]:
    """Column roles from names only.  Explicit metadata must exist, defaults may be absent."""
    have = set(columns)
    for c in (id_col, outcome):
        if c not in have:
            raise ValueError(f"missing required column {c}")
    for given in (numeric, categorical):
        lost = [c for c in given or () if c not in have]
        if lost:
            raise ValueError(f"metadata columns not in the table: {lost}")
    features = [c for c in columns if c.endswith(suffix)]
    if not features:
        raise ValueError(f"no feature column ends with {suffix}")
    return {
        "required": [id_col, outcome], "date": [date] if date in have else [],
        "numeric": list(numeric) if numeric is not None else [c for c in default_numeric if c in have],
        "categorical": list(categorical) if categorical is not None else [c for c in default_categorical if c in have],
        "features": features,
    }


def uncertain_control(outcome: str = "outcome", date: str = "event_date") -> Column:
    return (F.col(outcome) == CONTROL) & F.col(date).isNotNull()


def missing_numeric(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return out


def apply_row_filters(df: DataFrame, numeric: Sequence[str] = ("age", "bmi"), outcome: str = "outcome", date: str = "event_date", drop_uncertain: bool = True, drop_missing: bool = True) -> DataFrame:
    """Drop controls with a diagnosis date, then rows lacking numeric metadata."""
    keep = F.lit(True)
    if drop_uncertain and date in df.columns:
        keep = keep & ~F.coalesce(uncertain_control(outcome, date), F.lit(False))
    cols = [c for c in numeric if c in df.columns]
    if drop_missing and cols:
        keep = keep & ~missing_numeric(cols)
    return df.filter(keep)


def row_filter_counts(df: DataFrame, numeric: Sequence[str] = ("age", "bmi"), outcome: str = "outcome", date: str = "event_date", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in, removed by each rule in order, rows out: one aggregate."""
    a = F.coalesce(uncertain_control(outcome, date), F.lit(False))
    b = missing_numeric([c for c in numeric if c in df.columns])
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_in"), one(a).alias("n_removed_uncertain_controls"),
        one(~a & b).alias("n_removed_missing_numeric"), one(~a & ~b).alias("n_out"),
    )


def scenario_filter(df: DataFrame, scenario: str, outcome: str = "outcome", y: str = "y") -> DataFrame:
    """Keep a scenario's labels and derive the binary label."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario}; one of {sorted(SCENARIOS)}")
    keep, pos = SCENARIOS[scenario]
    return df.filter(F.col(outcome).isin(*keep)).withColumn(y, F.col(outcome).isin(*pos).cast("int"))


def scenario_label_report(df: DataFrame, scenario: str, outcome: str = "outcome") -> DataFrame:
    """Counts per label with its role in the scenario; unknown and absent labels are visible."""
    keep, pos = SCENARIOS[scenario]
    seen = df.groupBy(F.col(outcome).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = df.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    both = seen.join(F.broadcast(known.withColumn("known", F.lit(True))), "label", "full_outer")
    role = F.when(F.col("known").isNull(), "unknown").when(F.col("label").isin(*pos), "positive").when(F.col("label").isin(*keep), "negative").otherwise("dropped")
    return both.select("label", F.coalesce("n", F.lit(0)).alias("n"), role.alias("role"))


def validate_subjects(df: DataFrame, outcome: str = "outcome", required: Sequence[str] = ("id", "outcome"), numeric: Sequence[str] = ("age", "bmi")) -> DataFrame:
    """One row of violation counts; column problems are found from the schema alone."""
    types = dict(df.dtypes)
    lost = [c for c in required if c not in types]
    textual = [c for c in numeric if c in types and types[c] not in NUMERIC_TYPES]
    known = F.col(outcome).isin(*LABELS)
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.coalesce(known, F.lit(False)), 0).otherwise(1)).alias("n_unknown_label"),
        F.sum(F.when(F.col(outcome) == CONTROL, 1).otherwise(0)).alias("n_controls"),
        F.sum(F.when(F.col(outcome).isin(INCIDENT, PREVALENT), 1).otherwise(0)).alias("n_cases"),
    )
    ok = (F.col("n_unknown_label") == 0) & (F.col("n_controls") > 0) & (F.col("n_cases") > 0) & F.lit(not lost and not textual)
    return agg.withColumns({
        "missing_columns": F.lit(",".join(lost)), "non_numeric_columns": F.lit(",".join(textual)), "valid": ok,
    })


def validate_binary(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with a label other than 0, 1 or NULL, and their values."""
    return df.filter(F.col(y).isNotNull() & ~F.col(y).isin(0, 1)).groupBy(*keys, F.col(y).alias("bad_label")).agg(F.count(F.lit(1)).alias("n"))


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Cast to double; unreadable values become NULL."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def fill_missing_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in cols})


def feature_quality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Non-numeric and missing values per feature, worst first; one pass over the columns."""
    types = dict(df.dtypes)

    def counts(c: str) -> list[Column]:
        if types[c] in NUMERIC_TYPES:
            v, bad = F.col(c).cast("double"), F.lit(0)
        else:
            v = F.col(c).cast("string").try_cast("double")
            bad = F.sum(F.when(F.col(c).isNotNull() & v.isNull(), 1).otherwise(0))
        return [bad.alias("non_numeric"), F.sum(F.when(v.isNull() | F.isnan(v), 1).otherwise(0)).alias("missing")]

    structs = [F.struct(F.lit(c).alias("feature"), *[x.cast("bigint").alias(n) for x, n in zip(counts(c), ("n_non_numeric", "n_missing"))]) for c in features]
    return df.agg(F.array(*structs).alias("a"), F.count(F.lit(1)).alias("n_rows")).select(F.inline("a"), "n_rows").orderBy(F.desc("n_missing"), F.desc("n_non_numeric"), "feature")


def data_stats(df: DataFrame, outcome: str = "outcome", suffix: str = "_resid", metadata: Sequence[str] = ("age", "bmi", "sex")) -> DataFrame:
    """Rows, columns, features, outcome counts and missing metadata in one row."""
    miss = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"missing_{c}") for c in metadata if c in df.columns]
    labels = [F.sum(F.when(F.col(outcome) == x, 1).otherwise(0)).alias(f"n_{x.lower()}") for x in LABELS]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *labels, *miss).withColumns({
        "n_columns": F.lit(len(df.columns)), "n_features": F.lit(sum(c.endswith(suffix) for c in df.columns)),
    })


def category_breakdown(df: DataFrame, keys: Sequence[str] = (), outcome: str = "category") -> DataFrame:
    one = lambda x: F.sum(F.when(F.col(outcome) == x, 1).otherwise(0)).alias(f"n_{x.lower()}")
    return df.groupBy(*keys).agg(*[one(x) for x in LABELS], F.count(F.lit(1)).alias("n_total"))


def dataset_fingerprint(df: DataFrame, scenario: str, seeds: Sequence[int] = (), extra: str = "", outcome: str = "outcome") -> DataFrame:
    """Stable 16-hex digest of rows, positives, prevalence, columns, label column, scenario and seeds."""
    rows = scenario_filter(df, scenario, outcome, "__y")
    cols = F.substring(F.sha2(F.lit(",".join(sorted(df.columns))), 256), 1, 12)
    agg = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("__y").cast("bigint")).alias("n_positive"))
    agg = agg.withColumn("prevalence", F.round(F.coalesce(ratio(F.col("n_positive"), F.col("n_rows")), F.lit(0.0)), 6))
    millionths = F.round(F.col("prevalence") * 1_000_000).cast("bigint")
    text = F.concat_ws("|", F.col("n_rows"), F.col("n_positive"), millionths, cols, F.lit(outcome), F.lit(scenario), F.lit(",".join(map(str, sorted(seeds)))), F.lit(extra))
    return agg.withColumn("fingerprint", F.substring(F.sha2(text, 256), 1, 16))


def split_id(assign: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Order-free digest of the id set of each split: count, sum and xor of hashed ids.

    No id list is ever collected, so a split of any size costs one aggregate.
    """
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    agg = assign.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("__s"), F.bit_xor(h).alias("__x"))
    text = F.concat_ws(":", F.col("n"), F.col("__s"), F.col("__x"))
    return agg.select(*keys, "n", F.substring(F.md5(text), 1, 12).alias("split_id"))


def restrict_to_panel(df: DataFrame, panel: Sequence[str], metadata: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Panel features plus metadata, and the panel features the table lacks."""
    have = set(df.columns)
    return df.select(*[c for c in metadata if c in have], *[c for c in panel if c in have]), [c for c in panel if c not in have]


def restrict_long_to_panel(long: DataFrame, panel: DataFrame, feature: str = "feature") -> DataFrame:
    """Long form: keep the features named in a panel table."""
    return long.join(panel.select(feature).distinct(), feature, "left_semi")


def significant_models(rows: DataFrame, tests: DataFrame, alpha: float = 0.05, model: str = "model", p: str = "p_value", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the models whose aggregated test is significant."""
    good = tests.filter(F.col(p) < F.lit(alpha)).select(*keys, model).distinct()
    return join_on(rows, good, [*keys, model], "left_semi")


def split_integrity(assign: DataFrame, subjects: DataFrame, keys: Sequence[str] = ("seed",), id_col: str = "id", split: str = "split") -> DataFrame:
    """Per key: empty train/test, ids in several splits, ids unknown to the subject table."""
    per_id = assign.groupBy(*keys, id_col).agg(
        F.count_distinct(split).alias("__k"), F.max(F.when(F.col(split) == "TRAIN", 1).otherwise(0)).alias("__tr"),
        F.max(F.when(F.col(split) == "TEST", 1).otherwise(0)).alias("__te"),
    )
    known = subjects.select(F.col(id_col).alias("__id")).distinct().withColumn("__known", F.lit(True))
    rows = per_id.join(known, F.col(id_col) == F.col("__id"), "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy(*keys).agg(
        one(F.col("__tr") == 1).alias("n_train"), one(F.col("__te") == 1).alias("n_test"),
        one(F.col("__k") > 1).alias("n_overlap"), one(F.col("__known").isNull()).alias("n_unknown"),
    )
    return out.withColumn("valid", (F.col("n_train") > 0) & (F.col("n_test") > 0) & (F.col("n_overlap") == 0) & (F.col("n_unknown") == 0))


def leakage_check(assign: DataFrame, subjects: DataFrame, keys: Sequence[str] = ("seed",), id_col: str = "id", outcome: str = "outcome") -> DataFrame:
    """Prevalent cases found in VAL or TEST per key; must be 0."""
    prev = subjects.filter(F.col(outcome) == PREVALENT).select(id_col).distinct().withColumn("__prev", F.lit(1))
    rows = join_on(assign, prev, [id_col], "left")
    bad = F.col("split").isin("VAL", "TEST") & F.col("__prev").isNotNull()
    return rows.groupBy(*keys).agg(F.sum(F.when(bad, 1).otherwise(0)).alias("n_leaked"))
