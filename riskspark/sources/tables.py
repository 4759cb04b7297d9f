"""Readers and writers of subject, score, metric, split and result tables.

Keys that a result tree encodes in its folder names (run, model, seed) are read
back as columns; one multi-path read replaces walking the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..core.keys import join_on
from ..functions.scalar import json_map
from ..operators.cohort import resolve_columns

SCORED_SCHEMA = "id BIGINT, y_true INT, y_prob DOUBLE, y_prob_adjusted DOUBLE, category STRING"
#: Columns of result tables that are text; all others are numbers, so no second scan is needed to tell.
TEXT_COLUMNS = {"scenario", "model", "split", "feature", "run_id", "params", "best_params", "state", "datetime_start", "datetime_complete", "metric", "method", "source_file"}


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header or footer only."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path).columns
    return spark.read.parquet(path).columns


def read_subjects(spark: SparkSession, path: str, *, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None, **names) -> DataFrame:
    """Subject table from CSV or Parquet with only the id, outcome, date, metadata and feature columns."""
    roles = resolve_columns(column_names(spark, path), numeric=numeric, categorical=categorical, **names)
    wanted = [c for role in ("required", "date", "numeric", "categorical", "features") for c in roles[role]]
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path).select(*wanted)
    numbers = {*roles["numeric"], *roles["features"]}
    raw = spark.read.option("header", True).csv(path).select(*wanted)
    return raw.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in wanted])


def csv_to_parquet(spark: SparkSession, src: str, dst: str, compression: str = "snappy", **names) -> None:
    read_subjects(spark, src, **names).write.mode("overwrite").option("compression", compression).parquet(dst)


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{what} lacks columns {lost}")
    return df


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (), schema: str | None = None) -> DataFrame:
    """CSV or Parquet with a required-column check; give a schema to avoid inference."""
    if path.rstrip("/").endswith(".parquet"):
        return require(spark.read.parquet(path), required, path)
    names = column_names(spark, path)
    lost = [c for c in required if c not in names]
    if lost:
        raise ValueError(f"{path} lacks columns {lost}")
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    types = dict(part.strip().split(None, 1) for part in schema.split(","))
    raw = reader.csv(path)
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in names])


def read_predictions(spark: SparkSession, path: str, required: Sequence[str] = ("id", "y_true", "y_prob")) -> DataFrame:
    return read_table(spark, path, required, SCORED_SCHEMA)


def as_numbers(df: DataFrame, text: Sequence[str] = ()) -> DataFrame:
    """Text columns as doubles, but for ``TEXT_COLUMNS`` and ``text``; what is no number becomes NULL."""
    keep = {*TEXT_COLUMNS, *text}
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) if t == "string" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes])


def read_metrics(spark: SparkSession, path: str, required: Sequence[str] = ("model",), schema: str | None = None, text: Sequence[str] = ()) -> DataFrame:
    """Metric rows; without a schema all columns but the named text ones are numbers."""
    return as_numbers(read_table(spark, path, required, schema or "model STRING"), text)


def read_feature_report(spark: SparkSession, path: str, schema: str | None = None, text: Sequence[str] = ()) -> DataFrame:
    return as_numbers(read_table(spark, path, ("feature",), schema or "feature STRING"), text)


def write_table(df: DataFrame, path: str, append: bool = False, keys: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Save or append; key columns become folders."""
    w = df.write.mode("append" if append else "overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*keys) if keys else w).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """False only if there is nothing at ``path``; any other failure is raised."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def splits_differ(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("id", "scenario", "seed", "split")) -> DataFrame:
    """Rows in one assignment but not the other; empty when they are equal."""
    cols = [c for c in columns if c in a.columns]
    left, right = a.select(*cols), b.select(*cols)
    return left.exceptAll(right).withColumn("side", F.lit("new")).unionByName(right.exceptAll(left).withColumn("side", F.lit("stored")))


def save_splits(assign: DataFrame, path: str, overwrite: bool = False, keys: Sequence[str] = ("scenario", "seed")) -> str:
    """Store split assignments by key; equal stored splits are reused, different ones are an error.

    With ``overwrite`` only the key folders present in ``assign`` are replaced.
    """
    spark = assign.sparkSession
    if _exists(spark, path) and not overwrite:
        stored = join_on(spark.read.parquet(path), assign.select(*keys).distinct(), keys, "left_semi")
        if not stored.isEmpty():
            if splits_differ(assign, stored).isEmpty():
                return "reused"
            raise ValueError(f"stored splits in {path} differ; pass overwrite=True to replace them")
        assign.write.mode("append").partitionBy(*keys).parquet(path)
        return "written"
    assign.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return "written"


def path_keys(path: Column) -> dict[str, Column]:
    """run, model and split_seed from .../run_X/MODEL/splits/split_seedN/..."""
    return {
        "run_id": F.regexp_extract(path, r"run_([^/]+)/", 1),
        "model": F.regexp_extract(path, r"run_[^/]+/([^/]+)/", 1),
        "split_seed": F.regexp_extract(path, r"split_seed(\d+)", 1).try_cast("int"),
        "source_file": F.regexp_extract(path, r"([^/]+)$", 1),
    }


def collect_tree(spark: SparkSession, pattern: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """One read over a glob of result files, with the keys of their paths.  CSV columns are text unless a schema is given."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("escape", '"')
        df = (r.schema(schema) if schema else r).csv(pattern)
    elif fmt == "json":
        r = spark.read.option("multiLine", True)
        df = (r.schema(schema) if schema else r).json(pattern)
    else:
        df = spark.read.option("mergeSchema", True).parquet(pattern)
    own = {n: c for n, c in path_keys(F.col("_metadata.file_path")).items() if n not in df.columns}
    return df.select("*", *[c.alias(n) for n, c in own.items()])


def collect_predictions(spark: SparkSession, root: str, kind: str = "test", schema: str | None = None, text: Sequence[str] = ("category",)) -> DataFrame:
    return as_numbers(collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/preds/{kind}_preds*.csv", "csv", schema), text)


def collect_metrics(spark: SparkSession, root: str, kind: str = "test", schema: str | None = None, text: Sequence[str] = ()) -> DataFrame:
    return as_numbers(collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/core/{kind}_metrics.csv", "csv", schema), text)


def collect_feature_reports(spark: SparkSession, root: str, schema: str | None = None, text: Sequence[str] = ()) -> DataFrame:
    return as_numbers(collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/panels/*feature_report*.csv", "csv", schema), text)


def collect_trials(spark: SparkSession, root: str, schema: str | None = None, text: Sequence[str] = ()) -> DataFrame:
    return as_numbers(collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/cv/*trials*.csv", "csv", schema), text)


def flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns, names joined by ``sep``; lists of plain values as text joined by ';', other lists as JSON."""

    def leaves(c: Column, kind, name: str):
        if isinstance(kind, StructType):
            for f in kind.fields:
                yield from leaves(c.getField(f.name), f.dataType, f"{name}{sep}{f.name}" if name else f.name)
        elif isinstance(kind, ArrayType):
            plain = not isinstance(kind.elementType, (ArrayType, StructType))
            yield (F.array_join(c.cast("array<string>"), ";") if plain else F.to_json(c)).alias(name)
        else:
            yield c.alias(name)

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def parse_run_id(df: DataFrame, pattern: str, names: Sequence[str], column: str = "run_id") -> DataFrame:
    """Columns from the groups of ``pattern`` in the run id; NULL where it does not match."""
    found = [F.regexp_extract(column, pattern, i + 1) for i in range(len(names))]
    return df.withColumns({n: F.when(c != "", c) for n, c in zip(names, found, strict=True)})


def _found(read, *args) -> DataFrame | None:
    """None if no file matches."""
    try:
        return read(*args)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


#: Parts of a seed's folder and of a model's aggregated folder: prefix -> file.
SEED_PARTS = {"test_": "core/test_metrics.csv", "val_": "core/val_metrics.csv", "config_": "config_metadata.json", "settings_": "core/run_settings.json"}
AGGREGATED_PARTS = {"pooled_test_": "metrics/pooled_test_metrics.csv", "pooled_val_": "metrics/pooled_val_metrics.csv", "summary_": "metrics/test_metrics_summary.csv", "agg_": "aggregation_metadata.json"}


def _compiled(spark: SparkSession, folder: str, parts: dict[str, str], keys: list[str], text: Sequence[str]) -> DataFrame | None:
    out = None
    for prefix, file in parts.items():
        fmt = "json" if file.endswith(".json") else "csv"
        df = _found(collect_tree, spark, f"{folder}/{file}", fmt)
        if df is None:
            continue
        df = df.select(*[c for c in df.columns if c not in ("source_file", "_corrupt_record")])
        # A metric table's own model and scenario columns repeat the path.
        df = flatten_structs(df.drop(*[c for c in ("scenario",) if c in df.columns]))
        if fmt == "csv":
            df = as_numbers(df, text)
        cols = [c for c in df.columns if c not in ("run_id", "model", "split_seed")]
        df = df.select(*keys, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in cols]).dropDuplicates(keys)
        out = df if out is None else out.join(df, keys, "full")
    return out


def compile_run_tree(spark: SparkSession, root: str, seed_parts: dict[str, str] | None = None, aggregated_parts: dict[str, str] | None = None, id_pattern: str | None = None, id_names: Sequence[str] = (), text: Sequence[str] = ()) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows per (run, model, seed) and per (run, model) from a folder of runs: metrics and flattened nested settings side by side.

    Each kind of file is one read over all runs, whose columns are the union of all files'; a file
    that a seed lacks leaves NULLs.  ``id_pattern`` with ``id_names`` takes columns from the run id.  None: no such files.
    """
    seeds = _compiled(spark, f"{root}/run_*/*/splits/split_seed*", seed_parts or SEED_PARTS, ["run_id", "model", "split_seed"], text)
    whole = _compiled(spark, f"{root}/run_*/*/aggregated", aggregated_parts or AGGREGATED_PARTS, ["run_id", "model"], text)
    named = lambda x: x if x is None or not id_pattern else parse_run_id(x, id_pattern, id_names)
    return named(seeds), named(whole)


def ensemble_settings(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, split_seed, model, method, base_models, meta_model_type, meta_model_penalty, meta_model_C) of the stacked models, defaults where a setting is absent."""
    schema = "ensemble STRUCT<method: STRING, base_models: ARRAY<STRING>, meta_model: STRUCT<type: STRING, penalty: STRING, C: DOUBLE>>"
    df = collect_tree(spark, f"{root}/run_*/ENSEMBLE/splits/split_seed*/core/run_settings.json", "json", schema)
    e = lambda c, default: F.coalesce(F.col(f"ensemble.{c}"), F.lit(default))
    return df.select(
        "run_id", "split_seed", F.lit("ENSEMBLE").alias("model"), e("method", "stacking").alias("method"), F.coalesce(F.array_join("ensemble.base_models", ", "), F.lit("")).alias("base_models"),
        e("meta_model.type", "logistic_regression").alias("meta_model_type"), e("meta_model.penalty", "l2").alias("meta_model_penalty"), e("meta_model.C", 1.0).alias("meta_model_C"),
    )


def flatten_params(df: DataFrame, column: str = "params") -> DataFrame:
    """A JSON object per row becomes (param, value) rows; malformed cells give none."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(json_map(column)).alias("param", "value"))


def params_wide(df: DataFrame, params: Sequence[str], keys: Sequence[str], column: str = "params") -> DataFrame:
    """Named parameters of the JSON object as columns."""
    m = json_map(column)
    return df.select(*keys, *[F.try_element_at(m, F.lit(p)).alias(p) for p in params])


def collect_params(spark: SparkSession, root: str, column: str = "best_params") -> DataFrame:
    return flatten_params(collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/cv/best_params*.csv"), column)


def pool_matrices(spark: SparkSession, root: str) -> DataFrame:
    """Per-seed value matrices pooled; a feature a seed lacks is NULL there."""
    return collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/shap/*values*.parquet", "parquet")


def compile_cells(manifest: DataFrame, metrics: DataFrame, on: Sequence[str] = ("cell",), prefix: str = "summary_") -> DataFrame:
    """Factor columns of each cell next to its prefixed metrics; cells without metrics stay, with NULLs."""
    on = list(on)
    renamed = metrics.withColumnsRenamed({c: f"{prefix}{c}" for c in metrics.columns if c not in on})
    return join_on(manifest, renamed, on, "left")


def missing_cells(manifest: DataFrame, metrics: DataFrame, on: Sequence[str] = ("cell",)) -> DataFrame:
    return join_on(manifest, metrics.select(*on).distinct(), list(on), "left_anti")


def compile_runs(seed_metrics: DataFrame, aggregated: DataFrame, keys: Sequence[str] = ("run_id", "model")) -> DataFrame:
    """Per-seed rows with the aggregated metrics of their (run, model) under an ``agg_`` prefix."""
    keys = list(keys)
    agg = aggregated.withColumnsRenamed({c: f"agg_{c}" for c in aggregated.columns if c not in keys})
    return join_on(seed_metrics, agg, keys, "left")


def export_scores(df: DataFrame, variants: dict[str, str], active: str, id_col: str = "id", y: str = "y_true", percentile: bool = True) -> DataFrame:
    """Id, label, one risk column per variant (and x100), and the active variant's risk."""
    if active not in variants:
        raise ValueError(f"active variant {active} not among {sorted(variants)}")
    cols = [F.col(c).alias(f"risk_{v}") for v, c in variants.items()]
    if percentile:
        cols += [(F.col(c) * 100).alias(f"risk_{v}_pct") for v, c in variants.items()]
    return df.select(id_col, y, *cols, F.lit(active).alias("active_variant"), F.col(variants[active]).alias("risk_score"))
