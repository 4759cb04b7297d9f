"""Subject, scored and result tables derived from the supplied Parquet tables.

Each has a DataFrame form and the same rows as SQL text, so that operators can
be compared between engines on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.order import hash_order
from ..core.tails import ERFC_COEFFICIENTS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def h_sql(seed: int | str, *cols: str) -> str:
    """SQL twin of ``hash_order``."""
    args = ", ".join(f"cast({c} as varchar)" for c in cols)
    head = f"'{seed}'" if not str(seed).startswith("(") else f"cast({seed} as varchar)"
    return f"cast('0x' || substr(md5(concat_ws(':', {head}, {args})), 1, 8) as bigint)"


def normal_sf_sql(z: str) -> str:
    """SQL twin of ``normal_sf`` for a column name."""
    x = f"({z} / 1.4142135623730951e0)"
    t = f"(1e0 / (1e0 + 0.5e0 * abs({x})))"
    poly = f"{ERFC_COEFFICIENTS[-1]!r}e0"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    tail = f"({t} * exp(-{x} * {x} + {poly}))"
    return f"(0.5e0 * (case when {x} >= 0 then {tail} else 2e0 - {tail} end))"


def two_sided_sql(z: str) -> str:
    return f"least(1e0, 2e0 * {normal_sf_sql(f'abs({z})')})"


# ---------------------------------------------------------------- subjects
def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as a subject table: outcome, demographic stand-ins, features."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    words = F.split("text", " ")
    outcome = F.when(F.col("toxic") == 1, "Prevalent").when(F.col("quality") == 0, "Incident").otherwise("Controls")
    return d.select(
        F.col("doc_id").alias("id"), outcome.alias("outcome"), F.col("lang").alias("sex"), F.col("source").alias("site"),
        F.least(F.lit(150.0), F.sqrt(F.col("n_chars").cast("double"))).alias("age"),
        F.when(F.col("n_chars") % 17 != 0, F.col("n_chars") / 100.0).cast("double").alias("bmi"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("2020-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
        .when(F.col("doc_id") % 23 == 0, "2021-06-30").alias("event_date"),
        (F.lit(1.0) - F.size(F.array_distinct(words)) / F.size(words)).alias("repeat_resid"),
        (F.lit(1.0) - F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("symbol_resid"),
        (F.lit(2000.0) / (F.col("n_chars") + 2000)).alias("brevity_resid"),
        (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).cast("double").alias("lines_resid"),
        (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).cast("double").alias("digits_resid"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("double").alias("upper_resid"),
    )


FEATURES = ["repeat_resid", "symbol_resid", "brevity_resid", "lines_resid", "digits_resid", "upper_resid"]

SUBJECTS = """subjects AS (
  SELECT doc_id AS id,
    CASE WHEN toxic = 1 THEN 'Prevalent' WHEN quality = 0 THEN 'Incident' ELSE 'Controls' END AS outcome,
    lang AS sex, source AS site, least(150e0, sqrt(cast(n_chars AS double))) AS age,
    CASE WHEN n_chars % 17 <> 0 THEN n_chars / 100e0 END AS bmi,
    CASE WHEN toxic = 1 THEN '2020-01-' || lpad(cast(doc_id % 28 + 1 AS varchar), 2, '0')
         WHEN doc_id % 23 = 0 THEN '2021-06-30' END AS event_date,
    1e0 - len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) AS repeat_resid,
    1e0 - length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1) AS symbol_resid,
    2000e0 / (n_chars + 2000) AS brevity_resid,
    cast(length(text) - length(regexp_replace(text, '\\n', '', 'g')) AS double) AS lines_resid,
    cast(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS double) AS digits_resid,
    cast(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS double) AS upper_resid
  FROM documents JOIN labels USING (doc_id))"""


def long_features(spark: SparkSession, sf: str) -> DataFrame:
    """(id, y, feature, x): one row per subject and feature; y = not a control."""
    s = subjects(spark, sf)
    y = (F.col("outcome") != "Controls").cast("int").alias("y")
    return s.select("id", y, *FEATURES).unpivot(["id", "y"], FEATURES, "feature", "x")


LONG = SUBJECTS + """,
long AS (
  SELECT id, cast(outcome <> 'Controls' AS int) AS y, feature, x FROM subjects
  UNPIVOT (x FOR feature IN (""" + ", ".join(FEATURES) + """)))"""


# ------------------------------------------------------------- scored rows
def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored by three models: id, model, split_seed, split, y_true, y_prob, category."""
    s = subjects(spark, sf)
    fold = hash_order("split", "id") % 10
    models = F.array(
        F.struct(F.lit("repeat").alias("model"), F.col("repeat_resid").alias("y_prob")),
        F.struct(F.lit("symbol").alias("model"), F.col("symbol_resid").alias("y_prob")),
        F.struct(F.lit("brevity").alias("model"), F.col("brevity_resid").alias("y_prob")),
    )
    return s.select(
        "id", (hash_order("seed", "id") % 4).cast("int").alias("split_seed"),
        F.when(fold < 5, "TRAIN").when(fold < 8, "VAL").otherwise("TEST").alias("split"),
        (F.col("outcome") == "Incident").cast("int").alias("y_true"), F.col("outcome").alias("category"), F.inline(models),
    )


SCORED = SUBJECTS + f""",
scored AS (
  SELECT id, cast({h_sql('seed', 'id')} % 4 AS int) AS split_seed,
    CASE WHEN {h_sql('split', 'id')} % 10 < 5 THEN 'TRAIN' WHEN {h_sql('split', 'id')} % 10 < 8 THEN 'VAL' ELSE 'TEST' END AS split,
    cast(outcome = 'Incident' AS int) AS y_true, outcome AS category, model, y_prob
  FROM (SELECT *, 'repeat' AS model, repeat_resid AS y_prob FROM subjects
        UNION ALL SELECT *, 'symbol', symbol_resid FROM subjects
        UNION ALL SELECT *, 'brevity', brevity_resid FROM subjects) AS u)"""


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a large scored table: returned or not against a price score."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("split_seed"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        (F.col("l_extendedprice") / (F.col("l_extendedprice") + F.lit(40000.0) * (F.lit(1.0) + F.col("l_discount")))).alias("y_prob"),
    )


LINES = """lines AS (
  SELECT l_linestatus AS model, l_linenumber AS split_seed, cast(l_returnflag = 'R' AS int) AS y_true,
    l_extendedprice / (l_extendedprice + 40000e0 * (1e0 + l_discount)) AS y_prob FROM lineitem)"""


def points_sql(src: str, keys: str, p: str = "y_prob", y: str = "y_true", tag: str = "", w: str = "1") -> str:
    """CTEs hist/pts (suffix ``tag``): curve points of ``src`` per comma-separated keys."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    down = f"({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"
    return f"""hist{tag} AS (
  SELECT {k}{p} + 0e0 AS p, cast(sum({y} * {w}) AS bigint) AS pos, cast(sum((1 - {y}) * {w}) AS bigint) AS neg
  FROM {src} WHERE {p} IS NOT NULL GROUP BY ALL),
pts0{tag} AS (
  SELECT *, cast(sum(pos) OVER {down} AS bigint) AS tp, cast(sum(neg) OVER {down} AS bigint) AS fp,
    cast(sum(pos) OVER ({part}) AS bigint) AS n_pos, cast(sum(neg) OVER ({part}) AS bigint) AS n_neg,
    lead(pos) OVER ({part} ORDER BY p DESC) AS np, lead(neg) OVER ({part} ORDER BY p DESC) AS nn FROM hist{tag}),
pts{tag} AS (
  SELECT *, (tp + fp = pos + neg OR np IS NULL OR np <> pos OR nn <> neg) AS keep,
    CASE WHEN n_pos > 0 THEN tp / n_pos END AS tpr, CASE WHEN n_neg > 0 THEN fp / n_neg END AS fpr,
    tp / (tp + fp) AS prec FROM pts0{tag})"""


TWO = "max(n_pos) > 0 AND max(n_neg) > 0"
AUROC = f"CASE WHEN {TWO} THEN sum(pos * (n_neg - fp + neg / 2e0)) / (cast(max(n_pos) AS double) * max(n_neg)) END"
PRAUC = f"CASE WHEN {TWO} THEN sum(pos / cast(n_pos AS double) * prec) END"
YOUDEN = f"CASE WHEN {TWO} THEN greatest(0e0, max(tpr - fpr)) END"


def sens_sql(target: float) -> str:
    return f"CASE WHEN {TWO} THEN coalesce(max(CASE WHEN keep AND 1e0 - fpr >= {target!r}e0 THEN tpr END), 0e0) END"


def spec_thr_sql(target: float) -> str:
    ok = f"keep AND 1e0 - fpr >= {target!r}e0 AND tp > 0"
    return (f"CASE WHEN {TWO} AND count(CASE WHEN {ok} THEN 1 END) > 0 "
            f"THEN arg_max(p, tp * 1e0 + p / 1e3) FILTER (WHERE {ok}) ELSE max(p) + 1e-12 END")


# -------------------------------------------------------------- result rows
# Exact aggregates (min, max, count) keep ranks and thresholds equal in both
# engines; every table below grows with lineitem, orders or part.
def importances(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows per (model, split_seed): importance, coefficient, |explanation|, selection share."""
    li = table(spark, sf, "lineitem")
    agg = li.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("split_seed"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("feature")).agg(
        F.max("l_extendedprice").alias("x"), F.max("l_discount").alias("d"), F.min("l_tax").alias("t"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(
        "model", "split_seed", "feature", (F.col("x") * F.col("d") / 1e4).alias("importance"), ((F.col("x") - F.col("d") * 1e6) / 1e5).alias("coef"),
        (F.round(F.col("d") * 100) / 16.0).alias("selection_freq"), (F.col("x") / 1e5).alias("effect"), (F.col("t") * 10).alias("p_value"), (F.col("d") >= 0.05).alias("selected"), "n",
    )


IMP = """imp AS (
  SELECT model, split_seed, feature, x * d / 1e4 AS importance, (x - d * 1e6) / 1e5 AS coef, round(d * 100) / 16e0 AS selection_freq, x / 1e5 AS effect, t * 10 AS p_value, d >= 0.05e0 AS selected, n
  FROM (SELECT l_returnflag AS model, l_linenumber AS split_seed, 'p' || l_partkey AS feature, max(l_extendedprice) AS x, max(l_discount) AS d, min(l_tax) AS t, count(*) AS n
        FROM lineitem GROUP BY ALL))"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows per (experiment, model, split_seed)."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("experiment"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("split_seed")).agg(
        (F.max("l_extendedprice") / 1.2e5).alias("auroc"), (F.min("l_extendedprice") / 1e5).alias("brier"), F.max("l_quantity").alias("auprc"),
    )


RUNS = """runs AS (SELECT l_suppkey AS experiment, l_returnflag AS model, l_linenumber AS split_seed, max(l_extendedprice) / 1.2e5 AS auroc,
  min(l_extendedprice) / 1e5 AS brier, max(l_quantity) AS auprc FROM lineitem GROUP BY ALL)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """One tuning trial per order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("split_id"), F.col("o_orderkey").alias("trial_num"),
        (F.col("o_totalprice") / 5e5).alias("auroc"), ((F.col("o_custkey") % 97) / 97.0).cast("double").alias("brier"),
        F.concat(F.lit('{"depth": "'), (F.col("o_custkey") % 11).cast("string"), F.lit('", "loss": "'), F.col("o_orderstatus"), F.lit('"}')).alias("params"),
    )


TRIALS = """trials AS (SELECT o_orderpriority AS model, o_orderstatus AS split_id, o_orderkey AS trial_num, o_totalprice / 5e5 AS auroc, (o_custkey % 97) / 97e0 AS brier,
  '{"depth": "' || (o_custkey % 11) || '", "loss": "' || o_orderstatus || '"}' AS params FROM orders)"""


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """Elimination curves: one score per (experiment, model, seed, size)."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("experiment"), F.col("l_returnflag").alias("model"), (F.year("l_shipdate") - 1990).alias("seed"), (F.col("l_linenumber") * 5).alias("size")).agg(
        (F.lit(0.5) + F.max("l_extendedprice") / 2.5e5).alias("auroc_val"), (F.max("l_quantity") / 100).alias("prauc_val"),
    )


CURVES = """curves AS (SELECT l_suppkey AS experiment, l_returnflag AS model, cast(year(l_shipdate) - 1990 AS int) AS seed, l_linenumber * 5 AS size,
  0.5e0 + max(l_extendedprice) / 2.5e5 AS auroc_val, max(l_quantity) / 100 AS prauc_val FROM lineitem GROUP BY ALL)"""


def mix_sql(name: str, parts: list[str]) -> str:
    """SQL twin of ``power_mix``: a chain of lateral column aliases ending in ``name``."""
    from ..core.order import PRIME, ROUND_CONSTANTS

    out, x = [], "cast(0 AS bigint)"
    for i, part in enumerate(parts):
        s, q, nx = f"{name}s{i}", f"{name}q{i}", f"{name}x{i}"
        out += [f"({x} + cast({part} AS bigint) + {ROUND_CONSTANTS[i % 4]}) % {PRIME} AS {s}", f"({s} * {s}) % {PRIME} AS {q}", f"(({q} * {q}) % {PRIME} * {s}) % {PRIME} AS {nx}"]
        x = nx
    return ", ".join([*out, f"{x} AS {name}"])


def mixed_sql(name: str, seeds: list[str], digest: str) -> str:
    """SQL twin of ``mixed_order``."""
    from ..core.order import PRIME

    return mix_sql(name, [*seeds, f"{digest} % {PRIME}", f"{digest} // {PRIME}"])


def digest_sql(*cols: str) -> str:
    """SQL twin of ``id_digest``."""
    args = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws(':', {args})), 1, 15) as bigint)"


def draws_sql(src: str, by: str, id_col: str, n_boot: int, seed: int, cols: str) -> str:
    """CTEs ix (indexed rows) and wts (by, b, target, weight) for a bootstrap of ``src``."""
    from ..core.order import PRIME

    part = f"PARTITION BY {by}" if by else ""
    k = f"{by}, " if by else ""
    return f"""ix AS (SELECT {k}{id_col}, {cols}, row_number() OVER ({part} ORDER BY {h_sql(seed, id_col)}, {id_col}) - 1 AS idx, count(*) OVER ({part}) AS n_grp FROM {src}),
    slots AS (SELECT {k}b, n_grp, {mix_sql('u', [str(seed), 'b', f'idx % {PRIME}', f'idx // {PRIME}'])}, {mix_sql('v', ['u'])}, (u * {PRIME} + v) % n_grp AS target
      FROM ix, (SELECT unnest(range({n_boot})) AS b)),
    wts AS (SELECT {k}b, target, count(*) AS weight FROM slots GROUP BY ALL)"""


# ---------------------------------------------------------------- embeddings as features
def embedding_long(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("y"), F.posexplode("embedding").alias("k", "v")).select(
        "id", "y", F.concat(F.lit("e"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("feature"), F.col("v").cast("double").alias("x")
    )


EMB = """emb AS (SELECT vec_id AS id, cast(label >= 5 AS int) AS y, 'e' || lpad(cast(i - 1 AS varchar), 2, '0') AS feature, cast(embedding[i] AS double) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
EMB_FEATURES = [f"e{i:02d}" for i in range(64)]


def embedding_wide(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(EMB_FEATURES)])
