"""Queries over the subject table: filters, checks, strata, splits, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core.keys import join_on
from ..functions import scalar as S
from ..operators import cohort as P
from ..operators import splits as C
from .registry import query
from .tables import FEATURES, LONG, SUBJECTS, digest_sql, h_sql, long_features, mixed_sql, subjects, table

W = f"WITH {SUBJECTS}"
UNC = "coalesce(outcome = 'Controls' AND event_date IS NOT NULL, false)"
MISS = "(age IS NULL OR bmi IS NULL)"


@query("row_filters", f"{W} SELECT id, outcome FROM subjects WHERE NOT {UNC} AND NOT {MISS}")
def _(spark, sf):
    return P.apply_row_filters(subjects(spark, sf)).select("id", "outcome")


@query(
    "row_filter_counts",
    f"""{W} SELECT site, count(*) AS n_in, cast(sum(CASE WHEN {UNC} THEN 1 ELSE 0 END) AS bigint) AS n_removed_uncertain_controls,
    cast(sum(CASE WHEN NOT {UNC} AND {MISS} THEN 1 ELSE 0 END) AS bigint) AS n_removed_missing_numeric,
    cast(sum(CASE WHEN NOT {UNC} AND NOT {MISS} THEN 1 ELSE 0 END) AS bigint) AS n_out FROM subjects GROUP BY ALL""",
)
def _(spark, sf):
    return P.row_filter_counts(subjects(spark, sf), keys=["site"])


@query("scenario_filter", f"{W} SELECT id, outcome, cast(outcome = 'Incident' AS int) AS y FROM subjects WHERE outcome IN ('Controls', 'Incident')")
def _(spark, sf):
    return P.scenario_filter(subjects(spark, sf), "IncidentOnly").select("id", "outcome", "y")


@query(
    "scenario_label_report",
    f"""{W} SELECT label, coalesce(n, 0) AS n, role FROM (VALUES ('Controls', 'negative'), ('Incident', 'positive'), ('Prevalent', 'dropped')) AS k(label, role)
    LEFT JOIN (SELECT outcome AS label, count(*) AS n FROM subjects GROUP BY ALL) USING (label)""",
)
def _(spark, sf):
    return P.scenario_label_report(subjects(spark, sf), "IncidentOnly")


@query(
    "validate_subjects",
    f"""{W}, a AS (SELECT count(*) AS n_rows, count(CASE WHEN outcome NOT IN ('Controls', 'Incident', 'Prevalent') THEN 1 END) AS n_unknown_label,
      count(CASE WHEN outcome = 'Controls' THEN 1 END) AS n_controls, count(CASE WHEN outcome IN ('Incident', 'Prevalent') THEN 1 END) AS n_cases FROM subjects)
    SELECT *, '' AS missing_columns, '' AS non_numeric_columns, n_unknown_label = 0 AND n_controls > 0 AND n_cases > 0 AS valid FROM a""",
)
def _(spark, sf):
    return P.validate_subjects(subjects(spark, sf))


@query("validate_binary", "SELECT l_linestatus AS key, l_linenumber AS bad_label, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (0, 1) GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("key"), F.col("l_linenumber").alias("y"))
    return P.validate_binary(rows, "y", ["key"])


@query("coerce_numeric", "SELECT event_id, try_cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS double) AS k, try_cast(event_type AS double) AS bad FROM events", "k bad")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.regexp_extract("props", r'"k": ([0-9]+)', 1).alias("k"), F.col("event_type").alias("bad"))
    return P.coerce_numeric(ev, ["k", "bad"])


@query("fill_missing_category", f"{W} SELECT id, coalesce(event_date, 'Missing') AS event_date, sex FROM subjects")
def _(spark, sf):
    return P.fill_missing_category(subjects(spark, sf).select("id", "event_date", "sex"), ["event_date", "sex"])


@query(
    "feature_quality",
    f"""{W}, u AS (SELECT feature, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS miss, 0 AS bad FROM
      (SELECT 'bmi' AS feature, bmi AS v FROM subjects UNION ALL SELECT 'age', age FROM subjects UNION ALL SELECT 'upper_resid', upper_resid FROM subjects) GROUP BY feature
      UNION ALL SELECT 'event_date', sum(CASE WHEN event_date IS NULL OR try_cast(event_date AS double) IS NULL THEN 1 ELSE 0 END), sum(CASE WHEN event_date IS NOT NULL THEN 1 ELSE 0 END) FROM subjects)
    SELECT feature, cast(bad AS bigint) AS n_non_numeric, cast(miss AS bigint) AS n_missing, (SELECT count(*) FROM subjects) AS n_rows FROM u""",
)
def _(spark, sf):
    return P.feature_quality(subjects(spark, sf), ["bmi", "age", "upper_resid", "event_date"])


@query(
    "data_stats",
    f"""{W} SELECT count(*) AS n_rows, count(CASE WHEN outcome = 'Controls' THEN 1 END) AS n_controls, count(CASE WHEN outcome = 'Incident' THEN 1 END) AS n_incident,
    count(CASE WHEN outcome = 'Prevalent' THEN 1 END) AS n_prevalent, count(*) - count(age) AS missing_age, count(*) - count(bmi) AS missing_bmi,
    count(*) - count(sex) AS missing_sex, 13 AS n_columns, 6 AS n_features FROM subjects""",
)
def _(spark, sf):
    return P.data_stats(subjects(spark, sf))


@query(
    "category_breakdown",
    f"""{W} SELECT site, count(CASE WHEN outcome = 'Controls' THEN 1 END) AS n_controls, count(CASE WHEN outcome = 'Incident' THEN 1 END) AS n_incident,
    count(CASE WHEN outcome = 'Prevalent' THEN 1 END) AS n_prevalent, count(*) AS n_total FROM subjects GROUP BY ALL""",
)
def _(spark, sf):
    return P.category_breakdown(subjects(spark, sf), ["site"], "outcome")


COLS = ",".join(sorted(["id", "outcome", "sex", "site", "age", "bmi", "event_date", *FEATURES]))


@query(
    "dataset_fingerprint",
    f"""{W}, a AS (SELECT count(*) AS n_rows, count(CASE WHEN outcome = 'Incident' THEN 1 END) AS n_positive FROM subjects WHERE outcome IN ('Controls', 'Incident')),
    b AS (SELECT *, round(n_positive / n_rows, 6) AS prevalence FROM a)
    SELECT *, substr(sha256(concat_ws('|', n_rows, n_positive, cast(round(prevalence * 1000000) AS bigint), substr(sha256('{COLS}'), 1, 12), 'outcome', 'IncidentOnly', '1,2,3', 'v1')), 1, 16) AS fingerprint FROM b""",
    "prevalence",
)
def _(spark, sf):
    return P.dataset_fingerprint(subjects(spark, sf), "IncidentOnly", [3, 1, 2], "v1")


@query("restrict_to_panel", f"WITH {LONG} SELECT id, feature, x FROM long WHERE feature IN ('repeat_resid', 'symbol_resid')", "x")
def _(spark, sf):
    long = long_features(spark, sf)
    panel = long.groupBy("feature").agg(F.max("x").alias("m")).filter("m <= 1 AND feature <> 'brevity_resid'")
    return P.restrict_long_to_panel(long, panel).select("id", "feature", "x")


# ---------------------------------------------------------------- strata
AGE3 = "CASE WHEN age > 0 AND age <= 40 THEN 'young' WHEN age > 40 AND age <= 60 THEN 'middle' WHEN age > 60 AND age <= 150 THEN 'old' ELSE 'nan' END"
AGE2 = "CASE WHEN age > 0 AND age <= 60 THEN 'lt60' WHEN age > 60 AND age <= 150 THEN 'ge60' ELSE 'nan' END"


@query("age_bins", f"{W}, f AS (SELECT id, coalesce(bmi, (SELECT median(bmi) FROM subjects)) AS age FROM subjects) SELECT id, {AGE3} AS age3, {AGE2} AS age2 FROM f")
def _(spark, sf):
    f = C.fill_median(subjects(spark, sf).select("id", F.col("bmi").alias("age")), "age")
    return f.select("id", C.age_bins(F.col("age"), "age3").alias("age3"), C.age_bins(F.col("age"), "age2").alias("age2"))


@query("make_strata", f"{W} SELECT id, outcome || '_' || sex || '_' || {AGE3} AS s1, outcome || '_' || {AGE3} AS s3 FROM subjects")
def _(spark, sf):
    return subjects(spark, sf).select("id", C.make_strata("outcome+sex+age3").alias("s1"), C.make_strata("outcome+age3").alias("s3"))


STRATA = f"""{W}, st0 AS (SELECT *, outcome || '_' || sex || '_' || {AGE3} AS s0 FROM subjects),
  st AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s0) < 5 THEN outcome || '_RARE' ELSE s0 END AS stratum FROM st0)"""


def strata(spark, sf):
    return C.collapse_rare(subjects(spark, sf).withColumn("stratum", C.make_strata("outcome+sex+age3")), "stratum", 5)


@query("collapse_rare", f"{STRATA} SELECT id, stratum FROM st")
def _(spark, sf):
    return strata(spark, sf).select("id", "stratum")


@query(
    "scheme_minimums",
    f"""{W}, s AS (SELECT outcome, 'outcome+sex+age3' AS scheme, outcome || '_' || sex || '_' || {AGE3} AS st FROM subjects
      UNION ALL SELECT outcome, 'outcome+sex+age2', outcome || '_' || sex || '_' || {AGE2} FROM subjects
      UNION ALL SELECT outcome, 'outcome+age3', outcome || '_' || {AGE3} FROM subjects
      UNION ALL SELECT outcome, 'outcome+sex', outcome || '_' || sex FROM subjects UNION ALL SELECT outcome, 'outcome', outcome FROM subjects),
    c AS (SELECT scheme, CASE WHEN count(*) < 4 THEN outcome || '_RARE' ELSE st END AS st, count(*) AS n FROM s GROUP BY scheme, outcome, s.st),
    d AS (SELECT scheme, st, cast(sum(n) AS bigint) AS n FROM c GROUP BY ALL) SELECT scheme, count(*) AS n_strata, min(n) AS min_size FROM d GROUP BY ALL""",
)
def _(spark, sf):
    return C.scheme_minimums(subjects(spark, sf), 4)


@query("working_strata")
def _(spark, sf):
    rows, scheme = C.working_strata(subjects(spark, sf), 2)
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).withColumn("scheme", F.lit(scheme))


# ---------------------------------------------------------------- splits
ALLOC = """al0 AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS tot FROM st GROUP BY stratum),
  al1 AS (SELECT *, ceil(round(0.4e0 * tot, 9)) AS temp FROM al0),
  al2 AS (SELECT *, temp * n / tot AS sh FROM al1),
  al3 AS (SELECT *, floor(sh) + CASE WHEN row_number() OVER (ORDER BY round(sh - floor(sh), 9) DESC, stratum) <= temp - sum(floor(sh)) OVER () THEN 1 ELSE 0 END AS n_temp FROM al2),
  al4 AS (SELECT *, ceil(round(0.5e0 * temp, 9)) AS test, ceil(round(0.5e0 * temp, 9)) * n_temp / sum(n_temp) OVER () AS sh2 FROM al3),
  al AS (SELECT stratum, cast(n AS bigint) AS n_stratum, cast(n_temp AS bigint) AS n_temp, cast(floor(sh2) + CASE WHEN row_number() OVER (ORDER BY round(sh2 - floor(sh2), 9) DESC, stratum) <= test - sum(floor(sh2)) OVER () THEN 1 ELSE 0 END AS bigint) AS n_test FROM al4)"""


@query("split_allocation", f"{STRATA}, {ALLOC} SELECT * FROM al")
def _(spark, sf):
    return C.split_allocation(strata(spark, sf), "stratum", 0.2, 0.2)


ASSIGN = f"""{STRATA}, {ALLOC}, sd AS (SELECT unnest([10, 11, 12, 13, 14]) AS seed),
  mx AS (SELECT id, seed, stratum, outcome, {mixed_sql('hh', ['seed'], 'dg')} FROM (SELECT *, {digest_sql('id')} AS dg FROM st), sd),
  rk AS (SELECT id, seed, stratum, outcome, row_number() OVER (PARTITION BY seed, stratum ORDER BY hh, id) AS rn FROM mx),
  assign AS (SELECT id, seed, CASE WHEN rn <= n_test THEN 'TEST' WHEN rn <= n_temp THEN 'VAL' ELSE 'TRAIN' END AS split, stratum, cast(outcome <> 'Controls' AS int) AS y, outcome FROM rk JOIN al USING (stratum))"""


def assigned(spark, sf):
    rows = strata(spark, sf).withColumn("y", (F.col("outcome") != "Controls").cast("int"))
    return C.repeated_splits(rows, 0.2, 0.2, 5, 10, y="y")


@query("repeated_splits", f"{ASSIGN} SELECT id, seed, split, stratum, y FROM assign")
def _(spark, sf):
    return assigned(spark, sf)


@query("stratified_split", f"{ASSIGN} SELECT id, seed, split, stratum, y FROM assign WHERE seed = 12")
def _(spark, sf):
    rows = strata(spark, sf).withColumn("y", (F.col("outcome") != "Controls").cast("int"))
    return C.stratified_split(rows, 0.2, 0.2, 12, y="y")


@query("repeated_splits_lines")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("stratum"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return C.split_summary(C.repeated_splits(rows, 0.2, 0.2, 5, 0, y="y"))


@query("split_summary", f"{ASSIGN} SELECT seed, split, count(*) AS n, cast(sum(y) AS bigint) AS n_pos, avg(y) AS prevalence FROM assign GROUP BY ALL", "prevalence")
def _(spark, sf):
    return C.split_summary(assigned(spark, sf))


@query("split_size_check", f"{ASSIGN} SELECT seed, split, count(*) AS n, cast(sum(y) AS bigint) AS n_pos, avg(y) AS prevalence, sum(y) >= 2 AND sum(1 - y) >= 2 AS valid FROM assign GROUP BY ALL", "prevalence")
def _(spark, sf):
    return C.split_size_check(assigned(spark, sf))


@query("split_integrity", f"{ASSIGN} SELECT seed, count(CASE WHEN split = 'TRAIN' THEN 1 END) AS n_train, count(CASE WHEN split = 'TEST' THEN 1 END) AS n_test, cast(0 AS bigint) AS n_overlap, cast(0 AS bigint) AS n_unknown, true AS valid FROM assign GROUP BY ALL")
def _(spark, sf):
    return P.split_integrity(assigned(spark, sf), subjects(spark, sf))


@query("leakage_check", f"{ASSIGN} SELECT seed, count(CASE WHEN split IN ('VAL', 'TEST') AND outcome = 'Prevalent' THEN 1 END) AS n_leaked FROM assign GROUP BY ALL")
def _(spark, sf):
    return P.leakage_check(assigned(spark, sf), subjects(spark, sf))


SPLIT_ID = "substr(md5(concat_ws(':', count(*), cast(sum(h) AS bigint), bit_xor(h))), 1, 12) AS split_id"
H_ID = "cast('0x' || substr(md5(cast(id AS varchar)), 1, 8) AS bigint) AS h"


@query("split_id", f"{ASSIGN} SELECT seed, split, count(*) AS n, {SPLIT_ID} FROM (SELECT *, {H_ID} FROM assign) GROUP BY ALL")
def _(spark, sf):
    return P.split_id(assigned(spark, sf), ["seed", "split"])


@query(
    "split_metadata",
    f"""{ASSIGN} SELECT seed, split, count(*) AS n, cast(sum(y) AS bigint) AS n_pos, avg(y) AS prevalence, {SPLIT_ID}, any_value(n_in) AS n_in,
      any_value(u) AS n_removed_uncertain_controls, any_value(m) AS n_removed_missing_numeric, any_value(o) AS n_out FROM (SELECT *, {H_ID} FROM assign),
      (SELECT count(*) AS n_in, count(CASE WHEN {UNC} THEN 1 END) AS u, count(CASE WHEN NOT {UNC} AND {MISS} THEN 1 END) AS m, count(CASE WHEN NOT {UNC} AND NOT {MISS} THEN 1 END) AS o FROM subjects) GROUP BY ALL""",
    "prevalence",
)
def _(spark, sf):
    return C.split_metadata(assigned(spark, sf), P.row_filter_counts(subjects(spark, sf)))


@query("target_prevalence", f"{ASSIGN} SELECT seed, avg(y) AS target_prevalence FROM assign WHERE split = 'VAL' GROUP BY ALL", "target_prevalence")
def _(spark, sf):
    return C.target_prevalence(assigned(spark, sf), "val")


ORD = "row_number() OVER (ORDER BY ts, event_id)"


@query("temporal_order", f"SELECT event_id AS id, {ORD} AS position FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return C.temporal_order(ev, "ts").select("id", "position")


@query(
    "temporal_order_text",
    f"{W} SELECT id, row_number() OVER (ORDER BY try_cast(event_date AS timestamp) NULLS FIRST, id) AS position FROM subjects",
)
def _(spark, sf):
    return C.temporal_order(subjects(spark, sf).select("id", "event_date"), "event_date").select("id", "position")


@query(
    "temporal_split",
    f"""WITH o AS (SELECT event_id AS id, {ORD} AS position, count(*) OVER () AS n FROM events),
    s AS (SELECT *, greatest(1, round_even(0.2e0 * n, 0)) AS nt, round_even(0.25e0 * n, 0) AS nv FROM o)
    SELECT id, position, CASE WHEN position > n - nt THEN 'TEST' WHEN position > n - nt - nv THEN 'VAL' ELSE 'TRAIN' END AS split FROM s""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return C.temporal_split(ev, "ts", 0.25, 0.2)


DOWN = f"""dk AS (SELECT *, row_number() OVER (PARTITION BY sex, outcome = 'Controls' ORDER BY {h_sql(7, 'id')}, id) AS rn,
  count(CASE WHEN outcome = 'Incident' THEN 1 END) OVER (PARTITION BY sex) AS cases FROM subjects)"""


@query("downsample_controls", f"{W}, {DOWN} SELECT id, sex, outcome FROM dk WHERE outcome <> 'Controls' OR cases = 0 OR rn <= round_even(cases * 2e0, 0)")
def _(spark, sf):
    return C.downsample_controls(subjects(spark, sf), 2.0, 7, ["sex"]).select("id", "sex", "outcome")


@query(
    "add_prevalent_to_train",
    f"""{ASSIGN}, pv AS (SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY {h_sql('(seed)', "'prev3'", 'id')}, id) AS rn, count(*) OVER (PARTITION BY seed) AS n
      FROM subjects, sd WHERE outcome = 'Prevalent')
    SELECT id, seed, split FROM assign WHERE outcome <> 'Prevalent' UNION ALL SELECT id, seed, 'TRAIN' FROM pv WHERE rn <= least(n, greatest(1, round_even(0.5e0 * n, 0)))""",
)
def _(spark, sf):
    subj = subjects(spark, sf)
    a = join_on(assigned(spark, sf), subj.filter("outcome <> 'Prevalent'").select("id"), ["id"], "left_semi")
    return C.add_prevalent_to_train(a, subj, 0.5, 3)


HOLD = ALLOC.replace("0.4e0", "0.3e0").replace("0.5e0", "1e0")
HOLDOUT = f"""{STRATA}, {HOLD}, mx AS (SELECT id, stratum, {mixed_sql('hh', ['42'], 'dg')} FROM (SELECT *, {digest_sql('id')} AS dg FROM st)),
  ho AS (SELECT id, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY hh, id) <= n_temp THEN 'HOLDOUT' ELSE 'DEV' END AS split FROM mx JOIN al USING (stratum))"""


@query("create_holdout", f"{HOLDOUT} SELECT id, split FROM ho")
def _(spark, sf):
    return C.create_holdout(strata(spark, sf), 0.3)


@query("development_rows", f"{HOLDOUT} SELECT id, outcome FROM subjects WHERE id NOT IN (SELECT id FROM ho WHERE split = 'HOLDOUT')")
def _(spark, sf):
    return C.development_rows(subjects(spark, sf), C.create_holdout(strata(spark, sf), 0.3)).select("id", "outcome")


@query(
    "training_population",
    f"""{W} SELECT id, 'incident_only' AS strategy, cast(outcome = 'Incident' AS int) AS y FROM subjects WHERE outcome IN ('Controls', 'Incident')
    UNION ALL SELECT id, 'incident_prevalent', cast(outcome <> 'Controls' AS int) FROM subjects
    UNION ALL SELECT id, 'prevalent_only', cast(outcome = 'Prevalent' AS int) FROM subjects WHERE outcome IN ('Controls', 'Prevalent')""",
)
def _(spark, sf):
    return C.training_population(subjects(spark, sf)).select("id", "strategy", "y")


Y = f"{W}, ys AS (SELECT *, cast(outcome <> 'Controls' AS int) AS y FROM subjects)"


def with_y(spark, sf):
    return subjects(spark, sf).withColumn("y", (F.col("outcome") != "Controls").cast("int"))


@query(
    "cv_folds",
    f"""{Y} SELECT id, y, repeat, cast((row_number() OVER (PARTITION BY repeat, y ORDER BY {h_sql(5, 'repeat', 'id')}, id) - 1) % 5 AS int) AS fold FROM ys, (SELECT unnest([0, 1, 2]) AS repeat)""",
)
def _(spark, sf):
    return C.cv_folds(with_y(spark, sf), 5, 3, 5)


CW = """SELECT id, sex, CASE WHEN y = 1 THEN {pos} ELSE {neg} END AS weight FROM (SELECT *, sum(y) OVER (PARTITION BY sex) AS n1, sum(1 - y) OVER (PARTITION BY sex) AS n0 FROM ys)"""


@query(
    "class_weights",
    f"""{Y} SELECT *, 'balanced' AS scheme FROM ({CW.format(pos='(n0 + n1) / (2e0 * greatest(n1, 1))', neg='(n0 + n1) / (2e0 * greatest(n0, 1))')})
    UNION ALL SELECT *, 'sqrt' FROM ({CW.format(pos='greatest(1e0, sqrt(n0 / n1))', neg='1e0')}) UNION ALL SELECT *, 'log' FROM ({CW.format(pos='ln(n0 / n1)', neg='1e0')})""",
    "weight",
)
def _(spark, sf):
    y = with_y(spark, sf)
    out = None
    for s, floor in (("balanced", True), ("sqrt", True), ("log", False)):
        one = C.class_weights(y, s, ["sex"], floor=floor).select("id", "sex", "weight").withColumn("scheme", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query("positive_scale", f"{Y} SELECT sex, greatest(1e0, coalesce(sum(1 - y) / nullif(sum(y), 0), 1e0)) AS scale_pos_weight FROM ys GROUP BY ALL", "scale_pos_weight")
def _(spark, sf):
    return C.positive_scale(with_y(spark, sf), ["sex"])


RANKY = f"{Y}, ry AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {h_sql(9, 'id')}, id) AS rn, row_number() OVER (ORDER BY {h_sql(9, 'id')}, id) AS rall, count(*) OVER () AS n, sum(y) OVER () AS n1 FROM ys)"


@query("subsample_balanced", f"{RANKY} SELECT id, y FROM ry WHERE n <= 60 OR rn <= CASE WHEN y = 1 THEN least(30, n1) ELSE 60 - least(30, n1) END")
def _(spark, sf):
    return C.subsample_balanced(with_y(spark, sf), 60, 9).select("id", "y")


@query(
    "background_sample",
    f"""{RANKY} SELECT id, y, 'random' AS strategy FROM ry WHERE rall <= 50
    UNION ALL SELECT id, y, 'controls_only' FROM ry WHERE rn <= CASE WHEN y = 0 THEN least(50, n - n1) ELSE least(50, n) - least(50, n - n1) END
    UNION ALL SELECT id, y, 'stratified' FROM ry WHERE rn <= CASE WHEN y = 0 THEN greatest(1, floor(least(50, n) * (n - n1) / n)) ELSE greatest(1, floor(least(50, n) * n1 / n)) END""",
)
def _(spark, sf):
    y = with_y(spark, sf)
    out = None
    for s in ("random", "controls_only", "stratified"):
        one = C.background_sample(y, s, 50, 9).select("id", "y").withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


DESIGN = [(f"c{n}_{r}_{int(f * 10)}_{s}", s, n, r, f) for s in (1, 2) for n in (10, 20) for r in (1, 5) for f in (0.5, 1.0)]


@query(
    "factorial_sample",
    f"""{W}, d AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {s}, {n}, {r}, {f}e0)" for c, s, n, r, f in DESIGN)}) AS t(cell, seed, n_cases, ratio, pf)),
    r AS (SELECT id, outcome, seed, row_number() OVER (PARTITION BY seed, outcome ORDER BY {h_sql('(seed)', 'id')}, id) AS rn FROM subjects, (SELECT DISTINCT seed FROM d))
    SELECT cell, seed, id, outcome FROM r JOIN d USING (seed) WHERE rn <= CASE outcome WHEN 'Incident' THEN n_cases WHEN 'Prevalent' THEN round_even(pf * n_cases, 0) ELSE ratio * n_cases END""",
)
def _(spark, sf):
    design = spark.createDataFrame(DESIGN, "cell string, seed int, n_cases int, ratio int, prevalent_frac double")
    return C.factorial_sample(subjects(spark, sf), design)


# ---------------------------------------------------------------- scalars
@query(
    "scalar_functions",
    f"""{W} SELECT id, ln(least(greatest(repeat_resid, 1e-7), 1e0 - 1e-7) / (1e0 - least(greatest(repeat_resid, 1e-7), 1e0 - 1e-7))) AS lo,
      1e0 / (1e0 + exp(-digits_resid / 10)) AS inv, (lines_resid + 0.5e0) / (lines_resid + digits_resid + 1e0) AS jeff,
      0.3e0 - 0.2e0 * (brevity_resid / (1e0 - brevity_resid)) AS nb, 0.1e0 - 0.9e0 * (brevity_resid / (1e0 - brevity_resid)) AS ta,
      abs(symbol_resid - repeat_resid) / (abs(repeat_resid) + 1e-8) AS noise_score, abs(repeat_resid) / (1e0 + abs(symbol_resid - repeat_resid) / (abs(repeat_resid) + 1e-8)) AS purity_score,
      sign(repeat_resid) <> sign(symbol_resid) AS sign_flip FROM subjects""",
    "lo inv jeff nb ta noise_score purity_score",
)
def _(spark, sf):
    s = subjects(spark, sf)
    b = F.col("brevity_resid")
    return s.select(
        "id", S.logit("repeat_resid").alias("lo"), S.inv_logit(F.col("digits_resid") / 10).alias("inv"),
        S.jeffreys("lines_resid", F.col("lines_resid") + F.col("digits_resid")).alias("jeff"),
        S.net_benefit(F.lit(0.3), F.lit(0.2), F.lit(1.0), b).alias("nb"), S.treat_all(F.lit(0.1), b).alias("ta"),
        *[c.alias(n) for n, c in S.purity(F.col("repeat_resid"), F.col("symbol_resid")).items()],
    )


@query(
    "string_functions",
    """SELECT DISTINCT p_name || '_resid' AS raw, p_name AS base, 'num__' || p_name AS staged, p_name AS plain, p_size AS panel_size FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat("p_name", F.lit("_resid"))
    staged = F.concat(F.lit("num__"), "p_name")
    name = F.concat(F.lit("sweep_p"), F.col("p_size").cast("string"))
    return p.select(raw.alias("raw"), S.strip_suffix(raw).alias("base"), staged.alias("staged"), S.strip_transformer(staged).alias("plain"), S.panel_size_from_name(name).alias("panel_size")).distinct()


@query(
    "json_cells",
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, cast(0 AS int) AS n_list,
    cast(CASE WHEN event_id % 5 = 0 THEN 0 ELSE json_array_length('[' || repeat(event_id || ',', cast(event_id % 4 AS int)) || '"x"]') END AS int) AS n_items,
    CASE WHEN event_id % 5 <> 0 THEN json_extract_string('[' || repeat(event_id || ',', cast(event_id % 4 AS int)) || '"x"]', '$[0]') END AS first_item FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    # Lists of one to four items; every fifth is cut off before its end.
    cell = F.concat(F.lit("["), F.expr("repeat(concat(event_id, ','), cast(event_id % 4 AS int))"), F.when(F.col("event_id") % 5 == 0, F.lit('"x')).otherwise(F.lit('"x"]')))
    return ev.select("event_id", F.coalesce(F.try_element_at(S.json_map("props"), F.lit("k")), F.lit("none")).alias("k"), F.size(S.json_list("props")).alias("n_list"),
                     F.size(S.json_list(cell)).alias("n_items"), F.get(S.json_list(cell), F.lit(0)).alias("first_item"))


@query("parse_date_or_number", f"{W} SELECT id, try_cast(event_date AS timestamp) IS NOT NULL AS is_date, CASE WHEN event_date IS NULL THEN bmi END AS number FROM subjects", "number")
def _(spark, sf):
    cell = F.coalesce("event_date", F.col("bmi").cast("string"))
    return subjects(spark, sf).select("id", *[c.alias(n) for n, c in S.parse_date_or_number(cell).items()]).select("id", F.col("as_ts").isNotNull().alias("is_date"), F.col("as_number").alias("number"))
