"""Readers and writers on temporary folders."""

import pytest
from pyspark.sql import functions as F

from riskspark.functions import scalar as X
from riskspark.operators import cohort as P
from riskspark.operators import splits as C
from riskspark.sources import tables as S


@pytest.fixture
def cohort_csv(tmp_path):
    d = tmp_path / "cohort.csv"
    d.write_text(
        "id,outcome,event_date,age,bmi,sex,A_resid,B_resid,unused\n1,Controls,,50,22.5,F,0.1,1,x\n2,Incident,2020-01-02,61,,M,0.4,bad,y\n3,Prevalent,2019-05-01,70,30,,0.5,3,z\n4,Controls,2021-01-01,40,20,F,,4,w\n"
    )
    return str(d)


def test_read_subjects_selects_and_coerces(spark, cohort_csv, tmp_path):
    df = S.read_subjects(spark, cohort_csv)
    assert df.columns == ["id", "outcome", "event_date", "age", "bmi", "sex", "A_resid", "B_resid"]
    assert [r.B_resid for r in df.orderBy("id").collect()] == [1.0, None, 3.0, 4.0]
    out = str(tmp_path / "cohort.parquet")
    S.csv_to_parquet(spark, cohort_csv, out)
    again = S.read_subjects(spark, out, numeric=["age"], categorical=[])
    assert again.columns == ["id", "outcome", "event_date", "age", "A_resid", "B_resid"] and again.count() == 4
    plan = again.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "A_resid" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        S.read_subjects(spark, cohort_csv, numeric=["nope"])
    with pytest.raises(ValueError):
        S.read_subjects(spark, cohort_csv, suffix="_missing")


def test_row_filters_in_order(spark, cohort_csv):
    df = S.read_subjects(spark, cohort_csv)
    r = P.row_filter_counts(df).first()
    assert (r.n_in, r.n_removed_uncertain_controls, r.n_removed_missing_numeric, r.n_out) == (4, 1, 1, 2)
    assert {x.id for x in P.apply_row_filters(df).collect()} == {"1", "3"}
    v = P.validate_subjects(df, required=("id", "outcome", "zzz")).first()
    assert not v.valid and v.missing_columns == "zzz"
    with pytest.raises(ValueError):
        P.scenario_filter(df, "Nope")


def test_table_round_trip_append_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.25), (2, 1, 0.75)], "id bigint, y_true int, y_prob double")
    p = str(tmp_path / "preds.csv")
    S.write_table(df, p, fmt="csv")
    S.write_table(df, p, append=True, fmt="csv")
    back = S.read_predictions(spark, p)
    assert back.count() == 4 and dict(back.dtypes)["y_prob"] == "double"
    with pytest.raises(ValueError):
        S.read_metrics(spark, p)
    with pytest.raises(ValueError):
        S.read_feature_report(spark, p)


def test_save_splits_reuses_equal_and_rejects_different(spark, tmp_path):
    a = spark.createDataFrame([(i, "inc", s, "TRAIN" if i % 3 else "TEST") for i in range(9) for s in (0, 1)], "id bigint, scenario string, seed int, split string")
    path = str(tmp_path / "splits")
    assert S.save_splits(a, path) == "written"
    assert S.save_splits(a.repartition(3), path) == "reused"
    b = a.withColumn("split", F.when((F.col("id") == 1) & (F.col("seed") == 1), "TEST").otherwise(F.col("split")))
    with pytest.raises(ValueError):
        S.save_splits(b, path)
    S.save_splits(b.filter("seed = 1"), path, overwrite=True)
    stored = spark.read.parquet(path)
    assert stored.count() == 18 and stored.filter("seed = 1 AND split = 'TEST'").count() == 4
    more = a.filter("seed = 0").withColumn("seed", F.lit(7))
    assert S.save_splits(more, path) == "written" and spark.read.parquet(path).count() == 27


def test_collect_tree_reads_keys_from_paths(spark, tmp_path):
    for run, model, seed in (("r1", "LR", 0), ("r1", "LR", 1), ("r1", "RF", 0)):
        base = tmp_path / f"run_{run}" / model / "splits" / f"split_seed{seed}"
        for sub in ("preds", "core", "cv", "shap"):
            (base / sub).mkdir(parents=True)
        (base / "preds" / "test_preds.csv").write_text("idx,y_true,y_prob\n1,0,0.1\n2,1,0.8\n")
        (base / "core" / "test_metrics.csv").write_text(f"auroc,n\n0.{seed + 7},2\n")
        (base / "cv" / "best_params.csv").write_text('fold,best_params\n0,"{""C"": 1.5, ""k"": ""a""}"\n1,oops\n')
        df = spark.createDataFrame([(1, 0.5)], "id int, a double")
        if seed:
            df = df.withColumn("b", F.lit(2.0))
        df.coalesce(1).write.parquet(str(base / "shap" / "test_values.parquet"))
    root = str(tmp_path)
    preds = S.collect_predictions(spark, root, schema="idx INT, y_true INT, y_prob DOUBLE")
    assert {(r.run_id, r.model, r.split_seed) for r in preds.select("run_id", "model", "split_seed").collect()} == {("r1", "LR", 0), ("r1", "LR", 1), ("r1", "RF", 0)}
    assert preds.count() == 6 and {r.source_file for r in preds.collect()} == {"test_preds.csv"}
    assert S.collect_metrics(spark, root).count() == 3
    params = spark.read.option("header", True).option("escape", '"').csv(f"{root}/run_*/*/splits/split_seed*/cv/best_params*.csv")
    flat = S.flatten_params(params, "best_params").collect()
    assert len(flat) == 6 and {(r.param, r.value) for r in flat} == {("C", "1.5"), ("k", "a")}
    pooled = S.collect_tree(spark, f"{root}/run_*/*/splits/split_seed*/shap/test_values.parquet", "parquet")
    assert pooled.count() == 3 and pooled.filter("b IS NULL").count() == 2


def test_scalars(spark):
    r = spark.range(1).select(
        X.strip_suffix(F.lit("abc_resid")).alias("a"), X.strip_transformer(F.lit("num__age")).alias("b"), X.panel_size_from_name(F.lit("R1_p25")).alias("c"),
        F.size(X.json_list(F.lit("[1, 2]"))).alias("d"), F.size(X.json_list(F.lit("broken"))).alias("e"),
        X.adjust_prevalence(F.lit(0.3), F.lit(0.2), F.lit(0.2)).alias("f"), X.adjust_prevalence(F.lit(0.3), F.lit(0.0), F.lit(0.2)).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.g) == ("abc", "age", 25, 2, 0, 0.3) and abs(r.f - 0.3) < 1e-12


def test_downsampling_and_prevalent_sizes(spark):
    df = spark.createDataFrame([(i, "Incident" if i < 10 else "Prevalent" if i < 15 else "Controls") for i in range(200)], "id int, outcome string")
    got = {r.outcome: r["count"] for r in C.downsample_controls(df, 3.0, 1).groupBy("outcome").count().collect()}
    assert got == {"Incident": 10, "Prevalent": 5, "Controls": 30}
    assert C.downsample_controls(df, None, 1).count() == 200 and C.downsample_controls(df, 100.0, 1).count() == 200
    folds = C.cv_folds(df.withColumn("y", (F.col("outcome") == "Incident").cast("int")), 5, 2, 0)
    per = folds.groupBy("repeat", "fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.p == 2 and r.n == 40 for r in per)
