"""Rules that must not change with the size of the data, and answers mended in this round."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.core import session
from riskspark.core.newton import grouped_logistic
from riskspark.core.tails import t_ppf
from riskspark.operators import corr as R
from riskspark.operators import models as M
from riskspark.operators import significance as S
from riskspark.sources import tables as T


def test_student_quantile_at_any_size(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (200.0,), (201.0,), (500.0,), (None,)], "df double").select("df", t_ppf(0.975)("df").alias("t")).collect()
    want = {0.0: None, 1.0: 12.7062, 10.0: 2.22814, 200.0: 1.97190, 201.0: 1.97184, 500.0: 1.96472, None: None}
    for r in got:
        assert (r.t is None or math.isnan(r.t)) if want[r.df] is None else abs(r.t - want[r.df]) < 1e-4


def test_exact_signed_rank_beyond_fifty(spark):
    n = 60
    rows = [("m", f, 0.5 + (f + 1) * 1e-3 * (1 if f % 3 else -1)) for f in range(n)] + [("z", f, 0.5) for f in range(n)]
    df = spark.createDataFrame(rows, "combo string, fold int, auprc double")
    exact = S.wilcoxon_pairs(df).first()
    w = min(sum(f + 1 for f in range(n) if f % 3), sum(f + 1 for f in range(n) if not f % 3))
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    assert exact.n_nonzero == n and exact.statistic == w
    assert abs(exact.p_value - min(1.0, 2 * sum(ways[: w + 1]) / 2**n)) < 1e-12
    normal = S.wilcoxon_pairs(df, method="normal").first()
    assert 0 < abs(normal.p_value - exact.p_value) < 0.01
    with pytest.raises(ValueError):
        S.wilcoxon_pairs(df, method="auto")


def test_first_level_is_dropped_and_unknown_ones_are_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "s string")
    model = M.DropFirstEncoder(["s"]).fit(train)
    got = model.transform(spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "s string")).select("s", F.col("s__h").cast("string").alias("v")).collect()
    assert [r.v for r in got] == ["[0.0,0.0]", "[1.0,0.0]", "[0.0,1.0]", "[0.0,0.0]", "[0.0,0.0]"]
    pipe = M.build_pipeline("LR_L2", ["x"], categorical=["s"], maxIter=5)
    rows = spark.createDataFrame([(i % 2, float(i), "abc"[i % 3]) for i in range(30)], "y int, x double, s string")
    assert pipe.fit(rows).stages[-1].numFeatures == 3


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:04d}",) for i in range(n + 1)] + [("lone",)], "node string")
    got = {r.node: r.component for r in R.components(edges, nodes).collect()}
    assert set(got.values()) == {"n0000", "lone"}


def test_refill_takes_candidates_of_any_rank(spark):
    n = 3200  # all but the last of them conflict with the kept one
    kept = spark.createDataFrame([("k", 1)], "feature string, rank int")
    ranked = spark.createDataFrame([("k", 1)] + [(f"f{i:05d}", i + 2) for i in range(n)], "feature string, rank int")
    pairs = spark.createDataFrame([("k", f"f{i:05d}", 0.9) for i in range(n - 1)], "a string, b string, abs_corr double")
    got = [r.feature for r in R.refill_panel(kept, ranked, pairs, 2, 0.8).orderBy("position").collect()]
    assert got == ["k", f"f{n - 1:05d}"]


def test_fits_say_if_they_settled(spark):
    rows = spark.createDataFrame([("a", 0.0, 5, 5), ("a", 1.0, 7, 3), ("b", 0.0, 0, 9), ("b", 1.0, 9, 0)], "g string, x double, pos int, neg int")
    got = {r.g: r.converged for r in grouped_logistic(rows, ["g"], [F.lit(1.0), F.col("x")], max_iter=8, with_steps=True).collect()}
    assert got == {"a": True, "b": False}


def test_broken_splits_are_not_written_over(spark, tmp_path):
    path = tmp_path / "splits"
    path.mkdir()
    assert not T._exists(spark, str(tmp_path / "none"))
    (path / "part-0.parquet").write_bytes(b"this is not a parquet file at all")
    with pytest.raises(Exception):  # noqa: B017
        T._exists(spark, str(path))


def test_broadcast_goes_by_bytes(spark, monkeypatch):
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 2], "s": ["x" * 500, "y"]}))
    assert df.select(F.sum(session.row_bytes(df))).first()[0] == 2 * 32 + 501
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    plan = lambda: df.join(session.counted(df).withColumnRenamed("s", "r"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10_000)
    assert "broadcast" in plan()
