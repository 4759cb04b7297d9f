"""Queries do the whole of their method: published grids, draws and summaries, on rows built here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.plans import QUERIES


def lineitem(spark, folder, n=2400):
    """A small lineitem; one split of one model has one class only."""
    h = lambda i, m: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("int")
    rows = spark.range(n).select(
        "id", h(1, 40).cast("long").alias("l_partkey"), h(2, 12).cast("long").alias("l_suppkey"), (h(3, 7) + 1).alias("l_linenumber"),
        (h(4, 50) + 1.0).alias("l_quantity"), (h(5, 900) * 100 + 1000.0).alias("l_extendedprice"), (h(6, 11) / 100.0).alias("l_discount"), (h(7, 9) / 100.0).alias("l_tax"),
        F.element_at(F.array(*[F.lit(c) for c in "ANR"]), h(8, 3) + 1).alias("l_returnflag"), F.when(h(9, 2) == 0, "F").otherwise("O").alias("l_linestatus"),
    )
    one = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 3)
    rows = rows.withColumn("l_returnflag", F.when(one, "A").otherwise(F.col("l_returnflag")))
    rows.write.parquet(f"{folder}/lineitem.parquet")
    return rows.toPandas()


def split_curves(rows):
    """Model, then the cumulative positives and negatives from the highest score down, one entry per split with both classes."""
    score = rows.l_extendedprice / (rows.l_extendedprice + 40000.0 * (1.0 + rows.l_discount))
    rows = rows.assign(p=score, y=(rows.l_returnflag == "R").astype(int))
    for (model, _), g in rows.groupby(["l_linestatus", "l_linenumber"]):
        if g.y.nunique() == 2:
            c = g.groupby("p").y.agg(["sum", "count"]).sort_index(ascending=False)
            yield model, c["sum"].cumsum().to_numpy(), (c["count"] - c["sum"]).cumsum().to_numpy()


def check_band(df, curves):
    """The band of a query against the curves read on the published grid of 120 points."""
    got = {m: sorted((r for r in df if r.model == m), key=lambda r: r.grid) for m in curves}
    for model, lines in curves.items():
        lines, band = np.array(lines), got[model]
        assert np.allclose([r.grid for r in band], np.linspace(0, 1, 120), atol=1e-6)
        assert {r.n_splits for r in band} == {len(lines)}
        want = [lines.mean(0), lines.std(0), *np.percentile(lines, [2.5, 97.5], axis=0)]
        for c, w in zip(("mean", "sd", "lo", "hi"), want, strict=True):
            assert np.allclose([r[c] for r in band], w, atol=2e-6), (model, c)


def test_pr_band_has_the_published_grid(spark, tmp_path):
    curves = {}
    for model, tp, fp in split_curves(lineitem(spark, tmp_path)):
        x, v = np.append(0.0, tp / tp[-1]), np.append(1.0, tp / (tp + fp))
        curves.setdefault(model, []).append(np.interp(np.linspace(0, 1, 120), x, v))
    assert sorted(map(len, curves.values())) == [6, 7]
    check_band(QUERIES["pr_band"](spark, str(tmp_path)).collect(), curves)


def test_roc_band_has_the_published_grid(spark, tmp_path):
    curves = {}
    for model, tp, fp in split_curves(lineitem(spark, tmp_path)):
        line = np.interp(np.linspace(0, 1, 120), np.append(0.0, fp / fp[-1]), np.append(0.0, tp / tp[-1]))
        line[0] = 0.0
        curves.setdefault(model, []).append(line)
    assert sorted(map(len, curves.values())) == [6, 7]
    check_band(QUERIES["roc_band"](spark, str(tmp_path)).collect(), curves)


def test_select_winner_draws_as_often_as_the_method(spark, tmp_path):
    """Intervals of 2000 paired draws of the folds, for lists of several lengths."""
    from riskspark.operators import resample as B

    rows = lineitem(spark, tmp_path, 500)
    got = {r.experiment: r for r in QUERIES["select_winner"](spark, str(tmp_path)).collect()}
    runs = rows.groupby(["l_suppkey", "l_returnflag", "l_linenumber"]).l_extendedprice.max().div(1.2e5).reset_index()
    data = []
    for experiment, g in runs.groupby("l_suppkey"):
        first, second = g.groupby("l_returnflag").l_extendedprice.mean().sort_values(ascending=False).index[:2]
        wide = g.pivot(index="l_linenumber", columns="l_returnflag", values="l_extendedprice")
        data += [(int(experiment), int(fold), float(d)) for fold, d in (wide[first] - wide[second]).dropna().items()]
    diff = spark.createDataFrame(data, "experiment long, fold int, d double")
    idx = B.indexed(diff, ["experiment"], "fold", 42)
    drawn = B.draw_targets(diff, ["experiment"], "fold", 2000, 42, rows=idx).join(idx.select("experiment", F.col("idx").alias("target"), "d"), ["experiment", "target"])
    means = drawn.groupBy("experiment", "b").agg(F.avg("d").alias("d"))
    want = means.groupBy("experiment").agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi")).collect()
    assert len({sum(e == r.experiment for e, *_ in data) for r in want}) > 1 and len(want) == len(got) == 12
    for r in want:
        assert (got[r.experiment].ci_lo, got[r.experiment].ci_hi) == pytest.approx((r.lo, r.hi), abs=1.1e-6)


def test_shap_across_splits_averages_the_splits(spark, tmp_path):
    """Mean and sd over the splits that have a feature; places by mean, ties by name; least rank by mean x stability."""
    rows = lineitem(spark, tmp_path, 700)
    per = rows.assign(feature="p" + rows.l_partkey.astype(str)).groupby(["l_returnflag", "l_linenumber", "feature"]).l_extendedprice.max().div(1e5).reset_index()
    got = {(r.model, r.feature): r for r in QUERIES["shap_across_splits"](spark, str(tmp_path)).collect()}
    assert len(got) == len(per.groupby(["l_returnflag", "feature"]))
    for model, g in per.groupby("l_returnflag"):
        a = g.groupby("feature").l_extendedprice.agg(["mean", "std", "count"]).reset_index()
        a["stability"] = a["count"] / g.l_linenumber.nunique()
        a = a.sort_values(["mean", "feature"], ascending=[False, True], ignore_index=True)
        a["least"] = (a["mean"] * a.stability).round(12).rank(ascending=False, method="min")
        for i, w in a.iterrows():
            r = got[model, w.feature]
            assert (r["mean"], r.stability) == pytest.approx((w["mean"], w.stability), abs=1.1e-6)
            assert r.std is None if w["count"] == 1 else r.std == pytest.approx(w["std"], abs=1.1e-6)
            assert (r.n_present, r.rank_pooled, r.rank_stability) == (w["count"], i + 1, w.least)


@pytest.mark.parametrize("limit", [None, 5])
def test_equal_means_take_places_by_name(spark, limit):
    from riskspark.operators import aggregate as A

    rows = spark.createDataFrame([("m", s, f, v) for f, v in (("b", 0.1), ("a", 0.1), ("c", 0.7), ("d", 0.1)) for s in range(3)], "model string, split_seed int, feature string, mean_abs_shap double")
    got = {r.feature: (r.rank_pooled, r.rank_stability) for r in A.shap_across_splits(rows, limit=limit).collect()}
    assert got == {"c": (1, 1), "a": (2, 2), "b": (3, 2), "d": (4, 2)}
