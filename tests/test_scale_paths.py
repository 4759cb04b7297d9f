"""Results do not depend on partitioning, nor on whether rows are placed or ordered in one task."""

import pytest
from pyspark.sql import functions as F

from riskspark.core.order import hash_rank, neighbours, ordinal_rank, place_rows, running
from riskspark.core.quantile import quantiles
from riskspark.operators import aggregate as A
from riskspark.operators import calibration as C
from riskspark.operators import discrimination as D
from riskspark.operators import resample as B
from riskspark.operators import screen as N
from riskspark.operators import significance as S
from riskspark.operators import splits as P
from riskspark.operators import thresholds as T


def rows(df, digits=9):
    def norm(v):
        return round(v, digits) if isinstance(v, float) else v

    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def scored(spark):
    """One model holds most rows; scores repeat."""
    n = 3000
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 5 == 0, "small").otherwise("hot").alias("model"), (F.col("id") % 3).cast("int").alias("split_seed"),
        F.when(F.col("id") % 10 < 6, "VAL").otherwise("TEST").alias("split"),
        ((F.xxhash64("id") % 1000 + 1000) / 2000.0).alias("y_prob"),
    )
    y = (F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(100)) < 10 + 60 * F.col("y_prob")).cast("int")
    return df.withColumn("y_true", y).cache()


OPS = {
    "auroc": lambda d, **k: D.auroc(d, ["model"], **k),
    "discrimination": lambda d, **k: D.discrimination(d, ["model"], **k),
    "roc_points": lambda d, **k: D.roc_points(d, ["model"], **k),
    "no_keys": lambda d, **k: D.discrimination(d, [], **k),
    "youden": lambda d, **k: T.choose_threshold(d, ["model"], None, **k),
    "bundle": lambda d, **k: T.threshold_bundle(d, ["model"], 0.9, 0.4, **k),
    "controls": lambda d, **k: T.threshold_from_controls(d, ["model"], 0.9, **k),
    "top_risk": lambda d, **k: T.top_risk_capture(d, [0.01, 0.2], ["model"], **k),
    "quantile_bins": lambda d, **k: C.calibration_bins(d, ["model"], 10, "quantile", **k),
    "adaptive_ece": lambda d, **k: C.adaptive_ece(d, ["model"], **k),
    "smooth": lambda d, **k: C.smooth_errors(d, ["model"], **k),
    "distribution": lambda d, **k: A.distribution_stats(d, ["model"], **k),
    "bootstrap": lambda d, **k: B.bootstrap_ci(d, ["model"], n_boot=25, **k),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_placed_rows_give_the_same_result(scored, name):
    assert rows(OPS[name](scored)) == rows(OPS[name](scored, limit=200))


@pytest.mark.parametrize("name", ["discrimination", "bundle", "bootstrap", "quantile_bins"])
def test_partitioning_does_not_matter(scored, name):
    assert rows(OPS[name](scored)) == rows(OPS[name](scored.repartition(13, "y_prob")))


def test_hash_rank_is_a_permutation_and_matches_one_window(scored):
    from pyspark.sql import Window

    from riskspark.core.order import hash_order

    got = hash_rank(scored, ["model"], "id", 3, "rn")
    w = Window.partitionBy("model").orderBy(hash_order(3, "id"), "id")
    want = scored.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert rows(got.select("model", "id", "rn")) == rows(want.select("model", "id", "rn"))
    assert rows(hash_rank(scored, ["model"], "id", 3, "rn", bits=2).select("id", "rn")) == rows(want.select("id", "rn"))


def test_running_and_neighbours_across_places(spark, scored):
    base = scored.select("model", "id", "y_prob")
    order = [F.col("y_prob").desc(), F.col("id")]
    aggs = {"s": ("sum", F.col("id")), "m": ("max", F.col("id")), "l": ("min", F.col("id"))}
    one = neighbours(running(base, ["model"], order, aggs), ["model"], order, prev={"p": "id"}, nxt={"n": "id"})
    placed, place = place_rows(base, ["model"], order, limit=100)
    assert place
    two = neighbours(running(placed, ["model"], order, aggs, place), ["model"], order, prev={"p": "id"}, nxt={"n": "id"}, place=place)
    assert rows(one) == rows(two.select(one.columns))


def test_exact_quantiles(scored):
    counts = scored.groupBy("model", "y_prob").agg(F.count(F.lit(1)).alias("n"))
    got = quantiles(counts, ["model"], "y_prob", {"a": 0.1, "b": 0.5, "c": 0.975}, limit=100)
    want = scored.groupBy("model").agg(*[F.percentile("y_prob", F.lit(q)).alias(n) for n, q in (("a", 0.1), ("b", 0.5), ("c", 0.975))])
    assert rows(got) == rows(want)


def test_ranked_operators_when_placed(spark, scored):
    feats = scored.groupBy("model", (F.col("id") % 400).cast("string").alias("feature")).agg(F.max("y_prob").alias("p_value"))
    for op in (S.bh_adjust, S.holm_adjust):
        assert rows(op(feats, ["model"])) == rows(op(feats, ["model"], limit=50).select(op(feats, ["model"]).columns))
    assert rows(ordinal_rank(feats, ["model"], [F.col("p_value"), F.col("feature")])) == rows(ordinal_rank(feats, ["model"], [F.col("p_value"), F.col("feature")], limit=50))
    assert rows(A.min_rank(feats, ["model"], "p_value", "r")) == rows(A.min_rank(feats, ["model"], "p_value", "r", limit=50))
    a = A.pareto_scan(scored.select("model", "id", "y_prob", F.col("y_true").alias("c")), ["model"], "y_prob", "c", "id")
    b = A.pareto_scan(scored.select("model", "id", "y_prob", F.col("y_true").alias("c")), ["model"], "y_prob", "c", "id", limit=100)
    assert rows(a) == rows(b.select(a.columns))


def test_rank_agreement_when_placed(spark):
    a = spark.range(1, 201).select(F.col("id").cast("string").alias("feature"), F.col("id").alias("rank"))
    b = a.select("feature", (F.pmod(F.col("rank") * 77, F.lit(211))).alias("rank"))
    assert rows(S.rank_agreement(a, b, [10])) == rows(S.rank_agreement(a, b, [10], limit=30))


def test_mann_whitney_when_placed(scored):
    long = scored.select("id", F.col("y_true").alias("y"), F.col("model").alias("feature"), F.col("y_prob").alias("x"))
    assert rows(N.mann_whitney_screen(long)) == rows(N.mann_whitney_screen(long, limit=100))


def test_temporal_order_when_placed(scored):
    ev = scored.select("id", F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(500))).alias("ts"))
    assert rows(P.temporal_split(ev, "ts", 0.2, 0.2)) == rows(P.temporal_split(ev, "ts", 0.2, 0.2, limit=100))


def test_splits_are_disjoint_exhaustive_and_stable(scored):
    s = scored.select("id", F.col("model").alias("stratum"), F.col("y_true").alias("y"))
    a = P.repeated_splits(s, 0.25, 0.25, 3, 5, y="y")
    assert a.count() == 3 * s.count() and a.select("id", "seed").distinct().count() == a.count()
    assert rows(a) == rows(P.repeated_splits(s.repartition(7), 0.25, 0.25, 3, 5, y="y"))
    sizes = {(r.seed, r.split): r.n for r in P.split_summary(a).collect()}
    assert sizes[(5, "TEST")] == 750 and sizes[(5, "VAL")] == 750


def test_cuts_in_hash_order_match_ranks(spark, scored):
    from riskspark.core.order import hash_within

    limits = spark.createDataFrame([("hot", 700, 5000), ("small", 1, 0)], "model string, a bigint, b bigint")
    got = hash_within(scored.select("model", "id"), ["model"], "id", 3, limits, ["a", "b"], bits=3)
    ranked = hash_rank(scored.select("model", "id"), ["model"], "id", 3, "rn").join(limits, "model")
    want = ranked.select("model", "id", (F.col("rn") <= F.col("a")).alias("a"), (F.col("rn") <= F.col("b")).alias("b"))
    assert rows(got.select("model", "id", "a", "b")) == rows(want)


def test_null_median_when_placed(scored):
    n = scored.select("model", F.lit(1).alias("split_seed"), F.col("y_prob").alias("null_auroc"))
    obs = n.select("model", "split_seed").distinct().withColumn("observed", F.lit(0.7))
    assert rows(S.null_summary(n, obs)) == rows(S.null_summary(n, obs, limit=100))
