"""Large tables: replicates that are not broadcast, single places of a curve, permutations in pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import aggregate as A
from riskspark.operators import resample as B


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_select_winner_resamples_in_place(spark):
    """The draws of the row bootstrap, without a row per slot."""
    cv = spark.range(4 * 2 * 6).select(
        (F.col("id") % 4).alias("experiment"), (F.floor(F.col("id") / 4) % 2).cast("string").alias("strategy"), F.lit("log").alias("weight_scheme"),
        F.floor(F.col("id") / 8).alias("fold"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("auprc"), F.col("id").alias("n_nonzero"),
    )
    out = A.select_winner(cv, ["experiment"], n_boot=50)
    assert "Generate" not in plan_of(out)
    got = {r.experiment: (r.ci_lo, r.ci_hi) for r in out.collect()}
    first = {r.experiment: r.strategy for r in cv.groupBy("experiment", "strategy").agg(F.avg("auprc").alias("m")).groupBy("experiment").agg(F.max_by("strategy", "m").alias("strategy")).collect()}
    sign = F.when(F.col("strategy") == F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("experiment")), 1).otherwise(-1)
    diff = cv.groupBy("experiment", "fold").agg(F.sum(sign * F.col("auprc")).alias("d"))
    idx = B.indexed(diff, ["experiment"], "fold", 42)
    drawn = B.draw_targets(diff, ["experiment"], "fold", 50, 42, rows=idx).join(idx.select("experiment", F.col("idx").alias("target"), "d"), ["experiment", "target"])
    means = drawn.groupBy("experiment", "b").agg(F.avg("d").alias("d"))
    want = means.groupBy("experiment").agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi")).collect()
    assert len(want) == 4
    for r in want:
        assert got[r.experiment] == pytest.approx((r.lo, r.hi), abs=1e-12)


def test_replicates_are_not_broadcast(spark):
    df = spark.range(50).select("id", F.lit("a").alias("model"))
    plan = plan_of(B.draw_weights(df, ["model"], "id", 200, 42))
    assert "SortMergeJoin" in plan and "Generate" in plan


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_placed_curves_without_checkpoint(spark, limit):
    """Places follow from the score: the points are those of one window, NULL keys and a hot score included."""
    from riskspark.operators.hist import points_of

    u = F.pmod(F.xxhash64("id"), F.lit(400))
    df = spark.range(1200).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("m"), F.col("id") % 3)).alias("model"), (F.col("id") % 4 == 0).cast("int").alias("y_true"),
        F.when(u < 100, F.lit(-0.0)).when(u < 110, F.lit(float("nan"))).when(u < 350, u / 400).otherwise(F.col("id").cast("double")).alias("y_prob"),
    )
    placed = points_of(df, ["model"], limit=limit)
    assert "ExistingRDD" not in plan_of(placed)
    plain = points_of(df, ["model"])
    as_set = lambda d: sorted(map(repr, d.select(*sorted(plain.columns)).collect()))
    assert sorted(placed.columns) == sorted(plain.columns)
    assert as_set(placed) == as_set(plain)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_inversions_in_blocks(spark, block):
    from riskspark.operators.significance import _inversions

    rng = np.random.default_rng(3)
    data, want = [], {}
    for g, n in (("a", 23), (None, 9), ("b", 1)):
        z = (rng.permutation(n) + 1).tolist()
        data += [(g, i + 1, v) for i, v in enumerate(z)]
        want[g] = sum(z[i] > z[j] for i in range(n) for j in range(i + 1, n))
    rows = spark.createDataFrame(data, "g string, x long, z long").repartition(3)
    assert {r.g: r["__inv"] for r in _inversions(rows, ["g"], block).collect()} == want


def test_bands_start_without_the_points(spark):
    """The first point of a band's curves is read from the rows: one ordered walk, not two."""
    from riskspark.operators.curves import roc_band

    df = spark.range(60).select(F.lit("m").alias("model"), (F.col("id") % 3).alias("s"), (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") / 60).alias("y_prob"))
    df = df.withColumn("y_true", F.when(F.col("s") == 2, 0).otherwise(F.col("y_true")))
    band = roc_band(df, ["model"], "s", [0.0, 0.5, 1.0])
    assert [r.n_splits for r in band.orderBy("grid").collect()] == [2, 2, 2]
    # three windows over the points (running sums, totals) and two of the interpolation
    assert band._jdf.queryExecution().optimizedPlan().toString().count("lead(pos") <= 2


def test_fits_read_their_texts_once(spark, sf):
    from riskspark.plans.model_queries import parts_of

    train, test = parts_of(spark, sf)
    assert "regexp_replace" not in plan_of(train) + plan_of(test)
    assert train.count() and test.count()


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_shuffled_in_pieces(n):
    from riskspark.core.order import PRIME, fifth, shuffled

    whole = shuffled(n, 12345)
    assert sorted(whole.tolist()) == list(range(n))
    assert np.concatenate([shuffled(n, 12345, at=slice(i, min(n, i + 3))) for i in range(0, n, 3)]).tolist() == whole.tolist()
    assert [fifth(x) for x in (0, 1, PRIME - 1, 123456789)] == [pow(x, 5, PRIME) for x in (0, 1, PRIME - 1, 123456789)]


def test_unsettled_lines_are_null_unless_asked_for(spark):
    from riskspark.operators import calibration as C

    apart = [("apart", int(i >= 30), 0.2 + 0.01 * i) for i in range(60)]  # the score separates the classes
    mixed = [("mixed", i % 2, 0.2 + 0.01 * i) for i in range(60)]
    df = spark.createDataFrame(apart + mixed, "g string, y_true int, y_prob double")
    strict, last = ({r.g: r for r in C.calibration_line(df, ["g"], settled_only=s).collect()} for s in (True, False))
    assert strict["apart"].slope is None and last["apart"].slope > 100
    assert strict["mixed"].slope == pytest.approx(last["mixed"].slope)
    for settled_only, want in ((True, False), (False, True)):
        got = {r.g: (r.fitted, r.converged) for r in C.fit_calibrator(df, "logistic_full", ["g"], settled_only=settled_only).collect()}
        assert got == {"apart": (want, False), "mixed": (True, True)}


@pytest.mark.parametrize("block, cells", [(4, 1 << 21), (8, 20), (1 << 16, 1 << 21)])
def test_rankings_are_counted_in_blocks(spark, monkeypatch, block, cells):
    """No task holds a whole ranking; absent ranks, a NULL key and a NULL model included."""
    from riskspark.core.order import PRIME, mixed_key, shuffled
    from riskspark.operators import consensus as G

    rng, data, want = np.random.default_rng(5), [], {}
    for g, n, models in (("a", 37, ["x", "y", None]), (None, 9, ["x", "y"]), ("b", 1, ["z"])):
        names = [f"f{i:02d}" for i in range(n)]
        ranks = {m: {f: int(k) for f, k in zip(names, rng.permutation(n) + 1) if n == 1 or (m, f) != ("x", "f03")} for m in models}
        data += [(g, m, f, k) for m in models for f, k in ranks[m].items()]
        digests = {r.model: r.d for r in spark.createDataFrame([(m,) for m in models], "model string").select("model", G.id_digest("model").alias("d")).collect()}
        miss = max(k for m in models for k in ranks[m].values()) + 1
        scores = {m: np.log([max(ranks[m].values()) / ranks[m].get(f, miss) for f in names]) for m in models}
        own = np.mean(list(scores.values()), 0)
        null = [np.mean([scores[m][shuffled(n, mixed_key(42, b, digests[m] % PRIME, digests[m] // PRIME))] for m in models], 0) for b in range(11)]
        want |= {(g, f): (np.exp(own[i]), sum(x[i] >= own[i] - 1e-9 for x in null)) for i, f in enumerate(names)}
    rows = spark.createDataFrame(data, "g string, model string, feature string, final_rank int").repartition(3)
    monkeypatch.setattr(G, "BLOCK", block)
    monkeypatch.setattr(G, "CELLS", cells)
    got = {(r.g, r.feature): (r.observed_rra, r.n_ge) for r in G.rra_permutation(rows, 11, keys=["g"]).collect()}
    assert got.keys() == want.keys()
    for k, (observed, n_ge) in want.items():
        assert got[k] == (pytest.approx(observed), n_ge)


def test_a_task_counts_few_cells_of_a_ranking():
    """Ten blocks of one model: what a block of positions gets in one part of the permutations is bounded."""
    import pyarrow as pa

    from riskspark.core.order import shuffled
    from riskspark.operators import consensus as G

    sent = []
    for block in range(10):
        at = np.arange(block * 8, min(75, block * 8 + 8))
        one = {"model": "m", "__digest": 7, "__n": 75, "__size": 8, "__step": 3}
        table = pa.RecordBatch.from_pydict({**{k: [v] * len(at) for k, v in one.items()}, "__block": [block] * len(at), "__pos": at + 1, "__l": at.astype(float)})
        sent += G._moved([], 7, 42)(iter([table]))
    sent = pa.Table.from_batches(sent).to_pylist()
    groups = {(r["__to"], r["__part"]): [] for r in sent}
    for r in sent:
        groups[r["__to"], r["__part"]].append(len(r["__l"]) // 8)
    assert set(groups) == {(to, part) for to in range(10) for part in range(3)}
    assert max(sum(g) for g in groups.values()) == 8 * (3 + 1)
    key = G.mixed_key(42, 4, 7, 0)
    moved = {r["__to"] * 8 + p: s for r in sent if r["__b"] == 4 for p, s in zip(np.frombuffer(r["__at"], np.uint16).tolist(), np.frombuffer(r["__l"]).tolist())}
    assert [moved[i] for i in range(75)] == shuffled(75, key).tolist()
    assert shuffled(75, key, inverse=True)[shuffled(75, key)].tolist() == list(range(75))
