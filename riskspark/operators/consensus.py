"""Rankings per model, their aggregation across models, permutation significance, consensus panels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..core.keys import join_on, ratio
from ..core.order import PRIME, id_digest, mixed_key, ordinal_rank, shuffled
from ..core.session import counted, cut_lineage
from .corr import cluster_features
from .significance import bh_adjust


def model_ranking(stability: DataFrame, importance: DataFrame | None = None, keys: Sequence[str] = ("model",), min_stability: float | None = None, *, limit: int | None = None) -> DataFrame:
    """Ordinal rank by importance (missing last) where a model has any, else by stability; ties by name.

    ``stability`` is (keys, feature, selection_fraction), ``importance`` (keys, feature, mean_importance).
    """
    keys = list(keys)
    rows = stability.select(*keys, "feature", F.col("selection_fraction").alias("stability_freq"))
    if min_stability is not None:
        rows = rows.filter(F.col("stability_freq") >= min_stability)
    if importance is not None:
        rows = join_on(rows, importance.select(*keys, "feature", F.col("mean_importance").alias("oof_importance")), [*keys, "feature"], "left")
    else:
        rows = rows.withColumn("oof_importance", F.lit(None).cast("double"))
    any_ = rows.groupBy(*keys).agg((F.count("oof_importance") > 0).alias("__has"))
    rows = join_on(rows, any_, keys).withColumn("__v", F.when(F.col("__has"), F.col("oof_importance")).otherwise(F.col("stability_freq")))
    out = ordinal_rank(rows, keys, [F.col("__v").desc_nulls_last(), F.col("feature")], "final_rank", measure=stability, limit=limit)
    return out.drop("__v", "__has")


def rank_aggregate(rankings: DataFrame, method: str = "geometric_mean", keys: Sequence[str] = (), models: Sequence[str] | None = None, *, limit: int | None = None) -> DataFrame:
    """Consensus score of (keys, model, feature, final_rank) rows.

    A feature a model lacks takes one missing rank, the largest rank of all
    models + 1; the score still uses each model's own largest rank.  Absent
    models enter through per-key totals, so features are never crossed with models.
    """
    if method not in ("geometric_mean", "borda", "median"):
        raise ValueError(f"unknown aggregation method {method}")
    keys = list(keys)
    r = rankings.filter(F.col("final_rank").isNotNull()).select(*keys, "model", "feature", F.col("final_rank").cast("double").alias("rk"))
    tops = r.groupBy(*keys, "model").agg(F.max("rk").alias("__max"))
    glob = tops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__k"), (F.max("__max") + 1).alias("__miss"), F.sum(F.log("__max")).alias("__lm"), F.sum("__max").alias("__sm")
    )
    per = r.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_models_present"), F.sum("rk").alias("__s"), F.sum(F.log("rk")).alias("__l"), F.avg("rk").alias("__m"), F.var_pop("rk").alias("__v"),
        F.array_sort(F.collect_list("rk")).alias("__list"),  # one entry per model
        *[F.max(F.when(F.col("model") == m, F.col("rk"))).alias(f"{m}_rank") for m in models or ()],
    )
    both = join_on(per, glob, keys)
    k, miss = F.col("__k"), F.col("__miss")
    gone = k - F.col("n_models_present")
    mean = (F.col("__s") + gone * miss) / k
    gap = F.col("__m") - mean
    m2 = F.col("n_models_present") * (F.col("__v") + gap * gap) + gone * (miss - mean) * (miss - mean)
    if method == "geometric_mean":
        score = F.exp((F.col("__lm") - F.col("__l") - gone * F.log(miss)) / k)
    elif method == "borda":
        score = (F.col("__sm") + 2 * k - F.col("__s") - gone * miss) / k
    else:
        full = F.array_sort(F.concat("__list", F.array_repeat(miss, gone.cast("int"))))
        mid = (F.element_at(full, F.floor((k + 1) / 2).cast("int")) + F.element_at(full, (F.floor(k / 2) + 1).cast("int"))) / 2.0
        score = miss - mid
    std = F.when(k > 1, F.sqrt(m2 / (k - 1))).otherwise(F.lit(0.0))
    out = both.select(
        *keys, "feature", score.alias("consensus_score"), "n_models_present", (F.col("n_models_present") / k).alias("presence_fraction"),
        std.alias("rank_std"), F.when(mean > 0, std / mean).otherwise(F.lit(0.0)).alias("rank_cv"), *[F.coalesce(f"{m}_rank", miss).alias(f"{m}_rank") for m in models or ()],
    )
    return ordinal_rank(out, keys, [F.round("consensus_score", 10).desc(), F.col("feature")], "consensus_rank", measure=rankings, limit=limit)


def shap_normalized_aggregate(scores: DataFrame, value: str = "oof_importance", keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """Signed, per-model min-max scaled score averaged over all models, absent = 0."""
    keys = list(keys)
    n = scores.groupBy(*keys).agg(F.count_distinct("model").alias("__k"))
    rows = scores.filter(F.col(value).isNotNull()).groupBy(*keys, "model", "feature").agg(F.min(value).alias("__v"))
    a = F.abs("__v")
    ends = rows.groupBy(*keys, "model").agg(F.min(a).alias("__lo"), F.max(a).alias("__hi"))
    both = join_on(rows, ends, [*keys, "model"])
    flat = F.abs(F.col("__hi") - F.col("__lo")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("__lo")
    norm = F.signum("__v") * F.when(flat, F.lit(1.0)).otherwise((a - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    agg = join_on(both.groupBy(*keys, "feature").agg(F.sum(norm).alias("__s"), F.count(F.lit(1)).alias("n_models_present")), n, keys)
    out = agg.select(
        *keys, "feature", (F.col("__s") / F.col("__k")).alias("shap_signed_score"), F.abs(F.col("__s") / F.col("__k")).alias("shap_magnitude_score"),
        "n_models_present", (F.col("n_models_present") / F.col("__k")).alias("presence_fraction"),
    )
    return ordinal_rank(out, keys, [F.round("shap_magnitude_score", 10).desc(), F.col("feature")], "shap_rank", measure=scores, limit=limit)


def rra_permutation(rankings: DataFrame, n_perms: int, universe: int | None = None, seed: int = 42, alpha: float = 0.05, keys: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """Significance of the geometric-mean score when each model's ranks are shuffled.

    In permutation b the feature at position i takes the rank of the feature at place s(i), s a keyed
    permutation per model (``core.order.shuffled``), so nothing is sorted or joined.  A task holds a block of places
    of one model, or the scores that some permutations bring to a block of positions, never a whole ranking.
    ``universe`` replaces the largest ranks and pads the FDR.
    """
    keys = list(keys)
    r = cut_lineage(rankings.select(*keys, "model", "feature", F.col("final_rank").cast("double").alias("rk")))
    # the tasks see places in the order of names, not names
    at = ordinal_rank(r.select(*keys, "feature").distinct(), keys, [F.col("feature").asc_nulls_last()], "__pos", limit=limit)
    at = cut_lineage(at.withColumn("__pos", F.col("__pos").cast("long")))
    tops = r.groupBy(*keys, "model").agg(F.max("rk").alias("__max"))
    glob = tops.groupBy(*keys).agg((F.max("__max") + 1).alias("__miss"), F.count(F.lit(1)).alias("__k"))
    glob = join_on(glob, at.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)
    # many blocks of a few thousand places, or blocks of few enough for all models together
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / F.col("__k")), F.greatest(F.lit(BLOCK >> 4), F.ceil(F.col("__n") / 64))))
    glob = glob.withColumn("__size", size.cast("long")).withColumn("__step", F.greatest(F.lit(1), F.floor(F.lit(CELLS) / (F.col("__size") * F.col("__k")))).cast("long"))
    tops = counted(join_on(tops.withColumn("__digest", id_digest("model")), glob, keys))
    full = join_on(join_on(at, tops, keys), r, [*keys, "model", "feature"], "left")
    top = F.lit(float(universe)) if universe else F.col("__max")
    score = F.log(top / F.coalesce("rk", "__miss"))
    block = F.floor((F.col("__pos") - 1) / F.col("__size")).cast("long")
    rows = full.select(*keys, "model", "__digest", "__n", "__size", "__step", block.alias("__block"), "__pos", score.alias("__l"))
    same = [f"`{k}` {t}" for k, t in rows.select(*keys, "model", "__digest", "__size").dtypes]
    sent = ", ".join([*same, "__to long", "__part long", "__b long", "__at binary", "__l binary"])
    # a number keeps adaptive plans from merging these partitions: a row is little, but counts once a permutation
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "model", "__block")
    moved = rows.groupBy(*keys, "model", "__block").applyInArrow(_moved(keys, n_perms, seed), sent)
    schema = ", ".join([*same[: len(keys)], "__pos long", "__o double", "n_ge long"])
    counts = moved.groupBy(*keys, "__to", "__part").applyInArrow(_exceedances(keys), schema)
    agg = counts.groupBy(*keys, "__pos").agg(F.max("__o").alias("__o"), F.sum("n_ge").alias("n_ge"))
    agg = cut_lineage(join_on(agg, at, [*keys, "__pos"]))
    out = agg.select(*keys, "feature", F.exp("__o").alias("observed_rra"), "n_ge", ((F.col("n_ge") + 1) / F.lit(float(n_perms + 1))).alias("perm_p"))
    out = bh_adjust(out, keys, "perm_p", "feature", universe, "bh_adjusted_p", limit=limit)
    return out.withColumn("significant", F.col("bh_adjusted_p") <= alpha)


#: Places in a block, at most (an offset in it has 16 bits), and scores that one task gets for a block of positions.
BLOCK = 1 << 16
CELLS = 1 << 21


def _moved(keys: Sequence[str], n_perms: int, seed: int):
    """A block of places of one model: its scores by the block of positions that each permutation takes them to.

    Rows of permutation -1 hold the scores where they are, once for each part of the permutations.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        n, size, step, block, digest = (table.column(f"__{c}")[0].as_py() for c in ("n", "size", "step", "block", "digest"))
        piece = slice(block * size, min(n, (block + 1) * size))
        at, score = table.column("__pos").to_numpy() - 1 - piece.start, table.column("__l").to_numpy()
        own, blocks = np.zeros(piece.stop - piece.start), -(-n // size)
        up = np.argsort(score, kind="stable")  # the best rank of a feature that comes twice
        own[at[up]] = score[up]

        def message(to: np.ndarray, part: np.ndarray, b: np.ndarray, ends: np.ndarray, place: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            ends = np.concatenate([[0], ends]).astype(np.int32)
            packed = [pa.BinaryArray.from_buffers(pa.binary(), len(to), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (place, score)]
            same = {k: pa.repeat(table.column(k)[0], len(to)) for k in (*keys, "model", "__digest", "__size")}
            return pa.RecordBatch.from_pydict({**same, "__to": to, "__part": part, "__b": b, "__at": packed[0], "__l": packed[1]})

        parts = np.arange(max(1, -(-n_perms // step)))
        for part in parts:
            one = np.array([part])
            yield message(one * 0 + block, one, one * 0 - 1, np.array([len(own)]), np.arange(len(own), dtype=np.uint16), own)
        many = max(1, BLOCK // size)
        for lo in range(0, n_perms, many):
            b = np.arange(lo, min(n_perms, lo + many))
            mixed = np.array([[mixed_key(seed, int(x), digest % PRIME, digest // PRIME)] for x in b], np.int64)
            pos = shuffled(n, mixed, at=piece, inverse=True)
            code = (pos // size + blocks * np.arange(len(b))[:, None]).ravel()
            order = np.argsort(code.astype(np.min_scalar_type(blocks * len(b))), kind="stable")
            sizes = np.bincount(code, minlength=blocks * len(b))
            some = np.flatnonzero(sizes)
            yield message(some % blocks, b[some // blocks] // step, b[some // blocks], np.cumsum(sizes)[some], (pos % size).astype(np.uint16).ravel()[order], np.tile(own, len(b))[order])

    return fn


def _exceedances(keys: Sequence[str]):
    """A block of positions and a part of the permutations: how often each feature's shuffled mean reaches its own."""

    def fn(table: pa.Table) -> pa.Table:
        to, size = (table.column(c)[0].as_py() for c in ("__to", "__size"))
        table = table.sort_by([("__b", "ascending"), ("__digest", "ascending"), ("model", "ascending")])
        models = pc.sum(pc.equal(table.column("__b"), -1)).as_py()
        n = len(table.column("__l")[0].as_py()) // 8
        at, score = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("__at", np.uint16), ("__l", float)))
        # every model brings one score to every position
        at, score = at.reshape(-1, models, n), score.reshape(-1, models, n)
        means = np.zeros((len(at), n))
        for mean, places, scores in zip(means, at, score, strict=True):
            for p, s in zip(places, scores, strict=True):
                mean[p] += s
        means /= models
        reached = (means[1:] >= means[0] - 1e-9).sum(0)
        same = {k: pa.chunked_array([pa.repeat(table.column(k)[0], n)]) for k in keys}
        return pa.table({**same, "__pos": to * size + np.arange(1, n + 1), "__o": means[0], "n_ge": reached})

    return fn


def cluster_representatives(consensus: DataFrame, pairs: DataFrame, threshold: float, *, limit: int | None = None) -> DataFrame:
    """Best consensus score of each cluster of correlated features, best clusters first."""
    comp = cluster_features(pairs, consensus, threshold)
    rows = join_on(consensus.select("feature", "consensus_score"), comp, ["feature"])
    best = rows.groupBy("component", "component_size").agg(F.min(F.struct((-F.round("consensus_score", 10)).alias("k"), F.col("feature"), F.col("consensus_score"))).alias("s"))
    out = best.select("component", "component_size", F.col("s.feature").alias("feature"), F.col("s.consensus_score").alias("consensus_score"))
    return ordinal_rank(out, [], [F.round("consensus_score", 10).desc(), F.col("feature")], "rank", limit=limit)


def consensus_panel(stability: DataFrame, importance: DataFrame | None, pairs: DataFrame, target: int, threshold: float = 0.75, min_stability: float | None = None, method: str = "geometric_mean", *, limit: int | None = None) -> DataFrame:
    """Rank per model, aggregate, cluster all ranked features, keep the first ``target`` representatives."""
    if stability.select("model").distinct().limit(2).count() < 2:
        raise ValueError("a consensus needs at least two models")
    ranks = model_ranking(stability, importance, ["model"], min_stability, limit=limit)
    cons = cut_lineage(rank_aggregate(ranks, method, limit=limit))
    keep = pairs.join(cons.select(F.col("feature").alias("a")), "a", "left_semi").join(cons.select(F.col("feature").alias("b")), "b", "left_semi")
    return cluster_representatives(cons, keep, threshold, limit=limit).filter(F.col("rank") <= target)


def consensus_uncertainty(panel: DataFrame, consensus: DataFrame) -> DataFrame:
    """Spread of the ranks behind each panel member."""
    return join_on(panel.select("feature", "rank"), consensus.select("feature", "n_models_present", "presence_fraction", "rank_std", "rank_cv"), ["feature"], "left")


def degenerate_models(rankings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Models whose ranking carries no order: constant importance and constant stability."""
    agg = rankings.groupBy(*keys, "model").agg(F.count_distinct("stability_freq").alias("n_stability"), F.count_distinct("oof_importance").alias("n_importance"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("degenerate", (F.col("n_stability") <= 1) & (F.col("n_importance") <= 1))


def presence_report(consensus: DataFrame, top: int = 50, share: float = 0.5) -> DataFrame:
    """How many of the leading features fewer than ``share`` of the models rank."""
    rows = consensus.filter(F.col("consensus_rank") <= top)
    return rows.agg(F.count(F.lit(1)).alias("n_top"), F.sum(F.when(F.col("presence_fraction") < share, 1).otherwise(0)).alias("n_low"), ratio(F.sum("n_models_present"), F.count(F.lit(1))).alias("mean_models"))


def with_shap(consensus: DataFrame, shap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Consensus rows with the normalised scores of ``shap_normalized_aggregate``; features without one get 0."""
    on = [*keys, "feature"]
    both = join_on(consensus, shap.select(*on, "shap_signed_score", "shap_magnitude_score"), on, "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("shap_signed_score", "shap_magnitude_score")})
