"""Correlation of features, clusters of correlated features, pruning and refilling panels.

Products are formed for pairs of column tiles inside tasks and summed by pair of tiles.  A pass
over the rows takes as many tiles as fit a task's budget, so no task holds the p x p matrix,
and of each summed tile only the pairs that are asked for leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..core.keys import join_on
from ..core.order import ordinal_rank
from ..core.quantile import quantiles
from ..core.session import cut_lineage

#: Columns of a tile, and bytes of tile products that one task holds at once.
BLOCK = 256
TASK_BYTES = 256 << 20
#: A value held by more than this share of a column's rows is ranked by broadcast, not by a shuffle on the value.
FREQUENT = 1e-3


def unpivot_features(df: DataFrame, features: Sequence[str], id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(id_col, *keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([id_col, *keep], list(features), "feature", "x")


def _vectors(df: DataFrame, names: Sequence[str], id_col: str) -> DataFrame:
    """(id, v): the columns as an array of doubles; NaN becomes NULL."""
    v = F.array(*[F.col(f"`{f}`").cast("double") for f in names])
    return df.select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.when(~F.isnan(x), x)).alias("v"))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode("v").alias("j", "x"))


def _filled(rows: DataFrame, p: int, *, limit: int | None = None) -> tuple[DataFrame, list[int]]:
    """Missing values replaced by the column's median; columns without any value become 0 and are listed."""
    have = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col("v")[j]).alias(str(j)) for j in range(p)]).first()
    empty = [j for j in range(p) if not have[str(j)]]
    holed = [j for j in range(p) if 0 < have[str(j)] < have["n"]]
    fill = [0.0] * p
    if holed:
        counts = _long(rows).filter(F.col("x").isNotNull() & F.col("j").isin(holed)).groupBy("j", "x").agg(F.count(F.lit(1)).alias("n"))
        for r in quantiles(counts, ["j"], "x", {"m": 0.5}, measure=rows, limit=limit).collect():  # one row per column
            fill[r.j] = r.m
    if holed or empty:
        medians = F.array(*[F.lit(float(m)) for m in fill])
        rows = rows.withColumn("v", F.transform("v", lambda x, j: F.coalesce(x, medians[j])))
    return rows, empty


def _ranked(rows: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Values replaced by their average rank in the column."""
    from ..core.order import average_rank

    long = _long(rows)
    ranks = cut_lineage(average_rank(long, ["j"], "x", "r", limit=limit))
    total = ranks.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(ranks.filter(F.col("n") > FREQUENT * total).select("j", "x", "r"))  # at most 1 / FREQUENT rows
    rest = ranks.filter(F.col("n") <= FREQUENT * total).select("j", "x", "r")
    both = long.join(often, ["j", "x"]).unionByName(long.join(often, ["j", "x"], "left_anti").join(rest, ["j", "x"]))
    return both.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "r"))), lambda s: s["r"]).alias("v"))


def _tiles(p: int, block: int) -> list[tuple[int, int]]:
    n = -(-p // block)
    return [(i, j) for i in range(n) for j in range(i, n)]


def _tile_products(tiles: list[tuple[int, int]], p: int, block: int, mean: np.ndarray, scale: np.ndarray):
    """Sums of products of standardised columns, for the given pairs of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            z = (m - mean) * scale
            for i, j in tiles:
                got = z[:, i * block : (i + 1) * block].T @ z[:, j * block : (j + 1) * block]
                if (i, j) in sums:
                    sums[i, j] += got
                else:
                    sums[i, j] = got
        for (i, j), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([s.ravel()], pa.list_(pa.float64()))], ["bi", "bj", "s"])

    return run


def _tile_pairs(names: Sequence[str], block: int, n: int, flat: np.ndarray, threshold: float | None):
    """Pairs a < b of summed tiles as rows; with a threshold only those at or above it."""
    p = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, s in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("s"), strict=True):
                wide = min(block, p - bj * block)
                r = np.minimum(np.abs(s.values.to_numpy().reshape(-1, wide)) / max(n - 1, 1), 1.0)
                i = bi * block + np.arange(r.shape[0])[:, None]
                j = bj * block + np.arange(wide)[None, :]
                bad = flat[i] | flat[j]
                ok = (i < j) & (~bad & (r >= threshold) if threshold is not None else True)
                at = np.nonzero(ok)
                a, b = i[at[0], 0], j[0, at[1]]
                for lo in range(0, len(a), 1 << 16):
                    cut = slice(lo, lo + (1 << 16))
                    values = pa.array(r[at][cut], mask=bad[at][cut])
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in a[cut]]), pa.array([names[k] for k in b[cut]]), values], ["a", "b", "abs_corr"])

    return run


def correlation_pairs(df: DataFrame, features: Sequence[str], method: str = "pearson", id_col: str = "id", block: int | None = None, threshold: float | None = None, *, limit: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(a, b, abs_corr) for pairs a < b after median imputation, all of them or those at or above ``threshold``.

    A constant column, or one without any value, has NULL correlations and costs the others
    nothing.  Pearson reads the rows where they are; Spearman regroups them once by rank.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown correlation method {method}")
    names = sorted(features)
    p = len(names)
    spark = df.sparkSession
    if p < 2:
        return spark.createDataFrame([], "a string, b string, abs_corr double")
    block = min(block or BLOCK, p)
    rows = cut_lineage(_vectors(df, names, id_col))
    if rows.isEmpty():
        return spark.createDataFrame([], "a string, b string, abs_corr double")
    rows, empty = _filled(rows, p, limit=limit)
    if method == "spearman":
        rows = cut_lineage(_ranked(rows, limit=limit))
    stats = rows.select(Summarizer.metrics("count", "mean", "std").summary(array_to_vector("v")).alias("s")).select("s.*").first()
    mean, sd = stats["mean"].toArray(), stats["std"].toArray()
    flat = sd <= 1e-13 * np.abs(mean)
    flat[empty] = True
    scale = np.divide(1.0, sd, out=np.zeros(p), where=~flat)
    tiles = _tiles(p, block)
    each = max(1, task_bytes // (8 * block * block))
    parts = [rows.select("v").mapInArrow(_tile_products(tiles[k : k + each], p, block, mean, scale), "bi int, bj int, s array<double>") for k in range(0, len(tiles), each)]
    summed = reduce(DataFrame.unionByName, parts).groupBy("bi", "bj").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
    summed = summed.select("bi", "bj", vector_to_array("s").alias("s"))
    return summed.mapInArrow(_tile_pairs(names, block, stats["count"], flat, threshold), "a string, b string, abs_corr double")


def high_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.filter(F.col("abs_corr") >= threshold).orderBy(F.desc("abs_corr"), "a", "b")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node name reachable; isolated nodes are their own component.

    Labels move along edges (combined map-side) and jump through the label of
    their label, so the rounds grow with the logarithm of the path length.  Ends when
    no label changes.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(F.col("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("__c"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("__old"), F.least("component", F.coalesce("__c", "component")).alias("component"))
        jump = step.select(F.col("node").alias("__n"), F.col("component").alias("__j"))
        step = step.join(jump, F.col("component") == F.col("__n"), "left").select("node", "__old", F.least("component", F.coalesce("__j", "component")).alias("component"))
        step = cut_lineage(step)
        labels = step.select("node", "component")
        if step.filter(F.col("__old") != F.col("component")).isEmpty():
            return labels


def cluster_features(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """(feature, component, size) of the graph of pairs at or above the threshold."""
    comp = components(pairs.filter(F.col("abs_corr") >= threshold), features.select(F.col("feature").alias("node")))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return join_on(comp, size, ["component"]).select(F.col("node").alias("feature"), "component", "component_size")


def prune_correlated(pairs: DataFrame, freq: DataFrame, threshold: float, strength: DataFrame | None = None, *, limit: int | None = None) -> DataFrame:
    """Mapping feature -> component, representative and kept flag.

    The representative has the highest frequency, then (if given) the smallest p
    and the largest effect, then the first name.  ``freq`` holds (feature, selection_freq).
    """
    comp = cluster_features(pairs, freq, threshold)
    rows = join_on(comp, freq.select("feature", "selection_freq"), ["feature"], "left").withColumn("__f", -F.coalesce("selection_freq", F.lit(0.0)))
    if strength is not None:
        rows = join_on(rows, strength.select("feature", "p_value", "effect_size"), ["feature"], "left")
        key = [F.col("__f"), F.coalesce("p_value", F.lit(1.0)).alias("__p"), (-F.coalesce("effect_size", F.lit(0.0))).alias("__e"), F.col("feature")]
    else:
        key = [F.col("__f"), F.col("feature")]
    rep = rows.groupBy("component").agg(F.min(F.struct(*key)).alias("s")).select("component", F.col("s.feature").alias("representative"))
    out = join_on(rows, rep, ["component"])
    return out.select("feature", "component", "component_size", "representative", (F.col("feature") == F.col("representative")).alias("kept"))


def greedy_independent(ranked: DataFrame, conflicts: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Candidates a serial walk down the ranking would accept.

    ``ranked`` is (feature, rank); ``conflicts`` holds (a, b).  In each round every
    undecided candidate without a better-ranked undecided neighbour is accepted
    and its neighbours are dropped: the same set as the one-by-one walk.  A round
    decides the best undecided candidate at least, so the loop ends.
    """
    links = conflicts.select(F.col("a").alias("u"), F.col("b").alias("v")).union(conflicts.select("b", "a")).distinct()
    state = ranked.select("feature", F.col("rank").cast("bigint").alias("rank"), F.lit(0).alias("state"))
    if kept is not None:
        fixed = kept.select("feature").distinct().withColumn("__k", F.lit(1))
        state = join_on(state, fixed, ["feature"], "left").select("feature", F.when(F.col("__k") == 1, F.col("rank") - F.lit(1 << 40)).otherwise(F.col("rank")).alias("rank"), F.coalesce("__k", F.lit(0)).alias("state"))
    state = cut_lineage(state)
    links = cut_lineage(links.join(state.select(F.col("feature").alias("u")), "u", "left_semi").join(state.select(F.col("feature").alias("v")), "v", "left_semi"))
    while True:
        # neighbours of accepted features are out
        hit = links.join(state.filter("state = 1").select(F.col("feature").alias("u")), "u", "left_semi").select(F.col("v").alias("feature")).distinct().withColumn("__h", F.lit(1))
        state = join_on(state, hit, ["feature"], "left").select("feature", "rank", F.when((F.col("state") == 0) & (F.col("__h") == 1), F.lit(-1)).otherwise(F.col("state")).alias("state"))
        open_ = state.filter("state = 0").select(F.col("feature").alias("u"), F.col("rank").alias("__ru"))
        best = links.join(open_, "u").groupBy(F.col("v").alias("feature")).agg(F.min("__ru").alias("__best"))
        state = join_on(state, best, ["feature"], "left")
        free = (F.col("state") == 0) & (F.col("__best").isNull() | (F.col("__best") > F.col("rank")))
        state = cut_lineage(state.select("feature", "rank", F.when(free, F.lit(1)).otherwise(F.col("state")).alias("state")))
        if state.filter("state = 0").isEmpty():
            return state.filter("state = 1").select("feature", "rank")


def refill_panel(kept: DataFrame, ranked: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Kept features plus all ranked candidates below the threshold to everything accepted, ``size`` in all."""
    cand = ordinal_rank(ranked.select("feature", F.col("rank").alias("__r")), [], [F.col("__r"), F.col("feature")], "rank").drop("__r")
    bad = pairs.filter(F.col("abs_corr") >= threshold)
    got = greedy_independent(cand, bad, kept)
    extra = join_on(got, kept.select("feature"), ["feature"], "left_anti")
    base = ordinal_rank(kept.select("feature", F.col("rank").alias("__r")), [], [F.col("__r"), F.col("feature")], "position").select("feature", "position", F.lit("kept").alias("source"))
    n = kept.agg(F.count(F.lit(1)).alias("__n"))
    more = ordinal_rank(extra, [], [F.col("rank"), F.col("feature")], "__p").join(F.broadcast(n), F.lit(True), "inner")  # one row
    more = more.select("feature", (F.col("__p") + F.col("__n")).alias("position"), F.lit("refill").alias("source"))
    return base.unionByName(more).filter(F.col("position") <= size)


def prune_and_refill(pairs: DataFrame, freq: DataFrame, size: int, threshold: float, strength: DataFrame | None = None) -> DataFrame:
    """Representatives by frequency, then refilled to the wanted size from the full ranking."""
    mapping = prune_correlated(pairs, freq, threshold, strength)
    ranked = ordinal_rank(freq, [], [F.col("selection_freq").desc(), F.col("feature")], "rank")
    kept = join_on(ranked, mapping.filter("kept").select("feature"), ["feature"], "left_semi")
    kept = ordinal_rank(kept.drop("rank"), [], [F.col("selection_freq").desc(), F.col("feature")], "rank").filter(F.col("rank") <= size)
    return refill_panel(kept, ranked, pairs, size, threshold)


def interleave(streams: DataFrame, *, score: str = "score", limit: int | None = None) -> DataFrame:
    """Round-robin over streams ordered by their best score: first members, then second members, ...

    ``streams`` is (feature, component, score).
    """
    rows = streams.withColumn(score, F.coalesce(score, F.lit(0.0)))
    inner = ordinal_rank(rows, ["component"], [F.col(score).desc(), F.col("feature")], "round", limit=limit)
    best = rows.groupBy("component").agg(F.max(score).alias("__best"))
    both = join_on(inner, best, ["component"])
    return ordinal_rank(both, [], [F.col("round"), F.col("__best").desc(), F.col("component")], "position", limit=limit).select("feature", "component", "round", "position")
