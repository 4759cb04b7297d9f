"""Isotonic calibration for any number of keys, by pooling adjacent violators in ranges.

The score histogram is range-partitioned by (keys, score).  A task reads its range in order
and pools neighbours whose rates fall, keeping one stack of blocks per key.  A key that spans
ranges may still fall where two of them meet; then the blocks, now far fewer, are dealt into
other ranges and pooled again, until no key falls anywhere.  Neither a key nor the histogram
ever meets in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..core.keys import join_on
from ..core.order import neighbours, place_rows, running
from ..core.session import cut_lineage
from .hist import score_histogram

#: Blocks that one task pools.
RANGE_ROWS = 1_000_000


def _pool(n_keys: int):
    """Sorted (keys..., lo, hi, n, pos) in, pooled blocks out, with the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        now, schema = None, None

        def out(blocks: list[list]) -> pa.RecordBatch:
            cols = list(zip(*blocks, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], [f.name for f in schema])

        for batch in batches:
            schema = schema or list(batch.schema)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[:n_keys]
                if key != now:
                    if stack:
                        yield out(stack)
                    stack, now = [], key
                block = list(row)
                while stack and stack[-1][-1] * block[-2] >= block[-1] * stack[-1][-2]:
                    before = stack.pop()
                    block = [*key, before[-4], block[-3], before[-2] + block[-2], before[-1] + block[-1]]
                stack.append(block)
        if stack:
            yield out(stack)

    return run


def isotonic_blocks(hist: DataFrame, keys: Sequence[str], *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Blocks (keys, lo, hi, n, pos) of the isotonic fit of ``hist`` (keys, p, pos, neg): scores lo to hi have rate pos / n."""
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    blocks = hist.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("p").alias("lo"), F.col("p").alias("hi"), (F.col("pos") + F.col("neg")).cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    schema = ", ".join(f"{c} {t}" for c, t in blocks.dtypes)
    blocks = cut_lineage(blocks)
    odd = 0
    while True:
        parts = max(1, -(-blocks.count() // range_rows)) + odd
        order = [*names, "lo"]
        dealt = blocks.repartitionByRange(parts, *order) if parts > 1 else blocks.coalesce(1)
        done = dealt.sortWithinPartitions(*order).mapInArrow(_pool(len(keys)), schema).withColumn("__part", F.spark_partition_id())
        blocks = cut_lineage(done)
        if parts == 1:
            break
        # First and last block of each key in each range: where ranges of a key meet, does the rate still fall?
        ends = blocks.groupBy(*names, "__part").agg(F.min(F.struct("lo", "pos", "n")).alias("first"), F.max(F.struct("lo", "pos", "n")).alias("last"))
        before = F.lag("last").over(Window.partitionBy(*names).orderBy("__part")) if names else F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("__part"))
        falls = ends.withColumn("before", before).filter("before.pos * first.n >= first.pos * before.n")
        if falls.isEmpty():
            break
        # One range more than needed every other time, so that the same rows do not meet the same border again.
        blocks, odd = blocks.drop("__part"), 1 - odd
    return blocks.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "lo", "hi", "n", "pos")


def fit_isotonic(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", min_rows: int = 50, *, limit: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Isotonic calibrators per key: one row a block (keys, method, lo, hi, n, pos, value, next_lo, next_value, fitted).

    Groups with fewer than ``min_rows`` finite rows or one class have one row with ``fitted`` false and later keep their scores.
    """
    keys = list(keys)
    hist = cut_lineage(score_histogram(df, keys, y, p))
    sizes = hist.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    ok = (F.col("__p") + F.col("__n") >= min_rows) & (F.col("__p") > 0) & (F.col("__n") > 0)
    good = sizes.filter(ok)
    blocks = isotonic_blocks(join_on(hist, good.select(*keys), keys, "left_semi"), keys, range_rows=range_rows)
    blocks = blocks.withColumn("value", F.col("pos") / F.col("n"))
    placed, place = place_rows(blocks, keys, [F.col("lo")], limit=limit)
    out = neighbours(placed, keys, [F.col("lo")], nxt={"next_lo": "lo", "next_value": "value"}, place=place)
    out = out.select(*keys, F.lit("isotonic").alias("method"), "lo", "hi", "n", "pos", "value", "next_lo", "next_value", F.lit(True).alias("fitted"))
    none = [F.lit(None).cast("double").alias(c) for c in ("lo", "hi")] + [F.lit(None).cast("long").alias(c) for c in ("n", "pos")] + [F.lit(None).cast("double").alias(c) for c in ("value", "next_lo", "next_value")]
    left = sizes.filter(~ok).select(*keys, F.lit("isotonic").alias("method"), *none, F.lit(False).alias("fitted"))
    return cut_lineage(out.unionByName(left))


def apply_isotonic(df: DataFrame, calibrator: DataFrame, keys: Sequence[str] = (), p: str = "y_prob", out: str = "y_prob_calibrated", *, limit: int | None = None) -> DataFrame:
    """Calibrated score: a block's rate inside it, linear between blocks, the nearest block's beyond the ends.

    Distinct scores and block starts are ordered together once; each score takes the last block that starts at or before it.
    """
    keys = list(keys)
    blocks = calibrator.filter("fitted").select(*keys, "lo", "hi", "value", "next_lo", "next_value")
    first = blocks.groupBy(*keys).agg(F.min(F.struct("lo", "value")).alias("__first"))
    scores = df.filter(F.col(p).isNotNull() & ~F.isnan(p)).select(*keys, F.col(p).cast("double").alias("__x")).distinct()
    scores = join_on(scores, first, keys).withColumn("__lo", F.lit(None).cast("double"))
    both = scores.select(*keys, "__x", "__lo").unionByName(blocks.select(*keys, F.col("lo").alias("__x"), F.col("lo").alias("__lo")))
    order = [F.col("__x"), F.col("__lo").isNull().cast("int")]
    placed, place = place_rows(both, keys, order, measure=df, limit=limit)
    found = running(placed, keys, order, {"__at": ("max", F.col("__lo"))}, place).filter("__lo IS NULL").select(*keys, "__x", "__at")
    found = join_on(found, first, keys)
    found = join_on(found, blocks.withColumn("__at", F.col("lo")), [*keys, "__at"], "left")
    between = F.col("value") + (F.col("next_value") - F.col("value")) * (F.col("__x") - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    value = F.when(F.col("lo").isNull(), F.col("__first.value")).when((F.col("__x") <= F.col("hi")) | F.col("next_lo").isNull(), F.col("value")).otherwise(between)
    table = found.select(*keys, "__x", value.alias("__cal"))
    rows = join_on(df.withColumn("__x", F.col(p).cast("double")), table, [*keys, "__x"], "left")
    keep = F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p).cast("double"))
    return rows.withColumn(out, F.coalesce("__cal", keep)).drop("__x", "__cal")
