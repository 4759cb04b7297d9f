"""Orders that hold at scale: seeded hash order and running aggregates.

A window without a small partition key pulls all its rows into one task.  The
helpers here split every ordered group in two levels: a *place* (an
order-preserving piece of the group) and the rows inside it.  Windows run per
(keys, place); the small table of per-place totals gives each place its offset.

For hash orders the place is the top bits of the hash, so nothing is measured.
For value orders the rows are counted first: up to ``ROWS_PER_TASK`` rows an
ordinary window is used, above that the rows are range-partitioned and
checkpointed, which fixes the place of each row for all later readers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from .keys import col_of, join_on
from .session import counted, cut_lineage

ROWS_PER_TASK = 4_000_000
HASH_BITS = 12


def hash_order(seed: Column | int | str, *cols: Column | str) -> Column:
    """Seeded 32-bit order key: first 8 hex digits of md5('seed:col:...')."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", head.cast("string"), *[col_of(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# The Mersenne prime 2^31 - 1 and the round constants of the draw.
PRIME = 2147483647
ROUND_CONSTANTS = (1013904223, 1664525, 22695477, 69069)


def power_mix(df: DataFrame, name: str, parts: Sequence[Column]) -> DataFrame:
    """Adds a 31-bit pseudo-random integer: x -> (x + part + c)^5 mod 2^31-1 per part.

    The fifth power is a permutation modulo this prime, costs three integer
    products, stays inside codegen and is the same in any SQL engine.
    """
    x = F.lit(0).cast("bigint")
    tmp = []
    for i, part in enumerate(parts):
        s, q = f"__{name}s{i}", f"__{name}q{i}"
        df = df.withColumn(s, (x + part.cast("bigint") + F.lit(ROUND_CONSTANTS[i % 4])) % PRIME)
        df = df.withColumn(q, (F.col(s) * F.col(s)) % PRIME)
        x = ((F.col(q) * F.col(q)) % PRIME * F.col(s)) % PRIME
        df = df.withColumn(f"__{name}x{i}", x)
        x = F.col(f"__{name}x{i}")
        tmp += [s, q, f"__{name}x{i}"]
    return df.withColumn(name, x).drop(*tmp)


def _folded(x: np.ndarray | int):
    """x modulo the Mersenne prime for 0 <= x < 2^62, up to PRIME itself for its multiples."""
    x = (x & PRIME) + (x >> 31)
    return (x & PRIME) + (x >> 31)


def fifth(x: np.ndarray | int):
    """The fifth power modulo ``PRIME`` of integers below it: a permutation, and the same in any SQL engine."""
    q = _folded(x * x)
    return _folded(_folded(q * q) * x)


def shuffled(n: int, key: int | np.ndarray, rounds: int = 32, at: slice | None = None, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, or a piece of it, without a sort: in each round pairs (x, k - x) swap or not by a hash of the larger one.

    A round undoes itself, so the ``inverse`` takes them backwards.  A column of keys gives one row each.
    """
    x = np.arange(n, dtype=np.int64) if at is None else np.arange(at.start, at.stop, dtype=np.int64)
    for r in reversed(range(rounds)) if inverse else range(rounds):
        h = fifth((key + r + ROUND_CONSTANTS[0]) % PRIME)
        other = h % n - x
        other += n * (other < 0)
        swap = fifth((h + np.maximum(x, other) + ROUND_CONSTANTS[1]) % PRIME) >> 7 & 1
        x = np.where(swap == 1, other, x)
    return x


def mixed_key(*parts: int) -> int:
    """One integer below ``PRIME`` from several: ``power_mix`` for plain numbers."""
    x = 0
    for i, part in enumerate(parts):
        x = fifth((x + part + ROUND_CONSTANTS[i % 4]) % PRIME)
    return x


def id_digest(*cols: Column | str) -> Column:
    """60-bit integer of an id: first 15 hex digits of md5; computed once per row, not per seed."""
    text = F.concat_ws(":", *[col_of(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def mixed_order(df: DataFrame, name: str, seeds: Sequence[Column], digest: str) -> DataFrame:
    """Seeded 31-bit order key from a digest column: arithmetic only, so many seeds per row stay cheap."""
    return power_mix(df, name, [*seeds, F.col(digest) % PRIME, F.expr(f"{digest} div {PRIME}")])


def place_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    measure: DataFrame | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, str | None]:
    """Give each row a place if the table is too large for one task to order.

    ``measure`` is a cheaper table with at least as many rows per key.
    """
    limit = ROWS_PER_TASK if limit is None else limit
    n = (df if measure is None else measure).count()
    if n <= limit:
        return df, None
    parts = min(20_000, max(2, -(-2 * n // max(limit, 1))))
    spread = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut_lineage(spread.withColumn("__place", F.spark_partition_id())), "__place"


def value_places(df: DataFrame, value: str, *, measure: DataFrame | None = None, score: Column | None = None, limit: int | None = None) -> tuple[DataFrame, str | None]:
    """Places for an order by a number, if the table is too large for one task to order: 0 for the least values.

    ``measure`` is a cheaper table with at least as many rows per key, and ``score`` the value in it. A place
    follows from the value alone, so it needs no checkpoint, and rows dealt by (keys, place) stay there.
    """
    limit = ROWS_PER_TASK if limit is None else limit
    n = (df if measure is None else measure).count()
    if n <= limit:
        return df, None
    parts = min(4096, max(2, -(-2 * n // max(limit, 1))))
    source, at = (df, F.col(value)) if measure is None or score is None else (measure, score)
    cuts = source.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("c")).first().c or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="__place").transform(df), "__place"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    aggs: dict[str, tuple[str, Column]],
    place: str | None = None,
) -> DataFrame:
    """Inclusive running sum/max/min per key in the given order."""
    keys = list(keys)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    local = [*keys, place] if place else keys
    w = Window.partitionBy(*local).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not place:
        return df.withColumns({n: fn[how](c).over(w) for n, (how, c) in aggs.items()})
    totals = df.groupBy(*local).agg(*[fn[how](c).alias(f"__t_{n}") for n, (how, c) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *local, *[fn[how](f"__t_{n}").over(before).alias(f"__o_{n}") for n, (how, _) in aggs.items()]
    )
    out = join_on(df.withColumns({n: fn[how](c).over(w) for n, (how, c) in aggs.items()}), offsets, local)
    merged = {}
    for n, (how, _) in aggs.items():
        o = F.col(f"__o_{n}")
        if how == "sum":
            merged[n] = F.coalesce(F.col(n) + o, F.col(n), o)
        else:
            merged[n] = (F.greatest if how == "max" else F.least)(F.col(n), o)
    return out.withColumns(merged).drop(*[f"__o_{n}" for n in aggs])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    prev: dict[str, str] | None = None,
    nxt: dict[str, str] | None = None,
    place: str | None = None,
) -> DataFrame:
    """lag/lead columns; across places through a self join on the row number."""
    prev, nxt = prev or {}, nxt or {}
    keys = list(keys)
    if not place:
        w = Window.partitionBy(*keys).orderBy(*order)
        cols = {n: F.lag(c).over(w) for n, c in prev.items()}
        cols.update({n: F.lead(c).over(w) for n, c in nxt.items()})
        return df.withColumns(cols)
    out = running(df, keys, order, {"__rn": ("sum", F.lit(1))}, place)
    for cols, step in ((prev, 1), (nxt, -1)):
        if cols:
            near = out.select(
                *keys, (F.col("__rn") + step).alias("__rn"), *[F.col(c).alias(n) for n, c in cols.items()]
            )
            out = join_on(out, near, [*keys, "__rn"], "left")
    return out.drop("__rn")


def ordinal_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    *,
    measure: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """1..n per key in the given (total) order."""
    placed, place = place_rows(df, keys, order, measure=measure, limit=limit)
    out = running(placed, keys, order, {name: ("sum", F.lit(1))}, place)
    return out.drop(place) if place else out


def dense_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "rank",
    *,
    ascending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Rank of the value among the distinct values of its key, from 1; equal values share a rank, NULL and NaN come last as one value.

    Only distinct values are ordered, by places if there are many of them.
    """
    rows = df.withColumn("__v", F.when(~F.isnan(value), F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value))
    values = rows.select(*keys, "__v").distinct()
    order = F.col("__v").asc_nulls_last() if ascending else F.col("__v").desc_nulls_last()
    ranks = ordinal_rank(values, keys, [order], name, limit=limit)
    return join_on(rows, ranks, [*keys, "__v"]).drop("__v")


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "avg_rank",
    *,
    measure: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct (keys, value) rows with count ``n`` and the mid-rank of their ties."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col(value)]
    placed, place = place_rows(counts, keys, order, measure=df if measure is None else measure, limit=limit)
    out = running(placed, keys, order, {"__upto": ("sum", F.col("n"))}, place)
    out = out.withColumn(name, F.col("__upto") - (F.col("n") - 1) / F.lit(2.0).cast("double"))
    return out.drop("__upto", *([place] if place else []))


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: Column | int | str,
    name: str = "rn",
    *,
    bits: int = HASH_BITS,
    salt: Sequence[Column | str] = (),
) -> DataFrame:
    """1..n per key in seeded hash order (ties by id); one hot key still spreads."""
    out = df.withColumn("__h", hash_order(seed, *salt, id_col))
    out = out.withColumn("__place", F.shiftrightunsigned(F.col("__h"), 32 - bits))
    out = running(out, keys, [F.col("__h"), F.col(id_col)], {name: ("sum", F.lit(1))}, "__place")
    return out.drop("__h", "__place")


def hash_within(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: Column | int | str,
    limits: DataFrame,
    names: Sequence[str],
    *,
    bits: int = HASH_BITS,
    salt: Sequence[Column | str] = (),
    digest: str | None = None,
) -> DataFrame:
    """Replace limit columns by flags: is the row among the first ``limit`` of its key in hash order?

    ``limits`` holds the key columns and one count per name.  Counts per place
    show in which place each cut falls; only the rows of those places are
    ordered, to find the row at the cut.  All other rows are compared with the
    cut where they are, so the table itself is never shuffled.  With ``digest``
    (an ``id_digest`` column) the order key is mixed from it and an integer seed.
    """
    keys, names = list(keys), list(names)
    if digest is None:
        rows, width = df.withColumn("__h", hash_order(seed, *salt, id_col)), 32
    else:
        rows, width = mixed_order(df, "__h", [col_of(seed)], digest).drop(digest), 31
    place = F.shiftrightunsigned(F.col("__h"), width - bits)
    sizes = rows.groupBy(*keys, place.alias("__place")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    cum = join_on(sizes.withColumn("__upto", F.sum("__n").over(upto)), limits.select(*keys, *names), keys)
    cum = cut_lineage(cum)
    before = F.col("__upto") - F.col("__n")
    pairs = [F.when((F.col(c) > before) & (F.col(c) <= F.col("__upto")), F.struct(F.lit(c).alias("__cut"), (F.col(c) - before).cast("bigint").alias("__k"))) for c in names]
    bounds = counted(cum.select(*keys, "__place", F.inline(F.filter(F.array(*pairs), lambda x: x.isNotNull()))))
    edge = join_on(rows.select(*keys, place.alias("__place"), "__h", F.col(id_col).alias("__id")), bounds.select(*keys, "__place").distinct(), [*keys, "__place"], "left_semi")
    w = Window.partitionBy(*keys, "__place").orderBy("__h", "__id")
    edge = edge.withColumn("__k", F.row_number().over(w).cast("bigint"))
    at = join_on(edge, bounds, [*keys, "__place", "__k"])
    found = at.groupBy(*keys).agg(*[F.max(F.when(F.col("__cut") == c, F.struct("__h", "__id"))).alias(f"__at_{c}") for c in names])
    total = cum.groupBy(*keys).agg(F.max("__upto").alias("__total"), *[F.max(c).alias(f"__lim_{c}") for c in names])
    cuts = counted(join_on(total, found, keys, "left"))
    out = join_on(rows, cuts, keys)
    flags = {}
    for c in names:
        a = F.col(f"__at_{c}")
        inside = (F.col("__h") < a["__h"]) | ((F.col("__h") == a["__h"]) & (F.col(id_col) <= a["__id"]))
        flags[c] = F.coalesce((F.col(f"__lim_{c}") >= F.col("__total")) | inside, F.lit(False))
    return out.withColumns(flags).drop("__h", "__total", *[f"__{k}_{c}" for c in names for k in ("at", "lim")])
