"""Score histograms and the curve points every ranking metric is read from.

``score_histogram`` shrinks the scored table to one row per (keys, distinct
score) with map-side partial sums, so ties never travel twice and a single hot
score cannot overload a task.  ``curve_points`` adds cumulative counts from the
highest score down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core.keys import col_of, finite
from ..core.order import value_places


def clean_scores(df: DataFrame, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Rows with a finite score and a 0/1 label."""
    return df.filter(finite(F.col(p).cast("double")) & F.col(y).isin(0, 1))


def score_histogram(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y_true",
    p: str = "y_prob",
    weight: Column | str | None = None,
) -> DataFrame:
    """(keys, p, pos, neg): positives and negatives at each distinct score."""
    w = F.lit(1).cast("bigint") if weight is None else col_of(weight)
    label = F.col(y).cast("bigint")
    rows = clean_scores(df, y, p)
    return (
        rows.select(*keys, (F.col(p).cast("double") + F.lit(0.0)).alias("p"), (label * w).alias("__p"), ((1 - label) * w).alias("__n"))
        .groupBy(*keys, "p")
        .agg(F.sum("__p").alias("pos"), F.sum("__n").alias("neg"))
    )


def curve_points(
    hist: DataFrame,
    keys: Sequence[str] = (),
    *,
    measure: DataFrame | None = None,
    p: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Histogram plus tp, fp (score >= p), class totals and ROC point pruning.

    ``measure`` is a cheaper table with at least as many rows per key, ``p`` its score column.  A large
    histogram is dealt by key and place of the score once; what a place needs from the
    others goes along as two rows of its own.

    ``keep`` marks the points an ROC curve keeps when collinear inner points
    are dropped: the ends and every change of slope.
    """
    keys = list(keys)
    order = [F.col("p").desc()]
    score = None if p is None else F.when(finite(F.col(p).cast("double")), F.col(p).cast("double"))
    rows, place = value_places(hist, "p", measure=measure, score=score, limit=limit)
    if place:
        rows = rows.unionByName(_edges(rows, keys, place), allowMissingColumns=True)
        order = [F.coalesce("__at", F.lit(0)), *order]
    by = Window.partitionBy(*keys, *([place] if place else []))
    along = by.orderBy(*order)
    down = along.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.first(f"__n_{c}").over(down) if place else F.sum(c).over(by)
    out = rows.withColumns({
        "tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "n_pos": total("pos"), "n_neg": total("neg"),
        "__np": F.lead("pos").over(along), "__nn": F.lead("neg").over(along),
    })
    if place:
        out = out.filter("__at IS NULL").drop("__at", "__n_pos", "__n_neg", place)
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    keep = first | F.col("__np").isNull() | (F.col("__np") != F.col("pos")) | (F.col("__nn") != F.col("neg"))
    return out.withColumn("keep", keep).drop("__np", "__nn")


def _edges(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Two rows per key and place: the counts above it go first, the next score below it goes last (``__at``: -1 and 1)."""
    ends = rows.groupBy(*keys, place).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max_by(F.struct("pos", "neg"), "p").alias("__top"))
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col(place).desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *keys, place, F.sum("pos").over(whole).alias("__n_pos"), F.sum("neg").over(whole).alias("__n_neg"),
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"__a_{c}") for c in ("pos", "neg")], F.lead("__top").over(down).alias("__next"),
    )
    at = lambda i, pos, neg: F.struct(F.lit(i).alias("__at"), pos.alias("pos"), neg.alias("neg"))
    marks = F.array(at(-1, F.col("__a_pos"), F.col("__a_neg")), at(1, F.col("__next.pos"), F.col("__next.neg")))
    return ends.select(*keys, place, "__n_pos", "__n_neg", F.inline(marks))


def points_of(df: DataFrame, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_prob", *, limit: int | None = None) -> DataFrame:
    """Scored rows to curve points."""
    return curve_points(score_histogram(df, keys, y, p), keys, measure=df, p=p, limit=limit)
