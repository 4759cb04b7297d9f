"""Scalar functions as Column expressions (they stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..core.keys import col_of, finite


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def logit(p: Column | str, eps: float = 1e-7) -> Column:
    q = clip(col_of(p).cast("double"), eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def inv_logit(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(z)))


def jeffreys(k: Column | str, n: Column | str, a: float = 0.5) -> Column:
    """Smoothed rate; null when the smoothed count is zero."""
    return (col_of(k) + F.lit(a)) / (col_of(n) + F.lit(2.0 * a))


def adjust_prevalence(p: Column | str, sample: Column, target: Column) -> Column:
    """Shift on the log-odds scale from the sample to the target prevalence."""
    p = col_of(p)
    usable = finite(sample) & finite(target) & (sample > 0) & (sample < 1) & (target > 0) & (target < 1)
    shifted = inv_logit(logit(p, 1e-9) + logit(target, 1e-9) - logit(sample, 1e-9))
    return F.when(usable, clip(shifted, 1e-9, 1.0 - 1e-9)).otherwise(p)


def net_benefit(tp: Column, fp: Column, n: Column, t: Column) -> Column:
    return F.when((t > 0) & (t < 1) & (n > 0), tp / n - fp / n * (t / (F.lit(1.0) - t)))


def treat_all(prevalence: Column, t: Column) -> Column:
    return F.when((t > 0) & (t < 1), prevalence - (F.lit(1.0) - prevalence) * (t / (F.lit(1.0) - t)))


def purity(base: Column, other: Column) -> dict[str, Column]:
    """Noise, purity and sign flip of a coefficient between two strategies."""
    noise = F.abs(other - base) / (F.abs(base) + F.lit(1e-8))
    return {
        "noise_score": noise,
        "purity_score": F.abs(base) / (F.lit(1.0) + noise),
        "sign_flip": F.signum(base) != F.signum(other),
    }


def parse_date_or_number(c: Column | str) -> dict[str, Column]:
    """Text as a timestamp when it is one, else as a number."""
    text = col_of(c).cast("string")
    ts = F.try_to_timestamp(text)
    return {"as_ts": ts, "as_number": F.when(ts.isNull(), text.try_cast("double"))}


def strip_suffix(c: Column | str, suffix: str = "_resid") -> Column:
    text = col_of(c)
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def strip_transformer(c: Column | str) -> Column:
    """'num__age' -> 'age'."""
    return F.regexp_replace(col_of(c), "^[^_]+__", "")


def panel_size_from_name(c: Column | str) -> Column:
    return F.regexp_extract(col_of(c), r"_p(\d+)", 1).try_cast("int")


def json_list(c: Column | str) -> Column:
    """A JSON list cell; malformed text gives an empty list."""
    return F.coalesce(F.from_json(col_of(c), "array<string>"), F.array().cast("array<string>"))


def json_map(c: Column | str) -> Column:
    return F.coalesce(F.from_json(col_of(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
