"""URL verdicts: rules on host and path, and boosted trees where no rule fits.

Host and path are cut out with column functions.  Every URL gets lexical features
(lengths, depth, digit ratio, entropy, parameter counts, counts of its suffix over the
whole table) in the JVM.  Spark's gradient-boosted trees learn from URLs that a rule
has labelled, at most ``max_fit_rows`` of them, drawn by hash; the model then judges
the URLs that no rule fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .store import small, stored

#: (verdict, host, path)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "upper_ratio", "odd_ratio", "hyphens", "entropy", "host_entropy", "params", "has_fragment", "longest_part", "suffix_length", "suffix_count", "domain_count"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; path goes on to ``? #``. Empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains if the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last, longest one wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _times(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character of the text's own character frequencies; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    sums = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise((F.length(text) - F.length(F.replace(text, c, F.lit("")))) * F.log2((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)))
    return F.when(n > 0, -sums / n).otherwise(0.0)


def url_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with FEATURES; suffix counts cover all rows. A null url has the features of an empty one."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    parts = F.split("host", "\\.")
    share = lambda p: F.when(F.length(url) > 0, _times(url, p) / F.length(url)).otherwise(0.0)
    rows = pages.withColumns({
        "suffix": F.element_at(parts, -1),
        "domain": F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)),
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": _times(F.col("path"), "[/]"),
        "labels": F.size(parts).cast("double"),
        "digit_ratio": share("[0-9]"),
        "upper_ratio": share("[A-Z]"),
        "odd_ratio": share("[^A-Za-z0-9]"),
        "hyphens": _times(F.col("host"), "-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(F.col("host")),
        "params": F.when(F.length(query) > 0, 1 + _times(query, "&")).otherwise(0.0),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "longest_part": F.array_max(F.transform(parts, F.length)).cast("double"),
        "suffix_length": F.length("suffix").cast("double"),
    })
    rows = stored(rows, "urls")
    for key in ("suffix", "domain"):
        counts = stored(rows.groupBy(key).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias(f"{key}_count")), key)
        rows = rows.join(small(counts), key)
    return rows


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", max_fit_rows: int = 20_000, trees: int = 10, depth: int = 4, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row.

    verdict: the rule's, else ``block`` where the trees' probability is ``threshold`` or
    more.  ``block_score`` is that probability, null where a rule fits.  If the labelled
    URLs are all of one verdict, the others get it too; without any they are allowed.
    ``max_fit_rows``: different labelled URLs that the trees are fitted on at most.  Null,
    empty and very long URLs and repeated rows are judged like any other; other columns
    of ``pages`` are not read.
    """
    url = pages[url_col]
    host, path = split_url(url)
    base = pages.select(pages[id_col].alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = stored(url_features(base.withColumns({"rule": rule, "ruled": verdict})), "features")

    labelled = rows.filter("rule IS NOT NULL").select("url", F.when(F.col("ruled") == "block", 1.0).otherwise(0.0).alias("label"), *FEATURES).dropDuplicates(["url"])
    labelled = stored(labelled, "labelled")
    n, low, high = labelled.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
    rest = rows.filter("rule IS NULL")
    if not n or low == high:
        scored = rest.withColumn("block_score", F.lit(high if n else 0.0))
    else:
        # A uniform draw by hash, a little under the bound on average.
        share = min(1.0, 0.95 * max_fit_rows / n)
        drawn = labelled.filter(F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        bins = VectorAssembler(inputCols=FEATURES, outputCol="x")
        sample = stored(bins.transform(drawn).select("x", "label"), "sample")
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=seed).fit(sample)
        scored = model.transform(bins.transform(rest)).withColumn("block_score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    by_model = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    columns = ["page_id", "host", "path", "rule"]
    ruled = rows.filter("rule IS NOT NULL").select(*columns, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    return ruled.unionByName(scored.select(*columns, by_model.alias("verdict"), "block_score"))
