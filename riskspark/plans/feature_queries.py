"""Queries over the long feature table: screens, correlation clusters, panels, stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import corr as R
from ..operators import screen as N
from .aggregate_queries import COEF, coef_rows
from .registry import query
from .tables import EMB, EMB_FEATURES, IMP, LONG, draws_sql, embedding_long, embedding_wide, importances, long_features, two_sided_sql

LW = f"WITH {LONG}, {EMB}"


def mw_sql(src: str, min_total: int, min_class: int, keys: str = "feature", w: str = "1") -> str:
    k = keys
    return f"""mwc AS (SELECT {k}, x + 0e0 AS x, cast(sum((1 - y) * {w}) AS bigint) AS n0, cast(sum(y * {w}) AS bigint) AS n1 FROM {src} WHERE x IS NOT NULL GROUP BY ALL),
    mwr AS (SELECT *, sum(n0 + n1) OVER (PARTITION BY {k} ORDER BY x ROWS UNBOUNDED PRECEDING) - (n0 + n1 - 1) / 2e0 AS mid, cast(n0 + n1 AS double) AS t FROM mwc),
    mwa AS (SELECT {k}, cast(sum(n0) AS double) AS n0, cast(sum(n1) AS double) AS n1, sum(n1 * mid) AS r1, sum(t * t * t - t) AS ties, sum(x * n0) AS s0, sum(x * n1) AS s1 FROM mwr GROUP BY ALL),
    mwz AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, sqrt(n0 * n1 / 12e0 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS sd FROM mwa WHERE n0 + n1 >= {min_total} AND n0 >= {min_class} AND n1 >= {min_class}),
    mwy AS (SELECT *, CASE WHEN sd > 0 THEN (greatest(u1, n0 * n1 - u1) - n0 * n1 / 2 - 0.5e0) / sd END AS z, (SELECT sum({w}) FROM {src} q WHERE {' AND '.join(f'q.{c.strip()} = mwz.{c.strip()}' for c in k.split(','))}) AS tot FROM mwz),
    mw AS (SELECT {k}, CASE WHEN z < 0 THEN 1e0 ELSE {two_sided_sql('z')} END AS p_value, abs(s1 / n1 - s0 / n0) AS effect_size, (n0 + n1) / tot AS nonmissing_frac FROM mwy)"""


BOTH = "both_ AS (SELECT * FROM long UNION ALL SELECT id, y, feature, x FROM emb)"


def both_long(spark, sf):
    return long_features(spark, sf).unionByName(embedding_long(spark, sf))


@query("mann_whitney_screen", f"{LW}, {BOTH}, {mw_sql('both_', 20, 10)} SELECT feature, p_value, effect_size, nonmissing_frac FROM mw", "p_value effect_size nonmissing_frac")
def _(spark, sf):
    return N.mann_whitney_screen(both_long(spark, sf)).drop("rank")


@query("univariate_strength", f"{LW}, {BOTH}, {mw_sql('both_', 30, 5)} SELECT feature, p_value, effect_size FROM mw", "p_value effect_size")
def _(spark, sf):
    return N.univariate_strength(both_long(spark, sf))


FS = """fs0 AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM both_ WHERE x IS NOT NULL GROUP BY ALL),
  fs1 AS (SELECT a.feature, a.n AS n0, b.n AS n1, a.m AS m0, b.m AS m1, a.v AS v0, b.v AS v1 FROM fs0 a JOIN fs0 b USING (feature) WHERE a.y = 0 AND b.y = 1 AND (a.v > 0 OR b.v > 0)),
  fs AS (SELECT feature, n0 * n1 / (n0 + n1) * (m1 - m0) ** 2 / ((n0 * v0 + n1 * v1) / (n0 + n1 - 2)) AS f_score, abs(m1 - m0) AS effect_size FROM fs1)"""


@query("f_screen", f"{LW}, {BOTH}, {FS} SELECT * FROM fs", "f_score effect_size")
def _(spark, sf):
    return N.f_screen(both_long(spark, sf)).select("feature", "f_score", "effect_size")


@query("f_screen_p_values")
def _(spark, sf):
    return N.f_screen(both_long(spark, sf))


@query("kbest", f"{LW}, {BOTH}, {FS} SELECT * FROM (SELECT feature, f_score, row_number() OVER (ORDER BY f_score DESC, feature) AS rank FROM fs) WHERE rank <= 10", "f_score")
def _(spark, sf):
    return N.kbest(both_long(spark, sf), 10)


NEWTON_SUMS = """sum(pos - (pos + neg) * mu) AS g0, sum((pos - (pos + neg) * mu) * x) AS g1, sum((pos + neg) * mu * (1 - mu)) AS h00, sum((pos + neg) * mu * (1 - mu) * x) AS h01, sum((pos + neg) * mu * (1 - mu) * x * x) AS h11"""


def newton_sql(src: str, key: str, start: str = "0e0", iters: int = 20) -> str:
    """Recursive CTE nt: two-parameter logistic Newton per key over (key, x, pos, neg)."""
    mu = "1e0 / (1e0 + exp(-least(30e0, greatest(-30e0, b0 + b1 * x))))"
    return f"""nt AS (SELECT DISTINCT {key}, 0 AS it, 0e0 AS b0, {start} AS b1 FROM {src}
      UNION ALL SELECT {key}, it + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT {key}, it, b0, b1, {NEWTON_SUMS} FROM (SELECT s.*, it, b0, b1, {mu} AS mu FROM nt JOIN {src} s USING ({key}) WHERE it < {iters}) GROUP BY {key}, it, b0, b1)),
    fit AS (SELECT {key}, b0, b1 FROM nt WHERE it = {iters})"""


WALD = f"""WITH RECURSIVE {LONG}, {EMB}, {BOTH}, wf AS (SELECT feature, y, coalesce(x, 0e0) AS x FROM both_),
    wm AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM wf GROUP BY ALL),
    wz AS (SELECT feature, (x - m) / CASE WHEN s > 0 THEN s ELSE 1e0 END AS x, cast(sum(y) AS double) AS pos, cast(sum(1 - y) AS double) AS neg FROM wf JOIN wm USING (feature) GROUP BY ALL),
    {newton_sql('wz', 'feature')},
    ws AS (SELECT feature, b0, b1, sum((pos + neg) * mu * (1 - mu)) AS h00, sum((pos + neg) * mu * (1 - mu) * x) AS h01, sum((pos + neg) * mu * (1 - mu) * x * x) AS h11
      FROM (SELECT wz.*, b0, b1, 1e0 / (1e0 + exp(-(b0 + b1 * x))) AS mu FROM wz JOIN fit USING (feature)) GROUP BY feature, b0, b1),
    wd AS (SELECT feature, b1 AS beta, sqrt(h00 / (h00 * h11 - h01 * h01)) AS se, abs(b1) / sqrt(h00 / (h00 * h11 - h01 * h01)) AS wald_statistic FROM ws)"""


@query("wald_screen", f"{WALD} SELECT feature, beta, se, wald_statistic, {two_sided_sql('wald_statistic')} AS p_value FROM wd", "beta se wald_statistic p_value")
def _(spark, sf):
    return N.wald_screen(both_long(spark, sf)).drop("rank")


@query("screen_dispatch", f"{LW}, {BOTH}, {FS} SELECT * FROM (SELECT feature, f_score, row_number() OVER (ORDER BY f_score DESC, feature) AS rank FROM fs) WHERE rank <= 5", "f_score")
def _(spark, sf):
    return N.screen(both_long(spark, sf), "f_classif", 5).select("feature", "f_score", "rank")


# ---------------------------------------------------------------- correlation
EPAIRS = "pairs AS (SELECT a.feature AS a, b.feature AS b, abs(corr(a.x, b.x)) AS abs_corr FROM emb a JOIN emb b USING (id) WHERE a.feature < b.feature GROUP BY ALL)"


@query("correlation_pairs", f"WITH {EMB}, {EPAIRS} SELECT * FROM pairs", "abs_corr")
def _(spark, sf):
    return R.correlation_pairs(embedding_wide(spark, sf), EMB_FEATURES)


# A column without values, or a constant one, beside the others: NULL correlations, nothing else changes.

@query("correlation_null_column", f"""WITH {EMB}, {EPAIRS}, names AS (SELECT DISTINCT feature FROM emb)
    SELECT * FROM pairs UNION ALL SELECT least(feature, 'x_empty'), greatest(feature, 'x_empty'), NULL FROM names""", "abs_corr")
def _(spark, sf):
    return R.correlation_pairs(embedding_wide(spark, sf).withColumn("x_empty", F.lit(None).cast("double")), [*EMB_FEATURES, "x_empty"])


@query("correlation_constant_column", f"""WITH {EMB}, {EPAIRS}, names AS (SELECT DISTINCT feature FROM emb)
    SELECT * FROM pairs UNION ALL SELECT least(feature, 'x_constant'), greatest(feature, 'x_constant'), NULL FROM names""", "abs_corr")
def _(spark, sf):
    return R.correlation_pairs(embedding_wide(spark, sf).withColumn("x_constant", F.lit(3.0)), [*EMB_FEATURES, "x_constant"], block=24, task_bytes=8 * 24 * 24)


RANKED = "er AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2e0 AS x FROM emb)"


@query("correlation_pairs_spearman", f"WITH {EMB}, {RANKED} SELECT a.feature AS a, b.feature AS b, abs(corr(a.x, b.x)) AS abs_corr FROM er a JOIN er b USING (id) WHERE a.feature < b.feature GROUP BY ALL", "abs_corr")
def _(spark, sf):
    return R.correlation_pairs(embedding_wide(spark, sf), EMB_FEATURES, "spearman", block=20)


THR = 0.1
COMP = f"""WITH RECURSIVE {EMB}, {EPAIRS}, edges AS (SELECT a, b FROM pairs WHERE abs_corr >= {THR}e0 UNION ALL SELECT b, a FROM pairs WHERE abs_corr >= {THR}e0),
  reach AS (SELECT DISTINCT feature AS n, feature AS r FROM emb UNION SELECT reach.n, edges.b FROM reach JOIN edges ON edges.a = reach.r),
  comp AS (SELECT n AS feature, min(r) AS component FROM reach GROUP BY ALL)"""


def pairs(spark, sf):
    return R.correlation_pairs(embedding_wide(spark, sf), EMB_FEATURES)


@query("high_pairs", f"WITH {EMB}, {EPAIRS} SELECT * FROM pairs WHERE abs_corr >= {THR}e0", "abs_corr")
def _(spark, sf):
    return R.high_pairs(R.correlation_pairs(embedding_wide(spark, sf), EMB_FEATURES, threshold=THR), THR)


@query("components", f"{COMP} SELECT feature, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp")
def _(spark, sf):
    return R.cluster_features(pairs(spark, sf), embedding_long(spark, sf).select("feature").distinct(), THR)


FREQ = "freq AS (SELECT feature, count(CASE WHEN x > 0.2e0 THEN 1 END) / count(*) AS selection_freq FROM emb GROUP BY ALL)"


def frequency(spark, sf):
    return embedding_long(spark, sf).groupBy("feature").agg((F.sum(F.when(F.col("x") > 0.2, 1).otherwise(0)) / F.count(F.lit(1))).alias("selection_freq"))


PRUNE = f"""{COMP}, {FREQ}, pr AS (SELECT feature, component, count(*) OVER (PARTITION BY component) AS component_size, first_value(feature) OVER (PARTITION BY component ORDER BY selection_freq DESC, feature) AS representative FROM comp JOIN freq USING (feature))"""


@query("prune_correlated", f"{PRUNE} SELECT *, feature = representative AS kept FROM pr")
def _(spark, sf):
    return R.prune_correlated(pairs(spark, sf), frequency(spark, sf), THR)


@query("prune_correlated_univariate", f"""{COMP}, {FREQ}, {mw_sql('emb', 30, 5)}, pr AS (SELECT feature, component, count(*) OVER (PARTITION BY component) AS component_size,
    first_value(feature) OVER (PARTITION BY component ORDER BY floor(selection_freq * 20) / 20 DESC, p_value, effect_size DESC, feature) AS representative FROM comp JOIN freq USING (feature) JOIN mw USING (feature)) SELECT *, feature = representative AS kept FROM pr""")
def _(spark, sf):
    f = frequency(spark, sf).withColumn("selection_freq", F.floor(F.col("selection_freq") * 20) / 20)
    return R.prune_correlated(pairs(spark, sf), f, THR, N.univariate_strength(embedding_long(spark, sf)))


# The serial walk as a recursion: one candidate per step, accepted members in a list.
WALK = f"""WITH RECURSIVE {EMB}, {EPAIRS}, {FREQ}, rk AS (SELECT feature, row_number() OVER (ORDER BY selection_freq DESC, feature) AS rank FROM freq),
  bad AS (SELECT a, b FROM pairs WHERE abs_corr >= {THR}e0 UNION ALL SELECT b, a FROM pairs WHERE abs_corr >= {THR}e0),
  adj AS (SELECT rank, rk.feature, coalesce(list(b) FILTER (WHERE b IS NOT NULL), []) AS nb FROM rk LEFT JOIN bad ON bad.a = rk.feature GROUP BY ALL),
  walk AS (SELECT 0::bigint AS i, []::varchar[] AS got UNION ALL SELECT i + 1, CASE WHEN list_has_any(got, nb) THEN got ELSE list_append(got, feature) END FROM walk JOIN adj ON adj.rank = walk.i + 1),
  res AS (SELECT unnest(got) AS feature FROM walk WHERE i = 64)"""


@query("greedy_refill", f"{WALK} SELECT feature, row_number() OVER (ORDER BY rank) AS position FROM res JOIN rk USING (feature) ORDER BY rank LIMIT 20")
def _(spark, sf):
    from ..core.order import ordinal_rank

    ranked = ordinal_rank(frequency(spark, sf), [], [F.col("selection_freq").desc(), F.col("feature")])
    none = ranked.filter(F.lit(False))
    return R.refill_panel(none, ranked, pairs(spark, sf), 20, THR).select("feature", "position")


@query("prune_and_refill")
def _(spark, sf):
    return R.prune_and_refill(pairs(spark, sf), frequency(spark, sf), 20, THR)


@query("interleave_streams", f"""{COMP}, {FREQ}, s AS (SELECT feature, component, row_number() OVER (PARTITION BY component ORDER BY selection_freq DESC, feature) AS round, max(selection_freq) OVER (PARTITION BY component) AS best FROM comp JOIN freq USING (feature))
    SELECT feature, component, round, row_number() OVER (ORDER BY round, best DESC, component) AS position FROM s""")
def _(spark, sf):
    f = frequency(spark, sf)
    comp = R.cluster_features(pairs(spark, sf), f, THR)
    return R.interleave(comp.join(f, "feature").select("feature", "component", F.col("selection_freq").alias("score")))


# ---------------------------------------------------------------- stability
LOG = """log AS (SELECT DISTINCT l_returnflag AS model, l_linenumber - 1 AS repeat, l_linestatus AS outer_split, 'p' || l_partkey AS feature FROM lineitem)"""


def selection_log(spark, sf):
    from .tables import table

    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), (F.col("l_linenumber") - 1).alias("repeat"), F.col("l_linestatus").alias("outer_split"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("selected"))


@query("selection_frequency", f"WITH {LOG}, n AS (SELECT model, count(DISTINCT (repeat, outer_split)) AS n FROM log GROUP BY ALL) SELECT model, feature, count(*) AS n_selected, count(*) / n AS selection_freq FROM log JOIN n USING (model) GROUP BY model, feature, n", "selection_freq")
def _(spark, sf):
    return N.selection_frequency(selection_log(spark, sf), ["model"], split=["repeat", "outer_split"])


STABLE = f"""WITH {LOG}, fq AS (SELECT model, feature, count(DISTINCT repeat) / 7e0 AS selection_freq FROM log GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY selection_freq DESC, feature) AS rank, max(selection_freq) OVER (PARTITION BY model) AS top FROM fq)
    SELECT model, feature, selection_freq, rank, CASE WHEN top >= 0.5e0 THEN selection_freq >= 0.5e0 ELSE rank <= 20 END AS kept FROM rk"""


@query("stable_panel", STABLE, "selection_freq")
def _(spark, sf):
    return N.stable_panel(selection_log(spark, sf), 7, 0.5, ["model"])


@query("rank_by_frequency", f"{STABLE.split('rk AS')[0].rstrip().rstrip(',')} SELECT *, row_number() OVER (PARTITION BY model ORDER BY selection_freq DESC, feature) AS rank FROM fq", "selection_freq")
def _(spark, sf):
    freq = selection_log(spark, sf).select("model", "repeat", F.col("selected").alias("feature")).groupBy("model", "feature").agg((F.count_distinct("repeat") / F.lit(7.0)).alias("selection_freq"))
    return N.rank_by_frequency(freq, ["model"])


@query("bootstrap_stability", f"""WITH {LONG}, subj AS (SELECT DISTINCT id, y FROM long), {draws_sql('subj', 'y', 'id', 20, 42, '0 AS z')},
    bw AS (SELECT id, b, weight FROM wts JOIN ix ON ix.y = wts.y AND ix.idx = wts.target), br AS (SELECT b, feature, y, x, weight FROM long JOIN bw USING (id)),
    {mw_sql('br', 20, 10, 'b, feature', 'weight')},
    tk AS (SELECT feature FROM (SELECT b, feature, row_number() OVER (PARTITION BY b ORDER BY p_value, round(effect_size, 9) DESC, feature) AS rank FROM mw) WHERE rank <= 3),
    f AS (SELECT feature, count(*) / 20e0 AS selection_freq FROM tk GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY selection_freq DESC, feature) AS rank, max(selection_freq) OVER () AS top FROM f)
    SELECT feature, selection_freq, rank, CASE WHEN top >= 0.75e0 THEN selection_freq >= 0.75e0 ELSE rank <= 20 END AS kept FROM r""", "selection_freq")
def _(spark, sf):
    return N.bootstrap_stability(long_features(spark, sf), 20, 3)


# ---------------------------------------------------------------- panels
FP = f"""WITH {IMP}, cf AS (SELECT model AS strategy, 'log' AS weight_scheme, feature, split_seed AS fold, coef FROM imp WHERE selected),
    m AS (SELECT strategy, feature, (SELECT count(DISTINCT split_seed) FROM imp i WHERE i.model = c.strategy) AS nf, fold, coef FROM cf c),
    a AS (SELECT strategy, feature, nf, sum(coef) / nf AS mean_coef, count(CASE WHEN abs(coef) > 1e-8 THEN 1 END) / nf AS fold_stability,
      max(CASE WHEN coef > 1e-8 THEN 1 ELSE 0 END) + max(CASE WHEN coef < -1e-8 THEN 1 ELSE 0 END) = 1 AS sign_consistent, sum(coef * coef) AS q, count(*) AS k FROM m GROUP BY strategy, feature, nf)"""


def panels(spark, sf):
    i = importances(spark, sf)
    cv = i.select(F.col("model").alias("strategy"), F.lit("log").alias("weight_scheme"), F.col("split_seed").alias("fold"), F.lit(0.5).alias("auprc")).distinct()
    coefs = i.filter("selected").select(F.col("model").alias("strategy"), F.lit("log").alias("weight_scheme"), "feature", F.col("split_seed").alias("fold"), "coef")
    return N.fold_panels(coefs, cv)


@query("fold_panels", f"{FP} SELECT strategy, 'log' AS weight_scheme, feature, mean_coef, sqrt(greatest(0e0, q / nf - mean_coef * mean_coef)) AS std_coef, fold_stability, sign_consistent FROM a", "mean_coef std_coef fold_stability")
def _(spark, sf):
    return panels(spark, sf).drop("rank")


@query("core_panel", f"{FP} SELECT feature, mean_coef, fold_stability FROM a WHERE strategy = 'R' AND fold_stability >= 0.4e0 AND sign_consistent", "mean_coef fold_stability")
def _(spark, sf):
    return N.core_panel(panels(spark, sf), "R", 0.4).select("feature", "mean_coef", "fold_stability")


PUR = """pc AS (SELECT l_linestatus AS model, l_returnflag AS strategy, 's' || l_suppkey AS feature, max(l_extendedprice) / 1e5 - max(l_discount) * 8 AS coef FROM lineitem GROUP BY ALL),
  pw AS (SELECT model, feature, max(CASE WHEN strategy = 'A' THEN coef END) AS base, max(CASE WHEN strategy = 'R' THEN coef END) AS other FROM pc GROUP BY ALL HAVING base IS NOT NULL AND other IS NOT NULL),
  pn AS (SELECT *, abs(base) / (1e0 + abs(other - base) / (abs(base) + 1e-8)) AS pur, sign(base) <> sign(other) AS flip FROM pw),
  ps AS (SELECT feature, avg(pur / top) AS combined, count(*) AS n_models, max(cast(flip AS int)) AS any_flip FROM (SELECT *, max(pur) OVER (PARTITION BY model) AS top FROM pn) GROUP BY ALL)"""


def purity_rows(spark, sf):
    from .tables import table

    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("strategy"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("feature")).agg((F.max("l_extendedprice") / 1e5 - F.max("l_discount") * 8).alias("coef"))


@query("purity_scores", f"WITH {PUR} SELECT *, row_number() OVER (ORDER BY round(combined, 9) DESC, feature) AS rank FROM ps", "combined")
def _(spark, sf):
    return N.purity_scores(purity_rows(spark, sf), "A", "R")


@query("order_by_rule", f"""{COEF} SELECT 'abs_coef' AS rule, model, feature, row_number() OVER (PARTITION BY model ORDER BY abs(coef) DESC, feature) AS position FROM cf WHERE stability >= 0.8e0 AND coef > 0
    UNION ALL SELECT 'purity', model, feature, row_number() OVER (PARTITION BY model ORDER BY coef DESC, feature) FROM cf
    UNION ALL SELECT 'consensus', model, feature, row_number() OVER (PARTITION BY model ORDER BY stability DESC, feature) FROM cf WHERE abs(coef) <= 0.4e0
    UNION ALL SELECT 'consensus all', model, feature, row_number() OVER (PARTITION BY model ORDER BY stability DESC, feature) FROM cf
    UNION ALL SELECT r, model, feature, row_number() OVER (PARTITION BY r, model ORDER BY length(feature), feature) FROM cf, (SELECT unnest(['stored_rank', 'elimination']) AS r)""")
def _(spark, sf):
    rows = coef_rows(spark, sf).select(
        "model", "feature", F.col("coef").alias("mean_coef"), F.col("stability").alias("stability_freq"), (F.col("coef") > 0).alias("sign_consistent"), F.col("coef").alias("combined"),
        F.col("stability").alias("consensus_score"), F.abs("coef").alias("q_value"), F.length("feature").alias("stored_rank"),
    )
    given = {"abs_coef": {"stability_threshold": 0.8}, "purity": {}, "consensus": {"q_threshold": 0.4}, "consensus all": {"q_threshold": None}, "stored_rank": {}, "elimination": {}}
    parts = [N.order_by_rule(rows, r.split()[0], ["model"], **k).withColumn("rule", F.lit(r)).select("rule", "model", "feature", "position") for r, k in given.items()]
    return reduce(DataFrame.unionByName, parts)
