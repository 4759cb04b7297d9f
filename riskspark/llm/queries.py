"""Registered queries of the subpackage: each applies one operator to whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .best_fit import pack_documents
from .bwt_dedup import remove_repeats
from .chat_paths import as_chain, format_branches, read_digests
from .conversation_repair import damaged, repair_conversations, repair_digests
from .line_dedup import dedup_lines
from .merkle import build, proofs, row_digest
from .parity_join import component_rows
from .prefix_forest import nearest
from .pu_quality import quality_scores
from .rank_queue import bpe_digests
from .repetition import MAX_SHARE, repetition_rules
from .store import new_path, plain_id, stored
from .token_files import token_digests, write_tokens
from .url_trees import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


#: SQL lists: A-Z, a-z, and ASCII white space to strip.
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _crc32_sql(ascii_text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    codes = f"list_transform(string_split({ascii_text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


def _repetition_sql() -> str:
    lengths = sorted(MAX_SHARE)
    window = lambda k: "concat_ws(' ', word, " + ", ".join(f"lead(word, {j}) OVER w" for j in range(1, k)) + f")"
    grams = ", ".join(f"CASE WHEN pos + {k - 1} <= n THEN {window(k)} END AS g{k}" for k in (3, *lengths))
    twice = ", ".join(f"CASE WHEN g{k} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{k}) > 1 THEN 1 ELSE 0 END AS d{k}" for k in (3, *lengths))
    hit = ", ".join(f"max(d{k}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS h{k}" for k in (3, *lengths))
    sums = ", ".join(f"sum(h{k} * length(word))::BIGINT AS chars_{k}" for k in lengths)
    zero = ", ".join(f"coalesce(chars_{k}, 0) AS chars_{k}" for k in lengths)
    ok = " AND ".join(f"chars_{k} <= {share} * word_chars" for k, share in sorted(MAX_SHARE.items()))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words FROM d),
w AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM lists),
g AS (SELECT doc_id, pos, word, {grams} FROM w WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, pos, word, {twice} FROM g),
h AS (SELECT doc_id, pos, word, {hit} FROM t),
by_word AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(h3)::BIGINT AS n_repeat_words, {sums} FROM h GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT doc_id, line, count(*) AS n FROM l WHERE trim(line, {_WHITE}) <> '' GROUP BY doc_id, line),
by_line AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines, sum(n * length(line))::BIGINT AS line_chars, sum((n - 1) * length(line))::BIGINT AS dup_line_chars FROM full_lines GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars, {zero}
  FROM d LEFT JOIN by_word USING (doc_id) LEFT JOIN by_line USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_dup_lines <= 0.3 * n_lines AND dup_line_chars <= 0.2 * line_chars AND {ok} AS kept FROM f"""


@_query("op2_repetition_rules", _repetition_sql())
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return repetition_rules(_table(spark, sf, "documents"))


@_query(
    "op10_line_dedup",
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_WHITE}), {_UPPER}, {_LOWER}) AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN hot.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query("op5_rank_queue_bpe")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_digests(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op6_best_fit_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048, 0)


@_query("op8_token_files")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2)
    return token_digests(spark, path)


@_query("op1_pu_quality")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    out = quality_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"), threshold=0.3)
    return out.select(plain_id().alias("doc_id"), "held_out", "score", "predicted")


@_query("op4_prefix_forest")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(_table(spark, sf, "embeddings"), lambda c: c % 20 == 0, 20)


#: Fixed values of the query: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@_query("op9_url_trees")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(_table(spark, sf, "pages"), URL_RULES)


@_query("op3_parity_sketch_join")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return component_rows(_table(spark, sf, "documents"), 4, 85, 100)


@_query("op7_bwt_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(_table(spark, sf, "documents"), 400, output="sha256").withColumnRenamed("kept", "kept_sha256")


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256(concat({', '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"
    # Runs of one level; tree -1 joins the subroots.
    up = "SELECT tree, lvl + 1 AS lvl, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 7) // 8 AS n FROM {src} WHERE n > 1 GROUP BY tree, lvl, i // 8, n"
    others = lambda src: f"SELECT a.tree, a.lvl, a.i, a.n, a.h, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i) AS l, string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS r FROM {src} a JOIN {src} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.n > 1 AND a.i // 8 = b.i // 8 GROUP BY ALL"
    return f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
  dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, coalesce({_crc32_sql("doc_id::VARCHAR")} % 3 = 0, false) AS hit, {leaf("text")} AS h FROM documents),
t AS (SELECT *, CASE WHEN hit THEN {leaf(f"translate(text, {_UPPER}, {_LOWER})")} ELSE h END AS seen FROM d),
low AS (SELECT tree, 0 AS lvl, i, h, n FROM t UNION ALL {up.format(src="low")}),
subs AS (SELECT tree, lvl, h FROM low WHERE n = 1),
high AS (SELECT -1 AS tree, 100 AS lvl, tree AS i, h, (SELECT count(*) FROM subs) AS n FROM subs UNION ALL {up.format(src="high")}),
root AS (SELECT h FROM high WHERE n = 1),
beside AS ({others("low")} UNION ALL {others("high")}),
c AS (SELECT tree AS t0, i AS i0, tree, 0 AS lvl, i, seen AS h, '' AS proof, 0 AS done FROM t
  UNION ALL
  SELECT t0, i0, CASE WHEN b.h IS NOT NULL THEN c.tree ELSE -1 END, CASE WHEN b.h IS NOT NULL THEN c.lvl + 1 ELSE 100 END, CASE WHEN b.h IS NOT NULL THEN c.i // 8 ELSE c.tree END,
    CASE WHEN b.h IS NOT NULL THEN sha256(concat(b.l, c.h, b.r)) ELSE c.h END, concat(c.proof, b.l, b.r), CASE WHEN b.h IS NULL AND c.tree = -1 THEN 1 ELSE 0 END
  FROM c LEFT JOIN beside b ON b.tree = c.tree AND b.lvl = c.lvl AND b.i = c.i WHERE done = 0)
SELECT doc_id, t.h AS leaf, subs.h AS subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = root.h AS verified
FROM t JOIN c ON c.t0 = t.tree AND c.i0 = t.i AND c.done = 1 JOIN subs ON subs.tree = t.tree CROSS JOIN root"""


@_query("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = row_digest(*columns, F.col("text"))
    lower = row_digest(*columns, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    tree = build(docs, "doc_id", "lang", leaf, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(leaf))
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(tree.root)
    return proofs(tree).select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"),
    )


#: Fixed value of the query: both texts of its conversation -7.
TRICKY = "\\### Assistant: </turn> ok"


@_query(
    "op12_chat_paths",
    f"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(2 * (length(text) + length(role)) - length(translate(text, '<' || chr(92), '')) - length(translate(role, '<' || chr(92) || chr(10), '')) + 15)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    segments = stored(format_branches(as_chain(rows.unionByName(more))), "chats")
    return read_digests(segments).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _repair_sql() -> str:
    solid = "regexp_matches(text, '[^\\x20\\x09-\\x0D]')"
    return f"""
WITH RECURSIVE src AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, role, text,
  {_crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations),
bad AS (SELECT g, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS pos, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM bad),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT {solid} THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 1, 2, 'I', chr(10) || 'user:'), (0, 2, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 0, 1, '', ''), (1, 1, 2, 'I', chr(10) || 'user:'), (1, 2, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 0, 2, '', ''), (2, 1, 3, 'I', chr(10) || 'assistant:'), (3, 0, 3, '', ''), (3, 1, 2, 'I', chr(10) || 'user:')) AS v(q, k, q1, pre, made)),
e AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS v(q1, ini, q2)),
edits AS (
  SELECT g, pos, q1, 'D' AS letter, q1 AS q2, 2 AS price, '' AS made FROM f CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(q1)
  UNION ALL SELECT g, pos, q1, 'K', q2, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, chr(10) || role || ':' || text FROM f JOIN e USING (ini) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT g, pos, q1, 'R', q2, 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, chr(10) || CASE q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || text FROM f CROSS JOIN e WHERE e.ini <> 's' AND fault IN ('', 'truncated')),
dp AS (SELECT DISTINCT g, 0::BIGINT AS pos, 0 AS q, {{'c': 0, 'a': '', 't': ''}} AS best FROM src
  UNION ALL
  SELECT dp.g, dp.pos + 1, x.q2, min({{'c': dp.best.c + 5 * ins.k + x.price, 'a': dp.best.a || ins.pre || x.letter, 't': dp.best.t || ins.made || x.made}})
  FROM dp JOIN ins USING (q) JOIN edits x ON x.g = dp.g AND x.pos = dp.pos + 1 AND x.q1 = ins.q1 GROUP BY dp.g, dp.pos, x.q2),
n AS (SELECT g, any_value(conv_id) AS conv_id, (SELECT count(*) FROM f WHERE f.g = src.g) AS n FROM src GROUP BY g),
done AS (SELECT dp.g, min({{'c': dp.best.c + 5 * ins.k, 'a': dp.best.a || ins.pre, 't': dp.best.t || ins.made}}) AS best
  FROM dp JOIN n ON n.g = dp.g AND n.n = dp.pos JOIN ins USING (q) WHERE ins.q1 IN (0, 3) GROUP BY dp.g),
pairs AS (SELECT g, ini, lag(ini) OVER (PARTITION BY g ORDER BY pos) AS before FROM f),
bent AS (SELECT g, count(*) AS illegal FROM pairs WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au') GROUP BY g),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM f GROUP BY g)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  done.best.c::BIGINT AS cost, done.best.a AS audit, sha256(substr(done.best.t, 2)) AS repaired_sha256
FROM n JOIN done USING (g) LEFT JOIN counts USING (g) LEFT JOIN bent USING (g)"""


@_query("op13_conversation_repair", _repair_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    rows = damaged(_table(spark, sf, "conversations"))
    return repair_digests(repair_conversations(rows, gone_col="gone")).withColumnRenamed("conv", "conv_id")
