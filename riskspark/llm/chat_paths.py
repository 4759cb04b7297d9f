"""Reply trees as training conversations.

Messages point to the message they answer.  A conversation is a path from a root to a leaf.
Paths are found by self-joins of the message table that double their reach each round: after
k rounds a message knows its ancestor 2**k steps up, and the sum of scores up to it, so a
tree of depth d takes log2(d) rounds.  Only then, with every leaf's root, length and score
known, the branches of a tree are ranked, and the chosen ones are expanded, again doubling.
No text takes part in these joins.

A chosen path becomes one conversation of segments, one a turn:

    <turn>ROLE\\nTEXT</turn>\\n

Role and text are escaped so that neither ``<`` nor, in a role, a line feed is left in them:
``\\`` becomes ``\\b``, ``<`` becomes ``\\l``, a role's line feed ``\\n``.  Each escape is two
characters that occur nowhere else, so replacing them one after the other undoes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import NO_ID, plain_id, stored

#: Fixed values of the template.
OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables k = 0, 1, ... of (tree, node, up, total) for messages with an ancestor ``up`` 2**k steps above, and all (tree, node, total) that reach a root.

    ``messages``: tree, node, parent, score, all numbers, (tree, node) unique.  ``total``: scores from the node to just
    below ``up``, or to the root.  A round joins only messages that have not reached their root.  Messages that lead into
    a circle of answers never do; the rounds end once the reach exceeds the number of messages.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("__there"))
    base = messages.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left")
    base = stored(base.select("tree", "node", F.when(F.col("__there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), "up-0")
    n, left = base.agg(F.count(F.lit(1)), F.count("up")).first()
    tables, ended, reach = [], base.filter("up IS NULL"), 1
    level = base
    while left and reach <= n:
        above = level.filter("up IS NOT NULL")
        tables.append(above)
        every = above.unionByName(ended).select("tree", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("total").alias("__total"))
        level = stored(above.join(every, ["tree", "up"]).select("tree", "node", F.col("__up").alias("up"), (F.col("total") + F.col("__total")).alias("total")), f"up-{len(tables)}")
        ended = ended.unionByName(level.filter("up IS NULL"))
        left = level.agg(F.count("up")).first()[0]
        reach *= 2
    return tables, ended.select("tree", "node", "total")


def branches(tables: list[DataFrame], ended: DataFrame, most: int | None = None) -> DataFrame:
    """Chosen leaves (tree, leaf, rank, total): the ``most`` best per tree by total score, then smaller leaf; None: all.

    A leaf is answered by no message.  Leaves that lead into a circle have no root and are left out.
    """
    leaves = ended
    if tables:
        leaves = ended.join(tables[0].select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), "total", F.row_number().over(best).alias("rank"))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def paths(tables: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """All messages of the chosen branches: (tree, leaf, rank, node, turn), ``turn`` from 0 at the root.

    The k-th self-join adds, for every message found so far, the one 2**k steps up; each is written once.
    """
    found = stored(chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("steps")), "path-0")
    for k, table in enumerate(tables):
        more = found.join(table.select("tree", "node", "up"), ["tree", "node"])
        found = found.unionByName(stored(more.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("steps") + 2**k).alias("steps")), f"path-{k + 1}"))
    depth = found.groupBy("tree", "leaf").agg(F.max("steps").alias("__depth"))
    return found.join(depth, ["tree", "leaf"]).select("tree", "leaf", "rank", "node", (F.col("__depth") - F.col("steps")).alias("turn"))


def format_branches(messages: DataFrame, most: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per turn of each chosen branch: tree, leaf, rank, turn, segment, loss_start, loss_length.

    ``messages``: tree, node, parent (long), role, text (string), score (double).  The segments of a
    branch in order of ``turn`` are its conversation (``conversations`` joins them).  ``loss_start`` and
    ``loss_length`` (code points, start from 0) mark the escaped text inside the segment for
    turns of ``loss_role``, else null.  A null text or role is empty, a null score 0.  A parent that
    is no message of the tree counts as none.  A null tree is one tree; messages without a node number, or
    with one given before in the tree, are not defined.  No messages give no rows.
    """
    keyed = messages.withColumn("tree", F.coalesce("tree", F.lit(NO_ID)))
    tables, ended = ancestors(keyed)
    places = paths(tables, branches(tables, ended, most))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    written = keyed.select("tree", "node", F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.when(role == loss_role, F.length(head)).alias("loss_start"), F.when(role == loss_role, F.length(body)).alias("loss_length"))
    out = places.join(written, ["tree", "node"])
    return out.select(plain_id("tree").alias("tree"), "leaf", "rank", "turn", "segment", "loss_start", "loss_length")


def conversations(segments: DataFrame) -> DataFrame:
    """One row per branch (tree, leaf, rank, formatted, loss), for conversations that fit a row.

    ``loss``: array of (start, length) in code points of ``formatted``.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "segment", "loss_start", "loss_length")))
    rows = segments.groupBy("tree", "leaf", "rank").agg(turns.alias("turns"))
    rows = rows.withColumn("formatted", F.array_join(F.col("turns.segment"), ""))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["segment"])).alias("at"),
        F.when(x["loss_start"].isNotNull(), F.array_append(a["loss"], F.struct((a["at"] + x["loss_start"]).alias("start"), x["loss_length"].alias("length")))).otherwise(a["loss"]).alias("loss"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, length: int>>)").alias("loss"))
    return rows.select("tree", "leaf", "rank", "formatted", F.aggregate("turns", start, step)["loss"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from any run of whole segments: a segment of its own or a joined conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(piece):
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        cut = F.locate("\n", body)
        return F.struct(unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, start: Column, length: Column) -> Column:
    """The text under a loss span, unescaped."""
    return unescape(F.substr(formatted, start + 1, length))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by branch and turn in; one row per branch out.  Only the running hashes of one branch are held."""
    now, state = None, None
    out = {c: [] for c in ("tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}

    def close():
        for c, v in zip(out, (*now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
            out[c].append(v)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "role", "text", "loss", "chars")), strict=True)
        for tree, leaf, role, text, loss, chars in rows:
            if now != (tree, leaf):
                if now is not None:
                    close()
                now, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += chars
        if out["tree"]:
            yield flush()
            out = {c: [] for c in out}
    if now is not None:
        close()
        yield flush()


def read_digests(segments: DataFrame) -> DataFrame:
    """What a reader finds in the segments of each branch: (tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A branch is read as a sorted stream, whatever its length: its digests need its turns in order.
    """
    read = read_turns(F.col("segment"))[0]
    rows = segments.select("tree", "leaf", "turn", read.alias("read"), masked(F.col("segment"), F.col("loss_start"), F.col("loss_length")).alias("loss"), F.length("segment").alias("chars"))
    rows = rows.select("tree", "leaf", "turn", "read.role", "read.text", "loss", "chars")
    rows = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "turn").select("tree", "leaf", "role", "text", "loss", "chars")
    return rows.mapInArrow(_digests, "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_chain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as messages: each answers the one before it, by turn (null first), then role, then a digest of the text."""
    out = rows.select(rows[conv_col].cast("long").alias("tree"), rows[turn_col].alias("turn"), rows[role_col].alias("role"), rows[text_col].alias("text"))
    # The digest instead of the text, so that numbering alone reads no texts on.
    out = out.withColumn("__digest", F.md5(F.col("text").cast("binary")))
    out = out.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "__digest")).cast("long"))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
