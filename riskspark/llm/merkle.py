"""Merkle manifest of a table: built levels as parent-linked node rows, and a recursive SQL query that climbs them.

Rows become leaves.  The leaves of a group ascend by id; while a group has more than one
node, every eight consecutive ones become one node a level higher.  What remains is the
group's subroot; the subroots, ordered by group, are joined likewise up to the root.

Levels are built bottom-up, one grouping by run each, over digests only (texts are hashed
where they are read), and written as rows (node, parent, pos, children).  ``climb`` runs a
recursive query over them: a row per leaf ascends to its parent, leaves behind the siblings
it passed and folds its own digest into the next.

A node with many leaves below is met by many rows at once.  Nodes are therefore split by the
number of leaves below: the few large ones, at most ``BROADCAST_NODES``, are broadcast, the
rest are met by at most a bounded number of rows each and are joined by shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..core.session import counted
from .store import parallelism, stored

ARITY = 8
#: A node row has at most 8 digests of 32 bytes and five numbers: so many rows are 8 MB.
BROADCAST_NODES = 24_000
#: Level numbers of the tree above the subroots start here; a node number is its first leaf or group times 64 plus its level.
ABOVE, LEVELS = 32, 64


class Manifest(NamedTuple):
    """``leaves``: g, id, leaf, seen, next, pos, sub.  ``nodes``: node, parent, pos, children, size, digest, sub.  ``root``: hex, None without rows."""

    leaves: DataFrame
    nodes: DataFrame | None
    root: str | None


def hashed(binary: Column) -> Column:
    """Digest of the hex text of ``binary``."""
    return F.unhex(F.sha2(F.lower(F.hex(binary)), 256))


def row_digest(*columns: Column) -> Column:
    """Digest of values as text, each preceded by its UTF-8 length and a colon; null is a hyphen."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the given order; equal rows are spread by where they were stored."""
    df = stored(df.withColumn("__at", F.monotonically_increasing_id()), f"{name}-rows")
    order = [*order, "__at"]
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__row", F.monotonically_increasing_id()).drop("__at"), f"{name}-sorted")
    part = F.shiftrightunsigned(F.col("__row"), 33)
    rows = ranged.withColumns({"part": part, "__row": F.col("__row") - F.shiftleft(part, 33)})
    # One row per partition: their number is the session's setting.
    counts = sorted((r.part, r["count"]) for r in rows.groupBy("part").count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(starts, "part long, __start long")
    return rows.join(F.broadcast(starts), "part").withColumn("g", F.col("__start") + F.col("__row")).drop("__start", "__row")


def _parent(level: int, first: Column, i: Column, n: Column, group: Column, groups: int) -> tuple[Column, Column]:
    """Number of the parent and place in its run, for node ``i`` of ``n`` on a level."""
    up = (first + F.floor(i / ARITY ** (level % ABOVE + 1)).cast("long") * ARITY ** (level % ABOVE + 1)) * LEVELS + level + 1
    if level >= ABOVE:
        return F.when(n > 1, up), F.when(n > 1, F.floor(i / ARITY ** (level - ABOVE)).cast("long") % ARITY)
    top = F.floor(group / ARITY).cast("long") * ARITY * LEVELS + ABOVE + 1
    top_pos = group % ARITY
    if groups == 1:
        top, top_pos = F.lit(None).cast("long"), F.lit(None).cast("long")
    return F.when(n > 1, up).otherwise(top), F.when(n > 1, F.floor(i / ARITY**level).cast("long") % ARITY).otherwise(top_pos)


def _levels(rows: DataFrame, most: int, base: int, groups: int) -> list[DataFrame]:
    """Stored node rows level by level.  ``rows``: first, at, n, group, size, digest; ``at`` counts lowest nodes of the tree, ``n`` nodes of this level."""
    out, level = [], base
    while most > 1:
        height = level - base
        run = F.floor(F.col("at") / ARITY ** (height + 1)).cast("long") * ARITY ** (height + 1)
        pairs = F.sort_array(F.collect_list(F.struct("at", "digest")))
        up = rows.filter("n > 1").groupBy("first", "n", "group", run.alias("run")).agg(
            F.aggregate(pairs, F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("children"), F.sum("size").alias("size")
        )
        level += 1
        up = up.select("first", F.col("run").alias("at"), F.ceil(F.col("n") / ARITY).cast("long").alias("n"), "group", "size", "children", hashed(F.col("children")).alias("digest"))
        parent, pos = _parent(level, F.col("first"), F.col("at"), F.col("n"), F.col("group"), groups)
        node = (F.col("first") + F.col("at")) * LEVELS + level
        sub = F.when(F.col("n") == 1, F.col("digest")) if base == 0 else F.lit(None).cast("binary")
        rows = stored(up.withColumns({"node": node, "parent": parent, "pos": pos.cast("int"), "sub": sub}), f"level-{level}")
        out.append(rows)
        most = -(-most // ARITY)
    return out


def build(docs: DataFrame, id_col: str, group_col: str, leaf: Column, seen: Column | None = None) -> Manifest:
    """Levels of the tree over ``docs``.

    ``leaf``: digest of a row (see ``row_digest``); ``seen``: digest of the row as found
    later, by default the same.  Groups and ids ascend with null first, texts bytewise;
    rows that agree in both follow by digest.  Equal rows are leaves of their own.  No rows:
    no nodes and no root.
    """
    source = docs.select(docs[id_col].alias("id"), docs[group_col].alias("group"), leaf.alias("leaf"), (leaf if seen is None else seen).alias("seen"))
    rows = numbered(source, ["group", "id", "leaf"], "leaves")
    # Few rows per range: one for each group in it.
    pieces = stored(rows.groupBy("part", "group").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")), "pieces")
    each = numbered(pieces.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n")), ["group"], "groups").withColumnRenamed("g", "nth").drop("part")
    size = each.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if not size.groups:
        none = F.lit(None)
        return Manifest(rows.select("g", "id", "leaf", "seen", none.cast("long").alias("next"), none.cast("int").alias("pos"), none.cast("binary").alias("sub")), None, None)
    each = each.withColumnRenamed("group", "__group")
    where = counted(pieces.select("part", "group").join(each, F.col("group").eqNullSafe(F.col("__group"))).select(F.col("part").alias("__part"), "__group", "first", "n", "nth"))
    rows = rows.join(where, (F.col("part") == F.col("__part")) & F.col("group").eqNullSafe(F.col("__group")))
    at = F.col("g") - F.col("first")
    parent, pos = _parent(0, F.col("first"), at, F.col("n"), F.col("nth"), size.groups)
    rows = stored(rows.select("g", "id", "leaf", "seen", "first", at.alias("at"), "n", F.col("nth").alias("group"), parent.alias("next"), pos.cast("int").alias("pos")), "leaves")
    start = rows.select("first", "at", "n", "group", F.lit(1).cast("long").alias("size"), F.col("leaf").alias("digest"))
    levels = _levels(start, size.most, 0, size.groups)
    subroots = [x.filter("n = 1").select("group", "size", "digest") for x in (start, *levels)]
    tops = subroots[0]
    for x in subroots[1:]:
        tops = tops.unionByName(x)
    zero = F.lit(0).cast("long")
    tops = stored(tops.select(zero.alias("first"), F.col("group").alias("at"), F.lit(size.groups).cast("long").alias("n"), zero.alias("group"), "size", "digest"), "subroots")
    above = _levels(tops, size.groups, ABOVE, size.groups)
    root = F.lower(F.hex("digest"))
    root = (above[-1] if above else tops).select(root.alias("root")).first()["root"]
    nodes = None
    for x in (*levels, *above):
        x = x.select("node", "parent", "pos", "children", "size", "digest", "sub")
        nodes = x if nodes is None else nodes.unionByName(x)
    leaves = rows.select("g", "id", "leaf", "seen", "next", "pos", F.when(F.col("n") == 1, F.col("leaf")).alias("sub"))
    return Manifest(leaves, nodes, root)


#: One row per leaf and level: the digest folded so far, and which siblings were passed (their parent, and the place between them).
_CLIMB = """
WITH RECURSIVE climb (g, step, next, pos, digest, parent, place) MAX RECURSION LEVEL 70 AS (
  SELECT g, step, next, pos, digest, parent, place FROM {start}
  UNION ALL
  SELECT {hint} c.g, c.step + 1, n.parent, n.pos,
    unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.pos), c.digest, substring(n.children, 32 * c.pos + 33)))), 256)),
    n.node, c.pos
  FROM climb c JOIN {nodes} n ON c.next = n.node
)
SELECT * FROM climb LIMIT ALL"""


def _ascend(start: DataFrame, nodes: DataFrame, hint: str) -> DataFrame:
    return start.sparkSession.sql(_CLIMB.replace("{hint}", hint), start=start, nodes=nodes)


def _resolved(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Siblings passed, as digests, from the rows of their parents."""
    found = steps.join(nodes.select(F.col("node").alias("parent"), "children", "sub"), "parent")
    siblings = F.expr("concat(substring(children, 1, 32 * place), substring(children, 32 * place + 33))")
    return found.select("g", "step", "next", "digest", siblings.alias("siblings"), "sub")


def _ascended(start: DataFrame, tree: Manifest, broadcast_nodes: int) -> list[tuple[DataFrame, DataFrame]]:
    """Steps of all rows of ``start`` (g, step, next, pos, digest, parent, place), in two parts, each with the nodes it met."""
    # How many nodes have more than 8**k leaves below, for each k.
    digits = F.length(F.conv((F.col("size") - 1).cast("string"), 10, ARITY))
    histogram = dict(tree.nodes.groupBy(digits.alias("k")).count().collect())
    k = max(histogram)
    while k > 0 and sum(n for d, n in histogram.items() if d >= k) <= broadcast_nodes:
        k -= 1
    columns = ("node", "parent", "pos", "children", "sub")
    large, small = tree.nodes.filter(digits > k).select(*columns), tree.nodes.filter(digits <= k).select(*columns)
    parts, going = [], start
    if k:
        low = stored(_ascend(start, small, ""), "climb")
        parts.append((low.filter("parent IS NOT NULL"), small))
        going = low.join(F.broadcast(large.select(F.col("node").alias("next"))), "next", "left_semi").select(*start.columns)
    # Where this part begins has been counted already, so it has no parent here.
    high = _ascend(going.withColumn("parent", F.lit(None).cast("long")), large, "/*+ BROADCAST(n) */").filter("parent IS NOT NULL")
    return [*parts, (high, F.broadcast(large))]


def _start(rows: DataFrame, key: str, digest: str) -> DataFrame:
    none = F.lit(None)
    return rows.select(F.col(key).alias("g"), F.lit(0).alias("step"), "next", "pos", F.col(digest).alias("digest"), none.cast("long").alias("parent"), none.cast("int").alias("place"))


def climb(tree: Manifest, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row per leaf and step (g, step, next, digest, siblings, sub): step 0 is the leaf as found later, the last has no ``next``.

    ``digest`` is folded from the digest ``seen``, ``siblings`` holds the digests beside the node
    below, left to right, ``sub`` the group's subroot where the step is at it.  The recursion appends
    siblings as (parent, place); their digests are looked up once it has ended, so its rows stay short.
    """
    out = tree.leaves.select("g", F.lit(0).alias("step"), "next", F.col("seen").alias("digest"), F.lit(None).cast("binary").alias("siblings"), "sub")
    if tree.nodes is not None:
        for steps, nodes in _ascended(_start(tree.leaves, "g", "seen"), tree, broadcast_nodes):
            out = out.unionByName(_resolved(steps, nodes))
    return out


def proofs(tree: Manifest, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """One row per leaf: id, leaf, subroot, folded (digests) and proof (siblings in order of ascent, left to right).

    Every leaf ascends to fold its own digest.  The leaves of a run pass the same siblings above it, so those
    are gathered by an ascent of the run's parent and shared.
    """
    leaves = tree.leaves
    if tree.nodes is None:
        return leaves.select("id", "leaf", F.lit(b"").alias("proof"), F.col("leaf").alias("subroot"), F.col("seen").alias("folded"))
    folded = leaves.filter("next IS NULL").select("g", F.col("seen").alias("folded"))
    for steps, _ in _ascended(_start(leaves, "g", "seen"), tree, broadcast_nodes):
        folded = folded.unionByName(steps.filter("next IS NULL").select("g", F.col("digest").alias("folded")))
    lowest = tree.nodes.filter((F.col("node") % LEVELS).isin(1, ABOVE + 1))
    above = None
    for steps, nodes in _ascended(_start(lowest.withColumn("next", F.col("parent")), "node", "digest"), tree, broadcast_nodes):
        part = _resolved(steps, nodes).select(F.col("g").alias("node"), "step", "siblings", "sub")
        above = part if above is None else above.unionByName(part)
    siblings = F.sort_array(F.collect_list(F.struct("step", "siblings")))
    above = above.groupBy("node").agg(F.aggregate(siblings, F.lit(b""), lambda a, x: F.concat(a, x["siblings"])).alias("rest"), F.max("sub").alias("__sub"))
    runs = lowest.select("node", "children", "sub").join(above, "node", "left")
    runs = runs.select(F.col("node").alias("next"), "children", F.coalesce("rest", F.lit(b"")).alias("rest"), F.coalesce("sub", "__sub").alias("__sub"))
    own = F.expr("concat(substring(children, 1, 32 * pos), substring(children, 32 * pos + 33), rest)")
    out = leaves.join(folded, "g").join(runs, "next", "left")
    return out.select("id", "leaf", F.coalesce(own, F.lit(b"")).alias("proof"), F.coalesce("sub", "__sub").alias("subroot"), "folded")
