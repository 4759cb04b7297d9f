"""Nearest neighbours by inner product with a forest of hash prefixes.

Each tree gives every distinct vector a 64-bit hash string, one bit per random
hyperplane; sorted, the strings are the leaves of a binary trie.  A query descends in
all trees to its longest prefix match, then all trees ascend together, one bit at a
time, until the subtrees around the query hold enough rows in all; these are scored
exactly.  Enough follows the counted rows: a fixed share of them in each tree, so that
recall does not fall as the table grows.  The depth at which that happens differs from
query to query.

Work is laid out by (tree, first bits): a block holds one subtree of ``block_rows``
rows or more as a sorted array, several times what a query needs of a tree, and a query
visits one block per tree; if that is too little for any query, blocks are whole trees.  Two
steps run over the blocks.  The first counts, by binary search, the rows that share
each prefix length with the query, and the sums over trees give the query's depth; the
second scores the slice of the sorted array at that depth.  Blocks that come out larger
(many close vectors) are dealt out to several tasks, as are their queries.

Inner products are searched as angles: a vector gets one more component that gives all
vectors the same length, a query has 0 there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .store import small, stored

#: Depths counted below a block's root; a query with enough rows at the deepest takes them all.
DEPTHS = 20
BITS = 64
#: Share of the rows that a query is compared with in each tree, and products held at once.
SHARE, CELLS = 1 / 32, 1 << 22


def _planes(dims: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, trees * BITS)).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _hash(trees: int, seed: int, longest: float, as_query: bool):
    """(rep, vector) to (rep, vector, one hash for each tree)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1)).astype(np.float64) / longest
                if planes is None:
                    planes = _planes(x.shape[1] + 1, trees, seed)
                rest = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
                bits = np.column_stack([x, rest]).astype(np.float32) @ planes > 0
                hashes = np.packbits(bits.reshape(-1, BITS), axis=1).view(">u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(hashes.ravel()), trees).cast(pa.list_(pa.int64()))], ["rep", "vector", "hashes"])

    return rows


def _slices(hashes: np.ndarray, queries: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) in the sorted ``hashes`` of those that agree with each query in the first ``depth`` bits."""
    shift = (BITS - np.asarray(depth)).astype(np.uint64)
    whole = shift >= BITS
    s = np.where(whole, 0, shift).astype(np.uint64)
    first = np.where(whole, 0, (queries >> s) << s).astype(np.uint64)
    last = np.where(whole, np.uint64(2**64 - 1), first | ((np.uint64(1) << s) - np.uint64(1)))
    return np.searchsorted(hashes, first, "left"), np.searchsorted(hashes, last, "right")


def _count(root: int):
    def fn(rows: pa.Table, queries: pa.Table) -> pa.Table:
        h, q = np.sort(rows.column("hash").to_numpy().view(np.uint64)), queries.column("hash").to_numpy().view(np.uint64)
        n = np.empty((len(q), DEPTHS), np.int64)
        for d in range(DEPTHS):
            lo, hi = _slices(h, q, min(BITS, root + d))
            n[:, d] = hi - lo
        return pa.table({"query": queries.column("query"), "n": pa.FixedSizeListArray.from_arrays(pa.array(n.ravel()), DEPTHS).cast(pa.list_(pa.int64()))})

    return fn


def _score(k: int):
    def fn(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_r, out_s = [], [], []
        if rows.num_rows and queries.num_rows:
            h = rows.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(h, kind="stable")
            h, reps = h[order], rows.column("rep").to_numpy()[order]
            x = _matrix(rows.column("vector").combine_chunks()).astype(np.float64)[order]
            y = _matrix(queries.column("vector").combine_chunks()).astype(np.float64)
            ids = queries.column("query").to_numpy()
            ends = np.column_stack(_slices(h, queries.column("hash").to_numpy().view(np.uint64), queries.column("depth").to_numpy()))
            ends, of = np.unique(ends, axis=0, return_inverse=True)
            by = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel(), minlength=len(ends)))[:-1])
            for (lo, hi), asks in zip(ends.tolist(), by, strict=True):
                step = max(1, CELLS // max(1, hi - lo))
                for at in range(0, len(asks) if hi > lo else 0, step):  # queries of one slice together
                    some = asks[at : at + step]
                    rough = y[some] @ x[lo:hi].T
                    least = np.partition(rough, -k, axis=1)[:, -k] if hi - lo > k else np.full(len(some), -np.inf)
                    least = least - 1e-9 * np.abs(rough).max(axis=1)  # all that may tie with the k-th stay
                    for i, near, edge in zip(some, rough, least, strict=True):
                        found = lo + np.flatnonzero(near >= edge)
                        s, r = (x[found] * y[i]).sum(axis=1), reps[found]  # the same sum in every tree
                        if len(s) > k:
                            top = np.lexsort((r, -s))[:k]
                            s, r = s[top], r[top]
                        out_q.append(np.full(len(s), ids[i]))
                        out_r.append(r)
                        out_s.append(s)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query": cat(out_q, np.int64), "rep": cat(out_r, np.int64), "score": cat(out_s, np.float64)})

    return fn


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 24, candidates: int = 24 * 2048, block_rows: int = 8192, seed: int = 7, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query(id)`` holds its ``k`` nearest other rows found.

    ``is_query``: function of the id column.  Nearness: inner product in double precision;
    ties go to the smaller id.  Null vectors, zero vectors and those with null or
    non-finite components take no part, nor do vectors of another length than the most
    frequent one, nor rows with a null id.  Equal vectors are hashed once and stand for all
    their rows; for a result at most k + 1 rows of one vector can matter.  Rows that repeat an
    id with the same vector count once.  The trees ascend for
    ``share`` of the different vectors in each tree, summed over all trees, and for ``candidates``
    rows at least; work grows with queries times rows.  Blocks of a few rows and an empty table are fine.
    """
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    rows = rows.select("id", "v", F.size("v").alias("dims"))
    lengths = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1)
    rows = stored(rows.join(F.broadcast(lengths.select("dims")), "dims", "left_semi").select("id", "v").dropDuplicates(), "vectors")

    first = W.partitionBy("v").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    members = stored(members.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")), "members")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = members.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    longest = (longest or 1.0) * (1 + 1e-6)
    candidates = max(candidates, int(np.ceil(share * trees * n)))
    # A block has four times the rows that a query takes of a tree, or more.
    root = max(0, int(np.log2(max(1, n) / max(block_rows, 4 * candidates / trees))))

    reps = members.select("rep", F.col("v").alias("vector"))
    asked = rows.filter(is_query(F.col("id"))).groupBy("v").agg(F.min("id").alias("query"))  # one row per different vector
    hashed = "rep long, vector array<float>, hashes array<long>"
    data = stored(reps.mapInArrow(_hash(trees, seed, longest, False), hashed), "forest")
    asked = stored(asked.select(F.col("query").alias("rep"), F.col("v").alias("vector")).mapInArrow(_hash(trees, seed, longest, True), hashed).withColumnRenamed("rep", "query"), "queries")

    def placed(df: DataFrame, *columns: str) -> DataFrame:
        prefix = F.shiftrightunsigned("hash", BITS - root) if root else F.lit(0).cast("long")
        return df.select(*columns, F.posexplode("hashes").alias("tree", "hash")).withColumn("prefix", prefix)

    def laid_out() -> DataFrame:
        """Blocks and their queries, in parts of bounded size."""
        sizes = placed(data).groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n_rows"))
        visits = placed(asked).groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n_queries"))
        blocks = sizes.join(visits, ["tree", "prefix"]).select("tree", "prefix", F.ceil(F.col("n_rows") / (4 * block_rows)).cast("int").alias("parts"), F.ceil(F.col("n_queries") / block_rows).cast("int").alias("asks"))
        return small(stored(blocks, "blocks"))

    keys = ["tree", "prefix", "part", "ask"]

    def row_side(*columns: str) -> DataFrame:
        out = placed(data, *columns).join(blocks, ["tree", "prefix"])
        return out.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).drop("parts", "asks")

    def query_side(df: DataFrame, *columns: str) -> DataFrame:
        out = placed(df, *columns).join(blocks, ["tree", "prefix"])
        return out.withColumn("ask", F.pmod(F.xxhash64("query"), F.col("asks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "asks")

    while True:
        blocks = laid_out()
        counts = row_side("rep").groupBy(*keys).cogroup(query_side(asked, "query").groupBy(*keys)).applyInArrow(_count(root), "query long, n array<long>")
        at_depth = counts.select("query", F.posexplode("n").alias("d", "n")).groupBy("query", "d").agg(F.sum("n").alias("n"))
        enough = asked.select("query").join(at_depth.filter(F.col("n") >= candidates).groupBy("query").agg(F.max("d").alias("d")), "query", "left")
        enough = stored(enough, "enough")
        if not root or enough.filter("d IS NULL").isEmpty():
            break
        root = 0  # some query must ascend above its blocks
    deep = stored(asked.join(enough.select("query", (F.coalesce("d", F.lit(0)) + root).cast("int").alias("depth")), "query"), "depths")

    found = row_side("rep", "vector").groupBy(*keys).cogroup(query_side(deep, "query", "vector", "depth").groupBy(*keys)).applyInArrow(_score(k + 1), "query long, rep long, score double")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")
    listed = found.join(members.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    # Back to all query rows, without the row itself.
    query_of = rows.filter(is_query(F.col("id"))).join(asked.select("query", F.col("vector").alias("v")), "v").select("id", "query")
    own = query_of.join(lists, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("near"))
    out = own.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
