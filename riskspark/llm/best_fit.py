"""Best-fit packing after a dominance reduction, on the histogram of lengths.

Which items share a bin depends on lengths only, and a length is at most the bin's
capacity.  So the instance is a histogram with ``capacity`` entries at most, whatever
the number of items: it is the one thing that reaches the driver.  There, sets that
provably lie in some optimal packing are fixed first (Martello and Toth's reduction:
a length alone, a pair or a triple that dominates every other set with its largest
item), until nothing more can be fixed; the rest is packed by best fit decreasing.
Both work on whole classes of equal lengths, so time does not grow with the items.

The items are then placed where they are: an item of length l that is the r-th of its
length takes the r-th place for l.  r is a number within the item's task plus an
offset from a table of counts per (task, length).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .store import small, stored
from .tokens import library_coder


class _Sizes:
    """Lengths that are left, with their counts."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {s: c for s, c in histogram.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.remove(size)

    def largest(self, at_most: int, without: int) -> int | None:
        """The largest length up to ``at_most`` that is there besides one item ``without``."""
        i = bisect_right(self.order, at_most) - 1
        if i >= 0 and self.order[i] == without and self.n[without] == 1:
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest_fit(self, room: int, without: int) -> int:
        """How many of the smallest items fit into ``room`` together, one item ``without`` aside; 3 stands for more."""
        k = 0
        for s in self.order:
            c = self.n[s] - (s == without)
            take = min(c, room // s)
            k, room = k + take, room - take * s
            if k >= 3 or take < c:
                break
        return min(k, 3)

    def best_pair(self, room: int, without: int) -> tuple[int, int] | None:
        """Two lengths a >= b besides one item ``without``, with the largest sum up to ``room``; of equal sums the largest a."""
        best = None
        for a in reversed(self.order[: bisect_right(self.order, room)]):
            if best and 2 * a < sum(best):
                break
            if self.n[a] - (a == without) < 1:
                continue
            i = bisect_right(self.order, min(a, room - a)) - 1
            while i >= 0 and self.n[self.order[i]] - (self.order[i] == without) - (self.order[i] == a) < 1:
                i -= 1
            if i >= 0 and (best is None or a + self.order[i] > sum(best)):
                best = (a, self.order[i])
        return best

    def next_two_above(self, size: int, without: int) -> int | None:
        """Sum of the two items that come next above ``size``, or None if there are not two."""
        got = []
        for s in self.order[bisect_right(self.order, size) :]:
            got += [s] * min(2, self.n[s] - (s == without))
            if len(got) >= 2:
                return got[0] + got[1]
        return None


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins fixed by dominance as (lengths, how many such bins), and the histogram that is left."""
    left, fixed, changed = _Sizes(histogram), [], True
    while changed:
        changed = False
        for size in sorted(left.n, reverse=True):
            while left.n.get(size):
                room, found = capacity - size, None
                k = left.smallest_fit(room, size)
                if k == 0:
                    found = (size,)
                else:
                    mate = left.largest(room, size)
                    if k == 1 or size + mate == capacity:
                        found = (size, mate)
                    elif k == 2:
                        pair = left.best_pair(room, size)
                        if pair is None or mate >= sum(pair):
                            found = (size, mate)
                        elif pair[0] == mate:
                            above = left.next_two_above(pair[1], size)
                            if above is None or size + above > capacity:
                                found = (size, *pair)
                if not found:
                    break
                need = {s: found.count(s) for s in found}
                times = min(left.n[s] // c for s, c in need.items())
                for s, c in need.items():
                    left.take(s, c * times)
                fixed.append((found, times))
                changed = True
    return fixed, left.n


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over classes of equal lengths: bins as (lengths, how many such bins)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, what: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_bins:
                open_bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append((what, times))

    for size in sorted(histogram, reverse=True):
        todo = histogram[size]
        while todo:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                what, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:  # as many new bins as needed
                room, what = capacity, ()
                times = -(-todo // (capacity // size))
            each = room // size  # best fit stays with a bin until it is full for this length
            full = min(times, todo // each)
            put(room - each * size, what + (size,) * each, full)
            todo -= full * each
            rest = times - full
            if rest and todo:
                put(room - todo * size, what + (size,) * todo, 1)
                todo, rest = 0, rest - 1
            put(room, what, rest if what else 0)
    return [x for room in open_bins.values() for x in room]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """All bins: those fixed by dominance, then best fit of the rest."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    fixed, left = reduce_instance(histogram, capacity)
    return fixed + best_fit_decreasing(left, capacity)


def _places(bins: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, first sequence, offset): ranks from there on go to consecutive sequences."""
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for sizes, times in bins:
        offset = 0
        for s in sizes:
            out.append((s, rank.get(s, 0), sequence, offset))
            rank[s] = rank.get(s, 0) + times
            offset += s
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


#: A length takes the bits above these in the key of a place; ranks fit below.
RANK_BITS = 46


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored items with ``length``, ``shard`` and ``nth``.

    ``length``: 1 to ``capacity``.  ``nth``: number of the item among those of its
    length in its ``shard``, from 0.  Items of a sequence lie without gaps from offset 0.
    """
    counts = stored(items.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(pack_histogram(histogram, capacity))
    keys = (places[:, 0] << RANK_BITS) + places[:, 1]
    before = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    ranked = items.join(small(bases), ["shard", "length"])
    columns = [c for c in items.columns if c not in ("shard", "nth")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            p = places[np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1] if len(length) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p[:, 2] + rank - p[:, 1]), pa.array(np.ascontiguousarray(p[:, 3]))], [*columns, "sequence_id", "offset"])

    ranked = ranked.select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(rows, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token pieces of at most ``capacity``: (doc_id, piece, start, length, ids_crc32, shard, nth).

    A document's ids end with ``end_id``.  A longer one is cut so that its first piece is the short one.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, seen = library_coder(tokenizer_path, pattern), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi, all_ids, offsets in coder.column(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                out: list[tuple] = []
                for i in range(hi - lo):
                    ids = all_ids[offsets[i] : offsets[i + 1]].tobytes() + end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        out.append((i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), shard, int(seen[length])))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:5]), pa.array(c[5], pa.int32()), pa.array(c[6], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"])

    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, shard int, nth long")


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), sequence_id, offset.  Null and empty texts
    are the end id alone.  Each row is a document of its own, also if rows repeat; an
    empty table gives no rows; other columns are not read.
    """
    return pack(stored(token_pieces(docs, tokenizer_path, pattern, capacity, end_id, id_col, text_col), "pieces"), capacity)
