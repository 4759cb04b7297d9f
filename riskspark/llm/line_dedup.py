"""Lines that many documents share, by range-partitioned hashes.

Occurrences (hash of the line, document, position) are partitioned by ranges of
(hash, document) and sorted by (hash, document, position) inside a partition.  Each
partition is read once as a stream: a run of one hash is decided as soon as enough
documents were seen, so at most a few documents' occurrences are held.  A range cut
may fall inside a run, so one hash with a third of all rows is spread over many tasks;
only the first and last run of a partition can be undecided, and their counts are added
up in a small second step.  The result is one compressed bitmap of kept lines for each
document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import keyed, parallelism, plain_id, stored

#: Fixed value: what is stripped from a line's ends before it is compared.
STRIPPED = b" \t\n\x0b\x0c\r"
#: Bitmaps are broadcast up to so many bytes in all (measured first), else joined by shuffle.
BROADCAST_BYTES = 8 << 20
OCCURRENCE = "k1 long, k2 long, id long, t long, pos int"


def _occurrences(min_length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            digests, at, pos = [], [], []
            for i, text in enumerate(batch.column(2)):
                for j, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    key = line.strip(STRIPPED).lower()  # bytes: A-Z only
                    if len(key) >= min_length and (min_length < 2 or sum(c & 0xC0 != 0x80 for c in key) >= min_length):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        at.append(i)
                        pos.append(j)
                if len(digests) > 200_000:
                    yield _batch(digests, ids, ts, at, pos)
                    digests, at, pos = [], [], []
            if digests:
                yield _batch(digests, ids, ts, at, pos)

    return rows


def _batch(digests, ids, ts, at, pos) -> pa.RecordBatch:
    k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    at = np.asarray(at)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(ids[at]), pa.array(ts[at]), pa.array(np.asarray(pos, np.int32))], ["k1", "k2", "id", "t", "pos"])


def _stream(min_docs: int):
    """Sorted occurrences in; out those of runs with enough documents, and of undecided runs at the partition's ends.

    ``n``: on the first row of a run in this partition its number of documents here, else 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry: pa.Table | None = None  # the last run, not yet decided
        done: tuple[int, int] | None = None  # the last run's key if it has enough documents
        first = True  # no run has ended yet

        def out(t: pa.Table, n: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                t = t.append_column("n", pa.array(n)).append_column("sure", pa.array(sure)).append_column("part", pa.array(np.full(len(n), part, np.int32)))
                yield from t.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            k1, k2, ids, ts = (t.column(c).to_numpy() for c in ("k1", "k2", "id", "t"))
            new_run = np.ones(t.num_rows, bool)
            new_run[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1])
            run = np.cumsum(new_run) - 1
            n_docs = np.bincount(run[new_doc])
            enough = n_docs >= min_docs
            went_on = done == (int(k1[0]), int(k2[0]))
            enough[0] |= went_on
            last = n_docs.size - 1
            emit = enough[run]
            if first:
                emit |= (run == 0) & (last > 0)
            head = np.where(new_run, n_docs[run], 0)
            if went_on:  # its first row is out already
                head[0] = 0
            yield from out(t.filter(pa.array(emit)), head[emit], enough[run][emit])
            done = (int(k1[-1]), int(k2[-1])) if enough[last] else None
            carry = None if enough[last] else t.slice(int(np.flatnonzero(new_run)[-1])).combine_chunks()
            first = first and last == 0 and not enough[0]
        if carry is not None:
            n = np.zeros(carry.num_rows, np.int64)
            c = (carry.column("id").to_numpy(), carry.column("t").to_numpy())
            n[0] = 1 + int(np.count_nonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])))
            yield from out(carry, n, np.zeros(carry.num_rows, bool))

    return rows


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, dropped = [], []
        for n, gone in zip(batch.column(2).to_numpy(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(int(n), bool)
            keep[gone or []] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n) - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int64()), pa.array(packed, pa.binary())], ["id", "t", "n_lines", "n_dropped", "bitmap"])


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = False, min_length: int = 1, tasks: int | None = None) -> DataFrame:
    """One row (id, t, n_lines, n_dropped, bitmap) per document.

    A line is compared with its ends stripped of ASCII white space and A-Z lower-cased.
    Lines of at least ``min_length`` code points found in ``min_docs`` documents or more
    are dropped; with ``keep_first`` the first one by (id, text hash, position) stays.
    ``bitmap``: zlib of one bit a line, 1 where it is kept.  A null or empty text is one
    empty line, which is never dropped.  Rows equal in id and text are one document and
    give one row; a null id counts as the least id.  No rows give no rows.
    """
    spark = docs.sparkSession
    source = keyed(docs, id_col, text_col)
    found = stored(source.mapInArrow(_occurrences(min_length), OCCURRENCE), "lines")
    tasks = tasks or parallelism(spark)
    order = ["k1", "k2", "id", "t"]
    runs = found.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "pos").mapInArrow(_stream(min_docs), f"{OCCURRENCE}, n long, sure boolean, part int")
    runs = stored(runs, "runs")
    # Undecided runs, and the partition that has a run's first row: one row for each run and partition.
    heads = runs.filter("n > 0").groupBy("k1", "k2").agg((F.max("sure") | (F.sum("n") >= min_docs)).alias("enough"), F.min("part").alias("first_part")).filter("enough")
    # A decided run's rows need no look-up but for its first row, so a frequent line is not joined by its hash.
    plain = runs.filter("sure AND n = 0")
    rest = runs.filter("NOT (sure AND n = 0)").join(heads, ["k1", "k2"])
    if keep_first:
        rest = rest.filter((F.col("n") == 0) | (F.col("part") != F.col("first_part")))
    gone = plain.select("id", "t", "pos").unionByName(rest.select("id", "t", "pos"))
    gone = gone.groupBy("id", "t").agg(F.collect_set("pos").alias("gone"))
    lines = source.select("id", "t", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")).groupBy("id", "t").agg(F.first("n_lines").alias("n_lines"))
    return lines.join(gone, ["id", "t"], "left").mapInArrow(_bitmaps, "id long, t long, n_lines long, n_dropped long, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, bitmaps = batch.column(0), batch.column(1)
        kept = []
        for text, bitmap in zip(texts, bitmaps, strict=True):
            if not bitmap.is_valid:
                kept.append(text.as_py())
                continue
            lines = text.as_py().split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), np.uint8), count=len(lines))
            kept.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
        out = batch.drop_columns(batch.schema.names[:2])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(kept, pa.string())], [*out.schema.names, "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` as (doc_id, ``more``..., n_lines, n_dropped, kept text), lines joined by \\n."""
    bitmaps = stored(bitmaps, "bitmaps")
    size = bitmaps.filter("n_dropped > 0").agg(F.coalesce(F.sum(F.length("bitmap") + 64), F.lit(0))).first()[0]
    hit = bitmaps.filter("n_dropped > 0").select("id", "t", "n_dropped", "bitmap")
    source = keyed(docs, id_col, text_col, *more)
    joined = source.join(F.broadcast(hit) if size <= BROADCAST_BYTES else hit, ["id", "t"], "left")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = joined.select("text", "bitmap", plain_id().alias("doc_id"), *more, n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(_apply, f"{schema}, kept string")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, more: tuple[str, ...] = (), **options) -> DataFrame:
    """``apply_bitmaps`` of ``line_bitmaps``."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_docs, **options), id_col, text_col, more)
