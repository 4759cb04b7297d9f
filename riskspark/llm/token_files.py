"""Token ids in Parquet list columns that allow selective reads.

One row per document, in ascending order of ids over the files: doc_id, n_tokens,
start within the file, and the list of ids.  Token ids are dictionary coded (or delta
coded, by choice), the numeric columns delta coded (format version 2), row groups and
pages are kept small, and the writer adds page indexes.  A reader of counts or of one
document touches the few pages it needs, not the lists.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .store import keyed, parallelism, plain_id, small, stored
from .tokens import library_coder


def write_options(encoding: str, row_group_bytes: int, page_rows: int) -> dict[str, str]:
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    numbers = {f"parquet.enable.dictionary#{c}": "false" for c in ("id", "n_tokens", "start", "shard")}
    return numbers | {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 1000, files: int | None = None) -> None:
    """Write the ids of every row, each document closed by ``end_id``, in ascending order of doc_id.

    Null and empty texts are the end id alone.  Rows with one id follow each other in
    the order of their texts' hashes; null ids come first.  Files are ranges of (id, text
    hash), so neither many rows nor one repeated id make a file too large.
    """
    source = keyed(docs, id_col, text_col)
    ordered = source.repartitionByRange(files or parallelism(docs.sparkSession), "id", "t").sortWithinPartitions("id", "t")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, at_token = library_coder(tokenizer_path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, ids, offsets in coder.column(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ends = offsets + np.arange(offsets.size)
                n = np.diff(ends)
                ids = np.insert(ids, offsets[1:], end_id).view(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), part.column(0), pa.array(n), pa.array(at_token + ends[:-1]), tokens], ["shard", "id", "n_tokens", "start", "tokens"])
                at_token += int(ends[-1])

    out = ordered.select("id", "text").mapInArrow(rows, "shard int, id long, n_tokens long, start long, tokens array<int>")
    out.write.options(**write_options(encoding, row_group_bytes, page_rows)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as (shard, id, n_tokens, start, tokens); select columns to read only those."""
    return spark.read.schema("shard int, id long, n_tokens long, start long, tokens array<int>").parquet(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    ``start``: tokens of all documents before it.  A file's offset comes from the counts
    of the files before it, for which only n_tokens is read.
    """
    tokens = read_tokens(spark, path)
    sizes = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "file-starts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc, pa.int64())], ["shard", "id", "local", "n_tokens", "ids_crc32"])

    read = tokens.select("shard", "id", "start", "tokens").mapInArrow(rows, "shard int, id long, local long, n_tokens long, ids_crc32 long")
    return read.join(small(bases), "shard").select(plain_id().alias("doc_id"), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
