"""Tables that cut lineage: Parquet in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; an unset one is set only for a single-JVM session, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskspark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Bytes of an Arrow batch that goes to a Python worker: JVM and worker hold several, outside the heap.  Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send Arrow batches of ``BATCH_BYTES`` at most (one longer row goes alone); the session's own limit comes back after."""
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: survives lost executors, and later reads prune columns."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table is hinted for broadcast only if it has at most so many rows of fixed-width columns.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (stored, a few fixed-width columns) with a broadcast hint if its rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null id inside an operator, where ids are compared and sorted.
NO_ID = -(2**63)


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``docs`` as (id, t, text, more...): integer id, hash of the text, text with null as empty.

    Rows that agree in id and text are one document wherever documents are counted.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"), *(docs[c] for c in more))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and the key of ``keyed``, under two names that ``docs`` does not have."""
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("id", "t"):
        while name in taken:
            name += "_"
        names.append(name)
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.withColumns({names[0]: F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), names[1]: F.xxhash64(text)}), names


def keep_keys(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is (``left_semi``) or is not (``left_anti``) among ``keys`` (id, t)."""
    tagged, names = with_key(docs, id_col, text_col)
    return tagged.join(keys.select(F.col("id").alias(names[0]), F.col("t").alias(names[1])), names, how)


def plain_id(c: str = "id"):
    """The id as given."""
    return F.when(F.col(c) != NO_ID, F.col(c))
