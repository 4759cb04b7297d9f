"""Session helpers: local sessions for tests and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="riskspark-ckpt-"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A table up to this many bytes is broadcast; its rows are counted and its texts measured first.
BROADCAST_BYTES = 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 16 a column, and the length of texts, binaries and lists (16 an entry)."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map")):
            size = size + 16 * F.coalesce(F.size(F.col(f"`{name}`")), F.lit(0))
    return size.cast("long")


def small_side(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint behind a size check for tables of numbers; beyond it the join shuffles."""
    return F.broadcast(df) if n_rows * 16 * len(df.columns) <= BROADCAST_BYTES else df


def counted(df: DataFrame) -> DataFrame:
    """Checkpoint a small summary, measure it, and hint a broadcast if it is small."""
    fixed = cut_lineage(df)
    total = fixed.agg(F.coalesce(F.sum(row_bytes(fixed)), F.lit(0))).first()[0]
    return F.broadcast(fixed) if total <= BROADCAST_BYTES else fixed


def spread(df: DataFrame) -> DataFrame:
    """Checkpoint rows that are about to be multiplied (seeds, replicates, permutations).

    They are computed once, and if they sit in fewer partitions than the cluster
    has cores (few rows, many copies) they are dealt out again first.
    """
    fixed = cut_lineage(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return fixed.repartition(cores) if fixed.rdd.getNumPartitions() < cores else fixed
