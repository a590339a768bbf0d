"""Session helpers: shared-folder tables, size-checked broadcasts, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest relation that is broadcast, in bytes of its rows; larger ones are shuffled.
BROADCAST_BYTES = 24 << 20
#: Bytes of an Arrow batch on its way to a Python worker while a table is written.
BATCH_BYTES = 4 << 20
#: Bytes of a file below which tables of known bounds aren't split.
FILE_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine) gets a folder of its own; a cluster
    must name one, as no folder of one machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most (or one row) in what runs inside."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_SETTING) if before is None else spark.conf.set(_BATCH_SETTING, before)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Tables written since the innermost ``working_tables`` of this thread began.
_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def working_tables() -> Iterator[list[DataFrame]]:
    """Deletes the tables written inside once it ends, but for those put into the list it gives."""
    outer, own, kept = _made.get(), [], []
    token = _made.set(own)
    try:
        yield kept
    finally:
        _made.reset(token)
        stay = {getattr(df, "_torqueline_table", None) for df in kept}
        for spark, path in own:
            if path not in stay:
                _delete(spark, path)
                _written.remove((spark, path))
            elif outer is not None:
                outer.append((spark, path))


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before Python
            return


atexit.register(_clean)


def write_table(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Arrow batches are bounded by bytes meanwhile, so long rows don't fill a worker.  most
    is a bound of the table's bytes where one is known: a small table is then written by
    few tasks to few files, whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if most is not None:
        df = df.coalesce(1 + most // FILE_BYTES)
    _written.append((spark, path))
    if (own := _made.get()) is not None:
        own.append((spark, path))
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._torqueline_table = path
    return table


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows * row_bytes`` is within the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """Connected components of ``links(a, b)``: one row (node, component_id) per node that has a link.

    component_id is the smallest node reachable.  Each round takes the smallest
    label among a node and its neighbours, then follows labels twice, so the
    number of rounds grows with the logarithm of the longest path.  Links are
    kept once each way; labels are written to the shared folder every round.
    n_links is a bound of the number of links, if one is known.
    """
    both = links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    most = None if n_links is None else 32 * n_links
    both = write_table(both, "links", most)
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component_id")), "labels", most)
    n = labels.count()
    while n:
        side = bounded_broadcast(labels, n, 40)
        near = both.join(side.select(F.col("node").alias("b"), "component_id"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component_id").alias("near"))
        step = labels.join(bounded_broadcast(near, n, 40), "node", "left").select("node", F.col("component_id").alias("was"), F.least("component_id", F.coalesce("near", "component_id")).alias("c1"))
        for k in (1, 2):
            jump = side.select(F.col("node").alias(f"c{k}"), F.col("component_id").alias("up"))
            step = step.join(jump, f"c{k}", "left").select("node", "was", F.least(F.col(f"c{k}"), F.coalesce("up", f"c{k}")).alias(f"c{k + 1}"))
        new = write_table(step.select("node", "was", F.col("c3").alias("component_id")), "labels", 24 * n)
        labels = new.select("node", "component_id")
        labels._torqueline_table = new._torqueline_table
        if not new.where("was <> component_id").limit(1).count():
            break
    return labels
