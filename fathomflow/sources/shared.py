"""Where intermediate tables are kept: the shared folder that the cluster names in spark.checkpoint.dir.

Reliable checkpoints and written tables survive the loss of executors; a machine-local folder is used only
where the session names none, as in tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch on its way to a Python worker (one row may hold more).
BATCH_BYTES = "4m"
#: Tables of short rows are broadcast up to this many rows.
SMALL_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; a local one is set only where none is named and all executors are on this machine."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            folder = own.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        else:
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of a few megabytes unless it names a size: else 10,000 texts, however long, go to a worker at once."""
    if not spark.conf.get(_BATCH_SETTING, None):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, read back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """Marks a table of short rows for broadcast where it has SMALL_ROWS rows at most; beyond, it is joined by shuffle."""
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table
