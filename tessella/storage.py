"""Written tables that cut lineage, and joins that broadcast a side only by its counted size."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows, counted first, take no more than this.
BROADCAST_BYTES = 8 << 20
#: Seconds between two of the driver's collections, after which Spark deletes the shuffle files of finished work.
_COLLECT_EVERY = 5.0
_collected = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary
    one; a cluster's executors would not see that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif context.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="tessella-")
            context.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df, written as a table in the shared folder and read back: lineage ends here and lost executors cost nothing
    but the tasks they ran. The folder goes when it is dropped or the driver's JVM ends."""
    global _collected
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    if time.monotonic() - _collected > _COLLECT_EVERY:
        jvm.System.gc()
        _collected = time.monotonic()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(df: DataFrame | None) -> None:
    """Removes a stored table that nothing will read again."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sized_join(big: DataFrame, small: DataFrame, on, how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """big joined with a stored table: by broadcast if its counted rows fit BROADCAST_BYTES, else by a sort-merge
    join, whose hot partitions adaptive execution splits."""
    n = small.count()
    return big.join(F.broadcast(small) if n * row_bytes <= BROADCAST_BYTES else small.hint("merge"), on, how)
