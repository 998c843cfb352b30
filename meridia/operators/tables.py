"""Tables in the folder that driver and executors share, to cut lineage; broadcasts of a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have: ids of 8 bytes make about 64 MB as a hash relation.
BROADCAST_ROWS = 2_000_000
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder if all runs on this machine, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors on other machines need a folder that all of them share")
        app = spark.sparkContext.applicationId
        found = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="meridia-"))
    return found.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove():
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone; the folder is then the cluster's to clear
            pass

    atexit.register(remove)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/meridia-{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._meridia_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that shared_table wrote; nothing that is still to be computed may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._meridia_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it has at most ``rows`` rows; otherwise leave the join to a shuffle, whose skew AQE splits."""
    return F.broadcast(df) if at_most(df, rows) else df
