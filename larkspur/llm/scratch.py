"""Intermediate tables in the folder that the whole cluster shares.

A table written here cuts lineage and survives a lost executor.  The folder is
``spark.checkpoint.dir`` of the session; only where that is unset on a local
master (tests) does a folder of the driver's own stand in.  On any other master
an unset folder is refused: executors would write to their own disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="larkspur-")
    return "file://" + _own_root


class Scratch:
    """Named Parquet tables of one run; ``drop`` frees a table that is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/larkspur-{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Delete the whole run's folder."""
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
