"""Tables that a query writes on its way, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="kvlake-"))


class Workspace:
    """A folder for one call; it goes when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/kvlake/{label}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write rows once and return a frame that reads what was written."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def remove(self) -> None:
        with contextlib.suppress(Exception):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
