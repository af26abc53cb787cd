"""Shared working folder of a job: intermediate tables that outlive executors.

Every operator that needs to cut lineage writes a Parquet table below the folder
named by ``spark.checkpoint.dir`` and reads it back.  All executors see that
folder, so losing one of them never loses a finished table.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_roots:
        _own_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kvlake-")
    return _own_roots[context.applicationId]


class Scratch:
    """Names and writes the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/kvlake/{label}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written rows."""
        path = f"{self.folder}/{name}"
        df.write.options(**options).parquet(path, partitionBy=list(partition_by) or None)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str = "") -> None:
        """Delete one table, or the whole folder; later reads of it would fail."""
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


_shipped: set[str] = set()


#: Rows and bytes of one Arrow batch; the same for all operators, as a session has one
#: setting and a frame that is not run yet would take another operator's.
_BATCH_ROWS, _BATCH_BYTES = 1000, 8 << 20


def prepare_workers(spark: SparkSession) -> None:
    """Give Python workers this package, and bound one Arrow batch by rows and bytes."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="kvlake-")) / f"{package.name}_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, str(file.relative_to(package.parent)))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
