"""Intermediate tables written to shared storage.

A staged table cuts the lineage, survives the loss of executors, and is read back with column
pruning and row-group statistics. It lies below the folder that the session names in
`spark.checkpoint.dir`.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

SETTING = "spark.checkpoint.dir"


_local_root: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names; in local mode without one, a temporary folder."""
    global _local_root
    root = spark.conf.get(SETTING, None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    _local_root = _local_root or tempfile.mkdtemp(prefix="tableprobe-")
    return _local_root


class Stage:
    """Folder of one run; every table in it is written once and then only read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/tableprobe/{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._guard = threading.Lock()
        self._locks: dict[str, threading.RLock] = {}

    def _lock(self, name: str) -> threading.RLock:
        with self._guard:
            return self._locks.setdefault(name, threading.RLock())

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str, build) -> DataFrame:
        """The staged table of this name, built and written on first use."""
        with self._lock(name):  # one of several threads builds it
            if name not in self._tables:
                df = build()
                path = f"{self.path}/{name}"
                df.write.mode("error").parquet(path)
                self._tables[name] = self.spark.read.schema(df.schema).parquet(path)
            return self._tables[name]

    def small(self, name: str, build) -> DataFrame:
        """A table of about one row per column or dataset, kept as a local relation.

        Its size follows from the schemas and the number of partitions, never from the data.
        """
        with self._lock(name):
            if name not in self._tables:
                self._tables[name] = self.spark.createDataFrame(build().toArrow())
            return self._tables[name]

    def together(self, *makers) -> None:
        """Run independent jobs concurrently, so that one fills the gaps of another."""
        with ThreadPoolExecutor(len(makers)) as pool:
            for job in [pool.submit(inheritable_thread_target(self.spark)(make)) for make in makers]:
                job.result()
