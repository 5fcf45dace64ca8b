"""Stage tables shared by many queries.

Like the phase boundaries of the original pipeline (cleaned transactions,
per-customer tables, rules), each stage is written **once** as parquet under
the shared folder the cluster names in ``spark.checkpoint.dir`` and read back
by every consumer.  This cuts lineage (a lost executor recomputes from the
written table, not from the raw join) and lets later phases prune columns
and push filters into the stage scan.  Set ``RETAILSPARK_MATERIALIZE=0`` to
keep everything lazy instead.

A workspace belongs to one Spark application and one version of the input:
the modification times and sizes of the input tables are part of its key, so
changed data get new stages.  ``Stages(spark, sf_dir, root=...)`` puts the
tables into a folder of the caller's choice.
"""

from __future__ import annotations

import uuid
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retailspark.session import apply_semantic_conf, ensure_checkpoint_dir

_WORKSPACES: dict[tuple, "Stages"] = {}


def input_version(spark: SparkSession, folder: str) -> tuple:
    """(name, modification time, bytes) of what lies in ``folder``, and in the
    tables that are folders themselves; from the file system the cluster uses."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    out = []
    for s in fs.listStatus(path):
        inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        out += [(s.getPath().getName(), x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in inner]
    return tuple(sorted(out))


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize = os.environ.get("RETAILSPARK_MATERIALIZE", "1") != "0"
        self._root = root
        self._done: set[str] = set()
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Stages":
        apply_semantic_conf(spark)
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), input_version(spark, sf_dir))
        ws = _WORKSPACES.get(key)
        if ws is None:
            ws = _WORKSPACES[key] = cls(spark, sf_dir)
        return ws

    def path(self, name: str) -> str:
        if self._root is None:
            self._root = f"{ensure_checkpoint_dir(self.spark)}/retailspark-stages/{uuid.uuid4().hex}"
        return f"{self._root.rstrip('/')}/{name}"

    def once(self, name: str, write: Callable[[], object]) -> str:
        """Run ``write`` the first time; the path of ``name``."""
        if name not in self._done:
            write()
            self._done.add(name)
        return self.path(name)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.materialize:
            if name not in self._frames:
                self._frames[name] = build()
            return self._frames[name]
        return self.spark.read.parquet(
            self.once(name, lambda: build().write.mode("overwrite").parquet(self.path(name))))

    def value(self, name: str, build: Callable[[], object]) -> object:
        """Small driver-side parameters (fitted coefficients, chosen k)."""
        if name not in self._frames:
            self._frames[name] = build()
        return self._frames[name]
