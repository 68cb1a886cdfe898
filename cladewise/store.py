"""Cutting lineage with tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
#: Folders of the runs of this process.
_runs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir`` or the context's checkpoint folder. Only where neither is set and Spark
    runs in one process a temporary folder is made; a cluster without the setting is an error.
    """
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="cladewise-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables of all runs of this process, once their results are written; returns the number of folders."""
    runs, _runs[:] = list(_runs), []
    for path in runs:
        _delete(spark, path)
    return len(runs)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Cuts:
    """Named intermediate tables of one operator run; a later table of the same name replaces the earlier one."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _runs.append(self.root)
        self._paths: dict[str, str] = {}
        self._n = 0

    def save(self, name: str, df: DataFrame, group: int | None = None) -> DataFrame:
        """Write ``df`` and return it as a scan without lineage. The table it replaces is deleted once this one is whole.

        ``group`` is the number of rows of a row group, for rows of megabytes: a writer holds 100 rows before it looks at their size, and a
        reader takes thousands at once, but neither goes beyond a row group.
        """
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        writer = df.write.mode("overwrite")
        (writer.option("parquet.block.row.count.limit", group) if group else writer).parquet(path)
        old = self._paths.pop(name, None)
        if old:
            _delete(self.spark, old)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self._paths.pop(name, None)
        if path:
            _delete(self.spark, path)
