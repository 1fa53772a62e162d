"""Tables in the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode without one, a new temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{_LOCAL[app]}"


class Scratch:
    """Named Parquet tables of one operator call. The last ones live as long as the session, since results read them lazily."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.n = spark, 0
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write `df` and read it back; the schema is passed on, so no footer is read for it."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def save_counting(self, df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, dict]:
        """save() and the named aggregates of the rows, taken while they are written."""
        seen = Observation()
        back = self.save(df.observe(seen, *counts), name)
        return back, seen.get

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any longer."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Delete all tables of the call."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder is cleared with it
            pass
