"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local run gets one of its own, which goes when Python ends; a cluster gets an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Saved tables of one run of an operator. They are read again from files, so a lost executor costs no earlier step; results may still read them, so they stay until close() or until the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Remove all that is left. A session that has ended already leaves its folder to the cluster's own clearing."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):
            self._delete(self.root)
