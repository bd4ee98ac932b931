"""Tables written between steps, so that no step's work is planned or done twice and lost executors cost little."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The run's folder below spark.checkpoint.dir; a temporary one only where that is unset and the driver runs
    all tasks itself, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="siftlake-")
        _ROOTS[app] = f"{base.rstrip('/')}/siftlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already; the folder's owner clears it then
        pass


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, in one folder for each value of the columns `by`."""
    path = f"{root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
