"""Tables written on the way, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or on one machine in a folder that goes with the process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="chronolith-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what is read more than once is computed once, and lost executors cost no rerun of it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what this process has written here, and says how many folders; for when all results are written."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        at = path(_made.pop())
        gone += at.getFileSystem(conf).delete(at, True)
    return gone
