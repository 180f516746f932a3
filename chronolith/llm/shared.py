"""What the corpus operators share: the scratch folder, words, and column passing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The white space that the contracts name: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is unset on one machine (tests), a folder of this process is used
    and removed at its end. On a cluster it must be set, as executors could not see such a
    folder; its owner clears it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="chronolith-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(f"file://{_own[0]}")
        root = f"file://{_own[0]}"
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the scratch tables that this process has made, and says how many; for when all results are written."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        at = path(_made.pop())
        gone += at.getFileSystem(conf).delete(at, True)
    return gone


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the bare path of a URI; tasks read shared files through it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def kept(spark: SparkSession, df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, so lost executors cost no rerun of it."""
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add: its own win over an input's."""
    lower = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in lower])


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that ``df`` has not, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        made = f"_{n}"
        while made in have:
            made = f"_{made}"
        have.add(made)
        out.append(made)
    return out


def widened(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of ``df`` with ``fields`` behind it."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array], schema: pa.Schema | None = None) -> pa.RecordBatch:
    """``batch`` with some columns put in place of their namesakes or appended."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for n, a in columns.items():
        if n in names:
            arrays[names.index(n)] = a
        else:
            names.append(n)
            arrays.append(a)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Settings for long texts: Python tasks get at most ``rows`` documents at a time, and Parquet writers
    look at a page's size every few rows, so that neither holds hundreds of long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("parquet.page.size.row.check.min", 10)
