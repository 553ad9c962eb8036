"""Tables written between the parts of a computation, so that a lost executor costs one part and no plan is run twice."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="eventloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Writes df once as a table in the shared folder and returns a reader of it; removed when the driver ends.

    The driver's garbage is collected, since executors keep the shuffle files of a plan until the driver forgets it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the tables of cut(), once all that reads them has been written elsewhere."""
    for t in tables:
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        files = where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration())
        files.delete(where, True)
        files.cancelDeleteOnExit(where)
