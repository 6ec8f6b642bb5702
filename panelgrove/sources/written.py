"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder for a local master and one below the
    warehouse for a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="panelgrove-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelgrove"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written and read back: what stands before is computed once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(rows: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """A result table at ``path``, whole or not at all: it is written beside it and renamed when every task has ended well. An
    existing path is refused; a failure leaves nothing behind."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"))
    files = target.getFileSystem(conf)
    if files.exists(target):
        raise FileExistsError(path)
    try:
        rows.write.format(kind).options(**options).save(staged.toString())
        if not files.rename(staged, target):
            raise OSError(f"could not rename to {path}")
    finally:
        files.delete(staged, True)
