"""Tables that cut lineage: written as Parquet to the folder that the whole cluster shares.

A lost executor costs nothing that was materialised; ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster shares. On one machine without one, a folder beside the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rowsentry/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write and reread ``df``; the result has no lineage beyond the files."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these; nothing that is still to be computed may read them.

    Shuffle files of finished jobs go when the driver collects its garbage, so it is asked to.
    """
    for df in tables:
        if path := vars(df).get("_written_to"):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
