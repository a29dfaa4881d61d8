"""The folder that driver and executors share, for cut lineage and for tables that a query writes for itself."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or where that is not set a folder of its warehouse, which is shared as well."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from then on from Parquet files in the shared folder, whose size the planner knows.

    Columns there are compressed, which a checkpoint's rows are not.
    """
    path = fresh(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
