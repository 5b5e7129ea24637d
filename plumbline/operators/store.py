"""Tables that a job goes over several times, computed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are used behind it: Spark copies expressions into filters and other columns, but not through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used, functions of elements included."""
    return F.get(F.transform(F.array(c), use), 0)


def computed_once(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """df written once as a table in the shared folder, in buckets of its keys: joins and sums by these (and more) keys need no exchange, as often as it is read.

    There are as many buckets as the session has shuffle partitions, so that such tables go together with each other and with what is shuffled.
    """
    spark, name = df.sparkSession, f"laid_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
