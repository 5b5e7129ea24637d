"""Reading the given tables, and small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows: with whole texts in them, the usual 10,000 rows fill the Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def settled(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df checkpointed, in as many partitions as its rows need (16 at least, never more than it had): what is small stays small in the shuffles that follow."""
    df = checkpointed(df)
    return df.coalesce(max(16, df.count() // rows))


BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, computed once, to be broadcast if it has at most ``rows`` rows (of ids and hashes), else left to a shuffle join."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= rows else df


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, kept: Column, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents for which ``kept`` holds: those of the lowest id hashes, so the same ones each time.

    An id counts once: of texts (or labels) that repeat an id the least is taken. What is broadcast are ``rows`` ids at most.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & kept)
    picked = known.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1, ..., so that none clashes with those an operator adds; and which is which."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names
