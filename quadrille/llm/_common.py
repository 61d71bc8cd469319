"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the ASCII white space that separates words.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: Partitions of an exchange that a thin table's file takes.
THIN = 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``, or, in local mode only, one of our own if that is unset."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, *, files: int | None = None, thin: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage, survives lost executors (the table isn't on any executor's disk) and forgets the
    partitioning, so that a later join gets its own exchange, which adaptive execution can split when a key is hot.
    A ``thin`` table has a few numbers for a document at most: it gets one file for THIN partitions of an exchange.
    """
    spark = df.sparkSession
    if thin:
        files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // THIN)
    path = f"{shared_dir(spark)}/quadrille-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the written table replaces the exchanges: Spark removes their files when it is done
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, rows: int = 500):
    """An Arrow batch in parts of so many rows, so that only a part's texts are Python objects at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def text_of(docs: DataFrame, col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(docs[col].cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
