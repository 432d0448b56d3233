"""Helpers that the operators of this subpackage share: input tables, the shared folder, text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words as the contracts cut them: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    A fresh folder of our own only works when driver and executors are one machine, as in tests; anywhere else it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewright-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where it is, so that it can be removed."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and nothing before it runs again when an executor is lost."""
    return stored(df, name)[0]


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a table of our own in the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs within: rows that carry several whole texts."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that begins within go when it ends: for queries whose results are written and read from there."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES or so from now on, in this session; a longer row is a batch of its own.

    A task holds several batches at a time, on either side of the pipe, and neither side gives all of that back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Bits of the filter that tells which rows need a join at all: 1 MB.
FILTER_BITS = 1 << 23


def maybe_among(rows: DataFrame, key: Column, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows with a column maybe__: whether their key may be in the one column of ids; false is certain.

    ids become a filter of bits that goes to all tasks, so that only rows that may be among them need be shuffled to meet
    them.  A filter that is too full only lets more rows through.  Null is a key like any other.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    of_id = place(F.col(ids.columns[0]))
    filled = ids.groupBy(F.bitmap_bucket_number(of_id).alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of_id)).alias("bits__"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col("bits__"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.join(F.broadcast(filled), F.bitmap_bucket_number(place(key)) == F.col("bucket__"), "left").select(*[F.col(f"`{c}`") for c in rows.columns], maybe.alias("maybe__"))


def matching(rows: DataFrame, key: Column, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key is in the one column of ids (distinct, a table)."""
    some = maybe_among(rows, key, ids, bits).where("maybe__").drop("maybe__")
    return some.join(ids.toDF("id__"), key.eqNullSafe(F.col("id__")), "left_semi")


def not_matching(rows: DataFrame, key: Column, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key is not in the one column of ids (distinct, a table)."""
    marked = maybe_among(rows, key, ids, bits)
    some = marked.where("maybe__").drop("maybe__").join(ids.toDF("id__"), key.eqNullSafe(F.col("id__")), "left_anti")
    return marked.where("NOT maybe__").drop("maybe__").unionByName(some)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII takes the quick way, which is the same there."""
    quick = F.lower(F.decode(F.encode(text, "UTF-8"), "UTF-8"))
    return F.when(F.length(text) == F.octet_length(text), quick).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
