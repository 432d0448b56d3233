"""A stream of bars merged into a stored history, with the rule of the batch merge: the first bar of a day stays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.prep import KEY, incremental_merge
from ..schema import HISTORY, HISTORY_COLUMNS, struct
from ..sources.files import exists


def bar_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of Parquet files as they appear in a folder."""
    return spark.readStream.schema(struct(HISTORY)).parquet(folder)


def with_file(bars: DataFrame) -> DataFrame:
    """bars with __file, which rises with the age of their files; one value for a stream that is not of files."""
    try:
        return bars.withColumn("__file", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    except AnalysisException:
        return bars.withColumn("__file", F.lit(0))


def append_history(bars: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to a history partitioned by ticker, exactly once per bar, until the files that are there are read.

    Each micro-batch adds the bars that the stored history lacks, however old they are; there is no watermark.  A
    micro-batch that is run again finds its own bars stored and adds none.  One such query at a time may write to ``out``.
    """
    spark = bars.sparkSession
    if exists(spark, f"{out}/_spark_metadata"):
        raise ValueError(f"{out} was written by a file sink, whose log would hide what is added here")

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("__seq", F.struct("__file", F.monotonically_increasing_id())).drop("__file")
        stored = batch.sparkSession.read.schema(struct(HISTORY)).parquet(out) if exists(spark, out) else None
        fresh = new if stored is None else new.join(stored.select(*KEY), [*KEY], "left_anti")
        incremental_merge(None, fresh, "__seq").select(HISTORY_COLUMNS).write.mode("append").partitionBy("Ticker").parquet(out)

    rows = with_file(bars).select(*HISTORY_COLUMNS, "__file")
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
