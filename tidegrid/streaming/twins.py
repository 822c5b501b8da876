"""Streaming twins of batch operators, on Structured Streaming.

Operators that need a whole series (downsampling) have no streaming form; they run over what a stream has gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    spec = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = spec.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spec).isDirectory()
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def bucket_counts(df: DataFrame, time: str, width: str, tags: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by time bucket and tags; with `late`, events later than that behind the newest are dropped and closed buckets can be given out once."""
    source = df.withWatermark(time, late) if late else df
    return source.groupBy(F.window(time, width)["start"].alias("time"), *tags).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, time: str, gap: str, tags: list[str], late: str) -> DataFrame:
    """Events of a tag set with less than `gap` between them."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *tags).agg(F.count("*").alias("n")).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *tags, "n")


def newest_once(df: DataFrame, time: str, late: str, key: list[str]) -> DataFrame:
    """Each key once within the time that late events are waited for."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder: a batch that is run again replaces what it wrote before."""
    spark = df.sparkSession
    path = new_path(spark, "drained")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(df.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").select(*df.columns)


def write_batches(df: DataFrame, write, checkpoint: str):
    """A stream given to write(batch, number) batch by batch, exactly once if the write replaces what that number wrote before."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
