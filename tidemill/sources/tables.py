"""Tables of a data set, by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: events, as a stream source needs its schema beforehand.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_partitioned(rows: DataFrame, path: str, by: Sequence[str], order: Sequence[str], form: str = "parquet") -> str:
    """Write a table in folders by some columns, its files sorted within; the path.

    Rows are dealt by those columns and ranges of the order, so no value's rows gather
    in one task, and readers that filter by either skip most of what is there.
    """
    rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).write.partitionBy(*by).format(form).save(path)
    return path


def write_bucketed(rows: DataFrame, name: str, path: str, on: Sequence[str], buckets: int) -> DataFrame:
    """Keep a table in buckets of some columns' hash, one sorted file each, under a name of the session's catalog; the table.

    Tables with equal numbers of buckets, by columns of equal types, are joined and
    grouped by those columns without a shuffle, as often as they are read. A bucket
    is one task, so this is for columns without very frequent values, such as ids; where
    one has them, ``skew_join`` on plain tables spreads them.
    """
    if buckets < 1:
        raise ValueError(f"no number of buckets: {buckets}")
    dealt = rows.repartition(buckets, *(rows[f"`{c}`"] for c in on))
    dealt.write.bucketBy(buckets, *on).sortBy(*on).option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def event_stream(spark: SparkSession, folder: str, files: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """events as a stream of files; event time as a timestamp, which watermarks need.

    Without ``files``, the table is ``events.parquet`` in the folder, one file or a
    folder of part files, as Spark writes it; a pattern takes the folder's own files that
    match. Where there is no file, that is an error.
    """
    path = folder.rstrip("/") if files else f"{folder.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(EVENTS)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    reader = reader.option("pathGlobFilter", files) if files else reader
    there = spark.read.schema(EVENTS).option("pathGlobFilter", files or "*").parquet(path)
    if not there.inputFiles():
        raise FileNotFoundError(f"no files of events: {path}/{files or ''}")
    # As a pattern, a path may be one file as well as a folder.
    events = reader.parquet(path if files else f"{path[:-1]}[{path[-1]}]")
    return events.withColumn("ts", events["ts"].cast("timestamp"))


def write_json_lines(rows: DataFrame, path: str) -> str:
    """Write a table as line-delimited JSON, nulls left out, times as ISO text to the microsecond; the path."""
    times = {f.name for f in rows.schema if f.dataType == T.TimestampNTZType()}
    column = lambda c: F.date_format(f"`{c}`", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c in times else F.col(f"`{c}`")
    rows.select(F.to_json(F.struct(*map(column, rows.columns)))).write.text(path)
    return path
