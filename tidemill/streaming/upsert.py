"""A table that a stream keeps at the latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources.folders import list_folder, new_folder, remove_folder
from tidemill.sources.tables import event_stream

BUCKETS = 16


class UpsertTable:
    """Rows by key in files of ``bucket=<hash of key>/version=<batch>``.

    A batch reads the newest version before it of the buckets that its keys fall in,
    keeps the row of the largest ``order`` of each key, and writes those buckets as
    version = its own number; then a file ``_batches/<batch>`` says that it is
    complete. A batch that is run again reads what it read before and puts the same
    rows in the same place, so it changes nothing, wherever it was broken off. Readers
    see complete batches only. Other buckets aren't read or written. A version goes
    two complete batches after it was replaced.

    Rows with a null in a key are keys of their own; a null order is the least; of rows
    that tie, the one with the largest columns stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, list(keys), order, buckets

    def _numbers(self, folder: str, prefix: str = "") -> list[int]:
        return sorted(int(name.removeprefix(prefix)) for name in list_folder(self.spark, folder) if name.startswith(prefix) and name.removeprefix(prefix).isdigit())

    def complete(self) -> list[int]:
        return self._numbers(f"{self.path}/_batches")

    def _current(self, bucket: int, batches: set[int]) -> int | None:
        return max((v for v in self._numbers(f"{self.path}/bucket={bucket}", "version=") if v in batches), default=None)

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/bucket={b}/version={v}" for b, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        batches = set(self.complete())
        return self._read({b: v for b in range(self.buckets) if (v := self._current(b, batches)) is not None})

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Take in a batch of rows; the same batch again changes nothing."""
        before = {b for b in self.complete() if b < batch}
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", place)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # BUCKETS at most
        held = self._read({b: v for b in touched if (v := self._current(b, before)) is not None}).withColumn("bucket", place)
        columns = [c for c in rows.columns if c != "bucket"]
        whole = F.struct(F.col(self.order).alias("order"), F.struct(*columns).alias("row"))
        latest = rows.unionByName(held).groupBy("bucket", *(F.col(k).alias(f"key {k}") for k in self.keys)).agg(F.max(whole).alias("latest"))
        merged = latest.select("bucket", F.lit(batch).alias("version"), "latest.row.*")
        for bucket in touched:
            remove_folder(self.spark, f"{self.path}/bucket={bucket}/version={batch}")
        merged.write.partitionBy("bucket", "version").mode("append").parquet(self.path)
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/_batches/{batch}")
        self._clear(touched, before | {batch})

    def _clear(self, buckets: list[int], batches: set[int]) -> None:
        floor = sorted(batches)[-2:][0]
        for bucket in buckets:
            kept = [v for v in self._numbers(f"{self.path}/bucket={bucket}", "version=") if v <= floor and v in batches]
            for version in kept[:-1]:
                remove_folder(self.spark, f"{self.path}/bucket={bucket}/version={version}")

    def write(self, stream: DataFrame, state: str) -> StreamingQuery:
        """Keep the table up to date with what a stream has now; state is the stream's checkpoint folder."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def stream_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, kept by an upsert."""
    table = UpsertTable(spark, new_folder(spark, "latest"), "user_id long, ts timestamp, event_id long, event_type string", ["user_id"], "ts")
    table.write(event_stream(spark, sf_dir), new_folder(spark, "latest-state")).awaitTermination()
    return table.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (stream_latest_events,)}

ORACLE_SQL = {
    "stream_latest_events": """
SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
}
