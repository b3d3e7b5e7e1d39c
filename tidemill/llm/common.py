"""Small helpers that the operators share: folders, size checks, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.folders import new_folder, remove_folder

#: A word is a run of characters other than these.
ASCII_SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 20_000
#: Tasks of a shuffle at most: the driver plans each, so blocks beyond this number share tasks.
MOST_TASKS = 1 << 15
#: Of texts or hashes that go to a Python worker at once.
BATCH = 8 << 20

#: A column that a scan adds: its name, Spark type and Arrow type.
Field = tuple[str, str, pa.DataType]
#: Takes the values of the used columns of a batch; yields row numbers in the batch and a list for each field.
Maker = Callable[..., Iterator[tuple[Sequence[int], Sequence[Any]]]]


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs no more than a read. The table stays
    until its owner clears the shared folder, unless it is written into a folder of
    :func:`scratch`.
    """
    path = f"{folder}/{name}" if folder else new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function like :func:`stored` whose tables go when the block is left.

    What the block returns must rest on other tables.
    """
    top, count = new_folder(spark, "scratch"), iter(range(1 << 60))
    try:
        yield lambda df, name: stored(df, f"{name}-{next(count)}", top)
    finally:
        remove_folder(spark, top)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """Within the block, Arrow batches end at so many bytes, if not before.

    The default is many times that, and both a task's JVM side and its Python worker
    keep what a batch once took. Only jobs that the block itself runs see this, and those
    that another thread runs meanwhile in the same session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scan(docs: DataFrame, keep: Sequence[str], use: Sequence[str], start: Callable[[], Maker], fields: Sequence[Field]) -> DataFrame:
    """The kept columns, untouched whatever their types, and the fields that a maker adds.

    Each task calls start once for its maker. The maker may give any number of rows
    for a row of its input; their kept columns are repeated.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*kept, *(F.col(f"`{c}`").alias(f"used {i}") for i, c in enumerate(use)))
    types = [f.dataType.simpleString() for f in docs.select(*kept).schema]
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in zip(keep, types, strict=True)), *(f"`{n}` {t}" for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            columns, used = batch.columns[: len(keep)], batch.columns[len(keep) :]
            for at, made in make(*(u.to_pylist() for u in used)):
                whole = len(at) == len(batch) and all(i == j for i, j in enumerate(at))
                taken = columns if whole else [c.take(pa.array(at, pa.int64())) for c in columns]
                arrays = [pa.array(values, kind) for values, (_, _, kind) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*taken, *arrays], names=[*keep, *(n for n, _, _ in fields)])

    return rows.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df has at most that many rows; else Spark shuffles.

    df should be a stored table, as this counts it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: Column) -> Column:
    """A digest of a text (null: empty), to tell rows of one id apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, from the words' hashes."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n])
    return out


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def labelled_sample(labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """doc_id, label of about ``rows`` usable labelled ids (all, if there are fewer).

    A seeded hash of the id chooses them, so the choice needs no sort. An id with
    several labels counts once, with the largest; null ids and labels don't count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.coalesce(usable, F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """label, text of the chosen ids, one row an id: of several texts, the least.

    The sample's size is bounded, so it is safe to broadcast; rows that repeat an id
    shrink to one before they are shuffled.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")
