"""Operator 13: allow and block rules over urls by a sort-merge range join.

A rule is a host and a path prefix; it fits the host itself and all its subdomains.
Canonical keys hold a host's labels from last to first, then the path. A url has one
key for each of its host's last labels, as many as any rule's host has: under such a
key, "fits" is "starts with the rule's key", and what starts with a key is an interval
of the sort order. Intervals of prefixes either nest or are apart, so one sweep over
the sorted keys, with the rules that are open at a place on a stack, finds for each
key the longest rule: the topmost. Of a url's keys the one with the most labels that
met a rule decides, so the longest host wins, then the longest path.

The sort order is cut at ends that a sample of keys proposes; rows are dealt by these
cuts and sorted within. A rule goes to each stretch that its interval meets, so a
stretch needs nothing from those before it. Keys of one url or of one popular host, be
they a third of all, are cut apart by a hash of the row. Neither rules nor urls are
ever held at once: a task holds its stack, whose depth is that of nested rules.

Edge cases: a null url, or one without '://', has an empty host and an empty path, and
fits a rule of an empty host and path only; rows come back as often as they occur,
whatever their ids; a rule that is null in any column is left out; of two verdicts
for one host and path, block wins; a verdict other than allow and block is an error;
urls may be of any length (cuts use CUT characters of a key, which moves cuts only); an
empty table gives no row, no rules give every url the default. Only the id and the url
are read; other columns may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import MOST_TASKS, ascii_lower, scratch, stored

PER_STRETCH = 1 << 18  # keys of a stretch, about
LEAST_STRETCH = 1 << 12  # a stretch of fewer would cost more than it helps
SAMPLED = 32  # keys a stretch that propose its ends
CUT = 256  # characters of a key that an end keeps
LABEL_END, HOST_END = "\x00", "\x01"

Cut = tuple[str, int]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first '://' up to '/', '?' or '#', in lower case; then up to '?' or '#'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def reversed_labels(host: Column) -> Column:
    """A host's labels, last first; characters that end labels or hosts in keys are escaped."""
    plain = F.replace(F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02c")), F.lit(HOST_END), F.lit("\x02b")), F.lit(LABEL_END), F.lit("\x02a"))
    return F.reverse(F.split(plain, r"\."))


def key_of(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, LABEL_END), F.lit(HOST_END), path)


def page_keys(pages: DataFrame, labels: int) -> DataFrame:
    """row, level, key, salt: a row for each of the host's last labels, at most that many."""
    named = pages.withColumn("labels", reversed_labels(F.col("host")))
    levels = F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(labels)))
    each = named.withColumn("level", F.explode(levels))
    key = key_of(F.slice("labels", 1, F.col("level")), F.col("path"))
    return each.select("row", "level", key.alias("key"), F.shiftrightunsigned(F.xxhash64("row", F.lit("salt")), 1).alias("salt"))


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, level, rule, verdict of host, path, verdict."""
    known = rules.select("host", "path", "verdict").dropna()
    checked = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("neither allow nor block: "), F.col("verdict"))))
    once = known.withColumns({"host": ascii_lower(F.col("host")), "verdict": checked}).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = reversed_labels(F.col("host"))
    return once.select(key_of(labels, F.col("path")).alias("key"), F.size(labels).alias("level"), F.concat("host", "path").alias("rule"), "verdict")


def stretch_count(keys: int, partitions: int) -> int:
    return min(MOST_TASKS, max(1, math.ceil(keys / PER_STRETCH), min(partitions, math.ceil(keys / LEAST_STRETCH))))


def cuts_of(keys: DataFrame, count: int, total: int) -> list[Cut]:
    """The ends between ``count`` stretches. The driver gets about SAMPLED short keys a stretch."""
    if count == 1:
        return []
    share = min(1.0, SAMPLED * count / total)
    sampled = keys.where(F.pmod(F.xxhash64("row", "level", F.lit("cuts")), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sorted((r["key"], r["salt"]) for r in sampled.select(F.substring("key", 1, CUT).alias("key"), "salt").collect())
    return sorted({found[len(found) * i // count] for i in range(1, count)}) if found else []


def interval(cuts: list[Cut], prefix: str) -> range:
    """The stretches that hold keys which start with a prefix."""
    first = last = bisect_right(cuts, (prefix, -1))
    while last < len(cuts) and cuts[last][0].startswith(prefix):
        last += 1
    return range(first, last + 1)


def _placed_keys(cuts: list[Cut]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts, place) for place in zip(batch["key"].to_pylist(), batch["salt"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["stretch", *batch.schema.names])

    return run


def _placed_rules(cuts: list[Cut]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key in enumerate(batch["key"].to_pylist()):
                at = interval(cuts, key)
                for k in range(0, len(at), 4096):
                    here = pa.array(at[k : k + 4096], pa.int32())
                    yield pa.RecordBatch.from_arrays([here, *(c.take(pa.array([i] * len(here), pa.int64())) for c in batch.columns)], names=["stretch", *batch.schema.names])

    return run


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, level, rule, verdict of the keys that meet a rule: the topmost on the stack. Rows come by stretch, key, salt."""
    stack: list[tuple[str, str, str]] = []
    here = None
    for batch in batches:
        out: list[tuple[int, int, str, str]] = []
        for stretch, key, row, level, rule, verdict in zip(*(batch[c].to_pylist() for c in ("stretch", "key", "row", "level", "rule", "verdict")), strict=True):
            if stretch != here:
                here, stack = stretch, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row is None:
                stack.append((key, rule, verdict))
            elif stack:
                out.append((row, level, *stack[-1][1:]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "level", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; rules has host, path, verdict.

    The longest host that a rule with a fitting path has decides, then its longest
    path; where no rule fits, rule is null and the verdict is the default.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "url-rows")  # fixes the row numbers
    with scratch(spark) as keep:
        known = keep(rule_keys(rules), "rules")
        labels = known.agg(F.coalesce(F.max("level"), F.lit(1))).first()[0]
        keys = page_keys(rows, labels)
        total = keys.count()
        count = stretch_count(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
        cuts = cuts_of(keys, count, total)
        points = keys.select("key", "salt", "row", "level").mapInArrow(_placed_keys(cuts), "stretch int, key string, salt long, row long, level int")
        opened = known.mapInArrow(_placed_rules(cuts), "stretch int, key string, level int, rule string, verdict string")
        both = points.unionByName(opened.withColumn("salt", F.lit(-1).cast("long")), allowMissingColumns=True)
        dealt = both.repartition(len(cuts) + 1, "stretch").sortWithinPartitions("stretch", "key", "salt")
        met = dealt.mapInArrow(sweep, "row long, level int, rule string, verdict string")
        best = stored(met.groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), "level").alias("best")), "url-met")
    joined = rows.join(best, "row", "left")
    return joined.select(F.col("id").alias(page_id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: host, path, verdict of the contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def example_rules(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string")


ORACLE_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests
), met AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM met
"""
