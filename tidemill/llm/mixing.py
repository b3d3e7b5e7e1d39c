"""Operator 8: mix sources to target weights by capped water-filling.

DataFrame functions only. A source's target is its weight's share of the whole
mix, clamped at ``max_epochs`` times the source; what clamping frees is shared
again by weight until no source is above its cap. Sorting the sources by
size / weight makes the clamped ones a prefix, so that the fixed point follows
from two running sums over the table of sources. Running sums are made by ranges
(:func:`running_sums`), so neither many sources nor many rows at one place gather in
one task.

Each document is taken ``floor(target / source size)`` whole times. The rest of
the target is filled in the order of a seeded hash: whole documents while they
fit and a part of the one at the edge, at most one such document a source. The
edge is found on sums over hash bins, so only the rows of one bin a source are
ever sorted, in ranges, however large the source.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, the last one; a source without words has target 0; rows with
the same id (or without id) share a hash and take neighbouring places in the order, by
size and then by a hash of the whole row, which their sums settle by ranges as well, so
reruns take the same rows; an empty table gives an empty result. Only the named columns are read, other
columns pass through :func:`mixed_documents` under their own names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import ASCII_SPACE_WORD, broadcast_if_small, stored

BINS = 4096  # of the seeded hash; of each source one bin is sorted
_HASH_BITS = 60
FEW = 10_000  # rows that are always one range
PER_TASK = 1 << 20  # rows that a task sorts, about


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ASCII_SPACE_WORD)), F.lit(0)).cast("long")


def seeded_hash(key: Column, seed: str) -> Column:
    """60 bits of a digest of seed and key, the same in every SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_sums(rows: DataFrame, order: Sequence[str], values: Sequence[str], per_task: int = PER_TASK, *, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """rows with before_<value>: the sum over all rows before it in the (total) order.

    The rows are cut into ranges of about per_task of them; sums within a range are
    added to those of the ranges before it, of which there are few. Up to FEW rows, as
    of a table of sources, are one range, which needs no table of its own.
    """
    count = rows.count()
    if count <= min(FEW, per_task):
        every = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return rows.select(*rows.columns, *(F.coalesce(F.sum(v).over(every), F.lit(0)).alias(f"before_{v}") for v in values))
    ranges = max(1, -(-count // per_task))
    placed = keep(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    ahead, within = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(*(F.sum(v).alias(v) for v in values))
    sums = sums.select(F.col("range").alias("sum_range"), *(F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"ahead_{v}") for v in values))
    joined = placed.join(F.broadcast(sums), F.col("range") == F.col("sum_range"))  # a row a range
    return joined.select(*rows.columns, *((F.col(f"ahead_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"before_{v}") for v in values))


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """source, size -> source, size, target. The driver gets four sums."""
    named = sources.select("source", "size", F.col("source").isNull().alias("unnamed"), F.lit(1).cast("long").alias("one"))
    ranked = running_sums(named, ["unnamed", "source"], ["one"])
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighted = ranked.select("source", "size", F.col("before_one").alias("rank"), F.element_at(cycle, (F.col("before_one") % len(weights) + 1).cast("int")).alias("weight"))
    cap = F.lit(float(max_epochs)) * F.col("size")
    filled = running_sums(weighted.withColumns({"ratio": F.col("size") / F.col("weight"), "cap": cap}), ["ratio", "rank"], ["cap", "weight"])
    filled = stored(filled, "mix-filled")
    every = filled.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    total = float(every["size"]) * float(share)
    clamped = (F.lit(total) - F.col("before_cap")) * F.col("weight") >= F.col("cap") * (F.lit(float(every["weight"])) - F.col("before_weight"))
    held = filled.where(clamped).agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    rest = F.col("weight") * F.lit(total - held["cap"]) / F.lit(max(every["weight"] - held["weight"], 1e-300))
    return filled.select("source", "size", F.when(clamped, F.col("cap")).otherwise(rest).alias("target"))


def _plan(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """source -> its size, target, whole repetitions and where its fraction ends."""
    bins = stored(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    targets = water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("size")), weights, share, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("part", F.floor(F.col("target") - F.col("whole") * F.col("size") + 0.5).cast("long"))
    running = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ends = bins.withColumn("end", F.sum("bin_size").over(running)).withColumnRenamed("source", "bin_source")
    reached = F.when(F.col("end") > F.col("part"), F.struct("bin", (F.col("end") - F.col("bin_size")).alias("before")))
    joined = targets.join(ends, F.col("source").eqNullSafe(F.col("bin_source")))
    edge = joined.groupBy("source", "size", "target", "whole", "part").agg(F.min(reached).alias("edge"))
    return edge.select(
        F.col("source").alias("plan_source"),
        F.col("size").alias("source_size"),
        "target",
        "whole",
        "part",
        F.coalesce("edge.bin", F.lit(BINS)).alias("edge_bin"),
        F.coalesce("edge.before", F.lit(0)).alias("edge_before"),
    )


def _sized(docs: DataFrame, seed: str, keep: Column | None) -> DataFrame:
    order = seeded_hash(F.col("doc_id"), seed)
    columns = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), order.alias("order"), F.shiftright(order, _HASH_BITS - BINS.bit_length() + 1).cast("int").alias("bin")]
    return docs.select(*columns, *([keep.alias("row")] if keep is not None else []))


def _take(sized: DataFrame, plan: DataFrame) -> DataFrame:
    joined = sized.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    plain = joined.where(F.col("bin") != F.col("edge_bin")).withColumn("extra", F.when(F.col("bin") < F.col("edge_bin"), F.col("size")).otherwise(F.lit(0)))
    content = F.xxhash64(F.to_json("row")) if "row" in sized.columns else F.lit(0)
    edge = joined.where(F.col("bin") == F.col("edge_bin")).withColumns({"unnamed": F.col("source").isNull(), "content": content, "salt": F.monotonically_increasing_id()})
    # Rows that are alike in all but the salt can change places without changing the result.
    edge = stored(running_sums(edge, ["unnamed", "source", "order", "doc_id", "size", "content", "salt"], ["size"]), "mix-edge")
    first = stored(edge.groupBy(F.col("source").alias("first_source")).agg(F.min("before_size").alias("first_size")), "mix-first")
    edge = edge.join(broadcast_if_small(first), F.col("source").eqNullSafe(F.col("first_source")))
    left = F.col("part") - F.col("edge_before") - (F.col("before_size") - F.col("first_size"))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return plain.unionByName(edge.select(*plain.columns))


def mix_plan(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each document (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken.
    """
    sized = stored(_sized(docs, seed, None), "mix-sized")
    plan = stored(_plan(sized, weights, share, max_epochs), "mix-plan")
    taken = F.col("whole") * F.col("size") + F.col("extra")
    return _take(sized, plan).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, in docs' columns.

    A source's edge document appears once more with the words that still fit,
    from a seeded place in it; its n_chars, if there is one, follows.
    """
    sized = _sized(docs, seed, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    plan = stored(_plan(stored(sized.drop("row"), "mix-sized"), weights, share, max_epochs), "mix-plan")
    taken = _take(sized, plan)
    full = F.col("extra") >= F.greatest(F.col("size"), F.lit(1))
    partial = (F.col("extra") > 0) & ~full
    words = F.regexp_extract_all(F.col("row.text"), F.lit(ASCII_SPACE_WORD), 0)
    start = F.pmod(F.col("order"), F.greatest(F.col("size") - F.col("extra") + 1, F.lit(1))) + 1
    cut = F.when(partial, F.array_join(F.slice(words, start.cast("int"), F.greatest(F.col("extra"), F.lit(0)).cast("int")), " "))
    copies = F.col("whole") + F.when(full | partial, 1).otherwise(0)
    copied = taken.withColumn("cut", cut).withColumn("copies", copies.cast("int")).where("copies > 0")
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    is_cut = partial & (F.col("copy") == F.col("copies"))
    changed = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return copied.select(*(F.when(is_cut, changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns))


#: The same mix in DuckDB; the running sum goes over all of a source at once.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources
), sums AS (
  SELECT *, 2.0::DOUBLE * size AS cap, CAST(sum(size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(2.0::DOUBLE * size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM weighted
  WINDOW o AS (ORDER BY CAST(size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), clamps AS (
  SELECT *, (total - cap_before) * weight >= cap * (all_weight - weight_before) AS clamped FROM sums
), rests AS (
  SELECT *, total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0) AS rest, all_weight - coalesce(sum(CASE WHEN clamped THEN weight END) OVER (), 0) AS rest_weight FROM clamps
), targets AS (
  SELECT source, size AS source_size, CASE WHEN clamped THEN cap ELSE weight * rest / rest_weight END AS target FROM rests
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), running AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target - p.whole * p.source_size + 0.5) AS BIGINT) AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken FROM running
"""
