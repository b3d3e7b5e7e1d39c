"""Operator 12: how the sources of a language differ, from each other and from the whole.

Terms are runs of letters, Latin capitals in lower case. A language keeps the V terms
that at least LEAST_DOCS of its documents hold. A group (language, source) gives a kept
term p = 1 + floor(SCALE * (n + PRIOR) / (N + PRIOR * V)), n being the term's count
there and N the sum of counts of kept terms; a language likewise. All arithmetic is on
whole numbers.

- Part ``pair`` is, for two sources of a language, the sum of abs(p - q) over all kept
  terms. Most counts are 0, so it is made from those that aren't. With b for what a
  count of 0 gives, the sum is V * abs(b_s - b_t) and three corrections: for the terms
  of s alone against b_t, for those of t alone against b_s (both from running sums over
  the values of p, a source at a time), and for the terms of both (a join by term).
- Part ``term`` is, for a group, the terms that it uses more than its language does,
  the first ``top`` by p - q. Radix selection finds each group's last value: histograms
  of the leading bit's place and then of DIGIT bits at a time tell in which digit the
  k-th value lies, so only counts are shuffled. Where more rows than SORTED share that value, their UTF-8
  bytes are refined the same way, past what all of them begin with. What is then
  sorted is at most top + SORTED rows a group.

The result has a row for each pair of a language's sources, by contract; the join by
term makes as many rows a term. Both are dealt in blocks of BLOCK sources, so a term that
all sources hold, or a language with a great many, spreads over tasks; pairs are summed
before they are shuffled. Ranks of pairs come from ranges, not from sorting a group.

Edge cases: null text, language and source are empty; a group without terms has its
rows of part ``pair`` (value 0 if V = 0) and none of part ``term``; ids are not read,
so repeated rows count as often as they occur; terms may be of any length; an empty
table gives no row. Only the three columns named are read; others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import scratch, small_batches, stored
from tidemill.llm.mixing import running_sums

TERM_BYTES = re.compile(rb"[a-z\x80-\xFF]+")  # in lower-cased UTF-8
LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
DIGIT = 8  # bits of a histogram's digit
SORTED = 1 << 12  # rows of one value that a group's last sort takes
BLOCK = 512  # sources that one task pairs with all others of the language, about

Keep = Callable[[DataFrame, str], DataFrame]
GROUP = ["lang", "source"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs, summed over each batch of lang, source, text as UTF-8."""
    for batch in batches:
        found: dict[tuple[bytes, bytes], tuple[Counter[bytes], Counter[bytes]]] = {}
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            terms = TERM_BYTES.findall(text.lower())  # of bytes, lower() changes A to Z alone
            n.update(terms)
            docs.update(set(terms))
        for (lang, source), (n, docs) in found.items():
            keys = [pa.array(values, pa.binary()) for values in ([lang] * len(n), [source] * len(n), list(n))]
            sums = [pa.array(values, pa.int64()) for values in (list(n.values()), [docs[t] for t in n])]
            yield pa.RecordBatch.from_arrays([*keys, *sums], names=[*GROUP, "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often, and in how many documents.

    Tasks count a batch of documents at a time, in bytes, before Spark sums by term.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).cast("binary").alias(c) for c in (*GROUP, "text")))
    counted = rows.mapInArrow(_counted, "lang binary, source binary, term binary, n long, docs long")
    summed = counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.select(*(F.col(c).cast("string").alias(c) for c in (*GROUP, "term")), "n", "docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count; exact for counts up to 2**63."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n.cast("long") + PRIOR), F.nullif(whole(total.cast("long") + terms.cast("long") * PRIOR), F.lit(0).cast("decimal(20,0)"))).cast("long") + 1


def _bits(rows: DataFrame, value: str) -> int:
    return int(rows.agg(F.coalesce(F.max(value), F.lit(0))).first()[0]).bit_length()


def _reached(hist: DataFrame, order: Column) -> DataFrame:
    """Of each group's histogram the digit in which the last of its ``need`` rows lies, and what is then left to find."""
    so_far = F.sum("n").over(W.partitionBy(*GROUP).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    summed = hist.withColumn("end", so_far).where((F.col("end") >= F.col("need")) & (F.col("end") - F.col("n") < F.col("need")))
    return summed.withColumns({"need": F.col("need") - (F.col("end") - F.col("n")), "tied": F.col("n")})


def value_thresholds(rows: DataFrame, k: int, keep: Keep) -> DataFrame:
    """lang, source, least, need, tied: each group's k-th largest value; of its ``tied`` rows, ``need`` are among the k.

    Groups of fewer than k rows are left out. Values are whole numbers from 0. The
    first histogram is over the places of their leading bits, so what is refined after
    it, DIGIT bits at a time, is a group's largest values, not all.
    """
    longest = _bits(rows, "value")
    leading = F.length(F.bin("value"))
    hist = rows.groupBy(*GROUP, leading.alias("digit")).agg(F.count("*").alias("n")).withColumn("need", F.lit(k).cast("long"))
    one = F.col("digit") == 1  # 0 and 1
    found = keep(_reached(hist, F.desc("digit")).select(*GROUP, F.when(one, 0).otherwise(1).cast("long").alias("prefix"), F.when(one, 1).otherwise(F.col("digit") - 1).alias("shift"), "need", "tied"), "digits")
    moved = lambda by: F.call_function("shiftright", F.col("value"), F.col(by))
    for _ in range(-(-longest // DIGIT)):
        inside = rows.join(found.drop("tied"), GROUP).where(moved("shift") == F.col("prefix"))
        hist = inside.withColumn("next", F.greatest(F.col("shift") - DIGIT, F.lit(0))).groupBy(*GROUP, "need", "next", moved("next").alias("digit")).agg(F.count("*").alias("n"))
        found = keep(_reached(hist, F.desc("digit")).select(*GROUP, F.col("digit").alias("prefix"), F.col("next").alias("shift"), "need", "tied"), "digits")
    return found.select(*GROUP, F.col("prefix").alias("least"), "need", "tied")


def text_thresholds(rows: DataFrame, values: DataFrame, keep: Keep, most: int) -> DataFrame | None:
    """lang, source, width, key: where over ``most`` rows share the last value, their first ``width`` characters are at most key.

    Each round skips what a group's remaining terms begin with alike, and looks at
    the two characters after it, so it leaves fewer rows, whatever the terms' length, and
    one at last.
    """
    most = max(most, 1)
    state, found = values.where(F.col("tied") > most).select(*GROUP, "least", "need", F.lit(0).alias("width"), F.lit("").alias("key")), None
    while not (state := keep(state, "ties")).isEmpty():
        tied = rows.withColumnRenamed("value", "v").join(state, GROUP).where((F.col("v") == F.col("least")) & (F.substring("item", F.lit(1), F.col("width")) == F.col("key")))
        ends = tied.groupBy(*GROUP).agg(F.min("item").alias("a"), F.max("item").alias("b"))
        same = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        ends = keep(ends.select(*GROUP, (F.array_position(same, F.lit(False)) + 1).cast("int").alias("next")), "ends")
        digits = tied.join(ends, GROUP).groupBy(*GROUP, "least", "need", "next", F.substring("item", F.lit(1), F.col("next")).alias("digit")).agg(F.count("*").alias("n"))
        reached = keep(_reached(digits, F.asc("digit")).select(*GROUP, "least", "need", F.col("next").alias("width"), F.col("digit").alias("key"), "tied"), "letters")
        done = reached.where(F.col("tied") <= most).select(*GROUP, "width", "key")
        found = done if found is None else found.unionByName(done)
        state = reached.where(F.col("tied") > most).drop("tied")
    return found


def top_items(rows: DataFrame, k: int, keep: Keep, most: int = SORTED) -> DataFrame:
    """lang, source, item, value, rank: of each group the first k by value, then by item's UTF-8 bytes.

    rows (lang, source, item, value) should be stored; an item occurs once a group.
    """
    values = value_thresholds(rows, k, keep)
    near = rows.join(values.select(*GROUP, "least"), GROUP, "left").where(F.col("least").isNull() | (F.col("value") >= F.col("least")))
    if (texts := text_thresholds(rows, values, keep, most)) is not None:
        near = near.join(texts, GROUP, "left").where(F.col("key").isNull() | (F.col("value") > F.col("least")) | (F.substring("item", F.lit(1), F.col("width")) <= F.col("key")))
    order = W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*GROUP, "item", "value", "rank")


def _in_blocks(rows: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """rows by block of source, and in a copy for each block."""
    return rows.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")), rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _other(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_2" for c in names})


def one_sided(groups: DataFrame, terms: DataFrame, sides: DataFrame, keep: Keep) -> DataFrame:
    """lang, source, item, own: the sum over source's terms of abs(p - b of item) - abs(b of source - b of item)."""
    levels = terms.groupBy(*GROUP, F.col("p").alias("at")).agg(F.count("*").alias("many")).withColumns({"total": F.col("many") * F.col("at"), "item": F.lit(None).cast("string")})
    probes = sides.select(*GROUP, F.col("base_2").alias("at"), F.lit(0).cast("long").alias("many"), F.lit(0).cast("long").alias("total"), "item")
    # An item's probe comes before the values that equal it; which way doesn't matter.
    summed = running_sums(levels.unionByName(probes).withColumn("is_value", F.col("item").isNull()), [*GROUP, "at", "is_value", "item"], ["many", "total"], keep=keep)
    summed = keep(summed, "sums")
    whole = summed.groupBy(*GROUP).agg(F.sum("many").alias("terms"), F.sum("total").alias("sum"), F.min("before_many").alias("first_many"), F.min("before_total").alias("first_total"))
    probed = summed.where("item IS NOT NULL").select(*GROUP, "item", "at", "before_many", "before_total").join(whole, GROUP).join(groups.select(*GROUP, "base"), GROUP)
    below, many = F.col("before_total") - F.col("first_total"), F.col("before_many") - F.col("first_many")
    apart = F.col("sum") - 2 * below - F.col("at") * (F.col("terms") - 2 * many)
    return probed.select(*GROUP, "item", (apart - F.col("terms") * F.abs(F.col("base") - F.col("at"))).alias("own"))


def pair_values(groups: DataFrame, terms: DataFrame, keep: Keep) -> DataFrame:
    """lang, source, item, value: the summed differences of every two sources of a language."""
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-widest // BLOCK)
    left, right = _in_blocks(groups.select(*GROUP, "base", "kept"), blocks)
    sides = left.join(_other(right, ["source", "base", "kept"]), ["lang", "block"]).where(F.col("source") != F.col("source_2"))
    sides = keep(sides.select(*GROUP, F.col("source_2").alias("item"), "base", "base_2", "kept"), "sides")
    own = keep(one_sided(groups, terms, sides, keep), "own")
    left, right = _in_blocks(terms.join(groups.select(*GROUP, "base"), GROUP).select(*GROUP, "term", "p", "base"), blocks)
    met = left.join(_other(right, ["source", "p", "base"]), ["lang", "term", "block"]).where(F.col("source") < F.col("source_2"))
    p, q, b, c = (F.col(x) for x in ("p", "p_2", "base", "base_2"))
    shared = met.groupBy(*GROUP, "source_2").agg(F.sum(F.abs(p - q) - F.abs(p - c) - F.abs(b - q) + F.abs(b - c)).alias("shared"))
    shared = keep(shared, "shared")
    both_ways = shared.select("lang", "source", F.col("source_2").alias("item"), "shared").unionByName(shared.select("lang", F.col("source_2").alias("source"), F.col("source").alias("item"), "shared"))
    other = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("other"))
    joined = sides.join(own, [*GROUP, "item"]).join(other, [*GROUP, "item"]).join(both_ways, [*GROUP, "item"], "left")
    value = F.col("kept") * F.abs(F.col("base") - F.col("base_2")) + F.col("own") + F.col("other") + F.coalesce("shared", F.lit(0))
    return joined.select(*GROUP, "item", F.when(F.col("kept") > 0, value).otherwise(F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = 50, most: int = SORTED) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source)."""
    with scratch(docs.sparkSession) as keep:
        with small_batches(docs.sparkSession):
            counts = keep(term_counts(docs), "counts")
        named = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        kept = keep(counts.drop("docs").join(named, ["lang", "term"]), "kept")
        sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        langs = keep(kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total")), "langs")
        every = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in GROUP)).distinct()
        groups = every.join(sums, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
        base = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0))
        groups = keep(groups.withColumn("base", base), "groups")
        p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        terms = keep(kept.join(groups, GROUP).select(*GROUP, "term", p.alias("p"), q.alias("q")), "terms")
        more = keep(terms.where(F.col("p") > F.col("q")).select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "more")
        found = stored(top_items(more, top, keep, most), "divergence-top")
        placed = pair_values(groups, terms, keep).withColumns({"down": -F.col("value"), "one": F.lit(1).cast("long")})
        placed = stored(running_sums(placed, [*GROUP, "down", "item"], ["one"], keep=keep), "divergence-placed")
    first = placed.groupBy(*GROUP).agg(F.min("before_one").alias("first"))
    pairs = placed.join(first, GROUP).select(*GROUP, F.lit("pair").alias("part"), "item", "value", (F.col("before_one") - F.col("first") + 1).cast("int").alias("rank"))
    return pairs.unionByName(found.select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank"))


#: The same audit in DuckDB, where every group gives every kept term its p.
ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS BIGINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
