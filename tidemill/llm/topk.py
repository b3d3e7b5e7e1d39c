"""Operator 7: exact top-k search by distributed histogram selection.

The score of a query and a row is the integer inner product of their vectors,
whose components are ``floor(256 * x)``. Queries and rows are cut into blocks;
a block of queries meets a block of rows in a cell, one matrix product of
bounded size. Every pass scores all cells anew and keeps no score:

1. each pass counts scores in equal bins of a query's current range, sums the
   counts over all cells and narrows the range to the bin that holds the k-th
   highest score, until a bin is one score wide (or holds the k-th one last);
2. the last pass keeps the scores from that value up. Of the rows that tie
   there, a cell keeps its k smallest ids at most, which cannot change the k
   smallest of all.

A cell counts only bins from its own k-th highest score up: the k-th highest of
all is not below it. So a cell sends at most k bins for each query, and ties of
any number stay counts. What crosses the network is a number per query, cell and
rank; vectors are copied once for each block that they meet.

Edge cases: vectors that are null or hold null, NaN or infinite components take
no part; a null id takes no part either; vectors of unequal lengths are compared
as if the shorter ended in zeros; an empty vector scores 0; repeated rows are
rows of their own, and only the row that is the query itself is left out: all
rows of its id; a repeated query id is one query (its largest vector); scores
beyond +-2**62 are cut to that; an empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import MOST_TASKS, stored

QUERY_BLOCK = 2048  # queries in a cell at most, on average
ROW_BLOCK = 16_384  # rows in a cell, likewise
LEAST_CELLS = 64
BINS = 1024
STEP = 1024  # rows that are scored at once
_EXACT = 2.0**53
LIMIT = 2**62


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, null where the vector takes no part."""
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & whole, parts)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, cut to +-2**62."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (queries, rows)]
    return np.array([[min(max(int(x), -LIMIT), LIMIT) for x in r] for r in whole[0] @ whole[1].T], dtype=np.int64).reshape(len(queries), len(rows))


def _cell_pass(one: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame | None], columns: list[str]) -> Callable:
    """Score a cell in steps and let ``one`` reduce each step."""

    def run(_key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(queries) and len(rows):
            width = max(queries["vector"].map(len).max(), rows["vector"].map(len).max())
            q, r, ids = _matrix(queries["vector"], width), _matrix(rows["vector"], width), rows["vec_id"].to_numpy()
            for at in range(0, len(r), STEP):
                part = one(queries, _scores(q, r[at : at + STEP]), ids[at : at + STEP])
                if part is not None and len(part):
                    made.append(part)
        return pd.concat(made) if made else pd.DataFrame({c: pd.Series(dtype=np.int64) for c in columns})

    return run


def _histogram(k: int) -> Callable:
    """Counts of scores in the bins of each query's range, above its local k-th score."""

    def one(queries: pd.DataFrame, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        own = ids[None, :] == queries["query_id"].to_numpy()[:, None]
        low, step = queries["low"].to_numpy()[:, None], queries["step"].to_numpy()[:, None]
        high = queries["high"].to_numpy()[:, None]
        counted = ~own & (scores >= low)
        floor = np.where(counted, scores, np.iinfo(np.int64).min)
        if floor.shape[1] > k:
            floor = np.partition(floor, floor.shape[1] - k, axis=1)[:, floor.shape[1] - k :]
            counted &= scores >= floor.min(1)[:, None]
        bins = np.where(scores > high, BINS, (scores - low) // step)  # above the range: one bin for all
        at, _ = counted.nonzero()
        if not len(at):
            return None
        pairs, n = np.unique(np.stack([queries["query_id"].to_numpy()[at], bins[counted]]), axis=1, return_counts=True)
        return pd.DataFrame({"query_id": pairs[0], "bin": pairs[1], "n": n})

    return one


def _best(k: int) -> Callable:
    """The k best rows of each query in a step, of those that reach its threshold."""

    def one(queries: pd.DataFrame, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        own = ids[None, :] == queries["query_id"].to_numpy()[:, None]
        at, column = (~own & (scores >= queries["low"].to_numpy()[:, None])).nonzero()
        found = pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], "vec_id": ids[column], "score": scores[at, column]})
        return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)

    return one


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of every query.

    vectors has vec_id and embedding; is_query picks the queries among its rows.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    kept = stored(kept.where("vec_id IS NOT NULL AND vector IS NOT NULL"), "topk-vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    about = kept.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)).alias("queries"), F.coalesce(F.max(norm), F.lit(0.0)).alias("norm")).first()
    query_blocks = max(1, -(-about["queries"] // QUERY_BLOCK))
    row_blocks = max(-(-LEAST_CELLS // query_blocks), -(-about["rows"] // ROW_BLOCK))
    cells = query_blocks * row_blocks
    tasks = min(cells, MOST_TASKS)  # a task takes its cells one by one
    reach = int(min(about["norm"] * (1 + 1e-9) + 1, float(LIMIT)))  # no score is above the largest squared norm

    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks))
    rows = kept.select("vec_id", "vector", salt.alias("row_block"))
    rows = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    rows = rows.select((F.col("query_block") * row_blocks + F.col("row_block")).alias("cell"), "vec_id", "vector").repartition(tasks, "cell")
    queries = kept.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.max("vector").alias("vector"))
    queries = queries.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    # The widest range of whole bins around all possible scores.
    step = max(1, -(-(2 * reach + 1) // BINS))
    ranges = queries.withColumns({"low": F.lit(-reach).cast("long"), "high": F.lit(-reach + step * BINS - 1).cast("long"), "step": F.lit(step).cast("long")})

    def over_cells(ranged: DataFrame, one: Callable, schema: str) -> DataFrame:
        dealt = ranged.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        dealt = dealt.select((F.col("query_block") * row_blocks + F.col("row_block")).alias("cell"), "query_id", "vector", "low", "high", "step").repartition(tasks, "cell")
        names = [c.split()[0] for c in schema.split(", ")]
        return dealt.groupBy("cell").cogroup(rows.groupBy("cell")).applyInPandas(_cell_pass(one, names), schema)

    while True:
        counts = over_cells(ranges, _histogram(k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("bin")))
        reached = counts.withColumn("above", above).where(F.col("above") >= k).groupBy("query_id").agg(F.max("bin").alias("bin"))
        narrow = ranges.join(reached, "query_id", "left")
        within = F.col("bin").isNotNull() & (F.col("bin") < BINS)
        low = F.when(within, F.col("low") + F.col("bin") * F.col("step")).otherwise(F.col("low"))
        narrow = narrow.select("query_id", "vector", "query_block", low.alias("low"), F.when(within, low + F.col("step") - 1).otherwise(F.col("high")).alias("high"))
        ranges = stored(narrow.withColumn("step", F.lit(max(1, -(-step // BINS))).cast("long")), "topk-ranges")
        if step == 1:
            break
        step = max(1, -(-step // BINS))

    best = over_cells(ranges, _best(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same search in DuckDB, over rows that are all finite and without nulls inside.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
