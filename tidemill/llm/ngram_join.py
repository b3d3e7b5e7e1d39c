"""Operator 2: n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each distinct shingle set (documents of one set are one
class) and a column for each shingle. Its product with its own transpose holds
the overlaps of all pairs; only blocks that can hold a link are multiplied.

A row of n shingles links only to rows that share at least ``o = ceil(t * n)`` of
them. All that is left out follows from such bounds, so no link is lost:

1. Each text becomes the hashes of its shingles. Of a row's n hashes in order, the
   first ``n - o + c`` hold the c smallest common ones of any linked pair, so a row
   of which fewer than c meet another row there has no link. The entries go to
   column blocks (hash ranges) to find columns with several rows. A task sends
   one entry for a column that it sees in several rows, whatever their number.
2. The rows left are read again, whole. Column blocks count in how many rows each
   shingle is; rows with fewer than o shared columns go. The others' rarest
   ``n - o + 1`` columns are their prefix: linked rows share a column of it.
3. Rows are dealt to blocks by the least hash of their shared columns, on which
   similar rows mostly agree; groups beyond ROWS rows or ENTRIES entries get several
   blocks. Two blocks with a prefix column in common and rows of fitting size form a
   cell, so a row of a group of m near copies is sent m / ROWS times, not m times.
4. A cell multiplies its blocks strip by strip, accumulates the overlaps and discards
   pairs below the bound. It returns each row's links and a spanning forest, never
   its pairs.
5. Alternating large and small stars contract the forests to components.

Every pair has one cell, so link counts need no later removal of repeats. Groups
of copies, large or small, are one row each until the last join; there, groups that
hold a visible share of all rows (HOT of them at most) are joined by broadcast and
the rest by their keys. Tasks are counted from the entries, not from the session's
default.

Edge cases: a null or empty text, or one without words, has an empty set, links
with nothing and is its own component; a text of fewer than k words has one
shingle, the whole sequence; repeated rows are documents of their own, and rows of
one id with unlike texts too: a digest of the text goes with the id wherever rows
are looked up; a null id counts as a document but is no component's name while
another id is there; an empty table gives no row. Only doc_id and text are read;
:func:`one_of_each` passes all other columns through, whatever they are called. Row
and column keys are 128-bit and 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import MOST_TASKS, broadcast_if_small, hash_words, rolling_hashes, scan, scratch, small_batches, stored, text_key

EXTRA = 20  # c is one part in so many of a row
ENTRIES = 1 << 19  # entries of a column block and of a row block, and what a task gathers before it sends
ROWS = 2048  # of a row block, about
STRIP = 256  # rows that are compared at once
COLUMNS = 2048  # that are multiplied at once
SPARSE = 400  # a column of less than this part of all pairs adds pairs, not a product
BROADCAST = 100_000  # rows of a key, an id and three numbers
HOT = 10_000  # a group with more than this part of all rows is joined by broadcast
Store = Callable[[DataFrame, str], DataFrame]


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    return np.unique(rolling_hashes(hash_words(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def overlap_bound(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a row of n with any row that it links to."""
    return -(-n * percent // 100)


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, ref, prefix: a task gives the prefix of a set once."""

    def start():
        seen: set[bytes] = set()

        def make(texts: list[str | None]) -> Iterator[tuple[list[int], list]]:
            at, rows, held = [], [], 0
            for i, text in enumerate(texts):
                digest = hashlib.md5((text or "").encode(), usedforsecurity=False).digest()
                found = shingles(text, k)
                n, key, ref, prefix = len(found), None, None, None
                if n:
                    key = xxhash.xxh3_128_digest(found.tobytes())
                    ref = int.from_bytes(key[:8], "little", signed=True)
                    if key not in seen:
                        seen.add(key)
                        prefix = found[: n - overlap_bound(n, percent) + max(1, n // EXTRA)].tobytes()
                        held += len(prefix) // 8
                at.append(i)
                rows.append((digest, n, key, ref, prefix))
                if held > ENTRIES:
                    yield at, list(zip(*rows, strict=True))
                    at, rows, held = [], [], 0
            if rows:
                yield at, list(zip(*rows, strict=True))

        return make

    fields = [("text_key", "binary", pa.binary()), ("n_shingles", "long", pa.int64()), ("set_key", "binary", pa.binary()), ("ref", "long", pa.int64()), ("prefix", "binary", pa.binary())]
    return scan(docs, ["doc_id"], ["text"], start, fields)


def _numbers(blobs: pd.Series, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _cuts(hashes: np.ndarray, blocks: int) -> Iterator[tuple[int, slice]]:
    """The column blocks of sorted hashes, and where each lies."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
    for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
        yield int(block[a]), slice(a, b)


def _gathered(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The rows again, in frames of about ENTRIES numbers."""
    waiting, held = [], 0
    for batch in batches:
        sizes = batch[column].map(len).to_numpy() // 8
        part = (held + np.cumsum(sizes)) // ENTRIES
        for p in np.unique(part):
            waiting.append(batch[part == p])
            if p > 0 and p > part.min():
                yield pd.concat(waiting[:-1])
                waiting = waiting[-1:]
        held = sum(int(w[column].map(len).sum()) // 8 for w in waiting)
        if held >= ENTRIES:
            yield pd.concat(waiting)
            waiting, held = [], 0
    if waiting:
        yield pd.concat(waiting)


def block_count(partitions: int, entries: int) -> int:
    """How many blocks so many entries are dealt to: the session's number of tasks, or more for many."""
    return max(partitions, -(-entries // ENTRIES))


def _blocks(table: DataFrame, entries: int) -> int:
    return block_count(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries)


def _by_task(rows: DataFrame, blocks: int) -> DataFrame:
    """rows with the task that each block goes to; a task takes its blocks one by one."""
    tasks = min(blocks, MOST_TASKS)
    return rows.withColumn("task", F.pmod("block", F.lit(tasks))).repartitionById(tasks, F.col("task"))


def _shared_counts(sets: DataFrame) -> DataFrame:
    """ref -> how many entries of its prefix have a column with several rows."""
    entries = int(sets.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0)
    blocks = _blocks(sets, entries)

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Entries by column block; block < 0: counts of what this task has seen to be shared."""
        for frame in _gathered(batches, "prefix"):
            hashes = _numbers(frame["prefix"])
            refs = np.repeat(frame["ref"].to_numpy(np.int64), frame["prefix"].map(len).to_numpy() // 8)
            order = np.lexsort((refs, hashes))
            hashes, refs = hashes[order], refs[order]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (refs[1:] != refs[:-1])] if len(hashes) else np.empty(0, bool)
            hashes, refs = hashes[new], refs[new]
            columns, at, n = np.unique(hashes, return_index=True, return_counts=True)
            several = np.repeat(n > 1, n)
            own, counts = np.unique(refs[several], return_counts=True)
            first, many = refs[at], (n > 1).astype(np.uint8)
            rows = [(block, columns[s].tobytes(), first[s].tobytes(), many[s].tobytes()) for block, s in _cuts(columns, blocks)]
            for at in range(0, len(own), 50_000):
                part = slice(at, at + 50_000)
                rows.append((-1 - int(own[at] % blocks), counts[part].astype("<u8").tobytes(), own[part].tobytes(), b""))
            yield pd.DataFrame(rows, columns=["block", "numbers", "refs", "many"])

    def column_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        numbers, refs = _numbers(frame["numbers"]), _numbers(frame["refs"], "<i8")
        if key[1] < 0:
            return pd.DataFrame({"ref": refs, "n": numbers.astype(np.int64)})
        many = _numbers(frame["many"], "u1") > 0
        columns, of = np.unique(numbers, return_inverse=True)
        low, high = np.full(len(columns), np.iinfo(np.int64).max), np.full(len(columns), np.iinfo(np.int64).min)
        np.minimum.at(low, of, refs)
        np.maximum.at(high, of, refs)
        shared = low != high
        shared[of[many]] = True
        # Entries of one row from several tasks are one entry; those a task saw shared are counted there.
        counted = refs[shared[of] & ~many], of[shared[of] & ~many]
        pairs = np.unique(np.stack([counted[0], counted[1]]), axis=1) if len(counted[0]) else np.empty((2, 0), np.int64)
        found, n = np.unique(pairs[0], return_counts=True)
        return pd.DataFrame({"ref": found, "n": n})

    made = sets.where("prefix IS NOT NULL").select("ref", "prefix").mapInPandas(tiles, "block int, numbers binary, refs binary, many binary")
    counts = _by_task(made, blocks).groupBy("task", "block").applyInPandas(column_block, "ref long, n long")
    return counts.groupBy("ref").agg(F.sum("n").alias("shared"))


def _whole_rows(docs: DataFrame, nodes: DataFrame, k: int, store: Store) -> DataFrame:
    """The whole sets of nodes' rows: row_block, set_key, n, size, shingles.

    A node is looked up by the id and the digest of one of its texts, so rows without
    an id, or with a common one, meet their own node only.
    """
    chosen = nodes.select(F.col("rep.doc_id").alias("node_doc"), F.col("rep.text_key").alias("node_text"), "set_key", "n", "size")
    same = F.col("doc_id").eqNullSafe(F.col("node_doc")) & (F.col("text_key") == F.col("node_text"))
    read = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).join(broadcast_if_small(chosen, BROADCAST), same).select("text", "set_key", "n", "size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, seen = np.random.default_rng(), 0, set()
        name = int(block.integers(1 << 62))
        for batch in batches:
            rows = []
            for text, key, n, size in zip(batch["text"], batch["set_key"], batch["n"], batch["size"], strict=True):
                if bytes(key) not in seen:  # repeated rows of one id and text give a set again
                    seen.add(bytes(key))
                    rows.append((name, bytes(key), n, size, shingles(text, k).tobytes()))
                    held += n
                    if held > ENTRIES:
                        name, held = int(block.integers(1 << 62)), 0
            yield pd.DataFrame(rows, columns=["row_block", "set_key", "n", "size", "shingles"])

    rows = store(read.mapInPandas(run, "row_block long, set_key binary, n long, size long, shingles binary"), "rows")
    return rows if rows.count() == nodes.count() else store(rows.dropDuplicates(["set_key"]), "rows")


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Rows that can have links, with their prefix columns that others have too."""
    entries = int(rows.agg(F.sum("n")).first()[0] or 0)
    blocks = _blocks(rows, entries)

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for name, frame in batch.groupby("row_block"):
                for part in _gathered(iter([frame]), "shingles"):
                    columns, n = np.unique(_numbers(part["shingles"]), return_counts=True)
                    made += [(b, int(name), columns[s].tobytes(), n[s].astype("<u4").tobytes()) for b, s in _cuts(columns, blocks)]
            yield pd.DataFrame(made, columns=["block", "row_block", "columns", "counts"])

    def column_block(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        columns, counts = _numbers(frame["columns"]), _numbers(frame["counts"], "<u4")
        _, of = np.unique(columns, return_inverse=True)
        total = np.bincount(of, weights=counts)[of].astype("<u4")
        rows, at = [], 0
        for name, blob in zip(frame["row_block"], frame["columns"], strict=True):
            part = slice(at, at + len(blob) // 8)
            at = part.stop
            kept = total[part] > 1
            rows.append((name, columns[part][kept].tobytes(), total[part][kept].tobytes()))
        return pd.DataFrame(rows, columns=["row_block", "columns", "counts"])

    def row_block(_key: tuple, frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns, counts = _numbers(found["columns"]), _numbers(found["counts"], "<u4")
        columns, first = np.unique(columns, return_index=True)
        counts = counts[first]
        rows = []
        for key, n, size, blob in zip(frame["set_key"], frame["n"], frame["size"], frame["shingles"], strict=True):
            own = np.frombuffer(blob, "<u8")
            at = np.minimum(np.searchsorted(columns, own), max(len(columns) - 1, 0))
            shared = columns[at] == own if len(columns) else np.zeros(len(own), bool)
            least = overlap_bound(int(n), percent)
            if shared.sum() >= least:
                order = np.lexsort((own[shared], counts[at[shared]]))
                # The columns of this row alone come first in the order, and meet nobody.
                prefix = own[shared][order][: max(0, int(n) - least + 1 - int((~shared).sum()))]
                if len(prefix):
                    rows.append((key, n, size, int(own[shared][0].view(np.int64)), prefix.view(np.int64), blob))
        return pd.DataFrame(rows, columns=["set_key", "n", "size", "lead", "prefix", "shingles"])

    made = rows.select("row_block", "shingles").mapInPandas(tiles, "block int, row_block long, columns binary, counts binary")
    counted = _by_task(made, blocks).groupBy("task", "block").applyInPandas(column_block, "row_block long, columns binary, counts binary")
    schema = "set_key binary, n long, size long, lead long, prefix array<long>, shingles binary"
    dealt, counted = (x.repartition(min(blocks, MOST_TASKS), "row_block").groupBy("row_block") for x in (rows, counted))
    return dealt.cogroup(counted).applyInPandas(row_block, schema)


def _cells(rows: DataFrame, percent: int, store: Store) -> DataFrame:
    """The rows of each cell: low, high (its blocks), block, set_key, n, size, shingles."""
    parts = F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / ENTRIES))
    large = store(rows.groupBy(F.col("lead").alias("large_lead")).agg(parts.alias("parts")).where("parts > 1"), "large")
    block = F.xxhash64("lead", F.pmod(F.xxhash64("set_key"), F.coalesce("parts", F.lit(1))))
    placed = rows.join(broadcast_if_small(large), F.col("lead") == F.col("large_lead"), "left")
    placed = store(placed.select("set_key", "n", "size", "shingles", "prefix", block.alias("block")), "placed")
    entries = placed.select("n", "block", F.explode("prefix").alias("gram"))
    meets = entries.groupBy("gram", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("rows"))
    low = store(meets, "meets")
    high = low.select("gram", *(F.col(c).alias(f"high_{c}") for c in ("block", "least", "most")))
    fits = (F.col("high_most") * 100 >= F.col("least") * percent) & (F.col("high_least") * percent <= F.col("most") * 100)
    met = low.join(high, "gram").where(fits & ((F.col("block") < F.col("high_block")) | ((F.col("block") == F.col("high_block")) & (F.col("rows") > 1))))
    cells = store(met.select(F.col("block").alias("low"), F.col("high_block").alias("high")).distinct(), "cells")
    members = cells.withColumn("member", F.explode(F.array_distinct(F.array("low", "high"))))
    # As many tasks as what the cells hold takes column blocks, up to the limit.
    sizes = placed.groupBy(F.col("block").alias("sized")).agg(F.sum("n").alias("entries"))
    entries = members.join(sizes, F.col("member") == F.col("sized")).agg(F.sum("entries")).first()[0] or 0
    whole = placed.select("set_key", "n", "size", "shingles", "block")
    met = members.join(whole, F.col("member") == F.col("block")).drop("member")
    return met.repartition(min(_blocks(placed, int(entries)), MOST_TASKS), "low", "high")


def _columns(side: pd.DataFrame, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block over some (sorted) columns: its rows, column by column, their columns, and how many each has."""
    hashes = _numbers(side["shingles"])
    rows = np.repeat(np.arange(len(side)), side["n"])
    at = np.minimum(np.searchsorted(columns, hashes), max(len(columns) - 1, 0))
    known = columns[at] == hashes if len(columns) else np.zeros(len(hashes), bool)
    order = np.argsort(at[known], kind="stable")
    at = at[known][order]
    return rows[known][order], at, np.bincount(at, minlength=len(columns))


def _overlaps(low: pd.DataFrame, high: pd.DataFrame) -> np.ndarray:
    """The product of two blocks: common columns of each pair of rows.

    Columns of few pairs add them one by one, the others in dense stripes of COLUMNS.
    """
    columns = np.unique(_numbers(low["shingles"]))
    if low is not high:
        columns = np.intersect1d(columns, np.unique(_numbers(high["shingles"])), assume_unique=True)
    left = _columns(low, columns)
    right = left if low is high else _columns(high, columns)
    overlap = np.zeros((len(low), len(high)), np.float32)
    pairs = left[2] * right[2]
    sparse = pairs * SPARSE <= overlap.size
    firsts = np.cumsum(right[2]) - right[2]
    chosen = np.flatnonzero(sparse[left[1]])
    each = right[2][left[1][chosen]]
    for part in np.split(chosen, np.flatnonzero(np.diff(np.cumsum(each) // ENTRIES)) + 1):
        of = left[1][part]
        each = right[2][of]
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(overlap.reshape(-1), np.repeat(left[0][part], each) * len(high) + right[0][np.repeat(firsts[of], each) + within], np.float32(1))
    number = np.cumsum(~sparse) - 1
    for at in range(0, int((~sparse).sum()), COLUMNS):
        stripes = []
        for rows, of, _ in (left, right) if low is not high else (left,):
            held = ~sparse[of] & (number[of] >= at) & (number[of] < at + COLUMNS)
            stripe = np.zeros((int(rows.max()) + 1 if len(rows) else 0, COLUMNS), np.float32)
            stripe[rows[held], number[of[held]] - at] = 1
            stripes.append(stripe)
        overlap[: len(stripes[0]), : len(stripes[-1])] += stripes[0] @ stripes[-1].T
    return overlap


def _linked(low: pd.DataFrame, high: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of one block link to which of another; the rest is discarded, strip by strip."""
    overlap = _overlaps(low, high)
    linked = np.zeros(overlap.shape, bool)
    sizes = high["n"].to_numpy(np.float64)
    for i in range(0, len(low), STRIP):
        part = overlap[i : i + STRIP].astype(np.float64)
        linked[i : i + STRIP] = 100 * part >= percent * (low["n"].to_numpy(np.float64)[i : i + STRIP, None] + sizes - part)
    if low is high:
        np.fill_diagonal(linked, False)
    return linked


def _product(percent: int):
    """Multiply the two blocks of a cell; give each row's links and its tree in a spanning forest."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        low = frame if same else frame[frame["block"] == key[0]]
        high = low if same else frame[frame["block"] == key[1]]
        linked = _linked(low, high, percent)
        # From each row in turn, a wave over the rows not yet reached, now on one side, now on the other.
        shift = 0 if same else len(low)
        root = np.full(len(low) + (0 if same else len(high)), -1)
        for i in np.flatnonzero(linked.any(1)).tolist():
            if root[i] < 0:
                wave, left = np.array([i]), True
                root[i] = i
                while len(wave):
                    met = linked[wave].any(0) if left else linked[:, wave - shift].any(1)
                    wave = np.flatnonzero(met) + (shift if left else 0)
                    wave = wave[root[wave] < 0]
                    root[wave] = i
                    left = not left and not same or same
        keys = np.concatenate([low["set_key"].to_numpy(), *([] if same else [high["set_key"].to_numpy()])])
        links = linked @ high["size"].to_numpy(float)
        if not same:
            links = np.concatenate([links, linked.T @ low["size"].to_numpy(float)])
        at = np.flatnonzero(root >= 0)
        return pd.DataFrame({"set_key": keys[at], "links": links[at].astype(np.int64), "root": keys[root[at]]})

    return run


def components(edges: DataFrame, store: Store) -> DataFrame:
    """node -> component (its least node), of edges (node, root), by alternating stars.

    Each round is a minimum by key and a join; its result is written, so that
    neither lineage nor any node's neighbours gather anywhere.
    """
    now = edges.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct()
    now = store(now, "edges")
    mark: Column = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(store(least, "least"), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(store(least, "least"), F.col("u") == F.col("w"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        now = store(small, "edges")
        after = now.agg(F.count("*").alias("n"), mark.alias("mark")).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
        before = after


def _groups(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: a row for each document, and one for each set that is not alone.

    The first has doc_id, text_key, n_shingles and set_key; the second linked_key (a
    set_key), size, n_links, and least, the least document of the set's component: its
    id (null last) and the digest of its text.
    """
    spark = docs.sparkSession
    with scratch(spark) as store, small_batches(spark):
        sets = store(_sets(docs, k, percent), "sets")
        own = stored(sets.drop("ref", "prefix"), "ngram-sets")
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("rep")
        classes = store(sets.where("n_shingles > 0").groupBy("set_key").agg(rep, F.count("*").alias("size"), F.first("n_shingles").alias("n"), F.first("ref").alias("ref")), "classes")
        bound = F.floor((F.col("n") * percent + 99) / 100)
        nodes = classes.join(_shared_counts(sets).withColumnRenamed("ref", "shared_ref"), F.col("ref") == F.col("shared_ref"))
        nodes = store(nodes.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(bound / EXTRA))).select("set_key", "rep", "size", "n"), "nodes")
        rows = store(_candidates(_whole_rows(docs, nodes, k, store), percent), "candidates")
        found = _cells(rows, percent, store).groupBy("low", "high").applyInPandas(_product(percent), "set_key binary, links long, root binary")
        found = store(found, "links")
        named = components(found.select(F.col("set_key").alias("node"), "root"), store)
        links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
        linked = classes.join(links, "set_key", "left").join(named, F.col("set_key") == F.col("node"), "left")
        linked = store(linked.where("size > 1 OR node IS NOT NULL").select("set_key", "rep", "size", "links", "component"), "linked")
        least = linked.where("component IS NOT NULL").groupBy(F.col("component").alias("name")).agg(F.min("rep").alias("least"))
        linked = linked.join(least, F.col("component") == F.col("name"), "left")
        linked = linked.select(F.col("set_key").alias("linked_key"), "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.coalesce("least", "rep").alias("least"))
        return own, stored(linked, "ngram-groups")


def _by_set(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """Each row of sets with its set's columns, or nulls; no key of many rows is shuffled."""
    hot = linked.where(F.col("size") > F.lit(sets.count() / HOT))
    on = F.col("set_key") == F.col("linked_key")
    alone = sets.join(F.broadcast(hot.select("linked_key")), on, "left_anti")
    rest = linked.join(F.broadcast(hot.select(F.col("linked_key").alias("hot_key"))), F.col("linked_key") == F.col("hot_key"), "left_anti")
    return sets.join(F.broadcast(hot), on).unionByName(alone.join(rest, on, "left"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document (doc_id, text).

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of k-word shingles; n_links counts the documents that one links to.
    """
    whole = _by_set(*_groups(docs, k, percent))
    return whole.select("doc_id", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, in docs' own columns.

    It is the one of the least id (nulls last) and, of several texts of that id, of
    the least digest. Rows are told apart by id and text, so texts that no link
    connects stay, even if they share an id or have none. Where several rows have
    the id and the text that stay, one stays: the least by a hash of all columns.
    Documents without words link with nothing and stay, all of them.
    """
    whole = _by_set(*_groups(docs, k, percent)).where("least IS NOT NULL")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    # Each id and text that goes, and those that stay but in several rows.
    known = whole.groupBy(F.col("doc_id").alias("known_doc"), F.col("text_key").alias("known_text")).agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    known = stored(known.where("NOT stays OR rows > 1"), "ngram-known")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.col("text")).alias("text_key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("known_doc")) & (F.col("text_key") == F.col("known_text"))
    small = broadcast_if_small(known, BROADCAST)
    plain = keyed.join(small.select("known_doc", "known_text"), same, "left_anti").select("row.*")
    again = known.where("stays")
    if again.isEmpty():
        return plain
    several = keyed.join(broadcast_if_small(again, BROADCAST), same)
    one = several.groupBy("known_doc", "known_text").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return plain.unionByName(one.select("row.*"))


#: The same groups in DuckDB, by all common shingles.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS component_id,
       (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links
FROM s
"""
