"""Operator 3: packing documents along a space-filling curve.

1. Each document is cut into token ids and hashed to a vector of token counts,
   which is projected to DIMENSIONS random directions; one pass, stored.
2. The projections' means and deviations over all documents turn each coordinate
   into a cell of a grid with equally filled sides; the cell's place on the
   Hilbert curve is the document's key. Near keys are near vectors.
3. The documents are range-sorted by that key and laid end to end; each range is
   cut into sequences of SEQUENCE ids. Token counts along the curve, not samples,
   place the ranges, so the same table, read alike, is packed alike each time. A
   group of copies, however large, spreads over ranges.

Only the end of a range leaves less than a whole sequence. It is cut into pieces
whose lengths are powers of two, which need no padding at all.

Documents travel in parts of PART ids at most, so no row grows with a text.

Edge cases: a null or empty text is its closing id only; repeated rows are packed
as often as they occur; rows of one id keep apart, as their parts sort by a row
number of their own; an empty table gives no piece. Only doc_id and text are read.
Ranges follow the tokens, so a task's work doesn't grow with the table.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm.common import MOST_TASKS, mix64, scan, small_batches, stored

SEQUENCE = 2048
CLOSING = 1  # the id after each document
DIMENSIONS = 4
GRID_BITS = 8  # of a coordinate
HASHED = 1024  # length of the hashed vectors
PART = 65_536
RANGE = 1 << 25  # tokens of a range on large tables, about
LEAST_RANGE = 1 << 20  # a range of fewer would cost more than it helps
BINS = 1 << 16  # stretches of the curve whose tokens are counted to place the ranges
_UNLIKE = re.compile(r"[^\n\x20-\x7E\u00A1-\u024F]|<\|")


class Ids:
    """The ids that the tokenizer file gives for texts.

    Where the same vocabulary is at hand as ranks, plain texts (Latin letters, no
    white space but spaces and line breaks, no mark of a special token) go by
    those, which gives the same ids in a quarter of the time; all others go by the
    tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.path, self.tokenizer, self.plain = path, None, None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.plain is not None and not _UNLIKE.search(text):
            return np.array(self.plain.encode_ordinary(text), np.uint32)
        if self.tokenizer is None:  # most tasks never need it, and it takes much memory
            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def directions(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMENSIONS))


_BUCKETS = (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(HASHED)).astype(np.int64)


def project(ids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The coordinates of a document's hashed vector of damped counts."""
    counts = np.log1p(np.bincount(_BUCKETS[ids & 0xFFFF], minlength=HASHED))
    return (counts / max(float(np.linalg.norm(counts)), 1e-12)) @ axes


def hilbert_key(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Places of grid cells (rows of coordinates) on the Hilbert curve.

    Each round takes the top bit of every coordinate, and reflects or exchanges
    the lower bits so that the next finer curve joins on; the bits taken, in Gray
    code across the coordinates, spell the place.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flips ^= np.where(x[-1] & q, q - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tail_lengths(n: int) -> list[int]:
    """Powers of two, large ones first, that sum to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _tokenised(docs: DataFrame, path: str, ranks: str | None) -> DataFrame:
    """A row for each part: doc_id, start, doc_tokens, ids, width, row_number, and the coordinates."""
    axes = directions()

    def start():
        tokens = Ids(path, ranks)

        def make(texts: list[str | None]) -> Iterator[tuple[list[int], list]]:
            of, rows, held = [], [], 0
            for i, text in enumerate(texts):
                own = tokens.encode(text or "")
                point = project(own, axes).tolist()
                ids = np.append(own, np.uint32(CLOSING)).astype("<u4")
                for at in range(0, len(ids), PART):
                    part = ids[at : at + PART]
                    width = 2 if part.max() < 65536 else 4
                    of.append(i)
                    rows.append((at, len(ids), part.astype(f"<u{width}").tobytes(), width, *point))
                    held += len(part)
                if held > 4 * PART:
                    yield of, list(zip(*rows, strict=True))
                    of, rows, held = [], [], 0
            if rows:
                yield of, list(zip(*rows, strict=True))

        return make

    fields = [("start", "long", pa.int64()), ("doc_tokens", "long", pa.int64()), ("ids", "binary", pa.binary()), ("width", "int", pa.int32())]
    parts = scan(docs, ["doc_id"], ["text"], start, fields + [(f"p{i}", "double", pa.float64()) for i in range(DIMENSIONS)])
    return parts.withColumn("row_number", F.monotonically_increasing_id() - F.floor(F.col("start") / PART))


def range_count(tokens: float, partitions: int) -> int:
    """How many ranges a number of tokens takes: large ones, but one for each task if there is enough for all.

    A range is a task, so beyond MOST_TASKS ranges they grow; they are sorted by Spark
    and read as a stream, so their size isn't a matter of memory.
    """
    return min(MOST_TASKS, max(1, math.ceil(tokens / RANGE), min(partitions, math.ceil(tokens / LEAST_RANGE))))


def _ranged(parts: DataFrame, count: int | None) -> tuple[DataFrame, int]:
    """parts with the Hilbert key and the number of its range in the place of the coordinates; the number of ranges.

    The tokens in each of BINS stretches of the curve set the ranges' ends, so that
    all ranges get their even share, and the same in each run. Where an end falls
    within a stretch, a hash of the row decides the side; a stretch of many
    documents, such as a group of copies, thereby spreads over several ranges.
    """
    names = [f"p{i}" for i in range(DIMENSIONS)]
    stats = parts.agg(*(F.avg(c).alias(c) for c in names), *(F.stddev(c).alias(f"d{c}") for c in names)).first()
    mean = np.array([round(stats[c] or 0.0, 9) for c in names])  # sums of floats differ in their last digits
    deviation = np.array([max(round(stats[f"d{c}"] or 0.0, 9), 1e-9) for c in names])
    side = 1 << GRID_BITS

    def keys(coordinates: tuple[pd.Series, ...]) -> np.ndarray:
        z = (np.column_stack([c.to_numpy(float) for c in coordinates]) - mean) / deviation
        share = 0.5 * (1 + np.tanh(0.851 * z))  # about as filled as those of a normal law
        return hilbert_key(np.minimum((share * side).astype(np.int64), side - 1))

    below = DIMENSIONS * GRID_BITS - BINS.bit_length() + 1  # bits of a key within its stretch

    @F.pandas_udf("int")
    def stretch(*coordinates: pd.Series) -> pd.Series:
        return pd.Series((keys(coordinates) >> below).astype(np.int32))

    length = F.least(F.col("doc_tokens") - F.col("start"), F.lit(PART))
    filled = np.zeros(BINS)
    for row in parts.groupBy(stretch(*names).alias("stretch")).agg(F.sum(length).alias("tokens")).collect():  # BINS rows at most
        filled[row["stretch"]] = row["tokens"]
    before = np.cumsum(filled) - filled
    count = count or range_count(filled.sum(), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("key long, range int")
    def place(hashes: pd.Series, *coordinates: pd.Series) -> pd.DataFrame:
        key = keys(coordinates)
        at = before[key >> below] + filled[key >> below] * ((hashes.to_numpy(np.int64) & 0xFFFFFFFF) / 2.0**32)
        return pd.DataFrame({"key": key, "range": np.minimum(at / max(filled.sum(), 1.0) * count, count - 1).astype(np.int32)})

    placed = parts.withColumn("place", place(F.xxhash64("doc_id", "row_number"), *names))
    return placed.drop(*names).withColumns({"key": F.col("place.key"), "range": F.col("place.range")}).drop("place"), count


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, partitions: int | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit numbers. A sequence_id holds the range
    in its upper bits and counts within it in the lower ones. ranks names a file of
    the tokenizer's own vocabulary as ranks, if there is one.
    """
    if tokenizer is None:
        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    with small_batches(docs.sparkSession):
        parts = stored(_tokenised(docs, tokenizer, ranks), "pack-tokens")
        ranged, count = _ranged(parts, partitions)
    ranged = ranged.repartitionById(count, F.col("range")).sortWithinPartitions("key", "doc_id", "row_number", "start")

    def start():
        sequence, held, waiting, base = 0, 0, [], 0

        def written(pieces: list[tuple], number: int) -> Iterator[tuple]:
            offset = 0
            for doc, at, total, ids in pieces:
                yield (doc, at, len(ids), total, number, offset, ids.tobytes())
                offset += len(ids)

        def add(doc: object, at: int, total: int, ids: np.ndarray, number: int) -> Iterator[tuple]:
            nonlocal sequence, held, waiting, base
            base = number << 40
            while len(ids):
                piece, ids = ids[: SEQUENCE - held], ids[SEQUENCE - held :]
                waiting.append((doc, at, total, piece))
                at, held = at + len(piece), held + len(piece)
                if held == SEQUENCE:
                    yield from written(waiting, base + sequence)
                    sequence, held, waiting = sequence + 1, 0, []

        def rest() -> Iterator[tuple]:
            nonlocal sequence
            for room in tail_lengths(held):
                taken = []
                while room:
                    doc, at, total, ids = waiting.pop(0)
                    taken.append((doc, at, total, ids[:room]))
                    if len(ids) > room:
                        waiting.insert(0, (doc, at + room, total, ids[room:]))
                    room -= len(taken[-1][3])
                yield from written(taken, base + sequence)
                sequence += 1

        return add, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, rest = start()
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "width", "range")]
            rows = [r for doc, at, total, ids, width, number in zip(*columns, strict=True) for r in add(doc, at, total, np.frombuffer(ids, f"<u{width}").astype("<u4"), number)]
            if rows:
                yield packed(rows, kind)
        if rows := list(rest()):
            yield packed(rows, kind)

    def packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranged.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in the place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
