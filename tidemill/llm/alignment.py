"""Operator 11: which tokens of one tokenizer cover those of another.

Python gives ids and byte ends by both tokenizers; all that follows is Spark's functions
on arrays. The ends that both share (``array_intersect``) cut a text into groups; a
token meets one more token of the other side for each of that side's ends within it.
Where all ends are shared, groups and links are the two sides' ids, zipped. Else each
other end (``array_except``) is looked up among the ends of both sides by halving, and
slices between them are joined, for the groups' text, or laid end to end with the cut
token repeated, for the links. No step is quadratic, however long the groups.

Chunks of plain text recur. A chunk runs up to the next single space or line break, or
to a mark after a word; neither tokenizer ever joins bytes across those, so both have an
end there, and a text's groups and links are its chunks' in order. So a row holds a block of texts (an Arrow
batch): its distinct chunks with their tokens, which are aligned once, and for each
text the chunks that make it up. Tasks remember chunks' tokens across blocks (REMEMBERED
at most, then anew). A text with other white space or letters beyond Latin goes through
both tokenizers whole, as one chunk.

Links are counted by id pair over all texts; each text then sums over its own. Counts
come back to the links by a join: the most frequent pairs, at most HOT, are broadcast,
as they may hold most links; the rest are too rare to be a hot key and are shuffled,
summed by text first.

Edge cases: a null or empty text, or one that a tokenizer doesn't give back byte by
byte, has no tokens: zeros, and '' for the digest; marks of special tokens in a text
are plain text; repeated rows and ids get a row each and count as often; texts may be
long, but a text's ids, ends and links must fit into a row (2 GB), as must the string
that is digested; an empty table gives no row. Only id and text are read.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from tidemill.llm.common import scratch, small_batches, stored

HOT = 200_000  # pairs that are broadcast
REMEMBERED = 3 << 19  # tokens of chunks
BLOCK = 4 << 20  # bytes of the texts of a block, if there are more than one
TEXTS = 64  # texts that are cut into chunks at once
SHORT = 16  # ends that are looked through one by one
_UNLIKE = re.compile(r"[^\n\x20-\x7E¡-ɏ]|[ \n][ \n]")
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_MARKS = ".,;:!?"


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a_path, self.whole_a = a_path, None
        with open(a_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain_a = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = {i: token for token, i in ranks.items()}
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as file:
            model.ParseFromString(file.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space comes with the text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        # A word may end a chunk before these: the first tokenizer parts letters from marks, the second has no piece of both.
        apart = "".join(m for m in _MARKS if not any(re.search(_LETTER + re.escape(m), p) for p in pieces))
        self.cut = re.compile((rf" ?{_LETTER}++(?=[{re.escape(apart)}])|" if apart else "") + r" ?[^ \n]+|[ \n]").findall
        self.line = self.plain_a.encode_ordinary("\n")
        self.length = [self._lengths(t) for t in (self.bytes_a, self.bytes_b)]

    @staticmethod
    def _lengths(table: dict[int, bytes]) -> np.ndarray:
        lengths = np.zeros(max(table) + 2, np.int64)
        for i, token in table.items():
            lengths[i] = len(token)
        return lengths

    def exact(self, text: str, a: Iterable[int], b: Iterable[int]) -> bool:
        raw = text.encode()
        return b"".join([self.bytes_a.get(i, b"") for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])

    def chunks(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The tokens of chunks that hold no white space but a space in front; None where they don't give it back."""
        lines: list[list[int]] = [[]]
        for i in self.plain_a.encode_ordinary("\n".join(texts)):  # a line break parts tokens, as a chunk's end does
            if i == self.line[0]:
                lines.append([])
            else:
                lines[-1].append(i)
        made = list(zip(lines, self.b.encode(texts), strict=True))
        if self.exact("".join(texts), chain.from_iterable(lines), chain.from_iterable(b for _, b in made)):
            return made
        return [m if self.exact(t, *m) else None for t, m in zip(texts, made, strict=True)]

    def text(self, text: str) -> tuple[list[int], list[int]]:
        if self.whole_a is None:  # most tasks never need it, and it takes much memory
            self.whole_a = Tokenizer.from_file(self.a_path)
            self.whole_a.encode_special_tokens = True
        a, b = self.whole_a.encode(text, add_special_tokens=False).ids, self.b.encode(text)
        return (a, b) if self.exact(text, a, b) else ([], [])


class Remembered:
    """The tokens of chunks, each an entry with a number."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = array("i"), array("i")
        self.starts = array("q", [0]), array("q", [0])
        for space in " \n":
            self.code[space] = self.add([(self.tokens.plain_a.encode_ordinary(space), self.tokens.b.encode(space))])

    def add(self, made: list[tuple[list[int], list[int]]]) -> int:
        """New entries, in order; the number of the first."""
        first = len(self.starts[0]) - 1
        for side, (ids, starts) in enumerate(zip(self.ids, self.starts, strict=True)):
            start = len(ids)
            ids.extend(chain.from_iterable(m[side] for m in made))
            starts.extend(accumulate((len(m[side]) for m in made[1:]), initial=start + len(made[0][side])))
        return first

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        """The entries that make up each text with a space in front."""
        chunks = [self.tokens.cut(" " + text) if text and not _UNLIKE.search(" " + text) else [] for text in texts]
        if new := [c for c in dict.fromkeys(chain.from_iterable(chunks)) if c not in self.code]:
            made = self.tokens.chunks(new)
            first = self.add([m or ([], []) for m in made])
            self.code.update((c, first + i if m else -1) for i, (c, m) in enumerate(zip(new, made, strict=True)))
        out = [np.fromiter(map(self.code.__getitem__, each), np.int64, len(each)) for each in chunks]
        for i, (text, own) in enumerate(zip(texts, out, strict=True)):
            if text and not chunks[i]:
                made = self.tokens.text(" " + text)
                out[i] = np.array([self.add([made])] if made[0] else [], np.int64)
            elif len(own) and own.min() < 0:
                out[i] = own[:0]
        return out

    def lengths(self, codes: np.ndarray) -> list[np.ndarray]:
        """How many tokens of either tokenizer an entry has."""
        return [np.diff(np.array(starts))[codes] for starts in self.starts]

    def columns(self, codes: np.ndarray) -> list[pa.Array]:
        """ids and ends by the first tokenizer, ids and ends by the second, an array an entry."""
        out = []
        for ids, starts, lengths in zip(self.ids, self.starts, self.tokens.length, strict=True):
            bounds = np.array(starts)
            counts = bounds[codes + 1] - bounds[codes]
            offsets = np.concatenate([[0], np.cumsum(counts)])
            values = np.array(ids)[np.repeat(bounds[codes] - offsets[:-1], counts) + np.arange(offsets[-1])]
            ends = np.concatenate([[0], np.cumsum(lengths[values])])
            for column in (values, ends[1:] - np.repeat(ends[offsets[:-1]], counts)):
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(column, pa.int32()), type=INTS))
        return out


@cache
def _remembered(paths: tuple[str, str, str]) -> Remembered:
    """What this worker knows, over all its tasks."""
    return Remembered(Tokens(*paths))


INTS = pa.list_(pa.field("element", pa.int32(), False))
CHUNK = ("ids_a", "ends_a", "ids_b", "ends_b")


def _array(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of, False)


def tokenised(docs: DataFrame, doc_id: str, paths: tuple[str, str, str]) -> DataFrame:
    """chunks (ids_a, ends_a, ids_b, ends_b) and texts (doc_id, row, n_a, n_b, order) of blocks of texts; order numbers the chunks from 0."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text"))

    def whole(fields: dict[str, pa.Array]) -> pa.Array:
        """One list of all the rows of some columns."""
        kinds = [pa.field(name, c.type, name == "doc_id") for name, c in fields.items()]
        made = pa.StructArray.from_arrays(list(fields.values()), fields=kinds)
        return pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made, type=pa.list_(pa.field("element", made.type, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _remembered(paths)
        for batch in batches:
            texts, codes = batch["text"].to_pylist(), []
            for at in range(0, len(texts), TEXTS):
                codes += known.codes(texts[at : at + TEXTS])
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes], dtype=np.int64)])
            flat = np.concatenate([*codes, np.empty(0, np.int64)])
            sums = [np.concatenate([[0], np.cumsum(n)]) for n in known.lengths(flat)]
            distinct, order = np.unique(flat, return_inverse=True)
            fields = {"doc_id": batch["doc_id"], "row": batch["row"]} | {f"n_{side}": pa.array(np.diff(n[bounds])) for side, n in zip("ab", sums, strict=True)}
            fields["order"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(order, pa.int32()), type=INTS)
            yield pa.RecordBatch.from_arrays([whole(dict(zip(CHUNK, known.columns(distinct), strict=True))), whole(fields)], names=["chunks", "texts"])
            if len(known.ids[0]) > REMEMBERED:
                known.forget()

    ints = _array(T.IntegerType())
    chunk = T.StructType([T.StructField(name, ints, False) for name in CHUNK])
    text = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(name, T.LongType(), False) for name in ("row", "n_a", "n_b")), T.StructField("order", ints, False)])
    return rows.mapInArrow(run, T.StructType([T.StructField("chunks", _array(chunk), False), T.StructField("texts", _array(text), False)]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, however often body's own functions use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), bit)


def below(values: Column, x: Column, bits: Column) -> Column:
    """How many of the sorted values are less than x, by halving; bits go from that of their number down."""
    return F.aggregate(bits, F.lit(0), lambda n, bit: F.when(F.get(values, n + power(bit) - 1) < x, n + power(bit)).otherwise(n))


def places(values: Column, among: Column) -> Column:
    """For each value, how many of the sorted ends are less."""
    bits = F.sequence(F.floor(F.log2(F.size(among) + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))
    short = F.transform(values, lambda e: F.size(F.filter(among, lambda x: x < e)))
    return F.when(F.size(among) <= SHORT, short).otherwise(let(bits, lambda b: F.transform(values, lambda e: below(among, e, b))))


def _slices(values: Column, bounds: Column, overlap: int, each: Callable[[Column], Column]) -> Column:
    """each of the stretches of values between bounds; with an overlap, a stretch begins with the last of the one before."""

    def of(v: Column) -> Column:
        first = lambda k: F.when(k == 0, 0).otherwise(F.get(v["b"], k - 1) + (1 - overlap))
        end = lambda k: F.coalesce(F.get(v["b"], k) + 1, F.size(v["v"]))
        return F.transform(F.sequence(F.lit(0), F.size(v["b"])), lambda k: each(F.slice(v["v"], first(k) + 1, end(k) - first(k))))

    return let(F.struct(values.alias("v"), bounds.alias("b")), of)


def grouped_ids(ids: Column, inner: Column) -> Column:
    """The ids of each group, parted by commas; inner: the numbers of the tokens that don't end a group."""
    return F.split(F.array_join(_slices(ids.cast("array<string>"), inner, 0, lambda part: F.array_join(part, ";")), ","), ";")


def link_ids(ids: Column, cut: Column) -> Column:
    """An id for each link: a token comes once more for each of the other side's ends that cut it; cut: those tokens' numbers."""
    return F.flatten(_slices(ids, cut, 1, lambda part: part))


def pair(a: Column, b: Column) -> Column:
    """Two ids as one number, the second in the low 32 bits."""
    return F.shiftleft(a.cast("long"), 32) + b


def aligned_chunk(chunk: Column) -> Column:
    """text ('a1,a2|b1;a3|b2,b3') and links (pairs of ids) of a chunk's tokens."""

    def of(v: Column) -> Column:
        ids_a, ends_a, ids_b, ends_b = (v["chunk"][name] for name in CHUNK)
        text = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))), ";")
        both = lambda groups, a, b: F.struct(groups.alias("text"), F.zip_with(a, b, pair).alias("links"))

        def parted(only: Column) -> Column:
            groups = text(grouped_ids(ids_a, places(only["a"], ends_a)), grouped_ids(ids_b, places(only["b"], ends_b)))
            return both(groups, link_ids(ids_a, places(only["b"], ends_a)), link_ids(ids_b, places(only["a"], ends_b)))

        alike = (F.size(v["cuts"]) == F.size(ids_a)) & (F.size(v["cuts"]) == F.size(ids_b))
        others = F.struct(F.array_except(ends_a, v["cuts"]).alias("a"), F.array_except(ends_b, v["cuts"]).alias("b"))
        return F.when(alike, both(text(ids_a, ids_b), ids_a, ids_b)).otherwise(let(others, parted))

    return let(F.struct(chunk.alias("chunk"), F.array_intersect(chunk["ends_a"], chunk["ends_b"]).alias("cuts")), of)


def aligned(blocks: DataFrame) -> DataFrame:
    """doc_id, row, n_a, n_b, groups_sha256, links of each text."""

    def of(v: Column) -> Column:
        def text(d: Column) -> Column:
            each = lambda name: F.transform(d["order"], lambda i: F.get(v["chunks"], i)[name])
            digest = F.when(F.size(d["order"]) > 0, F.sha2(F.array_join(each("text"), ";"), 256)).otherwise(F.lit(""))
            return F.struct(*(d[name].alias(name) for name in ("doc_id", "row", "n_a", "n_b")), digest.alias("groups_sha256"), F.flatten(each("links")).alias("links"))

        return F.transform(v["texts"], text)

    made = let(F.struct(F.transform("chunks", aligned_chunk).alias("chunks"), F.col("texts").alias("texts")), of)
    return blocks.select(F.explode(made).alias("t")).select("t.*")


def pair_counts(links: DataFrame) -> DataFrame:
    """link, count, second: links by id pair over all texts."""
    second = F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).alias("second")
    return links.groupBy("link").agg(F.count("*").alias("count")).select("link", "count", second)


def hot_count(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most so many pairs have links enough for. The driver gets 64 sums at most."""
    sums = {r["bits"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("bits")).agg(F.count("*").alias("n")).collect()}
    held = 0
    for bits in range(63, -1, -1):
        held += sums.get(bits, 0)
        if held > most:
            return 1 << (bits + 1)
    return 1


def align(docs: DataFrame, *, doc_id: str = "doc_id", a: str | None = None, a_ranks: str | None = None, b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    a is a byte-level tokenizer's file, a_ranks the same vocabulary as ranks, b a
    sentencepiece model.
    """
    paths = a or public_tokenizers.path("byte_bpe_50k.json"), a_ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), b or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    with scratch(spark) as keep:
        with small_batches(spark, BLOCK):
            texts = keep(aligned(tokenised(docs, doc_id, paths)), "texts")
        links = texts.select("row", F.explode("links").alias("link"))
        counted = keep(pair_counts(links), "pairs")
        highest = counted.groupBy("second").agg(F.max("count").alias("highest"))
        pairs = keep(counted.join(highest, "second").select("link", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")), "counts")
        least = hot_count(pairs, hot)
        often, rare = pairs.where(F.col("count") >= least), pairs.where(F.col("count") < least)
        sums = [F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")]
        found = links.join(F.broadcast(often), "link").groupBy("row").agg(*sums)
        if least > 1:
            seldom = links.join(F.broadcast(often.select("link")), "link", "left_anti").groupBy("row", "link").agg(F.count("*").alias("times"))
            weighed = seldom.join(rare, "link").select("row", (F.col("best") * F.col("times")).alias("n_best"), (F.col("count") * F.col("times")).alias("count_sum"))
            found = found.unionByName(weighed).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        n_links = F.size("links").cast("long")  # a link is a stretch between two ends, and a group ends where both do
        rows = texts.select("doc_id", "row", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - n_links).alias("n_groups"), n_links.alias("n_links"), "groups_sha256")
        joined = rows.join(found, "row", "left").fillna(0, ["n_best", "count_sum"])
        return stored(joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")
