"""Operator 5: toxicity by maximum-scoring segments of token log-odds.

Training counts, in one pass over the labelled documents, how many toxic and how
many clean ones hold each token. A token's log-odds is that of a rate with a
Dirichlet prior whose mean is the rate of the token's prefix, and so on down to
the base rate (prefixes of 6 to 3 characters): rare inflections borrow from
their stem, unseen words score near zero. Counts live in a table of fixed size.

Scoring subtracts a drift from every token, which makes the expected score
negative, and a linear-time scan finds every maximal-scoring segment of the text
(all disjoint segments that can't be made better by growing or shrinking). How
high segments of clean text come by chance follows an extreme-value law: in n
tokens, ``K * n * exp(-S * rate)`` of them are expected to reach S. K and rate are
fitted to clean training documents. Segments that beat this expectation are
significant; a logistic fit turns their summed and their best evidence into a
probability. Training documents are scored with their own counts taken out, so
that both fits see what unlabelled documents will give.

Segments are those of the full log-odds, wherever in a text they stand. Within a
segment, a token that recurs counts less each time (the n-th time by 1/n), so that
plain repetition is no evidence: a segment's score is that of its best run so
counted, from its start or from its end. Words are cut at white space and then to runs of word characters; a document's
language, source and id are not read.

Edge cases: a null or empty text has no segment and gets the score of no
evidence; without labels (or of one class only) all scores are the smoothed base
rate; tokens of over MAX_TOKEN characters are scored but not remembered;
repeated rows get a row each; an empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import labelled_sample, labelled_texts, scan, stored

BUCKETS = 1 << 18  # of the table of token counts
PREFIXES = (3, 4, 5, 6)
STRENGTH = 2.0  # of each prior, in documents
DRIFT = 0.5
EXCESS = 1.0  # segments of clean text above this score fit the extreme-value law
SAMPLE = 20_000  # labelled documents to learn from
MAX_TOKEN = 64
REMEMBERED = 200_000  # tokens whose score a task keeps at hand
_WORD = re.compile(r"\w+")
_LONGEST = [max((n for n in PREFIXES if n < size), default=0) for size in range(max(PREFIXES) + 2)]  # prefix of a word of a size

Segment = tuple[int, int, float]  # first token, end, score


def bucket(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form.encode()) % BUCKETS


def keys(word: str) -> list[int]:
    """The buckets of a word's prefixes, short to long, and of the word itself."""
    return [bucket(f"{n}{word[:n]}") for n in PREFIXES if len(word) > n] + [bucket(f"0{word}")]


class Scores(dict):
    """Raw token -> log-odds without drift, worked out on first sight.

    own is what to take out of every count: (toxic, clean). Words and prefixes are
    remembered too, as there are far fewer of them than tokens with all their marks.
    """

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, base: float, own: tuple[int, int] = (0, 0)) -> None:
        super().__init__()
        self.toxic, self.clean, self.base = np.maximum(toxic - own[0], 0).tolist(), np.maximum(clean - own[1], 0).tolist(), base
        self.odds = math.log(base / (1 - base))
        self.rates: dict[str, float] = {}
        self.words: dict[str, float] = {}

    def _rate(self, form: str, prior: float) -> float:
        key = bucket(form)
        toxic = self.toxic[key]
        return (toxic + STRENGTH * prior) / (toxic + self.clean[key] + STRENGTH)

    def prefix_rate(self, prefix: str) -> float:
        rate = self.rates.get(prefix)
        if rate is None:
            n = len(prefix)
            prior = self.base if n == PREFIXES[0] else self.prefix_rate(prefix[: PREFIXES[PREFIXES.index(n) - 1]])
            if len(self.rates) >= REMEMBERED:
                self.rates.clear()
            rate = self.rates[prefix] = self._rate(f"{n}{prefix}", prior)
        return rate

    def of_word(self, word: str) -> float:
        score = self.words.get(word)
        if score is None:
            n = _LONGEST[min(len(word), len(_LONGEST) - 1)]
            rate = self._rate("0" + word, self.prefix_rate(word[:n]) if n else self.base)
            score = math.log(rate / (1 - rate)) - self.odds
            if len(word) <= MAX_TOKEN:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = score
        return score

    def __missing__(self, token: str) -> float:
        words = _WORD.findall(token.lower())
        score = self.of_word(words[0]) if len(words) == 1 else max(map(self.of_word, words), default=0.0)
        if len(token) <= MAX_TOKEN:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal-scoring segments, in one pass with a stack of candidates."""
    total = [0.0, *np.cumsum(scores).tolist()]
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, the last one with a lower sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, after = i, total[i], total[i + 1]
        below = len(stack) - 1
        while True:
            while below >= 0 and stack[below][2] >= before:
                below = stack[below][4]
            if below < 0 or stack[below][3] >= after:
                stack.append((start, i + 1, before, after, below))
                break
            start, _, before, _, link = stack[below]
            del stack[below:]
            below = link
    return [(s, e, b - a) for s, e, a, b, _ in stack]


def best_run(tokens: Sequence[str], values: np.ndarray) -> float:
    """The highest score of a run of tokens, when the n-th of a kind counts 1/n."""
    values, times = values.copy(), Counter()
    for i in np.flatnonzero(values > DRIFT).tolist():
        times[tokens[i]] += 1
        values[i] /= times[tokens[i]]
    total = np.concatenate([[0.0], np.cumsum(values - DRIFT)])
    return float((total - np.minimum.accumulate(total)).max())


def segments(text: str | None, scores: Scores, least: Callable[[int], float] = lambda n: 0.0) -> tuple[int, list[Segment]]:
    """How many tokens a text has, and its segments.

    Repeats can only lower a segment's score, so they are looked at only in those
    that score over least (of the number of tokens) without them.
    """
    tokens = (text or "").split()
    values = np.fromiter(map(scores.__getitem__, tokens), np.float64, len(tokens))
    found, bar = [], least(len(tokens))
    for start, end, score in maximal_segments(values - DRIFT):
        if score > bar and end - start > 1 and len(set(own := tokens[start:end])) < end - start:
            score = max(best_run(own, values[start:end]), best_run(own[::-1], values[start:end][::-1]))
        found.append((start, end, score))
    return len(tokens), found


def evidence(n: int, found: Sequence[Segment], law: tuple[float, float]) -> tuple[float, float, int]:
    """Summed and best log evidence of the significant segments, and their number."""
    k, rate = law
    chance = math.log(max(k * n, 1e-9))
    each = [e for _, _, s in found if (e := rate * s - chance) > 0]
    return sum(each), max(each, default=0.0), len(each)


def _features(total: Sequence[float], best: Sequence[float]) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(best), np.asarray(best) > 0])


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = set(_WORD.findall((text or "").lower()))
            held = {key for w in words for key in keys(w)}
            counts[int(label > 0), np.fromiter(held, np.int64, len(held))] += 1
    at = counts.any(0).nonzero()[0]
    yield pd.DataFrame({"bucket": at, "clean": counts[0, at], "toxic": counts[1, at]})


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Learn from at most about ``sample`` labelled documents.

    An id with several texts counts once (see labelled_texts). The driver gets BUCKETS
    pairs of counts, and three numbers for each id of the sample.
    """
    spark = docs.sparkSession
    chosen = labelled_sample(labels, label, F.lit(True) if usable is None else usable, sample)
    train = stored(labelled_texts(docs, chosen), "toxicity-train")
    sums = train.mapInPandas(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    counts = np.zeros((2, BUCKETS), np.int32)
    counts[0, sums["bucket"]], counts[1, sums["bucket"]] = sums["clean"], sums["toxic"]
    n = {bool(r["toxic"]): r["n"] for r in train.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    base = (n.get(True, 0) + 1) / (sum(n.values()) + 2)
    model = {"toxic": counts[1], "clean": counts[0], "base": base, "law": (1e-2, 1.0), "weights": np.array([math.log(base / (1 - base)), 0.0, 0.0, 0.0])}
    if len(n) < 2:
        return model
    shared = spark.sparkContext.broadcast(model)

    def own_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        own = {x: Scores(m["toxic"], m["clean"], m["base"], (int(x), int(not x))) for x in (False, True)}
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["label"], strict=True):
                tokens, found = segments(text, own[y > 0])
                rows.append((int(y > 0), tokens, [s for *_, s in found]))
            yield pd.DataFrame(rows, columns=["label", "tokens", "segments"])

    seen = train.mapInPandas(own_scores, "label int, tokens long, segments array<double>")
    over = F.filter("segments", lambda s: s > EXCESS)
    clean = seen.where("label = 0").select("tokens", F.size(over).alias("n"), F.aggregate(over, F.lit(0.0), lambda a, s: a + s - EXCESS).alias("excess"))
    law = clean.agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.sum("excess").alias("excess")).first()
    rate = min(5.0, max(0.3, (law["n"] + 1) / ((law["excess"] or 0.0) + 1)))
    k = (law["n"] + 1) / ((law["tokens"] or 0) + 1) * math.exp(rate * EXCESS)
    model["law"] = (min(k, 1.0), rate)
    kept, speed = model["law"]
    each = F.filter(F.transform("segments", lambda s: s * speed - F.log(F.greatest(F.col("tokens") * kept, F.lit(1e-9)))), lambda e: e > 0)
    x = seen.withColumn("each", each).select("label", F.aggregate("each", F.lit(0.0), lambda a, e: a + e).alias("total"), F.coalesce(F.array_max("each"), F.lit(0.0)).alias("best")).toPandas()
    model["weights"] = logistic_fit(_features(x["total"], x["best"]), x["label"].to_numpy(float))
    return model


def toxic_segments(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, evidence, n_segments and the segments (first token, end, score).

    Only significant segments are listed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        scores = Scores(m["toxic"], m["clean"], m["base"])
        k, rate = m["law"]

        def bar(n: int) -> float:
            """The score that segments of clean text of n tokens are expected to reach."""
            return math.log(max(k * n, 1e-9)) / rate

        def make(texts: list[str | None]) -> Iterator[tuple[range, list]]:
            total, best, listed = [], [], []
            for text in texts:
                n, found = segments(text, scores, bar)
                least = bar(n)
                listed.append([{"first": s, "end": e, "score": v} for s, e, v in found if v > least])
                t, b, _ = evidence(n, found, m["law"])
                total.append(t)
                best.append(b)
            if texts:
                x = _features(total, best) @ m["weights"]
                yield range(len(texts)), [1 / (1 + np.exp(-np.clip(x, -30, 30))), total, [len(s) for s in listed], listed]

        return make

    segment = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    fields = [("score", "double", pa.float64()), ("evidence", "double", pa.float64()), ("n_segments", "long", pa.int64()), ("segments", "array<struct<first: long, end: long, score: double>>", segment)]
    return scan(docs, ["doc_id"], ["text"], start, fields)
