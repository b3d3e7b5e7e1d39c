"""Operator 4: quality classifier as a sparse rule ensemble.

1. Statistics of the whole text (STATISTICS), one pass, no matter how long.
2. Boosted and bagged trees of small depth are grown on the labelled sample with
   Spark ML; every path from a root to a node below it becomes a conjunctive rule
   (``upper_share > 0.4 AND repeat_share <= 0.1``).
3. A lasso logistic regression over the rules, and over the statistics cut to
   their usual range, keeps few of them.
4. The kept rules and weights are compiled to one Spark column expression, so
   that scoring is a projection over the statistics.

Edge cases: a null text counts as empty, all of whose statistics are 0; without
labels (or of one class only) every score is the smoothed base rate; equal texts
get equal scores, repeated rows a row each; an empty table gives no row. Columns
other than doc_id and text are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, eq

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import labelled_sample, labelled_texts, scan, stored

STATISTICS = (
    "log_chars",
    "log_words",
    "word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "mark_share",  # of ! ? and |
    "space_share",
    "repeat_share",  # words equal to the word before
    "distinct_share",  # different words
    "line_repeat_share",  # lines that occur before
    "top_word_share",
    "long_word_share",
    "symbol_end_share",  # words that end in two symbols
)
SAMPLE = 20_000  # labelled documents to learn from
DEPTH = 3
ROUNDS = 12  # trees of each kind
LASSO = 1e-3
SEED = 7
_LOWER_OR_OTHER = bytes(b for b in range(128) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()!?|")
_MARKS = b"!?|"
_ENDS = tuple(a + b for a in "!#$%&*|=~^" for b in "!#$%&*|=~^")
_CONDITION = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+|-?Infinity|NaN)\)")


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS for one text."""
    text = text or ""
    raw = text.encode()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return (math.log1p(len(text)),) + (0.0,) * (len(STATISTICS) - 1)
    n, size, letters = len(words), len(text), sum(map(len, words))
    counts = Counter(words)
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    digits = len(raw.translate(None, _NOT_DIGIT))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    return (
        math.log1p(size),
        math.log1p(n),
        letters / n,
        upper / letters,
        digits / letters,
        symbols / letters,
        marks / letters,
        (size - letters) / size,
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n,
        1 - len(set(lines)) / len(lines),
        max(counts.values()) / n,
        sum(len(w) * c for w, c in counts.items() if len(w) > 24) / letters,
        sum(c for w, c in counts.items() if w.endswith(_ENDS)) / n,
    )


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and a double column for each of STATISTICS."""

    def make(texts: list[str | None]) -> Iterator[tuple[range, list]]:
        if texts:
            yield range(len(texts)), list(zip(*map(statistics, texts), strict=True))

    return scan(docs, keep, ["text"], lambda: make, [(s, "double", pa.float64()) for s in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(s) > F.lit(x) if above else F.col(s) <= F.lit(x) for s, above, x in self.terms]
        return reduce(lambda a, b: a & b, parts).cast("double")

    def __str__(self) -> str:
        return " AND ".join(f"{s} {'>' if above else '<='} {x:.6g}" for s, above, x in self.terms)


def _simplified(terms: list[tuple[str, bool, float]]) -> Rule:
    """One bound a statistic and side, the tightest."""
    bounds: dict[tuple[str, bool], float] = {}
    for s, above, x in terms:
        old = bounds.get((s, above), x)
        bounds[s, above] = max(old, x) if above else min(old, x)
    return Rule(tuple(sorted((s, above, x) for (s, above), x in bounds.items())))


def tree_rules(trees: list) -> list[Rule]:
    """The paths of Spark ML trees, from their printed form."""
    found: dict[Rule, None] = {}
    for tree in trees:
        path: list[tuple[str, bool, float]] = []
        depths: list[int] = []
        for line in tree.toDebugString.splitlines():
            if m := _CONDITION.search(line):
                depth = len(line) - len(line.lstrip())
                while depths and depths[-1] >= depth:
                    depths.pop()
                    path.pop()
                depths.append(depth)
                path.append((STATISTICS[int(m[2])], m[3] == ">", float(m[4])))
                found[_simplified(path)] = None
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    """Weights of rules and of statistics cut to a range (low, high)."""

    constant: float
    rules: tuple[tuple[Rule, float], ...] = ()
    linear: tuple[tuple[str, float, float, float], ...] = ()  # statistic, low, high, weight

    def column(self) -> Column:
        """The probability of label 1, over columns named as STATISTICS."""
        parts = [F.lit(self.constant)]
        parts += [rule.column() * F.lit(w) for rule, w in self.rules]
        parts += [F.greatest(F.lit(low), F.least(F.lit(high), F.col(s))) * F.lit(w) for s, low, high, w in self.linear]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(add, parts)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Learn from at most about ``sample`` labelled documents, one text an id."""
    chosen = labelled_sample(labels, label, F.lit(True) if usable is None else usable, sample)
    train = text_statistics(labelled_texts(docs, chosen), ("label",)).withColumn("label", (F.col("label") > 0).cast("double"))
    train = stored(train, "quality-train")
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    base = (n.get(1.0, 0) + 1) / (sum(n.values()) + 2)
    if len(n) < 2:
        return RuleModel(math.log(base / (1 - base)))
    data = train.withColumn("features", array_to_vector(F.array(*STATISTICS)))
    common = {"featuresCol": "features", "labelCol": "label", "maxDepth": DEPTH, "maxBins": 64, "seed": SEED, "minInstancesPerNode": 5}
    forest = RandomForestClassifier(numTrees=ROUNDS, subsamplingRate=0.7, featureSubsetStrategy="onethird", **common).fit(data)
    boosted = GBTClassifier(maxIter=ROUNDS, stepSize=0.3, subsamplingRate=0.7, **common).fit(data)
    rules = tree_rules([*forest.trees, *boosted.trees])
    low = train.agg(*(F.percentile_approx(s, F.array(F.lit(0.025), F.lit(0.975))).alias(s) for s in STATISTICS)).first()
    spread = train.agg(*(F.stddev(s).alias(s) for s in STATISTICS)).first()
    linear = [(s, float(low[s][0]), float(low[s][1]), 0.4 / max(float(spread[s] or 0.0), 1e-9)) for s in STATISTICS]
    terms = [r.column() for r in rules] + [F.greatest(F.lit(a), F.least(F.lit(b), F.col(s))) * F.lit(scale) for s, a, b, scale in linear]
    design = stored(train.select("label", F.array(*terms).alias("terms")), "quality-design").withColumn("features", array_to_vector("terms"))
    lasso = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(design)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return RuleModel(
        float(lasso.intercept),
        tuple((r, w) for r, w in zip(rules, weights, strict=False) if w),
        tuple((s, a, b, w * scale) for (s, a, b, scale), w in zip(linear, weights[len(rules) :], strict=True) if w),
    )


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score of every document."""
    return text_statistics(docs).select("doc_id", model.column().alias("score"))


def accepted(docs: DataFrame, model: RuleModel, least: float) -> DataFrame:
    """The documents whose score is at least that, in docs' own columns."""

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(statistics(t)))

    measured = F.col("measured")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), measure(F.col("text")).alias("measured"))
    row = row.select("row", *(measured[i].alias(s) for i, s in enumerate(STATISTICS)))
    return row.where(model.column() >= least).select(*(F.col("row")[c].alias(c) for c in docs.columns))
