"""Operator 1: personal data by patterns and a skip-chain conditional random field.

The base spans are leftmost, non-overlapping matches of four fixed patterns.
The field then adds mentions the patterns miss: a phone number that is written out
once and repeated without its prefix, one that a pattern gave up as digits stand
right behind it, a handle that is the mailbox of an address. Its nodes are the words
with a digit or an @ and the handles (all others are fixed to "no entity"). A node's
own factors are its shape and the word before it; chain factors join neighbouring
nodes; skip factors join distant nodes, in three strengths:

- skip: the same digits (LONG or more), the same last LONG digits as a written-out
  number, or the same mailbox. Neighbouring words go by their digits together:
  '+1 (212) 555-0147' meets '2125550147', and '+12125550147' meets '(212) 555-0147';
- near: digits that one edit turns into those of a written-out number, or the same
  domain;
- short: the same digits, but so few that it can be chance.

Base spans are observed; loopy sum-product messages carry their labels along the
edges until the messages stop changing. Each mention is linked to its group's first
observed node of each kind, or to the first node if none is observed. So the last of
n mentions hears as much as the next one, and the edges stay in proportion to n.

The factors are trained piece by piece, in closed form, from counts over all
documents: a node's factors are P(label | shape) and how much more often than by
chance a label follows a word, a pair's is how much more often two labels meet than
by chance. Shapes and words are hashed to tables of fixed size. Unmatched words that
skip edges join to base spans, or that a dropped phone match holds, are the mentions to
find, so they count as nothing, not as "no entity". A shape keeps at least a fixed share of the labels' prior (FLOOR), a
word before counts against a fixed number of others (AGAINST), and linked labels
disagree now and then (STRAY), so that what a link adds doesn't fade or grow with the
corpus.

A node becomes a span only if its belief is at least MIN_BELIEF and one of these holds:
a path of skip, near or short edges leads to an observed span of that kind; a path over
chain edges too, and the node's shape is one that base spans of that kind are made of
(SEEN times at least, and most often); or it is at the front of a dropped phone match,
has such a shape, and its own factors make a phone likelier than not. So a row of plain
numbers, dates or amounts that nothing links to a base span stays as it is, whatever
the chain factors: no shape vouches for its neighbour. Where no word stands before a
node, there is no factor for it. Spans never overlap base ones.

Edge cases: a null text is empty and has no span (its digest is that of the empty
string); words of any length are nodes; documents are independent, so repeated rows
and ids get a row each; an empty table gives no row. Ids of any type pass through,
null ones too. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import scan

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)  # the label of no entity
LABELS = OUTSIDE + 1
NUMBERS = (KINDS.index("card"), KINDS.index("phone"))
SHAPES = 1 << 14  # hash buckets of word shapes
MIN_BELIEF = 0.9
LONG = 7  # digits of a number without its prefixes
MOST = 19  # digits of any number
FLOOR = 0.2  # weight of the prior, as a share of a shape's count
SEEN = 3  # sightings in base spans before a shape counts as one of theirs
STRAY = 0.01  # how often linked nodes don't agree
AGAINST = 20.0  # sightings that a word before a node is weighed against
SETTLED = 1e-6  # messages that change less than this have stopped
LEAST_HANDLE = 5  # characters of a mailbox that counts as a handle
PAIRS = ("chain", "skip", "near", "short")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
_EDGE = "".join(map(chr, range(33, 127)))
_EDGE = "".join(c for c in _EDGE if not c.isalnum() and c not in "+()@")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All valid matches of the four patterns, by start and then kind."""
    found: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        other = _NOT_LOCAL.search(text[floor:at][::-1]) if domain else None
        start = at - other.start() if other else floor
        if domain and start < at:
            found.append((start, 0, domain.end()))
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def mailboxes(text: str, base: list[Span]) -> set[str]:
    """The mailboxes of the addresses among the base spans that are no plain words or numbers."""
    boxes = {text[s:e].partition("@")[0].lower() for s, k, e in base if k == 0}
    return {b for b in boxes if len(b) >= LEAST_HANDLE and not b.isalpha() and not b.isdigit()}


def nodes(text: str, base: list[Span] = []) -> list[tuple[int, int]]:  # noqa: B006
    """Start and end of the words with a digit or an @, without outer punctuation, and of handles.

    A handle is a word that equals the mailbox of an address among the base spans, if
    that holds more than letters.
    """
    out, floor = [], 0
    mark = _MARK.search(text)
    while mark:
        before = _SPACE.search(text[floor : mark.start()][::-1])
        start = mark.start() - before.start() if before else floor
        after = _SPACE.search(text, mark.end())
        floor = after.start() if after else len(text)
        left, right = start, floor
        while left < right and text[left] in _EDGE:
            left += 1
        while right > left and text[right - 1] in _EDGE:
            right -= 1
        if left < right:
            out.append((left, right))
        mark = _MARK.search(text, floor)
    if boxes := {b for b in mailboxes(text, base) if not _MARK.search(b)}:
        for word in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if word[0].strip(_EDGE).lower() in boxes and not _MARK.search(word[0]):
                left = word.start() + len(word[0]) - len(word[0].lstrip(_EDGE))
                out.append((left, left + len(word[0].strip(_EDGE))))
        out.sort()
    return out


def shape(word: str) -> int:
    """The hash bucket of a word's form: runs of digits by length, letters as one, and whether its checks hold.

    Runs of over MOST digits, more than any number has, are alike.
    """
    form = _RUNS.sub(lambda m: f"{min(len(m[0]), MOST + 1)}d" if "0" <= m[0][0] <= "9" else "a", word)
    digits = _NOT_DIGIT.sub("", word)
    parts = word.split(".")
    valid = luhn(digits) if MOST >= len(digits) > 12 else all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts) if len(parts) == 4 else ""
    return zlib.crc32(f"{form}{valid}".encode()) % SHAPES


def before(text: str, start: int) -> int:
    """The hash bucket of the word right before a place on its line, from 1; 0 if none ends within three characters of it."""
    end = start
    while end > max(0, start - 3) and text[end - 1] != "\n" and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    first = end
    while first > 0 and text[first - 1].isalpha():
        first -= 1
    return 1 + zlib.crc32(text[first:end].lower().encode()) % (SHAPES - 1) if first < end else 0


def skip_key(word: str) -> str | None:
    """What a word must share with another to be linked to it."""
    if "@" in word:
        return "@" + word.partition("@")[0].lower()
    digits = _NOT_DIGIT.sub("", word)
    return digits if len(digits) >= 4 else None


def is_long(key: str) -> bool:
    return key[0] == "@" or len(key) >= LONG


def one_edit(digits: str) -> list[str]:
    """Keys of which two digit strings share one if an edit turns one into the other."""
    return ["~" + digits, *("~" + digits[:i] + digits[i + 1 :] for i in range(len(digits)))]


class Graph(NamedTuple):
    at: list[tuple[int, int]]  # the nodes
    observed: np.ndarray  # their labels
    chain: list[tuple[int, int]]  # edges of neighbours
    skip: list[tuple[int, int]]  # edges of nodes that share LONG digits or a mailbox
    near: list[tuple[int, int]]  # edges of nodes with similar digits or the same domain
    short: list[tuple[int, int]]  # edges of nodes that share fewer digits

    def edges(self) -> list[tuple[str, list[tuple[int, int]]]]:
        return [(name, getattr(self, name)) for name in PAIRS]


def graph(text: str, base: list[Span]) -> Graph:
    """Nodes, their observed labels and the edges."""
    at = nodes(text, base)
    observed = np.full(len(at), OUTSIDE)
    numbers: dict[int, tuple[int, str]] = {}  # base span -> its last node, its digits
    k = 0
    for i, (start, end) in enumerate(at):
        while k < len(base) and base[k][2] <= start:
            k += 1
        n, here = k, []
        while n < len(base) and base[n][0] < end:
            if base[n][2] > start:
                here.append(n)
            n += 1
        if here:
            observed[i] = base[here[0]][1]
        for n in here:
            if base[n][1] in NUMBERS and base[n][1] == observed[i]:
                numbers[n] = i, _NOT_DIGIT.sub("", text[base[n][0] : base[n][2]])
    chain = [(i, i + 1) for i in range(len(at) - 1) if at[i + 1][0] - at[i][1] <= 4 and not any(c.isalnum() for c in text[at[i][1] : at[i + 1][0]])]
    words = [text[start:end] for start, end in at]
    groups: dict[str, dict[int, None]] = {}
    similar: dict[str, dict[int, None]] = {}
    for i, digits in numbers.values():
        for n in range(LONG, len(digits) + 1):
            groups.setdefault(digits[-n:], {})[i] = None
        for key in one_edit(digits):
            similar.setdefault(key, {})[i] = None
    for i in np.flatnonzero(observed == 0).tolist():
        if domain := words[i].rpartition("@")[2].lower():
            similar.setdefault(domain, {})[i] = None

    def join(digits: str, first: int, last: int) -> None:
        members = dict.fromkeys(range(first, last + 1))
        if LONG <= len(digits) <= MOST and groups:
            for key in {digits, digits[-LONG:]}:
                if key in groups:
                    groups[key].update(members)
            for key in one_edit(digits):
                if key in similar:
                    similar[key].update(members)

    bare = ["" if observed[i] != OUTSIDE or any(map(str.isalpha, w)) else _NOT_DIGIT.sub("", w) for i, w in enumerate(words)]
    joined = set(chain)
    for i in range(len(at) if groups else 0):
        digits, j = bare[i], i
        if digits:
            join(digits, i, j)
        while digits and (j, j + 1) in joined and bare[j + 1] and len(digits) + len(bare[j + 1]) <= MOST:
            j += 1
            digits += bare[j]
            join(digits, i, j)
    boxes = mailboxes(text, base)
    for i, word in enumerate(words):
        if key := "@" + word.lower() if word.lower() in boxes else skip_key(word):
            groups.setdefault(key, {})[i] = None
        if "@" in word and observed[i] == OUTSIDE and (domain := word.rpartition("@")[2].lower()) in similar:
            similar[domain][i] = None
    edges: dict[str, set[tuple[int, int]]] = {"skip": set(), "near": set(), "short": set()}
    for name, key, members in [("skip" if is_long(k) else "short", k, m) for k, m in groups.items()] + [("near", k, m) for k, m in similar.items()]:
        same = sorted(members)
        first: dict[int, int] = {}
        for i in same:
            if observed[i] != OUTSIDE:
                first.setdefault(int(observed[i]), i)
        hubs = set(first.values()) or {same[0]}
        edges[name].update((min(h, i), max(h, i)) for i in same for h in hubs if i != h and (i not in hubs or h < i))
    return Graph(at, observed, chain, sorted(edges["skip"]), sorted(edges["near"] - edges["skip"]), sorted(edges["short"] - edges["skip"] - edges["near"]))


def lost_numbers(text: str) -> list[tuple[int, int]]:
    """Where the phone pattern took in too many digits, so that what it found was dropped."""
    return [m.span() for m in _PHONE.finditer(text) if len(_NOT_DIGIT.sub("", m[0])) > 15] if "+" in text else []


def lost_fronts(text: str, at: list[tuple[int, int]]) -> set[int]:
    """The nodes that a dropped phone match begins with, as far as they hold no more digits than a phone number."""
    out: set[int] = set()
    k = 0
    for start, end in lost_numbers(text):
        while k < len(at) and at[k][1] <= start:
            k += 1
        digits, i = 0, k
        while i < len(at) and at[i][0] < end and (digits := digits + sum("0" <= c <= "9" for c in text[at[i][0] : at[i][1]])) <= 15:
            out.add(i)
            i += 1
    return out


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables = {name: np.zeros((SHAPES, LABELS), np.int64) for name in ("shape", "before")}
    tables |= {name: np.zeros((LABELS, LABELS), np.int64) for name in PAIRS}
    for batch in batches:
        for text in batch["text"]:
            if not text or not _MARK.search(text):
                continue
            found = graph(text, base_spans(text))
            observed = found.observed.tolist()
            lost = lost_numbers(text)
            sought = {x for i, j in found.skip if (observed[i] == OUTSIDE) != (observed[j] == OUTSIDE) for x in (i, j) if observed[x] == OUTSIDE}
            sought |= {i for i, (start, end) in enumerate(found.at) if observed[i] == OUTSIDE and any(a < end and b > start for a, b in lost)}
            for i, (start, end) in enumerate(found.at):
                if i not in sought:
                    tables["shape"][shape(text[start:end]), observed[i]] += 1
                    tables["before"][before(text, start), observed[i]] += 1
            for name, edges in found.edges():
                for i, j in edges:
                    if i not in sought and j not in sought:
                        tables[name][observed[i], observed[j]] += 1
    rows = [(name, int(r), int(c), int(t[r, c])) for name, t in tables.items() for r, c in zip(*t.nonzero(), strict=True)]
    yield pd.DataFrame(rows, columns=["factor", "row", "label", "n"])


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """The field's log factors, from counts over every document.

    The driver gets at most SHAPES * 10 + 100 sums, whatever the corpus.
    """
    counts = docs.select("text").mapInPandas(_count_batches, "factor string, row int, label int, n long")
    sums = counts.groupBy("factor", "row", "label").agg(F.sum("n").alias("n")).collect()
    tables = {name: np.zeros((SHAPES, LABELS)) for name in ("shape", "before")} | {name: np.zeros((LABELS, LABELS)) for name in PAIRS}
    for r in sums:
        tables[r["factor"]][r["row"], r["label"]] = r["n"]
    share = tables["shape"].sum(0) + 1.0
    prior = share / share.sum()
    node = tables["shape"] + (2.0 + FLOOR * tables["shape"].sum(1, keepdims=True)) * prior
    trusted = (tables["shape"] >= SEEN) & (2 * tables["shape"] > tables["shape"].sum(1, keepdims=True))
    context = tables["before"] + AGAINST * prior
    context = np.log(context / context.sum(1, keepdims=True) / prior)
    context[0] = 0.0  # no word
    pairs = {}
    t = tables["short"] + tables["short"].T + np.outer(prior, prior) * 10 + np.eye(LABELS)
    t /= t.sum()
    pairs["short"] = np.log(t / np.outer(t.sum(1), t.sum(0)))
    for name, chance in (("skip", 0.0), ("near", 0.0), ("chain", AGAINST)):
        t = tables[name] + tables[name].T + np.eye(LABELS) + np.outer(prior, prior) * chance
        lift = np.log((1 - STRAY) * t / t.sum(1, keepdims=True) / prior + STRAY)
        pairs[name] = (lift + lift.T) / 2
    return {"node": np.log(node / node.sum(1, keepdims=True)), "before": context, "trusted": trusted, **pairs}


def beliefs(unary: np.ndarray, pairs: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Loopy sum-product with damping; P(label) of each node.

    A label crosses any path in as many rounds as there are nodes; the limit is
    beyond that, for loops that never settle.
    """
    if not pairs:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    source = np.array([i for i, _, _ in pairs] + [j for _, j, _ in pairs])
    target = np.array([j for _, j, _ in pairs] + [i for i, _, _ in pairs])
    factor = np.exp(np.stack([t for *_, t in pairs] + [t.T for *_, t in pairs]))
    back = np.r_[len(pairs) : 2 * len(pairs), 0 : len(pairs)]
    message = np.zeros((len(source), unary.shape[1]))
    for _ in range(100 + 2 * len(unary)):
        total = unary.copy()
        np.add.at(total, target, message)
        cavity = total[source] - message[back]
        cavity = np.exp(cavity - cavity.max(1, keepdims=True))
        new = np.log(np.einsum("ea,eab->eb", cavity, factor) + 1e-300)
        change = 0.5 * (new - new.max(1, keepdims=True) - message)
        message += change
        if np.abs(change).max() < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def reached_kinds(observed: np.ndarray, edges: list[tuple[int, int]]) -> list[set[int]]:
    """For each node, the kinds of the observed nodes that a path leads to."""
    parent = list(range(len(observed)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in edges:
        parent[root(i)] = root(j)
    kinds: dict[int, set[int]] = {}
    for i, label in enumerate(observed.tolist()):
        held = kinds.setdefault(root(i), set())
        if label != OUTSIDE:
            held.add(label)
    return [kinds[root(i)] for i in range(len(observed))]


def added_spans(text: str, base: list[Span], model: dict[str, np.ndarray]) -> list[Span]:
    """Spans that the field finds beside the base ones."""
    if not _MARK.search(text):
        return []
    found = graph(text, base)
    at, observed = found.at, found.observed
    fixed = observed != OUTSIDE
    if fixed.all():
        return []
    shapes = [shape(text[s:e]) for s, e in at]
    unary = np.stack([model["node"][x] + model["before"][before(text, s)] for x, (s, _) in zip(shapes, at, strict=True)])
    own = np.exp(unary - unary.max(1, keepdims=True))
    own /= own.sum(1, keepdims=True)
    trusted = model["trusted"][shapes] if "trusted" in model else np.ones(unary.shape, bool)
    able = np.zeros(unary.shape, bool)  # of themselves
    fronts, phone = sorted(lost_fronts(text, at)), KINDS.index("phone")
    able[fronts, phone] = (own[fronts, phone] >= 0.5) & trusted[fronts, phone]
    edges = [e for _, each in found.edges() for e in each]
    crossing = any(fixed[i] != fixed[j] for i, j in edges)
    if not crossing and not able[~fixed].any():
        return []  # no label can travel, and no node has one of its own
    unary[fixed] = -np.inf  # however many messages come in
    unary[fixed, observed[fixed]] = 0.0
    belief = beliefs(unary, [(i, j, model[name]) for name, each in found.edges() for i, j in each])
    near, reach = (reached_kinds(observed, e) for e in (found.skip + found.near + found.short, edges))
    label = np.where(belief.max(1) >= MIN_BELIEF, belief.argmax(1), OUTSIDE)
    vouched = lambda i, k: k in near[i] or k in reach[i] and trusted[i, k] or able[i, k]
    chosen = {i for i in range(len(at)) if not fixed[i] and label[i] != OUTSIDE and vouched(i, int(label[i]))}
    joined = set(found.chain)
    spans: list[Span] = []
    for i in sorted(chosen):
        start, end = at[i]
        kind = int(label[i])
        if spans and (i - 1, i) in joined and i - 1 in chosen and spans[-1][1] == kind and len(_NOT_DIGIT.sub("", text[spans[-1][0] : end])) <= MOST:
            spans[-1] = (spans[-1][0], kind, end)
        else:
            spans.append((start, kind, end))
    return [s for s in spans if not any(b[0] < s[2] and b[2] > s[0] for b in base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are those of the base spans; spans has all.
    """
    model = fit(docs) if model is None else model

    def make(texts: list[str | None]) -> Iterator[tuple[range, list]]:
        rows = []
        for text in texts:
            base = base_spans(text or "")
            more = added_spans(text or "", base, model)
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(OUTSIDE)), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
        if rows:
            yield range(len(rows)), list(zip(*rows, strict=True))

    counts = [(f"n_{k}", "long", pa.int64()) for k in KINDS]
    return scan(docs, ["doc_id"], ["text"], lambda: make, [*counts, ("base_sha256", "string", pa.string()), ("spans", "string", pa.string()), ("n_added", "long", pa.int64())])


def redact(text: str, spans: list[Span]) -> str:
    """Put [KIND] in the place of each span; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with every span of text replaced, and n_chars, if there is one, to match."""
    model = fit(docs) if model is None else model

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            base = base_spans(text)
            spans = base + added_spans(text, base, model)
            return redact(text, spans) if spans else text

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
