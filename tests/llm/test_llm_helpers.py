"""The small functions, against plain versions of themselves."""

import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import chat, licenses, ngram_join, packing, pii, quality, tiff, topk, toxicity

TEXT = st.text(alphabet=st.sampled_from(list("ab1289 .@+-()\n%_é")), max_size=60)
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return (True, kind == 1 and all(int(p) <= 255 for p in found.split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[kind]


@given(TEXT)
def test_base_spans_are_the_patterns(text):
    wanted = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(k, m[0]))
    assert pii.base_spans(text) == wanted


def test_skip_edges_carry_labels():
    text = "Call +1 (212) 555-0147 now. Again: +1 (212) 555-0147, or 12125550147 later."
    base = pii.base_spans(text)
    node = np.log(np.full((pii.SHAPES, pii.LABELS), 1 / pii.LABELS))
    strong = np.log(np.eye(pii.LABELS) * 50 + 0.1)
    added = pii.added_spans(text, base, field(np.zeros_like(strong), strong) | {"node": node})
    assert all(not (b[0] < a[2] and a[0] < b[2]) for a in added for b in base)
    assert pii.redact(text, base + added).count("[PHONE]") >= 2


def field(chain, skip):
    node = np.log(np.full((pii.SHAPES, pii.LABELS), 1 / pii.LABELS))
    return {"node": node, "before": np.zeros_like(node), "chain": chain, "skip": skip, "near": np.zeros_like(skip), "short": np.zeros_like(skip)}


@given(st.integers(1, 7), st.integers(0, 10_000))
@settings(deadline=None, max_examples=40)
def test_beliefs_are_the_exact_marginals_of_a_tree(n, seed):
    rng = np.random.default_rng(seed)
    unary, edges = rng.normal(0, 2, (n, 3)), [(int(rng.integers(i)), i) for i in range(1, n)]
    pairs = [(i, j, rng.normal(0, 1.5, (3, 3))) for i, j in edges]
    weights = {x: np.exp(sum(unary[i, v] for i, v in enumerate(x)) + sum(t[x[i], x[j]] for i, j, t in pairs)) for x in itertools.product(range(3), repeat=n)}
    exact = np.array([[sum(w for x, w in weights.items() if x[i] == v) for v in range(3)] for i in range(n)]) / sum(weights.values())
    assert np.allclose(pii.beliefs(unary, pairs), exact, atol=1e-4)


def test_beliefs_of_a_loop_are_near_the_marginals():
    rng = np.random.default_rng(1)
    unary, pairs = rng.normal(0, 1, (4, 3)), [(i, (i + 1) % 4, rng.normal(0, 0.5, (3, 3))) for i in range(4)]
    weights = {x: np.exp(sum(unary[i, v] for i, v in enumerate(x)) + sum(t[x[i], x[j]] for i, j, t in pairs)) for x in itertools.product(range(3), repeat=4)}
    exact = np.array([[sum(w for x, w in weights.items() if x[i] == v) for v in range(3)] for i in range(4)]) / sum(weights.values())
    assert np.abs(pii.beliefs(unary, pairs) - exact).max() < 0.03


def test_similar_words_share_edges():
    text = "Call +12125550147. Typed 2125550148, then 21255550147; write j.doe7@corp.example.com, see j.doe7 and @corp.example.com, not 5550100."
    found = pii.graph(text, pii.base_spans(text))
    words = [text[s:e] for s, e in found.at]
    pairs = {(words[i], words[j]) for _, each in found.edges() for i, j in each}
    assert ("+12125550147", "2125550148") in pairs or ("+12125550147", "21255550147") in pairs
    assert ("j.doe7@corp.example.com", "j.doe7") in pairs and ("j.doe7@corp.example.com", "@corp.example.com") in pairs
    assert not any("5550100" in p for p in pairs)


def test_nothing_in_a_text_is_left_out_for_its_length():
    word = "x" * 500 + "1"
    assert pii.nodes(f"a {word} b") == [(2, 503)]
    assert pii.shape("a-" * 30 + "1") != pii.shape("a-" * 30 + "12")
    glued = ",".join(f"u{i}@h{i}.example.com" for i in range(20)) + ",+12125550147"
    found = pii.graph(glued + " or 2125550147", pii.base_spans(glued))
    assert len(found.at) == 2 and found.observed[0] == 0 and len(pii.base_spans(glued)) == 21


def test_labels_reach_the_fiftieth_mention():
    text = "Call +12125550147." + " Once more: 12125550147," * 50
    strong, none = np.log(np.eye(pii.LABELS) * 50 + 0.1), np.zeros((pii.LABELS, pii.LABELS))
    for model in (field(none, strong), field(none, strong) | {"node": field(none, none)["node"] + np.log([1, 1, 1, 1, 20])}):
        added = pii.added_spans(text, pii.base_spans(text), model)
        assert [text[s:e] for s, _, e in added] == ["12125550147"] * 50
    behind = "Call +12125550147 #77 and then 88 99"
    assert [behind[s:e] for s, _, e in pii.added_spans(behind, pii.base_spans(behind), field(strong, none))] == ["77"]


def test_labels_cross_a_long_row_of_nodes():
    text = "Call +12125550147 " + " ".join(f"#{i}" for i in range(100, 140))
    sure = np.log(np.eye(pii.LABELS) * 5000 + 0.1)
    spans = pii.added_spans(text, pii.base_spans(text), field(sure, sure))
    assert text[spans[-1][0] : spans[-1][2]].endswith("139")
    assert all(len(re.sub("[^0-9]", "", text[s:e])) <= pii.MOST for s, _, e in spans)  # no number is longer


@given(st.binary(max_size=3000), st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]), st.sampled_from([1, 2]), st.sampled_from([0, 16]))
@settings(deadline=None)
def test_tiff_round_trip(data, method, predictor, tile):
    data += b"\0" * (-len(data) % 48 or 48 * (not data))
    file = tiff.encode(data, 48, method, predictor, rows_per_strip=0 if tile else 3, tile=(tile, tile) if tile else None)
    assert [tiff.page_samples(file, f) for f in tiff.directories(file)] == [data]


@pytest.mark.parametrize("size", [500, 560, 5000, 70_000])
def test_lzw_of_random_bytes(size):
    data = random.Random(size).randbytes(size)
    assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data


def test_broken_tiff_gives_an_error_row():
    assert [p[-1] is None for p in tiff._file_pages(b"II*\0")] == [False]
    assert list(tiff._file_pages(None)) == []


def best_disjoint(scores, a, b):
    """The definition: the best segment, then the same left and right of it; of equal ones the shortest, then the first."""
    runs = [(sum(scores[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)]
    if not runs or max(runs)[0] <= 0:
        return []
    total, n, i = max(runs)
    return [*best_disjoint(scores, a, -i), (-i, -i - n, total), *best_disjoint(scores, -i - n, b)]


@given(st.lists(st.floats(-4, 4, allow_subnormal=False).map(lambda x: round(x, 3)), max_size=14), st.integers(0, 1000))
def test_segments_are_those_of_the_definition(scores, seed):
    rng = random.Random(seed)
    scores = [x + rng.random() * 1e-5 for x in scores]  # without ties
    found = toxicity.maximal_segments(np.array(scores, float))
    assert [(i, j) for i, j, _ in found] == [(i, j) for i, j, _ in best_disjoint(scores, 0, len(scores))]
    assert all(abs(sum(scores[i:j]) - s) < 1e-9 for i, j, s in found)


@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_with_ties_are_disjoint_and_hold_the_best(scores):
    found = toxicity.maximal_segments(np.array(scores, float))
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 and s > 0 for a, b, s in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    assert max((s for *_, s in found), default=0) == max([0, *(t for *_, t in best_disjoint(scores, 0, len(scores)))])


def test_a_bar_spares_work_but_changes_no_evidence():
    rng = random.Random(4)
    held = {w: rng.gauss(0, 1.5) for w in map(str, range(60))}
    for _ in range(200):
        text = " ".join(rng.choices(list(held), k=rng.choice([3, 40, 300])))
        law = (0.05, 0.8)
        bar = lambda n: math.log(max(law[0] * n, 1e-9)) / law[1]
        plain, spared = (toxicity.evidence(*toxicity.segments(text, held, *args), law) for args in ((), (bar,)))
        assert plain == spared


def test_scores_of_words_by_hand():
    toxic, clean = np.zeros(toxicity.BUCKETS, int), np.zeros(toxicity.BUCKETS, int)
    for form, bad, good in (("3vil", 3, 1), ("4vile", 2, 1), ("0viles", 1, 0), ("0sea", 0, 4)):
        toxic[toxicity.bucket(form)], clean[toxicity.bucket(form)] = bad, good
    scores = toxicity.Scores(toxic, clean, 0.2)
    rate = 0.2
    for bad, good in ((3, 1), (2, 1), (1, 0)):
        rate = (bad + 2 * rate) / (bad + good + 2)
    odds = lambda p: math.log(p / (1 - p))
    assert abs(scores["(Viles!)"] - (odds(rate) - odds(0.2))) < 1e-12
    assert abs(scores["sea"] - (odds(0.4 / 6) - odds(0.2))) < 1e-12 and abs(scores["newword"]) < 1e-12 and scores["--"] == 0
    assert scores["sea-viles"] == scores["viles"]


def test_passages_count_in_full_wherever_they_stand():
    scores = dict.fromkeys("abcde", 2.5) | {"z": -0.2}
    passage, filler = list("abcde"), ["z"] * 40
    text = passage + filler + [w for c in "abcde" * 3 for w in (c, *filler)] + passage + filler * 20 + passage

    class Held(dict):
        __missing__ = scores.__getitem__

    tokens, found = toxicity.segments(" ".join(text), Held())
    assert [(s, e) for s, e, v in found if abs(v - 10) < 1e-9] == [(0, 5), (660, 665), (1465, 1470)] and tokens == 1470
    _, (again,) = toxicity.segments(" ".join(passage * 50), Held())
    assert again[:2] == (0, 250) and 10 <= again[2] < 20
    _, (plain,) = toxicity.segments(" ".join("a" * 500), Held())
    assert plain[2] < 6


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_key(cells, bits=3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@given(st.text(max_size=40) | TEXT | st.sampled_from(["a <|endoftext|> b", "it's  two\n\n x", "\t", "über 12³ ½"]))
@settings(deadline=None)
def test_ranks_give_the_tokenizer_s_ids(text):
    if not hasattr(test_ranks_give_the_tokenizer_s_ids, "ids"):
        test_ranks_give_the_tokenizer_s_ids.ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        test_ranks_give_the_tokenizer_s_ids.whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = test_ranks_give_the_tokenizer_s_ids
    assert own.ids.encode(text).tolist() == own.whole.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 5000))
def test_tails_are_powers_of_two(n):
    parts = packing.tail_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts)


def test_scores_beyond_doubles_stay_exact():
    q = np.array([[2.0**40 + 1, 3.0]])
    assert topk._scores(q, q).tolist() == [[min((2**40 + 1) ** 2 + 9, topk.LIMIT)]]


def test_license_words_and_common_length():
    assert licenses.words("All-Rights  RESERVED é9") == [b"all", b"rights", b"reserved", "é9".encode()]
    assert licenses.common_length((b"a", b"b", b"c"), [b"a", b"x", b"c"]) == 2
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices(b"abcd", k=rng.randrange(70)) for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert licenses.common_length(a, b) == table[-1, -1]


def test_overlap_bound_is_exact():
    for n in range(1, 200):
        least = ngram_join.overlap_bound(n, 85)
        assert 100 * least >= 85 * n > 100 * (least - 1)


def test_statistics_of_empty_texts():
    assert quality.statistics(None) == quality.statistics("") and len(quality.statistics(" \n")) == len(quality.STATISTICS)


@given(st.text(alphabet=st.sampled_from(list("aB1 #!\n$é|x")), max_size=120))
def test_statistics_by_hand(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    letters = [c for w in words for c in w]
    share = lambda test: sum(map(test, letters)) / len(letters)
    found = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    if not words:
        assert sum(v != 0 for v in found.values()) <= 1
        return
    wanted = {
        "log_chars": math.log(1 + len(text)),
        "log_words": math.log(1 + len(words)),
        "word_length": len(letters) / len(words),
        "upper_share": share(lambda c: "A" <= c <= "Z"),
        "digit_share": share(lambda c: c in "0123456789"),
        "symbol_share": share(lambda c: c in "#$"),
        "mark_share": share(lambda c: c in "!?|"),
        "space_share": sum(c.isspace() for c in text) / len(text),
        "repeat_share": sum(words[i] == words[i - 1] for i in range(1, len(words))) / len(words),
        "distinct_share": len(set(words)) / len(words),
        "line_repeat_share": sum(x in lines[:i] for i, x in enumerate(lines)) / len(lines),
        "top_word_share": max(words.count(w) for w in words) / len(words),
        "long_word_share": sum(len(w) for w in words if len(w) > 24) / len(letters),
        "symbol_end_share": sum(len(w) > 1 and all(c in "!#$%&*|=~^" for c in w[-2:]) for w in words) / len(words),
    }
    assert found.keys() == wanted.keys() and all(abs(found[k] - v) < 1e-9 for k, v in wanted.items()), {k: (found[k], v) for k, v in wanted.items() if abs(found[k] - v) >= 1e-9}


def test_rules_are_the_paths_of_the_trees(spark):
    """A row's tree prediction is that of the leaf whose path it meets, and every prefix of a path is a rule."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.STATISTICS)))
    rows = [(float(r[0] > 0.5) if r[3] > 0.4 else float(r[5] > 0.7), *map(float, r)) for r in x]
    table = spark.createDataFrame(rows, ["label", *quality.STATISTICS]).withColumn("features", array_to_vector(F.array(*quality.STATISTICS)))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=4, maxDepth=3, seed=1).fit(table)
    rules = quality.tree_rules(forest.trees)

    def holds(rule, row):
        return all((row[quality.STATISTICS.index(s)] > t) == above for s, above, t in rule.terms)

    def paths(node, terms):
        out = [tuple(terms)] if terms else []
        if node.numDescendants():
            name, at = quality.STATISTICS[node.split().featureIndex()], node.split().threshold()
            out += paths(node.leftChild(), [*terms, (name, False, at)]) + paths(node.rightChild(), [*terms, (name, True, at)])
        return out

    walked = [p for t in forest.trees for p in paths(t._call_java("rootNode"), [])]
    meets = lambda p, row: all((row[quality.STATISTICS.index(s)] > t) == above for s, above, t in p)
    assert {tuple(meets(p, r) for r in x) for p in walked} == {tuple(holds(rule, r) for r in x) for rule in rules}
    model = quality.RuleModel(-0.3, tuple((r, 0.2 * i - 1) for i, r in enumerate(rules)), (("log_chars", 0.2, 0.6, 1.5), ("word_length", 0.1, 0.9, -2.0)))
    scored = [r["p"] for r in table.select(model.column().alias("p")).collect()]
    for p, r in zip(scored, x, strict=True):
        z = -0.3 + sum(w for rule, w in model.rules if holds(rule, r)) + 1.5 * min(max(r[0], 0.2), 0.6) - 2.0 * min(max(r[2], 0.1), 0.9)
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9


def test_template_escapes(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "[INST][INST]", "plain", "", "\\", "<s"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"] and not re.search(r"</?s>|\[/?INST\]", r["e"])
