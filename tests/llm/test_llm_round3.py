"""Token alignment, source divergence and url rules against brute force, on rows that break jobs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import alignment, divergence, ngram_join, packing, pii, topk, urlfilter
from tidemill.llm.common import MOST_TASKS, scratch

CLASHING = {"row": "x", "chunks": 1, "order": 2, "link": 3, "count": 4, "key": 5, "level": 6, "term": "t", "part": "p", "item": 7, "host": "h", "verdict": "v", "n": 8}


def with_clashes(frame):
    for name, value in CLASHING.items():
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(value))
    return frame


# --- alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_by_hand(both, text):
    """ids and ends by both, or nothing."""
    a, b = both
    letters = alignment.byte_letters()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
    if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    ends = [[len(b"".join(r[: i + 1])) if len(r) < 300 else 0 for i in range(len(r))] for r in raw]
    for e, r in zip(ends, raw, strict=True):
        at = 0
        for i, t in enumerate(r):
            at += len(t)
            e[i] = at
    return ids, ends


def aligned_by_hand(both, texts):
    found, counts = [], Counter()
    for text in texts:
        made = tokens_by_hand(both, text or "")
        if made is None:
            found.append(None)
            continue
        (a, b), (ends_a, ends_b) = made
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [[[i for i, e in zip(ids, ends, strict=True) if lo < e <= hi] for ids, ends in ((a, ends_a), (b, ends_b))] for lo, hi in zip([0, *cuts], cuts)] if len(a) < 3000 else None
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            done = min(ends_a[i], ends_b[j])
            i, j = i + (ends_a[i] == done), j + (ends_b[j] == done)
        counts.update(links)
        text = None if groups is None else ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((len(a), len(b), len(cuts), links, text))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4] if f[4] is None else hashlib.sha256(f[4].encode()).hexdigest()) for f in found]


ODD = ["Plain words, again and again.\nPlain words!", "</s> <s> <unk> <|endoftext|> <0x41>", "naïve café Œuvre ǅ ĲŁ", "a▁b", "two  spaces   three\t\ttabs\r\nlines \n\n end ", " lead", "trail ", "日本語のテキスト 한국어 🙂👍🏽 é", "nul\x00byte", " nbsp em", "it's we'll 3.14159 1,000,000 v2.0-rc1", "²³.½", "x" * 400, "A", "\n", " ", "﻿bom", "ﬁ Å"]


@pytest.mark.parametrize("hot", [alignment.HOT, 5])
def test_alignment_against_brute_force(spark, both, hot):
    rng = random.Random(1)
    words = ["tide", "mill", "Unhappiness", "internationalization", "grün", "vögel", "xqzt", "2024", "re-entry", "don't"]
    texts = [None, "", *ODD, *(" ".join(rng.choices(words, k=rng.choice([1, 5, 60]))) + rng.choice([".", "!\n", ""]) for _ in range(40))]
    texts += [texts[20], texts[20], " " * 3000 + "x", "ab " * 20_000]
    rows = [(rng.choice([None, 3, i]), t) for i, t in enumerate(texts)]
    made = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = alignment.align(made, hot=hot).collect()
    wanted = [(r[0], *w) for r, w in zip(rows, aligned_by_hand(both, texts), strict=True)]
    short = lambda rows: sorted((tuple(r)[:7] for r in rows), key=str)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = [tuple(r[c] for c in columns) for r in found]
    assert short(found) == short(wanted)
    digests = {r[7] for r in found}
    assert all(w[7] is None or w[7] in digests for w in wanted)


def test_alignment_of_no_rows_and_no_tokens(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = alignment.align(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


@given(st.text(st.sampled_from("abcéßŁ .,;:!?'\n-_()|09AZ"), max_size=60))
@settings(deadline=None, max_examples=150)
def test_chunks_tokenise_as_the_whole_text_does(text):
    known = alignment._remembered(tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    (codes,) = known.codes([text])
    columns = known.columns(codes)
    ids = [[i for each in c.to_pylist() for i in each] for c in (columns[0], columns[2])]
    a, b = known.tokens.text(" " + text) if text else ([], [])
    assert ids == [a, b]


# --- divergence


def audit_by_hand(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (own, s), c in counts.items() if own == lang}
        p = lambda of: {t: 1 + 10**9 * (n + 5) // (sum(of.values()) + 5 * len(kept)) for t, n in of.items()}
        shares, whole = {s: p(of) for s, of in groups.items()}, p({t: sum(g[t] for g in groups.values()) for t in kept})
        for s in groups:
            pairs = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            more = sorted((whole[t] - shares[s][t], t.encode(), t) for t in kept if groups[s][t] and shares[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(more[:top])]
    return sorted(out)


@pytest.mark.parametrize("most, block", [(divergence.SORTED, divergence.BLOCK), (0, 2)])
def test_divergence_against_brute_force(spark, monkeypatch, most, block):
    """With ties of the last value, long terms that begin alike, terms beyond Latin, a hot source, and languages without kept terms."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(2)
    terms = ["Sea", "tide", "ÉTÉ", "été", "日本", "日本語", "🙂", "z", *("a" * 900 + x for x in "bcdé"), *(f"w{c}" for c in "abcdefghijklmnop")]
    rows = [(" ".join(rng.choices(terms, k=rng.choice([1, 4, 30]))) + "1x2", rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "b", "c", "", None, "é"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "x"), ("one two", "fr", "y"), ("one", "it", "only")] + rows[:9]
    made = with_clashes(spark.createDataFrame(rows, "text string, lang string, source string"))
    for least, top in ((9, 3), (2, 50)):
        found = divergence.audit(made, least_docs=least, top=top, most=most)
        assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found.collect()) == audit_by_hand(rows, least, top)
    assert divergence.audit(made.where("false")).count() == 0


def test_terms_are_counted_before_they_leave_their_task(spark):
    """A task gives a row a group and term of a batch, not one a token; ends of terms are those of the contract's pattern."""
    rows = [("Sea sea SEA-tide", "en", "a"), ("tide\x7f\x80x ÀÉ日", "en", "a"), (None, "en", "a"), ("sea", None, "a")] * 50
    counted = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1))
    assert sorted((r["lang"], r["term"], r["n"], r["docs"]) for r in counted.collect()) == sorted([("", "sea", 50, 50), ("en", "sea", 150, 50), ("en", "tide", 100, 100), ("en", "\x80x", 50, 50), ("en", "ÀÉ日", 50, 50)])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_radix_selection_is_the_sort(spark):
    rng = random.Random(3)
    rows = [(g, "s", "".join(rng.choices("abé", k=rng.randrange(1, 6))) + str(i), rng.choice([0, 1, 2, 5, 255, 256, 10**9, 2**62, rng.randrange(10**6)])) for g in "xyz" for i in range({"x": 400, "y": 7, "z": 3}[g])]
    table = spark.createDataFrame(rows, "lang string, source string, item string, value long").cache()
    for k, most in ((1, 0), (5, 0), (90, 3), (200, 1000)):
        with scratch(spark) as keep:
            found = sorted((r["lang"], r["rank"], r["item"], r["value"]) for r in divergence.top_items(table, k, keep, most).collect())
        wanted = [(g, i + 1, t, v) for g in "xyz" for i, (v, _, t) in enumerate(sorted((-v, t.encode(), t) for own, _, t, v in rows if own == g)[:k])]
        assert found == sorted((g, i, t, -v) for g, i, t, v in wanted)


def test_shares_are_exact_beyond_doubles(spark):
    n, total, terms = 7 * 10**17 + 3, 9 * 10**17 + 1, 10**9 + 7
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# --- url rules


def judged_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count(".") + 1, len(p), v, h + p) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def urls(rng, n):
    labels = ["a", "b", "com", "net", "", "x\x01y", "\x00", "é", "\x02c"]
    url = lambda: rng.choice(["http://", "https://", "://", "//", ""]) + ".".join(rng.choices(labels, k=rng.randrange(1, 6))) + rng.choice(["", "/", "/en", "/en/", "/en/x/y", "?q=/en/", "#/en/", "/é\x00z", ":80/en/", "/en\n/x"])
    return [(rng.choice([None, 1, i]), rng.choice([None, url(), url(), url(), "http://hot.b.com/en/", "HTTP://B.com/EN/"])) for i in range(n)] + [(n, "http://" + "a." * 3000 + "com/en/" + "y" * 20_000)]


@pytest.mark.parametrize("stretch", [urlfilter.PER_STRETCH, 20])
def test_url_rules_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(urlfilter, "PER_STRETCH", stretch)
    monkeypatch.setattr(urlfilter, "LEAST_STRETCH", stretch)
    rng = random.Random(8)
    pages = urls(rng, 700)
    rules = [(".".join(rng.choices(["a", "b", "com", "net", "", "x\x01y", "é"], k=rng.randrange(1, 4))), rng.choice(["", "/", "/en", "/en/", "/en/x", "/é"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [("com", "/en/", "allow"), ("com", "/en/", "block"), (None, "/", "block"), ("b", None, "allow"), ("", "", "block")]
    made = with_clashes(spark.createDataFrame(pages, "page_id long, url string").withColumnsRenamed({}))
    ruled = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = urlfilter.judge(made.drop("host", "verdict"), ruled).collect()
    worst = {(h, p): "block" for h, p, v in rules if v == "block"}
    once = [(h, p, worst.get((h, p), v)) for h, p, v in rules]
    wanted = [(i, *judged_by_hand(u, once)) for i, u in pages]
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found), key=str) == sorted(wanted, key=str)


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted(map(str, (tuple(r) for r in urlfilter.judge(pages, none, default="block").collect()))) == sorted(map(str, [(1, "a.net", "/x", None, "block")] * 2 + [(2, "", "", None, "block")]))
    assert urlfilter.judge(pages.where("false"), urlfilter.example_rules(pages)).count() == 0
    with pytest.raises(Exception, match="neither allow nor block"):
        urlfilter.judge(pages, spark.createDataFrame([("net", "/", "maybe")], none.schema)).collect()


@given(st.lists(st.text("ab\x00", max_size=4), max_size=12), st.text("ab\x00", max_size=3))
@settings(deadline=None)
def test_an_interval_holds_all_keys_that_start_with_its_prefix(keys, prefix):
    from bisect import bisect_right

    cuts = sorted({(k, i) for i, k in enumerate(keys)})
    at = urlfilter.interval(cuts, prefix)
    for key in [*keys, prefix, prefix + "a", prefix + "bb\x00", "b"]:
        for salt in (0, 5, 20):
            assert not key.startswith(prefix) or bisect_right(cuts, (key, salt)) in at


# --- what was mended


def rows_of_numbers(rng):
    for digits in range(5, 20):
        for n in (5, 20, 100):
            for between in (" ", ", ", "\n"):
                yield between.join(str(rng.randrange(10 ** (digits - 1), 10**digits)) for _ in range(n))
    for between in (" ", ", ", "\n"):
        yield between.join(f"20{rng.randrange(10, 25)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" for _ in range(50))
        yield between.join(f"{rng.randrange(100, 999)},{rng.randrange(100, 999)}.{rng.randrange(10, 99)}" for _ in range(50))
        yield between.join(f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}" for _ in range(50))
        yield between.join(f"{rng.randrange(10**6)};{rng.randrange(999)};{rng.random():.3f}" for _ in range(50))


@pytest.mark.parametrize("times", [0, 1, 40])
def test_pii_leaves_rows_of_numbers_alone(spark, times):
    """Fitted on no base span, a few and many; alone, and with base spans elsewhere in the text."""
    rng = random.Random(4)
    rows = list(rows_of_numbers(rng))
    texts = [lead + row for row in rows for lead in ("", "Call +12125550147 now, or +1 (415) 555-0123 later. Then came\n", "Mail jane.doe@corp.example.com from 10.0.0.1, card 4111 1111 1111 1111, about ")]
    taught = [f"Ring +1 (415) 555-{i:04} or +1415555{i:04}, mail u{i}@x.example.com, 10.0.{i % 250}.7, card 4111-1111-1111-1111." for i in range(5)] * times
    table = spark.createDataFrame(list(enumerate(texts + taught)), "doc_id long, text string").repartition(8)
    made = pii.find_pii(table).where(F.col("doc_id") < len(texts)).where("n_added > 0").collect()
    assert [(texts[r["doc_id"]][:80], r["spans"][:80]) for r in made] == []


def test_pii_reads_the_word_before_in_full():
    long = ["q" * 60 + "ab", "q" * 60 + "cd", "zq" * 5000]
    marks = {pii.before(f"{w} 123", len(w) + 1) for w in long}
    assert len(marks) == 3 and 0 not in marks
    assert pii.before("word\n123", 5) == 0 and pii.before("123", 0) == 0 and pii.before("x9 123", 3) == 0 and pii.before("no: (123", 5) == pii.before("NO 1", 3)


def test_pipeline_keeps_rows_of_numbers(spark):
    import corpus_pipeline

    text = "Figures " + " ".join(str(393462242 + 7919 * i) for i in range(60))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([text, "Ring +1 (415) 555-0123 or +14155550123."] * 9)], "doc_id long, text string, lang string, source string, n_chars long")
    made = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert made[0] == text and "555" not in made[1]


def test_tasks_stay_few_at_any_size():
    assert ngram_join.block_count(200, 10**13) > MOST_TASKS
    assert packing.range_count(25e12, 200) == MOST_TASKS == urlfilter.stretch_count(10**12, 200) and packing.range_count(10, 8) == 1
    assert topk.MOST_TASKS == MOST_TASKS <= 50_000
