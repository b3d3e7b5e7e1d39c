"""Every match of a pattern, against a plain walk and a regular expression."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators.patterns import Machine, in_order, matches

SCHEMA = "`a key` string, slice int, kind string, n int"


def plain(machine, events):
    """began and ended of each match of events that are (time, kind), in their order."""
    state, began, found = 0, None, []
    for time, kind in events:
        to = machine.moves[state][machine.kinds.index(kind) if kind in machine.kinds else -1]
        began = time if state == 0 and to != 0 else began
        if to == len(machine.moves):
            found.append((began, time))
            to = 0
        state = to
    return found


MACHINES = {
    "in order": in_order(["a", "b", "c"], ["e"]),
    "one step": in_order(["a"]),
    "repeated": in_order(["a", "a", "b", "a"], ["b", "e"]),
    "three b, then no c": Machine(("b", "c"), ((1, 0, 0), (2, 0, 1), (3, 0, 2), (3, 0, 4))),
}


@pytest.mark.parametrize("name", sorted(MACHINES))
@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_matches_are_those_of_a_plain_walk(spark, name, span):
    rng = random.Random(len(name))
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.choice([None, *(rng.randrange(-40, 90) for _ in range(15))]), rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(3)) for _ in range(500)]
    found = matches(spark.createDataFrame(rows, SCHEMA), ["a key"], "slice", "kind", MACHINES[name], lambda t: F.floor(t / span), ["n"])
    assert found.columns == ["a key", "began", "ended"]
    wanted = []
    for key in ("hot", "x", None):
        events = sorted(((t, n, k or "") for k2, t, k, n in rows if k2 == key and t is not None))
        wanted += [(key, *m) for m in plain(MACHINES[name], [(t, k) for t, _, k in events])]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, wanted)) and len(wanted) > 3


def test_matches_are_those_of_a_regular_expression(spark):
    text = "".join(random.Random(3).choices("vcpeo", k=4000))
    rows = spark.createDataFrame(list(enumerate(text)), "t int, kind string")
    found = matches(rows, [], "t", "kind", in_order("vcp", "e"), lambda t: F.floor(t / 100))
    assert sorted(tuple(r) for r in found.collect()) == [(m.start(), m.end() - 1) for m in re.finditer("v[^ce]*c[^pe]*p", text)]


def test_no_rows_no_matches(spark):
    rows = spark.createDataFrame([("x", 1, "a", 0)], SCHEMA)
    for on in ([], ["a key"]):
        assert matches(rows.where("false"), on, "slice", "kind", in_order("a"), lambda t: t).count() == 0
        assert matches(rows, on, "slice", "kind", in_order("ab"), lambda t: t).count() == 0
