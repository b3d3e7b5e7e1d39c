"""Patterns over ordered events: a finite automaton for each key, whose rows may lie in many tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Machine(NamedTuple):
    """moves[state][kind's place in kinds] is the next state; the last place stands for all other kinds and null.

    State 0 is the first. A move to the state len(moves) is a match, after which the
    machine is in state 0 again, so matches don't overlap.
    """

    kinds: tuple[str, ...]
    moves: tuple[tuple[int, ...], ...]


def in_order(steps: Sequence[str], resets: Sequence[str] = ()) -> Machine:
    """A machine for kinds that follow one another, others between them or not; a kind of ``resets`` that isn't awaited starts it anew."""
    kinds = tuple(dict.fromkeys([*steps, *resets]))
    return Machine(kinds, tuple((*(at + 1 if kind == step else 0 if kind in resets else at for kind in kinds), at) for at, step in enumerate(steps)))


def walk(moves: Sequence[Sequence[int]], codes: Sequence[int], state: int) -> tuple[int, int, list[tuple[int, int]]]:
    """The state behind the codes, where the machine last left state 0 (-1: not here), and the matches' (left, end)."""
    left, found = -1, []
    for i, code in enumerate(codes):
        to = moves[state][code]
        if state == 0 and to != 0:
            left = i
        if to == len(moves):
            found.append((left, i))
            to = 0
        state = to
    return state, left, found


def matches(rows: DataFrame, on: Sequence[str], time: str, kind: str, machine: Machine, slices: Callable[[Column], Column], order: Sequence[str] = ()) -> DataFrame:
    """on..., began, ended: every match of the machine over each key's rows in the order of time, ``order`` and kind.

    began is the time at which the machine last left its first state. Null keys are a
    key of their own; rows without a time have no place; repeated rows count each.

    ``slices`` says what part of time a time lies in (``F.to_date``, say), never falling
    as time goes on. A task walks the rows of one key and slice, first from every state,
    as it doesn't know yet where the key's earlier slices leave the machine. What
    a slice does to each state is one short row; those of a key are put one behind the other,
    and each slice is walked once more from the state that it then starts in. So a key
    of very many rows takes many tasks, and memory for a slice's rows and a key's slices.
    """
    moves, last = machine.moves, len(machine.kinds)
    keys = [f"key {i}" for i in range(len(on))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]

    @F.pandas_udf("struct<states:array<int>,lefts:array<int>>")
    def moved(codes: pd.Series) -> pd.DataFrame:
        ends = [[walk(moves, run, s)[:2] for s in range(len(moves))] for run in (c.tolist() for c in codes)]
        return pd.DataFrame({"states": [[e[0] for e in run] for run in ends], "lefts": [[e[1] for e in run] for run in ends]})

    @F.pandas_udf("array<struct<state:int,place:int,start:int>>")
    def entered(each: pd.Series, lefts: pd.Series) -> pd.Series:
        """For each slice of a key its first state, and in which slice, walked from which state, that was begun."""
        out = []
        for states, left in zip(each, lefts, strict=True):
            here, run = (0, -1, -1), []
            for j in range(len(states)):
                run.append(dict(zip(("state", "place", "start"), here, strict=True)))
                s = here[0]
                here = (int(states[j][s]), j, s) if left[j][s] >= 0 else (int(states[j][s]), *here[1:])
            out.append(run)
        return pd.Series(out)

    @F.pandas_udf("array<struct<left:int,at:int>>")
    def found(codes: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([[{"left": a, "at": b} for a, b in walk(moves, c.tolist(), s)[2]] for c, s in zip(codes, state, strict=True)])

    code = reduce(lambda e, i: e.when(F.col(f"`{kind}`") == machine.kinds[i], i), range(last), F.when(F.lit(False), last)).otherwise(last)
    cut = rows.select(*named, F.struct(F.col(f"`{time}`").alias("time"), *(F.col(f"`{c}`").alias(f"by {i}") for i, c in enumerate(order)), F.col(f"`{kind}`").alias("kind"), code.alias("code")).alias("row"))
    cut = cut.where("row.time IS NOT NULL").withColumn("slice", slices(F.col("row.time")))
    runs = cut.groupBy(*keys, "slice").agg(F.sort_array(F.collect_list("row")).alias("run"))
    runs = runs.select(*keys, "slice", F.col("run.time").alias("times"), F.col("run.code").alias("codes"))

    ends = runs.withColumn("end", moved("codes"))
    ends = ends.select(*keys, F.struct("slice", "end.states", "end.lefts", F.transform("end.lefts", lambda i: F.get("times", i)).alias("begun")).alias("end"))
    # An aggregate of no keys has a row where there is nothing.
    lines = ends.groupBy(*keys).agg(F.sort_array(F.collect_list("end")).alias("ends")).where(F.size("ends") > 0)
    lines = lines.withColumn("starts", entered(F.col("ends.states"), F.col("ends.lefts")))
    begun = lambda start: F.get(F.get("ends", start["place"])["begun"], start["start"])
    starts = F.transform("starts", lambda start, j: F.struct(F.get("ends", j)["slice"].alias("slice"), start["state"].alias("state"), begun(start).alias("begun")))
    starts = lines.select(*(F.col(k).alias(f"of {k}") for k in keys), F.explode(starts).alias("start"))

    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"of {k}")) for k in keys), F.col("slice") == F.col("start.slice"))
    walked = runs.join(starts, same).withColumn("found", found("codes", "start.state"))
    ended = F.transform("found", lambda x: F.struct(F.coalesce(F.get("times", x["left"]), F.col("start.begun")).alias("began"), F.get("times", x["at"]).alias("ended")))
    return walked.select(*(F.col(k).alias(c) for k, c in zip(keys, on, strict=True)), F.explode(ended).alias("match")).select(*(F.col(f"`{c}`") for c in on), "match.*")
