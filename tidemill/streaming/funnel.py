"""State by key, with timeouts: a funnel as a machine that events move."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tidemill.sources.tables import event_stream
from tidemill.streaming.windows import DELAY, run_once

STEPS = ("view", "click", "purchase")
STATE = ", ".join(f"{c} array<long>" for c in ("users", "steps", "times", "lasts", "waiting", "held"))  # held: microseconds * len(STEPS) + place in STEPS
BLOCKS = 1 << 12
NEVER = -(1 << 62)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _funnel(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """How far each user of a block came: STEPS in order, each later than the one before.

    Events wait until the watermark has passed them and are then taken in the order
    of their times, so files out of order don't matter. Of a user only the step, the
    time of it, that of the last event and the waiting events are kept. A user without an
    event for over ``idle_ms`` starts anew; a timeout then forgets them. Each step is a row.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users, steps, times, lasts, waiting, held = state.get if state.exists else ([],) * 6
        at, events, mark = dict(zip(users, zip(steps, times, lasts))), list(zip(held, waiting)), state.getCurrentWatermarkMs()
        for frame in frames:
            events += zip(frame["event"].tolist(), frame["user_id"].tolist())
        events.sort()
        due = bisect_left(events, ((mark * 1000 + 1) * len(STEPS),))
        out = []
        for event, user in events[:due]:
            us, kind = divmod(event, len(STEPS))
            step, since, last = at.get(user, (0, NEVER, NEVER))
            if idle_ms is not None and us - last > idle_ms * 1000:
                step, since = 0, NEVER
            if step == kind and us > since:
                step, since = step + 1, us
                out.append((user, step, us))
            at[user] = (step, since, us)
        left, wake = events[due:], []
        if left:  # Timeouts come once the watermark is past them, not at them.
            wake.append(-(-(left[0][0] // len(STEPS)) // 1000) - 1)
        if idle_ms is not None:
            busy = {user for _, user in left}
            ends = {user: last // 1000 + idle_ms for user, (_, _, last) in at.items() if user not in busy}
            at = {user: place for user, place in at.items() if ends.get(user, mark + 1) > mark}
            wake += (end for end in ends.values() if end > mark)
        if at or left:
            places = zip(*((user, *place) for user, place in at.items())) if at else ([],) * 4
            state.update((*map(list, places), [user for _, user in left], [event for event, _ in left]))
            if wake:
                state.setTimeoutTimestamp(min(wake))
        else:
            state.remove()
        if out:
            rows = pd.DataFrame(out, columns=["user_id", "step", "ts"])
            yield rows.assign(ts=pd.to_datetime(rows["ts"], unit="us"))

    return advance


def funnel_steps(events: DataFrame, delay: str = DELAY, idle_ms: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """user_id, step, ts of a stream: each user's steps as the watermark confirms them. Null users and times are left out.

    Users share state by hash in so many blocks, as a call of a group costs milliseconds
    and a user of it microseconds. A block's state is written whole, and a checkpoint
    holds for one number of blocks.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    steps = events.where(F.col("event_type").isin(*STEPS)).dropna(subset=["user_id", "ts"]).withWatermark("ts", delay)
    kind = F.array_position(F.array(*map(F.lit, STEPS)), F.col("event_type")) - 1
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block")
    rows = steps.select(block, "user_id", "ts", (F.unix_micros("ts") * len(STEPS) + kind).alias("event"))
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("step", T.IntegerType()), T.StructField("ts", T.TimestampNTZType())])
    return rows.groupBy("block").applyInPandasWithState(_funnel(idle_ms), schema, STATE, "append", "EventTimeTimeout")


def stream_user_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the farthest step that the watermark confirmed."""
    steps = run_once(funnel_steps(event_stream(spark, sf_dir)), "funnel")
    return steps.groupBy("user_id").agg(F.max("step").alias("step")).groupBy("step").agg(F.count("*").alias("users"))


QUERIES = {f.__name__: f for f in (stream_user_funnel,)}

ORACLE_SQL = {
    "stream_user_funnel": """
WITH s AS (SELECT * FROM events WHERE event_type IN ('view', 'click', 'purchase')),
e AS (SELECT * FROM s WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM s)),
v AS (SELECT user_id, min(ts) AS v FROM e WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT user_id, min(ts) AS c FROM e JOIN v USING (user_id) WHERE event_type = 'click' AND ts > v GROUP BY 1),
p AS (SELECT DISTINCT user_id FROM e JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c)
SELECT CAST(CASE WHEN user_id IN (SELECT user_id FROM p) THEN 3 WHEN user_id IN (SELECT user_id FROM c) THEN 2 ELSE 1 END AS INTEGER) AS step, count(*) AS users FROM v GROUP BY 1""",
}
