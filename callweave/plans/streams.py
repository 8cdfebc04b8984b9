"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import states as S
from ..streaming import flows as X
from .flows import fold_sql
from .registry import query

c = F.col


def _events(t):
    return X.events(t.spark, t.sf_dir)


query("stream_dedup", "SELECT event_id FROM events")(lambda t: X.first_within(X.drain(_events(t).select("event_id", "at"), "dedup"), ["event_id"], 5).select("event_id"))
# a key that recurs: each user's events of a type, once a day at most
query(
    "stream_dedup_users",
    """
, z AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
kept AS (SELECT event_id, user_id, event_type, n, true AS keep, ts AS since FROM z WHERE n = 1
  UNION ALL SELECT z.event_id, z.user_id, z.event_type, z.n, z.ts >= k.since + INTERVAL 1 DAYS, CASE WHEN z.ts >= k.since + INTERVAL 1 DAYS THEN z.ts ELSE k.since END
  FROM kept k JOIN z ON z.user_id = k.user_id AND z.event_type = k.event_type AND z.n = k.n + 1)
SELECT event_id FROM kept WHERE keep""",
)(lambda t: X.first_within(X.drain(_events(t).select("event_id", "user_id", "event_type", "at"), "dedup"), ["user_id", "event_type"], 24 * 60, ["event_id"]).select("event_id"))
query("stream_rates", "SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2")(lambda t: X.rates(X.drain(_events(t).select("user_id", "at"), "rates"), "user_id", {"1 minute": 1})["1 minute"])
query(
    "stream_states",
    fold_sql(
        "SELECT user_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id AS seq, ts AS at, event_id % 9 AS stage, "
        "CASE WHEN value > 200 THEN 'hold' WHEN value > 150 THEN 'drop' ELSE 'continue' END AS action FROM events"
    )
    + f"SELECT call_id, status, {list(V.STAGES)}[rank + 1] AS stage, seq FROM f WHERE moved",
)(
    lambda t: S.call_moves(
        X.drain(
            _events(t).select(
                c("user_id").alias("call_id"), c("event_id").alias("seq"), F.element_at(F.array(*(F.lit(s) for s in V.STAGES)), (F.pmod(c("event_id"), F.lit(9)) + 1).cast("int")).alias("stage"),
                F.when(c("value") > 200, "hold").when(c("value") > 150, "drop").otherwise("continue").alias("action"),
            ),
            "states",
        )
    )
)

#: All files at once: the first watermark is the last event's time, so no event is late and every wait that ends is told.
WHOLE = 1_000_000
query(
    "stream_waits",
    """
, p AS (SELECT user_id AS call_id, ts AS "at", event_type = 'error' AND value > 100 AS ready FROM events),
w AS (SELECT call_id, epoch_us(min("at") FILTER (WHERE NOT ready)) + 259200000000 AS due, epoch_us(min("at") FILTER (WHERE ready)) AS found FROM p GROUP BY call_id),
e AS (SELECT call_id, CASE WHEN found IS NOT NULL AND (due IS NULL OR found < due) THEN 'ready' ELSE 'held' END AS state, CASE WHEN found IS NOT NULL AND (due IS NULL OR found < due) THEN found ELSE due END AS at_us FROM w)
SELECT call_id, state, at_us FROM e WHERE at_us <= (SELECT max(epoch_us("at")) FROM p)""",
)(
    lambda t: X.drain(
        X.settled_waits(X.events(t.spark, t.sf_dir, WHOLE).select(c("user_id").alias("call_id"), "at", ((c("event_type") == "error") & (c("value") > 100)).alias("ready")), 3 * 24 * 60), "waits", timers=True
    )
)
