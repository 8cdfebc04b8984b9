"""Folds of state: transitions, holds, reviews, alerts, budgets, retention. Each is a CASE, a join, or an ordered fold by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V

def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], tuple], schema: str) -> DataFrame:
    """step(state, row) of each row of a key, in order; start() makes a key's state.

    What a row gives depends on all before it, so a key is one ordered fold; keys run in parallel. Rows arrive sorted and
    are folded batch by batch, so a key of any length needs no more memory than its state.
    """
    target = pa.schema([(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or tuple(row[k] for k in keys) != key:
                    key, state = tuple(row[k] for k in keys), start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# -- pipeline state -----------------------------------------------------------


def stage_rank(stage: Column) -> Column:
    """Place of a stage, 1 to 9; 0 for unknown ones."""
    return F.array_position(F.array(*(F.lit(s) for s in V.STAGES)), stage)


def call_fold(log: DataFrame) -> DataFrame:
    """(call_id, status, stage, at): state of each call after its stage results, in order of (at, id).

    log: call_id, id, at, stage, action (continue, drop, hold, defer). A result counts only while the call is
    processing and sits at that stage; later ones are stale. Sorted rows are folded batch by batch, so a call with any
    number of stage results needs constant memory.
    """
    kind = log.schema["call_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        call, status, rank, since, types = none, "processing", 0, None, None
        for batch in batches:
            types = types or (batch.schema.field("call_id").type, pa.string(), pa.string(), batch.schema.field("at").type)
            out = []
            for c, at, stage, action in zip(*(batch.column(x).to_pylist() for x in ("call_id", "at", "stage", "action"))):
                if call is none or c != call:
                    if call is not none:
                        out.append((call, status, V.STAGES[rank], since))
                    call, status, rank, since = c, "processing", 0, None
                if status == "processing" and stage == V.STAGES[rank] and action not in (None, "defer"):
                    since = at
                status, rank = moved(status, rank, stage, action)
            yield _batch(out, types)
        if call is not none:
            yield _batch([(call, status, V.STAGES[rank], since)], types)

    rows = log.select("call_id", F.col("at").cast("timestamp_ntz").alias("at"), "id", "stage", "action").repartition("call_id").sortWithinPartitions("call_id", "at", "id", "stage", "action")
    return rows.mapInArrow(fold, f"call_id {kind}, status string, stage string, at timestamp_ntz")


def _batch(rows: list[tuple], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["call_id", "status", "stage", "at"])


def moved(status: str, rank: int, stage: str | None, action: str | None) -> tuple[str, int]:
    """Status and stage (from 0) after one result. One of another stage than the call's own, or after the end, does nothing."""
    if status != "processing" or stage != V.STAGES[rank]:
        return status, rank
    if action == "hold":
        return "held", rank
    if action == "drop" and stage in V.SKIP_STAGES:
        return "skipped", rank
    if action == "continue":
        return ("completed", rank) if rank == len(V.STAGES) - 1 else (status, rank + 1)
    return status, rank


def call_moves(results: DataFrame) -> DataFrame:
    """(call_id, status, stage, seq): a row for each stage result that moves its call, in order of seq over all of them.

    results: call_id, seq, stage, action. Sorted rows are folded batch by batch, in constant memory for a call of any length.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, status, rank = (), "processing", 0
        for batch in batches:
            out = []
            for c, seq, stage, action in zip(*(x.to_pylist() for x in batch.columns)):
                if c != call:
                    call, status, rank = c, "processing", 0
                after = moved(status, rank, stage, action)
                if after != (status, rank):
                    status, rank = after
                    out.append((c, status, V.STAGES[rank], seq))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["call_id", "status", "stage", "seq"])

    rows = results.select(F.col("call_id").cast("long"), F.col("seq").cast("long"), "stage", "action")
    return rows.repartition("call_id").sortWithinPartitions("call_id", "seq", "stage", "action").mapInArrow(fold, "call_id long, status string, stage string, seq long")


def wait_state(waits: DataFrame, now: Column, timeout_minutes: int) -> DataFrame:
    """(call_id, wait_started_at, state): first wait stamped once; past the timeout a call is held."""
    first = waits.groupBy("call_id").agg(F.min("at").alias("wait_started_at"), F.max("ready").alias("ready"))
    late = F.col("wait_started_at") <= now - F.expr(f"INTERVAL {timeout_minutes} MINUTES")
    return first.select("call_id", "wait_started_at", F.when(F.col("ready"), "ready").when(late, "held").otherwise("waiting").alias("state"))


def transcript_polls(polls: DataFrame, most_minutes: int, poll_minutes: int) -> DataFrame:
    """(call_id, id, wait_started_at, action, slot): what each poll for a transcript leads to, until one ends the wait.

    polls: call_id, id, at, ready. The wait starts with the first poll that finds nothing and never moves. A poll that finds
    the transcript continues the call; one at or past the longest wait holds it; any other is tried again, in the slot of the
    wait that it lies in. Polls after the end count no more.
    """
    on = Window.partitionBy("call_id").orderBy("at", "id")
    so_far, before = on.rowsBetween(Window.unboundedPreceding, 0), on.rowsBetween(Window.unboundedPreceding, -1)
    waited = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("wait_started_at").cast("timestamp"))
    rows = polls.withColumn("wait_started_at", F.min(F.when(~F.col("ready"), F.col("at"))).over(so_far))
    rows = rows.withColumn("waited", waited).withColumn("ends", F.col("ready") | (F.col("waited") >= most_minutes * 60_000_000))
    rows = rows.withColumn("over", F.coalesce(F.max("ends").over(before), F.lit(False))).filter("NOT over")
    action = F.when(F.col("ready"), "continue").when(F.col("ends"), "hold").otherwise("defer")
    return rows.select("call_id", "id", "wait_started_at", action.alias("action"), F.when(action == "defer", F.floor(F.col("waited") / (poll_minutes * 60_000_000)).cast("long")).alias("slot"))


def replay_guard(requests: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """(keys, id, kind, acquired): reservations of a key in order; requests: keys, id, kind (reserve, commit, release), at.

    A reservation is acquired if no other holds the key; it holds it for so many minutes. Its commit holds the key for as long
    again from then on, its release frees it at once unless it is committed. A commit or release of one that does not hold
    the key does nothing.
    """
    kinds = {k: requests.schema[k].dataType.simpleString() for k in keys}
    ttl = minutes * 60_000_000

    def step(held: dict, row: dict) -> tuple:
        acquired = row["kind"] == "reserve" and (held["by"] is None or held["until"] <= row["us"])
        own = held["by"] is not None and held["by"] == row["id"]
        if acquired:
            held |= {"by": row["id"], "until": row["us"] + ttl, "committed": False}
        elif row["kind"] == "commit" and own:
            held |= {"until": row["us"] + ttl, "committed": True}
        elif row["kind"] == "release" and own and not held["committed"]:
            held["by"] = None
        return *(row[k] for k in keys), row["id"], row["kind"], acquired

    step_order = F.array_position(F.array(F.lit("reserve"), F.lit("commit"), F.lit("release")), F.col("kind"))
    rows = requests.select(*keys, F.col("id").cast("long").alias("id"), "kind", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), step_order.alias("step"))
    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), "id long, kind string, acquired boolean"])
    return ordered_fold(rows, keys, ["us", "id", "step"], lambda: {"by": None, "until": 0, "committed": False}, step, schema)


# -- reviews and alerts -------------------------------------------------------


def action_matrix(df: DataFrame) -> DataFrame:
    """(held_reason, action) pairs that are allowed, as a small fixed table."""
    rows = [(r, a) for r in V.HELD_REASONS for a in V.allowed_actions(r)]
    return df.sparkSession.createDataFrame(rows, "held_reason string, action string")


def sla_breaches(reviews: DataFrame, now: Column, escalated: DataFrame) -> DataFrame:
    """Active reviews past their due time that have no escalation yet."""
    late = reviews.filter(F.col("status").isin("open", "in_review") & (F.col("sla_due_at") <= now))
    return late.join(escalated.select("review_id").distinct(), "review_id", "left_anti")


def first_open_alert(alerts: DataFrame) -> DataFrame:
    """Alerts that open a new incident of their dedup key: no unacknowledged alert of it stood before them."""
    before = Window.partitionBy("dedup_key").orderBy("created_at", "alert_id").rowsBetween(Window.unboundedPreceding, -1)
    # an earlier alert still stands unless it was acknowledged by now; one that never was stands for ever
    standing = F.max(F.coalesce("acknowledged_at", F.lit("9999-12-31").cast("timestamp_ntz"))).over(before)
    return alerts.withColumn("_s", standing).filter(F.col("_s").isNull() | (F.col("_s") <= F.col("created_at"))).drop("_s")


def stale_critical(alerts: DataFrame, now: Column, window_minutes: int) -> DataFrame:
    old = F.col("created_at") <= now - F.expr(f"INTERVAL {window_minutes} MINUTES")
    return alerts.filter((F.col("severity") == "critical") & F.col("acknowledged_at").isNull() & old & ~F.col("dedup_key").startswith("escalation:"))


def health(last_seen: Column, now: Column, degraded_minutes: int, broken_minutes: int) -> Column:
    age = lambda m: now - F.expr(f"INTERVAL {m} MINUTES")
    return F.when(last_seen.isNull(), "unknown").when(last_seen < age(broken_minutes), "broken").when(last_seen < age(degraded_minutes), "degraded").otherwise("healthy")


# -- budget -------------------------------------------------------------------


def budget_fold(requests: DataFrame, cap: float, warn_ratio: float = 0.8) -> DataFrame:
    """(day, id, amount, accepted, spent, warned): reservations of a day in order, each refused if it would pass the cap.

    Whether one is accepted depends on what was accepted before, so a day is one ordered fold; days run in parallel.
    Rows arrive sorted and are folded batch by batch, so a day of any length needs constant memory.
    """
    limit, warn = Decimal(str(cap)), Decimal(str(cap)) * Decimal(str(warn_ratio))
    six = Decimal("0.000001")

    def fold(frames):
        day, spent = None, Decimal(0)
        for pdf in frames:
            out = []
            for d, i, amount in zip(pdf["day"], pdf["id"], pdf["amount"]):
                if d != day:
                    day, spent = d, Decimal(0)
                amount = amount.quantize(six, ROUND_HALF_UP)
                ok = spent + amount <= limit
                spent += amount if ok else 0
                out.append((d, i, amount, ok, spent.quantize(six), bool(ok and spent >= warn)))
            yield pd.DataFrame(out, columns=["day", "id", "amount", "accepted", "spent", "warned"])

    ordered = requests.select("day", "id", F.col("amount").cast("decimal(12,6)").alias("amount"), "at").repartition("day").sortWithinPartitions("day", "at", "id").drop("at")
    return ordered.mapInPandas(fold, f"day {requests.schema['day'].dataType.simpleString()}, id long, amount decimal(12,6), accepted boolean, spent decimal(18,6), warned boolean")


def budget_ledger(moves: DataFrame, cap: float, warn_ratio: float = 0.8) -> DataFrame:
    """(day, id, kind, result, spent, warned): reservations of a day and what becomes of them, in order.

    moves: day, id (of the reservation), kind (reserve, settle, release), amount, at. A reservation that would pass the cap
    is refused. Settling puts the actual amount in place of the reserved one, releasing takes it back; either does nothing
    (`ignored`) for one that was refused or is no longer outstanding. State: what is spent, and the outstanding reservations.
    """
    limit, six = Decimal(str(cap)), Decimal("0.000001")
    warn = limit * Decimal(str(warn_ratio))

    def step(day: dict, row: dict) -> tuple:
        amount, warned = row["amount"].quantize(six, ROUND_HALF_UP), False
        if row["kind"] == "reserve":
            result = "reserved" if day["spent"] + amount <= limit and row["id"] not in day["open"] else "refused"
            if result == "reserved":
                day["open"][row["id"]] = amount
                day["spent"] += amount
                warned = day["spent"] >= warn
        elif (held := day["open"].pop(row["id"], None)) is None:
            result = "ignored"
        else:
            result = {"settle": "settled", "release": "released"}[row["kind"]]
            day["spent"] += (amount if row["kind"] == "settle" else 0) - held
        return row["day"], row["id"], row["kind"], result, day["spent"].quantize(six), warned

    step_order = F.array_position(F.array(F.lit("reserve"), F.lit("settle"), F.lit("release")), F.col("kind"))
    rows = moves.select("day", F.col("id").cast("long").alias("id"), "kind", F.col("amount").cast("decimal(18,6)").alias("amount"), "at", step_order.alias("step"))
    schema = f"day {moves.schema['day'].dataType.simpleString()}, id long, kind string, result string, spent decimal(18,6), warned boolean"
    return ordered_fold(rows, ["day"], ["at", "id", "step"], lambda: {"spent": Decimal(0), "open": {}}, step, schema)


def dual_window(requests: DataFrame, key: str, short_s: int, per_short: int, long_s: int, per_long: int) -> DataFrame:
    """(key, id, admitted, wait_ms): requests of a key under two fixed windows at once; requests: key, id, at.

    One is admitted if both windows have room, and counts in both; a refused one counts in neither and is told how long it
    is until both that are full roll over. The long window holds whole short ones, so each is a fold of its own and a key that
    sends for long is dealt over all tasks.
    """
    if long_s % short_s:
        raise ValueError("the long window must hold whole short ones")
    short, long = short_s * 1_000_000, long_s * 1_000_000

    def step(held: dict, row: dict) -> tuple:
        window = row["us"] // short
        if window != held["window"]:
            held |= {"window": window, "short": 0}
        waits = [(window + 1) * short - row["us"]] * (held["short"] >= per_short) + [(row["long"] + 1) * long - row["us"]] * (held["long"] >= per_long)
        if not waits:
            held["short"] += 1
            held["long"] += 1
        return row[key], row["id"], not waits, -(-max(waits, default=0) // 1000)

    us = F.unix_micros(F.col("at").cast("timestamp"))
    rows = requests.select(key, F.col("id").cast("long").alias("id"), us.alias("us"), F.floor(us / long).cast("long").alias("long"))
    return ordered_fold(rows, [key, "long"], ["us", "id"], lambda: {"window": None, "short": 0, "long": 0}, step, f"`{key}` {requests.schema[key].dataType.simpleString()}, id long, admitted boolean, wait_ms long")


def guarded_adjust(changes: DataFrame) -> DataFrame:
    """(key, id, applied, total): changes of a key in order, each refused if the total would fall below zero.

    Folded like budget_fold: sorted rows, batch by batch, constant memory for a key of any length.
    """
    def fold(frames):
        key, total = None, Decimal(0)
        for pdf in frames:
            out = []
            for k, i, delta in zip(pdf["key"], pdf["id"], pdf["delta"]):
                if k != key:
                    key, total = k, Decimal(0)
                ok = total + delta >= 0
                total += delta if ok else 0
                out.append((k, i, ok, total))
            yield pd.DataFrame(out, columns=["key", "id", "applied", "total"])

    ordered = changes.select("key", "id", F.col("delta").cast("decimal(18,6)").alias("delta"), "at").repartition("key").sortWithinPartitions("key", "at", "id").drop("at")
    return ordered.mapInPandas(fold, f"key {changes.schema['key'].dataType.simpleString()}, id long, applied boolean, total decimal(18,6)")


# -- retention ----------------------------------------------------------------


def retention_action(now: Column, soft_days: int, hard_days: int) -> Column:
    """soft_delete, hard_delete or null for a row with the retention columns."""
    ago = lambda d: now - F.expr(f"INTERVAL {d} DAYS")
    eligible, soft, hard = F.col("retention_eligible_at"), F.col("soft_deleted_at"), F.col("hard_deleted_at")
    return F.when((eligible <= ago(soft_days)) & soft.isNull(), "soft_delete").when((eligible <= ago(hard_days)) & (soft <= ago(hard_days - soft_days)) & hard.isNull(), "hard_delete")


def coupled_retention(parent: DataFrame, child: DataFrame, blocked: DataFrame, now: Column, soft_days: int, hard_days: int) -> DataFrame:
    """(side, call_id, row_id, action): what one pass does to parents, their children and orphans.

    Blocked calls keep everything. Children follow their parent's action. A parent waits with its hard delete until
    no child row is still inside the grace period.
    """
    grace = hard_days - soft_days
    act = retention_action(now, soft_days, hard_days)
    free = lambda df: df.join(blocked.select("call_id").distinct(), "call_id", "left_anti")
    fresh = child.filter(F.col("hard_deleted_at").isNull() & (F.col("soft_deleted_at").isNull() | (F.col("soft_deleted_at") > now - F.expr(f"INTERVAL {grace} DAYS")))).select("call_id").distinct().withColumn("_wait", F.lit(True))
    p = free(parent).withColumn("action", act).filter("action IS NOT NULL").join(fresh, "call_id", "left")
    p = p.filter((F.col("action") == "soft_delete") | F.col("_wait").isNull()).select("call_id", F.col("row_id").cast("long").alias("row_id"), "action")
    by_parent = p.select("call_id", "action").distinct()
    open_ = F.when(F.col("action") == "soft_delete", F.col("soft_deleted_at").isNull()).otherwise(F.col("hard_deleted_at").isNull())
    kids = child.join(by_parent, "call_id").filter(open_).select("call_id", F.col("row_id").cast("long").alias("row_id"), "action")
    orphans = free(child).join(parent.select("call_id").distinct(), "call_id", "left_anti").withColumn("action", act).filter("action IS NOT NULL").select("call_id", F.col("row_id").cast("long").alias("row_id"), "action")
    side = lambda df, name: df.select(F.lit(name).alias("side"), "call_id", "row_id", "action")
    return side(p, "parent").unionByName(side(kids, "child")).unionByName(side(orphans, "orphan"))


# -- evaluation ---------------------------------------------------------------


def accuracy(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, correct, accuracy) of expected against predicted, null-safe."""
    hit = F.count_if(F.col("expected").eqNullSafe(F.col("predicted")))
    return pairs.groupBy(*groups).agg(F.count("*").alias("n"), hit.alias("correct"), F.round(hit / F.count("*"), 6).alias("accuracy"))


def run_status(total: Column, evaluated: Column, stop_reason: Column) -> Column:
    """complete, partial (stopped after some), or skipped (nothing to do, or stopped before the first)."""
    return F.when(total == 0, "skipped").when(stop_reason.isNull(), "complete").when(evaluated == 0, "skipped").otherwise("partial")
