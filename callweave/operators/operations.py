"""What a service decides row by row, as results over tables: deliveries, checkpoints, gates, samples, duties, scans of candidates."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows as R
from . import writes as W
from .states import ordered_fold

# -- deliveries ---------------------------------------------------------------


def deliveries(requests: DataFrame, base_seconds: int, most: int) -> DataFrame:
    """(alert_id, id, outcome, attempts, next_us): what each request to deliver an alert leads to, in order.

    requests: alert_id, id, read_at (when the caller read the alert), at (when it claims it), immediate, result (sent,
    failed, or anything else: the caller was lost). A claim wins if the alert is owed, has attempts left, nobody has claimed it
    since it was read, and, unless it is immediate, its next attempt was due then. A winner counts one attempt and leases
    the alert for base * 2^attempts before, so that a lost caller's alert comes back by itself. A loser is skipped.
    One ordered fold by alert in constant memory; attempts and next_us are those after the request.
    """
    def step(own: dict, row: dict) -> tuple:
        fresh = own["claimed"] is None or own["claimed"] <= row["read_us"]
        due = row["immediate"] or own["next"] is None or own["next"] <= row["read_us"]
        outcome = "skipped"
        if not own["done"] and own["attempts"] < most and fresh and due:
            own["next"] = row["us"] + base_seconds * 1_000_000 * 2 ** min(own["attempts"], 20)
            own["attempts"] += 1
            own["claimed"], own["done"] = row["us"], row["result"] == "sent"
            outcome = {"sent": "delivered", "failed": "failed"}.get(row["result"], "leased")
        return row["alert_id"], row["id"], outcome, own["attempts"], own["next"]

    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = requests.select("alert_id", F.col("id").cast("long").alias("id"), us("read_at").alias("read_us"), us("at").alias("us"), F.coalesce("immediate", F.lit(False)).alias("immediate"), "result")
    schema = f"alert_id {requests.schema['alert_id'].dataType.simpleString()}, id long, outcome string, attempts int, next_us long"
    return ordered_fold(rows, ["alert_id"], ["us", "id"], lambda: {"done": False, "attempts": 0, "next": None, "claimed": None}, step, schema)


def retryable(delivered: DataFrame, now: Column, base_seconds: int, most: int) -> DataFrame:
    """(alert_id, attempts, next_us, lease_us): alerts still owed and due at `now`, and until when a claim now leases them.

    delivered: rows of `deliveries`. The last state of an alert is its greatest next attempt, as leases only grow later.
    """
    state = delivered.groupBy("alert_id").agg(F.max("attempts").alias("attempts"), F.max("next_us").alias("next_us"), F.max(F.col("outcome") == "delivered").alias("done"))
    clock = F.unix_micros(now.cast("timestamp"))
    lease = clock + F.lit(base_seconds * 1_000_000) * F.pow(F.lit(2), F.least("attempts", F.lit(20))).cast("long")
    return state.filter(~F.col("done") & (F.col("attempts") < most) & (F.coalesce("next_us", clock) <= clock)).select("alert_id", "attempts", "next_us", lease.alias("lease_us"))


# -- checkpoints --------------------------------------------------------------

PHASES = ("sweep", "drain")
COUNTERS = {"callsSeen": "calls_seen", "seededTotal": "seeded_total", "terminalCount": "terminal_count"}


def checkpoint_json(phase: Column, watermark_ms: Column, calls_seen: Column, seeded_total: Column, terminal_count: Column) -> Column:
    """A checkpoint as JSON; a watermark that is not there yet is written as null."""
    fields = [F.lit(1).alias("v"), phase.alias("phase"), watermark_ms.alias("watermarkStartedAtMs")]
    return F.to_json(F.struct(*fields, *(x.alias(k) for k, x in zip(COUNTERS, (calls_seen, seeded_total, terminal_count)))), {"ignoreNullFields": "false"})


def decoded(df: DataFrame, raw: str) -> DataFrame:
    """df with the columns of the checkpoint in `raw` and `error`.

    Null text is no checkpoint: nulls and no error. Text that is no JSON is malformed; any other shape than a checkpoint's is
    unrecognised; neither gives a value, so that nothing resumes from a part. Keys beyond those of a checkpoint don't matter.
    """
    v = F.try_parse_json(F.col(raw))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    got = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    number = lambda k: kind(k).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    fits = number("v") & (got("v", "double") == 1) & (kind("phase") == "STRING") & got("phase", "string").isin(*PHASES) & (number("watermarkStartedAtMs") | (kind("watermarkStartedAtMs") == "VOID"))
    for k in COUNTERS:
        fits = fits & number(k) & (got(k, "double") >= 0) & (got(k, "double") == F.floor(got(k, "double")))
    error = F.when(F.col(raw).isNull(), F.lit(None)).when(v.isNull(), "malformed").when(~F.coalesce(fits, F.lit(False)), "unrecognised")
    values = {"phase": got("phase", "string"), "watermark_ms": got("watermarkStartedAtMs", "double").cast("long")} | {name: got(k, "double").cast("long") for k, name in COUNTERS.items()}
    return df.withColumn("error", error.cast("string")).withColumns({n: F.when(F.col("error").isNull(), x) for n, x in values.items()})


# -- gates, samples, duties ---------------------------------------------------


def missing_gates(runs: DataFrame, recorded: DataFrame, key: str, required: Iterable[str], conditional: dict[str, Column]) -> DataFrame:
    """(key, missing, passes): gates that a run lacks, in order of name, joined by a comma; an empty list passes.

    recorded: key, gate. A conditional gate is required of the runs for which its column holds. Of a run's records only the
    asked gates are kept, each once, so a run's list is never longer than theirs.
    """
    asked = sorted({*required, *conditional})
    have = recorded.filter(F.col("gate").isin(*asked)).groupBy(key).agg(F.collect_set("gate").alias("have"))
    wanted = F.filter(F.array(*(F.when(F.coalesce(conditional[g], F.lit(False)), g) if g in conditional and g not in set(required) else F.lit(g) for g in asked)), lambda g: g.isNotNull())
    rows = runs.select(key, wanted.alias("wanted")).join(have, key, "left")
    lacks = F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>")))
    return rows.select(key, F.array_join(lacks, ",").alias("missing"), (F.size(lacks) == 0).alias("passes"))


def sample_reports(calls: DataFrame, reviews: DataFrame, log: DataFrame, records: DataFrame, texts: DataFrame, size: int, guards: dict[str, str]) -> DataFrame:
    """One report for each of the `size` latest calls: state, latest hold, stages that succeeded, record, guarded text.

    guards: category -> pattern; a text that any of them finds is withheld, and only the categories are told. The sample is
    bounded by its size, so it is sent to the scans of the other tables, and each of them keeps a call's rows only.
    """
    sample = calls.orderBy(F.desc("created_at"), F.desc("call_id")).limit(size).select("call_id", "status", "current_stage", "drop_reason")
    few = F.broadcast(sample.select("call_id"))
    of = lambda df: df.join(few, "call_id", "left_semi")
    holds = of(reviews).groupBy("call_id").agg(F.max_by("held_reason", F.struct("created_at", "review_id")).alias("hold_reason"))
    stages = of(log).filter("outcome = 'success'").groupBy("call_id").agg(F.countDistinct("stage").alias("stages"))
    known = of(records).groupBy("call_id").agg(F.lit(True).alias("recorded"))
    hits = F.array_join(F.filter(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in sorted(guards.items()))), lambda x: x.isNotNull()), ",")
    shown = of(texts).groupBy("call_id").agg(F.first("text").alias("text")).select("call_id", hits.alias("found"), F.sha2("text", 256).alias("text_sha256"))
    whole = sample
    for part in (holds, stages, known, shown):
        whole = whole.join(part, "call_id", "left")
    tripped = F.coalesce(F.col("found") != "", F.lit(False))
    return whole.select(
        "call_id", F.col("status").alias("pipeline_status"), "current_stage", "drop_reason", "hold_reason", F.coalesce("stages", F.lit(0)).alias("stages"), F.coalesce("recorded", F.lit(False)).alias("record_present"),
        F.when(~tripped, F.col("text_sha256")).alias("text_sha256"), tripped.alias("guard_tripped"), F.coalesce("found", F.lit("")).alias("guard_categories"),
    )


def duties(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(duty, n, failed, complete, ping): each duty over rows with a boolean `failed`; `ping` only if all are complete.

    Duties don't hang on each other: one that can't be read or throws has nulls and is incomplete, and the others are done.
    """
    found = []
    for name, make in parts.items():
        try:
            n, failed = make().agg(F.count("*"), F.count_if(F.coalesce("failed", F.lit(True)))).first()
            found.append((name, n, failed, failed == 0))
        except Exception as e:  # whatever it says; an incomplete duty is the report
            logging.getLogger(__name__).warning("duty %s failed: %s", name, str(e).splitlines()[0])
            found.append((name, None, None, False))
    ping = all(row[3] for row in found)
    return spark.createDataFrame([(*row, ping) for row in found], "duty string, n long, failed long, complete boolean, ping boolean")


# -- scans of candidates ------------------------------------------------------


def scan_failed(candidates: DataFrame, scans: DataFrame, now: Column) -> DataFrame:
    """Candidates after failed scans: phrases emptied, status, kind, time and counts stamped in one step.

    scans: call_id, kind (null: clean), counts. A failure also overrides an earlier pass; deleted candidates are left alone.
    Of several failures of a call the first by kind, then counts, holds.
    """
    failures = scans.filter("kind IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("kind", "counts")).alias("f"))
    both = candidates.join(failures, "call_id", "left")
    hit = F.col("f").isNotNull() & F.col("soft_deleted_at").isNull() & F.col("hard_deleted_at").isNull()
    new = {"phrases": F.lit("[]"), "status": F.lit("failed"), "failed_at": now, "kind": F.col("f.kind"), "counts": F.col("f.counts")}
    return W.transition(both, hit, **new).select(*candidates.columns)


def scan_passed(candidates: DataFrame, scans: DataFrame) -> DataFrame:
    """Candidates after clean scans: only a pending one passes, so a failure stays until a new candidate comes."""
    dirty = scans.filter("kind IS NOT NULL")
    clean = R.lacking(scans.filter("kind IS NULL"), dirty, ["call_id"])
    live = F.col("soft_deleted_at").isNull() & F.col("hard_deleted_at").isNull()
    return W.update_from(candidates, clean, ["call_id"], live & (F.col("status") == "pending"), status=F.lit("passed"))


# -- texts of alerts ----------------------------------------------------------

#: Columns of a catalogue of failures beside code and severity: sentences, whether data is safe, what becomes of calls, where to read on.
SENTENCES = ("what_broke", "likely_cause", "impact", "remedy_now", "remedy_later")


def alert_texts(alerts: DataFrame, catalog: DataFrame, environment: str, scopes: Iterable[str]) -> DataFrame:
    """(alert_id, text, reason): an alert as lines of plain language, or why it can't be written.

    alerts: alert_id, code, severity, created_at and a column for each scope. Of the scopes only the names of those present
    are told, in the given order, never values. An alert of a code that the catalogue lacks, or with another severity than the
    catalogue's, has a reason instead of a text. A null later remedy is the immediate one. The catalogue is joined as
    any table is: Spark sends it where it is small.
    """
    known = catalog.select("code", F.col("severity").alias("usual"), *SENTENCES, "data_safe", "calls", "runbook")
    rows = alerts.join(known, "code", "left")
    reason = F.when(F.col("usual").isNull(), "unknown code").when(~F.col("severity").eqNullSafe(F.col("usual")), "other severity")
    present = F.filter(F.array(*(F.when(F.col(s).isNotNull(), s) for s in scopes)), lambda s: s.isNotNull())
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = lambda head, x: F.concat(F.lit(f"{head}: "), x)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("["), "severity", F.lit("] "), "code", F.lit(f" in {environment} at "), time),
        line("What broke", F.col("what_broke")),
        line("Likely root cause", F.col("likely_cause")),
        line("Impact", F.col("impact")),
        line("Immediate remediation", F.col("remedy_now")),
        line("Longer-term fix", F.coalesce("remedy_later", F.lit("Same as the immediate step."))),
        line("Customer data safe", F.when(F.col("data_safe"), "yes").otherwise("no")),
        line("Calls", F.col("calls")),
        line("Affected", F.when(F.size(present) > 0, F.array_join(present, ", ")).otherwise("none")),
        line("Runbook", F.col("runbook")),
    )
    return rows.select("alert_id", F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))
