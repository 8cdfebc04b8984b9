"""Scans, filters, joins, aggregates, latest-wins, paging and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import redaction as X
from ..operators import rows as R
from ..sources import readers
from .registry import at, query
from .standins import NOW, RETENTION_NOW, Tables

TS = f"TIMESTAMP '{NOW}'"
c = F.col
LIVE = "soft_deleted_at IS NULL AND hard_deleted_at IS NULL"

# -- scans ----------------------------------------------------------------------

query("src_01", "SELECT call_id, status, current_stage FROM call_state WHERE duration > 100")(lambda t: t.spark.sql("SELECT call_id, status, current_stage FROM {cs} WHERE duration > :least", args={"least": 100}, cs=t.call_state))
query("src_02", "SELECT * FROM call_state WHERE call_id = 4242 OR call_id = 707")(lambda t: t.call_state.filter(c("call_id").isin(4242, 707)))
query("src_03", f"SELECT call_id, row_id FROM raw_transcripts WHERE {LIVE}")(lambda t: R.live(t.raw_transcripts).select("call_id", "row_id"))
# payloads of conversations: a plain text, one that is not there yet, a flat transcript, and lines of which system turns are moments
_SAID = "string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text)"
_LINED = "string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) FILTER (WHERE role <> 'system' AND text IS NOT NULL)"


def _payloads(t: Tables):
    line = F.struct(c("text").alias("content"), F.when(c("role") == "system", "moment").otherwise("line").alias("type"), c("role").alias("name"))
    whole = t.turns.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("x"))
    said, kind = F.array_join(F.transform("x.text", lambda s: F.coalesce(s, F.lit(""))), "\n"), c("call_id") % 5
    return whole.select("call_id", F.when(kind == 0, said).when(kind == 1, F.to_json(F.struct(F.lit("pending").alias("status")))).when(kind == 2, F.to_json(F.struct(said.alias("transcript")))).otherwise(F.to_json(F.struct(F.col("x.line").alias("lines")))).alias("raw"))


query("src_05", f"SELECT call_id, CASE call_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'not_ready' WHEN 2 THEN CASE WHEN {_SAID} <> '' THEN 'ready' ELSE 'not_ready' END ELSE 'ready' END AS state FROM turns GROUP BY call_id")(
    lambda t: _payloads(t).select("call_id", readers.transcript_state(c("raw")).alias("state"))
)
query("src_06", "SELECT event_id, event_id * 1000 + 7 AS ms FROM events")(lambda t: t.events.select("event_id", C.epoch_ms((c("event_id") * 1000 + 7).cast("string")).alias("ms")))
query("src_08", "SELECT event_id, json_extract_string(props, '$.k') AS v FROM events")(lambda t: t.events.select("event_id", C.present_scalar(c("props"), ["$.call.id", "$.call_id", "$.k"]).alias("v")))
query("src_12", f"SELECT call_id, CASE call_id % 5 WHEN 1 THEN '{{\"status\":\"pending\"}}' WHEN 0 THEN {_SAID} WHEN 2 THEN {_SAID} ELSE {_LINED} END AS text FROM turns GROUP BY call_id")(
    lambda t: _payloads(t).select("call_id", readers.transcript_text(c("raw")).alias("text"))
)

# -- filters ----------------------------------------------------------------------

_SEARCH = "created_at >= TIMESTAMP '1996-01-01 00:00:00' AND created_at < TIMESTAMP '1998-01-01 00:00:00' AND urgency = '1-URGENT' AND superseded_by_call_id IS NULL"


def _search(t: Tables) -> DataFrame:
    where = R.search_filter({"urgency": "1-URGENT", "call_intent": ""}, start="1996-01-01", end="1997-12-31", null_cols=["superseded_by_call_id"])
    return t.structured_knowledge.filter(where)


query("flt_01", f"SELECT call_id, service_category, created_at FROM structured_knowledge WHERE {_SEARCH}")(lambda t: _search(t).select("call_id", "service_category", "created_at"))
query(
    "flt_02",
    "SELECT call_id, problem_statement FROM structured_knowledge WHERE superseded_by_call_id IS NULL AND (problem_statement ILIKE '%00000099%' OR list_bool_or([lang1 ILIKE '%house%', lang2 ILIKE '%house%']))",
)(
    lambda t: t.structured_knowledge.withColumn("langs", F.array("lang1", "lang2")).filter(c("superseded_by_call_id").isNull())
    .filter(R.search_filter(text="00000099", text_cols=["problem_statement"], array_cols=["langs"]) | R.search_filter(text="House", text_cols=["problem_statement"], array_cols=["langs"])).select("call_id", "problem_statement")
)
_LATEST_FB = "SELECT *, row_number() OVER (PARTITION BY call_id, field_path, reviewer ORDER BY created_at DESC, id DESC) AS n FROM note_feedback"
query(
    "flt_03",
    f"SELECT tn.call_id FROM technician_notes tn WHERE scope_signal = 'F' AND EXISTS (SELECT 1 FROM ({_LATEST_FB}) f WHERE f.n = 1 AND f.call_id = tn.call_id AND f.verdict <> 'correct')",
)(lambda t: R.having(t.technician_notes.filter("scope_signal = 'F'"), R.latest(t.note_feedback, ["call_id", "field_path", "reviewer"], ["created_at", "id"]).filter("verdict <> 'correct'"), ["call_id"]).select("call_id"))
_HELD = "SELECT call_id, held_reason FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY created_at DESC, review_id DESC) AS n FROM review_queue) AS y WHERE n = 1"


def _with_hold(t: Tables) -> DataFrame:
    return t.call_state.join(R.latest_value(t.review_queue, ["call_id"], "held_reason", ["created_at", "review_id"]), "call_id", "left")


query(
    "flt_04",
    f"SELECT cs.call_id, status, rq.held_reason FROM call_state cs LEFT JOIN ({_HELD}) rq USING (call_id) WHERE (cs.status = 'held' AND rq.held_reason IS DISTINCT FROM 'classified_spam') OR (cs.status = 'skipped' AND cs.drop_reason IS DISTINCT FROM 'classified_non_customer')",
)(lambda t: _with_hold(t).filter(C.outcome_filter("held", c("status"), c("drop_reason"), c("held_reason")) | C.outcome_filter("filtered", c("status"), c("drop_reason"), c("held_reason"))).select("call_id", "status", "held_reason"))
query("flt_05", "SELECT count(*) AS n FROM structured_knowledge WHERE created_at >= TIMESTAMP '1996-02-28 00:00:00' AND created_at < TIMESTAMP '1996-03-01 00:00:00'")(
    lambda t: t.structured_knowledge.filter(R.search_filter(start="1996-02-28", end="1996-02-29")).agg(F.count("*").alias("n"))
)
_PRE = "CASE WHEN duration <= 5 THEN 'zero_duration' WHEN lower(state) IN ('missed', 'busy') THEN 'non_conversation_call_state' WHEN duration - 5 <= 10 THEN 'below_minimum_duration' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'internal_transfer_non_operator_leg' WHEN k % 3 = 0 AND k % 5 = 0 THEN 'outbound_no_customer_conversation' END"
query("flt_07", f"SELECT call_id, {_PRE} AS drop_reason FROM (SELECT call_id, duration, k, CASE WHEN k % 11 = 0 THEN 'Missed' WHEN k % 13 = 0 THEN 'busy' ELSE 'ended' END AS state FROM call_state) AS x")(
    lambda t: t.call_state.select(
        "call_id",
        C.prefilter(c("duration") - 5, F.when(c("k") % 11 == 0, "Missed").when(c("k") % 13 == 0, "busy").otherwise("ended"), c("k") % 3 == 0, c("call_id") + F.when(c("k") % 2 == 0, 1).otherwise(0),
                    F.when(c("k") % 5 == 0, "Outbound").otherwise("inbound"), c("call_id"), ("missed", "no_answer", "failed", "busy", "canceled", "abandoned", "rejected"), 10).alias("drop_reason"),
    )
)
_MEMBER = "CASE WHEN updated_at >= TIMESTAMP '2024-01-10 00:00:00' AND updated_at < TIMESTAMP '2024-01-12 00:00:00' THEN 'inside' WHEN status <> 'processing' AND created_at < TIMESTAMP '2024-01-12 00:00:00' THEN 'started' ELSE 'outside' END"
query("flt_08", f"SELECT call_id, {_MEMBER} AS membership FROM call_state")(
    lambda t: t.call_state.select("call_id", F.when((c("updated_at") >= at("2024-01-10 00:00:00")) & (c("updated_at") < at("2024-01-12 00:00:00")), "inside").when((c("status") != "processing") & (c("created_at") < at("2024-01-12 00:00:00")), "started").otherwise("outside").alias("membership"))
)
query("flt_09", f"SELECT call_id FROM call_state WHERE CASE WHEN status = 'completed' THEN updated_at >= TIMESTAMP '2024-01-10 00:00:00' AND updated_at <= {TS} ELSE status <> 'processing' END")(
    lambda t: t.call_state.filter(F.when(c("status") == "completed", (c("updated_at") >= at("2024-01-10 00:00:00")) & (c("updated_at") <= at())).otherwise(c("status") != "processing")).select("call_id")
)
query("flt_10", f"SELECT review_id FROM review_queue WHERE status IN ('open', 'in_review') AND raw_purged_at IS NULL AND created_at + INTERVAL 72 HOURS < {TS}")(
    lambda t: t.review_queue.filter(c("status").isin("open", "in_review") & c("raw_purged_at").isNull() & (c("created_at") + F.expr("INTERVAL 72 HOURS") < at())).select("review_id")
)
query("flt_11", f"SELECT count(*) AS n FROM call_state WHERE status = 'completed' AND updated_at >= TIMESTAMP '2024-01-05 00:00:00' AND updated_at < {TS}")(
    lambda t: t.call_state.filter((c("status") == "completed") & (c("updated_at") >= at("2024-01-05 00:00:00")) & (c("updated_at") < at())).agg(F.count("*").alias("n"))
)
query("flt_12", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ms FROM events")(lambda t: t.events.select("event_id", C.duration_ms(c("props"), "$.k").alias("ms")))
query("flt_13", "SELECT call_id, created_at FROM technician_notes")(lambda t: t.technician_notes.select("call_id", "created_at"))

# -- joins ----------------------------------------------------------------------

query("jn_01", "SELECT tn.call_id, tn.prompt_version, sk.urgency FROM technician_notes tn JOIN structured_knowledge sk USING (call_id) WHERE sk.superseded_by_call_id IS NULL")(
    lambda t: t.technician_notes.join(t.structured_knowledge.filter("superseded_by_call_id IS NULL"), "call_id").select("call_id", "prompt_version", "urgency")
)
query("jn_02", "SELECT count(*) AS n FROM alert_events ae JOIN call_state cs ON ae.call_id = cs.call_id WHERE ae.acknowledged_at IS NULL AND cs.status = 'completed'")(
    lambda t: t.alert_events.filter("acknowledged_at IS NULL").withColumn("snapshot", F.to_json(F.struct(F.struct("call_id").alias("context"))))
    .join(t.call_state.filter("status = 'completed'").select(c("call_id").cast("string").alias("id")), F.get_json_object("snapshot", "$.context.call_id") == c("id")).agg(F.count("*").alias("n"))
)
query("jn_03", "SELECT count(*) AS n FROM alert_events ae JOIN review_queue rq ON ae.dedup_key = concat('alert:user:', CAST(rq.review_id AS VARCHAR)) WHERE rq.status IN ('resolved', 'unresolvable')")(
    lambda t: t.alert_events.join(t.review_queue.filter("status IN ('resolved', 'unresolvable')").select("review_id"), c("dedup_key") == F.concat(F.lit("alert:user:"), c("review_id").cast("string"))).agg(F.count("*").alias("n"))
)
query("jn_04", "SELECT oa.action_id, oa.action, rq.held_reason FROM operator_actions oa JOIN review_queue rq ON rq.call_id = oa.call_id * 100 + oa.k WHERE oa.action IN ('approve', 'reject')")(
    lambda t: t.operator_actions.filter(c("action").isin("approve", "reject")).withColumn("full_id", c("call_id") * 100 + c("k")).drop("call_id").join(t.review_queue.select(c("call_id").alias("full_id"), "held_reason"), "full_id").select("action_id", "action", "held_reason")
)
query("jn_05", "SELECT sk.call_id, tn.prompt_version FROM structured_knowledge sk LEFT JOIN technician_notes tn USING (call_id) WHERE tn.call_id IS NULL OR tn.prompt_version <> 'N'")(
    lambda t: t.structured_knowledge.join(t.technician_notes.withColumn("has", F.lit(1)), "call_id", "left").filter(c("has").isNull() | (c("prompt_version") != "N")).select("call_id", "prompt_version")
)
query("jn_06", "SELECT count(*) AS n FROM structured_knowledge sk LEFT JOIN technician_notes tn USING (call_id) WHERE call_intent IN ('F', 'P') AND (tn.call_id IS NULL OR tn.prompt_version <> 'N')")(
    lambda t: t.structured_knowledge.filter(c("call_intent").isin("F", "P")).join(t.technician_notes.withColumn("has", F.lit(1)), "call_id", "left").filter(c("has").isNull() | (c("prompt_version") != "N")).agg(F.count("*").alias("n"))
)
query("jn_07", f"SELECT cs.call_id, cs.status, rq.held_reason FROM call_state cs LEFT JOIN ({_HELD}) rq USING (call_id)")(lambda t: _with_hold(t).select("call_id", "status", "held_reason"))
query(
    "jn_08",
    "SELECT cs.call_id FROM call_state cs JOIN (SELECT call_id, outcome, row_number() OVER (PARTITION BY call_id ORDER BY created_at DESC, id DESC) AS n FROM processing_log) pl ON pl.call_id = cs.call_id AND pl.n = 1 WHERE cs.status = 'processing' AND pl.outcome = 'held'",
)(lambda t: t.call_state.filter("status = 'processing'").join(R.latest_value(t.processing_log, ["call_id"], "outcome", ["created_at", "id"]).filter("outcome = 'held'"), "call_id").select("call_id"))
query(
    "jn_09",
    "SELECT sk.call_id FROM structured_knowledge sk JOIN raw_transcripts rt USING (call_id) JOIN technician_notes tn USING (call_id) WHERE rt.soft_deleted_at IS NULL AND sk.service_category = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM token_vault tv WHERE tv.call_id = sk.call_id AND tv.hard_deleted_at IS NOT NULL)",
)(
    lambda t: R.lacking(
        t.structured_knowledge.filter("service_category = 'BUILDING'").join(t.raw_transcripts.filter("soft_deleted_at IS NULL").select("call_id"), "call_id").join(t.technician_notes.select("call_id"), "call_id"),
        t.token_vault.filter("hard_deleted_at IS NOT NULL"), ["call_id"],
    ).select("call_id")
)
query(
    "jn_10",
    "SELECT count(*) AS n FROM call_state cs WHERE NOT (cs.status IN ('completed', 'skipped') OR EXISTS (SELECT 1 FROM dead_letter d WHERE d.call_id = cs.call_id))",
)(lambda t: R.lacking(t.call_state.filter(~c("status").isin("completed", "skipped")), t.dead_letter, ["call_id"]).agg(F.count("*").alias("n")))
_ACTIVE = "SELECT 1 FROM review_queue rq WHERE rq.call_id = cs.call_id AND rq.status IN ('open', 'in_review')"
query("jn_11", f"SELECT cs.call_id FROM call_state cs WHERE NOT EXISTS ({_ACTIVE})")(lambda t: R.lacking(t.call_state, t.review_queue.filter(c("status").isin("open", "in_review")), ["call_id"]).select("call_id"))
query("jn_12", "SELECT tv.row_id FROM token_vault tv WHERE EXISTS (SELECT 1 FROM raw_transcripts p WHERE p.call_id = tv.call_id AND p.soft_deleted_at IS NOT NULL)")(
    lambda t: R.having(t.token_vault, t.raw_transcripts.filter("soft_deleted_at IS NOT NULL"), ["call_id"]).select("row_id")
)
query("jn_13", "SELECT tv.row_id FROM token_vault tv WHERE NOT EXISTS (SELECT 1 FROM raw_transcripts p WHERE p.call_id = tv.call_id)")(lambda t: R.lacking(t.token_vault, t.raw_transcripts, ["call_id"]).select("row_id"))
query(
    "jn_14",
    "SELECT p.call_id FROM raw_transcripts p WHERE NOT EXISTS (SELECT 1 FROM token_vault tv WHERE tv.call_id = p.call_id AND (tv.soft_deleted_at IS NULL OR tv.soft_deleted_at > p.retention_eligible_at + INTERVAL 60 DAYS))",
)(
    lambda t: R.lacking(
        t.raw_transcripts.alias("p"), t.token_vault.alias("v"),
        (c("p.call_id") == c("v.call_id")) & (c("v.soft_deleted_at").isNull() | (c("v.soft_deleted_at") > c("p.retention_eligible_at") + F.expr("INTERVAL 60 DAYS"))),
    ).select("call_id")
)
query("jn_15", "SELECT call_id FROM raw_transcripts WHERE soft_deleted_at IS NULL AND call_id NOT IN (SELECT call_id FROM review_queue WHERE status = 'open' AND call_id IS NOT NULL)")(
    lambda t: R.lacking(t.raw_transcripts.filter("soft_deleted_at IS NULL"), t.review_queue.filter("status = 'open'"), ["call_id"]).select("call_id")
)
query("jn_16", "SELECT e.event_id, n.r_name FROM events e JOIN region n ON e.user_id % 5 = n.r_regionkey")(lambda t: t.events.join(t.region, c("user_id") % 5 == c("r_regionkey")).select("event_id", "r_name"))
query(
    "jn_17",
    "SELECT action_id, model FROM (SELECT oa.action_id, mi.model, row_number() OVER (PARTITION BY oa.action_id ORDER BY mi.created_at DESC NULLS LAST, mi.id DESC) AS n FROM operator_actions oa LEFT JOIN model_invocations mi ON mi.call_id = oa.call_id AND mi.created_at < oa.created_at) AS x WHERE n = 1",
)(lambda t: R.as_of_before(t.operator_actions, t.model_invocations, ["call_id"], "created_at", "created_at", ["created_at", "id"], ["model"]).select("action_id", "model"))
query(
    "jn_19",
    "SELECT a.alert_id, coalesce(h.seen_at > a.created_at AND h.status <> 'degraded', false) AS recovered FROM alert_events a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY seen_at DESC, id DESC) AS n FROM heartbeats) AS x WHERE n = 1) h ON h.component = a.component",
)(
    lambda t: t.alert_events.join(R.latest(t.heartbeats, ["component"], ["seen_at", "id"]).select("component", "seen_at", c("status").alias("beat")), "component", "left")
    .select("alert_id", F.coalesce((c("seen_at") > c("created_at")) & (c("beat") != "degraded"), F.lit(False)).alias("recovered"))
)

# -- aggregates ----------------------------------------------------------------------

for name, table, where, keys in (
    ("agg_01", "call_state", "status = 'processing'", ["current_stage"]),
    ("agg_02", "review_queue", "status IN ('open', 'in_review')", ["held_reason"]),
    ("agg_03", "dead_letter", "cleared_at IS NULL", ["error_code"]),
    ("agg_04", "alert_events", "acknowledged_at IS NULL", ["error_code", "severity"]),
    ("agg_06", "processing_log", "stage <> 'redact'", ["stage", "outcome"]),
    ("rd_10", "backfill_run_calls", "call_id >= 0", ["run_id"]),
):
    query(name, f"SELECT {', '.join(keys)}, count(*) AS n FROM {table} WHERE {where} GROUP BY {', '.join(keys)}")(lambda t, table=table, where=where, keys=keys: R.counts(getattr(t, table).filter(where), keys))
query("agg_05", "SELECT json_extract_string(detail, '$.k') AS bucket, count(*) AS n FROM processing_log WHERE stage = 'classify' AND detail IS NOT NULL GROUP BY 1")(
    lambda t: R.counts(t.processing_log.filter((c("stage") == "classify") & F.array_contains(F.json_object_keys("detail"), "k")).select(F.get_json_object("detail", "$.k").alias("bucket")), ["bucket"])
)
_KN = "FROM structured_knowledge WHERE superseded_by_call_id IS NULL"
query(
    "agg_07",
    f"SELECT 'all' AS facet, NULL AS key, count(*) AS n {_KN} UNION ALL SELECT 'service_category', service_category, count(*) {_KN} GROUP BY service_category UNION ALL SELECT 'call_intent', call_intent, count(*) {_KN} GROUP BY call_intent UNION ALL SELECT 'urgency', urgency, count(*) {_KN} GROUP BY urgency",
)(lambda t: R.facets(t.structured_knowledge.filter("superseded_by_call_id IS NULL"), ["service_category", "call_intent", "urgency"]))
query("agg_08", "SELECT (SELECT count(*) FROM call_state) AS calls, (SELECT count(*) FROM dead_letter WHERE cleared_at IS NULL) AS uncleared, (SELECT count(*) FROM technician_notes) AS notes")(
    lambda t: t.call_state.agg(F.count("*").alias("calls")).join(t.dead_letter.filter("cleared_at IS NULL").agg(F.count("*").alias("uncleared"))).join(t.technician_notes.agg(F.count("*").alias("notes")))
)
query(
    "agg_09",
    "SELECT reviewer, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS correct FROM (SELECT *, row_number() OVER (PARTITION BY call_id, field_path, reviewer ORDER BY created_at DESC, id DESC) AS r FROM note_feedback) AS x WHERE r = 1 GROUP BY reviewer",
)(lambda t: R.latest_value(t.note_feedback, ["call_id", "field_path", "reviewer"], "verdict", ["created_at", "id"]).groupBy("reviewer").agg(F.count("*").alias("n"), F.count_if(c("verdict") == "correct").alias("correct")))
query("agg_10", "SELECT count(DISTINCT call_id) AS n FROM token_vault WHERE soft_deleted_at IS NOT NULL")(lambda t: t.token_vault.filter("soft_deleted_at IS NOT NULL").agg(F.count_distinct("call_id").alias("n")))
query("agg_11", "SELECT kek, coalesce(max(version), 0) + 1 AS next_version FROM key_versions GROUP BY kek")(lambda t: t.key_versions.groupBy("kek").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version")))
query("agg_12", f"SELECT key_version, count(*) AS n FROM (SELECT key_version FROM raw_transcripts WHERE {LIVE} UNION ALL SELECT key_version FROM token_vault WHERE {LIVE}) AS x GROUP BY key_version")(
    lambda t: R.counts(R.live(t.raw_transcripts).select("key_version").unionByName(R.live(t.token_vault).select("key_version")), ["key_version"])
)
_LABELS = "CASE WHEN error_code IN ('MODEL_TIMEOUT', 'STORE_DOWN', 'QUEUE_BACKLOG') THEN error_code ELSE 'other' END"
query(
    "agg_13",
    f"SELECT 'dead_letters' AS metric, {_LABELS} AS label, count(*) AS n FROM dead_letter GROUP BY 2 UNION ALL SELECT 'alerts', {_LABELS}, count(*) FROM alert_events GROUP BY 2 UNION ALL SELECT 'calls', status, count(*) FROM call_state GROUP BY 2",
)(
    lambda t: _counter(t.dead_letter, "dead_letters", _known("error_code")).unionByName(_counter(t.alert_events, "alerts", _known("error_code"))).unionByName(_counter(t.call_state, "calls", c("status")))
)


def _known(col: str):
    return F.when(c(col).isin("MODEL_TIMEOUT", "STORE_DOWN", "QUEUE_BACKLOG"), c(col)).otherwise("other")


def _counter(df: DataFrame, metric: str, label) -> DataFrame:
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "label", "n")


# the last part stands for a source that can't be read: it is null, and the others stand
query(
    "agg_14",
    "SELECT (SELECT count(*) FROM call_state WHERE status = 'processing') AS processing, (SELECT count(*) FROM review_queue WHERE status = 'open') AS open_reviews, (SELECT max(seen_at) FROM heartbeats) AS last_beat, "
    "(SELECT count(*) FROM alert_events WHERE acknowledged_at IS NULL AND severity = 'critical') AS critical, (SELECT count(*) FROM dead_letter WHERE cleared_at IS NULL) AS dead_letters, (SELECT sum(cost) FROM daily_cost WHERE day = DATE '2024-01-15')::DOUBLE AS spent, NULL::BIGINT AS queue_depth",
)(
    lambda t: R.rollup(
        t.spark,
        {
            "processing": ("long", lambda: t.call_state.agg(F.count_if(c("status") == "processing"))),
            "open_reviews": ("long", lambda: t.review_queue.agg(F.count_if(c("status") == "open"))),
            "last_beat": ("timestamp_ntz", lambda: t.heartbeats.agg(F.max("seen_at"))),
            "critical": ("long", lambda: t.alert_events.agg(F.count_if(c("acknowledged_at").isNull() & (c("severity") == "critical")))),
            "dead_letters": ("long", lambda: t.dead_letter.agg(F.count_if(c("cleared_at").isNull()))),
            "spent": ("double", lambda: t.daily_cost.filter("day = DATE '2024-01-15'").agg(F.sum("cost"))),
            "queue_depth": ("long", lambda: t.spark.read.parquet(f"{t.sf_dir}/queue_depth.parquet").agg(F.count("*"))),
        },
    )
)
query("agg_15", f"SELECT string_agg(service_category || ' (' || n || ')', ', ' ORDER BY n DESC, service_category) AS summary FROM (SELECT service_category, count(*) AS n {_KN} GROUP BY 1 ORDER BY n DESC, service_category LIMIT 3) AS x")(
    lambda t: R.counts(t.structured_knowledge.filter("superseded_by_call_id IS NULL"), ["service_category"]).orderBy(F.desc("n"), "service_category").limit(3)
    .agg(F.sort_array(F.collect_list(F.struct((-c("n")).alias("o"), "service_category", "n"))).alias("x"))
    .select(F.array_join(F.transform("x", lambda r: F.concat(r["service_category"], F.lit(" ("), r["n"].cast("string"), F.lit(")"))), ", ").alias("summary"))
)
query("agg_18_counts", "SELECT lang, sum(len(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '[0-9]{7,}')))::BIGINT AS digit_run, sum(len(regexp_extract_all(text, '[A-Za-z0-9_%+-]+\\s*[@＠﹫]\\s*[A-Za-z0-9.-]+')))::BIGINT AS at_signs FROM clean_transcripts GROUP BY lang")(
    lambda t: t.clean_transcripts.groupBy("lang").agg(
        F.sum(F.size(F.regexp_extract_all(C.normal_token(c("text")), F.lit("[0-9]{7,}"), F.lit(0)))).alias("digit_run"),
        F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_%+-]+\s*[@＠﹫]\s*[A-Za-z0-9.-]+"), F.lit(0)))).alias("at_signs"),
    )
)
# the residual scan's counts over all texts of a language, merged by category; its look-around patterns have no SQL
query("agg_18")(
    lambda t: t.clean_transcripts.select("lang", F.explode(X.residual(c("text"))).alias("category", "n")).groupBy("lang", "category").agg(F.sum("n").alias("n"))
    .groupBy("lang").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n"))))).alias("counts"))
)
query("agg_19", "SELECT stage, count(*) AS attempted, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) >= 50 AND count(*) FILTER (WHERE outcome = 'failed') * 5 > count(*) AS alarm FROM processing_log GROUP BY stage")(
    lambda t: t.processing_log.groupBy("stage").agg(F.count("*").alias("attempted"), F.count_if(c("outcome") == "failed").alias("failed")).withColumn("alarm", (c("attempted") >= 50) & (c("failed") * 5 > c("attempted")))
)
query("agg_21", f"SELECT count(*) FILTER (WHERE soft_deleted_at IS NULL AND retention_eligible_at <= TIMESTAMP '{RETENTION_NOW}' - INTERVAL 30 DAYS) AS soft, count(*) FILTER (WHERE hard_deleted_at IS NULL AND soft_deleted_at <= TIMESTAMP '{RETENTION_NOW}' - INTERVAL 60 DAYS) AS hard FROM raw_transcripts")(
    lambda t: t.raw_transcripts.agg(
        F.count_if(c("soft_deleted_at").isNull() & (c("retention_eligible_at") <= at(RETENTION_NOW) - F.expr("INTERVAL 30 DAYS"))).alias("soft"),
        F.count_if(c("hard_deleted_at").isNull() & (c("soft_deleted_at") <= at(RETENTION_NOW) - F.expr("INTERVAL 60 DAYS"))).alias("hard"),
    )
)

# -- latest wins ----------------------------------------------------------------------

query("win_01", f"SELECT call_id, field_path, reviewer, verdict FROM ({_LATEST_FB}) AS x WHERE n = 1")(lambda t: R.latest(t.note_feedback, ["call_id", "field_path", "reviewer"], ["created_at", "id"]).select("call_id", "field_path", "reviewer", "verdict"))
query("win_02", "SELECT call_id, field_path, verdict FROM (SELECT *, row_number() OVER (PARTITION BY call_id, field_path ORDER BY created_at DESC, id DESC) AS n FROM note_feedback WHERE reviewer = 'reviewer2') AS x WHERE n = 1")(
    lambda t: R.latest(t.note_feedback.filter("reviewer = 'reviewer2'"), ["call_id", "field_path"], ["created_at", "id"]).select("call_id", "field_path", "verdict")
)


def _reviewed(t: Tables) -> DataFrame:
    standing = R.latest_value(t.note_feedback, ["call_id", "field_path", "reviewer"], "verdict", ["created_at", "id"])
    return standing.groupBy("call_id").agg(F.max(c("verdict") != "correct").alias("wrong"))


query("win_03", f"SELECT call_id, bool_or(verdict <> 'correct') AS wrong FROM ({_LATEST_FB}) AS x WHERE n = 1 GROUP BY call_id")(_reviewed)
query(
    "win_04",
    f"SELECT tn.call_id, CASE WHEN f.wrong THEN 'wrong' WHEN f.call_id IS NOT NULL THEN 'reviewed' ELSE 'unreviewed' END AS review_state FROM technician_notes tn LEFT JOIN (SELECT call_id, bool_or(verdict <> 'correct') AS wrong FROM ({_LATEST_FB}) AS x WHERE n = 1 GROUP BY call_id) f ON f.call_id = tn.call_id",
)(lambda t: t.technician_notes.join(_reviewed(t), "call_id", "left").select("call_id", F.when(c("wrong"), "wrong").when(c("wrong").isNotNull(), "reviewed").otherwise("unreviewed").alias("review_state")))
query("win_05", "SELECT call_id, arg_max(k, struct_pack(a := created_at, b := id)) AS bucket FROM processing_log WHERE stage = 'classify' GROUP BY call_id")(
    lambda t: R.latest_value(t.processing_log.filter("stage = 'classify'"), ["call_id"], "k", ["created_at", "id"], "bucket")
)
query("win_06", "SELECT id FROM (SELECT id, outcome, lag(outcome) OVER (PARTITION BY call_id ORDER BY created_at, id) AS before FROM processing_log) AS x WHERE NOT (outcome = 'held' AND before IS NOT DISTINCT FROM 'held')")(
    lambda t: t.processing_log.withColumn("before", F.lag("outcome").over(R.Window.partitionBy("call_id").orderBy("created_at", "id"))).filter(~((c("outcome") == "held") & c("before").eqNullSafe(F.lit("held")))).select("id")
)
query("win_07", "SELECT call_id, arg_max(held_reason, struct_pack(a := created_at, b := review_id)) AS held_reason FROM review_queue WHERE status IN ('open', 'in_review') GROUP BY call_id")(
    lambda t: R.latest_value(t.review_queue.filter(c("status").isin("open", "in_review")), ["call_id"], "held_reason", ["created_at", "review_id"])
)

# -- paging ----------------------------------------------------------------------

query("top_01", f"SELECT call_id, created_at FROM structured_knowledge WHERE {_SEARCH} ORDER BY created_at DESC, call_id DESC LIMIT 50 OFFSET 50")(
    lambda t: R.page(_search(t), [F.desc("created_at"), F.desc("call_id")], 50, 2).select("call_id", "created_at")
)
query("top_02", "SELECT call_id, created_at FROM structured_knowledge WHERE (created_at, call_id) < (TIMESTAMP '1998-06-01 00:00:00', 5000) ORDER BY created_at DESC, call_id DESC LIMIT 40")(
    lambda t: R.page_after(t.structured_knowledge.select("created_at", "call_id"), ["created_at", "call_id"], ("1998-06-01 00:00:00", 5000), 40, descending=True)
)
query("top_03", "SELECT call_id FROM technician_notes WHERE call_id > 777 ORDER BY call_id LIMIT 25")(lambda t: R.page_after(t.technician_notes.select("call_id"), ["call_id"], (777,), 25))
query("top_04", "SELECT count(*) > 5000 AS truncated FROM (SELECT call_id FROM structured_knowledge LIMIT 5001) AS x")(lambda t: t.structured_knowledge.select("call_id").limit(5001).agg((F.count("*") > 5000).alias("truncated")))
query("top_05", "SELECT alert_id FROM alert_events WHERE acknowledged_at IS NULL ORDER BY created_at DESC, alert_id DESC LIMIT 1")(lambda t: t.alert_events.filter("acknowledged_at IS NULL").orderBy(F.desc("created_at"), F.desc("alert_id")).limit(1).select("alert_id"))
query(
    "top_06",
    "SELECT a.alert_id FROM (SELECT * FROM alert_events WHERE acknowledged_at IS NULL ORDER BY created_at DESC, alert_id DESC LIMIT 50) a WHERE NOT EXISTS (SELECT 1 FROM heartbeats h WHERE h.component = a.component AND h.seen_at > a.created_at AND h.status <> 'degraded') ORDER BY a.created_at DESC, a.alert_id DESC LIMIT 1",
)(
    lambda t: R.lacking(
        t.alert_events.filter("acknowledged_at IS NULL").orderBy(F.desc("created_at"), F.desc("alert_id")).limit(50).alias("a"), t.heartbeats.filter("status <> 'degraded'").groupBy("component").agg(F.max("seen_at").alias("seen_at")).alias("h"),
        (c("h.component") == c("a.component")) & (c("h.seen_at") > c("a.created_at")),
    ).orderBy(F.desc("created_at"), F.desc("alert_id")).limit(1).select("alert_id")
)
query("top_07", "SELECT call_id, updated_at FROM call_state ORDER BY updated_at DESC, call_id LIMIT 20 OFFSET 40")(lambda t: R.page(t.call_state.select("call_id", "updated_at"), [F.desc("updated_at"), F.asc("call_id")], 20, 3))
query("top_08", "SELECT call_id FROM call_state WHERE status = 'completed' ORDER BY updated_at DESC, call_id LIMIT 30")(lambda t: t.call_state.filter("status = 'completed'").orderBy(F.desc("updated_at"), "call_id").limit(30).select("call_id"))
query("top_09", "SELECT stage, id FROM (SELECT stage, id, row_number() OVER (PARTITION BY stage ORDER BY created_at, id) AS n FROM processing_log WHERE outcome = 'failed') AS x WHERE n <= 50")(
    lambda t: t.processing_log.filter("outcome = 'failed'").withColumn("n", F.row_number().over(R.Window.partitionBy("stage").orderBy("created_at", "id"))).filter("n <= 50").select("stage", "id")
)
query("top_10", f"SELECT review_id FROM review_queue WHERE status IN ('open', 'in_review') AND sla_due_at <= {TS}")(lambda t: t.review_queue.filter(c("status").isin("open", "in_review") & (c("sla_due_at") <= at())).select("review_id"))
query("top_11", "SELECT service_category, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages, greatest(CAST(ceil(count(*) FILTER (WHERE superseded_by_call_id < 0) / 50.0) AS BIGINT), 1) AS pages_at_least_one FROM structured_knowledge GROUP BY 1")(
    lambda t: t.structured_knowledge.groupBy("service_category").agg(R.pages(F.count("*"), 50).alias("pages"), R.pages(F.count_if(c("superseded_by_call_id") < 0), 50, 1).alias("pages_at_least_one"))
)

# -- sets ----------------------------------------------------------------------

query("set_01", "SELECT action_id FROM operator_actions oa WHERE EXISTS (SELECT id FROM dead_letter d WHERE d.id = oa.action_id + 1 UNION ALL SELECT review_id FROM review_queue r WHERE r.review_id = oa.action_id + 1)")(
    lambda t: R.having(t.operator_actions, t.dead_letter.select((c("id") - 1).alias("action_id")).unionByName(t.review_queue.select((c("review_id") - 1).alias("action_id"))), ["action_id"]).select("action_id")
)
query("set_02", "SELECT DISTINCT call_id FROM (SELECT call_id FROM raw_transcripts WHERE hard_deleted_at IS NOT NULL UNION ALL SELECT call_id FROM token_vault WHERE hard_deleted_at IS NOT NULL) AS x")(
    lambda t: t.raw_transcripts.filter("hard_deleted_at IS NOT NULL").select("call_id").unionByName(t.token_vault.filter("hard_deleted_at IS NOT NULL").select("call_id")).distinct()
)
query("set_03", "SELECT DISTINCT call_id FROM review_queue WHERE status = 'open'")(lambda t: t.review_queue.filter("status = 'open'").select("call_id").distinct())
query("set_04", "SELECT user_id AS call_id, list_sort(list_filter(['click', 'error', 'signup', 'view', 'consent'], lambda x: NOT list_contains(list(DISTINCT event_type), x)))::VARCHAR AS missing FROM events GROUP BY user_id")(
    lambda t: t.events.groupBy(c("user_id").alias("call_id")).agg(F.collect_set("event_type").alias("have"))
    .select("call_id", F.array_sort(F.array_except(F.array(*map(F.lit, ("click", "error", "signup", "view", "consent"))), "have")).alias("m")).select("call_id", F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")).alias("missing"))
)
query("set_05", "SELECT call_id, min(k) AS first_pos FROM processing_log GROUP BY call_id ORDER BY first_pos, call_id LIMIT 100")(
    lambda t: t.processing_log.groupBy("call_id").agg(F.min("k").alias("first_pos")).orderBy("first_pos", "call_id").limit(100)
)

# -- point, list and existence reads ----------------------------------------------------------------------

#: id -> (table, columns, predicate)
LISTS = {
    "rd_01": ("alert_events", "alert_id, created_at", "acknowledged_at IS NULL"),
    "rd_03": ("dead_letter", "id, failed_at", "cleared_at IS NULL"),
    "rd_05": ("operator_actions", "action_id, created_at", "action = 'approve'"),
    "rd_06": ("daily_cost", "day, id, tokens", "day = DATE '2024-01-15'"),
    "rd_08": ("raw_transcripts", "call_id, row_id", LIVE),
    "rd_11": ("backfill_runs", "run_id, status", "run_id = 17"),
    "rd_14": ("key_versions", "version, kek", "status = 'active'"),
    "rd_16": ("key_versions", "version, status", "version = 42"),
    "rd_17": ("key_versions", "version, kek, status", "version >= 0"),
    "rd_18": ("key_versions", "version, status", "kek = 7"),
    "rd_20": ("examples", "id, expected", "task = 1"),
    "rd_21": ("model_invocations", "id, stage, model", "call_id = 12"),
    "rd_22": ("note_feedback", "id, field_path, verdict", "call_id = 33"),
    "rd_23": ("operator_actions", "action_id, action", "call_id = 20"),
    "rd_24": ("processing_log", "id, stage, outcome", "call_id >= 1000 AND call_id < 1100"),
    "rd_27": ("token_vault", "row_id, token", f"{LIVE} AND row_id = 12341"),
    "rd_28": ("token_vault", "row_id, token", f"{LIVE} AND call_id < 100"),
    "rd_29": ("review_queue", "review_id, created_at", "status = 'open' AND review_id NOT IN (3, 5, 8)"),
    "rd_30": ("review_queue", "review_id, status", "review_id = 17"),
    "rd_31": ("operator_actions", "action_id, call_id", "action_id = 104"),
    "rd_37": ("review_queue", "review_id, held_reason, created_at", "status IN ('open', 'in_review')"),
    "rd_38": ("review_queue", "review_id, held_reason", "review_id = 29"),
    "rd_39": ("structured_knowledge", "call_id, urgency", "call_id = 99"),
    "rd_40": ("technician_notes", "call_id, prompt_version", "call_id = 99"),
    "rd_42": ("token_vault", "row_id, key_version", f"{LIVE} AND key_version = 9"),
}
for name, (table, cols, where) in LISTS.items():
    query(name, f"SELECT {cols} FROM {table} WHERE {where}")(lambda t, table=table, cols=cols, where=where: getattr(t, table).filter(where).select(*(x.strip() for x in cols.split(","))))

#: id -> (calls table, evidence table, predicate on the evidence): which calls have some
EXISTS = {
    "rd_02": ("call_state", "dead_letter", "cleared_at IS NULL"),
    "rd_07": ("structured_knowledge", "raw_transcripts", "hard_deleted_at IS NOT NULL"),
    "rd_09": ("structured_knowledge", "token_vault", "hard_deleted_at IS NOT NULL"),
    "rd_25": ("technician_notes", "raw_transcripts", "soft_deleted_at IS NOT NULL"),
    "rd_26": ("technician_notes", "raw_transcripts", LIVE),
    "rd_32": ("call_state", "review_queue", "status IN ('open', 'in_review')"),
    "rd_33": ("call_state", "review_queue", "status IN ('resolved', 'unresolvable')"),
    "rd_34": ("call_state", "review_queue", "status IN ('open', 'in_review') AND raw_purged_at IS NULL"),
    "rd_35": ("call_state", "review_queue", "raw_purged_at IS NOT NULL"),
    "rd_36": ("call_state", "review_queue", "status <> 'resolved'"),
    "rd_43": ("structured_knowledge", "token_vault", f"{LIVE} AND token = '[NAME_3]'"),
}
for name, (table, other, where) in EXISTS.items():
    query(name, f"SELECT a.call_id FROM {table} a WHERE EXISTS (SELECT 1 FROM {other} b WHERE b.call_id = a.call_id AND {where})")(
        lambda t, table=table, other=other, where=where: R.having(getattr(t, table), getattr(t, other).filter(where), ["call_id"]).select("call_id")
    )
_BEAT = "SELECT *, row_number() OVER (PARTITION BY component ORDER BY seen_at DESC, id DESC) AS n FROM heartbeats"
query("rd_04", f"SELECT component, status, seen_at FROM ({_BEAT}) AS x WHERE n = 1")(lambda t: R.latest(t.heartbeats, ["component"], ["seen_at", "id"]).select("component", "status", "seen_at"))
query("rd_12", "SELECT window_id, count(*) AS n, count(*) > 1 AS ambiguous FROM backfill_runs WHERE status IN ('running', 'failed') GROUP BY window_id")(
    lambda t: t.backfill_runs.filter(c("status").isin("running", "failed")).groupBy("window_id").agg(F.count("*").alias("n")).withColumn("ambiguous", c("n") > 1)
)
for name in ("rd_13", "rd_15"):
    query(name, "SELECT kek, count(*) FILTER (WHERE status = 'active') = 1 AS exactly_one, max(version) FILTER (WHERE status = 'active') AS version FROM key_versions GROUP BY kek")(
        lambda t: t.key_versions.groupBy("kek").agg((F.count_if(c("status") == "active") == 1).alias("exactly_one"), F.max(F.when(c("status") == "active", c("version"))).alias("version"))
    )
query("rd_19", "SELECT action_id, created_at FROM operator_actions WHERE action = 'reject' AND created_at >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY created_at DESC, action_id LIMIT 100")(
    lambda t: t.operator_actions.filter(R.search_filter({"action": "reject", "held_reason": None}, start="2024-01-10")).orderBy(F.desc("created_at"), "action_id").limit(100).select("action_id", "created_at")
)
query("rd_41", "SELECT tn.call_id, tn.quantity, sk.problem_statement FROM technician_notes tn JOIN structured_knowledge sk USING (call_id) WHERE superseded_by_call_id IS NULL")(
    lambda t: t.technician_notes.join(t.structured_knowledge.filter("superseded_by_call_id IS NULL"), "call_id").select("call_id", "quantity", "problem_statement")
)
