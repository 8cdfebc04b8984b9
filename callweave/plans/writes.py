"""Writes and guarded transitions: each query returns the table after the write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab as V
from ..operators import rows as R
from ..operators import writes as W
from ..scratch import fresh_path
from .registry import at, hmac_sql, query
from .standins import NOW, Tables

c = F.col
TS = f"TIMESTAMP '{NOW}'"
now = at
LIVE = "soft_deleted_at IS NULL AND hard_deleted_at IS NULL"

# -- upserts ----------------------------------------------------------------------


_PROTECTED = ", ".join(f"'{s}'" for s in V.PROTECTED_STATUSES)
# All rows are old ones; the change set, by stage or time, grows with them and brings new keys.


def _states(t: Tables):
    changed, fresh = t.call_state.filter("current_stage IN ('metadata-pre-filter', 'extract', 'redact')"), t.call_state.filter("current_stage = 'classify'")
    ids = changed.select("call_id").unionByName(fresh.select((-c("call_id") - 1).alias("call_id")))
    return t.call_state.select("call_id", "status", "updated_at"), ids.select("call_id", F.lit("processing").alias("status"), now().alias("updated_at"))


def _ids(table, changed: str):
    """Keys of the rows that change, and new keys for the others."""
    return table.select(F.when(F.expr(changed), c("call_id")).otherwise(-c("call_id") - 1).alias("call_id"))


_MOVED = f"current_stage IN ('metadata-pre-filter', 'extract', 'redact') AND status NOT IN ({_PROTECTED})"
query(
    "snk_01",
    f"SELECT call_id, CASE WHEN {_MOVED} THEN 'processing' ELSE status END AS status, CASE WHEN {_MOVED} THEN {TS} ELSE updated_at END AS updated_at FROM call_state UNION ALL SELECT -call_id - 1, 'processing', {TS} FROM call_state WHERE current_stage = 'classify'",
)(lambda t: W.upsert(*_states(t), ["call_id"], keep=c("old.status").isin(*V.PROTECTED_STATUSES)))
query("snk_02", "SELECT call_id, status FROM call_state UNION ALL SELECT -call_id - 1, 'processing' FROM call_state WHERE current_stage = 'classify'")(lambda t: W.insert_absent(*_states(t), ["call_id"]).select("call_id", "status"))
_LATE = "retention_eligible_at >= DATE '1996-01-01'"
query("snk_03", f"SELECT call_id, CASE WHEN hard_deleted_at IS NULL AND {_LATE} THEN -1 ELSE key_version END AS key_version, CASE WHEN hard_deleted_at IS NULL AND {_LATE} THEN coalesce(soft_deleted_at, {TS}) ELSE soft_deleted_at END AS stamped FROM raw_transcripts UNION ALL SELECT -call_id - 1, -1, {TS} FROM raw_transcripts WHERE NOT ({_LATE})")(
    lambda t: W.upsert(
        t.raw_transcripts.select("call_id", "key_version", c("soft_deleted_at").alias("stamped"), "hard_deleted_at"),
        _ids(t.raw_transcripts, _LATE).select("call_id", F.lit(-1).cast("long").alias("key_version"), now().alias("stamped"), F.lit(None).cast("timestamp_ntz").alias("hard_deleted_at")),
        ["call_id"], keep=c("old.hard_deleted_at").isNotNull(), once=["stamped"],
    ).select("call_id", "key_version", "stamped")
)
query("snk_04", f"SELECT call_id, CASE WHEN hard_deleted_at IS NOT NULL THEN 'kept' WHEN {_LATE} THEN 'pending' ELSE 'passed' END AS scan_status FROM raw_transcripts UNION ALL SELECT -call_id - 1, 'pending' FROM raw_transcripts WHERE NOT ({_LATE})")(
    lambda t: W.upsert(
        t.raw_transcripts.select("call_id", F.when(c("hard_deleted_at").isNotNull(), "kept").otherwise("passed").alias("scan_status"), "hard_deleted_at"),
        _ids(t.raw_transcripts, _LATE).select("call_id", F.lit("pending").alias("scan_status"), F.lit(None).cast("timestamp_ntz").alias("hard_deleted_at")),
        ["call_id"], keep=c("old.hard_deleted_at").isNotNull(),
    ).select("call_id", "scan_status")
)
query("snk_06", f"SELECT call_id, CASE WHEN scope_signal = 'O' THEN 'v2' ELSE prompt_version END AS prompt_version, created_at FROM technician_notes UNION ALL SELECT -call_id - 1, 'v2', {TS} FROM technician_notes WHERE scope_signal <> 'O'")(
    lambda t: W.upsert(t.technician_notes.select("call_id", "prompt_version", "created_at"), _ids(t.technician_notes, "scope_signal = 'O'").select("call_id", F.lit("v2").alias("prompt_version"), now().alias("created_at")), ["call_id"], first=["created_at"])
)
# every result stands in the table; failed ones are told again a day later, and each call of a review gets its first row
query(
    "snk_05",
    "SELECT call_id, arg_max(k, struct_pack(a := created_at, b := id)) AS k FROM (SELECT call_id, k, created_at, id FROM processing_log UNION ALL SELECT call_id, k + 1000, created_at + INTERVAL 1 DAYS, id + 1000000000 FROM processing_log WHERE outcome = 'failed' "
    "UNION ALL SELECT -1 - call_id, k, created_at, review_id + 2000000000 FROM review_queue) AS x GROUP BY call_id",
)(lambda t: W.latest_wins(t.processing_log.select("call_id", "k", "created_at", "id"), _told_again(t), ["call_id"], ["created_at", "id"]).select("call_id", "k"))


def _told_again(t: Tables):
    again = t.processing_log.filter("outcome = 'failed'").select("call_id", (c("k") + 1000).alias("k"), (c("created_at") + F.expr("INTERVAL 1 DAYS")).alias("created_at"), (c("id") + 1000000000).alias("id"))
    return again.unionByName(t.review_queue.select((-1 - c("call_id")).alias("call_id"), "k", "created_at", (c("review_id") + 2000000000).alias("id")))


query("snk_07", "SELECT day, CAST(sum(cost) AS DECIMAL(18,6)) AS cost, sum(tokens)::BIGINT AS tokens FROM daily_cost GROUP BY day")(
    lambda t: W.accumulate(t.daily_cost, ["day"], ["cost", "tokens"]).withColumn("cost", c("cost").cast("decimal(18,6)"))
)
query(
    "snk_09",
    f"SELECT row_id, call_id, CASE WHEN {LIVE} AND call_id % 5 = 0 AND EXISTS (SELECT 1 FROM raw_transcripts q WHERE q.call_id = tv.call_id) THEN {TS} ELSE soft_deleted_at END AS soft_deleted_at, retention_eligible_at FROM token_vault tv "
    f"UNION ALL SELECT -call_id, call_id, NULL, coalesce((SELECT min(v.retention_eligible_at) FROM token_vault v WHERE v.call_id = p.call_id AND v.soft_deleted_at IS NULL AND v.hard_deleted_at IS NULL), {TS}) FROM raw_transcripts p WHERE call_id % 5 = 0",
)(
    lambda t: W.replace_set(
        t.token_vault.withColumn("row_id", c("row_id").cast("long")).unionByName(t.token_vault.limit(0).withColumn("row_id", c("row_id").cast("long"))),
        # new rows for every transcript of the chosen calls; keys without a transcript keep their rows
        t.raw_transcripts.filter("call_id % 5 = 0").select("call_id", (-c("call_id")).alias("row_id"), F.lit("[NAME_1]").alias("token"), "key_version", now().alias("retention_eligible_at"), F.lit(None).cast("timestamp_ntz").alias("soft_deleted_at"), F.lit(None).cast("timestamp_ntz").alias("hard_deleted_at"))
        .unionByName(t.token_vault.limit(0).withColumn("row_id", c("row_id").cast("long"))),
        ["call_id"], now(),
    ).select("row_id", "call_id", "soft_deleted_at", "retention_eligible_at")
)
for name in ("snk_10", "wr_17"):
    query(name, "SELECT call_id, max(row_id) AS row_id FROM token_vault v WHERE NOT EXISTS (SELECT 1 FROM raw_transcripts p WHERE p.call_id = v.call_id AND p.hard_deleted_at IS NOT NULL) GROUP BY call_id")(
        lambda t: R.latest(R.lacking(t.token_vault, t.raw_transcripts.filter("hard_deleted_at IS NOT NULL"), ["call_id"]), ["call_id"], ["row_id"]).select("call_id", "row_id")
    )
query("snk_12", "SELECT component, arg_max(status, struct_pack(a := seen_at, b := id)) AS status, max(seen_at) AS seen_at FROM heartbeats GROUP BY component")(
    lambda t: R.latest(t.heartbeats, ["component"], ["seen_at", "id"]).select("component", "status", "seen_at")
)
_TERMINAL = "SELECT 1 FROM call_state cs WHERE cs.call_id = a.call_id AND cs.status = 'completed'"
query("snk_14", f"SELECT alert_id, CASE WHEN acknowledged_at IS NULL AND EXISTS ({_TERMINAL}) THEN {TS} ELSE acknowledged_at END AS acknowledged_at FROM alert_events a")(
    lambda t: W.update_from(t.alert_events, t.call_state.filter("status = 'completed'"), ["call_id"], c("acknowledged_at").isNull(), acknowledged_at=now()).select("alert_id", "acknowledged_at")
)
query("snk_15", "SELECT call_id, CASE WHEN call_id % 10 = 3 AND call_id <> 13 THEN 13 ELSE superseded_by_call_id END AS superseded_by_call_id FROM structured_knowledge")(
    lambda t: W.transition(t.structured_knowledge, (c("call_id") % 10 == 3) & (c("call_id") != 13), superseded_by_call_id=F.lit(13).cast("long")).select("call_id", "superseded_by_call_id")
)

# -- exports ----------------------------------------------------------------------

_cell = lambda e: f"CASE WHEN contains({e}, ',') OR contains({e}, '\"') THEN '\"' || replace({e}, '\"', '\"\"') || '\"' ELSE {e} END"
query("snk_16", f"SELECT call_id, CAST(call_id AS VARCHAR) || ',' || {_cell('problem_statement')} || ',' || {_cell('lang')} AS line FROM (SELECT call_id, problem_statement, CASE WHEN call_id % 5 = 0 THEN '''=' || lang1 ELSE lang1 || '; ' || lang2 || ', \"' || call_intent || '\"' END AS lang FROM structured_knowledge) AS x")(
    lambda t: t.structured_knowledge.select(
        "call_id",
        C.csv_row([c("call_id"), c("problem_statement"), F.when(c("call_id") % 5 == 0, F.concat(F.lit("="), c("lang1"))).otherwise(F.array_join(F.array("lang1", F.concat("lang2", F.lit(', "'), "call_intent", F.lit('"'))), "; "))]).alias("line"),
    )
)
query("snk_17", "SELECT '{\"call_id\":' || call_id || ',\"urgency\":\"' || urgency || '\"}' AS line, count(*) OVER () AS total, false AS truncated FROM structured_knowledge")(lambda t: W.json_export(t.structured_knowledge.select("call_id", "urgency"), ["call_id"]))
query("snk_18_names", "SELECT action_id, action || '-' || action_id || '.json' AS file FROM operator_actions WHERE action IN ('approve', 'reject')")(
    lambda t: t.operator_actions.filter(c("action").isin("approve", "reject")).select("action_id", F.concat("action", F.lit("-"), c("action_id").cast("string"), F.lit(".json")).alias("file"))
)
# accepted actions are exported, and once more when spam counts and rejected ones of a late place do not, approved ones of it with other contents
_AGAIN = "action IN ('approve', 'mark_spam') OR (action = 'reject' AND k < 50)"


def _exported_twice(t: Tables):
    folder = fresh_path(t.spark, "fixtures")
    body = lambda late: F.to_json(F.struct("call_id", "action", F.when(late, c("k")).alias("k")))
    file = F.concat("action", F.lit("-"), c("action_id").cast("string"), F.lit(".json")).alias("file")
    W.export_fixtures(t.operator_actions.filter("action IN ('approve', 'reject')").select(file, body(F.lit(False)).alias("body")), folder)
    diff = W.export_fixtures(t.operator_actions.filter(_AGAIN).select(file, body((c("action") == "approve") & (c("k") >= 50)).alias("body")), folder)
    return diff.join(W.exported(t.spark, folder), "file", "left").select("file", "change", c("body").isNotNull().alias("there"))


query(
    "snk_18",
    f"SELECT action || '-' || action_id || '.json' AS file, CASE WHEN action = 'mark_spam' THEN 'added' WHEN NOT ({_AGAIN}) THEN 'removed' WHEN action = 'approve' AND k >= 50 THEN 'changed' ELSE 'kept' END AS change, ({_AGAIN}) AS there "
    "FROM operator_actions WHERE action IN ('approve', 'reject', 'mark_spam')",
)(_exported_twice)


def _audit(t: Tables):
    from ..operators import redaction as X

    return t.customer.select("c_custkey", "c_mktsegment", X.keyed_hash(b"audit", C.name_key(c("c_name"))).alias("name_hash"))


_NAME = "trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g'))"
query("snk_19", f"SELECT c_custkey, c_mktsegment, {hmac_sql(b'audit', f'encode({_NAME})')} AS name_hash FROM customer")(_audit)

# -- appends and insert-once ----------------------------------------------------------------------

#: id -> (table, its columns, new rows' source, condition, new values): inserts with the values that the operation sets.
#: Expressions are read alike by Spark and by SQL. New ids lie behind the old ones.
APPENDS = {
    "snk_13": ("processing_log", ["id", "call_id", "stage", "outcome"], "call_state", "status = 'held'", ["call_id + 1000000000", "call_id", "current_stage", "'held'"]),
    "wr_07": ("backfill_runs", ["run_id", "window_id", "status", "progress"], "supplier", "s_acctbal > 0", ["s_suppkey + 1000000000", "s_nationkey", "'running'", "CAST(0 AS DOUBLE)"]),
    "wr_24": ("processing_log", ["id", "call_id", "stage", "outcome"], "events", "event_type = 'signup'", ["event_id + 1000000000", "user_id", "coalesce(nullif(event_type, 'signup'), 'webhook')", "coalesce(CAST(NULL AS STRING), 'received')"]),
    "wr_25": ("operator_actions", ["action_id", "call_id", "action"], "review_queue", "status = 'open' AND held_reason <> 'cost_cap_held'", ["review_id + 1000000000", "call_id", "'reprocess_requested'"]),
    "wr_30": ("dead_letter", ["id", "call_id", "error_code"], "processing_log", "outcome = 'failed' AND k > 50", ["id + 1000000000", "call_id", "CASE WHEN stage = 'redact' THEN 'BAD_INPUT' ELSE 'STORE_DOWN' END"]),
    "wr_31": ("operator_actions", ["action_id", "call_id", "action"], "customer", "c_acctbal > 0", ["c_custkey + 1000000000", "c_custkey", "concat('consent:', lower(c_mktsegment))"]),
    "wr_32": ("examples", ["id", "expected", "task"], "documents", "length(text) > 800", ["doc_id + 1000000000", "1", "0"]),
    "wr_35": ("model_invocations", ["id", "call_id", "model", "tokens"], "clean_transcripts", "lang IS NOT NULL", ["call_id + 1000000000", "call_id", "concat('model-', lang)", "CAST(floor(length(text) / 4) AS INT)"]),
    "wr_36": ("note_feedback", ["id", "call_id", "field_path", "verdict"], "technician_notes", "quantity > 40", ["call_id + 1000000000", "call_id", "'equipment.capacity'", "CASE WHEN scope_signal = 'O' THEN 'wrong' ELSE 'correct' END"]),
    "wr_37": ("operator_actions", ["action_id", "call_id", "action"], "alert_events", "acknowledged_at IS NOT NULL", ["alert_id + 1000000000", "call_id", "'acknowledge'"]),
    "wr_38": ("heartbeats", ["id", "component", "status"], "key_versions", "status <> 'active'", ["version + 1000000000", "concat('key:', CAST(kek AS STRING))", "concat('lifecycle:', status)"]),
    "wr_39": ("key_versions", ["version", "kek", "status"], "nation", "true", ["n_nationkey + 1000000000", "n_nationkey", "'active'"]),
    "wr_40": ("key_versions", ["version", "kek", "status"], "key_versions", "status = 'active'", ["version + 1000000000", "kek", "'rotating'"]),
    "wr_44": ("key_versions", ["version", "kek", "status"], "region", "true", ["r_regionkey + 1000000000", "r_regionkey + 100", "'parent_active'"]),
}


def _appended(t: Tables, table: str, columns: list[str], source: str, where: str, values: list[str]):
    old = getattr(t, table).select(*columns)
    new = getattr(t, source).filter(where).select(*(F.expr(v).cast(old.schema[k].dataType).alias(k) for k, v in zip(columns, values)))
    return W.append(old, new)


for name, spec in APPENDS.items():
    table, columns, source, where, values = spec
    query(name, f"SELECT {', '.join(columns)} FROM {table} UNION ALL SELECT {', '.join(values)} FROM {source} WHERE {where}")(lambda t, spec=spec: _appended(t, *spec))
#: id -> (table, key columns, source of new rows, their values): insert-once of what is not there yet. Expressions are read alike by Spark and by SQL.
ONCE = {
    "wr_05": ("backfill_run_calls", ["run_id", "call_id"], "lineitem", ["l_suppkey", "l_orderkey"]),
    "wr_23": ("raw_transcripts", ["call_id"], "processing_log", ["call_id"]),
    "wr_33": ("examples", ["id", "task"], "documents", ["doc_id", "CASE WHEN length(text) > 800 THEN 1 ELSE 0 END"]),
    "wr_34": ("examples", ["id", "expected"], "documents", ["doc_id", "CASE WHEN lang = 'en' THEN 1 ELSE 0 END"]),
}


def _inserted(t: Tables, table: str, keys: list[str], source: str, values: list[str]):
    old = getattr(t, table).select(*keys)
    return W.insert_absent(old, getattr(t, source).select(*(F.expr(v).cast(old.schema[k].dataType).alias(k) for k, v in zip(keys, values))), keys)


for name, spec in ONCE.items():
    table, keys, source, values = spec
    new = f"(SELECT DISTINCT {', '.join(f'{v} AS {k}' for k, v in zip(keys, values))} FROM {source}) AS n"
    same = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    query(name, f"SELECT {', '.join(keys)} FROM {table} UNION ALL SELECT {', '.join(keys)} FROM {new} WHERE NOT EXISTS (SELECT 1 FROM {table} AS o WHERE {same})")(lambda t, spec=spec: _inserted(t, *spec))

# -- stamps and guarded transitions ----------------------------------------------------------------------

#: id -> (table, id column, stamped column, guard): the column becomes now where the guard holds and it is unset
STAMPS = {
    "wr_01": ("alert_events", "alert_id", "acknowledged_at", "dedup_key = 'alert:user:3'"),
    "wr_02": ("alert_events", "alert_id", "acknowledged_at", "call_id = 4242"),
    "wr_10": ("raw_transcripts", "call_id", "soft_deleted_at", "hard_deleted_at IS NULL AND call_id % 7 = 0"),
    "wr_11": ("token_vault", "row_id", "soft_deleted_at", "hard_deleted_at IS NULL AND key_version % 7 = 0"),
    "wr_12": ("raw_transcripts", "call_id", "hard_deleted_at", "soft_deleted_at IS NOT NULL"),
    "wr_15": ("raw_transcripts", "call_id", "soft_deleted_at", "call_id < 1000"),
    "wr_16": ("token_vault", "row_id", "soft_deleted_at", "call_id < 1000"),
    "wr_22": ("review_queue", "review_id", "raw_purged_at", "status = 'resolved'"),
}
for name, (table, key, col, guard) in STAMPS.items():
    query(name, f"SELECT {key}, CASE WHEN {col} IS NULL AND ({guard}) THEN {TS} ELSE {col} END AS {col} FROM {table}")(
        lambda t, table=table, key=key, col=col, guard=guard: W.stamp_once(getattr(t, table), col, F.expr(guard), now()).select(key, col)
    )
#: id -> (table, id column, changed column, guard, new value)
MOVES = {
    "wr_03": ("alert_events", "alert_id", "delivery_state", "delivery_state <> 'delivered'", "delivered"),
    "wr_04": ("alert_events", "alert_id", "delivery_state", "delivery_state <> 'delivered' AND attempts > 3", "failed"),
    "wr_08": ("backfill_runs", "run_id", "status", "progress > 5000", "checkpointed"),
    "wr_13_reviews": ("review_queue", "review_id", "status", "status = 'open' AND k % 3 = 0", "failed"),
    "wr_14_reviews": ("review_queue", "review_id", "status", "status = 'open'", "passed"),
    "wr_19": ("review_queue", "review_id", "status", "status IN ('open', 'in_review') AND call_id % 4 = 0", "unresolvable"),
    "wr_20": ("review_queue", "review_id", "status", "status IN ('open', 'in_review') AND review_id % 4 = 0", "unresolvable"),
    "wr_21": ("review_queue", "review_id", "status", "status = 'in_review'", "resolved"),
    "wr_27": ("alert_events", "alert_id", "delivery_state", "delivery_state = 'pending' AND attempts = 0", "sent"),
    "wr_28": ("alert_events", "alert_id", "delivery_state", "delivery_state = 'pending' AND attempts > 2", "superseded"),
    "wr_41": ("key_versions", "version", "status", "status = 'active'", "rotating"),
    "wr_42": ("key_versions", "version", "status", "status = 'retired'", "destroy_requested"),
    "wr_43": ("key_versions", "version", "status", "status = 'retired' AND kek % 2 = 0", "destroyed"),
    "wr_45": ("key_versions", "version", "status", "status = 'rotating'", "active"),
    "wr_46": ("key_versions", "version", "status", "status = 'retired' AND kek % 3 = 0", "destroy_requested"),
    "wr_47": ("key_versions", "version", "status", "status = 'retired' AND balance > 1000", "destroyed"),
}
for name, (table, key, col, guard, value) in MOVES.items():
    query(name, f"SELECT {key}, CASE WHEN {guard} THEN '{value}' ELSE {col} END AS {col} FROM {table}")(
        lambda t, table=table, key=key, col=col, guard=guard, value=value: W.transition(getattr(t, table), F.expr(guard), **{col: F.lit(value)}).select(key, col)
    )
query("wr_06", "SELECT run_id, call_id FROM backfill_run_calls WHERE run_id % 10 <> 3")(lambda t: t.backfill_run_calls.filter("run_id % 10 <> 3").select("run_id", "call_id"))
query("wr_09", "SELECT run_id, CASE WHEN run_id % 10 = 3 THEN 'running' ELSE status END AS status, (SELECT count(*) FROM backfill_run_calls b WHERE b.run_id = r.run_id AND r.run_id % 10 <> 3) AS calls FROM backfill_runs r")(
    lambda t: W.transition(t.backfill_runs, c("run_id") % 10 == 3, status=F.lit("running")).join(R.counts(t.backfill_run_calls.filter("run_id % 10 <> 3"), ["run_id"], "calls"), "run_id", "left").select("run_id", "status", F.coalesce("calls", F.lit(0)).alias("calls"))
)
query("wr_18", "SELECT call_id, min(review_id) AS review_id FROM review_queue WHERE status IN ('open', 'in_review') GROUP BY call_id")(
    lambda t: R.first_row(t.review_queue.filter(c("status").isin("open", "in_review")), ["call_id"], ["review_id"]).select("call_id", "review_id")
)
query("wr_26", "SELECT review_id FROM review_queue WHERE status = 'open' ORDER BY created_at, review_id LIMIT 20")(lambda t: t.review_queue.filter("status = 'open'").orderBy("created_at", "review_id").limit(20).select("review_id"))
query("wr_29", "SELECT call_id, count(*) AS attempts FROM dead_letter GROUP BY call_id")(lambda t: R.counts(t.dead_letter, ["call_id"], "attempts"))
