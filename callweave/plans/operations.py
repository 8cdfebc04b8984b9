"""Deliveries, checkpoints, gates, samples, duties and scans of candidates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import operations as O
from ..operators import states as S
from .registry import at, query
from .standins import K, NOW, Tables

c = F.col
TS = f"TIMESTAMP '{NOW}'"

# -- deliveries: a user's alert, of which every event is a request -------------------------------

BASE_SECONDS, MOST = 1800, 8
#: When the sweep runs: three days after the first requests, so that some alerts are due and others leased or out of attempts.
SWEEP = "2024-01-03 12:00:00"
_AT = f"TIMESTAMP '{SWEEP}'"
_RESULT = "CASE WHEN event_type = 'purchase' AND value > 60 THEN 'sent' WHEN event_type = 'error' THEN 'lost' ELSE 'failed' END"
#: One step of the recursion takes every alert's next request; {until} is the time up to which requests count.
DELIVERED = f"""
, q AS (SELECT user_id AS alert_id, event_id AS id, epoch_us(ts) AS us, epoch_us(ts) - {K} * 600000000::BIGINT AS seen, event_type = 'signup' AS immediate, {_RESULT} AS result,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts <= {{until}}),
d AS (SELECT DISTINCT alert_id, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, 0 AS attempts, NULL::BIGINT AS next_us, NULL::BIGINT AS claimed, false AS done FROM q
  UNION ALL SELECT alert_id, n, id, CASE WHEN NOT won THEN 'skipped' WHEN result = 'sent' THEN 'delivered' WHEN result = 'failed' THEN 'failed' ELSE 'leased' END,
    attempts + won::INT, CASE WHEN won THEN us + {BASE_SECONDS * 1_000_000} * (2 ** attempts)::BIGINT ELSE next_us END, CASE WHEN won THEN us ELSE claimed END, done OR (won AND result = 'sent')
  FROM (SELECT d.alert_id, q.n, q.id, q.us, q.result, d.attempts, d.next_us, d.claimed, d.done,
    NOT d.done AND d.attempts < {MOST} AND (d.claimed IS NULL OR d.claimed <= q.seen) AND (q.immediate OR d.next_us IS NULL OR d.next_us <= q.seen) AS won
    FROM d JOIN q ON q.alert_id = d.alert_id AND q.n = d.n + 1) AS y)
"""


def _delivered(t: Tables, until=None):
    rows = t.events if until is None else t.events.filter(c("ts") <= until)
    asked = rows.select(
        c("user_id").alias("alert_id"), c("event_id").alias("id"), F.expr(f"ts - make_interval(0, 0, 0, 0, 0, {K} * 10, 0)").alias("read_at"), c("ts").alias("at"), (c("event_type") == "signup").alias("immediate"), F.expr(_RESULT).alias("result")
    )
    return O.deliveries(asked, BASE_SECONDS, MOST)


query("op_53", DELIVERED.format(until="TIMESTAMP '9999-01-01'") + " SELECT alert_id, id, outcome, attempts, next_us FROM d WHERE n > 0")(_delivered)
query(
    "str_12",
    DELIVERED.format(until=_AT) + f""", e AS (SELECT alert_id, max(attempts) AS attempts, max(next_us) AS next_us, bool_or(done) AS done FROM d GROUP BY alert_id)
SELECT alert_id, attempts, next_us, epoch_us({_AT}) + {BASE_SECONDS * 1_000_000} * (2 ** attempts)::BIGINT AS lease_us FROM e WHERE NOT done AND attempts < {MOST} AND coalesce(next_us <= epoch_us({_AT}), true)""",
)(lambda t: O.retryable(_delivered(t, at(SWEEP)), at(SWEEP), BASE_SECONDS, MOST))

# -- checkpoints of backfill runs ----------------------------------------------------------------

_PROGRESS = """
, g AS (SELECT run_id, epoch_ms(min(started_at)) AS watermark_ms, count(*) AS seen, count(*) FILTER (WHERE soft_deleted_at IS NOT NULL) AS terminal FROM backfill_run_calls b JOIN raw_transcripts rt USING (call_id) GROUP BY run_id),
cp AS (SELECT r.run_id, '{"v":1,"phase":"' || CASE WHEN status = 'running' THEN 'sweep' ELSE 'drain' END || '","watermarkStartedAtMs":' || coalesce(CAST(watermark_ms AS VARCHAR), 'null')
  || ',"callsSeen":' || coalesce(seen, 0) || ',"seededTotal":' || coalesce(seen, 0) || ',"terminalCount":' || coalesce(terminal, 0) || '}' AS checkpoint FROM backfill_runs r LEFT JOIN g USING (run_id))
"""


def _checkpoints(t: Tables):
    calls = t.backfill_run_calls.join(t.raw_transcripts.select("call_id", "soft_deleted_at"), "call_id").groupBy("run_id")
    done = calls.agg(F.unix_millis(F.min("started_at").cast("timestamp")).alias("watermark_ms"), F.count("*").alias("seen"), F.count_if(c("soft_deleted_at").isNotNull()).alias("terminal"))
    seen, terminal = (F.coalesce(x, F.lit(0)) for x in ("seen", "terminal"))
    rows = t.backfill_runs.select("run_id", "status").join(done, "run_id", "left")
    return rows.select("run_id", O.checkpoint_json(F.when(c("status") == "running", "sweep").otherwise("drain"), c("watermark_ms"), seen, seen, terminal).alias("checkpoint"))


#: What has become of a stored checkpoint: cut short, another key, another version, version as text, a broken counter, a counter below zero, gone, no object, a further key, or whole.
_STORED = """CASE run_id % 11 WHEN 0 THEN replace(checkpoint, '}', '') WHEN 1 THEN replace(checkpoint, '"phase"', '"stage"') WHEN 2 THEN replace(checkpoint, '"v":1', '"v":2') WHEN 3 THEN replace(checkpoint, '"v":1', '"v":"1"')
 WHEN 4 THEN replace(checkpoint, '"callsSeen":', '"callsSeen":0.5,"was":') WHEN 5 THEN replace(checkpoint, '"seededTotal":', '"seededTotal":-1') WHEN 6 THEN NULL WHEN 7 THEN concat('[', checkpoint, ']')
 WHEN 8 THEN replace(checkpoint, '{', '{"more":true,') ELSE checkpoint END"""
_COUNT = "coalesce(json_type(j, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(j, '$.{0}') AS DOUBLE) >= 0 AND CAST(json_extract_string(j, '$.{0}') AS DOUBLE) % 1 = 0, false)"
query("op_01", _PROGRESS + "SELECT run_id, checkpoint FROM cp")(_checkpoints)
query(
    "op_02",
    _PROGRESS + f""", s AS (SELECT run_id, {_STORED} AS raw FROM cp), v AS (SELECT run_id, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM s),
k AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN j IS NULL THEN 'malformed' WHEN coalesce(json_type(j, '$.v') = 'UBIGINT' AND json_extract_string(j, '$.v') = '1' AND json_extract_string(j, '$.phase') IN ('sweep', 'drain')
  AND json_type(j, '$.watermarkStartedAtMs') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL'), false) AND {" AND ".join(_COUNT.format(k) for k in O.COUNTERS)} THEN NULL ELSE 'unrecognised' END AS error FROM v)
SELECT run_id, error, CASE WHEN error IS NULL THEN json_extract_string(j, '$.phase') END AS phase, CASE WHEN error IS NULL THEN CAST(json_extract_string(j, '$.watermarkStartedAtMs') AS BIGINT) END AS watermark_ms,
  {", ".join(f"CASE WHEN error IS NULL THEN CAST(json_extract_string(j, '$.{k}') AS BIGINT) END AS {name}" for k, name in O.COUNTERS.items())} FROM k""",
)(lambda t: O.decoded(_checkpoints(t).select("run_id", F.expr(_STORED).alias("raw")), "raw").drop("raw"))

# -- gates, samples, duties ----------------------------------------------------------------------

#: A run needs four kinds of orders on record, and the fifth only where it writes match keys (an even window).
_GATES, _MATCHING = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), "5-LOW"
_MISSING = f"""SELECT run_id, coalesce(string_agg(gate, ',' ORDER BY gate), '') AS missing, count(gate) = 0 AS passes FROM (
  SELECT r.run_id, CASE WHEN NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = r.run_id AND o.o_orderpriority = w.gate) AND (w.gate <> '{_MATCHING}' OR window_id % 2 = 0) THEN w.gate END AS gate
  FROM backfill_runs r, (SELECT unnest([{", ".join(repr(g) for g in (*_GATES, _MATCHING))}]) AS gate) AS w) AS x GROUP BY run_id"""
query("op_06", _MISSING)(lambda t: O.missing_gates(t.backfill_runs, t.orders.select(c("o_custkey").alias("run_id"), c("o_orderpriority").alias("gate")), "run_id", _GATES, {_MATCHING: c("window_id") % 2 == 0}))

SAMPLE_SIZE = 200
_GUARDS = {"email": "[A-Za-z0-9._]+@[A-Za-z0-9]", "long_number": "[0-9]{7}", "zip": r"\b[0-9]{5}\b"}
query(
    "op_43",
    f""", u AS (SELECT call_id, status, current_stage, drop_reason FROM call_state ORDER BY created_at DESC, call_id DESC LIMIT {SAMPLE_SIZE}),
x AS (SELECT u.*, (SELECT arg_max(held_reason, (created_at, review_id)) FROM review_queue rq WHERE rq.call_id = u.call_id) AS hold_reason,
  (SELECT count(DISTINCT stage) FROM processing_log p WHERE p.call_id = u.call_id AND outcome = 'success') AS stages,
  EXISTS (SELECT 1 FROM structured_knowledge k WHERE k.call_id = u.call_id) AS record_present, ct.text,
  concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(ct.text, '{p}') THEN '{k}' END" for k, p in sorted(_GUARDS.items()))}) AS found FROM u LEFT JOIN clean_transcripts ct ON ct.call_id = u.call_id)
SELECT call_id, status AS pipeline_status, current_stage, drop_reason, hold_reason, stages, record_present, CASE WHEN found = '' THEN sha256(text) END AS text_sha256, found <> '' AS guard_tripped, found AS guard_categories FROM x""",
)(lambda t: O.sample_reports(t.call_state, t.review_queue, t.processing_log, t.structured_knowledge, t.clean_transcripts, SAMPLE_SIZE, _GUARDS))

_DUTIES = {
    "sweep": "SELECT started_at IS NULL AS failed FROM backfill_run_calls",
    "scan": f"SELECT cs.call_id IS NULL AS failed FROM review_queue rq LEFT JOIN call_state cs USING (call_id) WHERE rq.status IN ('open', 'in_review') AND rq.sla_due_at <= {TS}",
    "drain": "SELECT cs.call_id IS NULL AS failed FROM operator_actions oa LEFT JOIN call_state cs ON cs.call_id = oa.call_id * 100 + oa.k",
    "label_sync": "SELECT ct.text IS NULL AS failed FROM examples e LEFT JOIN clean_transcripts ct ON ct.call_id = e.id",
    "abandon": f"SELECT raw_purged_at IS NOT NULL AS failed FROM review_queue WHERE held_reason = 'missing_transcript' AND status = 'open' AND created_at <= {TS} - INTERVAL 24 HOURS",
}


def _with_call(t: Tables, rows):
    return rows.join(t.call_state.select("call_id", F.lit(False).alias("failed")), "call_id", "left").select(F.coalesce("failed", F.lit(True)).alias("failed"))


def _duties(t: Tables):
    return O.duties(
        t.spark,
        {
            "sweep": lambda: t.backfill_run_calls.select(c("started_at").isNull().alias("failed")),
            "scan": lambda: _with_call(t, S.sla_breaches(t.review_queue, at(), t.review_queue.limit(0)).select("call_id")),
            "drain": lambda: _with_call(t, t.operator_actions.select((c("call_id") * 100 + c("k")).alias("call_id"))),
            "label_sync": lambda: t.examples.join(t.clean_transcripts.select(c("call_id").alias("id"), c("text").isNull().alias("failed")), "id", "left").select(F.coalesce("failed", F.lit(True)).alias("failed")),
            "abandon": lambda: t.review_queue.filter((c("held_reason") == "missing_transcript") & (c("status") == "open") & (c("created_at") <= at() - F.expr("INTERVAL 24 HOURS"))).select(c("raw_purged_at").isNotNull().alias("failed")),
        },
    )


query(
    "op_52",
    ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS duty, count(*) AS n, count(*) FILTER (WHERE failed) AS failed FROM ({q}) AS x_{k}" for k, q in _DUTIES.items()) + ") SELECT duty, n, failed, failed = 0 AS complete, (SELECT bool_and(failed = 0) FROM u) AS ping FROM u",
)(_duties)

# -- scans of candidates -------------------------------------------------------------------------

_CLEAR = "soft_deleted_at IS NULL AND hard_deleted_at IS NULL"
_KEPT = ("call_id", "phrases", "status", "failed_at", "kind", "counts")
query(
    "wr_13",
    f"SELECT e.call_id, CASE WHEN hit THEN '[]' ELSE phrases END AS phrases, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN {TS} ELSE failed_at END AS failed_at, "
    "CASE WHEN hit THEN x.kind ELSE e.kind END AS kind, CASE WHEN hit THEN x.counts ELSE e.counts END AS counts FROM "
    f"(SELECT ec.*, {_CLEAR} AND EXISTS (SELECT 1 FROM pii_scans s WHERE s.call_id = ec.call_id AND s.kind IS NOT NULL) AS hit FROM extraction_candidates ec) AS e LEFT JOIN pii_scans x ON x.call_id = e.call_id",
)(lambda t: O.scan_failed(t.extraction_candidates, t.pii_scans, at()).select(*_KEPT))
query(
    "wr_14",
    f"SELECT call_id, phrases, CASE WHEN {_CLEAR} AND status = 'pending' AND EXISTS (SELECT 1 FROM pii_scans s WHERE s.call_id = ec.call_id AND s.kind IS NULL) THEN 'passed' ELSE status END AS status, failed_at, kind, counts FROM extraction_candidates ec",
)(lambda t: O.scan_passed(t.extraction_candidates, t.pii_scans).select(*_KEPT))

# -- texts of alerts: codes in turn, some unknown, some of another severity than the catalogue's -----------------

_CODES = list(V.FAILURES)
_SCOPES = ("call_id", "stage", "component")
_SAID = {k: k.replace("_", " ").lower() for k in _CODES}
#: The catalogue's rows; its sentences are made from the codes.
_CATALOG = [(k, s, f"{_SAID[k]} was seen.", f"{_SAID[k]} at the source.", "Calls wait.", "Look at the source.", None if s == "low" else "Mend the source.", s != "critical", "held" if s == "critical" else "retried", f"runbook/{k.lower()}") for k, s in V.FAILURES.items()]
_CATALOG_COLUMNS = ("code", "severity", *O.SENTENCES, "data_safe", "calls", "runbook")
_ALERTS = """SELECT alert_id, CASE WHEN attempts = 6 THEN error_code ELSE code END AS code, CASE WHEN attempts = 5 THEN severity ELSE usual END AS severity, created_at, call_id, CASE WHEN attempts % 2 = 0 THEN component END AS stage, CASE WHEN attempts <> 1 THEN component END AS component
 FROM alert_events JOIN catalog ON catalog.place = alert_id % {n}"""


def _alert_texts(t: Tables):
    spark = t.spark
    catalog = spark.createDataFrame(_CATALOG, "code string, severity string, " + ", ".join(f"{s} string" for s in O.SENTENCES) + ", data_safe boolean, calls string, runbook string")
    places = spark.createDataFrame([(i, k, V.FAILURES[k]) for i, k in enumerate(_CODES)], "place long, code string, usual string")
    body = _ALERTS.format(n=len(_CODES)).replace("FROM alert_events", "FROM {a}").replace("JOIN catalog ON catalog.", "JOIN {p} p ON p.")
    return O.alert_texts(spark.sql(body, a=t.alert_events, p=places), catalog, "production", _SCOPES)


def _sql_value(x):
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


query(
    "op_17",
    f""", catalog AS (SELECT place, code, usual, {", ".join(_CATALOG_COLUMNS[2:])} FROM (VALUES {", ".join(f"({i}, {', '.join(map(_sql_value, row))})" for i, row in enumerate(_CATALOG))}) AS v(place, code, usual, {", ".join(_CATALOG_COLUMNS[2:])})),
al AS ({_ALERTS.format(n=len(_CODES))}), w AS (SELECT al.*, c.* EXCLUDE (code), CASE WHEN c.code IS NULL THEN 'unknown code' WHEN al.severity <> c.usual THEN 'other severity' END AS reason FROM al LEFT JOIN catalog c ON c.code = al.code)
SELECT alert_id, reason, CASE WHEN reason IS NULL THEN '[' || severity || '] ' || code || ' in production at ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(10) || 'What broke: ' || what_broke || chr(10) || 'Likely root cause: ' || likely_cause
  || chr(10) || 'Impact: ' || impact || chr(10) || 'Immediate remediation: ' || remedy_now || chr(10) || 'Longer-term fix: ' || coalesce(remedy_later, 'Same as the immediate step.') || chr(10) || 'Customer data safe: ' || CASE WHEN data_safe THEN 'yes' ELSE 'no' END
  || chr(10) || 'Calls: ' || calls || chr(10) || 'Affected: ' || coalesce(nullif(concat_ws(', ', {", ".join(f"CASE WHEN {s} IS NOT NULL THEN '{s}' END" for s in _SCOPES)}), ''), 'none') || chr(10) || 'Runbook: ' || runbook END AS text FROM w""",
)(_alert_texts)
