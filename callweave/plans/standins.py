"""The given star-schema tables in the shapes that the operators work on.

Each stand-in is a list of (name, expression) pairs over one table or a short SELECT, in expressions that Spark and
ANSI SQL read alike, so that a query and its SQL start from the same rows. `Tables` gives them as DataFrames,
`WITH` as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..spread import spread

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
#: The clock of all queries.
NOW = "2024-01-20 12:00:00"
RETENTION_NOW = "2001-06-01 00:00:00"
CALL = f"(user_id * 100 + {K})"
_STAGE = (
    "CASE event_type WHEN 'view' THEN 'metadata-pre-filter' WHEN 'signup' THEN 'fetch-transcript' WHEN 'click' THEN 'redact' "
    "WHEN 'error' THEN 'classify' ELSE 'extract' END"
)
_REASON = (
    f"CASE {K} % 6 WHEN 0 THEN 'redaction_failed' WHEN 1 THEN 'classifier_uncertain' WHEN 2 THEN 'schema_invalid' "
    "WHEN 3 THEN 'missing_transcript' WHEN 4 THEN 'classified_spam' ELSE 'cost_cap_held' END"
)

SOURCES: dict[str, str] = {
    "processing_log": f"SELECT event_id AS id, {CALL} AS call_id, {_STAGE} AS stage, CASE WHEN value < 40 THEN 'success' WHEN value < 80 THEN 'held' ELSE 'failed' END AS outcome, "
    f"CASE WHEN event_type = 'error' THEN props END AS detail, {K} AS k, ts AS created_at FROM events",
    "call_state": f"SELECT call_id, status, stage AS current_stage, CASE WHEN status = 'skipped' THEN CASE WHEN k % 2 = 0 THEN 'classified_non_customer' ELSE 'zero_duration' END END AS drop_reason, "
    "duration, k, created_at, updated_at FROM ("
    f"SELECT {CALL} AS call_id, {_STAGE} AS stage, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'held' WHEN 'signup' THEN 'review_closed' ELSE 'processing' END AS status, "
    f"value AS duration, {K} AS k, ts AS updated_at, min(ts) OVER (PARTITION BY {CALL}) AS created_at, row_number() OVER (PARTITION BY {CALL} ORDER BY ts DESC, event_id DESC) AS n FROM events) AS x WHERE n = 1",
    "structured_knowledge": "SELECT o_orderkey AS call_id, c_mktsegment AS service_category, o_orderstatus AS call_intent, o_orderpriority AS urgency, c_name AS problem_statement, "
    "c_mktsegment AS lang1, o_orderpriority AS lang2, o_totalprice AS price, o_orderdate AS created_at, CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 1 END AS superseded_by_call_id "
    "FROM orders JOIN customer ON o_custkey = c_custkey",
    "technician_notes": "SELECT l_orderkey AS call_id, min(l_returnflag) AS prompt_version, min(l_linestatus) AS scope_signal, max(l_quantity) AS quantity, min(l_shipdate) AS created_at FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey",
    "note_feedback": f"SELECT event_id AS id, user_id AS call_id, event_type AS field_path, concat('reviewer', CAST({K} % 4 AS STRING)) AS reviewer, "
    f"CASE {K} % 5 WHEN 0 THEN 'wrong' WHEN 1 THEN 'missing' WHEN 2 THEN 'should_not_be_here' ELSE 'correct' END AS verdict, ts AS created_at FROM events",
    "review_queue": f"SELECT event_id AS review_id, {CALL} AS call_id, {_REASON} AS held_reason, CASE WHEN value < 15 THEN 'open' WHEN value < 30 THEN 'in_review' WHEN value < 70 THEN 'resolved' ELSE 'unresolvable' END AS status, "
    f"{K} AS k, ts AS created_at, CASE WHEN {K} % 9 <> 0 THEN ts + INTERVAL 2 DAYS END AS sla_due_at, CASE WHEN {K} % 7 = 0 THEN ts + INTERVAL 1 DAYS END AS raw_purged_at FROM events WHERE event_type IN ('error', 'signup')",
    "alert_events": f"SELECT event_id AS alert_id, {CALL} AS call_id, CASE {K} % 3 WHEN 0 THEN 'MODEL_TIMEOUT' WHEN 1 THEN 'REVIEW_QUEUE_STALLED' ELSE 'QUEUE_BACKLOG' END AS error_code, "
    f"CASE {K} % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, concat('alert:user:', CAST(user_id AS STRING)) AS dedup_key, "
    f"ts AS created_at, CASE WHEN {K} % 3 = 1 THEN ts + INTERVAL 6 HOURS END AS acknowledged_at, CASE WHEN value < 30 THEN 'delivered' WHEN value < 60 THEN 'failed' ELSE 'pending' END AS delivery_state, "
    f"{K} % 7 AS attempts, event_type AS component FROM events WHERE event_type IN ('error', 'purchase')",
    "model_invocations": f"SELECT event_id AS id, user_id AS call_id, {_STAGE} AS stage, concat('model', CAST({K} % 3 AS STRING)) AS model, {K} AS tokens, ts AS created_at FROM events WHERE event_type IN ('view', 'click')",
    "operator_actions": f"SELECT event_id AS action_id, user_id AS call_id, CASE {K} % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'mark_spam' ELSE 'reveal_raw' END AS action, {K} AS k, ts AS created_at FROM events WHERE event_type = 'purchase'",
    "daily_cost": f"SELECT event_id AS id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(12,6)) AS cost, {K} AS tokens, ts AS at FROM events",
    "dead_letter": f"SELECT event_id AS id, {CALL} AS call_id, CASE {K} % 3 WHEN 0 THEN 'MODEL_TIMEOUT' WHEN 1 THEN 'STORE_DOWN' ELSE 'BAD_INPUT' END AS error_code, ts AS failed_at, CASE WHEN {K} % 4 = 0 THEN ts + INTERVAL 3 HOURS END AS cleared_at FROM events WHERE event_type = 'error' AND value > 30",
    "heartbeats": f"SELECT event_type AS component, user_id AS worker, CASE WHEN {K} % 10 = 0 THEN 'degraded' ELSE 'ok' END AS status, event_id AS id, ts AS seen_at FROM events",
    "raw_transcripts": "SELECT o_orderkey AS call_id, o_orderkey AS row_id, o_custkey AS key_version, o_orderdate AS retention_eligible_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 40 DAYS END AS soft_deleted_at, "
    "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 90 DAYS END AS hard_deleted_at FROM orders",
    "token_vault": "SELECT CASE WHEN l_partkey % 40 = 0 THEN -l_orderkey ELSE l_orderkey END AS call_id, l_orderkey * 10 + l_linenumber AS row_id, concat('[NAME_', CAST(l_linenumber AS STRING), ']') AS token, l_suppkey AS key_version, "
    "l_shipdate AS retention_eligible_at, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 40 DAYS END AS soft_deleted_at, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_shipdate + INTERVAL 90 DAYS END AS hard_deleted_at FROM lineitem",
    "key_versions": "SELECT s_suppkey AS version, s_nationkey AS kek, CASE WHEN s_acctbal < 0 THEN 'destroyed' WHEN s_acctbal < 3000 THEN 'retired' WHEN s_acctbal < 6000 THEN 'rotating' ELSE 'active' END AS status, s_acctbal AS balance FROM supplier",
    "backfill_runs": "SELECT c_custkey AS run_id, c_nationkey AS window_id, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 4000 THEN 'running' ELSE 'completed' END AS status, c_acctbal AS progress FROM customer",
    "backfill_run_calls": "SELECT o_custkey AS run_id, o_orderkey AS call_id, o_orderdate AS started_at FROM orders",
    "examples": "SELECT doc_id AS id, quality AS expected, toxic AS task FROM labels",
    "turns": "SELECT conv_id AS call_id, turn, role, text FROM conversations",
    "extraction_candidates": "SELECT o_orderkey AS call_id, concat('[\"', o_orderpriority, '\"]') AS phrases, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, "
    "CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS failed_at, CASE WHEN o_orderstatus = 'P' THEN 'residual_pii' END AS kind, CASE WHEN o_orderstatus = 'P' THEN concat(chr(123), '\"phone\":1', chr(125)) END AS counts, "
    "CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 40 DAYS END AS soft_deleted_at, CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 90 DAYS END AS hard_deleted_at FROM orders",
    "pii_scans": "SELECT call_id, CASE WHEN phones > 0 THEN 'residual_pii' WHEN dropped > 0 THEN 'tokened_phrase' WHEN mismatched > 0 THEN 'verbatim_mismatch' END AS kind, "
    "CASE WHEN phones > 0 THEN concat(chr(123), '\"phone\":', CAST(phones AS STRING), chr(125)) WHEN dropped > 0 THEN concat(chr(123), '\"dropped_count\":', CAST(dropped AS STRING), chr(125)) "
    "WHEN mismatched > 0 THEN concat(chr(123), '\"mismatch_count\":', CAST(mismatched AS STRING), ',\"phrase_count\":', CAST(n AS STRING), chr(125)) END AS counts FROM ("
    "SELECT l_orderkey AS call_id, count(*) AS n, count(CASE WHEN l_quantity >= 49 THEN 1 END) AS phones, count(CASE WHEN l_quantity <= 2 THEN 1 END) AS dropped, count(CASE WHEN l_partkey % 9 = 0 THEN 1 END) AS mismatched "
    "FROM lineitem GROUP BY l_orderkey) AS x",
    "clean_transcripts": "SELECT doc_id AS call_id, text, lang, source FROM documents",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def with_sql() -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in SOURCES.items())


WITH = with_sql()
#: Tables of whole texts, on which detectors work long.
TEXTS = ("documents", "pages")


class Tables:
    """Stand-ins and given tables as DataFrames, each read only when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXTS else table

    def dealt(self, name: str) -> DataFrame:
        """A table or stand-in whose rows cost work: what it reads is over all cores, where it lies in few partitions."""
        return self._made(name, lambda t: spread(self.given(t)))

    def _made(self, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
        if name in TABLES:
            return read(name)
        if name in SOURCES:
            body = SOURCES[name]
            used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", body)]
            for t in used:
                body = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", body)
            return self.spark.sql(body, **{t: read(t) for t in used})
        raise AttributeError(name)

    def __getattr__(self, name: str) -> DataFrame:
        return self._made(name, self.given)
