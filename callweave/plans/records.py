"""Records, failures, reports and job outcomes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import redaction as X
from ..operators import rows as R
from ..operators import states as S
from . import flows
from .registry import at, query
from .standins import NOW, Tables
from .texts import DENY

c = F.col
TS = f"TIMESTAMP '{NOW}'"
LIVE = "soft_deleted_at IS NULL AND hard_deleted_at IS NULL"

# -- labelled records ----------------------------------------------------------------------

_INTENT = "CASE call_intent WHEN 'O' THEN 'new_booking' WHEN 'F' THEN 'billing' ELSE 'unheard_of' END"
_CATEGORY = "CASE service_category WHEN 'BUILDING' THEN 'leak_detection_or_repair' WHEN 'HOUSEHOLD' THEN 'toilet' ELSE 'other' END"
_URGENCY = "CASE urgency WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'urgent' WHEN '5-LOW' THEN 'some day' ELSE 'routine' END"
_SENTIMENT = "CASE call_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' ELSE 'frustrated' END"
ENUMS = {"call_intent": (_INTENT, V.CALL_INTENTS), "service_category": (_CATEGORY, V.SERVICE_CATEGORIES), "urgency": (_URGENCY, V.URGENCIES), "sentiment": (_SENTIMENT, V.SENTIMENTS)}
#: Fixed value: what stands for a text that only a person may write.
PLACEHOLDER = "Human-reviewed extraction correction"


def extract_record(enums: dict[str, F.Column]) -> F.Column:
    """The full record around its four enums: a placeholder statement, empty lists, nothing else known."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    lists = {k: empty for k in ("symptoms", "customer_language", "competitor_mentions", "concerns")}
    open_ = {k: none for k in ("location_in_home", "access_or_scheduling_notes", "prior_attempts", "acquisition_source")}
    fields = {"call_intent": enums["call_intent"], "service_category": enums["service_category"], "problem_statement": F.lit(PLACEHOLDER), **lists, **open_, "urgency": enums["urgency"], "sentiment": enums["sentiment"]}
    return F.struct(*(v.alias(k) for k, v in fields.items()))




def _enums():
    return {k: F.expr(e) for k, (e, _) in ENUMS.items()}


query(
    "op_14",
    f"SELECT call_id, '{{\"call_intent\":\"' || {_INTENT} || '\",\"service_category\":\"' || {_CATEGORY} || '\",\"problem_statement\":\"{PLACEHOLDER}\",\"symptoms\":[],\"customer_language\":[],\"competitor_mentions\":[],\"concerns\":[],"
    f"\"location_in_home\":null,\"access_or_scheduling_notes\":null,\"prior_attempts\":null,\"acquisition_source\":null,\"urgency\":\"' || {_URGENCY} || '\",\"sentiment\":\"' || {_SENTIMENT} || '\"}}' AS record FROM structured_knowledge",
)(lambda t: t.structured_knowledge.select("call_id", F.to_json(extract_record(_enums()), {"ignoreNullFields": "false"}).alias("record")))
_FAILS = " ".join(f"WHEN {e} NOT IN ({', '.join(repr(x) for x in domain)}) THEN '{k}'" for k, (e, domain) in ENUMS.items())
query("op_15", f"SELECT call_id, CASE {_FAILS} END AS failed_field, CASE WHEN (CASE {_FAILS} END) IS NULL THEN concat_ws('|', {', '.join(e for e, _ in ENUMS.values())}) END AS expected FROM structured_knowledge")(
    lambda t: t.structured_knowledge.withColumns(_enums()).withColumn("failed_field", F.coalesce(*(F.when(~c(k).isin(*domain), k) for k, (_, domain) in ENUMS.items())))
    .select("call_id", "failed_field", F.when(c("failed_field").isNull(), F.concat_ws("|", *ENUMS)).alias("expected"))
)

# -- failures ----------------------------------------------------------------------

#: The failure catalogue of the queries: code -> (category, severity, impact, remedy now, remedy for good, data safe, state of calls, owner, runbook).
CATALOG = {
    "MODEL_TIMEOUT": ("model", "high", "answers are late", "try again", "raise the limit", True, "waiting", "pipeline", "runbook/model"),
    "REVIEW_QUEUE_STALLED": ("review", "medium", "reviews wait", "call a reviewer", "more reviewers", True, "held", "operations", "runbook/review"),
    "QUEUE_BACKLOG": ("queue", "low", "calls wait", "add a worker", "more workers", True, "queued", "platform", "runbook/queue"),
}
FIELDS = ("root_cause_category", "severity", "impact", "remediation_now", "remediation_fix", "data_safe", "calls_state", "owner", "runbook_ref")


def catalog(t: Tables):
    """(error_code, FIELDS): a small fixed table."""
    return t.spark.createDataFrame([(k, *v) for k, v in CATALOG.items()], "error_code string, " + ", ".join(f"{f} {'boolean' if f == 'data_safe' else 'string'}" for f in FIELDS))


_CATALOG = "catalog(error_code, " + ", ".join(FIELDS) + ") AS (VALUES " + ", ".join(f"('{k}', " + ", ".join("true" if x is True else f"'{x}'" for x in v) + ")" for k, v in CATALOG.items()) + ")"


def failures(t: Tables):
    """Every failure that the log names, with its catalogue entry; an unknown code is no failure of the catalogue."""
    return t.dead_letter.select("id", "call_id", "error_code").join(catalog(t), "error_code", "left")


query("op_20", f", {_CATALOG} SELECT id, d.error_code, k.severity, k.root_cause_category, k.owner, k.error_code IS NOT NULL AS known FROM dead_letter d LEFT JOIN catalog k USING (error_code)")(
    lambda t: failures(t).select("id", "error_code", "severity", "root_cause_category", "owner", c("owner").isNotNull().alias("known"))
)
_SNAPSHOT = ("error_code", "root_cause_category", "severity", "impact", "processing_state", "remediation_now", "remediation_fix", "data_safe", "calls_state", "owner", "runbook_ref")
query(
    "op_19",
    f", {_CATALOG} SELECT id, '{{' || " + " || ',' || ".join(f"'\"{f}\":' || " + ("'true'" if f == "data_safe" else "'\"degraded\"'" if f == "processing_state" else f"'\"' || k.{f} || '\"'") for f in _SNAPSHOT)
    + " || ',\"context\":{\"call_id\":\"' || call_id || '\"}}' AS snapshot FROM dead_letter d JOIN catalog k USING (error_code)",
)(
    lambda t: failures(t).filter("owner IS NOT NULL").withColumn("processing_state", F.lit("degraded"))
    .select("id", F.to_json(F.struct(*_SNAPSHOT, F.create_map(F.lit("call_id"), c("call_id").cast("string")).alias("context"))).alias("snapshot"))
)
_STORED = "alert_id % 3 = 0"
query(
    "op_18",
    f", {_CATALOG} SELECT alert_id, '[' || CASE WHEN {_STORED} THEN 'low' ELSE a.severity END || '] ' || error_code || ': ' || CASE WHEN {_STORED} THEN 'as it was stored' ELSE impact END || ' (' || owner || ')' AS text, "
    f"{_STORED} AS stored FROM alert_events a JOIN catalog k USING (error_code)",
)(
    # a third of the alerts have a valid snapshot, a third a broken one and a third none: those are rebuilt from the catalogue
    lambda t: t.alert_events.select(
        "alert_id", "error_code", c("severity").alias("kept_severity"),
        F.when(F.expr(_STORED), F.to_json(F.struct("error_code", F.lit("low").alias("severity"), F.lit("as it was stored").alias("impact")))).when(c("alert_id") % 3 == 1, "{broken").alias("snapshot"),
    )
    .withColumn("read", F.from_json("snapshot", "error_code string, severity string, impact string"))
    .withColumn("stored", F.coalesce((c("read.error_code") == c("error_code")) & c("read.severity").isin(*V.SEVERITIES) & c("read.impact").isNotNull(), F.lit(False)))
    .join(catalog(t), "error_code")
    .select("alert_id", F.format_string("[%s] %s: %s (%s)", F.when(c("stored"), c("read.severity")).otherwise(c("kept_severity")), c("error_code"), F.when(c("stored"), c("read.impact")).otherwise(c("impact")), c("owner")).alias("text"), "stored")
)
#: Keys of a failure's context that may be kept: none holds content.
SAFE_CONTEXT = V.DEDUP_SCOPES
query(
    "op_51",
    "SELECT id, CASE WHEN outcome = 'failed' THEN 'STAGE_FAILED' ELSE 'UNKNOWN' END AS error_code, CAST(call_id AS VARCHAR) AS call_id, stage, CASE WHEN detail IS NULL THEN 2 ELSE 3 END - 2 AS dropped FROM processing_log WHERE outcome <> 'success'",
)(
    lambda t: t.processing_log.filter("outcome <> 'success'")
    .select("id", F.when(c("outcome") == "failed", "STAGE_FAILED").otherwise("UNKNOWN").alias("error_code"),
            F.map_filter(F.create_map(F.lit("call_id"), c("call_id").cast("string"), F.lit("stage"), c("stage"), F.lit("message"), c("detail")), lambda k, v: v.isNotNull()).alias("context"))
    .withColumn("safe", F.map_filter("context", lambda k, v: k.isin(*SAFE_CONTEXT)))
    .select("id", "error_code", c("safe")["call_id"].alias("call_id"), c("safe")["stage"].alias("stage"), (F.size("context") - F.size("safe")).alias("dropped"))
)

# -- sanitised exports ----------------------------------------------------------------------

_TEXTS = ("problem_statement", "lang1", "lang2")
_LONG = "'[0-9]{7}'"
_SQUEEZED = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_CONCERNS = "[lang1, 'call ' || (1000000 + call_id), 'since ' || call_intent]"
query(
    "op_22",
    f"SELECT call_id, {', '.join(f'CASE WHEN NOT regexp_matches({_SQUEEZED(x)}, {_LONG}) THEN {x} END AS {x}' for x in _TEXTS)}, "
    f"array_to_string(list_filter({_CONCERNS}, lambda x: NOT regexp_matches({_SQUEEZED('x')}, {_LONG})), '; ') AS concerns, service_category, urgency FROM structured_knowledge",
)(
    lambda t: t.dealt("structured_knowledge").withColumn("concerns", F.array("lang1", F.concat(F.lit("call "), (c("call_id") + 1000000).cast("string")), F.concat(F.lit("since "), "call_intent")))
    .transform(lambda d: X.sanitized_rows(d, list(_TEXTS), ["concerns"], DENY)).select("call_id", *_TEXTS, F.array_join("concerns", "; ").alias("concerns"), "service_category", "urgency")
)


def _report(t: Tables):
    """A report a call: state, newest open hold, redacted text and record, free text withheld as a whole if the scan finds anything.

    Texts are scanned where they lie and only their verdicts go on: no text is dealt out by call.
    """
    held = R.latest(t.review_queue.filter(c("status").isin("open", "in_review")), ["call_id"], ["created_at", "review_id"]).select("call_id", c("held_reason").alias("hold_reason"))
    texts = t.clean_transcripts.select("call_id", "text", F.array_sort(F.map_keys(X.residual(c("text"), DENY))).alias("in_text"))
    texts = texts.select("call_id", "in_text", F.md5(F.when(F.size("in_text") == 0, c("text"))).alias("text_md5"))
    known = t.structured_knowledge.select("call_id", "service_category", "urgency", "problem_statement", "lang1")
    rows = t.call_state.select("call_id", "status", "current_stage", "drop_reason").join(held, "call_id", "left").join(texts, "call_id", "left").join(known, "call_id", "left")
    free = F.concat_ws("\n", F.coalesce("problem_statement", F.lit("")), F.coalesce("lang1", F.lit("")))
    found = rows.withColumn("in_text", F.coalesce("in_text", F.array().cast("array<string>"))).withColumn("in_record", F.array_sort(F.map_keys(X.residual(free, DENY))))
    shown = lambda col, hits: F.when(F.size(hits) == 0, F.col(col)).alias(col)
    return found.select(
        "call_id", "status", "current_stage", "drop_reason", "hold_reason", "text_md5", "service_category", "urgency",
        shown("problem_statement", "in_record"), shown("lang1", "in_record"), F.array_join(F.array_sort(F.array_union("in_text", "in_record")), ",").alias("guard"),
    )


query("op_42")(_report)

# -- jobs ----------------------------------------------------------------------

#: Consents that any run needs, and the one that only some need.
GATES = ("dialpad_recording_consent", "signed_services_agreement", "signed_data_processing_addendum", "anthropic_no_training_confirmation", "anthropic_data_retention_confirmation")
MATCHING_GATE = "servicetitan_matching_consent"
query("op_40", f"SELECT run_id, '{','.join(GATES)}' || CASE WHEN window_id % 2 = 0 THEN ',{MATCHING_GATE}' ELSE '' END AS required FROM backfill_runs")(
    lambda t: t.backfill_runs.select("run_id", F.array_join(F.concat(F.array(*map(F.lit, GATES)), F.when(c("window_id") % 2 == 0, F.array(F.lit(MATCHING_GATE))).otherwise(F.array().cast("array<string>"))), ",").alias("required"))
)
_EXTRACTED = "SELECT sk.call_id, sk.superseded_by_call_id IS NULL AND p.call_id IS NOT NULL AS eligible, EXISTS (SELECT 1 FROM technician_notes n WHERE n.call_id = sk.call_id AND n.scope_signal = 'O') AS busy FROM structured_knowledge sk LEFT JOIN (SELECT * FROM raw_transcripts WHERE " + LIVE + ") AS p ON p.call_id = sk.call_id"
query("op_45", f"SELECT count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND NOT busy) AS enqueued, count(*) FILTER (WHERE NOT eligible OR busy) AS skipped FROM ({_EXTRACTED}) AS x")(
    lambda t: t.structured_knowledge.select("call_id", "superseded_by_call_id")
    .join(t.raw_transcripts.filter(LIVE).select("call_id", F.lit(True).alias("live")), "call_id", "left")
    .join(t.technician_notes.filter("scope_signal = 'O'").select("call_id", F.lit(True).alias("busy")), "call_id", "left")
    .select((c("superseded_by_call_id").isNull() & c("live").isNotNull()).alias("eligible"), c("busy").isNotNull().alias("busy"))
    .agg(F.count_if("eligible").alias("eligible"), F.count_if(c("eligible") & ~c("busy")).alias("enqueued"), F.count_if(~c("eligible") | c("busy")).alias("skipped"))
)
_RUN = "CASE WHEN lang <> 'en' THEN 'complete' WHEN count(*) FILTER (WHERE toxic = 0) = 0 THEN 'skipped' ELSE 'partial' END"
query(
    "op_47",
    f"SELECT lang, n, correct, accuracy, status, status <> 'skipped' AND lang <> 'de' AS persisted FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = {flows._PRED}) AS correct, "
    f"round(count(*) FILTER (WHERE quality = {flows._PRED}) / count(*), 6) AS accuracy, {_RUN} AS status FROM labels JOIN documents USING (doc_id) GROUP BY lang) AS x",
)(
    # the labels are synced with their documents, evaluated by language, and the report is kept unless the run is a dry one (here: German)
    lambda t: S.accuracy(flows._pairs(t), ["lang"])
    .join(flows._pairs(t).groupBy("lang").agg(F.count("*").alias("all"), F.count_if(c("toxic") == 0).alias("done")).select("lang", S.run_status(c("all"), c("done"), F.when(c("lang") == "en", "cost_capped")).alias("status")), "lang")
    .withColumn("persisted", (c("status") != "skipped") & (c("lang") != "de"))
)
_DUE = f"delivery_state IN ('pending', 'failed') AND attempts < 5 AND created_at + INTERVAL 30 MINUTES <= {TS}"
_SENT = "CASE WHEN attempts = 4 THEN 'gave_up' WHEN error_code = 'QUEUE_BACKLOG' THEN 'failed' ELSE 'delivered' END"
query("op_55", f"SELECT {_SENT} AS outcome, count(*) AS n FROM alert_events WHERE {_DUE} GROUP BY 1")(
    lambda t: R.counts(t.alert_events.filter(c("delivery_state").isin("pending", "failed") & (c("attempts") < 5) & (c("created_at") + F.expr("INTERVAL 30 MINUTES") <= at())).withColumn("outcome", F.expr(_SENT)), ["outcome"])
)

# -- budgets ----------------------------------------------------------------------

SPENDING = flows.SPENDING
_ANSWER = "CASE event_type WHEN 'click' THEN 'truncated' WHEN 'error' THEN 'non_json' WHEN 'signup' THEN 'schema_invalid' END"


def _answered(t: Tables):
    """Each model call of the day with its answer; one over the budget is never made."""
    events = t.events.select(c("event_id").alias("id"), "event_type")
    answer = F.when(c("event_type") == "error", "{").when(c("event_type") == "signup", '{"bucket":"unheard_of"}').otherwise('{"bucket":"view"}')
    stop = F.when(c("event_type") == "click", "max_tokens").otherwise("end_turn")
    read = flows._budget(t).join(events, "id").withColumn("read", X.strict_record(answer, stop, {"bucket": ("view", "purchase")}))
    return read.select("id", "accepted", c("read.failure").alias("failure"))


query("op_49", SPENDING.format(cap=4000) + f" SELECT s.id, CASE WHEN NOT ok THEN 'cost_capped' WHEN {_ANSWER} IS NOT NULL THEN 'failed:' || {_ANSWER} ELSE 'predicted' END AS status FROM spent s JOIN events ON event_id = s.id")(
    lambda t: _answered(t).select("id", F.when(~c("accepted"), "cost_capped").when(c("failure").isNotNull(), F.concat(F.lit("failed:"), "failure")).otherwise("predicted").alias("status"))
)
query("op_50", SPENDING.format(cap=4000) + f" SELECT CASE WHEN NOT ok THEN 'deferred' WHEN {_ANSWER} = 'truncated' THEN 'retry' WHEN {_ANSWER} IS NOT NULL THEN 'rejected' ELSE 'written' END AS outcome, count(*) AS n FROM spent s JOIN events ON event_id = s.id GROUP BY 1")(
    lambda t: R.counts(_answered(t).select(F.when(~c("accepted"), "deferred").when(c("failure") == "truncated", "retry").when(c("failure").isNotNull(), "rejected").otherwise("written").alias("outcome")), ["outcome"])
)
