"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab as V
from ..operators import redaction as X
from .registry import at, hmac_sql, query
from .standins import NOW

c = F.col
TS = f"TIMESTAMP '{NOW}'"

query("fn_01", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS v FROM documents")(lambda t: t.documents.select("doc_id", F.md5(C.normal_token(c("text"))).alias("v")))
query("fn_02", "SELECT item_id, trim(regexp_replace(translate(lower(text), '‘’', ''''''), '\\s+', ' ', 'g')) AS v FROM benchmark")(lambda t: t.benchmark.select("item_id", C.normal_light(c("text")).alias("v")))
query("fn_03", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[''‘’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS v FROM documents")(lambda t: t.documents.select("doc_id", F.md5(C.normal_verbatim(c("text"))).alias("v")))
query(
    "fn_04",
    "SELECT item_id, array_to_string([CASE WHEN regexp_matches(x[i], '^[a-z]$') AND (i = 1 OR NOT regexp_matches(x[i - 1], '^[A-Za-z'']$')) THEN upper(x[i]) ELSE x[i] END FOR i IN range(1, len(x) + 1)], '') AS v "
    "FROM (SELECT item_id, string_split(text, '') AS x FROM benchmark) AS y",
)(lambda t: t.benchmark.select("item_id", X.title_case(c("text")).alias("v")))
query("fn_05", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS phone, trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) AS name, lower(trim(c_name)) AS email FROM customer")(
    lambda t: t.customer.select("c_custkey", C.phone_key(c("c_name")).alias("phone"), C.name_key(c("c_name")).alias("name"), C.email_key(c("c_name")).alias("email"))
)
query("fn_06", "SELECT review_id, upper(held_reason[1:1]) || replace(held_reason, '_', ' ')[2:] AS label FROM review_queue")(lambda t: t.review_queue.select("review_id", C.humanized(c("held_reason")).alias("label")))
_LINE = r"trim(CASE WHEN regexp_matches(w, '(?s)^.*?[.!?](?:[ \t\n\x0B\f\r]|$)') THEN regexp_extract(w, '(?s)^(.*?[.!?])(?:[ \t\n\x0B\f\r]|$)', 1) ELSE regexp_extract(w, '^[^\n]*') END)"
query("fn_07", f"SELECT doc_id, CASE WHEN w = '' THEN NULL WHEN length(line) > 240 THEN rtrim(substring(line, 1, 239)) || '…' ELSE line END AS line FROM (SELECT doc_id, w, {_LINE} AS line FROM (SELECT doc_id, trim(text) AS w FROM documents) AS x) AS y")(lambda t: t.documents.select("doc_id", C.first_line(c("text")).alias("line")))
query(
    "fn_08",
    """
, d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws, regexp_split_to_array(text, '[A-Za-z0-9]+') AS gaps FROM documents),
h AS (SELECT doc_id, text, gaps, ws, unnest(list_filter(range(1, len(ws) + 1), lambda i: lower(ws[i]) = 'license')[1:5]) AS i FROM d WHERE contains(lower(text), 'license')),
p AS (SELECT doc_id, text, i, length(array_to_string(gaps[1:i], '')) + length(array_to_string(ws[1:i - 1], '')) AS s FROM h)
SELECT doc_id, coalesce(string_agg(substring(text, greatest(s - 48, 0) + 1, least(s, 48) + 7 + 48), '|' ORDER BY i) FILTER (WHERE i IS NOT NULL), '') AS windows FROM documents LEFT JOIN (SELECT doc_id, text AS t, i, s FROM p) AS q USING (doc_id) GROUP BY doc_id""",
)(lambda t: t.documents.select("doc_id", F.array_join(X.contexts(c("text"), "license"), "|").alias("windows")))
query("fn_09", "SELECT event_id, (SELECT sum(CASE WHEN i % 2 = 0 THEN d ELSE (2 * d) // 10 + (2 * d) % 10 END) FROM (SELECT i, CAST(reverse(s)[i + 1:i + 1] AS INT) AS d FROM (SELECT unnest(range(length(s))) AS i)) AS y) % 10 = 0 AS ok FROM (SELECT event_id, CAST(event_id * 7919 AS VARCHAR) AS s FROM events) AS x")(
    lambda t: t.events.select("event_id", C.luhn((c("event_id") * 7919).cast("string")).alias("ok"))
)
query("fn_10", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")(lambda t: t.events.select("event_id", C.utc_day(c("ts")).alias("day")))
query("fn_11", "SELECT event_id, strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS shown FROM events")(lambda t: t.events.select("event_id", C.shown_in_zone(c("ts")).alias("shown")))
_SLA = f"CASE WHEN sla_due_at IS NULL THEN 'ok' WHEN {TS} >= sla_due_at THEN 'breached' WHEN {TS} >= sla_due_at - INTERVAL 15 MINUTES THEN 'due_soon' ELSE 'ok' END"
query("fn_12", f"SELECT review_id, {_SLA} AS state FROM review_queue")(lambda t: t.review_queue.select("review_id", C.sla_state(c("sla_due_at"), at()).alias("state")))
query("fn_13", "SELECT id, CAST(round((tokens * 1000 * 3 + tokens * 100 * 15) / 1000000.0, 6) AS DECIMAL(12,6)) AS usd FROM daily_cost")(lambda t: t.daily_cost.select("id", C.token_cost(c("tokens") * 1000, c("tokens") * 100, 3, 15).alias("usd")))
query("fn_14", "SELECT doc_id, strlen(text) + strlen(lang) + 500 AS bound FROM documents")(lambda t: t.documents.select("doc_id", C.payload_tokens([c("text"), c("lang")], 500).alias("bound")))
query("fn_15", f"SELECT doc_id, {hmac_sql(b'key', chr(39).join(['encode(doc_id::VARCHAR) || ', chr(92) + 'x00', '::BLOB || encode(text)']))} AS v FROM documents")(lambda t: t.documents.select("doc_id", X.keyed_hash(b"key", c("doc_id").cast("string"), c("text")).alias("v")))
query("fn_16", "SELECT call_id, rtrim(translate(to_base64(unhex(sha256('call:' || CAST(call_id AS VARCHAR)))), '+/', '-_'), '=') AS job FROM call_state")(lambda t: t.call_state.select("call_id", C.job_id("call:", c("call_id")).alias("job")))
query("fn_17", "SELECT doc_id, md5(text) AS plain_md5, true AS restored FROM documents")(
    lambda t: t.documents.select("doc_id", "text", F.aes_encrypt("text", F.lit("0123456789abcdef"), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.md5(c("doc_id").cast("string")), 1, 24)), F.concat(F.lit("v1"), c("doc_id").cast("string")).cast("binary")).alias("sealed"))
    .select("doc_id", "text", F.aes_decrypt("sealed", F.lit("0123456789abcdef"), F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit("v1"), c("doc_id").cast("string")).cast("binary")).cast("string").alias("back"))
    .select("doc_id", F.md5("back").alias("plain_md5"), (c("back") == c("text")).alias("restored"))
)
query("fn_18", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS v FROM events")(lambda t: t.events.select("event_id", X.canonical_json(c("props")).alias("v")))
query("fn_19", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS component FROM events")(
    lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.context.component").alias("component"))
)
query("fn_20", "SELECT id, replace(stage, '-', '_') AS dto FROM processing_log")(lambda t: t.processing_log.select("id", F.element_at(F.create_map(*(F.lit(x) for s in V.STAGES for x in (s, s.replace("-", "_")))), c("stage")).alias("dto")))
_HELD = "SELECT call_id, arg_max(held_reason, struct_pack(a := created_at, b := review_id)) AS held_reason FROM review_queue GROUP BY call_id"
query(
    "fn_21",
    f"SELECT call_id, CASE WHEN status = 'completed' THEN 'customer_completed' WHEN status = 'skipped' AND drop_reason = 'classified_non_customer' THEN 'non_customer' WHEN status = 'skipped' THEN 'filtered' WHEN status = 'held' AND held_reason = 'classified_spam' THEN 'spam' WHEN status IN ('held', 'review_closed') THEN status ELSE 'processing' END AS key FROM call_state LEFT JOIN ({_HELD}) h USING (call_id)",
)(
    lambda t: t.call_state.join(t.review_queue.groupBy("call_id").agg(F.max_by("held_reason", F.struct("created_at", "review_id")).alias("held_reason")), "call_id", "left")
    .select("call_id", C.outcome(c("status"), c("drop_reason"), c("held_reason"))["key"].alias("key"))
)
query("fn_22", "SELECT alert_id, error_code || ':' || CASE WHEN call_id % 2 = 0 THEN 'call_id:' || call_id ELSE 'component:' || component END AS key FROM alert_events")(
    lambda t: t.alert_events.select("alert_id", C.dedup_key(c("error_code"), {"call_id": F.when(c("call_id") % 2 == 0, c("call_id")), "component": c("component")}).alias("key"))
)
query("fn_23", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) < 50 AS kept FROM events")(
    lambda t: t.events.select("event_id", (F.size(F.map_filter(F.from_json("props", "map<string,int>"), lambda k, v: k.isin("k", "call_id") & (v < 50))) > 0).alias("kept"))
)
# events as failures of every code in turn: category and severity by the catalogue
_CODES = f"{list(V.FAILURES)}[(event_id % {len(V.FAILURES)}) + 1]"
query("fn_24", f"SELECT event_id, {_CODES} AS category, {list(V.FAILURES.values())}[(event_id % {len(V.FAILURES)}) + 1] AS severity FROM events")(
    lambda t: t.events.select("event_id", F.element_at(F.array(*map(F.lit, V.FAILURES)), (c("event_id") % len(V.FAILURES) + 1).cast("int")).alias("category")).withColumn("severity", C.severity_of(c("category")))
)
# payloads of five shapes: nested, with arrays, nulls and labelled values
_PAYLOAD = (
    "CASE event_type WHEN 'click' THEN concat('{\"call\":', props, ',\"tags\":[\"a\",1,true]}') WHEN 'error' THEN concat('{\"phone\":[\"+1 555 ', CAST(user_id AS STRING), '\",\"+1 555 0\"],\"state\":null}') "
    "WHEN 'signup' THEN concat('{\"data\":{\"Contact_Name\":\"Ann ', CAST(user_id AS STRING), '\",\"email\":{\"home\":\"a@b.org\"}},\"items\":[{\"n\":1},{\"m\":\"x\"}]}') WHEN 'view' THEN '[]' ELSE props END"
)
_SHAPES = "CASE event_type WHEN 'click' THEN ['call.k:number', 'tags[]:boolean', 'tags[]:number', 'tags[]:string'] WHEN 'error' THEN ['phone[]:string', 'state:null'] WHEN 'signup' THEN ['data.Contact_Name:string', 'data.email.home:string', 'items[].m:string', 'items[].n:number'] WHEN 'view' THEN ['[]:empty'] ELSE ['k:number'] END"
_payload = lambda t: t.events.withColumn("payload", F.expr(_PAYLOAD))
query("src_09", f"SELECT leaf, count(*) AS n FROM (SELECT unnest({_SHAPES}) AS leaf FROM events) AS x GROUP BY leaf")(lambda t: X.json_leaves(_payload(t), "event_id", "payload").groupBy("leaf").agg(F.count("*").alias("n")))
query("fn_25", "SELECT event_id, CASE event_type WHEN 'error' THEN '+1 555 ' || user_id || CASE WHEN user_id = 0 THEN '' ELSE ',+1 555 0' END ELSE '' END AS phones, CASE event_type WHEN 'signup' THEN 'Ann ' || user_id ELSE '' END AS names, CASE event_type WHEN 'signup' THEN 'a@b.org' ELSE '' END AS emails FROM events")(
    lambda t: _payload(t).select("event_id", X.labelled_values(c("payload")).alias("p")).select("event_id", *(F.array_join(f"p.{k}", ",").alias(k) for k in ("phones", "names", "emails")))
)
query("fn_26", "SELECT alert_id, 30.0 * pow(2.0, least(attempts * 5, 20)) AS seconds FROM alert_events")(lambda t: t.alert_events.select("alert_id", C.backoff(30, c("attempts") * 5).alias("seconds")))
query("fn_27", "SELECT call_id, concat_ws(',', CASE WHEN scope_signal = 'O' THEN 'scope_signal' END, CASE WHEN quantity < 10 THEN 'equipment.capacity' END) AS gaps FROM technician_notes")(
    lambda t: t.technician_notes.select("call_id", F.array_join(F.filter(F.array(F.when(c("scope_signal") == "O", "scope_signal"), F.when(c("quantity") < 10, "equipment.capacity")), lambda x: x.isNotNull()), ",").alias("gaps"))
)
query("fn_28", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS flag FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", C.tristate(F.when(c("l_returnflag") == "A", "yes").when(c("l_returnflag") == "R", "no").otherwise("unknown")).alias("flag"))
)
query("fn_29", "SELECT action_id, CASE action WHEN 'approve' THEN 'customer' WHEN 'mark_spam' THEN 'spam' WHEN 'reject' THEN 'non_customer' END AS label FROM operator_actions")(
    lambda t: t.operator_actions.select("action_id", F.when(c("action") == "approve", "customer").when(c("action") == "mark_spam", "spam").when(c("action") == "reject", "non_customer").alias("label"))
)
query("fn_30", f"SELECT count(*) AS n FROM events WHERE abs(epoch(ts)::BIGINT - epoch({TS})::BIGINT) <= 86400")(lambda t: t.events.filter(C.is_fresh(F.date_trunc("second", c("ts")), at(), 86400)).agg(F.count("*").alias("n")))
