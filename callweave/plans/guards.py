"""Source shapes, parameter checks and output guards over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import redaction as X
from ..operators.params import ListQuery, gate, without_content
from ..operators.rows import covered_by, search_filter
from ..scratch import fresh_path
from ..sources import readers
from .registry import at, query

c = F.col

def _landed(t, rows, label: str) -> str:
    """Rows of one text column, written line by line into the shared folder."""
    path = fresh_path(t.spark, label)
    rows.write.text(path)
    return path


#: Items of a page of the call listing.
PAGE = 1000


def _listing(t):
    """The backfilled calls as a landed listing of pages, read through the reader from a start time on."""
    calls = t.backfill_run_calls.select((c("call_id") / PAGE).cast("long").alias("page"), F.struct(c("call_id").cast("string").alias("call_id"), F.unix_timestamp(c("started_at").cast("timestamp")).cast("double").alias("started_at"), F.lit("hangup").alias("state")).alias("item"))
    last = t.backfill_run_calls.agg((F.max("call_id") / PAGE).cast("long").alias("last"))
    pages = calls.groupBy("page").agg(F.collect_list("item").alias("items")).join(last)  # at most PAGE items each
    lines = pages.select(F.to_json(F.struct(c("page").cast("string").alias("page"), F.when(c("page") < c("last"), (c("page") + 1).cast("string")).alias("cursor"), "items")).alias("value"))
    return readers.landed_pages(t.spark, _landed(t, lines, "listing"), 946684800.0)


query("src_04_landed", "SELECT CAST(call_id AS VARCHAR) AS call_id, epoch(started_at)::DOUBLE AS started_at FROM backfill_run_calls WHERE started_at > TIMESTAMP '2000-01-01 00:00:00'")(lambda t: _listing(t).select("call_id", "started_at"))


def _paged(t):
    """The backfilled calls as a paged listing, read through its data source; the bound is pushed to it, so earlier pages are not read."""
    path = fresh_path(t.spark, "paged")
    calls = t.backfill_run_calls.select("call_id", F.unix_timestamp(c("started_at").cast("timestamp")).cast("double").alias("started_at"), F.lit("hangup").alias("state"))
    readers.land_listing(calls, path, PAGE)
    return readers.paged_calls(t.spark, path).filter(c("started_at") > 946684800.0)


query("src_04", "SELECT CAST(call_id AS VARCHAR) AS call_id, epoch(started_at)::DOUBLE AS started_at, 'hangup' AS state FROM backfill_run_calls WHERE started_at > TIMESTAMP '2000-01-01 00:00:00'")(_paged)


def _base64url(x):
    return F.translate(F.replace(F.base64(x), F.lit("="), F.lit("")), "+/", "-_")


query("src_07", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")(
    lambda t: t.events.select("event_id", F.concat_ws(".", _base64url(F.lit('{"alg":"HS256"}').cast("binary")), _base64url(c("props").cast("binary"))).alias("body"))
    .select("event_id", F.concat_ws(".", "body", F.when(c("event_id") % 3 == 0, "AAAA").otherwise(_base64url(F.unhex(X.keyed_hash(b"secret", c("body")))))).alias("token"))
    .select("event_id", F.get_json_object(readers.verified_claims(c("token"), [b"other", b"secret"]), "$.k").alias("k"))
)
query("src_10", "SELECT term, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS term FROM documents) AS x WHERE term <> '' AND term NOT LIKE '#%' GROUP BY term")(
    lambda t: readers.term_lines(t.spark, _landed(t, t.documents.filter("text IS NOT NULL").select("text"), "terms")).groupBy("term").agg(F.count("*").alias("n"))
)


def _fixtures(t):
    """The conversations as fixtures, one a line, read through the reader: its calls with their transcripts."""
    key = F.concat_ws(":", "call_id", "turn")
    call = F.struct(key.alias("callId"), c("turn").cast("double").alias("startedAt"), F.lit("hangup").alias("state"))
    lines = t.turns.select(F.to_json(F.struct(F.array(call).alias("calls"), F.create_map(key, F.coalesce("text", F.lit(""))).alias("transcripts"))).alias("value"))
    calls, texts = readers.fixture(t.spark, _landed(t, lines, "fixtures"), lines=True)
    return calls.select(c("callId").alias("call_id"), "startedAt", "state").join(texts, "call_id")


query("src_11", "SELECT call_id::VARCHAR || ':' || turn AS call_id, turn::DOUBLE AS started_at, 'hangup' AS state, coalesce(text, '') AS text FROM turns")(lambda t: _fixtures(t).select("call_id", c("startedAt").alias("started_at"), "state", "text"))
_DOMAINS = {"service_category": ("BUILDING", "HOUSEHOLD"), "urgency": ("1-URGENT", "2-HIGH")}
query("flt_06", "SELECT call_id FROM structured_knowledge WHERE service_category = 'BUILDING' AND created_at < TIMESTAMP '1996-01-01 00:00:00' ORDER BY call_id LIMIT 200")(
    lambda t: (lambda q: t.structured_knowledge.filter(q.where()).orderBy("call_id").limit(q.size).select("call_id"))(ListQuery.parse({"service_category": " BUILDING ", "urgency": "", "end": "1995-12-31", "size": "9999"}, _DOMAINS))
)
query("flt_14", "SELECT call_id, status, duration FROM call_state")(lambda t: without_content(t.call_state.select("call_id", "status", "duration")))
query("jn_18_numbers")(
    lambda t: t.clean_transcripts.select("call_id", X.detect(c("text"), "number").alias("numbers"), X.detect(c("text"), "phone").alias("phones"))
    .select("call_id", F.size(F.filter("numbers", lambda n: ~F.exists("phones", lambda p: (p["start"] <= n["start"]) & (n["end"] <= p["end"])))).alias("uncovered"))
)
# order lines as stretches of days: which lie within a stretch of another line of their order
query(
    "jn_18",
    """
, s AS (SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT // 86400 AS start, epoch(l_shipdate)::BIGINT // 86400 + CAST(l_quantity AS BIGINT) AS stop FROM lineitem)
SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM s AS o WHERE o.l_orderkey = s.l_orderkey AND o.l_linenumber <> s.l_linenumber AND o.l_linenumber % 2 = 0 AND o.start <= s.start AND s.stop <= o.stop) AS covered FROM s WHERE l_linenumber % 2 = 1""",
)(
    lambda t: (lambda s: covered_by(s.filter("l_linenumber % 2 = 1"), s.filter("l_linenumber % 2 = 0"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "covered"))(
        t.lineitem.select("l_orderkey", "l_linenumber", F.unix_date(c("l_shipdate").cast("date")).cast("long").alias("start"), "l_quantity").withColumn("end", c("start") + c("l_quantity").cast("long"))
    )
)
query("txt_07", "SELECT call_id FROM structured_knowledge WHERE contains(lower(problem_statement), '0042')")(lambda t: t.structured_knowledge.filter(search_filter(text=gate("0042"), text_cols=["problem_statement"])).select("call_id"))
