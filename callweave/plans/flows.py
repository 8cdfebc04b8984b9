"""State folds, retention, budgets, reviews, alerts, keys and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab as V
from ..operators import rows as R
from ..operators import states as S
from .registry import at, hmac_sql, query
from .standins import K, NOW, RETENTION_NOW, Tables

c = F.col
TS, RTS = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{RETENTION_NOW}'"
LIVE = "soft_deleted_at IS NULL AND hard_deleted_at IS NULL"
ACTIVE = ("open", "in_review")


def _results(t: Tables):
    """Stage results of a call in order: the n-th event of a user is a result of the n-th stage, more or less."""
    w = R.Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = t.events.withColumn("n", F.row_number().over(w) - 1)
    stage = F.element_at(F.array(*(F.lit(s) for s in V.STAGES)), (F.pmod(F.floor(c("n") / 2), F.lit(9)) + 1).cast("int"))
    action = F.when(c("value") > 150, "hold").when(c("value") > 100, "drop").when(c("value") > 80, "defer").otherwise("continue")
    return numbered.select(c("user_id").alias("call_id"), c("event_id").alias("id"), c("ts").alias("at"), stage.alias("stage"), action.alias("action"))


def fold_sql(results: str) -> str:
    """The fold of stage results in SQL; results: call_id, n (1, 2, ...), seq, at, stage (from 0), action. One step takes every call's next row."""
    hits = "f.status = 'processing' AND r.stage = f.rank"
    return f"""
, r AS ({results}),
f AS (SELECT DISTINCT call_id, 0::BIGINT AS n, 'processing' AS status, 0 AS rank, NULL::TIMESTAMP AS since, NULL::BIGINT AS seq, false AS moved FROM r
  UNION ALL SELECT f.call_id, r.n,
    CASE WHEN NOT ({hits}) THEN f.status WHEN r.action = 'hold' THEN 'held' WHEN r.action = 'drop' AND f.rank IN {tuple(V.STAGES.index(x) for x in V.SKIP_STAGES)} THEN 'skipped' WHEN r.action = 'continue' AND f.rank = {len(V.STAGES) - 1} THEN 'completed' ELSE f.status END,
    CASE WHEN {hits} AND r.action = 'continue' AND f.rank < {len(V.STAGES) - 1} THEN f.rank + 1 ELSE f.rank END,
    CASE WHEN {hits} AND r.action <> 'defer' THEN r.at ELSE f.since END, r.seq,
    {hits} AND (r.action IN ('hold', 'continue') OR (r.action = 'drop' AND f.rank IN {tuple(V.STAGES.index(x) for x in V.SKIP_STAGES)}))
  FROM f JOIN r ON r.call_id = f.call_id AND r.n = f.n + 1)
"""


_STAGE_NAMES = f"{list(V.STAGES)}"
_RESULTS = (
    "SELECT user_id AS call_id, n, n AS seq, ts AS at, ((n - 1) // 2) % 9 AS stage, CASE WHEN value > 150 THEN 'hold' WHEN value > 100 THEN 'drop' WHEN value > 80 THEN 'defer' ELSE 'continue' END AS action "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) AS x"
)
query("str_01", fold_sql(_RESULTS) + f"SELECT call_id, arg_max(status, n) AS status, {_STAGE_NAMES}[arg_max(rank, n) + 1] AS stage, max(since) AS at FROM f GROUP BY call_id")(lambda t: S.call_fold(_results(t)))
# the log row of every guarded transition, in the order of the call's results
query("str_02", fold_sql(_RESULTS) + f"SELECT call_id, status, {_STAGE_NAMES}[rank + 1] AS stage, seq FROM f WHERE moved")(
    lambda t: S.call_moves(_results(t).withColumn("seq", F.row_number().over(R.Window.partitionBy("call_id").orderBy("at", "id"))))
)
# each event reserves its user and type for a day; most are committed or released a minute later
_REQUESTS = (
    "SELECT user_id, event_type, event_id AS id, 'reserve' AS kind, 0 AS step, ts AS at FROM events UNION ALL "
    f"SELECT user_id, event_type, event_id, CASE WHEN value < 60 THEN 'commit' ELSE 'release' END, CASE WHEN value < 60 THEN 1 ELSE 2 END, ts + INTERVAL 1 MINUTE FROM events WHERE {K} % 5 <> 0"
)
query(
    "str_03",
    f"""
, z AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY "at", id, step) AS n FROM ({_REQUESTS.replace(" AS at ", ' AS "at" ')}) AS x),
f AS (SELECT DISTINCT user_id, event_type, 0::BIGINT AS n, NULL::BIGINT AS id, 0 AS step, false AS acquired, NULL::BIGINT AS holder, false AS committed, NULL::TIMESTAMP AS expires FROM z
  UNION ALL SELECT z.user_id, z.event_type, z.n, z.id, z.step, z.step = 0 AND (f.holder IS NULL OR f.expires <= z."at"),
    CASE WHEN z.step = 0 AND (f.holder IS NULL OR f.expires <= z."at") THEN z.id WHEN z.step = 2 AND f.holder = z.id AND NOT f.committed THEN NULL ELSE f.holder END,
    CASE WHEN z.step = 0 AND (f.holder IS NULL OR f.expires <= z."at") THEN false WHEN z.step = 1 AND f.holder = z.id THEN true ELSE f.committed END,
    CASE WHEN (z.step = 0 AND (f.holder IS NULL OR f.expires <= z."at")) OR (z.step = 1 AND f.holder = z.id) THEN z."at" + INTERVAL 1 DAY ELSE f.expires END
  FROM f JOIN z ON z.user_id = f.user_id AND z.event_type = f.event_type AND z.n = f.n + 1)
SELECT id AS event_id, acquired FROM f WHERE n > 0 AND step = 0""",
)(lambda t: S.replay_guard(t.spark.sql(_REQUESTS.replace("FROM events", "FROM {e}"), e=t.events), ["user_id", "event_type"], 24 * 60).filter("kind = 'reserve'").select(c("id").alias("event_id"), "acquired"))
query("str_03_gaps", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) AS x WHERE before IS NULL OR ts > before + INTERVAL 5 MINUTES")(
    lambda t: t.events.withColumn("before", F.lag("ts").over(R.Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).filter(c("before").isNull() | (c("ts") > c("before") + F.expr("INTERVAL 5 MINUTES"))).select("event_id")
)
query("str_04_due", f"SELECT call_id, min(created_at) AS wait_started_at, CASE WHEN bool_or(outcome = 'success') THEN 'ready' WHEN min(created_at) <= {TS} - INTERVAL 4320 MINUTES THEN 'held' ELSE 'waiting' END AS state FROM processing_log GROUP BY call_id")(
    lambda t: S.wait_state(t.processing_log.select("call_id", c("created_at").alias("at"), (c("outcome") == "success").alias("ready")), at(), 4320)
)
# polls of a user's transcript: an error finds it; three days are the longest wait, a slot is six hours
query(
    "str_04",
    """
, p AS (SELECT user_id AS call_id, event_id AS id, ts AS "at", event_type = 'error' AND value > 100 AS ready FROM events),
w AS (SELECT *, min(CASE WHEN NOT ready THEN "at" END) OVER (PARTITION BY call_id ORDER BY "at", id ROWS UNBOUNDED PRECEDING) AS wait_started_at FROM p),
e AS (SELECT *, ready OR "at" >= wait_started_at + INTERVAL 3 DAYS AS ends FROM w),
o AS (SELECT *, coalesce(max(ends::INT) OVER (PARTITION BY call_id ORDER BY "at", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS over_ FROM e)
SELECT call_id, id, wait_started_at, CASE WHEN ready THEN 'continue' WHEN ends THEN 'hold' ELSE 'defer' END AS action,
  CASE WHEN NOT ends THEN (epoch_us("at") - epoch_us(wait_started_at)) // 21600000000 END AS slot FROM o WHERE NOT over_""",
)(lambda t: S.transcript_polls(t.events.select(c("user_id").alias("call_id"), c("event_id").alias("id"), c("ts").alias("at"), ((c("event_type") == "error") & (c("value") > 100)).alias("ready")), 3 * 24 * 60, 6 * 60))
query("str_05", "SELECT call_id, min(created_at) AS wait_started_at FROM processing_log WHERE stage = 'fetch-transcript' GROUP BY call_id")(lambda t: t.processing_log.filter("stage = 'fetch-transcript'").groupBy("call_id").agg(F.min("created_at").alias("wait_started_at")))
query("str_06", "SELECT run_id, min(started_at) AS watermark, count(*) FILTER (WHERE started_at > TIMESTAMP '1999-01-01 00:00:00') AS skipped FROM backfill_run_calls GROUP BY run_id")(
    lambda t: t.backfill_run_calls.groupBy("run_id").agg(F.min("started_at").alias("watermark"), F.count_if(c("started_at") > at("1999-01-01 00:00:00")).alias("skipped"))
)
query("str_07", "SELECT b.run_id, count(*) AS tracked, count(*) FILTER (WHERE rt.soft_deleted_at IS NOT NULL) AS terminal, count(*) = count(*) FILTER (WHERE rt.soft_deleted_at IS NOT NULL) AS drained FROM backfill_run_calls b JOIN raw_transcripts rt USING (call_id) GROUP BY b.run_id")(
    lambda t: t.backfill_run_calls.join(t.raw_transcripts.select("call_id", "soft_deleted_at"), "call_id").groupBy("run_id").agg(F.count("*").alias("tracked"), F.count_if(c("soft_deleted_at").isNotNull()).alias("terminal")).withColumn("drained", c("tracked") == c("terminal"))
)
query("str_08", "SELECT DISTINCT call_id FROM backfill_run_calls b WHERE NOT EXISTS (SELECT 1 FROM technician_notes tn WHERE tn.call_id = b.call_id)")(lambda t: R.lacking(t.backfill_run_calls, t.technician_notes, ["call_id"]).select("call_id").distinct())
_BREACH = f"status IN ('open', 'in_review') AND sla_due_at <= {TS}"
query("str_09", f"SELECT review_id FROM review_queue rq WHERE {_BREACH} AND NOT EXISTS (SELECT 1 FROM alert_events a WHERE a.alert_id = rq.review_id + 1)")(
    lambda t: S.sla_breaches(t.review_queue, at(), t.alert_events.select((c("alert_id") - 1).alias("review_id"))).select("review_id")
)
query("str_10", f"SELECT review_id, CASE WHEN EXISTS (SELECT 1 FROM processing_log p WHERE p.call_id = rq.call_id AND p.outcome = 'success') THEN 'requeue' ELSE 'abandon' END AS decision FROM review_queue rq WHERE held_reason = 'missing_transcript' AND status = 'open' AND created_at <= {TS} - INTERVAL 24 HOURS")(
    lambda t: t.review_queue.filter((c("held_reason") == "missing_transcript") & (c("status") == "open") & (c("created_at") <= at() - F.expr("INTERVAL 24 HOURS")))
    .join(t.processing_log.filter("outcome = 'success'").select("call_id").distinct().withColumn("ready", F.lit(True)), "call_id", "left").select("review_id", F.when(c("ready"), "requeue").otherwise("abandon").alias("decision"))
)
query("str_11", "SELECT oa.action_id, CASE WHEN cs.call_id IS NULL THEN 'failed' WHEN cs.status = 'held' THEN 'sent' ELSE 'superseded' END AS result FROM operator_actions oa LEFT JOIN call_state cs ON cs.call_id = oa.call_id * 100 + oa.k")(
    lambda t: t.operator_actions.select("action_id", (c("call_id") * 100 + c("k")).alias("call_id")).join(t.call_state.select("call_id", "status"), "call_id", "left").select("action_id", F.when(c("status").isNull(), "failed").when(c("status") == "held", "sent").otherwise("superseded").alias("result"))
)
query("str_12_delay", f"SELECT alert_id FROM alert_events WHERE delivery_state IN ('pending', 'failed') AND attempts < 5 AND created_at + INTERVAL 30 MINUTES <= {TS}")(
    lambda t: t.alert_events.filter(c("delivery_state").isin("pending", "failed") & (c("attempts") < 5) & (c("created_at") + F.expr("INTERVAL 30 MINUTES") <= at())).select("alert_id")
)
for name in ("str_13", "op_56"):
    query(name, f"SELECT 'escalation:' || dedup_key AS dedup_key, min(alert_id) AS alert_id FROM alert_events WHERE severity = 'critical' AND acknowledged_at IS NULL AND created_at <= {TS} - INTERVAL 60 MINUTES GROUP BY 1")(
        lambda t: S.stale_critical(t.alert_events, at(), 60).groupBy(F.concat(F.lit("escalation:"), "dedup_key").alias("dedup_key")).agg(F.min("alert_id").alias("alert_id"))
    )
_STANDING = "SELECT alert_id, dedup_key FROM (SELECT *, max(coalesce(acknowledged_at, TIMESTAMP '9999-12-31')) OVER (PARTITION BY dedup_key ORDER BY created_at, alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM alert_events) AS x WHERE s IS NULL OR s <= created_at"
for name in ("snk_11", "op_54"):
    query(name, _STANDING)(lambda t: S.first_open_alert(t.alert_events).select("alert_id", "dedup_key"))


def _budget(t: Tables, cap: float = 4000.0):
    return S.budget_fold(t.daily_cost.select("day", "id", c("cost").alias("amount"), "at"), cap)


#: Reservations of a day in order, each refused if it would pass the cap: one step of the recursion takes every day's next row.
SPENDING = """
, z AS (SELECT day, id, CAST(cost AS DECIMAL(18,6)) AS amount, row_number() OVER (PARTITION BY day ORDER BY "at", id) AS n FROM daily_cost),
spent AS (SELECT day, id, n, amount, amount <= {cap} AS ok, CASE WHEN amount <= {cap} THEN amount ELSE 0 END::DECIMAL(18,6) AS total FROM z WHERE n = 1
  UNION ALL SELECT z.day, z.id, z.n, z.amount, s.total + z.amount <= {cap}, (s.total + CASE WHEN s.total + z.amount <= {cap} THEN z.amount ELSE 0 END)::DECIMAL(18,6) FROM spent s JOIN z ON z.day = s.day AND z.n = s.n + 1)"""
def _budget_moves(t: Tables):
    """Every call reserves its cost; half an hour later a third of them settle at half of it, a third are given back, and a third stay."""
    asked = t.daily_cost.select("day", "id", F.lit("reserve").alias("kind"), c("cost").cast("decimal(18,6)").alias("amount"), "at")
    half = (F.floor((c("cost") * 1000000).cast("long") / 2).cast("decimal(18,0)") / 1000000).cast("decimal(18,6)")
    later = t.daily_cost.filter("tokens % 3 < 2").select("day", "id", F.when(c("tokens") % 3 == 0, "settle").otherwise("release").alias("kind"), half.alias("amount"), (c("at") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    return asked.unionByName(later)


query(
    "str_14",
    """
, z AS (SELECT day, id, kind, step, CAST(amount AS DECIMAL(18,6)) AS amount, row_number() OVER (PARTITION BY day ORDER BY "at", id, step) AS n FROM (
  SELECT day, id, 'reserve' AS kind, 0 AS step, CAST(cost AS DECIMAL(18,6)) AS amount, "at" FROM daily_cost UNION ALL
  SELECT day, id, CASE tokens % 3 WHEN 0 THEN 'settle' ELSE 'release' END, tokens % 3 + 1, (((cost * 1000000)::BIGINT // 2)::DECIMAL(18,0) / 1000000)::DECIMAL(18,6), "at" + INTERVAL 30 MINUTES FROM daily_cost WHERE tokens % 3 < 2) AS x),
r AS (SELECT day, id, CAST(cost AS DECIMAL(18,6)) AS held FROM daily_cost),
y AS (SELECT z.*, r.held FROM z JOIN r USING (day, id)),
f AS (SELECT DISTINCT day, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS kind, NULL::VARCHAR AS result, 0::DECIMAL(18,6) AS spent, []::BIGINT[] AS open FROM y
  UNION ALL SELECT y.day, y.n, y.id, y.kind,
    CASE WHEN step = 0 THEN CASE WHEN f.spent + y.amount <= 4000 THEN 'reserved' ELSE 'refused' END WHEN NOT list_contains(f.open, y.id) THEN 'ignored' WHEN step = 1 THEN 'settled' ELSE 'released' END,
    (f.spent + CASE WHEN step = 0 THEN CASE WHEN f.spent + y.amount <= 4000 THEN y.amount ELSE 0 END WHEN NOT list_contains(f.open, y.id) THEN 0 WHEN step = 1 THEN y.amount - y.held ELSE -y.held END)::DECIMAL(18,6),
    CASE WHEN step = 0 THEN CASE WHEN f.spent + y.amount <= 4000 THEN list_append(f.open, y.id) ELSE f.open END ELSE [x FOR x IN f.open IF x <> y.id] END
  FROM f JOIN y ON y.day = f.day AND y.n = f.n + 1)
SELECT day, id, kind, result, spent, result = 'reserved' AND spent >= 3200 AS warned FROM f WHERE n > 0""",
)(lambda t: S.budget_ledger(_budget_moves(t), 4000.0))
query("str_14_cap", SPENDING.format(cap=4000) + " SELECT day, id, amount::DECIMAL(12,6) AS amount, ok AS accepted, total AS spent, ok AND total >= 3200 AS warned FROM spent")(_budget)
query("op_26", SPENDING.format(cap=9000) + " SELECT day, min(id) AS id FROM spent WHERE ok AND total >= 7200 GROUP BY day")(
    lambda t: _budget(t, 9000.0).filter("warned").groupBy("day").agg(F.min("id").alias("id"))
)
query(
    "snk_08",
    """
, z AS (SELECT day AS key, id, CAST(cost - 40 AS DECIMAL(18,6)) AS delta, row_number() OVER (PARTITION BY day ORDER BY "at", id) AS n FROM daily_cost),
kept AS (SELECT key, id, n, delta >= 0 AS applied, CASE WHEN delta >= 0 THEN delta ELSE 0 END::DECIMAL(18,6) AS total FROM z WHERE n = 1
  UNION ALL SELECT z.key, z.id, z.n, k.total + z.delta >= 0, (k.total + CASE WHEN k.total + z.delta >= 0 THEN z.delta ELSE 0 END)::DECIMAL(18,6) FROM kept k JOIN z ON z.key = k.key AND z.n = k.n + 1)
SELECT key, id, applied, total FROM kept""",
)(lambda t: S.guarded_adjust(t.daily_cost.select(c("day").alias("key"), "id", "at", (c("cost") - 40).cast("decimal(12,6)").alias("delta"))))
query("str_15_minutes", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2")(
    lambda t: t.events.groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n")).withColumn("limited", c("n") > 1)
)
# requests of each type: one in ten minutes and three in an hour at most
query(
    "str_15",
    """
, z AS (SELECT event_type, event_id AS id, epoch_us(ts) AS us, epoch_us(ts) // 600000000 AS short, epoch_us(ts) // 3600000000 AS long FROM events),
y AS (SELECT *, row_number() OVER (PARTITION BY event_type, long ORDER BY us, id) AS n FROM z),
f AS (SELECT DISTINCT event_type, long, 0::BIGINT AS n, NULL::BIGINT AS id, false AS ok, -1::BIGINT AS short, 0 AS a, 0 AS b, 0::BIGINT AS wait_us FROM y
  UNION ALL SELECT y.event_type, y.long, y.n, y.id, here < 1 AND f.b < 3, y.short, CASE WHEN here < 1 AND f.b < 3 THEN here + 1 ELSE here END, CASE WHEN here < 1 AND f.b < 3 THEN f.b + 1 ELSE f.b END,
    greatest(CASE WHEN here >= 1 THEN (y.short + 1) * 600000000 - us ELSE 0 END, CASE WHEN f.b >= 3 THEN (y.long + 1) * 3600000000 - us ELSE 0 END)
  FROM f JOIN y ON y.event_type = f.event_type AND y.long = f.long AND y.n = f.n + 1, LATERAL (SELECT CASE WHEN y.short = f.short THEN f.a ELSE 0 END AS here) AS h)
SELECT event_type, id, ok AS admitted, (wait_us + 999) // 1000 AS wait_ms FROM f WHERE n > 0""",
)(lambda t: S.dual_window(t.events.select("event_type", c("event_id").alias("id"), c("ts").alias("at")), "event_type", 600, 1, 3600, 3))
_ACT = f"CASE WHEN retention_eligible_at <= {RTS} - INTERVAL 30 DAYS AND soft_deleted_at IS NULL THEN 'soft_delete' WHEN retention_eligible_at <= {RTS} - INTERVAL 90 DAYS AND soft_deleted_at <= {RTS} - INTERVAL 60 DAYS AND hard_deleted_at IS NULL THEN 'hard_delete' END"
query(
    "str_16",
    f"""
, pa AS (SELECT p.call_id, p.row_id, {_ACT} AS action FROM raw_transcripts p WHERE NOT EXISTS (SELECT 1 FROM review_queue b WHERE b.status = 'open' AND b.call_id = p.call_id)),
pk AS (SELECT * FROM pa WHERE action = 'soft_delete' OR (action = 'hard_delete' AND NOT EXISTS (SELECT 1 FROM token_vault v WHERE v.call_id = pa.call_id AND v.hard_deleted_at IS NULL AND (v.soft_deleted_at IS NULL OR v.soft_deleted_at > {RTS} - INTERVAL 60 DAYS)))),
ca AS (SELECT v.call_id, v.row_id, {_ACT} AS action FROM token_vault v WHERE NOT EXISTS (SELECT 1 FROM review_queue b WHERE b.status = 'open' AND b.call_id = v.call_id) AND NOT EXISTS (SELECT 1 FROM raw_transcripts p WHERE p.call_id = v.call_id))
SELECT 'parent' AS side, call_id, row_id, action FROM pk
UNION ALL SELECT 'child', v.call_id, v.row_id, pk.action FROM token_vault v JOIN pk USING (call_id) WHERE CASE WHEN pk.action = 'soft_delete' THEN v.soft_deleted_at IS NULL ELSE v.hard_deleted_at IS NULL END
UNION ALL SELECT 'orphan', call_id, row_id, action FROM ca WHERE action IS NOT NULL""",
)(lambda t: S.coupled_retention(t.raw_transcripts, t.token_vault, t.review_queue.filter("status = 'open'"), at(RETENTION_NOW), 30, 90))
query("str_17", "SELECT call_id FROM processing_log WHERE outcome = 'failed' GROUP BY call_id HAVING count(*) >= 2")(lambda t: R.counts(t.processing_log.filter("outcome = 'failed'"), ["call_id"]).filter("n >= 2").select("call_id"))


def _reviewed(t: Tables):
    asked = t.review_queue.join(t.operator_actions.select((c("call_id") * 100 + c("k")).alias("call_id"), "action_id", "action"), "call_id")
    allowed = S.action_matrix(asked).withColumn("ok", F.lit(True))
    open_ = c("status").isin(*ACTIVE)
    return asked.join(allowed, ["held_reason", "action"], "left").select("review_id", "action_id", F.when(~open_, "already_closed").when(c("ok"), "applied").otherwise("not_allowed").alias("result"))


for name in ("str_18", "op_41"):
    query(
        name,
        "SELECT review_id, action_id, CASE WHEN status NOT IN ('open', 'in_review') THEN 'already_closed' WHEN action = 'reject' OR (action = 'approve' AND held_reason IN ('classifier_uncertain', 'emergency_review')) OR (action = 'mark_spam' AND held_reason NOT IN ('missing_transcript', 'weak_servicetitan_match')) THEN 'applied' ELSE 'not_allowed' END AS result "
        "FROM review_queue rq JOIN operator_actions oa ON rq.call_id = oa.call_id * 100 + oa.k",
    )(_reviewed)
query("str_19", f"SELECT component, CASE WHEN max(seen_at) < {TS} - INTERVAL 10000 MINUTES THEN 'broken' WHEN max(seen_at) < {TS} - INTERVAL 30 MINUTES THEN 'degraded' ELSE 'healthy' END AS health FROM heartbeats WHERE seen_at <= {TS} GROUP BY component")(
    lambda t: t.heartbeats.filter(c("seen_at") <= at()).groupBy("component").agg(F.max("seen_at").alias("seen")).select("component", S.health(c("seen"), at(), 30, 10000).alias("health"))
)
query("str_20", f"SELECT stage, max(created_at) < {TS} - INTERVAL 2 HOURS AS stalled FROM processing_log WHERE created_at <= {TS} GROUP BY stage")(
    lambda t: t.processing_log.filter(c("created_at") <= at()).groupBy("stage").agg((F.max("created_at") < at() - F.expr("INTERVAL 2 HOURS")).alias("stalled"))
)
query("str_22", "SELECT call_id, CASE WHEN n = 1 THEN 'canonical' ELSE 'duplicate' END AS leg FROM (SELECT call_id, row_number() OVER (PARTITION BY problem_statement, created_at ORDER BY call_id) AS n FROM structured_knowledge) AS x")(
    lambda t: t.structured_knowledge.join(t.structured_knowledge.groupBy("problem_statement", "created_at").agg(F.min("call_id").alias("first")), ["problem_statement", "created_at"]).select("call_id", F.when(c("call_id") == c("first"), "canonical").otherwise("duplicate").alias("leg"))
)
_SYNC = "CASE WHEN d.id IS NOT NULL THEN 'already' WHEN oa.action NOT IN ('approve', 'reject', 'mark_spam') THEN 'unsupported' WHEN oa.k % 7 = 0 THEN 'gate_failed' ELSE 'accepted' END"


def _synced(t: Tables):
    done = t.dead_letter.select((c("id") - 1).alias("action_id")).distinct().withColumn("done", F.lit(True))
    return t.operator_actions.join(done, "action_id", "left").withColumn(
        "outcome", F.when(c("done"), "already").when(~c("action").isin("approve", "reject", "mark_spam"), "unsupported").when(c("k") % 7 == 0, "gate_failed").otherwise("accepted")
    )


query("str_23", f"SELECT action_id, {_SYNC} AS outcome FROM operator_actions oa LEFT JOIN dead_letter d ON d.id = oa.action_id + 1")(lambda t: _synced(t).select("action_id", "outcome"))
for name in ("agg_20",):
    query(name, f"SELECT {_SYNC} AS outcome, count(*) AS n FROM operator_actions oa LEFT JOIN dead_letter d ON d.id = oa.action_id + 1 GROUP BY 1")(lambda t: R.counts(_synced(t), ["outcome"]))

# -- evaluation ----------------------------------------------------------------------

_PRED = "CASE WHEN length(text) > 400 THEN 1 ELSE 0 END"


def _pairs(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "lang", F.when(F.length("text") > 400, 1).otherwise(0).alias("predicted")), "doc_id").withColumnRenamed("quality", "expected")


query("agg_16", f"SELECT lang, toxic, count(*) AS n, count(*) FILTER (WHERE quality = {_PRED}) AS correct, round(count(*) FILTER (WHERE quality = {_PRED}) / count(*), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang, toxic")(
    lambda t: S.accuracy(_pairs(t), ["lang", "toxic"])
)
for name in ("agg_17",):
    query(name, "SELECT lang, CASE WHEN count(*) = 0 THEN 'skipped' WHEN lang <> 'en' THEN 'complete' WHEN count(*) FILTER (WHERE toxic = 0) = 0 THEN 'skipped' ELSE 'partial' END AS status FROM labels JOIN documents USING (doc_id) GROUP BY lang")(
        lambda t: _pairs(t).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(c("toxic") == 0).alias("done")).select("lang", S.run_status(c("n"), c("done"), F.when(c("lang") == "en", "cost_capped")).alias("status"))
    )

# -- records and gates ----------------------------------------------------------------------

query("op_01_fields", "SELECT run_id, '{\"run_id\":' || run_id || ',\"status\":\"' || status || '\"}' AS checkpoint FROM backfill_runs")(lambda t: t.backfill_runs.select("run_id", F.to_json(F.struct("run_id", "status")).alias("checkpoint")))
query("op_02_fields", "SELECT run_id, status AS decoded FROM backfill_runs")(lambda t: t.backfill_runs.select("run_id", F.from_json(F.to_json(F.struct("run_id", "status")), "run_id long, status string")["status"].alias("decoded")))
query("op_03", "SELECT count(*) AS missing FROM backfill_run_calls WHERE started_at IS NULL")(lambda t: t.backfill_run_calls.agg(F.count_if(c("started_at").isNull()).alias("missing")))
query("op_04", f"SELECT run_id, min(started_at) - INTERVAL 4 HOURS AS since FROM backfill_run_calls GROUP BY run_id")(lambda t: t.backfill_run_calls.groupBy("run_id").agg((F.min("started_at") - F.expr("INTERVAL 4 HOURS")).alias("since")))
query("op_05", "SELECT call_id, status IN ('completed', 'skipped', 'review_closed') OR EXISTS (SELECT 1 FROM dead_letter d WHERE d.call_id = cs.call_id) AS terminal FROM call_state cs")(
    lambda t: t.call_state.join(t.dead_letter.select("call_id").distinct().withColumn("dead", F.lit(True)), "call_id", "left").select("call_id", (c("status").isin("completed", "skipped", "review_closed") | F.coalesce("dead", F.lit(False))).alias("terminal"))
)
for name in ("op_06_types",):
    query(name, "SELECT user_id AS call_id, count(DISTINCT event_type) = 5 AS all_gates FROM events GROUP BY user_id")(lambda t: t.events.groupBy(c("user_id").alias("call_id")).agg((F.size(F.array_except(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.collect_set("event_type"))) == 0).alias("all_gates")))
query("op_08", "SELECT event_id, '{\"v\":' || user_id || '}' AS json FROM events")(lambda t: t.events.select("event_id", F.to_json(F.struct(c("user_id").alias("v"))).alias("json")))
query("op_09", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(lambda t: t.events.select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k")))
query("op_10", "SELECT c_custkey, nullif(trim(c_name), '') AS id FROM customer")(lambda t: t.customer.select("c_custkey", C.unset_to_null(c("c_name")).alias("id")))
query("op_11", "SELECT call_id, duration, status FROM call_state")(lambda t: t.call_state.select("call_id", F.struct("duration", "status").alias("m")).select("call_id", "m.*"))
query("op_12", f"SELECT c_custkey, {hmac_sql(b'pepper', 'encode(c_name)')} AS hash FROM customer")(lambda t: t.customer.select("c_custkey", _keyed(c("c_name")).alias("hash")))


def _keyed(x):
    from ..operators import redaction as X

    return X.keyed_hash(b"pepper", x)


for name in ("op_13",):
    query(name, "SELECT call_id, 'bucket' AS kind, service_category AS bucket, service_category IN ('BUILDING', 'HOUSEHOLD') AS valid FROM structured_knowledge")(
        lambda t: t.structured_knowledge.select("call_id", F.struct(F.lit("bucket").alias("kind"), c("service_category").alias("bucket"), c("service_category").isin("BUILDING", "HOUSEHOLD").alias("valid")).alias("l")).select("call_id", "l.*")
    )
for name in ("op_16",):
    query(name, "SELECT alert_id, error_code, severity, CASE WHEN severity IN ('critical', 'high') THEN 'page' ELSE 'log' END AS channel FROM alert_events")(
        lambda t: t.alert_events.select("alert_id", "error_code", "severity", F.when(c("severity").isin("critical", "high"), "page").otherwise("log").alias("channel"))
    )
for name in ("op_17_short",):
    query(name, "SELECT alert_id, '[' || severity || '] ' || error_code || chr(10) || 'key: ' || dedup_key AS text FROM alert_events")(
        lambda t: t.alert_events.select("alert_id", F.concat_ws("\n", F.concat(F.lit("["), "severity", F.lit("] "), "error_code"), F.concat(F.lit("key: "), "dedup_key")).alias("text"))
    )
query("op_21", "SELECT o_orderkey, regexp_matches(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS ok FROM orders")(lambda t: t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("ok")))
query("op_25", f"SELECT call_id, CASE WHEN hard_deleted_at IS NOT NULL THEN 'unavailable' WHEN soft_deleted_at IS NOT NULL THEN 'withheld' ELSE 'available' END AS state FROM raw_transcripts")(
    lambda t: t.raw_transcripts.select("call_id", F.when(c("hard_deleted_at").isNotNull(), "unavailable").when(c("soft_deleted_at").isNotNull(), "withheld").otherwise("available").alias("state"))
)
query("op_30", "SELECT row_id, '[NAME_' || (row_id % 10) || ']' AS label FROM token_vault")(lambda t: t.token_vault.select("row_id", F.concat(F.lit("[NAME_"), (c("row_id") % 10).cast("string"), F.lit("]")).alias("label")))
query("op_32", "SELECT review_id, CASE held_reason WHEN 'cost_cap_held' THEN 60 WHEN 'missing_transcript' THEN 1440 ELSE 240 END AS minutes FROM review_queue")(
    lambda t: t.review_queue.select("review_id", F.when(c("held_reason") == "cost_cap_held", 60).when(c("held_reason") == "missing_transcript", 1440).otherwise(240).alias("minutes"))
)
query("op_33", "SELECT review_id, 'REVIEW_QUEUE_STALLED:review_queue:' || review_id AS key FROM review_queue")(lambda t: t.review_queue.select("review_id", F.concat(F.lit("REVIEW_QUEUE_STALLED:review_queue:"), c("review_id").cast("string")).alias("key")))
for name in ("op_34",):
    query(name, "SELECT rq.review_id, cs.status AS call_status, CASE WHEN rq.raw_purged_at IS NULL THEN cs.current_stage END AS stage FROM review_queue rq LEFT JOIN call_state cs USING (call_id)")(
        lambda t: t.review_queue.select("review_id", "call_id", "raw_purged_at").join(t.call_state.select("call_id", c("status").alias("call_status"), "current_stage"), "call_id", "left").select("review_id", "call_status", F.when(c("raw_purged_at").isNull(), c("current_stage")).alias("stage"))
    )
query("op_35", f"SELECT review_id, raw_purged_at IS NULL AND created_at + INTERVAL 7 DAYS > {TS} AS open FROM review_queue")(lambda t: t.review_queue.select("review_id", (c("raw_purged_at").isNull() & (c("created_at") + F.expr("INTERVAL 7 DAYS") > at())).alias("open")))
query("op_39", "SELECT review_id, upper(held_reason[1:1]) || replace(held_reason, '_', ' ')[2:] || '.' AS explanation FROM review_queue")(lambda t: t.review_queue.select("review_id", F.concat(C.humanized(c("held_reason")), F.lit(".")).alias("explanation")))
query("op_43_states", f"SELECT status, count(*) AS n FROM (SELECT status FROM call_state ORDER BY updated_at DESC, call_id LIMIT 200) AS x GROUP BY status")(lambda t: R.counts(t.call_state.orderBy(F.desc("updated_at"), "call_id").limit(200), ["status"]))
query("op_46", "SELECT doc_id, length(text) <= 800 AS short_enough FROM documents")(lambda t: t.documents.select("doc_id", (F.length("text") <= 800).alias("short_enough")))
for name in ("op_48",):
    query(name, SPENDING.format(cap=4000) + " SELECT id, CASE WHEN ok THEN 'predicted' ELSE 'cost_capped' END AS status FROM spent")(lambda t: _budget(t).select("id", F.when(~c("accepted"), "cost_capped").otherwise("predicted").alias("status")))
query("op_52_counts", "SELECT bool_and(n > 0) AS succeeded FROM (SELECT count(*) AS n FROM call_state UNION ALL SELECT count(*) FROM alert_events UNION ALL SELECT count(*) FROM review_queue) AS x")(
    lambda t: t.call_state.agg(F.count("*").alias("n")).union(t.alert_events.agg(F.count("*"))).union(t.review_queue.agg(F.count("*"))).agg(F.every(c("n") > 0).alias("succeeded"))
)
query("op_53_case", "SELECT alert_id, CASE WHEN delivery_state = 'delivered' THEN 'skipped' WHEN attempts > 4 THEN 'failed' ELSE 'delivered' END AS result FROM alert_events")(
    lambda t: t.alert_events.select("alert_id", F.when(c("delivery_state") == "delivered", "skipped").when(c("attempts") > 4, "failed").otherwise("delivered").alias("result"))
)
query("op_57", "SELECT 'destroyed_in_use' AS violation, count(*) AS n FROM key_versions k WHERE status = 'destroyed' AND EXISTS (SELECT 1 FROM token_vault v WHERE v.key_version = k.version AND v.soft_deleted_at IS NULL) UNION ALL SELECT 'no_active', count(*) FROM (SELECT kek FROM key_versions GROUP BY kek HAVING count(*) FILTER (WHERE status = 'active') = 0) AS x")(
    lambda t: R.having(t.key_versions.filter("status = 'destroyed'"), t.token_vault.filter("soft_deleted_at IS NULL").select(c("key_version").alias("version")), ["version"]).agg(F.lit("destroyed_in_use").alias("violation"), F.count("*").alias("n"))
    .unionByName(t.key_versions.groupBy("kek").agg(F.count_if(c("status") == "active").alias("a")).filter("a = 0").agg(F.lit("no_active").alias("violation"), F.count("*").alias("n")))
)
