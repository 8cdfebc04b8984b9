"""Sealed transcripts and vault values, and the life cycle of their keys, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys as K
from .registry import at, query
from .standins import NOW, Tables

c = F.col
TS = f"TIMESTAMP '{NOW}'"
MASTER = "a master secret of the tests"
LIVE = "soft_deleted_at IS NULL AND hard_deleted_at IS NULL"


def _transcripts(t: Tables):
    """The raw transcripts with their sealed text: every order's document of the same number, if there is one."""
    texts = t.clean_transcripts.select("call_id", "text")
    rows = t.raw_transcripts.withColumn("key_version", c("key_version") % 100).join(texts, "call_id")
    return rows.withColumn("box", K.sealed(c("text"), c("call_id"), c("key_version"), MASTER)).drop("text")


def _vault(t: Tables):
    """The token vault with its sealed values."""
    return t.token_vault.withColumn("box", K.sealed(F.concat(F.lit("person "), c("row_id").cast("string")), c("call_id"), c("key_version"), MASTER))


_RAW = "raw AS (SELECT p.call_id, p.key_version % 100 AS key_version, p.soft_deleted_at, p.hard_deleted_at, d.text FROM raw_transcripts p JOIN clean_transcripts d USING (call_id))"
_MOVES = "moves AS (SELECT k.version, a.target FROM key_versions k JOIN (SELECT kek, max(version) AS target FROM key_versions WHERE status = 'active' GROUP BY kek) AS a USING (kek) WHERE k.status = 'rotating')"

query("src_13", f", {_RAW} SELECT call_id, key_version, md5(text) AS text_md5 FROM raw WHERE {LIVE}")(
    lambda t: _transcripts(t).filter(LIVE).select("call_id", "key_version", F.md5(K.opened(c("box"), c("call_id"), c("key_version"), MASTER)).alias("text_md5"))
)
query("rd_44", f"SELECT row_id, call_id, token, 'person ' || row_id AS value FROM token_vault WHERE {LIVE}")(
    lambda t: _vault(t).filter(LIVE).select("row_id", "call_id", "token", K.opened(c("box"), c("call_id"), c("key_version"), MASTER).alias("value"))
)
query("op_07", f"SELECT doc_id AS call_id, doc_id % 5 + 1 AS version, strlen(text) + {K.OVERHEAD} AS box_bytes, md5(text) AS text_md5, true AS other_refused FROM documents WHERE text IS NOT NULL")(
    lambda t: t.clean_transcripts.filter("text IS NOT NULL").withColumn("version", c("call_id") % 5 + 1).withColumn("box", K.sealed(c("text"), c("call_id"), c("version"), MASTER))
    .select("call_id", "version", F.octet_length("box").alias("box_bytes"), F.md5(K.opened(c("box"), c("call_id"), c("version"), MASTER)).alias("text_md5"),
            K.opened(c("box"), c("call_id"), c("version") + 1, MASTER).isNull().alias("other_refused"))
)
query("str_21", f", {_RAW}, {_MOVES} SELECT call_id, coalesce(target, key_version) AS key_version, md5(text) AS text_md5 FROM raw LEFT JOIN moves ON version = key_version")(
    lambda t: K.resealed(_transcripts(t), K.targets(t.key_versions), MASTER).select("call_id", "key_version", F.md5(K.opened(c("box"), c("call_id"), c("key_version"), MASTER)).alias("text_md5"))
)
query("op_63", f", {_MOVES} SELECT row_id, coalesce(target, key_version) AS key_version, 'person ' || row_id AS value FROM token_vault LEFT JOIN moves ON version = key_version WHERE hard_deleted_at IS NULL")(
    lambda t: K.resealed(_vault(t).filter("hard_deleted_at IS NULL"), K.targets(t.key_versions), MASTER).select("row_id", "key_version", K.opened(c("box"), c("call_id"), c("key_version"), MASTER).alias("value"))
)


def _rotated(t: Tables):
    moves = K.targets(t.key_versions)
    swept = lambda df: K.resealed(df.withColumn("before", c("key_version")), moves, MASTER)
    return K.rotate(t.key_versions, swept(_transcripts(t)), swept(_vault(t)), moves)


query(
    "op_61",
    f", {_RAW}, {_MOVES} SELECT version, target, (SELECT count(*) FROM raw r WHERE r.key_version = m.version AND r.hard_deleted_at IS NULL) AS moved_raw, "
    "(SELECT count(*) FROM token_vault v WHERE v.key_version = m.version AND v.hard_deleted_at IS NULL) AS moved_vault, 0 AS \"left\", 'retired' AS status FROM moves m",
)(_rotated)
_AFFECTED = f"""
, {_RAW}, counts AS (SELECT version, kek, status, (SELECT count(*) FROM raw r WHERE r.key_version = k.version AND r.hard_deleted_at IS NULL) AS r,
  (SELECT count(*) FROM token_vault v WHERE v.key_version = k.version AND v.hard_deleted_at IS NULL) AS v FROM key_versions k)"""
query("op_59", f"{_AFFECTED} SELECT version, CASE status WHEN 'active' THEN 'refused_active' WHEN 'retired' THEN 'destroy_requested' ELSE 'refused_not_retired' END AS result, CASE status WHEN 'retired' THEN r ELSE 0 END AS affected_raw, CASE status WHEN 'retired' THEN v ELSE 0 END AS affected_vault FROM counts")(
    lambda t: K.revoke(t.key_versions, _transcripts(t), t.token_vault)
)
_PARENTS = "(kek * 5 + version % 5)"  # finer than the nation, so that some parents have no active version
_finer = lambda t: t.key_versions.withColumn("kek", c("kek") * 5 + c("version") % 5)
query(
    "op_60",
    f"{_AFFECTED} SELECT {_PARENTS} AS kek, CASE WHEN bool_or(status = 'active') THEN 'refused_active' ELSE 'destroy_requested' END AS result, "
    "CASE WHEN bool_or(status = 'active') THEN 0 ELSE CAST(sum(CASE WHEN status <> 'destroyed' THEN r ELSE 0 END) AS BIGINT) END AS affected_raw, "
    "CASE WHEN bool_or(status = 'active') THEN 0 ELSE CAST(sum(CASE WHEN status <> 'destroyed' THEN v ELSE 0 END) AS BIGINT) END AS affected_vault, "
    "CASE WHEN bool_or(status = 'active') THEN 0 ELSE count(*) FILTER (WHERE status <> 'destroyed') END AS versions FROM counts GROUP BY 1",
)(lambda t: K.revoke_parent(_finer(t), _transcripts(t), t.token_vault))
query(
    "op_62",
    "SELECT kek, 'retired' AS status FROM (SELECT DISTINCT kek FROM key_versions) AS x UNION ALL SELECT max(kek) + 1, 'active' FROM key_versions",
)(
    lambda t: K.rotate_parent(t.key_versions.groupBy("kek").agg(F.lit("retired").alias("status")).join(t.key_versions.agg(F.max("kek").alias("most")))
                              .select("kek", F.when(c("kek") == c("most"), "active").otherwise(c("status")).alias("status")), F.max("kek") + 1)
)
_ASKED = "CASE WHEN status = 'retired' THEN TIMESTAMP '2024-01-01 00:00:00' END"
_UNTIL = "CASE WHEN status = 'retired' THEN CASE WHEN balance < 1500 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-02-10 00:00:00' END END"
query(
    "op_58",
    f""", k AS (SELECT version, {_PARENTS} AS kek, status, {_ASKED} AS asked, {_UNTIL} AS until FROM key_versions)
SELECT 'version' AS kind, version AS id, CASE WHEN until <= {TS} THEN 'destroyed' ELSE 'pending' END AS result FROM k WHERE asked IS NOT NULL
UNION ALL SELECT 'parent', kek, CASE WHEN bool_and(status = 'destroyed' OR coalesce(until <= {TS}, false)) THEN 'destroyed' ELSE 'pending' END FROM k GROUP BY kek HAVING bool_and(status = 'destroyed' OR asked IS NOT NULL)""",
)(lambda t: K.finalize(_finer(t).withColumns({"destroy_requested_at": F.expr(_ASKED.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "recovery_window_until": F.expr(_UNTIL.replace("TIMESTAMP", "TIMESTAMP_NTZ"))}), at()))
_REVIEWED = "rq.call_id % 1000"  # a call of a document
query(
    "op_38",
    f""", {_RAW}, r AS (SELECT review_id, CASE WHEN status NOT IN ('open', 'in_review') THEN 'conflict'
  WHEN raw_purged_at IS NULL AND {TS} < created_at + INTERVAL 240 HOURS AND p.text IS NOT NULL THEN 'revealed' ELSE 'unavailable' END AS result, {_REVIEWED} AS call_id, p.text
  FROM review_queue rq LEFT JOIN (SELECT * FROM raw WHERE {LIVE}) AS p ON p.call_id = {_REVIEWED})
SELECT review_id, result, CASE WHEN result = 'revealed' THEN md5(text) END AS text_md5,
  CASE WHEN result = 'revealed' THEN '{{"action":"reveal_raw","revealed":["transcript"],"call_id":' || call_id || '}}' END AS audit FROM r""",
)(lambda t: K.reveal(t.review_queue.withColumn("call_id", c("call_id") % 1000), _transcripts(t), at(), 240, MASTER).select("review_id", "result", F.md5("transcript").alias("text_md5"), "audit"))
query("op_36", f"SELECT review_id, raw_purged_at IS NULL AND created_at + INTERVAL 7 DAYS > {TS} AND EXISTS (SELECT 1 FROM raw_transcripts p WHERE p.call_id = rq.call_id AND p.{LIVE.replace('AND ', 'AND p.')}) AS allowed FROM review_queue rq")(
    lambda t: t.review_queue.join(t.raw_transcripts.filter(LIVE).select("call_id", F.lit(True).alias("present")), "call_id", "left")
    .select("review_id", (c("raw_purged_at").isNull() & (c("created_at") + F.expr("INTERVAL 7 DAYS") > at()) & F.coalesce("present", F.lit(False))).alias("allowed"))
)
