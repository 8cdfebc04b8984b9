"""Sealed values and key life cycle against plain expectations."""

from datetime import datetime

from pyspark.sql import functions as F

from callweave.operators import keys as K

c = F.col
GONE = datetime(2024, 1, 1)


def boxed(spark, rows):
    df = spark.createDataFrame(rows, "call_id long, key_version long, hard_deleted_at timestamp_ntz, soft_deleted_at timestamp_ntz, text string")
    return df.withColumn("box", K.sealed(c("text"), c("call_id"), c("key_version"), "m"))


def test_boxes_open_only_where_they_belong(spark):
    df = boxed(spark, [(1, 1, None, None, "héllo"), (2, 1, None, None, ""), (3, 2, None, None, None)])
    got = df.select(
        K.opened(c("box"), c("call_id"), c("key_version"), "m").alias("a"), K.opened(c("box"), c("call_id") + 1, c("key_version"), "m").alias("b"),
        K.opened(c("box"), c("call_id"), c("key_version") + 1, "m").alias("v"), K.opened(c("box"), c("call_id"), c("key_version"), "other").alias("k"),
    ).collect()
    assert [(r.a, r.b, r.v, r.k) for r in got] == [("héllo", None, None, None), ("", None, None, None), (None, None, None, None)]
    twice = df.select("call_id", K.sealed(F.lit("x"), c("call_id") * 0, F.lit(1), "m").alias("s")).filter("call_id < 3").collect()
    assert len({bytes(r.s) for r in twice}) == 2  # never the same nonce


def test_rotation_moves_everything_that_opens(spark):
    raw = boxed(spark, [(1, 1, None, None, "a"), (2, 1, GONE, None, "b"), (3, 2, None, None, "c"), (4, 3, None, None, "d")])
    versions = spark.createDataFrame([(1, 0, "rotating"), (2, 0, "active"), (3, 0, "retired"), (5, 9, "rotating")], "version long, kek long, status string")
    moves = K.targets(versions)
    assert [tuple(r) for r in moves.collect()] == [(1, 2)]  # the other parent has no active version
    swept = K.resealed(raw.withColumn("before", c("key_version")), moves, "m")
    got = {r.call_id: (r.key_version, r.t) for r in swept.select("*", K.opened(c("box"), c("call_id"), c("key_version"), "m").alias("t")).collect()}
    assert got == {1: (2, "a"), 2: (2, "b"), 3: (2, "c"), 4: (3, "d")}
    assert [tuple(r) for r in K.rotate(versions, swept, swept.limit(0), moves).collect()] == [(1, 2, 1, 0, 0, "retired")]
    stuck = raw.withColumn("before", c("key_version"))
    assert [tuple(r) for r in K.rotate(versions, stuck, stuck.limit(0), moves).collect()] == [(1, 2, 0, 0, 1, "rotating")]


def test_revocation_and_destruction(spark):
    raw = boxed(spark, [(1, 1, None, None, "a"), (2, 3, None, GONE, "b"), (3, 3, GONE, GONE, "c")])
    versions = spark.createDataFrame([(1, 0, "active"), (3, 0, "retired"), (4, 1, "destroyed"), (5, 1, "retired")], "version long, kek long, status string")
    assert sorted(tuple(r) for r in K.revoke(versions, raw, raw.limit(0)).collect()) == [(1, "refused_active", 0, 0), (3, "destroy_requested", 1, 0), (4, "refused_not_retired", 0, 0), (5, "destroy_requested", 0, 0)]
    assert sorted(tuple(r) for r in K.revoke_parent(versions, raw, raw).collect()) == [(0, "refused_active", 0, 0, 0), (1, "destroy_requested", 0, 0, 1)]
    late, early = datetime(2024, 3, 1), datetime(2024, 1, 5)
    asked = spark.createDataFrame([(1, 0, "active", None, None), (3, 0, "retired", GONE, early), (4, 1, "destroyed", None, None), (5, 1, "retired", GONE, early), (6, 2, "retired", GONE, late)], "version long, kek long, status string, destroy_requested_at timestamp_ntz, recovery_window_until timestamp_ntz")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert sorted(tuple(r) for r in K.finalize(asked, now).collect()) == [("parent", 1, "destroyed"), ("parent", 2, "pending"), ("version", 3, "destroyed"), ("version", 5, "destroyed"), ("version", 6, "pending")]


def test_reveal_is_guarded_and_audited(spark):
    raw = boxed(spark, [(1, 1, None, None, "said"), (2, 1, None, GONE, "gone")])
    day = datetime(2024, 1, 31)
    reviews = spark.createDataFrame([(10, 1, "open", None, day), (11, 2, "open", None, day), (12, 1, "resolved", None, day), (13, 1, "in_review", day, day), (14, 1, "open", None, GONE), (15, 9, "open", None, day)], "review_id long, call_id long, status string, raw_purged_at timestamp_ntz, created_at timestamp_ntz")
    got = {r.review_id: (r.result, r.transcript, r.audit) for r in K.reveal(reviews, raw, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 48, "m").collect()}
    assert got.pop(10) == ("revealed", "said", '{"action":"reveal_raw","revealed":["transcript"],"call_id":1}')
    assert got == {11: ("unavailable", None, None), 12: ("conflict", None, None), 13: ("unavailable", None, None), 14: ("unavailable", None, None), 15: ("unavailable", None, None)}
