"""Deliveries, checkpoints, gates, samples, duties and scans of candidates on small examples."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callweave.operators import operations as O

T0 = datetime(2024, 1, 1)
REQUESTS = "alert_id long, id long, read_at timestamp_ntz, at timestamp_ntz, immediate boolean, result string"


def requests(spark, rows):
    """rows: (alert, id, minute read, minute claimed, immediate, result)"""
    return spark.createDataFrame([(a, i, T0 + timedelta(minutes=r), T0 + timedelta(minutes=m), now, res) for a, i, r, m, now, res in rows], REQUESTS)


def outcomes(spark, rows, base_minutes=10, most=3):
    return {r.id: (r.outcome, r.attempts) for r in O.deliveries(requests(spark, rows), base_minutes * 60, most).collect()}


def test_two_callers_that_read_the_same_row_send_once(spark):
    got = outcomes(spark, [(1, 1, 0, 1, False, "failed"), (1, 2, 0, 2, True, "sent"), (1, 3, 3, 3, True, "sent"), (1, 4, 60, 60, True, "sent")])
    assert got == {1: ("failed", 1), 2: ("skipped", 1), 3: ("delivered", 2), 4: ("skipped", 2)}


def test_a_lost_caller_leases_the_alert_for_one_backoff(spark):
    # the first attempt leases ten minutes, the second twenty
    got = outcomes(spark, [(1, 1, 0, 0, False, "lost"), (1, 2, 9, 9, False, "sent"), (1, 3, 10, 10, False, "lost"), (1, 4, 29, 29, False, "sent"), (1, 5, 30, 30, False, "sent")])
    assert [got[i] for i in range(1, 6)] == [("leased", 1), ("skipped", 1), ("leased", 2), ("skipped", 2), ("delivered", 3)]


def test_attempts_end_and_alerts_are_apart(spark):
    rows = [(1, i, 1000 * i, 1000 * i, None, "failed") for i in range(1, 6)] + [(None, 9, 0, 0, False, "sent")]
    got = outcomes(spark, rows)
    assert [got[i][0] for i in range(1, 6)] == ["failed"] * 3 + ["skipped"] * 2 and got[9] == ("delivered", 1)
    assert outcomes(spark, []) == {}


def test_deliveries_against_a_plain_loop(spark):
    dice = random.Random(7)
    rows, clock = [], {}
    for i in range(600):
        alert = dice.randrange(12)
        at = clock[alert] = clock.get(alert, 0) + dice.randrange(40)
        rows.append((alert, i, max(0, at - dice.randrange(30)), at, dice.random() < 0.2, dice.choice(["failed", "failed", "failed", "lost", "sent"])))
    want = {}
    for alert in range(12):
        tries, due, claimed, done = 0, 0, -1, False
        for _, i, read, at, now, result in sorted((r for r in rows if r[0] == alert), key=lambda r: (r[3], r[1])):
            if done or tries == 5 or claimed > read or not (now or due <= read):
                want[i] = ("skipped", tries)
                continue
            due, claimed, tries, done = at + 10 * 2**tries, at, tries + 1, result == "sent"
            want[i] = ({"sent": "delivered", "failed": "failed", "lost": "leased"}[result], tries)
    assert outcomes(spark, rows, most=5) == want


def test_retry_sweep_lists_what_is_owed_and_due(spark):
    done = O.deliveries(requests(spark, [(1, 1, 0, 0, False, "failed"), (2, 2, 0, 0, False, "sent"), (3, 3, 0, 25, False, "lost")]), 600, 3)
    got = O.retryable(done, F.lit(T0 + timedelta(minutes=30)).cast("timestamp_ntz"), 600, 3).collect()
    assert [(r.alert_id, r.attempts, r.lease_us - r.next_us) for r in got] == [(1, 1, 40 * 60_000_000)]


WHOLE = '{"v":1,"phase":"sweep","watermarkStartedAtMs":5,"callsSeen":3,"seededTotal":2,"terminalCount":0}'


@pytest.mark.parametrize(
    "raw, error",
    [
        (WHOLE, None), (None, None), (WHOLE.replace(":5", ":null"), None), (WHOLE.replace(":3", ":3.0"), None), (WHOLE.replace("{", '{"x":[1],'), None), (WHOLE[:-1], "malformed"), ("", "malformed"), ("null", "unrecognised"),
        ("[]", "unrecognised"), (f"[{WHOLE}]", "unrecognised"), (WHOLE.replace('"v":1', '"v":2'), "unrecognised"), (WHOLE.replace('"v":1', '"v":"1"'), "unrecognised"), (WHOLE.replace('"v":1,', ""), "unrecognised"),
        (WHOLE.replace("sweep", "SWEEP"), "unrecognised"), (WHOLE.replace('"sweep"', "1"), "unrecognised"), (WHOLE.replace('"watermarkStartedAtMs":5,', ""), "unrecognised"), (WHOLE.replace(":5", ':"5"'), "unrecognised"),
        (WHOLE.replace(":3", ":3.5"), "unrecognised"), (WHOLE.replace(":3", ":-3"), "unrecognised"), (WHOLE.replace(":3", ":true"), "unrecognised"), (WHOLE.replace(":2", ":null"), "unrecognised"),
    ],
)
def test_checkpoints_are_read_strictly(spark, raw, error):
    row = O.decoded(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert row.error == error
    assert (row.calls_seen, row.seeded_total) == ((3, 2) if raw and error is None else (None, None))


def test_checkpoint_round_trip(spark):
    rows = spark.createDataFrame([("sweep", None, 1, 2, 3), ("drain", 1 << 40, 0, 0, 0)], "p string, w long, a long, b long, c long")
    got = O.decoded(rows.withColumn("raw", O.checkpoint_json(F.col("p"), F.col("w"), F.col("a"), F.col("b"), F.col("c"))), "raw")
    assert got.filter("error IS NULL AND phase = p AND watermark_ms <=> w AND calls_seen = a AND seeded_total = b AND terminal_count = c").count() == 2


def test_gates(spark):
    runs = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "run long, writes boolean")
    recorded = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (3, "a"), (4, "a"), (4, "b"), (4, "m"), (4, "other")], "run long, gate string")
    got = {r.run: (r.missing, r.passes) for r in O.missing_gates(runs, recorded, "run", ["b", "a"], {"m": F.col("writes")}).collect()}
    assert got == {1: ("m", False), 2: ("", True), 3: ("b", False), 4: ("", True)}


def test_sample_reports_withhold_guarded_texts(spark):
    calls = spark.createDataFrame([(i, "completed", "extract", None, T0 + timedelta(hours=i)) for i in range(5)], "call_id long, status string, current_stage string, drop_reason string, created_at timestamp_ntz")
    reviews = spark.createDataFrame([(4, 1, "old", T0), (4, 2, "new", T0), (0, 3, "x", T0)], "call_id long, review_id long, held_reason string, created_at timestamp_ntz")
    log = spark.createDataFrame([(4, "redact", "success"), (4, "redact", "success"), (4, "extract", "failed"), (3, "extract", "success")], "call_id long, stage string, outcome string")
    texts = spark.createDataFrame([(4, "mail a@b now 1234567"), (3, "clean"), (2, None)], "call_id long, text string")
    got = {r.call_id: r for r in O.sample_reports(calls, reviews, log, spark.createDataFrame([(3,)], "call_id long"), texts, 3, {"email": "[a-z]@[a-z]", "digits": "[0-9]{7}"}).collect()}
    assert sorted(got) == [2, 3, 4]
    assert (got[4].hold_reason, got[4].stages, got[4].guard_categories, got[4].guard_tripped, got[4].text_sha256) == ("new", 1, "digits,email", True, None)
    assert (got[3].stages, got[3].record_present, got[3].guard_tripped, len(got[3].text_sha256)) == (1, True, False, 64)
    assert (got[2].stages, got[2].record_present, got[2].guard_tripped, got[2].text_sha256) == (0, False, False, None)


def test_a_duty_that_throws_withholds_the_ping_and_stops_no_other(spark):
    fine = lambda: spark.createDataFrame([(False,), (False,)], "failed boolean")
    gone = lambda: spark.read.parquet("/nowhere/at/all")
    got = [tuple(r) for r in O.duties(spark, {"a": fine, "b": gone, "c": lambda: spark.createDataFrame([(None,), (False,)], "failed boolean")}).collect()]
    assert got == [("a", 2, 0, True, False), ("b", None, None, False, False), ("c", 2, 1, False, False)]
    assert all(r.ping for r in O.duties(spark, {"a": fine}).collect())


def test_a_failed_scan_is_a_latch(spark):
    kinds = "call_id long, phrases string, status string, failed_at timestamp_ntz, kind string, counts string, soft_deleted_at timestamp_ntz, hard_deleted_at timestamp_ntz, more int"
    candidates = spark.createDataFrame([(1, '["a"]', "pending", None, None, None, None, None, 1), (2, '["a"]', "passed", None, None, None, None, None, 2), (3, '["a"]', "pending", None, None, None, T0, None, 3), (4, '["a"]', "pending", None, None, None, None, None, 4)], kinds)
    scans = spark.createDataFrame([(1, "residual_pii", "{}"), (1, None, None), (2, "tokened_phrase", "{}"), (3, "residual_pii", "{}"), (4, None, None), (9, "residual_pii", "{}")], "call_id long, kind string, counts string")
    failed = O.scan_failed(candidates, scans, F.lit(T0).cast("timestamp_ntz"))
    assert failed.columns == candidates.columns
    assert {r.call_id: (r.status, r.phrases, r.kind) for r in failed.collect()} == {1: ("failed", "[]", "residual_pii"), 2: ("failed", "[]", "tokened_phrase"), 3: ("pending", '["a"]', None), 4: ("pending", '["a"]', None)}
    clean = spark.createDataFrame([(i, None, None) for i in (1, 2, 3, 4)], "call_id long, kind string, counts string")
    assert {r.call_id: r.status for r in O.scan_passed(failed, clean).collect()} == {1: "failed", 2: "failed", 3: "pending", 4: "passed"}
    assert {r.call_id: r.status for r in O.scan_passed(candidates, scans).collect()} == {1: "pending", 2: "passed", 3: "pending", 4: "passed"}


def test_alert_texts(spark):
    catalog = spark.createDataFrame([("A", "high", "It broke.", "A cause.", "None.", "Mend it.", None, True, "held", "book/a")], "code string, severity string, what_broke string, likely_cause string, impact string, remedy_now string, remedy_later string, data_safe boolean, calls string, runbook string")
    alerts = spark.createDataFrame([(1, "A", "high", T0, 77, None), (2, "A", "low", T0, 77, None), (3, "B", "high", T0, 77, None), (4, None, None, T0, 1, "x"), (5, "A", "high", T0, None, None)], "alert_id long, code string, severity string, created_at timestamp_ntz, call_id long, stage string")
    got = {r.alert_id: r for r in O.alert_texts(alerts, catalog, "test", ["stage", "call_id"]).collect()}
    lines = got[1].text.split("\n")
    assert lines[0] == "[high] A in test at 2024-01-01T00:00:00.000Z" and len(lines) == 10
    assert "Longer-term fix: Same as the immediate step." in lines and "Affected: call_id" in lines and "77" not in got[1].text
    assert "Affected: none" in got[5].text.split("\n")
    assert [(got[i].text, got[i].reason) for i in (2, 3, 4)] == [(None, "other severity"), (None, "unknown code"), (None, "unknown code")]
