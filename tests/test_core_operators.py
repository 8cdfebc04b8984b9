"""Operators on small tables, with nulls, ties and empty inputs."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callweave.functions import columns as C
from callweave.functions import vocab as V
from callweave.operators import params, redaction, rows, states, writes
from callweave.sources import readers

DAY = lambda d: datetime(2024, 1, d)


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, DAY(1), 1), (1, DAY(1), 2), (2, DAY(3), 3), (None, DAY(1), 4)], "k int, t timestamp_ntz, id int")
    assert {(r.k, r.id) for r in rows.latest(df, ["k"], ["t", "id"]).collect()} == {(1, 2), (2, 3), (None, 4)}
    assert rows.latest(df.limit(0), ["k"], ["t", "id"]).count() == 0


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, DAY(5), "a"), (1, DAY(1), "b"), (2, DAY(9), "c")], "k int, t timestamp_ntz, name string")
    right = spark.createDataFrame([(1, DAY(1), 1, "x"), (1, DAY(4), 2, "y"), (1, DAY(4), 3, "z"), (1, DAY(5), 4, "w")], "k int, t timestamp_ntz, id int, v string")
    found = rows.as_of_before(left, right, ["k"], "t", "t", ["t", "id"], ["v"]).collect()
    assert {(r.name, r.v) for r in found} == {("a", "z"), ("b", None), ("c", None)}


def test_date_bounds():
    assert rows.day_bounds("2024-02-01", "2024-02-29") == (datetime(2024, 2, 1), datetime(2024, 3, 1))
    for bad in (("2024-02-02", "2024-02-01"), ("2023-02-29", None)):
        with pytest.raises(ValueError):
            rows.day_bounds(*bad)


def test_list_query_checks():
    q = params.ListQuery.parse({"urgency": " urgent ", "text": "", "size": "1000", "page": "0"})
    assert (q.urgency, q.text, q.size, q.page) == ("urgent", None, 200, 1)
    for bad in ({"x": "1"}, {"urgency": "soon"}, {"text": "y" * 300}, {"text": "call 212 555 0199"}):
        with pytest.raises(ValueError):
            params.ListQuery.parse(bad)


def test_forbidden_fields(spark):
    df = spark.createDataFrame([(1, [("x",)])], "a int, b array<struct<phone:string>>")
    with pytest.raises(ValueError):
        params.without_content(df)
    assert params.without_content(df.select("a")).columns == ["a"]


def test_upsert_keeps_protected_rows(spark):
    old = spark.createDataFrame([(1, "held", None), (2, "processing", DAY(1))], "id int, status string, at timestamp_ntz")
    new = spark.createDataFrame([(1, "processing", DAY(2)), (2, "completed", DAY(2)), (3, "processing", DAY(2))], "id int, status string, at timestamp_ntz")
    done = writes.upsert(old, new, ["id"], keep=F.col("old.status").isin(*V.PROTECTED_STATUSES), once=["at"])
    expected = {(1, "held", None), (2, "completed", DAY(1)), (3, "processing", DAY(2))}
    assert {tuple(r) for r in done.collect()} == expected
    again = writes.upsert(done, new, ["id"], keep=F.col("old.status").isin(*V.PROTECTED_STATUSES), once=["at"])
    assert {tuple(r) for r in again.collect()} == expected


def test_budget_depends_on_order(spark):
    df = spark.createDataFrame([(1, i, Decimal(a), DAY(i)) for i, a in ((1, "6"), (2, "5"), (3, "4"), (4, "0.0000004"))], "day int, id long, amount decimal(12,7), at timestamp_ntz")
    got = [(r.id, r.accepted, float(r.spent), r.warned) for r in states.budget_fold(df, 10).orderBy("id").collect()]
    assert got == [(1, True, 6.0, False), (2, False, 6.0, False), (3, True, 10.0, True), (4, True, 10.0, True)]


def test_guarded_adjust(spark):
    df = spark.createDataFrame([("k", 1, 1, Decimal("5")), ("k", 2, 2, Decimal("-7")), ("k", 3, 3, Decimal("-5"))], "key string, at int, id long, delta decimal(12,6)")
    assert [(r.id, r.applied, float(r.total)) for r in states.guarded_adjust(df).orderBy("id").collect()] == [(1, True, 5.0), (2, False, 5.0), (3, True, 0.0)]


def test_call_fold_ignores_stale_results(spark):
    steps = [(1, i, DAY(i + 1), s, "continue") for i, s in enumerate(V.STAGES)]
    steps += [(2, 20, DAY(1), V.STAGES[0], "drop"), (2, 21, DAY(2), V.STAGES[0], "continue"), (3, 30, DAY(1), V.STAGES[3], "continue"), (4, 40, DAY(1), V.STAGES[0], "hold")]
    got = {r.call_id: (r.status, r.stage) for r in states.call_fold(spark.createDataFrame(steps, "call_id int, id int, at timestamp_ntz, stage string, action string")).collect()}
    assert got == {1: ("completed", V.STAGES[-1]), 2: ("skipped", V.STAGES[0]), 3: ("processing", V.STAGES[0]), 4: ("held", V.STAGES[0])}


def test_first_open_alert(spark):
    df = spark.createDataFrame([(1, "k", DAY(1), DAY(3)), (2, "k", DAY(2), None), (3, "k", DAY(4), None), (4, "j", DAY(1), DAY(2)), (5, "j", DAY(3), None)], "alert_id int, dedup_key string, created_at timestamp_ntz, acknowledged_at timestamp_ntz")
    assert {r.alert_id for r in states.first_open_alert(df).collect()} == {1, 4, 5}


def test_review_matrix():
    assert V.allowed_actions("weak_servicetitan_match") == ("reject", "mark_unresolvable")
    assert "correct_extraction" in V.allowed_actions("schema_invalid") and "approve" in V.allowed_actions("emergency_review")


def test_columns(spark):
    row = spark.createDataFrame([("=1+1", 'a,"b"', "First one. Second", "4539148803436467", "2024-01-01T00:00:00Z", "17.5")], "a string, b string, c string, d string, e string, f string").select(
        C.csv_row([F.col("a"), F.col("b"), F.lit(None)]).alias("csv"), C.first_line(F.col("c")).alias("line"), C.luhn(F.col("d")).alias("luhn"), C.epoch_ms(F.col("e")).alias("iso"), C.epoch_ms(F.col("f")).alias("num"),
        C.humanized(F.lit("classified_spam")).alias("h"), C.risk_score(F.array(F.lit("short_transcript"), F.lit("short_transcript"), F.lit("address_like_ambiguous"))).alias("risk"),
        C.urgency_rule(F.lit("routine"), F.lit("quote"), F.lit("It  won’t shut off!")).alias("u"), C.urgency_rule(F.lit("routine"), F.lit("quote"), F.lit("smell gas")).alias("v"),
    ).first()
    assert tuple(row) == ("'=1+1,\"a,\"\"b\"\"\",", "First one.", True, 1704067200000, 17, "Classified spam", 0.3, "urgent", "emergency")


def test_redaction_columns(spark):
    df = spark.createDataFrame([(1, "call 212 555 0199 now"), (2, None), (3, "")], "id int, text string")
    got = {r.id: (r.redaction.text, r.decision) for r in redaction.decided(df).collect()}
    assert got[1] == ("call [PHONE_1] now", "write") and got[2] == got[3] == ("", "write")


def test_strict_records(spark):
    df = spark.createDataFrame([('{"bucket":"spam"}', "end_turn"), ('{"bucket":"spam","x":"1"}', "end_turn"), ("so: {}", "end_turn"), ("", "end_turn"), ("{}", "max_tokens"), (None, "refusal"), ("{}", "tool")], "a string, s string")
    got = [r[0] for r in df.select(redaction.strict_record(F.col("a"), F.col("s"), {"bucket": ("spam",)})["failure"]).collect()]
    assert got == [None, "schema_invalid", "non_json", "empty", "truncated", "refusal", "unexpected_stop_reason"]


def test_sources(spark, tmp_path):
    (tmp_path / "terms").write_text(" one \n\n# no\ntwo\n")
    assert {r.term for r in readers.term_lines(spark, str(tmp_path / "terms")).collect()} == {"one", "two"}
    (tmp_path / "fx.json").write_text(json.dumps({"calls": [{"callId": "a", "startedAt": 1.0}], "transcripts": {"a": "hi"}}))
    calls, texts = readers.fixture(spark, str(tmp_path / "fx.json"))
    assert calls.first().callId == "a" and texts.first().text == "hi"
    raw = [json.dumps({"lines": [{"name": "A", "content": "x"}, {"type": "moment", "content": "y"}, {"name": "B", "content": "z"}]}), json.dumps({"transcript": "flat"}), "plain", json.dumps({"status": "pending"})]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    assert [r[0] for r in df.select(readers.transcript_text(F.col("raw"))).collect()] == ["A: x\nB: z", "flat", "plain", raw[3]]
    assert [r[0] for r in df.select(readers.transcript_state(F.col("raw"))).collect()] == ["ready", "ready", "error", "not_ready"]


def test_a_bound_on_the_start_skips_pages(spark, tmp_path):
    path = str(tmp_path / "listing")
    calls = spark.createDataFrame([(i, float(i % 97), None if i % 3 else "hangup") for i in range(500)], "call_id long, started_at double, state string")
    readers.land_listing(calls, path, 20)
    found = readers.paged_calls(spark, path)
    assert sorted(found.collect()) == sorted((str(r.call_id), r.started_at, r.state) for r in calls.collect())
    late = found.filter("started_at > 80 AND state = 'hangup'")
    assert sorted(r.call_id for r in late.collect()) == sorted(str(i) for i in range(500) if i % 97 > 80 and i % 3 == 0)
    assert late.rdd.getNumPartitions() < found.rdd.getNumPartitions() / 2  # pages before the bound are no partitions
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "started_at" not in "".join(line for line in plan.splitlines() if "Filter" in line) or "paged_calls" in plan
    assert spark.read.format("paged_calls").option("path", path).option("started_after", "95").load().count() == sum(i % 97 > 95 for i in range(500))
    readers.land_listing(calls.limit(0), f"{path}0")
    assert readers.paged_calls(spark, f"{path}0").count() == 0


def test_a_cursor_that_does_not_advance(spark, tmp_path):
    for cursor, after in (("a", "b"), ("b", "a")):
        (tmp_path / "items" / f"cursor={cursor}").mkdir(parents=True)
        (tmp_path / "items" / f"cursor={cursor}" / "part-0").write_text(json.dumps({"items": []}))
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "part-0").write_text("\n".join(json.dumps({"cursor": x, "after": y, "latest": 1.0, "first": x == "a"}) for x, y in (("a", "b"), ("b", "a"))))
    with pytest.raises(Exception, match="does not advance"):
        readers.paged_calls(spark, str(tmp_path)).collect()


def test_cover_by_a_sweep_equals_any(spark):
    import random

    dice = random.Random(1)
    spans, others = ([(dice.choice("abc"), i, s := dice.randrange(30), s + dice.randrange(9)) for i in range(80)] for _ in range(2))
    df, of = (spark.createDataFrame(x, "k string, id int, start int, end int") for x in (spans, others))
    got = {r.id: r.covered for r in rows.covered_by(df, of, ["k"]).collect()}
    assert got == {i: any(k == x and s <= start and end <= e for x, _, s, e in others) for k, i, start, end in spans} and set(got.values()) == {True, False}


def test_a_part_that_fails_is_null(spark):
    got = rows.rollup(spark, {"good": ("long", lambda: spark.range(3).groupBy().count()), "bad": ("long", lambda: spark.read.parquet("/nowhere").groupBy().count()), "late": ("string", lambda: spark.range(1).selectExpr("raise_error('no')"))})
    assert got.collect() == [(3, None, None)]


def test_every_code_has_a_severity(spark):
    codes = spark.createDataFrame([("INTERNAL_ERROR",), ("DATABASE_UNAVAILABLE",), (None,)], "code string")
    assert [r[0] for r in codes.select(C.severity_of(F.col("code"))).collect()] == ["high", "critical", None]
    with pytest.raises(Exception, match="no such failure code"):
        spark.createDataFrame([("NO_SUCH",)], "code string").select(C.severity_of(F.col("code"))).collect()
