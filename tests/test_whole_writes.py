"""Writes, exports and caps over whole tables."""

from pathlib import Path

import duckdb
import pytest

from callweave import plans
from callweave.operators import writes

SF = "/root/testdata/sf0.001"
OLD = {"snk_01": "call_state", "snk_02": "call_state", "snk_03": "raw_transcripts", "snk_04": "raw_transcripts", "snk_06": "technician_notes", "snk_17": "structured_knowledge"}


@pytest.mark.parametrize("name", OLD)
def test_no_row_is_left_out(spark, name):
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    sql = plans.oracle_sql()[name]
    want, got = con.sql(sql), plans.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(map(str, r)) for r in got.select(*want.columns).collect()]
    assert sorted(rows) == sorted(tuple(map(str, r)) for r in want.fetchall())
    old = getattr(plans.registry.Tables(spark, SF), OLD[name])
    if name == "snk_17":
        assert len(rows) == old.count()
    else:
        ids = [int(r[want.columns.index("call_id")]) for r in rows]
        assert len(set(ids)) == len(ids) and {r.call_id for r in old.select("call_id").collect()} < set(ids)


def test_export_says_when_it_is_cut(spark):
    df = spark.createDataFrame([(i, "low") for i in range(5)], "call_id int, urgency string")
    cut = writes.json_export(df, ["call_id"], 2).collect()
    assert [(r.line, r.total, r.truncated) for r in cut] == [(f'{{"call_id":{i},"urgency":"low"}}', 5, True) for i in (0, 1)]
    assert [(r.total, r.truncated) for r in writes.json_export(df, ["call_id"], 5).collect()] == [(5, False)] * 5


def test_cap_takes_late_places_too(spark, tmp_path):
    """set_05 has calls of places from 60 on where its cap leaves room."""
    from callweave.streaming.flows import EVENTS
    from datetime import datetime

    spark.createDataFrame([(i, datetime(2024, 1, 1), i, "view", 1.0, f'{{"k": {k}}}') for i, k in enumerate((5, 59, 60, 99))], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.first_pos for r in plans.queries()["set_05"](spark, str(tmp_path)).collect()) == [5, 59, 60, 99]
