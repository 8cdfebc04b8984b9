"""The fold of stage results: against a plain loop, and without holding a call in memory."""

import random
from datetime import datetime, timedelta

from callweave.functions import vocab as V
from callweave.operators import states

T0 = datetime(2024, 1, 1)
LOG = "call_id long, id long, at timestamp_ntz, stage string, action string"


def plain(rows):
    done = {}
    for call, _, at, stage, action in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        status, rank, since = done.get(call, ("processing", 0, None))
        if status == "processing" and stage == V.STAGES[rank]:
            since = at if action not in (None, "defer") else since
            if action == "hold":
                status = "held"
            elif action == "drop" and stage in V.SKIP_STAGES:
                status = "skipped"
            elif action == "continue":
                status, rank = ("completed", rank) if rank == 8 else (status, rank + 1)
        done[call] = status, rank, since
    return {(c, s, V.STAGES[r], t) for c, (s, r, t) in done.items()}


def test_call_fold_equals_plain_loop(spark):
    dice = random.Random(5)
    rows = [
        (dice.choice((None, *range(60))), i, T0 + timedelta(minutes=dice.randrange(300)), dice.choice((None, *V.STAGES[:3], *V.STAGES)), dice.choice(("continue",) * 8 + ("drop", "hold", "defer", None)))
        for i in range(4000)
    ]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # calls go on over many batches
    try:
        assert {tuple(r) for r in states.call_fold(spark.createDataFrame(rows, LOG)).collect()} == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert states.call_fold(spark.createDataFrame([], LOG)).collect() == []


def test_call_fold_collects_no_arrays(spark):
    plan = states.call_fold(spark.createDataFrame([(1, 1, T0, V.STAGES[0], "hold")], LOG))._jdf.queryExecution().toString()
    assert "collect_list" not in plan
