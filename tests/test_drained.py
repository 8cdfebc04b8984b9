"""Stream queries over files that are not in time order: the same result as a plain fold over all rows."""

import os
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callweave import plans
from callweave.functions import vocab as V
from callweave.streaming import flows

T0 = datetime(2024, 1, 1)
ROWS = [(i, T0 + timedelta(seconds=97 * i), i % 5, "view", float(i * 37 % 211), "{}") for i in range(600)]


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """20 files, each of one stretch of time, that the source takes in another order."""
    path = tmp_path_factory.mktemp("shuffled")
    for place, part in enumerate([7 * i % 20 for i in range(20)]):
        spark.createDataFrame(ROWS[part * 30 : part * 30 + 30], flows.EVENTS).coalesce(1).write.parquet(f"{path}/one{place}")
        (found,) = (path / f"one{place}").glob("*.parquet")
        name = path / f"events{place:02}.parquet"
        found.rename(name)
        os.utime(name, (1_700_000_000 + 100 * place,) * 2)
    return str(path)


def test_dedup_keeps_every_event(spark, shuffled):
    assert sorted(r.event_id for r in plans.queries()["stream_dedup"](spark, shuffled).collect()) == [r[0] for r in ROWS]


def test_rates_count_every_event(spark, shuffled):
    want = Counter((r[2], r[1].replace(second=0)) for r in ROWS)
    got = {(r.user_id, r.start): (r.n, r.limited) for r in plans.queries()["stream_rates"](spark, shuffled).collect()}
    assert got == {k: (n, n > 1) for k, n in want.items()}


def test_states_follow_seq(spark, shuffled):
    want, at = [], {}
    for i, _, user, _, value, _ in ROWS:
        status, rank = at.get(user, ("processing", 0))
        stage, action = V.STAGES[i % 9], "hold" if value > 200 else "drop" if value > 150 else "continue"
        if status != "processing" or stage != V.STAGES[rank]:
            continue
        if action == "hold":
            status = "held"
        elif action == "drop" and stage in V.SKIP_STAGES:
            status = "skipped"
        elif action == "continue" and rank == 8:
            status = "completed"
        elif action == "continue":
            rank += 1
        else:
            continue
        at[user] = status, rank
        want.append((user, status, V.STAGES[rank], i))
    got = plans.queries()["stream_states"](spark, shuffled).select("call_id", "status", "stage", "seq").collect()
    assert len(want) > 5 and sorted(map(tuple, got)) == sorted(want)


def test_first_within_ttl(spark):
    rows = [(1, "a", 0), (2, "a", 4), (3, "a", 5), (4, "a", 9), (5, "b", 4), (6, None, 1), (7, None, 2), (8, "a", None)]
    df = spark.createDataFrame([(i, k, None if m is None else T0 + timedelta(minutes=m)) for i, k, m in rows], "id long, key string, at timestamp")
    assert sorted(r.id for r in flows.first_within(df, ["key"], 5).select(F.col("id")).collect()) == [1, 3, 5, 6, 8]
