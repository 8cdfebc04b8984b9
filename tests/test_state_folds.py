"""Reservations, budgets, limiters and waits against plain folds, as tables and as streams."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from callweave.operators import states
from callweave.streaming import flows

START = datetime(2024, 1, 1)


def requests(seed, n=120):
    """(key, id, kind, at): reservations, of which most are committed or released later; ties in time."""
    dice, out = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(minutes=dice.randrange(300))
        out.append((dice.choice("ab"), i, "reserve", at))
        if dice.random() < 0.8:
            out.append((out[-1][0], i, dice.choice(("commit", "release")), at + timedelta(minutes=dice.choice((0, 1, 30)))))
    return out


def plain_guard(rows, minutes):
    held, out = {}, []
    for key, i, kind, at in sorted(rows, key=lambda r: (r[3], r[1], ("reserve", "commit", "release").index(r[2]))):
        who, committed, until = held.get(key, (None, False, None))
        acquired = kind == "reserve" and (who is None or until <= at)
        if acquired:
            held[key] = (i, False, at + timedelta(minutes=minutes))
        elif kind == "commit" and who == i:
            held[key] = (i, True, at + timedelta(minutes=minutes))
        elif kind == "release" and who == i and not committed:
            del held[key]
        out.append((key, i, kind, acquired))
    return sorted(out)


def test_a_released_key_may_come_again(spark):
    rows = requests(1)
    df = spark.createDataFrame(rows, "key string, id long, kind string, at timestamp_ntz").repartition(3)
    got = sorted(tuple(r) for r in states.replay_guard(df, ["key"], 40).collect())
    assert got == plain_guard(rows, 40) and 0 < sum(r[3] for r in got) < 120
    again = [("k", 1, "reserve", START), ("k", 1, "release", START + timedelta(minutes=1)), ("k", 2, "reserve", START + timedelta(minutes=2)), ("k", 2, "commit", START + timedelta(minutes=3)), ("k", 2, "release", START + timedelta(minutes=4)), ("k", 3, "reserve", START + timedelta(minutes=5)), ("k", 4, "reserve", START + timedelta(minutes=43))]
    found = states.replay_guard(spark.createDataFrame(again, "key string, id long, kind string, at timestamp_ntz"), ["key"], 40).collect()
    assert {r.id: r.acquired for r in found if r.kind == "reserve"} == {1: True, 2: True, 3: False, 4: True}


def streamed(spark, folder, rows, schema, parts, per_batch):
    """The rows as files, read as a stream in the order of their names."""
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(folder))


def test_reservations_of_a_live_stream(spark, tmp_path):
    rows = sorted(requests(2, 60), key=lambda r: (r[3], r[1]))
    stream = streamed(spark, tmp_path / "in", rows, "key string, id long, kind string, at timestamp", 3, 1)
    got = flows.drain(flows.replay_guard(stream, ["key"], 40, "400 minutes"), "replay", timers=True)
    assert sorted(tuple(r) for r in got.collect()) == plain_guard(rows, 40)


@pytest.mark.parametrize("per_batch, late", [(1_000_000, "0 seconds"), (2, "30 days")])
def test_waits_do_not_depend_on_the_order_of_files(spark, tmp_path, per_batch, late):
    dice = random.Random(3)
    rows = [(dice.randrange(40), START + timedelta(minutes=dice.randrange(2000)), dice.random() < 0.15) for _ in range(300)] + [(99, START + timedelta(days=40), False), (98, START + timedelta(days=90), False)]
    dice.shuffle(rows)
    stream = streamed(spark, tmp_path / "in", rows, "call_id long, at timestamp, ready boolean", 8, per_batch)
    got = {r.call_id: (r.state, r.at_us) for r in flows.drain(flows.settled_waits(stream, 500, late), "waits", timers=True).collect()}
    want, last = {}, max(at for _, at, _ in rows) - timedelta(days=0 if late[0] == "0" else 30)
    us = lambda at: int((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    for call in {c for c, *_ in rows}:
        waited = min((at for c, at, ready in rows if c == call and not ready), default=None)
        found = min((at for c, at, ready in rows if c == call and ready), default=None)
        due = None if waited is None else waited + timedelta(minutes=500)
        state, at = ("ready", found) if found is not None and (due is None or found < due) else ("held", due)
        if at <= last:
            want[call] = (state, us(at))
    assert got == want and 98 not in got and {s for s, _ in got.values()} == {"ready", "held"}


def test_polls_are_retried_in_slots_until_the_wait_ends(spark):
    dice = random.Random(4)
    rows = [(dice.randrange(12), i, START + timedelta(minutes=dice.randrange(900)), dice.random() < 0.1) for i in range(200)]
    want = []
    for call in range(12):
        waited = None
        for _, i, at, ready in sorted((r for r in rows if r[0] == call), key=lambda r: (r[2], r[1])):
            waited = at if waited is None and not ready else waited
            minutes = None if waited is None else (at - waited).total_seconds() / 60
            if ready or minutes >= 300:
                want.append((call, i, waited, "continue" if ready else "hold", None))
                break
            want.append((call, i, waited, "defer", int(minutes // 45)))
    df = spark.createDataFrame(rows, "call_id long, id long, at timestamp_ntz, ready boolean").repartition(3)
    assert sorted(map(tuple, states.transcript_polls(df, 300, 45).collect()), key=str) == sorted(want, key=str)
    assert {w[3] for w in want} == {"continue", "hold", "defer"}


def test_budget_with_settled_and_released_reservations(spark):
    dice, rows = random.Random(5), []
    for i in range(200):
        day, at = f"2024-01-0{dice.randrange(1, 4)}", START + timedelta(minutes=dice.randrange(500))
        rows.append((day, i, "reserve", Decimal(dice.randrange(1, 900)) / 100, at))
        for kind in dice.sample(("settle", "release"), dice.choice((0, 1, 1, 2))):
            rows.append((day, i, kind, Decimal(dice.randrange(1, 900)) / 100, at + timedelta(minutes=dice.choice((0, 5, 60)))))
    want, spent, open_ = [], {}, {}
    for day, i, kind, amount, _ in sorted(rows, key=lambda r: (r[4], r[1], ("reserve", "settle", "release").index(r[2]))):
        now, held = spent.get(day, Decimal(0)), open_.get((day, i))
        if kind == "reserve":
            result = "reserved" if now + amount <= 50 else "refused"
            if result == "reserved":
                open_[day, i], now = amount, now + amount
        elif held is None:
            result = "ignored"
        else:
            del open_[day, i]
            result, now = ("settled", now + amount - held) if kind == "settle" else ("released", now - held)
        spent[day] = now
        want.append((day, i, kind, result, now, result == "reserved" and now >= 40))
    df = spark.createDataFrame(rows, "day string, id long, kind string, amount decimal(12,6), at timestamp_ntz").repartition(3)
    assert sorted(tuple(r) for r in states.budget_ledger(df, 50.0).collect()) == sorted(want)
    assert {w[3] for w in want} == {"reserved", "refused", "ignored", "settled", "released"}


def test_two_windows_at_once(spark):
    dice = random.Random(6)
    rows = [(dice.choice("ab"), i, START + timedelta(milliseconds=dice.randrange(240_000))) for i in range(400)]
    want, short, long = [], {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        ms = int((at - START).total_seconds() * 1000 + 0.5)
        a, b = (key, ms // 1000), (key, ms // 60_000)
        waits = [(a[1] + 1) * 1000 - ms] * (short.get(a, 0) >= 2) + [(b[1] + 1) * 60_000 - ms] * (long.get(b, 0) >= 20)
        if not waits:
            short[a], long[b] = short.get(a, 0) + 1, long.get(b, 0) + 1
        want.append((key, i, not waits, max(waits, default=0)))
    df = spark.createDataFrame(rows, "key string, id long, at timestamp_ntz").repartition(3)
    assert sorted(tuple(r) for r in states.dual_window(df, "key", 1, 2, 60, 20).collect()) == sorted(want)
    assert max(long.values()) == 20 and not all(w[2] for w in want)
    with pytest.raises(ValueError):
        states.dual_window(df, "key", 7, 1, 60, 1)
