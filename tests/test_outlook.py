import datetime as dt
import random

import pytest
from lanepulse.operators import outlook
from lanepulse.streaming import live

START = dt.datetime(2024, 1, 10)


def readings(spark, rows):
    """rows: (detector, lane, time, congested)"""
    return spark.createDataFrame(
        [(d, lane, t, t + dt.timedelta(seconds=30), t.date(), 50 if on else 5, 20.0 if on else 80.0) for d, lane, t, on in rows],
        "detector_id int, lane_id string, period_from timestamp_ntz, period_to timestamp_ntz, date date, occupancy int, speed double")


def plain_episodes(rows, gap=3600):
    found, lanes = [], {}
    for d, lane, t, on in rows:
        lanes.setdefault((d, lane), []).append((t, on))
    for key, times in lanes.items():
        before = None
        for t, on in sorted(times):
            if on and before and before[1] and (t - before[0]).total_seconds() <= gap:
                found[-1][2] = t + dt.timedelta(seconds=30)
                found[-1][3] += 1
            elif on:
                found.append([key, t, t + dt.timedelta(seconds=30), 1])
            before = (t, on)
    return sorted((*k, a, b, n) for k, a, b, n in found)


def episodes(df, **options):
    return sorted((r.detector_id, r.lane_id, r.start, r.stop, r.readings)
                  for r in outlook.congestion_episodes(df, **options).collect())


def test_an_episode_over_midnight_is_one(spark):
    rows = [(1, "a", START.replace(hour=23, minute=57) + dt.timedelta(minutes=i), 1 <= i <= 5) for i in range(8)]
    got = outlook.congestion_episodes(readings(spark, rows)).collect()
    assert [(r.readings, str(r.date), r.episode) for r in got] == [(5, "2024-01-10", 1)]
    assert (got[0].start, got[0].stop) == (dt.datetime(2024, 1, 10, 23, 58), dt.datetime(2024, 1, 11, 0, 2, 30))


def test_episodes_over_days_against_plain_python(spark):
    rng, rows = random.Random(2), []
    for d in range(12):
        t, on = START + dt.timedelta(minutes=rng.randrange(600)), False
        while t < START + dt.timedelta(days=7):
            on = on if rng.random() < (0.995 if d % 3 else 0.7) else not on
            rows.append((d, "ab"[d % 2], t, on))
            t += dt.timedelta(minutes=rng.choice([10, 30, 50, 60, 61, 90 if d % 4 == 0 else 20]))
    rows += [(50, "a", START + dt.timedelta(minutes=30 * i), True) for i in range(48 * 4)]  # four whole days
    rows += [(51, "a", START + dt.timedelta(days=i), True) for i in range(4)]  # far apart
    rng.shuffle(rows)
    assert episodes(readings(spark, rows)) == plain_episodes(rows)
    assert episodes(readings(spark, rows), longest_gap=86400) == plain_episodes(rows, 86400)
    assert episodes(readings(spark, rows[:1]).limit(0)) == []
    with pytest.raises(ValueError):
        outlook.congestion_episodes(readings(spark, rows), longest_gap=86401)


def test_gaps_between_the_nearest_seconds(spark):
    """As in SQL: 3,600.6 s apart is one episode or two by where the seconds fall."""
    def pair(d, start, gap):
        t = START + dt.timedelta(seconds=start)
        return [(d, "a", t, True), (d, "a", t + dt.timedelta(seconds=gap), True)]

    midnight = 24 * 3600
    rows = [*pair(1, 100.8, 3600.6), *pair(2, 100.2, 3600.6), *pair(3, 100.9, 3600.5), *pair(4, 100.1, 3600.3),
            *pair(5, 100.5, 3600), *pair(6, 101.5, 3601), *pair(7, midnight - 0.3, 3600.2), *pair(8, midnight - 3000.4, 3600.95)]
    count = {}
    for d, *_ in episodes(readings(spark, rows)):
        count[d] = count.get(d, 0) + 1
    assert count == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2}
    far = [*pair(1, midnight - 0.3, 24 * 3600 + 0.5), *pair(2, 0.3, 24 * 3600 - 0.1)]
    found = outlook.congestion_episodes(readings(spark, far), longest_gap=24 * 3600).collect()
    assert sorted((r.detector_id, str(r.date), r.episode, r.readings) for r in found) == [
        (1, "2024-01-10", 1, 2), (2, "2024-01-10", 1, 2)]


WINDOW, LATE = dt.timedelta(minutes=5), dt.timedelta(minutes=10)


def plain_live(drops):
    """Windows written, and groups dropped, when each drop is one run of the stream."""
    state, written, dropped, mark = {}, {}, 0, None
    for drop in drops:
        late = set()
        for d, _, t, on in drop:
            w = START + (t - START) // WINDOW * WINDOW
            if mark is not None and w + WINDOW <= mark:
                late.add((w, d))
            else:
                state.setdefault((w, d), []).append(80.0 - 60.0 * on)
        dropped += len(late)
        seen = max([t for _, _, t, _ in drop], default=START) - LATE
        mark = seen if mark is None else max(mark, seen)
        for key in [k for k in state if k[0] + WINDOW <= mark]:
            assert key not in written
            written[key] = (len(state[key]), sum(state.pop(key)))
    return written, dropped, len(state)


def test_live_windows_in_append_mode(spark, tmp_path):
    rng = random.Random(5)
    minute = lambda a, b: START + dt.timedelta(seconds=rng.randrange(a * 60, b * 60))
    drops = [
        [(rng.randrange(4), "a", minute(0, 60), rng.random() < 0.5) for _ in range(300)],
        [(rng.randrange(4), "a", minute(45, 120), rng.random() < 0.5) for _ in range(300)]
        + [(7, "a", minute(0, 40), True) for _ in range(20)],
        [(rng.randrange(4), "a", minute(100, 180), rng.random() < 0.5) for _ in range(300)]
        + [(8, "a", minute(0, 90), False) for _ in range(20)],
    ]
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    done = []
    for drop in drops:
        df = readings(spark, drop)
        df.write.mode("append").parquet(source)
        done.append(live.drain(spark.readStream.schema(df.schema).parquet(source), table, checkpoint))
    written, dropped, left = plain_live(drops)
    got = spark.read.parquet(table).collect()
    assert len(got) == len(written)  # no window twice
    assert {(r.window_start.replace(tzinfo=None), r.detector_id): (r.record_count, round(r.avg_speed * r.record_count))
            for r in got} == {k: (n, round(s)) for k, (n, s) in written.items()}
    assert sum(d.rows for d in done) == sum(map(len, drops))
    assert dropped > 10 and sum(d.dropped for d in done) == dropped
    assert done[-1].open_groups == left  # what has been written is no longer kept
    again = live.drain(spark.readStream.schema(df.schema).parquet(source), table, checkpoint)
    assert again.rows == 0 and spark.read.parquet(table).count() == len(written)
