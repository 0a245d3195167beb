"""Correlated roads, distributed ranks, clusters, own free speeds and the forecast, on planted
rows against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from lanepulse.operators import forecast, network, outlook
from lanepulse.operators.ranking import value_ranks, with_percent_rank

DAY = dt.date(2024, 1, 1)


def hourly(spark, series, first=0):
    """series: {road: [speed or None per hour]}"""
    rows = [(r, "D", h, 1 + h % 3, DAY + dt.timedelta(days=t // 24), dt.datetime(2024, 1, 1) + dt.timedelta(hours=t), s, 10, 5)
            for r, speeds in series.items() for t, s in enumerate(speeds) if s is not None for h in [t + first]]
    return spark.createDataFrame(
        rows, "Road_EN string, District string, n int, detector_id int, date date, period_from timestamp_ntz, "
        "speed double, occupancy int, volume int").repartition(4)


def exact(series, lag=0, fewest=24):
    """{(a, b): (correlation, hours)} over hours both have, b `lag` hours on."""
    found = {}
    names = list(series)
    for a in names:
        for b in names:
            pairs = [(x, y) for x, y in zip(series[a], series[b][lag:]) if x is not None and y is not None]
            if a != b and len(pairs) >= fewest:
                x, y = np.array(pairs).T
                if x.std() and y.std():
                    found[a, b] = (float(np.corrcoef(x, y)[0, 1]), len(pairs))
    return found


def clustered(roads, groups, hours, seed, gaps=0.0):
    """Roads that share a daily pattern, and within a group also a pattern of their own."""
    rng = np.random.default_rng(seed)
    daily = 10 * np.sin(np.arange(hours) * math.pi / 12)
    own = rng.normal(size=(groups, hours)) * 6
    series = {}
    for r in range(roads):
        speeds = 60 + daily + own[r % groups] + rng.normal(size=hours) * 4
        series[f"R{r:03}"] = [None if rng.random() < gaps else float(s) for s in speeds]
    return series


def test_small_tables_are_searched_whole(spark):
    series = clustered(20, 4, 200, 1, gaps=0.1)
    series["flat"] = [50.0] * 200
    series["short"] = [float(i) for i in range(10)] + [None] * 190
    want = exact(series)
    got = network.road_speed_correlation(hourly(spark, series), partners=5).collect()
    assert {r.Road_EN for r in got} == {f"R{r:03}" for r in range(20)}
    for a in {r.Road_EN for r in got}:
        best = sorted(((-c, b, n) for (x, b), (c, n) in want.items() if x == a))[:5]
        mine = sorted((r.place, r.partner_Road_EN, r.hours) for r in got if r.Road_EN == a)
        assert [m[1:] for m in mine] == [b[1:] for b in best]
    assert all(abs(r.correlation - want[r.Road_EN, r.partner_Road_EN][0]) < 1e-9 for r in got)


def test_recall_on_a_larger_table(spark):
    series = clustered(300, 25, 300, 2)
    want = exact(series)
    got = network.road_speed_correlation(hourly(spark, series), partners=10, lists=8, reach=16).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.Road_EN, set()).add(r.partner_Road_EN)
    assert max(map(len, mine.values())) <= 10
    hits = sum(len(mine[a] & set(sorted((b for x, b in want if x == a), key=lambda b: -want[a, b][0])[:10])) for a in series)
    assert hits >= 0.9 * 10 * len(series)


def test_planted_lags_are_found(spark):
    rng = np.random.default_rng(3)
    base = {g: 60 + np.cumsum(rng.normal(size=260)) * 0.3 + rng.normal(size=260) * 5 for g in range(6)}
    series = {f"G{g}L{lag}": [float(v + rng.normal() * 0.5) for v in speeds[8 - lag:248 - lag]]
              for g, speeds in base.items() for lag in range(4)}
    got = network.shifted_correlation(hourly(spark, series), longest_lag=3, partners=3).collect()
    lags = {(r.Road_EN, r.follower_Road_EN): r.lag_hours for r in got}
    for g in range(6):
        for lag in (1, 2, 3):
            assert lags[f"G{g}L0", f"G{g}L{lag}"] == lag
    at = {lag: exact(series, lag) for lag in range(4)}
    for r in got:
        pair = r.Road_EN, r.follower_Road_EN
        best = max(range(4), key=lambda lag: (at[lag][pair][0], -lag))
        assert r.lag_hours == best and abs(r.correlation - at[best][pair][0]) < 1e-9


def test_no_roads_and_bad_parameters(spark):
    none = hourly(spark, {"A": [1.0, 2.0]}).limit(0)
    assert network.road_speed_correlation(none).collect() == []
    assert network.shifted_correlation(none).collect() == []
    unnamed = hourly(spark, {None: [float(i % 7) for i in range(60)], "A": [float(i % 5) for i in range(60)]})
    assert network.road_speed_correlation(unnamed).collect() == []
    with pytest.raises(ValueError):
        network.road_speed_correlation(none, lists=300)


def test_ranks_without_one_sorted_task(spark):
    rng = random.Random(4)
    values = [float(rng.randrange(40)) for _ in range(500)] + [7.0] * 300 + [rng.random() * 1e6 for _ in range(2000)] + [None] * 9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(5)
    known = sorted(v for v in values if v is not None)
    got = {r.v: (r.below, r.total) for r in value_ranks(df, "v").collect()}
    assert got == {v: (known.index(v), len(known)) for v in set(known)}
    shares = {r.id: r.share for r in with_percent_rank(df, "v", "share").collect()}
    assert all(shares[i] == (None if v is None else known.index(v) / (len(known) - 1)) for i, v in enumerate(values))
    assert [r.share for r in with_percent_rank(df.where("id = 3"), "v", "share").collect()] == [0.0]
    assert value_ranks(df.limit(0), "v").collect() == []
    plan = value_ranks(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line.split("windowspecdefinition(")[1].split(",")[0] for line in windows)


def test_clusters_name_the_nearest_centre(spark):
    series = {f"R{r}": [20.0 + 20 * (r % 3) + (r // 3) * 0.1 + (t % 24) * 0.2 for t in range(72)] for r in range(18)}
    obs = hourly(spark, series)
    got = outlook.road_clusters(obs, k=3).collect()
    assert {r.Road_EN: r.cluster for r in got} == {f"R{r}": r % 3 + 1 for r in range(18)}
    profiles = {r.Road_EN: np.array([r[f"h{h}"] for h in range(24)]) for r in outlook.road_profiles(obs).collect()}
    centres = {c: np.mean([profiles[r.Road_EN] for r in got if r.cluster == c], axis=0) for c in (1, 2, 3)}
    for r in got:
        gaps = {c: float(np.linalg.norm(profiles[r.Road_EN] - centre)) for c, centre in centres.items()}
        assert min(gaps, key=gaps.get) == r.cluster and abs(gaps[r.cluster] - r.distance) < 1e-6
        assert abs(centres[r.cluster].mean() - r.centre_speed) < 1e-6
    assert outlook.road_clusters(obs.limit(0)).collect() == []


def test_delay_against_each_roads_own_speed(spark):
    series = {"fast": [100.0] * 17 + [50.0] * 3, "slow": [30.0] * 20}
    got = {r.Road_EN: r for r in outlook.delay_against_own_speed(hourly(spark, series)).collect()}
    assert got["fast"].free_speed == 100 and got["slow"].free_speed == 30
    assert abs(got["fast"].delay_hours - 3 * 0.5 * 5 * 30 / 3600) < 1e-9 and got["slow"].delay_hours == 0


def test_forecast_beats_the_majority(spark):
    rng = random.Random(6)
    slow = lambda t: (t % 24 in (8, 9, 18) and t // 24 % 7 < 5) != (rng.random() < 0.03)
    series = {f"R{r}": [(25.0 if slow(t) else 70.0) + rng.random() for t in range(24 * 42)] for r in range(3)}
    rows = hourly(spark, series).selectExpr("* EXCEPT (detector_id)", "cast(substr(Road_EN, 2) AS int) AS detector_id")
    predicted = forecast.next_hour_forecast(rows)
    table = {(r.next_congested, r.predicted): r.hours for r in forecast.forecast_quality(predicted).collect()}
    total = sum(table.values())
    right = sum(n for (actual, guess), n in table.items() if actual == guess)
    majority = max(sum(n for (actual, _), n in table.items() if actual == side) for side in (True, False))
    assert right > majority and right / total > 0.94
    first = predicted.selectExpr("min(date)").first()[0]
    assert first >= DAY + dt.timedelta(days=33)  # the last fifth of 42 days
    assert predicted.where("next_congested IS NULL").count() == 3  # each detector's last hour
    with pytest.raises(ValueError):
        forecast.next_hour_forecast(rows.limit(0))
