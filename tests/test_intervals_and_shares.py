"""Interval join and exceptional shares."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import exceptional_shares, in_intervals
from tallyframe.operators import intervals as module
from tallyframe.operators.lift import upper_tail
from tests.conftest import SF01
from tools.plan_checks import has_python, plan_text


def held(values, bounds):
    return Counter((v, label) for v in values for low, high, label in bounds
                   if v is not None and low is not None and high is not None and low <= v < high)


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_equal_to_comparing_every_value_with_every_interval(spark, monkeypatch, bound):
    monkeypatch.setattr(module, "BROADCAST_CELLS", bound)
    rng = random.Random(8)
    values = [rng.choice([rng.randint(-400, 400), rng.randint(-(10**15), 10**15)]) for _ in range(300)] + [0, 0, -1, None]
    bounds = [(low := rng.choice([rng.randint(-300, 300), rng.randint(-(10**15), 10**15)]), low + rng.choice([-1, 0, 1, 2, 15, 16, 17, 255, 10**6, 10**15]), i)
              for i in range(300)]
    bounds += [bounds[0], (None, 5, 900), (5, None, 901), (-(10**17), 10**17, 902)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    table = spark.createDataFrame(bounds, "low long, high long, label int")
    found = in_intervals(df, "v", table, "low", "high", "label")
    assert Counter((r.v, r.label) for r in found.collect()) == held(values, bounds)
    text = plan_text(found, "simple")
    assert "NestedLoop" not in text and "Cartesian" not in text and not has_python(found)


def test_cells_are_few_and_do_not_overlap(spark):
    rng = random.Random(9)
    bounds = [(low := rng.randint(-5000, 5000), low + rng.randint(1, 9000)) for _ in range(40)]
    rows = spark.createDataFrame(bounds, "a long, b long").select("a", "b", module.cells_of(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        units = [u for c in r.c for u in range(c.cell * 16**c.size, (c.cell + 1) * 16**c.size)]
        assert sorted(units) == list(range(r.a, r.b)) and max(Counter(c.size for c in r.c).values()) <= 30


def test_timestamps_dates_and_ten_thousand_intervals(spark):
    events = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts")
    kind = events.schema["ts"].dataType.simpleString()
    starts = spark.range(10_000).select(
        F.expr(f"CAST(TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 4, 0) AS {kind})").alias("a"),
        F.expr(f"CAST(TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 4 + 6, 0) AS {kind})").alias("b"), "id")
    found = in_intervals(events, "ts", starts, "a", "b", "id")
    text = plan_text(found, "simple")
    assert "NestedLoop" not in text and "BroadcastHashJoin" in text
    minutes = [(r.ts - datetime.datetime(2024, 1, 1)).total_seconds() / 60 for r in events.collect()]
    want = sum(1 for m in minutes for i in range(max(0, math.floor((m - 6) / 4)), min(9999, math.floor(m / 4)) + 1) if 4 * i <= m < 4 * i + 6)
    assert found.count() == want
    days = spark.createDataFrame([(datetime.date(2024, 1, 31),), (datetime.date(2024, 2, 1),)], "d date")
    month = spark.createDataFrame([(datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), "Jan")], "a date, b date, name string")
    assert [tuple(r) for r in in_intervals(days, "d", month, "a", "b", "name").collect()] == [(datetime.date(2024, 1, 31), "Jan")]


def test_what_cannot_be_joined_is_refused(spark):
    df, table = spark.range(3), spark.createDataFrame([(1, 2, "x")], "a long, b long, id string")
    with pytest.raises(ValueError, match="id"):
        in_intervals(df, "id", table, "a", "b", "id")
    with pytest.raises(TypeError):
        in_intervals(spark.createDataFrame([(1.5,)], "v double"), "v", table, "a", "b")
    assert in_intervals(df, "id", table.limit(0), "a", "b").count() == 0


def test_tail_of_the_normal_distribution(spark):
    z = [-6.0, -1.5, 0.0, 0.3, 1.96, 4.0, 8.0, 20.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", upper_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=2e-7) for r in rows)


def by_hand(counts, false_share):
    total = sum(counts.values())
    groups, items = Counter(), Counter()
    for (g, i), n in counts.items():
        groups[g] += n
        items[i] += n
    p = {}
    for (g, i), n in counts.items():
        r, c = groups[g], items[i]
        v = r * c * (total - r) * (total - c) / (total * total * (total - 1))
        p[g, i] = 0.5 * math.erfc((n - r * c / total) / math.sqrt(2 * v)) if v > 0 else 0.5
    ranked = sorted(p.values())
    cut = max((x for k, x in enumerate(ranked, 1) if x <= false_share * k / len(ranked)), default=-1)
    return {key: value <= cut for key, value in p.items()}


def test_cut_equals_the_cut_by_rank(spark):
    rng = random.Random(3)
    counts = {(g if g else None, i): rng.randint(1, 60) for g in range(25) for i in range(12) if rng.random() < 0.8}
    counts[1, 1], counts[2, 5], counts[None, 7] = 200, 140, 150
    df = spark.createDataFrame([(*key, n) for key, n in counts.items()], "g int, i int, n long")
    for false_share in (0.01, 0.2):
        got = {(r.g, r.i): r.exceptional for r in exceptional_shares(df, "g", "i", "n", false_share).collect()}
        assert got == by_hand(counts, false_share) and any(got.values()) and not all(got.values())
    assert exceptional_shares(df.limit(0), "g", "i", "n").count() == 0


def test_a_small_group_is_not_exceptional_by_lift_alone(spark):
    rows = [(g, i, 500) for g in range(20) for i in range(10)] + [(99, 0, 1)]
    df = spark.createDataFrame(rows, "g int, i int, n long")
    assert not any(r.exceptional for r in exceptional_shares(df, "g", "i", "n").collect())


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_numbers_of_alike_rows_add_up(spark, monkeypatch, bound):
    monkeypatch.setattr(module, "BROADCAST_CELLS", bound)
    rng = random.Random(10)
    values = [rng.randint(-400, 400) for _ in range(100)] + [0, 0, None]
    bounds = [(low := rng.randint(-300, 300), low + rng.choice([-1, 0, 1, 16, 17, 300]), rng.choice("ab")) for _ in range(400)] + [(None, 5, "a")]
    table = spark.createDataFrame(bounds, "low long, high long, label string")
    found = in_intervals(spark.createDataFrame([(v,) for v in values], "v long"), "v", table, "low", "high", "label", times="n").collect()
    got = Counter()
    for r in found:
        got[r.v, r.label] += r.n
    assert got == held(values, bounds)
    assert len(found) <= 3 * 2 * len(values)  # sizes, labels


@pytest.mark.parametrize("step", [datetime.timedelta(microseconds=1), datetime.timedelta(milliseconds=250), datetime.timedelta(minutes=1), datetime.timedelta(days=1)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_borders_in_whole_spans_and_values_in_between(spark, step, kind):
    rng = random.Random(11)
    zero = datetime.datetime(1970, 1, 1)  # values on both sides of it
    bounds = [(zero + (low := rng.randint(-40, 40)) * step, zero + (low + rng.randint(0, 30)) * step, i) for i in range(60)]
    micro = datetime.timedelta(microseconds=1)
    values = [at + d for low, high, _ in bounds for at in (low, high) for d in (-micro, 0 * micro, micro)]
    df, table = spark.createDataFrame([(v,) for v in values], "v timestamp_ntz"), spark.createDataFrame(bounds, "low timestamp_ntz, high timestamp_ntz, label int")
    df, table = df.select(F.col("v").cast(kind)), table.select(*[F.col(c).cast(kind) for c in ("low", "high")], "label")
    found = in_intervals(df, "v", table, "low", "high", "label").select(F.col("v").cast("timestamp_ntz"), "label")
    assert Counter((r.v, r.label) for r in found.collect()) == held(values, bounds)


def test_joined_rows_do_not_grow_with_the_orders(spark, monkeypatch, tmp_path):
    from tallyframe.plans import registry

    joined = []

    def spied(*args, **options):
        joined.append(in_intervals(*args, **options))
        return joined[-1]

    monkeypatch.setattr(registry, "in_intervals", spied)
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    copies = spark.range(8).withColumnRenamed("id", "copy")
    more = orders.crossJoin(copies).withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * 1_000_000).drop("copy")
    more.write.parquet(f"{tmp_path}/orders.parquet")
    events = spark.read.parquet(f"{SF01}/events.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["f9_order_intervals"](spark, str(tmp_path)).collect()
    sizes, priorities = 2, len(found)
    assert joined[0].count() <= events.count() * sizes * priorities < sum(r.n for r in found)
