from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.accounting import classified
from ledgerloom.operators import scan, snapshots

DAY = date(2026, 3, 1)


def days(n, **change):
    """Frames of n days: (day, complete, emitted_at); ``change``: by number of the day."""
    rows = []
    for i in range(n):
        d = DAY + timedelta(days=i)
        rows.append(change.get(f"d{i}", (d, True, datetime(d.year, d.month, d.day, 23))))
    return [r for r in rows if r]


def states(spark, rows, now, **kw):
    df = spark.createDataFrame(rows, "day date, complete boolean, emitted_at timestamp_ntz")
    got = scan.history(df, F.lit(now).cast("timestamp_ntz"), **kw).collect()
    return [r.state for r in sorted(got, key=lambda r: r.day)]


def test_history(spark):
    now = datetime(2026, 3, 10, 12)
    assert states(spark, days(8), now) == ["too_few"] * 6 + ["ready"] * 2
    assert states(spark, days(8), now + timedelta(days=9)) == ["too_few"] * 6 + ["stale"] * 2
    hole = days(9, d3=None)
    assert states(spark, hole, now) == ["too_few"] * 6 + ["gap"] * 2
    assert states(spark, days(8, d2=(DAY + timedelta(days=2), False, None)), now)[6:] == ["incomplete_baseline"] * 2
    assert states(spark, days(8, d7=(DAY + timedelta(days=7), False, None)), now)[6:] == ["ready", "incomplete"]
    assert states(spark, days(8, d7=(DAY + timedelta(days=7), True, datetime(2026, 4, 1))), now)[6:] == ["ready", "emitted_in_future"]
    assert states(spark, [], now) == []


def test_error_surges(spark):
    d = lambda i: DAY + timedelta(days=i)
    windows = spark.createDataFrame([(d(i),) for i in range(9)], "day date")
    rows = [(d(i), "a", 5) for i in range(6)] + [(d(6), "a", 16), (d(6), "new", 11), (d(6), "few", 10), (d(7), "a", 16), (d(3), "new", 40)]
    counts = spark.createDataFrame(rows, "day date, member string, errors bigint")
    got = sorted((r.day, r.member, r.threshold) for r in scan.error_surges(counts, windows).collect())
    assert got == [(d(6), "a", 15.0)]  # 'new' had more before, 'few' stays below the least change, the next day's 16 is no more than before
    assert scan.error_surges(counts, windows.filter(F.col("day") != d(2))).filter(F.col("day") == d(6)).count() == 0


def test_finding_ids(spark):
    d = lambda i: DAY + timedelta(days=i)
    df = spark.createDataFrame([(d(0), "a"), (d(1), "a"), (d(1), "b"), (d(1), "c"), (d(3), "a")], "day date, member string")
    once = scan.identified(df, ["member"], "x")
    assert once.count() == 5 and once.select("id").distinct().count() == 5 and {len(r.id) for r in once.collect()} == {32}
    assert sorted(r.id for r in scan.identified(df.repartition(4), ["member"], "x").collect()) == sorted(r.id for r in once.collect())
    assert not {r.id for r in scan.identified(df, ["member"], "y").collect()} & {r.id for r in once.collect()}
    assert [(r.day, r.member, r.held) for r in scan.identified(df, ["member"], "x", persist=2).collect()] == [(d(1), "a", 2)]
    assert sorted((r.day, r.member, r.omitted) for r in scan.identified(df, ["member"], "x", top=2).collect()) == [(d(0), "a", 0), (d(1), "a", 1), (d(1), "b", 1), (d(3), "a", 0)]


def source(producer, window, requests=5, **change):
    c = {"requests": requests, "missing_token_usage": 0, "input_tokens": 10, "output_tokens": 5, "dedup_key_missing": 0}
    c |= {f"token_observations.{f}.{s}": requests if s == "reported" else 0 for f in ("input", "output") for s in scan.OBSERVATION_STATES}
    c |= {k.replace("__", "."): v for k, v in change.items()}
    return producer, 0, window, 0, {k: v for k, v in c.items() if v is not None}


def test_token_eligibility(spark):
    other = {"token_observations__input__reported": 4, "token_observations__input__missing": 1}
    rows = [
        source("a", 1), source("b", 1), source("a", 2), source("a", 3, missing_token_usage=1), source("b", 3), source("a", 4, **other), source("b", 4, token_observations__input__reported=6),
        source("a", 5, input_tokens=2**53), source("b", 5), source("a", 6, output_tokens=None), source("b", 6), source("a", 7, dedup_key_missing=1), source("b", 7), source("a", 8, requests=0), source("b", 8, requests=0),
    ]
    df = spark.createDataFrame(rows, "producer string, epoch int, window_start int, sequence int, counters map<string,bigint>")
    got = {r.window_start: (r.total if r.total is None else int(r.total), r.reason) for r in scan.token_eligibility(df, ["a", "b"]).collect()}
    assert got == {
        1: (30, None), 2: (15, "missing_producers"), 3: (30, "incomplete_usage"), 4: (30, "source_not_clean"), 5: (2**53 + 20, "beyond_exact_range"),
        6: (None, "incomplete_usage"), 7: (30, "source_not_clean"), 8: (30, "tokens_without_requests"),
    }


def test_frequent_items(spark):
    kind = "window_start int, total bigint, max_error bigint, items array<struct<item:string,lower:bigint,upper:bigint>>"
    rows = [(1, 10, 2, [("a", 5, 6), ("b", 2, 3)]), (1, 20, 3, [("a", 9, 9)]), (2, 4, 0, [("c", 4, 4)])]
    got = {(r.window_start, r.item): (r.lower, r.upper, r.total) for r in snapshots.merged_items(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, "a"): (14, 15, 30), (1, "b"): (2, 6, 30), (2, "c"): (4, 4, 4)}
    bad = [(1, 10, 0, [("a", 9, 9)]), (2, 10, 1, [("a", 6, 7), ("b", 5, 6)]), (3, 10, 1, [("a", 5, 11)]), (4, 10, 1, [("a", 5, 4)]), *rows, (5, 0, 0, [])]
    assert sorted((r.window_start, r.reason) for r in snapshots.inconsistent_items(spark.createDataFrame(bad, kind)).collect()) == [(1, "exact_sum"), (2, "lower_sum"), (3, "bound"), (4, "bound")]


def test_provenance_and_windows(spark):
    df = spark.createDataFrame([(1, {"requests": 3}), (2, {"requests": 4, "usage_provenance.v1.input.inferred": 1})], "window_start int, counters map<string,bigint>")
    got = {r.window_start: r.counters for r in snapshots.with_provenance(df).collect()}
    assert got[1]["usage_provenance.v1.input.unknown"] == 3 and got[1]["usage_provenance.v1.output.inferred"] == 0 and len(got[1]) == 9
    assert got[2] == {"requests": 4, "usage_provenance.v1.input.inferred": 1}
    assert snapshots.one_window(df, 2).count() == 1 and snapshots.one_window(df.filter("window_start = 1")).count() == 1
    with pytest.raises(ValueError):
        snapshots.one_window(df)


def test_histogram(spark):
    from test_usage import frame

    sizes = [0, 1, 2, 3, 4, 2**53, 2**62 - 1, 2**62]
    rows = classified(frame(spark, *({"prompt_tokens": str(n), "total_tokens": str(n + 5)} for n in sizes), {"prompt_tokens": ""}))
    got = {r.bin: (r.requests, r.input_min, r.input_max) for r in snapshots.usage_histogram(rows).collect()}
    assert got == {-1: (1, None, None), 0: (1, 0, 0), 1: (1, 1, 1), 2: (2, 2, 3), 3: (1, 4, 4), 54: (1, 2**53, 2**53), 62: (1, 2**62 - 1, 2**62 - 1), 63: (1, 2**62, 2**62)}
