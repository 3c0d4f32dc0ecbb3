import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.accounting import classified, money, unsigned
from ledgerloom.operators import coverage, periods, routing, scan, sessions, snapshots, stats, usage
from ledgerloom.sources.adapters import usage_from_events

CELLS = {
    "row_number": "bigint", "request_id": "string", "call_type": "string", "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "status": "string", "level": "string",
    "api_key": "string", "user": "string", "team_id": "string", "end_user": "string", "session_id": "string", "model": "string", "model_id": "string", "route": "string",
    "prompt_tokens": "string", "completion_tokens": "string", "total_tokens": "string", "cache_read_input_tokens": "string", "cache_write_input_tokens": "string",
    "reasoning_output_tokens": "string", "spend": "string", "rejection_kind": "string", "extra": "string",
}
T = datetime(2026, 3, 1, 12)
GOOD = {"call_type": "acompletion", "start_time": T, "end_time": T, "status": "success", "prompt_tokens": "10", "completion_tokens": "5", "total_tokens": "15", "spend": "0.5", "model": "m", "api_key": "k"}


def frame(spark, *rows):
    data = [tuple(({"row_number": i} | GOOD | r).get(c) for c in CELLS) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {t}" for n, t in CELLS.items()))


def flags(spark, **change):
    r = classified(frame(spark, change)).first()
    return {f for f in ("missing", "invalid", "total_mismatch", "total_missing", "zero_only", "failed", "unknown_status", "error_level", "unclear", "spend_missing", "spend_invalid", "spend_zero") if r[f]}


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, set()),
        ({"prompt_tokens": ""}, {"missing", "total_mismatch", "unclear"}),
        ({"prompt_tokens": "+7"}, {"missing", "invalid", "total_mismatch", "unclear"}),
        ({"prompt_tokens": None, "total_tokens": None}, {"missing", "total_missing", "unclear"}),
        ({"prompt_tokens": "9223372036854775807"}, {"missing", "invalid", "total_mismatch", "unclear"}),
        ({"cache_read_input_tokens": "11"}, {"invalid", "unclear"}),
        ({"reasoning_output_tokens": "5"}, set()),
        ({"prompt_tokens": "0", "completion_tokens": "0", "total_tokens": "0"}, {"zero_only", "unclear"}),
        ({"status": "failure"}, {"failed", "unclear"}),
        ({"status": None}, {"unknown_status", "unclear"}),
        ({"status": None, "level": "DEBUG"}, {"unknown_status"}),
        ({"level": "ERROR"}, {"error_level", "unclear"}),
        ({"level": "WEIRD"}, {"unclear"}),
        ({"end_time": None}, {"unclear"}),
        ({"spend": ""}, {"spend_missing"}),
        ({"spend": "-1"}, {"spend_invalid"}),
        ({"spend": "0.00"}, {"spend_zero"}),
    ],
)
def test_flags(spark, change, expected):
    assert flags(spark, **change) == expected


def test_counts_and_money(spark):
    values = ["7", "007", " 7", "+7", "9223372036854775808", "", None, "7.0"]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(unsigned(F.col("v"))).collect()] == [7, 7] + [None] * 6
    values = ["1.5", "1e-3", "1e18", "2e18", "-1", "1.", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(money(F.col("v"))).collect()]
    assert got[:3] == [Decimal("1.5"), Decimal("0.001"), Decimal(10**18)] and got[3:] == [None] * 5


def test_periods(spark):
    rows = frame(spark, {"start_time": datetime(2026, 3, 1, 5)}, {"start_time": datetime(2026, 3, 18, 5)})
    before, after = periods.automatic(rows)
    assert before == (datetime(2026, 3, 4), datetime(2026, 3, 11)) and after == (datetime(2026, 3, 11), datetime(2026, 3, 18))
    assert periods.automatic(rows.limit(0)) is None and periods.automatic(rows.filter("row_number = 0")) is None
    assert periods.automatic(rows, now=datetime(2026, 3, 17, 9))[1] == (datetime(2026, 3, 10), datetime(2026, 3, 17))  # today is not over
    assert periods.parse("2026-03-01") == (datetime(2026, 3, 1), datetime(2026, 3, 2))
    assert periods.parse("2026-03-01T00:00:00+05:00/2026-03-02T00:00:00.5Z") == (datetime(2026, 2, 28, 19), datetime(2026, 3, 2, 0, 0, 0, 500000))
    for wrong in ("2026-03-01/2026-03-02", "2026-03-01T00:00:00/2026-03-02T00:00:00", "2026-02-30", "1969-01-01", "2026-03-01T00:00:00Z", "x"):
        with pytest.raises(ValueError):
            periods.parse(wrong)
    with pytest.raises(ValueError):
        periods.parse("2026-03-02T00:00:00Z/2026-03-01T00:00:00Z")
    with pytest.raises(ValueError):
        periods.validate(before, (after[0], after[1].replace(day=17)))
    sides = rows.select(periods.side(F.col("start_time"), before, (after[0], datetime(2026, 3, 18, 5)))).collect()
    assert [r[0] for r in sides] == [-1, -1]  # the end is outside


def test_sides_empty_and_ties(spark):
    rows = classified(frame(spark, {"api_key": "b"}, {"api_key": "a"}, {"api_key": " "}, {"api_key": None})).withColumn("side", F.lit(1))
    assert [r.member for r in usage.movers(rows, "key").collect()] == ["b", "a"]  # a tie goes to the first seen
    none = rows.limit(0)
    for result in (usage.windows(none), usage.by_model(none), usage.movers(none, "key"), usage.call_types(none), routing.cohorts(none.withColumns({"attempted_fallbacks": F.lit(""), "agent_id": F.lit("")})).filter("grain > 0"), usage.contributor_excess(none, "key")):
        assert result.count() == 0
    assert usage.concentration(none, "key").first().share is None


def test_sum_overflow_is_said(spark):
    big = {"total_tokens": str(2**63 - 1)}
    r = usage.call_types(classified(frame(spark, big, big)).withColumn("side", F.lit(0))).first()
    assert r.total_sum is None and r.total_overflow and r.prompt_sum == 20


def test_agent_tags(spark):
    tags = {'["agent:a", "x"]': ["a"], '["agent:a", "agent:b"]': ["a", "b"], '["agent: "]': [], '[1, "agent:a"]': None, "{}": None, "": None, '["AGENT:a"]': []}
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(routing.tag_labels(F.col("t"), "agent:")).collect()
    assert [r[0] for r in got] == list(tags.values())


def test_session_quantiles_are_nearest_rank(spark):
    random.seed(1)
    amounts = [Decimal(random.randint(0, 4000)) / 100 for _ in range(101)]
    df = spark.createDataFrame([(a, True, 1) for a in amounts], "spend decimal(38,6), complete boolean, calls int")
    got = {r["share"]: r.spend for r in sessions.quantiles(df).collect()}
    ordered = sorted(amounts)
    assert got == {0.5: ordered[50], 0.95: ordered[95], 1.0: ordered[100]}
    assert sessions.quantiles(df.limit(0)).count() == 0


def test_interval_coverage(spark):
    d = lambda n: datetime(2026, 1, n)
    rows = [("a", d(1), d(3)), ("a", d(2), d(4)), ("a", d(4), d(5)), ("a", d(7), d(8)), ("a", d(1), d(3)), ("b", d(1), None), ("b", d(3), d(2)), (None, d(1), d(2))]
    got = {r.owner: (r.islands, r.covered_seconds, r.gap_seconds) for r in coverage.interval_coverage(spark.createDataFrame(rows, "k string, s timestamp, e timestamp"), "k", "s", "e").collect()}
    day = 86_400
    assert got == {"a": (2, 5 * day, 2 * day), None: (1, day, 0)}


def test_latest_snapshot_and_conflicts(spark):
    rows = [("p", 1, d, s, c) for d, s, c in ((1, 1, {"n": 1}), (1, 3, {"n": 5}), (1, 2, {"n": 9}), (2, 1, {"n": 2}), (2, 1, {"n": 3}))]
    df = spark.createDataFrame(rows, "producer string, epoch int, window_start int, sequence int, counters map<string,bigint>")
    assert {(r.window_start, r.sequence) for r in snapshots.latest(df).collect()} == {(1, 3), (2, 1)}
    assert [r.window_start for r in snapshots.conflicts(df).collect()] == [2]
    assert {r.window_start: r.value for r in snapshots.combined(df.filter("window_start = 1")).collect()} == {1: 5}


def brute_cusum(values, reference, floor, shift, threshold=None):
    med = lambda v: (lambda s, n: s[n // 2] if n % 2 else s[n // 2 - 1] / 2 + s[n // 2] / 2)(sorted(v), len(v))
    past, score, out, last = [], 0.0, {}, None
    for index, value, eligible in values:
        if not eligible or (last is not None and index - last != 1):
            past, score = [], 0.0
        if eligible:
            if len(past) == reference:
                m = med(past)
                score = max(0.0, score + (value - m) / max(1.4826 * med([abs(x - m) for x in past]), floor) - shift / 2)
                if threshold is None:
                    out[index] = round(score, 6)
                elif score >= threshold:
                    out[index], score = round(score, 6), 0.0
            past = [*past, value][-reference:]
        last = index
    return out


def test_cusum_equals_the_recursion(spark):
    random.seed(2)
    values = [(i, random.gauss(100, 10) + (30 if i > 70 else 0), i % 37 != 0) for i in range(120) if i not in (20, 55)]
    df = spark.createDataFrame([("s", *v) for v in values], "series string, index int, value double, eligible boolean")
    got = {r["index"]: r.statistic for r in scan.cusum(df, ["series"]).collect()}
    want = brute_cusum(values, 6, 1.0, 2.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    alarms = {r["index"]: r.statistic for r in scan.cusum_alarms(df, ["series"], 4.0).collect()}
    assert alarms == pytest.approx(brute_cusum(values, 6, 1.0, 2.0, 4.0))
    assert scan.cusum(df.limit(0), ["series"]).count() == 0


def test_threshold_keeps_quiet():
    random.seed(3)
    quiet = [random.gauss(-0.5, 1) for _ in range(400)]
    threshold = scan.calibrated_threshold(quiet, 100)
    score, alarms = 0.0, 0
    for i in quiet:
        score = max(0.0, score + i)
        if score >= threshold:
            score, alarms = 0.0, alarms + 1
    assert alarms <= 4


def test_tiers(spark):
    tiers = spark.createDataFrame([("m", 1, 10), ("m", 2, None), ("n", 1, 5)], "model string, tier_no int, max_size bigint")
    rows = spark.createDataFrame([("m", 10), ("m", 11), ("n", 6), ("x", 1), (None, 1)], "model string, size bigint")
    got = sorted((str(r.model), r["size"], r.tier) for r in stats.first_tier(rows, tiers, ["model"], "size").collect())
    assert got == [("None", 1, None), ("m", 10, 1), ("m", 11, 2), ("n", 6, None), ("x", 1, None)]


def test_adapter_has_every_cell(spark, data):
    rows = usage_from_events(spark.read.parquet(f"{data}/events.parquet"))
    assert {"row_number", "request_id", "spend", "request_tags", "rejection_kind"} <= set(rows.columns)
    assert rows.filter("row_number is null").count() == 0


@pytest.mark.parametrize(
    ("value", "state"),
    [(w, "invalid") for w in ("unknown", "Unknown", "unknown_model", "__unknown__", "__other__", "__missing__", "__unmapped__", "__overflow__", " unknown ", "x" * 8193)]
    + [(w, "known") for w in ("UNKNOWN", "none", "other", "n/a", "null", "quorin", "x" * 8192)]
    + [("", "empty"), (" \t", "empty"), (None, "absent")],
)
def test_model_states(spark, value, state):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(routing.model_state(F.col("v"))).first()[0] == state


def test_text_and_fallback_states(spark):
    df = spark.createDataFrame([("unknown", "007"), ("", "-1"), (None, " ")], "v string, n string")
    assert [tuple(r) for r in df.select(routing.text_state(F.col("v")), routing.fallback_cell(F.col("n"))).collect()] == [("known", "known"), ("empty", "invalid"), ("absent", "empty")]


def test_volume_split_is_gated(spark):
    good = [frame(spark, {}, {"prompt_tokens": "30", "total_tokens": "35"}).withColumn("side", F.lit(s)) for s in (0, 1)]
    rows = good[0].union(good[1]).union(good[1])
    got = {(r.model, r.over_all): (r.request_effect, r.size_effect) for r in usage.volume_split(classified(rows)).collect()}
    assert got == {("m", 0): (50.0, 0.0), (None, 1): (50.0, 0.0)}
    for doubt in ({"status": "odd", "level": "DEBUG"}, {"status": "failure"}):
        more = rows.union(frame(spark, doubt).withColumn("side", F.lit(1)))
        assert {r.request_effect for r in usage.volume_split(classified(more)).collect()} == {None}


def test_overhead_and_scope(spark):
    calls = ({"call_type": "pass_through_endpoint"}, {"call_type": "pass_through_endpoint", "route": "r"}, {"call_type": "odd", "spend": "x", "route": " "}, {"route": "r"})
    rows = classified(frame(spark, *calls)).withColumns({"side": F.lit(1), "internal_call_origin": F.when(F.col("row_number") != 1, "autorouter_classifier")})
    got = {r.kind: (r.n, r.prompt_sum, str(r.spend), r.spend_invalid) for r in routing.overhead(rows).collect()}
    assert got == {"overhead": (1, 10, "0.500000", 0), "other": (2, 20, "0.500000", 1)}
    assert [r.row_number for r in usage.scoped(rows, "route", "r").collect()] == [1, 3]


def test_period_bounds_reach_the_scan(spark, data):
    from ledgerloom.plans.usage import QUERIES

    for name in ("window_totals", "movers_key", "cache_window", "model_change"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
