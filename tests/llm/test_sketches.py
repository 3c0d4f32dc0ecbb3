import random
from collections import Counter
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import distinct, frequent, quantiles

# Percentiles ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 100, 30_000, 400_000])
def test_rank_error_is_within_the_bound(n):
    values = np.random.default_rng(n).permutation(n).astype(float)
    parts = []
    for i, part in enumerate(np.array_split(values, 7)):
        s = quantiles.RelativeSketch(seed=i)
        for chunk in np.array_split(part, 5):
            s.update(chunk)
        parts.append(quantiles.RelativeSketch.unpack(s.pack(), i))
    total = parts[0]
    for p in parts[1:]:
        total.merge(p)
    assert total.n == n and sum(len(b) << h for h, b in enumerate(total.levels)) == n
    for q in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 1.0):
        rank = total.quantiles([q])[0] + 1
        assert abs(rank - q * n) <= 1 + 2 * total.rank_error(q) * n
    assert sum(map(len, total.levels)) < 6_000


def test_order_of_merges_keeps_the_bound():
    values = np.concatenate([np.full(50_000, 5.0), np.arange(50_000)])  # ties
    sketches = []
    for i, part in enumerate(np.array_split(np.random.default_rng(1).permutation(values), 40)):
        s = quantiles.RelativeSketch(seed=i)
        s.update(part)
        sketches.append(s)
    while len(sketches) > 1:
        a, b = sketches.pop(), sketches.pop(0)
        a.merge(b)
        sketches.append(a)
    ordered = np.sort(values)
    for q in (0.5, 0.9, 0.99):
        x = sketches[0].quantiles([q])[0]
        low, high = np.searchsorted(ordered, x, "left"), np.searchsorted(ordered, x, "right")
        slack = 2 * sketches[0].rank_error(q) * len(values)
        assert low - slack <= q * len(values) <= high + slack


def test_percentiles_of_groups(spark):
    rows = [("a", float(v), i) for i, v in enumerate(range(1, 101))] + [(None, 7.0, 1), ("b", None, 2), ("b", float("nan"), 3)]
    df = spark.createDataFrame(rows, "g string, x double, sketch int").repartition(3)
    got = {(r.g, r.q): (r.value, r.n, r.rank_error) for r in quantiles.percentiles(df, ["g"], ["x"], [0.5, 0.9]).collect()}
    assert got == {("a", 0.5): (50.0, 100, 0.0), ("a", 0.9): (90.0, 100, 0.0), (None, 0.5): (7.0, 1, 0.0), (None, 0.9): (7.0, 1, 0.0)}
    assert quantiles.percentiles(df.limit(0), ["g"], ["x"], [0.5]).count() == 0
    assert quantiles.percentiles(df, [], ["x"], [0.5]).first().value == 50.0


# Frequent items -------------------------------------------------------------------


def test_space_saving_bounds():
    random.seed(4)
    stream = [f"v{min(int(random.paretovariate(0.6)), 5000)}" for _ in range(60_000)]
    truth = Counter(stream)
    parts = []
    for k in range(12):
        s = frequent.SpaceSaving(100)
        for a in range(k * 5000, (k + 1) * 5000, 500):
            c = Counter(stream[a : a + 500])
            s.merge(list(c), list(c.values()), [0] * len(c), 0, 500)
        parts.append(s.row("f", k))
    total = frequent.SpaceSaving(100)
    for r in parts:
        total.merge(r["items"], r["counts"], r["errors"], r["floor"], r["rows"])
    assert total.rows == len(stream) and len(total.held) <= 100 and total.floor <= len(stream) / 100 * 2
    for item, (count, error) in total.held.items():
        assert count - error <= truth[item] <= count
    for item, n in truth.items():
        assert item in total.held or n <= total.floor


def test_frequent_against_counting(spark):
    random.seed(5)
    rows = [(random.choice(["hot ", "hot", " hot\t"]) if random.random() < 0.3 else random.choice(["é", "é"]) if random.random() < 0.1 else f"rare{random.random()}", random.choice([None, " ", "", "x", "X"]), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, n int").repartition(5)
    got = {(r.field, r.value): (r.n, r.rows) for r in frequent.frequent(df, ["a", "b"], 0.01, counters=150).collect()}
    want = {}
    for i, f in enumerate("ab"):
        values = [v for v in (frequent.canonical(r[i]) for r in rows if r[i] is not None) if v]
        want |= {(f, v): (n, len(values)) for v, n in Counter(values).items() if n > 0.01 * len(values)}
    assert got == want and {v for _, v in got} == {"hot", "é", "x", "X"}
    assert frequent.frequent(df.limit(0), ["a", "b"], 0.01).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent(df, ["a"], 0.001, counters=100)


@pytest.mark.parametrize("parts", [1, 200, 1500])
def test_any_number_of_tasks(spark, parts):
    """One summary a field and one sketch a group come out however many tasks ran."""
    rows = spark.range(40_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS a", "id", "CAST(id AS double) AS x", "id % 2 AS g").repartitionByRange(parts, "id")
    got = {(r.value, r.n, r.rows, r.estimate - r.error <= r.n <= r.estimate) for r in frequent.frequent(rows, ["a"], 0.1, counters=50).collect()}
    assert got == {("even", 20_000, 40_000, True), ("odd", 20_000, 40_000, True)}
    found = quantiles.percentiles(rows, ["g"], ["x"], [0.5, 0.99]).collect()
    assert sorted((r.g, r.q, r.n) for r in found) == [(0, 0.5, 20_000), (0, 0.99, 20_000), (1, 0.5, 20_000), (1, 0.99, 20_000)]
    for r in found:
        assert abs(r.value / 40_000 - r.q) <= r.rank_error + 1e-4


def test_many_small_files(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("CASE WHEN id < 10000 THEN 'early' ELSE 'late' END AS a", "CAST(id AS double) AS x").repartitionByRange(1100, "x")
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.value, r.n, r.rows) for r in frequent.frequent(df, ["a"], 0.1, counters=50).collect()} == {("early", 10_000, 20_000), ("late", 10_000, 20_000)}
    assert [r.n for r in quantiles.percentiles(df, [], ["x"], [0.5]).collect()] == [20_000]


def test_exact_ranks(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 1.0, 6), ("a", 2.0, None), (None, 3.0, 1), ("a", None, 1)], "g string, x double, y int")
    got = quantiles.ranks(df, ["g"], ["x", "y"], quantiles.percentiles(df, ["g"], ["x", "y"], [0.5, 1.0]))
    want = {("a", "x", 0.5, 0, 2), ("a", "x", 1.0, 2, 3), (None, "x", 0.5, 0, 1), (None, "x", 1.0, 0, 1), ("a", "y", 0.5, 1, 2), ("a", "y", 1.0, 2, 3), (None, "y", 0.5, 0, 1), (None, "y", 1.0, 0, 1)}
    assert {(r.g, r.metric, r.q, r.below, r.upto) for r in got.collect()} == want
    assert quantiles.ranks(df.limit(0), ["g"], ["x"], quantiles.percentiles(df.limit(0), ["g"], ["x"], [0.5])).count() == 0


# Distinct counts --------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=30), max_size=8))
def test_runs_round_trip(groups):
    runs = [np.unique(np.array(g, np.uint64)) for g in groups]
    starts = np.cumsum([0, *map(len, runs)])[:-1].astype(np.int64)
    packed = distinct.encode_runs(np.concatenate([np.zeros(0, np.uint64), *runs]), starts)
    hashes, group = distinct.decode_runs(packed)
    assert [hashes[group == i].tolist() for i in range(len(runs))] == [r.tolist() for r in runs]
    hashes, group = distinct.decode_runs(pa.concat_arrays([pa.array([b""], pa.binary()), packed]).slice(1))
    assert [hashes[group == i].tolist() for i in range(len(runs))] == [r.tolist() for r in runs]


@pytest.mark.parametrize(("shard_rows", "members"), [(50, 16_384), (50, 3), (10_000, 16_384)])
def test_counts_of_all_combinations(spark, shard_rows, members, monkeypatch):
    monkeypatch.setattr(distinct, "HOT_MEMBERS", members)
    random.seed(6)
    rows = [(random.choice([date(2026, 1, 1), date(2026, 1, 2), None]), "hot" if random.random() < 0.4 else f"t{random.randint(0, 30)}", random.choice("ab"), random.choice([None, f"s{random.randint(0, 900)}"]), f"k{random.randint(0, 20)}", 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, "day date, team string, model string, session string, key string, shard int").repartition(6)
    got = {(r.grouped, r.day, r.team, r.model): (r.n_session, r.n_key) for r in distinct.distinct_counts(df, ["day", "team", "model"], ["session", "key"], shard_rows).collect()}
    want = {}
    for members in distinct.grouping_sets(["day", "team", "model"]):
        sets = {}
        for d, t, m, s, k, _ in rows:
            key = (",".join(members), *(v if n in members else None for n, v in (("day", d), ("team", t), ("model", m))))
            a, b = sets.setdefault(key, (set(), set()))
            b.add(k)
            if s:
                a.add(s)
        want |= {k: (len(a), len(b)) for k, (a, b) in sets.items()}
    assert got == want


def test_composed_values(spark):
    df = spark.createDataFrame([("e\u0301 ", "e\u0301 ", 1), ("\u00e9", "x", 2), (" \u3000", None, 3), (None, "", 4)], "a string, b string, n int")
    got = [tuple(r) for r in distinct.composed(df, ["a"]).collect()]
    assert got == [("\u00e9", "e\u0301 ", 1), ("\u00e9", "x", 2), (None, None, 3), (None, "", 4)]
    assert distinct.composed(df.limit(0), ["a"]).count() == 0
    assert [frequent.canonical(v) for v in ("e\u0301 ", "\u00e9", " \u3000")] == ["\u00e9", "\u00e9", ""]  # the form of the frequent values


def test_nothing_to_count(spark):
    df = spark.createDataFrame([], "day date, team string, model string, session string")
    assert distinct.distinct_counts(df, ["day", "team", "model"], ["session"]).count() == 0
    df = spark.createDataFrame([(None, None, None, None)], "day date, team string, model string, session string")
    assert distinct.distinct_counts(df, ["day", "team", "model"], ["session"]).count() == 0
