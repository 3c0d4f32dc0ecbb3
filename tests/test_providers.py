import json
from datetime import datetime

import pytest

from ledgerloom.operators import providers, sessions
from ledgerloom.sources import providers as files
from ledgerloom.sources.rows import ExportError

NOW = datetime(2026, 4, 1)
GOOD = {
    "schema": "demo-provider-counts/v1", "start_utc": "2026-03-01T00:00:00Z", "end_exclusive_utc": "2026-03-03T00:00:00Z", "retrieved_at_utc": "2026-03-03T06:00:00Z", "pagination_complete": True,
    "population": dict.fromkeys(files.POPULATION, "matched"), "count_basis": "primary_requests", "counting_units_match": True, "token_units_match": True,
}


def write(tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    return str(tmp_path / "f.csv")


def test_contract():
    c = files.parse_contract(json.dumps(GOOD | {"settlement_margin_seconds": 60}), NOW)
    assert c.population_status == "matched" and c.margin_seconds == 60 and c.end == datetime(2026, 3, 3)
    assert files.parse_contract(json.dumps(GOOD | {"pagination_complete": False}), NOW).population_status == "provider_export_incomplete"
    assert files.parse_contract(json.dumps(GOOD | {"population": GOOD["population"] | {"gateway": "mismatch"}}), NOW).population_status == "population_mismatch"
    wrong = [
        {"pagination_complete": "yes"}, {"count_basis": "other"}, {"count_basis": "tokens_only"}, {"retrieved_at_utc": "2026-03-02T00:00:00Z"}, {"start_utc": "2026-03-01T01:00:00Z"}, {"start_utc": "2026-03-01T00:00:00+02:00"},
        {"retrieved_at_utc": "2027-01-01T00:00:00Z"}, {"settlement_margin_seconds": -1}, {"more": 1}, {"population": {}}, {"schema": "x"},
    ]
    for change in wrong:
        with pytest.raises(ExportError):
            files.parse_contract(json.dumps(GOOD | change), NOW)
    for text in ("[]", "{", json.dumps(GOOD)[:-1] + ', "schema": "demo-provider-counts/v1"}', " " * 9000):
        with pytest.raises(ExportError):
            files.parse_contract(text, NOW)


def test_counts_file(spark, tmp_path):
    text = "date_utc,provider,provider_model,requests,output_tokens\n2026-03-01,p,m,7,\n2026-03-02,p,m,,5\n"
    got = sorted(tuple(r) for r in files.read_counts(spark, write(tmp_path, text)).selectExpr("cast(day as string)", "provider", "provider_model", "requests", "input_tokens", "output_tokens").collect())
    assert got == [("2026-03-01", "p", "m", 7, None, None), ("2026-03-02", "p", "m", None, None, 5)]
    for bad in ("date_utc,provider,requests\n", text + "2026-03-01,p,m,7,\n", text + "2026-02-30,p,n,7,\n", text + "2026-03-01,p , n,-7,\n", text + "2026-03-01,,n,7,\n", "date_utc,provider,provider_model,requests,x\n"):
        with pytest.raises(ExportError):
            files.read_counts(spark, write(tmp_path, bad))


def test_model_map(spark, tmp_path):
    head = "source_provider,source_model,provider,provider_model\n"
    assert files.read_model_map(spark, write(tmp_path, head + "a,b,p,m\na,b,p,m\n")).count() == 1
    with pytest.raises(ExportError):
        files.read_model_map(spark, write(tmp_path, head + "a,b,p,m\na,b,p,n\n"))
    counts = spark.createDataFrame([("p", "m")], "provider string, provider_model string")
    with pytest.raises(ExportError):
        files.read_model_map(spark, write(tmp_path, head + "p,p/m,p,n\n"), counts)


def test_statuses(spark):
    rows = [("2026-03-01", "src", "x", "success", "10", "1"), ("2026-03-01", "src", "x", "failure", "", "1"), ("2026-03-01", "p", "p/direct", None, "3", "4"), ("2026-03-02", "src", "odd", "success", "1", "1"), ("2026-03-02", "p", "p/direct", "success", "1", "1"), ("2026-03-03", "src", "x", "success", "1", "1")]
    df = spark.createDataFrame(rows, "day string, source_provider string, source_model string, status string, prompt_tokens string, completion_tokens string").selectExpr("cast(day as date) day", "source_provider", "source_model", "status", "prompt_tokens", "completion_tokens")
    mapping = spark.createDataFrame([("src", "x", "p", "mapped")], "source_provider string, source_model string, provider string, provider_model string")
    counts = [("2026-03-01", "p", "mapped", 3, 11, 2), ("2026-03-01", "p", "direct", 1, 3, None), ("2026-03-02", "p", "direct", None, 1, 1), ("2026-03-02", "p", "quiet", 5, 0, 0)]
    c = spark.createDataFrame(counts, "day string, provider string, provider_model string, requests bigint, input_tokens bigint, output_tokens bigint").selectExpr("cast(day as date) day", "provider", "provider_model", "requests", "input_tokens", "output_tokens")
    contract = files.parse_contract(json.dumps(GOOD), NOW)
    period = [(datetime(2026, 3, 1), datetime(2026, 3, 3))]

    def run(contract, period=period):
        got = providers.compared(df, mapping, c, period, contract, NOW).collect()
        return {(r.day.day, r.provider_model): (r.rows, r.failed, r.unknown_status, r.status, r.request_difference, r.comparable, r.input_difference, r.output_difference) for r in got}

    assert run(contract) == {
        (1, "mapped"): (2, 1, 0, "provider_exceeds_logged_rows", 1, True, None, 0),
        (1, "direct"): (1, 0, 1, "matched", 0, True, 0, None),
        (2, "odd"): (1, 0, 0, "unmapped_spend_model", None, False, None, None),
        (2, "direct"): (1, 0, 0, "request_count_unavailable", None, False, None, None),
        (2, "quiet"): (0, 0, 0, "provider_exceeds_logged_rows", 5, False, None, None),
    }
    mismatch = files.parse_contract(json.dumps(GOOD | {"population": GOOD["population"] | {"gateway": "mismatch"}}), NOW)
    assert {v[3] for v in run(mismatch).values()} == {"population_mismatch"}
    late = files.parse_contract(json.dumps(GOOD | {"settlement_margin_seconds": 7 * 3600}), NOW)
    assert {k[0]: v[3] for k, v in run(late).items()}[2] == "unsettled_day"
    assert {k[0]: v[3] for k, v in run(contract, [(datetime(2026, 3, 1, 5), datetime(2026, 3, 2))]).items()} == {1: "partial_day"}
    assert {v[5] for v in run(None).values()} == {False} and run(None)[1, "mapped"][3] == "provider_exceeds_logged_rows"


def test_session_period(spark):
    rows = spark.createDataFrame([(datetime(2026, 3, 1, 5),), (datetime(2026, 3, 4, 5),)], "start_time timestamp_ntz")
    assert sessions.automatic(rows) == (datetime(2026, 3, 2), datetime(2026, 3, 4))
    assert sessions.automatic(rows, datetime(2026, 3, 3, 1)) == (datetime(2026, 3, 2), datetime(2026, 3, 3))
    one = rows.filter("day(start_time) = 1")
    assert sessions.automatic(one) == (datetime(2026, 3, 1, 5), datetime(2026, 3, 1, 5, 0, 0, 1))
    assert sessions.automatic(rows.limit(0)) is None
    with pytest.raises(ValueError):
        sessions.automatic(one, datetime(2026, 3, 1, 1))
