import json
from datetime import datetime
from decimal import Decimal

import pytest

from ledgerloom import __main__ as cli
from ledgerloom import report


def test_numbers():
    d = Decimal
    assert [report.usd(d(x)) for x in ("0", "0.004", "-0.004", "1.005", "1.015", "-1234.5")] == ["$0.00", "<$0.01", "-<$0.01", "$1.00", "$1.02", "-$1,234.50"]
    assert report.count(1234567) == "1,234,567" and report.percent(1, 3) == "33.3%" and report.percent(1, 0) == "n/a"


def test_json(spark):
    df = spark.createDataFrame([(2, Decimal("1.500000"), None), (1, Decimal("10.000000"), {"b": 1, "a": 2})], "n int, x decimal(38,6), m map<string,int>")
    assert json.loads(report.to_json({"t": df})) == {"t": [{"n": 1, "x": "10", "m": {"a": 2, "b": 1}}, {"n": 2, "x": "1.5", "m": None}]}
    assert report._cell(datetime(2026, 3, 1, 1, 2, 3, 500000)) == "2026-03-01T01:02:03.5Z"
    assert report.to_json({"t": df.limit(0)}) == '{\n  "t": []\n}\n'
    with pytest.raises(ValueError):
        report.assemble({"t": df}, max_rows=1)


def test_command(spark, tmp_path, capsys):
    span = lambda a, b: f"2026-03-{a:02}T00:00:00Z/2026-03-{b:02}T00:00:00Z"
    head = "request_id,call_type,startTime,endTime,prompt_tokens,completion_tokens,total_tokens,spend,status,api_key,model\n"
    line = "r{0},acompletion,2026-03-{1:02}T10:00:00Z,2026-03-{1:02}T10:00:01Z,10,5,15,0.5,success,k,m\n"
    (tmp_path / "a.csv").write_text(head + "".join(line.format(i, d) for i, d in enumerate([2, 3, 10, 11, 11])))
    assert cli.main(["investigate", str(tmp_path / "a.csv"), "csv", span(1, 8), span(8, 15)]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [(w["side"], w["requests"], w["spend"]) for w in got["windows"]] == [(0, 2, "1"), (1, 3, "1.5")]
    assert got["movers_key"][0]["change"] == 15
    assert cli.main(["investigate", str(tmp_path / "a.csv"), "csv"]) == 1  # too short for automatic periods
    assert cli.main(["investigate", str(tmp_path / "a.csv"), "csv", span(1, 8), span(7, 14)]) == 1
    assert cli.main(["other"]) == 2


def test_shares_are_rounded_outwards():
    assert report.share_text(1, 1, 3) == "33.33%" and report.share_text(0, 0, 0) == "unknown"
    assert report.share_text(1, 2, 3) == "[33.33%, 66.67%]" and report.share_text(0, 3, 3) == "[0.00%, 100.00%]" and report.share_text(9_999_999, 10_000_000, 10_000_000) == "[99.99%, 100.00%]"


def test_headline_and_table():
    volume = {"tokens_before": 10, "tokens_after": 4, "requests_before": 2, "requests_after": 1}
    assert report.headline([], 3, volume) == "Reported tokens: 10 -> 4 (-6); model attempts: 2 -> 1."
    assert report.headline([], 3, None, "No requests.") == "Token-change breakdown unavailable. No requests."
    some = [{"lower": 3, "upper": 3, "total": 10, "unit": "tokens"}, {"lower": 5, "upper": 6, "total": 10, "unit": "tokens"}]
    assert report.headline(some[:1], 4, volume) == "1 of 4 tracked sessions flagged for review: 30.00% of attributed tokens."
    assert report.headline(some, 4, volume) == "2 of 4 tracked sessions flagged for review; one flagged session: [50.00%, 60.00%] of attributed tokens."
    assert report.text_table([{"a": "x\ny", "n": 1200}, {"a": None, "n": None}]) == "a         n\nx\\ny  1,200\n-         -\n" and report.text_table([]) == ""


def test_questions(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import questions

    def run(*rows):
        df = spark.createDataFrame([(p, w, c) for p, w, c in rows], "producer string, window_start int, counters map<string,bigint>")
        return {r.question: (r.status, r.reason) for r in questions.statuses(df, F.col("window_start") == 1, F.col("window_start") == 2, ["p"]).collect()}

    good = {"requests": 2, "missing_token_usage": 0, "input_tokens": 5, "output_tokens": 1}
    assert run(("p", 1, good), ("p", 2, good)) == {"volume": ("observed", None), "coverage": ("observed", None)}
    assert run(("p", 1, good), ("q", 2, good))["volume"] == ("cannot_determine", "incomplete_producers")
    assert run(("p", 1, good))["volume"] == ("cannot_determine", "incomplete_producers")
    assert run(("p", 1, good), ("p", 2, {"requests": 1}))["volume"] == ("cannot_determine", "counters_unavailable")
    assert run(("p", 1, good), ("p", 2, good | {"missing_token_usage": 1})) == {"volume": ("cannot_determine", "missing_usage"), "coverage": ("limited", "missing_usage")}
    assert run(("p", 1, good), ("p", 2, good | {"requests": 0})) == {"volume": ("cannot_determine", "no_requests"), "coverage": ("observed", None)}


def test_flags_and_aliases(spark):
    from ledgerloom.operators import questions

    items = spark.createDataFrame([("a", 3, 9, 10), ("b", 4, 4, 10), ("c", 0, 0, 0)], "item string, lower bigint, upper bigint, total bigint")
    assert [r.item for r in questions.flagged(items, "0.3").collect()] == ["b"]  # exactly three tenths is not above
    lists = spark.createDataFrame([("key", "x", 1), ("key", "y", 2), ("key", "x", 11), ("key", None, 3), ("team", "x", 4)], "kind string, member string, place int")
    got = sorted((r.kind, str(r.member), r.place, r.alias) for r in questions.aliased(lists, "kind", "member", "place").collect())
    assert got == [("key", "None", 3, "key-3"), ("key", "x", 1, "key-1"), ("key", "x", 11, "key-1"), ("key", "y", 2, "key-2"), ("team", "x", 4, "team-1")]
