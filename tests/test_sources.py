import csv
import gzip
import io
import json
from datetime import datetime

import pytest

from ledgerloom.functions.accounting import classified
from ledgerloom.sources import exports, rows

HEAD = ["request_id", "call_type", "startTime", "prompt_tokens", "completion_tokens", "total_tokens", "user", "other"]
ROWS = [
    ["r1", "acompletion", "2026-03-01T10:00:00Z", "10", "5", "15", 'the "blue", team\nnight', "x"],
    ["r2", "embedding", "2026-03-01T12:00:00.5+02:00", "", "5", "5", "", "x"],
    ["r3", "acompletion", "2026-03-01 10:00:00", "x", "5", "5", "ü", "x"],
]


def csv_text(header, body):
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c
    return "".join(",".join(map(quoted, r)) + "\n" for r in [header, *body])


def view(df):
    return sorted((r.request_id, r.start_time, r.prompt_tokens or "", r.user or "") for r in df.collect())


WANT = [("r1", datetime(2026, 3, 1, 10), "10", ROWS[0][6]), ("r2", datetime(2026, 3, 1, 10, 0, 0, 500000), "", ""), ("r3", None, "x", "ü")]


def test_formats_agree(spark, tmp_path):
    objects = [dict(zip(HEAD, r)) for r in ROWS]
    (tmp_path / "a.csv").write_text(csv_text(HEAD, ROWS))
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, objects)) + "\n\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, objects)))
    spark.createDataFrame(ROWS, HEAD).write.parquet(str(tmp_path / "a.parquet"))
    for name, kind in (("a.csv", "csv"), ("a.json", "json"), ("a.jsonl", "jsonl"), ("b.jsonl.gz", "jsonl"), ("a.parquet", "parquet")):
        df = rows.read_rows(spark, str(tmp_path / name), kind)
        assert view(df) == WANT, name
        assert "other" not in df.columns and df.select("row_number").distinct().count() == 3
        assert classified(df).filter("invalid = 1").count() == 1


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("twice.csv", csv_text([*HEAD, "user"], [])),
        ("short.csv", csv_text(HEAD[1:], [])),
        ("daily.csv", "date,api_requests\n"),
        ("empty.csv", ""),
        ("object.json", "{}"),
        ("broken.jsonl", "{\n"),
        ("twice.jsonl", '{"request_id": "a", "request_id": "b"}'),
    ],
)
def test_other_files_are_refused(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(rows.ExportError):
        rows.read_rows(spark, str(tmp_path / name), name.split(".")[1])


def test_ragged_csv_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text(csv_text(HEAD, [*ROWS, ["r4", "x"]]))
    with pytest.raises(Exception, match="(?i)malformed"):
        rows.read_csv(spark, str(tmp_path / "a.csv")).select(*HEAD[:-1]).collect()


def test_daily_counts(spark, tmp_path):
    good = "date,api_requests,failed_requests,successful_requests\n2026-03-01,5,1,4\n"
    (tmp_path / "d.csv").write_text(good)
    (r,) = rows.read_daily_counts(spark, str(tmp_path / "d.csv")).collect()
    assert (str(r.day), r.api_requests, r.failed_requests) == ("2026-03-01", 5, 1)
    for bad in (good + "2026-03-01,5,1,4\n", good + "2026-02-30,5,1,4\n", good + "2026-03-02,+5,1,4\n", "date\n"):
        (tmp_path / "d.csv").write_text(bad)
        with pytest.raises(rows.ExportError):
            rows.read_daily_counts(spark, str(tmp_path / "d.csv"))


def manifest(files, **more):
    m = {"version": 1, "projectId": "p", "window": {"minTimestamp": "2026-03-01T00:00:00Z", "maxTimestamp": "2026-03-02T00:00:00Z"}, "files": files}
    return json.dumps(m | more)


def observation(i, **more):
    return {"id": i, "project_id": "p", "type": "GENERATION", "start_time": "2026-03-01 10:00:00.250", "usage_details": {"input": 5}, "payload": "never read"} | more


def encoded_file(kind, rows):
    if kind == "csv":
        out = io.StringIO()
        w = csv.writer(out)
        w.writerow(["id", "project_id", "type", "start_time", "usage_details", "payload", "tags"])
        for r in rows:
            w.writerow([r["id"], r["project_id"], r["type"], r["start_time"], json.dumps(r["usage_details"]), "a\n\"b\", c", json.dumps(r.get("tags"))])
        return out.getvalue().encode()
    return (json.dumps(rows) if kind == "json" else "\n".join(map(json.dumps, rows))).encode()


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl"])
@pytest.mark.parametrize("packed", [False, True])
def test_observation_export_formats(spark, tmp_path, kind, packed):
    rows_ = [observation("a", tags=["x", "y"]), observation("b", usage_details={"input": 7, "output": None})]
    data = encoded_file(kind, rows_)
    data = gzip.compress(data) if packed else data
    key = f"p/observations_v2/one.{kind}" + (".gz" if packed else "")
    (tmp_path / "p/observations_v2").mkdir(parents=True)
    (tmp_path / key).write_bytes(data)
    files = [{"key": key, "table": "observations_v2", "format": f"{kind}-{'gzip' if packed else 'raw'}", "sizeBytes": len(data), "rowCount": 2}]
    got, status = exports.read_observations(spark, str(tmp_path), exports.parse_manifest(manifest(files)))
    assert [r.status for r in status.collect()] == ["complete"]
    assert sorted((r.id, r.usage_details, r.tags) for r in got.collect()) == [("a", {"input": 5}, ["x", "y"]), ("b", {"input": 7, "output": None}, None)]


def test_incomplete_files_give_no_rows(spark, tmp_path):
    texts = {
        "ok": [observation("a"), observation("b")], "short": [observation("a")], "other": [observation("a"), observation("b", project_id="q")], "late": [observation("a"), observation("b", start_time="2026-03-02 00:00:00.001")],
        "edge": [observation("c"), observation("d", start_time="2026-03-02 00:00:00")], "sized": [observation("a"), observation("b")],
    }
    sizes = {}
    for n, rows_ in texts.items():
        data = encoded_file("jsonl", rows_)
        (tmp_path / f"{n}.jsonl").write_bytes(data)
        sizes[n] = len(data) + (n == "sized")
    for n, text in (("bad", json.dumps(observation("c")) + "\n{"), ("twice", '{"id": "a", "id": "b"}\n' + json.dumps(observation("c")))):
        (tmp_path / f"{n}.jsonl").write_text(text)
        sizes[n] = len(text)
    files = [{"key": f"{n}.jsonl", "format": "jsonl-raw", "sizeBytes": k, "rowCount": 2} for n, k in (sizes | {"gone": 5}).items()]
    got, status = exports.read_observations(spark, str(tmp_path), exports.parse_manifest(manifest(files)))
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c", "d"]
    assert {r.file_key.split(".")[0]: r.status for r in status.collect()} == {
        "ok": "complete", "edge": "complete", "short": "row_count_differs", "other": "outside", "late": "outside", "sized": "size_differs", "bad": "does_not_parse", "twice": "does_not_parse", "gone": "missing",
    }


@pytest.mark.parametrize("key", ["../a.jsonl", "/a.jsonl", "a/./b.jsonl", "a//b.jsonl", "a\\b.jsonl", "a.csv", ""])
def test_keys_stay_in_their_folder(key):
    with pytest.raises(rows.ExportError):
        exports.parse_manifest(manifest([{"key": key, "format": "jsonl-raw", "sizeBytes": 1, "rowCount": 1}]))


def test_observations_as_usage_rows(spark):
    from ledgerloom.functions.accounting import classified
    from ledgerloom.operators.observations import usage_rows

    data = [("a", "p", "GENERATION", {"input": 5, "input_cached_tokens": 2, "output": 3, "output_reasoning_tokens": 1, "total": 11}, 0.5), ("a", "q", "GENERATION", {"input": -1}, None), ("c", "p", "SPAN", {"input": 9}, 1.0), ("d", "p", "GENERATION", None, None)]
    df = spark.createDataFrame(data, "id string, project_id string, type string, usage_details map<string,bigint>, total_cost double").selectExpr("*", "'' AS start_time", "CAST(NULL AS timestamp) AS end_time", "'ERROR' AS level", "'u' AS user_id", "'s' AS session_id", "'m' AS provided_model_name")
    got = classified(usage_rows(df)).collect()
    assert [(r.call_type, r.prompt_tokens, r.completion_tokens, r.cache_read, r.total_mismatch, None if r.amount is None else float(r.amount)) for r in got] == [
        ("completion", "7", "4", 2, 0, 0.5), ("completion", "invalid", "invalid", None, 0, None), ("observation_other", None, None, None, 0, None), ("completion", None, None, None, 0, None),
    ]
    assert len({r.request_id for r in got}) == 4


@pytest.mark.parametrize("text", ["", "[]", "{}", manifest([], version=2), manifest([{"key": "a", "format": "x", "sizeBytes": 1, "rowCount": -1}]), '{"version": 1, "version": 1}'])
def test_other_manifests_are_refused(text):
    with pytest.raises(rows.ExportError):
        exports.parse_manifest(text)


def test_snapshots_and_traces(spark, tmp_path):
    doc = {"producer_id": "p", "epoch": 1, "sequence": 2, "window_start_unix_nano": 1_772_323_200_000_000_000, "window_duration_unix_nano": 3_600_000_000_000, "emitted_at_unix_nano": 1, "counters": {"requests": 3}}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps(doc))
    (r,) = exports.read_snapshots(spark, str(tmp_path / "s")).collect()
    assert (r.producer, r.window_start, r.window_seconds, r.counters) == ("p", datetime(2026, 3, 1), 3600, {"requests": 3})
    (tmp_path / "s/b.json").write_text("{}")
    with pytest.raises(rows.ExportError):
        exports.read_snapshots(spark, str(tmp_path / "s"))
    span = lambda i, **a: {"traceId": "ab" * 16, "spanId": i, "name": "n", "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in a.items()]}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "k", "value": {"intValue": "7"}}, {"key": "r", "value": {"boolValue": True}}]}, "scopeSpans": [{"spans": [span("cd" * 8, k="own"), span("short")]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    spans = exports.read_traces(spark, str(tmp_path / "t.json"))
    assert [r.attributes for r in spans.collect()] == [{"k": "own", "r": "true"}]
    assert {r.label: r.n for r in exports.attribute_cardinality(spans).collect()} == {"k": 1, "r": 1}
    assert [r.kind for r in exports.operation_mix(spans).collect()] == ["other"]
    for value in ("v", "w"):  # a key twice, alike or not
        (tmp_path / "t.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span("cd" * 8) | {"attributes": [{"key": "k", "value": {"stringValue": v}} for v in ("v", value)]}]}]}]}))
        with pytest.raises(rows.ExportError):
            exports.read_traces(spark, str(tmp_path / "t.json"))


def test_trace_identities_and_readiness(spark):
    model = {"gen_ai.operation.name": "chat"}
    spans = [model | {"user.id": "u1", "gen_ai.usage.input_tokens": "5", "gen_ai.usage.output_tokens": "2"}, model | {"enduser.id": "u2", "user.id": "u1", "gen_ai.usage.input_tokens": "x"}, {"gen_ai.request.model": "m", "session.id": ""}, {"gen_ai.operation.name": "execute_tool", "user.id": "u9"}]
    df = spark.createDataFrame([(s,) for s in spans], "attributes map<string,string>")
    got = {r.identity: (r.attempts, r.present, r.members, r.with_tokens, r.tokens) for r in exports.identity_coverage(df).collect()}
    assert got == {"user": (3, 2, 2, 1, 7), "session": (3, 0, 0, 0, 0), "prompt": (3, 0, 0, 0, 0)}
    ready = {r.question: (r.covered, r.status) for r in exports.readiness(df).collect()}
    assert ready["model_activity"] == (3, "ready") and ready["token_usage"] == (1, "partial") and ready["prompt_rankings"] == (0, "cannot_determine") and len(ready) == 7
    assert {r.status for r in exports.readiness(df.limit(0)).collect()} == {"cannot_determine"}
    assert {r.label: r.risk for r in exports.attribute_cardinality(df).collect()}["user.id"] == "sensitive_identifier"


def test_order_does_not_depend_on_splits(spark, tmp_path):
    head = [c for c in HEAD if c != "other"]
    for f in range(3):
        lines = [json.dumps(dict(zip(head, [f"{f}-{i}", "acompletion", "2026-03-01T10:00:00Z", "1", "1", "2", "u"]))) for i in range(400)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = []
    try:
        for size in ("128m", "9k", "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            orders.append([r.request_id for r in rows.read_jsonl(spark, str(tmp_path)).orderBy("row_number").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert orders[0] == orders[1] == orders[2] and len(set(orders[0])) == 1200
    for f in range(3):
        assert [i for i in orders[0] if i.startswith(f"{f}-")] == [f"{f}-{i}" for i in range(400)]


def test_ends_limits_and_generator(spark, tmp_path):
    now = datetime(2026, 4, 1)
    base = {"request_id": "r", "call_type": "acompletion", "startTime": "2026-03-01T10:00:00Z", "prompt_tokens": "1", "completion_tokens": "1", "total_tokens": "2"}

    def read(*ends):
        (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(base | {"endTime": e}) for e in ends))
        return rows.read_jsonl(spark, str(tmp_path / "e.jsonl"))

    rows.check_ends(read("2026-03-01T10:00:01Z", "", None), now)
    for bad in ("2026-03-01T09:00:00Z", "2026-05-01T09:00:00Z", "soon"):
        with pytest.raises(rows.ExportError):
            rows.check_ends(read(bad), now)
    some = read("2026-03-01T10:00:01Z")
    rows.check_limits(some, 1)
    for limits in ({"most_rows": 0}, {"most_bytes": 5}):
        with pytest.raises(rows.ExportError):
            rows.check_limits(some, **limits)
    many = rows.repeated(some, 100, days=4, keys=7)
    assert many.count() == 100 and many.select("request_id").distinct().count() == 100 and many.select("api_key").distinct().count() == 7
    assert sorted({r.startTime[:10] for r in many.collect()}) == [f"2026-03-0{d}" for d in range(1, 5)]
    assert rows.canonical(many).filter("start_time is null or end_time < start_time").count() == 0
