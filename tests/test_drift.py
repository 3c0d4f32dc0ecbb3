import json

from ledgerloom.operators import drift

LINES = "file_key string, line_no int, raw_line string, member string"
FILES = "file_key string, project_id string, window_start timestamp, quantity string"


def line(cached=None, category=None, plain=100, **more):
    usage = {"input": plain, "output": 10}
    total = plain + 10
    if cached:
        name, value, count = cached
        usage[name] = value
        total += count
    if category:
        usage[category[0]] = category[1]
    usage |= more
    return json.dumps({"id": "x", "usage_details": usage | {"total": total}})


def changes(spark, files):
    lines = [(k, n, raw, None) for k, _, _, rows in files for n, raw in enumerate(rows)]
    table = [(k, p, w, None) for k, p, w, _ in files]
    df = drift.changes(spark.createDataFrame(lines, LINES), spark.createDataFrame(table, FILES.replace("timestamp", "string")).selectExpr("file_key", "project_id", "cast(window_start as timestamp) window_start", "quantity"))
    return sorted((r.file_key, r.member, r.change) for r in df.collect())


def test_all_changes(spark):
    files = [
        ("f1", "p", "2026-01-01", [line(("cached", 5, 5))]),
        ("f2", "p", "2026-02-01", [line(("cached", 7, 7), ("cat", 3)), line(None, ("cat", 4)), line(("cached", None, 0))]),
        ("f3", "p", "2026-02-02", [line(("hits", {"value": 9}, 9), ("cat", True)), line(None, ("cat", False))]),
        ("f4", "p", "2026-02-03", [line(("hits", {"value": 2}, 2))]),
        ("g1", "q", "2026-02-03", [line(("hits", 1, 1))]),
    ]
    assert changes(spark, files) == [
        ("f2", "cat", "added"), ("f3", "cat", "type_changed"), ("f3", "hits", "renamed"), ("f3", "hits", "type_changed"), ("f4", "cat", "removed"),
    ]


def test_names_swapped_between_quantities(spark):
    """A name says nothing: the arithmetic of total does."""
    files = [
        ("f1", "p", "2026-01-01", [line(("a", 5, 5), ("b", 3)), line(None, ("b", 2))]),
        ("f2", "p", "2026-01-02", [line(("b", "6", 6), ("a", 3)), line(None, ("a", 2))]),
    ]
    assert ("f2", "b", "renamed") in changes(spark, files) and ("f2", "a", "renamed") in changes(spark, files)


def test_members_beyond_two_are_reported(spark):
    """A third member is neither dropped nor put in another's place."""
    both = dict(cached=("c", 5, 5), category=("code", 3))
    files = [
        ("f1", "p", "2026-01-01", [line(**both), line(None, ("code", 2))]),
        ("f2", "p", "2026-01-02", [line(**both, aaa=9), line(None, ("code", 2))]),
        ("f3", "p", "2026-01-03", [line(**both, aaa="x"), line(None, ("code", 2))]),
        ("f4", "p", "2026-01-04", [line(**both), line(None, ("code", 2))]),
    ]
    assert changes(spark, files) == [("f2", "aaa", "added"), ("f3", "aaa", "type_changed"), ("f4", "aaa", "removed")]


def test_broken_lines_and_empty(spark):
    files = [("f1", "p", "2026-01-01", ["not json", None, "[1]", "{}", line(("c", 1, 1))]), ("f2", "p", "2026-01-02", ["{"])]
    assert changes(spark, files) == [("f2", "c", "removed")]
    assert changes(spark, [("f1", "p", "2026-01-01", [])]) == []


def test_consistent_table(spark):
    rows = [("f1", 1, line(("c", 5, 5))), ("f2", 1, line(("d", 2.5, 0) if False else ("d", 3.0, 3))), ("f2", 2, "oops")]
    df = drift.consistent_table(spark.createDataFrame([(*r, None) for r in rows], LINES))
    assert dict(df.dtypes)[drift.COUNTED] == "decimal(38,6)"
    got = {(r.file_key, r.line_no): r[drift.COUNTED] for r in df.collect()}
    assert got[("f1", 1)] == 5 and got[("f2", 1)] == 3 and got[("f2", 2)] is None


def test_promotion_lattice():
    b = drift._BIT
    assert drift.promoted(b["integer"]) == "bigint"
    assert drift.promoted(b["integer"] | b["decimal"]) == "decimal(38,6)"
    assert drift.promoted(b["boolean"]) == "boolean"
    assert drift.promoted(b["boolean"] | b["integer"]) == drift.promoted(b["array"]) == drift.promoted(0) == "string"


def test_union_of_all_members(spark):
    """No member and no digit is lost, whatever file carries it."""
    raws = [
        ("f1", 1, line(("c", 5, 5)).replace('"id": "x"', '"id": "x", "user_id": "u", "cost": 0.12345678912345678901234567, "big": 12345678901234567890123456789012345, "Total": 1e-7')),
        ("f2", 1, line(("d", 3, 3), output_reasoning_tokens=0.5).replace('"id": "x"', '"provided_model_name": "m", "tags": [1, "a"], "cost": 7, "big": 0.125, "usage": null')),
        ("f2", 2, '{"usage_details": "none", "id": 7}'),
        ("f3", 1, "oops"),
    ]
    df = drift.consistent_table(spark.createDataFrame([(*r, None) for r in raws], LINES))
    got = {(r.file_key, r.line_no): r.asDict() for r in df.collect()}
    kinds = dict(df.dtypes)
    assert kinds["cost"] == "decimal(38,26)" and kinds["big"] == "decimal(38,3)" and kinds["Total_"] == "decimal(38,7)" and kinds["usage"] == "string"
    a, b, c = got[("f1", 1)], got[("f2", 1)], got[("f2", 2)]
    assert (a["user_id"], a["provided_model_name"], str(a["cost"]), a["big"], float(a["Total_"])) == ("u", None, "0.12345678912345678901234567", 12345678901234567890123456789012345, 1e-7)
    assert (b["user_id"], b["provided_model_name"], b["tags"], b["cost"], str(b["big"]), str(b["output_reasoning_tokens"])) == (None, "m", '[1,"a"]', 7, "0.125", "0.500000")
    assert (c["id"], c["usage_details"], a["usage_details"], a["input"], b[drift.COUNTED]) == ("7", "none", None, 100, 3)
    assert set(got[("f3", 1)].values()) == {"f3", 1, None}
    assert drift.promoted(drift._NUMERIC, 30, 9) == "string" and drift.promoted(drift._NUMERIC, 1, 9) == "decimal(38,9)"
    assert drift.consistent_table(spark.createDataFrame([], LINES)).columns[2:7] == list(drift.USUAL)
