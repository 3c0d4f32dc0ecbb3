"""Observation exports with manifests, snapshot documents and trace captures."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.rejects import header_names
from ledgerloom.sources.rows import ExportError

#: Encodings of export files with their endings; each may be gzipped.
FORMATS = {"csv": ".csv", "json": ".json", "jsonl": ".jsonl"}


def encoding(name: str, key: str) -> str:
    """csv, json or jsonl of a format like 'csv-raw' or 'jsonl-gzip'; the key must end accordingly."""
    kind, _, packing = name.partition("-")
    if kind not in FORMATS or packing not in ("raw", "gzip") or not key.endswith(FORMATS[kind] + (".gz" if packing == "gzip" else "")):
        raise ExportError("a file of an unknown format, or whose ending contradicts it")
    return kind


def local_key(key: object) -> str:
    """A key as a relative path that cannot leave its folder."""
    if not isinstance(key, str) or not 0 < len(key) <= 4096 or set(key) & set("\\:\0") or any(part in ("", ".", "..") for part in key.split("/")):
        raise ExportError("a key is no plain relative path")
    return key


def parse_manifest(text: str) -> dict:
    """A manifest: project, window and files (key, table, format, size_bytes, row_count); raises ExportError if it is no such thing."""

    def once(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ExportError("a member is named twice")
        return out

    def whole(value: object) -> int:
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 63:
            raise ExportError("a size or count is no whole number")
        return value

    try:
        m = json.loads(text, object_pairs_hook=once)
        window = m["window"]
        start, end = (datetime.fromisoformat(window[k].replace("Z", "+00:00")) for k in ("minTimestamp", "maxTimestamp"))
        files = [
            {"key": local_key(f["key"]), "table": f.get("table", "observations_v2"), "kind": encoding(f["format"], f["key"]), "size_bytes": whole(f["sizeBytes"]), "row_count": whole(f["rowCount"])}
            for f in m["files"]
        ]
        project = m["projectId"]
    except ExportError:
        raise
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise ExportError("not a manifest") from error
    if m.get("version") != 1 or end <= start or len({f["key"] for f in files}) != len(files) or len(files) > 1000 or not isinstance(project, str) or not project:
        raise ExportError("not a manifest of this version, or an empty window, or a file listed twice")
    return {"project_id": project, "start": start, "end": end, "files": files}


_TEXTS = ("id", "project_id", "type", "start_time", "end_time", "total_cost", "provided_model_name", "user_id", "session_id", "environment", "release", "trace_name", "prompt_name", "level")


def _records(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    """``path``, the text fields, ``usage`` and ``tags`` (JSON text) and ``fits`` of the records of files of one encoding."""
    path = F.col("_metadata.file_path").alias("path")
    if kind == "csv":
        first = spark.read.text(paths[0]).head(1)
        names = header_names(first[0][0].rstrip("\r").removeprefix("\ufeff")) if first else None
        if not names or len(set(names)) != len(names) or not {"id", "project_id", "start_time"} <= set(names):
            raise ExportError("an observation file without its header")
        reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", False).option("columnNameOfCorruptRecord", "__bad")
        raw = reader.schema(", ".join(f"`{n}` string" for n in [*names, "__bad"])).csv(paths)
        cell = lambda n: F.col(f"`{n}`") if n in names else F.lit(None).cast("string")
        return raw.select(path, *[cell(n).alias(n) for n in _TEXTS], cell("usage_details").alias("usage"), cell("tags").alias("tags"), F.col("__bad").isNull().alias("fits"))
    if kind == "json":
        whole = spark.read.option("wholetext", True).text(paths).select(path, F.try_parse_json("value").alias("v"))
        listed = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
        rows = whole.select("path", F.explode(F.coalesce(listed, F.array(F.parse_json(F.lit("null"))))).alias("o"))
    else:
        rows = spark.read.text(paths).filter(F.trim("value") != "").select(path, F.try_parse_json("value").alias("o"))
    one = F.coalesce(F.schema_of_variant("o").startswith("OBJECT"), F.lit(False))
    get = lambda n: F.try_variant_get("o", f"$.{n}", "string").alias(n)
    return rows.select("path", *[get(n) for n in _TEXTS], F.to_json(F.try_variant_get("o", "$.usage_details", "variant")).alias("usage"), F.to_json(F.try_variant_get("o", "$.tags", "variant")).alias("tags"), one.alias("fits"))


def read_observations(spark: SparkSession, folder: str, manifest: dict) -> tuple[DataFrame, DataFrame]:
    """Observations of the listed files that are complete, and the status of every listed
    file: ``file_key, row_count, status``.

    Files are CSV, JSON arrays or JSON lines, gzipped or not. A file that is missing, whose
    size or row count is not the listed one, in which a record does not parse (or names a
    member twice), or that holds a record of another project or outside the manifest's
    window (its ends included) gives no rows at all.
    """
    files = manifest["files"]
    listed = spark.createDataFrame([(f["key"], f["table"], f["kind"], f["size_bytes"], f["row_count"]) for f in files], "file_key string, table string, kind string, size_bytes bigint, row_count bigint")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("p"), "length")  # lists the folder; contents are not read
    base = regexp_escape(folder.rstrip("/").removeprefix("file:").lstrip("/"))
    relative = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), rf"^(?:file:)?/*{base}/", "")
    sized = listed.join(there.select(relative(F.col("p")).alias("file_key"), "length"), "file_key", "left")
    found = {r.file_key: r.length for r in sized.select("file_key", "length").collect()}  # at most as many as a manifest lists
    whole = [f for f in files if found[f["key"]] == f["size_bytes"] and f["table"] == "observations_v2"]
    parts = [_records(spark, kind, [f"{folder.rstrip('/')}/{f['key']}" for f in whole if f["kind"] == kind and f["size_bytes"]]) for kind in FORMATS if any(f["kind"] == kind and f["size_bytes"] for f in whole)]
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], "path string, " + ", ".join(f"{n} string" for n in (*_TEXTS, "usage", "tags")) + ", fits boolean")
    at = F.col("start_time").try_cast("timestamp")
    bounds = [F.lit(manifest[k]).cast("timestamp") for k in ("start", "end")]
    inside = F.coalesce((F.col("project_id") == manifest["project_id"]) & (at >= bounds[0]) & (at <= bounds[1]), F.lit(False))
    rows = rows.withColumn("file_key", relative(F.col("path"))).withColumn("inside", inside)
    seen = rows.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("fits").alias("fits"), F.bool_and("inside").alias("inside"))
    state = (
        F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size_bytes"), "size_differs").when(F.col("table") != "observations_v2", "other_table")
        .when(F.coalesce("n", F.lit(0)) != F.col("row_count"), F.when(F.col("fits"), "row_count_differs").otherwise("does_not_parse")).when(~F.coalesce("fits", F.lit(True)), "does_not_parse")
        .when(~F.coalesce("inside", F.lit(True)), "outside").otherwise("complete")
    )
    state = F.when(F.col("length").isNotNull() & (F.col("length") == F.col("size_bytes")) & (F.col("n").isNull()) & (F.col("row_count") > 0) & (F.col("table") == "observations_v2"), "row_count_differs").otherwise(state)
    status = sized.join(seen, "file_key", "left").select("file_key", "row_count", state.alias("status"))
    good = status.filter("status = 'complete'").select("file_key")
    usage = F.transform_values(F.try_variant_get(F.try_parse_json("usage"), "$", "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "bigint"))
    kept = rows.join(good, "file_key", "left_semi")
    return kept.select("file_key", *[c for c in _TEXTS if c != "total_cost"], F.col("total_cost").try_cast("double").alias("total_cost"), usage.alias("usage_details"), F.try_variant_get(F.try_parse_json("tags"), "$", "array<string>").alias("tags")), status


def regexp_escape(text: str) -> str:
    return re.sub(r"([^\w/])", r"\\\1", text)


SNAPSHOT = (
    "producer_id string, epoch bigint, sequence bigint, window_start_unix_nano bigint, window_duration_unix_nano bigint, emitted_at_unix_nano bigint, counters map<string,bigint>"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Summary snapshots, one JSON document in each file; documents that are none raise ExportError."""
    docs = spark.read.option("wholetext", True).text(path).select(F.from_json("value", SNAPSHOT, {"mode": "PERMISSIVE"}).alias("s"))
    rows = docs.select("s.*")
    if rows.filter("producer_id is null or sequence is null or window_start_unix_nano is null").head(1):
        raise ExportError("not a summary snapshot")
    at = lambda c: F.timestamp_micros(F.expr(f"{c} div 1000"))
    return rows.select(
        F.col("producer_id").alias("producer"), "epoch", at("window_start_unix_nano").alias("window_start"), F.expr("window_duration_unix_nano div 1000000000").alias("window_seconds"),
        "sequence", at("emitted_at_unix_nano").alias("emitted_at"), "counters",
    )


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
TRACES = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES}>>>>>>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Spans of OTLP JSON captures (one request in each file) with their attributes
    as text; an attribute of the span holds before one of its resource. Spans
    with ids of other lengths than 16 and 8 bytes in hex are left out; a capture in which
    an attribute key is repeated, alike or not, is refused (ExportError)."""
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", TRACES).alias("d"))
    r = doc.select(F.explode("d.resourceSpans").alias("r"))
    s = r.select("r.resource.attributes", F.explode("r.scopeSpans").alias("s")).select(F.col("attributes").alias("ra"), F.explode("s.spans").alias("p"))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast(_ATTRIBUTES)), lambda a: a["key"])
    twice = lambda c: F.size(F.array_distinct(keys(c))) != F.size(keys(c))
    if s.filter(twice(F.col("ra")) | twice(F.col("p.attributes"))).head(1):
        raise ExportError("an attribute key is repeated")
    pairs = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), text(a["value"]).alias("value"))))
    own, of = pairs(F.col("p.attributes")), pairs(F.col("ra"))
    rest = F.map_filter(of, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    hexed = (F.length("p.traceId") == 32) & (F.length("p.spanId") == 16) & F.col("p.traceId").rlike("^[0-9a-fA-F]+$") & F.col("p.spanId").rlike("^[0-9a-fA-F]+$")
    return s.filter(hexed).select(
        F.lower("p.traceId").alias("trace_id"), F.lower("p.spanId").alias("span_id"), F.lower("p.parentSpanId").alias("parent_id"), "p.name",
        F.col("p.startTimeUnixNano").try_cast("bigint").alias("start_nano"), F.col("p.endTimeUnixNano").try_cast("bigint").alias("end_nano"), F.map_concat(own, rest).alias("attributes"),
    )


#: Attributes that name a person, session, prompt or call, and those identities are taken from, in order.
SENSITIVE = (
    "enduser.id", "user.id", "gen_ai.conversation.id", "session.id", "gen_ai.request.prompt", "gen_ai.tool.call.id", "mcp.session.id", "mcp.resource.uri", "jsonrpc.request.id",
)
IDENTITIES = {"user": ("enduser.id", "user.id"), "session": ("gen_ai.conversation.id", "session.id"), "prompt": ("gen_ai.request.prompt",)}
#: Distinct values from which a label has many.
MANY = 1000


def attribute_cardinality(spans: DataFrame) -> DataFrame:
    """Spans and distinct values of each attribute (HyperLogLog), whether it reads like a label
    of many values, and the ``risk`` of using it as one; the most values first."""
    x = spans.select(F.explode("attributes").alias("label", "value"))
    g = x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value", 0.01).alias("values"))
    risk = F.when(F.col("label").isin(*SENSITIVE), "sensitive_identifier").when(F.col("values") >= MANY, "high_cardinality").otherwise("review")
    return g.withColumn("many", F.col("values") >= MANY).withColumn("risk", risk).orderBy(F.desc("values"), "label")


def _model_attempts(spans: DataFrame) -> DataFrame:
    a = F.col("attributes")
    at = lambda n: F.try_element_at(a, F.lit(n))
    model = at("gen_ai.operation.name").isin("chat", "generate_content", "text_completion", "embeddings") | (at("gen_ai.operation.name").isNull() & at("gen_ai.request.model").isNotNull())
    number = lambda n: F.when(at(n).rlike(r"\A[0-9]+\z"), at(n).try_cast("bigint"))
    named = [F.coalesce(*[F.nullif(at(n), F.lit("")) for n in names]).alias(k) for k, names in IDENTITIES.items()]
    origin = at("gen_ai_sketch.usage.input.provenance").isNotNull() & at("gen_ai_sketch.usage.output.provenance").isNotNull()
    return spans.filter(model).select(*named, number("gen_ai.usage.input_tokens").alias("input"), number("gen_ai.usage.output_tokens").alias("output"), origin.alias("origin"))


def identity_coverage(spans: DataFrame) -> DataFrame:
    """``identity, attempts, present, members, with_tokens, tokens``: how many model attempts
    name each kind of identity, how many distinct ones there are (HyperLogLog), and the tokens of
    those attempts that also have both counts."""
    x = _model_attempts(spans)
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("identity"), F.col(k).alias("member")) for k in IDENTITIES])).alias("x")
    both = F.col("input").isNotNull() & F.col("output").isNotNull() & F.col("member").isNotNull()
    return x.select(pair, "input", "output").select("x.*", "input", "output").groupBy("identity").agg(
        F.count(F.lit(1)).alias("attempts"), F.count("member").alias("present"), F.approx_count_distinct("member", 0.008).alias("members"),
        F.count_if(both).alias("with_tokens"), F.coalesce(F.sum(F.when(both, F.col("input") + F.col("output"))), F.lit(0)).cast("bigint").alias("tokens"),
    )


def readiness(spans: DataFrame) -> DataFrame:
    """``question, covered, attempts, status``: which questions a capture can answer: ready where
    all model attempts have what it takes, partial where some, else cannot_determine."""
    x = _model_attempts(spans)
    usage = F.col("input").isNotNull() & F.col("output").isNotNull()
    asked = {
        "model_activity": F.lit(True), "token_usage": usage, "usage_origin": F.col("origin"), "distinct_users": F.col("user").isNotNull(), "top_users_by_tokens": F.col("user").isNotNull() & usage,
        "session_rankings": F.col("session").isNotNull(), "prompt_rankings": F.col("prompt").isNotNull(),
    }
    one = x.agg(F.count(F.lit(1)).alias("attempts"), *[F.count_if(c).alias(n) for n, c in asked.items()])
    rows = one.select("attempts", F.explode(F.array(*[F.struct(F.lit(n).alias("question"), F.col(n).alias("covered")) for n in asked])).alias("q")).select("q.question", "q.covered", "attempts")
    status = F.when(F.col("covered") == 0, "cannot_determine").when(F.col("covered") == F.col("attempts"), "ready").otherwise("partial")
    return rows.withColumn("status", status)


def operation_mix(spans: DataFrame) -> DataFrame:
    """Spans of each kind of operation."""
    op = F.col("attributes")["gen_ai.operation.name"]
    kind = (
        F.when(op.isin("chat", "generate_content", "text_completion", "embeddings") | (op.isNull() & F.col("attributes")["gen_ai.request.model"].isNotNull()), "model")
        .when(op.isin("invoke_agent", "create_agent"), "agent").when(op == "execute_tool", "tool").when(op == "retrieval", "retrieval").otherwise("other")
    )
    return spans.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("spans"))
