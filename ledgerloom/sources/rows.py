"""Readers of exported request rows: CSV, JSON arrays, JSON lines and Parquet.

All cells stay text (their spelling is part of the evidence); columns that an
export lacks come out null. Files are read by Spark in parallel; only headers
are looked at on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REQUIRED = ("request_id", "call_type", "startTime", "prompt_tokens", "completion_tokens", "total_tokens")
OPTIONAL = (
    "api_key", "user", "team_id", "organization_id", "end_user", "model", "model_id", "model_group", "custom_llm_provider", "spend", "status", "session_id", "endTime",
    "cache_read_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens", "agent_id", "rejection_kind", "request_tags",
    "original_model_group", "attempted_fallbacks", "internal_call_origin",
)
#: RFC 3339 with zone, as exports spell times.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"


class ExportError(ValueError):
    """An export that is not one of request rows."""


def check_columns(columns: list[str]) -> None:
    """Raise unless the columns are those of request rows, each named once."""
    if len(set(columns)) != len(columns):
        raise ExportError("a column is named twice")
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        if {"date", "api_requests"} & set(columns):
            raise ExportError("daily aggregates instead of request rows")
        raise ExportError("missing columns: " + ", ".join(missing))


_PLACE = "__place"


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` of files with a number that orders them by file and place in it, however the
    scan is split: files in the order of a hash of their paths, rows of one by the start of
    their block and their order there."""
    file = F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << 22) - 1))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(_PLACE, F.shiftleft(file, 41) + F.col("_metadata.file_block_start") + within)


def canonical(rows: DataFrame) -> DataFrame:
    """Allow-listed columns as text with ``row_number`` in an order that does not depend on
    how files are split (see :func:`placed`; of other sources in reading order), parsed
    times, and ``level``; other columns are not read at all."""
    have = set(rows.columns)
    text = [(F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in (*REQUIRED, *OPTIONAL)]
    number = F.col(_PLACE) if _PLACE in have else F.monotonically_increasing_id()
    x = rows.select(*text, number.alias("row_number"))
    when = lambda c: F.when(F.col(c).rlike(RFC3339), F.col(c).try_cast("timestamp")).cast("timestamp_ntz")
    x = x.withColumns({"start_time": when("startTime"), "end_time": when("endTime"), "level": F.lit(""), "route": F.coalesce("original_model_group", "model_group")})
    return x


def header_of(spark: SparkSession, path: str) -> list[str]:
    from ledgerloom.operators.rejects import header_names

    first = spark.read.option("lineSep", "\n").text(path).filter("value <> ''").head(1)
    names = header_names(first[0][0].rstrip("\r").removeprefix("﻿")) if first else None
    if not names:
        raise ExportError("no header")
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RFC 4180 files with one header; a record with another number of cells fails the read."""
    names = header_of(spark, path)
    check_columns(names)
    schema = ", ".join(f"`{n}` string" for n in names)
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", True).option("emptyValue", "").option("nullValue", "\u0000")
    return canonical(placed(reader.schema(schema).csv(path)))


def _from_objects(objects: DataFrame) -> DataFrame:
    """``objects`` has ``o``, a variant. Members named twice make no object at all."""
    shape = objects.select(F.count_if(F.col("o").isNull()).alias("bad"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.try_variant_get("o", f"$.{c}", "variant").isNotNull()).alias(c) for c in REQUIRED]).first()
    if shape.bad:
        raise ExportError(f"{shape.bad} records are no JSON objects")
    if shape.n:
        check_columns([c for c in REQUIRED if shape[c]])
    return canonical(objects.select(*[F.try_variant_get("o", f"$.{c}", "string").alias(c) for c in (*REQUIRED, *OPTIONAL)], _PLACE))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files with one JSON object on each line."""
    return _from_objects(placed(spark.read.text(path)).filter(F.trim("value") != "").select(F.try_parse_json("value").alias("o"), _PLACE))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files that are each a JSON array of objects (a file is one task's work; prefer JSON lines for large exports)."""
    whole = placed(spark.read.option("wholetext", True).text(path)).select(F.try_parse_json("value").alias("v"), F.shiftright(_PLACE, 41).alias("file"))
    if whole.filter(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("ARRAY")).head(1):
        raise ExportError("not an array of request rows")
    items = whole.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "o"))
    return _from_objects(items.select("o", (F.shiftleft("file", 41) + F.col("at")).alias(_PLACE)))


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of an export of a given kind: csv, json, jsonl or parquet."""
    if kind == "parquet":
        rows = spark.read.parquet(path)
        check_columns(rows.columns)
        return canonical(placed(rows))
    return {"csv": read_csv, "json": read_json, "jsonl": read_jsonl}[kind](spark, path)


def check_ends(rows: DataFrame, now) -> None:
    """Raise unless every row that has an end began no later than it, and ended before ``now`` (naive
    UTC); an end that is no RFC 3339 time counts as a fault."""
    at = F.lit(now).cast("timestamp_ntz")
    given = F.col("endTime").isNotNull() & (F.col("endTime") != "")
    r = rows.agg(
        F.count_if(given & F.col("end_time").isNull()).alias("unreadable"), F.count_if(F.col("end_time") < F.col("start_time")).alias("early"), F.count_if(F.coalesce("end_time", "start_time") > at).alias("unfinished")
    ).first()
    faults = [f"{n} {name}" for name, n in r.asDict().items() if n]
    if faults:
        raise ExportError("ends of requests: " + ", ".join(faults))


def check_limits(rows: DataFrame, most_rows: int | None = None, most_bytes: int = 8192) -> None:
    """Raise if there are more rows than a policy allows, or a cell of more bytes; nothing is cut."""
    cells = [c for c in (*REQUIRED, *OPTIONAL) if c in rows.columns]
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*[F.octet_length(c) for c in cells], F.lit(0))).alias("longest")).first()
    if (most_rows is not None and r.n > most_rows) or (r.longest or 0) > most_bytes:
        raise ExportError("the export exceeds the limits set for it")


def repeated(rows: DataFrame, n: int, days: int = 16, keys: int | None = None) -> DataFrame:
    """``n`` rows made of a few (request rows of an export): each with an id of its own, spread over
    ``days`` days, and with ``keys`` api keys in turn (None: those of the rows)."""
    base = rows.select(*[c for c in rows.columns if c in (*REQUIRED, *OPTIONAL)])
    few = base.select(F.row_number().over(Window.orderBy("request_id")).alias("place"), "*")  # a fixture: a few rows
    size = few.count()
    many = rows.sparkSession.range(n).withColumn("place", (F.col("id") % size + 1).cast("int"))
    x = many.join(F.broadcast(few), "place") if size <= 10_000 else many.join(few, "place")
    shift = F.expr(f"make_dt_interval(cast(id % {int(days)} as int))")
    moved = lambda c: F.date_format(F.col(c).try_cast("timestamp") + shift, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias(c)
    changed = {"request_id": F.concat_ws("-", "request_id", "id").alias("request_id"), "startTime": moved("startTime"), "endTime": moved("endTime")}
    if keys is not None:
        changed["api_key"] = F.concat(F.lit("key-"), (F.col("id") % keys).cast("string")).alias("api_key")
    return x.select(*[changed.get(c, F.col(c)) for c in base.columns])


def read_jdbc(spark: SparkSession, url: str, table: str, start: str, end: str, partitions: int = 16, **options: str) -> DataFrame:
    """Rows of a database table between two times, read in parallel by time ranges (half-open, so no row twice)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    reader = reader.option("partitionColumn", "startTime").option("lowerBound", start).option("upperBound", end).option("numPartitions", partitions)
    rows = reader.load().filter((F.col("startTime") >= start) & (F.col("startTime") < end))
    return canonical(rows)


DAILY = ("date", "api_requests", "successful_requests", "failed_requests")


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Daily counts: four columns, dates named once, digits only."""
    names = header_of(spark, path)
    if sorted(names) != sorted(DAILY):
        raise ExportError("daily counts need the columns " + ", ".join(DAILY))
    raw = spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    rows = raw.select(F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date").try_cast("date")).alias("day"), *[F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("bigint")).alias(c) for c in DAILY[1:]])
    bad = rows.agg(F.count_if(F.col("day").isNull() | F.col("api_requests").isNull() | F.col("successful_requests").isNull() | F.col("failed_requests").isNull()).alias("bad"), (F.count("day") - F.count_distinct("day")).alias("twice")).first()
    if bad.bad or bad.twice:
        raise ExportError("daily counts with invalid or repeated rows")
    return rows
