"""Readers of a provider's counts, their contract and the map of model names; each refuses what it cannot be sure of."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.accounting import unsigned
from ledgerloom.functions.text import strip
from ledgerloom.operators.providers import BASES, STATES, Contract
from ledgerloom.sources.rows import ExportError, header_of

#: Columns of both files, members of the contract and of its population, and the contract's schema name.
COUNTS, MORE_COUNTS = ("date_utc", "provider", "provider_model", "requests"), ("input_tokens", "output_tokens")
MAPPING = ("source_provider", "source_model", "provider", "provider_model")
MEMBERS = ("schema", "start_utc", "end_exclusive_utc", "retrieved_at_utc", "pagination_complete", "population", "count_basis", "counting_units_match", "token_units_match")
POPULATION = ("account", "project_or_workspace", "region_set", "gateway", "operation")
CONTRACT_SCHEMA = re.compile(r"[a-z]+-provider-counts/v1")


def _table(spark: SparkSession, path: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    names = header_of(spark, path)
    if len(set(names)) != len(names) or not set(required) <= set(names) <= {*required, *optional}:
        raise ExportError("the columns must be " + ", ".join(required) + (" and may be " + ", ".join(optional) if optional else ""))
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").schema(schema).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in (*required, *optional)])


def _named(column: str):
    """An identity: 1 to 256 bytes without surrounding white space or control characters."""
    c = F.col(column)
    return c.isNotNull() & (c != "") & (F.octet_length(c) <= 256) & (strip(c) == c) & ~c.rlike(r"\p{Cntrl}")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``day, provider, provider_model, requests, input_tokens, output_tokens``; an empty count is
    null. Raises ExportError for other columns, invalid cells or a key listed twice."""
    raw = _table(spark, path, COUNTS, MORE_COUNTS)
    numbers = {c: unsigned(F.col(c)) for c in ("requests", *MORE_COUNTS)}
    day = F.when(F.col("date_utc").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.col("date_utc").try_cast("date"))
    bad = day.isNull() | ~_named("provider") | ~_named("provider_model")
    for c, v in numbers.items():
        bad = bad | ((F.col(c) != "") & v.isNull())
    rows = raw.select(day.alias("day"), "provider", "provider_model", *[v.alias(c) for c, v in numbers.items()], F.coalesce(bad, F.lit(True)).alias("bad"))
    if rows.filter("bad").head(1) or rows.groupBy("day", "provider", "provider_model").count().filter("count > 1").head(1):
        raise ExportError("provider counts with invalid or repeated rows")
    return rows.drop("bad")


def read_model_map(spark: SparkSession, path: str, counts: DataFrame | None = None) -> DataFrame:
    """Pairs of source names to pairs of the provider's; a source listed twice alike counts once,
    one listed with two targets is refused. ``counts`` (if given): a source that names a model
    they list exactly may not be mapped to another."""
    rows = _table(spark, path, MAPPING)
    bad = ~(_named("source_provider") & _named("source_model") & _named("provider") & _named("provider_model"))
    if rows.filter(bad).head(1):
        raise ExportError("a model map with invalid names")
    rows = rows.distinct()
    if rows.groupBy("source_provider", "source_model").count().filter("count > 1").head(1):
        raise ExportError("a source model is mapped to two targets")
    if counts is not None:
        known = counts.select(F.col("provider").alias("p"), F.col("provider_model").alias("m")).distinct()
        exact = F.concat("p", F.lit("/"), "m")
        other = (F.col("provider") != F.col("p")) | (F.col("provider_model") != F.col("m"))
        if rows.join(known, (F.col("source_provider") == F.col("p")) & (F.col("source_model") == exact)).filter(other).head(1):
            raise ExportError("a model the counts list by its own name is mapped to another")
    return rows


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ExportError("a member is named twice")
    return out


def parse_contract(text: str, now: datetime) -> Contract:
    """A contract out of its JSON text (8 KiB at most); ``now`` is naive UTC."""

    def time(value: object) -> datetime:
        if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)", value):
            raise ExportError("times of a contract are UTC")
        t = datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)
        if not 1970 <= t.year <= 2200 or t > now:
            raise ExportError("a time of the contract lies outside its bounds")
        return t

    try:
        if len(text.encode()) > 8192:
            raise ExportError("a contract has 8 KiB at most")
        c = json.loads(text, object_pairs_hook=_once)
        margin = c.get("settlement_margin_seconds", 0)
        if set(c) - {"settlement_margin_seconds"} != set(MEMBERS) or set(c["population"]) != set(POPULATION) or not CONTRACT_SCHEMA.fullmatch(c["schema"]):
            raise ExportError("a contract lacks members or has others")
        flags = [c[k] for k in ("pagination_complete", "counting_units_match", "token_units_match")]
        if not all(isinstance(f, bool) for f in flags) or isinstance(margin, bool) or not isinstance(margin, int) or margin < 0:
            raise ExportError("a member of the contract has the wrong type")
        start, end, retrieved = (time(c[k]) for k in ("start_utc", "end_exclusive_utc", "retrieved_at_utc"))
        states = tuple(c["population"][k] for k in POPULATION)
        if not set(states) <= set(STATES) or c["count_basis"] not in BASES or (c["count_basis"] == "tokens_only" and flags[1]):
            raise ExportError("a state or basis of the contract is unknown")
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise error if isinstance(error, ExportError) else ExportError("not a contract") from error
    day = lambda t: (t.hour, t.minute, t.second, t.microsecond) == (0, 0, 0, 0)
    if not (start < end and day(start) and day(end) and retrieved >= end):
        raise ExportError("a contract covers whole days, and its counts are retrieved after them")
    return Contract(start, end, retrieved, flags[0], states, c["count_basis"], flags[1], flags[2], margin)
