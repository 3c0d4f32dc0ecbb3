"""Queries of the llm problems over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACES
from ledgerloom.llm import distinct, quantiles
from ledgerloom.llm.encode import encoded, reuse
from ledgerloom.llm.frequent import frequent
from ledgerloom.llm.leaks import leaks, removal_spans
from ledgerloom.llm.sentences import sentences
from ledgerloom.operators.timestamps import normalised, zone_owners
from ledgerloom.session import read

#: Percentiles that are reported.
QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def _dated(spark: SparkSession, sf: str, keep: list[str]) -> DataFrame:
    """``synthetic`` with ``day``, the UTC date of ``startTime`` (null if it names no instant)."""
    owners = zone_owners(read(spark, sf, "time_zones"), "organization")
    utc = normalised(read(spark, sf, "synthetic"), "startTime", "organization_id", owners, keep, keep_blank=True)
    return utc.select(*keep, F.to_date("instant").alias("day"))


def p3_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each model and day."""
    rows = _dated(spark, sf, ["model", "total_tokens", "spend"])
    return quantiles.percentiles(rows, ["day", "model"], ["total_tokens", "spend"], QUANTILES)


def _models(rows: DataFrame) -> DataFrame:
    keys = ["day", "model"]
    days = quantiles.merged(quantiles.partial_sketches(rows, keys, ["total_tokens", "spend"]), keys)
    return quantiles.evaluated(quantiles.rolled_up(days, keys, "day", F.coalesce(F.unix_date("day"), F.lit(-1_000_000))), ["model"], QUANTILES)


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each model over all days, from the merged sketches of its days."""
    return _models(_dated(spark, sf, ["model", "total_tokens", "spend"]))


def p3_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each percentile of ``p3_percentiles`` holds its stated error against exact ranks over all rows."""
    got = _models(_dated(spark, sf, ["model", "total_tokens", "spend"]))
    exact = quantiles.ranks(read(spark, sf, "synthetic"), ["model"], ["total_tokens", "spend"], got)
    slack = F.col("rank_error") * F.col("n") + 1
    within = (F.col("below") - slack < F.col("q") * F.col("n")) & (F.col("q") * F.col("n") <= F.col("upto") + slack)
    return exact.select("model", "metric", "n", "q", within.alias("within"))


def p4_frequent(spark: SparkSession, sf: str) -> DataFrame:
    """All values above one percent with their counts and the summaries' estimates."""
    return frequent(read(spark, sf, "synthetic"), ["api_key", "user", "end_user"], 0.01)


def p4_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same without the summaries' estimates."""
    return p4_frequent(spark, sf).select("field", "value", "n", "rows")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_frequent(spark, sf).select("field", "value")


def p6_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keys, sessions and teams of each day, team, model and combination."""
    rows = _dated(spark, sf, ["api_key", "session_id", "team_id", "model"])
    rows = distinct.composed(rows.select("day", F.col("team_id").alias("team"), "model", "api_key", "session_id", "team_id"), ["team", "api_key", "session_id", "team_id"])
    return distinct.distinct_counts(rows, ["day", "team", "model"], ["api_key", "session_id", "team_id"])


def p6_exported(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the day of the export, on the values as they stand, which SQL can count exactly."""
    rows = read(spark, sf, "synthetic").select(F.to_date("exported_at").alias("day"), F.col("team_id").alias("team"), "model", "api_key", "session_id")
    counts = distinct.distinct_counts(rows, ["day", "team", "model"], ["api_key", "session_id"])
    return counts.select("grouped", "day", "team", "model", "n_api_key", "n_session_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(read(spark, sf, "documents"))


def p8_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks shared and joins repaired, by declared language."""
    return reuse(read(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read(spark, sf, "documents"), read(spark, sf, "eval_items"))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches of text to remove from each document."""
    return removal_spans(read(spark, sf, "documents"), read(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(read(spark, sf, "documents"))


QUERIES = {q.__name__: q for q in (p3_percentiles, p3_days, p3_ranks, p4_found, p4_frequent, p4_exact, p6_distinct, p6_exported, p8_ids, p8_reuse, p9_found, p9_spans, p10_found)}

_CHARS = "||".join(f"chr({ord(c)})" for c in SPACES)
_VALUES = " UNION ALL ".join(f"""SELECT '{f}' AS field, nfc_normalize(trim("{f}", {_CHARS})) AS value FROM synthetic""" for f in ("api_key", "user", "end_user"))
_METRICS = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, count({m}) AS n FROM synthetic GROUP BY model HAVING count({m}) > 0" for m in ("total_tokens", "spend"))
_FREQUENT = f"""WITH v AS (SELECT field, value FROM ({_VALUES}) WHERE value <> ''), n AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL)
SELECT field, value, n, CAST(rows AS BIGINT) AS rows FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS rows FROM n) WHERE n > 0.01 * rows"""
SQL: dict[str, str] = {
    "p3_ranks": f"SELECT model, metric, n, q, true AS within FROM ({_METRICS}), (SELECT unnest({QUANTILES}::DOUBLE[]) AS q)",
    "p6_exported": """SELECT concat_ws(',', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(team) = 0 THEN 'team' END, CASE WHEN grouping(model) = 0 THEN 'model' END) AS grouped,
day, team, model, count(DISTINCT api_key) AS n_api_key, count(DISTINCT session_id) AS n_session_id
FROM (SELECT CAST(exported_at AS DATE) AS day, team_id AS team, model, api_key, session_id FROM synthetic) GROUP BY CUBE (day, team, model) HAVING count(api_key) + count(session_id) > 0""",
    "p4_found": f"SELECT field, value FROM ({_FREQUENT})",
    "p4_exact": _FREQUENT,
}
