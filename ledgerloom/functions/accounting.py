"""Token and spend accounting of usage rows as column expressions.

Everything here is per row and stays within code generation: three-way
known/missing/invalid states of each count, quality flags, and exact decimals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Call types that are analysed, by operation.
CHAT = ("completion", "acompletion", "anthropic_messages", "aanthropic_messages", "responses", "aresponses")
COMPLETION = ("text_completion", "atext_completion")
#: Observation levels that ask for no review, and names that stand for no model (case matters).
CALM_LEVELS = ("DEFAULT", "DEBUG", "WARNING")
PLACEHOLDERS = ("unknown", "Unknown", "unknown_model", "__unknown__", "__other__", "__missing__", "__unmapped__", "__overflow__")
#: Fixed value: the spelling of an amount of money.
MONEY = r"^[0-9]{1,19}(\.[0-9]{1,20})?([eE][+-]?[0-9]{1,3})?$"
MONEY_TYPE = "decimal(38,18)"
COUNTS = {
    "input": "prompt_tokens", "output": "completion_tokens", "cache_read": "cache_read_input_tokens",
    "cache_write": "cache_write_input_tokens", "reasoning": "reasoning_output_tokens",
}
FLAGS = ("missing", "invalid", "total_mismatch", "total_missing", "zero_only", "failed", "unknown_status", "error_level", "unclear", "spend_missing", "spend_invalid", "spend_zero")


def empty(col: Column) -> Column:
    """Null and '' are one state: no value."""
    return col.isNull() | (col == "")


def blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def unsigned(col: Column) -> Column:
    """Digits only, as bigint; null for anything else and beyond 2**63 - 1 (a bare cast would take signs and spaces)."""
    return F.when(col.rlike("^[0-9]+$"), col.try_cast("bigint"))


def money(col: Column) -> Column:
    """An amount of money exactly; null if it is spelled otherwise or above 10**18."""
    value = F.when((F.length(col) <= 48) & col.rlike(MONEY), col.try_cast(MONEY_TYPE))
    return F.when(value <= F.lit(10**18), value)


def operation(call_type: Column) -> Column:
    return F.when(call_type.isin(*CHAT), "chat").when(call_type.isin(*COMPLETION), "text_completion")


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` with counts (null: not known), quality flags (0/1), ``total``,
    ``amount`` and ``operation``.

    A count is missing where its cell is empty or not a count; input and output
    together beyond 2**63 - 1 are invalid. Cache and reasoning counts are parts of
    input and output and may not exceed them. A row is unclear if anything about
    its usage or status needs review.
    """
    counts = {n: unsigned(F.col(c)) for n, c in COUNTS.items()}
    rows = rows.select("*", *[v.alias(n) for n, v in counts.items()])
    rows = rows.withColumn("overflow", F.try_add("input", "output").isNull() & F.col("input").isNotNull() & F.col("output").isNotNull())
    rows = rows.withColumns({n: F.when(~F.col("overflow"), F.col(n)) for n in ("input", "output")})
    bad = [~empty(F.col(c)) & F.col(n).isNull() for n, c in COUNTS.items()]
    over = [F.coalesce(F.col(part) > F.col(whole), F.lit(False)) for part, whole in (("cache_read", "input"), ("cache_write", "input"), ("reasoning", "output"))]
    said = unsigned(F.col("total_tokens"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns(
        {
            "total": F.coalesce("input", zero) + F.coalesce("output", zero), "operation": operation(F.col("call_type")),
            "missing": flag(F.col("input").isNull() | F.col("output").isNull()),
            "invalid": flag(_any(*bad, *over, ~empty(F.col("total_tokens")) & said.isNull())),
            "total_missing": flag(empty(F.col("total_tokens"))), "failed": flag(F.col("status") == "failure"),
            "unknown_status": flag(F.col("status").isNull() | ~F.col("status").isin("success", "failure")), "error_level": flag(F.col("level") == "ERROR"),
            "amount": money(F.col("spend")), "spend_missing": flag(empty(F.col("spend"))),
        }
    )
    review = F.when(empty(F.col("level")), F.col("unknown_status")).when(F.col("level").isin(*CALM_LEVELS, "ERROR"), F.lit(0)).otherwise(1)
    review = F.when(F.col("level") == "ERROR", F.col("unknown_status")).otherwise(review)
    rows = rows.withColumns(
        {
            "total_mismatch": flag(said != F.col("total")), "zero_only": flag((F.col("missing") == 0) & (F.col("invalid") == 0) & (F.col("total") == 0)),
            "spend_invalid": flag((F.col("spend_missing") == 0) & F.col("amount").isNull()), "spend_zero": flag(F.col("amount") == 0),
        }
    )
    sure = [F.col(f) == 1 for f in ("missing", "invalid", "total_mismatch", "total_missing", "zero_only", "failed", "error_level")]
    return rows.withColumn("unclear", flag(_any(*sure, review == 1, F.col("end_time").isNull())))


#: :func:`classified` for DuckDB, over the common table expression ``usage``.
SQL = """counted AS (SELECT *, {counts}, CAST(CASE WHEN length(spend) <= 48 AND regexp_matches(spend, '{money}') THEN TRY_CAST(spend AS DECIMAL(38,18)) END AS DECIMAL(38,18)) AS amount,
  CASE WHEN regexp_full_match(total_tokens, '[0-9]+') THEN TRY_CAST(total_tokens AS BIGINT) END AS said FROM usage),
flagged AS (SELECT *, coalesce(input, 0) + coalesce(output, 0) AS total,
  CASE WHEN call_type IN ('completion','acompletion','anthropic_messages','aanthropic_messages','responses','aresponses') THEN 'chat' WHEN call_type IN ('text_completion','atext_completion') THEN 'text_completion' END AS operation,
  CAST(input IS NULL OR output IS NULL AS INT) AS missing,
  CAST({bad} OR coalesce(cache_read > input, false) OR coalesce(cache_write > input, false) OR coalesce(reasoning > output, false) OR (coalesce(total_tokens, '') <> '' AND said IS NULL) AS INT) AS invalid,
  CAST(coalesce(total_tokens, '') = '' AS INT) AS total_missing, CAST(coalesce(status = 'failure', false) AS INT) AS failed,
  CAST(coalesce(status NOT IN ('success', 'failure'), true) AS INT) AS unknown_status, CAST(coalesce(level = 'ERROR', false) AS INT) AS error_level,
  CAST(coalesce(spend, '') = '' AS INT) AS spend_missing FROM counted),
reviewed AS (SELECT *, CAST(coalesce(said <> total, false) AS INT) AS total_mismatch, CAST(missing = 0 AND invalid = 0 AND total = 0 AS INT) AS zero_only,
  CAST(spend_missing = 0 AND amount IS NULL AS INT) AS spend_invalid, CAST(coalesce(amount = 0, false) AS INT) AS spend_zero,
  CASE WHEN coalesce(level, '') IN ('', 'ERROR') THEN unknown_status WHEN level IN ('DEFAULT', 'DEBUG', 'WARNING') THEN 0 ELSE 1 END AS review FROM flagged),
classified AS (SELECT *, CAST(missing + invalid + total_mismatch + total_missing + zero_only + failed + error_level + review > 0 OR end_time IS NULL AS INT) AS unclear FROM reviewed)""".format(
    counts=", ".join(f"CASE WHEN regexp_full_match({c}, '[0-9]+') THEN TRY_CAST({c} AS BIGINT) END AS {n}" for n, c in COUNTS.items()),
    bad=" OR ".join(f"(coalesce({c}, '') <> '' AND {n} IS NULL)" for n, c in COUNTS.items()),
    money=MONEY,
)
