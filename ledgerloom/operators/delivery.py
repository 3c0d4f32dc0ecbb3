"""Exactly one copy of each message out of at-least-once deliveries.

An aggregation by message identifier keeps, with ``min_by`` over a struct of delivery
order, delivery time and tie-break, the delivery that stays. Every map task reduces
its own copies first: a message that makes up a third of all rows leaves each task as
one row and no reducer ever sees the copies. To name the repeated rows the aggregate
carries row keys only; to keep whole rows it carries them, which takes one scan and
no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold

_KEPT = "__kept_row_key"


def _rank(row_key: str, order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row_key).alias("tie"))


def kept_deliveries(df: DataFrame, row_key: str, identity: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Row keys of the delivery kept of each message.

    ``identity``: expressions that are equal for copies of one message. The first
    must not be null (rows where it is null have no identity and are not
    looked at); a null in the others is a value like any other.
    ``order``: the delivery with the least struct of these stays; nulls sort
    first, and the row key breaks remaining ties, so the result is the same for
    every partitioning of the input.
    """
    named = [c.alias(f"k{i}") for i, c in enumerate(identity)]
    keyed = df.filter(identity[0].isNotNull()).select(*named, F.col(row_key).alias("row_key"), _rank(row_key, order).alias("rank"))
    return keyed.groupBy(*[f"k{i}" for i in range(len(named))]).agg(F.min_by("row_key", "rank").alias(_KEPT)).select(_KEPT)


def repeated_deliveries(df: DataFrame, row_key: str, identity: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The rows of ``df`` that repeat a message of which another delivery is kept."""
    kept = kept_deliveries(df, row_key, identity, order)
    return df.filter(identity[0].isNotNull()).join(kept, F.col(row_key) == F.col(_KEPT), "left_anti")


def deduplicated(df: DataFrame, row_key: str, identity: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """``df`` with one delivery of each message, whole rows; rows without identity all
    stay (each counts as a message of its own)."""
    lone = F.when(identity[0].isNull(), F.col(row_key))
    added = [*identity, lone, _rank(row_key, order)]
    wide = df.select("*", *added)
    n = len(df.columns)
    wide = wide.toDF(*[f"c{i}" for i in range(n)], *[f"k{i}" for i in range(len(identity) + 1)], "rank")  # by place: names may clash
    row = F.struct(*[f"c{i}" for i in range(n)])
    kept = wide.groupBy(*[f"k{i}" for i in range(len(identity) + 1)]).agg(F.min_by(row, "rank").alias("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])


def observation_identity() -> list[Column]:
    """``id`` within ``project_id``, apart from surrounding white space and letter case."""
    return [fold(F.col("id")), fold(F.col("project_id"))]


def observation_order() -> list[Column]:
    """Deliveries are numbered in the order they came in; the time of delivery settles a number given twice."""
    return [F.col("delivery_id"), F.col("ingested_at")]
