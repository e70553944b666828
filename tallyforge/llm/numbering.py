"""Gapless global row numbers without a task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import saved

#: monotonically_increasing_id() holds the partition above so many bits and the place in it below.
PLACE_BITS = 33


def free(base: str) -> str:
    """A column name that no table has."""
    return f"{base}_{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows of df, written once, with `name`: 0, 1, 2, ... in the given order.

    The rows are sorted over all tasks, each partition numbers its own, and the starts of the partitions
    are sums of their counts: one small row for each task, which is also what is broadcast. Rows that are
    equal in `order` are dealt by an id of their own, so equal rows, however many, spread over partitions;
    which of them gets which number is not defined.
    """
    salt, at, part, rows = free("salt"), free("at"), free("part"), free("rows")
    kept = df.columns
    placed = saved(df.withColumn(salt, F.monotonically_increasing_id()).orderBy(*order, salt).select(*kept, F.monotonically_increasing_id().alias(at)))
    counts = placed.groupBy(F.shiftright(at, PLACE_BITS).alias(part)).agg(F.count("*").alias(rows))
    starts = counts.select(part, (F.sum(rows).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(rows)).alias(rows))
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn(part, F.shiftright(at, PLACE_BITS)).join(F.broadcast(starts), part).select(*kept, (F.col(rows) + place).alias(name))
