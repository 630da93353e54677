"""Joins in time: earlier recurrences, intervals with forward fill, shared boundaries, tails by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def recurrences(rows: DataFrame, key: list[str], time: str) -> DataFrame:
    """For each row the number of earlier rows with its key and the latest of them; rows of one time don't count."""
    w = W.partitionBy(*key).orderBy(time)
    before = w.rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy(*key, time)
    return rows.withColumn("earlier", F.count(F.lit(1)).over(before) - F.count(F.lit(1)).over(same))


def earlier_pairs(rows: DataFrame, key: str, id_col: str, time: str) -> DataFrame:
    """Every (row, earlier row) with one key: all of them, not just the nearest."""
    a = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(time).alias("at"))
    b = rows.select(F.col(key).alias("key"), F.col(id_col).alias("earlier_id"), F.col(time).alias("earlier_at"))
    return a.join(b, "key").filter(F.col("earlier_at") < F.col("at")).select("key", "id", "earlier_id")


def forward_fill(rows: DataFrame, group: str, order: str, value: str, to: str) -> DataFrame:
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def in_steps(log: DataFrame, steps: DataFrame, group: str, order: str, time: str) -> DataFrame:
    """Lines of a log in their step's [start, end], both ends in; a line without a time belongs where the last one with a time does."""
    filled = forward_fill(log, group, order, time, "at")
    return filled.join(steps, group).filter((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end")))


def shared_boundaries(steps: DataFrame, group: str, step: str) -> DataFrame:
    """(group, step, other): steps one of whose ends is another's start in the same second."""
    a = steps.select(group, F.col(step).alias("step"), F.date_trunc("second", "end").alias("at"))
    b = steps.select(group, F.col(step).alias("other"), F.date_trunc("second", "start").alias("at"))
    return a.join(b, [group, "at"]).filter("step <> other").select(group, "step", "other")


def tail_by_bytes(rows: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """The last rows of a group whose texts, each with a line end, fit a number of bytes."""
    w = W.partitionBy(group).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("bytes", F.sum(F.octet_length(text) + 1).over(w)).filter(F.col("bytes") <= most)


def newest(rows: DataFrame, group: str, rank: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(the first rows of each group in rank order, how many of each group were left out)."""
    numbered = rows.withColumn("at", F.row_number().over(W.partitionBy(group).orderBy(*rank)))
    return numbered.filter(F.col("at") <= most).drop("at"), rows.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
