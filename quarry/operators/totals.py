"""Totals that never cross currencies, rankings, comparisons and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import numbered


def subtotals(rows: DataFrame, entity: str, currency: str, amount: str) -> DataFrame:
    """(entity, currency, total, n, currencies): currencies counts those of the entity; more than one means no grand total."""
    sums = rows.groupBy(F.col(entity).alias("entity"), F.coalesce(F.col(currency), F.lit("?")).alias("currency")).agg(F.sum(F.col(amount).cast("decimal(38,2)")).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("currencies", F.count(F.lit(1)).over(W.partitionBy("entity")))


def superlative(totals: DataFrame) -> DataFrame:
    """The entity with the largest total in each currency (ties: the least entity), and how many were compared."""
    best = totals.groupBy("currency").agg(F.max(F.struct(F.col("total"), (-F.col("entity")).alias("least"))).alias("best"), F.count(F.lit(1)).alias("compared"))
    return best.select("currency", (-F.col("best.least")).alias("entity"), F.col("best.total").alias("total"), "compared")


def ranked_pairs(totals: DataFrame) -> DataFrame:
    """Neighbours in the ranking of each currency, ties left out: (currency, higher, lower, margin).

    The ranking is one numbering over a range partitioning, so a currency that holds most rows is spread over many tasks.
    """
    placed = numbered(totals.select("currency", "entity", "total"), ["currency", F.desc("total"), "entity"], "at")
    after = placed.select((F.col("at") - 1).alias("at"), "currency", F.col("entity").alias("lower"), F.col("total").alias("next"))
    pairs = placed.withColumnRenamed("entity", "higher").join(after, ["at", "currency"])
    return pairs.filter("total <> next").select("currency", "higher", "lower", (F.col("total") - F.col("next")).alias("margin"))


def compare(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, verdict) for pairs of entities: refused if one has no rows, several currencies, or another currency."""
    one = lambda s: totals.groupBy(F.col("entity").alias(s)).agg(F.count(F.lit(1)).alias(f"{s}_n"), F.max("currency").alias(f"{s}_currency"), F.max("total").alias(f"{s}_total"))
    both = pairs.join(one("left"), "left", "left").join(one("right"), "right", "left")
    verdict = (
        F.when(F.col("left_n").isNull() | F.col("right_n").isNull(), "refused: no rows")
        .when((F.col("left_n") > 1) | (F.col("right_n") > 1), "refused: mixed currencies")
        .when(F.col("left_currency") != F.col("right_currency"), "refused: different currencies")
        .when(F.col("left_total") == F.col("right_total"), "same")
        .when(F.col("left_total") > F.col("right_total"), "exceeds")
        .otherwise("is below")
    )
    return both.select("left", "right", verdict.alias("verdict"))


def display_names(names: DataFrame, entity: str, name: str) -> DataFrame:
    """The longest name of each entity, ties by the name itself."""
    return names.groupBy(F.col(entity).alias("entity")).agg(F.max(F.struct(F.length(name).alias("n"), F.col(name).alias("name")))["name"].alias("name"))


def conflicts(clauses: DataFrame, entity: str, text: str, pattern: str) -> DataFrame:
    """(entity, stated): what the clauses of an entity state by the pattern, where that differs."""
    stated = clauses.select(F.col(entity).alias("entity"), F.regexp_extract(text, pattern, 1).alias("stated")).filter("stated <> ''")
    return stated.groupBy("entity").agg(F.sort_array(F.collect_set("stated")).alias("stated"), F.count(F.lit(1)).alias("clauses")).filter(F.size("stated") >= 2)


def counts_by_kind(rows: DataFrame, by: str, kind: str, names: dict[str, str]) -> DataFrame:
    """(by, n, a count for each name): how many rows of each kind, in one pass; null kinds only count in n."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(kind) == value).alias(name) for name, value in names.items()))


def value_sets(rows: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """(by, to, n): the distinct values in order, joined by commas; nulls are no values."""
    return rows.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias(to), F.count(F.lit(1)).alias("n"))


def guarded(rows: DataFrame, group: list[str], value: str, to: str) -> DataFrame:
    """Rows with `value` carried over only where the row is the only one of its group, so that no join multiplies it."""
    return rows.withColumn(to, F.when(F.count(F.lit(1)).over(W.partitionBy(*group)) == 1, F.col(value)))
