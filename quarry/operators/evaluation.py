"""Scores of answers, precision and recall, tallies, redaction counts, bounded enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 1 where there is nothing to judge."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(1.0))


def precision_recall(pairs: DataFrame, said: Column, truth: Column) -> DataFrame:
    return pairs.agg(ratio(F.count_if(said & truth), F.count_if(said)).alias("precision"), ratio(F.count_if(said & truth), F.count_if(truth)).alias("recall"))


def scorecard(cases: DataFrame, group: str, faithful: Column, covered: Column, correct: Column) -> DataFrame:
    """Means of each score and of all three together, by group."""
    mean = lambda c: F.avg(c.cast("int"))
    return cases.groupBy(group).agg(F.count(F.lit(1)).alias("cases"), mean(faithful).alias("faithfulness"), mean(covered).alias("coverage"), mean(correct).alias("quality"), mean(faithful & covered & correct).alias("trustworthy"))


def tally(rows: DataFrame, group: list[str], family: str, families: list[str], detected: Column, applies: Column) -> DataFrame:
    """detected of applicable for each family, as columns."""
    return rows.groupBy(*group).pivot(family, families).agg(F.count_if(detected & applies).alias("detected"), F.count_if(applies).alias("applicable"))


def supported(claims: DataFrame, support: DataFrame, norm) -> DataFrame:
    """(claim_id, supported): some cited record holds the claim's normalised text."""
    hits = claims.join(support, "claim_id", "left").groupBy("claim_id").agg(F.coalesce(F.bool_or(F.contains(norm(F.col("record")), norm(F.col("claim")))), F.lit(False)).alias("supported"))
    return hits


def universe(spark, records: int, citations: int) -> DataFrame:
    """Every assignment of a claim's citations to records and of each record's truth: (truth mask, cited mask)."""
    masks = spark.range(1 << records).withColumnRenamed("id", "truth")
    cited = spark.range(1 << records).withColumnRenamed("id", "cited").filter(F.bit_count("cited") <= citations)
    return masks.crossJoin(cited)
