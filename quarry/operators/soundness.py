"""Bounded soundness: every state of a small universe of sealed answers, judged by verifiers, as one relational plan.

A corpus is a list of record values. A claim adds up the records it cites or quotes one of them, asserts a value and
carries a recorded verdict; citing a record that isn't there makes it invalid. A state is a corpus, a question and an
answer of one claim or more. A verifier is sound if every state that it passes is honest: its claims are recorded as
valid, are valid, and are the answer that the corpus yields.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    name: str
    max_records: int
    values: int
    claims: int
    max_asserted: int


# The bounds of the universes.
UNIVERSES = (Bounds("A", 3, 4, 1, 12), Bounds("B", 2, 3, 2, 6))
DEEP = Bounds("deep", 2, 2, 3, 4)
VERIFIERS = ("re-execution", "control-trusting", "control-claims-only")


def corpora(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """(corpus, records): every list of 1 to max_records values."""
    out = None
    for size in range(1, bounds.max_records + 1):
        base, n = bounds.values, bounds.values**size
        digits = F.array(*(F.floor(F.col("id") / base ** (size - 1 - k)) % base + 1 for k in range(size)))
        part = spark.range(n).select((F.lit(size * 1_000_000) + F.col("id")).alias("corpus"), digits.cast("array<long>").alias("records"))
        out = part if out is None else out.unionByName(part)
    return out


def claims(corpora_: DataFrame, bounds: Bounds) -> DataFrame:
    """(corpus, recorded, valid, is_total, is_first): every claim on each corpus; one bit of `cited` for each record, the bit above them cites none."""
    cited = F.explode(F.expr("sequence(1, shiftleft(1, size))")).alias("cited")
    each = corpora_.withColumn("size", F.size("records")).select("corpus", "records", "size", cited).crossJoin(F.broadcast(corpora_.sparkSession.range(bounds.max_asserted + 1).withColumnRenamed("id", "asserted")))
    each = each.withColumn("kind", F.explode(F.array(F.lit("sum"), F.lit("quote")))).withColumn("recorded", F.explode(F.array(F.lit(True), F.lit(False))))
    there = F.expr("cited < shiftleft(1, size)")
    picked = F.expr("filter(records, (v, i) -> (cited & shiftleft(1, i)) <> 0)")
    total = F.aggregate(picked, F.lit(0).cast("long"), lambda s, v: s + v)
    valid = there & F.when(F.col("kind") == "sum", total == F.col("asserted")).otherwise(F.array_contains(picked, F.col("asserted")))
    whole = F.aggregate("records", F.lit(0).cast("long"), lambda s, v: s + v)
    is_total = F.col("recorded") & (F.col("kind") == "sum") & F.expr("cited = shiftleft(1, size) - 1") & (F.col("asserted") == whole)
    is_first = F.col("recorded") & (F.col("kind") == "quote") & (F.col("cited") == 1) & (F.col("asserted") == F.element_at("records", 1))
    return each.select("corpus", "recorded", valid.alias("valid"), is_total.alias("is_total"), is_first.alias("is_first"))


def states(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """(question, recorded, genuine, agree, canonical) of every state: all recorded as valid; all valid; verdicts as recomputed; the corpus's own answer."""
    own = claims(corpora(spark, bounds), bounds)
    parts, answer = [], None
    for length in range(1, bounds.claims + 1):
        one = own.select("corpus", *(F.col(c).alias(f"{c}_{length}") for c in ("recorded", "valid", "is_total", "is_first")))
        answer = one if answer is None else answer.join(one, "corpus")
        every = lambda f: functools.reduce(lambda a, b: a & b, (f(k) for k in range(1, length + 1)))  # noqa: B023, E731
        question = F.explode(F.array(*map(F.lit, ("total", "first", "both")))).alias("question")
        yields = F.lit(False)
        if length == 1:
            yields = F.when(F.col("question") == "total", F.col("is_total_1")).when(F.col("question") == "first", F.col("is_first_1")).otherwise(False)
        elif length == 2:
            yields = (F.col("question") == "both") & F.col("is_total_1") & F.col("is_first_2")
        parts.append(answer.select("*", question).select("question", every(lambda k: F.col(f"recorded_{k}")).alias("recorded"), every(lambda k: F.col(f"valid_{k}")).alias("genuine"), every(lambda k: F.col(f"valid_{k}") == F.col(f"recorded_{k}")).alias("agree"), yields.alias("canonical")))
    return functools.reduce(DataFrame.unionByName, parts)


def soundness(spark: SparkSession, universes: tuple[Bounds, ...] = UNIVERSES) -> DataFrame:
    """(universe, verifier, states, passes, unsound): a verifier is refuted if it passes a state that isn't honest."""
    every = functools.reduce(DataFrame.unionByName, (states(spark, b).withColumn("universe", F.lit(b.name)) for b in universes))
    honest = F.col("agree") & F.col("genuine") & F.col("canonical")
    passes = {"re-execution": F.col("agree") & F.col("genuine") & F.col("canonical"), "control-trusting": F.col("recorded"), "control-claims-only": F.col("agree") & F.col("recorded")}
    judged = every.select("universe", F.explode(F.array(*(F.struct(F.lit(v).alias("verifier"), passes[v].alias("pass"), honest.alias("honest")) for v in VERIFIERS))).alias("j")).select("universe", "j.*")
    return judged.groupBy("universe", "verifier").agg(F.count(F.lit(1)).alias("states"), F.count_if("pass").alias("passes"), F.count_if(F.col("pass") & ~F.col("honest")).alias("unsound"))
