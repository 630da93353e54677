"""Conclusions checked by recomputing them: comparisons over the cited rows, superlatives over all rows.

Nulls: a row without an amount counts as zero, one without a currency never fits; a claim of another form gets no row.
Ties: a superlative holds for the name of any entity with the largest total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

# The forms of the two conclusions.
SIDE = r"'(.+?)' \(([A-Z]{3}) ([\d,]+\.\d{2}) across (\d+) order\(s\)\)"
COMPARE = f"{SIDE} exceeds {SIDE} in total net order value"
SUPERLATIVE = r"Among (\d+) entities with ([A-Z]{3}) orders, '(.+?)' has the highest total net order value: ([A-Z]{3}) ([\d,]+\.\d{2})"

_MONEY = "decimal(38,2)"


def _amount(c):
    return F.replace(c, F.lit(","), F.lit("")).cast(_MONEY)


def _keys(names: DataFrame) -> DataFrame:
    return names.filter("name is not null").select("entity", normalize(F.col("name")).alias("key")).distinct()


def _worth(sales: DataFrame) -> DataFrame:
    return sales.select("id", "entity", "currency", F.coalesce(F.col("amount").cast(_MONEY), F.lit(0).cast(_MONEY)).alias("amount"))


def compare_conclusion(claims: DataFrame, support: DataFrame, sales: DataFrame, names: DataFrame) -> DataFrame:
    """(claim_id, holds) of comparisons: each side's cited rows must be those of the named entity, in number, currency and sum.

    claims (claim_id, text), support (claim_id, id), sales (id, entity, currency, amount), names (entity, name).
    """
    part = lambda k: F.regexp_extract("text", COMPARE, k)
    side = lambda n, k: F.struct(F.lit(n).alias("side"), normalize(part(k)).alias("key"), part(k + 1).alias("stated_in"), _amount(part(k + 2)).alias("stated"), part(k + 3).cast("long").alias("stated_n"))
    sides = claims.filter(F.col("text").rlike(COMPARE)).select("claim_id", F.explode(F.array(side(0, 1), side(1, 5))).alias("s")).select("claim_id", "s.*")
    cited = support.join(_worth(sales), "id").select("claim_id", "entity", "currency", "amount")
    rows = sides.join(cited, "claim_id").join(_keys(names), ["entity", "key"], "left_semi")
    found = rows.groupBy("claim_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.bool_and(F.coalesce(F.col("currency") == F.col("stated_in"), F.lit(False))).alias("same"))
    judged = sides.join(found, ["claim_id", "side"], "left")
    fits = (F.coalesce("n", F.lit(0)) == F.col("stated_n")) & F.coalesce("same", F.lit(True)) & (F.coalesce("total", F.lit(0).cast(_MONEY)) == F.col("stated"))
    value = lambda n: F.max(F.when(F.col("side") == n, F.col("stated")))
    return judged.groupBy("claim_id").agg((F.bool_and(fits) & (value(0) > value(1))).alias("holds"))


def superlative_conclusion(claims: DataFrame, support: DataFrame, sales: DataFrame, names: DataFrame) -> DataFrame:
    """(claim_id, holds) of superlatives: the number of entities, the winner, its total and the sum of the cited rows must all follow from the data."""
    part = lambda k: F.regexp_extract("text", SUPERLATIVE, k)
    said = claims.filter(F.col("text").rlike(SUPERLATIVE)).select("claim_id", part(1).cast("long").alias("stated_n"), part(2).alias("currency"), normalize(part(3)).alias("key"), part(4).alias("again"), _amount(part(5)).alias("stated"))
    keys = _keys(names)
    worth = _worth(sales)
    totals = worth.join(keys.select("entity").distinct(), "entity", "left_semi").groupBy("entity", "currency").agg(F.sum("amount").alias("total"))
    field = totals.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("best"))
    champions = totals.join(field, "currency").filter("total = best").join(keys, "entity").select("currency", "key", F.lit(True).alias("wins")).distinct()
    sums = said.select("claim_id", "currency").join(support, "claim_id").join(worth.select("id", F.col("currency").alias("own"), "amount"), "id", "left")
    sums = sums.groupBy("claim_id").agg(F.sum("amount").alias("cited"), F.bool_and(F.coalesce(F.col("own") == F.col("currency"), F.lit(False))).alias("same"))
    judged = said.join(field, "currency", "left").join(champions, ["currency", "key"], "left").join(sums, "claim_id", "left")
    holds = (F.col("stated_n") == F.col("n")) & (F.col("currency") == F.col("again")) & (F.col("stated") == F.col("best")) & F.coalesce("wins", F.lit(False)) & F.coalesce("same", F.lit(True)) & (F.coalesce("cited", F.lit(0).cast(_MONEY)) == F.col("stated"))
    return judged.select("claim_id", F.coalesce(holds, F.lit(False)).alias("holds"))


def chain_citation(claims: DataFrame, support: DataFrame, records: DataFrame) -> DataFrame:
    """(claim_id, holds) of claims that cite a claim of another bundle: one support of kind `bundle-claim`, with the very same text.

    claims (claim_id, text), support (claim_id, id), records (id, kind, text); other claims get no row.
    """
    cited = support.join(records.select("id", "kind", F.col("text").alias("record")), "id").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind") == "bundle-claim").alias("chained"), F.max("record").alias("record"))
    return claims.join(cited.filter("chained"), "claim_id").select("claim_id", ((F.col("n") == 1) & (F.col("text") == F.col("record"))).alias("holds"))


#: Why a chain record doesn't stand, first that applies.
CHAIN_FAILURES = ("unknown root", "upstream did not pass", "no such claim", "kind differs", "text differs")


def chain_records(records: DataFrame, upstreams: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, failure): records (id, root, idx, kind, text) that must equal claim idx of the bundle with that root.

    upstreams (root, verdict), claims (root, idx, text); failure is null where the record stands.
    """
    both = records.join(upstreams.select("root", "verdict").distinct(), "root", "left").join(claims.select("root", "idx", F.col("text").alias("claimed")), ["root", "idx"], "left")
    tests = (F.col("verdict").isNull(), F.col("verdict") != "PASS", F.col("claimed").isNull(), F.col("kind") != "bundle-claim", F.col("text") != F.col("claimed"))
    failure = F.coalesce(*(F.when(t, F.lit(name)) for t, name in zip(tests, CHAIN_FAILURES, strict=True)))
    return both.select("id", failure.alias("failure"))
