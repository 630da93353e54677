"""Claims checked against the rows they cite, independently of what produced them.

Input: claims (claim_id, text) and support (claim_id, id, source, kind, text, currency, amount). Every shape gives true,
false or null for a claim: null passes it on, and the first shape with a verdict decides. What no shape knows is
supported only if some cited record holds it in normalised form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

# The forms of claims.
MONEY = r"\b([A-Z]{3}) ([\d,]+\.\d{2})\b"
COUNTS = r"spanning (\d+) customer record\(s\) and (\d+) address record\(s\)"
REFUSE = r"Refused to sum across (\w+) and (\w+)"
SHARED = r"\"([^\"]+)\" appears in ([^\"]+)$"
RENEWAL = r"(?s)renews\b.*?\bon (\d{1,2} [A-Z][a-z]+)"
DATE = r"'(\d{1,2} [A-Z][a-z]+)'"


def _amount(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("decimal(38,2)")


def shared_fragment(text: Column, records: Column) -> Column:
    """Owns its verdict: the fragment in every record, and the named sources are those cited, two at least of each."""
    fragment = normalize(F.regexp_extract(text, SHARED, 1))
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_extract(text, SHARED, 2), F.lit("'([^']+)'"), F.lit(1))))
    cited = F.array_sort(F.array_distinct(F.transform(records, lambda r: r["source"])))
    holds = (fragment != "") & F.forall(records, lambda r: F.contains(r["key"], fragment))
    return F.when(text.rlike(SHARED), (F.size(records) >= 2) & (F.size(named) >= 2) & (named == cited) & holds)


def conflict_disclosure(text: Column, records: Column) -> Column:
    quoted = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(DATE), F.lit(1))))
    stated = F.array_sort(F.array_distinct(F.filter(F.transform(records, lambda r: F.regexp_extract(r["text"], RENEWAL, 1)), lambda d: d != "")))
    return F.when(F.contains(text, F.lit("disagree on the renewal date")), (F.size(quoted) >= 2) & (quoted == stated) & (F.size(records) >= 2))


def aggregate_recompute(text: Column, records: Column) -> Column:
    """True if the cited rows, all in the stated currency, add up to the stated amount; otherwise passed on."""
    currency, amount = F.regexp_extract(text, MONEY, 1), _amount(F.nullif(F.regexp_extract(text, MONEY, 2), F.lit("")))
    same = (F.size(records) > 0) & F.forall(records, lambda r: F.coalesce(r["currency"] == currency, F.lit(False)))
    zero = F.lit(0).cast("decimal(38,2)")
    total = F.aggregate(records, zero, lambda s, r: (s + F.coalesce(r["amount"].cast("decimal(38,2)"), zero)).cast("decimal(38,2)"))
    return F.when(text.rlike(MONEY) & F.contains(F.lower(text), F.lit("net order value")) & same & (total == amount), F.lit(True))


def count_match(customer: str, address: str):
    """The shape for records whose kinds have these names."""

    def shape(text: Column, records: Column) -> Column:
        number = lambda k: F.try_to_number(F.regexp_extract(text, COUNTS, k), F.lit("999999999"))
        of = lambda kind: F.size(F.filter(records, lambda r: r["kind"] == kind))
        return F.when(text.rlike(COUNTS) & (of(customer) == number(1)) & (of(address) == number(2)), F.lit(True))

    return shape


def refuse_to_sum(text: Column, records: Column) -> Column:
    named = F.array(F.regexp_extract(text, REFUSE, 1), F.regexp_extract(text, REFUSE, 2))
    return F.when(text.rlike(REFUSE) & (F.size(F.array_except(named, F.transform(records, lambda r: r["currency"]))) == 0), F.lit(True))


def shapes(customer: str, address: str) -> tuple:
    """All shapes, in the order in which they decide."""
    return conflict_disclosure, aggregate_recompute, count_match(customer, address), refuse_to_sum, shared_fragment


def verify(claims: DataFrame, support: DataFrame, shapes: tuple) -> DataFrame:
    """(claim_id, text, supported). One shuffle brings a claim and what it cites together."""
    record = F.struct("id", "source", "kind", "text", "currency", "amount", normalize(F.coalesce("text", F.lit(""))).alias("key"))
    cited = support.groupBy("claim_id").agg(F.array_sort(F.collect_list(record)).alias("records"))
    joined = claims.join(cited, "claim_id", "left").withColumn("records", F.coalesce("records", F.array().cast(dict(cited.dtypes)["records"])))
    needle = normalize(F.col("text"))
    contained = (needle != "") & F.exists("records", lambda r: F.contains(r["key"], needle))
    return joined.select("claim_id", "text", F.coalesce(*(s(F.col("text"), F.col("records")) for s in shapes), contained).alias("supported"))
