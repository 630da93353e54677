"""Questions on business entities: who is meant, what is known, and when to refuse. Batches of questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import common_length, money, normalize
from ..operators import totals
from ..operators.claims import RENEWAL
from .lookup import currency_scope

LEAST_MATCH, LEAST_SHARE = 6, 0.6
SUPERLATIVE = r"\b(?:highest|largest|biggest|greatest|maximum|most|top)\b"


def matches(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, entity, match, share): the longest string that a question has in common with any name of an entity.

    names: (entity, name). A name can only match in six characters if it shares one of its six-grams with the question.
    """
    six = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - LEAST_MATCH + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(LEAST_MATCH))))
    asked = questions.select("qid", F.explode(F.array(normalize(F.col("question")))).alias("q"))
    known = names.select("entity", F.explode(F.array(normalize(F.col("name")))).alias("key")).filter("key <> ''").distinct()
    # grams travel without the questions, which only join what was met
    pairs = asked.select("qid", F.explode(six(F.col("q"))).alias("gram")).join(known.select("entity", "key", F.explode(six(F.col("key"))).alias("gram")), "gram").select("qid", "entity", "key").distinct()
    found = pairs.join(asked, "qid").withColumn("match", common_length(F.col("key"), F.col("q"))).filter(F.col("match") >= LEAST_MATCH)
    return found.groupBy("qid", "entity").agg(F.max("match").alias("match"), F.max(F.col("match") / F.length("key")).alias("share"))


def resolve(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, status, entity, candidates): ok, ambiguous (a tie) or none."""
    best = matches(questions, names).withColumn("at", F.rank().over(W.partitionBy("qid").orderBy(F.desc("match")))).filter("at = 1")
    shown = totals.display_names(names, "entity", "name")
    tied = best.join(shown, "entity").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity"), F.array_sort(F.collect_list("name")).alias("names"))
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return questions.join(tied, "qid", "left").select("qid", status.alias("status"), F.when(F.col("n") == 1, F.col("entity")).alias("entity"), F.when(F.col("n") > 1, F.col("names")).alias("candidates"))


def named_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, entity, name, place): the entities that a question names to a share of LEAST_SHARE, longest match first, ties by name."""
    shown = totals.display_names(names, "entity", "name")
    named = matches(questions, names).filter(F.col("share") >= LEAST_SHARE).join(shown, "entity")
    return named.select("qid", "entity", "name", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("match"), "name", "entity")).alias("place"))


def coverage(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, covered): what share of a question's normalised text its best match takes."""
    best = matches(questions, names).groupBy("qid").agg(F.max("match").alias("match"))
    return questions.join(best, "qid", "left").select("qid", F.coalesce(F.try_divide(F.col("match"), F.length(normalize(F.col("question")))), F.lit(0.0)).alias("covered"))


def route(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, kind): several named entities or a superlative go to reasoning, one to composition, none to retrieval.

    A question that matches several entities equally well, and hardly says more than their name, goes to composition too,
    which refuses it as ambiguous.
    """
    named = named_entities(questions, names).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    tied = resolve(questions, names).select("qid", (F.col("status") == "ambiguous").alias("tied"))
    all_ = questions.join(named, "qid", "left").join(tied, "qid").join(coverage(questions, names), "qid")
    ambiguous = F.col("tied") & (F.col("covered") >= LEAST_SHARE)
    kind = F.when((F.coalesce("n", F.lit(0)) >= 2) | F.lower("question").rlike(SUPERLATIVE), "multi").when((F.col("n") == 1) | ambiguous, "entity").otherwise("lookup")
    return all_.select("qid", kind.alias("kind"))


def _worth(sales: DataFrame) -> DataFrame:
    return sales.groupBy("entity", F.coalesce("currency", F.lit("?")).alias("currency")).agg(F.sum(F.coalesce(F.col("amount").cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))).alias("total"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("support"))


def _quoted(c) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def compare(pairs: DataFrame, sales: DataFrame) -> DataFrame:
    """(qid, step, text, support, refusal) for (qid, a, name_a, b, name_b): both totals and which exceeds, or why they can't be compared."""
    held = _worth(sales).groupBy("entity").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list("currency")).alias("c"), F.min(F.struct("currency", "total", "n", "support")).alias("w"))
    both = pairs
    for x in "ab":
        both = both.join(held.select(F.col("entity").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("k", "c", "w"))), x, "left")
    none = lambda x: F.when(F.col(f"k_{x}").isNull(), F.concat(F.lit("No sales orders found for "), _quoted(F.col(f"name_{x}")), F.lit(" — nothing to compare.")))
    mixed = lambda x: F.when(F.col(f"k_{x}") > 1, F.concat(F.lit("Cannot compare: "), _quoted(F.col(f"name_{x}")), F.lit(" has orders in "), F.array_join(f"c_{x}", " and "), F.lit(", which are not directly comparable.")))
    other = F.when(F.col("w_a.currency") != F.col("w_b.currency"), F.concat(F.lit("Cannot compare: "), _quoted(F.col("name_a")), F.lit(" has orders in "), F.col("w_a.currency"), F.lit(" but "), _quoted(F.col("name_b")), F.lit(" in "), F.col("w_b.currency"), F.lit("; the totals are not directly comparable.")))
    both = both.withColumn("refusal", F.coalesce(none("a"), mixed("a"), none("b"), mixed("b"), other))
    shown = lambda x: money(F.col(f"w_{x}.currency"), F.col(f"w_{x}.total"))
    step = lambda x: F.struct(F.concat(_quoted(F.col(f"name_{x}")), F.lit(": total net order value across "), F.col(f"w_{x}.n").cast("string"), F.lit(" order(s): "), shown(x), F.lit(".")).alias("text"), F.col(f"w_{x}.support").alias("support"))
    side = lambda x: F.concat(_quoted(F.col(f"name_{x}")), F.lit(" ("), shown(x), F.lit(" across "), F.col(f"w_{x}.n").cast("string"), F.lit(" order(s))"))
    exceeds = lambda x, y: F.concat(side(x), F.lit(" exceeds "), side(y), F.lit(" in total net order value."))
    same = F.concat(_quoted(F.col("name_a")), F.lit(" and "), _quoted(F.col("name_b")), F.lit(" have the same total net order value: "), shown("a"), F.lit("."))
    last = F.when(F.col("w_a.total") == F.col("w_b.total"), same).when(F.col("w_a.total") > F.col("w_b.total"), exceeds("a", "b")).otherwise(exceeds("b", "a"))
    steps = F.array(step("a"), step("b"), F.struct(last.alias("text"), F.concat("w_a.support", "w_b.support").alias("support")))
    told = both.filter("refusal is null").select("qid", F.posexplode(steps).alias("at", "s")).select("qid", (F.col("at") + 1).alias("step"), "s.text", "s.support", F.lit(None).cast("string").alias("refusal"))
    empty = F.lit(None).cast("array<string>")
    return told.unionByName(both.filter("refusal is not null").select("qid", F.lit(0).alias("step"), F.lit(None).cast("string").alias("text"), empty.alias("support"), "refusal"))


def superlative(questions: DataFrame, names: DataFrame, sales: DataFrame) -> DataFrame:
    """(qid, step, text, support, refusal): the largest total in the currency that a question names, if it names one that the corpus has."""
    currencies = sales.filter("currency is not null").agg(F.array_sort(F.collect_set("currency")).alias("all"))
    asked = questions.join(F.broadcast(currencies), F.lit(True)).withColumn("currency", currency_scope(F.col("question"), F.col("all")))  # one row
    worth = _worth(sales).join(totals.display_names(names, "entity", "name"), "entity")
    best = worth.groupBy("currency").agg(F.count(F.lit(1)).alias("of"), F.min(F.struct((-F.col("total")).alias("o"), "name", "total", "support")).alias("b"))
    found = asked.join(best, "currency", "left")
    refusal = F.when(F.col("currency").isNull(), F.concat(F.lit("A single ranking would mix currencies ("), F.array_join("all", ", "), F.lit("); name one."))).when(F.col("of").isNull(), F.concat(F.lit("No entity has orders in "), F.col("currency"), F.lit(".")))
    text = F.concat(F.lit("Among "), F.col("of").cast("string"), F.lit(" entities with "), F.col("currency"), F.lit(" orders, "), _quoted(F.col("b.name")), F.lit(" has the highest total net order value: "), money(F.col("currency"), F.col("b.total")), F.lit("."))
    return found.select("qid", F.when(refusal.isNull(), 1).otherwise(0).alias("step"), F.when(refusal.isNull(), text).alias("text"), F.when(refusal.isNull(), F.col("b.support")).alias("support"), refusal.alias("refusal"))


def reason(questions: DataFrame, names: DataFrame, sales: DataFrame) -> DataFrame:
    """(qid, step, text, support, refusal): two named entities are compared, more are ambiguous, a superlative is ranked, all else is refused."""
    named = named_entities(questions, names)
    by = named.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "entity", "name"))).alias("e"))
    asked = questions.join(by, "qid", "left").withColumn("k", F.coalesce(F.size("e"), F.lit(0)))
    asked = asked.withColumn("k", F.greatest("k", F.lit(0)))
    two = asked.filter("k = 2").select("qid", F.col("e")[0]["entity"].alias("a"), F.col("e")[0]["name"].alias("name_a"), F.col("e")[1]["entity"].alias("b"), F.col("e")[1]["name"].alias("name_b"))
    ranks = F.lower("question").rlike(SUPERLATIVE)
    ranked = superlative(asked.filter((F.col("k") < 2) & ranks).select("qid", "question"), names, sales)
    many = F.concat(F.lit("Ambiguous: the question matches more than two entities ("), F.array_join(F.transform("e", lambda x: x["name"]), ", "), F.lit(")."))
    refused = asked.filter((F.col("k") > 2) | (F.col("k") < 2) & ~ranks).select("qid", F.lit(0).alias("step"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("support"), F.when(F.col("k") > 2, many).otherwise("the question asks for no comparison or ranking").alias("refusal"))
    return compare(two, sales).unionByName(ranked).unionByName(refused)


def compose(resolved: DataFrame, names: DataFrame, sales: DataFrame, clauses: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(qid, step, text, support): what an entity consists of, its totals by currency, a refusal to add up several, its clauses, and a conflict among them.

    sales (entity, id, currency, amount), clauses (entity, id, source, text): every clause of every document that mentions
    the entity; members (entity, id, part): its records, part `customer` or `address`.
    """
    who = resolved.filter("status = 'ok'").select("qid", "entity").join(totals.display_names(names, "entity", "name"), "entity")
    sums = who.join(_worth(sales), "entity").withColumn("kinds", F.count(F.lit(1)).over(W.partitionBy("qid")))
    count = F.col("n").cast("string")
    total = money(F.col("currency"), F.col("total"))
    one = F.concat(F.lit("Total net order value across "), count, F.lit(" order(s): "), total, F.lit("."))
    each = F.concat(F.lit("Net order value in "), F.col("currency"), F.lit(" across "), count, F.lit(" order(s): "), total, F.lit("."))
    amounts = sums.select("qid", F.lit(2).alias("step"), F.when(F.col("kinds") == 1, one).otherwise(each).alias("text"), "support")
    mixed = sums.groupBy("qid", "name").agg(F.array_sort(F.collect_set("currency")).alias("c"), F.flatten(F.collect_list("support")).alias("support")).filter(F.size("c") > 1)
    refused = mixed.select("qid", F.lit(3).alias("step"), F.concat(F.lit("Refused to sum across "), F.array_join("c", " and "), F.lit(": the orders are in different currencies and are not directly comparable.")).alias("text"), F.array_sort("support").alias("support"))
    stated = who.join(clauses, "entity").select("qid", F.lit(4).alias("step"), "id", "source", "text")
    dated = stated.withColumn("date", F.regexp_extract("text", RENEWAL, 1)).filter("date <> ''")
    sides = dated.groupBy("qid").agg(F.count_distinct("date").alias("k"), F.array_sort(F.collect_list(F.struct("id", "date", "source"))).alias("d")).filter("k > 1")
    sides_text = F.array_join(F.transform("d", lambda x: F.concat(_quoted(x["date"]), F.lit(" ("), x["source"], F.lit(")"))), "; ")
    conflict = sides.select("qid", F.lit(5).alias("step"), F.concat(F.lit("Conflict: the cited documents disagree on the renewal date — "), sides_text, F.lit(". No single renewal date can be asserted.")).alias("text"), F.transform("d", lambda x: x["id"]).alias("support"))
    out = amounts.unionByName(refused).unionByName(stated.select("qid", "step", "text", F.array("id").alias("support"))).unionByName(conflict)
    if members is None:
        return out
    parts = who.join(members, "entity").groupBy("qid", "name").agg(F.count_if(F.col("part") == "customer").alias("c"), F.count_if(F.col("part") == "address").alias("a"), F.array_sort(F.collect_list("id")).alias("support")).filter("c > 0")
    identity = F.concat(_quoted(F.col("name")), F.lit(" is one resolved entity spanning "), F.col("c").cast("string"), F.lit(" customer record(s) and "), F.col("a").cast("string"), F.lit(" address record(s)."))
    return out.unionByName(parts.select("qid", F.lit(1).alias("step"), identity.alias("text"), "support"))
