"""Questions answered from named things: changes, services, entities of a directory; facts that narrations may use.

All functions take batches of questions (qid, question) and give claims (qid, step, text, support) or refusals
(qid, refusal). Null questions name nothing. Ties are refused as ambiguous, never broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize, phrase
from ..operators import totals
from .root_cause import PR_ID

# The tokens that a narration may not add, and the order of kinds in a service's answer.
ID_TOKEN = r"\b[A-Z][A-Z0-9]*-[A-Z0-9][A-Za-z0-9-]*\b"
NUMBER = r"\d[\d,.:]*"
KIND_ORDER = ("Component", "Owner")
TITLE = r'"([^"]+)"'
CURRENCY = r"\b([A-Z]{3})\b"


def change_asked(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.regexp_extract(F.coalesce("question", F.lit("")), f"({PR_ID})", 1).alias("pr"))


def summarize_change(questions: DataFrame, pulls: DataFrame, hunks: DataFrame, motivated_by: DataFrame, tickets: DataFrame) -> DataFrame:
    """(qid, step, place, text, support): the pull request's row, its hunks in order, and each ticket that motivated it.

    pulls (pr, source, text), hunks (id, pr, text), motivated_by (pr, ticket), tickets (ticket, source, text).
    """
    asked = change_asked(questions).filter("pr <> ''")
    own = asked.join(pulls.select("pr", F.col("source").alias("pr_source"), F.col("text").alias("pr_text")), "pr")
    row = own.select("qid", F.lit(1).alias("step"), F.col("pr").alias("place"), F.col("pr_text").alias("text"), F.array("pr").alias("support"))
    cut = own.select("qid", "pr").join(hunks, "pr").select("qid", F.lit(2).alias("step"), F.col("id").alias("place"), "text", F.array("id").alias("support"))
    why = own.join(motivated_by, "pr").join(tickets, "ticket")
    named = F.concat_ws(" and ", F.transform(F.array_sort(F.array_distinct(F.array("pr_source", "source"))), lambda s: F.concat(F.lit("'"), s, F.lit("'"))))
    link = why.select("qid", F.lit(3).alias("step"), F.concat("ticket", F.lit("/1")).alias("place"), F.concat(F.lit('Motivating ticket: "'), "ticket", F.lit('" appears in '), named, F.lit(".")).alias("text"), F.array("pr", "ticket").alias("support"))
    told = why.select("qid", F.lit(3).alias("step"), F.concat("ticket", F.lit("/2")).alias("place"), "text", F.array("ticket").alias("support"))
    return row.unionByName(cut).unionByName(link).unionByName(told)


def change_refusals(questions: DataFrame, pulls: DataFrame) -> DataFrame:
    found = change_asked(questions).join(pulls.select("pr", F.lit(True).alias("known")).distinct(), "pr", "left")
    return found.select("qid", F.when(F.col("pr") == "", "no change is named").when(F.col("known").isNull(), F.concat(F.lit("there is no "), "pr")).alias("refusal"))


def named_parts(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, entity, n): the longest key of each entity that the question's normalised text holds.

    keys (entity, key), already normalised. A key can only be held if its first six characters, or all of a shorter
    one, are: the question's substrings of these lengths fetch the candidates, by an equi-join; only then the whole key
    is looked for.
    """
    asked = questions.select("qid", normalize(F.coalesce("question", F.lit(""))).alias("q"))
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("q") - k + 1, F.lit(1))), lambda i: F.substr(F.col("q"), i, F.lit(k)))
    heads = asked.select("qid", F.explode(F.array_distinct(F.concat(*(starts(k) for k in range(1, 7))))).alias("head"))
    known = keys.filter("key <> ''").withColumn("head", F.substring("key", 1, 6))
    return heads.join(known, "head").join(asked, "qid").filter(F.contains("q", "key")).groupBy("qid", "entity").agg(F.max(F.length("key")).alias("n"))


def find_service(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, status, entity, candidates): the entity whose name or alias, the longest held by the question, is longest.

    names (entity, name, shown): shown is false for an alias, which names an entity but isn't displayed.
    """
    best = named_parts(questions, names.select("entity", normalize(F.col("name")).alias("key"))).withColumn("at", F.rank().over(W.partitionBy("qid").orderBy(F.desc("n")))).filter("at = 1")
    tied = best.join(totals.display_names(names.filter("shown"), "entity", "name"), "entity", "left").groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.min("entity").alias("entity"), F.array_sort(F.collect_list("name")).alias("names"))
    status = F.when(F.col("k").isNull(), "none").when(F.col("k") > 1, "ambiguous").otherwise("ok")
    return questions.select("qid").join(tied, "qid", "left").select("qid", status.alias("status"), F.when(F.col("k") == 1, F.col("entity")).alias("entity"), F.when(F.col("k") > 1, F.col("names")).alias("candidates"))


def service_claims(found: DataFrame, members: DataFrame) -> DataFrame:
    """(qid, step, id, text): the records (entity, id, kind, text) of each service found, by kind and id."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)), F.lit(len(KIND_ORDER)))
    own = found.filter("status = 'ok'").select("qid", "entity").join(members, "entity")
    return own.select("qid", F.row_number().over(W.partitionBy("qid").orderBy(rank, "id")).alias("step"), "id", "text")


def directory_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name, components): the longest display name that the question holds as a whole phrase, ties by name.

    names (name, entity). The first word of a name fetches it, so questions meet few names.
    """
    words = lambda c: F.filter(F.split(F.trim(phrase(c)), " "), lambda w: w != "")
    asked = questions.select("qid", phrase(F.coalesce("question", F.lit(""))).alias("q"), F.explode(F.array_distinct(words(F.coalesce("question", F.lit(""))))).alias("first"))
    listed = names.groupBy("name").agg(F.count_distinct("entity").alias("components"), F.min("entity").alias("entity"))
    listed = listed.select("name", "components", "entity", phrase(F.col("name")).alias("p"), F.get(words(F.col("name")), F.lit(0)).alias("first"))
    met = asked.join(listed, "first").filter(F.contains("q", "p"))
    best = F.min(F.struct((-F.length("name")).alias("n"), "name", "components", "entity"))
    return met.groupBy("qid").agg(best.alias("b")).select("qid", "b.name", "b.components", "b.entity")


def directory_route(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, kind, entity, refusal): a named entity's facts, a refusal where the name stands for several, or else retrieval."""
    found = questions.select("qid").join(directory_names(questions, names), "qid", "left")
    many = F.col("components") > 1
    refusal = F.when(many, F.concat(F.lit("'"), "name", F.lit("' names "), F.col("components").cast("string"), F.lit(" separate entities")))
    return found.select("qid", F.when(F.col("name").isNull(), "lookup").otherwise("entity").alias("kind"), F.when(~many, F.col("entity")).alias("entity"), refusal.alias("refusal"))


def ambiguous_names(names: DataFrame) -> DataFrame:
    """(name, components) of display names that stand for several entities; names (name, entity)."""
    return names.filter("name is not null and name <> ''").groupBy("name").agg(F.count_distinct("entity").alias("components")).filter("components > 1")


def fact_tokens(text: Column) -> Column:
    """The ids and numbers of a text, each once, in order."""
    ids = F.regexp_extract_all(text, F.lit(f"({ID_TOKEN})"), F.lit(1))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,:]+$", ""))
    return F.array_distinct(F.concat(ids, numbers))


def adds_facts(narration: Column, source: Column) -> Column:
    return F.size(F.array_except(fact_tokens(narration), fact_tokens(source))) > 0


def narrated(answers: DataFrame) -> DataFrame:
    """(qid, narration, notice) from (qid, question, claims array<string>, refusal, narration): refusals are never narrated, and a narration that adds facts is dropped."""
    source = F.concat_ws("\n", F.concat(F.lit("Question: "), F.coalesce("question", F.lit(""))), F.array_join("claims", "\n"))
    told = F.trim(F.coalesce("narration", F.lit("")))
    may = F.col("refusal").isNull() & (F.size(F.coalesce("claims", F.array().cast("array<string>"))) > 0) & (told != "")
    new = adds_facts(told, source)
    return answers.select("qid", F.when(may & ~new, told).alias("narration"), F.when(may & new, F.lit("narration discarded: it adds facts")).alias("notice"))


def currency_scope(question: Column, currencies: Column) -> Column:
    """The first capital triple that is a currency of the corpus; null if none is."""
    return F.get(F.filter(F.regexp_extract_all(question, F.lit(CURRENCY), F.lit(1)), lambda x: F.array_contains(currencies, x)), F.lit(0))


def describe(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, id, relation, other, refusal): what an id is linked to either way; an unknown id is refused. ids (qid, id)."""
    links = edges.select(F.col("src").alias("id"), "relation", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.concat(F.lit("inverse "), "relation").alias("relation"), F.col("src").alias("other")))
    known = ids.join(nodes.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    return known.join(links, "id", "left").select("qid", "id", "relation", "other", F.when(F.col("known").isNull(), F.concat(F.lit("there is no "), "id")).alias("refusal"))


def assertions_of(ids: DataFrame, resolutions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, kind, a, b) of the resolutions (node_a, node_b) and mentions (chunk, node) that an id stands in, on either side."""
    said = resolutions.select(F.lit("resolution").alias("kind"), F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(mentions.select(F.lit("mention").alias("kind"), F.col("chunk").alias("a"), F.col("node").alias("b")))
    sides = said.select("kind", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    return ids.select("id").distinct().join(sides, "id").select("id", "kind", "a", "b")


def without_assertions(resolutions: DataFrame, dropped: DataFrame) -> DataFrame:
    """Resolutions less some (node_a, node_b), whichever way round; components are then taken anew, so clusters split again."""
    return resolutions.join(dropped.select(F.least("node_a", "node_b").alias("x"), F.greatest("node_a", "node_b").alias("y")).distinct(), (F.least("node_a", "node_b") == F.col("x")) & (F.greatest("node_a", "node_b") == F.col("y")), "left_anti")


def rendered(answers: DataFrame) -> DataFrame:
    """(qid, text) from (qid, claims array<struct<text, source, locator>>, refusal): each claim with its source below it, or the refusal."""
    line = F.transform("claims", lambda c: F.concat(c["text"], F.lit("\n  ↳ "), c["source"], F.lit(" ("), c["locator"], F.lit(")")))
    return answers.select("qid", F.coalesce("refusal", F.array_join(line, "\n")).alias("text"))


def missing_evidence(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms (qid, term) of which the corpus holds none: questions on them must be refused. vocabulary (term)."""
    return terms.join(vocabulary.select("term").distinct(), "term", "left_anti").select("qid", "term")


def admitted_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs that are completed with success or failure, how many of each other kind are left out); runs (id, status, conclusion)."""
    fit = (F.col("status") == "completed") & F.col("conclusion").isin("success", "failure")
    fit = F.coalesce(fit, F.lit(False))
    return runs.filter(fit), runs.filter(~fit).groupBy("status", "conclusion").agg(F.count(F.lit(1)).alias("n"))


def rebased(rows: DataFrame, old: str, new: str, column: str = "source") -> DataFrame:
    """Origins below one folder as those below another."""
    at = F.col(column)
    return rows.withColumn(column, F.when(F.startswith(at, F.lit(old)), F.concat(F.lit(new), F.substr(at, F.lit(len(old) + 1)))).otherwise(at))


def floor_gates(scores: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(gate, least, floor, ok): the smallest score of each column against its floor; vacuously fine without rows."""
    least = scores.agg(*(F.min(c).alias(c) for c in floors))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("least"), F.lit(float(v)).alias("floor")) for c, v in floors.items()))).alias("g")
    return least.select(rows).select("g.*", F.coalesce(F.col("g.least") >= F.col("g.floor"), F.lit(True)).alias("ok"))


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row, one text: a table of a small frame (a scorecard), in order of a column."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line([F.col(c).cast("string") for c in columns]).alias("x")))), lambda r: r["x"]), "\n")
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.agg(F.concat(F.lit(head), body).alias("text"))
