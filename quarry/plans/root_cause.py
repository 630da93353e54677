"""Root causes of failed runs, all runs in one plan: signature, recurrences, incidents, and the fixes they led to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalize
from ..operators.resolution import holding

# Run names, error lines and the trailer that says nothing.
RUN_ID = r"\bR-\d{3,5}\b|\b\d{8,}\b"
PR_ID = r"\bPR-\d{3,5}\b"
ERROR_LINE = r"(?m)ERROR \S+: (.+)$"
MARKED_LINE = r"(?m)##\[error\](.+)$"
TRAILER = r"^Process completed with exit code -?\d+\.?$"


def is_error(text: Column) -> Column:
    return F.contains(text, F.lit("ERROR")) | F.contains(text, F.lit("##[error]"))


def signatures(chunks: DataFrame) -> DataFrame:
    """(run, signature, chunk_id): the first error line that can be checked and says something; else the first that can.

    chunks: (run, id, text), in order of id as a string.
    """
    own = F.regexp_extract_all("text", F.lit(ERROR_LINE), F.lit(1))
    marked = F.transform(F.regexp_extract_all("text", F.lit(MARKED_LINE), F.lit(1)), lambda x: F.trim(x))
    found = chunks.filter(is_error(F.col("text"))).select("run", "id", F.posexplode(F.concat(own, marked)).alias("at", "line"))
    good = found.filter((F.trim("line") != "") & ~F.contains("line", F.lit('"')) & (normalize(F.col("line")) != ""))
    order = F.struct(F.col("line").rlike(TRAILER).alias("dull"), F.col("id"), F.col("at"))
    return good.groupBy("run").agg(F.min_by("line", order).alias("signature"), F.min_by("id", order).alias("chunk_id"))


def explain(runs: DataFrame, chunks: DataFrame, tickets: DataFrame, motivated_by: DataFrame) -> DataFrame:
    """(run, ord, kind, text, support) of the claims on every failed run.

    runs (run, status, started, text), chunks (run, id, text), tickets (id, text), motivated_by (pr, ticket, text).
    """
    failed = runs.filter("status = 'failed'")
    claim = lambda kind, order, text, support: (F.lit(order).alias("step"), F.lit(kind).alias("kind"), text.alias("text"), support.alias("support"))
    outcome = failed.select("run", *claim("outcome", 1, F.col("text"), F.array("run")))
    logs = chunks.filter(is_error(F.col("text"))).join(failed.select("run"), "run", "left_semi").select("run", *claim("log", 2, F.col("text"), F.array("id")))
    signed = signatures(chunks).join(failed.select("run", "started"), "run")
    earlier = chunks.join(runs.select("run", F.col("started").alias("at")), "run").select(F.col("id").alias("prior"), F.col("text").alias("prior_text"), "at")
    needles = signed.select(F.col("signature").alias("key"), F.col("signature").alias("needle")).distinct()
    seen = holding(earlier.select(F.col("prior").alias("id"), F.col("prior_text").alias("text")), needles).select(F.col("id").alias("prior"), F.col("key").alias("signature"))
    recur = signed.join(seen, "signature").join(earlier.select("prior", "at"), "prior").filter(F.col("at") < F.col("started")).groupBy("run", "signature", "chunk_id").agg(F.array_sort(F.collect_set("prior")).alias("priors"))
    named = F.concat(F.lit('"'), F.col("signature"), F.lit('" appears in '))
    again = recur.select("run", *claim("recurrence", 3, F.concat(named, F.concat_ws(" and ", F.transform(F.concat(F.array("chunk_id"), "priors"), lambda x: F.concat(F.lit("'"), x, F.lit("'"))))), F.concat(F.array("chunk_id"), "priors")))
    told = holding(tickets.select("id", "text"), needles).select(F.col("id").alias("ticket"), F.col("key").alias("signature"))
    known = signed.join(told, "signature").join(tickets.select(F.col("id").alias("ticket"), F.col("text").alias("ticket_text")), "ticket")
    incidents = known.select("run", *claim("incident", 4, F.concat(named, F.lit("'"), F.col("chunk_id"), F.lit("' and '"), F.col("ticket"), F.lit("'")), F.array("chunk_id", "ticket")))
    quoted = known.select("run", *claim("ticket", 5, F.col("ticket_text"), F.array("ticket")))
    fixes = known.join(motivated_by, "ticket").select("run", *claim("fix", 6, motivated_by["text"], F.array("ticket", "pr")))
    all_ = outcome
    for part in (logs, again, incidents, quoted, fixes):
        all_ = all_.unionByName(part)
    return all_.select("run", F.row_number().over(W.partitionBy("run").orderBy("step", "support", "text")).alias("ord"), "kind", "text", "support")


def route(question: Column, runs: Column, services: Column) -> Column:
    """rca, summary, service or lookup: a run's name goes before a pull request's, that before a service's."""
    has = lambda names: F.exists(names, lambda n: F.contains(normalize(question), normalize(n)))
    return F.when(question.rlike(RUN_ID), "rca").when(question.rlike(PR_ID), "summary").when(has(services), "service").otherwise("lookup")


def refusals(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """(qid, run, refusal): why a question on a failure gets no answer; null where it gets one."""
    asked = questions.select("qid", F.regexp_extract("question", f"({RUN_ID})", 1).alias("run"))
    found = asked.join(runs.select("run", "status"), "run", "left")
    return found.select("qid", "run", F.when(F.col("run") == "", "no run is named").when(F.col("status").isNull(), "the run is unknown").when(F.col("status") != "failed", "the run did not fail").alias("refusal"))
