"""Actions drafted from answers: grounded fields, payloads, simulated execution, receipts. Nothing is sent anywhere.

An answer is (qid, kind, title, claims array<struct<text, support array<string>>>, refusal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import canonical_digest, idempotency_key
from ..functions.text import fence, normalize
from .bundle import quoted

# Which answers give which draft, and the keys whose values a receipt doesn't show.
DRAFTS = {"rca": "incident", "summary": "pr_summary"}
SECRET_KEY = r"(?i)(token|secret|password|authorization|api[_-]?key)"
MASK = "***"


def draft(answers: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, action, title, body, faithful, total, grounded): a field is faithful if a record that it cites holds its text.

    records (id, text). Refused answers, and kinds without a draft, give none.
    """
    action = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in DRAFTS.items()))
    fit = answers.filter(F.col("refusal").isNull() & (F.size("claims") > 0)).withColumn("action", action).filter("action is not null")
    fields = fit.select("qid", F.posexplode("claims").alias("at", "c")).select("qid", "at", F.col("c.text").alias("text"), F.explode_outer("c.support").alias("id"))
    held = fields.join(records.select("id", F.col("text").alias("record")), "id", "left").groupBy("qid", "at", "text").agg(F.bool_or(F.coalesce(F.contains(normalize(F.col("record")), normalize(F.col("text"))), F.lit(False))).alias("ok"))
    counts = held.groupBy("qid").agg(F.count_if("ok").alias("faithful"), F.count(F.lit(1)).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return fit.select("qid", "action", "title").join(counts, "qid").select("qid", "action", "title", "body", "faithful", "total", (F.col("faithful") == F.col("total")).alias("grounded"))


def payload(drafts: DataFrame, target: Column) -> DataFrame:
    """(qid, target, payload, key, withheld): the request as JSON with its idempotency key; a draft that isn't fully grounded is withheld."""
    mark = fence(F.col("body"))
    text = F.concat(mark, F.lit("\n"), "body", F.lit("\n"), mark)
    body = F.concat(F.lit('{"title":'), quoted(F.col("title")), F.lit(',"body":'), quoted(text), F.lit(',"labels":['), quoted(F.col("action")), F.lit("]}"))
    key = idempotency_key(F.lit("POST"), target, body)
    may = F.col("grounded")
    return drafts.select("qid", target.alias("target"), F.when(may, body).alias("payload"), F.when(may, key).alias("key"), (~may).alias("withheld"))


def execute(payloads: DataFrame, done: DataFrame, approved: Column) -> DataFrame:
    """(qid, outcome): simulated; what was done already (key) isn't done again, what isn't approved isn't done at all."""
    seen = payloads.join(done.select("key", F.lit(True).alias("exists")).distinct(), "key", "left")
    outcome = F.when(F.col("withheld"), "withheld").when(F.col("exists"), "exists").when(~F.coalesce(approved, F.lit(False)), "not approved").otherwise("simulated")
    return seen.select("qid", outcome.alias("outcome"))


def rederived(receipts: DataFrame, payloads: DataFrame) -> DataFrame:
    """(qid, problem): receipts (qid, payload, outcome) against what drafting and rendering give again; null where they agree."""
    both = receipts.select("qid", F.col("payload").alias("was"), "outcome").join(payloads.select("qid", F.col("payload").alias("now"), "withheld"), "qid", "left")
    problem = F.when(F.col("withheld").isNull(), "no such action").when(F.col("withheld") & F.col("was").isNotNull(), "an unapproved payload was sent").when(~canonical_digest(F.col("was")).eqNullSafe(canonical_digest(F.col("now"))), "the payload does not re-derive").when(F.col("withheld") & (F.col("outcome") != "withheld"), "the outcome does not re-derive")
    return both.select("qid", problem.alias("problem"))


def masked(receipts: DataFrame, column: str) -> DataFrame:
    """A map column with the values of secret keys masked."""
    return receipts.withColumn(column, F.transform_values(column, lambda k, v: F.when(k.rlike(SECRET_KEY), MASK).otherwise(v)))


def smoke(checks: dict[str, tuple[DataFrame, Column, bool]]) -> DataFrame:
    """(name, status): a row for each check (rows, what must hold of all, whether it only warns); without rows it is skipped."""
    out = None
    for name, (rows, holds, warns) in checks.items():
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(holds, F.lit(False))).alias("bad"))
        row = row.select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "SKIP").when(F.col("bad") == 0, "PASS").otherwise("WARN" if warns else "FAIL").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def conformance(found: DataFrame, methods: dict[str, tuple[str, ...]], threats: dict[str, tuple[str, ...]]) -> DataFrame:
    """(method, threat, detected, applicable): of the forgeries (forgery, layer) that a threat can make, how many a method sees.

    A method sees a forgery if it looks at its layer; found (forgery, layer, caught) says what the verifier caught.
    """
    spark = found.sparkSession
    grid = spark.createDataFrame([(m, layer) for m, layers in methods.items() for layer in layers], "method string, layer string").withColumn("looks", F.lit(True))
    can = spark.createDataFrame([(t, f) for t, forgeries in threats.items() for f in forgeries], "threat string, forgery string")
    names = spark.createDataFrame([(m,) for m in methods], "method string")
    cells = can.join(found, "forgery").crossJoin(F.broadcast(names)).join(grid, ["method", "layer"], "left")  # a few cells
    return cells.groupBy("method", "threat").agg(F.count_if(F.col("caught") & F.coalesce("looks", F.lit(False))).alias("detected"), F.count(F.lit(1)).alias("applicable"))
