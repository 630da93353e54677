"""Sealed bundles in bulk: manifests, roots, integrity, approvals, verdicts, mutants. One row a leaf, any number of bundles.

leaves (bundle_id, name, value): value is JSON text; a null value was withheld, and its leaf keeps the digest it was
sealed with. A bundle without leaves has the root of an empty manifest. A name that comes twice in a bundle breaks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import canonical_digest
from ..functions.text import digest

#: Verdicts by exit code.
VERDICTS = {0: "PASS", 2: "FAIL", 3: "DEGRADED", 4: "TAMPERED"}


def quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def manifest(leaves: DataFrame) -> DataFrame:
    """(bundle_id, name, digest) of the leaves that are there."""
    return leaves.filter("value is not null").select("bundle_id", "name", canonical_digest(F.col("value")).alias("digest"))


def roots(manifest_: DataFrame) -> DataFrame:
    """(bundle_id, root, leaves): the digest of the manifest's canonical JSON. A bundle's leaves meet in one row, as it travels whole."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(quoted(x["name"]), F.lit(":"), quoted(x["digest"])))
    return manifest_.groupBy("bundle_id").agg(digest(F.concat(F.lit("{"), F.array_join(lines, ","), F.lit("}"))).alias("root"), F.count(F.lit(1)).alias("leaves"))


def sealed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, roots) of bundles when they are sealed, with nothing withheld."""
    m = manifest(leaves)
    return m, roots(m)


def integrity(leaves: DataFrame, manifest_: DataFrame, roots_: DataFrame) -> DataFrame:
    """(bundle_id, problem): leaves that are missing, unexpected, altered or repeated, and roots that don't follow from the manifest."""
    now = manifest(leaves)
    both = manifest_.select("bundle_id", "name", F.col("digest").alias("was")).join(now.withColumnRenamed("digest", "is"), ["bundle_id", "name"], "full_outer")
    withheld = leaves.filter("value is null").select("bundle_id", "name", F.lit(True).alias("withheld")).distinct()
    both = both.join(withheld, ["bundle_id", "name"], "left")
    change = F.when(F.col("was").isNull(), "unexpected leaf ").when(F.col("is").isNull() & F.col("withheld").isNull(), "missing leaf ").when(F.col("is") != F.col("was"), "altered leaf ")
    changed = both.select("bundle_id", F.concat(change, F.col("name")).alias("problem")).filter("problem is not null")
    twice = leaves.groupBy("bundle_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bundle_id", F.concat(F.lit("repeated leaf "), F.col("name")).alias("problem"))
    wrong = roots_.select("bundle_id", F.col("root").alias("sealed")).join(roots(manifest_), "bundle_id", "full_outer").filter(~F.col("sealed").eqNullSafe(F.col("root"))).select("bundle_id", F.lit("root mismatch").alias("problem"))
    return changed.unionByName(twice).unionByName(wrong)


def claim_problems(checks: DataFrame) -> DataFrame:
    """(bundle_id, problem) of claims (bundle_id, idx, recorded, rederived) whose recorded verdict isn't the recomputed one."""
    return checks.filter(~F.col("recorded").eqNullSafe(F.col("rederived"))).select("bundle_id", F.concat(F.lit("claim "), F.col("idx").cast("string"), F.lit(" does not re-derive")).alias("problem"))


def answer_problems(answers: DataFrame) -> DataFrame:
    """(bundle_id, problem) of answers (bundle_id, recorded, rederived), JSON texts, that differ in canonical form."""
    return answers.filter(~canonical_digest(F.col("recorded")).eqNullSafe(canonical_digest(F.col("rederived")))).select("bundle_id", F.lit("the answer does not re-derive").alias("problem"))


def taxonomy(bundles: DataFrame, engine: str) -> DataFrame:
    """(bundle_id, status): re-derivable by this engine, by no engine that is here, or not evaluable for want of evidence."""
    status = F.when(~F.coalesce("has_evidence", F.lit(False)), "NOT-EVALUABLE").when(~F.col("engine").eqNullSafe(F.lit(engine)), "INTEGRITY-ONLY").otherwise("RE-DERIVED")
    return bundles.select("bundle_id", status.alias("status"))


def verdicts(bundles: DataFrame, engine: str, envelope: DataFrame, semantic: DataFrame, withheld: DataFrame, checks: DataFrame) -> DataFrame:
    """(bundle_id, status, problems, exit_code, verdict): broken envelopes before wrong contents before what proves less.

    bundles (bundle_id, engine, has_evidence); envelope and semantic (bundle_id, problem); withheld (bundle_id, name).
    """
    listed = lambda df, name: df.groupBy("bundle_id").agg(F.array_sort(F.collect_list("problem")).alias(name))
    honest = checks.filter(~F.col("recorded") & ~F.col("rederived")).select("bundle_id").union(withheld.select("bundle_id")).distinct().withColumn("less", F.lit(True))
    all_ = taxonomy(bundles, engine).join(listed(envelope, "broken"), "bundle_id", "left").join(listed(semantic, "wrong"), "bundle_id", "left").join(honest, "bundle_id", "left")
    judged = F.col("status") == "RE-DERIVED"
    code = F.when(F.col("broken").isNotNull(), 4).when(F.col("wrong").isNotNull() & (F.col("status") != "NOT-EVALUABLE"), 2).when(~judged | F.col("less").isNotNull(), 3).otherwise(0)
    none = F.array().cast("array<string>")
    verdict = F.coalesce(*(F.when(F.col("exit_code") == k, F.lit(v)) for k, v in VERDICTS.items()))
    return all_.select("bundle_id", "status", F.concat(F.coalesce("broken", none), F.coalesce("wrong", none)).alias("problems"), code.alias("exit_code")).withColumn("verdict", verdict)


def redacted(leaves: DataFrame, roots_: DataFrame, keep: DataFrame) -> DataFrame:
    """The leaves with all values withheld but those in keep (bundle_id, name); manifest and root stay as they are.

    A bundle that was never sealed, or one in which nothing would be withheld, is an error.
    """
    if not leaves.join(roots_, "bundle_id", "left_anti").isEmpty():
        raise ValueError("only a sealed bundle can be redacted")
    marked = leaves.join(keep.select("bundle_id", "name", F.lit(True).alias("stays")).distinct(), ["bundle_id", "name"], "left")
    if not marked.groupBy("bundle_id").agg(F.bool_and(F.coalesce("stays", F.lit(False))).alias("all")).filter("all").isEmpty():
        raise ValueError("nothing is withheld from some bundle")
    return marked.select("bundle_id", "name", F.when(F.col("stays"), F.col("value")).alias("value"))


def approval_payload(root: Column, note: Column, at: Column) -> Column:
    """The bytes that an approver signs, in canonical form."""
    value = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    return F.concat(F.lit('{"approves_root":'), quoted(root), F.lit(',"at":'), value(at), F.lit(',"format":{"major":1,"name":"approval"},"note":'), value(note), F.lit("}"))


def approvals(artifacts: DataFrame, recomputed: DataFrame, verified: Column) -> DataFrame:
    """(bundle_id, approver, problem) of artifacts (bundle_id, approves_root, approver, ...) against the root that was recomputed, never a stored one."""
    both = artifacts.join(recomputed.select("bundle_id", "root"), "bundle_id", "left")
    problem = F.when(~F.col("approves_root").eqNullSafe(F.col("root")), "approves another bundle").when(~F.coalesce(verified, F.lit(False)), "the signature does not verify")
    return both.select("bundle_id", "approver", problem.alias("problem"))


def explained(verdicts_: DataFrame) -> DataFrame:
    """(bundle_id, text): a verdict with its causes, a line each."""
    return verdicts_.select("bundle_id", F.concat_ws("\n", F.concat("verdict", F.lit(" ("), F.lower("status"), F.lit(")")), F.array_join(F.transform("problems", lambda p: F.concat(F.lit("- "), p)), "\n")).alias("text"))


#: What an audit asks for, and where the law names it.
AUDIT = (("Record-keeping / traceability", "Art. 12"), ("Reconstructing why an output was produced", "Art. 12 (purpose)"), ("Human oversight", "Art. 14"))


def audit(verdicts_: DataFrame, actions: DataFrame) -> DataFrame:
    """(bundle_id, concept, article, met): what a bundle shows of each concept; oversight only where it holds an action (bundle_id, approved)."""
    both = verdicts_.join(actions.select("bundle_id", "approved"), "bundle_id", "left")
    met = (F.col("verdict") != "TAMPERED", F.col("status") == "RE-DERIVED", F.col("approved"))
    rows = F.array(*(F.struct(F.lit(c).alias("concept"), F.lit(a).alias("article"), m.alias("met")) for (c, a), m in zip(AUDIT, met, strict=True)))
    return both.select("bundle_id", F.explode(rows).alias("r")).select("bundle_id", "r.*").filter("met is not null")


def mutants(leaves: DataFrame, manifest_: DataFrame, roots_: DataFrame, checks: DataFrame) -> dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]]:
    """Forged copies of every bundle: name -> (leaves, manifest, roots, checks, the verdict that must come out).

    A forger who can't seal alters leaves or roots; one who can seals again, so that only the contents tell.
    """
    first = leaves.groupBy("bundle_id").agg(F.min("name").alias("first"))
    mark = leaves.join(first, "bundle_id").withColumn("hit", F.col("name") == F.col("first"))
    edited = mark.select("bundle_id", "name", F.when(F.col("hit"), F.concat(F.lit("["), "value", F.lit(",0]"))).otherwise(F.col("value")).alias("value"))
    omitted = mark.filter(~F.col("hit")).select("bundle_id", "name", "value")
    extra = leaves.unionByName(first.select("bundle_id", F.lit("zz-extra").alias("name"), F.lit("1").alias("value")))
    flipped = checks.withColumn("recorded", F.when(F.col("idx") == 0, ~F.col("recorded")).otherwise(F.col("recorded")))
    doubted = checks.withColumn("recorded", F.lit(False)).withColumn("rederived", F.lit(False))
    resealed = lambda x: sealed(x)
    return {
        "honest": (leaves, manifest_, roots_, checks, "PASS"),
        "leaf tamper": (edited, manifest_, roots_, checks, "TAMPERED"),
        "leaf omission": (omitted, manifest_, roots_, checks, "TAMPERED"),
        "extra leaf": (extra, manifest_, roots_, checks, "TAMPERED"),
        "root mismatch": (leaves, manifest_, roots_.withColumn("root", F.reverse("root")), checks, "TAMPERED"),
        "manifest edit": (leaves, manifest_.withColumn("digest", F.reverse("digest")), roots_, checks, "TAMPERED"),
        "verdict flip": (leaves, *resealed(leaves), flipped, "FAIL"),
        "honest doubt": (leaves, *resealed(leaves), doubted, "DEGRADED"),
        "withheld leaf": (mark.select("bundle_id", "name", F.when(~F.col("hit"), F.col("value")).alias("value")), manifest_, roots_, checks, "DEGRADED"),
    }


def mutation_battery(bundles: DataFrame, engine: str, leaves: DataFrame, manifest_: DataFrame, roots_: DataFrame, checks: DataFrame) -> DataFrame:
    """(mutant, expected, bundles, caught): of how many bundles each forgery gets the verdict that it must."""
    out = None
    for name, (l, m, r, c, want) in mutants(leaves, manifest_, roots_, checks).items():
        found = verdicts(bundles, engine, integrity(l, m, r), claim_problems(c), l.filter("value is null").select("bundle_id", "name"), c)
        row = found.agg(F.count(F.lit(1)).alias("bundles"), F.count_if(F.col("verdict") == want).alias("caught")).select(F.lit(name).alias("mutant"), F.lit(want).alias("expected"), "bundles", "caught")
        out = row if out is None else out.unionByName(row)
    return out
