"""The command line: python -m quarry COMMAND.

    ingest FOLDER OUT          records, nodes and edges of a declared folder as Parquet
    ask FOLDER QUESTION        an answer with its sources, or a refusal
    seal FILE                  the sealed form of a bundle {"leaves": {name: value, ...}, ...}
    verify FILE                its verdict and causes
    ledger head FILE           the root over a file of lines
    ledger prove FILE LINE     that a line is in it
    ledger check FILE OLD      that the first OLD lines have only been added to
    proof                      bounded soundness of the verifiers

Exit: 0 passed or answered, 1 refused, 2 wrong contents, 3 proves less, 4 tampered with.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.json_text import strict, written
from .operators import bundle, graph, integrity, resolution, retrieval, soundness
from .plans import lookup
from .sources import directory


def _session() -> SparkSession:
    return SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def ask(spark: SparkSession, folder: str, question: str) -> tuple[str, int]:
    """A named entity's facts and links; a refusal where its name stands for several; else the best records."""
    nodes, edges, records = directory.load(spark, folder)
    asked = spark.createDataFrame([(0, question)], "qid long, question string")
    named = nodes.filter("name is not null and name <> ''").withColumn("seq", F.xxhash64("id")).select("seq", "id", "name")
    entity = graph.components(nodes.select("id"), resolution.resolve(named, resolution.generic_tokens(spark, named)))
    way = lookup.directory_route(asked, named.join(entity, "id").select("name", F.col("entity_id").alias("entity"))).first()
    if way["refusal"]:
        return way["refusal"], 1
    if way["kind"] == "entity":
        own = entity.filter(F.col("entity_id") == way["entity"]).select("id")
        near = own.union(graph.neighbours(edges, own)).distinct()
        hits = nodes.join(near, "id", "left_semi").select(F.lit(0).alias("qid"), "text", "source", "locator", "id")
    else:
        top = retrieval.bm25(records, asked)
        hits = records.join(top, "id").select("qid", "text", "source", "locator", F.col("rank").cast("string").alias("id"))
    claims = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text", "source", "locator"))), lambda c: F.struct(c["text"].alias("text"), c["source"].alias("source"), c["locator"].alias("locator"))).alias("claims"))
    out = lookup.rendered(claims.withColumn("refusal", F.lit(None).cast("string"))).first()
    return (out["text"], 0) if out else ("no evidence", 1)


def _leaves(spark: SparkSession, data: dict) -> DataFrame:
    rows = [(0, k, None if isinstance(v, dict) and v == {"redacted": True} else written(v)) for k, v in data["leaves"].items()]
    return spark.createDataFrame(rows, "bundle_id long, name string, value string")


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return strict(f.read())


def seal(spark: SparkSession, path: str) -> str:
    data = _read(path)
    m, r = bundle.sealed(_leaves(spark, data))
    top = r.first()
    data["integrity"] = {"leaves": {x["name"]: x["digest"] for x in m.collect()}, "root": top["root"] if top else ""}  # one bundle
    return written(data)


def verify(spark: SparkSession, path: str) -> tuple[str, int]:
    try:
        data = _read(path)
        leaves, sealed = _leaves(spark, data), data["integrity"]
        m = spark.createDataFrame([(0, k, str(v)) for k, v in sealed["leaves"].items()], "bundle_id long, name string, digest string")
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        return f"TAMPERED\n- unreadable bundle: {error}", 4
    r = spark.createDataFrame([(0, str(sealed.get("root")))], "bundle_id long, root string")
    checks = spark.createDataFrame([(0, k, bool(c["recorded"]), bool(c["rederived"])) for k, c in enumerate(data.get("claims", []))], "bundle_id long, idx int, recorded boolean, rederived boolean")
    one = spark.createDataFrame([(0, str(data.get("engine", "1.0")), True)], "bundle_id long, engine string, has_evidence boolean")
    found = bundle.verdicts(one, "1.0", bundle.integrity(leaves, m, r), bundle.claim_problems(checks), leaves.filter("value is null").select("bundle_id", "name"), checks)
    return bundle.explained(found).first()["text"], found.first()["exit_code"]


def ledger(spark: SparkSession, what: str, path: str, number: str | None = None) -> tuple[str, int]:
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    levels = integrity.merkle_levels(graph.numbered(rows, ["at"], "i"), "i", "value")
    n = levels[0].count()
    if not n or what == "head":
        return (integrity.subtree(levels, 0, n).hex() if n else integrity.EMPTY_ROOT), 0
    k, head = int(number or 0), integrity.subtree(levels, 0, n).hex()
    if what == "prove":
        if not 0 <= k < n:
            return f"there is no line {k}", 1
        return json.dumps({"index": k, "size": n, "head": head, "path": integrity.inclusion_path(levels, k)}), 0
    if not 0 < k <= n:
        return f"there were never {k} lines", 1
    old = integrity.subtree(levels, 0, k).hex()
    path_ = integrity.consistency_path(levels, k, n)
    return json.dumps({"old": old, "new": head, "path": path_}), 0 if integrity.check_consistency(k, old, n, head, path_) else 2


def proof(spark: SparkSession) -> tuple[str, int]:
    rows = soundness.soundness(spark).orderBy("universe", "verifier").collect()  # six rows
    good = all((r["unsound"] == 0) == (r["verifier"] == "re-execution") for r in rows)
    return "\n".join([*(f"{r['universe']} {r['verifier']}: {r['states']} states, {r['passes']} passed, {r['unsound']} wrongly" for r in rows), "PROVED" if good else "REFUTED"]), 0 if good else 2


def main(args: list[str], spark: SparkSession | None = None) -> int:
    match args:
        case ["ingest", folder, out]:
            spark = spark or _session()
            for name, df in zip(("nodes", "edges", "records"), directory.load(spark, folder), strict=True):
                df.write.mode("overwrite").parquet(f"{out}/{name}")
            text, code = out, 0
        case ["ask", folder, question]:
            text, code = ask(spark or _session(), folder, question)
        case ["seal", path]:
            text, code = seal(spark or _session(), path), 0
        case ["verify", path]:
            text, code = verify(spark or _session(), path)
        case ["ledger", "head" | "prove" | "check" as what, path, *rest] if len(rest) < 2:
            text, code = ledger(spark or _session(), what, path, *rest)
        case ["proof"]:
            text, code = proof(spark or _session())
        case _:
            text, code = __doc__ or "", 2
    print(text)
    return code


def console() -> None:
    sys.exit(main(sys.argv[1:]))
