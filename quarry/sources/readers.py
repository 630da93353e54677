"""Readers that give rows as records: id, source, locator, snapshot date, text."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunking import log_chunks

JOBS = "array<struct<name:string,conclusion:string,status:string,steps:array<struct<number:int,name:string,conclusion:string>>>>"
CI_RUN = f"databaseId bigint, workflowName string, displayTitle string, headBranch string, headSha string, event string, conclusion string, createdAt string, name string, jobs {JOBS}"
PULL = "number bigint, title string, state string, author string, createdAt string, mergedAt string, headRef string, baseRef string, body string"


def csv_rows(spark: SparkSession, path: str, need: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings, '' for missing cells, and row: the place in the file from 1."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    # a multi-line file is one split, so this id counts its rows without a shuffle
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns]
    return rows.select((F.monotonically_increasing_id() + 1).alias("row"), *cells)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of each file; name without folder and ending."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(stem.alias("name"), F.col("value").alias("text"))


def ci_runs(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of CI runs with their first failed job and its first failed step."""
    failed = lambda rows: F.get(F.filter(rows, lambda x: x["conclusion"] == "failure"), F.lit(0))
    runs = spark.read.schema(CI_RUN).json(path, multiLine=True)
    return runs.withColumn("failed_job", failed(F.coalesce("jobs", F.array().cast(JOBS)))).withColumn("failed_step", failed(F.col("failed_job.steps"))["name"]).withColumn("failed_job", F.col("failed_job.name"))


def pulls(spark: SparkSession, path: str) -> DataFrame:
    """Pull requests from files named by their number, <number>.json; others are left out. Order is by number, not by name."""
    rows = spark.read.schema(PULL).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file"))
    return rows.filter(F.col("file").rlike(r"^\d+\.json$")).drop("file")


def ci_logs(runs: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the chunks of runs' logs (name, text), named by the run's id, and their links to the runs (databaseId); a log without a run is left out."""
    known = runs.select(F.col("databaseId").cast("string").alias("run")).distinct()
    chunks = log_chunks(logs.select(F.col("name").alias("run"), "text").join(known, "run", "left_semi"))
    own = F.concat("run", F.lit(":"), "name")
    place = render_locator(locator("log-span", job=F.col("job"), step=F.col("step"), lines=F.concat("start_line", F.lit("-"), "end_line")))
    nodes = chunks.select(own.alias("id"), F.lit("log-span").alias("kind"), F.concat(F.lit("logs/"), "run", F.lit(".log")).alias("source"), place.alias("locator"), "text")
    return nodes, chunks.select(own.alias("src"), F.concat(F.lit("Run:"), "run").alias("dst"), F.lit("log_of").alias("relation"))


def aliases(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def template(text: str) -> Column:
    """A `{column}` template as a concatenation; only plain names, no attributes, conversions or format specs."""
    parts: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(text):
        parts.append(F.lit(literal))
        if name is not None:
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or spec or conversion:
                raise ValueError(f"only plain {{column}} fields are allowed, not {name!r}")
            parts.append(F.col(name))
    return F.concat(*parts) if parts else F.lit("")


def locator(kind: str, **parts: Column) -> Column:
    """An ordered locator: kind and (label, value) pairs."""
    pairs = [F.struct(F.lit(k.replace("_", " ")).alias("label"), v.cast("string").alias("value")) for k, v in parts.items()]
    return F.struct(F.lit(kind).alias("kind"), F.array(*pairs).alias("parts"))


def render_locator(c: Column) -> Column:
    return F.array_join(F.transform(c["parts"], lambda p: F.concat(p["label"], F.lit(" "), p["value"])), ", ")


@dataclass(frozen=True)
class TableSpec:
    """A declared table: rows become records `name:id` with text by template and edges by foreign key."""

    name: str
    file: str
    id: str
    text: str
    display_name: str | None = None
    attributes: tuple[str, ...] = ()
    match_fields: tuple[str, ...] = ()
    edges: tuple[tuple[str, str, str], ...] = field(default=())  # column, to, relation

    def __post_init__(self):
        if ":" in self.name or not self.name:
            raise ValueError("a table's name must not be empty or hold a colon")
        if not set(self.match_fields) <= set(self.attributes):
            raise ValueError("match_fields must be attributes")


def declared(spark: SparkSession, folder: str, tables: list[TableSpec], taken: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a declared folder; a repeated id is an error."""
    names = [t.name for t in tables]
    if not tables or len(set(names)) != len(names):
        raise ValueError("at least one table is needed, and names must differ")
    nodes = edges = None
    for t in tables:
        if bad := [to for _, to, _ in t.edges if to not in names]:
            raise ValueError(f"unknown edge target(s): {', '.join(bad)}")
        rows = csv_rows(spark, f"{folder}/{t.file}", (t.id, *t.attributes, *(e[0] for e in t.edges)))
        if not rows.groupBy(t.id).count().filter("count > 1").isEmpty():
            raise ValueError(f"{t.name}: an id occurs more than once")
        own = F.concat(F.lit(f"{t.name}:"), F.col(t.id))
        pairs = F.array(*(F.struct(F.lit(a).alias("key"), F.col(a).alias("value")) for a in t.attributes)) if t.attributes else F.array().cast("array<struct<key:string,value:string>>")
        name = F.col(t.display_name) if t.display_name else F.lit(None).cast("string")
        part = rows.select("row", own.alias("id"), F.lit(t.name).alias("kind"), name.alias("name"), pairs.alias("attributes"), F.lit(t.file).alias("source"), render_locator(locator("table-row", row=F.col("row"))).alias("locator"), F.lit(taken).alias("ingested_at"), template(t.text).alias("text"))
        nodes = part if nodes is None else nodes.unionByName(part)
        for column, to, relation in t.edges:
            links = rows.filter(F.col(column) != "").select(own.alias("src"), F.concat(F.lit(f"{to}:"), F.col(column)).alias("dst"), F.lit(relation).alias("relation"))
            edges = links if edges is None else edges.unionByName(links)
    return nodes, edges if edges is not None else spark.createDataFrame([], "src string, dst string, relation string")
