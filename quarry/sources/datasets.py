"""Folders of keyed tables as records and edges: ERP slices, delivery data, documents with a manifest, remote pages.

A dataset is declared by its tables; every cell is cleaned of control sequences and trimmed. A missing column, a repeated
id or a missing manifest is an error; missing cells are empty text, and an empty reference makes no edge.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import money, neutralize_controls
from .chunking import paragraphs
from .readers import csv_rows, locator, render_locator


@dataclass(frozen=True)
class Table:
    """`key` is joined by `glue` to the id `kind:...`; edges are (relation, target kind, its key columns)."""

    kind: str
    file: str
    key: tuple[str, ...]
    text: Callable[[], Column]
    need: tuple[str, ...] = ()
    name: str | None = None
    edges: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    attributes: tuple[str, ...] = ()
    glue: str = "-"


def _said(*parts: str) -> Column:
    """Plain words, and columns in braces."""
    return F.concat(*(F.coalesce(F.col(p[1:-1]), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts))


def _worth(amount: str, currency: str) -> Column:
    return money(F.col(currency), F.col(amount).cast("decimal(38,2)"))


# The tables of the ERP datasets and of delivery data.
ERP = (
    Table("I_Customer", "I_Customer.csv", ("Customer",), lambda: _said("Customer ", "{Customer}", ': "', "{CustomerName}", '" (account group ', "{CustomerAccountGroup}", ", country ", "{Country}", "); address ", "{AddressID}", "."), name="CustomerName", edges=(("has_address", "I_AddrOrgNamePostalAddress", ("AddressID",)),)),
    Table("I_AddrOrgNamePostalAddress", "I_AddrOrgNamePostalAddress.csv", ("AddressID",), lambda: _said("Address ", "{AddressID}", ': "', "{OrganizationName}", '", ', "{StreetName}", " ", "{HouseNumber}", ", ", "{PostalCode}", " ", "{CityName}", ", ", "{Country}", "."), name="OrganizationName", attributes=("PostalCode", "CityName")),
    Table("I_SalesDocument", "I_SalesDocument.csv", ("SalesDocument",), lambda: F.concat(_said("Sales document ", "{SalesDocument}", ": sold-to party ", "{SoldToParty}", ", net value "), _worth("TotalNetAmount", "TransactionCurrency"), _said(", dated ", "{SalesDocumentDate}", ".")), edges=(("sold_to", "I_Customer", ("SoldToParty",)),), attributes=("TotalNetAmount", "TransactionCurrency")),
    Table("I_SalesDocumentItem", "I_SalesDocumentItem.csv", ("SalesDocument", "SalesDocumentItem"), lambda: F.concat(_said("Item ", "{SalesDocumentItem}", " of sales document ", "{SalesDocument}", ": ", "{SalesDocumentItemText}", " (material ", "{Material}", "), quantity ", "{OrderQuantity}", ", net "), _worth("NetAmount", "TransactionCurrency"), F.lit(".")), edges=(("line_of", "I_SalesDocument", ("SalesDocument",)),)),
)
ERP_SLICE = (
    Table("Address", "addresses.csv", ("ADDRESSID",), lambda: F.concat(_said("Address ", "{ADDRESSID}", ": country "), F.when(F.col("COUNTRY") == "", "unknown").otherwise(F.col("COUNTRY")), F.when(F.col("REGION") == "", "").otherwise(_said(", region ", "{REGION}")), F.lit(".")), need=("COUNTRY", "REGION")),
    Table("Customer", "customers.csv", ("CUSTOMER",), lambda: _said("Customer ", "{CUSTOMER}", " (address ", "{ADDRESSID}", ")."), edges=(("located_at", "Address", ("ADDRESSID",)),)),
    Table("SalesDoc", "sales_docs.csv", ("SALESDOCUMENT",), lambda: _said("Sales document ", "{SALESDOCUMENT}", ": type ", "{SALESDOCUMENTTYPE}", ", currency ", "{TRANSACTIONCURRENCY}", ", incoterms ", "{INCOTERMSCLASSIFICATION}", ", created ", "{CREATIONDATE}", "."), need=("TRANSACTIONCURRENCY", "SALESDOCUMENTTYPE", "INCOTERMSCLASSIFICATION", "CREATIONDATE")),
    Table("SalesItem", "sales_items.csv", ("SALESDOCUMENT", "SALESDOCUMENTITEM"), lambda: _said("Sales document ", "{SALESDOCUMENT}", " item ", "{SALESDOCUMENTITEM}", ": product ", "{PRODUCT}", ", sold to ", "{SOLDTOPARTY}", "."), need=("PRODUCT",), edges=(("sold_to", "Customer", ("SOLDTOPARTY",)), ("line_of", "SalesDoc", ("SALESDOCUMENT",))), glue="/"),
)
DELIVERY_EDGES = {"pipelines.csv": ("Pipeline", "Component", "builds"), "runs.csv": ("Run", "Pipeline", "executes"), "tickets.csv": ("Ticket", "Component", "concerns")}
JOB_LINE, RESULT_LINE = r"(?s)^--- job: (.*?)(?: ---)?$", "=== result:"


def _key(kind: str, columns: tuple[str, ...], glue: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws(glue, *columns))


def keyed(spark: SparkSession, folder: str, tables: tuple[Table, ...], source: str, taken: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): (id, kind, name, source, locator, ingested_at, text, attributes map) and (src, dst, relation)."""
    nodes = edges = None
    glue_of = {t.kind: t.glue for t in tables}
    for t in tables:
        need = (*t.key, *t.need, *(c for _, _, cols in t.edges for c in cols), *((t.name,) if t.name else ()), *t.attributes)
        rows = csv_rows(spark, f"{folder}/{t.file}", tuple(dict.fromkeys(need)))
        rows = rows.select("row", *(F.trim(neutralize_controls(F.col(f"`{c}`"))).alias(c) for c in rows.columns if c != "row"))
        if not rows.groupBy(*t.key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{t.file}: an id occurs more than once")
        name = F.col(t.name) if t.name else F.lit(None).cast("string")
        attributes = F.map_from_arrays(F.array(*map(F.lit, t.attributes)), F.array(*map(F.col, t.attributes))) if t.attributes else F.create_map().cast("map<string,string>")
        part = rows.select(_key(t.kind, t.key, t.glue).alias("id"), F.lit(t.kind).alias("kind"), name.alias("name"), F.lit(f"{source}/{t.file}").alias("source"), render_locator(locator("table-row", table=F.lit(t.kind), row=F.col("row"))).alias("locator"), F.lit(taken).alias("ingested_at"), t.text().alias("text"), attributes.alias("attributes"))
        nodes = part if nodes is None else nodes.unionByName(part)
        for relation, target, columns in t.edges:
            there = F.concat_ws("", *columns) != ""
            links = rows.filter(there).select(_key(t.kind, t.key, t.glue).alias("src"), _key(target, columns, glue_of.get(target, "-")).alias("dst"), F.lit(relation).alias("relation"))
            edges = links if edges is None else edges.unionByName(links)
    return nodes, edges


def manifest(spark: SparkSession, path: str) -> dict:
    """A MANIFEST.json, one small file."""
    rows = spark.read.text(path, wholetext=True).take(1)
    if not rows:
        raise ValueError(f"{path}: no manifest")
    return json.loads(rows[0]["value"])


def documents(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """(id, source, locator, ingested_at, text): the paragraphs of the documents that MANIFEST.json lists; a listed file that isn't there is an error."""
    listed = manifest(spark, f"{folder}/MANIFEST.json")
    files = sorted(map(str, listed["documents"]))
    chunks = paragraphs(_files(spark, folder, files), "file", "text")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    place = render_locator(locator("doc-span", lines=F.concat("start_line", F.lit("-"), "end_line"), paragraph=F.col("chunk")))
    return chunks.select(F.concat(stem, F.lit(":chunk"), "chunk").alias("id"), F.concat(F.lit(f"{source}/"), "file").alias("source"), place.alias("locator"), F.lit(str(listed["snapshot_date"])).alias("ingested_at"), "text")


def _files(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    paths = [f"{folder}/{f}" for f in files]
    return spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def delivery_edges(tables: dict[str, DataFrame], pulls: DataFrame) -> DataFrame:
    """(src, dst, relation) of pipelines, runs and tickets by their keys, and of pull requests by the ticket that their text names.

    tables by file name, pulls (PR, Description).
    """
    out = None
    for file, (kind, target, relation) in DELIVERY_EDGES.items():
        part = tables[file].filter(F.col(target) != "").select(_key(kind, (kind,), "").alias("src"), _key(target, (target,), "").alias("dst"), F.lit(relation).alias("relation"))
        out = part if out is None else out.unionByName(part)
    ticket = F.regexp_extract("Description", r"\b([A-Z]+-\d+)\b", 1)
    named = pulls.withColumn("ticket", ticket).filter("ticket <> ''")
    return out.unionByName(named.select(_key("PR", ("PR",), "").alias("src"), _key("Ticket", ("ticket",), "").alias("dst"), F.lit("motivated_by").alias("relation")))


def log_section(first_line: Column) -> Column:
    """The job that a log chunk belongs to, `result` or `header`, from its first line."""
    return F.when(F.startswith(first_line, F.lit("--- job: ")), F.regexp_extract(first_line, JOB_LINE, 1)).when(F.startswith(first_line, F.lit(RESULT_LINE)), "result").otherwise("header")


def invented_firms(spark: SparkSession, n: int, seed: int = 20260605) -> DataFrame:
    """(id, name, city, currency, amount) of n firms, the same for a seed whatever the partitioning; every fifth repeats its forerunner's name with another legal form."""
    pick = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "base"), F.lit(len(words))) + 1).cast("int"))
    base = F.when(F.col("id") % 5 == 4, F.col("id") - 1).otherwise(F.col("id"))
    first = pick("first", ["Bittern", "Plover", "Curlew", "Avocet", "Dunlin", "Egret", "Grebe", "Teal", "Wigeon", "Osprey"])
    second = pick("second", ["Works", "Holdings", "Trading", "Foundry", "Mills", "Logistics", "Press", "Labs"])
    form = F.element_at(F.array(*map(F.lit, ["GmbH", "Inc", "Ltd", "AG"])), (F.col("id") % 4 + 1).cast("int"))
    code = F.initcap(F.translate(F.substring(F.md5(F.col("base").cast("string")), 1, 8), "0123456789", "ghijklmnop"))
    rows = spark.range(n).withColumn("base", base)
    return rows.select("id", F.concat(first, F.lit(" "), second, F.lit(" "), code, F.lit(" "), form).alias("name"), pick("city", ["Aachen", "Bern", "Graz", "Lyon"]).alias("city"), pick("currency", ["EUR", "USD"]).alias("currency"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10_000_000)) / 100).cast("decimal(12,2)").alias("amount"))
