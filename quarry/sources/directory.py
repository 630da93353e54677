"""A folder that declares itself: `corpus.toml` names tables, their keys and links, and documents by file or glob.

    name = "shop"
    snapshot_date = "2026-01-01"
    [[tables]]
    name = "Firm"; file = "firms.csv"; id = "id"; text = "Firm {id}: {title}"; display_name = "title"
    edges = [{ column = "city", to = "City", relation = "located_in" }]
    [[documents]]
    glob = "notes/*.md"

Every path stays inside the folder; a glob leaves out the declaration itself and the files of tables, and must find something.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunking import paragraphs
from .readers import TableSpec, declared, locator, render_locator

FILE = "corpus.toml"


class DeclarationError(ValueError):
    """What is wrong with a declaration, in words for its author."""


def _text(raw: dict, key: str, where: str) -> str:
    value = raw.get(key)
    if not isinstance(value, str) or not value:
        raise DeclarationError(f"{where}: {key} must be a text that is not empty")
    return value


def _inside(path: str, where: str) -> str:
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "~")) or ":" in path or ".." in parts:
        raise DeclarationError(f"{where}: {path} leads out of the folder")
    return path


def _names(raw: dict, key: str, where: str) -> tuple[str, ...]:
    value = raw.get(key, [])
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise DeclarationError(f"{where}: {key} must be a list of texts")
    return tuple(value)


def parse(text: str) -> tuple[str, str, list[TableSpec], list[str]]:
    """(name, snapshot date, tables, globs of documents)."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise DeclarationError(f"{FILE} is no valid TOML: {error}") from error
    if not raw.get("tables"):
        raise DeclarationError(f"{FILE}: at least one table is needed")
    tables, globs = [], []
    for k, t in enumerate(raw["tables"]):
        where = f"table {k + 1}"
        edges = tuple((_text(e, "column", where), _text(e, "to", where), _text(e, "relation", where)) for e in t.get("edges", []))
        try:
            tables.append(TableSpec(_text(t, "name", where), _inside(_text(t, "file", where), where), _text(t, "id", where), _text(t, "text", where), t.get("display_name"), _names(t, "attributes", where), _names(t, "match_fields", where), edges))
        except DeclarationError:
            raise
        except ValueError as error:
            raise DeclarationError(f"{where}: {error}") from error
    for k, d in enumerate(raw.get("documents", [])):
        where = f"documents {k + 1}"
        if ("file" in d) == ("glob" in d):
            raise DeclarationError(f"{where}: one of file and glob is needed")
        globs.append(_inside(_text(d, "file" if "file" in d else "glob", where), where))
    return str(raw.get("name", "")), str(raw.get("snapshot_date", "")), tables, globs


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, records): the declared tables, their links, and all texts to search, paragraphs of documents included."""
    rows = spark.read.text(f"{folder}/{FILE}", wholetext=True).take(1)
    name, taken, tables, globs = parse(rows[0]["value"] if rows else "")
    nodes, edges = declared(spark, folder, tables, taken)
    records = nodes.select("id", "source", "locator", "ingested_at", "text")
    own = {FILE, *(t.file.rpartition("/")[2] for t in tables)}
    for g in globs:
        found = spark.read.text(f"{folder}/{g}", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text")).filter(~F.col("file").isin(*own))
        chunks = paragraphs(found, "file", "text")
        place = render_locator(locator("doc-span", lines=F.concat("start_line", F.lit("-"), "end_line"), paragraph=F.col("chunk")))
        stem = F.regexp_replace("file", r"\.[^.]*$", "")
        records = records.unionByName(chunks.select(F.concat(stem, F.lit(":chunk"), "chunk").alias("id"), F.col("file").alias("source"), place.alias("locator"), F.lit(taken).alias("ingested_at"), "text"))
    return nodes, edges, records
