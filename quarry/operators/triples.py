"""The graph as RDF triples in N-Triples form, and back. The namespace is a parameter; no product's names are built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that an N-Triples literal may not hold raw, or that tools take for line ends (fixed values).
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
CODED = [chr(c) for c in (*range(0, 9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x85, 0x2028, 0x2029)]


def escaped(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    for ch in CODED:
        c = F.replace(c, F.lit(ch), F.lit(f"\\u{ord(ch):04X}"))
    return c


def unescaped(c: Column) -> Column:
    """Escapes read from left to right, so that what follows an escaped backslash isn't taken for one."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\.|[^\\]+)"), F.lit(1))
    known = F.create_map(*(F.lit(x) for plain, coded in ESCAPES for x in (coded, plain)))
    read = F.transform(parts, lambda p: F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}$"), F.decode(F.unhex(F.substr(p, F.lit(3))), "UTF-16BE")).otherwise(F.coalesce(F.try_element_at(known, p), p)))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(read, "")).otherwise(c)


def iri(base: str, kind: str, c: Column) -> Column:
    """Percent-encoded; url_encode writes a space as + and leaves *, which differ here."""
    coded = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"{base}{kind}/"), coded)


PROPERTIES = ("kind", "name", "text", "source", "ingested_at", "locator", "attributes")


def graph_triples(nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """(s, p, o, is_iri): the properties of nodes that are there and not null, then edges; a repeated edge is an error, as sets would lose it.

    attributes may be a map; it is written as JSON, in order of its keys.
    """
    if not edges.groupBy("src", "dst", "relation").count().filter("count > 1").isEmpty():
        raise ValueError("a repeated identical edge cannot be exported")
    kinds = dict(nodes.dtypes)
    value = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if kinds[c].startswith("map") else F.col(c).cast("string")
    own = iri(base, "node", F.col("id"))
    facts = nodes.select(own.alias("s"), F.explode(F.array(*(F.struct(F.lit(f"{base}prop/{c.replace('_', '-')}").alias("p"), value(c).alias("o")) for c in PROPERTIES if c in kinds))).alias("x"))
    facts = facts.select("s", "x.p", "x.o", F.lit(False).alias("is_iri")).filter("o is not null")
    return facts.unionByName(edges.select(iri(base, "node", F.col("src")).alias("s"), iri(base, "rel", F.col("relation")).alias("p"), iri(base, "node", F.col("dst")).alias("o"), F.lit(True).alias("is_iri")))


def _assertions(rows: DataFrame, base: str, kind: str, ends: dict[str, str], said: tuple[str, ...]) -> DataFrame:
    own = F.concat(F.lit(f"{base}{kind}/"), F.col("i").cast("string"))
    parts = [F.struct(F.lit(f"{base}prop/{p}").alias("p"), iri(base, "node", F.col(c)).alias("o"), F.lit(True).alias("is_iri")) for p, c in ends.items()]
    parts += [F.struct(F.lit(f"{base}prop/{c}").alias("p"), F.col(c).cast("string").alias("o"), F.lit(False).alias("is_iri")) for c in said if c in rows.columns]
    return rows.select(own.alias("s"), F.explode(F.array(*parts)).alias("x")).select("s", "x.p", "x.o", "x.is_iri").filter("o is not null")


def resolution_triples(resolutions: DataFrame, base: str) -> DataFrame:
    """Of resolutions (i, node_a, node_b, score, confidence, reason), numbered by i."""
    return _assertions(resolutions, base, "resolution", {"a": "node_a", "b": "node_b"}, ("score", "confidence", "reason"))


def mention_triples(mentions: DataFrame, base: str) -> DataFrame:
    """Of mentions (i, chunk, node, confidence, reason), numbered by i."""
    return _assertions(mentions, base, "mention", {"chunk": "chunk", "node": "node"}, ("confidence", "reason"))


def to_lines(triples: DataFrame) -> DataFrame:
    shown = F.when(F.col("is_iri"), F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"')))
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), shown, F.lit(" .")).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    pattern = r'(?s)^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"(.*)") \.$'
    part = lambda k: F.regexp_extract("value", pattern, k)
    resource = F.col("value").rlike(r"(?s)^<[^>]*> <[^>]*> <")
    return lines.filter(F.trim("value") != "").select(part(1).alias("s"), part(2).alias("p"), F.when(resource, part(3)).otherwise(unescaped(part(4))).alias("o"), resource.alias("is_iri"))
