"""Vectors beside words: names resolved by their stems' vectors, retrieval by vectors where there is an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEGAL_SUFFIXES, ORG_DESCRIPTORS, normalize
from . import retrieval

NEIGHBOURS, THRESHOLD, LEAST_DF = 10, 0.85, 3
SEPARATORS = r"[\s\-_/.,&]+"


def name_parts(c: Column) -> Column:
    """All parts of a name in normalised form, single characters too."""
    return F.filter(F.transform(F.split(c, SEPARATORS), lambda t: normalize(t)), lambda t: t != "")


def stoplist(names: DataFrame, least: int = LEAST_DF) -> DataFrame:
    """(token) that stands for no firm of its own: fixed ones, and those of `least` names or more; names (id, name)."""
    often = names.select(F.explode(F.array_distinct(name_parts(F.col("name")))).alias("token")).groupBy("token").count().filter(F.col("count") >= least).select("token")
    fixed = names.sparkSession.createDataFrame([(t,) for t in sorted(set(LEGAL_SUFFIXES) | set(ORG_DESCRIPTORS))], "token string")
    return often.union(fixed).distinct()


def stems(names: DataFrame, generic: DataFrame) -> DataFrame:
    """(id, stem): what is left of a name without generic tokens, in order; names without any rest drop out."""
    parts = names.select("id", F.posexplode(name_parts(F.col("name"))).alias("at", "token")).join(generic, "token", "left_anti")
    return parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("stem"))


def gram_vector(text: Column, size: int = 64) -> Column:
    """A stand-in for a model: counts of a text's three-grams in `size` hash slots. Any function of (id, text) to (id, embedding) may take its place."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substr(padded, i, F.lit(3))), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda slot: F.size(F.filter(grams, lambda g: g == slot)).cast("float"))


def proposals(vectors: DataFrame, model: str, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """(node_a, node_b, score, confidence, reason) of pairs (id, embedding) near enough among each other's k nearest, each once."""
    near = retrieval.nearest(vectors, vectors, k + 1, "id", "embedding")
    pairs = retrieval.symmetric_pairs(near, threshold)
    return pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "score", F.least(F.lit(1.0), "score").alias("confidence"), F.concat(F.lit(f"embedding match ({model}, cosine "), F.format_number("score", 3), F.lit(")")).alias("reason"))


def hits(questions: DataFrame, records: DataFrame, k: int = 5, vectors: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): by vectors (id, embedding) and (qid, embedding) where there are any, cosine above 0; else by BM25."""
    if vectors is None or asked is None:
        return retrieval.bm25(records, questions, k)
    found = retrieval.nearest(vectors, asked.select(F.col("qid").alias("id"), "embedding"), k, "id", "embedding")
    return found.filter("score > 0").select("qid", "id", "score", "rank")
