"""BM25 and vector retrieval in batches of questions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import retrieval_tokens
from .graph import cut_lineage

K1, B = 1.5, 0.75


def postings(records: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, length, term, tf); records without terms have one row with a null term, as they count for the averages."""
    tokens = records.select(F.col(id_col).alias("id"), retrieval_tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))
    return tokens.select("id", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term")).groupBy("id", "length", "term").agg(F.count("term").alias("tf"))


def bm25(records: DataFrame, questions: DataFrame, k: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(qid, id, score, rank): the k best records of each question (qid, question) with a score above 0; ties by id.

    Records are tokenised once, and only the tokens are written; of these only terms that some question has are counted. A
    term that a question repeats counts as often. The top k are cut before the shuffle where Spark can.
    """
    asked = questions.select("qid", F.explode(retrieval_tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    tokens = cut_lineage(records.select(F.col(id_col).alias("id"), retrieval_tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))).withColumn("length", F.size("tokens"))
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = tokens.select("id", "length", F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = cut_lineage(hits)
    found = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(found, "term").join(F.broadcast(size), F.lit(True)).join(asked, "term")  # size is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    total = scored.groupBy("qid", "id").agg(F.sum(F.col("times") * idf * weight).alias("score")).filter("score > 0")
    return top(total, k, "qid", "id")


def top(scored: DataFrame, k: int, group: str, tie: str) -> DataFrame:
    # sums of doubles differ in the last digits with the order of rows; equal scores must tie all the same
    w = W.partitionBy(group).orderBy(F.desc(F.round("score", 9)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(k, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; a zero vector, a null or one of another length than the first stays zero and scores 0."""
    rows = [np.array([v or 0.0 for v in x], np.float64) if x is not None else np.zeros(0) for x in column.to_pylist()]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        if len(x) == width:
            out[k] = x
    norms = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norms == 0, 1, norms)[:, None]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, block_rows: int = 4096) -> DataFrame:
    """(qid, id, score, rank) by cosine; a zero vector scores 0; ties by id.

    An exact search: every query meets every vector, as products of matrices. Vectors are dealt to parts and queries to
    blocks of about `block_rows`; a task holds one part and one block, and sends on the k best of each query only. What is
    shuffled is the vectors times the number of blocks and the queries times that of parts.
    """
    n, m = vectors.count(), queries.count()
    parts = parts or max(1, math.ceil(n / 65536), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 256))
    blocks = max(1, math.ceil(m / block_rows))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    left = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), dealt(id_col, parts).alias("part"), every(blocks).alias("block"))
    right = queries.select(F.col(id_col).alias("qid"), F.col(vector_col).alias("q"), every(parts).alias("part"), dealt(id_col, blocks).alias("block"))
    kind = dict(vectors.dtypes)[id_col]

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids = own["id"].to_pylist(), asked["qid"].to_pylist()
        a, b = _matrix(asked["q"]), _matrix(own["v"])
        out: dict[str, list] = {"qid": [], "id": [], "score": []}
        for at in range(0, len(qids) if ids else 0, 256):
            scores = a[at : at + 256] @ b.T if a.shape[1] == b.shape[1] else np.zeros((min(256, len(qids) - at), len(ids)))
            for row, qid in zip(scores, qids[at : at + 256], strict=True):
                least = np.partition(row, -k)[-k] if k < len(row) else -2.0
                found = sorted((-round(float(row[i]), 9), ids[i], i) for i in np.flatnonzero(row >= least - 1e-9).tolist())[:k]
                out["qid"] += [qid] * len(found)
                out["id"] += [x[1] for x in found]
                out["score"] += [float(row[x[2]]) for x in found]
        return pa.table({"qid": pa.array(out["qid"], asked["qid"].type), "id": pa.array(out["id"], own["id"].type), "score": pa.array(out["score"], pa.float64())})

    if k < 1:
        return vectors.select(F.col(id_col).alias("qid"), F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    scored = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(best, f"qid {dict(queries.dtypes)[id_col]}, id {kind}, score double")
    return top(scored, k, "qid", "id")


def symmetric_pairs(neighbours: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs above a threshold, each once, without a vector and itself."""
    return neighbours.filter((F.col("qid") != F.col("id")) & (F.col("score") >= threshold)).groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.max("score").alias("score"))


def answers(hits: DataFrame, questions: DataFrame, records: DataFrame, refusal: str = "no evidence") -> DataFrame:
    """(qid, question, claims, refusal): one claim for each hit with its record as support, or else a refusal."""
    claims = hits.join(records.select("id", "text"), "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("text"), F.array("id").alias("support")))).alias("claims"))
    return questions.join(claims, "qid", "left").select("qid", "question", "claims", F.when(F.col("claims").isNull(), F.lit(refusal)).alias("refusal"))
