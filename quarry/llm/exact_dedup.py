"""Exact dedup by composable polynomial fingerprints.

A chunk's fingerprint is sum(byte[i] * B**(n - 1 - i)) mod p under two (B, p). Fingerprints of neighbouring chunks
combine by length-shifted arithmetic: f(xy) = f(x) * B**len(y) + f(y). Texts above `huge_bytes` are dealt out as chunk
rows that different tasks hash; their fingerprints are combined by a SQL fold. Rows of equal fingerprint and length are
then compared chunk by chunk with the group's first row, and rows that differ (a collision) are regrouped by SHA-256.

Defined results: a null text is empty; a null id ranks below every id; of rows that repeat both id and text exactly one
is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_text, map_rows, materialise, sha_hex, small

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
HUGE_BYTES = 4 << 20
KEY = ["n_bytes", "f1", "f2"]
_weights: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """B**(CHUNK - 1 - i) for i < CHUNK, for each base; made once per process."""
    if not _weights:
        for base, p in zip(BASES, PRIMES, strict=True):
            w, x = np.empty(CHUNK, np.uint64), 1
            for i in range(CHUNK - 1, -1, -1):
                w[i], x = x, x * base % p
            _weights.append(w)
    return _weights


def chunk_fingerprint(data: np.ndarray) -> tuple[int, int]:
    """Of at most CHUNK bytes."""
    wide = data.astype(np.uint64)
    return tuple(int(np.dot(wide, w[CHUNK - len(data) :])) % p for w, p in zip(_powers(), PRIMES, strict=True))


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    return tuple((a * pow(base, right_bytes, p) + b) % p for a, b, base, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprint(data: np.ndarray) -> tuple[int, int]:
    out = (0, 0)
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        out = combine(out, chunk_fingerprint(piece), len(piece)) if at else chunk_fingerprint(piece)
    return out


def _hash_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    *keep, body = batch.columns
    prints = [fingerprint(np.frombuffer(x.as_buffer(), np.uint8)) for x in body]
    return pa.record_batch([*keep, pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64())], [*batch.schema.names[:-1], "f1", "f2"])


def fingerprints(docs: DataFrame, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, f1, f2) of each row."""
    rows = docs.select("doc_id", sha_hex(F.col("text")).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("body"))
    plain = map_rows(rows.filter(F.col("n_bytes") <= huge_bytes), _hash_batch, "doc_id long, text_sha256 string, n_bytes long, f1 long, f2 long")
    huge = rows.filter(F.col("n_bytes") > huge_bytes).withColumn("row", F.monotonically_increasing_id())
    pieces = huge.select("row", "doc_id", "text_sha256", "n_bytes", F.posexplode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(CHUNK))).alias("k", "at"), "body").select("row", "doc_id", "text_sha256", "n_bytes", "k", F.expr(f"substring(body, cast(at + 1 as int), {CHUNK})").alias("piece"))
    hashed = map_rows(pieces.repartition(F.col("row"), F.col("k")), _hash_batch, "row long, doc_id long, text_sha256 string, n_bytes long, k int, f1 long, f2 long")
    # every chunk but the last has CHUNK bytes, so the shift is B**CHUNK or B**(rest)
    folds = []
    for name, base, p in zip(("f1", "f2"), BASES, PRIMES, strict=True):
        full = pow(base, CHUNK, p)
        tail = f"aggregate(sequence(1, cast((n_bytes - 1) % {CHUNK} + 1 as int)), 1L, (a, i) -> a * {base}L % {p}L)"
        folds.append(F.expr(f"aggregate(parts, 0L, (a, x) -> (a * if((x.k + 1) * {CHUNK}L <= n_bytes, {full}L, {tail}) + x.{name}) % {p}L)").alias(name))
    joined = hashed.groupBy("row", "doc_id", "text_sha256", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("k", "f1", "f2"))).alias("parts")).select("doc_id", "text_sha256", "n_bytes", *folds)
    return plain.unionByName(joined)


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunk rows of the texts; the empty text has one empty chunk."""
    return rows.withColumn("body", F.col("text").cast("binary")).select("doc_id", *KEY, F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(CHUNK))).alias("k", "at"), "body").select("doc_id", *KEY, "k", F.expr(f"substring(body, cast(at + 1 as int), {CHUNK})").alias("piece"))


def _classes(prints: DataFrame, key: list[str]) -> DataFrame:
    return prints.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def collisions(docs: DataFrame, prints: DataFrame, classes: DataFrame, n_classes: int) -> DataFrame:
    """(doc_id, key) of rows whose text differs from that of their class's first row in some chunk."""
    ids = materialise(prints.join(small(classes, 48, n_classes), KEY).select(F.col("doc_id").alias("copy_id")).distinct(), "copies")
    texts = docs.join(small(ids, 16), F.col("doc_id").eqNullSafe(F.col("copy_id")), "left_semi")
    texts = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    hashed = map_rows(texts.select("doc_id", "text", "n_bytes", F.col("text").cast("binary").alias("body")), _hash_batch, "doc_id long, text string, n_bytes long, f1 long, f2 long")
    both = hashed.join(classes.select(*KEY, "keep_id"), KEY)
    firsts = _chunks(both.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(KEY)).drop("doc_id").withColumnRenamed("piece", "first_piece")
    others = _chunks(both.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    return others.join(firsts, [*KEY, "k"]).filter("piece <> first_piece").select("doc_id", *KEY).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = id_text(docs, id_col, text_col)
    prints = materialise(fingerprints(docs, huge_bytes), "fingerprints")
    classes = materialise(_classes(prints, KEY), "classes")
    n_classes = classes.count()
    key = KEY
    if n_classes:
        differ = materialise(collisions(docs, prints, classes, n_classes), "collisions")
        if not differ.isEmpty():
            same = F.lit("")
            marked = prints.join(differ.withColumn("differs", F.lit(True)), [prints["doc_id"].eqNullSafe(differ["doc_id"]), *(prints[k] == differ[k] for k in KEY)], "left")
            prints = materialise(marked.select(prints["*"], F.when(F.col("differs"), prints["text_sha256"]).otherwise(same).alias("apart")), "regrouped")
            key = [*KEY, "apart"]
            classes = materialise(_classes(prints, key), "classes")
            n_classes = classes.count()
    out = prints.join(small(classes, 48, n_classes), key, "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", *key
    )
    first = out.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1))
    repeated = first.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    result = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if not n_classes or repeated.isEmpty():
        return out.select(*result)
    # rows that repeat id and text: number them, so that only one stays
    twins = first.join(repeated, key, "left_semi")
    numbered = twins.withColumn("at", F.row_number().over(W.partitionBy(*key).orderBy("doc_id"))).select("doc_id", "keep_id", "group_size", (F.col("at") == 1).alias("kept"), "text_sha256")
    rest = out.join(repeated.withColumn("twin", F.lit(True)), key, "left").filter(~(F.coalesce("twin", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    return rest.select(*result).unionByName(numbered)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat id and text any one.

    The rows travel in one struct, so no column name can clash, and meet the few keys that lose a row only.
    """
    found = exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    losers = materialise(found.filter("not stays or n > 1").select("id", "sha", "stays"), "losers")
    n = losers.count()
    rows = docs.select(docs[id_col].cast("long").alias("key"), sha_hex(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("digest"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    on = F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha"))
    out = rows.join(small(losers, 112, n), on, "left_anti")
    twins = losers.filter("stays")
    if not twins.isEmpty():
        out = out.unionByName(rows.join(small(twins, 112, n), on, "left_semi").dropDuplicates(["key", "digest"]))
    return out.select("row.*")
