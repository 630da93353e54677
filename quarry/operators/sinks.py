"""Writers: snapshots swapped in whole, last-write-wins upserts, an evaluation journal, batched statements over an injected connection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import scrub

INSERT_BATCH = 500


def _fs(df: DataFrame, path: str):
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), where


def write_snapshot(df: DataFrame, path: str) -> dict[str, int]:
    """Every text column scrubbed, written beside `path` and swapped in by rename, so readers see the old or the new rows; returns what was scrubbed."""
    hits, columns = {}, []
    for name, kind in df.dtypes:
        if kind == "string":
            clean, found = scrub(F.col(f"`{name}`"))
            columns.append(clean.alias(name))
            for k, c in found.items():
                hits[k] = hits.get(k, F.lit(0)) + F.coalesce(c, F.lit(0))
        else:
            columns.append(F.col(f"`{name}`"))
    stage, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.select(*columns).write.parquet(stage)
    counts = df.agg(*(F.sum(c).alias(k) for k, c in hits.items())).first().asDict() if hits else {}
    fs, target = _fs(df, path)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target) and not fs.rename(target, hadoop(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(hadoop(stage), target):
        fs.rename(hadoop(old), target)
        raise OSError(f"cannot swap in {path}")
    fs.delete(hadoop(old), True)
    return {k: int(v) for k, v in counts.items() if v}


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: of the new rows the last by `order`, else the old one."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("row")).select("row.*")
    return old.join(last, key, "left_anti").unionByName(last.select(*old.columns))


def append_journal(scores: DataFrame, path: str, at: str, label: str) -> None:
    scores.withColumn("at", F.lit(at)).withColumn("label", F.lit(label)).write.mode("append").json(path)


def badge(journal: DataFrame) -> DataFrame:
    """(label, faithfulness, colour): the least faithfulness of the latest entries of each label."""
    last = journal.groupBy("label").agg(F.max("at").alias("at"))
    least = journal.join(last, ["label", "at"]).groupBy("label").agg(F.min("faithfulness").alias("faithfulness"))
    return least.withColumn("colour", F.when(F.col("faithfulness") >= 1, "green").when(F.col("faithfulness") >= 0.9, "yellow").otherwise("red"))


def insert_lines(lines: DataFrame, graph: str, connect: Callable[[], object], batch: int = INSERT_BATCH) -> None:
    """N-Triples lines (value) into a named graph, cleared first; each task sends its own batches. connect() gives an object with update(text)."""
    connect().update(f"DROP SILENT GRAPH <{graph}>")

    def send(rows: Iterator) -> None:
        link, held = connect(), []
        for r in rows:
            held.append(r["value"])
            if len(held) == batch:
                link.update(f"INSERT DATA {{ GRAPH <{graph}> {{ {' '.join(held)} }} }}")
                held = []
        if held:
            link.update(f"INSERT DATA {{ GRAPH <{graph}> {{ {' '.join(held)} }} }}")

    lines.foreachPartition(send)
