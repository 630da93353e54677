"""Knowledge graph operators over (src, dst, relation) edges and (node_a, node_b) resolutions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that the session names; in local mode one of our own where none is set."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint()


def numbered(rows: DataFrame, order: list, to: str) -> DataFrame:
    """Places from 0 in a total order, over range partitions: only the partitions' counts, one number each, meet in one task.

    Rows that are equal in all of `order` get places next to each other in no defined order.
    """
    sorted_ = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return sorted_.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(to))


def named_key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def key_edges(rows: DataFrame, kind: str, key: str, target: str, reference: str, relation: str) -> DataFrame:
    """(src, dst, relation): a foreign key as edges; a row whose reference is null has none."""
    return rows.filter(F.col(reference).isNotNull()).select(named_key(kind, key).alias("src"), named_key(target, reference).alias("dst"), F.lit(relation).alias("relation"))


def sources_of(edges: DataFrame, targets: DataFrame, relation: str) -> DataFrame:
    """src of edges into the targets (id); repeats stay."""
    return edges.filter(F.col("relation") == relation).join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id"))


def targets_of(edges: DataFrame, sources: DataFrame, relation: str) -> DataFrame:
    return edges.filter(F.col("relation") == relation).join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def all_links(edges: DataFrame, resolutions: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(src, dst, relation) of edges, resolutions (node_a, node_b) and mentions (chunk, node), for walks over all of them."""
    out = edges.select("src", "dst", "relation")
    if resolutions is not None:
        out = out.unionByName(resolutions.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), F.lit("resolves").alias("relation")))
    if mentions is not None:
        out = out.unionByName(mentions.select(F.col("chunk").alias("src"), F.col("node").alias("dst"), F.lit("mentions").alias("relation")))
    return out


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids one hop from start (id) in either direction."""
    return both_ways(edges).join(start.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("id")).distinct()


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of all within a number of hops, with the least hop; the frontier only carries new ids."""
    links = both_ways(edges).filter("a <> b").distinct()
    reached = cut_lineage(start.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = reached
    for k in range(1, hops + 1):
        new = links.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut_lineage(new.join(reached, "id", "left_anti").withColumn("hop", F.lit(k)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def components(nodes: DataFrame, pairs: DataFrame, a: str = "node_a", b: str = "node_b") -> DataFrame:
    """(id, entity_id) of every node, entity_id the smallest id of its component.

    Smallest-neighbour labels with pointer jumping: the number of rounds grows with the logarithm of a component's
    diameter in all but contrived cases; each round is two joins on the label table. Pairs with unknown ids don't count.
    """
    ids = nodes.select("id").distinct()
    known = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    links = cut_lineage(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while not labels.isEmpty():
        near = links.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jumped = low.join(labels.select(F.col("id").alias("low"), F.col("label").alias("far")), "low").select("id", F.least("low", "far").alias("label"), "was")
        jumped = cut_lineage(jumped)
        labels = jumped.select("id", "label")
        if jumped.filter("label <> was").isEmpty():
            break
    return ids.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("entity_id"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, relation, missing) of edges whose ends aren't nodes."""
    ids = nodes.select("id").distinct()
    sides = [edges.join(ids.withColumnRenamed("id", side), side, "left_anti").select("src", "dst", "relation", F.col(side).alias("missing")) for side in ("src", "dst")]
    return sides[0].unionByName(sides[1])


def latest(nodes: DataFrame) -> DataFrame:
    """Of nodes with one id the last by seq, at the place of the first."""
    return nodes.groupBy("id").agg(F.min("seq").alias("place"), *(F.max_by(c, "seq").alias(c) for c in nodes.columns if c not in ("id", "seq"))).withColumnRenamed("place", "seq")
