"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to; sources may overlap). The flow runs
from the patterns to the sources: a pattern offers its words once at cost 0, again at cost 1, a third time at cost 2 and
so on (convex repetition costs, up to `max_repeats`), and each source asks for its quota. Successive shortest paths on
this small network (a node for each pattern and source, however many documents there are) give the words that each
pattern yields at each repetition. Documents are then selected in a seeded order: in each pattern the first words of
that order, up to the flow, are taken. A document at the border is taken in part, so that the sums hit their targets.

The order is cut into buckets whose sums give each document's place, so no task holds a whole source.

Defined results: a null text has size 0 and is never taken; a null source (or array of
sources) is a source of its own, last in order; a document with an empty array is in no source and is not taken; null
ids and repeated rows give one row each; without any words nothing is taken; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, small

#: Rows of a bucket of the seeded order, about.
BUCKET_ROWS = 2000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most * its size; the excess is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            open_.discard(i)
        left = float(total) - sum(targets[i] for i in range(len(sizes)) if i not in open_)
    return targets


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of least cost; shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
    potential = [0] * n
    while True:
        reached, arc_to, queue = {source: 0}, {}, [(0, source)]
        done = set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done.add(x)
            for e in graph[x]:
                y = to[e]
                if cap[e] > 0 and (y not in reached or d + cost[e] + potential[x] - potential[y] < reached[y]):
                    reached[y] = d + cost[e] + potential[x] - potential[y]
                    arc_to[y] = e
                    heapq.heappush(queue, (reached[y], y))
        if sink not in reached:
            return [cap[2 * k + 1] for k in range(len(arcs))]
        far = max(reached.values())
        potential = [p + reached.get(x, far) for x, p in enumerate(potential)]
        amount, x = None, sink
        while x != source:
            e = arc_to[x]
            amount = cap[e] if amount is None else min(amount, cap[e])
            x = to[e ^ 1]
        x = sink
        while x != source:
            e = arc_to[x]
            cap[e] -= amount
            cap[e ^ 1] += amount
            x = to[e ^ 1]


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], max_repeats: int) -> list[list[int]]:
    """Words that each pattern (sources, words) yields at each repetition.

    Patterns that have no source in common, not even over others, don't touch each other's flow: each connected part of
    the network is solved by itself, so the work grows with the largest part and not with the number of sources.
    """
    top = list(range(len(quotas)))

    def root(s: int) -> int:
        while top[s] != s:
            top[s] = s = top[top[s]]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            top[root(s)] = root(members[0])
    parts: dict[int, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            parts.setdefault(root(members[0]), []).append(i)
    out = [[0] * max_repeats for _ in patterns]
    for own in parts.values():
        m = len(own)
        sources = sorted({s for i in own for s in patterns[i][0]})
        node = {s: 2 + m + k for k, s in enumerate(sources)}  # nodes: source, sink, patterns, quotas
        arcs = [(0, 2 + k, patterns[i][1], level) for k, i in enumerate(own) for level in range(max_repeats)]
        arcs += [(2 + k, node[s], patterns[i][1] * max_repeats, 0) for k, i in enumerate(own) for s in patterns[i][0]]
        arcs += [(node[s], 1, quotas[s], 0) for s in sources]
        flow = min_cost_flow(2 + m + len(sources), arcs, 0, 1)
        for k, i in enumerate(own):
            out[i] = flow[k * max_repeats : (k + 1) * max_repeats]
    return out


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_repeats: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    source_col may hold one source or an array of sources; of an array, source_size and target are summed over its
    members. The driver holds a number for each pattern and source, never for documents.
    """
    several = dict(docs.dtypes)[source_col].startswith("array")
    nowhere = F.array(F.lit(None).cast("string"))
    members = F.coalesce(F.array_sort(F.array_distinct(docs[source_col].cast("array<string>"))), nowhere) if several else F.array(docs[source_col].cast("string"))
    size = F.when(docs[text_col].isNull(), 0).otherwise(F.regexp_count(docs[text_col].cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    sized = materialise(docs.select(docs[id_col].cast("long").alias("doc_id"), members.alias("members"), size.alias("size")), "sizes")
    totals = sized.groupBy("members").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    key = lambda s: (s is None, (s or "").encode())  # noqa: E731  bytes of UTF-8 stand in the order of code points
    sources = sorted({s for r in totals for s in r["members"]}, key=key)
    place = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for r in totals:
        for s in r["members"]:
            sizes[place[s]] += r["size"]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sources))], budget * sum(r["size"] for r in totals), max_repeats)
    patterns = [(tuple(place[s] for s in r["members"]), r["size"]) for r in totals]
    flows = route(patterns, [round(t) for t in targets], max_repeats)
    plan = docs.sparkSession.createDataFrame(
        [(r["members"], float(sum(sizes[i] for i in p[0])), float(sum(targets[i] for i in p[0])), f, max(1, math.ceil(r["n"] / BUCKET_ROWS))) for r, p, f in zip(totals, patterns, flows, strict=True)],
        "members array<string>, source_size double, target double, flow array<long>, buckets int",
    )
    # null members: join on a text of the pattern
    name = F.to_json(F.col("members"))
    plan = plan.select(name.alias("pattern"), "source_size", "target", "flow", "buckets")
    placed = sized.withColumn("pattern", name).join(small(plan, 200, len(totals)), "pattern")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = placed.withColumn("order", order).withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("pattern", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    inside = W.partitionBy("pattern", "bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = F.expr("aggregate(flow, 0L, (a, f) -> a + greatest(0L, least(f, at + size) - least(f, at)))")
    return placed.join(starts, ["pattern", "bucket"]).withColumn("at", at).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that the mix takes, with all their columns: a row for each time that it takes one, wholly or in part.

    Rows that repeat an id get the largest count of that id.
    """
    counts = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    times = counts.filter("taken > 0").select(F.col("doc_id").alias("id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times")).groupBy("id").agg(F.max("times").alias("times"))
    rows = docs.select(docs[id_col].cast("long").alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))  # one struct: no names clash
    joined = rows.join(times, F.col("key").eqNullSafe(F.col("id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
