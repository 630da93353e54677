"""N-gram Jaccard join under several global orders of the shingles.

1. Each text becomes a set of 64-bit shingle hashes. Equal sets form one class (their texts may differ in white space or
   repeats); everything further works on classes.
2. Three global orders by three hashes; under the first, shingles that `heavy` texts or more hold come last (at most
   `table_rows` of them, the most frequent, so that the table that tells them has a bound). Sets that reach the threshold
   share a token of their prefixes under every order. Prefix tokens of the first order are dealt to buckets; those that
   two classes share form groups. A candidate pair must pass the filters of sizes, of positions (what is common up to
   the last shared prefix token and what can still follow) and of signatures (sets that differ in few shingles differ in
   few bits), then share prefix tokens under the other two orders too; only then it is verified on its whole sets.
3. Pairs of a group are not all made. In a voting round each class meets only the one hub, a class of the largest component
   of a group, with which it shares most groups; links join components, and groups inside one component are done. Voting
   goes on while it links and much is left. Then the classes outside a group's largest component meet all others of the
   group, in large groups some at a time: a class that has met all others leaves, and rounds go on until no group holds
   two components. So a group of near copies costs about one pair a member, and no link between components is lost.

Defined results: a null or empty text, or one of white space only, has no shingles, links with nothing and is its own
component; rows that repeat an id count each by its own text; a null id takes the smallest id of its
component (null if it has none); an empty table gives no rows; other columns are not read; a text's set is held whole,
some 60 bytes of memory for each of its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .buckets import pack, unpack
from .common import Powers, Tables, id_text, map_rows, mix, portions, raw_bytes, small, tidied

BLOCK = 1 << 20
#: Text that a map unit works on at once.
UNIT_BYTES = 3 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80
    heavy: int = 12
    table_rows: int = 1 << 21
    #: Pairs of a group that the first round after voting makes, about; each later one makes four times as many.
    pairs: int = 1 << 22
    #: Voting ends when at most so many pairs are left for each row that the groups had at first, or when it links little.
    left: int = 64


_powers = Powers(0x9E3779B97F4A7C15 | 1, 20)
_powers.value[65:91] = _powers.value[97:123]  # A-Z count as a-z


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end); blocks of about BLOCK bytes, cut between words."""
    hashes, starts_at = [], []
    lo, n = 0, len(data)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    while lo < n:
        hi = min(n, lo + BLOCK)
        while hi < n and not (border[hi] or SPACE[data[hi]]):
            step = np.flatnonzero(SPACE[data[hi : hi + BLOCK]] | border[hi : hi + BLOCK][: len(data[hi : hi + BLOCK])])
            hi = min(n, hi + int(step[0])) if len(step) else min(n, hi + BLOCK)
        block = data[lo:hi]
        inside = ~SPACE[block]
        cut = border[lo : hi + 1]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        stops[:-1] &= ~inside[1:] | cut[1:-1]
        a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes.append(_powers.span(_powers.prefix(block), a, b))
        starts_at.append(a + lo)
        lo = hi
    starts = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(starts, offsets)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The set of each text, as sorted hashes."""
    data, offsets = raw_bytes(texts)
    hashes, first = word_hashes(data, offsets)
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(words)]
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k, f in enumerate(factors):
        rolled += hashes[k : k + n] * f
    rolled = mix(rolled, 5)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = sum(int(h) * int(f) for h, f in zip(hashes[a:b], factors, strict=False)) + (b - a) & (1 << 64) - 1
            sets.append(mix(np.array([whole], np.uint64), 6))
        else:
            sets.append(hashes[:0])
    return sets


def class_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def short(cid: bytes | None) -> int | None:
    return None if cid is None else int.from_bytes(cid[:8], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def rank(tokens: np.ndarray, order: int) -> np.ndarray:
    return mix(tokens, 100 + order)


def first_ranks(tokens: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Under the first order: shingles of the sorted table `heavy` (40 bits of the rank) come last."""
    own = rank(tokens, 0)
    return (own >> np.uint64(1)) | (_among(own >> np.uint64(24), heavy).astype(np.uint64) << np.uint64(63))


def foremost(tokens: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The places of the tokens that come first, in order."""
    p = prefix_length(len(tokens), percent)
    least = np.argpartition(ranks, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return least[np.argsort(ranks[least])]


def _long(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


SIGNATURE = ["s0", "s1", "s2", "s3"]
SETS = "did long, n long, cid binary, own long, second array<int>, third array<int>, " + ", ".join(f"{c} long" for c in SIGNATURE)


def _sets_pass(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of texts (did, n, cid, own: 64 bits of it, prefixes under the other orders as 32 bits of each token, signature).

    Prefixes and signature stand at one text of each class and map unit; a collision only lets a pair pass.
    """
    listed = pa.list_(pa.int32())
    names = [x.split(" ")[0] for x in SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1, UNIT_BYTES):
                sets = shingle_sets(batch.column(1), rule.words)
                cids, fresh = classes(sets)
                others = [pa.array([None if s is None else s[foremost(s, rank(s, order), rule.percent)].astype(np.uint32).view(np.int32) for s in fresh], listed) for order in (1, 2)]
                bits = [signature(s) if s is not None else None for s in fresh]
                signatures = [pa.array([None if b is None else int(b[k]) for b in bits], pa.int64()) for k in range(len(SIGNATURE))]
                yield pa.record_batch([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(cids, pa.binary()), pa.array(list(map(short, cids)), pa.int64()), *others, *signatures], names)

    return docs.mapInArrow(tidied(run), SETS)


def signature(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of 256 hash slots, set if an odd number of tokens fall there: sets that differ in d tokens differ in d bits at most."""
    odd = np.bincount((mix(tokens, 7) % np.uint64(64 * len(SIGNATURE))).astype(np.int64), minlength=64 * len(SIGNATURE)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def classes(sets: list[np.ndarray]) -> tuple[list[bytes | None], list[np.ndarray | None]]:
    """(class of each set, the set where its class stands first)."""
    cids, met, fresh = [class_of(s) for s in sets], set(), []
    for s, c in zip(sets, cids, strict=True):
        fresh.append(None if c is None or c in met else s)
        met.add(c)
    return cids, fresh


def _heavy(docs: DataFrame, rule: Rule, buckets: int, tables: Tables) -> np.ndarray:
    """The table of frequent shingles: at most rule.table_rows of those that rule.heavy texts hold, the most frequent.

    Shingles go by 40 bits of their rank; those that share them count as one, which only moves them back in the order.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1, UNIT_BYTES):
                fresh = [rank(s, 0) for s in classes(shingle_sets(batch.column(1), rule.words))[1] if s is not None]
                if not fresh:
                    continue
                key, count = np.unique(np.concatenate(fresh) >> np.uint64(24), return_counts=True)
                word, bucket = np.divmod(key, np.uint64(buckets))
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                word, count = word[order].astype(np.uint32), np.minimum(count[order], 255).astype(np.uint8)
                there = [b for b in range(buckets) if edges[b + 1] > edges[b]]
                cut = [slice(edges[b], edges[b + 1]) for b in there]
                yield pa.record_batch([pa.array(there, pa.int64()), pa.array([word[c].tobytes() for c in cut], pa.binary()), pa.array([count[c].tobytes() for c in cut], pa.binary())], ["bucket", "keys", "counts"])

    def meet(t: pa.Table) -> pa.Table:
        word, count = unpack(t, {"keys": np.uint32, "counts": np.uint8})
        order = np.argsort(word, kind="stable")
        word, count = word[order], count[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = np.add.reduceat(count, edge)
        often = total >= rule.heavy
        key = word[edge[often]].astype(np.uint64) * np.uint64(buckets) + np.uint64(t["bucket"][0].as_py())
        return pa.table({"key": _long(key), "count": total[often]})

    counts = docs.mapInArrow(tidied(send), "bucket long, keys binary, counts binary")
    found = tables.write(counts.groupBy("bucket").applyInArrow(meet, "key long, count long"), "heavy")
    level, room, least = F.floor(F.log2("count") * 8).cast("int"), rule.table_rows, 0
    for r in sorted(found.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred levels at most
        room, least = room - r["count"], r["level"]
        if room < 0:
            least += 1
            break
    table = found.filter(level >= least).select("key").toArrow()["key"]
    return np.sort(table.to_numpy().astype(np.int64).view(np.uint64))


def _shared_tokens(docs: DataFrame, rule: Rule, heavy: Broadcast, buckets: int) -> DataFrame:
    """(token, own, pos) of prefix tokens under the first order that more than one text holds; own: short class, pos: place in the order."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1, UNIT_BYTES):
                tokens, owners, places, met = [], [], [], set()
                for own in shingle_sets(batch.column(1), rule.words):
                    if len(own) and (cid := short(class_of(own))) not in met:
                        met.add(cid)
                        tokens.append(own[foremost(own, first_ranks(own, heavy.value), rule.percent)])
                        owners.append(np.full(len(tokens[-1]), cid, np.int64))
                        places.append(np.arange(len(tokens[-1]), dtype=np.uint32))
                if not tokens:
                    continue
                token, owner, place = map(np.concatenate, (tokens, owners, places))
                order = np.argsort(token, kind="stable")
                token, owner, place = token[order], owner[order], place[order]
                fresh = np.ones(len(token), bool)
                fresh[1:] = token[1:] != token[:-1]
                alone = fresh.copy()
                alone[:-1] &= fresh[1:]
                # several texts of this unit hold it: they go on at once, and one row tells the bucket
                flags = (fresh & ~alone).astype(np.uint8)
                one = np.flatnonzero(fresh)
                one = one[np.argsort(owner[one], kind="stable")]  # runs of owners pack well
                out = pack(buckets, token[one], {"owners": owner[one], "places": place[one], "flags": flags[one]})
                if out is not None:
                    yield out
                several = ~alone
                if several.any():
                    key = int(token[0] >> np.uint64(3)) | 1 << 60  # a group of its own
                    yield pa.record_batch([pa.array([key], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (token[several], owner[several], place[several], flags[:0]))], ["bucket", "keys", "owners", "places", "flags"])

    def meet(t: pa.Table) -> pa.Table:
        token, owner, place, flag = unpack(t, {"keys": np.uint64, "owners": np.int64, "places": np.uint32, "flags": np.uint8})
        if t["bucket"][0].as_py() < 1 << 60:
            order = np.argsort(token, kind="stable")
            token, owner, place, flag = token[order], owner[order], place[order], flag[order]
            same = token[1:] == token[:-1]
            keep = np.zeros(len(token), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep &= flag == 0  # flagged rows have gone on already
            token, owner, place = token[keep], owner[keep], place[keep]
        return pa.table({"token": _long(token), "own": owner, "pos": place.astype(np.int64)})

    return docs.mapInArrow(tidied(send), "bucket long, keys binary, owners binary, places binary, flags binary").groupBy("bucket").applyInArrow(meet, "token long, own long, pos long")


def _whole_sets(docs: DataFrame, rows: DataFrame, cids: DataFrame, rule: Rule, tables: Tables) -> DataFrame:
    """(cid, tokens) of some classes: the sets, as sorted 64-bit hashes."""
    firsts = tables.write(rows.join(cids, "cid", "left_semi").groupBy("cid").agg(F.min("did").alias("did")).select("did").distinct(), "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1, UNIT_BYTES):
                found = [s for s in shingle_sets(batch.column(1), rule.words) if len(s)]
                yield pa.record_batch([pa.array(map(class_of, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["cid", "tokens"])

    return docs.join(small(firsts, 16), "did", "left_semi").select("did", "text").mapInArrow(tidied(run), "cid binary, tokens binary").dropDuplicates(["cid"])


def _both(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    for x in ("a", "b"):
        pairs = pairs.join(table.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols)), x)
    return pairs


def passing(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that share prefix tokens under the other orders too."""
    need = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    prefixes = rows.filter("second is not null").join(need, "cid", "left_semi").dropDuplicates(["cid"])
    return _both(pairs, prefixes, "second", "third").filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = int(_among(x, y).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return map_rows(_both(pairs, sets, "tokens").select("a", "b", "tokens_a", "tokens_b"), run, "a binary, b binary")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(cid, label, was) of linked classes, label the smallest cid: smallest neighbour's label, then a jump to the label's label."""
    edges = tables.write(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = tables.write(edges.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cid").alias("b"), "label"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        low = labels.join(near, "cid").select("cid", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("cid").alias("low"), F.col("label").alias("jumped"))
        new = tables.write(low.join(jump, "low").select("cid", F.least("low", "jumped").alias("label"), "was"), "labels")
        labels = new.select("cid", "label")
        if new.filter("label <> was").isEmpty():
            return new


def _can(na: Column, pa_: Column, nb: Column, pb: Column, before: Column, percent: int) -> Column:
    """Whether sizes allow the threshold, given a common token at these places and at most so many common ones up to it.

    Before a common token of the prefixes only tokens that some other class's prefix holds too can be common, so `above`,
    the number of these, bounds them better than the place does. Sets of these two sizes that reach the threshold share a
    token in prefixes that are shorter than those cut for any partner; tokens behind these are not asked for.
    """
    need = (na + nb) * percent  # times 1 / (100 + percent), of common tokens
    most = before + F.least(na - pa_, nb - pb) - 1
    near = ((na - pa_) * (100 + percent) >= need) & ((nb - pb) * (100 + percent) >= need)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & near & (most * (100 + percent) >= need)


def _votes(group: DataFrame, salt: int, percent: int) -> DataFrame:
    """Pairs (a, b): each class outside a group's largest component and the hub with which it shares most groups.

    At first the hubs are the classes that stand in most groups, as a text with few words of its own is close to most of
    its copies; later ones are drawn by a hash.
    """
    order = F.xxhash64(F.lit(salt), "cid") if salt else F.col("stands")
    hub = F.max(F.struct(order.alias("h"), "cid", "n", "pos", "above"))
    parts = group.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"), hub.alias("hub"))
    best = parts.groupBy("token").agg(F.max(F.struct("m", "hub.h", "label", "hub")).alias("best")).select("token", F.col("best.label").alias("lh"), F.col("best.hub").alias("hub"))
    met = group.join(best, "token").filter("label <> lh").select(F.col("cid").alias("b"), F.col("hub.cid").alias("a"), "n", "pos", "above", F.col("hub.n").alias("nh"), F.col("hub.pos").alias("ph"), F.col("hub.above").alias("ah"))
    met = met.filter(_can(F.col("n"), F.col("pos"), F.col("nh"), F.col("ph"), F.least("above", "ah") + 1, percent))
    votes = met.groupBy("b", "a").agg(F.count(F.lit(1)).alias("votes")).groupBy("b").agg(F.max(F.struct("votes", "a")).alias("best"))
    return votes.select(F.least("b", "best.a").alias("a"), F.greatest("b", "best.a").alias("b")).distinct()


def _everyone(group: DataFrame, sizes: DataFrame, rows: DataFrame, salt: int, most: int, percent: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(pairs, those who leave): of the classes outside a group's largest component some meet all others of the group."""
    # `share` of them, by a hash that changes with each round, so that about `most` pairs of a group are made, of two classes at least
    share = sizes.select("token", F.col("label").alias("most"), (F.greatest(F.lit(float(most)), 2 * F.col("m")) / (F.col("minor") * F.col("m"))).alias("share"))
    own = rows.filter("second is not null").select("cid", *SIGNATURE).join(group.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
    marked = group.join(share, "token").join(small(own, 64), "cid")
    drawn = (F.pmod(F.xxhash64(F.lit(salt), "cid"), F.lit(1 << 20)) < F.col("share") * (1 << 20)) | (F.col("share") >= 1)
    marked = marked.withColumn("hub", (F.col("label") != F.col("most")) & drawn).withColumn("whole", F.col("share") >= 1)
    marked = tables.write(marked.select("token", "cid", "n", "pos", "above", "label", "hub", "whole", *SIGNATURE), "hubs")
    hubs = marked.filter("hub")
    # the count of common tokens is only known for classes all of whose groups are compared at once
    crowded = marked.filter("not whole").select("cid").distinct()
    x = hubs.select("token", F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("above").alias("ax"), F.col("label").alias("lx"), *(F.col(c).alias(f"{c}x") for c in SIGNATURE))
    y = marked.select("token", F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("above").alias("ay"), F.col("label").alias("ly"), "hub", *(F.col(c).alias(f"{c}y") for c in SIGNATURE))
    met = x.join(y, "token").filter((F.col("lx") != F.col("ly")) & (~F.col("hub") | (F.col("x") < F.col("y"))))
    differ = sum((F.bit_count(F.col(f"{c}x").bitwiseXOR(F.col(f"{c}y"))) for c in SIGNATURE), F.lit(0))
    met = met.filter(_can(F.col("nx"), F.col("px"), F.col("ny"), F.col("py"), F.least("ax", "ay") + 1, percent) & (differ * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)))
    first = F.col("x") < F.col("y")
    pick = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
    met = met.select(pick("x", "y", "a"), pick("y", "x", "b"), pick("nx", "ny", "na"), pick("ny", "nx", "nb"), pick("px", "py", "pa"), pick("py", "px", "pb"))
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), *(F.max(c).alias(c) for c in ("na", "nb", "pa", "pb")))
    if crowded.isEmpty():
        known = F.lit(True)
    else:
        crowded = tables.write(crowded.withColumn("is", F.lit(True)), "crowded")
        for k in ("a", "b"):
            pairs = pairs.join(crowded.select(F.col("cid").alias(k), F.col("is").alias(f"c{k}")), k, "left")
        known = F.col("ca").isNull() | F.col("cb").isNull()
    return pairs.filter(~known | _can(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), F.col("common"), percent)).select("a", "b"), hubs.select("token", "cid")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    docs = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "text")
    tables = Tables(docs.sparkSession)
    rows = tables.write(_sets_pass(docs, rule), "sets-pass")
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(docs, rule, max(256, math.ceil(tokens * 5 / (4 << 20))), tables))
    buckets = max(64, math.ceil(tokens * (100 - rule.percent) / 100 * 21 / (4 << 20)))
    named = rows.select("own", "cid", "n").filter("cid is not null").distinct()
    group = tables.write(_shared_tokens(docs, rule, heavy, buckets), "shared").join(small(named, 48), "own").groupBy("token", "cid").agg(F.max("n").alias("n"), F.max("pos").alias("pos"))
    own = W.partitionBy("cid")
    group = tables.write(group.withColumn("label", F.col("cid")).withColumn("stands", F.count(F.lit(1)).over(own)).withColumn("above", F.row_number().over(own.orderBy("pos")) - 1), "groups")
    links = labels = whole = sets = None
    salt, voting, most, at_first, linked = 0, True, rule.pairs, 0, 0
    while True:
        if labels is not None:
            group = group.drop("label").join(small(labels, 48), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        parts = group.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
        sizes = parts.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("most")).select("token", "m", (F.col("m") - F.col("most.m")).alias("minor"), F.col("most.label").alias("label")).filter("minor > 0")
        sizes = tables.write(sizes, "sizes")
        if labels is not None:  # at first nearly every group has several
            group = tables.write(group.join(sizes.select("token"), "token", "left_semi").select("token", "cid", "n", "pos", "above", "stands", "label"), "groups")
        left, held = sizes.agg(F.sum(F.col("minor") * F.col("m")), F.sum("m")).first()
        if not held:
            break
        at_first = at_first or held
        voting = salt == 0 or voting and left > rule.left * at_first
        if voting:
            pairs = _votes(group, salt, rule.percent)
        else:
            pairs, leaving = _everyone(group, sizes, rows, salt, most, rule.percent, tables)
            most *= 4
            group = group.join(leaving, ["token", "cid"], "left_anti")
        salt += 1
        passed = tables.write(passing(tables.write(pairs, "pairs"), rows), "passed")
        need = passed.select(F.col("a").alias("cid")).union(passed.select("b")).distinct()
        if sets is not None:
            need = need.join(sets.select("cid"), "cid", "left_anti")
        more = tables.write(_whole_sets(docs, rows, need, rule, tables), "whole-sets")
        sets = more if sets is None else sets.union(more)
        found = tables.write(verified(passed, sets, rule.percent), "links")
        n = found.count()
        linked = max(linked, n)
        voting &= n * 10 >= linked > 0
        if n:
            links = found if links is None else links.union(found)
            whole = components(links, tables)
            labels = whole.select("cid", "label")
    tables.drop(rows, whole)
    named = rows.select("did", "n", "cid").withColumn("label", F.col("cid"))
    if labels is not None:
        named = rows.select("did", "n", "cid").join(small(labels, 48), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lowest = named.filter("label is not null").groupBy("label").agg(F.min(F.when(F.col("did") != NO_ID, F.col("did"))).alias("component_id"))
    own = F.when(F.col("did") != NO_ID, F.col("did"))
    return named.join(lowest, "label", "left").select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), own).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component; texts without words stay."""
    found = near_duplicates(docs, rule, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_id"]), "left_semi")
