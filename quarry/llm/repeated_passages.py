"""Removal of byte strings that a document with a smaller id holds too, by prefix-free parsing.

1. Parse. A rolling hash over TRIGGER bytes is taken at every byte; the smallest one inside each window of `length`
   bytes is its trigger. The windows with one trigger form a phrase (the text from the first window's start to the last
   window's end), so phrases overlap by length - 1 bytes, every window lies in just one phrase, and equal windows of any
   two documents have equal triggers at equal places: no phrase depends on what stands around it.
2. Dictionary. A phrase is known by its fingerprint. Map units keep the smallest document of each phrase and send it to
   the trigger's bucket; there, phrases with one trigger meet. Where all of them are equal, the smallest document
   decides for the whole phrase. In highly repetitive text nearly all phrases end here.
3. Suffixes. Where different phrases share a trigger and more bytes on one side of it than chance gives (TRIGGER plus
   half of the rest must agree if any window does), the suffixes of these dictionary phrases, cut off at `length` bytes,
   are put in order together with their documents, again by map units first and then by buckets. In this order equal
   windows stand together, the smallest document first, which is the corpus order that matters here: all others lose
   the window's bytes. The order is that of fingerprints, not of bytes, since only equality counts. Windows are equal by
   96 bits of two hashes with different bases, phrases by 64 bits and the 40 bits of their trigger.
4. The documents that lose something are parsed once more, and the bytes of lost phrases and windows are taken out.

No task gets more rows of one phrase or window than there are map units, whatever the number of copies.

Defined results: a null text is empty; a null id counts as smaller than all others; rows with one id don't take bytes
from each other; an empty table gives no rows; other columns are not read; texts are treated whole, and the lost phrases
and windows of a text travel in one row, 8 bytes each, which bounds a text with no lost phrase but only lost windows to
some 250 MB.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import unpack
from .common import Powers, id_text, materialise, mix, raw_bytes, sha_hex, small, tidied

TRIGGER = 20
BLOCK = 1 << 18
#: A map unit holds its rows once, some 30 bytes each, and sorts and sends them by PORTIONS of the buckets: copies are made of one portion only.
UNIT_ROWS = {"phrases": 3 << 19, "windows": 3 << 20}
PORTIONS = 8
#: Bytes of text whose phrases meet in one bucket.
BUCKET_BYTES = 16 << 20
#: Different phrases of one trigger that a map unit sends on; beyond it sends word that there are many.
MANY = 16
NO_ID = -(1 << 63)
PHRASE, WINDOW, ASK = 0, 1, 2
_powers = Powers(0xD1342543DE82EF95, 31)
_again = Powers(0xAF251AF3B0F025B5, 37)
_low = np.uint64((1 << 24) - 1)


class Parse:
    """The phrases of one block of bytes: first start, number of starts, trigger (40 bits), fingerprint, sides, text number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, w = len(data), length - TRIGGER + 1
        self.length = length
        self.data, self.sums = data, _powers.prefix(data)
        sums = self.sums
        at = np.arange(n - TRIGGER + 1)
        rolled = mix((sums[TRIGGER:] - sums[:-TRIGGER]) * _powers.down[: len(at)])
        low = (rolled & ~_low) | at.astype(np.uint64)
        reach = 1
        while reach < w:  # the least of w neighbours
            step = min(reach, w - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        valid = np.ones(len(low), bool)
        for edge in offsets[1:-1].tolist():
            valid[max(0, edge - length + 1) : edge] = False
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
        self.start = np.flatnonzero(fresh)
        self.count = np.flatnonzero(last) + 1 - self.start
        spot = (low[self.start] & _low).astype(np.int64)
        self.trigger = low[self.start] >> np.uint64(24)
        end = self.start + self.count - 1 + length
        self.phrase = _powers.span(sums, self.start, end)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        half = (length - TRIGGER + 1) // 2
        first, after = offsets[self.text], offsets[self.text + 1]
        self.left = self._side(spot - half, spot, spot - half >= first)
        self.right = self._side(spot + TRIGGER, spot + TRIGGER + half, spot + TRIGGER + half <= after)

    def _side(self, a: np.ndarray, b: np.ndarray, there: np.ndarray) -> np.ndarray:
        """16 bits of the bytes beside the trigger; 0 where the text ends before."""
        out = _powers.span(self.sums, np.where(there, a, 0), np.where(there, b, 0)) % np.uint64(65535) + np.uint64(1)
        return np.where(there, out, 0).astype(np.uint16)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, fingerprint) of the windows of chosen phrases."""
        counts = self.count[chosen]
        start = np.repeat(self.start[chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return start, mix(_powers.span(self.sums, start, start + self.length), 9)

    def checks(self, start: np.ndarray) -> np.ndarray:
        """32 bits more of the windows from some places on."""
        return (_again.span(_again.prefix(self.data), start, start + self.length) >> np.uint64(32)).astype(np.uint32)


def parses(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[Parse, int, int]]:
    """(parse, first text, place in data) of blocks of whole texts, or of pieces of a text that is longer than a block."""
    k, m = 0, len(offsets) - 1
    while k < m:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, side="right")) - 1)
        lo, hi = int(offsets[k]), int(offsets[stop])
        if hi - lo <= BLOCK:
            if hi - lo >= length:
                yield Parse(data[lo:hi], offsets[k : stop + 1] - lo, length), k, lo
        else:
            for at in range(lo, hi - length + 1, BLOCK - length + 1):
                piece = data[at : min(hi, at + BLOCK)]
                yield Parse(piece, np.array([0, len(piece)]), length), k, at
        k = stop


def portioned(blocks: Iterator[tuple[np.ndarray, ...]], buckets: int, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of blocks, the first of which deals the rows to buckets, again by map units and in them by portions: rows of one bucket of a unit come together."""
    held, n = [[] for _ in range(PORTIONS)], 0

    def emptied() -> Iterator[tuple[np.ndarray, ...]]:
        for portion in held:
            if portion:
                columns = tuple(map(np.concatenate, zip(*portion, strict=True)))
                portion.clear()
                yield columns

    for key, *columns in blocks:
        part = (key % np.uint64(buckets) % np.uint64(PORTIONS)).astype(np.uint8)
        order = np.argsort(part, kind="stable")
        limits = np.searchsorted(part[order], np.arange(PORTIONS + 1))
        columns = [c[order] for c in columns]
        for portion, lo, hi in zip(held, limits[:-1], limits[1:], strict=True):
            if hi > lo:
                portion.append([c[lo:hi] for c in columns])
        n += len(part)
        if n >= rows:
            yield from emptied()
            n = 0
    yield from emptied()


KINDS = {"spot": np.uint32, "phrase": np.uint64, "did": np.int64, "left": np.uint16, "right": np.uint16, "many": np.uint8}
PACKED = "bucket long, " + ", ".join(f"{k} binary" for k in KINDS)
DIRECT = 1 << 60


def _send(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(_starts(bucket))
    limits = [*edges.tolist(), len(bucket)]

    def packed(name: str) -> pa.Array:
        if name not in columns:
            return pa.array([b""] * len(edges), pa.binary())
        column = columns[name][order]
        return pa.array([column[lo:hi].tobytes() for lo, hi in zip(limits, limits[1:], strict=False)], pa.binary())

    return pa.record_batch([pa.array(bucket[edges], pa.int64()), *map(packed, KINDS)], ["bucket", *KINDS])


def _direct(kind: int, did: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Findings of a map unit itself, which pass through the shuffle in a group of their own."""
    key = DIRECT + kind * (1 << 58) + int(mix(value[:1] + np.uint64(len(value)))[0] >> np.uint64(8))
    return pa.record_batch([pa.array([key], pa.int64()), *(pa.array([{"phrase": value, "did": did}[k].tobytes() if k in ("phrase", "did") else b""], pa.binary()) for k in KINDS)], ["bucket", *KINDS])


def _found(kind: int, did: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(did), kind, np.int32)), "did": did, "value": value.view(np.int64)})


FOUND = "kind int, did long, value long"


def _passed(t: pa.Table) -> pa.Table | None:
    key = t["bucket"][0].as_py()
    if key < DIRECT:
        return None
    value, did = unpack(t, {"phrase": np.uint64, "did": np.int64})
    return _found((key - DIRECT) >> 58, did, value)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def phrase_findings(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """FOUND: phrases that a document loses (PHRASE), and triggers whose phrases' suffixes must be compared (ASK)."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        data, offsets = raw_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for p, k, _ in parses(data, offsets, length):
            yield p.trigger, p.trigger, p.phrase, ids[p.text + k], p.left, p.right

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trigger, phrase, did, left, right in portioned(rows(batch), buckets, UNIT_ROWS["phrases"]):
                order = np.lexsort((did, phrase, trigger))
                trigger, phrase, did, left, right = (x[order] for x in (trigger, phrase, did, left, right))
                once = _starts(trigger, phrase, did)
                trigger, phrase, did, left, right = (x[once] for x in (trigger, phrase, did, left, right))
                first = _starts(trigger, phrase)
                if not first.all():
                    yield _direct(PHRASE, did[~first], phrase[~first])
                trigger, phrase, did, left, right = (x[first] for x in (trigger, phrase, did, left, right))
                edge = np.flatnonzero(_starts(trigger))
                size = np.diff(np.append(edge, len(trigger)))
                many = np.repeat(size > MANY, size)
                if many.any():
                    yield _direct(ASK, did[many], trigger[many])
                word = np.zeros(len(trigger), bool)
                word[edge] = size > MANY
                row = np.flatnonzero(~many | word)
                row = row[np.argsort(did[row], kind="stable")]
                spot, bucket = np.divmod(trigger[row], np.uint64(buckets))
                yield _send(bucket.astype(np.int64), {"spot": spot.astype(np.uint32), "phrase": phrase[row], "did": did[row], "left": left[row], "right": right[row], "many": word[row].astype(np.uint8)})

    def meet(t: pa.Table) -> pa.Table:
        if (passed := _passed(t)) is not None:
            return passed
        bucket = t["bucket"][0].as_py()
        spot, phrase, did, left, right, many = unpack(t, KINDS)
        order = np.argsort(spot, kind="stable")
        same = spot[order][1:] == spot[order][:-1]
        shared = np.zeros(len(order), bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        spot, phrase, did, left, right, many = (x[order] for x in (spot, phrase, did, left, right, many))
        order = np.lexsort((did, phrase, spot))
        spot, phrase, did, left, right, many = (x[order] for x in (spot, phrase, did, left, right, many))
        group = np.cumsum(_starts(spot)) - 1
        kinds = _starts(spot, phrase)
        has_many = np.bincount(group, weights=many)[group] > 0 if len(group) else many.astype(bool)
        ask = has_many & (many == 0)
        # phrases that differ but agree on one side of the trigger
        for side in (left, right):
            at = np.lexsort((phrase, side, spot))
            s, g, p = side[at], spot[at], phrase[at]
            run = np.cumsum(_starts(g, s)) - 1
            fresh = _starts(g, s, p)
            several = np.bincount(run, weights=fresh)[run] > 1 if len(run) else fresh
            hit = np.zeros(len(at), bool)
            hit[at] = several & (s > 0)
            ask |= hit & (many == 0)
        # of equal phrases the smallest document keeps it; it alone has to be compared with other phrases
        least = did[np.flatnonzero(kinds)][np.cumsum(kinds) - 1] if len(did) else did
        loses = (many == 0) & (did > least) & ~has_many
        ask &= ~loses
        trigger = spot.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        return pa.concat_tables([_found(PHRASE, did[loses], phrase[loses]), _found(ASK, did[ask], trigger[ask])])

    return docs.mapInArrow(tidied(send), PACKED).groupBy("bucket").applyInArrow(meet, FOUND)


def window_findings(asked: DataFrame, length: int, buckets: int) -> DataFrame:
    """FOUND: windows that a document loses, from (did, text, triggers)."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        data, offsets = raw_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        lists = batch.column(2)
        wanted = lists.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        # a text's number and its trigger in one value: equal ones may only add comparisons
        wanted = np.sort(mix(wanted, 3) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for p, k, _ in parses(data, offsets, length):
            own = mix(p.trigger, 3) + (p.text + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            chosen = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
            if chosen.any():
                start, value = p.windows(np.flatnonzero(chosen))
                yield value >> np.uint64(32), value, p.checks(start), ids[np.repeat(p.text[chosen] + k, p.count[chosen])]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, check, did in portioned(rows(batch), buckets, UNIT_ROWS["windows"]):
                order = np.lexsort((did, check, value))
                value, check, did = value[order], check[order], did[order]
                once = _starts(value, check, did)
                value, check, did = value[once], check[once], did[once]
                first = _starts(value, check)
                if not first.all():
                    yield _direct(WINDOW, did[~first], value[~first])
                value, check, did = value[first], check[first], did[first]
                order = np.argsort(did, kind="stable")
                yield _send(((value[order] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), {"spot": check[order], "phrase": value[order], "did": did[order]})

    def meet(t: pa.Table) -> pa.Table:
        if (passed := _passed(t)) is not None:
            return passed
        check, value, did = unpack(t, {"spot": np.uint32, "phrase": np.uint64, "did": np.int64})
        order = np.lexsort((did, check, value))
        check, value, did = check[order], value[order], did[order]
        first = _starts(value, check)
        least = did[np.flatnonzero(first)][np.cumsum(first) - 1]
        loses = did > least
        return _found(WINDOW, did[loses], value[loses])

    return asked.mapInArrow(tidied(send), PACKED).groupBy("bucket").applyInArrow(meet, FOUND)


def cut(data: np.ndarray, phrases: np.ndarray, windows: np.ndarray, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, removed spans) of one text, given the sorted fingerprints that it loses."""
    marks = np.zeros(len(data) + 1, np.int32)
    for p, _, at in parses(data, np.array([0, len(data)]), length):
        if len(phrases):
            lost = phrases[np.minimum(np.searchsorted(phrases, p.phrase), len(phrases) - 1)] == p.phrase
            np.add.at(marks, p.start[lost] + at, 1)
            np.add.at(marks, p.start[lost] + p.count[lost] - 1 + length + at, -1)
        if len(windows):
            start, value = p.windows(np.arange(len(p.start)))
            start = start[windows[np.minimum(np.searchsorted(windows, value), len(windows) - 1)] == value] + at
            np.add.at(marks, start, 1)
            np.add.at(marks, start + length, -1)
    gone = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return data[~gone].tobytes(), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with texts also spans and kept (bytes)."""
    docs = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "text")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(256, math.ceil(total / BUCKET_BYTES))  # about a row for 16 bytes, and some 30 bytes a row
    found = materialise(phrase_findings(docs, length, buckets), "phrases")
    asks = materialise(found.filter(F.col("kind") == ASK).groupBy("did").agg(F.collect_set("value").alias("triggers")), "asks")
    n_asks = asks.count()
    lost = found.filter(F.col("kind") == PHRASE)
    if n_asks:
        near = docs.join(small(asks.select("did"), 16, n_asks), "did", "left_semi")
        lost = lost.unionByName(window_findings(near.join(asks, "did").select("did", "text", "triggers"), length, buckets))
    lists = lost.groupBy("did").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(x) for k, x in ((PHRASE, "phrases"), (WINDOW, "windows"))))
    lists = materialise(lists, "lost")
    n_lost = lists.count()
    own = F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")
    none = F.array().cast("array<struct<start:long, end:long>>")
    more = [none.alias("spans"), F.col("text").cast("binary").alias("kept")] if texts else []
    untouched = docs.join(small(lists.select("did"), 16, n_lost), "did", "left_anti")
    untouched = untouched.select("did", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), sha_hex(F.col("text")).alias("kept_sha256"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            rows = []
            for k in range(batch.num_rows):
                phrases, windows = (np.sort(np.array(batch.column(c)[k].values, np.int64).view(np.uint64)) for c in (2, 3))
                kept, spans = cut(data[offsets[k] : offsets[k + 1]], phrases, windows, length)
                n = int(offsets[k + 1] - offsets[k])
                rows.append((n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans] if texts else None, kept if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.record_batch([batch.column(0), *columns[: 6 if texts else 4]], names[: 7 if texts else 5])

    touched = docs.join(small(lists.select("did"), 16, n_lost), "did", "left_semi").join(lists, "did").select("did", "text", "phrases", "windows")
    schema = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long, end:long>>, kept binary" * texts
    out = untouched.unionByName(touched.mapInArrow(tidied(run), schema))
    return out.select(own, *out.columns[1:])
