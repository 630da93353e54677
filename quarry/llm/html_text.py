"""Main text of web pages, with a host suffix array against repeated boilerplate.

A tolerant scanner reads the tags, drops the parts that landmarks mark as no article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments), and gives the blocks of the article, or of the whole body
where a page marks none. Of the token streams of
a host's pages a suffix array (prefix doubling up to `min_run` tokens, runs never cross blocks) tells which strings of
`min_run` tokens repeat. A run that stands in `min_pages` different contents and in `min_share` of all contents of the
whole host is the site's boilerplate; tokens that such runs cover go from every page of the host, the others stay.

Contents are pages told apart by a sketch (two minima over hashed strings of three tokens): exact copies of an article
count as one, close copies mostly do, pages that share their boilerplate only count each. Runs are told by 64-bit
fingerprints.

Pages of a host with more than `group_pages` contents, or more than GROUP_BYTES of text, are dealt by their sketch to
several arrays of about that size, so that no task holds a whole host. A run that reaches the bound over the host reaches its part of the bound in one array
at least; what does so is counted again over all pages of the host, so the parts have no effect on the result.

Defined results: a null or empty html gives an empty text; a null url has an empty host; repeated rows and null ids give
one row each; other columns are not read; nothing is capped.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Powers, map_rows, materialise, mix, small, tidied

#: Element names, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp".split())
SKIP = frozenset("nav footer aside form button select dialog menu head".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 body html main".split())
SKIP_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo related replies share sidebar signup social sponsor sponsored subscribe".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_marks = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_word = re.compile(r"[a-z]+")


def _skipped(name: str, attributes: str, inside: bool) -> bool:
    if name in SKIP or name == "header" and not inside:
        return True
    if not attributes or name in TITLES:
        return False
    words = {w for m in _marks.finditer(attributes) for w in _word.findall((m[1] or m[2] or m[3] or "").lower())}
    return bool(words & (COMMENT_WORDS if name == "article" else SKIP_WORDS))


def blocks(page: str) -> list[str]:
    """The candidate blocks in page order, white space collapsed, character references decoded."""
    article: list[str] = []
    body: list[str] = []
    piece: list[str] = []
    inside = 0  # depth of article and main
    skip, depth = "", 0  # the element that is skipped, and how deep it nests in itself
    marked = False
    at, n = 0, len(page)

    def close() -> None:
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            (article if inside else body).append(text)

    while at < n:
        m = _token.search(page, at)
        if not skip:
            piece.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in RAW and not ends:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else n if name in ("script", "style", "textarea", "title") else at
            continue
        if skip:
            if name in ("article", "main") and not ends and not inside and skip != "article" and not _skipped(name, m[3], False):
                skip, depth = "", 0  # the skipped part was never closed
            else:
                if name == skip:
                    depth += -1 if ends else not m[3].endswith("/")
                if depth <= 0 or ends and name in ("article", "main", "body") and inside and name != skip:
                    skip, depth = "", 0
                    if name not in ("article", "main", "body"):
                        continue
                else:
                    continue
        if name in BLOCK:
            close()
        elif name == "br":
            piece.append(" ")
        if not ends:
            if name not in VOID and not m[3].endswith("/") and _skipped(name, m[3], bool(inside)):
                if piece:
                    close()
                skip, depth = name, 1
            elif name in ("article", "main"):
                inside, marked = inside + 1, True
        elif name in ("article", "main"):
            inside = max(0, inside - 1)
    close()
    return article if marked else body


_powers = Powers(0xD6E8FEB86659FD93, 41)
#: Text that is hashed at once.
PIECE = 1 << 20
#: Text of the pages that one array holds, about.
GROUP_BYTES = 16 << 20


def strings(hashed: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of the `length` tokens from each place on."""
    n = max(0, len(hashed) - length + 1)
    return combine([hashed[k : k + n] for k in range(length)])


def combine(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0].copy()
    for x in columns[1:]:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += x
    return mix(out)


def among(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which values are in some sorted runs."""
    return runs[np.minimum(np.searchsorted(runs, values), len(runs) - 1)] == values if len(runs) else np.zeros(len(values), bool)


def joined(pages: list[list[str]], marks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed tokens of some pages with marks (0) after each block, whether each is a mark, and its page."""
    data = np.frombuffer("".join([f"{block}\n" for page in pages for block in page]).encode(), np.uint8)
    stops = np.flatnonzero((data == 32) | (data == 10))  # a space or the block's end stands after each token
    starts = np.concatenate([np.zeros(1, np.int64), stops[:-1] + 1])[: len(stops)]
    hashed, at = np.zeros(len(stops), np.uint64), 0
    while at < len(stops):
        last = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, side="right")))
        lo = int(starts[at])
        sums = _powers.prefix(data[lo : int(stops[last - 1])])
        hashed[at:last] = _powers.span(sums, starts[at:last] - lo, stops[at:last] - lo)
        at = last
    hashed |= np.uint64(1)  # no token looks like a mark
    ends = data[stops] == 10
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends)])
    tokens = np.zeros(len(stops) + marks * int(before[-1]), np.uint64)
    place = np.arange(len(stops)) + marks * before[:-1]
    tokens[place] = hashed
    sizes = np.array([sum(block.count(" ") + 1 + marks for block in page) for page in pages], np.int64)
    return tokens, tokens == 0, np.repeat(np.arange(len(pages)), sizes)


def free(ends: np.ndarray, length: int) -> np.ndarray:
    """The places from which `length` tokens stand in one block."""
    if len(ends) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(ends)])
    return np.flatnonzero(sums[length:] == sums[:-length])


def sketches(pages: list[list[str]]) -> np.ndarray:
    """Equal for copies; pages that share a part b of their strings have the same one with a chance of about b squared."""
    tokens, last, owner = joined([[" ".join(page)] if page else [] for page in pages], 2)  # two marks, so no string reaches the next page
    grams = strings(np.concatenate([tokens, np.zeros(2, np.uint64)]), 3)
    low = []
    for salt in (21, 22):
        value = mix(grams, salt)
        value[last] = np.iinfo(np.uint64).max
        least = np.full(len(pages), np.iinfo(np.uint64).max, np.uint64)
        if len(tokens):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least[owner[starts]] = np.minimum.reduceat(value, starts)
        low.append(least)
    return mix(low[0] + mix(low[1], 23)).view(np.int64)


def repeated_runs(pages: list[list[str]], contents: list[int], min_run: int, bound: int) -> np.ndarray:
    """Fingerprints of the runs that stand in at least `bound` different contents, by a suffix array."""
    tokens, ends, page = joined(pages)
    if not len(tokens):
        return tokens
    owner = np.array(contents, np.int64)[page]
    n = len(tokens)
    inside = np.zeros(n, bool)
    inside[free(ends, min_run)] = True
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    rank[ends] = n + np.arange(ends.sum())  # each end of a block is unlike all others
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < min_run:  # after this, suffixes are in order of their first min_run tokens
        step = min(reach, min_run - reach)
        pair = rank * (n + 1)
        pair[:-step] += rank[step:] + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        reach += step
    order = np.lexsort((owner, rank))
    run, page_of = rank[order], owner[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (run[1:] != run[:-1]) | (page_of[1:] != page_of[:-1])
    first = np.ones(n, bool)
    first[1:] = run[1:] != run[:-1]
    spread = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(first))
    places = order[first][spread >= bound]
    return strings(tokens, min_run)[places[inside[places]]]


def without(pages: list[list[str]], runs: np.ndarray, min_run: int) -> list[list[str]]:
    """The blocks of some pages without the tokens that some runs cover."""
    tokens, ends, owner = joined(pages)
    places = free(ends, min_run)
    if len(places):
        places = places[among(strings(tokens, min_run)[places], runs)]
    if not len(places):
        return pages
    cover = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + min_run, -1)
    gone = np.cumsum(cover) > 0
    starts = np.searchsorted(owner, np.arange(len(pages)))
    out = list(pages)
    for k in np.unique(owner[places]).tolist():
        kept, at = [], int(starts[k])
        for block in pages[k]:
            n = block.count(" ") + 1
            if gone[at : at + n].any():
                block = " ".join([t for t, g in zip(block.split(" "), gone[at : at + n].tolist(), strict=True) if not g])
            at += n + 1
            if block:
                kept.append(block)
        out[k] = kept
    return out


def pack(page: list[str]) -> tuple[bytes, int]:
    data = "\n".join(page).encode()
    return pa.compress(data, "zstd", asbytes=True), len(data)


def unpack(data: bytes, size: int) -> list[str]:
    return pa.decompress(data, size, "zstd", asbytes=True).decode().split("\n") if size else []


def beside_runs(pages: DataFrame, runs: DataFrame, hosts: DataFrame, fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """fn(pages, runs) over all pages (page_id, url, host, ...), each with the runs (host, run) of its host."""
    runs = materialise(runs, "runs")
    if runs.count() * 128 <= BROADCAST_BYTES:
        by: dict[str, list[int]] = {}
        for r in runs.collect():
            by.setdefault(r["host"], []).append(r["run"])
        held = pages.sparkSession.sparkContext.broadcast({k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in by.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places: dict[str | None, list[int]] = {}
                for i, h in enumerate(batch.column("host").to_pylist()):
                    places.setdefault(h if h in held.value else None, []).append(i)
                for h, at in places.items():
                    yield from fn(pa.Table.from_batches([batch]).take(at), held.value[h] if h is not None else np.zeros(0, np.uint64)).to_batches()

        return pages.mapInArrow(tidied(run), schema)
    part = F.pmod(F.xxhash64(F.lit(11), "page_id", "url"), F.coalesce("splits", F.lit(1)))
    dealt = pages.join(small(hosts.select("host", "splits"), 64), "host", "left").withColumn("part", part).drop("splits")
    near = dealt.select(F.col("host").alias("of_host"), F.col("part").alias("of_part")).distinct().join(runs.withColumnRenamed("host", "of_host"), "of_host")

    def group(t: pa.Table, r: pa.Table) -> pa.Table:
        return fn(t, np.sort(r["run"].to_numpy().astype(np.int64).view(np.uint64)))

    return dealt.groupBy(F.col("host"), F.col("part")).cogroup(near.groupBy(F.col("of_host"), F.col("of_part"))).applyInArrow(group, schema)


def main_text(pages: DataFrame, min_run: int = 8, min_share: float = 0.05, min_pages: int = 3, group_pages: int = 400, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    after = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.lower(after).alias("host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [blocks(x.as_py()) for x in batch.column(3)]
        packed = [pack(p) for p in found]
        more = [pa.array(sketches(found)), pa.array([x for x, _ in packed], pa.binary()), pa.array([n for _, n in packed], pa.int64())]
        return pa.record_batch([*batch.columns[:3], *more], ["page_id", "url", "host", "content", "packed", "size"])

    scanned = materialise(map_rows(rows, scan, "page_id long, url string, host string, content long, packed binary, size long"), "page-blocks")
    n = F.count(F.lit(1))
    hosts = scanned.groupBy("host", "content").agg(n.alias("copies"), F.max("size").alias("size")).groupBy("host").agg(n.alias("n"), F.sum("copies").alias("pages"), F.sum("size").alias("bytes"), F.sum(F.col("size") * F.col("copies")).alias("all_bytes")).filter(F.col("n") >= min_pages)
    bound = F.greatest(F.lit(min_pages), F.ceil(F.col("n") * min_share)).cast("long")
    cut = lambda pages, size: F.greatest(F.ceil(F.col(pages) / group_pages), F.ceil(F.col(size) / GROUP_BYTES))
    hosts = materialise(hosts.select("host", cut("n", "bytes").alias("parts"), cut("pages", "all_bytes").alias("splits"), bound.alias("bound")), "hosts")
    held = scanned.select("host", "content", "packed", "size").join(small(hosts, 64), "host")
    dealt = held.select("host", F.pmod("content", "parts").alias("part"), "parts", "bound", "content", "packed", "size")

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # exact copies in a map task are sent once
        for batch in batches:
            keep = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), (hashlib.blake2b(x.as_py(), digest_size=16).digest() for x in batch.column(5)), strict=True)):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    def group(t: pa.Table) -> pa.Table:
        parts, least = t["parts"][0].as_py(), t["bound"][0].as_py()
        texts = [unpack(*x) for x in zip(t["packed"].to_pylist(), t["size"].to_pylist(), strict=True)]
        found = repeated_runs(texts, t["content"].to_pylist(), min_run, -(-least // parts))
        return pa.table({"host": pa.array([t["host"][0].as_py()] * len(found), pa.string()), "run": pa.array(found.view(np.int64)), "parts": pa.array([parts] * len(found), pa.int64()), "bound": pa.array([least] * len(found), pa.int64())})

    found = materialise(dealt.mapInArrow(tidied(fresh), dealt.schema).groupBy("host", "part").applyInArrow(group, "host string, run long, parts long, bound long"), "found-runs")

    def stands(t: pa.Table, runs: np.ndarray) -> pa.Table:
        texts = [unpack(*x) for x in zip(t["packed"].to_pylist(), t["size"].to_pylist(), strict=True)] if len(runs) else []
        tokens, ends, owner = joined(texts)
        at = free(ends, min_run)
        run = strings(tokens, min_run)[at]
        hit = among(run, runs)
        rows = t.select(["host", "content"]).take(pa.array(owner[at[hit]], pa.int64()))
        return rows.append_column("run", pa.array(run[hit].view(np.int64))).group_by(["host", "content", "run"]).aggregate([])

    crowded = hosts.filter(F.col("parts") > 1)
    wide = scanned.join(small(crowded.select("host"), 64), "host", "left_semi").select(*scanned.columns)
    counted = beside_runs(wide, found.filter(F.col("parts") > 1).select("host", "run").distinct(), hosts, stands, "host string, content long, run long")
    counted = counted.distinct().groupBy("host", "run").agg(n.alias("n")).join(small(crowded.select("host", "bound"), 64), "host").filter(F.col("n") >= F.col("bound"))
    runs = found.filter(F.col("parts") == 1).select("host", "run").unionByName(counted.select("host", "run"))

    def cover(t: pa.Table, runs: np.ndarray) -> pa.Table:
        found = [unpack(*x) for x in zip(t["packed"].to_pylist(), t["size"].to_pylist(), strict=True)]
        texts = ["\n\n".join(page) for page in (without(found, runs, min_run) if len(runs) else found)]
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return beside_runs(scanned, runs, hosts, cover, "page_id long, url string, text string, n_chars long")
