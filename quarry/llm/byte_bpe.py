"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

The merges are compiled on demand. A state is (last token emitted, bytes not yet decided); reading a byte extends, for
every place where a token may still start, the one valid chain of tokens that ends there (two tokens may stand side by
side only if merging their joined bytes gives back just those two). Once all live chains pass one boundary, the tokens
before it are emitted: no further byte can change them, so the lookahead is bounded by the longest token. States and arcs
are made when first met, kept in bounded tables, and whole units of text are kept as compressed arcs.

Texts are cut into units where a white-space character follows another character: no match of the split pattern
crosses such a place, whatever stands around it. A match taken alone is one match again, so that units share what
their matches were coded to. Short texts that have single spaces only are coded together, each different unit once.

Decoding is streaming: token bytes pass through an incremental UTF-8 state machine.

Defined results: a null or empty text has no tokens; repeated rows and null ids give one row each; other columns are not
read; texts of any length are coded whole, in pieces, and results leave in batches of a few MB of text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_text, map_rows, portions, raw_bytes, tidied

#: Text that goes into one batch of results, about.
OUT_BYTES = 2 << 20

#: White space of the split pattern (fixed values, Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_unclean = [chr(i) + " " for i in range(0x3001) if re.match(f"[{SPACE}]", chr(i))]
_units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def units(text: str) -> list[str]:
    """The text cut wherever white space follows another character; for text with white space in runs."""
    return _units.findall(text)


def is_plain(text: str) -> bool:
    """No space at the start or after other white space: text.split(' ') then gives the units, less their leading space."""
    return not text.startswith(" ") and not any(x in text for x in _unclean)


def numbers(ids: str) -> np.ndarray:
    """From decimals joined by a space."""
    return np.fromstring(ids, np.int32, sep=" ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Lazily determinised; `limit` bounds its arcs and its memory of pairs, which are emptied when full.

    A state holds, for each place where a token may still start, the node of the trie of tokens that the bytes since then
    lead to and the tokens (after the last one emitted) before it, and the last token emitted if one of these chains is
    empty. Arcs are filed under state << 8 | byte; of one that emits tokens the complement of its target is kept.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 600_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.steps: dict[int, int] = {}
        self.token, inner = [-1], bytearray(1)
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                inner[node] = 1
                if (next_ := self.steps.get(node << 8 | byte)) is None:
                    next_ = self.steps[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    inner.append(0)
                node = next_
            self.token[node] = rank
        self.inner = bytes(inner)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (-1, ((0, ()),))
        self.names, self.states, self.arcs, self.emits = {start: 0}, [start], {}, {}

    def halved(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, (token, token) for a byte; None if merging never makes it."""
        if token not in self.halves:
            parts = [bytes((b,)) for b in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60 or rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (token, token) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side: undoing their merges from the latest, no pair that meets at the border may have come first."""
        if (known := self.fits.get(pair := left << 32 | right)) is None:
            if len(self.fits) >= self.limit:
                self.fits.clear()
            known = self.fits[pair] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60) < limit:
                return False
            inner, outer = self.halved(left)[1], self.halved(right)[0]
            # the half that was merged later is undone first; of equal ranks the left one had been merged first
            if left > right and inner != left or outer == right:
                if inner == left:
                    return True
                limit, left = left, inner
            else:
                limit, right = right + 1, outer

    def extend(self, arc: int) -> int:
        before, live = self.states[arc >> 8]
        byte, token, found, after = arc & 0xFF, self.token, None, []
        for node, path in live:
            if node := self.steps.get(node << 8 | byte):
                if found is None and (rank := token[node]) >= 0 and self.halved(rank):
                    left = path[-1] if path else before
                    if left < 0 or self.fit(left, rank):
                        found = (*path, rank)
                if self.inner[node]:
                    after.append((node, path))
        after.append((0, found))
        out = after[0][1]  # what stays of it are the tokens that all chains share
        for _, path in after:
            if not out:
                break
            while path[: len(out)] != out:
                out = out[:-1]
        if out:
            before, after = out[-1], [(node, path[len(out) :]) for node, path in after]
        key = (before if not all(path for _, path in after) else -1, tuple(after))
        if (name := self.names.get(key)) is None:
            name = self.names[key] = len(self.states)
            self.states.append(key)
        if out:
            self.emits[arc], name = out, ~name
        self.arcs[arc] = name
        return name

    def encode(self, piece: bytes) -> list[int]:
        """Of one match of the split pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.arcs) >= self.limit:
            self.reset()
        out: list[int] = []
        known, state = self.arcs.get, 0
        for byte in piece:
            arc = state << 8 | byte
            if (state := known(arc)) is None:
                state = self.extend(arc)
            if state < 0:
                out += self.emits[arc]
                state = ~state
        return out + list(self.states[state][1][-1][1])


class Utf8Stream:
    """An incremental UTF-8 state machine: its state is the unfinished sequence at the end of what it was fed."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a sequence that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 4 if lead & 0xF8 == 0xF0 else 3 if lead & 0xF0 == 0xE0 else 2 if lead & 0xE0 == 0xC0 else 1
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        k = self.unfinished(data)
        self.held = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class _Arcs:
    """Unit of text -> its ids in decimal, joined by a space; when full, what wasn't met since the last time goes. Long units, which hardly come again, are not kept."""

    LONG = 64

    def __init__(self, codec: Codec, lead: str):
        self.codec, self.lead = codec, lead
        self.old: dict[str, str] = {}
        self.now = _Met(self.meet)

    def meet(self, unit: str) -> str:
        if (out := self.old.get(unit)) is None:
            matches = self.codec.split(self.lead + unit)
            out = " ".join(map(self.codec.one if len(matches) > 1 and len(unit) <= self.LONG else self.codec.fresh, matches))
        if len(unit) <= self.LONG:
            self.now[unit] = out
        return out

    def turn(self) -> None:
        """To be called between texts: a full table becomes the old one."""
        if len(self.now) >= self.codec.kept:
            self.old, self.now = self.now, _Met(self.meet)


class _Met(dict):
    def __init__(self, meet):
        self.meet = meet

    def __missing__(self, unit: str) -> str:
        return self.meet(unit)


class Codec:
    """`kept` bounds the units kept as compressed arcs, twice over, of _Arcs.LONG characters at most, so their bytes are bounded too."""

    STEP = 1 << 15

    def __init__(self, ranks_path: str, pattern: str, kept: int = 450_000, arcs: int = 600_000):
        self.kept = kept
        ranks = load_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, arcs)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for text, i in ranks.items():
            self.bytes_of[i] = text
        self.sizes = np.array([len(x) for x in self.bytes_of])
        self.decimal = {i: str(i) for i in ranks.values()}
        self.bare, self.spaced = _Arcs(self, ""), _Arcs(self, " ")

    def coded(self, text: str) -> Iterator[str]:
        """The ids, as decimals joined by spaces, some units at a time."""
        if not text:
            return
        self.bare.turn()
        if is_plain(text):
            first, *rest = text.split(" ")
            if first:
                yield self.bare.now[first]
            arcs = self.spaced
        else:
            rest, arcs = units(text), self.bare
        for at in range(0, len(rest), self.STEP):
            arcs.turn()
            yield " ".join(map(arcs.now.__getitem__, rest[at : at + self.STEP]))

    def fresh(self, match: str) -> str:
        """The ids of one match of the split pattern."""
        ids = self.transducer.encode(match.encode())
        return self.decimal[ids[0]] if len(ids) == 1 else " ".join([self.decimal[i] for i in ids])

    def one(self, match: str) -> str:
        """As fresh(), looked up and, while there is room, kept as the unit that it is."""
        arcs, unit = (self.spaced, match[1:]) if match[0] == " " else (self.bare, match)
        if (out := arcs.now.get(unit)) is None:
            if (out := arcs.old.get(unit)) is None:
                out = self.fresh(match)
            if len(arcs.now) < self.kept:
                arcs.now[unit] = out
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.coded(text) for i in part.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(self.bytes_of[i]) for i in ids]) + stream.close()

    def round_trip(self, text: str, want: set[str]) -> dict:
        """Codes and decodes a text piece by piece."""
        count, coded, decoded, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        texts: list[str] = []
        for k, part in enumerate(self.coded(text)):
            coded.update((" " * bool(k) + part).encode())
            codes = numbers(part)
            count += len(codes)
            back = stream.feed(b"".join([self.bytes_of[i] for i in codes.tolist()]))
            decoded.update(back.encode())
            if "ids" in want:
                ids.append(codes)
            if "decoded" in want:
                texts.append(back)
        last = stream.close()
        decoded.update(last.encode())
        return {"n_tokens": count, "ids": np.concatenate(ids), "decoded": "".join(texts) + last, "ids_sha256": coded.hexdigest(), "decoded_sha256": decoded.hexdigest()}

    def round_trips(self, texts: list[str], want: set[str]) -> list[dict]:
        """round_trip() of each text; the plain ones go together, so that a unit they share is looked up and decoded once."""
        some = [k for k, x in enumerate(texts) if x and len(x) <= OUT_BYTES and is_plain(x)]
        out = dict(zip(some, self._together([texts[k] for k in some], want) if some else [], strict=True))
        return [out[k] if k in out else self.round_trip(x, want) for k, x in enumerate(texts)]

    def _together(self, texts: list[str], want: set[str]) -> Iterator[dict]:
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        edges, met = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        names, places = met.dictionary.to_pylist(), met.indices.to_numpy().copy()
        firsts, known = places[edges[:-1]].tolist(), []
        for at in range(0, len(names), self.STEP):
            self.spaced.turn()
            known += map(self.spaced.now.__getitem__, names[at : at + self.STEP])
        self.bare.turn()
        places[edges[:-1]] = np.arange(len(known), len(known) + len(texts))  # no space stands before the first unit of a text
        known += [self.bare.now[names[i]] for i in firsts]
        ids, counts = numbers(" ".join(known)), np.array([x.count(" ") + 1 for x in known])
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))]
        back = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(known), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join([self.bytes_of[i] for i in ids.tolist()]))])
        data, at = raw_bytes(back.take(pa.array(places)))
        coded = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, pa.array(known, pa.string()).take(pa.array(places))), " ")
        at, totals = at[edges].tolist(), np.add.reduceat(counts[places], edges[:-1]).tolist()
        for k, row in enumerate(coded.to_pylist()):
            stream = Utf8Stream()
            text = stream.feed(data[at[k] : at[k + 1]].tobytes()) + stream.close()
            yield {"n_tokens": totals[k], "ids": numbers(row) if "ids" in want else None, "decoded": text, "ids_sha256": hashlib.sha256(row.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}


@lru_cache(maxsize=1)
def codec(*args) -> Codec:
    """One per Python worker: what it has learnt serves the next tasks."""
    return Codec(*args)


def forget() -> None:
    codec.cache_clear()
    gc.collect()  # a codec and its tables refer to each other


TYPES = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, columns: tuple[str, ...] = tuple(TYPES), id_col: str = "doc_id", text_col: str = "text", kept: int = 450_000, arcs: int = 600_000, lasting: bool = True) -> DataFrame:
    """One row per input row: doc_id and the wanted columns of TYPES. ranks_path must be there on every executor.

    kept and arcs bound the tables of a worker, some 300 and 600 bytes an entry; unless lasting, they go with each task,
    so that other stages find the memory free.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, want = codec(ranks_path, pattern, kept, arcs), set(columns)
        for whole in batches:
            for batch in portions(whole, 1, OUT_BYTES):
                rows = c.round_trips(batch.column(1).to_pylist(), want)
                yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], TYPES[k][1]) for k in columns)], ["doc_id", *columns])

    return id_text(docs, id_col, text_col).mapInArrow(tidied(run, None if lasting else forget), "doc_id long, " + ", ".join(f"{k} {TYPES[k][0]}" for k in columns))


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_path, pattern)
        return pa.record_batch([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_rows(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].alias("ids")), run, "doc_id long, text string")
