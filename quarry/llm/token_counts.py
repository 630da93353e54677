"""Exact token counts of whole texts by a library tokenizer, with overlap resynchronisation for huge texts.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring encodings are spliced at a place inside the
overlap where both have a token boundary and white space follows another character: whatever stands further away, no
token of a byte-level BPE spans such a place, so both sides are proven stable there. If the overlap has no such place,
it is widened until it has one or the text ends.

Shorter texts are cut at the same proven places into units, whose counts by the library are remembered (a bounded
number of them); only units not yet met are given to the library.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids give one row each; other
columns are not read; nothing is truncated or padded.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SPACE, is_plain, units
from .common import id_text, map_rows

CHUNK, OVERLAP = 1 << 16, 1 << 9


class Counter:
    """`kept` bounds the units whose counts are remembered."""

    def __init__(self, tokenizer_path: str, kept: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kept = Tokenizer.from_file(tokenizer_path), kept
        self.library.no_truncation()
        self.library.no_padding()
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def learn(self, known: dict[str, int], met: set[str], lead: str) -> None:
        new = [u for u in met if u not in known]
        if len(known) + len(new) > self.kept:
            known.clear()
            new = list(met)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, map(len, self.library.encode_batch_fast([lead + u for u in part], add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str], huge: int = CHUNK) -> list[int]:
        out = [0] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        other: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if len(text) > huge:
                out[k] = self.spliced(text, huge)
            elif is_plain(text):
                first, *rest = text.split(" ")
                plain.append((k, rest))
                other.append((k, [first] if first else []))
            else:
                other.append((k, units(text)))
        for known, rows, lead in ((self.spaced, plain, " "), (self.bare, other, "")):
            self.learn(known, set().union(*(u for _, u in rows)), lead)
            for k, u in rows:
                out[k] += sum(map(known.__getitem__, u))
        return out

    def ends(self, text: str) -> list[tuple[int, int]]:
        return self.library.encode(text, add_special_tokens=False).offsets

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Of a huge text: the counts left and right of each splice, added."""
        total, start = 0, 0
        while True:
            end = min(len(text), start + chunk)
            left = self.ends(text[start:end])
            if end == len(text):
                return total + len(left)
            width, cut = min(overlap, chunk), None
            while cut is None:
                lo = max(start + 1, end - width)
                right = self.ends(text[lo:end])
                cut = self.common(text, start, left, lo, right, end)
                if cut is None:
                    if lo > start + 1:
                        width *= 2
                    elif end == len(text):
                        return total + len(left)
                    else:  # the whole chunk has none: take more text
                        end = min(len(text), end + chunk)
                        left, width = self.ends(text[start:end]), overlap
            total += sum(1 for _, b in left if start + b <= cut)
            start = cut

    @staticmethod
    def common(text: str, start: int, left: list[tuple[int, int]], lo: int, right: list[tuple[int, int]], end: int) -> int | None:
        """The last stable boundary that both encodings of the overlap show."""
        left_ends, right_ends = {start + b for _, b in left}, {lo + b for _, b in right}
        for p in range(end - 1, lo, -1):
            if text[p] in _SPACES and text[p - 1] not in _SPACES and p in left_ends and p in right_ends:
                return p
        return None


#: The characters of SPACE (fixed values).
_SPACES = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@lru_cache(maxsize=2)
def counter(tokenizer_path: str) -> Counter:
    return Counter(tokenizer_path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. tokenizer_path must be there on every executor."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, counts, texts, size = counter(tokenizer_path), [], [], 0
        for x in batch.column(2):
            texts.append(x.as_py())
            size += len(texts[-1])
            if size > 1 << 21:
                counts += c.counts(texts)
                texts, size = [], 0
        counts += c.counts(texts)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_rows(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
