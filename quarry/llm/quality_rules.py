"""Quality rules with suffix-array repetition.

Each text's words get ids; a suffix array over them (prefix doubling) and the longest common prefixes of neighbouring
suffixes give, for every word, the longest string starting there that occurs again. The spans of repeats of at least
`min_repeat` words are united; a text fails if they cover too large a fraction of its words or if one repeat is too long.
The suffix array is only built for texts in which some string of `min_repeat` words occurs twice, which a set of rolling
hashes tells; in all others no repeat reaches that length.

Defined results: a null or empty text has no words, and fails; repeated rows and null ids give one row each; other
columns are not read; a text of any length is judged whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_rows, mix

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_words_pct: int = 50
    #: Repeats shorter than this many words don't count as such.
    min_repeat: int = 10
    max_covered_pct: int = 25
    max_longest_pct: int = 15


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before); prefix doubling, its levels give the prefixes."""
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while levels[-1].max() < n - 1 and k < n:
        rank = levels[-1]
        pair = rank * (n + 1)
        pair[:-k] += rank[k:] + 1
        levels.append(np.unique(pair, return_inverse=True)[1])
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + (1 << level) <= n
        same = inside.copy()
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        step = same * (1 << level)
        common[1:] += step
        a, b = np.minimum(a + step, n - 1), np.minimum(b + step, n - 1)
        # a suffix that has run out has no further match
        done = (order[1:] + common[1:] >= n) | (order[:-1] + common[1:] >= n)
        a, b = np.where(done, n, a), np.where(done, n, b)
    return order, common


def repeats(ids: np.ndarray, min_repeat: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(covered words, longest repeat, united spans) of strings of at least min_repeat words that occur again."""
    n = len(ids)
    if n <= min_repeat:
        return 0, 0, []
    parts = mix(ids.astype(np.uint64), 1)
    rolled = np.zeros(n - min_repeat + 1, np.uint64)
    for k in range(min_repeat):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + parts[k : n - min_repeat + 1 + k]
    if len(np.unique(rolled)) == len(rolled):
        return 0, 0, []
    order, common = suffix_array(ids)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(common, np.append(common[1:], 0))
    longest[longest < min_repeat] = 0
    starts = np.flatnonzero(longest)
    if not len(starts):
        return 0, 0, []
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + longest[starts], -1)
    covered = np.concatenate(([0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(covered))
    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return sum(b - a for a, b in spans), int(longest.max()), spans


def judge(text: str, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat."""
    words = text.encode().split()  # splits bytes at these six characters only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat_words = covered = longest = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(counts := Counter(windows)) < len(windows):
            end = 0  # of the words counted so far
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    n_repeat_words += i + 3 - max(i, end)
                    end = i + 3
            index: dict[bytes, int] = {}
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
            covered, longest, _ = repeats(ids, rules.min_repeat)
    base_failed = n < rules.min_words or 100 * n_repeat_words > rules.max_repeat_words_pct * n
    kept = not base_failed and 100 * covered <= rules.max_covered_pct * n and 100 * longest <= rules.max_longest_pct * n
    return n, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered, longest


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and NAMES."""
    kinds = [pa.bool_() if k in ("base_failed", "kept") else pa.int64() for k in NAMES]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(judge(x.as_py(), rules) for x in batch.column(1)), strict=True))
        return pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], ["doc_id", *NAMES])

    return map_rows(id_text(docs, id_col, text_col), run, "doc_id long, " + ", ".join(f"{k} {'boolean' if t == pa.bool_() else 'long'}" for k, t in zip(NAMES, kinds, strict=True)))


def drop_failing(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; judged where they lie, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([judge(x.as_py() or "", rules)[6] for x in batch.column(at)], pa.bool_()))

    return map_rows(docs, run, docs.schema)
