"""Scalar text functions as Column expressions (JVM side); the two that have no native form are pandas UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words of retrieval, legal suffixes in the order in which they are tried, and descriptors.
STOPWORDS = "a an and are as at be by do does for from how in is it its of on or that the their this to was what when where which who why with".split()
LEGAL_SUFFIXES = "incorporated limited gmbh sarl corp inc ltd ohg plc spa ag as sa".split()
ORG_DESCRIPTORS = "service services svc svcs system systems platform app".split()
MIN_STEM = 8

UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))

# Credential patterns (name, pattern, replacement), applied in this order; white space stays in the line.
MARKER = "***SCRUBBED***"
SECRETS = (
    ("github-token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}\b", MARKER),
    ("github-fine-grained-pat", r"\bgithub_pat_[A-Za-z0-9_]{16,}\b", MARKER),
    ("gitlab-pat", r"\bglpat-[A-Za-z0-9_-]{16,}\b", MARKER),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{30,}\b", MARKER),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", MARKER),
    ("google-api-key", r"\bAIza[A-Za-z0-9_-]{35}\b", MARKER),
    ("openai-key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", MARKER),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", MARKER),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", MARKER),
    ("authorization-header", r"(?i)\b(authorization[ \t]*:[ \t]*(?:bearer|token|basic)[ \t]+)\S+", "$1" + MARKER),
    ("sensitive-assignment", r"(?i)((?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|token|secret|password|accountkey)[ \t]*[=:][ \t]*)[A-Za-z0-9_./+-]{8,}", "$1" + MARKER),
)
CONTROLS = (r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)", r"\x1b\[[0-?]*[ -/]*[@-~]", r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition at plan time: characters that become one of a-z0-9, and those that become several."""
    one, to, several = [], [], []
    for code in range(0x80, 0x20000):
        if not 0xD800 <= code <= 0xDFFF:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c in "abcdefghijklmnopqrstuvwxyz0123456789")
            if len(plain) == 1:
                one.append(chr(code))
                to.append(plain)
            elif plain:
                several.append((chr(code), plain))
    return "".join(one), "".join(to), tuple(several)


def umlauts(c: Column) -> Column:
    out = F.lower(c)
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize(c: Column) -> Column:
    """Comparison key: lower case, umlauts to digraphs, other characters to their compatibility decomposition, a-z0-9 only."""
    one, to, several = _folds()
    low = umlauts(c)
    table = F.create_map(*(F.lit(x) for pair in several for x in pair))
    spelt = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("(?s)(.)"), F.lit(1)), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    # few texts hold one of the characters that become several
    low = F.when(low.rlike("[" + "".join(k for k, _ in several) + "]"), spelt).otherwise(low)
    return F.regexp_replace(F.translate(low, one, to), "[^a-z0-9]", "")


#: A run of a-z0-9 that is no stop word, without the last s if more than three characters.
TOKEN = rf"(?<![a-z0-9])(?!(?:{'|'.join(STOPWORDS)})(?![a-z0-9]))(?:[a-z0-9]{{3,}}(?=s(?![a-z0-9]))|[a-z0-9]{{2,}})"


def retrieval_tokens(c: Column) -> Column:
    """Runs of a-z0-9 without single characters and stop words; one trailing s goes from words longer than three."""
    return F.regexp_extract_all(umlauts(c), F.lit(TOKEN), F.lit(0))


def grams(c: Column, size: int) -> Column:
    """All strings of `size` characters of a text, in one pass; none if it is shorter."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def name_tokens(c: Column) -> Column:
    """Parts between white space and -_/.,& in normalised form, of two characters at least."""
    return F.filter(F.transform(F.split(c, r"[\s\-_/.,&]+"), normalize), lambda t: F.length(t) >= 2)


def strip_legal_suffix(c: Column) -> Column:
    """The normalised name without its legal form; null if it has none or too little would be left."""
    key, out = normalize(c), F.lit(None).cast("string")
    for suffix in reversed(LEGAL_SUFFIXES):
        stem = F.regexp_replace(key, f"{suffix}$", "")
        out = F.when(key.endswith(suffix), F.when(F.length(stem) >= MIN_STEM, stem)).otherwise(out)
    return out


def phrase(c: Column) -> Column:
    """Lower case, all else but a-z0-9 one space, padded: whole phrases are then substrings."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def has_phrase(text: Column, wanted: Column) -> Column:
    return F.contains(phrase(text), phrase(wanted)) & (F.length(phrase(wanted)) > 2)


def held_phrases(text: Column, wanted: list[str]) -> Column:
    """Those of some phrases that a text holds as whole phrases; the text is brought into form once."""
    listed = F.array(*(F.struct(F.lit(w).alias("wanted"), phrase(F.lit(w)).alias("form")) for w in wanted))
    hits = F.transform(F.array(phrase(text)), lambda body: F.filter(listed, lambda w: F.contains(body, w["form"]) & (F.length(w["form"]) > 2)))
    return F.transform(hits[0], lambda w: w["wanted"])


def money(currency: Column, amount: Column) -> Column:
    return F.concat(currency, F.lit(" "), F.format_number(amount, 2))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def neutralize_controls(c: Column) -> Column:
    out = c
    for pattern in CONTROLS:
        out = F.regexp_replace(out, pattern, "")
    return F.when(c.rlike(CONTROLS[-1]), out).otherwise(c)  # every sequence begins with a control character


def scrub(c: Column) -> tuple[Column, dict[str, Column]]:
    """(clean text, hits of each category, counted before its step). Texts that no pattern fits, nearly all, are only looked at once."""
    hits, clean = {}, neutralize_controls(c)
    out, suspect = clean, clean.rlike("|".join(f"(?:{pattern})" for _, pattern, _ in SECRETS))
    for name, pattern, to in SECRETS:
        hits[name] = F.when(suspect, F.regexp_count(out, F.lit(pattern))).otherwise(0)
        out = F.regexp_replace(out, pattern, to)
    return F.when(suspect, out).otherwise(clean), hits


def fence(c: Column) -> Column:
    """A code fence longer than any run of backticks inside, three at least."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def elide(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(" …[truncated]"))).otherwise(c)


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common substring: the longest of a's substrings that b contains."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    best = F.aggregate(
        starts, F.lit(0), lambda best, i: best + F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a) - i - best + 1, F.lit(1))), lambda k: (i + best + k - 1 <= F.length(a)) & F.contains(b, F.substr(a, i, best + k))))
    )
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(best)


@F.pandas_udf(T.DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt ratio of two normalised keys, left one first (it isn't symmetric); 0 if one is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")
