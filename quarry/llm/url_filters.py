"""URL filters: pattern rules indexed by their rarest literal token.

Every rule, a host and path rule as well as a free pattern, is a regular expression with the literal tokens that any
match must hold. The tokens of all rules are counted over all URLs (the result is bounded by the rules), and each rule
is filed under the rarest of its tokens. The tokens of a URL fetch the rules filed under them, and only those run their
expression; a rule without a sure token runs on every URL. Among host and path rules the longest that fits decides; if
none fits, the patterns do, and `default` if none of them fits either.

Defined results: a null URL, or one without ://, has an empty host and path, and gets the default; repeated rows and
null ids give one row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """name: what the result shows, of a host and path rule `host/path`; pattern: on the host and the path, with a zero between."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    exact: bool


def host_rule(text: str, verdict: str) -> Rule:
    """`com/en/`: this host (A-Z in either case) and its subdomains, paths that start so. The last token of the path may go on in the URL."""
    host, _, path = text.partition("/")
    host = host.translate(_LOWER)
    # as in a URL, tokens are cut from the lower-cased text; what follows the last slash may go on
    whole = TOKEN.findall(host.lower()) + TOKEN.findall(path.rpartition("/")[0].lower())
    return Rule(text, rf"^(?:[^\0]*\.)?{re.escape(host)}\0{re.escape('/' + path)}", tuple(whole), verdict, True)


def pattern_rule(name: str, pattern: str, tokens: tuple[str, ...], verdict: str) -> Rule:
    """tokens: words of a to z and digits that stand whole, in either case, in all that the pattern matches."""
    return Rule(name, pattern, tokens, verdict, False)


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
            (self.always if rarest is None else self.by_token[rarest]).append((rule, re.compile(rule.pattern)))

    def judge(self, host: str, path: str, default: str) -> tuple[str | None, str]:
        subject = f"{host}\0{path}"
        fetched = [x for token in set(TOKEN.findall(subject.lower())) & self.by_token.keys() for x in self.by_token[token]]
        fit = [rule for rule, run in fetched + self.always if run.search(subject)]
        if exact := [r for r in fit if r.exact]:
            best = max(exact, key=lambda r: (len(r.name), r.name))
            return best.name, best.verdict
        return None, max(fit, key=lambda r: (len(r.name), r.name)).verdict if fit else default


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict."""
    after = F.regexp_extract(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "host", "path")), "[^a-z0-9]+"))
    listed = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    counted = rows.select(F.explode(F.array_intersect(tokens, listed)).alias("token")).groupBy("token").count()
    index = Index(rules, {r["token"]: r["count"] for r in counted.collect()} if wanted else {})  # a row for each token of the rules at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [index.judge(h, p, default) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.record_batch([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return map_rows(rows, run, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string")


#: The production rules (fixed values).
BASE_RULES = [host_rule("com/en/", "block"), host_rule("example.com/en/7", "allow"), host_rule("net/de/", "allow"), host_rule("example.net/de/8", "block"), host_rule("org/es/", "block")]
PATTERNS = [
    pattern_rule("login pages", r"\0/(?:.*/)?login(?:[/.]|$)", ("login",), "block"),
    pattern_rule("site administration", r"\0/(?:.*/)?wp-admin(?:/|$)", ("wp", "admin"), "block"),
    pattern_rule("advert servers", r"^(?:[^\0]*\.)?doubleclick\.", ("doubleclick",), "block"),
]
