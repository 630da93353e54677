"""Personal data: fixed patterns, and information-theoretic sanitisation of what reveals it.

Base spans follow four patterns. The method adds terms: over all texts, a term discloses a base entity if the lower
confidence bound of P(entity | term), by Wilson's interval with `deviations` standard deviations, reaches `min_share`, and
its information about the entity, log2(bound / P(entity)), reaches `min_bits`. Both stand together wherever one text holds
them, however far apart. There is no least support: few texts widen the interval. With one deviation a term in a single
text of the corpus, next to an entity, just passes, as whoever finds the term finds the entity; one more text without the
entity and it fails, while 4 of 5 texts pass. Every occurrence of such a term becomes a span of kind `term`; sanitise()
generalises base spans to their kind and removes disclosing terms. Equal texts (copies) count once.

Defined results: a null or empty text has no spans; repeated rows give one row each, rows with null ids too; other
columns are not read; texts are searched whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_rows, materialise, small, small_measured

KINDS = ("email", "ip", "card", "phone", "term")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't start inside a run of digits if none starts at the run's first digit; without this long runs take quadratic time
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")
#: Terms: words of three letters or digits and more.
TERM = re.compile(r"[^\W_]{3,}")
TERM_JAVA = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Disclosure:
    deviations: float = 1.0
    min_share: float = 0.5
    min_bits: float = 6.0


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part has no @, so each match starts at the run of its characters before an @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        after = at + 1
        if start < at and (m := _domain.match(text, after)):
            out.append((start, m.end()))
            free = after = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _digit.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def term_spans(text: str, terms: set[str]) -> list[tuple[int, int, int]]:
    return [(m.start(), 4, m.end()) for m in TERM.finditer(text) if m[0].lower() in terms]


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Base spans generalised to [KIND], terms removed; of overlapping spans the earlier goes first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out.append(text[at:a] + (f"[{KINDS[k].upper()}]" if k < 4 else ""))
        at = max(at, b)
    return "".join(out) + text[at:]


def named(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[str]]:
    """The entities of a text, and its terms outside base spans."""
    entities, rest, at = set(), [], 0
    for a, k, b in spans:
        entities.add(f"{KINDS[k]}:{text[a:b].lower()}" if k in (0, 1) else f"{KINDS[k]}:" + "".join(filter(str.isdigit, text[a:b])))
        rest.append(text[at : max(at, a)])
        at = max(at, b)
    if not entities:
        return [], []
    return sorted(entities), sorted({m[0].lower() for m in TERM.finditer("\0".join([*rest, text[at:]]))})


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _row(base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list:
    counts = [sum(1 for s in base if s[1] == k) for k in range(4)]
    return [*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(spans)]


def _batch(ids: pa.Array, rows: list[list], *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(x[1] for x in more)], [*names, *(x[0] for x in more)])


def lower_bound(hits: Column, of: Column, z: float) -> Column:
    """Of Wilson's interval for hits / of."""
    share = hits / of
    return (share + z * z / (2 * of) - z * F.sqrt(share * (1 - share) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def word_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("term", F.explode(F.array_distinct(F.split(F.lower("text"), TERM_JAVA)))).drop("text")


def disclosing_terms(evidence: DataFrame, docs: DataFrame, rule: Disclosure) -> DataFrame:
    """(entity, term, share, bits) of terms that disclose an entity, from texts with entities (content, entities, terms)."""
    evidence = evidence.dropDuplicates(["content"])
    pairs = evidence.select("content", F.explode("entities").alias("entity"))
    of_entity = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"), F.min("content").alias("content"))
    # entities of one and the same text only have equal figures: one stands for all, so that long lists don't multiply
    single = of_entity.filter("with_entity = 1").groupBy("content").agg(F.min("entity").alias("entity"), F.lit(1).cast("long").alias("with_entity"))
    several = of_entity.filter("with_entity > 1").select("entity", "with_entity")
    kept = materialise(single.select("content", "entity", "with_entity").unionByName(pairs.join(several, "entity").select("content", "entity", "with_entity")), "entities")
    words = evidence.select("content", F.explode("terms").alias("term"))
    # a term's texts with whatever entity are some of its texts: this bounds its share from above
    anywhere = words.groupBy("term").agg(F.count(F.lit(1)).alias("anywhere"))
    near = words.join(kept, "content").groupBy("entity", "term", "with_entity").agg(F.count(F.lit(1)).alias("both"))
    near = materialise(near.join(anywhere, "term").filter(lower_bound(F.col("both"), F.col("anywhere"), rule.deviations) >= rule.min_share - 1e-9), "near")
    names = near.select("term").distinct()
    of_term = word_rows(docs.select("content", "text")).join(small_measured(names, "term"), "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    total = docs.select(F.countDistinct("content").alias("total"))
    joined = near.join(of_term, "term").join(F.broadcast(total), F.lit(True))  # one row
    share = lower_bound(F.col("both"), F.greatest("with_term", "anywhere"), rule.deviations)
    joined = joined.select("entity", "term", share.alias("share"), F.log2(share / (F.col("with_entity") / F.col("total"))).alias("bits"))
    return joined.filter((F.col("share") >= rule.min_share - 1e-9) & (F.col("bits") >= rule.min_bits))


def personal_data(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: SCHEMA; spans has base spans and disclosing terms."""
    docs = id_text(docs, id_col, text_col)

    texts = docs.withColumn("content", F.xxhash64("text"))

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, entities, terms = [], [], []
        for x in batch.column(1):
            text = x.as_py()
            base = base_spans(text)
            rows.append(_row(base, base))
            for out, values in zip((entities, terms), named(text, base), strict=True):
                out.append(values)
        listed = pa.list_(pa.string())
        return _batch(batch.column(0), rows, ("content", batch.column(2)), ("entities", pa.array(entities, listed)), ("terms", pa.array(terms, listed)))

    found = materialise(map_rows(texts, first, SCHEMA + ", content long, entities array<string>, terms array<string>"), "base-spans")
    evidence = found.filter(F.size("entities") > 0).select("content", "entities", "terms")
    terms = materialise(disclosing_terms(evidence, texts, rule).select("term").distinct(), "terms")
    base = found.drop("content", "entities", "terms")
    if terms.isEmpty():
        return base
    words = word_rows(docs)
    hits = materialise(words.join(small_measured(terms, "term"), "term").groupBy("doc_id").agg(F.collect_set("term").alias("terms")).withColumnRenamed("doc_id", "hit_id"), "hits")
    n = hits.count()
    on = F.col("doc_id").eqNullSafe(F.col("hit_id"))

    def second(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x, terms in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = x.as_py()
            base = base_spans(text)
            rows.append(_row(base, sorted(base + term_spans(text, set(terms)))))
        return _batch(batch.column(0), rows)

    touched = map_rows(docs.join(small_measured(hits, "terms"), on).select("doc_id", "text", "terms"), second, SCHEMA)
    return base.join(small(hits.select("hit_id"), 16, n), on, "left_anti").unionByName(touched)
