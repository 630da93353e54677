"""JSON as text: canonical form, strict reading, scrubbing of values. Free-form JSON has no native sorted form, so these are pandas UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import CONTROLS, SECRETS, digest


class Number(str):
    """A number as it was written."""


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key comes twice")
    return out


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def strict(text: str) -> object:
    """Parsed; a repeated key, or a number that JSON doesn't know, is an error; numbers keep their form."""
    return json.loads(text, object_pairs_hook=_object, parse_int=Number, parse_float=Number, parse_constant=_constant)


def written(value: object) -> str:
    """Keys in order of code points, no spaces, all characters as they are, numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """The canonical form of a JSON text; null for null and for what isn't strict JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else written(strict(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)


def canonical_digest(text: Column) -> Column:
    return digest(canonical(text))


def idempotency_key(action: Column, target: Column, body: Column) -> Column:
    """A digest of the canonical request, so that the same request has the same key however its JSON is laid out."""
    quoted = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    value = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1)
    return canonical_digest(F.concat(F.lit('{"target":'), value(target), F.lit(',"action":'), value(action), F.lit(',"body":'), F.coalesce(body, F.lit("null")), F.lit("}")))


_controls = [re.compile(p) for p in CONTROLS]
_secrets = [(name, re.compile(p), to.replace("$1", r"\1")) for name, p, to in SECRETS]


def scrub_value(value: object, hits: list[int]) -> object:
    """Every string value scrubbed, keys as they are; adds to hits[0] what was taken out."""
    if isinstance(value, str) and not isinstance(value, Number):
        for p in _controls:
            value, n = p.subn("", value)
            hits[0] += n
        for _, p, to in _secrets:
            value, n = p.subn(to, value)
            hits[0] += n
        return value
    if isinstance(value, dict):
        return {k: scrub_value(v, hits) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub_value(v, hits) for v in value]
    return value


@F.pandas_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("hits", T.LongType())]))
def scrub_json(texts: pd.Series) -> pd.DataFrame:
    """(canonical form after scrubbing all string values, what was taken out); null for what isn't strict JSON."""
    clean, counts = [], []
    for text in texts:
        hits = [0]
        try:
            clean.append(None if text is None else written(scrub_value(strict(text), hits)))
        except (ValueError, RecursionError):
            clean.append(None)
        counts.append(hits[0])
    return pd.DataFrame({"clean": clean, "hits": counts})
