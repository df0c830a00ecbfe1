"""Typed reads from open JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions import text as tx


def parse(value: Column | str) -> Column:
    return F.try_parse_json(tx.as_col(value))


def get(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def kind_of(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def is_object(variant: Column) -> Column:
    return kind_of(variant).startswith("OBJECT")


def is_array(variant: Column) -> Column:
    return kind_of(variant).startswith("ARRAY")


def has(variant: Column, path: str) -> Column:
    """True when the path holds a value other than null."""
    part = get(variant, path, "variant")
    return part.isNotNull() & (kind_of(part) != "VOID")


def items(variant: Column, path: str) -> Column:
    """Elements of an array as variants; null when the path is not an array."""
    return get(variant, path, "array<variant>")


def strings(variant: Column, path: str) -> Column:
    """Elements of an array as strings; an absent array is empty."""
    found = F.transform(items(variant, path), lambda x: x.cast("string"))
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_or(value: Column | str, default: str) -> Column:
    """Parsed JSON, or the default for null and broken text."""
    return F.coalesce(parse(value), F.parse_json(F.lit(default)))


# The two halves of the key and text rules in Python syntax, for JSON of unknown shape only.
_PY_RULES = (
    (regex.compile(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"), "[REDACTED_EMAIL]"),
    (regex.compile(r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}"), "Bearer [REDACTED_TOKEN]"),
    (
        regex.compile(
            r"(?i)\b(api[_-]?key|token|secret|password|passwd|authorization|bearer)\b"
            r"\s*[:=]\s*['\"]?([^'\"\s,;]+)"
        ),
        r"\1=[REDACTED_SECRET]",
    ),
    (
        regex.compile(
            r"\b(?:sk-[A-Za-z0-9_-]{12,}|[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}"
            r"\.[A-Za-z0-9_-]{20,}|[A-Za-z0-9_-]{32,})\b"
        ),
        "[REDACTED_KEY]",
    ),
)
_PY_SECRET_KEY = regex.compile(tx.SECRET_KEY_NAME)
_PY_KEY_NAMES = ("key", "token", "secret", "password", "passwd", "authorization", "bearer")
# A run that only a text with a long key can hold.
_PY_RUN = re.compile(r"[A-Za-z0-9_-]{20}|sk-")


def _folded(text: str) -> str:
    """Lower case, with the letters that a rule takes for i, k or s although their lower case is another."""
    text = text.lower()
    if not text.isascii():
        for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("i\u0307", "i"), ("\u017f", "s")):
            text = text.replace(letter, plain)
    return text


def _redacted(text: str) -> str:
    """The rules, each only where the text holds what its matches cannot do without."""
    def run(place: int) -> str:
        rule, replacement = _PY_RULES[place]
        return rule.sub(replacement, text)

    if "@" in text:
        text = run(0)
    folded = _folded(text)
    if "bearer" in folded:
        text = run(1)
    if any(name in folded for name in _PY_KEY_NAMES):
        text = run(2)
    if _PY_RUN.search(text):
        text = run(3)
    return text


def _clean(node):
    if isinstance(node, str):
        return _redacted(node)
    if isinstance(node, list):
        return [_clean(item) for item in node]
    if isinstance(node, dict):
        return {
            key: tx.REDACTED_SECRET if _PY_SECRET_KEY.search(key) else _clean(item)
            for key, item in node.items()
        }
    return node


@F.pandas_udf(T.StringType())
def redact_json(values: pd.Series) -> pd.Series:
    """Redact JSON text of any shape; Arrow batches, since no built-in rebuilds open JSON."""
    return values.map(
        lambda text: None if text is None
        else json.dumps(_clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    )
