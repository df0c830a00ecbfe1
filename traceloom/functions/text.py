"""Text expressions: truthiness, whitespace, tokens, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, spelled out so Java and other regex engines agree on it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"
# A word border that is Unicode-aware on every Java version.
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# The four redaction rules, in the order they must run. A matcher tries every position,
# so each rule rules most of them out by the next characters before it looks for a border.
_EMAIL = rf"(?iu){_EDGE}[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{{2,}}{_EDGE}"
_BEARER = rf"(?iu)(?-iu:(?=[Bb]))(?<!{_WORD})Bearer{SPACE}+[A-Za-z0-9._~+/=-]{{12,}}"
_ASSIGNMENT = (
    rf"(?iu)(?-iu:(?=[AaBbPpSsTtſ][AaEeOoPpUu]))(?<!{_WORD})"
    rf"(api[_-]?key|token|secret|password|passwd|authorization|bearer)(?!{_WORD})"
    rf"{SPACE}*[:=]{SPACE}*['\"]?([^'\"\s\x0B\x1C-\x1F\x85\p{{Z}},;]+)"
)
_LONG_KEY = (
    rf"(?=[A-Za-z0-9_-]{{15}}){_EDGE}(?:sk-[A-Za-z0-9_-]{{12,}}"
    rf"|[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}\.[A-Za-z0-9_-]{{20,}}"
    rf"|[A-Za-z0-9_-]{{32,}}){_EDGE}"
)
SECRET_KEY_NAME = r"(?i)(api[_-]?key|token|secret|password|passwd|authorization)"
REDACTED_SECRET = "[REDACTED_SECRET]"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_null(value: Column | str) -> Column:
    """Null for an empty string, as a falsy string counts as absent."""
    return F.nullif(as_col(value), F.lit(""))


def number_or_null(value: Column | str) -> Column:
    """Null for zero, as a falsy number counts as absent."""
    return F.nullif(as_col(value), F.lit(0))


def array_or_null(value: Column | str) -> Column:
    column = as_col(value)
    return F.when(F.size(column) > 0, column)


def first_text(*values: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[text_or_null(value) for value in values])


def strip(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(value: Column | str) -> Column:
    """Runs of whitespace become one space; no space at either end."""
    return F.trim(F.regexp_replace(as_col(value), rf"{SPACE}+", " "))


def trimmed_or_null(value: Column | str) -> Column:
    return text_or_null(strip(value))


def slug(value: Column | str) -> Column:
    """Trimmed lower case with '-' and ' ' turned into '_'."""
    return F.translate(F.lower(strip(value)), "- ", "__")


def contains_any(value: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(word) for word in words])


def word_count(value: Column | str) -> Column:
    """Number of whitespace-separated words; zero for null or blank text."""
    flat = squeeze(F.coalesce(as_col(value), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def token_set(value: Column | str) -> Column:
    """Distinct lower-case alphanumeric tokens of three or more characters."""
    text = F.lower(F.coalesce(as_col(value), F.lit("")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1)))


def word_tokens(value: Column | str) -> Column:
    """Lower-case runs of letters, digits and apostrophes, in order."""
    text = F.lower(F.coalesce(as_col(value), F.lit("")))
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def normalized_words(value: Column | str) -> Column:
    return F.array_join(word_tokens(value), " ")


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap; two empty sets are equal, one empty set shares nothing."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def redact_text(value: Column | str) -> Column:
    text = as_col(value)
    text = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, _EMAIL, "[REDACTED_EMAIL]")).otherwise(text)
    text = F.regexp_replace(text, _BEARER, "Bearer [REDACTED_TOKEN]")
    text = F.regexp_replace(text, _ASSIGNMENT, f"$1={REDACTED_SECRET}")
    return F.regexp_replace(text, _LONG_KEY, "[REDACTED_KEY]")


def redact_map(value: Column | str) -> Column:
    """Redact a string map: whole value under a secret-like key, else by text rules."""
    return F.transform_values(
        as_col(value),
        lambda key, item: F.when(F.regexp_like(key, F.lit(SECRET_KEY_NAME)), F.lit(REDACTED_SECRET))
        .otherwise(redact_text(item)),
    )


def first_sentence(value: Column | str, limit: int) -> Column:
    """Squeezed text up to the first full stop followed by a space, cut to ``limit``."""
    flat = squeeze(F.coalesce(as_col(value), F.lit("")))
    stop = F.instr(flat, ". ")
    sentence = F.when(stop > 1, F.substr(flat, F.lit(1), stop)).otherwise(flat)
    return F.rtrim(F.substring(sentence, 1, limit))
