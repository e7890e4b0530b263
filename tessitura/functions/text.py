"""Text normal forms and matching as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

ENYE = "ñ"
SPACES = r"[\s\x0b\x1c-\x1f]+"
EDGE_SPACES = r"^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$"


def _bare(char: str) -> str:
    """A character without its marks; ñ stays whole."""
    return char if char == ENYE else "".join(part for part in unicodedata.normalize("NFKD", char) if not unicodedata.combining(part))


class _BareForms(dict):
    """Bare forms by code point, each made when it is first met."""

    def __missing__(self, point: int) -> str:
        self[point] = found = _bare(chr(point))
        return found


_BARE = _BareForms()


def fold(text: str) -> str:
    """Case-folded text without accents, ñ kept apart from n, white space collapsed."""
    return " ".join(unicodedata.normalize("NFC", text).casefold().translate(_BARE).split())


def fold_mentions(text: str) -> str:
    """Case-folded text without accents; here ñ is an n and white space stays."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _series(function: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def _fold_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda items: [None if i is None else fold(i) for i in items], na_action="ignore")


def arrow_udf(function: Callable[[pd.Series], pd.Series], result: DataType, *columns: Column) -> Column:
    """Applies a batch function; built per call so that importing this module needs no session."""
    return F.pandas_udf(function, result)(*columns)


def is_ascii(text: Column) -> Column:
    """Only seven-bit characters."""
    return F.octet_length(text) == F.char_length(text)


def normal(text: Column) -> Column:
    """``fold`` as a column. Seven-bit text is folded inside the JVM; only the rest crosses to Python."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), SPACES, " "), "^ | $", "")
    return F.when(is_ascii(text), plain).otherwise(arrow_udf(_series(fold), StringType(), F.when(~is_ascii(text), text)))


def normal_each(texts: Column) -> Column:
    """``fold`` of every element of a short array."""
    return arrow_udf(_fold_each, ArrayType(StringType()), texts)


def normal_mentions(text: Column) -> Column:
    """``fold_mentions`` as a column."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(arrow_udf(_series(fold_mentions), StringType(), F.when(~is_ascii(text), text)))


def phrase_pattern(needle: str) -> str | None:
    """Pattern that finds a literal phrase in normal text between non-alphanumerics; underscores are separators."""
    parts = [p for p in re.split(r"[\s_]+", fold(needle)) if p]
    if not parts:
        return None
    return r"(?U)(?<![^\W_])" + r"[\s_]+".join(re.escape(p) for p in parts) + r"(?![^\W_])"


def phrase_pattern_column(normal_needle: Column) -> Column:
    """The same pattern from a column of normal text; null when it has no word."""
    parts = F.filter(F.split(normal_needle, r"[\s_]+"), lambda p: p != "")
    quoted = F.transform(parts, lambda p: F.regexp_replace(p, r"([\\.^$|?*+()\[\]{}&~#-])", r"\\$1"))
    return F.when(
        F.size(parts) > 0, F.concat(F.lit(r"(?U)(?<![^\W_])"), F.array_join(quoted, r"[\s_]+"), F.lit(r"(?![^\W_])"))
    )


def contains_phrase(normal_text: Column, needle: str) -> Column:
    """Whether normal text holds a literal phrase as whole words."""
    pattern = phrase_pattern(needle)
    return F.lit(False) if pattern is None else F.coalesce(normal_text.rlike(pattern), F.lit(False))


def has_mention(caption: Column, mention: Column) -> Column:
    """Whether the caption names the account, not as part of a longer name or an address."""
    quoted = F.regexp_replace(mention, r"([\\.^$|?*+()\[\]{}&~#-])", r"\\$1")
    return F.regexp_like(caption, F.concat(F.lit(r"(?iuU)(?<![\w@])"), quoted, F.lit(r"(?!\w)")))


def hashtag(tag: Column) -> Column:
    """Normal form: trimmed, without leading hashes, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(tag, EDGE_SPACES, ""), "^#+", ""))


def has_hashtag(caption: Column, tag: Column) -> Column:
    """Whether the caption carries the hashtag as a whole token."""
    quoted = F.regexp_replace(hashtag(tag), r"([\\.^$|?*+()\[\]{}&~#-])", r"\\$1")
    return F.regexp_like(caption, F.concat(F.lit(r"(?iuU)(?<![\w#])#"), quoted, F.lit(r"(?!\w)")))


def ordered_tokens(normal_text: Column) -> Column:
    """Words of normal text in order, without edge punctuation."""
    bare = F.transform(F.split(normal_text, r"[\s_]+"), lambda t: F.regexp_replace(t, r"(?U)^[^\w]+|[^\w]+$", ""))
    return F.filter(bare, lambda t: t != "")


def contains_any(folded: Column, needles: Sequence[str]) -> Column:
    """Plain substring test against any needle."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(folded, F.lit(n)) for n in needles]), F.lit(False))


def first_line(caption: Column) -> Column:
    """First line, trimmed; empty for an empty caption."""
    head = F.get(F.split(caption, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), F.lit(0))
    return F.regexp_replace(head, r"(?U)^\s+|\s+$", "")


def distinct_in_order(items: Column) -> Column:
    """Each element once, at its first place."""
    return F.array_distinct(items)


def caption_colour(raw: Column) -> Column:
    """``&HAABBGGRR`` from ``#RRGGBB``, ``#RRGGBBAA`` or itself; null when neither."""
    text = F.upper(F.regexp_replace(raw, EDGE_SPACES, ""))
    red, green, blue = (F.substring(text, p, 2) for p in (2, 4, 6))
    alpha = F.lpad(F.hex(F.lit(255) - F.conv(F.substring(text, 8, 2), 16, 10).cast("int")), 2, "0")
    return (
        F.when(text.rlike("^&H[0-9A-F]{8}$"), text)
        .when(text.rlike("^#[0-9A-F]{6}$"), F.concat(F.lit("&H00"), blue, green, red))
        .when(text.rlike("^#[0-9A-F]{8}$"), F.concat(F.lit("&H"), alpha, blue, green, red))
    )


# Fixed values.
RESERVED_NAMES = ("con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)])
