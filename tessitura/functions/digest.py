"""Canonical digests: sorted keys, no spaces, raw UTF-8, SHA-256."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def json_text(text: Column) -> Column:
    """A JSON string literal as Python writes it with raw non-ASCII."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    for code in (*range(0x00, 0x08), 0x0B, *range(0x0E, 0x20)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(fields: Mapping[str, Column], optional: frozenset[str] = frozenset()) -> Column:
    """JSON of ready-made value texts with sorted keys; a null is ``null``, or absent for optional keys."""
    parts = []
    for key in sorted(fields):
        value = F.coalesce(fields[key], F.lit("null"))
        item = F.concat(F.lit(f'"{key}":'), value)
        parts.append(F.when(fields[key].isNotNull(), item) if key in optional else item)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def digest(fields: Mapping[str, Column], optional: frozenset[str] = frozenset()) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(fields, optional), 256)


def number_text(value: Column) -> Column:
    """A double as Python's JSON writes it: fewest digits that give the same number, an exponent below -4 or from 16 on."""
    shortest = F.coalesce(*[F.when(t.cast("double") == value, t) for t in (F.format_string(f"%.{k}e", value) for k in range(17))])
    finite = F.get(F.transform(F.transform(F.array(shortest), _parts), lambda p: F.concat(p["sign"], _placed(p["digits"], p["power"]))), F.lit(0))
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(finite)


def _parts(text: Column) -> Column:
    """Sign, digits and power of ten of a number in scientific form."""
    part = lambda k: F.regexp_extract(text, r"^(-?)([0-9])\.?([0-9]*)e([+-][0-9]+)$", k)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "(?<=.)0+$", "")
    return F.struct(part(1).alias("sign"), digits.alias("digits"), part(4).try_cast("int").alias("power"))


def _placed(digits: Column, power: Column) -> Column:
    """Digits with their point, and with an exponent where the power asks for one."""
    size = F.length(digits)
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(size <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - size), F.lit(".0")))
        .otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, size)))
    )
    tail = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
    shown = F.abs(power).cast("string")
    scaled = F.concat(F.left(digits, F.lit(1)), tail, F.when(power < 0, "e-").otherwise("e+"), F.lpad(shown, F.greatest(F.lit(2), F.length(shown)), F.lit("0")))
    return F.when(power.between(-4, 15), plain).otherwise(scaled)


def canonical_text(value: Column, kind: T.DataType, unset: Mapping[str, str] = {}, volatile: frozenset[str] = frozenset(), path: str = "") -> Column:
    """JSON of any nested column: keys of structs and maps sorted, no spaces, raw UTF-8; a null is ``null``.

    Paths name fields from the root with dots; ``*`` stands for the elements of an array and the values of a map. A field of
    ``unset`` is left out where its JSON is the one given there, a ``volatile`` field always. Maps need text keys. Kinds
    without a JSON form of their own (dates, binary, decimals) are refused while the plan is built.
    """
    below = lambda name: f"{path}.{name}" if path else name
    inner = lambda v, k, name: canonical_text(v, k, unset, volatile, below(name))
    if isinstance(kind, T.StructType):
        items = []
        for field in sorted((f for f in kind.fields if below(f.name) not in volatile), key=lambda f: f.name):
            text = inner(value[field.name], field.dataType, field.name)
            item = F.concat(F.lit(json.dumps(field.name, ensure_ascii=False) + ":"), text)
            items.append(F.when(text != unset[below(field.name)], item) if below(field.name) in unset else item)
        text = F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: inner(v, kind.elementType, "*")), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), inner(e["value"], kind.valueType, "*").alias("v")))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(json_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = json_text(value)
    elif isinstance(kind, (T.BooleanType, *WHOLE)):
        text = value.cast("string")
    elif isinstance(kind, T.DoubleType):
        text = number_text(value)
    else:
        raise TypeError(f"{path or 'value'}: no JSON form for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def line_feeds(text: Column) -> Column:
    """Text with every line end as a line feed."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def brief_key(text: Column) -> Column:
    """Digest of a brief that does not depend on its line ends."""
    return F.sha2(line_feeds(text), 256)
