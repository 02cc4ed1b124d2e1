"""Masks inside nested documents (GOV-2, GOV-4, PRJ-3).

A policy names paths such as ``card.number``, ``accounts[].iban`` or
``phones{}.value``: ``[]`` steps into the elements of an array, ``{}`` into the
values of a map.  The whole schema is rewritten as one projection: only the
named leaves change, structs, arrays and maps stay what they are (NULL ones
too), and nothing is exploded.

``form`` and ``form_last4`` keep a value's form: letters become ``x`` (``X``),
digits ``9``, and everything else (spaces, hyphens, dots, length) stays, so that
a masked card number, mobile, ssn or iban still looks like one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.masks import MASKS, apply_mask

_STEP = re.compile(r"\[\]|\{\}|`((?:[^`]|``)+)`|([^.\[\]{}`]+)")
ELEMENT, VALUE = "[]", "{}"


def _formed(text: Column, rest: str) -> Column:
    for letters, to in (("\\p{Lu}", "X"), ("\\p{L}", "x"), ("\\p{N}", "9")):
        # What is a mask's sign already stays it, so that the order doesn't matter.
        text = F.regexp_replace(text, f"(?!X){letters}{rest}" if to == "x" else letters + rest, to)
    return text


def form(c: Column) -> Column:
    """Every letter and digit hidden, all signs and the length kept."""
    return _formed(c.cast("string"), "")


def form_last4(c: Column) -> Column:
    """As ``form``, but the last four letters or digits are shown (none of a value
    that has four or fewer)."""
    text = c.cast("string")
    n = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))
    return F.when(n <= 4, form(c)).otherwise(_formed(text, "(?=(?:[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]){4})"))


FORM_MASKS = {"form": form, "form_last4": form_last4}


def parse_path(path: str) -> tuple[str, ...]:
    """Steps of a path; a name with dots or brackets goes between backticks."""
    steps, at = [], 0
    while at < len(path):
        if path[at] == "." and steps:
            at += 1
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path {path!r} at {at}")
        steps.append(m[0] if m[0] in (ELEMENT, VALUE) else (m[1].replace("``", "`") if m[1] else m[2].strip()))
        at = m.end()
    return tuple(steps)


def _mask(name: str, c: Column) -> Column:
    return FORM_MASKS[name](c) if name in FORM_MASKS else apply_mask(name, c)


def _rewritten(c: Column, t: T.DataType, rules: dict[tuple[str, ...], str], where: str) -> Column:
    """``c`` with the masks of ``rules`` (paths from here on) applied inside it."""
    if () in rules:
        if len(rules) > 1:
            raise ValueError(f"a mask on {where} and masks inside it")
        if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            raise ValueError(f"{where} is nested: name the values inside it")
        return _mask(rules[()], c)
    inner: dict[str, dict[tuple[str, ...], str]] = {}
    for path, name in rules.items():
        inner.setdefault(path[0], {})[path[1:]] = name
    if isinstance(t, T.StructType):
        unknown = set(inner) - set(t.names)
        if unknown:
            raise ValueError(f"{where} has no {sorted(unknown)}")
        fields = [(_rewritten(c.getField(f.name), f.dataType, inner[f.name], f"{where}.{f.name}") if f.name in inner
                   else c.getField(f.name)).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    step = ELEMENT if isinstance(t, T.ArrayType) else VALUE if isinstance(t, T.MapType) else None
    if set(inner) != {step}:
        raise ValueError(f"{where} is {t.simpleString()}: its paths go on with {step or 'nothing'}")
    if step == ELEMENT:
        return F.transform(c, lambda x: _rewritten(x, t.elementType, inner[ELEMENT], where + ELEMENT))
    return F.transform_values(c, lambda _, v: _rewritten(v, t.valueType, inner[VALUE], where + VALUE))


def mask_paths(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """``df`` with each named path masked in place, as one projection.

    Unknown masks, unknown paths and masks on whole nested values are errors.
    NULL values, structs, arrays, elements and empty arrays stay as they are."""
    unknown = set(rules.values()) - set(MASKS) - set(FORM_MASKS)
    if unknown:
        raise ValueError(f"unknown masks {sorted(unknown)}")
    by_column: dict[str, dict[tuple[str, ...], str]] = {}
    for path, name in rules.items():
        column, *rest = parse_path(path)
        by_column.setdefault(column, {})[tuple(rest)] = name
    missing = set(by_column) - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return df.select(*[_rewritten(quoted(f.name), f.dataType, by_column[f.name], f.name).alias(f.name) if f.name in by_column else quoted(f.name)
                       for f in df.schema.fields])


def masked_documents(df: DataFrame, rules: Mapping[str, str], principal: str, unmasked_readers: tuple[str, ...] = ("owner",)) -> DataFrame:
    """Raw documents for those who may see them, masked ones for everyone else."""
    return df if principal in unmasked_readers else mask_paths(df, rules)
