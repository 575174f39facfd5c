"""Attribute value rules: material, thread, colour and size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, let, strip

# Material names by abbreviation.
MATERIALS = {
    "ss": "stainless steel",
    "st steel": "stainless steel",
    "st. steel": "stainless steel",
    "stainless": "stainless steel",
    "cs": "carbon steel",
    "ms": "mild steel",
    "al": "aluminum",
    "alu": "aluminum",
    "cu": "copper",
    "br": "brass",
    "bronze": "bronze",
    "pvc": "pvc",
    "pp": "polypropylene",
    "pe": "polyethylene",
    "ptfe": "ptfe",
    "teflon": "ptfe",
    "rubber": "rubber",
    "steel": "steel",
}
# Thread names.
THREADS = {
    "npt": "NPT",
    "bsp": "BSP",
    "bspt": "BSPT",
    "bspp": "BSPP",
    "metric": "Metric",
    "unf": "UNF",
    "unc": "UNC",
}
# Unit words and their symbols.
UNITS = {"inch|inches": "in", "millimeter|millimeters": "mm", "centimeter|centimeters": "cm"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _unless_missing(c: Column, value: Column) -> Column:
    missing = c.isNull() | (c == "") | (F.lower(c) == "nan")
    return F.when(missing, F.lit("")).otherwise(value)


def normalize_material(c: Column | str) -> Column:
    c = as_col(c)
    key = strip(F.lower(c))
    return _unless_missing(c, F.coalesce(_lookup(MATERIALS, key), key))


def normalize_thread(c: Column | str) -> Column:
    c = as_col(c)
    return _unless_missing(c, F.coalesce(_lookup(THREADS, strip(F.lower(c))), F.upper(c)))


def normalize_color(c: Column | str) -> Column:
    c = as_col(c)
    return _unless_missing(c, strip(F.lower(c)))


def normalize_size(c: Column | str) -> Column:
    """A leading fraction becomes a decimal with its unit (inches if none); otherwise unit words
    become symbols. A zero denominator leaves the text as it is."""
    c = as_col(c)

    def rule(s: Column) -> Column:
        fraction = r"(?U)^(\d+)/(\d+)\s*(\w+)?"
        top, bottom, unit = (F.regexp_extract(s, fraction, i) for i in (1, 2, 3))
        value = F.try_divide(
            F.when(top != "", top).try_cast("double"), F.when(bottom != "", bottom).try_cast("double")
        )
        decimal = F.concat(value.cast("string"), F.when(unit == "", F.lit("in")).otherwise(unit))
        words = s
        for names, symbol in UNITS.items():
            words = F.regexp_replace(words, rf"(?U)\s*({names})\b", symbol)
        return F.coalesce(decimal, words)

    return _unless_missing(c, let(strip(F.lower(c)), rule))
