"""Accent and compatibility folding as native column expressions.

Spark has no NFKD function, so the decomposition tables are generated from
``unicodedata`` once per process and enter the plan as literals:

* code points that decompose to nothing (combining marks) or to one character go into ``translate``;
* code points that expand to several characters are looked up in a map, and only for the rare
  strings that hold one;
* Hangul syllables follow the arithmetic rule of the Unicode standard instead of a table.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Unicode standard (Hangul syllable composition).
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEAD_BASE, VOWEL_BASE, TAIL_BASE = 0x1100, 0x1161, 0x11A7
VOWELS, TAILS = 21, 28


def _decomposed(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """(single-character sources, their targets, one-to-many map); deletions end the source string."""
    kept, targets, dropped, expanded = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or HANGUL_FIRST <= cp <= HANGUL_LAST:
            continue
        ch = chr(cp)
        out = _decomposed(ch)
        if out == ch:
            continue
        if not out:
            dropped.append(ch)
        elif len(out) == 1:
            kept.append(ch)
            targets.append(out)
        else:
            expanded[ch] = out
    return "".join(kept + dropped), "".join(targets), expanded


def _ranges(chars: list[str]) -> str:
    """A regex character class body covering exactly these characters."""
    points = sorted(map(ord, chars))
    spans, start = [], None
    for i, p in enumerate(points):
        if start is None:
            start = p
        if i + 1 == len(points) or points[i + 1] != p + 1:
            spans.append(f"\\x{{{start:x}}}-\\x{{{p:x}}}")
            start = None
    return "".join(spans)


@lru_cache(maxsize=1)
def _expanding_pattern() -> str:
    return f"[{_ranges(list(_tables()[2]))}\\x{{{HANGUL_FIRST:x}}}-\\x{{{HANGUL_LAST:x}}}]"


LATIN_END = 0x250


@lru_cache(maxsize=1)
def _worth_checking_pattern() -> str:
    """A short class that covers the long one: few ranges decide most Western texts quickly."""
    latin = [c for c in _tables()[2] if ord(c) < LATIN_END]
    return f"[{_ranges(latin)}\\x{{{LATIN_END:x}}}-\\x{{{sys.maxunicode:x}}}]"


def _char(code: Column) -> Column:
    """The character of a code point in the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _jamo(ch: Column) -> Column:
    index = F.ascii(ch) - HANGUL_FIRST
    tail = index % TAILS
    lead = F.floor(index / (VOWELS * TAILS)).cast("int")
    vowel = F.floor((index % (VOWELS * TAILS)) / TAILS).cast("int")
    return F.concat(
        _char(lead + LEAD_BASE),
        _char(vowel + VOWEL_BASE),
        F.when(tail > 0, _char(tail + TAIL_BASE)).otherwise(F.lit("")),
    )


def fold_accents(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks; plain ASCII text passes straight through."""
    source, target, expanded = _tables()
    table = F.from_json(F.lit(json.dumps(expanded)), "map<string,string>")
    spread = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(
                F.ascii(ch).between(HANGUL_FIRST, HANGUL_LAST), _jamo(ch)
            ).otherwise(F.coalesce(F.try_element_at(table, ch), ch)),
        ),
        "",
    )
    expands = text.rlike(_worth_checking_pattern()) & text.rlike(_expanding_pattern())
    widened = F.when(expands, spread).otherwise(text)
    return F.when(
        F.octet_length(text) > F.length(text), F.translate(widened, source, target)
    ).otherwise(text)
