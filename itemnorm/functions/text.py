"""Text keys, n-gram sets and word rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold_accents

# Every character Python's str.strip() removes; Spark's one-argument trim removes only U+0020.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Words whose final s is no plural.
NOT_PLURAL = ["series", "species", "glasses", "pliers", "scissors", "headquarters"]
# Words that say nothing in a category type.
CATEGORY_NOISE = r"(?U)\b(category|type|class)\b"
# Legal-form endings of a brand.
LEGAL_FORMS = r"inc\.?|ltd\.?|llc|corp\.?|co\.?|gmbh|ag|sa"
# Texts that stand for "no brand".
NO_BRAND = ["", "N/A", "NA", "NONE", "UNKNOWN", "-", "NULL"]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(SPACES))


def blank(c: Column | str) -> Column:
    """Null, nothing but white space, or the text ``nan`` in any case."""
    c = as_col(c)
    return c.isNull() | (strip(c) == "") | (F.lower(c) == "nan")


def present(c: Column | str) -> Column:
    """The stripped value, or null where it is blank after stripping."""
    s = strip(c)
    return F.when(~blank(s), s)


def first_present(*cols: Column | str) -> Column:
    """First non-blank value, stripped; the empty string if there is none."""
    return F.coalesce(*[present(c) for c in cols], F.lit(""))


# --- keys ---------------------------------------------------------------------------------------


def key_tokens(c: Column | str) -> Column:
    """Sorted distinct words of the accent-folded lower-case text; anything but letters, digits and
    the underscore separates words."""
    folded = let(F.lower(strip(as_col(c))), fold_accents)
    words = F.filter(F.split(folded, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def key_fingerprint(c: Column | str) -> Column:
    return F.coalesce(F.array_join(key_tokens(c), " "), F.lit(""))


def ngram_text(c: Column | str, unicode_ngrams: bool = False) -> Column:
    drop = r"[^\p{L}\p{N}]" if unicode_ngrams else "[^a-z0-9]"
    return F.regexp_replace(F.lower(as_col(c)), drop, "")


def ngrams(c: Column | str, n: int = 2, unicode_ngrams: bool = False) -> Column:
    """Distinct character n-grams. Text shorter than n is its own single gram; empty input gives an
    empty set. A capturing look-ahead yields the overlapping grams in one linear pass."""
    none = F.array().cast("array<string>")

    def grams(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
        return F.when(F.length(text) < n, F.array(text)).otherwise(found)

    return let(
        F.coalesce(as_col(c), F.lit("")),
        lambda s: F.when(s == "", none).otherwise(let(ngram_text(s, unicode_ngrams), grams)),
    )


def ngram_fingerprint(c: Column | str, n: int = 2, unicode_ngrams: bool = False) -> Column:
    """Sorted distinct n-grams written without a separator."""
    return F.array_join(F.array_sort(ngrams(c, n, unicode_ngrams)), "")


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def ngram_similarity(a: Column | str, b: Column | str, n: int = 2, unicode_ngrams: bool = False) -> Column:
    return set_similarity(ngrams(a, n, unicode_ngrams), ngrams(b, n, unicode_ngrams))


def character_bag(c: Column | str) -> Column:
    """The characters of the lower-case text numbered by occurrence, so that the overlap of two
    such sets is the overlap of the two character multisets."""
    return let(
        F.filter(F.split(F.lower(as_col(c)), ""), lambda ch: ch != ""),
        lambda chars: F.flatten(
            F.transform(
                F.array_distinct(chars),
                lambda ch: let(
                    F.size(F.filter(chars, lambda other: other == ch)),
                    lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(ch, k.cast("string"))),
                ),
            )
        ),
    )


# --- word rules ---------------------------------------------------------------------------------


def _without(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def singularize(c: Column | str) -> Column:
    """Singular of a phrase by its ending; applied to the whole text, so only its end changes."""
    c = as_col(c)
    size = F.length(c)
    stem = _without(c, 2)
    sibilant = stem.rlike(r"(s|x|z|ch|sh)\z")
    return (
        F.when((size <= 3) | c.isin(NOT_PLURAL), c)
        .when(c.endswith("ies") & (size > 4), F.concat(_without(c, 3), F.lit("y")))
        .when(c.endswith("ves") & (size > 4), F.concat(_without(c, 3), F.lit("f")))
        .when(c.endswith("es"), F.when(sibilant, stem).otherwise(_without(c, 1)))
        .when(c.endswith("s") & ~c.endswith("ss"), _without(c, 1))
        .otherwise(c)
    )


def singularize_review(c: Column | str) -> Column:
    """Variant used when reviewed decisions are applied: no exceptions and no minimum length."""
    c = as_col(c)
    size = F.length(c)
    return (
        F.when(c.endswith("ies") & (size > 4), F.concat(_without(c, 3), F.lit("y")))
        .when(c.endswith("ves"), F.concat(_without(c, 3), F.lit("f")))
        .when(c.endswith("ses") & (size > 4), _without(c, 2))
        .when(c.endswith("s") & ~c.endswith("ss"), _without(c, 1))
        .otherwise(c)
    )


def clean_category_type(c: Column | str) -> Column:
    bare = strip(F.regexp_replace(F.lower(as_col(c)), CATEGORY_NOISE, ""))
    return F.regexp_replace(bare, SPACE_RUN, " ")


def clean_brand_suffix(c: Column | str, compat: bool = False) -> Column:
    """Drop a legal-form ending. ``compat`` also cuts it inside a word (``msa`` becomes ``m``);
    the default asks for a word boundary before it."""
    gap = r"\s*" if compat else r"[\s,]+"
    return strip(F.regexp_replace(F.lower(as_col(c)), rf"(?Ui){gap}({LEGAL_FORMS})$", ""))


def clean_brand(c: Column | str) -> Column:
    """Upper-case, stripped, and empty when at most one character long."""
    b = F.upper(strip(F.coalesce(as_col(c), F.lit(""))))
    return F.when(F.length(b) > 1, b).otherwise(F.lit(""))


def valid_brand(c: Column | str) -> Column:
    """Brand of a parsed response: as :func:`clean_brand`, and empty for a "no brand" text."""
    b = clean_brand(c)
    return F.when(b.isin(NO_BRAND), F.lit("")).otherwise(b)
