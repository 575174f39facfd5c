"""Rows to enrich, request texts, answers, evidence, resume."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_col, blank, let, strip, valid_brand
from .ordering import first_per_group

# Fields of an answer, with the default for a missing one.
RESPONSE_FIELDS = {
    "language": "",
    "translated_text": "",
    "brand": "",
    "concept_noun": "",
    "modifier": "",
    "category_type": "",
    "is_product_or_service": "Product",
    "service_object": "",
    "ai_insight": "",
    "confidence": "low",
    "mapped_category": "",
    "proposed_category": "",
    "matching_reason": "",
    "selected_category": "",
}
LOWER_FIELDS = {"language", "concept_noun", "category_type", "service_object", "confidence"}
# Fields of a level answer.
LEVEL_FIELDS = ["selected_category", "mapped_category", "proposed_category", "matching_reason"]
# Table columns that the fields of an answer fill.
RESPONSE_COLUMNS = {
    "language": "Language",
    "translated_text": "Translated_Description",
    "brand": "Brand_Raw",
    "concept_noun": "Concept_Noun_Raw",
    "modifier": "Modifier_Raw",
    "category_type": "Category_Type_Raw",
    "is_product_or_service": "Is_Product_or_Service",
    "service_object": "Service_Object",
    "ai_insight": "AI_Insight",
    "confidence": "AI_Confidence",
    "mapped_category": "Mapped_Category_Raw",
    "proposed_category": "Proposed_Category_Raw",
    "matching_reason": "Matching_Reason",
}
WEB_COLUMNS = {
    "concept_noun": "Web_Concept_Noun",
    "category_type": "Web_Category_Type",
    "confidence": "Web_Confidence",
    "mapped_category": "Web_Mapped_Category",
    "proposed_category": "Web_Proposed_Category",
    "matching_reason": "Web_Matching_Reason",
}

# What a request asks for, by field of the answer.
GUIDANCE = {
    "language": "language of the description, two letters",
    "translated_text": "the description in English",
    "brand": "maker's name as written, empty if none is written",
    "concept_noun": "the thing itself, singular, at most two words",
    "modifier": "what kind of it, words separated by commas",
    "category_type": "group of goods or works it belongs to",
    "is_product_or_service": "Product or Service",
    "service_object": "for a service: what the work is done on",
    "ai_insight": "one sentence for a buyer who does not know it",
    "confidence": "high, medium or low",
}

FIRST_REQUEST = (
    "A line from a purchase order has to be described and classified.\n{categories}\nFIELDS\n"
    + "\n".join(f"{name}: {text}" for name, text in GUIDANCE.items())
    + "\n{attributes}\nReply with this JSON object, filled in, and nothing else:\n{template}\n\n"
    "LINE\nDescription: {description}{context}{evidence}"
)

LEVEL_REQUEST = """Choose one category of level {level} for this item.

INPUT
Description: {description}{context}{evidence}

CATEGORIES OF LEVEL {level}
{categories}

ANSWER WITH JSON ONLY
{{"selected_category": "", "mapped_category": "", "proposed_category": "", "matching_reason": ""}}"""

CONTEXT_HEAD = "\n\nADDITIONAL CONTEXT\n"
EVIDENCE_HEAD = "\n\nSEARCH EVIDENCE\n"
CATEGORY_HEAD = "\nVALID CATEGORIES (use the exact text)\n"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Check before any job starts that the columns exist."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"input lacks the column(s) {', '.join(absent)}")
    return df


def rows_to_enrich(df: DataFrame, description: str = "Description", done: str = "Concept_Noun_Raw") -> DataFrame:
    """Rows with a description that have no noun yet."""
    d = F.col(description)
    missing = d.isNull() | (d == "") | (F.lower(d) == "nan")
    todo = df.filter(~missing)
    return todo.filter(blank(done)) if done in df.columns else todo


def resume_pending(items: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Items that have no finished row yet."""
    return items.join(finished.select(key), key, "left_anti")


def map_columns(df: DataFrame, selected: list[str], renames: dict[str, str], keep: list[str]) -> DataFrame:
    """The kept columns and the selected context columns under their new names."""
    return df.select(*keep, *selected).withColumnsRenamed({c: renames.get(c) or c for c in selected})


def context_text(columns: dict[str, Column | str]) -> Column:
    """``name: value`` lines of the non-blank columns."""
    lines = [F.when(~blank(c), F.concat(F.lit(f"{name}: "), as_col(c))) for name, c in columns.items()]
    return F.concat_ws("\n", *lines)


def json_template(attribute_keys: list[str], with_categories: bool) -> str:
    """Empty JSON answer with the fields asked for."""
    fields = [f'  "{f}": ""' for f in RESPONSE_FIELDS if f not in LEVEL_FIELDS]
    if attribute_keys:
        inner = ",\n".join(f'    "{k}": ""' for k in attribute_keys)
        fields.append(f'  "attributes": {{\n{inner}\n  }}')
    if with_categories:
        fields += [f'  "{f}": ""' for f in LEVEL_FIELDS if f != "selected_category"]
    return "{\n" + ",\n".join(fields) + "\n}"


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the literal pieces of a template with columns for its placeholders."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def request_text(
    description: Column | str,
    context: Column | None = None,
    evidence: Column | None = None,
    categories: Column | None = None,
    attributes: Column | None = None,
    template: Column | None = None,
    layout: str = FIRST_REQUEST,
    level: int | None = None,
) -> Column:
    """The request for one row. ``layout`` may be the caller's own text with any of the placeholders
    {description}, {context}, {evidence}, {categories}, {attributes}, {template} and {level}."""
    none = F.lit("")

    def block(head: str, c: Column | None) -> Column:
        if c is None:
            return none
        return F.when(F.coalesce(c, none) == "", none).otherwise(F.concat(F.lit(head), c))

    values = {
        "description": F.coalesce(as_col(description), none),
        "context": block(CONTEXT_HEAD, context),
        "evidence": block(EVIDENCE_HEAD, evidence),
        "categories": (block(CATEGORY_HEAD, categories) if layout is FIRST_REQUEST else F.coalesce(categories, none))
        if categories is not None
        else none,
        "attributes": F.coalesce(attributes, none) if attributes is not None else none,
        "template": template if template is not None else none,
        "level": F.lit("" if level is None else str(level)),
    }
    return _fill(layout, values)


def shared_parts(layout: str, parts: dict[str, str]) -> tuple[str, str, str]:
    """``(before, rest, after)`` of a layout: the text before its first and after its last placeholder that
    differs by row, filled with ``parts``, and the layout between, where ``parts`` are filled in too.

    All rows share ``before`` and ``after``; ``enrich`` puts them around a request in the task that sends it,
    so a long category list is never written into rows."""
    pieces = list(string.Formatter().parse(layout))
    own = [i for i, (_, name, _, _) in enumerate(pieces) if name is not None and name not in parts]
    if not own:
        return "".join(t + parts.get(n, "") if n else t for t, n, _, _ in pieces), "", ""
    filled = lambda i: pieces[i][0] + (parts[pieces[i][1]] if pieces[i][1] in parts else "")
    escape = lambda x: x.replace("{", "{{").replace("}", "}}")
    before = "".join(filled(i) for i in range(own[0])) + pieces[own[0]][0]
    rest = "".join(
        escape(filled(i) if i > own[0] else "") + ("{" + pieces[i][1] + "}" if i in own else "")
        for i in range(own[0], own[-1] + 1)
    )
    return before, rest, "".join(filled(i) for i in range(own[-1] + 1, len(pieces)))


def _json_object(content: Column) -> Column:
    """The text from the first to the last brace, code fences dropped."""
    bare = F.regexp_replace(content, r"^```(?:json)?\n?", "")
    bare = F.regexp_replace(bare, r"\n?```\s*$", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


# Strict reading of an answer: one object, double quotes, and text after it makes it invalid.
STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def _read_object(content: Column, schema: T.StructType) -> Column:
    """The object of an answer, null if it is no single valid JSON object.

    A parser that stops after the first object accepts what follows it; inside an array the rest must be valid
    too, and anything but exactly one object is refused."""
    whole = F.from_json(F.concat(F.lit("["), _json_object(content), F.lit("]")), T.ArrayType(schema), STRICT)
    return F.when(F.size(whole) == 1, whole[0])


def parse_response(content: Column | str) -> Column:
    """Struct of the answer's fields and a map of attributes; a broken answer gives the defaults. Attributes
    that are 0, false, null or empty in the JSON are blank."""
    schema = T.StructType(
        [T.StructField(f, T.StringType()) for f in RESPONSE_FIELDS]
        + [T.StructField("attributes", T.MapType(T.StringType(), T.VariantType()))]
    )
    falsy = ["", "0", "0.0", "-0", "-0.0", "false", "null", "[]", "{}"]

    def attribute(v: Column) -> Column:
        written = F.to_json(v)
        text = F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(written)
        return F.when(v.isNull() | written.isin(falsy), F.lit("")).otherwise(strip(text))

    def fields(r: Column) -> Column:
        cells = []
        for name, default in RESPONSE_FIELDS.items():
            v = strip(F.coalesce(r[name], F.lit(default)))
            if name == "brand":
                v = valid_brand(v)
            elif name in LOWER_FIELDS:
                v = F.lower(v)
            cells.append(v.alias(name))
        attributes = F.transform_values(
            F.coalesce(r["attributes"], F.create_map().cast("map<string,variant>")), lambda _, v: attribute(v)
        )
        return F.struct(*cells, attributes.alias("attributes"))

    return let(_read_object(as_col(content), schema), fields)


def parse_level_response(content: Column | str) -> Column:
    schema = T.StructType([T.StructField(f, T.StringType()) for f in LEVEL_FIELDS])
    return let(
        _read_object(as_col(content), schema),
        lambda r: F.struct(*[strip(F.coalesce(r[f], F.lit(""))).alias(f) for f in LEVEL_FIELDS]),
    )


def flatten_response(df: DataFrame, parsed: str, attributes: list[str] | None = None, web: bool = False) -> DataFrame:
    """Spread a parsed answer over its table columns, with one column per selected attribute."""
    names = WEB_COLUMNS if web else RESPONSE_COLUMNS
    out = df.withColumns({column: F.col(parsed)[field] for field, column in names.items()})
    return out.withColumns(select_attributes(f"{parsed}.attributes", attributes or []))


def attribute_key(name: str) -> str:
    return name.strip().replace(" ", "_").lower()


def select_attributes(attributes: str, selected: list[str]) -> dict[str, Column]:
    """Column per selected attribute name, by its key in the attribute map."""
    return {
        name: F.coalesce(F.try_element_at(F.col(attributes), F.lit(attribute_key(name))), F.lit("")) for name in selected
    }


def needs_evidence(confidence: Column | str, web_enabled: bool = True, level: str = "low") -> Column:
    """Whether a row gets a second request. ``level`` widens this to medium confidence or to all rows."""
    wanted = {"low": ["low"], "medium": ["low", "medium"], "all": ["low", "medium", "high"]}[level]
    return F.lit(web_enabled) & F.lower(F.coalesce(as_col(confidence), F.lit("low"))).isin(wanted)


def evidence_text(snippets: DataFrame, query: str = "query", k: int = 3) -> DataFrame:
    """``(query, evidence)``: the first k non-blank snippets of each query with their address."""
    top = first_per_group(snippets.filter(~blank("snippet")), [query], [F.col("rank")], k, "_rank")
    lines = F.array_sort(F.collect_list(F.struct("_rank", "snippet", "url")))
    line = lambda s: F.concat(s["snippet"], F.lit(" ("), F.coalesce(s["url"], F.lit("")), F.lit(")"))
    return top.groupBy(query).agg(F.array_join(F.transform(lines, line), "\n").alias("evidence"))


def attach_evidence(items: DataFrame, snippets: DataFrame, description: str, confidence: str, k: int = 3) -> DataFrame:
    """Low-confidence rows with the evidence found for their description."""
    wanted = items.filter(needs_evidence(confidence))
    texts = evidence_text(snippets.withColumnRenamed("query", "_query"), "_query", k)
    return wanted.join(texts, F.col(description) == F.col("_query"), "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(""))
    ).drop("_query")


def enrich(
    df: DataFrame,
    classify: Callable,
    request: str,
    columns: list[str],
    tasks: int | None = None,
    batch: int = 1,
    around: tuple[str, str] = ("", ""),
) -> DataFrame:
    """Send every request once: ``classify(pandas.Series of requests)`` gets ``batch`` of them at a time.

    It returns a Series of answers, or a DataFrame with ``content`` and, if it has them, ``error``,
    ``input_tokens`` and ``output_tokens`` per row. If a call raises, its rows carry the error and nothing is
    sent again, so calls of one request lose only that one. ``around`` is the text before and after every
    request that all rows share. ``tasks`` spreads the rows over that many tasks, which bounds the calls in
    flight. Adds ``content``, ``error`` and both token counts."""
    tokens = ["input_tokens", "output_tokens"]
    out = T.StructType(
        [df.schema[c] for c in columns]
        + [T.StructField(c, T.StringType()) for c in ("content", "error")]
        + [T.StructField(c, T.LongType()) for c in tokens]
    )
    before, after = around

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def call(rows) -> dict[str, list]:
            """Columns of the answers to some requests."""
            n = len(rows)
            made = {c: [None] * n for c in ("content", "error", *tokens)}
            try:
                got = classify(rows if joined is not None else before + rows + after)
            except Exception as failure:  # noqa: BLE001 - whatever the caller's function raises
                return made | {"error": [str(failure)] * n}
            found = {c: got[c] for c in made if c in got} if isinstance(got, pd.DataFrame) else {"content": got}
            if any(len(v) != n for v in found.values()):
                raise ValueError(f"{n} requests got another number of answers")
            return made | {c: v.tolist() for c, v in found.items()}

        for part in batches:
            try:
                joined = before + part[request] + after
            except Exception:  # noqa: BLE001 - then every call fails by itself
                joined = None
            rows = part[request] if joined is None else joined
            made: dict[str, list] = {c: [] for c in ("content", "error", *tokens)}
            for i in range(0, len(part), batch):
                for c, v in call(rows.iloc[i : i + batch]).items():
                    made[c] += v
            # One table a batch of rows: building one a call took most of the time.
            for c in tokens:
                made[c] = pd.array([None if pd.isna(x) else int(x) for x in made[c]], dtype="Int64")
            answers = pd.DataFrame(made, index=part.index).astype({"content": object, "error": object})
            yield pd.concat([part[columns], answers], axis=1)

    spread = df.repartition(tasks) if tasks else df
    return spread.select(*dict.fromkeys([*columns, request])).mapInPandas(run, out)


def failed_rows(enriched: DataFrame, key: str, description: str) -> DataFrame:
    """``(index, description, error)`` of the failed rows, with the first 100 characters of the text."""
    return enriched.filter(F.col("error").isNotNull()).select(
        F.col(key).alias("index"), F.substring(F.col(description), 1, 100).alias("description"), "error"
    )


def proposed_path(levels: Column | str, category_type: Column | str) -> Column:
    """Chosen levels and the category type with each word capitalised, joined by a bar."""
    words = F.array_join(F.filter(F.split(as_col(category_type), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""), " ")
    chosen = F.filter(as_col(levels), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.array_join(F.concat(chosen, F.array(F.initcap(words))), "|")
