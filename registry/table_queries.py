"""Sources, projections, joins, enrichment, taxonomy, reports and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemnorm.functions.text import clean_brand, strip
from itemnorm.operators import cost as K
from itemnorm.operators import decide as Z
from itemnorm.operators import enrich as E
from itemnorm.operators import report as P
from itemnorm.operators import taxonomy as Y
from itemnorm.operators.clustering import normalize_column
from itemnorm.operators.ordering import add_index, sample_rows
from itemnorm.sources import catalog as G
from itemnorm.plans.levels import level_loop
from itemnorm.plans.votes import VoteState
from itemnorm.plans.waves import ask_in_waves
from itemnorm.operators.sketches import merge_sketches, profile_of, profile_sketches
from itemnorm.session import work_folder
from itemnorm.sources.quarantine import read_quarantined
from itemnorm.sources.tables import attribute_sets, taxonomy
from itemnorm.streaming.streams import compact, finished_rows, item_stream, process_stream

from . import duck as D
from .core import register
from .duck import sequence_sql

# --- sources ------------------------------------------------------------------------------------


@register("scan_items", "select p_partkey as Index, p_name as Description, p_brand as Brand, p_retailprice as Value from part")
def _(t):
    named = t("part").withColumnsRenamed(
        {"p_partkey": "Index", "p_name": "Description", "p_brand": "Brand", "p_retailprice": "Value"}
    )
    return E.require_columns(named, "Description").select("Index", "Description", "Brand", "Value")


@register(
    "taxonomy_load",
    D.query(["taxonomy"], None, "select trim(level1) || '|' || trim(level2) as category from taxonomy where lower(level1 || '|' || level2) not like '%nan%'"),
)
def _(t):
    return taxonomy(t("taxonomy"))


_DEFAULT = ", ".join(G.DEFAULT_SET)


@register(
    "attribute_sets",
    D.query(
        ["items", "set_table", "set_mapping"],
        {
            "slots": "select Attribute_Set, unnest([1,2,3,4,5,6,7,8]) as i, unnest([Att1,Att2,Att3,Att4,Att5,Att6,Att7,Att8]) as a from set_table",
            "lists": "select Attribute_Set, string_agg(trim(a), ', ' order by i) as attributes from slots where a is not null and trim(a) <> '' and lower(a) <> 'nan' group by 1",
            "named": "select trim(Level1_Category) as l1, Attribute_Set, attributes from set_mapping join lists using (Attribute_Set)",
        },
        f"""select idx, coalesce(Attribute_Set, 'Default_Set') as attribute_set, coalesce(attributes, '{_DEFAULT}') as attributes
        from items left join named on string_split(final_category, '|')[1] = l1""",
    ),
)
def _(t):
    joined = Y.attach_attribute_set(t("items"), "final_category", t("set_mapping"), attribute_sets(t("set_table")))
    return joined.select("idx", "attribute_set", F.array_join("attributes", ", ").alias("attributes"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CATALOG = "select * from (values {}) as c(ordinal, grp, name, key, description, example1, example2)".format(
    ", ".join("(" + str(r[0]) + ", " + ", ".join(_q(x) for x in r[1:]) + ")" for r in G.catalog_rows())
)


@register(
    "attribute_catalog",
    D.query(
        ["responses"],
        {
            "catalog": _CATALOG,
            "j": r"select regexp_extract(content, '\{.*\}', 0, 's') as j from responses",
            "found": """select 'material' as key, json_extract_string(j, '$.attributes.material') as v from j where j <> ''
              union all select 'size_dimension', json_extract_string(j, '$.attributes.size_dimension') from j where j <> ''""",
            "n": "select key, count(*) as items from found where v <> '' group by key",
        },
        'select grp as "group", name, key, coalesce(items, 0) as items from catalog left join n using (key)',
    ),
)
def _(t):
    """The catalog with the number of answers that state each attribute."""
    stated = t("responses").select(F.explode(E.parse_response("content")["attributes"]).alias("key", "value"))
    counts = stated.filter("value <> ''").groupBy("key").agg(F.count("*").alias("items"))
    catalog = G.attribute_catalog(counts.sparkSession)
    return catalog.join(counts, "key", "left").select(
        "group", "name", "key", F.coalesce("items", F.lit(0).cast("long")).alias("items")
    )


_PICKED = {
    "catalog": _CATALOG,
    "picks": "select distinct p_brand as item_set, p_size % 47 as ordinal from part",
    "chosen": "select item_set, c.* from picks join catalog c using (ordinal)",
}


def _picks(t):
    """Every brand selects the attributes that its sizes point to."""
    part = t("part")
    catalog = G.attribute_catalog(part.sparkSession)
    picks = part.select(F.col("p_brand").alias("item_set"), (F.col("p_size") % 47).alias("ordinal")).distinct()
    return catalog, picks.join(catalog.select("ordinal", "name"), "ordinal").select("item_set", "name")


@register(
    "attribute_section",
    D.query(
        [],
        {
            **_PICKED,
            "lines": """select item_set, ordinal, '- ' || key || ': ' || description || ' (e.g. "' || example1 || '", "' || example2 || '")' as line from chosen""",
        },
        f"select item_set, {_q(G.SECTION_HEAD)} || chr(10) || string_agg(line, chr(10) order by ordinal) as section from lines group by item_set",
    ),
)
def _(t):
    catalog, picks = _picks(t)
    return G.attribute_section(picks, catalog, "item_set")


_PRESET = ", ".join(f"({_q(n)})" for n in G.PRESETS["Full_MRO"])
_SERVICES = ", ".join(_q(n) for n in G.GROUPS["Services"])


@register(
    "attribute_selection",
    D.query(
        [],
        {
            **_PICKED,
            "cleaned": "select distinct replace(trim(p_name), ' ', '_') as name from part where trim(p_name) <> ''",
            "custom": "select name from cleaned where name not in (select name from catalog)",
            "joined": f"select distinct name from chosen union select * from (values {_PRESET}) as p(name) union select name from custom",
        },
        f"select name, lower(name) as key from joined where name not in ({_SERVICES})",
    ),
)
def _(t):
    """Picked attributes, a preset and new custom names (from item names), without one group."""
    catalog, picks = _picks(t)
    spark = catalog.sparkSession
    preset = spark.createDataFrame([(n,) for n in G.PRESETS["Full_MRO"]], "name string")
    custom = G.new_custom_attributes(t("part").select(F.col("p_name").alias("name")), catalog)
    selected = G.add_selection(G.add_selection(picks, preset), custom)
    kept = G.drop_selection(selected, G.group_attributes(catalog, "Services"))
    return kept.select("name", F.lower("name").alias("key"))


def _enriched(t):
    def strict(texts):
        """Stands for the remote call: answers in JSON and refuses texts with a hyphen."""

        def answer(text):
            if "-" in text:
                raise ValueError("unreadable text")
            return '{"concept_noun": "' + text.strip().split(" ")[-1] + '", "confidence": "high"}'

        return texts.map(answer)

    items = t("items")
    # a small file is one task, however many its calls are
    return E.enrich(items, strict, "description", ["idx", "description"], items.sparkSession.sparkContext.defaultParallelism)


@register(
    "failed_rows",
    D.query(["items"], None, "select idx as \"index\", substr(description, 1, 100) as description, 'unreadable text' as error from items where description like '%-%'"),
)
def _(t):
    return E.failed_rows(_enriched(t), "idx", "description")


@register(
    "run_stats",
    D.query(
        ["items"],
        {"src": "select idx, modifier_raw from items", **D.normalizer("m", "src", "modifier_raw", "idx", "generic")},
        """select (select count(*) from items) as total_rows, (select count(*) from items where description like '%-%') as failed_rows,
          (select count(distinct canonical) from m_map) as unique_modifiers,
          (select greatest(0, count(distinct lower(value)) - count(distinct canonical)) from m_map) as modifiers_clustered""",
        recursive=True,
    ),
)
def _(t):
    summary = normalize_column(t("items"), "modifier_raw", "idx", "generic").summary()
    return P.run_stats(_enriched(t), {"modifiers": summary})


# --- projections and filters --------------------------------------------------------------------


@register("add_index", D.query(["items"], None, "select row_number() over (order by description, idx) as \"Index\", idx, description from items"))
def _(t):
    return add_index(t("items").select("idx", "description"), ["description", "idx"])


@register("sample_rows", D.query(["items"], None, "select idx, description from items order by idx limit 20"))
def _(t):
    return sample_rows(t("items").select("idx", "description"), ["idx"], 20)


@register(
    "rows_to_enrich",
    D.query(["items"], None, f"select idx, description from items where description <> '' and lower(description) <> 'nan' and {D.blank('concept_noun_raw')}"),
)
def _(t):
    return E.rows_to_enrich(t("items"), "description", "concept_noun_raw").select("idx", "description")


@register("resume_pending", D.query(["items", "finished"], None, "select idx, description from items where idx not in (select idx from finished)"))
def _(t):
    return E.resume_pending(t("items").select("idx", "description"), t("finished"), "idx")


@register("map_columns", D.query(["items"], None, "select idx, description, brand_raw as Supplier, value as value, p_size as Pack_Size from items"))
def _(t):
    return E.map_columns(
        t("items"), ["brand_raw", "value", "p_size"], {"brand_raw": "Supplier", "value": "", "p_size": "Pack_Size"}, ["idx", "description"]
    )


_CONTEXT = {"Supplier": "brand_raw", "Kind": "kind", "Noun": "concept_noun_raw"}
_CONTEXT_SQL = "concat_ws(chr(10), " + ", ".join(
    f"case when {D.blank(c)} then null else '{n}: ' || {c} end" for n, c in _CONTEXT.items()
) + ")"


@register("context_text", D.query(["items"], None, f"select idx, {_CONTEXT_SQL} as context from items"))
def _(t):
    return t("items").select("idx", E.context_text(_CONTEXT).alias("context"))


@register(
    "merge_sources",
    D.query(
        ["items"],
        None,
        f"""select idx, coalesce({D.present('web_concept_noun')}, {D.present('concept_noun_raw')}, '') as noun,
          coalesce({D.present('category_type_raw')}, '') as category_type, coalesce({D.present('modifier_raw')}, '') as modifier from items""",
    ),
)
def _(t):
    out = t("items")
    for output, web, ai in (
        ("noun", "web_concept_noun", "concept_noun_raw"),
        ("category_type", "web_category_type", "category_type_raw"),
        ("modifier", "web_modifier", "modifier_raw"),
    ):
        out = Z.merge_sources(out, output, web, ai)
    return out.select("idx", "noun", "category_type", "modifier")


@register(
    "brand_clean",
    D.query(["items"], None, "select idx, case when length(trim(brand_raw)) > 1 then upper(trim(brand_raw)) else '' end as brand, case when length(modifier_raw) > 1 then upper(trim(modifier_raw)) else '' end as second_brand from items"),
)
def _(t):
    return t("items").select("idx", clean_brand("brand_raw").alias("brand"), clean_brand("modifier_raw").alias("second_brand"))


_PROPOSED = "case when ai_proposed <> '' then ai_proposed when web_proposed <> '' then web_proposed else 'UNCATEGORIZED' end"
_RULE = "case when web_confidence = 'high' and web_mapped <> '' then 1 when ai_confidence in ('high','medium') and ai_mapped <> '' then 2 when web_mapped <> '' then 3 else 4 end"


@register(
    "final_category",
    D.query(
        ["items"],
        {"r": f"select *, {_RULE} as rule, {_PROPOSED} as p from items"},
        """select idx, case rule when 1 then web_mapped when 2 then ai_mapped when 3 then web_mapped else '' end as category,
          case when rule = 4 then p else '' end as proposed,
          case rule when 1 then 'Web' when 2 then 'AI' when 3 then 'Web' else case when p = 'UNCATEGORIZED' then 'No Match' else 'Proposed' end end as method from r""",
    ),
)
def _(t):
    decision = Z.final_category("ai_confidence", "ai_mapped", "ai_proposed", "web_confidence", "web_mapped", "web_proposed")
    return t("items").select("idx", decision.alias("d")).select("idx", "d.*")


_JSON = {
    "j": r"select idx, regexp_extract(content, '\{.*\}', 0, 's') as j from responses",
    "p": "select idx, case when j = '' then null else json(j) end as j from j",
}
_FIELD = lambda f, default="": f"trim(coalesce(json_extract_string(j, '$.{f}'), '{default}'))"
_BRAND = f"upper({_FIELD('brand')})"
_BRAND_SQL = f"case when length({_BRAND}) <= 1 or {_BRAND} in ('N/A','NA','NONE','UNKNOWN','-','NULL') then '' else {_BRAND} end"


@register(
    "parse_responses",
    D.query(
        ["responses"],
        _JSON,
        f"""select idx, lower({_FIELD('language')}) as language, {_BRAND_SQL} as brand, lower({_FIELD('concept_noun')}) as concept_noun,
          {_FIELD('modifier')} as modifier, {_FIELD('is_product_or_service', 'Product')} as is_product_or_service,
          lower({_FIELD('confidence', 'low')}) as confidence, {_FIELD('mapped_category')} as mapped_category,
          {_FIELD('attributes.material')} as material, {_FIELD('attributes.size_dimension')} as size_dimension from p""",
    ),
)
def _(t):
    parsed = t("responses").select("idx", E.parse_response("content").alias("r"))
    fields = ["language", "brand", "concept_noun", "modifier", "is_product_or_service", "confidence", "mapped_category"]
    attributes = E.select_attributes("r.attributes", ["material", "size_dimension"])
    return parsed.select("idx", *[f"r.{f}" for f in fields], *[c.alias(n) for n, c in attributes.items()])


@register(
    "flatten_response",
    D.query(
        ["responses"],
        _JSON,
        f"""select idx, lower({_FIELD('language')}) as "Language", {_BRAND_SQL} as "Brand_Raw", lower({_FIELD('concept_noun')}) as "Concept_Noun_Raw",
          {_FIELD('is_product_or_service', 'Product')} as "Is_Product_or_Service", lower({_FIELD('confidence', 'low')}) as "AI_Confidence",
          {_FIELD('mapped_category')} as "Mapped_Category_Raw", {_FIELD('proposed_category')} as "Proposed_Category_Raw",
          {_FIELD('attributes.material')} as "Material" from p""",
    ),
)
def _(t):
    parsed = t("responses").withColumn("r", E.parse_response("content"))
    return E.flatten_response(parsed, "r", ["Material"]).select(
        "idx", "Language", "Brand_Raw", "Concept_Noun_Raw", "Is_Product_or_Service", "AI_Confidence",
        "Mapped_Category_Raw", "Proposed_Category_Raw", "Material",
    )


@register(
    "select_attributes",
    D.query(
        ["responses"],
        _JSON,
        f"""select idx, {_FIELD('attributes.material')} as "Material", {_FIELD('attributes.size_dimension')} as "Size Dimension", '' as "Voltage" from p""",
    ),
)
def _(t):
    parsed = t("responses").select("idx", E.parse_response("content").alias("r"))
    return parsed.select("idx", *[c.alias(n) for n, c in E.select_attributes("r.attributes", ["Material", "Size Dimension", "Voltage"]).items()])


@register(
    "parse_level_responses",
    D.query(
        ["level_responses"],
        {"j": r"select idx, regexp_extract(content, '\{.*\}', 0, 's') as j from level_responses", "p": "select idx, case when json_valid(j) then json(j) end as j from j"},
        f"select idx, {', '.join(f'{_FIELD(f)} as {f}' for f in E.LEVEL_FIELDS)} from p",
    ),
)
def _(t):
    return t("level_responses").select("idx", E.parse_level_response("content").alias("r")).select("idx", "r.*")


@register("needs_evidence", D.query(["items"], None, "select idx, ai_confidence = 'low' as wanted, ai_confidence in ('low','medium') as wanted_wider from items"))
def _(t):
    return t("items").select(
        "idx", E.needs_evidence("ai_confidence").alias("wanted"), E.needs_evidence("ai_confidence", level="medium").alias("wanted_wider")
    )


_SCORED = f"""select *, greatest(0, least(100, case ai_confidence when 'high' then 85 when 'medium' then 65 else 45 end
  + case when {D.blank('brand_raw')} then 0 else 5 end + case when {D.blank('ai_mapped')} then 0 else 5 end
  + case when {D.blank('concept_noun_raw')} then -15 else 5 end + case when {D.blank('category_type_raw')} then 0 else 3 end
  - case when length(description) < 10 then 10 else 0 end)) as score from items"""


def _scored(t):
    score = Z.confidence_score("ai_confidence", "brand_raw", "ai_mapped", "concept_noun_raw", "category_type_raw", "description")
    return t("items").withColumn("Confidence_Score", score).withColumn("Needs_Review", Z.needs_review("Confidence_Score"))


@register(
    "confidence_score",
    D.query(["items"], {"s": _SCORED}, 'select idx, score as "Confidence_Score", case when score < 70 then 1 else 0 end as "Needs_Review" from s'),
)
def _(t):
    return _scored(t).select("idx", "Confidence_Score", "Needs_Review")


_RESULT = {
    "s": _SCORED,
    "result": """select idx, description as Description, ai_confidence as AI_Confidence, kind as Is_Product_or_Service, category_type_raw as Category_Type,
      case when score < 70 then 1 else 0 end as Needs_Review, lower(trim(description)) as Normalized_Description, nullif(brand_raw, '') as Brand,
      nullif(concept_noun_raw, 'nan') as Concept_Noun from s""",
}


def _result(t):
    return _scored(t).select(
        "idx",
        F.col("description").alias("Description"),
        F.col("ai_confidence").alias("AI_Confidence"),
        F.col("kind").alias("Is_Product_or_Service"),
        F.col("category_type_raw").alias("Category_Type"),
        "Needs_Review",
        F.lower(strip("description")).alias("Normalized_Description"),
        F.nullif("brand_raw", F.lit("")).alias("Brand"),
        F.nullif("concept_noun_raw", F.lit("nan")).alias("Concept_Noun"),
    )


@register(
    "filter_results",
    D.query(
        ["items"],
        _RESULT,
        """select idx, Description from result where AI_Confidence in ('low','medium') and Is_Product_or_Service = 'Product' and Needs_Review = 1
          and Category_Type in ('economy','small type','promo category') and regexp_matches(Description, 'G(ear|izmo)', 'i')""",
    ),
)
def _(t):
    kept = P.filter_results(
        _result(t), ["low", "medium"], ["Product"], True, ["economy", "small type", "promo category"], "G(ear|izmo)"
    )
    return kept.select("idx", "Description")


@register(
    "select_output",
    D.query(
        ["checkpoint"],
        None,
        """select Index, Description, Translated_Description, case when length(trim(Brand_Raw)) > 1 then upper(trim(Brand_Raw)) else '' end as Brand,
          Is_Product_or_Service, AI_Confidence, Final_Category as Category,
          case when Final_Category = '' then Final_Proposed_Category else '' end as Proposed_Category, Classification_Method as Classification_Source,
          Material, Thread_Type, Value from checkpoint""",
    ),
)
def _(t):
    return Z.select_output(t("checkpoint").withColumn("Brand", F.col("Brand_Raw")))


# --- requests and evidence ----------------------------------------------------------------------

_EVIDENCE = {
    "numbered": "select *, row_number() over (partition by query order by rank) as r from snippets where trim(snippet) <> ''",
    "texts": "select query, string_agg(snippet || ' (' || url || ')', chr(10) order by r) as evidence from numbered where r <= 3 group by query",
}


@register(
    "attach_evidence",
    D.query(["items", "snippets"], _EVIDENCE, "select idx, description, coalesce(evidence, '') as evidence from items left join texts on description = query where ai_confidence = 'low'"),
)
def _(t):
    return E.attach_evidence(t("items").select("idx", "description", "ai_confidence"), t("snippets"), "description", "ai_confidence").select(
        "idx", "description", "evidence"
    )


_TEMPLATE = E.json_template(["material", "size_dimension"], True)


# What differs by row; the rest of the request is shared text that no row repeats.
_ROW_LAYOUT = E.shared_parts(E.FIRST_REQUEST, {"categories": "", "attributes": "", "template": _TEMPLATE})[1]


def _request_sql() -> str:
    pieces = {
        "description": "coalesce(description, '')",
        "context": f"case when {_CONTEXT_SQL} = '' then '' else {_q(E.CONTEXT_HEAD)} || {_CONTEXT_SQL} end",
        "evidence": f"case when coalesce(evidence, '') = '' then '' else {_q(E.EVIDENCE_HEAD)} || evidence end",
    }
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(_ROW_LAYOUT):
        if literal:
            parts.append(_q(literal))
        if name:
            parts.append(f"({pieces[name]})")
    return " || ".join(parts)


@register(
    "request_text",
    D.query(["items", "snippets"], _EVIDENCE, f"select idx, {_request_sql()} as request from items left join texts on description = query"),
)
def _(t):
    items = t("items").select("idx", "description", *_CONTEXT.values())
    texts = E.evidence_text(t("snippets"), "query")
    joined = items.join(texts, F.col("description") == F.col("query"), "left")
    request = E.request_text("description", E.context_text(_CONTEXT), F.col("evidence"), layout=_ROW_LAYOUT)
    return joined.select("idx", request.alias("request"))


@register(
    "proposed_category",
    D.query(
        ["items"],
        {
            "w": "select idx, final_category, web_mapped, list_filter(string_split_regex(category_type_raw, '\\s+'), lambda x: x <> '') as words from items",
            "c": "select *, array_to_string(list_transform(words, lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') as suggestion from w",
        },
        "select idx, concat_ws('|', nullif(final_category, ''), nullif(web_mapped, ''), suggestion) as proposed from c",
    ),
)
def _(t):
    return t("items").select(
        "idx", E.proposed_path(F.array("final_category", "web_mapped"), "category_type_raw").alias("proposed")
    )


# --- taxonomy -----------------------------------------------------------------------------------


@register(
    "keyword_distribution",
    D.query(
        ["categories", "keywords"],
        {"n": "select category, count(*) as n from keywords group by 1"},
        "select category, coalesce(n, 0) as current, 15 as target, case when coalesce(n, 0) >= 12 then 'ok' else 'low' end as status from categories left join n using (category)",
    ),
)
def _(t):
    return Y.keyword_distribution(t("categories"), t("keywords"))


@register(
    "validate_category",
    D.query(
        ["mistyped", "categories"],
        None,
        """select idx, coalesce(c.category, '') as valid_category, case when c.category is null then given else '' end as proposed_category
        from mistyped left join (select distinct category from categories) c on given = c.category""",
    ),
)
def _(t):
    return Y.validate_category(t("mistyped"), "given", t("categories")).select("idx", "valid_category", "proposed_category")


@register(
    "nearest_category",
    D.query(
        ["mistyped", "categories"],
        {
            "held": "select distinct category from categories where category is not null",
            "asked": "select distinct given from mistyped where trim(given) <> '' and given not in (select category from held)",
            **sequence_sql("asked", "given", "held", "category", 0.9),
            "best": "select x as given, first(y order by similarity desc, y) as nearest, max(similarity) as similarity from near group by x",
        },
        """select idx, given, coalesce(h.category, b.nearest) as nearest_category, case when h.category is not null then 1.0 else b.similarity end as similarity
        from mistyped left join held h on h.category = given left join best b using (given)""",
        recursive=True,
    ),
)
def _(t):
    near = Y.nearest_category(t("mistyped"), "given", t("categories"), 0.9, similarity="similarity")
    return near.select("idx", "given", "nearest_category", "similarity")


@register(
    "category_pages",
    D.query(
        ["categories"],
        {"held": "select category, row_number() over (order by category) - 1 as place from (select distinct category from categories where category is not null)"},
        "select place // 50 as page, string_agg(concat('  - ', category), chr(10) order by place) as options from held group by 1",
    ),
)
def _(t):
    return Y.category_pages(t("categories"), 50)


@register(
    "taxonomy_children",
    D.query(
        ["paths"],
        {
            "s": "select string_split(category, '|') as p from paths",
            "e": "select distinct unnest(range(1, len(p) + 1)) as level, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i-1], '|'))) as parent, unnest(p) as child from s",
            "below": "select parent as path, count(*) as n, min(child) as only_child from e group by 1",
        },
        """select cast(level as integer) as level, parent, child, coalesce(n, 0) as children, coalesce(n, 0) = 0 or (n = 1 and only_child = child) as leaf
        from e left join below on below.path = case when parent = '' then child else parent || '|' || child end""",
    ),
)
def _(t):
    return Y.taxonomy_children(t("paths"))


@register(
    "taxonomy_summary",
    D.query(
        ["paths"],
        None,
        "select count(*) as categories, count(distinct string_split(category, '|')[1]) as level1, cast(max(len(string_split(category, '|'))) as integer) as depth from paths",
    ),
)
def _(t):
    return Y.taxonomy_summary(t("paths"))


_LEVEL_ITEMS = "select idx, description, case when final_category = '' then '' else final_category end as chosen from items"


def _level_sql() -> str:
    import string

    pieces = {"description": "description", "context": "''", "evidence": "''", "categories": "coalesce(options, '')", "level": "'2'"}
    parts = []
    for literal, name, _, _ in string.Formatter().parse(E.LEVEL_REQUEST):
        if literal:
            parts.append(_q(literal))
        if name:
            parts.append(f"({pieces[name]})")
    return " || ".join(parts)


@register(
    "level_request_text",
    D.query(
        ["items", "paths"],
        {
            "chosen": _LEVEL_ITEMS,
            "s": "select distinct string_split(category, '|')[1] as parent, string_split(category, '|')[2] as child from paths",
            "o": "select parent, string_agg('  - ' || child, chr(10) order by child) as options from s group by 1",
        },
        f"select idx, {_level_sql()} as request from chosen left join o on chosen = parent where chosen <> ''",
    ),
)
def _(t):
    """Second step of the drill-down: the children of the first level already chosen."""
    items = t("items").select("idx", "description", F.col("final_category").alias("chosen")).filter("chosen <> ''")
    asked = Y.attach_level_options(items, "chosen", t("paths"))
    request = E.request_text("description", categories=F.col("options"), layout=E.LEVEL_REQUEST, level=2)
    return asked.select("idx", request.alias("request"))


# --- reports ------------------------------------------------------------------------------------


@register(
    "benchmark_items",
    D.query(
        ["items"],
        {
            **_RESULT,
            "b": "select Normalized_Description, Brand, min(idx) as pos from result where Brand is not null group by 1, 2",
            "r": "select *, row_number() over (partition by Normalized_Description order by pos) as r from b",
            "l": "select Normalized_Description, string_agg(Brand, ', ' order by r) as Brands from r where r <= 3 group by 1",
            "c": "select Normalized_Description, count(Description) as Count, arg_min(Concept_Noun, idx) filter (where Concept_Noun is not null) as Concept_Noun from result group by 1",
        },
        'select Normalized_Description, Count, coalesce(Brands, \'\') as "Brands", Concept_Noun from c left join l using (Normalized_Description) order by Count desc, Normalized_Description limit 20',
    ),
)
def _(t):
    return P.benchmark_items(_result(t), "idx")


@register(
    "drill_down",
    D.query(
        ["items"],
        {**_RESULT, "picked": "select distinct Normalized_Description from result where AI_Confidence = 'high' and Brand is null"},
        "select idx, Description, Brand from result where Normalized_Description in (select Normalized_Description from picked)",
    ),
)
def _(t):
    result = _result(t)
    picked = result.filter("AI_Confidence = 'high' and Brand is null")
    return P.drill_down(result, picked).select("idx", "Description", "Brand")


@register(
    "attribute_top_values",
    D.query(
        ["checkpoint"],
        {
            "v": """select 'Material' as attribute, Material as value from checkpoint union all select 'Thread_Type', Thread_Type from checkpoint
              union all select 'Brand_Raw', Brand_Raw from checkpoint""",
            "n": f"select attribute, value, count(*) as count from v where not {D.blank('value')} group by 1, 2",
            "r": "select *, cast(row_number() over (partition by attribute order by count desc, value) as integer) as rank from n",
        },
        "select * from r where rank <= 20",
    ),
)
def _(t):
    return P.attribute_top_values(t("checkpoint"), ["Material", "Thread_Type", "Brand_Raw"])


@register(
    "result_metrics",
    D.query(
        ["items"],
        _RESULT,
        """select count(*) as total, count(*) filter (where AI_Confidence = 'high') as high_confidence, count(*) filter (where AI_Confidence = 'medium') as medium_confidence,
          count(*) filter (where AI_Confidence = 'low') as low_confidence, count(*) filter (where Is_Product_or_Service = 'Product') as products,
          count(*) filter (where Is_Product_or_Service = 'Service') as services, count(*) filter (where Needs_Review = 1) as needs_review from result""",
    ),
)
def _(t):
    return P.result_metrics(_result(t))


@register(
    "confidence_breakdown",
    D.query(
        ["items"],
        _RESULT,
        """select AI_Confidence as level, count(*) as rows, case AI_Confidence when 'high' then '🟢 High' when 'medium' then '🟡 Medium' else '🔴 Low' end as label
        from result group by 1""",
    ),
)
def _(t):
    return P.confidence_breakdown(_result(t))


_PROFILE = {
    "v": " union all ".join(f"select idx, '{c}' as col, {c} as value from shown" for c in ("description", "brand", "noun")),
    "pv": "select col, value, count(*) as n, min(idx) as pos from v group by 1, 2",
    "tot": "select col, coalesce(sum(n) filter (where value is not null), 0) as non_null, coalesce(sum(n) filter (where value is null), 0) as nulls, count(value) as distinct_values from pv group by 1",
    "rk": "select *, row_number() over (partition by col order by pos, value) as r from pv where value is not null",
    "smp": "select col, string_agg(value, ' | ' order by r) as samples from rk where r <= 3 group by 1",
}


@register(
    "column_profile",
    D.query(
        ["items"],
        {"shown": "select idx, description, nullif(brand_raw, '') as brand, nullif(concept_noun_raw, 'nan') as noun from items", **_PROFILE},
        "select col as \"column\", cast(non_null as bigint) as non_null, cast(nulls as bigint) as nulls, distinct_values, coalesce(samples, '') as samples from tot left join smp using (col)",
    ),
)
def _(t):
    shown = t("items").select(
        "idx",
        "description",
        F.nullif("brand_raw", F.lit("")).alias("brand"),
        F.nullif("concept_noun_raw", F.lit("nan")).alias("noun"),
    )
    return P.column_profile(shown, ["description", "brand", "noun"], "idx")


# --- cost ---------------------------------------------------------------------------------------


@register(
    "usage_cost",
    D.query(
        ["usage_log", "prices"],
        {
            "s": """select model, count(*) as requests, sum(input_tokens) as i, sum(output_tokens) as o, count(*) filter (where provider = 'google') as g,
              count(*) filter (where provider = 'perplexity') as p, sum(seconds) as total_time from usage_log group by 1""",
            "c": "select *, coalesce((i / 1000000) * input + (o / 1000000) * output, cast(0 as double)) as ai, (g / 1000) * cast(5 as double) + p * cast(0.003 as double) as web from s left join prices using (model)",
        },
        """select model, requests, cast(i as bigint) as input_tokens, cast(o as bigint) as output_tokens, cast(i + o as bigint) as total_tokens,
          g as google_searches, p as perplexity_searches, ai as ai_cost, web as search_cost, ai + web as total_cost, total_time, total_time / requests as avg_time_per_row from c""",
    ),
)
def _(t):
    return K.usage_cost(t("usage_log"), t("prices"), "seconds")


@register(
    "cost_estimate",
    D.query(
        ["batches", "prices"],
        {
            "s": """select *, cast(floor(num_rows * cast(0.3 as double)) as bigint) as kw, cast(floor(num_rows * (1 - cast(0.3 as double))) as bigint) as calls,
              cast(floor(num_rows * cast(0.2 as double)) as bigint) as searches from batches left join prices using (model)""",
            "k": "select *, (calls - searches) * 800 + searches * 1500 as i, (calls - searches) * 100 + searches * 150 as o from s",
            "c": """select *, coalesce((i / 1000000) * input + (o / 1000000) * output, cast(0 as double)) as ai, searches * cast(0.003 as double) as web,
              num_rows * cast(0.1 as double) + (calls - searches) * 8 / 10 + searches * 15 / 10 as secs from k""",
        },
        """select batch, model, num_rows as total_rows, kw as keyword_matches, calls as ai_calls, searches as web_searches, i as input_tokens, o as output_tokens,
          ai as ai_cost, web as web_cost, ai + web as total_cost, secs as estimated_seconds, secs / 60 as estimated_minutes from c""",
    ),
)
def _(t):
    return K.cost_estimate(t("batches"), t("prices"), 0.3, 0.2)


@register(
    "simple_estimate",
    D.query(
        ["batches", "prices"],
        {
            "k": """select *, (num_rows * 500 / 1000000) * input + (num_rows * 150 / 1000000) * output as cost,
              case when input is null then cast(0 as double) else num_rows * case when model like 'gpt-5%' then cast(3.5 as double) else cast(4 as double) end end as secs
              from batches left join prices using (model)"""
        },
        """select batch, model, num_rows as total_rows, case when input is null then 'Unknown' else printf('$%.2f', cost) end as cost_text, secs as seconds,
          case when input is null then 'Unknown' when secs < 60 then printf('%.0fs', secs) when secs < 3600 then printf('%.1f min', secs / 60) else printf('%.1f hours', secs / 3600) end as time_text from k""",
    ),
)
def _(t):
    return K.simple_estimate(t("batches"), t("prices"))


def _echo():
    """Answers every request with the evidence in it; refuses those of some items, as a service does."""

    def answer(request):
        if "Id: 1\n" in request or "Id: 17\n" in request:
            raise ValueError("refused")
        return request.split("SEARCH EVIDENCE\n")[1].split("\nEND")[0]

    return lambda texts: texts.map(answer)


@register(
    "answer_waves",
    D.query(
        ["items", "responses"],
        None,
        """select idx, case when idx in (1, 17) then null else content end as content, case when idx in (1, 17) then 'refused' end as error
        from items join responses using (idx)""",
    ),
)
def _(t):
    """Two calls over one store: the first gets half of the items, the second all of them and asks only the rest."""
    rows = t("items").join(t("responses"), "idx")
    asked = rows.withColumn("request", F.concat(E.request_text("description", E.context_text({"Id": F.col("idx")}), F.col("content")), F.lit("\nEND")))
    store = work_folder(rows.sparkSession)
    ask_in_waves(asked.where("idx % 2 = 0"), _echo(), "request", "idx", store, 3)
    return ask_in_waves(asked, _echo(), "request", "idx", store, 5).select("idx", "content", "error")


@register("resume_stream", D.query(["items"], None, "select idx, upper(description) as shown from items"))
def _(t):
    """Items arrive in files that overlap; the stream is stopped and started again; what is stored is compacted."""
    items = t("items").select("idx", "description")
    spark, folder = items.sparkSession, work_folder(items.sparkSession)
    work = lambda df: df.select("idx", F.upper("description").alias("shown"))
    for arrival in ("idx % 3 = 0", "idx % 2 = 0", "true"):
        items.where(arrival).write.mode("append").parquet(f"{folder}/in")
        stream = item_stream(spark, f"{folder}/in", items.schema)
        process_stream(stream, work, f"{folder}/out", f"{folder}/state", "idx").awaitTermination()
        compact(spark, f"{folder}/out", 2)
    return finished_rows(spark, f"{folder}/out")


# A line of each kind: a record, one that breaks off, one whose number is a word, one without a description.
_RECORD = """concat('{{"Index":', {n}, ',"Description":"', {d}, '"', {e})"""
_LINE = (
    "case when idx % 7 = 0 then " + _RECORD.format(n="idx", d="trim(description)", e="''")
    + " when idx % 11 = 0 then " + _RECORD.format(n="'seven'", d="trim(description)", e="'}'")
    + " when idx % 13 = 0 then " + _RECORD.format(n="idx", d="' '", e="'}'")
    + " else " + _RECORD.format(n="idx", d="trim(description)", e="'}'") + " end"
)


@register(
    "quarantine_items",
    D.query(
        ["items"],
        {"l": f"select idx, description, {_LINE} as line from items"},
        """select cast(case when idx % 7 = 0 or idx % 11 = 0 or idx % 13 = 0 then null else idx end as bigint) as idx,
          case when idx % 7 = 0 or idx % 11 = 0 or idx % 13 = 0 then line else trim(description) end as text,
          case when idx % 7 = 0 or idx % 11 = 0 then 'unreadable' when idx % 13 = 0 then 'lacks Description' end as reason from l""",
    ),
)
def _(t):
    """Items as lines of JSON, some of them broken: the good rows, and the failed ones with their record."""
    items = t("items")
    spark, folder = items.sparkSession, work_folder(items.sparkSession)
    items.select(F.expr(_LINE).alias("value")).write.text(f"{folder}/lines")
    read = read_quarantined(spark, f"{folder}/lines", "Index long, Description string", "json", ["Index", "Description"])
    good = read.good.select(F.col("Index").alias("idx"), F.col("Description").alias("text"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(read.failed.select(F.lit(None).cast("long").alias("idx"), F.col("record").alias("text"), "reason"))


@register(
    "column_profile_sketch",
    D.query(
        ["items"],
        {
            "shown": "select description, nullif(brand_raw, '') as brand, nullif(concept_noun_raw, 'nan') as noun from items",
            "long": "select 'description' as col, description as v from shown union all select 'brand', brand from shown union all select 'noun', noun from shown",
            "n": "select col, v, count(*) as n from long where v is not null group by col, v",
        },
        """select long.col as "column", count(v) as non_null, count(*) - count(v) as nulls, true as within_error,
          (select max(n.n) from n where n.col = long.col) as top_count from long group by long.col""",
    ),
)
def _(t):
    """Sketches of three batches, stored and merged; the distinct count is held against the exact one."""
    items = t("items")
    shown = items.select("idx", "description", F.nullif("brand_raw", F.lit("")).alias("brand"), F.nullif("concept_noun_raw", F.lit("nan")).alias("noun"))
    spark, folder, names = items.sparkSession, work_folder(items.sparkSession), ["description", "brand", "noun"]
    for i in range(3):
        profile_sketches(shown.where(F.col("idx") % 3 == i), names).write.parquet(f"{folder}/batch={i}")
    merged = profile_of(merge_sketches(spark.read.parquet(folder)))
    exact = P.column_profile(shown, names, "idx").select("column", F.col("distinct_values").alias("exact"))
    within = F.col("exact").between(F.col("low"), F.col("high"))
    return merged.join(exact, "column").select("column", "non_null", "nulls", within.alias("within_error"), F.col("top")[0]["count"].alias("top_count"))


def _choose():
    """Chooses by the length of the description; some answers are no category."""

    def answer(request):
        import json

        size = len(next(x for x in request.split("\n") if x.startswith("Description: "))) - len("Description: ")
        options = [x[4:] for x in request.split("\n") if x.startswith("  - ")]
        level = int(request.split("category of level ")[1].split(" ")[0])
        chosen = "elsewhere" if size % 7 == 0 and level == 2 else options[(size + level) % len(options)]
        return json.dumps({"selected_category": chosen})

    return lambda texts: texts.map(answer)


@register(
    "level_loop",
    D.query(
        ["items", "paths"],
        {
            "s": "select string_split(category, '|') as p from paths",
            "e": "select distinct unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i-1], '|'))) as parent, unnest(p) as child from s",
            "o": "select parent, list(child order by child) as c from e group by parent",
            "walk": """select idx, length(description) as size, '' as path, '' as tip, 0 as level, cast(null as varchar) as proposed from items
              union all
              select idx, size, case when bad then path when path = '' then pick else path || '|' || pick end, pick, level + 1, case when bad then 'elsewhere' end
              from (select w.*, o.c[1 + (size + level + 1) % len(o.c)] as pick, size % 7 = 0 and level = 1 as bad
                from walk w join o on o.parent = w.path where proposed is null and not (len(o.c) = 1 and o.c[1] = tip))""",
            "tops": "select idx, max(level) as level from walk group by idx",
        },
        """select idx, path, cast(case when proposed is null then level else level - 1 end as integer) as level, proposed from walk join tops using (idx, level)""",
        recursive=True,
    ),
)
def _(t):
    return level_loop(t("items"), _choose(), t("paths"), "idx", "description").select("idx", "path", "level", "proposed")


@register(
    "incremental_consensus",
    D.query(
        ["items"],
        {
            "final": """select idx, case when idx % 5 = 1 then concat(lower(trim(concept_noun_raw)), '2') else lower(trim(concept_noun_raw)) end as k,
              case when idx % 3 = 0 then final_category else ai_mapped end as cat from items where idx % 10 <> 9""",
            **D.consensus("f", "final", "k", "cat"),
        },
        "select key, winner, top as votes, cast(voters as bigint) as voters from f_win",
    ),
)
def _(t):
    """All items vote; then some change their category, some their cluster, and some are withdrawn."""
    items = t("items")
    state = VoteState(items.sparkSession, work_folder(items.sparkSession), 8)
    key = F.lower(F.trim("concept_noun_raw"))
    vote = lambda k, c: [F.col("idx").alias("item"), k.alias("key"), c.alias("category")]
    state.apply(items.select(*vote(key, F.col("ai_mapped"))))
    category = F.when(F.col("idx") % 3 == 0, F.col("final_category")).otherwise(F.col("ai_mapped"))
    moved = F.when(F.col("idx") % 10 != 9, F.when(F.col("idx") % 5 == 1, F.concat(key, F.lit("2"))).otherwise(key))
    state.apply(items.where("idx % 3 = 0 or idx % 5 = 1 or idx % 10 = 9").select(*vote(moved, category)))
    return state.decisions()
