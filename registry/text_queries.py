"""Text keys and word rules over whole documents and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemnorm.functions import attributes as A
from itemnorm.functions import text as X
from itemnorm.operators.decide import normalized_description

from . import duck as D
from .core import register


@register("key_fingerprint", D.query(["lines"], None, f"select pos, {D.fingerprint('line')} as fingerprint from lines"))
def _(t):
    return t("lines").select("pos", X.key_fingerprint("line").alias("fingerprint"))


@register(
    "ngram_fingerprint",
    D.query(
        ["lines"],
        {"g": f"select pos, {D.gram_text('line')} as t from lines"},
        f"select pos, case when length(t) < 2 then t else array_to_string({D.grams('t')}, '') end as fingerprint from g",
    ),
)
def _(t):
    return t("lines").select("pos", X.ngram_fingerprint("line").alias("fingerprint"))


@register(
    "ngram_similarity",
    D.query(
        ["lines"],
        {
            "g": f"select pos, line, {D.gram_text('line')} as t from lines",
            "s": f"select pos, case when line = '' then [] else {D.grams('t')} end as g from g",
        },
        """select a.pos as pos, case when len(a.g) = 0 or len(b.g) = 0 then cast(0 as double)
          else len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) end as similarity
        from s a join s b on b.pos = a.pos + 1""",
    ),
)
def _(t):
    """Each line with the next line of its document."""
    grams = t("lines").select("pos", X.ngrams("line").alias("grams"))
    following = grams.select((F.col("pos") - 1).alias("pos"), F.col("grams").alias("following"))
    return grams.join(following, "pos").select("pos", X.set_similarity(F.col("grams"), F.col("following")).alias("similarity"))


@register("singularize", D.query(["words"], None, f"select word, {D.singular('word')} as singular from words"))
def _(t):
    return t("words").select("word", X.singularize("word").alias("singular"))


@register("singularize_review", D.query(["words"], None, f"select word, {D.singular_review('word')} as singular from words"))
def _(t):
    return t("words").select("word", X.singularize_review("word").alias("singular"))


def _values(table: dict[str, str], key: str) -> str:
    return "case " + " ".join(f"when {key} = '{k}' then '{v}'" for k, v in table.items()) + f" else {key} end"


_SIZE = "lower(trim(size_text))"
_FRACTION = r"'^(\d+)/(\d+)\s*(\w+)?'"


@register(
    "normalize_attributes",
    D.query(
        ["attribute_texts"],
        {
            "f": f"""select *, try_cast(regexp_extract({_SIZE}, {_FRACTION}, 1) as double) as top, try_cast(regexp_extract({_SIZE}, {_FRACTION}, 2) as double) as bottom,
              regexp_extract({_SIZE}, {_FRACTION}, 3) as unit from attribute_texts"""
        },
        rf"""select idx,
          case when material = '' or lower(material) = 'nan' then '' else {_values(A.MATERIALS, 'lower(trim(material))')} end as material,
          case when thread = '' or lower(thread) = 'nan' then '' else coalesce(({' '.join(['case lower(trim(thread))'] + [f"when '{k}' then '{v}'" for k, v in A.THREADS.items()] + ['end'])}), upper(thread)) end as thread,
          case when color = '' or lower(color) = 'nan' then '' else lower(trim(color)) end as color,
          case when top is not null and bottom > 0 then cast(top / bottom as varchar) || case when unit = '' then 'in' else unit end
            else regexp_replace(regexp_replace(regexp_replace({_SIZE}, '\s*(inch|inches)\b', 'in', 'g'), '\s*(millimeter|millimeters)\b', 'mm', 'g'), '\s*(centimeter|centimeters)\b', 'cm', 'g') end as size
        from f""",
    ),
)
def _(t):
    return t("attribute_texts").select(
        "idx",
        A.normalize_material("material").alias("material"),
        A.normalize_thread("thread").alias("thread"),
        A.normalize_color("color").alias("color"),
        A.normalize_size("size_text").alias("size"),
    )


def description_sql(noun: str, text: str, brand: str, modifier: str, attributes: list[str], source: str, keep: str) -> dict[str, str]:
    """CTEs ending in ``described(..., normalized)``; each repeat rule is one step."""
    steps = {
        "d0": f"""select {keep}, {noun} as d_noun, lower({text}) as d_text,
          [lower({noun})] || case when {D.blank(modifier)} then [] else list_filter(list_transform(string_split(lower({modifier}), ','), lambda m: trim(m)), lambda m: m <> '') end
          || case when {D.blank(brand)} then [] else [lower({brand})] end as parts, {', '.join(f"case when {D.blank(a)} then '' else lower({a}) end as v{i}" for i, a in enumerate(attributes))}
          from {source}"""
    }
    for i, _ in enumerate(attributes):
        steps[f"d{i + 1}"] = f"select * replace (case when v{i} = '' or list_contains(parts, v{i}) then parts else list_append(parts, v{i}) end as parts) from d{i}"
    last = f"d{len(attributes)}"
    steps["d_terms"] = f"""select *, list_filter(list_transform(string_split_regex(d_text, '\\s+'), lambda w: trim(w, '.,;:()[]{{}}"''-')),
      lambda w: length(w) > 3 and w not in ('the','a','an','and','or','for','to','of','in','on','at','by','with') and not list_contains(parts, w))[1:3] as terms from {last}"""
    steps["d_all"] = """select *, case when len(parts) < 3 then parts || list_filter(terms, lambda w, i: list_position(terms, w) = i) else parts end as whole from d_terms"""
    steps["described"] = f"""select *, case when {D.blank('d_noun')} then d_text when len(whole) > 1 then whole[1] || ' - ' || array_to_string(whole[2:], ' ; ') else whole[1] end as normalized from d_all"""
    return steps


@register(
    "normalized_description",
    D.query(
        ["checkpoint"],
        description_sql("Concept_Noun_Raw", "Description", "Brand_Raw", "Modifier_Raw", ["Material", "Thread_Type"], "checkpoint", "Index"),
        "select Index, normalized as Normalized_Description from described",
    ),
)
def _(t):
    d = normalized_description("Concept_Noun_Raw", "Description", "Brand_Raw", "Modifier_Raw", ["Material", "Thread_Type"])
    return t("checkpoint").select("Index", d.alias("Normalized_Description"))
