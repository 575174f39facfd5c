"""Clustering, normalization, voting and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemnorm.functions.text import key_fingerprint
from itemnorm.operators import clustering as C
from itemnorm.operators import consensus as V
from itemnorm.operators import review as R
from itemnorm.plans.learning import Learner
from itemnorm.plans.renormalize import renormalize
from itemnorm.session import cut, work_folder
from itemnorm.sources.tables import load_mapping, save_mapping
from itemnorm.streaming.streams import append_stream, apply_mapping_stream, item_stream

from . import duck as D
from .core import register
from .text_queries import description_sql


def line_keys(t):
    """Distinct fingerprints of all document lines by first appearance."""
    counts = C.value_counts(t("lines"), "line", "pos")
    keys = counts.withColumn("key", key_fingerprint("value")).groupBy("key").agg(F.min("first_pos").alias("key_pos"))
    return cut(keys, work_folder(keys.sparkSession), "keys")


@register(
    "value_counts",
    D.query(["lines"], None, f"select trim(line) as value, count(*) as n, min(pos) as first_pos from lines where not {D.blank('line')} group by 1"),
)
def _(t):
    return C.value_counts(t("lines"), "line", "pos")


_COLLISION = lambda table, column, order, key: {
    "c": f"select {column} as value, count(*) as n, min({order}) as first_pos from {table} where {column} is not null group by 1",
    "k": f"select *, {key} as cluster_key from c",
    "clusters": "select cluster_key, value, n, first_pos, count(*) over (partition by cluster_key) as variants from k where cluster_key <> ''",
}


@register(
    "fingerprint_clusters",
    D.query(["lines"], _COLLISION("lines", "line", "pos", D.fingerprint("value")), "select * from clusters where variants >= 2"),
)
def _(t):
    return C.collision_clusters(t("lines"), "line", "pos")


@register(
    "ngram_clusters",
    D.query(
        ["lines"],
        {
            **_COLLISION("lines", "line", "pos", f"case when length(t) < 2 then t else array_to_string({D.grams('t')}, '') end"),
            "c": f"select *, {D.gram_text('value')} as t from (select line as value, count(*) as n, min(pos) as first_pos from lines where line is not null group by 1)",
        },
        "select * from clusters where variants >= 2",
    ),
)
def _(t):
    return C.collision_clusters(t("lines"), "line", "pos", method="ngram")


@register(
    "canonical_form",
    D.query(
        ["items"],
        {
            "c": f"select trim(description) as value, count(*) as n, min(idx) as pos from items where not {D.blank('description')} group by 1",
            "k": f"select *, {D.fingerprint('value')} as key from c",
        },
        "select key, lower(first(value order by n desc, (value = lower(value)) desc, length(value), pos)) as canonical, cast(sum(n) as bigint) as n_rows from k group by key",
    ),
)
def _(t):
    counts = C.value_counts(t("items"), "description", "idx").withColumn("key", key_fingerprint("value"))
    return counts.groupBy("key").agg(C.canonical_value("value", "n", "first_pos").alias("canonical"), F.sum("n").alias("n_rows"))


_SLICE = {
    "c": f"select trim(description) as value, count(*) as n, min(idx) as pos from items where not {D.blank('description')} group by 1",
    "k": f"select *, {D.fingerprint('value')} as key from c",
    "f": "select key, lower(first(value order by n desc, (value = lower(value)) desc, length(value), pos)) as canonical from k group by key",
    "m": "select value, canonical from k join f using (key)",
}


@register(
    "apply_mapping",
    D.query(["items"], _SLICE, f"select idx, description, {D.mapped('description', 'm')} as canonical from items left join m on trim(description) = m.value"),
)
def _(t):
    return apply_canonical(t("items"))


def apply_canonical(items):
    """Fingerprint groups, canonical form, mapping back onto the rows."""
    counts = C.value_counts(items, "description", "idx").withColumn("key", key_fingerprint("value"))
    forms = counts.groupBy("key").agg(C.canonical_value("value", "n", "first_pos").alias("canonical"))
    mapping = counts.join(forms, "key").select("value", "canonical")
    return C.apply_mapping(items.select("idx", "description"), "description", mapping, "canonical")


_LINE_KEYS = {
    "v": f"select trim(line) as value, min(pos) as pos from lines where not {D.blank('line')} group by 1",
    "keys": f"select {D.fingerprint('value')} as key, min(pos) as key_pos from v group by 1",
    "texts": f"select key, key_pos, {D.gram_text('key')} as t from keys where key <> ''",
    "sets": f"select key, key_pos, t, {D.grams('t')} as g from texts",
    # Equal sets are one node, named by their earliest key.
    "nodes": "select g, min(key_pos) as node, arg_min(key, key_pos) as key, any_value(length(t)) as len from sets group by g",
}
# A bigram of [0-9a-z] is one of 36 * 36 bits, so brute force over all pairs is one AND per pair.
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_BITS = {
    "bits": f"""select node, any_value(key) as key, bitstring_agg(cast((strpos('{_DIGITS}', substr(gram, 1, 1)) - 1) * 36 + strpos('{_DIGITS}', substr(gram, 2, 1)) - 1 as integer), 0, 1295) as b
      from (select node, key, unnest(g) as gram from nodes where len >= 2) group by node""",
    "sized": "select node, key, b, bit_count(b) as n from bits",
    "pairs": """select a.node as a, b.node as b, a.key as left_key, b.key as right_key,
        bit_count(a.b & b.b) as both_n, a.n + b.n - bit_count(a.b & b.b) as either_n
      from sized a join sized b on a.node < b.node and a.n >= 0.85 * b.n - 0.001 and b.n >= 0.85 * a.n - 0.001""",
    "near": "select a, b, left_key, right_key, both_n / either_n as similarity from pairs where both_n / either_n >= 0.85",
}


#: Greedy leaders over the table near (a, b): each node in order leads unless an earlier leader is near.
_WALK = {
    "linked": "select node, row_number() over (order by node) - 1 as i from (select a as node from near union select b from near)",
    "nb": "select y.i as b, list(x.i order by x.i) as ns from near join linked x on x.node = near.a join linked y on y.node = near.b group by y.i",
    "walk": """select cast(-1 as bigint) as i, cast([] as bigint[]) as leaders, cast(-1 as bigint) as lead
      union all
      select w.i + 1, case when x.l is null then list_append(w.leaders, w.i + 1) else w.leaders end, coalesce(x.l, w.i + 1)
      from walk w left join nb on nb.b = w.i + 1,
      lateral (select list_min(list_intersect(w.leaders, coalesce(nb.ns, cast([] as bigint[])))) as l) x
      where w.i + 1 < (select count(*) from linked)""",
    "led": "select m.node, l.node as leader from walk join linked m on m.i = walk.i join linked l on l.i = walk.lead",
}


@register("ngram_similar_pairs", D.query(["lines"], {**_LINE_KEYS, **_BITS}, "select left_key, right_key, similarity from near"))
def _(t):
    return C.ngram_similar_pairs(line_keys(t), "key", "key_pos")


@register(
    "leader_clusters",
    D.query(
        ["lines"],
        {
            **_LINE_KEYS,
            **_BITS,
            **_WALK,
        },
        """select k.key, k.key_pos as position, coalesce(led.leader, n.node, k.key_pos) as cluster
        from keys k left join sets s on s.key = k.key left join nodes n on n.g = s.g left join led on led.node = n.node""",
        recursive=True,
    ),
)
def _(t):
    return C.leader_clusters(line_keys(t), "key", "key_pos")


_SEQUENCE = {
    "vals": "select lower(description) as t, min(idx) as node, arg_min(description, idx) as value from items where description is not null group by 1",
    **D.sequence_sql("vals", "t", "vals", "t", 0.8, "l.node < r.node"),
}
# Named by the nodes instead of the texts.
_SEQUENCE["near"] = f"select l.node as a, r.node as b, l.value as left_key, r.value as right_key, similarity from ({_SEQUENCE['near']}) join vals l on l.t = x join vals r on r.t = y"


@register(
    "fuzzy_similar_pairs",
    D.query(
        ["items"], _SEQUENCE,
        "select left_key, right_key, similarity from near",
        recursive=True,
    ),
)
def _(t):
    return C.fuzzy_similar_pairs(t("items"), "description", "idx", 0.8)


@register(
    "fuzzy_clusters",
    D.query(
        ["items"],
        {
            **_SEQUENCE,
            **_WALK,
            "grouped": "select t, coalesce(led.leader, v.node) as leader from vals v left join led using (node)",
            "named": "select g.t, v.value as cluster_key from grouped g join vals v on v.node = g.leader",
            "c": "select description as value, count(*) as n, min(idx) as first_pos from items where description is not null group by 1",
            "clusters": "select cluster_key, c.value, n, first_pos, count(*) over (partition by cluster_key) as variants from c join named on named.t = lower(c.value)",
        },
        "select * from clusters where variants >= 2",
        recursive=True,
    ),
)
def _(t):
    return C.fuzzy_clusters(t("items"), "description", "idx", 0.8)


# --- column normalizer --------------------------------------------------------------------------

_MERGED = f"""select idx, coalesce({D.present('web_concept_noun')}, {D.present('concept_noun_raw')}, '') as noun, brand_raw, modifier_raw, category_type_raw from items"""


def _normalizer_query(column: str, kind: str) -> str:
    return D.query(
        ["items"],
        {"merged": _MERGED, **D.normalizer("m", "merged", column, "idx", kind)},
        f"select idx, {D.mapped(column, 'm_map')} as normalized from merged left join m_map on trim({column}) = m_map.value",
        recursive=True,
    )


def _normalized(items, column: str, kind: str):
    result = C.normalize_column(items, column, "idx", kind)
    return C.apply_mapping(items.select("idx", column), column, result.mapping, "normalized").select("idx", "normalized")


@register("normalize_noun", _normalizer_query("noun", "noun"))
def _(t):
    from itemnorm.operators.decide import merge_sources

    return _normalized(merge_sources(t("items"), "noun", "web_concept_noun", "concept_noun_raw"), "noun", "noun")


@register("normalize_category_type", _normalizer_query("category_type_raw", "category"))
def _(t):
    return _normalized(t("items"), "category_type_raw", "category")


@register("normalize_modifier", _normalizer_query("modifier_raw", "generic"))
def _(t):
    return _normalized(t("items"), "modifier_raw", "generic")


@register("normalize_brand", _normalizer_query("brand_raw", "brand"))
def _(t):
    return _normalized(t("items"), "brand_raw", "brand")


@register(
    "normalization_summary",
    D.query(
        ["items"],
        {"merged": _MERGED, **D.normalizer("m", "merged", "noun", "idx", "noun")},
        """select 'noun' as column_name, count(distinct canonical) as unique_values,
          greatest(0, count(distinct lower(value)) - count(distinct canonical)) as clustered from m_map""",
        recursive=True,
    ),
)
def _(t):
    from itemnorm.operators.decide import merge_sources

    merged = merge_sources(t("items"), "noun", "web_concept_noun", "concept_noun_raw")
    summary = C.normalize_column(merged, "noun", "idx", "noun").summary()
    return summary.select(F.lit("noun").alias("column_name"), "unique_values", "clustered")


_PATTERNS = f"select idx, brand_raw, {D.mapped('brand_raw', 'learned')} as brand from items left join learned on trim(brand_raw) = learned.value"


def _stored_mapping(t):
    """The mapping after a round trip through its stored form."""
    learned = t("learned")
    spark = learned.sparkSession
    path = work_folder(spark)
    save_mapping(learned, "brand", path)
    return load_mapping(spark, path, "brand")


@register("apply_patterns", D.query(["items", "learned"], None, _PATTERNS))
def _(t):
    return C.apply_mapping(t("items").select("idx", "brand_raw"), "brand_raw", _stored_mapping(t), "brand")


@register("apply_patterns_stream", D.query(["items", "learned"], None, _PATTERNS))
def _(t):
    """New items arrive as files; the stream joins them with the stored mapping."""
    items = t("items").select("idx", "brand_raw")
    spark = items.sparkSession
    folder = work_folder(spark)
    items.write.parquet(f"{folder}/arrivals")
    stream = item_stream(spark, f"{folder}/arrivals", items.schema)
    append_stream(
        apply_mapping_stream(stream, "brand_raw", _stored_mapping(t), "brand"), f"{folder}/out", f"{folder}/state"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# --- voting -------------------------------------------------------------------------------------

_KEYED = f"select *, {D.item_key('concept_noun_raw', 'modifier_raw', 'category_type_raw')} as k from items"


@register(
    "category_consensus",
    D.query(
        ["items"],
        {"keyed": _KEYED, **D.consensus("f", "keyed", "k", "final_category"), **D.consensus("g", "keyed", "k", "ai_mapped")},
        """select idx, coalesce(f_win.winner, final_category) as final_category, coalesce(g_win.winner, ai_mapped) as ai_mapped
        from keyed left join f_win on f_win.key = k left join g_win on g_win.key = k""",
    ),
)
def _(t):
    items = t("items")
    key = V.item_key("concept_noun_raw", "modifier_raw", "category_type_raw")
    return V.apply_consensus(items, ["final_category", "ai_mapped"], key).select("idx", "final_category", "ai_mapped")


_CHOSEN = f"select *, lower(trim(category_type_raw)) || '|' || {D.fingerprint('modifier_raw')} as k from items"


@register(
    "category_clusters",
    D.query(
        ["items"],
        {"keyed": _CHOSEN, **D.consensus("f", "keyed", "k", "final_category")},
        "select key as cluster_key, winner as canonical, variants, cast(total as bigint) as total_rows from f_win",
    ),
)
def _(t):
    return V.category_clusters(t("items"), ["category_type_raw", "modifier_raw"], "final_category")


_BRAND_KEYED = f"select *, lower(trim(concept_noun_raw)) || '|' || {D.fingerprint('modifier_raw')} as k from items"
_REVIEW = {
    "keyed": _BRAND_KEYED.replace("select *", "select *, case when p_size < 30 then 'A' else cast(p_size as varchar) end as cat"),
    **D.consensus("f", "keyed", "k", "cat"),
    "shown": "select k, cat, count(*) as n, min(idx) as pos from keyed group by 1, 2",
}


def _with_cat(t):
    return t("items").withColumn("cat", F.when(F.col("p_size") < 30, F.lit("A")).otherwise(F.col("p_size").cast("string")))


@register(
    "category_review",
    D.query(
        ["items"],
        {
            **_REVIEW,
            "texts": "select k, string_agg(coalesce(cat, '') || ' (' || n || ')', ' ⚫ ' order by n desc, pos) as variants from shown group by k",
            "heads": "select k, arg_min(concept_noun_raw || ' + ' || modifier_raw, idx) as clustering_key from keyed group by k",
        },
        """select key as cluster_key, true as approve, clustering_key, cast(0 as bigint) as page, texts.variants as variants, winner as normalize_to, cast(total as bigint) as total_rows
        from f_win join texts on texts.k = key join heads on heads.k = key where f_win.variants > 1""",
    ),
)
def _(t):
    return V.category_review(_with_cat(t), ["concept_noun_raw", "modifier_raw"], "cat", "idx")


@register(
    "apply_category_review",
    D.query(
        ["items"],
        {**_REVIEW, "counted": "select k, count(*) as shown_values from shown group by k"},
        """select idx, case when f_win.variants > 1 and shown_values <= 4 then case when shown_values > 2 then 'CHECKED' else winner end else cat end as cat
        from keyed left join f_win on f_win.key = keyed.k left join counted on counted.k = keyed.k""",
    ),
)
def _(t):
    """Pages of two: the reviewer sets another value on second pages and withdraws approval on third ones."""
    items = _with_cat(t)
    keys = ["concept_noun_raw", "modifier_raw"]
    review = V.category_review(items, keys, "cat", "idx", page_size=2).withColumns(
        {
            "approve": F.col("page") != 2,
            "normalize_to": F.when(F.col("page") == 1, F.lit("CHECKED")).otherwise(F.col("normalize_to")),
        }
    )
    return V.apply_category_decisions(items, keys, "cat", review).select("idx", "cat")


# --- review of value clusters -------------------------------------------------------------------

_ITEM_CLUSTERS = _COLLISION("items", "description", "idx", D.fingerprint("value"))


@register(
    "cluster_review",
    D.query(
        ["items"],
        _ITEM_CLUSTERS,
        """select cluster_key, true as approve, cast(0 as bigint) as page, string_agg(value || ' (' || n || ')', ' | ' order by n desc, first_pos) as variants,
          first(value order by n desc, first_pos) as normalize_to, '' as exclude, count(*) as variant_count, cast(sum(n) as bigint) as total_rows
        from clusters where variants >= 2 group by cluster_key""",
    ),
)
def _(t):
    return R.cluster_review(C.collision_clusters(t("items"), "description", "idx"))


def _reviewed(t):
    """Pages of two, each edited in its own way: first pages exclude the upper-case form, the others the first
    variant they show; clusters of five, ten, ... variants lose their approval on the second page."""
    items = t("items").withColumnRenamed("concept_noun_raw", "Concept_Noun_Merged")
    clusters = C.collision_clusters(items, "Concept_Noun_Merged", "idx")
    shown_first = F.substring_index("variants", " (", 1)
    decisions = R.cluster_review(clusters, page_size=2).select(
        "cluster_key",
        "page",
        (~((F.col("variant_count") % 5 == 0) & (F.col("page") == 1))).alias("approve"),
        "normalize_to",
        F.when(F.col("page") == 0, F.concat(F.upper("cluster_key"), F.lit("; spare"))).otherwise(shown_first).alias("exclude"),
    )
    return items, R.apply_review(items, "Concept_Noun_Merged", clusters, decisions)


_APPLIED = {
    **_COLLISION("items", "concept_noun_raw", "idx", D.fingerprint("value")),
    "shared": """select *, row_number() over (partition by cluster_key order by n desc, first_pos) - 1 as place,
      count(*) over (partition by cluster_key) as members from clusters where variants >= 2""",
    "decided": "select cluster_key, first(value order by n desc, first_pos) as to_value from shared where members % 5 <> 0 group by 1",
    "forms": f"""select value, {D.singular_review('lower(to_value)')} as canonical from shared join decided using (cluster_key)
      where value <> upper(cluster_key) and value <> 'spare' and not (place >= 2 and place % 2 = 0)""",
    "applied": "select idx, concept_noun_raw as before, coalesce(forms.canonical, concept_noun_raw) as after from items left join forms on forms.value = concept_noun_raw",
}


@register("apply_review", D.query(["items"], _APPLIED, "select idx, after as Concept_Noun_Merged from applied"))
def _(t):
    return _reviewed(t)[1].select("idx", "Concept_Noun_Merged")


@register(
    "change_counts",
    D.query(["items"], _APPLIED, "select 'Concept_Noun_Merged' as \"column\", count(*) filter (where before is distinct from after) as changed from applied"),
)
def _(t):
    before, after = _reviewed(t)
    return R.change_counts(before, after, "idx", ["Concept_Noun_Merged"])


@register(
    "export_columns",
    D.query(
        ["checkpoint"],
        None,
        """select Final_Category, Index, Description, Translated_Description, Is_Product_or_Service, AI_Confidence,
        Final_Proposed_Category, Classification_Method, Material, Thread_Type, Value from checkpoint""",
    ),
)
def _(t):
    return R.export(t("checkpoint"), "standard")


# --- whole run over a stored table --------------------------------------------------------------

_RUN = {
    "merged": f"""select *, coalesce({D.present('Web_Concept_Noun')}, {D.present('Concept_Noun_Raw')}, '') as m_noun,
      coalesce({D.present('Category_Type_Raw')}, '') as m_type, coalesce({D.present('Modifier_Raw')}, '') as m_mod from checkpoint""",
    **D.normalizer("n", "merged", "m_noun", "Index", "noun"),
    **D.normalizer("c", "merged", "m_type", "Index", "category"),
    **D.normalizer("m", "merged", "m_mod", "Index", "generic"),
    "clean": f"""select Index, Description, Translated_Description, AI_Confidence, Final_Category, Mapped_Category_Raw, Material, Thread_Type,
      {D.mapped('m_noun', 'n_map')} as Concept_Noun, {D.mapped('m_type', 'c_map')} as Category_Type, {D.mapped('m_mod', 'm_map')} as Modifier,
      upper(trim(Brand_Raw)) as Brand from merged left join n_map on m_noun = n_map.value left join c_map on m_type = c_map.value left join m_map on m_mod = m_map.value""",
    "keyed": f"select *, {D.item_key('Concept_Noun', 'Modifier', 'Category_Type')} as k from clean",
    **D.consensus("f", "keyed", "k", "Final_Category"),
    **D.consensus("g", "keyed", "k", "Mapped_Category_Raw"),
    "voted": """select keyed.* exclude (Final_Category), coalesce(f_win.winner, Final_Category) as Final_Category, coalesce(g_win.winner, Mapped_Category_Raw) as Mapped_Category
      from keyed left join f_win on f_win.key = k left join g_win on g_win.key = k""",
    **description_sql(
        "Concept_Noun", "(case when Translated_Description <> '' then Translated_Description else Description end)", "Brand", "Modifier",
        ["Material", "Thread_Type"], "voted",
        "Index, Concept_Noun, Category_Type, Modifier, Brand, Final_Category, Mapped_Category, AI_Confidence, Description",
    ),
    "scored": f"""select *, greatest(0, least(100, case AI_Confidence when 'high' then 85 when 'medium' then 65 else 45 end
      + case when {D.blank('Brand')} then 0 else 5 end + case when {D.blank('Mapped_Category')} then 0 else 5 end
      + case when {D.blank('Concept_Noun')} then -15 else 5 end + case when {D.blank('Category_Type')} then 0 else 3 end
      - case when length(Description) < 10 then 10 else 0 end)) as score from described""",
}


@register(
    "renormalize_checkpoint",
    D.query(
        ["checkpoint"],
        _RUN,
        """select Index, Concept_Noun, Category_Type, Modifier, Brand, Final_Category, Mapped_Category, normalized as Normalized_Description,
          score as Confidence_Score, case when score < 70 then 1 else 0 end as Needs_Review from scored""",
        recursive=True,
    ),
)
def _(t):
    return renormalize(t("checkpoint")).table.select(
        "Index", "Concept_Noun", "Category_Type", "Modifier", "Brand", "Final_Category", "Mapped_Category",
        "Normalized_Description", "Confidence_Score", "Needs_Review",
    )


@register(
    "learn_in_parts",
    D.query(["items"], {**D.normalizer("m", "items", "description", "idx", "noun")}, "select value, canonical from m_map", recursive=True),
)
def _(t):
    """Items arrive in two halves by their order; the learned mapping is that of all of them at once."""
    items = t("items").select("idx", "description")
    learner = Learner(items.sparkSession, work_folder(items.sparkSession), "noun")
    middle = items.agg(F.percentile_approx("idx", 0.5)).first()[0]  # the result does not depend on where a half ends
    learner.learn(items.where(F.col("idx") <= middle), "description", "idx")
    return learner.learn(items.where(F.col("idx") > middle), "description", "idx")
