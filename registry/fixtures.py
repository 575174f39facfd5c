"""Input tables derived from the driver's tables.

Every body is written in the common subset of Spark SQL and DuckDB SQL, so both sides derive the same
input. ``lines`` alone differs, since the dialects split text into rows differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

BODIES: dict[str, str] = {
    "items": """
select cast(p_partkey as bigint) as idx,
  case p_partkey % 6 when 0 then p_name when 1 then upper(p_name)
    when 2 then concat(split_part(p_name,' ',2), ', ', split_part(p_name,' ',1))
    when 3 then concat(p_name,'s') when 4 then replace(p_name,' ','-')
    else concat('  ',p_name,' ') end as description,
  case when p_partkey % 11 = 0 then '' else concat(p_brand, case p_partkey % 3 when 0 then ' Inc.' when 1 then ' LTD' else '' end) end as brand_raw,
  case when p_partkey % 13 = 0 then 'nan' when p_partkey % 4 = 0 then concat(upper(split_part(p_name,' ',2)),'S') else split_part(p_name,' ',2) end as concept_noun_raw,
  case when p_partkey % 10 = 3 then split_part(p_name,' ',2) else '' end as web_concept_noun,
  case when p_partkey % 5 = 0 then '' else split_part(p_name,' ',1) end as modifier_raw,
  concat(lower(p_type), case p_partkey % 3 when 0 then ' category' when 1 then ' type' else '' end) as category_type_raw,
  case p_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as ai_confidence,
  case when p_partkey % 4 = 0 then '' else p_type end as ai_mapped,
  case when p_partkey % 8 = 0 then '' else concat('NEW|', p_type) end as ai_proposed,
  case when p_partkey % 10 = 3 then 'high' when p_partkey % 10 = 7 then 'low' else '' end as web_confidence,
  case when p_partkey % 10 in (3, 7) then p_type else '' end as web_mapped,
  case when p_partkey % 16 = 0 then concat('WEB|', p_type) else '' end as web_proposed,
  case when p_partkey % 7 = 0 then '' else p_type end as final_category,
  case when p_partkey % 9 = 4 then 'Service' else 'Product' end as kind,
  cast(p_size as int) as p_size, p_retailprice as value
from part""",
    "checkpoint": """
select idx as Index, description as Description,
  case when idx % 17 = 0 then concat('translated ', description) else '' end as Translated_Description,
  brand_raw as Brand_Raw, concept_noun_raw as Concept_Noun_Raw, modifier_raw as Modifier_Raw,
  category_type_raw as Category_Type_Raw, kind as Is_Product_or_Service, ai_confidence as AI_Confidence,
  ai_mapped as Mapped_Category_Raw, ai_proposed as Proposed_Category_Raw,
  web_concept_noun as Web_Concept_Noun, final_category as Final_Category,
  case when final_category = '' then ai_proposed else '' end as Final_Proposed_Category,
  case when final_category = '' then 'Proposed' else 'AI' end as Classification_Method,
  case when idx % 3 = 0 then upper(modifier_raw) when idx % 3 = 1 then 'Brass' else '' end as Material,
  case when idx % 5 = 0 then 'NPT' else '' end as Thread_Type,
  value as Value
from items""",
    "responses": """
select cast(p_partkey as bigint) as idx,
  case when p_partkey % 9 = 0 then 'no json here'
  else concat(case when p_partkey % 4 = 0 then concat('```json', chr(10)) else '' end,
    '{"language":"EN","brand":"', case when p_partkey % 6 = 0 then 'n/a' else lower(p_brand) end,
    '","concept_noun":" ', upper(split_part(p_name,' ',2)), '","confidence":"', case p_partkey % 3 when 0 then 'High' when 1 then 'medium' else 'low' end,
    '","mapped_category":"', p_type, '","attributes":{"material":"', split_part(p_name,' ',1), '","size_dimension":"', cast(p_size as varchar(10)), '"}}',
    case when p_partkey % 4 = 0 then concat(chr(10), '```') else '' end) end as content
from part""",
    "level_responses": """
select cast(p_partkey as bigint) as idx,
  case when p_partkey % 7 = 0 then '{"selected_category": broken}'
  else concat('Answer: {"selected_category":" ', p_type, ' ","mapped_category":"', p_type, '|', p_name, '","matching_reason":null} done') end as content
from part""",
    "taxonomy": "select distinct p_type as level1, split_part(p_name,' ',2) as level2 from part",
    "paths": """
select distinct concat(p_type, '|', split_part(p_name,' ',2), '|', p_brand) as category from part
union select distinct concat(p_brand, '|', p_brand) as category from part
union select distinct concat(p_type, '|', split_part(p_name,' ',1)) as category from part""",
    "categories": """
select distinct concat(p_type, '|', p_name) as category from part
union select distinct concat('NEW|', p_type) as category from part""",
    "keywords": "select distinct concat(p_type, '|', p_name) as category, p_brand as keyword from part",
    "set_table": """
select p_brand as Attribute_Set, min(p_type) as Att1, '' as Att2, max(p_name) as Att3, ' nan' as Att4,
  concat(' ', min(p_name), ' ') as Att5, cast(null as varchar(10)) as Att6, max(p_type) as Att7, 'nan' as Att8
from part group by p_brand""",
    "set_mapping": """
select concat(case when p_type = 'STANDARD' then 'OTHER' else p_type end, ' ') as Level1_Category, min(p_brand) as Attribute_Set
from part group by p_type""",
    "mistyped": """
select idx, description, case idx % 4 when 0 then ai_proposed when 1 then concat(ai_proposed, 's') when 2 then concat(lower(ai_proposed), ' x')
  else replace(ai_proposed, 'O', '0') end as given
from items""",
    "snippets": """
select p_name as query, cast(row_number() over (partition by p_name order by p_partkey) as int) as rank,
  case when p_partkey % 5 = 0 then '' else concat('sold as ', p_brand) end as snippet,
  concat('http://example.org/', cast(p_partkey as varchar(20))) as url
from part""",
    "usage_log": """
select event_id as call_id,
  case user_id % 3 when 0 then 'gpt-5-mini' when 1 then 'gpt-4o' else 'unpriced' end as model,
  800 + event_id % 50 as input_tokens, 100 + event_id % 7 as output_tokens,
  case event_type when 'error' then 'google' when 'view' then 'perplexity' else '' end as provider,
  cast(event_id % 16 as double) / 4 as seconds
from events""",
    "prices": """
select model, cast(pin as double) as input, cast(pout as double) as output
from (values ('gpt-5-mini', 0.25, 2.0), ('gpt-4o', 2.5, 10.0)) as t(model, pin, pout)""",
    "batches": """
select p_brand as batch, case p_type when 'ECONOMY' then 'gpt-5-mini' when 'PROMO' then 'gpt-4o' else 'unpriced' end as model,
  count(*) as num_rows
from part group by 1, 2""",
    "attribute_texts": """
select idx,
  case idx % 7 when 0 then 'SS' when 1 then ' Teflon ' when 2 then 'St. Steel' when 3 then 'nan' when 4 then 'ALU' when 5 then description else '' end as material,
  case idx % 5 when 0 then 'npt' when 1 then ' Bspt' when 2 then 'm10x' when 3 then '' else 'Metric' end as thread,
  case idx % 3 when 0 then ' Red ' when 1 then 'NaN' else 'BLUE/green' end as color,
  case idx % 6 when 0 then concat(cast(p_size as varchar(10)), '/8in') when 1 then concat(cast(p_size as varchar(10)), '/4')
    when 2 then concat(cast(p_size as varchar(10)), ' Inches') when 3 then concat(cast(p_size as varchar(10)), ' millimeter x')
    when 4 then concat(cast(p_size as varchar(10)), '/0') else concat(cast(p_size as varchar(10)), ' Centimeters') end as size_text
from items""",
    "learned": """
select distinct concat(p_brand, ' Inc.') as value, lower(p_brand) as canonical from part""",
    # every second item at most, from all rows
    "finished": "select distinct l_partkey * 2 as idx from lineitem",
}

LINES_SPARK = r"select doc_id * 1000000 + pos as pos, line from documents lateral view posexplode(split(text, '\n')) as pos, line"
LINES_DUCK = """select doc_id * 1000000 + i - 1 as pos, line from (select doc_id,
  unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)"""
WORDS_SPARK = r"select distinct word from documents lateral view explode(split(lower(text), '[^\\p{L}\\p{N}_]+')) as word where word <> ''"
WORDS_DUCK = r"select distinct word from (select unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) as word from documents) where word <> ''"


def _uses(body: str, known: list[str]) -> list[str]:
    return [n for n in known if re.search(rf"\b(from|join)\s+{n}\b", body)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived one, as a lazy DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = {"lines": LINES_SPARK, "words": WORDS_SPARK}.get(name) or BODIES[name]
    for dep in _uses(body, BASE + list(BODIES)):
        table(spark, sf_dir, dep).createOrReplaceTempView(dep)
    return spark.sql(body)


def with_tables(*names: str) -> list[str]:
    """DuckDB CTEs of derived tables in dependency order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        body = {"lines": LINES_DUCK, "words": WORDS_DUCK}.get(name) or BODIES[name]
        for dep in _uses(body, list(BODIES)):
            add(dep)
        done.setdefault(name, f"{name} as ({body})")

    for n in names:
        add(n)
    return list(done.values())
