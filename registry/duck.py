"""SQL fragments for DuckDB."""

from __future__ import annotations

from .fixtures import with_tables


def query(tables: list[str], ctes: dict[str, str] | None, final: str, recursive: bool = False) -> str:
    parts = with_tables(*tables) + [f"{k} as ({v})" for k, v in (ctes or {}).items()]
    head = f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + final


def blank(x: str) -> str:
    return f"({x} is null or trim({x}) = '' or lower({x}) = 'nan')"


def present(x: str) -> str:
    return f"(case when {x} is null or trim({x}) = '' or lower(trim({x})) = 'nan' then null else trim({x}) end)"


def fingerprint(x: str) -> str:
    words = rf"list_filter(string_split_regex(strip_accents(lower(trim({x}))), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
    return f"coalesce(array_to_string(list_sort(list_distinct({words})), ' '), '')"


def gram_text(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def grams(t: str) -> str:
    """Sorted distinct bigrams of a text that is already reduced to letters and digits."""
    return f"(case when length({t}) < 2 then [{t}] else list_sort(list_distinct(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)))) end)"


def singular(w: str) -> str:
    cut = lambda n: f"substr({w}, 1, length({w}) - {n})"
    return f"""(case when length({w}) <= 3 or {w} in ('series','species','glasses','pliers','scissors','headquarters') then {w}
      when {w} like '%ies' and length({w}) > 4 then {cut(3)} || 'y'
      when {w} like '%ves' and length({w}) > 4 then {cut(3)} || 'f'
      when {w} like '%es' then case when regexp_matches({cut(2)}, '(s|x|z|ch|sh)$') then {cut(2)} else {cut(1)} end
      when {w} like '%s' and {w} not like '%ss' then {cut(1)} else {w} end)"""


def singular_review(w: str) -> str:
    cut = lambda n: f"substr({w}, 1, length({w}) - {n})"
    return f"""(case when {w} like '%ies' and length({w}) > 4 then {cut(3)} || 'y' when {w} like '%ves' then {cut(3)} || 'f'
      when {w} like '%ses' and length({w}) > 4 then {cut(2)}
      when {w} like '%s' and {w} not like '%ss' then {cut(1)} else {w} end)"""


def clean_type(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower({x}), '\b(category|type|class)\b', '', 'g')), '\s+', ' ', 'g')"


def brand_suffix(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s*(inc\.?|ltd\.?|llc|corp\.?|co\.?|gmbh|ag|sa)$', ''))"


def type_rule(kind: str, x: str) -> str:
    return {"noun": singular(f"lower({x})"), "category": clean_type(x), "brand": brand_suffix(x), "generic": x}[kind]


def normalizer(p: str, source: str, column: str, order: str, kind: str, threshold: float = 0.85) -> dict[str, str]:
    """CTEs of the column normalizer; the last, ``{p}_map(value, canonical)``, is its mapping.

    Keys are compared pair by pair and leaders are found one key at a time."""
    return {
        f"{p}_counts": f"select trim({column}) as value, count(*) as n, min({order}) as pos from {source} where not {blank(column)} group by 1",
        f"{p}_valued": f"select *, {fingerprint('value')} as key from {p}_counts",
        f"{p}_keys": f"select key, min(pos) as kpos, row_number() over (order by min(pos)) - 1 as i from {p}_valued group by key",
        f"{p}_grams": f"select i, key, {grams('t')} as g from (select i, key, {gram_text('key')} as t from {p}_keys where key <> '')",
        f"{p}_nb": f"""select b.i as b, list(a.i order by a.i) as ns from {p}_grams a join {p}_grams b on a.i < b.i
          where len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= {threshold} group by b.i""",
        f"{p}_walk": f"""select cast(-1 as bigint) as i, cast([] as bigint[]) as leaders, cast(-1 as bigint) as lead
          union all
          select w.i + 1, case when x.l is null then list_append(w.leaders, w.i + 1) else w.leaders end, coalesce(x.l, w.i + 1)
          from {p}_walk w left join {p}_nb nb on nb.b = w.i + 1,
          lateral (select list_min(list_intersect(w.leaders, coalesce(nb.ns, cast([] as bigint[])))) as l) x
          where w.i + 1 < (select count(*) from {p}_keys)""",
        f"{p}_members": f"""select v.value, v.n, k.kpos, v.pos, w.lead from {p}_valued v join {p}_keys k on v.key = k.key
          join {p}_walk w on w.i = k.i""",
        f"{p}_best": f"""select lead, lower(first(value order by n desc, (value = lower(value)) desc, length(value), kpos, pos)) as form
          from {p}_members group by lead""",
        f"{p}_map": f"select m.value, {type_rule(kind, 'b.form')} as canonical from {p}_members m join {p}_best b on m.lead = b.lead",
    }


def mapped(column: str, alias: str) -> str:
    return f"case when {blank(column)} then '' else coalesce({alias}.canonical, {column}) end"


def item_key(noun: str, modifier: str, category_type: str) -> str:
    return f"lower(trim({noun})) || '|' || (case when {fingerprint(modifier)} <> '' then {fingerprint(modifier)} else {fingerprint(category_type)} end)"


def consensus(p: str, source: str, key: str, category: str) -> dict[str, str]:
    """CTEs ending in ``{p}_win(key, winner, ...)`` for clusters in which more than half agree."""
    return {
        f"{p}_n": f"select {key} as key, coalesce({category}, '') as category, count(*) as n from {source} group by 1, 2",
        f"{p}_votes": f"""select key, max(n) filter (where not {blank('category')}) as top, sum(n) filter (where not {blank('category')}) as voters,
          sum(n) as total, count(*) filter (where not {blank('category')}) as variants,
          arg_max(category, case when {blank('category')} then null else n end) as winner from {p}_n group by key""",
        f"{p}_win": f"select * from {p}_votes where total >= 2 and voters > 0 and top * 2 > voters",
    }


def sequence_sql(left: str, x: str, right: str, y: str, threshold: float, on: str = "true") -> dict[str, str]:
    """CTEs that end in near (x, y, similarity): the pairs of distinct texts whose sequence ratio in lower case reaches the threshold.

    The runs of equal characters of every pair are found once, by diagonal; the longest run of a segment is the longest
    one clipped to it, the first in x and then in y. The texts must have less than 200 characters."""
    letters = lambda t, c: f"select {c} as t, unnest(range(1, length({c}) + 1)) as p, substr(lower({c}), unnest(range(1, length({c}) + 1)), 1) as c from (select distinct {c} from {t})"
    clipped = "least(e, xh, yh - d) - greatest(r.i, xl, yl - d)"
    return {
        "xc": letters(left, x),
        "yc": letters(right, y),
        "two": f"""select l.{x} as x, r.{y} as y, length(l.{x}) as lx, length(r.{y}) as ly from {left} l join {right} r
          on {on} and 2 * least(length(l.{x}), length(r.{y})) >= {threshold} * (length(l.{x}) + length(r.{y}))""",
        "ties": "select x, y, xc.p as i, yc.p - xc.p as d from two join xc on xc.t = x join yc on yc.t = y and yc.c = xc.c",
        "runs": """select x, y, d, min(i) as i, max(i) + 1 as e from
          (select *, i - row_number() over (partition by x, y, d order by i) as island from ties) group by x, y, d, island""",
        "seg": f"""select x, y, cast(1 as bigint) as xl, cast(lx + 1 as bigint) as xh, cast(1 as bigint) as yl, cast(ly + 1 as bigint) as yh, cast(0 as bigint) as k from two
          union all
          select x, y, case when side = 0 then xl else i + n end, case when side = 0 then i else xh end,
            case when side = 0 then yl else i + d + n end, case when side = 0 then i + d else yh end, case when side = 0 then n else 0 end
          from (
            select x, y, xl, xh, yl, yh, (best).n as n, -(best).i as i, -(best).d as d from (
              select x, y, xl, xh, yl, yh, max({{'n': {clipped}, 'i': -greatest(r.i, xl, yl - d), 'd': -d}}) as best
              from seg join runs r using (x, y) where {clipped} > 0 group by x, y, xl, xh, yl, yh)
          ), (select unnest([0, 1]) as side)""",
        "near": f"""select x, y, similarity from (select x, y, 2.0 * sum(k) / any_value(lx + ly) as similarity from seg join two using (x, y) group by x, y)
          where similarity >= {threshold}""",
    }
