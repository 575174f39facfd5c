"""The registered queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, itq, language, licenses, line_dedup, prefix_trie, resample, sharding, tool_calls, toxicity, weighted_minhash
from .common import cut, read, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary of op4 and of the pipeline's last stage.
VOCABULARY = "byte_bpe_50k.json"
SHARDS = 24


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), machine).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@register("op2_itq")
def op2_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_groups(read(spark, sf_dir, "embeddings"))


@register("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.clean(docs, removed="n_removed")
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return left.select("doc_id", n_lines.alias("n_lines"), "n_removed", "text")


@register("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary_path())


@register("op5_html")
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


@register(
    "op6_decontamination",
    r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS m, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM iw WHERE len(words) > 0)
), place AS (
  SELECT doc_id, m, i, array_to_string(words[i:i + m - 1], ' ') AS w
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i
        FROM dw CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(words) >= m)
), hit AS (
  SELECT DISTINCT doc_id, i, m, item_id FROM place JOIN win USING (m, w)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
""",
)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The tool of ``talk_with_tools``.
TOOLS = {"lookup": {"query": ("string", True), "turn": ("integer", True), "limit": ("integer", False)}}


def talk_with_tools(talk: DataFrame) -> DataFrame:
    """The turns of ``conversations``, and for each assistant turn a lookup made from it: a call and its result.

    The table has no tool calls of its own, so its assistant turns give them: the first word of the answer is the
    query, or every fifth turn the result of the lookup two turns before; every seventh has an argument the tool does not know,
    every eleventh lacks its query, every thirteenth has no result, and every third result stands before its call.
    """
    answer = talk.where(F.col("role") == "assistant")
    t = F.col("turn")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    query = F.when(t % 5 == 0, F.concat(F.lit("$"), name(t - 2))).otherwise(F.substring_index("text", " ", 1))
    call = F.struct(
        name(t).alias("id"),
        F.lit("lookup").alias("name"),
        F.struct(
            F.when(t % 11 != 0, query).alias("query"),
            t.alias("turn"),
            F.when(t % 7 != 0, t % 7).alias("limit"),
            F.when(t % 7 == 0, F.lit("all")).alias("unit"),
        ).alias("arguments"),
    )
    calls = answer.select("conv_id", (t * 4).alias("turn"), "role", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    result = F.struct(name(t).alias("tool_call_id"), F.length("text").cast("string").alias("content"))
    results = answer.where(t % 13 != 0).select(
        "conv_id", (t * 4 + F.when(t % 3 == 0, -1).otherwise(1)).alias("turn"), F.lit("tool").alias("role"), F.to_json(result).alias("text")
    )
    return talk.select("conv_id", (t * 4 + 2).alias("turn"), "role", "text").unionByName(calls).unionByName(results)


@register("op7_chat")
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(talk_with_tools(read(spark, sf_dir, "conversations")), TOOLS)


@register("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


@register("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign(docs, "doc_id", [1.0] * SHARDS, "shard")
    placed = sharding.assign(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    out = sharding.with_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@register("op10_minhash")
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.decide(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register(
    "op11_resample",
    r"""
WITH bit AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])),
      lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(0, 256)) AS b))
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), d1 AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM dw) GROUP BY ALL
), t1 AS (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w
), crc AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS b
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d1 UNION SELECT w FROM t1)) CROSS JOIN bit
), s AS (SELECT b, sum(n) AS s FROM d1 JOIN crc USING (w) GROUP BY b
), t AS (SELECT b, sum(n) AS t FROM t1 JOIN crc USING (w) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE)
    / ((s + 1) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b)
), weight AS (SELECT doc_id, sum(n * g) AS weight FROM d1 JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(words) AS n, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS score
  FROM dw LEFT JOIN weight USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n >= 20) AS m FROM scored
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n >= 20 AND r <= 10 * m // 100 THEN CAST(r AS BIGINT) END AS rank
FROM ranked
""",
)
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_language")
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    named = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return named.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def borrowed(placed: DataFrame) -> DataFrame:
    """(conv, pos, id, chars) of each conversation c rebuilt: its first h turns, h = crc32(c) mod 6, are those of conversation
    c - c mod 100, as many as that has. At most a hundred conversations borrow from one, five turns each."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(6))
    convs = placed.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    lenders = placed.where((F.col("conv") % 100 == 0) & (F.col("pos") < 6)).withColumnRenamed("conv", "base")
    lent = convs.where("h > 0").join(lenders, "base").where("pos <= h").select("conv", "pos", "id", "chars")
    own = placed.withColumn("h", h).where("pos > h")
    m = lent.groupBy("conv").agg(F.count(F.lit(1)).alias("m"))
    own = own.join(m, "conv", "left").select("conv", (F.col("pos") - F.col("h") + F.coalesce("m", F.lit(0))).alias("pos"), "id", "chars")
    return lent.unionByName(own)


@register(
    "op13_prefix_trie",
    r"""
WITH bit AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])),
      lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(0, 256)) AS b))
), placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM (SELECT DISTINCT conv_id FROM placed)) CROSS JOIN bit
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h
), step AS (
  SELECT conv_id, role, text, md5(len(role) || ':' || role || text) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM rebuilt
), path AS (
  SELECT conv_id, d, len(text) AS chars, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS k, max(d) OVER (PARTITION BY conv_id) = d AS ends
  FROM step
), node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS e
  FROM path GROUP BY k, d
), family AS (SELECT substr(k, 1, len(k) - 32) AS up, count(*) AS kids FROM node GROUP BY up
), leaf AS (SELECT n.k, n.conv_id, n.d FROM node n LEFT JOIN family f ON f.up = n.k WHERE f.up IS NULL
), leaves AS (SELECT substr(k, 1, 32 * u) AS k, count(*) AS n FROM (SELECT k, unnest(range(0, d + 1)) AS u FROM leaf) GROUP BY 1
), saved AS (SELECT substr(k, 1, 32 * u) AS k, sum((n - 1) * chars) AS s FROM (SELECT k, n, chars, unnest(range(0, d + 1)) AS u FROM node) GROUP BY 1
), root AS (
  SELECT '' AS k, 0 AS d, min(conv_id) AS conv_id, count(*) AS n,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (conv_id NOT IN (SELECT conv_id FROM step)) AS e
  FROM convs HAVING count(*) > 0
), every AS (SELECT k, d, conv_id, n, e FROM node UNION ALL SELECT k, d, conv_id, n, e FROM root)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(coalesce(f.kids, 0) AS BIGINT) AS n_children,
  CAST(coalesce(l.n, 1) AS BIGINT) AS n_leaves, CAST(coalesce(s.s, 0) AS BIGINT) AS saved_tokens, sha256(coalesce(v.e, '')) AS ends_sha256
FROM every v LEFT JOIN every p ON v.d > 0 AND p.k = substr(v.k, 1, len(v.k) - 32) LEFT JOIN family f ON f.up = v.k
LEFT JOIN leaves l ON l.k = v.k LEFT JOIN saved s ON s.k = v.k
""",
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    placed = cut(prefix_trie.place_turns(read(spark, sf_dir, "conversations"), folder), folder, "turns")
    convs = cut(placed.select("conv").distinct(), folder, "convs")
    turns = cut(borrowed(placed), folder, "borrowed")
    nodes, classes = prefix_trie.trie(turns, convs, folder)
    return prefix_trie.with_end_digests(nodes, prefix_trie.end_digests(classes, folder))
