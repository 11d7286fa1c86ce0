"""Registered queries: text, keys, nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T
from quarry.operators import checks, evaluation
from quarry.plans.registry import Registry

R = Registry()
c = F.col


def _has_any(phrases: list[str], expr: str) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), '{p.lower().replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def _matches(patterns: list[str], expr: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, '{p}', 'is')" for p in patterns) + ")"


_WORDS = "(" + " OR ".join(rf"regexp_matches(lower(text), '\b{w}\b')" for w in rules.CONCEPTUAL_WORDS) + ")"
_ANALYTICAL = f"({_has_any(rules.ANALYTICAL_PHRASES, 'text')} OR {_matches(rules.ANALYTICAL_PATTERNS, 'text')})"
ROUTE_SQL = (
    f"CASE WHEN trim(coalesce(text, '')) = '' THEN 'concept' WHEN {_ANALYTICAL} AND {_WORDS} THEN 'ambiguous' WHEN {_ANALYTICAL} THEN 'analytical' "
    f"WHEN {_matches(rules.SOLUTION_PATTERNS, 'text')} THEN 'solution_lookup' WHEN {_has_any(rules.SUMMARY_PHRASES, 'text')} THEN 'summary_request' ELSE 'concept' END"
)


@R.query("classify_query", f"SELECT conv_id, turn, {ROUTE_SQL} AS route FROM conversations WHERE role = 'user'")
def classify_query(t) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", T.classify(c("text")).alias("route"))


@R.query(
    "matched_phrases",
    "SELECT conv_id, turn, array_to_string([x FOR x IN ['the', 'in ', 'ver', 'que', 'ion'] IF contains(lower(text), x)], '|') AS phrases FROM conversations",
)
def matched_phrases(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(T.matched_phrases(c("text"), ["the", "in ", "ver", "que", "ion"]), "|").alias("phrases"))


@R.query(
    "parse_ref",
    r"SELECT page_id, try_cast(nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS INT) AS page, try_cast(nullif(regexp_extract(url, '/(\d+)', 1), '') AS INT) AS item, nullif(regexp_extract(url, 'example\.com/([a-z]{2})/', 1), '') AS lang FROM pages",
)
def parse_ref(t) -> DataFrame:
    lang = F.nullif(F.regexp_extract("url", r"example\.com/([a-z]{2})/", 1), F.lit(""))
    return t.pages.select("page_id", T.first_int(c("url"), r"page=(\d+)").alias("page"), T.first_int(c("url"), r"/(\d+)").alias("item"), lang.alias("lang"))


@R.query(
    "strand_variant_a",
    r"SELECT slug, CASE WHEN regexp_matches(slug, '^.+?-[0-9]+(-|$)') THEN regexp_extract(slug, '^(.+?)-[0-9]+(-|$)', 1) ELSE slug END AS strand, count(*) AS n FROM (SELECT lower(p_type) || '-' || p_size || '-' || replace(p_name, ' ', '-') AS slug FROM part) GROUP BY 1, 2",
)
def strand_variant_a(t) -> DataFrame:
    slug = F.concat(F.lower("p_type"), F.lit("-"), c("p_size").cast("string"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return t.part.select(slug.alias("slug")).groupBy("slug", T.strand_before_number(c("slug")).alias("strand")).agg(F.count("*").alias("n"))


@R.query(
    "strand_variant_b",
    "SELECT slug, CASE WHEN slug LIKE 'small-ring-%' THEN 'small-ring' WHEN slug LIKE 'blue-bolt-%' THEN 'blue-bolt' WHEN slug LIKE 'small-%' THEN 'small' WHEN slug LIKE 'blue-%' THEN 'blue' END AS strand, count(*) AS n FROM (SELECT replace(p_name, ' ', '-') || '-' || p_size AS slug FROM part) GROUP BY 1, 2",
)
def strand_variant_b(t) -> DataFrame:
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), c("p_size").cast("string"))
    return t.part.select(slug.alias("slug")).groupBy("slug", T.strand_by_prefix(c("slug"), ["small", "blue", "small-ring", "blue-bolt"]).alias("strand")).agg(F.count("*").alias("n"))


@R.query("strand_variant_c", "SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'red' WHEN p_name LIKE 'small %' THEN 'small' ELSE 'unknown' END AS strand FROM part")
def strand_variant_c(t) -> DataFrame:
    return t.part.select("p_partkey", T.strand_by_prefix(F.replace("p_name", F.lit(" "), F.lit("-")), ["red", "small"], F.lit("unknown")).alias("strand"))


def _normal(expr: str) -> str:
    out = f"lower(trim({expr}))"
    for a, b in rules.SYMBOLS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return rf"regexp_replace({out}, '\s+', ' ', 'g')"


@R.query("normalise_text", f"SELECT conv_id, turn, {_normal('text')} AS query FROM conversations")
def normalise_text(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.normalise_query(c("text")).alias("query"))


@R.query("cache_key", f"SELECT conv_id, turn, sha256({_normal('text')} || chr(1) || role || chr(1) || 'm' || chr(1) || 'a,b') AS cache_key FROM conversations")
def cache_key(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.cache_key(c("text"), c("role"), F.lit("m"), F.array(F.lit("b"), F.lit("a"))).alias("cache_key"))


@R.query("truncate_snippet", "SELECT doc_id, CASE WHEN length(trim(text)) > 80 THEN rtrim(substr(trim(text), 1, 79)) || '…' ELSE trim(text) END AS snippet FROM documents")
def truncate_snippet(t) -> DataFrame:
    return t.documents.select("doc_id", T.shorten(c("text"), 80).alias("snippet"))


def _cut_sql(mark: str, length: int) -> str:
    at = f"(length(h) - instr(reverse(h), reverse({mark})) - {length} + 2)"
    return f"WHEN instr(h, {mark}) > 0 AND {at} - 1 > 200 THEN rtrim(substr(h, 1, {at} - 1)) "


@R.query(
    "cut_at_section",
    "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text " + _cut_sql("chr(10) || '## '", 4) + _cut_sql("chr(10) || chr(10)", 2) + _cut_sql("chr(10)", 1) + "ELSE h END AS cut FROM (SELECT doc_id, text, substr(text, 1, 400) AS h FROM documents)",
)
def cut_at_section(t) -> DataFrame:
    return t.documents.select("doc_id", T.cut_at_section(c("text"), 400).alias("cut"))


@R.query(
    "capped_join",
    "WITH RECURSIVE l AS (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS parts FROM documents), "
    "r AS (SELECT doc_id, parts, 0 AS k, '' AS out FROM l UNION ALL SELECT doc_id, parts, k + 1, CASE WHEN out = '' THEN parts[k + 1] ELSE out || chr(10) || parts[k + 1] END FROM r "
    "WHERE k < len(parts) AND length(CASE WHEN out = '' THEN parts[k + 1] ELSE out || chr(10) || parts[k + 1] END) <= 600) SELECT doc_id, arg_max(out, k) AS joined FROM r GROUP BY 1",
)
def capped_join(t) -> DataFrame:
    return t.documents.select("doc_id", T.join_capped(F.split("text", "\n"), 600).alias("joined"))


_STOP = "(" + ", ".join(f"'{w}'" for w in rules.REWRITE_STOPWORDS) + ")"
_TOKENS = rf"len([x FOR x IN [regexp_replace(w, '[^\p{{L}}\p{{N}}_'']+', '', 'g') FOR w IN regexp_split_to_array(lower(text), '\s+')] IF x <> '' AND x NOT IN {_STOP}])"


@R.query("rewrite_gate", rf"SELECT conv_id, turn, {_TOKENS}::BIGINT AS n_tokens, (regexp_matches(text, '\$[^$]+\$') OR {_has_any(rules.DOMAIN_GLYPHS, 'text')} OR {_has_any(rules.DOMAIN_WORDS, 'text')}) AS domain FROM conversations")
def rewrite_gate(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.rewrite_tokens(c("text")).cast("long").alias("n_tokens"), T.in_domain_language(c("text")).alias("domain"))


@R.query(
    "rewrite_firing",
    f"SELECT conv_id, turn, coalesce({ROUTE_SQL} = 'concept' AND {_TOKENS} <= 6 AND trim(text) <> '' AND NOT (regexp_matches(text, '\\$[^$]+\\$') OR {_has_any(rules.DOMAIN_GLYPHS, 'text')} OR {_has_any(rules.DOMAIN_WORDS, 'text')}), false) AS fallback FROM conversations",
)
def rewrite_firing(t) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.should_rewrite_after_miss(c("text"), T.classify(c("text"))).alias("fallback"))


@R.query(
    "difficulty_tier",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR n > 5 THEN 'auto-hard' WHEN year(o_orderdate) >= 2022 OR n >= 2 THEN 'auto-medium' ELSE 'auto-easy' END AS tier FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
)
def difficulty_tier(t) -> DataFrame:
    refs = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    sitting = F.when(c("o_orderstatus") == "P", "df").otherwise("main")
    tier = T.reference_difficulty(F.when(c("n") > 5, "df").otherwise(sitting), F.least(c("n"), F.lit(2)), F.year("o_orderdate"))
    return t.orders.join(refs, "o_orderkey").select("o_orderkey", tier.alias("tier"))


@R.query("phrasing_tier", "SELECT doc_id, CASE WHEN lang = 'induction' THEN 'auto-hard' WHEN length(text) > 60 THEN 'auto-medium' ELSE 'auto-easy' END AS tier FROM documents")
def phrasing_tier(t) -> DataFrame:
    return t.documents.select("doc_id", T.phrasing_difficulty(c("text"), c("lang")).alias("tier"))


@R.query("subnet_key", "SELECT '10.' || (user_id % 256) || '.' || (user_id // 7) || '.0/24' AS subnet, count(*) AS n FROM events GROUP BY 1")
def subnet_key(t) -> DataFrame:
    ip = F.concat_ws(".", F.lit("10"), (c("user_id") % 256).cast("string"), F.floor(c("user_id") / 7).cast("string"), F.lit("9"))
    return t.events.groupBy(T.subnet(ip).alias("subnet")).agg(F.count("*").alias("n"))


@R.query("json_extract", "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing FROM events")
def json_extract(t) -> DataFrame:
    parsed = F.from_json("props", "k long, missing string")
    return t.events.select("event_id", parsed.k.alias("k"), parsed.missing.alias("missing"))


@R.query("variant_extract", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def variant_extract(t) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.sum(F.variant_get(F.parse_json("props"), "$.k", "long")).alias("total"))


_TOK = "[x FOR x IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF x <> '']"


@R.query(
    "array_ops",
    f"WITH w AS (SELECT doc_id, lang, source, {_TOK} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, len(list_intersect(w, ['the', 'der', 'la', 'en']))::BIGINT AS n_common, array_to_string(w[1:3], ' ') AS first_words, array_to_string([lang, source], ',') AS tags FROM w",
)
def array_ops(t) -> DataFrame:
    w = t.documents.select("doc_id", "lang", "source", T.tokens(c("text")).alias("w"))
    common = F.array(*map(F.lit, ["the", "der", "la", "en"]))
    return w.select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size(F.array_intersect("w", common)).cast("long").alias("n_common"),
        F.array_join(F.slice("w", 1, 3), " ").alias("first_words"), F.array_join(F.array("lang", "source"), ",").alias("tags"),
    )


@R.query("token_df", f"WITH w AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS token FROM documents) SELECT token, count(*) AS n_docs FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def token_df(t) -> DataFrame:
    return evaluation.token_frequency(t.documents, "doc_id", T.tokens(c("text"))).orderBy(F.desc("n_docs"), "token").limit(50)


@R.query("slugify", "SELECT s_suppkey, regexp_replace(replace(lower(trim(s_name)), ' ', '-'), '[^a-z0-9_-]', '', 'g') AS slug FROM supplier")
def slugify(t) -> DataFrame:
    return t.supplier.select("s_suppkey", T.slugify(c("s_name")).alias("slug"))


@R.query(
    "manifest_classify",
    r"SELECT CASE WHEN regexp_matches(url, '\?.*page=') THEN 'paged' WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'translated' WHEN regexp_matches(url, '/\d+$') THEN 'item' ELSE 'none' END AS category, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1",
)
def manifest_classify(t) -> DataFrame:
    u = c("url")
    category = T.first_match([(u.rlike(r"\?.*page="), "paged"), (u.rlike("/(de|fr|es)/"), "translated"), (u.rlike(r"/\d+$"), "item")], F.lit("none"))
    return t.pages.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@R.query("clock_format", "SELECT event_id, '**[' || lpad(((epoch_us(ts) // 1000000) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(((epoch_us(ts) // 1000000) % 60)::VARCHAR, 2, '0') || ']** ' || event_type AS line FROM events")
def clock_format(t) -> DataFrame:
    return t.events.select("event_id", F.concat(T.clock(F.unix_seconds(c("ts").cast("timestamp")) % 3600), F.lit(" "), "event_type").alias("line"))


@R.query("placeholders", "SELECT p_type, p_type IN ('TBD', 'tbd', '???', 'TODO', 'FIXME', 'XXX') AS is_placeholder, count(*) AS n FROM part GROUP BY 1, 2")
def placeholders(t) -> DataFrame:
    return t.part.groupBy("p_type", T.is_placeholder(c("p_type")).alias("is_placeholder")).agg(F.count("*").alias("n"))


@R.query("dangling_links", "SELECT l_orderkey AS key, 'parts' AS field, l_partkey::VARCHAR AS link, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 48) GROUP BY 1, 2, 3")
def dangling_links(t) -> DataFrame:
    rows = t.lineitem.select(c("l_orderkey").alias("key"), F.array(c("l_partkey").cast("string")).alias("parts"))
    known = t.part.where("p_size <= 48").select(c("p_partkey").cast("string").alias("slug"))
    return checks.dangling(rows, "key", ["parts"], known, "slug").groupBy("key", "field", "link").agg(F.count("*").alias("n"))


@R.query("sorted_json", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS json FROM events")
def sorted_json(t) -> DataFrame:
    return t.events.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json"))


@R.query("chunk_offsets", "SELECT doc_id, k AS chunk, k * 900 AS offset_seconds FROM (SELECT doc_id, unnest(range(0, n_chars // 5000 + 1)) AS k FROM documents)")
def chunk_offsets(t) -> DataFrame:
    each = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(c("n_chars") / 5000))).alias("chunk"))
    return each.withColumn("offset_seconds", c("chunk") * rules.AUDIO_CHUNK_SECONDS)
