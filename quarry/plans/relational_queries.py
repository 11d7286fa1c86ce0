"""Registered queries: projections, joins, aggregations, set operations, merges, and the semantic layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluation, merge, ordered, parts
from quarry.plans.registry import Registry
from quarry.plans.semantic import Item, Model, View

R = Registry()
c = F.col

#: The rules of the driver's parts, tried in order.
PART_RULES = [("ring", "ring"), ("eco", "economy"), ("bolt", "bolt"), ("small", "small"), ("blue", "blue"), ("pro", "promo")]


def _rule_sql(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} ILIKE '%{p}%' THEN '{s}'" for p, s in PART_RULES) + " END"


def _strands(part: DataFrame) -> DataFrame:
    named = F.concat_ws(",", "p_name", "p_type")
    own = T.first_match([(T.contains_any(named, [p]), s) for p, s in PART_RULES])
    return parts.with_sibling_fallback(part, own, ("p_brand", "p_size"), "strand")


STRAND_SQL = f"SELECT *, coalesce(own, max(own) OVER (PARTITION BY p_brand, p_size), 'uncategorised') AS strand FROM (SELECT *, {_rule_sql("concat_ws(',', p_name, p_type)")} AS own FROM part)"


@R.query("strand_flat", f"SELECT p_partkey, p_brand, p_size, strand FROM ({STRAND_SQL})")
def strand_flat(t) -> DataFrame:
    return _strands(t.part).select("p_partkey", "p_brand", "p_size", "strand")


@R.query("paper_strand_key", f"SELECT p_size || ':' || strand AS strand_key, count(*) AS n FROM ({STRAND_SQL}) GROUP BY 1")
def paper_strand_key(t) -> DataFrame:
    return _strands(t.part).groupBy(F.concat(c("p_size").cast("string"), F.lit(":"), c("strand")).alias("strand_key")).agg(F.count("*").alias("n"))


@R.query(
    "flags_text",
    "SELECT doc_id, coalesce(text, '') ILIKE '%ing%' OR coalesce(source, '') ILIKE '%src1%' AS is_flagged, coalesce(text, '') ILIKE 'the %' OR coalesce(text, '') ILIKE '%verify%' AS has_proof FROM documents",
)
def flags_text(t) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", (T.contains_any(c("text"), ["ing"]) | T.contains_any(c("source"), ["src1"])).alias("is_flagged"), (low.startswith("the ") | T.contains_any(c("text"), ["verify"])).alias("has_proof"))


@R.query("recent_flag", "SELECT o_orderkey, year(o_orderdate) >= 1999 AS is_recent FROM orders")
def recent_flag(t) -> DataFrame:
    return t.orders.select("o_orderkey", (F.year("o_orderdate") >= 1999).alias("is_recent"))


@R.query(
    "by_tag_explode",
    "WITH e AS (SELECT doc_id, unnest(list_distinct([source, lang, source || '-' || lang])) AS tag FROM documents) "
    "SELECT tag, CASE WHEN tag LIKE 'src1-%' THEN 'src1' WHEN tag LIKE 'src2-%' THEN 'src2' ELSE 'uncategorised' END AS tag_strand, count(*) AS n FROM e GROUP BY 1, 2",
)
def by_tag_explode(t) -> DataFrame:
    tags = F.array_distinct(F.array("source", "lang", F.concat_ws("-", "source", "lang")))
    each = t.documents.select("doc_id", F.explode(tags).alias("tag"))
    return each.groupBy("tag", T.strand_by_prefix(c("tag"), ["src1", "src2"], F.lit("uncategorised")).alias("tag_strand")).agg(F.count("*").alias("n"))


@R.query(
    "strand_growth",
    "WITH j AS (SELECT c_mktsegment AS s, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey), "
    "r AS (SELECT s, count(*) AS recent FROM j WHERE y BETWEEN 1998 AND 2001 GROUP BY s), p AS (SELECT s, count(*) AS prior FROM j WHERE y BETWEEN 1995 AND 1997 GROUP BY s) "
    "SELECT coalesce(r.s, p.s) AS segment, coalesce(p.prior, 0) AS prior_orders, coalesce(r.recent, 0) AS recent_orders, coalesce(r.recent, 0) - coalesce(p.prior, 0) AS delta FROM r FULL OUTER JOIN p USING (s)",
)
def strand_growth(t) -> DataFrame:
    # Counts of both eras in one scan, summed by customer before the join, whose exchange they share.
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    d = c("o_orderdate")
    recent, prior = d.between(at("1998-01-01"), at("2001-12-31 23:59:59.999999")), d.between(at("1995-01-01"), at("1997-12-31 23:59:59.999999"))
    by_customer = t.orders.where(recent | prior).groupBy("o_custkey").agg(F.count_if(prior).alias("p"), F.count_if(recent).alias("r"))
    joined = by_customer.join(t.customer, c("o_custkey") == c("c_custkey"))
    sums = joined.groupBy(c("c_mktsegment").alias("segment")).agg(F.sum("p").alias("prior_orders"), F.sum("r").alias("recent_orders"))
    return sums.withColumn("delta", c("recent_orders") - c("prior_orders"))


@R.query(
    "era_outer_join",
    "WITH r AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1), p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) "
    "SELECT k AS o_custkey, coalesce(p.n, 0) AS prior_orders, coalesce(r.n, 0) AS recent_orders FROM r FULL OUTER JOIN p USING (k)",
)
def era_outer_join(t) -> DataFrame:
    era = lambda test, n: t.orders.where(test).groupBy("o_custkey").agg(F.count("*").alias(n))
    d = c("o_orderdate")
    p, r = era(d < F.lit("1996-01-01").cast("timestamp_ntz"), "prior_orders"), era(d >= F.lit("1998-01-01").cast("timestamp_ntz"), "recent_orders")
    return p.join(r, "o_custkey", "full_outer").na.fill(0, ["prior_orders", "recent_orders"])


@R.query("count_filtered", "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderstatus = 'F' AND (o_orderpriority ILIKE '%high%' OR o_orderpriority ILIKE '%urgent%')")
def count_filtered(t) -> DataFrame:
    era = (c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return t.orders.where(era & (c("o_orderstatus") == "F") & (c("o_orderpriority").ilike("%high%") | c("o_orderpriority").ilike("%urgent%"))).agg(F.count("*").alias("n"))


@R.query("count_by_year", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def count_by_year(t) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


@R.query("avg_and_count", "SELECT round(avg(p_retailprice), 4) AS avg_price, count(*) AS n FROM part WHERE p_name ILIKE '%o%t%'")
def avg_and_count(t) -> DataFrame:
    return t.part.where(c("p_name").ilike("%o%t%")).agg(F.round(F.avg("p_retailprice"), 4).alias("avg_price"), F.count("*").alias("n"))


@R.query("pivot_count_if", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS o_orders FROM orders GROUP BY 1")
def pivot_count_if(t) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(c("o_orderstatus") == "F").alias("f_orders"), F.count_if(c("o_orderstatus") == "O").alias("o_orders"))


@R.query("avg_per_year_appeared", "SELECT o_orderpriority, count(*) AS total, count(DISTINCT year(o_orderdate)) AS years, count(*)::DOUBLE / count(DISTINCT year(o_orderdate)) AS per_year FROM orders GROUP BY 1")
def avg_per_year_appeared(t) -> DataFrame:
    by_year = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return by_year.groupBy("o_orderpriority").agg(F.sum("n").alias("total"), F.count("y").alias("years")).withColumn("per_year", c("total").cast("double") / c("years"))


@R.query("top_cited", "SELECT l_partkey, count(*) AS citations FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_cited(t) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("citations")).orderBy(F.desc("citations"), "l_partkey").limit(10)


@R.query("heavy_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity >= 45 AND l_returnflag = 'R' AND l_discount < 0.05")
def heavy_filter(t) -> DataFrame:
    return t.lineitem.where((c("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (c("l_quantity") >= 45) & (c("l_returnflag") == "R") & (c("l_discount") < 0.05)).select("l_orderkey", "l_linenumber", "l_quantity")


def line_model(t) -> Model:
    lines = View(
        "lines",
        lambda: t.lineitem,
        {"flag": Item(lambda: c("l_returnflag"), ("return flag",)), "status": Item(lambda: c("l_linestatus"))},
        {
            "line_count": Item(lambda: F.count("*"), ("how many lines",)),
            "total_quantity": Item(lambda: F.sum("l_quantity"), ("quantity in total",)),
            "avg_quantity": Item(lambda: F.round(F.avg("l_quantity"), 6), ("average quantity",)),
            "orders": Item(lambda: F.countDistinct("l_orderkey")),
            "discounted": Item(lambda: F.count_if(c("l_discount") > 0.05), ("discounted lines",)),
        },
    )
    return Model({"lines": lines})


@R.query(
    "semantic_measures",
    "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS line_count, sum(l_quantity) AS total_quantity, round(avg(l_quantity), 6) AS avg_quantity, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1, 2",
)
def semantic_measures(t) -> DataFrame:
    return line_model(t).query(["line_count", "total_quantity", "avg_quantity", "orders", "discounted"], ["flag", "status"])


@R.query("semantic_answer", "SELECT l_returnflag AS flag, round(avg(l_quantity), 6) AS avg_quantity FROM lineitem GROUP BY 1")
def semantic_answer(t) -> DataFrame:
    return line_model(t).answer("What is the average quantity by return flag?")


@R.query("share_of_total", "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def share_of_total(t) -> DataFrame:
    return ordered.share_of_total(t.orders, "o_orderpriority")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@R.query("union_checks", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in TABLES) + " UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment) FROM customer")
def union_checks(t) -> DataFrame:
    out = t.customer.agg(F.countDistinct("c_mktsegment").alias("n")).select(F.lit("segments").alias("name"), "n")
    for n in TABLES:
        out = out.unionByName(t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n"))
    return out


@R.query("minus_orphans", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def minus_orphans(t) -> DataFrame:
    """Customers without an urgent order."""
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey")))


@R.query("semi_valid_refs", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def semi_valid_refs(t) -> DataFrame:
    valid = t.part.where("p_size > 25").select(c("p_partkey").alias("l_partkey"))
    return t.lineitem.join(valid, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@R.query("anti_dead_refs", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def anti_dead_refs(t) -> DataFrame:
    return t.lineitem.join(t.part.where("p_size <= 45").select(c("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@R.query(
    "group_rejoin_set",
    "WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderpriority, coalesce(len(parts), 0) AS n_parts, coalesce(array_to_string(parts, ','), '') AS parts FROM orders LEFT JOIN s ON o_orderkey = l_orderkey",
)
def group_rejoin_set(t) -> DataFrame:
    sets = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("s"))
    joined = t.orders.select("o_orderkey", "o_orderpriority").join(sets, "o_orderkey", "left")
    return joined.select("o_orderkey", "o_orderpriority", F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n_parts"), F.coalesce(F.array_join(c("s").cast("array<string>"), ","), F.lit("")).alias("parts"))


@R.query("left_outer_default", "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def left_outer_default(t) -> DataFrame:
    # Nations are one row a country.
    known = F.broadcast(t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name"))
    return t.supplier.join(known, c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


def _staging(part: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    target = part.where("p_size <= 30").select(c("p_partkey").alias("key"), c("p_name").alias("name"), c("p_size").alias("size"), (c("p_size") > 10).alias("curated"))
    staging = extra.where("p_size >= 20").select(c("p_partkey").alias("key"), F.when(c("p_size") != 25, F.upper("p_name")).alias("name"), (c("p_size") + 1).alias("size"), F.lit(False).alias("curated"))
    return target, staging


MERGE_SQL = (
    "WITH t AS (SELECT p_partkey AS key, p_name AS name, p_size AS size, p_size > 10 AS curated FROM part WHERE p_size <= 30), "
    "s AS (SELECT p_partkey AS key, CASE WHEN p_size <> 25 THEN upper(p_name) END AS name, p_size + 1 AS size, false AS curated FROM part WHERE p_size >= 20) "
)


@R.query("merge_upsert", MERGE_SQL + "SELECT * FROM s UNION ALL SELECT * FROM t WHERE key NOT IN (SELECT key FROM s)")
def merge_upsert(t) -> DataFrame:
    return merge.upsert(*_staging(t.part, t.part), "key")


@R.query("merge_preserve", MERGE_SQL + "SELECT s.key, s.name, s.size, coalesce(t.curated, s.curated) AS curated FROM s LEFT JOIN t USING (key) UNION ALL SELECT * FROM t WHERE key NOT IN (SELECT key FROM s)")
def merge_preserve(t) -> DataFrame:
    return merge.upsert(*_staging(t.part, t.part), "key", keep=["curated"])


@R.query("merge_counts", MERGE_SQL + "SELECT count(*) FILTER (WHERE t.key IS NULL) AS inserted, count(*) FILTER (WHERE t.key IS NOT NULL) AS updated FROM s LEFT JOIN t USING (key)")
def merge_counts(t) -> DataFrame:
    return merge.merge_counts(*_staging(t.part, t.part), "key")


@R.query("merge_accumulate", "SELECT event_type, ts::DATE::VARCHAR AS day, round(sum(value), 4) AS spend FROM events GROUP BY 1, 2")
def merge_accumulate(t) -> DataFrame:
    daily = lambda test: t.events.where(test).select("event_type", F.to_date("ts").cast("string").alias("day"), c("value").alias("spend"))
    out = merge.accumulate(daily(c("user_id") < 20), daily(c("user_id") >= 20), ["event_type", "day"], "spend")
    return out.withColumn("spend", F.round("spend", 4))


@R.query("update_flags", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT c_acctbal > 9000")
def update_flags(t) -> DataFrame:
    live = merge.delete_where(t.customer, c("c_acctbal") > 9000)
    return merge.update_where(live, c("c_acctbal") < 0, {"c_mktsegment": F.lit("blocked")}).select("c_custkey", "c_mktsegment")


@R.query("contingency", "SELECT lang, count(*) FILTER (WHERE toxic = 0) AS \"0\", count(*) FILTER (WHERE toxic = 1) AS \"1\", count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def contingency(t) -> DataFrame:
    return evaluation.contingency(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), "lang", "toxic", ["0", "1"])


@R.query("dup_keys", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(t) -> DataFrame:
    return t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).where("n > 1")


@R.query("best_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def best_fit(t) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@R.query("percentile_floor", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS floor FROM events GROUP BY 1")
def percentile_floor(t) -> DataFrame:
    return evaluation.floor_percentile(t.events, "value", "event_type")


@R.query(
    "threshold_sweep",
    "WITH r AS (SELECT least(n_chars / 5000.0, 1.0)::DOUBLE AS s, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)), h AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold), "
    "a AS (SELECT threshold, count(*) FILTER (WHERE ok AND s >= threshold) AS tp, count(*) FILTER (WHERE NOT ok AND s >= threshold) AS fp FROM h, r GROUP BY 1) SELECT threshold, tp, fp, round(tp::DOUBLE / nullif(tp + fp, 0), 3) AS \"precision\" FROM a",
)
def threshold_sweep(t) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return evaluation.threshold_sweep(rows, F.least(c("n_chars") / 5000.0, F.lit(1.0)), c("quality") == 1)


@R.query(
    "stratified_sample",
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS wave FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY wave, source, doc_id) AS place FROM w) "
    "SELECT doc_id, lang, source, wave, place FROM p WHERE place <= CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 ELSE 0 END",
)
def stratified_sample(t) -> DataFrame:
    return evaluation.stratified_sample(t.documents.select("doc_id", "lang", "source"), "doc_id", "lang", "source", {"en": 50, "de": 20}, 7)


@R.query("sample_per_group", "SELECT event_id, event_type, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || event_id), event_id) AS place FROM events) WHERE place <= 15")
def sample_per_group(t) -> DataFrame:
    return evaluation.sample_per_group(t.events.select("event_id", "event_type"), "event_id", "event_type", 15, 3)


@R.query(
    "quality_diagnostics",
    "SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN text IS NULL OR length(text) < 100 THEN 'short_text' END, CASE WHEN source NOT LIKE 'src%' THEN 'bad_source' END, CASE WHEN n_chars > 10000 THEN 'long_text' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'other_language' END]) AS rule FROM documents) WHERE rule IS NOT NULL GROUP BY 1",
)
def quality_diagnostics(t) -> DataFrame:
    from quarry.operators.checks import diagnostics

    tests = {"short_text": c("text").isNull() | (F.length("text") < 100), "bad_source": ~c("source").like("src%"), "long_text": c("n_chars") > 10000, "other_language": ~c("lang").isin("en", "de")}
    return diagnostics(t.documents, "doc_id", tests).groupBy("rule").agg(F.count("*").alias("n"))


@R.query("distinct_brands", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_brands(t) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@R.query(
    "union_sources",
    "SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, NULL::VARCHAR AS note FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_name FROM supplier",
)
def union_sources(t) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("source"), c("c_custkey").alias("key"), c("c_acctbal").alias("balance"))
    b = t.supplier.select(F.lit("supplier").alias("source"), c("s_suppkey").alias("key"), c("s_acctbal").alias("balance"), c("s_name").alias("note"))
    return a.unionByName(b, allowMissingColumns=True)


@R.query("ir_firing_matrix", "SELECT role, CASE WHEN length(text) < 60 THEN 'iter1' WHEN length(text) < 200 THEN 'fallback' ELSE 'none' END AS mechanism, count(*) AS n FROM conversations GROUP BY 1, 2")
def ir_firing_matrix(t) -> DataFrame:
    return t.conversations.groupBy("role", F.when(F.length("text") < 60, "iter1").when(F.length("text") < 200, "fallback").otherwise("none").alias("mechanism")).agg(F.count("*").alias("n"))


@R.query("token_estimate", "SELECT role, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, round(sum(greatest(1, length(text) // 4)) * 3.0 / 1e6, 6) AS usd FROM conversations GROUP BY 1")
def token_estimate(t) -> DataFrame:
    tokens = F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    return t.conversations.groupBy("role").agg(tokens.cast("long").alias("tokens"), F.round(tokens * 3.0 / 1e6, 6).alias("usd"))


@R.query("row_number_dedupe", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def row_number_dedupe(t) -> DataFrame:
    best = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey"), F.struct("o_totalprice", -c("o_orderkey"))).alias("b"))
    return best.select("o_custkey", "b.o_orderkey")


@R.query("newest_first", "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 4")
def newest_first(t) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return t.orders.withColumn("place", F.row_number().over(w)).where("place <= 4").select("o_custkey", "o_orderkey", "place")


