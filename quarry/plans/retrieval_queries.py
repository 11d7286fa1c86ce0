"""Registered queries: ranked retrieval and its evaluation.

Vector searches take as queries every vector whose id is divisible by 100,
against all vectors; text searches take every benchmark passage, against all
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.functions.stems import english_terms
from quarry.operators import evaluation as E
from quarry.operators import retrieval as V
from quarry.plans.registry import Registry
from quarry.sources.versions import materialize

R = Registry()
c = F.col

# --- vectors -----------------------------------------------------------------


def _asked(t) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0")


def _neighbours(t, k: int) -> DataFrame:
    """Each query's best k other vectors."""
    return V.without_self(V.dense_topk(_asked(t), t.embeddings, k, "vec_id", "embedding"), k)


def _cosine(a: str, b: str) -> str:
    return f"round(greatest(0.0, least(1.0, list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]))), 6)"


def _ranked_sql(k: int) -> str:
    return (
        f"WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS ql, d.label AS dl, {_cosine('q.embedding', 'd.embedding')} AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0), "
        f"n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}) "
    )


@R.query("dense_topk", _ranked_sql(5) + "SELECT query_id, doc_id, score, rank FROM n")
def dense_topk(t) -> DataFrame:
    return _neighbours(t, 5)


_HALVES = (
    f"WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, greatest({_cosine('q.embedding[1:32]', 'd.embedding[1:32]')}, {_cosine('q.embedding[33:64]', 'd.embedding[33:64]')}) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"
)


@R.query("dense_multi_field", _HALVES)
def dense_multi_field(t) -> DataFrame:
    part = lambda a, n: t.embeddings.select("vec_id", F.slice("embedding", a, n).alias("v"))
    fields = [V.dense_topk(x.where("vec_id % 100 = 0"), x, max(6 * 5, 25), "vec_id", "v") for x in (part(1, 32), part(33, 32))]
    return V.ranked(V.merge_fields(*fields), 5)


_METRICS = "count(*) AS n, 0::BIGINT AS errors, round(avg((rank <= 1)::INT), 6) AS p1, round(avg((rank <= 3)::INT), 6) AS p3, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(top1), 6) AS mean_top1, round(avg((top1 >= 0.3)::INT), 6) AS above_floor"
_ROWS = _ranked_sql(20) + ", r AS (SELECT q.vec_id AS query_id, q.label, min(n.rank) FILTER (WHERE n.dl = q.label) AS rank0, max(n.score) AS top1 FROM embeddings q JOIN n ON n.query_id = q.vec_id GROUP BY 1, 2), g AS (SELECT query_id, label, rank0, coalesce(rank0, 1000000) AS rank, top1 FROM r) "


def _golden_rows(t) -> DataFrame:
    """Queries with the best rank of a vector of their own label among 20."""
    near = _neighbours(t, 20)
    labelled = near.join(t.embeddings.select(c("vec_id").alias("doc_id"), c("label").alias("dl")), "doc_id")
    asked = _asked(t).select(c("vec_id").alias("query_id"), "label")
    best = labelled.join(asked, "query_id").where("dl = label").groupBy("query_id").agg(F.min("rank").alias("rank"))
    top = near.groupBy("query_id").agg(F.max("score").alias("top1"))
    return asked.join(best, "query_id", "left").join(top, "query_id", "left")


@R.query("best_rank", _ROWS + "SELECT query_id, label, rank0 AS rank, top1 FROM g")
def best_rank(t) -> DataFrame:
    return _golden_rows(t)


_M = _METRICS.replace("1.0 / rank", "1.0 / rank0")


@R.query("ir_metrics", _ROWS + f"SELECT {_M} FROM g")
def ir_metrics(t) -> DataFrame:
    return _golden_rows(t).agg(*E.metrics())


@R.query("ir_grouping_sets", _ROWS + f"SELECT 'overall' AS dimension, NULL::VARCHAR AS value, {_M} FROM g UNION ALL SELECT 'label', label::VARCHAR, {_M} FROM g GROUP BY label UNION ALL SELECT 'half', (label % 2)::VARCHAR, {_M} FROM g GROUP BY label % 2")
def ir_grouping_sets(t) -> DataFrame:
    return E.by_dimensions(_golden_rows(t).withColumn("half", c("label") % 2), ["label", "half"])


@R.query("weakest_labels", _ROWS + f"SELECT label, {_M} FROM g GROUP BY label HAVING count(*) >= 2 ORDER BY p1, label")
def weakest_labels(t) -> DataFrame:
    return _golden_rows(t).groupBy("label").agg(*E.metrics()).where(c("n") - c("errors") >= 2).orderBy("p1", "label")


@R.query("recall_at_k", _ROWS + "SELECT label, count(*) AS n, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 5)::INT), 6) AS recall_5, round(avg((rank <= 20)::INT), 6) AS recall_20 FROM g GROUP BY 1")
def recall_at_k(t) -> DataFrame:
    return E.recall_at(_golden_rows(t), [1, 5, 20], "label")


@R.query("gate_check", _ROWS + "SELECT round(round(avg((rank <= 1)::INT), 6), 3) >= 0.911 AS passes FROM g")
def gate_check(t) -> DataFrame:
    return _golden_rows(t).agg(*E.metrics()).select(E.gate(c("p1")).alias("passes"))


@R.query(
    "blend_score",
    _ranked_sql(20) + "SELECT query_id, doc_id, round(0.6 / (1 + exp(-(score * 4 - 2))) + 0.3 * score + 0.1 * (1.0 / rank), 6) AS blended FROM n",
)
def blend_score(t) -> DataFrame:
    near = _neighbours(t, 20)
    return near.select("query_id", "doc_id", F.round(S.blend(c("score") * 4 - 2, c("score"), 1.0 / c("rank")), 6).alias("blended"))


# --- text --------------------------------------------------------------------

_WORDS = "[x FOR x IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF length(x) > 1]"
_BM25 = f"""
WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS term FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS terms FROM documents),
s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
e AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM tf JOIN df USING (term), s),
b AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
"""
_TOP = "{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {of}) WHERE rank <= {k})"


def words(text: Column) -> Column:
    return F.filter(T.tokens(text), lambda w: F.length(w) > 1)


def _items(t) -> DataFrame:
    return t.benchmark.select(c("item_id").alias("query_id"), "text")


def _bm25(t, k: int) -> DataFrame:
    return V.bm25_topk(_items(t), t.documents.select("doc_id", "text"), words, k)


@R.query("bm25_topk", _BM25 + _TOP.format(name="r", of="b", k=5) + "SELECT query_id, doc_id, rank FROM r")
def bm25_topk(t) -> DataFrame:
    return _bm25(t, 5).select("query_id", "doc_id", "rank")


@R.query("bm25_norm", _BM25 + _TOP.format(name="r", of="b", k=5) + "SELECT query_id, rank, round(CASE WHEN max(score) OVER p - min(score) OVER p <= 0 THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END, 4) AS score FROM r WINDOW p AS (PARTITION BY query_id)")
def bm25_norm(t) -> DataFrame:
    return _bm25(t, 5).select("query_id", "rank", F.round(S.min_max(c("score"), "query_id"), 4).alias("score"))


@R.query("bm25_stemmed_topk")
def bm25_stemmed_topk(t) -> DataFrame:
    """By the stems of words that are no stop words; SQL has no stems, so small rows hold it against plain Python."""
    return V.bm25_topk(_items(t), t.documents.select("doc_id", "text"), english_terms, 5)


#: A second ranking: shared words of five letters and more, over the passage's.
_OVERLAP = "o AS (SELECT q.query_id, e.doc_id, count(DISTINCT term)::DOUBLE AS score FROM q JOIN e USING (term) WHERE length(term) >= 5 GROUP BY 1, 2),"


def _overlap(t, k: int) -> DataFrame:
    return V.overlap_topk(_items(t), t.documents.select("doc_id", "text"), lambda x: F.filter(words(x), lambda w: F.length(w) >= 5), k)


_FUSED = (
    _BM25 + _OVERLAP + _TOP.format(name="r1", of="b", k=50) + "," + _TOP.format(name="r2", of="o", k=50)
    + ", f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT query_id, doc_id, rank FROM r1 UNION ALL SELECT query_id, doc_id, rank FROM r2) GROUP BY 1, 2), h AS (SELECT query_id, doc_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM f), "
)


def _hybrid(t, k: int | None) -> DataFrame:
    return V.ranked(V.rrf(_bm25(t, rules.HYBRID_CANDIDATES), _overlap(t, rules.HYBRID_CANDIDATES)), k)


@R.query("rrf_fuse", _FUSED + "z AS (SELECT 1) SELECT query_id, doc_id, score FROM h")
def rrf_fuse(t) -> DataFrame:
    return _hybrid(t, None).select("query_id", "doc_id", "score")


@R.query("hybrid_topk", _FUSED + _TOP.format(name="r", of="h", k=5) + " SELECT query_id, doc_id, score, rank FROM r")
def hybrid_topk(t) -> DataFrame:
    return _hybrid(t, 5)


@R.query("fanin_dedupe", _BM25 + _OVERLAP + _TOP.format(name="r1", of="b", k=5) + "," + _TOP.format(name="r2", of="o", k=5) + ", u AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2), " + _TOP.format(name="r", of="u", k=5) + " SELECT query_id, doc_id, rank FROM r")
def fanin_dedupe(t) -> DataFrame:
    return V.fan_in([_bm25(t, 5), _overlap(t, 5)], 5).select("query_id", "doc_id", "rank")


@R.query("attr_filter_then_rank", _BM25 + "k AS (SELECT b.* FROM b JOIN documents USING (doc_id) WHERE lang = 'en' AND source = 'src0'), " + _TOP.format(name="r", of="k", k=5) + " SELECT query_id, doc_id, rank FROM r")
def attr_filter_then_rank(t) -> DataFrame:
    return V.bm25_topk(_items(t), t.documents, words, 5, keep=(c("lang") == "en") & (c("source") == "src0")).select("query_id", "doc_id", "rank")


def lexical_logit(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic scorer in the place of a cross-encoder: shared words, less their share missing."""
    out = []
    for q, d in zip(queries, texts, strict=True):
        a, b = set(q.lower().split()), set(d.lower().split())
        out.append(4.0 * len(a & b) / max(1, len(a)) - 2.0)
    return out


def _bag(expr: str) -> str:
    return rf"list_distinct([w FOR w IN regexp_split_to_array(lower({expr}), '\s+') IF w <> ''])"


@R.query(
    "rerank_pool",
    _FUSED + _TOP.format(name="pool", of="h", k=20)
    + f", x AS (SELECT pool.query_id, pool.doc_id, {_bag('i.text')} AS a, {_bag('substr(d.text, 1, 256)')} AS bag FROM pool JOIN benchmark i ON i.item_id = pool.query_id JOIN documents d ON d.doc_id = pool.doc_id), "
    "y AS (SELECT query_id, doc_id, round(1 / (1 + exp(-(4.0 * len(list_intersect(a, bag)) / greatest(1, len(a)) - 2.0))), 6) AS score FROM x), "
    + _TOP.format(name="r", of="y", k=5) + " SELECT query_id, doc_id, score, rank FROM r",
)
def rerank_pool(t) -> DataFrame:
    pool = _hybrid(t, 20)
    pairs = pool.select("query_id", "doc_id").join(_items(t).withColumnRenamed("text", "query_text"), "query_id").join(t.documents.select("doc_id", c("text").alias("doc_text")), "doc_id")
    return V.rerank(pool, pairs, lexical_logit, rules.TOP_K)


_ANY_WORDS = "[x FOR x IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF x <> '']"


def bm25_ctes(p: str, queries: str, docs: str = "true", tokens: str = _WORDS, k: int = 5) -> str:
    """CTEs, named with a prefix, up to the k best documents of each query."""
    steps = {
        "q": f"SELECT query_id, unnest(list_distinct({tokens})) AS term FROM ({queries})",
        "d": f"SELECT doc_id, {tokens} AS terms FROM documents WHERE {docs}",
        "s": f"SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {p}d",
        "e": f"SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM {p}d",
        "t": f"SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM {p}e WHERE term IN (SELECT term FROM {p}q) GROUP BY 1, 2",
        "f": f"SELECT term, count(*) AS df FROM {p}t GROUP BY 1",
        "w": f"SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM {p}t JOIN {p}f USING (term), {p}s",
        "b": f"SELECT query_id, doc_id, round(sum(w), 6) AS score FROM {p}q JOIN {p}w USING (term) GROUP BY 1, 2",
        "r": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}b) WHERE rank <= {k}",
    }
    return ", ".join(f"{p}{name} AS ({sql})" for name, sql in steps.items())


_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_SHORT = "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS text FROM benchmark"


@R.query(
    "rewrite_aware",
    f"WITH {bm25_ctes('p', _ITEMS)}, {bm25_ctes('r', _SHORT)}, f AS (SELECT item_id AS query_id, CASE WHEN length(text) < 200 THEN 'iter1' WHEN length(text) < 260 THEN 'fallback' ELSE 'none' END AS m FROM benchmark), "
    "c AS (SELECT f.query_id FROM f LEFT JOIN pr ON pr.query_id = f.query_id AND pr.rank = 1 LEFT JOIN rr ON rr.query_id = f.query_id AND rr.rank = 1 WHERE (m = 'iter1' AND coalesce(rr.score, -1) >= 0) OR (m = 'fallback' AND coalesce(pr.score, 0) < 0.3 AND coalesce(rr.score, -1) >= coalesce(pr.score, 0))) "
    "SELECT query_id, doc_id, rank FROM pr WHERE query_id NOT IN (SELECT query_id FROM c) UNION ALL SELECT query_id, doc_id, rank FROM rr WHERE query_id IN (SELECT query_id FROM c)",
)
def rewrite_aware(t) -> DataFrame:
    shorter = _items(t).withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, 12), " "))
    rewritten = V.bm25_topk(shorter, t.documents.select("doc_id", "text"), words, 5)
    firing = _items(t).select("query_id", F.when(F.length("text") < 200, "iter1").when(F.length("text") < 260, "fallback").otherwise("none").alias("mechanism"))
    return V.rewrite_aware(_bm25(t, 5), rewritten, firing).select("query_id", "doc_id", "rank")


_CONTENT = (
    "list_distinct([x FOR x IN [regexp_replace(y, '^[-:;!]+|[-:;!]+$', '', 'g') FOR y IN regexp_split_to_array(regexp_replace(translate(lower(coalesce(text, '')), '²³', '23'), '[?.,()''\"/\\\\]', ' ', 'g'), '\\s+')] "
    "IF length(x) >= 5 AND NOT regexp_matches(x, '^[0-9]+$'){}])"
)
_QUESTION = " AND x NOT IN (" + ", ".join(f"'{w}'" for w in rules.QUESTION_STOPWORDS) + ")"
_COMMON = "list_max(flatten([[CASE WHEN contains(b, substr(a, i, n)) THEN n ELSE 0 END FOR n IN range(0, length(a) - i + 2)] FOR i IN range(1, length(a) + 1)]))"


@R.query(
    "failure_buckets",
    f"WITH {bm25_ctes('p', _ITEMS, k=1)}, dt AS (SELECT doc_id, unnest({_CONTENT.format('')}) AS token FROM documents), f AS (SELECT token FROM dt GROUP BY 1 HAVING count(*) <= 2), "
    f"i AS (SELECT item_id AS query_id, {_CONTENT.format(_QUESTION)} AS q, 'item-' || item_id AS a FROM benchmark), "
    f"t AS (SELECT pr.query_id, doc_id, lang, concat_ws('-', source, lang, doc_id) AS b, {_CONTENT.format('')} AS d FROM pr JOIN documents USING (doc_id)), "
    "j AS (SELECT i.query_id, q, a, coalesce(b, '') AS b, doc_id, lang, coalesce(list_intersect(q, d), []) AS shared FROM i LEFT JOIN t USING (query_id)), "
    "r AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, unnest(shared) AS token FROM j) JOIN f USING (token) GROUP BY 1), "
    "z AS (SELECT CASE WHEN (len(shared) >= 2 OR coalesce(n, 0) >= 1) AND len([x FOR x IN q IF NOT list_contains(shared, x)]) = 0 THEN 'E' WHEN doc_id IS NULL THEN 'D' WHEN lang = 'en' THEN 'A' WHEN lang IS NOT NULL THEN 'B' "
    f"WHEN {_COMMON} >= 6 THEN 'C' ELSE 'F' END AS bucket FROM j LEFT JOIN r USING (query_id)) SELECT bucket, count(*) AS n FROM z GROUP BY 1",
)
def failure_buckets(t) -> DataFrame:
    """Of each passage: why the first document is not one that contains it."""
    items = _items(t).select("query_id", T.content_tokens(c("text"), 5, rules.QUESTION_STOPWORDS).alias("q"), F.concat(F.lit("item-"), "query_id").alias("slug"))
    # A few rows for each passage: written once, and met before texts are cut into tokens.
    top = materialize(_bm25(t, 1).where("rank = 1").select("query_id", "doc_id"), "first-documents")
    found = t.documents.join(top, "doc_id").select("query_id", "doc_id", "lang", T.content_tokens(c("text"), 5).alias("d"), F.concat_ws("-", "source", "lang", "doc_id").alias("doc_slug"))
    shared = F.coalesce(F.array_intersect("q", "d"), F.array().cast("array<string>"))
    joined = materialize(items.join(found, "query_id", "left").withColumn("shared", shared).drop("d"), "shared-tokens")
    tokens = joined.select("query_id", F.explode("shared").alias("token"))
    frequency = E.token_frequency(t.documents, "doc_id", T.content_tokens(c("text"), 5), tokens.select("token").distinct())
    rare = tokens.join(frequency.where(c("n_docs") <= rules.DISTINCTIVE_DF), "token").groupBy("query_id").agg(F.count("*").alias("distinctive"))
    rows = joined.join(rare, "query_id", "left")
    bucket = E.failure_bucket(F.size("shared"), F.size(F.array_except("q", "shared")), F.coalesce("distinctive", F.lit(0)), F.col("doc_id").isNotNull(), F.lit("en"), c("lang"), E.common_substring(c("slug"), F.coalesce("doc_slug", F.lit(""))))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _slug(g: str) -> str:
    """A document's slug: its source, the letters of its beginning as words, and its id."""
    return f"coalesce(source, 'none') || '-' || lower(replace(trim(regexp_replace(substr(coalesce(text, ''), 1, 60), '[^A-Za-z]+', ' '{g})), ' ', '-')) || '-' || doc_id"


_SLUG_WORDS = (
    "list_distinct([x FOR x IN string_split(CASE WHEN starts_with({0}, 'src1-') OR starts_with({0}, 'src2-') THEN substr({0}, 6) ELSE coalesce({0}, '') END, '-') IF length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN (" + ", ".join(f"'{w}'" for w in rules.SLUG_STOPWORDS) + ")])"
)
_STRAND = "CASE WHEN starts_with({0}, 'src1-') THEN 'src1' WHEN starts_with({0}, 'src2-') THEN 'src2' END"


@R.query(
    "failure_evidence",
    _BM25 + _OVERLAP + _TOP.format(name="r1", of="b", k=5) + "," + _TOP.format(name="r2", of="o", k=1)
    + f", sl AS (SELECT doc_id, {_slug(", 'g'")} AS slug FROM documents), us AS (SELECT token FROM (SELECT slug, unnest({_SLUG_WORDS.format('slug')}) AS token FROM (SELECT DISTINCT slug FROM sl)) GROUP BY 1 HAVING count(*) > 2), "
    + "gs AS (SELECT item_id AS query_id, text, t.slug AS b, x.slug AS a, coalesce(r2.doc_id IN (SELECT doc_id FROM r1 r WHERE r.query_id = item_id), false) AS in_top5 FROM benchmark LEFT JOIN r1 ON r1.query_id = item_id AND r1.rank = 1 LEFT JOIN r2 ON r2.query_id = item_id LEFT JOIN sl t ON t.doc_id = r1.doc_id LEFT JOIN sl x ON x.doc_id = r2.doc_id), "
    + f"ws AS (SELECT *, {_CONTENT.replace('>= 5', '>= 4').format(_QUESTION)} AS q, {_SLUG_WORDS.format('b')} AS tb, {_SLUG_WORDS.format('a')} AS ta, {_STRAND.format('a')} AS expected_strand, {_STRAND.format('b')} AS top_strand, coalesce({_COMMON}, 0) AS common_length FROM gs), "
    + "ev AS (SELECT *, list_sort(list_intersect(q, tb)) AS st, list_sort(list_intersect(q, ta)) AS se FROM ws), hs AS (SELECT *, [x FOR x IN st IF NOT list_contains(usual, x)] AS d FROM ev, (SELECT coalesce(list(token), []) AS usual FROM us)) "
    + "SELECT query_id, a AS expected_slug, b AS top_slug, in_top5, expected_strand, top_strand, array_to_string(st, '|') AS shared_top, array_to_string(se, '|') AS shared_expected, array_to_string(d, '|') AS distinctive, common_length, "
    + "CASE WHEN a IS DISTINCT FROM b THEN CASE WHEN (len(st) >= 2 OR len(d) >= 1) AND len(se) = 0 THEN 'E' WHEN NOT in_top5 THEN 'D' WHEN expected_strand = top_strand THEN 'A' WHEN expected_strand <> top_strand THEN 'B' WHEN common_length >= 6 THEN 'C' ELSE 'F' END END AS bucket FROM hs",
)
def failure_evidence(t) -> DataFrame:
    """Of each passage whose first document is another than the one that shares most of its words: the bucket and its evidence."""
    slugs = t.documents.select("doc_id", F.expr(_slug("")).alias("slug"))
    # A few rows for each passage, read more than once: each search runs once.
    found = materialize(_bm25(t, 5).select("query_id", "doc_id", "rank"), "found-documents")
    first = materialize(_overlap(t, 1).select("query_id", c("doc_id").alias("wanted")), "wanted-documents")
    tops = found.where("rank = 1").select("query_id", "doc_id").join(slugs, "doc_id").select("query_id", c("slug").alias("top_slug"))
    wanted = first.join(slugs.withColumnRenamed("doc_id", "wanted"), "wanted").select("query_id", "wanted", c("slug").alias("expected_slug"))
    near = found.select("query_id", c("doc_id").alias("wanted"), F.lit(True).alias("near"))
    rows = _items(t).join(tops, "query_id", "left").join(wanted, "query_id", "left").join(near, ["query_id", "wanted"], "left").withColumn("in_top5", F.coalesce("near", F.lit(False)))
    joined = lambda n: F.array_join(n, "|").alias(n)
    return E.failure_evidence(rows, slugs.select("slug"), ["src1", "src2"], c("text")).select(
        "query_id", "expected_slug", "top_slug", "in_top5", "expected_strand", "top_strand", joined("shared_top"), joined("shared_expected"), joined("distinctive"), "common_length", "bucket"
    )
