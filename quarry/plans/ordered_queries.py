"""Registered queries: windows, time, state machines, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import curves, gates, ordered
from quarry.plans.registry import Registry

R = Registry()
c = F.col


@R.query(
    "sibling_first",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS flag FROM (SELECT *, CASE WHEN l_quantity > 30 THEN l_returnflag END AS own FROM lineitem)",
)
def sibling_first(t) -> DataFrame:
    own = F.when(c("l_quantity") > 30, c("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ordered.first_known(own, ["l_orderkey"], ["l_linenumber", "l_partkey"]).alias("flag"))


@R.query(
    "marks_distribution",
    "WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN l_quantity::BIGINT END AS own FROM lineitem), "
    "g AS (SELECT *, 200 AS total, count(*) FILTER (WHERE own IS NULL) OVER p AS n, greatest(200 - coalesce(sum(own) OVER p, 0), 0)::BIGINT AS rest, count(*) OVER p AS all_rows, count(*) FILTER (WHERE own IS NULL) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS place FROM w WINDOW p AS (PARTITION BY l_orderkey)) "
    "SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN own IS NOT NULL THEN own ELSE greatest(rest // n + CASE WHEN place <= rest - (rest // n) * n THEN 1 ELSE 0 END, greatest(1, total // all_rows)) END)::BIGINT AS marks FROM g",
)
def marks_distribution(t) -> DataFrame:
    own = F.when(c("l_quantity") > 25, c("l_quantity").cast("long"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", own.alias("own"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", ordered.distribute(F.lit(200), c("own"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).alias("marks"))


@R.query("forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events")
def forward_fill(t) -> DataFrame:
    return t.events.select("event_id", ordered.forward_fill(F.when(c("event_type") == "signup", c("event_id")), ["user_id"], ["ts", "event_id"]).alias("last_signup"))


@R.query("islands", "SELECT user_id, section, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM events) GROUP BY 1, 2")
def islands(t) -> DataFrame:
    marked = t.events.withColumn("section", ordered.island(c("event_type") == "signup", ["user_id"], ["ts", "event_id"]))
    return marked.groupBy("user_id", "section").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@R.query(
    "true_runs",
    "WITH m AS (SELECT user_id, event_id, value > 20 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY event_id) AS run FROM events) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM m WHERE ok GROUP BY user_id, run",
)
def true_runs(t) -> DataFrame:
    return ordered.runs(t.events.select("user_id", "event_id", "value"), c("value") > 20, ["user_id"], "event_id")


@R.query(
    "limiter_window",
    "SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s} SECONDS PRECEDING AND CURRENT ROW) AS n_{s}" for s in (60, 3600, 86400)) + " FROM events",
)
def limiter_window(t) -> DataFrame:
    return ordered.trailing_counts(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", [60, 3600, 86400]).drop("user_id", "ts")


LIMITER_SQL = """
WITH RECURSIVE e AS (SELECT user_id % 3 AS user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS k FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, []::BIGINT[] AS kept, ''::VARCHAR AS decision FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN d = 'ok' THEN list_append(live, us) ELSE live END, d FROM (
    SELECT *, CASE WHEN len(live) >= 30 THEN 'day_cap' WHEN len([x FOR x IN live IF x >= us - 60000000]) >= 5 THEN 'minute_cap' ELSE 'ok' END AS d FROM (
      SELECT e.user_id, e.k, e.event_id, e.us, [x FOR x IN r.kept IF x >= e.us - 86400000000] AS live FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
SELECT event_id, decision FROM r WHERE k > 0
"""


@R.query("limiter_exact", LIMITER_SQL)
def limiter_exact(t) -> DataFrame:
    events = t.events.select("event_id", "ts", (c("user_id") % 3).alias("user_id"), F.lit("authenticated").alias("tier"))
    return gates.limit_requests(events, "user_id", "tier").select("event_id", "decision")


SUBNET_SQL = """
WITH RECURSIVE e AS (SELECT user_id // 40 AS subnet, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id // 40 ORDER BY ts, event_id) AS k FROM events),
r AS (
  SELECT subnet, 0::BIGINT AS k, 0::BIGINT AS event_id, []::BIGINT[] AS kept, ''::VARCHAR AS decision FROM (SELECT DISTINCT subnet FROM e)
  UNION ALL
  SELECT subnet, k, event_id, CASE WHEN d = 'ok' THEN list_append(live, us) ELSE live END, d FROM (
    SELECT *, CASE WHEN len([x FOR x IN live IF x >= us - 3600000000]) >= 12 OR len(live) >= 30 THEN 'subnet_cap' ELSE 'ok' END AS d FROM (
      SELECT e.subnet, e.k, e.event_id, e.us, [x FOR x IN r.kept IF x >= e.us - 86400000000] AS live FROM r JOIN e ON e.subnet = r.subnet AND e.k = r.k + 1)))
SELECT event_id, subnet, decision FROM r WHERE k > 0
"""


@R.query("subnet_limiter", SUBNET_SQL)
def subnet_limiter(t) -> DataFrame:
    events = t.events.select("event_id", "ts", F.floor(c("user_id") / 40).alias("subnet"))
    return gates.limit_subnets(events, "subnet").select("event_id", "subnet", "decision")


BREAKER_SQL = """
WITH RECURSIVE e AS (SELECT user_id % 5 AS route, event_id, event_type <> 'signup' AS failed, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS k FROM events),
r AS (
  SELECT route, 0::BIGINT AS k, 0::BIGINT AS event_id, []::BIGINT[] AS fails, 0::BIGINT AS opened FROM (SELECT DISTINCT route FROM e)
  UNION ALL
  SELECT route, k, event_id, f2, CASE WHEN failed AND len(f2) >= 5 AND o1 = 0 THEN us + 43200000000 ELSE o1 END FROM (
    SELECT *, CASE WHEN NOT failed THEN []::BIGINT[] ELSE list_append([x FOR x IN f1 IF x >= us - 21600000000], us) END AS f2 FROM (
      SELECT e.route, e.k, e.event_id, e.us, e.failed, CASE WHEN r.opened <> 0 AND e.us >= r.opened THEN 0 ELSE r.opened END AS o1, CASE WHEN r.opened <> 0 AND e.us >= r.opened THEN []::BIGINT[] ELSE r.fails END AS f1
      FROM r JOIN e ON e.route = r.route AND e.k = r.k + 1)))
SELECT event_id, route, CASE WHEN opened <> 0 THEN 'open' ELSE 'closed' END AS decision FROM r WHERE k > 0
"""


@R.query("breaker_states", BREAKER_SQL)
def breaker_states(t) -> DataFrame:
    events = t.events.select("event_id", "ts", (c("user_id") % 5).alias("route"), (c("event_type") != "signup").alias("failed"))
    return gates.break_circuits(events, "route", "failed", window=6 * 3600, hold=12 * 3600).select("event_id", "route", "decision")


@R.query(
    "cache_ttl",
    """
WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT key, k, event_id, us AS created, 'miss' AS decision FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, e.event_id, CASE WHEN e.us - r.created <= 43200000000 THEN r.created ELSE e.us END, CASE WHEN e.us - r.created <= 43200000000 THEN 'hit' ELSE 'stale' END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT event_id, decision FROM r
""",
)
def cache_ttl(t) -> DataFrame:
    events = t.events.select("event_id", "ts", F.concat_ws(":", "user_id", "event_type").alias("key"))
    return gates.cache_lookups(events, "key", 43_200).select("event_id", "decision")


@R.query(
    "daily_spend",
    "WITH d AS (SELECT ts::DATE::VARCHAR AS day, sum(value) FILTER (WHERE event_type = 'view') AS anon, sum(value) FILTER (WHERE event_type IN ('view', 'click')) AS free, sum(value) AS total FROM events GROUP BY 1) "
    "SELECT day, round(coalesce(anon, 0), 4) AS anonymous, round(coalesce(free, 0), 4) AS free, round(total, 4) AS total, CASE WHEN total >= 17000 THEN 'global' WHEN coalesce(free, 0) >= 7000 THEN 'free' WHEN coalesce(anon, 0) >= 3500 THEN 'anonymous' END AS stopped_by FROM d",
)
def daily_spend(t) -> DataFrame:
    sums = lambda *types: F.coalesce(F.sum(F.when(c("event_type").isin(*types), c("value"))), F.lit(0.0))
    days = t.events.groupBy(F.to_date("ts").cast("string").alias("day")).agg(sums("view").alias("a"), sums("view", "click").alias("f"), F.sum("value").alias("t"))
    stopped = F.when(c("t") >= 17000, "global").when(c("f") >= 7000, "free").when(c("a") >= 3500, "anonymous")
    return days.select("day", F.round("a", 4).alias("anonymous"), F.round("f", 4).alias("free"), F.round("t", 4).alias("total"), stopped.alias("stopped_by"))


@R.query(
    "cap_crossing",
    "SELECT event_id, round(running, 4) AS running FROM (SELECT *, sum(value) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events) WHERE round(running, 6) >= 1000 AND round(running, 6) - value < 1000",
)
def cap_crossing(t) -> DataFrame:
    days = t.events.withColumn("day", F.to_date("ts"))
    return ordered.cap_crossing(days, ["event_type", "day"], ["ts", "event_id"], "value", 1000.0).where("crosses").select("event_id", F.round("running", 4).alias("running"))


@R.query("recent_7d", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' - INTERVAL 7 DAYS")
def recent_7d(t) -> DataFrame:
    return t.events.where(c("ts") >= F.lit("2024-01-29").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@R.query("warm_window", "SELECT hour(ts + INTERVAL 1 HOUR) AS hour, count(*) AS n FROM events WHERE hour(ts + INTERVAL 1 HOUR) >= 8 AND hour(ts + INTERVAL 1 HOUR) < 22 GROUP BY 1")
def warm_window(t) -> DataFrame:
    hour = F.hour(c("ts") + F.expr("INTERVAL 1 HOUR"))
    return t.events.select(hour.alias("hour")).where((c("hour") >= 8) & (c("hour") < 22)).groupBy("hour").agg(F.count("*").alias("n"))


@R.query("epoch_iso", "SELECT event_id, (epoch_us(ts) // 1000000) AS epoch, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def epoch_iso(t) -> DataFrame:
    return t.events.select("event_id", F.unix_seconds(c("ts").cast("timestamp")).alias("epoch"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@R.query(
    "condense_history",
    "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6 GROUP BY 1",
)
def condense_history(t) -> DataFrame:
    last = t.conversations.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 6")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 500)).alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("history"))


@R.query("session_gaps", "SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOURS)::INT AS new FROM events) GROUP BY 1")
def session_gaps(t) -> DataFrame:
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", F.coalesce(c("ts") > before + F.expr("INTERVAL 2 HOURS"), F.lit(True)).cast("long").alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"))


@R.query("span_durations", "SELECT user_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM events GROUP BY 1")
def span_durations(t) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6, 3).alias("seconds"))


@R.query(
    "resumable_todo",
    "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('click', 'view'))",
)
def resumable_todo(t) -> DataFrame:
    done = t.events.where(c("event_type").isin("click", "view")).select("event_id")
    return t.events.select("event_id").join(done, "event_id", "left_anti")


@R.query("curve_poly", "SELECT p_partkey, round(((p_size * x - 2) * x + 1), 6) AS y, x FROM (SELECT p_partkey, p_size, unnest([-1.0, 0.0, 0.5, 2.0])::DOUBLE AS x FROM part)")
def curve_poly(t) -> DataFrame:
    x = t.part.select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, [-1.0, 0.0, 0.5, 2.0]))).alias("x"))
    return x.select("p_partkey", "x", F.round(curves.polynomial([c("p_size"), F.lit(-2), F.lit(1)], c("x")), 6).alias("y"))


@R.query("curve_trig", "SELECT event_id, round(sin(value), 6) AS sine, round(cos(value), 6) AS cosine, CASE WHEN abs(tan(value)) <= 10 THEN round(tan(value), 6) END AS tangent FROM events")
def curve_trig(t) -> DataFrame:
    f = lambda kind: F.round(curves.trigonometric(kind, c("value"), limit=10.0), 6)
    return t.events.select("event_id", f("sin").alias("sine"), f("cos").alias("cosine"), f("tan").alias("tangent"))


@R.query("curve_exp_log", "SELECT event_id, round(pow(2.0, value / 20), 6) AS doubled, CASE WHEN value - 10 > 0 THEN round(ln(value - 10) / ln(2), 6) END AS log2 FROM events")
def curve_exp_log(t) -> DataFrame:
    return t.events.select("event_id", F.round(curves.exponential(2.0, c("value") / 20), 6).alias("doubled"), F.round(curves.logarithm(2.0, c("value") - 10), 6).alias("log2"))


@R.query("curve_piecewise", "SELECT event_id, CASE WHEN value < 10 THEN value WHEN value < 30 THEN abs(value - 20) END AS y FROM events")
def curve_piecewise(t) -> DataFrame:
    pieces = [(c("value") < 10, c("value")), ((c("value") >= 10) & (c("value") < 30), F.abs(c("value") - 20))]
    return t.events.select("event_id", curves.piecewise(pieces).alias("y"))


@R.query("argand", "SELECT event_id, round(sqrt(value * value + k * k), 6) AS modulus, round(CASE WHEN degrees(atan2(k, value)) < 0 THEN degrees(atan2(k, value)) + 360 ELSE degrees(atan2(k, value)) END, 6) AS argument FROM (SELECT event_id, value, (user_id - 25)::DOUBLE AS k FROM events)")
def argand(t) -> DataFrame:
    m, a = curves.polar(c("value"), c("user_id") - 25.0)
    return t.events.select("event_id", F.round(m, 6).alias("modulus"), F.round(a, 6).alias("argument"))


@R.query("quadratic_roots", "SELECT p_partkey, d AS discriminant, CASE WHEN d >= 0 THEN round((-b - sqrt(d)) / 2, 6) END AS low, CASE WHEN d >= 0 THEN round((-b + sqrt(d)) / 2, 6) END AS high FROM (SELECT p_partkey, (p_size - 25)::DOUBLE AS b, ((p_size - 25) * (p_size - 25) - 40)::DOUBLE AS d FROM part)")
def quadratic_roots(t) -> DataFrame:
    d, low, high = curves.quadratic(F.lit(1.0), c("p_size") - 25.0, F.lit(10.0))
    return t.part.select("p_partkey", d.alias("discriminant"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


