"""The catalogue's operators over the driver's tables, with the same questions in SQL.

An order is a series, its line numbers are volumes, a line is a file, a line with status F is owned; events are
observations or cached responses, pages are raw provider responses, customers and suppliers are two providers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import issues, joins, keyed, numbers, shelf, snapshot, summaries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def cents(c: str) -> F.Column:
    """Money as a decimal, so that sums do not depend on their order."""
    return F.col(c).cast("decimal(18,2)")


@query("""
SELECT o.l_orderkey AS series, CAST(n.n AS BIGINT) AS missing
FROM (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) o, LATERAL (SELECT unnest(generate_series(1, o.m)) AS n) n
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.l_orderkey AND l.l_linenumber = n.n)
""")
def holdings_gaps(spark, d):
    lines = t(spark, d, "lineitem", F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("volume"))
    return numbers.gaps(lines, ["series"], "volume", "volume")


@query("""
SELECT l_orderkey AS series, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS n_owned, CAST(max(l_linenumber) AS BIGINT) AS largest,
  CAST(max(l_linenumber) - count(DISTINCT l_linenumber) AS BIGINT) AS n_missing,
  string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS owned
FROM lineitem GROUP BY 1
""")
def holdings_list(spark, d):
    lines = t(spark, d, "lineitem", F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("volume"))
    h = numbers.holdings(lines, ["series"], "volume", "volume")
    return h.select("series", F.size("owned").cast("long").alias("n_owned"), F.col("max").alias("largest"), F.size("missing").cast("long").alias("n_missing"), F.array_join("owned", ",").alias("owned"))


@query("SELECT l_orderkey AS series, l_linenumber AS volume, count(DISTINCT l_partkey) AS bases FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def dup_volumes(spark, d):
    lines = t(spark, d, "lineitem", F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("volume"), "l_partkey")
    return issues.duplicates(lines, ["series", "volume"], "l_partkey")


@query("""
SELECT series, count(*) AS duplicate_volumes, CAST(sum(n - 1) AS BIGINT) AS duplicate_files
FROM (SELECT l_orderkey AS series, l_linenumber, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1) GROUP BY 1
""")
def dup_counts(spark, d):
    lines = t(spark, d, "lineitem", F.col("l_orderkey").alias("series"), "l_linenumber", "l_partkey")
    return issues.duplicate_counts(lines, ["series"], ["l_linenumber"], "l_partkey")


@query("SELECT substr(p_name, 1, length(p_name) - length(p_type) % 5) AS base, count(*) AS n FROM part GROUP BY 1")
def file_bases(spark, d):
    p = t(spark, d, "part", "p_name", "p_type")
    ext = F.repeat(F.lit("x"), F.length("p_type") % 5)
    return p.select(issues.file_base(F.col("p_name"), F.lit(None).cast("string"), ext).alias("base")).groupBy("base").agg(F.count("*").alias("n"))


def _published(spark, d):
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus")
    return numbers.published(lines, lines.where("l_linestatus = 'F'"), ["l_orderkey"], "l_linenumber", "l_linenumber")


_KNOWN = """
WITH o AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
own AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
s AS (
  SELECT k.l_orderkey AS series, max(k.l_linenumber) AS published_max, count(*) FILTER (WHERE own.l_linenumber IS NULL) AS n_missing,
    count(*) FILTER (WHERE k.l_linenumber > coalesce(o.m, 0)) AS n_ahead, coalesce(max(o.m), 0) AS owned_max
  FROM k LEFT JOIN o USING (l_orderkey) LEFT JOIN own ON own.l_orderkey = k.l_orderkey AND own.l_linenumber = k.l_linenumber GROUP BY 1
)
"""


@query(_KNOWN + "SELECT k.l_orderkey AS series, CAST(k.l_linenumber AS BIGINT) AS ahead FROM k LEFT JOIN o USING (l_orderkey) WHERE k.l_linenumber > coalesce(o.m, 0)")
def published_ahead(spark, d):
    return _published(spark, d).select(F.col("l_orderkey").alias("series"), F.explode("ahead").alias("ahead"))


@query(_KNOWN + """
SELECT s.series, CASE WHEN o_orderstatus = 'F' THEN 'owner-completed' WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN n_ahead > 0 THEN 'behind' ELSE 'caught-up' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN n_missing > 0 THEN '完結 — 未所持 ' || n_missing || '巻' ELSE '完結 — 揃っている' END
    WHEN o_orderpriority = '5-LOW' THEN '発行状況は未確認'
    WHEN n_ahead > 0 THEN '続きが出ている — ' || (owned_max + 1) || '〜' || published_max || '巻が未所持'
    ELSE year(o_orderdate) || '年の第' || published_max || '巻まで確認 — それ以降は不明' END AS label
FROM s JOIN orders ON o_orderkey = s.series
""")
def shelf_status(spark, d):
    o = t(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    p = _published(spark, d).join(o, "l_orderkey")
    status = shelf.shelf_status(F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW", F.col("published_max"), F.size("ahead"))
    label = shelf.shelf_label(F.col("status"), F.col("owned_max"), F.col("published_max"), F.size("missing"), F.year("o_orderdate"))
    return p.withColumn("status", status).select(F.col("l_orderkey").alias("series"), "status", label.alias("label"))


@query("""
SELECT p_partkey, p_size FROM part p
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND p.p_size BETWEEN l.l_linenumber AND CAST(l.l_quantity AS BIGINT))
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_linenumber = 1 AND l.l_quantity < 20)
""")
def exists_and_not_exists(spark, d):
    lines = t(spark, d, "lineitem", F.col("l_partkey").alias("p_partkey"), "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag")
    p = joins.in_some_range(t(spark, d, "part", "p_partkey", "p_size"), lines, ["p_partkey"], "p_size", "l_linenumber", "quantity")
    return joins.without(p, lines.where("l_returnflag = 'R' and l_linenumber = 1 and quantity < 20"), ["p_partkey"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return keyed.latest_per_key(t(spark, d, "events", "user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("""
SELECT user_id, event_id, event_type, later > 1 AS stale FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS later,
    row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error') DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def stale_if_error(spark, d):
    e = t(spark, d, "events", "user_id", "event_id", "event_type", "ts")
    return keyed.stale_if_error(e, ["user_id"], F.col("event_type") != "error", "ts", "event_id").drop("ts")


@query("""
SELECT p_brand, p_type, votes FROM (SELECT p_brand, p_type, count(*) AS votes, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, length(p_type), p_type) AS rn
  FROM part GROUP BY 1, 2) WHERE rn = 1
""")
def majority_vote(spark, d):
    return keyed.majority(t(spark, d, "part", "p_brand", "p_type"), ["p_brand"], "p_type")


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey LIMIT 60 OFFSET 60")
def page_two(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return summaries.page(c, [F.lower("c_mktsegment"), F.desc("c_acctbal"), F.col("c_custkey")], 60, 60).select("c_custkey", "c_name")


@query(r"""
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')) AS title FROM pages
""")
def tag_extract(spark, d):
    return t(spark, d, "pages", "page_id", "html").select("page_id", S.tag_text(F.col("html"), "title").alias("title"))


@query("""
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (
  SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY 1, 2
""")
def gap_sessions(spark, d):
    e = t(spark, d, "events", "user_id", "event_id", "ts")
    return snapshot.sessions(e, "user_id", "ts", 30).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""
WITH q AS (SELECT o_orderkey AS id, o_orderkey AS series, CAST(o_orderkey % 7 + 1 AS BIGINT) AS lo, CAST(o_orderkey % 7 + 1 + o_custkey % 3 AS BIGINT) AS hi FROM orders),
own AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
w AS (SELECT q.id, unnest(generate_series(q.lo, q.hi)) AS n, q.series FROM q)
SELECT w.id, count(*) FILTER (WHERE own.l_linenumber IS NULL) = 0 AS owned, string_agg(CASE WHEN own.l_linenumber IS NULL THEN CAST(w.n AS VARCHAR) END, ',' ORDER BY w.n) AS missing
FROM w LEFT JOIN own ON own.l_orderkey = w.series AND own.l_linenumber = w.n GROUP BY 1
""")
def own_check(spark, d):
    key = F.col("o_orderkey")
    q = t(spark, d, "orders", "o_orderkey", "o_custkey").select(key.alias("id"), key.alias("series"), (key % 7 + 1).alias("lo"), (key % 7 + 1 + F.col("o_custkey") % 3).alias("hi"))
    lines = t(spark, d, "lineitem", F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("volume"))
    h = numbers.spans(lines, ["series"], "volume", "volume").withColumnRenamed("spans", "have")
    m = q.join(h, "series", "left").withColumn("m", numbers.missing_of_request(F.col("lo"), F.col("hi"), F.col("have")))
    return m.select("id", (F.size("m") == 0).alias("owned"), F.nullif(F.array_join("m", ","), F.lit("")).alias("missing"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(regexp_replace(lower(p_name), '[ _\\-.,]', '', 'g'), 'redw')")
def search_filter(spark, d):
    p = t(spark, d, "part", "p_partkey", "p_name", "p_brand").withColumn("key", S.folded_key(F.col("p_name")))
    return summaries.search(p, ["p_name", "p_brand"], "Ring", "key", "redw").select("p_partkey", "p_name")


@query("SELECT 'series' AS name, count(*) AS n FROM orders UNION ALL SELECT 'files', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def health_counts(spark, d):
    return summaries.counts_of({"series": t(spark, d, "orders", "o_orderkey"), "files": t(spark, d, "lineitem", "l_orderkey"), "events": t(spark, d, "events", "event_id")})


@query("SELECT event_type AS provider, count(*) AS entries, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS hits FROM events GROUP BY 1")
def cache_stats(spark, d):
    return t(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("entries"), F.sum(cents("value")).cast("double").alias("hits"))


@query("""
SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS owned,
  CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS missing,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS care FROM orders GROUP BY 1
""")
def conditional_sums(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    cases = {"owned": F.col("o_orderstatus") == "F", "missing": F.col("o_orderstatus") == "O", "care": F.col("o_orderpriority") == "1-URGENT"}
    s = summaries.conditional_sums(o, ["o_custkey"], cents("o_totalprice"), cases)
    return s.select("o_custkey", *(F.col(c).cast("double").alias(c) for c in cases))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS files, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS bytes, max(l_linenumber) AS largest, count(DISTINCT l_linenumber) AS volumes FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS series, sum(files) AS files, sum(bytes) AS bytes, count(*) FILTER (WHERE largest > volumes) AS with_gaps FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(series, 0) AS series, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(bytes, 0) AS DOUBLE) AS bytes, coalesce(with_gaps, 0) AS with_gaps
FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE coalesce(with_gaps, 0) > 0 ORDER BY with_gaps DESC, c_custkey LIMIT 100
""")
def list_join_summary(spark, d):
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    line = lines.groupBy("l_orderkey").agg(F.count("*").alias("files"), F.sum(cents("l_extendedprice")).alias("bytes"), F.max("l_linenumber").alias("largest"), F.count_distinct("l_linenumber").alias("volumes"))
    o = t(spark, d, "orders", "o_orderkey", "o_custkey").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("series"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("largest") > F.col("volumes")).alias("with_gaps"))
    c = t(spark, d, "customer", "c_custkey", "c_name").join(o, "c_custkey", "left").na.fill(0, ["series", "files", "with_gaps"])
    c = c.withColumn("bytes", F.coalesce(F.col("bytes").cast("double"), F.lit(0.0)))
    return summaries.page(c.where("with_gaps > 0"), [F.desc("with_gaps"), F.col("c_custkey")], 100)


#: Two snapshots per user and kind of event: without errors, and without clicks from the second half of the stream on.
_SPLIT = """
WITH h AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS half FROM events),
a AS (SELECT user_id, event_type, max(event_id) AS last, count(*) AS n FROM events, h WHERE event_type <> 'error' AND epoch_us(ts) < half GROUP BY 1, 2),
b AS (SELECT user_id, event_type, max(event_id) AS last, count(*) AS n FROM events, h WHERE event_type <> 'click' AND (event_type = 'view' OR epoch_us(ts) < half) GROUP BY 1, 2)
"""


def _two(spark, d):
    e = t(spark, d, "events", "user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    early = F.col("us") < e.select(F.expr("(min(us) + max(us)) div 2")).scalar()
    a = e.where((F.col("event_type") != "error") & early)
    b = e.where((F.col("event_type") != "click") & ((F.col("event_type") == "view") | early))
    return tuple(x.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"), F.count("*").alias("n")) for x in (a, b))


@query(_SPLIT + """
SELECT user_id, event_type, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.last = b.last AND a.n = b.n THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (user_id, event_type)
""")
def snapshot_diff(spark, d):
    old, new = _two(spark, d)
    return snapshot.diff(old, new, ["user_id", "event_type"], ["last", "n"])


@query(_SPLIT + """
SELECT user_id, event_type, coalesce(b.last, a.last) AS last, coalesce(a.n, b.n) AS n, coalesce(a.n > 60, false) OR coalesce(b.n > 60, false) AS completed,
  CASE WHEN a.user_id IS NULL THEN 'created' WHEN b.user_id IS NOT NULL THEN 'updated' END AS change FROM a FULL JOIN b USING (user_id, event_type)
""")
def snapshot_upsert(spark, d):
    old, new = (x.withColumn("completed", F.col("n") > 60) for x in _two(spark, d))
    return snapshot.upsert(old, new, ["user_id", "event_type"], sticky=["completed"], keep=["n"])


@query("SELECT o_orderkey, o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F') AS present FROM orders")
def soft_delete_rollup(spark, d):
    o = t(spark, d, "orders", "o_orderkey", (F.col("o_orderstatus") != "P").alias("present"))
    lines = t(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").withColumn("present", F.expr("l_returnflag = 'R' and l_linestatus = 'F'"))
    return snapshot.roll_up_presence(o, lines, "o_orderkey", "l_orderkey")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE WHEN new.k IS NULL OR (coalesce(old.p, false) AND NOT new.p) THEN old.k ELSE new.k END AS chosen
FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k, min(s_acctbal) < 1500 AS p FROM supplier GROUP BY 1) old ON old.s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k, min(c_acctbal) < 100 AS p FROM customer GROUP BY 1) new ON new.c_nationkey = n_nationkey
WHERE old.k IS NOT NULL OR new.k IS NOT NULL
""")
def pin_merge(spark, d):
    old = t(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.min("s_suppkey").alias("chosen"), (F.min("s_acctbal") < 1500).alias("pinned"))
    c = t(spark, d, "customer")
    new = c.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.min("c_custkey").alias("chosen"), (F.min("c_acctbal") < 100).alias("pinned"))
    return keyed.merge_pinned(old, new, ["nation"]).drop("pinned")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
""")
def elect_lowest(spark, d):
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return keyed.elect_lowest(lines, ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey").drop("l_suppkey")


@query("""
SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal > 5000 DESC, s_suppkey DESC) AS rn FROM supplier) WHERE rn = 1
""")
def cover_dedupe(spark, d):
    s = t(spark, d, "supplier", "s_nationkey", "s_suppkey", "s_acctbal").withColumn("pinned", F.col("s_acctbal") > 5000)
    return keyed.dedupe_pinned(s, ["s_nationkey"], "pinned", "s_suppkey").select("s_nationkey", "s_suppkey")


@query("""
WITH l AS (SELECT DISTINCT p_name AS a FROM part), r AS (SELECT substr(p_name, 1, 4 + p_size % 9) AS b, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT a AS name, min(k) AS first_match, CAST(sum(n) AS BIGINT) AS matches FROM l JOIN r ON length(a) >= 6 AND length(b) >= 6 AND (starts_with(a, b) OR starts_with(b, a)) GROUP BY 1
""")
def prefix_match(spark, d):
    p = t(spark, d, "part", "p_partkey", "p_name", "p_size")
    left = p.select(F.col("p_name").alias("a")).distinct()
    right = p.groupBy(F.substring(F.col("p_name"), F.lit(1), F.col("p_size") % 9 + 4).alias("b")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    return joins.prefix_pairs(left, right, "a", "b", 6).groupBy(F.col("a").alias("name")).agg(F.min("k").alias("first_match"), F.sum("n").alias("matches"))


@query("""
WITH r AS (SELECT o_orderkey AS id, o_custkey AS series, o_orderkey % 40 AS lo, o_orderkey % 40 + o_custkey % 4 AS hi FROM orders)
SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(r.lo, r.hi)) AS n) x
  WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.series = r.series AND q.id <> r.id AND x.n BETWEEN q.lo AND q.hi))
""")
def range_coverage(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey")
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("series"), (F.col("o_orderkey") % 40).alias("lo"), (F.col("o_orderkey") % 40 + F.col("o_custkey") % 4).alias("hi"))
    return numbers.covered_ranges(r, "id", ["series"], "lo", "hi").select("id")


@query("""
WITH r AS (SELECT o_orderkey AS series, CAST(1 AS BIGINT) AS lo, CAST(o_custkey % 5 + 1 AS BIGINT) AS hi FROM orders)
SELECT r.series, x.n AS number FROM r, LATERAL (SELECT unnest(generate_series(r.lo, r.hi)) AS n) x
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.series AND l.l_linenumber = x.n)
""")
def settled_check(spark, d):
    r = t(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("series"), F.lit(1).alias("lo"), (F.col("o_custkey") % 5 + 1).alias("hi"))
    have = t(spark, d, "lineitem", F.col("l_orderkey").alias("series"), "l_linenumber")
    return numbers.uncovered(r, have, ["series"], "lo", "hi", "l_linenumber")


@query("""
SELECT 'customer' AS provider, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier
""")
def union_sources(spark, d):
    c = t(spark, d, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return joins.union_sources({"customer": c, "supplier": t(spark, d, "supplier", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))})


@query("SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def folder_collisions(spark, d):
    return summaries.collisions(t(spark, d, "part", "p_name", "p_brand"), "p_name", "p_brand")


@query("SELECT s_suppkey, 'supplier#' || lpad(CAST(s_suppkey % 97 AS VARCHAR), 12, '0') || 'x' AS key FROM supplier")
def natural_sort(spark, d):
    name = F.concat(F.lit("Supplier#"), F.col("s_suppkey") % 97, F.lit("X"))
    return t(spark, d, "supplier", "s_suppkey").select("s_suppkey", summaries.natural_key(name).alias("key"))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS ym, CAST(year(o_orderdate) * 100 + greatest(1, least(12, o_custkey % 15)) AS INT) AS clamped, CAST(year(o_orderdate) AS INT) AS y FROM orders
""")
def date_key(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_orderdate", "o_custkey")
    text = F.concat_ws(".", F.year("o_orderdate"), F.col("o_custkey") % 15)
    return o.select("o_orderkey", S.month_key(F.col("o_orderdate")).alias("ym"), S.date_key(text).alias("clamped"), S.year_of(text).alias("y"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    e = t(spark, d, "events", "event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("""
SELECT c_custkey, CASE WHEN length(b) IN (10, 13) THEN b END AS isbn FROM (SELECT c_custkey, upper(regexp_replace(repeat('-', CAST(c_custkey % 3 AS INT)) || c_custkey || '-978' || c_name || 'x', '[^0-9Xx]', '', 'g')) AS b FROM customer)
""")
def isbn_clean(spark, d):
    raw = F.concat(F.repeat(F.lit("-"), (F.col("c_custkey") % 3).cast("int")), F.col("c_custkey"), F.lit("-978"), F.col("c_name"), F.lit("x"))
    return t(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", S.normalize_isbn(raw).alias("isbn"))


@query(r"""
SELECT doc_id, regexp_replace(lower(text), '[\t\n\x0B\f\r 　_\-‐–—~〜・,.、。!?！？''"“”‘’()（）\[\]{}【】「」『』:：;；|/\\]', '', 'g') AS key FROM documents
""")
def string_keys(spark, d):
    return t(spark, d, "documents", "doc_id", "text").select("doc_id", S.folded_key(F.col("text")).alias("key"))


@query("SELECT l_orderkey, string_agg('第' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '巻', ' / ' ORDER BY l_linenumber) AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def batch_text(spark, d):
    lines = t(spark, d, "lineitem", "l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber")
    return summaries.joined_text(lines.withColumn("label", S.format_volume(n, n, F.lit("巻"))), ["l_orderkey"], ["l_linenumber"], "label")


@query("SELECT l_orderkey, quantile_cont(l_quantity, 0.5) AS median, max(l_quantity) AS largest FROM lineitem GROUP BY 1")
def median_stats(spark, d):
    return summaries.spread(t(spark, d, "lineitem", "l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity")


@query("""
SELECT l_partkey, l_linenumber, l_orderkey FROM (SELECT l_partkey, l_linenumber, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 3
""")
def budget_per_series(spark, d):
    lines = t(spark, d, "lineitem", "l_partkey", "l_linenumber", "l_orderkey", "l_suppkey")
    return keyed.top_per_key(lines, ["l_partkey"], [F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")], 3).drop("l_suppkey")


@query("SELECT s_suppkey, 'v:巻:' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '-' || (s_nationkey + s_suppkey % 3) END AS slot, s_nationkey AS volume_no FROM supplier")
def slot_keys(spark, d):
    s = t(spark, d, "supplier", "s_suppkey", "s_nationkey")
    slot = S.volume_slot(F.col("s_nationkey"), (F.col("s_nationkey") + F.col("s_suppkey") % 3), F.lit("巻"))
    return s.withColumn("slot", slot).select("s_suppkey", "slot", S.slot_volume_no(F.col("slot")).alias("volume_no"))
