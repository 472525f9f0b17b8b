"""Queries over names, records and whole plans, made up from the driver's tables so that SQL knows the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..operators import candidates, covers, folding, keyed, numbers, snapshot
from ..session import scratch
from ..sources import providers
from ..streaming import changes
from . import moves, shelf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cat(*parts) -> F.Column:
    return F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))


@query("""
SELECT p_partkey, p_brand AS author, p_name AS title, p_size AS volume, p_partkey % 5 = 0 AS completed, CASE p_partkey % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.rar' ELSE '.part2.rar' END AS suffix,
  CASE WHEN p_partkey % 3 = 2 THEN 2 END AS part_no FROM part
""")
def parse_names(spark, d):
    k = F.col("p_partkey")
    ext = F.when(k % 3 == 0, ".zip").when(k % 3 == 1, ".rar").otherwise(".part2.rar")
    mark = F.when(k % 5 == 0, "(完)").otherwise("")
    work = cat("[", F.col("p_brand"), "] ", F.col("p_name"))
    path = cat(work, mark, "/", work, " 第", F.lpad(F.col("p_size").cast("string"), 2, "0"), "巻", mark, ext)
    e = t(spark, d, "part").select("p_partkey", R.parse_library_entry(path).alias("e"))
    return e.select("p_partkey", "e.author", "e.title", F.col("e.volume_from").alias("volume"), "e.completed", F.concat("e.part", "e.ext").alias("suffix"), "e.part_no")


@query("SELECT p_partkey, replace(lower(p_name), ' ', '') AS key FROM part")
def series_keys(spark, d):
    return t(spark, d, "part").select("p_partkey", R.series_key(cat(F.col("p_name"), " 第", F.col("p_size"), "巻(完)")).alias("key"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 1 WHEN 5 THEN NULL ELSE p_size END AS lo, CASE p_partkey % 6 WHEN 1 THEN p_size + 2 WHEN 5 THEN NULL ELSE p_size END AS hi,
  CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 4 THEN '話' ELSE '巻' END AS unit FROM part
""")
def find_volumes(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    forms = [cat("第", n, "巻"), cat(n, "〜", n + 2, "巻"), cat("vol.", n), cat("全", n, "巻"), cat("第", n, "話"), cat(n + 1, "-", n, "巻")]
    text = forms[5]
    for i in range(5):
        text = F.when(k % 6 == i, forms[i]).otherwise(text)
    return t(spark, d, "part").select("p_partkey", R.find_volume(cat(F.col("p_name"), " ", text)).alias("f")).select("p_partkey", "f.lo", "f.hi", "f.unit")


@query("SELECT replace(p_name, ' ', '') AS key, count(*) AS files, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1")
def inbox_fold(spark, d):
    edition = F.element_at(F.array(*map(F.lit, ("", "s", "v2", "_LQ"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = cat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "_", F.lpad(F.col("p_size").cast("string"), 2, "0"), edition, ".rar")
    w = moves.fold_inbox(moves.inbox_works(t(spark, d, "part").select(name.alias("name"))))
    volumes = F.transform("files", lambda x: x["volume_from"])
    return w.select("key", F.size("files").cast("long").alias("files"), F.array_min(volumes).alias("lo"), F.array_max(volumes).alias("hi"))


def _tables(spark, d) -> shelf.Tables:
    """Orders as series, their lines as files, lines with status F as owned volumes, all lines as bibliography."""
    o, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    key = F.col("o_orderkey")
    start = F.timestamp_seconds(F.lit(1_000_000_000) + key)
    series = o.select(
        key.alias("id"), cat("r", key % 3).alias("root_id"), cat("f", key).alias("folder"), cat("order", key).alias("series_key"), cat("Order ", key).alias("title"), F.col("o_orderpriority").alias("author"),
        (F.col("o_orderstatus") == "F").alias("completed"), F.when(key % 11 == 0, F.lit(False)).alias("completed_user"), F.lit(True).alias("present"), start.alias("first_seen_at"), F.when(key % 4 != 0, start).alias("enriched_at"),
    )
    owned = lines.where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber").distinct()
    volume_id = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    volumes = owned.select(volume_id.alias("id"), F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("volume_from"), F.col("l_linenumber").alias("volume_to"), F.lit(numbers.VOLUME).alias("unit"), F.lit(True).alias("present"), F.timestamp_seconds(F.lit(1_100_000_000) + F.col("l_linenumber")).alias("first_seen_at"))
    files = lines.select(
        F.monotonically_increasing_id().alias("id"), cat("r", F.col("l_orderkey") % 3).alias("root_id"), cat("x", F.col("l_partkey"), ".zip").alias("rel_path"), F.col("l_orderkey").alias("series_id"), F.when(F.col("l_linestatus") == "F", volume_id).alias("volume_id"),
        F.col("l_quantity").cast("long").alias("size"), F.lit("").alias("part"), F.lit(".zip").alias("ext"), F.when(F.col("l_returnflag") == "N", "side").alias("side_label"), (F.col("l_returnflag") == "R").alias("care"), F.lit(True).alias("present"),
    )
    bib = lines.select(F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("volume_no"), F.lit("ndl").alias("provider"), F.lit("isbn").alias("isbn"), F.lit("t").alias("title"), F.lit("2003.9").alias("pubdate")).distinct()
    c = owned.select(volume_id.alias("id"), F.col("l_orderkey").alias("series_id"), S.volume_slot(F.col("l_linenumber"), F.col("l_linenumber"), F.lit(numbers.VOLUME)).alias("slot"), F.col("l_linenumber").alias("volume_no"), cat("c", F.col("l_linenumber")).alias("file"), F.lit(False).alias("pinned"))
    return shelf.Tables(series, volumes, files, bib, c)


_SHELF = """
WITH own AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F'), o AS (SELECT k, max(n) AS m, count(*) AS c FROM own GROUP BY 1),
allv AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
p AS (SELECT allv.k, max(allv.n) AS pmax, count(*) FILTER (WHERE own.n IS NULL) AS n_missing, count(*) FILTER (WHERE allv.n > coalesce(o.m, 0)) AS n_ahead FROM allv LEFT JOIN own USING (k, n) LEFT JOIN o ON o.k = allv.k GROUP BY 1),
f AS (SELECT l_orderkey AS k, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_returnflag <> 'N') AS loose, count(*) FILTER (WHERE l_returnflag = 'R') AS care FROM lineitem GROUP BY 1),
dup AS (SELECT k, count(*) AS dups FROM (SELECT l_orderkey AS k, l_linenumber FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1) GROUP BY 1),
s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN false ELSE o_orderstatus = 'F' END AS done FROM orders),
list AS (
  SELECT s.k AS series_id, 'Order ' || s.k AS title, coalesce(f.files, 0) AS file_count, coalesce(f.bytes, 0) AS bytes, coalesce(f.loose, 0) AS loose_files, coalesce(f.care, 0) AS care_files, coalesce(dup.dups, 0) AS duplicate_volumes,
    s.done AS effective_completed, coalesce(o.m > o.c, false) AS has_gap, CASE WHEN s.done THEN 'owner-completed' WHEN s.k % 4 = 0 OR p.pmax IS NULL THEN 'unknown' WHEN p.n_ahead > 0 THEN 'behind' ELSE 'caught-up' END AS status,
    CASE WHEN o.k IS NOT NULL THEN 'c' || (SELECT min(n) FROM own WHERE own.k = s.k) END AS cover
  FROM s LEFT JOIN f USING (k) LEFT JOIN dup USING (k) LEFT JOIN p USING (k) LEFT JOIN o USING (k)
)
"""
_LIST = ("series_id", "title", "file_count", "bytes", "loose_files", "care_files", "duplicate_volumes", "effective_completed", "has_gap", "status", "cover")


@query(_SHELF + "SELECT * FROM list")
def shelf_list(spark, d):
    return shelf.summaries_of(_tables(spark, d)).select(*_LIST)


@query(_SHELF + "SELECT * FROM list WHERE series_id % 3 = 1 AND has_gap AND NOT effective_completed AND contains(lower(title), 'r 1') ORDER BY file_count DESC, series_id LIMIT 40 OFFSET 10")
def shelf_page(spark, d):
    page, _ = shelf.series_list(_tables(spark, d), shelf.Options(root_id="r1", gaps=True, completed=False, q="R 1", sort="volumes", limit=40, offset=10))
    return page.select(*_LIST)


@query(_SHELF + "SELECT count(*) AS total FROM list WHERE duplicate_volumes > 0 AND care_files > 0 AND status = 'behind'")
def shelf_total(spark, d):
    return shelf.series_list(_tables(spark, d), shelf.Options(issues="dup", care=True, behind=True, limit=1))[1]


@query(_SHELF + "SELECT series_id, title FROM list JOIN p ON p.k = series_id WHERE n_ahead > 0 OR has_gap ORDER BY lower(title), series_id LIMIT 1000")
def missing_list(spark, d):
    return shelf.missing_list(_tables(spark, d), "all", 1000).select("series_id", "title")


@query("""
WITH q AS (SELECT c_custkey AS id, c_custkey * 7 % 20000 AS k, c_custkey % 5 + 1 AS lo, c_custkey % 5 + 1 + c_custkey % 2 AS hi FROM customer),
own AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')
SELECT q.id AS query_id, o_orderkey IS NOT NULL AND count(*) FILTER (WHERE own.l_linenumber IS NULL) = 0 AS owned,
  CASE WHEN o_orderkey IS NULL THEN 'no such series' WHEN count(*) FILTER (WHERE own.l_linenumber IS NULL) > 0 THEN 'some are missing' ELSE 'owned' END AS reason
FROM q, LATERAL (SELECT unnest(generate_series(q.lo, q.hi)) AS n) x LEFT JOIN orders ON o_orderkey = q.k LEFT JOIN own ON own.l_orderkey = q.k AND own.l_linenumber = x.n GROUP BY q.id, o_orderkey
""")
def own_requests(spark, d):
    k = F.col("c_custkey")
    lo = k % 5 + 1
    span = F.when(k % 2 == 0, lo.cast("string")).otherwise(cat(lo, "-", lo + 1))
    title = cat("Order ", k * 7 % 20000)
    none = F.lit(None).cast("string")
    q = t(spark, d, "customer").select(k.alias("query_id"), F.when(k % 3 != 0, title).alias("title"), F.when(k % 3 != 0, span).otherwise(none).alias("volume"), F.when(k % 3 == 0, cat(title, " 第", span, "巻")).alias("raw_text"))
    return shelf.check_owned(_tables(spark, d), q).select("query_id", "owned", "reason")


def _brand_records(spark, d):
    p = t(spark, d, "part")
    none = F.lit(None).cast("string")
    return p.select(
        F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("query_id"), F.col("p_partkey").cast("int").alias("ordinal"), F.element_at(F.array(F.lit("ndl"), F.lit("rakuten")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("provider"),
        cat(F.col("p_name"), "（", F.col("p_size"), "）").alias("title"), none.cast("int").alias("volume"), none.alias("author"), F.col("p_type").alias("publisher"), cat(1990 + F.col("p_partkey") % 30, ".5").alias("date"), none.alias("isbn"), none.alias("image_url"), none.alias("link"),
    )


@query("""
SELECT p_brand AS query_id, p_name AS title, count(*) AS n_items, count(DISTINCT p_size) AS n_volumes, CAST(min(1990 + p_partkey % 30) AS INT) AS first_year FROM part GROUP BY 1, 2
""")
def candidate_groups(spark, d):
    g = candidates.groups(folding.fold_candidates(candidates.normalise(_brand_records(spark, d))))
    return g.select(cat("Brand#", F.col("query_id")).alias("query_id"), "title", F.col("n_items").cast("long").alias("n_items"), F.size("volumes").cast("long").alias("n_volumes"), "first_year")


@query("SELECT p_partkey, p_name || ' & co' AS title, p_size AS volume, '4088' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS isbn, p_brand AS author FROM part")
def ndl_records(spark, d):
    isbn = cat("4-088-", F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    xml = cat("<rss><item><dc:title>", F.col("p_name"), " &amp; co</dc:title><dcndl:volume>第", F.col("p_size"), "巻</dcndl:volume><dc:creator><![CDATA[", F.col("p_brand"), ']]></dc:creator><dc:identifier xsi:type="dcndl:ISBN">', isbn, "</dc:identifier></item></rss>")
    return providers.ndl_records(t(spark, d, "part").select("p_partkey", xml.alias("body"))).select("p_partkey", "title", "volume", "isbn", "author")


@query("SELECT p_partkey, p_name AS title, 'a・' || p_brand AS author, 'https://img/' || p_partkey AS image_url, p_partkey % 2 = 0 AS large FROM part")
def google_records(spark, d):
    size = F.when(F.col("p_partkey") % 2 == 0, "large").otherwise("thumbnail")
    body = cat('{"items":[{"volumeInfo":{"title":"', F.col("p_name"), '","authors":["a","', F.col("p_brand"), '"],"imageLinks":{"', size, '":"http://img/', F.col("p_partkey"), '"}}}]}')
    return providers.google_records(t(spark, d, "part").select("p_partkey", body.alias("body"))).select("p_partkey", "title", "author", "image_url", "large")


@query("SELECT p_partkey, p_name AS title, 'i_ex=600x600&' || p_partkey AS image_url FROM part")
def rakuten_records(spark, d):
    body = cat('{"Items":[{"Item":{"title":"', F.col("p_name"), '","largeImageUrl":"","mediumImageUrl":"i_ex=120x120&', F.col("p_partkey"), '"}}]}')
    return providers.rakuten_records(t(spark, d, "part").select("p_partkey", body.alias("body"))).select("p_partkey", "title", "image_url")


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'u' || p_partkey END AS image_url FROM part WHERE p_partkey % 7 <> 0")
def openbd_records(spark, d):
    cover = F.when(F.col("p_partkey") % 2 == 0, cat("u", F.col("p_partkey"))).otherwise("")
    body = F.when(F.col("p_partkey") % 7 == 0, "[null]").otherwise(cat('[{"summary":{"title":"', F.col("p_name"), '","cover":"', cover, '"}}]'))
    return providers.openbd_records(t(spark, d, "part").select("p_partkey", body.alias("body"))).select("p_partkey", "title", "image_url")


@query("""
WITH w AS (
  SELECT p_partkey AS id, p_brand AS folder, 'Set ' || p_size % 5 || CASE WHEN p_partkey % 3 = 0 THEN ' (' || 1 + p_partkey % 6 || ')' ELSE '' END AS bare, p_partkey % 4 = 0 AS large FROM part),
s AS (SELECT id, folder, CASE WHEN large THEN upper(bare) ELSE bare END AS stem, lower(bare) || '.zip' AS key FROM w),
x AS (SELECT DISTINCT s_nationkey, 'set ' || s_suppkey % 5 || ' (' || 2 + s_suppkey % 3 || ').zip' AS key FROM supplier WHERE s_suppkey % 2 = 0),
e AS (SELECT 'Brand#' || 11 + s_nationkey % 5 AS folder, key FROM x),
r AS (SELECT folder, regexp_replace(key, ' \\([0-9]+\\)\\.zip$', '.zip') AS key, list(DISTINCT CAST(regexp_extract(key, '\\(([0-9]+)\\)\\.zip$', 1) AS BIGINT)) AS numbers
  FROM (SELECT folder, key FROM s UNION SELECT folder, key FROM e) u WHERE key LIKE '%)%' GROUP BY 1, 2),
p AS (SELECT s.*, row_number() OVER (PARTITION BY folder, key ORDER BY id) - CASE WHEN (folder, key) IN (SELECT (folder, key) FROM e) THEN 0 ELSE 1 END AS place FROM s)
SELECT id, stem || CASE WHEN place = 0 THEN '' ELSE ' (' || list_filter(range(2, 3 + place + len(coalesce(numbers, []))), lambda n: NOT list_contains(coalesce(numbers, []), n))[place] || ')' END || '.zip' AS name
FROM p LEFT JOIN r USING (folder, key)
""")
def unique_names(spark, d):
    p, s = t(spark, d, "part"), t(spark, d, "supplier")
    bare = F.concat(cat("Set ", F.col("p_size") % 5), F.when(F.col("p_partkey") % 3 == 0, cat(" (", 1 + F.col("p_partkey") % 6, ")")).otherwise(""))
    stem = F.when(F.col("p_partkey") % 4 == 0, F.upper(bare)).otherwise(bare)
    wanted = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("folder"), stem.alias("stem"), F.lit(".zip").alias("suffix"))
    there = s.where("s_suppkey % 2 = 0").select(cat("Brand#", 11 + F.col("s_nationkey") % 5).alias("folder"), cat("Set ", F.col("s_suppkey") % 5, " (", 2 + F.col("s_suppkey") % 3, ").zip").alias("name"))
    return keyed.unique_names(wanted, "folder", "stem", "suffix", there).select("id", "name")


@query("""
SELECT p_partkey AS id, '[' || p_brand || '] ' || p_type || ' 第' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '巻 [LQ]' || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.rar' AS to_name, '[' || p_brand || '] ' || p_type || '(完)' AS to_folder, false AS loses_volume
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS n FROM part)
""")
def rename_plan(spark, d):
    p = t(spark, d, "part")
    old = cat("[", F.col("p_brand"), "] ", F.col("p_name"))
    f = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("series_id"), cat(old, "/", old, " 第", F.col("p_size"), "巻 [LQ].rar").alias("rel_path"), F.col("p_size").alias("volume_from"), F.col("p_size").alias("volume_to"), F.lit("巻").alias("unit"), F.lit(True).alias("present"))
    s = p.select(F.col("p_partkey").alias("id"), old.alias("folder"), F.col("p_name").alias("title"))
    want = p.select(F.col("p_partkey").alias("series_id"), F.col("p_type").alias("title"), F.col("p_brand").alias("author"), F.lit(True).alias("completed"))
    # series that get one folder name share a folder, so equal names in it are numbered
    return moves.plan_renames(f, s, want).select("id", "to_name", "to_folder", "loses_volume")


@query("""
SELECT id, n FROM (SELECT user_id || '-' || event_type AS id, count(*) AS n, max(epoch_us(ts)) AS last FROM events GROUP BY 1) WHERE last < (SELECT max(epoch_us(ts)) FROM events) - 86400000000
""")
def visits_due(spark, d):
    e = t(spark, d, "events")
    v = e.groupBy(F.concat_ws("-", F.col("user_id"), F.col("event_type")).alias("id")).agg(F.count("*").alias("n"), F.max(F.col("ts").cast("timestamp")).alias("visited"))
    now = e.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return snapshot.due(v, "visited", now, 1).select("id", "n")


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), own AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT k, n FROM own WHERE n > 3)
SELECT k AS series_id, n AS volume_no FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS rn FROM (SELECT b.k, b.n FROM b JOIN own USING (k, n) LEFT JOIN c USING (k, n) WHERE c.k IS NULL)) WHERE rn <= 2
""")
def cover_targets(spark, d):
    x = _tables(spark, d)
    have = x.covers.where("volume_no > 3")
    return covers.targets(x.bib.withColumn("cover_tried_at", F.lit(None).cast("timestamp")), x.volumes, have, budget=2).select("series_id", "volume_no")


@query("""
WITH own AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F'), r AS (SELECT o_orderkey AS k, o_custkey % 4 + 1 AS lo, o_custkey % 4 + 3 AS hi FROM orders)
SELECT r.k AS id, CASE WHEN min(own.n) IS NOT NULL THEN 'c' || min(own.n) END AS cover, min(own.n) IS NOT NULL AS borrowed FROM r LEFT JOIN own ON own.k = r.k AND own.n BETWEEN r.lo AND r.hi GROUP BY r.k
""")
def cover_borrow(spark, d):
    o = t(spark, d, "orders")
    v = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("series_id"), (F.col("o_custkey") % 4 + 1).cast("int").alias("volume_from"), (F.col("o_custkey") % 4 + 3).cast("int").alias("volume_to"), F.lit(numbers.VOLUME).alias("unit"))
    return covers.for_volumes(v, _tables(spark, d).covers).select("id", "cover", "borrowed")


@query("""
SELECT title, first_key, keys FROM (SELECT p_brand AS title, min(p_type) AS first_key, max(p_type) AS last_key, count(DISTINCT p_type) AS keys, min(length(p_type)) AS short FROM part GROUP BY 1)
WHERE keys > 1 AND len(list_filter(generate_series(1, least(length(first_key), length(last_key))), lambda n: left(first_key, n) = left(last_key, n))) < 0.6 * short
""")
def suspect_answers(spark, d):
    p = t(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("title"))
    return moves.suspect_answers(p, p).select("title", F.get("keys", F.lit(0)).alias("first_key"), F.size("keys").cast("long").alias("keys"))


@query("""
SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS window_start, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 5 MINUTE, min(ts))) + 300000000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 600000000
""")
def stream_event_counts(spark, d):
    """A stream closes the windows that the watermark has passed; later ones wait for more events."""
    e = changes.stream_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = changes.drain(changes.event_counts(e), f"{scratch(spark)}/streams")
    return out.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n")
