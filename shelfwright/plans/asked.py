"""Queries over marks, covers, names and plans of single works, made up from the driver's tables so that SQL knows the answer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalars as S
from ..operators import candidates, covers, folding, issues, joins, marks, numbers, snapshot, summaries
from ..session import scratch
from ..sources import archives, files, images, layout, providers, requests, responses
from ..streaming import changes
from . import enrich, moves, scan, shelf
from .named import _LIST, _SHELF, _brand_records, _tables, cat, t
from .named import ORACLE as ORACLE_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def pick(of: F.Column, *values) -> F.Column:
    """The value at ``of`` modulo their number."""
    return F.element_at(F.array(*(v if isinstance(v, F.Column) else F.lit(v) for v in values)), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))


def key() -> F.Column:
    return F.col("p_partkey")


# Listings and responses.


@query("SELECT p_partkey, p_partkey % 5 <> 3 AS content FROM part")
def content_files(spark, d):
    name = cat(F.col("p_name"), pick(key(), ".zip", ".CBZ", ".r01", ".txt", ".003"))
    return t(spark, d, "part").select("p_partkey", S.is_content_file(name).alias("content"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS author FROM part WHERE p_partkey > 0 AND p_partkey % 5 > 0")
def answers_file(spark, d):
    """A tab-separated file with a header, carriage returns and blank titles."""
    title = F.when(key() % 5 == 0, "").otherwise(cat(F.col("p_name"), " ", key()))
    line = F.when(key() == 0, "key\ttitle\tauthor").otherwise(F.concat_ws("\t", cat("k", key()), title, F.when(key() % 3 > 0, F.col("p_brand")).otherwise("")))
    path = f"{scratch(spark)}/answers-{uuid.uuid4().hex}"
    t(spark, d, "part").select(cat(line, "\r").alias("value")).write.text(path)
    return files.read_answers(spark, path).select(F.substring("key", 2, 20).cast("long").alias("id"), "title", "author")


@query("SELECT p_name || ' ' || p_partkey AS title, 'r' || p_partkey AS reading FROM part WHERE p_partkey % 4 > 0")
def title_readings(spark, d):
    item = cat("<item><dc:title> <b>", F.col("p_name"), "</b> ", key(), "</dc:title><x>1</x><dcndl:titleTranscription>", F.when(key() % 4 > 0, cat("r", key())).otherwise(""), "</dcndl:titleTranscription></item>")
    return providers.ndl_readings(t(spark, d, "part").select(item.alias("body")))


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber % 3 AS v, l_returnflag <> 'N' AND l_linestatus = 'F' AS good FROM lineitem),
s AS (SELECT k, v, count(*) FILTER (WHERE good) AS n, count(*) AS records FROM r GROUP BY 1, 2)
SELECT k AS l_orderkey, v AS variant, records FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS rn FROM s) WHERE rn = 1
""")
def best_variants(spark, d):
    lines = t(spark, d, "lineitem")
    r = lines.select("l_orderkey", (F.col("l_linenumber") % 3).alias("variant"), F.when(F.col("l_returnflag") != "N", "i").alias("isbn"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("volume"))
    return providers.best_variant(r, "l_orderkey", "variant").groupBy("l_orderkey", "variant").agg(F.count("*").alias("records"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'quota' WHEN 2 THEN 'auth' WHEN 3 THEN 'other' ELSE 'quota' END AS error_kind, p_partkey % 5 <> 3 AS stop FROM part WHERE p_partkey % 5 > 0
""")
def response_errors(spark, d):
    body = pick(key(), "fine", "Quota exceeded for key", "API key not valid", "broken", "Too Many Requests (credential)")
    r = t(spark, d, "part").select("p_partkey", body.alias("body"), F.when(key() % 5 == 0, 200).otherwise(403).alias("status"))
    return providers.provider_errors(r).select("p_partkey", "error_kind", "stop")


@query("""
SELECT event_id, epoch_us(ts) // 1000000 + CASE WHEN event_type = 'error' THEN 3600 ELSE 90 * 86400 END AS expires FROM events
""")
def response_expiry(spark, d):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return t(spark, d, "events").select("event_id", F.unix_seconds(responses.expiry(status, F.col("ts").cast("timestamp"))).alias("expires"))


@query("""
WITH l AS (SELECT user_id, event_id, event_type <> 'error' AS good, epoch_us(ts) AS us FROM events),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY good DESC, us DESC, event_id DESC) AS rn FROM l) WHERE rn = 1)
SELECT user_id, event_id FROM c WHERE event_id % 3 > 0
""")
def fresh_responses(spark, d):
    e = t(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    log = e.select("user_id", F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), at.alias("fetched_at"), F.timestamp_seconds(F.when(F.col("event_id") % 3 > 0, 2_000_000_000).otherwise(1)).alias("expires_at"))
    return responses.fresh(log, F.timestamp_seconds(F.lit(1_900_000_000))).select("user_id", F.col("id").alias("event_id"))


@query("""
WITH kept AS (SELECT event_id AS id, user_id, ts, ts + INTERVAL 1 HOUR * (event_id % 72) AS expires FROM events WHERE event_type = 'view'),
asked AS (SELECT a.event_id, k.id FROM (SELECT * FROM events WHERE event_type <> 'view') a ASOF JOIN kept k ON a.user_id = k.user_id AND a.ts >= k.ts WHERE a.ts < k.expires)
SELECT id, (SELECT count(*) FROM asked WHERE asked.id = kept.id) AS hits FROM kept
""")
def cached_hits(spark, d):
    """Views are what is fetched, good for up to three days; the other events of a user ask for it."""
    e = t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    log = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("at").alias("fetched_at"), (F.col("at") + F.make_dt_interval(hours=F.col("event_id") % 72)).alias("expires_at"))
    return responses.with_hits(log, e.where("event_type <> 'view'").select(F.col("user_id").alias("key"), "at")).select("id", "hits")


@query("SELECT p_partkey, sha256('ndl' || chr(10) || 'https://x/' || p_partkey) AS key, left(sha256(p_name), 32) || '.jpg' AS name, lower(to_base(p_size, 36)) || '-' || lower(to_base(1700000000000 + p_partkey, 36)) AS version FROM part")
def keys_and_versions(spark, d):
    url = cat("https://x/", key())
    return t(spark, d, "part").select("p_partkey", S.cache_key(F.lit("ndl"), url).alias("key"), S.content_name(F.col("p_name"), F.lit(".jpg")).alias("name"), S.file_version(F.col("p_size"), 1_700_000_000_000 + key()).alias("version"))


@query("""
SELECT p_partkey, [NULL, 'image/jpeg', 'image/png', 'image/webp', NULL][p_partkey % 5 + 1] AS kind, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE '=?UTF-8?B?' || base64(encode(p_name || '巻')) || '?=' END AS header FROM part
""")
def types_and_headers(spark, d):
    name = cat(F.col("p_name"), pick(key(), ".txt", ".JPG", ".png", ".webp", ""))
    return t(spark, d, "part").select("p_partkey", S.content_type(name).alias("kind"), S.header_word(F.when(key() % 2 == 0, F.col("p_name")).otherwise(cat(F.col("p_name"), "巻"))).alias("header"))


@query("""
SELECT p_partkey, p_partkey % 3 > 0 AS allowed, p_partkey % 3 > 0 AND p_size >= 20 AND p_partkey % 7 > 0 AS valid,
  ['https://books.rakuten.co.jp/', 'https://ndlsearch.ndl.go.jp/', 'https://openbd.jp/'][p_partkey % 3 + 1] AS referer,
  '/api/covers/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '?v=' || left(sha256(p_name), 12) ELSE '' END AS shown FROM part
""")
def image_checks(spark, d):
    url = cat(pick(key(), "http://elsewhere/", "https://ndlsearch.ndl.go.jp/thumbnail/", "https://cover.openbd.jp/"), key())
    file = F.when(key() % 2 == 0, S.content_name(F.col("p_name"), F.lit(".jpg")))
    status, digest = F.when(key() % 3 > 0, 200).otherwise(404), F.when(key() % 7 == 0, "blank").otherwise("d")
    return t(spark, d, "part").select("p_partkey", images.allowed(url).alias("allowed"), S.valid_image(status, F.col("p_size") * 100, digest, ["blank"]).alias("valid"), images.referer(url).alias("referer"), images.cover_url(key(), file).alias("shown"))


@query("""
WITH w AS (SELECT o_orderkey AS id, o_custkey AS isbn FROM orders), r AS (SELECT l_partkey AS isbn, l_orderkey * 10 + l_linenumber AS ordinal, l_returnflag <> 'N' AS image, l_linestatus = 'F' AS large FROM lineitem)
SELECT id, ordinal FROM (SELECT w.id, r.ordinal, row_number() OVER (PARTITION BY w.id ORDER BY (image AND large) DESC, image DESC, ordinal) AS rn FROM w JOIN (SELECT isbn, ordinal, bool_or(image) AS image, bool_or(large) AS large FROM r GROUP BY 1, 2) r USING (isbn)) WHERE rn = 1
""")
def record_by_isbn(spark, d):
    w = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("isbn"))
    r = t(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("isbn"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal")).agg(F.bool_or(F.col("l_returnflag") != "N").alias("i"), F.bool_or(F.col("l_linestatus") == "F").alias("large"))
    return requests.by_isbn(w, r.withColumn("image_url", F.when(F.col("i"), "u")).drop("i")).select("id", "ordinal")


@query("""
SELECT p.p_partkey AS id, min(q.p_partkey) AS ordinal FROM part p JOIN part q ON p.p_name = q.p_name AND p.p_size = q.p_size AND (contains(q.p_brand, p.p_brand) OR contains(p.p_brand, q.p_brand)) AND q.p_partkey % 3 > 0 GROUP BY 1
""")
def record_by_title(spark, d):
    p = t(spark, d, "part")
    w = p.select(key().alias("id"), F.upper("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").alias("volume"))
    r = p.select(key().alias("ordinal"), cat(F.col("p_name"), "(", F.col("p_size"), ") ", F.col("p_size")).alias("title"), cat(" ", F.lower("p_brand")).alias("author"), F.when(key() % 3 > 0, "u").alias("image_url"))
    return requests.by_title(w, r, "google").select("id", "ordinal")


# Snapshots, marks and events.


@query("""
SELECT 'r' || l_orderkey % 2 AS root_id, l_partkey % 4 AS folder, NOT (l_orderkey % 2 = 1 AND l_partkey % 4 = 3 AND l_shipdate < TIMESTAMP '1998-01-01') AS present, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
""")
def gone_files(spark, d):
    lines = t(spark, d, "lineitem")
    f = lines.select(cat("r", F.col("l_orderkey") % 2).alias("root_id"), cat("d", F.col("l_partkey") % 4, "/x").alias("rel_path"), F.col("l_shipdate").cast("timestamp").alias("last_seen_at"), F.lit(True).alias("present"), (F.col("l_partkey") % 4).alias("folder"))
    gone = snapshot.mark_gone(f, "r1", F.to_timestamp(F.lit("1998-01-01 00:00:00")), "d3/")
    return gone.groupBy("root_id", "folder", "present").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN true WHEN o_orderkey % 6 = 3 THEN NULL ELSE o_orderkey % 4 = 0 END AS completed_user,
  CASE WHEN o_orderkey % 10 = 0 THEN 'new' || o_orderkey ELSE 'f' || o_orderkey END AS folder, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS visited FROM orders
""")
def human_marks(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders")
    s = o.select(k.alias("id"), cat("f", k).alias("folder"), F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit("t").alias("series_key"), (k % 4 == 0).alias("completed_user"), F.timestamp_seconds(F.lit(0)).alias("enriched_at"))
    none = F.lit(None)
    s = marks.override_completion(s, o.where(k % 3 == 0).select(k.alias("id"), F.when(k % 6 == 0, True).alias("completed_user")))
    s = marks.rename_folders(s, o.where(k % 10 == 0).select(k.alias("id"), cat("new", k).alias("to_folder"), *(none.cast("string").alias(c) for c in ("title", "author", "series_key"))))
    s = marks.visit(s, o.where(k % 9 == 0).select(k.alias("id")), "enriched_at", F.timestamp_seconds(F.lit(1)))
    return s.select("id", "completed_user", "folder", F.unix_seconds("enriched_at").cast("int").alias("visited"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 8 = 0 ELSE p_partkey % 3 = 0 END AS care, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 16 > 0 THEN 'new' WHEN p_partkey % 3 = 0 THEN 'old' END AS note,
  CASE WHEN p_partkey % 5 = 0 THEN 'to/' ELSE 'from/' END || CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE CAST(p_partkey AS VARCHAR) END AS rel_path FROM part
""")
def care_and_moves(spark, d):
    p = t(spark, d, "part")
    f = p.select(key().alias("id"), (key() % 5).alias("series_id"), cat("from/", key()).alias("rel_path"), (key() % 3 == 0).alias("care"), F.when(key() % 3 == 0, "old").alias("care_note"))
    f = marks.set_care(f, p.where(key() % 4 == 0).select(key().alias("id"), (key() % 8 == 0).alias("care"), F.lit("new").alias("note"), (key() % 16 == 0).alias("keep_note")))
    f = marks.move_files(f, p.where(key() % 7 == 0).select(key().alias("id"), F.lit("from/moved").alias("to_path")))
    f = marks.move_below(f, spark.range(1).select(F.lit(0).cast("long").alias("series_id"), F.lit("from").alias("from_folder"), F.lit("to").alias("to_folder")))
    return f.select("id", "care", F.col("care_note").alias("note"), "rel_path")


@query("""
SELECT user_id AS series_id, 'g' || last_value AS group_key FROM (SELECT user_id, max_by(event_id % 4, event_id) AS last_value FROM events GROUP BY 1) WHERE last_value > 0
""")
def picked_groups(spark, d):
    e = t(spark, d, "events")
    p = e.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("query_id"), F.when(F.col("event_id") % 4 > 0, cat("g", F.col("event_id") % 4)).alias("group_key"), F.timestamp_seconds("event_id").alias("picked_at"))
    half = p.where("query_id % 2 = 0")
    return marks.pick(half, p.where("query_id % 2 = 1")).select("series_id", "group_key")


def _events(spark, d):
    at = F.col("ts").cast("timestamp")
    return t(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", at.alias("created_at"), F.when(F.col("event_type") == "view", at).alias("read_at"), F.when(F.col("event_type") == "click", at).alias("notified_at"))


@query("SELECT event_id AS id FROM events WHERE event_type <> 'click' ORDER BY ts, event_id LIMIT 20")
def pending_events(spark, d):
    return snapshot.pending(_events(spark, d)).select("id")


@query("SELECT event_id AS id FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_events(spark, d):
    return snapshot.newest(_events(spark, d), 1000, unread=True).select("id")


@query("SELECT event_id AS id, epoch_us(ts) // 1000000 + CASE WHEN event_type <> 'view' AND event_id % 3 = 0 THEN 5 ELSE 0 END AS read_at FROM events WHERE event_type = 'view' OR event_id % 3 = 0")
def stamped_events(spark, d):
    e = _events(spark, d)
    s = snapshot.stamp(e, e.where("id % 3 = 0"), "read_at", F.timestamp_seconds(F.unix_seconds("created_at") + 5))
    return s.where("read_at is not null").select("id", F.unix_seconds("read_at").alias("read_at"))


@query("""
SELECT l_orderkey AS series_id, 'series_added' AS kind FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'series_completed' FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')
""")
def stream_changes(spark, d):
    """State per series: what the first sight of each tells, and whether it is complete by then."""
    listing = _listed(changes.stream_table(spark, d, "lineitem"))
    return changes.drain(changes.change_events(listing, first_completed=True), f"{scratch(spark)}/streams").select("series_id", "kind")


def _listed(lines):
    number = F.col("l_linenumber")
    return lines.select(F.col("l_orderkey").alias("series_id"), cat("Work ", F.col("l_orderkey")).alias("title"), F.when(F.col("l_suppkey") % 5 == 0, "話").otherwise("巻").alias("unit"), number.alias("volume_from"), (number + F.col("l_partkey") % 3).alias("volume_to"), (F.col("l_returnflag") == "R").alias("completed"), F.lit(False).alias("baseline"))


@query("""
WITH v AS (
  SELECT l_orderkey AS s, CASE WHEN l_suppkey % 5 = 0 THEN '話' ELSE '巻' END AS u, CAST(l_linenumber AS BIGINT) AS lo, l_linenumber + l_partkey % 3 AS hi, l_returnflag = 'R' AS done,
    CASE WHEN l_shipdate < TIMESTAMP '1994-01-01' THEN 1 WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 2 WHEN l_shipdate < TIMESTAMP '1997-06-01' THEN 3 ELSE 4 END AS turn FROM lineitem),
first AS (SELECT s, min(turn) AS turn FROM v GROUP BY s),
fresh AS (SELECT s, u, lo, hi, min(turn) AS turn FROM v GROUP BY s, u, lo, hi),
each AS (SELECT f.*, unnest(range(lo, hi + 1)) AS n FROM fresh f),
held AS (SELECT s, u, n, min(turn) AS since FROM each GROUP BY s, u, n),
added AS (SELECT DISTINCT e.s, e.u, e.lo, e.hi, e.turn FROM each e JOIN held h USING (s, u, n) JOIN first b ON b.s = e.s WHERE h.since >= e.turn AND e.turn > b.turn),
done AS (SELECT s, min(turn) AS turn FROM v WHERE done GROUP BY s)
SELECT s AS series_id, 'series_added' AS kind, 'Work ' || s AS message, turn FROM first
UNION ALL SELECT s, 'volume_added', string_agg('第' || lo || CASE WHEN lo < hi THEN '-' || hi ELSE '' END || u, ' / ' ORDER BY lo, hi, u) || ' が増えました', turn FROM added GROUP BY s, turn
UNION ALL SELECT d.s, 'series_completed', 'Work ' || d.s, d.turn FROM done d JOIN first b ON b.s = d.s WHERE d.turn > b.turn
""")
def stream_turns(spark, d):
    """Four micro-batches by date: works that are new, then the volumes that each later one adds, and works that become complete."""
    lines, at = t(spark, d, "lineitem"), [None, "1994-01-01", "1996-01-01", "1997-06-01", None]
    between = lambda lo, hi: (F.lit(True) if lo is None else F.col("l_shipdate") >= F.lit(lo).cast("timestamp")) & (F.lit(True) if hi is None else F.col("l_shipdate") < F.lit(hi).cast("timestamp"))
    parts = [_listed(lines.where(between(lo, hi))) for lo, hi in zip(at[:-1], at[1:])]
    return changes.drain_in_turns(parts, changes.change_events, f"{scratch(spark)}/streams")


@query("SELECT p_partkey FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 25")
def random_sample(spark, d):
    return summaries.sample(t(spark, d, "part"), "p_partkey", 25, seed=7).select("p_partkey")


# Series and their volumes.


@query("""
WITH own AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F')
SELECT o_orderkey AS series_id, coalesce((SELECT 1100000000 + max(n) FROM own WHERE k = o_orderkey), 1000000000 + o_orderkey) AS added FROM orders
""")
def added_times(spark, d):
    return shelf.summaries_of(_tables(spark, d)).select("series_id", F.unix_seconds("volume_added_at").alias("added"))


@query("""
SELECT l_orderkey AS series_id, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_returnflag <> 'N') AS unreadable_files, coalesce(max(v), 0) AS duplicate_volumes, CAST(coalesce(max(f), 0) AS BIGINT) AS duplicate_files
FROM lineitem LEFT JOIN (SELECT k, count(*) AS v, sum(b - 1) AS f FROM (SELECT l_orderkey AS k, l_linenumber, count(DISTINCT l_partkey) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) WHERE b > 1 GROUP BY 1) x ON k = l_orderkey GROUP BY 1
""")
def series_issues(spark, d):
    x = _tables(spark, d)
    return issues.issues(x.files, x.volumes).select("series_id", "unreadable_files", "duplicate_volumes", "duplicate_files")


@query("SELECT l_orderkey AS series_id, 'side' AS side_label, count(*) AS files FROM lineitem WHERE l_linestatus <> 'F' AND l_returnflag = 'N' GROUP BY 1")
def side_files(spark, d):
    return issues.side_volumes(_tables(spark, d).files).select("series_id", "side_label", F.size("files").cast("long").alias("files"))


@query("SELECT count(*) AS total FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 3 = 2")
def needs_cover_total(spark, d):
    x = _tables(spark, d)
    own = x.series.where("id % 4 = 0").select(F.col("id").alias("series_id"), F.lit("").alias("slot"))
    x.covers = x.covers.unionByName(own, allowMissingColumns=True)
    return shelf.series_list(x, shelf.Options(root_id="r2", needs_cover=True))[1]


@query("""
WITH own AS (SELECT DISTINCT l_linenumber AS n FROM lineitem WHERE l_orderkey = 7 AND l_linestatus = 'F')
SELECT CAST(7 AS BIGINT) AS series_id, (SELECT count(*) FROM own) AS volumes, (SELECT count(*) FROM lineitem WHERE l_orderkey = 7 AND l_linestatus = 'F') AS files,
  (SELECT string_agg('c' || n, ',' ORDER BY n) FROM own) AS covers, (SELECT count(*) FROM lineitem WHERE l_orderkey = 7 AND l_linestatus <> 'F' AND l_returnflag <> 'N') AS loose, (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = 7) AS bib
""")
def one_series(spark, d):
    x = shelf.series_detail(_tables(spark, d), 7)
    each = F.aggregate("volumes", F.lit(0).cast("long"), lambda n, v: n + F.size(v["files"]))
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long")
    return x.select("series_id", size("volumes").alias("volumes"), F.coalesce(each, F.lit(0)).cast("long").alias("files"), F.nullif(F.array_join(F.transform("volumes", lambda v: v["cover"]), ","), F.lit("")).alias("covers"), size("loose").alias("loose"), size("bib").alias("bib"))


@query("SELECT l_orderkey AS series_id, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE contains(lower('Order ' || o_orderkey), 'r 12') ORDER BY lower('Order ' || o_orderkey), 'x' || l_partkey || '.zip' LIMIT 60")
def found_files(spark, d):
    x = _tables(spark, d)
    return shelf.find_files(x, "R 12").select("series_id", F.regexp_extract("rel_path", "x([0-9]+)", 1).cast("long").alias("part"))


@query("SELECT l_orderkey AS series, l_linenumber AS number FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_suppkey % 3 > 0)")
def single_volumes(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.when(F.col("l_suppkey") % 3 == 0, 2).otherwise(0)).alias("hi"))
    return numbers.explode_ranges(lines.where("lo = hi"), ["series"], "lo", "hi")


@query("""
SELECT o_orderkey AS id, coalesce((SELECT count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) FROM lineitem WHERE l_orderkey = o_orderkey), false) AS exact FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def exact_covers(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linenumber").alias("n"))
    return g.select("id", numbers.exact_cover(F.col("n"), F.lit(1), F.size("n")).alias("exact"))


# Covers and enrichment.


@query("""
SELECT coalesce(a.k, b.k) AS series_id, CASE WHEN b.k IS NULL THEN nullif(a.n, 1) ELSE nullif(b.n, 1) END AS volume_no, coalesce(b.isbn, a.isbn) AS isbn, CASE WHEN b.k IS NULL OR a.isbn = b.isbn THEN a.tried END AS tried
FROM (SELECT l_orderkey AS k, l_linenumber AS n, 'i' || min(l_partkey) % 2 AS isbn, min(l_partkey) AS tried FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) a
FULL JOIN (SELECT l_orderkey AS k, l_linenumber AS n, 'i' || min(l_suppkey) % 2 AS isbn FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.k = b.k AND a.n = b.n
""")
def bib_upsert(spark, d):
    lines, n = t(spark, d, "lineitem"), F.nullif(F.col("l_linenumber"), F.lit(1)).alias("volume_no")
    keys = ["l_orderkey", "l_linenumber"]
    head = [F.col("l_orderkey").alias("series_id"), n, F.lit("ndl").alias("provider")]
    old = lines.where("l_linestatus = 'F'").groupBy(*keys).agg(F.min("l_partkey").alias("p")).select(*head, cat("i", F.col("p") % 2).alias("isbn"), F.timestamp_seconds("p").alias("cover_tried_at"), F.lit(None).cast("timestamp").alias("ndl_tried_at"))
    new = lines.where("l_returnflag = 'R'").groupBy(*keys).agg(F.min("l_suppkey").alias("s")).select(*head, cat("i", F.col("s") % 2).alias("isbn"))
    return covers.write_bib(old, new).select("series_id", "volume_no", "isbn", F.unix_seconds("cover_tried_at").alias("tried"))


@query("""
WITH own AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F')
SELECT k AS id FROM own GROUP BY 1 HAVING max(n) <= 4
""")
def settled_works(spark, d):
    x = _tables(spark, d)
    return covers.settled(x.volumes, x.covers.where("volume_no <= 4"), x.series).select("id")


@query("""
WITH own AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F')
SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM own WHERE k = o_orderkey HAVING max(n) <= 4) AND (o_orderkey % 4 = 0 OR o_orderkey % 7 < 3) ORDER BY o_orderkey % 4 > 0, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END, o_orderkey LIMIT 50
""")
def works_to_visit(spark, d):
    x = _tables(spark, d)
    k = F.col("id")
    day = 86400
    visited = F.when(k % 4 > 0, F.timestamp_seconds(1_000_000_000 + k - F.when(k % 7 < 3, 40 * day).otherwise(0)))
    return enrich.works_to_visit(x.series.withColumn("enriched_at", visited), x.volumes, x.covers.where("volume_no <= 4"), F.timestamp_seconds(F.lit(1_000_000_000 + 5 * day)), 30, 50).select("id")


@query("""
SELECT count(*) AS remaining FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <= 3)
""")
def covers_left(spark, d):
    x = _tables(spark, d)
    return enrich.remaining(x.bib.withColumn("cover_tried_at", F.lit(None).cast("timestamp")), x.volumes, x.covers.where("volume_no > 3"))


@query("SELECT ['ndl', 'rakuten', 'google'][l_linenumber % 3 + 1] AS provider, count(*) AS n FROM lineitem GROUP BY 1")
def covers_by_provider(spark, d):
    return enrich.written(t(spark, d, "lineitem").select(pick(F.col("l_linenumber"), "ndl", "rakuten", "google").alias("provider")))


_TIERS = ("google:title:small", "rakuten:title", "ndl:isbn", "openbd:isbn", "google:isbn:large")


@query("""
WITH a AS (SELECT l_orderkey AS k, l_linenumber % 2 AS v, [7, 4, 0, 2, 3][l_suppkey % 5 + 1] AS tier, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity >= 20),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, v ORDER BY tier, p * 1000 + s) AS rn FROM a) WHERE rn = 1)
SELECT coalesce(k, o_orderkey) AS series_id, CAST(coalesce(v, 0) AS INT) AS volume, CASE WHEN o_orderkey % 3 = 0 AND coalesce(v, 0) = 0 THEN 'mine' ELSE 'f' || p END AS file
FROM w FULL JOIN (SELECT o_orderkey, 0 AS z FROM orders WHERE o_orderkey % 3 = 0) ON o_orderkey = k AND z = v
""")
def pasted_covers(spark, d):
    """The waterfall's winners pasted over covers of which some are pinned."""
    lines = t(spark, d, "lineitem")
    slot = cat("v:巻:", F.col("l_linenumber") % 2)
    a = lines.select(F.col("l_orderkey").alias("series_id"), slot.alias("slot"), pick(F.col("l_suppkey"), *_TIERS).alias("tier"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"), cat("f", F.col("l_partkey")).alias("file"), F.col("l_quantity").alias("bytes"))
    own = t(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("series_id"), F.lit("v:巻:0").alias("slot"), F.lit("mine").alias("file"), F.lit(True).alias("pinned"))
    out = enrich.paste(a.select("series_id", "slot").distinct(), a, own, F.col("bytes") >= 20)
    return out.select("series_id", S.slot_volume_no(F.col("slot")).alias("volume"), "file")


@query("""
SELECT s_suppkey AS series_id, 'side' || s_suppkey % 5 AS side_label, (SELECT min(c_custkey) FROM customer WHERE c_custkey % 100 = s_suppkey AND c_nationkey % 5 = s_suppkey % 5) AS isbn FROM supplier WHERE s_suppkey % 5 > 0
""")
def side_matches(spark, d):
    labels = t(spark, d, "supplier").select(F.col("s_suppkey").alias("series_id"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(cat("side", F.col("s_suppkey") % 5)).alias("side_label"), cat("k", F.col("s_suppkey") % 5).alias("key"))
    recs = t(spark, d, "customer").select((F.col("c_custkey") % 100).alias("series_id"), cat("k", F.col("c_nationkey") % 5).alias("key"), F.col("c_custkey").alias("isbn"), F.lit("u").alias("image_url"), F.col("c_custkey").alias("ordinal"))
    return covers.side_targets(labels, recs).select("series_id", "side_label", F.col("record.isbn").alias("isbn"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'series' WHEN 1 THEN 'side' WHEN 2 THEN 'volume' END AS kind, CASE WHEN s_suppkey % 4 = 2 THEN s_nationkey + 1 END AS lo, CASE s_suppkey % 4 WHEN 0 THEN '代表表紙' WHEN 1 THEN 'a:' || s_nationkey WHEN 2 THEN '第' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || '巻' END AS label FROM supplier")
def read_slots(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    slot = pick(k, F.lit(""), cat("s:a:", n), enrich.slot_of((n + 1)), cat("v:巻:", n + 2, "-", n + 1))
    s = t(spark, d, "supplier").withColumn("slot", slot)
    return s.select("s_suppkey", S.parse_slot(F.col("slot"))["kind"].alias("kind"), S.slot_volume_no(F.col("slot")).alias("lo"), S.slot_label(F.col("slot")).alias("label"))


@query("""
SELECT l_orderkey AS series_id, slot IS NOT NULL AS has_cover, coalesce(pin, false) AS pinned, EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = q.l_orderkey AND x.l_linestatus = 'F') AS has_volume_cover
FROM (SELECT DISTINCT l_orderkey FROM lineitem) q LEFT JOIN (SELECT DISTINCT l_orderkey AS k, 'v' AS slot, l_orderkey % 2 = 0 AS pin FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1) c ON k = l_orderkey
""")
def cover_probes(spark, d):
    x = _tables(spark, d)
    asked = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("series_id"), F.lit("v:巻:1").alias("slot")).distinct()
    return images.probes(asked, x.covers.withColumn("pinned", F.col("series_id") % 2 == 0)).select("series_id", "has_cover", "pinned", "has_volume_cover")


# Records and groups.


def _records(spark, d, more: str = "") -> DataFrame:
    p, none = t(spark, d, "part"), F.lit(None).cast("string")
    return p.select(
        F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("query_id"), key().cast("int").alias("ordinal"), pick(key(), "ndl", "rakuten").alias("provider"), cat(F.col("p_name"), more, "（", F.col("p_size"), "）").alias("title"),
        none.cast("int").alias("volume"), pick(key(), F.col("p_type"), none).alias("author"), F.lit("p").alias("publisher"), cat(1990 + key() % 30, ".5").alias("date"), cat("i", key()).alias("isbn"), F.when(key() % 4 == 0, cat("u", key())).alias("image_url"), none.alias("link"),
    )


def _groups(spark, d) -> DataFrame:
    return candidates.groups(folding.fold_candidates(candidates.normalise(_records(spark, d))))


_BRAND = "CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT)"


@query(f"SELECT query_id, title, volume, isbn FROM (SELECT {_BRAND} AS query_id, p_name AS title, p_size AS volume, 'i' || p_partkey AS isbn, row_number() OVER (PARTITION BY p_brand, p_name, p_size ORDER BY p_partkey % 30, p_partkey % 2, p_partkey) AS rn FROM part) WHERE rn = 1")
def edition_map(spark, d):
    m = candidates.volume_map(_groups(spark, d))
    return m.select("query_id", F.col("item.base_title").alias("title"), "volume", F.col("item.isbn").alias("isbn"))


@query(f"SELECT {_BRAND} AS query_id, p_name AS title, string_agg('i' || p_partkey, ',' ORDER BY p_size, p_partkey % 30, p_partkey % 2, p_partkey) AS items, CAST(min(1990 + p_partkey % 30) AS INT) AS first_year, CAST(max(1990 + p_partkey % 30) AS INT) AS last_year FROM part GROUP BY 1, 2")
def group_items(spark, d):
    return _groups(spark, d).select("query_id", "title", F.array_join(F.transform("items", lambda x: x["isbn"]), ",").alias("items"), "first_year", "last_year")


@query("""
WITH c AS (SELECT c_custkey AS query_id, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS w FROM customer)
SELECT query_id, 'Work ' || w AS title, '1,2,3' AS volumes FROM c UNION ALL SELECT query_id, 'Other ' || w || ' story', '1,2' FROM c UNION ALL SELECT query_id, 'Longname ' || w || ' alpha omega', '1,2,3' FROM c
UNION ALL SELECT query_id, 'Longname ' || w || ' 完全版 omega', '4' FROM c WHERE query_id % 2 = 0
""")
def folded_groups(spark, d):
    """A volume's own subtitle, lines that differ by a number, an inserted subtitle, and another book, which stays."""
    k = F.col("c_custkey")
    w = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    titles = [cat("Work ", w, "（1）"), cat("Work ", w, "（2）"), cat("Work ", w, " Sub（3）"), cat("Other ", w, " 1 story"), cat("Other ", w, " 2 story")]
    titles += [cat("Longname ", w, " alpha omega（1）"), cat("Longname ", w, " alpha omega（2）"), cat("Longname ", w, " alpha beta omega（3）"), F.when(k % 2 == 0, cat("Longname ", w, " 完全版 omega（4）"))]
    none = F.lit(None).cast("string")
    r = t(spark, d, "customer").select(k.alias("query_id"), F.posexplode(F.array(*titles)).alias("ordinal", "title")).where("title is not null")
    r = r.select("query_id", "ordinal", F.lit("ndl").alias("provider"), "title", none.cast("int").alias("volume"), *(none.alias(c) for c in ("author", "publisher", "date", "isbn", "image_url", "link")))
    g = candidates.groups(folding.fold_candidates(candidates.normalise(r)))
    return g.select("query_id", "title", F.array_join("volumes", ",").alias("volumes"))


@query(f"SELECT query_id, title, CAST(row_number() OVER (PARTITION BY query_id ORDER BY v DESC, n DESC, first) AS INT) AS place FROM (SELECT {_BRAND} AS query_id, p_name AS title, count(DISTINCT p_size) AS v, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2)")
def group_order(spark, d):
    return _groups(spark, d).select("query_id", "title", "place")


@query(f"SELECT {_BRAND} AS query_id, p_name AS title, count(*) AS images, CAST(sum(p_partkey) AS BIGINT) AS total FROM part WHERE p_partkey % 4 = 0 GROUP BY 1, 2")
def group_images(spark, d):
    g = _groups(spark, d)
    i = candidates.image_candidates(g).join(g.select("query_id", "group_key", "title"), ["query_id", "group_key"])
    return i.groupBy("query_id", "title").agg(F.count("*").alias("images"), F.sum(F.substring("item.image_url", 2, 20).cast("long")).alias("total"))


@query(f"SELECT {_BRAND} AS query_id, p_name AS title, count(*) AS n, string_agg(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'ndl' ELSE 'rakuten' END, ',' ORDER BY CASE WHEN p_partkey % 2 = 0 THEN 'ndl' ELSE 'rakuten' END) AS providers FROM part GROUP BY 1, 2")
def searched_groups(spark, d):
    r = _records(spark, d)
    g = enrich.search({p: r.where(F.col("provider") == p) for p in ("ndl", "rakuten")})
    return g.select("query_id", "title", F.col("n_items").cast("long").alias("n"), F.array_join("providers", ",").alias("providers"))


@query(f"""
WITH m AS (SELECT {_BRAND} AS q, p_name, p_size, 'i' || p_partkey AS isbn, row_number() OVER (PARTITION BY p_brand, p_name, p_size ORDER BY p_partkey % 30, p_partkey % 2, p_partkey) AS rn FROM part),
chosen AS (SELECT q, min(p_name) AS p_name FROM m WHERE q % 2 = 0 GROUP BY 1)
SELECT q + 100 AS series_id, p_size AS volume_no, isbn FROM m JOIN chosen USING (q, p_name) WHERE rn = 1 UNION ALL SELECT q + 100, 1, 'old' FROM (SELECT DISTINCT q FROM m WHERE q % 2 = 1)
""")
def picked_bib(spark, d):
    g = _groups(spark, d)
    picks = g.where("query_id % 2 = 0").groupBy("query_id").agg(F.min_by("group_key", "title").alias("group_key")).select((F.col("query_id") + 100).alias("series_id"), "query_id", "group_key")
    bib = g.select((F.col("query_id") + 100).alias("series_id")).distinct().select("series_id", F.lit(1).alias("volume_no"), F.lit("ndl").alias("provider"), F.lit("old").alias("isbn"))
    return enrich.apply_pick(bib, g, picks, F.timestamp_seconds(F.lit(0))).select("series_id", "volume_no", "isbn")


@query("""
SELECT l_orderkey AS series_id, l_linenumber AS volume, l_partkey AS isbn FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey * 1000 + l_suppkey) AS rn FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F') WHERE rn = 1
""")
def enriched_volumes(spark, d):
    lines = t(spark, d, "lineitem")
    title = F.when(F.col("l_linestatus") == "F", cat("Order ", F.col("l_orderkey"), " : sub")).otherwise("Another work")
    r = lines.select(F.col("l_orderkey").alias("series_id"), title.alias("title"), F.col("l_linenumber").alias("volume"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("isbn"), F.col("l_shipdate").cast("string").alias("date"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"))
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cat("Order ", F.col("o_orderkey")).alias("title"))
    return enrich.enrich(r, s).select("series_id", "volume", "isbn")


# Names.


@query("SELECT p_partkey, p_name AS base, p_size AS volume FROM part")
def split_titles(spark, d):
    """A volume as each provider writes it: in kanji, twice, before 巻, or bare before a subtitle."""
    n = F.col("p_size")
    digits = [F.lit(x) for x in "〇一二三四五六七八九"]
    tens, ones = (n / 10).cast("int"), n % 10
    kanji = F.when(n < 10, pick(ones, *digits)).otherwise(F.concat(F.when(tens == 1, "").otherwise(pick(tens, *digits)), F.lit("十"), F.when(ones == 0, "").otherwise(pick(ones, *digits))))
    by_place = F.when(n < 10, pick(ones, *digits)).otherwise(F.concat(pick(tens, *digits), pick(ones, *digits)))
    name = F.col("p_name")
    texts = [cat(name, "（", kanji, "）"), cat(name, " 第", by_place, "巻"), cat(name, "(", n, ") ", n), cat(name, " ", n, " ─sub─"), cat(name, " 第", n, "巻")]
    found = [R.split_rakuten(texts[0]), R.split_rakuten(texts[1]), R.split_google(texts[2]), R.split_title(texts[3]), R.split_title(texts[4])]
    out = found[0]
    for k in range(1, 5):
        out = F.when(key() % 5 == k, found[k]).otherwise(out)
    return t(spark, d, "part").select("p_partkey", out.alias("x")).select("p_partkey", "x.base", "x.volume")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || p_brand WHEN 1 THEN 'First ' || p_name ELSE p_name END AS author, 'A' || p_partkey || '×Bob ' || n || ',A' || p_partkey || ',Bob,' || n AS variants FROM (SELECT *, lpad(CAST(p_size AS VARCHAR), 2, '0') AS n FROM part)
""")
def author_names(spark, d):
    """Kanji names join, Latin ones turn; a field of several people gives the whole and each of two characters or more."""
    raw = pick(key(), cat("姓", F.col("p_name"), ", ", F.col("p_brand"), ", 1950-"), cat(F.col("p_name"), ", First, 1828-1910"), F.col("p_name"))
    name = F.regexp_replace(R.tidy_author(raw), "^姓", "")
    v = R.author_variants(cat("A", key(), "×Bob ", F.lpad(F.col("p_size").cast("string"), 2, "0")))
    return t(spark, d, "part").select("p_partkey", name.alias("author"), F.array_join(v, ",").alias("variants"))


@query("SELECT p_partkey, replace(p_name, ' ', '') || 'subx,' || replace(p_name, ' ', '') || 'sub,' || replace(p_name, ' ', '') AS keys FROM part")
def keys_of_titles(spark, d):
    keys = R.title_keys(cat(F.col("p_name"), " : sub（x）"))
    return t(spark, d, "part").select("p_partkey", F.array_join(keys, ",").alias("keys"))


@query("""
SELECT p_partkey, starts_with(p_name, a) OR starts_with(a, p_name) OR a = p_type OR (a <> '' AND (starts_with(p_type, a) OR starts_with(a, p_type))) AS keys_fit, contains(replace(lower(p_name), ' ', ''), replace(lower(a), ' ', '')) AS authors_fit
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_name || 'x' ELSE substr(p_name, CAST(p_partkey % 2 + 1 AS INT), CAST(p_size % 6 + 1 AS INT)) END AS a FROM part)
""")
def fitting_names(spark, d):
    p = t(spark, d, "part")
    a = F.when(key() % 3 == 0, cat(F.col("p_name"), "x")).otherwise(F.substring(F.col("p_name"), (key() % 2 + 1).cast("int"), (F.col("p_size") % 6 + 1).cast("int")))
    p = p.withColumn("a", a)
    fits = joins.keys_compatible(F.array("p_name", "p_type"), F.array("a", F.lit("")))
    return p.select("p_partkey", fits.alias("keys_fit"), F.when(key() % 3 == 0, False).otherwise(joins.authors_compatible(F.upper("p_name"), F.col("a"))).alias("authors_fit"))


@query("""
SELECT p_partkey, '[' || replace(p_brand, '#', '') || '] ' || p_name || '？ 第' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '巻 [LQ]' AS volume_name, '[' || replace(p_brand, '#', '') || '] ' || p_name || '？(完)' AS folder_name,
  '[' || replace(p_brand, '#', '') || '] ' || p_name || '？ side' AS side_name, p_name || '： a' AS safe FROM part
""")
def planned_names(spark, d):
    n, author, title = F.col("p_size"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), cat(F.col("p_name"), "?")
    no = F.lit(False)
    return t(spark, d, "part").select("p_partkey", R.volume_name(author, title, n, n, F.lit("巻"), no, F.lit(" [LQ]")).alias("volume_name"), R.folder_name(author, title, F.lit(True)).alias("folder_name"), R.side_name(author, title, F.lit("side")).alias("side_name"), R.sanitize(cat(F.col("p_name"), ":  a. .")).alias("safe"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size END AS volume, CASE p_partkey % 3 WHEN 1 THEN 'side story' END AS side_label, CASE WHEN p_partkey % 3 = 1 THEN 'side story' ELSE CAST(p_size AS VARCHAR) END AS rest FROM part
""")
def bare_names(spark, d):
    """A number behind the folder's title is a volume, other words name a side story."""
    work = cat("[", F.col("p_brand"), "] ", F.col("p_name"))
    tail = F.when(key() % 3 == 1, "side story").otherwise(F.col("p_size").cast("string"))
    e = t(spark, d, "part").select("p_partkey", R.parse_library_entry(cat(work, "/", work, " ", tail, ".zip")).alias("e"), R.rest_after_folder(cat(F.col("p_name"), " ", tail), F.upper("p_name")).alias("rest"))
    return e.select("p_partkey", F.col("e.volume_from").alias("volume"), "e.side_label", "rest")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'kashuppan' WHEN 1 THEN 'vinrandosaga' WHEN 2 THEN 'kyotootawa' WHEN 3 THEN 'jojonofushigi' WHEN 4 THEN 'chibimaruko' ELSE 'feariteiru2' END AS latin, lower(p_name) || '12' AS folded, CAST(length(p_name) + 1 AS INT) AS start, CAST(length(p_name) + 1 + length(CAST(p_size AS VARCHAR)) + 2 AS INT) AS stop FROM part")
def folded_texts(spark, d):
    f = R.find_volume(cat(F.col("p_name"), " 第", F.col("p_size"), "巻"))
    return t(spark, d, "part").select("p_partkey", R.romaji(F.element_at(F.array(*map(F.lit, ("カ シュッパーン", "ヴィンランド　サガ", "キョートオータワー", "ジョジョノフシギ", "チビマルコ", "フェアリーテイル2"))), (key() % 6 + 1).cast("int"))).alias("latin"), F.lower(R.nfkc(cat(F.col("p_name"), "１２"))).alias("folded"), f["start"].alias("start"), f["stop"].alias("stop"))


@query("SELECT p_partkey, '作品' || p_partkey AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS author, p_size AS volume, CASE WHEN p_partkey % 3 = 0 THEN '話' ELSE '巻' END AS unit FROM part")
def japanese_inbox(spark, d):
    author = F.when(key() % 2 == 0, cat("[", F.col("p_brand"), "]_")).otherwise("")
    number = F.when(key() % 3 == 0, cat("ch", F.col("p_size"))).otherwise(cat("_v", F.lpad(F.col("p_size").cast("string"), 2, "0"), "_LQ"))
    n = R.parse_inbox_name(cat("Raw-Zip.Com-", author, "作品", key(), number, ".rar.rar"))
    return t(spark, d, "part").select("p_partkey", n.alias("n")).select("p_partkey", "n.title", "n.author", F.col("n.volume_from").alias("volume"), "n.unit")


# Plans.


@query("SELECT replace(p_name, ' ', '') AS key, CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS VARCHAR) ELSE min(p_size) || '-' || max(p_size) END AS volumes, count(*) AS files FROM part GROUP BY 1")
def inbox_questions(spark, d):
    name = cat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "_", F.col("p_size"), ".zip")
    return files.questions(moves.inbox_works(t(spark, d, "part").select(name.alias("name")))).select("key", "volumes", "files")


@query("SELECT replace(p_name, ' ', '') AS key, replace(p_name, ' ', '_') AS label, count(*) AS files, min(p_size) AS first FROM part GROUP BY 1, 2")
def folded_inbox(spark, d):
    name = cat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "_", F.lpad(F.col("p_size").cast("string"), 2, "0"), ".rar")
    f = moves.fold_inbox(moves.inbox_works(t(spark, d, "part").select(name.alias("name"))))
    return f.select("key", "label", F.size("files").cast("long").alias("files"), F.get("files", F.lit(0))["volume_from"].alias("first"))


_PREFIX = """
WITH l AS (SELECT c_custkey AS id, 'customer' || c_custkey AS a FROM customer), r AS (SELECT s_suppkey AS n, 'customer' || s_suppkey * 3 AS b FROM supplier),
same AS (SELECT id, n FROM l JOIN r ON a = b), near AS (SELECT id, min(n) AS n FROM l JOIN r ON starts_with(a, b) OR starts_with(b, a) WHERE id NOT IN (SELECT id FROM same) GROUP BY 1)
"""


@query(_PREFIX + "SELECT 'customer' || id AS key, n AS series_id FROM (SELECT * FROM same UNION ALL SELECT * FROM near)")
def reading_matches(spark, d):
    w = t(spark, d, "customer").select(cat("customer", F.col("c_custkey")).alias("key"))
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").select(k.alias("id"), F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit("r").alias("reading"), cat("customer", k * 3).alias("reading_key"))
    return moves.match_by_reading(w, s).select("key", "series_id")


@query("""
WITH l AS (SELECT c_custkey AS id, c_name AS a FROM customer), r AS (SELECT DISTINCT substr(c_name, 1, CAST(14 + c_custkey % 5 AS INT)) AS b FROM customer WHERE c_custkey % 3 > 0),
same AS (SELECT id, a AS b FROM l WHERE a IN (SELECT b FROM r)), near AS (SELECT id, min(b) AS b FROM l JOIN r ON starts_with(a, b) OR starts_with(b, a) WHERE id NOT IN (SELECT id FROM same) GROUP BY 1)
SELECT c_custkey AS id, 'r' || lower(replace(b, '#', '')) AS reading_key FROM customer LEFT JOIN (SELECT * FROM same UNION ALL SELECT * FROM near) x ON x.id = c_custkey
""")
def shelf_readings(spark, d):
    c = t(spark, d, "customer")
    s = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("a").alias("author"), F.lit("f").alias("folder"))
    r = c.where("c_custkey % 3 > 0").select(F.substring(F.col("c_name"), F.lit(1), (F.col("c_custkey") % 5 + 14).cast("int")).alias("title")).distinct().select("title", cat("R", F.col("title")).alias("reading"))
    found = moves.shelf_with_readings(s, r)
    return found.select("id", F.nullif(F.col("reading_key"), F.lit("")).alias("reading_key"))


@query("""
SELECT 'p' || p_partkey || 'x' AS key, CASE WHEN p_partkey % 3 > 0 THEN 'answer' ELSE 'skipped' END AS via, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '[A] ' ELSE '' END || 'Title ' || p_partkey || ' 第' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '巻.rar' END AS to_name,
  CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '[A] ' ELSE '' END || 'Title ' || p_partkey END AS folder FROM part
""")
def inbox_moves(spark, d):
    p = t(spark, d, "part")
    w = moves.inbox_works(p.select(cat("P", key(), "x_", F.lpad(F.col("p_size").cast("string"), 2, "0"), ".rar").alias("name")))
    answers = p.where(key() % 3 > 0).select(cat("p", key(), "x").alias("key"), cat("Title ", key()).alias("title"), F.when(key() % 2 == 0, "A").alias("author"))
    none = p.limit(0).select(F.col("p_name").alias("key"), F.col("p_name").alias("shelf_title"), F.col("p_name").alias("shelf_author"))
    return moves.plan_moves(w, answers, none, "/shelf").select("key", "via", "to_name", "folder")


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'kept name' WHEN 2 THEN 'chapters' ELSE 'answer' END AS bucket, count(*) AS files, count(DISTINCT p_name) AS works FROM part GROUP BY 1")
def move_buckets(spark, d):
    m = t(spark, d, "part").select(F.when(key() % 4 == 0, "skipped").otherwise("answer").alias("via"), F.when(key() % 4 == 2, "話").otherwise("巻").alias("unit"), (key() % 4 == 1).alias("keep_name"), F.col("p_name").alias("work"))
    return moves.bucket_counts(m)


@query("""
SELECT l_orderkey AS series_id, count(*) FILTER (WHERE l_linestatus = 'F') AS moves, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_returnflag <> 'N') AS stuck FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag <> 'N' GROUP BY 1
""")
def rename_report(spark, d):
    """Volumes get new names; files whose rest cannot be told stay."""
    k = F.col("l_orderkey")
    f = t(spark, d, "lineitem").where((F.col("l_linestatus") == "F") | (F.col("l_returnflag") != "N"))
    n = F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))
    name = F.when(n.isNotNull(), cat("[A] Old ", k, " 第", n, "巻.zip")).otherwise("other.zip")
    f = f.select(F.monotonically_increasing_id().alias("id"), k.alias("series_id"), cat("[A] Old ", k, "/", name).alias("rel_path"), n.alias("volume_from"), n.alias("volume_to"), F.lit("巻").alias("unit"), F.lit(True).alias("present"))
    ids = f.select("series_id").distinct()
    s = ids.select(F.col("series_id").alias("id"), cat("[A] Old ", F.col("series_id")).alias("folder"), cat("Old ", F.col("series_id")).alias("title"))
    plan = moves.plan_renames(f, s, ids.select("series_id", cat("New ", F.col("series_id")).alias("title"), F.lit("A").alias("author"), F.lit(False).alias("completed")))
    return moves.rename_summary(plan).select("series_id", "moves", "stuck")


@query("""
SELECT l_orderkey * 100 + l_linenumber AS volume_id, count(*) AS n FROM lineitem WHERE l_partkey > (SELECT min(x.l_partkey) FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber = lineitem.l_linenumber) GROUP BY 1
""")
def attic_files(spark, d):
    lines = t(spark, d, "lineitem")
    v = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    f = lines.select(v.alias("volume_id"), F.col("l_partkey").alias("id"), F.col("l_partkey").alias("base"), F.lit("x").alias("rel_path"), F.lit(True).alias("present"))
    keep = f.groupBy("volume_id").agg(F.min("base").alias("keep_base"))
    return moves.keep_one(f, keep).groupBy("volume_id").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'not on the shelf' WHEN 1 THEN 'holds chapters' WHEN 2 THEN 'no volumes could be read' WHEN 3 THEN 'holds one volume' WHEN 4 THEN 'is a part' WHEN 5 THEN 'is no ZIP' END AS reason FROM part
""")
def split_reasons(spark, d):
    k = key() % 7
    p = t(spark, d, "part").select("p_partkey", (k != 0).alias("present"), F.when(k == 1, "話").otherwise("巻").alias("unit"), F.when(k != 2, F.lit(1)).alias("volume_from"), F.when(k == 3, 1).otherwise(4).alias("volume_to"), F.when(k == 4, ".part1").otherwise("").alias("part"), F.when(k == 5, ".rar").otherwise(".CBZ").alias("ext"))
    return p.select("p_partkey", moves.split_eligibility().alias("reason"))


@query("""
SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 0 THEN 'folders' WHEN 1 THEN 'nested' ELSE 'refuse' END AS kind, CASE WHEN p_partkey % 4 < 2 THEN p_size || ',' || p_size + 1 END AS volumes, CASE p_partkey % 4 WHEN 2 THEN 'pages stand outside of folders' WHEN 3 THEN 'the parts are not the volumes' END AS reason FROM part
""")
def split_volumes(spark, d):
    n, k = F.col("p_size"), key() % 4
    page = lambda at, x: cat("work/第", at, "巻/", x, ".jpg")
    none = F.array().cast("array<string>")
    names = F.when(k == 0, F.array(page(n + 1, "1"), page(n, "2"), page(n, "10"))).when(k == 2, F.array(F.lit("1.jpg"), F.lit("2.jpg"))).when(k == 3, F.array(page(n, "1"), page(n + 2, "1"))).otherwise(none)
    skipped = F.when(k == 1, F.array(cat("第", n + 1, "巻.zip"), cat("x ", n, ".rar"))).otherwise(none)
    i = t(spark, d, "part").select(key().alias("file_id"), names.alias("names"), skipped.alias("skipped"), (k == 1).alias("nested"), n.alias("lo"), (n + 1).alias("hi"))
    return archives.split_plans(i).select("file_id", "kind", F.nullif(F.array_join(F.transform("parts", lambda x: x["volume"]), ","), F.lit("")).alias("volumes"), "reason")


@query("""
SELECT 'files' AS name, count(*) AS n FROM part UNION ALL SELECT 'volumes', count(*) FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT 'side', count(*) FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT 'single', count(*) FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT 'unreadable', 0 UNION ALL SELECT 'drift', 0 UNION ALL SELECT 'collisions', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1)
""")
def name_probe(spark, d):
    work = cat("[", F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), "] ", F.col("p_name"))
    tail = pick(key(), cat(" 第", F.col("p_size"), "巻"), cat(" ", F.col("p_size")), F.lit(" side"), F.lit(""))
    p = files.parse_files(t(spark, d, "part").select(cat(work, "/", work, tail, ".zip").alias("rel_path")))
    return scan.probe(p.withColumn("file_title", F.col("title")))


# Tables laid out by root, and by series.


@query("""
WITH p AS (SELECT p_partkey AS k, 'r' || p_partkey % 2 AS root_id, 'Work ' || p_size % 12 AS folder, p_partkey % 5 <> 0 AS one, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 7 <> 0 ELSE p_partkey % 3 <> 0 END AS two, p_partkey % 2 = 1 OR p_size % 12 = 7 AS again FROM part)
SELECT root_id, folder || '/' || folder || ' 第' || k || '巻.zip' AS rel_path, CASE WHEN again THEN two ELSE true END AS present,
  CASE WHEN one THEN 1 + k % 2 WHEN root_id = 'r1' THEN 3 ELSE 4 END AS first_day, CASE WHEN again AND two THEN CASE WHEN root_id = 'r1' THEN 3 ELSE 4 END ELSE 1 + k % 2 END AS last_day
FROM p WHERE one OR again AND two
""")
def rooted_scans(spark, d):
    """Two roots are scanned, then one of them again, then one folder of the other."""
    p = t(spark, d, "part")
    key, folder = F.col("p_partkey"), cat("Work ", F.col("p_size") % 12)
    p = p.select(key, folder.alias("folder"), cat("r", key % 2).alias("root_id"), cat(folder, "/", folder, " 第", key, "巻.zip").alias("rel_path"), key.alias("size"), F.lit(datetime(2024, 1, 1, 12, tzinfo=UTC)).alias("mtime"))
    tables = layout.Rooted(spark, f"{scratch(spark)}/rooted/{uuid.uuid4().hex}", shelves=4)
    for day, root, under, some in ((1, "r0", None, key % 5 != 0), (2, "r1", None, key % 5 != 0), (3, "r1", None, key % 7 != 0), (4, "r0", "Work 7", (key % 3 != 0) & (F.col("folder") == "Work 7"))):
        listing = p.where((F.col("root_id") == root) & some).select("root_id", "rel_path", "size", "mtime")
        scan.scan_root(tables, listing, root, datetime(2024, 1, day, 12, tzinfo=UTC), under)
    f = tables.read("files", scan.FILES)
    return f.select("root_id", "rel_path", "present", F.dayofmonth("first_seen_at").cast("long").alias("first_day"), F.dayofmonth("last_seen_at").cast("long").alias("last_day"))


@query(_SHELF + "SELECT * FROM list")
def shelf_by_series(spark, d):
    """The list of works over tables that lie bucketed by series."""
    made = layout.save_by_series(vars(_tables(spark, d)), f"{scratch(spark)}/by_series/{uuid.uuid4().hex}", 16, {"series": "id"})
    return shelf.summaries_of(shelf.Tables(**made)).select(*_LIST)


# Pages by place, sketches, groups in SQL, work in rounds.


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderpriority DESC, o_custkey, o_orderkey LIMIT 60 OFFSET 120")
def keyset_pages(spark, d):
    """The third page: each begins behind the place where the one before it ended."""
    o, order, at = t(spark, d, "orders"), [("o_orderpriority", True), ("o_custkey", False), ("o_orderkey", False)], None
    for _ in range(2):
        at = summaries.place_of(summaries.page_after(o, order, at), order)
    return summaries.page_after(o, order, at).select("o_orderkey", "o_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, true AS within FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2")
def sketch_medians(spark, d):
    """Medians out of sketches kept by year, and whether their ranks are as close as promised."""
    key = ["l_returnflag", "l_linestatus"]
    lines = t(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    m = summaries.merge_sketches(summaries.sketches(lines, [*key, "year"], "l_extendedprice"), key).select(*key, "n", summaries.quantile("sketch", 0.5).alias("median"))
    at = lines.join(F.broadcast(m), key).groupBy(*key, "n").agg((F.count_if(F.col("l_extendedprice") < F.col("median")) / F.count("*")).alias("below"), (F.count_if(F.col("l_extendedprice") <= F.col("median")) / F.count("*")).alias("upto"))
    return at.select(*key, "n", ((F.col("below") <= 0.5 + summaries.SKETCH_ERROR) & (F.col("upto") >= 0.5 - summaries.SKETCH_ERROR)).alias("within"))


@query(ORACLE_OF["candidate_groups"])
def grouped_in_sql(spark, d):
    """The groups of records by the table function."""
    candidates.register(spark)
    items = candidates.normalise(_brand_records(spark, d))
    g = candidates.groups(spark.sql("SELECT * FROM group_candidates(TABLE({items}))", items=items))
    return g.select(cat("Brand#", F.col("query_id")).alias("query_id"), "title", F.col("n_items").cast("long").alias("n_items"), F.size("volumes").cast("long").alias("n_volumes"), "first_year")


@query("""
SELECT (place - 1) // 400 AS batch, count(*) AS tried, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS done
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P') w WHERE place <= 1200 GROUP BY 1
""")
def background_rounds(spark, d):
    """Three rounds of 400 each: what is due longest and was not tried yet; a quarter of the attempts come to nothing."""
    at = f"{scratch(spark)}/rounds/{uuid.uuid4().hex}"
    for k in range(3):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(f"{at}/ticks")
    open_ = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due"))
    rounds = changes.Rounds(spark, f"{at}/ledger", 400)
    ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/ticks")
    rounds.run(ticks, f"{at}/checkpoint", lambda batch: datetime(2024, 1, 1 + batch, tzinfo=UTC), lambda _, claims: open_.join(claims, "id", "left_anti"), lambda some: some.where("id % 4 <> 0")).awaitTermination()
    return rounds.progress()
