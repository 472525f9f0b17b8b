"""The catalogue's operators on small literal tables."""

import random
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfwright.functions import registry, scalars
from shelfwright.operators import candidates, covers, folding, issues, joins, keyed, numbers, snapshot, summaries
from shelfwright.plans import moves, shelf
from shelfwright.sources import archives, files, providers, responses

T0 = datetime(2024, 1, 1)
NDL = "query_id long, ordinal int, provider string, title string, volume int, author string, publisher string, date string, isbn string, image_url string, link string"


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


VOL = "id long, series_id long, volume_from int, volume_to int, unit string, completed boolean, present boolean, first_seen_at timestamp"


def volumes(spark, data):
    return spark.createDataFrame([(i, s, a, b, u, False, p, T0 + timedelta(days=i)) for i, (s, a, b, u, p) in enumerate(data)], VOL)


def test_holdings(spark):
    v = volumes(spark, [(1, 1, 3, "巻", True), (1, 5, 5, "巻", True), (2, 1, 2, "巻", True), (2, 3, 4, "話", True), (3, 1, 1, "巻", True), (3, 2, 2, "巻", False), (4, 5, 2, "巻", True), (4, 0, 0, "巻", True)])
    h = {(r.series_id, x.unit): (x.owned, x.missing, x.max) for r in numbers.holdings_by_series(v).collect() for x in r.holdings}
    assert h == {(1, "巻"): ([1, 2, 3, 5], [4], 5), (2, "巻"): ([1, 2], [], 2), (2, "話"): ([3, 4], [1, 2], 4), (3, "巻"): ([1], [], 1), (4, "巻"): ([0], [], 0)}


def test_ranges(spark):
    r = spark.createDataFrame([(1, "a", 1, 3), (2, "a", 1, 2), (3, "a", 3, 3), (4, "b", 1, 1), (5, "b", 2, 1)], "id int, k string, lo int, hi int")
    assert sorted(x.id for x in numbers.covered_ranges(r, "id", ["k"], "lo", "hi").collect()) == [1, 2, 3]
    assert sorted(rows(numbers.uncovered(r, r.where("id = 2").select("k", F.lit(2).alias("n")), ["k"], "lo", "hi", "n"))) == [("a", 1), ("a", 3), ("b", 1)]
    x = spark.createDataFrame([([1, 2], 1, 2), ([1, 1], 1, 2), ([1, 2, 3], 1, 2)], "n array<int>, lo int, hi int")
    assert [r[0] for r in x.select(numbers.exact_cover(F.col("n"), F.col("lo"), F.col("hi"))).collect()] == [True, False, False]


FILES = "id long, root_id string, rel_path string, series_id long, volume_id long, size long, ext string, part string, side_label string, care boolean, present boolean"


def shelf_tables(spark):
    s = "id long, root_id string, folder string, series_key string, title string, author string, completed boolean, completed_user boolean, present boolean, first_seen_at timestamp, enriched_at timestamp"
    series = spark.createDataFrame(
        [(1, "r", "f1", "メイドインアビス", "メイドインアビス", "つくし", False, None, True, T0, T0), (2, "r", "f2", "話も巻もある作品", "話も巻もある作品", None, True, False, True, T0, None), (3, "r", "f3", "日常", "日常", "あらゐ", True, None, True, T0 + timedelta(days=99), T0)], s
    )
    v = volumes(spark, [(1, 1, 1, "巻", True), (1, 2, 2, "巻", True), (1, 3, 3, "巻", True), (2, 1, 20, "話", True), (2, 1, 2, "巻", True), (3, 1, 2, "巻", True), (3, 5, 5, "巻", True)])
    f = spark.createDataFrame(
        [
            (1, "r", "f1/x 第01巻.rar", 1, 0, 10, ".rar", "", None, False, True),
            (2, "r", "f1/x 副題つき 第01巻.zip", 1, 0, 10, ".zip", "", None, True, True),
            (3, "r", "f1/x 第02巻.part1.rar", 1, 1, 5, ".rar", ".part1", None, False, True),
            (4, "r", "f1/x 第02巻.part2.rar", 1, 1, 5, ".rar", ".part2", None, False, True),
            (5, "r", "f1/?.rar", 1, None, 1, ".rar", "", None, False, True),
            (6, "r", "f1/外伝.rar", 1, None, 1, ".rar", "", "外伝", False, True),
            (7, "r", "f1/x.rar", 1, None, 1, ".rar", "", "", False, True),
        ],
        FILES,
    )
    bib = spark.createDataFrame([(1, 1, "ndl", "i1", "t", "2003.9"), (1, 4, "ndl", "i4", "t", "2008.1"), (3, 6, "ndl", "i6", "t", None), (3, None, "ndl", None, "t", None)], "series_id long, volume_no int, provider string, isbn string, title string, pubdate string")
    c = spark.createDataFrame([(1, 1, "v:巻:2", 2, "b.jpg", False), (2, 1, "v:巻:1", 1, "a.jpg", False), (3, 3, "v:巻:2", 2, "c.jpg", False)], "id long, series_id long, slot string, volume_no int, file string, pinned boolean")
    return shelf.Tables(series, v, f, bib, c)


def test_issues(spark):
    t = shelf_tables(spark)
    assert rows(issues.issues(t.files, t.volumes), "series_id", "duplicate_volumes", "duplicate_files", "unreadable_files", "any_issue") == [(1, 1, 1, 1, True)]
    assert [r.side_label for r in issues.side_volumes(t.files).collect()] == ["", "外伝"]


def test_series_list(spark):
    t = shelf_tables(spark)
    d = {r.series_id: r for r in shelf.summaries_of(t).collect()}
    assert d[1].status == "behind" and d[1].status_label == "続きが出ている — 4〜4巻が未所持" and d[1].cover == "a.jpg" and d[1].care_files == 1 and d[1].bytes == 33
    assert d[2].status == "unknown" and d[2].effective_completed is False and d[2].completed_by is None
    assert d[3].status == "owner-completed" and d[3].has_gap and d[3].completed_by == "folder"
    ids = lambda **o: [r.series_id for r in shelf.series_list(t, shelf.Options(**o))[0].collect()]
    assert ids(gaps=True) == [3] and ids(behind=True) == [1] and ids(issues="dup") == [1] and ids(care=True) == [1] and ids(q="アビス") == [1] and ids(q="%") == []
    assert ids(sort="added") == [3, 2, 1] and ids(limit=1, offset=1, sort="added") == [2] and ids(completed=True) == [3] and ids(needs_cover=True, limit="all") == ids()
    assert shelf.series_list(t, shelf.Options(gaps=True, limit=1))[1].first().total == 1
    assert [r.series_id for r in shelf.missing_list(t, "gap").collect()] == [3]
    one = shelf.series_detail(t, 1).first()
    assert [v.volume_from for v in one.volumes] == [1, 2, 3] and one.volumes[0].duplicate and not one.volumes[1].duplicate and one.loose == ["f1/?.rar"] and len(one.side) == 2


def test_ownership(spark):
    t = shelf_tables(spark)
    q = [(1, "メイドインアビス", "2", None), (2, "メイドインアビス", "2-5", None), (3, "メイドインアビス", None, None), (4, "存在しない作品", "1", None), (5, None, None, "[つくしあきひと] メイドインアビス 第03巻"), (6, "話も巻もある作品", "5", None), (7, None, None, "話も巻もある作品 第05話")]
    got = {r.query_id: (r.owned, r.missing) for r in shelf.check_owned(t, spark.createDataFrame(q, "query_id int, title string, volume string, raw_text string")).collect()}
    assert got[1] == (True, []) and got[2] == (False, [4, 5]) and got[3] == (False, None) and got[4] == (False, None) and got[6] == (False, [5]) and got[7] == (True, [])
    assert got[5][0] is False  # the author stands in the key of a raw text


def test_snapshots(spark):
    keys = "root_id string, folder string, title string, completed boolean, first_seen_at int, present boolean"
    old = spark.createDataFrame([("r", "a", "A", True, 1, True), ("r", "b", "B", False, 1, False)], keys)
    new = spark.createDataFrame([("r", "a", "A2", False, 2, True), ("r", "b", "B", False, 2, True), ("r", "c", "C", False, 2, True)], keys)
    got = {r.folder: r for r in snapshot.upsert(old, new, ["root_id", "folder"], sticky=["completed"], keep=["first_seen_at"]).collect()}
    assert got["a"].completed and got["a"].title == "A2" and got["a"].first_seen_at == 1 and got["b"].present and got["b"].change == "updated" and got["c"].change == "created"
    f = spark.createDataFrame([(1, "r", "a_b/x", T0, True), (2, "r", "aXb/x", T0, True), (3, "q", "a_b/x", T0, True), (4, "r", "a_b/y", T0 + timedelta(1), True)], "id int, root_id string, rel_path string, last_seen_at timestamp, present boolean")
    gone = snapshot.mark_gone(f, "r", F.lit(T0 + timedelta(hours=1)), "a_b/")
    assert sorted(r.id for r in gone.where("not present").collect()) == [1]
    e = snapshot.volume_events(spark.createDataFrame([(1, 10, "第10巻"), (1, 4, "第4巻")], "series_id int, volume_from int, label string"), F.lit(T0))
    assert e.first().message == "第4巻 / 第10巻 が増えました"
    assert snapshot.volume_events(spark.createDataFrame([(1, 1, "x")], "series_id int, volume_from int, label string"), F.lit(T0), True).count() == 0
    p = snapshot.roll_up_presence(spark.createDataFrame([(1, True), (2, True)], "id int, present boolean"), spark.createDataFrame([(1, True), (2, False), (None, True)], "ref int, present boolean"), "id", "ref")
    assert sorted(rows(p, "id", "present")) == [(1, True), (2, False)]
    ev = spark.createDataFrame([(1, T0, None), (2, T0, None), (3, T0, T0)], "id int, created_at timestamp, notified_at timestamp")
    left = snapshot.stamp(ev, snapshot.pending(ev, 1), "notified_at", F.lit(T0))
    assert [r.id for r in snapshot.pending(left).collect()] == [2]


def _record(n, title, volume, date, isbn, provider="ndl", author="内藤, 泰弘"):
    return (1, n, provider, title, volume, author, "集英社", date, isbn, f"u/{isbn}" if isbn else None, None)


KEKKAI = [("血界戦線 : オンリー・ア・ペイパームーン", None, "2015.6"), ("血界戦線 : 魔封街結社", 1, "2010.1"), ("血界戦線", 2, "2010.11"), ("血界戦線", 4, "2011.12"), ("血界戦線", 10, "2015.4"), ("血界戦線Back 2 Back", 1, "2016.1"), ("血界戦線Back 2 Back", 3, "2017.9"), ("血界戦線Back 2 Back", 10, "2022.8"), ("血界戦線back 2 back", 5, "2018.7"), ("血界戦線Beat 3 Peat", 1, "2023.7"), ("血界戦線Beat 3 Peat", 4, "2026.7")]


def _groups(spark, records):
    d = candidates.normalise(spark.createDataFrame(records, NDL))
    return candidates.groups(folding.fold_candidates(d))


def test_candidates_kekkai(spark):
    recs = [_record(i, t, v, d, f"97840000000{i:02d}") for i, (t, v, d) in enumerate(KEKKAI)] + [_record(20, "血界戦線（2）", None, "2010年11月", "9784088701097", "rakuten", "内藤泰弘")]
    g = {r.title: r for r in _groups(spark, recs).collect()}
    assert {"血界戦線", "血界戦線Back 2 Back", "血界戦線Beat 3 Peat"} <= set(g)
    assert g["血界戦線"].volumes == [1, 2, 4, 10] and g["血界戦線Back 2 Back"].volumes == [1, 3, 5, 10]
    assert g["血界戦線"].providers == ["ndl", "rakuten"] and g["血界戦線"].author == "内藤, 泰弘" and g["血界戦線"].author_name == "内藤泰弘"


def test_candidates_editions(spark):
    arms = [("Arms", 1, "1997.11"), ("Arms", 1, "2007.6"), ("ARMS", 1, "2014.4"), ("Arms", 2, "1998.2"), ("Arms", 16, "2001.4")]
    g = _groups(spark, [_record(i, t, v, d, f"40912488{i:02d}") for i, (t, v, d) in enumerate(arms)])
    assert [r.item.date for r in candidates.image_candidates(g, 1).orderBy("at").collect()] == ["1997.11", "2007.6", "2014.4"]
    assert candidates.volume_map(g).where("volume = 1").first().item.date == "1997.11"


def test_candidates_numbers_and_subtitles(spark):
    myno = [f"異世界黙示録マイノグーラ {n:02d} ～破滅の文明で始める世界征服～" for n in (1, 2, 3, 4)]
    g = _groups(spark, [_record(i, t, None, "2020.1", f"97840000001{i:02d}") for i, t in enumerate(myno)]).collect()
    assert len(g) == 1 and g[0].volumes == [1, 2, 3, 4] and not any(c.isdigit() for c in g[0].title)
    fushigi = [("ふしぎ遊戯", 1), ("ふしぎ遊戯", 2), ("ふしぎ遊戯 : 玄武開伝", 1), ("ふしぎ遊戯 : 玄武開伝", 2)]
    assert _groups(spark, [_record(i, t, v, "1992.7", None) for i, (t, v) in enumerate(fushigi)]).count() == 2
    hon = [("本好きの下剋上第二部 「本のためなら巫女になる! 第4巻」", None), ("本好きの下剋上第二部 「本のためなら巫女になる! 第5巻」", None), ("本好きの下剋上司書になるためには手段を選んでいられません第二部「本のためなら巫女になる!」", 3)]
    g = _groups(spark, [_record(i, t, v, "2020.1", None) for i, (t, v) in enumerate(hon)]).collect()
    assert len(g) == 1 and g[0].volumes == [3, 4, 5]
    assert candidates.inner_cut("arms", "afarewelltoarms") is None and _groups(spark, [_record(0, "", None, None, None)]).count() == 0


def test_covers(spark):
    s = "series_id int, slot string, file string, pinned boolean"
    w = lambda old, new: covers.write(spark.createDataFrame(old, s), spark.createDataFrame(new, s))
    assert rows(w([(1, "", "a", False)], [(1, "", "b", False)]), "file") == [("b",)]
    assert rows(w([(1, "", "p", True)], [(1, "", "b", False)]), "file") == [("p",)] and rows(w([(1, "", "p", True)], [(1, "", "q", True)]), "file") == [("q",)]
    v = volumes(spark, [(1, 1, 6, "巻", True)])
    c = spark.createDataFrame([(1, 1, "v:巻:2", 2, "two", False), (2, 1, "v:巻:1", 1, "one", False)], "id int, series_id long, slot string, volume_no int, file string, pinned boolean")
    assert rows(covers.for_volumes(v, c), "cover", "borrowed") == [("one", True)]
    assert covers.settled(v, c, spark.createDataFrame([(1,)], "id long")).count() == 0
    bib = spark.createDataFrame([(1, 1, None), (1, 2, T0), (1, 5, None), (1, 9, None)], "series_id long, volume_no int, cover_tried_at timestamp")
    assert [r.volume_no for r in covers.targets(bib, v, c).collect()] == [5]
    b = "series_id int, volume_no int, provider string, isbn string, cover_tried_at timestamp, ndl_tried_at timestamp"
    merged = covers.write_bib(spark.createDataFrame([(1, None, "ndl", "x", T0, T0), (1, 1, "ndl", "x", T0, None)], b), spark.createDataFrame([(1, None, "ndl", "y", None, None), (1, 1, "ndl", "x", None, None)], b))
    assert sorted(rows(merged, "volume_no", "isbn", "cover_tried_at"), key=repr) == sorted([(None, "y", None), (1, "x", T0)], key=repr)


def test_slots(spark):
    d = spark.createDataFrame([(x,) for x in ("", "v:巻:3", "v:巻:1-2", "v:話:224", "s:外伝", "s:", "s:Vol:Zero", "v", "v:巻", "v:巻:", "v:巻:abc", "v:巻:5-2", "x:1")], "slot string")
    got = {r.slot: (r.s, r.n, r.l) for r in d.select("slot", scalars.parse_slot(F.col("slot")).alias("s"), scalars.slot_volume_no(F.col("slot")).alias("n"), scalars.slot_label(F.col("slot")).alias("l")).collect()}
    assert got[""][2] == "代表表紙" and got["v:巻:3"][1:] == (3, "第03巻") and got["v:巻:1-2"][1:] == (1, "第01-02巻") and got["v:話:224"][1] == 224
    assert got["s:外伝"][2] == "外伝" and got["s:"][2] == "本編" and got["s:Vol:Zero"][0].label == "Vol:Zero"
    assert all(got[x][0] is None for x in ("v", "v:巻", "v:巻:", "v:巻:abc", "v:巻:5-2", "x:1"))


def test_scalars(spark):
    d = spark.createDataFrame([("2011年05月02日", "978-4-08-876529-7"), ("2003.9", "484023163X"), ("x", "123"), ("1999.77", None)], "d string, i string")
    assert rows(d, scalars.date_key(F.col("d")), scalars.normalize_isbn(F.col("i"))) == [(201105, "9784088765297"), (200309, "484023163X"), (999912, None), (199912, None)]
    n = spark.createDataFrame([("010.jpg",), ("2.jpg",), ("1.jpg",)], "n string")
    assert [r.n for r in n.orderBy(summaries.natural_key(F.col("n"))).collect()] == ["1.jpg", "2.jpg", "010.jpg"]
    assert spark.range(1).select(scalars.file_version(F.lit(35), F.lit(36)), scalars.header_word(F.lit("é")), scalars.to_number(F.lit("１2"))).first()[:] == ("z-10", "=?UTF-8?B?w6k=?=", 12)


def test_responses(spark):
    s = "id int, provider string, url string, status int, body string, fetched_at timestamp"
    log = responses.keyed(spark.createDataFrame([(1, "ndl", "a", 200, "good", T0), (2, "ndl", "a", 503, "bad", T0 + timedelta(1)), (3, "ndl", "b", 503, "bad", T0)], s))
    assert sorted(rows(responses.current(log), "url", "body", "stale")) == [("a", "good", True), ("b", "bad", False)]
    now = [T0]
    answers = iter([(200, "x"), (503, "y")])
    c = responses.Cache(lambda url: next(answers), responses.Throttle(0), clock=lambda: now[0])
    assert c.get("ndl", "u")["body"] == "x" and c.get("ndl", "u")["stale"] is False
    now[0] += timedelta(days=91)
    assert c.get("ndl", "u")["stale"] and len(c.log) == 2


def test_providers(spark):
    xml = '<rss><item><dc:title>血界戦線</dc:title><dcndl:titleTranscription>ケッカイ センセン</dcndl:titleTranscription><dcndl:volume>第3巻</dcndl:volume><dc:creator>内藤</dc:creator><dc:identifier xsi:type="dcndl:ISBN">4-08-876529-X</dc:identifier><link>l&amp;m</link></item></rss>'
    r = providers.ndl_records(spark.createDataFrame([(1, xml)], "query_id int, body string")).first()
    assert (r.title, r.volume, r.isbn, r.link) == ("血界戦線", 3, "408876529X", "l&m")
    assert providers.ndl_readings(spark.createDataFrame([(xml,)], "body string")).first().reading == "ケッカイ センセン"
    j = '{"Items":[{"Item":{"title":"t","author":"a","isbn":"9784088765297","largeImageUrl":"","mediumImageUrl":"x?_ex=200x200"}}]}'
    assert providers.rakuten_records(spark.createDataFrame([(j,)], "body string")).first().image_url == "x?_ex=600x600"
    g = '{"items":[{"volumeInfo":{"title":"t","authors":["a","b"],"industryIdentifiers":[{"type":"ISBN_10","identifier":"4088765293"},{"type":"ISBN_13","identifier":"9784088765297"}],"imageLinks":{"thumbnail":"http://x?zoom=1&edge=curl"}}}]}'
    x = providers.google_records(spark.createDataFrame([(g,)], "body string")).first()
    assert (x.author, x.isbn, x.image_url, x.large) == ("a・b", "9784088765297", "https://x?zoom=1", False)
    for body, n in (('[{"summary":{"isbn":"9784088765297","cover":""}}]', 1), ("[null]", 0), ("[]", 0), ("<html>", 0), ("", 0)):
        got = providers.openbd_records(spark.createDataFrame([(body,)], "body string")).collect()
        assert len(got) == n and all(r.image_url is None for r in got)


def test_archives(spark, tmp_path):
    p = str(tmp_path / "a.zip")
    with zipfile.ZipFile(p, "w") as z:
        for n in ("ch10/001.jpg", "ch2/002.jpg", "ch2/001.jpg", "x.url", "in.zip"):
            z.writestr(n, b"x" * 9)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    got = {r.path: r for r in archives.index_files(spark.createDataFrame([(p,), (str(tmp_path / "bad.zip"),)], "path string")).collect()}
    assert [x.name for x in got[p].pages] == ["ch2/001.jpg", "ch2/002.jpg", "ch10/001.jpg"] and got[p].nested and len(got[p].skipped) == 2
    assert got[str(tmp_path / "bad.zip")].error
    archives.register(spark)
    assert spark.sql(f"SELECT name FROM archive_pages('{p}') WHERE page ORDER BY ordinal").first().name == "ch2/001.jpg"
    assert archives.read_member(p, "x.url") == b"x" * 9 and archives.write_zip(str(tmp_path / "b.zip"), p, ["x.url"]) == 1
    assert files.list_files(spark, str(tmp_path), "r").orderBy("rel_path").first().rel_path == "a.zip"


def test_split_plans(spark):
    plan = archives.split_plan
    assert plan([], ["x 第1巻.zip", "x 第2巻.zip"], True, 1, 2)[0] == "nested" and plan([], ["3.zip", "4.zip"], True, 1, 2)[0] == "refuse"
    kind, parts, _ = plan(["w/第10巻/1.jpg", "w/第09巻/2.jpg", "w/第09巻/1.jpg"], [], False, 9, 10)
    assert kind == "folders" and parts == [(9, ["w/第09巻/1.jpg", "w/第09巻/2.jpg"]), (10, ["w/第10巻/1.jpg"])]
    assert plan(["1.jpg", "2.jpg"], [], False, 1, 2)[0] == "refuse" and plan(["第1巻/1.jpg", "第2巻/1.jpg", "extra/1.jpg"], [], False, 1, 2)[0] == "refuse"
    d = spark.createDataFrame([(1, ["第1巻/1.jpg", "第2巻/1.jpg"], [], False, 1, 2)], "file_id long, names array<string>, skipped array<string>, nested boolean, lo int, hi int")
    assert archives.split_plans(d).first().kind == "folders"


def test_inbox_plan(spark, tmp_path):
    names = ["One_Punch-man_16.rar", "MG-Zip.Com-One_Punch-man_15_LQ.rar", "[藤栄道彦]_最後のレストランch84-103.rar", "Vinland_Saga_03.zip", "zzz_01.rar"]
    w = moves.inbox_works(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.key: len(r.files) for r in moves.fold_inbox(w).collect()}["onepunchman"] == 2
    series = spark.createDataFrame([(1, "ヴィンランド・サガ", "幸村誠", "f")], "id long, title string, author string, folder string")
    s = moves.shelf_with_readings(series, spark.createDataFrame([("ヴィンランド・サガ", "ヴィンランド サガ"), ("ヴィンランド・サガ 2", "x")], "title string, reading string"))
    assert s.first().reading_key == "vinrandosaga"
    (tmp_path / "a.tsv").write_text("﻿key\ttitle\tauthor\r\nonepunchman\tワンパンマン\tONE\r\nzzz\t\t\r\nonepunchman\tワンパンマン\t村田\r\n", encoding="utf-8")
    a = files.read_answers(spark, str(tmp_path / "a.tsv"))
    assert rows(a) == [("onepunchman", "ワンパンマン", "村田")]
    m = moves.match_by_reading(w, s)
    plan = {r.file: r for r in moves.plan_moves(w, a, m, "/shelf").collect()}
    assert plan["[村田] ワンパンマン 第15巻.rar"].folder == "[村田] ワンパンマン" and plan["[藤栄道彦] 最後のレストラン 第84-103話.rar"].via == "name"
    assert plan["zzz_01.rar"].via == "skipped" and sum(r.n for r in moves.bucket_counts(spark.createDataFrame(list(plan.values()), "to_name string, folder string, key string, work string, author string, volume_from int, volume_to int, unit string, keep_name boolean, via string, file string")).select(F.col("files").alias("n")).collect()) == 5
    sus = spark.createDataFrame([("arte", "A"), ("arte13w", "A"), ("alpha", "B"), ("omega", "B"), ("gamma", "B")], "key string, title string")
    assert [r.title for r in moves.suspect_answers(sus, sus).collect()] == ["B"]


def test_rename_plan(spark):
    f = spark.createDataFrame([(1, "[A] 旧/[A] 旧 第01巻w.rar", 1, 1, 1, "巻", True), (2, "[A] 旧/[A] 旧 外伝.rar", 1, None, None, "巻", True), (3, "[A] 旧/別.rar", 1, None, None, "巻", True)], "id long, rel_path string, series_id long, volume_from int, volume_to int, unit string, present boolean")
    s = spark.createDataFrame([(1, "[A] 旧", "旧")], "id long, folder string, title string")
    p = moves.plan_renames(f, s, spark.createDataFrame([(1, "新", "A", True)], "series_id long, title string, author string, completed boolean"))
    got = {r.id: r for r in p.collect()}
    assert got[1].to_name == "[A] 新 第01巻w.rar" and got[2].to_name == "[A] 新 外伝.rar" and got[3].stuck and got[1].to_folder == "[A] 新(完)"
    assert rows(moves.rename_summary(p), "moves", "stuck", "loses_volume", "noop") == [(2, 1, 0, False)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, "zzzzzzzzzz"), (4, None)], "id int, k string")
    b = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefghij"), (3, "abc")], "o int, r string")
    assert sorted(rows(joins.match_by_prefix(a, b, "id", "k", "r", "o"), "id", "o")) == [(1, 2)]
    d = spark.createDataFrame([(["ab"], ["abc"], "A b", "ab c"), (["x"], ["y"], "", "q"), ([], ["y"], "n", "m")], "a array<string>, b array<string>, c string, d string")
    assert rows(d, joins.keys_compatible(F.col("a"), F.col("b")), joins.authors_compatible(F.col("c"), F.col("d"))) == [(True, True), (False, True), (False, False)]
    n = spark.createDataFrame([(1, "f", "a"), (2, "f", "A"), (3, "f", "b")], "id int, folder string, stem string").withColumn("suffix", F.lit(".rar"))
    taken = spark.createDataFrame([("f", "b.rar")], "folder string, name string")
    assert sorted(r.name for r in keyed.unique_names(n, "folder", "stem", "suffix", taken).collect()) == ["A (2).rar", "a.rar", "b (2).rar"]


def test_no_name_is_given_twice(spark):
    stems = ["a", "a", "a (2)", "A", "a (2)", "b (1)", "b (02)", "b", "c", "c", "a (2) (2)"]
    wanted = spark.createDataFrame([(k, "f", x, ".rar") for k, x in enumerate(stems)] + [(99, "g", "a", ".part1.rar"), (98, "g", "a", ".part1.rar")], "id int, folder string, stem string, suffix string")
    taken = spark.createDataFrame([("f", "C (2).rar"), ("f", "c (4).RAR"), ("f", "x"), ("g", "a (2).part1.rar")], "folder string, name string")
    got = {r.id: r.name for r in keyed.unique_names(wanted, "folder", "stem", "suffix", taken).collect()}
    assert [got[k] for k in range(len(stems))] == ["a.rar", "a (3).rar", "a (2).rar", "A (4).rar", "a (2) (3).rar", "b (1).rar", "b (02).rar", "b.rar", "c.rar", "c (3).rar", "a (2) (2).rar"]
    assert [got[98], got[99]] == ["a.part1.rar", "a (3).part1.rar"]
    assert keyed.unique_names(wanted.where("id = 0"), "folder", "stem", "suffix", spark.createDataFrame([("f", "A.rar")], taken.schema)).first().name == "a (2).rar"


def test_sql_functions(spark):
    registry.register(spark)
    r = spark.sql("SELECT series_key('作品 第3巻') AS k, parse_library_entry('[a] b/[a] b 01.rar').volume_from AS v, romaji('サガ') AS r, find_volume(NULL) AS f, nfkc(NULL) AS n").first()
    assert (r.k, r.v, r.r, r.n) == ("作品", 1, "saga", None) and r.f.lo is None


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"scan_minutes": 5, "unknown": 1}')
    monkeypatch.setenv("SHELF_PROVIDERS", '["ndl", "google"]')
    c = files.Config.load(str(tmp_path / "c.json"))
    assert c.scan_minutes == 5 and c.ready("google") and not c.ready("rakuten")


def test_stream_of_changes(spark, tmp_path):
    from shelfwright.streaming import changes

    s = "series_id long, title string, volume_from int, volume_to int, completed boolean, baseline boolean"
    q = changes.change_events(spark.readStream.schema(s).parquet(str(tmp_path / "in"))) if (tmp_path / "in").mkdir() is None else None

    def put(*data):
        spark.createDataFrame(list(data), s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with changes.state_store(spark):
            run = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
            run.awaitTermination()

    put((1, "A", 1, 3, False, True))
    put((1, "A", 1, 1, False, False), (1, "A", 2, 2, False, False))
    put((1, "A", 10, 10, True, False), (1, "A", 4, 4, False, False), (1, "A", 2, 5, False, False), (2, "B", 1, 1, True, False))
    put((1, "A", 4, 4, True, False), (1, "A", 9, 10, True, False), (2, "B", None, None, False, False), (2, "B", 7, 6, None, None))
    got = sorted((r.series_id, r.kind, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "series_completed", "A"), (1, "volume_added", "第2-5巻 / 第4巻 / 第10巻 が増えました"), (1, "volume_added", "第9-10巻 が増えました"), (2, "series_added", "B")]


def test_interval_algebra(spark):
    rng = random.Random(4)
    cases = []
    for k in range(300):
        some = lambda n: [(lo, lo + rng.randrange(6)) for lo in (rng.randrange(-3, 30) for _ in range(rng.randrange(n)))]
        lo = rng.randrange(1, 25)
        cases.append((k, some(9), lo, lo + rng.randrange(-1, 12)))
    d = spark.createDataFrame(cases, "k int, r array<struct<lo:long,hi:long>>, lo long, hi long")
    held = numbers.islands(F.col("r"))
    d = d.select("*", held.alias("i"), numbers.islands_twice(F.col("r")).alias("t"), numbers.numbers_in(numbers.gaps_in(held)).alias("g"), numbers.missing_of_request(F.col("lo"), F.col("hi"), held).alias("m"))
    flat = lambda x: [n for r in x for n in range(r["lo"], r["hi"] + 1)]
    for r in d.collect():
        count = Counter(n for x in r.r for n in range(x["lo"], x["hi"] + 1))
        assert flat(r.i) == sorted(count) and flat(r.t) == sorted(n for n, c in count.items() if c > 1)
        assert all(a["hi"] + 1 < b["lo"] for x in (r.i, r.t) for a, b in zip(x, x[1:]))
        assert r.g == [n for n in range(1, max(count, default=0) + 1) if n not in count]
        assert r.m == (None if r.lo > r.hi else [n for n in range(r.lo, r.hi + 1) if n not in count])


def test_groups_in_sql(spark):
    candidates.register(spark)
    recs = spark.createDataFrame([(q, i, ("ndl", "rakuten", "google")[i % 3], title, None, "a", "p", "2001", None, None, None) for q in (1, 2) for i, title in enumerate(["日常 1", "日常 2", "別の本", "日常 : 副題 3", "", "別の本 外伝"])], NDL)
    items = candidates.normalise(recs)
    own = spark.sql("SELECT * FROM group_candidates(TABLE({items}))", items=items.withColumn("more", F.lit(1)))
    want = folding.fold_candidates(items)
    bare = lambda d: sorted(map(repr, d.drop("group_no").collect()))
    assert own.dtypes == want.dtypes and bare(own) == bare(want)
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM group_candidates(TABLE({items}))", items=items.drop("isbn")).collect()


def test_a_page_with_its_total(spark):
    series = spark.createDataFrame([(k, "r", f"f{k}", f"k{k}", f"T{k}", None, False, None, True, T0, T0, None) for k in range(5)], "id long, root_id string, folder string, series_key string, title string, author string, completed boolean, completed_user boolean, present boolean, first_seen_at timestamp, last_seen_at timestamp, enriched_at timestamp")
    none = lambda schema: spark.createDataFrame([], schema)
    t = shelf.Tables(series, none("id long, series_id long, unit string, volume_from int, volume_to int, present boolean, first_seen_at timestamp"), none("id long, series_id long, volume_id long, rel_path string, part string, ext string, size long, side_label string, care boolean, present boolean"), none("series_id long, volume_no int, provider string, pubdate string"), none("id long, series_id long, slot string, volume_no int, file string, pinned boolean"))
    assert [(r.title, r.total) for r in shelf.series_page(t, shelf.Options(limit=2, offset=1)).collect()] == [("T1", 5), ("T2", 5)]


def test_folding_of_whole_tables(spark):
    """What meets through hashed keys is what the fold of one query after another finds."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "完全版", "外伝"]
    data = []
    for q in range(60):
        for k in range(rng.randrange(1, 14)):
            w = rng.choice(["Sora no Uta", "Umi to Yama", "Kaze ga Fuku", "Hoshi Furu Yoru"])
            title = rng.choice([w, f"{w} {k}", f"{w} {rng.choice(words)}", f"{w[:6]} {rng.choice(words)} {w[6:]}", f"{w} {rng.choice(words)} {k} end", f"{w}（{k}）"])
            data.append((q, k, "ndl", title, None, None, None, None, None, None, None))
    items = candidates.normalise(spark.createDataFrame(data, NDL))
    got = {}
    for r in folding.fold_candidates(items).collect():
        got.setdefault(r.query_id, {}).setdefault(r.group_key, []).append((r.ordinal, r.base_title, r.volume))
    same = 0
    for q in range(60):
        rows = sorted((r.ordinal, r.base_title, r.volume) for r in items.where(F.col("query_id") == q).collect())
        want = {k: sorted((x.ordinal, x.title, x.volume) for x in own) for k, own in candidates.fold([candidates.Record(*r) for r in rows]).items()}
        assert sorted(o for own in got[q].values() for o, _, _ in own) == [o for o, _, _ in rows]
        same += {k: sorted(own) for k, own in got[q].items()} == want
    assert same >= 54  # moves that wait for one another are judged at once, not in turn


def test_folding_of_one_large_query(spark):
    k = F.col("id")
    name = lambda x: F.translate(F.md5(x.cast("string")), "0123456789abcdef", "ghijklmnopqrstuv")
    title = F.when(k % 4 == 3, name(k)).otherwise(F.concat(name(k - k % 4), F.element_at(F.array(F.lit(""), F.lit(" 2"), F.lit(" 3")), (k % 4 + 1).cast("int"))))
    none = F.lit(None).cast("string")
    recs = spark.range(20000).select(F.lit(1).cast("long").alias("query_id"), k.cast("int").alias("ordinal"), F.lit("ndl").alias("provider"), title.alias("title"), none.cast("int").alias("volume"), *(none.alias(c) for c in ("author", "publisher", "date", "isbn", "image_url", "link")))
    folded = folding.fold_candidates(candidates.normalise(recs))
    sizes = Counter(r["count"] for r in folded.groupBy("group_key").count().collect())
    assert sizes == {3: 5000, 1: 5000}
