"""Marks, requests, images, notifications and concurrent writers."""

import hashlib
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import issues, marks, summaries
from shelfwright.plans import scan
from shelfwright.sources import images, listing, requests, responses
from shelfwright.sources.store import Conflict, Store
from shelfwright.streaming import changes

T0 = datetime(2024, 1, 1)


def test_a_renamed_folder_keeps_its_series(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    listing = lambda *paths: spark.createDataFrame([("r", p, 1, T0) for p in paths], "root_id string, rel_path string, size long, mtime timestamp")
    scan.scan(store, listing("A/A 第01巻.zip"), "r", T0)
    before = store.read("series").first()
    r = spark.createDataFrame([(before.id, "B", "B", None, "b")], "id long, to_folder string, title string, author string, series_key string")
    f = spark.createDataFrame([(before.id, "A", "B")], "series_id long, from_folder string, to_folder string")
    s = marks.override_completion(marks.rename_folders(store.read("series"), r), spark.createDataFrame([(before.id, True)], "id long, completed_user boolean"))
    store.commit({"series": s, "files": marks.move_below(store.read("files"), f)})
    scan.scan(store, listing("B/A 第01巻.zip", "B/B 第02巻.zip"), "r", T0 + timedelta(days=1))
    after = store.read("series").collect()
    assert [(x.id, x.folder, x.completed_user, x.present) for x in after] == [(before.id, "B", True, True)]
    assert sorted((x.series_id, x.volume_from) for x in store.read("volumes").collect()) == [(before.id, 1), (before.id, 2)]


def test_two_writers(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    known = b._pointers()
    a.commit({"t": one(1)})
    b._pointers = lambda: known  # b began before a was done
    with pytest.raises(Conflict):
        b.commit({"t": one(2)})
    del b._pointers
    assert b.read("t").first().n == 1 and b.commit({"t": one(3)}) == 2 and a.read("t").first().n == 3
    with pytest.raises(ZeroDivisionError):  # a commit that fails lets the next one go on
        a.commit({"t": one(4), "u": type("Bad", (), {"write": property(lambda _: 1 // 0)})()})
    assert a.read("t").first().n == 3 and a.commit({"t": one(5)}) == 3


def test_requests():
    r = requests.rakuten({"applicationId": "id", "accessKey": "secret"}, title="日常", most=99)
    assert "secret" in r.fetched and "secret" not in r.kept and r.fetched.startswith(r.kept) and "hits=30" in r.kept
    assert requests.rakuten({}, title="a", author="b").kept == requests.rakuten({"accessKey": "x"}, author="b", title="a").kept
    assert "isbn%3A9784088725093" in requests.google({}, title="x", isbn="978-4-08-872509-3").kept and "intitle%3A%22a+b%22" in requests.google({}, title='a"b').kept
    assert requests.openbd("4-08-872509-x").kept.endswith("isbn=408872509X") and "cnt=500" in requests.ndl(title="x").kept and "cnt=1&" in requests.ndl(title="x", most=0).kept
    with pytest.raises(ValueError):
        requests.ndl()


def test_spellings_of_an_author():
    good, bare = {"isbn": "i", "volume": 1}, {"isbn": None, "volume": 1}
    asked = []

    def ask(of):
        return lambda c: asked.append(c) or of.get(c, [])

    assert requests.first_fitting(ask({"a": [bare], "b": [good, good], "c": [good] * 3}), ["a", "b", "c"], "t") == ([good, good], "b") and asked == ["a", "b"]
    assert requests.first_fitting(ask({"a": [bare], None: [good]}), ["a"], "t") == ([good], None)
    assert requests.first_fitting(ask({"a": [bare], None: [good]}), ["a"], None) == ([bare], "a")


def test_answers_that_are_not_kept():
    now, asked = [T0], []
    answers = iter([(503, "down"), (200, "x")])

    def fetch(url):
        asked.append(url)
        return next(answers)

    c = responses.Cache(fetch, responses.Throttle(0), clock=lambda: now[0])
    assert c.get("p", "u", "u?key=1", requests.NEVER_KEPT)["status"] == 503 and not c.log
    assert c.get("p", "u", "u?key=1")["body"] == "x" and c.get("p", "u")["body"] == "x"
    assert asked == ["u?key=1"] * 2 and [x["url"] for x in c.log] == ["u"] and c.hits["p", "u"] == 1


def test_images(tmp_path):
    big, asked = b"x" * 5000, []

    def fetch(url, headers):
        asked.append(headers["Referer"])
        return (404, b"", None) if "gone" in url else (200, b"tiny" if "tiny" in url else big, "image/png")

    host = "https://cover.openbd.jp/"
    i = images.Images(str(tmp_path), fetch, responses.Throttle(0))
    name = hashlib.sha256(big).hexdigest()[:32] + ".png"
    assert i.keep("openbd", host + "a.jpg") == name == i.keep("openbd", host + "b.jpg") and (tmp_path / "covers" / name).read_bytes() == big
    assert i.keep("openbd", host + "gone") is None and i.keep("openbd", host + "tiny") is None and i.keep("x", "http://elsewhere/") is None
    assert images.Images(str(tmp_path), fetch, responses.Throttle(0), [name[:32]]).keep("openbd", host + "a.jpg") is None
    n = len(asked)
    assert i.thumbnail("openbd", host + "t") == big == i.thumbnail("openbd", host + "t") and len(asked) == n + 1 and set(asked) == {"https://openbd.jp/"}


def test_every_event_is_offered(spark, tmp_path):
    spark.range(45).write.parquet(str(tmp_path / "in"))
    sizes, log = [], []

    def send(portion):
        ids = [r.id for r in portion.collect()]
        sizes.append(len(ids))
        return [i for i in ids if i % 2 == 0]

    events = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    changes.outbox(events, send, lambda df, _: log.extend(df.collect()), str(tmp_path / "c")).awaitTermination()
    assert max(sizes) == 20 and sorted(r.id for r in log) == list(range(45)) and all(r.sent == (r.id % 2 == 0) for r in log)


def test_a_round_that_failed_tries_nothing_twice(spark, tmp_path):
    due = spark.range(10).selectExpr("id", "100 - id AS due")
    rounds, tried, told = changes.Rounds(spark, str(tmp_path / "ledger"), 4), [], []
    for k in range(3):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))

    def attempt(some):
        tried.append(sorted(r.id for r in some.collect()))
        if len(tried) == 2:
            raise RuntimeError("the provider is gone")
        return some.where("id <> 8")

    listener = changes.Progress(told.append)
    spark.streams.addListener(listener)
    run = lambda: rounds.run(ticks, str(tmp_path / "c"), lambda batch: T0 + timedelta(days=batch), lambda _, claims: due.join(claims, "id", "left_anti"), attempt).awaitTermination()
    with pytest.raises(Exception, match="the provider is gone"):
        run()
    run()
    deadline = time.time() + 30
    while sum(x["state"] in ("ended", "failed") for x in told) < 2 and time.time() < deadline:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert tried == [[6, 7, 8, 9], [2, 3, 4, 5], [0, 1]]
    assert sorted(map(tuple, rounds.progress().collect())) == [(0, 4, 3), (1, 4, 0), (2, 2, 2)]
    assert {r.at for r in rounds.claims().where("batch = 1").collect()} == {T0 + timedelta(days=1)}
    assert sorted(x["state"] for x in told if x["state"] != "running") == ["ended", "failed", "started", "started"] and {x["batch"] for x in told if x["state"] == "running"} >= {0, 2}


def test_listing_tolerates_what_it_cannot_read(spark, tmp_path):
    listing.register(spark)
    root = tmp_path / "lib"
    for name in ("A/1.zip", "A/deep/2.zip", "B/3.zip", "C/" + "x" * 40 + ".zip", "loose.zip"):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(name)
    os.symlink("loop", root / "B/loop")
    os.symlink("absent", root / "B/nothing")
    os.symlink(str(root), root / "B/up")
    at = os.open(root / "C", os.O_RDONLY)
    for _ in range(18):  # deeper than a path may be
        os.mkdir("d" * 250, dir_fd=at)
        at, above = os.open("d" * 250, os.O_RDONLY, dir_fd=at), at
        os.close(above)
    os.close(at)
    got = {r.rel_path: r for r in spark.read.format("shelf_files").option("root_id", "r").option("parts", "3").load(str(root)).collect()}
    files = {k for k, r in got.items() if r.error is None}
    assert files == {"A/1.zip", "A/deep/2.zip", "B/3.zip", "C/" + "x" * 40 + ".zip", "loose.zip"} and got["A/1.zip"].size == 7 and got["A/1.zip"].root_id == "r"
    bad = {k: r.error for k, r in got.items() if r.error}
    assert len(bad) == 2 and "B/loop" in bad and any(k.startswith("C/ddd") for k in bad) and all(r.size is None for k, r in got.items() if k in bad)
    with pytest.raises(Exception, match="No such file"):
        spark.read.format("shelf_files").load(str(root / "none")).collect()


def test_listing_as_a_stream(spark, tmp_path):
    listing.register(spark)
    root = tmp_path / "lib"
    os.makedirs(root / "A")
    (root / "A/1.zip").write_text("1")

    def run():
        time.sleep(0.3)
        s = spark.readStream.format("shelf_files").option("settle", "0.1").load(str(root))
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted(r.rel_path for r in spark.read.schema(listing.SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert run() == ["A/1.zip"]
    old = tmp_path / "old.zip"
    old.write_text("old")
    os.utime(old, (1, 1))
    os.rename(old, root / "A/old.zip")  # an old file that comes new
    (root / "2.zip").write_text("2")
    assert run() == ["2.zip", "A/1.zip", "A/old.zip"]
    assert run() == ["2.zip", "A/1.zip", "A/old.zip"]


def test_pages_by_place(spark):
    rows = [(k, (None, 3, 1, 1, 2)[k % 5], None if k % 7 == 0 else f"n{k % 4}") for k in range(60)]
    d = spark.createDataFrame(rows, "id int, a int, b string")
    for order in ([("a", False), ("b", True), ("id", False)], [("a", True), ("b", False), ("id", True)]):
        whole = [tuple(r) for r in d.orderBy(*(F.desc_nulls_last(c) if x else F.asc_nulls_first(c) for c, x in order)).collect()]
        at, seen = None, []
        while True:
            page = summaries.page_after(d, order, at, limit=7)
            if (at := summaries.place_of(page, order)) is None:
                break
            seen += [tuple(r) for r in page.collect()]
        assert seen == whole


def test_a_page_by_place_is_pruned_at_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id DIV 10 AS a").write.parquet(str(tmp_path / "t"))
    page = summaries.page_after(spark.read.parquet(str(tmp_path / "t")), [("a", False), ("id", False)], (90, 905))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(a,90)" in plan and [r.id for r in page.limit(2).collect()] == [906, 907]


def test_sketches(spark):
    d = spark.range(100000).selectExpr("id % 3 AS k", "id % 10 AS part", "CASE WHEN id % 50 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS v")
    m = summaries.merge_sketches(summaries.sketches(d, ["k", "part"], "v"), ["k"])
    for r in m.select("k", "n", *(summaries.quantile("sketch", q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9))).collect():
        assert r.n == 98000 // 3 + (r.k < 98000 % 3) or abs(r.n - 98000 / 3) < 2
        assert all(abs(r[f"q{int(q * 100)}"] / 100000 - q) <= summaries.SKETCH_ERROR for q in (0.1, 0.5, 0.9))


def test_orders_of_people(spark):
    names = ["い10.jpg", "い9.jpg", "ア1.jpg", "あ2.jpg", "B.jpg", "a.jpg"]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in d.orderBy(*summaries.natural_order(F.col("name"))).collect()] == ["a.jpg", "B.jpg", "ア1.jpg", "あ2.jpg", "い9.jpg", "い10.jpg"]
    f = spark.createDataFrame([(i, 1, x, None, x, 1, True) for i, x in enumerate(["い", "ア", "", "あ"])], "id long, series_id long, side_label string, volume_id long, rel_path string, size long, present boolean")
    labels = [r.side_label for r in issues.side_volumes(f).collect()]
    assert labels[0] == "" and labels[-1] == "い"
