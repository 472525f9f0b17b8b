import json
import os
import re
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwright.operators import marks
from shelfwright.plans import effects, enrich, scan
from shelfwright.sources import archives
from shelfwright.sources.files import parse_files
from shelfwright.sources.layout import Rooted
from shelfwright.sources.store import Store

T0 = datetime(2024, 1, 1)
LIST = "root_id string, rel_path string, size long, mtime timestamp"


def listing(spark, *paths, root="r"):
    return spark.createDataFrame([(root, p, 1, T0) for p in paths], LIST)


def test_scans(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    run = lambda n, *paths, folder=None, root="r": scan.scan(store, listing(spark, *paths, root=root), root, T0 + timedelta(days=n), folder)
    assert run(1, "A/A 第01-03巻.rar", "B/B 第01巻.rar") == {"batch": 1, "seen": 2, "baseline": True} and store.read("events").count() == 0
    with pytest.raises(scan.Refused):
        run(1, "C/C 第01巻.rar", folder="C", root="q")
    files = store.read("files")
    store.commit({"files": files.withColumn("care", F.lit(True)).withColumn("care_note", F.lit("torn"))})
    run(2, "A/A 第01巻.zip", "A/A 第02巻.zip", "A/A 第03巻.zip", folder="A")
    f = {r.rel_path: r for r in store.read("files").collect()}
    assert not f["A/A 第01-03巻.rar"].present and f["B/B 第01巻.rar"].present and f["B/B 第01巻.rar"].care_note == "torn"
    assert store.read("events").count() == 0  # the numbers were on the shelf
    assert store.read("volumes").where("present").count() == 4
    run(3, "A/A 第01巻.zip", "A/A 第02巻.zip", "A/A 第03巻.zip", "A/A 第10巻.zip", "A/A 第04巻.zip", folder="A")
    assert [r.message for r in store.read("events").collect()] == ["第4巻 / 第10巻 が増えました"]
    run(4, "A(完)/A 第01巻.zip", "B/B 第01巻.rar")
    kinds = sorted(r.kind for r in store.read("events").collect())
    assert kinds == ["series_added", "volume_added"] or kinds == ["series_added", "series_completed", "volume_added"]
    assert {r.folder: r.present for r in store.read("series").collect()} == {"A": False, "B": True, "A(完)": True}
    p = {r.name: r.n for r in scan.probe(parse_files(listing(spark, "A/A 第01巻.zip", "A/x.rar", "A(完)/A 外伝.zip"))).collect()}
    assert p["files"] == 3 and p["volumes"] == 1 and p["side"] == 1 and p["unreadable"] == 1 and p["collisions"] == 1


def contents(path):
    return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_scans_of_a_root_leave_the_others_alone(spark, tmp_path):
    tables = Rooted(spark, str(tmp_path / "t"), shelves=8)
    run = lambda n, root, *paths, folder=None: scan.scan_root(tables, listing(spark, *paths, root=root), root, T0 + timedelta(days=n), folder)
    with pytest.raises(scan.Refused):
        run(0, "r", "A/A 第01巻.zip", folder="A")
    assert run(1, "r", "A/A 第01巻.zip", "B/B 第01巻.zip", "loose 第01巻.zip") == {"seen": 3, "baseline": True}
    run(1, "007", "A/A 第01巻.zip")
    before = contents(tmp_path / "t/files")
    run(2, "r", "A/A 第01巻.zip", "A/A 第02巻.zip", folder="A")
    after = contents(tmp_path / "t/files")
    own = {k for k in before if before[k] != after.get(k)}
    there = {r.rel_path: (r.root_id, r.shelf, r.present) for r in tables.read("files", scan.FILES, "r").collect()}
    here = f"root_id=r/shelf={there['A/A 第01巻.zip'][1]}/"
    assert own and all(k.startswith(here) for k in own) and set(after) - set(before) and all(k.startswith(here) for k in set(after) - set(before))
    assert len(there) == 4 and all(x[2] for x in there.values()) and tables.read("files", scan.FILES, "007").first().root_id == "007"
    assert [(r.kind, r.message) for r in scan.events(tables).collect()] == [("volume_added", "第2巻 が増えました")]
    run(2, "r", "A/A 第01巻.zip", "A/A 第02巻.zip", folder="A")  # run again: nothing changes, nothing is told twice
    assert len(scan.events(tables).collect()) == 1 and tables.read("files", scan.FILES).count() == 5
    run(3, "r", "B/B 第01巻.zip")
    gone = {r.folder: r.present for r in tables.read("series", scan.SERIES, "r").collect()}
    assert gone["B"] and not gone["A"] and contents(tmp_path / "t/files/root_id=007") == {k.removeprefix("root_id=007/"): v for k, v in before.items() if k.startswith("root_id=007")}
    p = tables.read("files", scan.FILES, "r", "A")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*root_id[^]]*shelf", p)


def test_an_old_name_that_comes_back_is_another_work(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    scan.scan(store, listing(spark, "A/A 第01巻.zip"), "r", T0)
    series, files = store.read("series"), store.read("files")
    old = series.first().id
    renames = spark.createDataFrame([(old, "A", "B")], "id long, from_folder string, to_folder string")
    named = renames.select("id", "to_folder", F.lit("B").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("b").alias("series_key"))
    store.commit({"series": marks.rename_folders(series, named), "files": marks.move_below(files, renames.withColumnRenamed("id", "series_id"))})
    scan.scan(store, listing(spark, "A/A 第01巻.zip", "B/A 第01巻.zip"), "r", T0 + timedelta(days=1))
    by = {r.folder: r.id for r in store.read("series").collect()}
    of = {r.rel_path: (r.id, r.series_id) for r in store.read("files").collect()}
    assert by["B"] == old != by["A"] and len(by) == 2
    assert of["A/A 第01巻.zip"][1] == by["A"] and of["B/A 第01巻.zip"][1] == old and len({x for x, _ in of.values()}) == 2


def test_enrichment(spark):
    rec = "query_id long, ordinal int, title string, volume int, author string, publisher string, date string, isbn string, image_url string, link string"
    ndl = spark.createDataFrame([(1, 0, "日常", 1, "あらゐ", "角川", "2007.7", "978a", "u1", None), (1, 1, "日常", 2, "あらゐ", "角川", "2008.7", "978b", "u2", None)], rec)
    rak = spark.createDataFrame([(1, 0, "日常（1）", None, "あらゐ", "角川", "2007年07月05日", "978c", "u3", None)], rec)
    g = enrich.search({"ndl": ndl, "rakuten": rak})
    assert g.first().providers == ["ndl", "rakuten"] and g.first().volumes == [1, 2]
    bib = spark.createDataFrame([(7, 1, "ndl", "old"), (8, 1, "ndl", "stay")], "series_id long, volume_no int, provider string, isbn string")
    picks = spark.createDataFrame([(7, 1, "日常")], "series_id long, query_id long, group_key string")
    assert sorted((r.series_id, r.volume_no, r.isbn) for r in enrich.apply_pick(bib, g, picks, F.lit(T0)).collect()) == [(7, 1, "978a"), (7, 2, "978b"), (8, 1, "stay")]
    recs = spark.createDataFrame([(7, "日常 : 副題", 1, "b", "2010", 1), (7, "日常", 1, "a", "2007", 2), (7, "別の作品", 2, "c", "2001", 3), (7, "日常", 3, None, "2001", 4)], "series_id long, title string, volume int, isbn string, date string, ordinal int")
    assert [(r.volume, r.isbn) for r in enrich.enrich(recs, spark.createDataFrame([(7, "日常")], "id long, title string")).collect()] == [(1, "a")]
    c = spark.createDataFrame([(7, "v:巻:1", "mine", True)], "series_id long, slot string, file string, pinned boolean")
    t = spark.createDataFrame([(7, "v:巻:1"), (7, "v:巻:2")], "series_id long, slot string")
    a = spark.createDataFrame([(7, "v:巻:1", "ndl:isbn", 0, "x", 9000), (7, "v:巻:2", "google:title:small", 0, "s", 9000), (7, "v:巻:2", "rakuten:isbn", 0, "r", 9000), (7, "v:巻:2", "ndl:isbn", 0, "tiny", 10)], "series_id long, slot string, tier string, ordinal int, file string, bytes long")
    assert sorted((r.slot, r.file) for r in enrich.paste(t, a, c, F.col("bytes") >= 2000).collect()) == [("v:巻:1", "mine"), ("v:巻:2", "r")]


def test_effects(tmp_path):
    for n in ("in/a.rar", "in/b.rar", "out/c.rar"):
        os.makedirs(tmp_path / os.path.dirname(n), exist_ok=True)
        (tmp_path / n).write_text(n)
    root = str(tmp_path)
    log = str(tmp_path / "log")
    assert effects.apply_moves([("a.rar", "w/a.rar")], f"{root}/in", f"{root}/out", log) == [("a.rar", "w/a.rar")]
    with pytest.raises(effects.Clobber):
        effects.apply_moves([("b.rar", "c.rar")], f"{root}/in", f"{root}/out", log)
    with pytest.raises(PermissionError):
        effects.apply_moves([("b.rar", "../x")], f"{root}/in", f"{root}/out", log)
    assert [json.loads(x)["from"] for x in open(log)] == ["a.rar", "b.rar"]

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        effects.apply_renames(root, [("in/b.rar", "in/z.rar")], log, fail)
    assert os.path.exists(tmp_path / "in/b.rar") and effects.apply_renames(root, [("in/b.rar", "in/z.rar")], log) == 1
    z = str(tmp_path / "in/o.zip")
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("1/a.jpg", b"1")
        f.writestr("2/a.jpg", b"2")
    with pytest.raises(KeyError):
        effects.run_split(z, [("v1.zip", ["1/a.jpg"]), ("v2.zip", ["none"])], f"{root}/attic")
    assert sorted(os.listdir(tmp_path / "in")) == ["o.zip", "z.rar"]
    inner = str(tmp_path / "inner.zip")
    for n in "12":
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as f:
            f.writestr("p/1.jpg", n * 500)
        with zipfile.ZipFile(tmp_path / "in/nested.zip", "a") as f:
            f.write(inner, f"第{n}巻.zip")
    out = effects.run_split(str(tmp_path / "in/nested.zip"), [("n1.zip", ["第1巻.zip"]), ("n2.zip", ["第2巻.zip"])], f"{root}/attic", "nested")
    assert [archives.read_member(x, "p/1.jpg") for x in out] == [b"1" * 500, b"2" * 500] and os.path.exists(tmp_path / "attic/nested.zip")
    archives.write_zip(str(tmp_path / "copy.zip"), out[0], ["p/1.jpg"])
    assert archives.read_member(str(tmp_path / "copy.zip"), "p/1.jpg") == b"1" * 500 and archives.members(str(tmp_path / "copy.zip"))[0]["method"] == zipfile.ZIP_DEFLATED
    start, packed, method = archives.packed_member(str(tmp_path / "copy.zip"), "p/1.jpg")
    assert zlib.decompress(open(tmp_path / "copy.zip", "rb").read()[start : start + packed], -15) == b"1" * 500 and method == 8
    assert effects.undouble(out[0]) == out[0]
    os.rename(out[0], f"{root}/in/n1 (2).zip")
    assert effects.undouble(f"{root}/in/n1 (2).zip") == out[0]
    for x in out:
        os.remove(x)
    assert archives.dos_time(datetime(1999, 2, 3, 4, 5, 7)) == (4 << 11 | 5 << 5 | 3, 19 << 9 | 2 << 5 | 3)
    assert len(effects.run_split(z, [("v1.zip", ["1/a.jpg"]), ("v2.zip", ["2/a.jpg"])], f"{root}/attic")) == 2 and os.path.exists(tmp_path / "attic/o.zip")
    (tmp_path / "in" / (effects.TEMP + "x")).write_text("")
    assert effects.sweep(root) == 1
