import pytest

from shelfwright.functions import inbox, names, titles, volumes


@pytest.mark.parametrize(
    "path, want",
    [
        (r"[つくしあきひと] メイドインアビス\[つくしあきひと] メイドインアビス 第01巻.rar", ("つくしあきひと", "メイドインアビス", 1, 1, False, None)),
        (r"[あらゐけいいち] 日常(完)\[あらゐけいいち] 日常 第10巻(完).rar", ("あらゐけいいち", "日常", 10, 10, True, None)),
        (r"[Boichi] ORIGIN -オリジン-(完)\[Boichi] ORIGIN -オリジン- 第03巻.rar", ("Boichi", "ORIGIN -オリジン-", 3, 3, True, None)),
        (r"[おがきちか] Landreaall\[おがきちか] Landreaall ランドリオール 第37巻.rar", ("おがきちか", "Landreaall", 37, 37, False, None)),
        (r"[井上堅二×吉岡公威] ぐらんぶる/[井上堅二×吉岡公威] ぐらんぶる 01.rar", ("井上堅二×吉岡公威", "ぐらんぶる", 1, 1, False, None)),
        (r"[BETEMIUS (バシウス)] 同人誌\[BETEMIUS (バシウス)] あなたのヤミ鎮守府 1.rar", ("BETEMIUS (バシウス)", "同人誌", None, None, False, None)),
        (r"[吾峠呼世晴] 鬼滅の刃(完)\[吾峠呼世晴] 鬼滅の刃 外伝.rar", ("吾峠呼世晴", "鬼滅の刃", None, None, True, "外伝")),
        (r"[尾崎かおり] 神様がうそをつく。\[尾崎かおり] 神様がうそをつく。.zip", ("尾崎かおり", "神様がうそをつく。", None, None, False, "")),
        (r"[BETEMIUS (バシウス)] 同人誌\[BETEMIUS (バシウス)] 夕立の手紙.rar", ("BETEMIUS (バシウス)", "同人誌", None, None, False, None)),
        (r"[CLAMP] ×××HOLiC\[CLAMP] ×××HOLiC 第01-03巻.zip", ("CLAMP", "×××HOLiC", 1, 3, False, None)),
    ],
)
def test_library_entry(path, want):
    e = names.parse_library_entry(path)
    assert (e.author, e.title, e.volume_from, e.volume_to, e.completed, e.side_label) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("[Boichi] ORIGIN -オリジン- 第04巻 [LQ].rar", dict(volume_from=4, tags=["LQ"])),
        ("[ヤマシタトモコ] 違国日記 第03巻w.rar", dict(volume_from=3, title="違国日記", tail="w")),
        ("[あかりん 細音啓] なぜ僕の世界を誰も覚えていないのか？ 第０１巻 ［DL版］.rar", dict(title="なぜ僕の世界を誰も覚えていないのか？", volume_from=1, tags=["DL版"])),
        ("ｶﾞｯﾂ！ 第３巻.zip", dict(title="ｶﾞｯﾂ！", volume_from=3)),
        ("[作者] 作品 第12話.rar", dict(unit="話", volume_from=12)),
        ("[作者] 作品 第03巻.part2.rar", dict(part=".part2", part_no=2, volume_from=3)),
        ("[作者] 作品 第03巻.r00", dict(ext=".r00", part_no=0)),
        ("[作者] 作品 第03巻 (2).rar", dict(volume_from=3, title="作品")),
        ("", dict(title="", volume_from=None)),
    ],
)
def test_filename(name, want):
    got = names.parse_filename(name)
    assert {k: getattr(got, k) for k in want} == want


def test_volume_rules():
    f = lambda s: (x := volumes.find_volume(s)) and (x.lo, x.hi, x.unit)
    assert f("全6巻") == (1, 6, "巻") and f("第1巻-第6巻") == (1, 6, "巻") and f("1〜6話") == (1, 6, "話")
    assert f("vol.3") == (3, 3, "巻") and f("x_v03-04") == (3, 4, "巻") and f("nov01") is None
    assert f("6-1巻") is None and f("1-2024巻") is None  # settled, not read in part
    assert f("3巻と5巻") == (5, 5, "巻")
    assert volumes.series_key("作品名 第3巻") == volumes.series_key("作品名(完)") == "作品名"
    assert volumes.parse_explicit("(3)") == (3, 3) and volumes.parse_explicit("1-6") == (1, 6) and volumes.parse_explicit("") is None


def test_plan_names():
    assert names.plan_volume_name("ヤマシタトモコ", "違国日記", 1, 1) == "[ヤマシタトモコ] 違国日記 第01巻"
    assert names.plan_volume_name(None, "同人誌", 2, 2) == "同人誌 第02巻"
    assert names.plan_volume_name("CLAMP", "ちょびっツ?", 1, 1) == "[CLAMP] ちょびっツ？ 第01巻"
    assert names.plan_volume_name(None, " ", 1, 1) is None and names.plan_folder_name(None, "(完)", True) is None
    assert names.plan_folder_name("A", "B(完)", True) == "[A] B(完)"
    long = names.plan_folder_name("A", "あ" * 200, True)
    assert len(long) == 110 and long.endswith("(完)")
    assert names.sanitize("CON") == "CON_" and names.sanitize("a. .") == "a" and names.sanitize("\x00") is None
    assert names.plan_name("rsdjf1me5yac.rar").keep_name
    p = names.plan_name("x.rar", "作者", "題" * 100, 3, 3)
    assert len("/".join(("/base" * 20, names.fit_path("/base" * 20, p).file))) <= 240


@pytest.mark.parametrize(
    "stem, want",
    [
        ("Akatsuki_no_Yona_26v2", ("Akatsuki_no_Yona", 26, 26, "巻")),
        ("Kasane_12", ("Kasane", 12, 12, "巻")),
        ("Landreaall", ("Landreaall", None, None, "巻")),
        ("100man no Inochi no ue ni ore v15-16s", ("100man no Inochi no ue ni ore", 15, 16, "巻")),
        ("[藤栄道彦]_最後のレストランch84-103", ("[藤栄道彦]_最後のレストラン", 84, 103, "話")),
        ("幼女戦記_外伝1,_2_第61-63話_[2020-11〜2021-03]", ("幼女戦記_外伝1,_2", 61, 63, "話")),
        ("Busamen_Gachi_Fighter_01s ch05-07", ("Busamen_Gachi_Fighter", 1, 1, "巻")),
        ("Series_1999-2024", ("Series_1999-2024", None, None, "巻")),
    ],
)
def test_inbox(stem, want):
    assert tuple(inbox.split_inbox_name(stem)) == want


def test_inbox_keys_and_readings():
    a, b = (inbox.parse_inbox_name(n).key for n in ("MG-Zip.Com-One_Punch-man_15_LQ.rar", "One_Punch-man_16.rar"))
    assert a == b == "onepunchman"
    assert inbox.inbox_key("SPY×FAMILY") == "spyxfamily"
    assert inbox.romaji("シュッパツ") == "shuppatsu" and inbox.romaji("ヴィンランド サガ") == "vinrandosaga" and inbox.romaji("キョー") == "kyo"


@pytest.mark.parametrize("raw, want", [("２", 2), ("第3巻", 3), ("其ノ3", 3), ("VOL.2", 2), ("no.2", 2), ("#2", 2), ("[2]", 2), ("6 (四月になれば彼女は)", 6), ("3 : pbk", 3), ("上", None), ("第2部[3]", None), ("15-16", None), ("fight 1", None), ("", None), (None, None)])
def test_ndl_volume(raw, want):
    assert titles.parse_ndl_volume(raw) == want


def test_titles():
    assert titles.split_title("血界戦線 8 ─幻界病棟ライゼズ─") == ("血界戦線", 8) and titles.split_title("血界戦線（10）") == ("血界戦線", 10)
    assert titles.split_title("ゾン100") == ("ゾン100", None) and titles.split_title("20世紀少年") == ("20世紀少年", None)
    assert titles.split_rakuten("日常　（十二）") == ("日常", 12) and titles.split_rakuten("ヒストリエ 十巻") == ("ヒストリエ", 10) and titles.split_rakuten("鋼の錬金術師（完全版）").volume is None
    assert titles.split_google("よつばと!(14) 14") == ("よつばと!", 14) and titles.split_google("よつばと!(14) 15") == ("よつばと!(14)", 15) and titles.split_google("ゾン100").volume is None
    assert titles.tidy_author("藤田, 和日郎, 1964-") == "藤田和日郎" and titles.tidy_author("Tolstoy, Leo, 1828-1910") == "Leo Tolstoy"
    assert titles.tidy_author("広江 礼威") == "広江 礼威" and titles.tidy_author(" ") is None
    assert titles.kanji_number("二十三") == 23 and titles.kanji_number("十") == 10 and titles.kanji_number("二三") == 23
    assert [titles.kanji_number(x) for x in ("二〇", "一二", "〇", "零", "九十九", "", "十十", "二a")] == [20, 12, 0, 0, 99, None, None, None]
    assert titles.split_rakuten("日常（二〇）") == ("日常", 20) and titles.split_rakuten("日常 一〇五巻") == ("日常", 105)
