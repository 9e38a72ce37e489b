"""Address resolution end to end on the written gazetteer."""

import pytest
from pyspark.sql import functions as F

from azanami.fixtures import gazetteer
from azanami.functions import parse, text
from azanami.plans.engine import GeoEngine
from azanami.queries import gazetteer as queries

CASES = {
    1: "東京都世田谷区太子堂5-5-5",
    2: "東京都世田谷区太子堂五丁目５番３２号 キャロットタワー3F",
    3: "東京都世田谷区太子堂5-6-1",
    4: "せたがやくたいしどう5-5-5",
    5: "東京都世田ケ谷区太子堂5-5-5",
    6: "中央区銀座1-1-1",
    7: "東京都存在しない市",
    8: "あいうえお",
    9: "浦和市高砂3-15-1",
    10: "神奈川県横須賀市野増字王ノ上",
    11: "北海道石狩郡当別町太美町1-2",
    12: "北海道当別町太美町1-9",
    13: "太子堂50番地",
    14: "太子堂5丁目",
    15: "",
    16: None,
    17: "北海道当別町獅子内東7",
    18: "当別町",
    19: "東京都世田谷区太子童5-5-5",
    20: "東京都世田谷区太子堂5-99-5",
}


@pytest.fixture(scope="module")
def found(spark):
    engine = GeoEngine(spark, gazetteer(spark))
    rows = engine.geocode(spark.createDataFrame(list(CASES.items()), "id long, address string")).collect()
    out: dict[int, list] = {i: [] for i in CASES}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        out[r["id"]].append(r)
    return out


def test_number_is_reached(found):
    r = found[1][0]
    assert (r.match_level, r.accuracy, r.score, r.machiaza_id) == ("rsdt", "surveyed", 1.0, "0038005")
    assert (r.lat, r.lng) == (35.644194, 139.667013)
    assert r.address == "東京都世田谷区太子堂五丁目5番5号" and r.system == "residential"


def test_branch_and_building(found):
    r = found[2][0]
    assert r.match_level == "rsdt" and r.address.endswith("5番32-1号") and r.building == "キャロットタワー3F"


def test_block_without_number(found):
    r = found[3][0]
    assert (r.match_level, r.lat, r.lng, r.accuracy) == ("block", 35.645, 139.667, "representative")
    assert found[20][0].match_level == "oaza" and found[20][0].lat == 35.6461


def test_readings_score_lower(found):
    r = found[4][0]
    assert (r.match_level, r.score) == ("rsdt", 0.81)


def test_one_edit(found):
    assert (found[5][0].match_level, found[5][0].score) == ("rsdt", 0.6)
    assert (found[19][0].match_level, found[19][0].score) == ("rsdt", 0.6)


def test_ambiguous_city(found):
    assert found[6][0].city == "中央区" and found[6][0].match_level == "oaza"


def test_fallbacks(found):
    assert [r.match_level for r in found[7]] == ["pref"]
    assert found[8] == [] and found[15] == [] and found[16] == []
    assert [r.match_level for r in found[18]] == ["city"] and found[18][0].pref == "北海道"


def test_former_name(found):
    r = found[9][0]
    assert (r.lg_code, r.score, r.match_level) == ("111074", 0.85, "oaza")


def test_exact_spelling_narrows(found):
    assert [r.machiaza_id for r in found[10]] == ["0013000"]


def test_parcels(found):
    r = found[11][0]
    assert (r.match_level, r.lat, r.lng, r.accuracy, list(r.parcel), r.parcel_exact) == ("parcel", 34.9611, 136.62905, "surveyed", [1, 2], True)
    r = found[12][0]
    assert r.match_level == "parcel" and r.lat == 34.961 and not r.parcel_exact
    assert found[17][0].match_level == "parcel" and found[17][0].lat == 43.21


def test_guard(found):
    assert all(r.chome is None for r in found[13])
    assert found[14][0].chome == 5 and found[14][0].city == "世田谷区"


def test_cities_only(spark):
    t = gazetteer(spark)
    t.town_key = None
    engine = GeoEngine(spark, t)
    rows = engine.geocode(spark.createDataFrame([(1, "中央区銀座1-1-1")], "id long, address string")).orderBy("rank").collect()
    assert [r.city for r in rows] == ["中央区", "大阪市中央区"]


def test_nearest_by_address(spark):
    engine = GeoEngine(spark, gazetteer(spark))
    rows = engine.nearest_by_address(spark.createDataFrame([(1, "中央区銀座1-1-1"), (2, "ない")], "id long, address string"), limit=2).orderBy("id", "rank").collect()
    assert [(r.id, r.code) for r in rows] == [(1, 3), (1, 1), (2, None)]


def test_whole_tails(spark):
    city = spark.createDataFrame([("01", "01", "雪県", "pref", None), ("010011", "01", "雪道市", "city", None), ("010029", "01", "川島町", "city", "石郡")], "code string, pref string, name string, level string, county string")
    towns = spark.createDataFrame([("010011", "梅条原"), ("010011", "草麻端"), ("010011", "三条町"), ("010029", "塩峰")], "lg_code string, oaza_cho string")
    want = [
        ("雪道市梅条原３８番地", "38", "ban", None, (None, None), "38"),
        ("雪道市草麻端七丁目4番13号", "7,4,13", "chome,ban,go", None, None, "7-4-13"),
        ("雪県 雪道市　大字草麻端 ７丁目４－１３ 駅前ビル2F", "7,4,13", "chome,,", "駅前ビル2F", None, "7-4-13駅前ビル2F"),
        ("〒123-4567 雪県雪道市三条町十二番三号", "12,3", "ban,go", None, None, "12-3"),
        ("雪県石郡川島町塩峰二の三", "2,3", ",", None, None, "2-3"),
        ("川島町無之谷五丁目６番", "5,6", "chome,ban", None, None, "5-6"),
        ("雪道市梅条原駅前ビル", "", "", "駅前ビル", None, "駅前ビル"),
        ("無之谷", "", "", None, None, ""),
    ]
    a = spark.createDataFrame([(i, w[0]) for i, w in enumerate(want)], "code int, address string")
    tails = queries.after_town(a, towns, city)
    parsed = tails.select("code", parse.parse_tail(F.col("s")).alias("t"))
    got = {r.code: (r.numbers, r.units, r.building) for r in queries._numbers_of(parsed).collect()}
    assert got == {i: w[1:4] for i, w in enumerate(want)}
    lots = {r.code: (r.block, r.number, r.a) for r in queries._assigned(parsed).collect()}
    assert lots[0] == (38, None, 38) and lots[1] == (4, 13, 4) and lots[2] == (4, 13, 4) and lots[4] == (2, 3, 2)
    assert {r.code: r.b for r in tails.select("code", text.normalize_banchi(F.col("s")).alias("b")).collect()} == {i: w[5] for i, w in enumerate(want)}


def test_collisions_of_whole_names(spark):
    rnd = __import__("random").Random(5)
    names = ["霞ヶ丘", "霞が丘", "霞ケ丘東", "栁町", "柳町", "梅原一", "梅原１", "梅原南", "栁町"]
    kana = ["カスミガオカ", "かすみがおか", None, "ヤナギマチ", "", "ウメハラ"]
    rows = [("010011", f"{i:07d}", rnd.choice(names), rnd.choice(["", "一丁目", "１丁目"]), "", rnd.choice(kana), "", None) for i in range(25)]
    towns = spark.createDataFrame(rows, "lg_code string, machiaza_id string, oaza_cho string, chome string, koaza string, oaza_cho_kana string, chome_kana string, koaza_kana string")
    pos = spark.createDataFrame([(r[0], r[1], 35.0, 139.0) for r in rows[:9]], "lg_code string, machiaza_id string, lat double, lng double")
    kana_key = {k: v for k, v in zip([k for k in kana if k], [r[0] for r in spark.createDataFrame([(k,) for k in kana if k], "k string").select(text.to_kana_key("k")).collect()])}
    want: dict = {}
    for lg, i, o, c, _, k, *_ in rows:
        for axis, key in (("spelling", text.key_text(o + c)), ("reading", kana_key.get(k))):
            if key:
                want.setdefault((axis, lg, key), (set(), set()))[0].add(o + c)
                want[axis, lg, key][1].add(i)
    want = {k: (len(n), len(i)) for k, (n, i) in want.items() if len(n) > 1}
    got = {(r.axis, r.lg_code, r.key): (r.names, r.ids) for r in queries.collisions_of_names(towns, pos).collect()}
    assert sorted(got.items()) == sorted(want.items())
    assert ("spelling", "010011", "柳町1丁目") in got
