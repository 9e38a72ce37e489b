"""A small gazetteer written out by hand, for tests and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession

from azanami.plans.build import build_towns
from azanami.plans.engine import Tables

CITY = "code string, pref string, name string, level string, k array<string>, kk array<string>, county string, parent string, lat double, lng double, towns int"
CITIES = [
    ("01", "01", "北海道", "pref", ["北海道"], [], None, None, 43.06, 141.35, None),
    ("11", "11", "埼玉県", "pref", ["埼玉県"], [], None, None, 35.86, 139.65, None),
    ("13", "13", "東京都", "pref", ["東京都"], [], None, None, 35.69, 139.69, None),
    ("14", "14", "神奈川県", "pref", ["神奈川県"], [], None, None, 35.45, 139.64, None),
    ("013030", "01", "当別町", "city", ["当別町", "石狩郡当別町"], ["とうべつちよう", "いしかりぐんとうべつちよう"], "石狩郡", None, 43.22, 141.52, 30),
    ("111007", "11", "さいたま市", "city", ["さいたま市"], ["さいたまし"], None, None, 35.86, 139.65, 0),
    ("111074", "11", "さいたま市浦和区", "ward", ["浦和区", "さいたま市浦和区"], ["うらわく", "さいたましうらわく"], None, "111007", 35.87, 139.64, 60),
    ("131024", "13", "中央区", "special_ward", ["中央区"], ["ちゆうおうく"], None, None, 35.67, 139.77, 20),
    ("131121", "13", "世田谷区", "special_ward", ["世田谷区"], ["せたがやく"], None, None, 35.65, 139.65, 62),
    ("141003", "14", "横浜市", "city", ["横浜市"], ["よこはまし"], None, None, 35.44, 139.64, 0),
    ("141011", "14", "横浜市鶴見区", "ward", ["鶴見区", "横浜市鶴見区"], ["つるみく", "よこはましつるみく"], None, "141003", 35.51, 139.68, 40),
    ("141020", "14", "横浜市神奈川区", "ward", ["神奈川区", "横浜市神奈川区"], ["かながわく", "よこはましかながわく"], None, "141003", 35.48, 139.63, 50),
    ("142018", "14", "横須賀市", "city", ["横須賀市"], ["よこすかし"], None, None, 35.28, 139.67, 80),
    ("271284", "27", "大阪市中央区", "ward", ["中央区", "大阪市中央区"], ["ちゆうおうく", "おおさかしちゆうおうく"], None, "271004", 34.68, 135.51, 10),
]
PLACED = "ord long, lg_code string, machiaza_id string, oaza_cho string, oaza_cho_kana string, chome string, chome_kana string, koaza string, koaza_kana string, lat double, lng double, source string, flags int"
TOWNS = [
    (1, "131121", "0038004", "太子堂", "タイシドウ", "四丁目", "ヨンチョウメ", "", "", 35.6447, 139.6690, "abr", 1),
    (2, "131121", "0038005", "太子堂", "タイシドウ", "五丁目", "ゴチョウメ", "", "", 35.6461, 139.6680, "abr", 1),
    (3, "131024", "0001001", "銀座", "ギンザ", "一丁目", "イッチョウメ", "", "", 35.6741, 139.7680, "abr", 1),
    (4, "142018", "0012000", "野増字王の上", "ノマシアザオウノウエ", "", "", "", "", 35.25, 139.66, "abr", 0),
    (5, "142018", "0013000", "野増字王ノ上", "ノマシアザオウノウエ", "", "", "", "", 35.26, 139.67, "abr", 0),
    (6, "013030", "0001000", "太美町", "フトミチョウ", "", "", "", "", None, None, "none", 0),
    (7, "111074", "0020001", "高砂", "タカサゴ", "三丁目", "サンチョウメ", "", "", 35.8617, 139.6455, "abr", 1),
    (8, "013030", "0002101", "獅子内", "シシナイ", "", "", "東", "ヒガシ", 43.2, 141.5, "abr", 0),
]
BLOCKS = [("131121", "0038005", "5", 35.6443, 139.6669), ("131121", "0038005", "6", 35.645, 139.667)]
NUMBERS = [("131121", "0038005", "5", "5", -106, 113), ("131121", "0038005", "5", "32-1", 200, -200), ("131121", "0038005", "5", "32-10", 300, -300)]
PARCELS = [("013030", "0001000", i, a, b, 0, lat, lng, s) for i, (a, b, lat, lng, s) in enumerate([(1, 0, 34.961, 136.629, 500), (1, 2, 34.9611, 136.62905, 500), (1, 3, 34.9612, 136.6291, 600), (5, 0, 34.9607, 136.6294, 1000), (100, 0, 34.9627, 136.6286, 0)])] + [("013030", "0002000", 0, 7, 0, 0, 43.21, 141.51, 500)]
STATIONS = [(1, 100, "東京", 11, 13, 35.681382, 139.766084, 1), (2, 100, "東京", 12, 13, 35.681391, 139.766103, 2), (3, 101, "有楽町", 11, 13, 35.675069, 139.763328, 3), (4, 102, "大宮", 12, 11, 35.906295, 139.623999, 4)]
LINES = [(11, "山手線", "JR"), (12, "東北線", "JR"), (13, "廃線", "")]
ALIASES = [("浦和市", "111074", 1), ("埼玉県浦和市", "111074", 2)]


def gazetteer(spark: SparkSession) -> Tables:
    df = spark.createDataFrame
    keys, kana = build_towns(df(TOWNS, PLACED))
    return Tables(
        cities=df([(*r, i) for i, r in enumerate(CITIES)], CITY + ", city_ord long"),
        town_key=keys, town_kana=kana,
        blocks=df(BLOCKS, "lg string, machiaza_id string, blk string, lat double, lng double"),
        numbers=df(NUMBERS, "lg string, machiaza_id string, blk string, no_key string, dlat int, dlng int"),
        parcels=df(PARCELS, "lg string, machiaza_id string, ord int, a int, b int, c int, lat double, lng double, scale int"),
        aliases=df(ALIASES, "key string, code string, ord long"),
        lines=df(LINES, "code int, name string, company string"),
        stations=df(STATIONS, "code int, group_code int, name string, line_code int, pref int, lat double, lng double, ord int"),
    )
