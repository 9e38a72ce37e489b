"""Keys, numerals, readings and address tails against written expectations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from azanami.functions import geo, parse, text
from azanami.functions.names import expand_aliases, prefectures
from azanami.plans.directory import resolve_prefs


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_one_key(spark):
    for group in (["霞ヶ関", "霞が関", "霞カ関", "霞ケ関"], ["一ノ関", "一の関", "一之関"], ["国立　市", "國立市"], ["１丁目", "一丁目", "1丁目"]):
        assert len(set(apply(spark, text.to_key, group))) == 1, group


#: The pairs of the reference's table (src/core/variants.ts) but the two that hold one letter twice.
REFERENCE_PAIRS = (
    "髙高 𠮷吉 﨑崎 嵜崎 邊辺 邉辺 澤沢 濱浜 濵浜 舘館 曾曽 瀨瀬 齋斎 齊斉 冨富 栁柳 檜桧 嶋島 嶌島 峯峰 邨村 槇槙 亞亜 圍囲 醫医 壹壱 飮飲 隱隠 營営 榮栄 衞衛 驛駅 圓円 緣縁 應応 歐欧 櫻桜 奧奥 橫横 溫温 假仮 價価 畫画 會会 壞壊 懷懐 樂楽 渴渇 卷巻 關関 "
    "歡歓 舊旧 據拠 擧挙 峽峡 狹狭 曉暁 區区 驅駆 勸勧 惠恵 揭掲 缺欠 儉倹 劍剣 圈圏 檢検 權権 獻献 縣県 險険 顯顕 驗験 嚴厳 廣広 恆恒 鑛鉱 號号 國国 齒歯 濕湿 實実 舍舎 寫写 收収 從従 澁渋 獸獣 縱縦 將将 稱称 燒焼 條条 狀状 乘乗 淨浄 剩剰 疊畳 孃嬢 讓譲 "
    "釀醸 盡尽 醉酔 髓髄 數数 樞枢 靜静 攝摂 專専 戰戦 纖繊 禪禅 雙双 壯壮 搜捜 插挿 巢巣 爭争 總総 莊荘 裝装 藏蔵 臟臓 屬属 續続 墮堕 體体 對対 帶帯 滯滞 臺台 擇択 單単 擔担 膽胆 團団 斷断 彈弾 遲遅 晝昼 蟲虫 鑄鋳 廳庁 徵徴 聽聴 鎭鎮 傳伝 轉転 點点 燈灯 "
    "當当 鬪闘 德徳 讀読 拜拝 賣売 髮髪 拔抜 拂払 佛仏 竝並 變変 瓣弁 辨弁 辯弁 舖舗 步歩 寶宝 豐豊 沒没 飜翻 每毎 萬万 滿満 麥麦 默黙 彌弥 藥薬 譯訳 豫予 餘余 與与 譽誉 搖揺 樣様 謠謡 來来 賴頼 亂乱 覽覧 龍竜 兩両 獵猟 綠緑 淚涙 壘塁 勵励 禮礼 隸隷 靈霊 "
    "齡齢 曆暦 歷歴 戀恋 勞労 樓楼 錄録 灣湾 壽寿 眞真 淸清 靑青 塲場 屛屏 觀観 鐵鉄 學学 圖図 桒桑 侭儘 "
).split()


def test_old_letters(spark):
    assert len(REFERENCE_PAIRS) == 220
    pairs = REFERENCE_PAIRS + text.VARIANTS.split()
    old, new = ([f"{p[i]}田{p[i]}" for p in pairs] for i in (0, 1))
    for fn in (text.to_key, text.to_exact_key, text.key_of_nfkc, text.unify_variants):
        a, b = apply(spark, fn, old), apply(spark, fn, new)
        assert [p for p, x, y in zip(pairs, a, b) if x != y] == []
    assert not set(text.VARIANT_FROM) & set(text.VARIANT_TO)
    assert apply(spark, text.to_key, ["栁町", "檜原邨", "淸水步"]) == ["柳町", "桧原村", "清水歩"]


def test_different_keys(spark):
    for a, b in (("中島", "中ノ島"), ("岩崎", "岩ケ崎")):
        x, y = apply(spark, text.to_key, [a, b])
        assert x != y


def test_katakana_words_stay(spark):
    words = ["アカシア通", "モノレール", "ノ田"]
    assert apply(spark, text.to_key, words) == words


def test_exact_key_keeps_spelling_and_length(spark):
    a = ["霞が関一丁目", "野増字王の上", "東京都千代田区霞ヶ関"]
    keys, exact = apply(spark, text.to_key, a), apply(spark, text.to_exact_key, a)
    assert [len(k) for k in keys] == [len(e) for e in exact] and keys[0] != exact[0]


def test_numerals(spark):
    assert apply(spark, text.kanji_to_number, ["千二百三十四", "二三", "三百", "十", "〇一二", "", "甲", None]) == [1234, 23, 300, 10, 12, None, None, None]
    assert apply(spark, text.arabic_numerals, ["千代田", "三軒", "2十", "無"]) == ["1000代田", "3軒", "210", "無"]
    n = spark.range(0, 1001).select(text.number_to_kanji(F.col("id")).alias("k"), "id")
    got = {r.id: r.k for r in n.collect()}
    assert (got[0], got[12], got[100], got[234], got[999], got[1000]) == ("〇", "十二", "百", "二百三十四", "九百九十九", "1000")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 999), min_size=1, max_size=50))
def test_numeral_round_trip(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert all(r.n == r.m for r in df.withColumn("m", text.kanji_to_number(text.number_to_kanji(F.col("n")))).collect())


def test_chome(spark):
    assert apply(spark, text.chome_display, ["５丁目", "12丁目", "五丁目", "乙"]) == ["五丁目", "十二丁目", "五丁目", "乙"]
    assert apply(spark, text.chome_number, ["５丁目", "二十三丁目", "乙", ""]) == [5, 23, 0, 0]


def test_banchi(spark):
    assert set(apply(spark, text.normalize_banchi, ["一丁目二番三号", "1の2の3", "１－２－３"])) == {"1-2-3"}


def test_readings(spark):
    assert apply(spark, text.to_kana_key, ["タイシドウ", "ｾﾀｶﾞﾔ", "ちょうふ", "ヶ ヱー"]) == ["たいしどう", "せたがや", "ちようふ", "え"]
    a, b = apply(spark, text.to_kana_key, ["しんかわ", "じんかわ"])
    assert a != b
    assert len(set(apply(spark, text.to_kana_loose_key, ["しんかわ", "じんかわ"]))) == 1


def test_typos(spark):
    df = spark.createDataFrame([("1丁目", "2丁目"), ("本町", "元町"), ("北12条東3丁目", "北12条西3丁目"), ("世田ケ谷区", "世田谷区"), ("あいうえお", "かきくけこ")], "a string, b string")
    assert [r[0] for r in df.select(text.typo_distance(F.col("a"), F.col("b"))).collect()] == [None, None, 1, 1, None]
    assert [r[0] for r in df.select(text.bounded_levenshtein(F.col("a"), F.col("b"), 1)).collect()][-1] == 2


@pytest.mark.parametrize("tail,values,units,building", [
    ("1丁目2番3号", [1, 2, 3], ["chome", "ban", "go"], None),
    ("3-1-1○○ビル3F", [3, 1, 1], [None] * 3, "○○ビル3F"),
    ("5-5-5-301", [5, 5, 5], [None] * 3, "301"),
    ("１２３番地の４", [123, 4], ["ban", None], None),
    ("駅前ビル", [], [], "駅前ビル"),
    ("", [], [], None),
])
def test_tails(spark, tail, values, units, building):
    t = apply(spark, parse.parse_tail, [tail])[0]
    assert ([x.value for x in t.tokens], [x.unit for x in t.tokens], t.building) == (values, units, building)


def test_assignment(spark):
    def both(s):
        df = spark.createDataFrame([(s,)], "s string").select(parse.parse_tail(F.col("s")).alias("t"))
        r = df.select(parse.assign_ban_go(F.col("t.tokens")).alias("b"), parse.assign_parcel(F.col("t.tokens")).alias("p")).first()
        return (r.b.block, r.b.number), r.p and tuple(r.p)

    assert both("5-6") == ((5, 6), (5, 6, 0))
    assert both("2丁目5番6号") == ((5, 6), (5, 6, 0))
    assert both("1番2") == ((1, None), (1, 2, 0))
    assert both("ビル") == ((None, None), None)


def test_buildings(spark):
    assert apply(spark, parse.looks_like_building, ["キャロットタワー", "301", "三丁目", "", None]) == [True, True, False, False, False]


def test_aliases(spark):
    df = spark.createDataFrame([("太子堂", "５丁目", ""), ("長刀鉾町", "", "四条通烏丸東入"), ("町", "", "室町通四条上る"), (None, None, None)], "o string, c string, k string")
    got = [[(x.name, x.guard) for x in r[0]] for r in df.select(expand_aliases(F.col("o"), F.col("c"), F.col("k"))).collect()]
    assert got[0] == [("太子堂５丁目", None), ("太子堂５", "nodigit")]
    assert {n for n, _ in got[1]} == {"長刀鉾町四条通烏丸東入", "四条通烏丸東入長刀鉾町", "四条通烏丸東入"}
    assert ("室町通四条上ル", None) in got[2] and got[3] == []


def test_prefectures(spark):
    p = prefectures(spark)
    assert p.count() == 47
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["14", "１４", "神奈川", "京都", "0", "48", "京都市", None, "北海道", "東京都渋谷区"])], "i int, s string")
    got = {r.i: r.pref for r in resolve_prefs(df, "s", p).collect()}
    assert [got[i] for i in range(10)] == ["14", "14", "14", "26", None, None, None, None, "01", None]


def test_python_and_jvm_keys_agree(spark):
    rnd = __import__("random").Random(11)
    values = ["".join(rnd.choice("霞ヶケがガカのノ之関國千十二〇三1０９ア ー-・,町ゕゖヵぁゐ澤") for _ in range(rnd.randint(0, 9))) for _ in range(400)] + [None, "", "ab, c"]
    for a, b in ((text.to_key, text.key_of_nfkc), (text.to_exact_key, text.exact_key_of_nfkc), (text.to_kana_key, text.kana_key_of_nfkc)):
        assert apply(spark, a, values) == apply(spark, lambda c, b=b: b(text.nfkc(c)), values)


def test_old_letters_reach_the_letter_in_use():
    # written out: one pair of each kind (old form, variant form, two old forms of one letter, beyond the basic plane)
    pairs = "醫医 恆恒 從従 戰戦 釀醸 險険 驗験 栁柳 檜桧 邨村 嵜崎 﨑崎 淸清 靑青 步歩 狹狭 權権 假仮 遲遅 專専 邊辺 邉辺 髙高 𠮷吉 濱浜 濵浜 澤沢 齋斎 國国 圀国 龍竜 嶋島 嶌島 渕淵 冨富"
    for pair in pairs.split():
        assert text.key_text("北" + pair[0] + "町") == text.key_text("北" + pair[1] + "町") == "北" + pair[1] + "町"


def test_distance_of_missing_points(spark):
    df = spark.createDataFrame([(35.0, 139.0, None, 139.0), (35.0, 139.0, 35.0, 139.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r.m for r in df.select(geo.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect()]
    assert got[:2] == [None, 0.0] and abs(got[2] - 6371000 * 3.141592653589793) < 1
