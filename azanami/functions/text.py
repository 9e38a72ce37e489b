"""Comparable keys of Japanese place names and address strings, as column expressions.

NFKC needs Python (Spark has no such function), so keys of raw text are made whole in one Arrow-batched UDF: the rows make
the way to Python and back once.  For text that is NFKC already the same steps exist as JVM expressions (``..._of_nfkc``):
``translate`` for single letters, regular expressions with lookaround for what depends on the neighbours, and higher-order
functions for numerals.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# Old and variant letters with the letter in use now: all pairs of the source's table and further ones.  No letter in use now
# is an old one too.
VARIANTS = (
    "亞亜 惡悪 壓圧 圍囲 醫医 爲為 壹壱 飮飲 隱隠 榮栄 營営 衞衛 驛駅 圓円 鹽塩 緣縁 應応 歐欧 毆殴 櫻桜 奧奥 橫横 溫温 穩穏 假仮 價価 畫画 會会 壞壊 懷懐 繪絵 擴拡 殼殻 覺覚 學学 嶽岳 樂楽 勸勧 卷巻 歡歓 罐缶 觀観 關関 陷陥 巖巌 顏顔 歸帰 氣気 "
    "龜亀 僞偽 戲戯 犧犠 舊旧 據拠 擧挙 峽峡 狹狭 鄕郷 曉暁 區区 驅駆 勳勲 薰薫 徑径 惠恵 溪渓 經経 繼継 莖茎 螢蛍 輕軽 鷄鶏 藝芸 擊撃 縣県 劍剣 險険 圈圏 檢検 權権 獻献 硏研 顯顕 驗験 嚴厳 廣広 恆恒 鑛鉱 號号 國国 黑黒 濟済 碎砕 齋斎 劑剤 雜雑 "
    "參参 慘惨 棧桟 蠶蚕 讚讃 殘残 絲糸 齒歯 兒児 辭辞 濕湿 實実 舍舎 寫写 釋釈 壽寿 收収 從従 澁渋 獸獣 縱縦 肅粛 處処 敍叙 奬奨 將将 燒焼 稱称 證証 乘乗 剩剰 壤壌 孃嬢 條条 淨浄 疊畳 穰穣 讓譲 釀醸 觸触 寢寝 愼慎 晉晋 眞真 盡尽 圖図 粹粋 醉酔 "
    "隨随 髓髄 數数 樞枢 瀨瀬 聲声 靜静 齊斉 攝摂 竊窃 專専 戰戦 淺浅 潛潜 纖繊 踐践 錢銭 禪禅 雙双 壯壮 搜捜 插挿 巢巣 爭争 總総 聰聡 莊荘 裝装 騷騒 增増 藏蔵 臟臓 卽即 屬属 續続 墮堕 體体 對対 帶帯 滯滞 臺台 瀧滝 擇択 澤沢 單単 團団 癡痴 遲遅 "
    "晝昼 蟲虫 鑄鋳 廳庁 鎭鎮 遞逓 鐵鉄 轉転 點点 傳伝 黨党 盜盗 燈灯 當当 鬪闘 德徳 獨独 讀読 屆届 繩縄 貳弐 腦脳 廢廃 拜拝 賣売 麥麦 發発 髮髪 拔抜 蠻蛮 濱浜 甁瓶 拂払 佛仏 竝並 變変 邊辺 邉辺 辨弁 舖舗 穗穂 寶宝 豐豊 沒没 飜翻 萬万 滿満 默黙 "
    "彌弥 藥薬 譯訳 豫予 餘余 與与 譽誉 搖揺 樣様 謠謡 來来 賴頼 覽覧 龍竜 兩両 獵猟 綠緑 壘塁 勵励 禮礼 靈霊 齡齢 戀恋 爐炉 勞労 樓楼 祿禄 灣湾 嶋島 嶌島 濵浜 髙高 﨑崎 𠮷吉 桒桑 冨富 舘館 槇槙 藪薮 鷗鴎 靍鶴 渕淵 曾曽 薗園 圀国 畧略 峯峰 埜野 "
    "舩船 嵜崎 栁柳 檜桧 邨村 渴渇 揭掲 缺欠 儉倹 狀状 擔担 膽胆 斷断 彈弾 徵徴 聽聴 瓣弁 辯弁 步歩 每毎 亂乱 淚涙 隸隷 曆暦 歷歴 錄録 淸清 靑青 塲場 屛屏 侭儘"
)
_pairs = dict(VARIANTS.split())
VARIANT_FROM, VARIANT_TO = "".join(_pairs), "".join(_pairs.values())

_NOISE = r"(?U)[\s\x{FEFF},、，．.·・･]"
_HAN = r"\p{IsHan}0-9"
# Letters that stand for ケ or ノ between ideographs.
_ALWAYS_KE, _KE, _NO = "ヶヵゕゖ", "ケカがガ", "のノ之"
KANJI_DIGITS = "〇一二三四五六七八九"
_NUMERALS = "〇零一壱二弐三参四五六七八九十百千"
_DIGIT_FROM, _DIGIT_TO = "〇零一壱二弐三参四五六七八九", "00112233456789"
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
# Small and archaic kana with the plain one, and voiced kana with the unvoiced one.
_FOLD_FROM, _FOLD_TO = "ぁぃぅぇぉっゃゅょゎゐゑを", "あいうえおつやゆよわいえお"
_LOOSE_FROM, _LOOSE_TO = "がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽゔ", "かきくけこさしすせそたちつてとはひふへほはひふへほう"
_DROPPED_IN_READINGS = "ー―‐−–—・･"
DASHES = "-ー―‐−–—"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def let(c: Column, then) -> Column:
    """then(c) with c computed once, however often ``then`` mentions it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def strip_noise(s: Column) -> Column:
    """Without white space and the separators that carry no meaning in an address."""
    return F.regexp_replace(s, _NOISE, "")


def unify_variants(s: Column) -> Column:
    return F.translate(s, VARIANT_FROM, VARIANT_TO)


def unify_interstitial(s: Column) -> Column:
    """One spelling of the particles inside names (ケ, ノ), only between ideographs or digits so that katakana words stay whole."""
    s = F.regexp_replace(s, f"(?s)(?<=.)[{_ALWAYS_KE}](?=.)", "ケ")
    s = F.regexp_replace(s, f"(?<=[{_HAN}])[{_KE}](?=[{_HAN}])", "ケ")
    return F.regexp_replace(s, f"(?<=[{_HAN}])[{_NO}](?=[{_HAN}])", "ノ")


def kanji_to_number(s: Column) -> Column:
    """Value of a run of kanji numerals, by place (三百二) or digit by digit (三〇二); null for anything else."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("cur"))

    def step(acc: Column, c: Column) -> Column:
        digit = F.translate(c, _DIGIT_FROM, _DIGIT_TO).try_cast("long")
        unit = F.when(c == "十", 10).when(c == "百", 100).otherwise(1000)
        return F.when(digit.isNotNull(), F.struct(acc["total"].alias("total"), (acc["cur"] * 10 + digit).alias("cur"))).otherwise(
            F.struct((acc["total"] + F.when(acc["cur"] == 0, 1).otherwise(acc["cur"]) * unit).alias("total"), F.lit(0).cast("long").alias("cur"))
        )

    def value(r: Column) -> Column:
        by_place = F.aggregate(F.split(r, ""), start, step, lambda a: a["total"] + a["cur"])
        plain = F.translate(r, _DIGIT_FROM, _DIGIT_TO).try_cast("long")
        return F.when(r.rlike(f"^[{_NUMERALS}]+$"), F.when(r.rlike("[十百千]"), by_place).otherwise(plain))

    return let(s, value)


def arabic_numerals(s: Column) -> Column:
    """Every run of kanji numerals as Arabic digits, inside names too: keys must agree, not read well."""

    def replaced(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(f"([{_NUMERALS}]+)"), F.lit(1))
        between = F.split(t, f"[{_NUMERALS}]+", -1)
        number = lambda r: F.coalesce(kanji_to_number(r).cast("string"), r)
        joined = F.array_join(F.zip_with(between, F.transform(runs, number), lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), "")
        return F.when(t.rlike(f"[{_NUMERALS}]"), joined).otherwise(t)

    return let(s, replaced)


def key_of_nfkc(s: Column) -> Column:
    """``to_key`` for text that is NFKC already."""
    return arabic_numerals(unify_interstitial(unify_variants(strip_noise(s))))


_PY_HAN = "⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎\U00020000-\U000323af"
_PY_NOISE = re.compile(r"[\s\ufeff,、，．.·・･]")
_PY_VARIANTS = str.maketrans(VARIANT_FROM, VARIANT_TO)
_PY_SMALL = re.compile(f"(?s)(?<=.)[{_ALWAYS_KE}](?=.)")
_PY_KE, _PY_NO = (re.compile(f"(?<=[{_PY_HAN}0-9])[{x}](?=[{_PY_HAN}0-9])") for x in (_KE, _NO))
_PY_NUMERALS = re.compile(f"[{_NUMERALS}]+")
_PY_DIGIT = dict(zip(_DIGIT_FROM, map(int, _DIGIT_TO)))
_PY_UNIT = {"十": 10, "百": 100, "千": 1000}


def _numeral(m: re.Match) -> str:
    run = m.group()
    if not any(c in _PY_UNIT for c in run):
        return str(int("".join(str(_PY_DIGIT[c]) for c in run)))
    total = cur = 0
    for c in run:
        if c in _PY_DIGIT:
            cur = cur * 10 + _PY_DIGIT[c]
        else:
            total, cur = total + (cur or 1) * _PY_UNIT[c], 0
    return str(total + cur)


def key_text(v: str | None, unify: bool = True) -> str | None:
    """The key of one text."""
    if v is None:
        return None
    t = _PY_NOISE.sub("", v if v.isascii() else unicodedata.normalize("NFKC", v))
    if t.isascii():
        return t
    t = t.translate(_PY_VARIANTS)
    if unify:
        t = _PY_NO.sub("ノ", _PY_KE.sub("ケ", _PY_SMALL.sub("ケ", t)))
    return _PY_NUMERALS.sub(_numeral, t)


@F.pandas_udf(StringType())
def to_key(s: pd.Series) -> pd.Series:
    """The key by which names are looked up: NFKC, no separators, current letters, one spelling of ケ and ノ, Arabic digits."""
    return s.map(key_text)


def word_end_places(v: str | None) -> list[int] | None:
    """Letters of the key of one text before each of its inner spaces; none inside a run of kanji numerals, which is one number."""
    if v is None:
        return None
    out, at, cur = [], 0, ""
    for w in unicodedata.normalize("NFKC", v).split():
        if cur and not (cur[-1] in _NUMERALS and w[0] in _NUMERALS):
            at += len(key_text(cur))
            out.append(at)
            cur = ""
        cur += w
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def word_ends(s: pd.Series) -> pd.Series:
    """Places in ``to_key`` of a text where the text has a space."""
    return s.map(word_end_places)


@F.pandas_udf(StringType())
def to_exact_key(s: pd.Series) -> pd.Series:
    """As ``to_key`` but ケ and ノ as written: tells apart names that share a key."""
    return s.map(lambda v: key_text(v, False))


def exact_key_of_nfkc(s: Column) -> Column:
    return arabic_numerals(unify_variants(strip_noise(s)))


def hiragana(s: Column) -> Column:
    return F.translate(s, _KATAKANA, _HIRAGANA)


def kana_key_of_nfkc(s: Column) -> Column:
    s = F.regexp_replace(hiragana(s), r"(?U)[\s\x{FEFF}]", "")
    return F.translate(s, _FOLD_FROM + _DROPPED_IN_READINGS + _ALWAYS_KE, _FOLD_TO)  # letters beyond the second list are deleted


_PY_KANA = str.maketrans({**dict(zip(_KATAKANA, _HIRAGANA)), **dict.fromkeys(_DROPPED_IN_READINGS + _ALWAYS_KE + "ゕゖ")})
_PY_FOLD = str.maketrans(_FOLD_FROM, _FOLD_TO)
_PY_SPACE = re.compile(r"[\s\ufeff]")


@F.pandas_udf(StringType())
def to_kana_key(s: pd.Series) -> pd.Series:
    """Key of a reading: hiragana, no long-vowel marks, small and archaic kana as plain ones, voicing kept."""
    return s.map(lambda v: v if v is None else _PY_SPACE.sub("", unicodedata.normalize("NFKC", v)).translate(_PY_KANA).translate(_PY_FOLD))


def loosen(kana_key: Column) -> Column:
    return F.translate(kana_key, _LOOSE_FROM, _LOOSE_TO)


def to_kana_loose_key(s: Column) -> Column:
    """As ``to_kana_key`` without voicing."""
    return loosen(to_kana_key(s))


def number_to_kanji(n: Column) -> Column:
    """0 .. 999 in kanji; other numbers in digits."""
    n = n.cast("long")
    digit = lambda d: F.substring(F.lit(KANJI_DIGITS), d.cast("int") + 1, 1)
    place = lambda d, name: F.when(d == 0, "").when(d == 1, name).otherwise(F.concat(digit(d), F.lit(name)))
    h, t, o = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    text = F.concat(place(h, "百"), place(t, "十"), F.when(o == 0, "").otherwise(digit(o)))
    return F.when(n == 0, KANJI_DIGITS[0]).when((n < 0) | (n >= 1000), n.cast("string")).otherwise(text)


def half_digits(s: Column) -> Column:
    return F.translate(s, "０１２３４５６７８９", "0123456789")


def chome_display(s: Column) -> Column:
    """５丁目 as 五丁目; anything else as it is."""
    n = F.regexp_extract(half_digits(s), "^([0-9]+)(丁目|丁)$", 1)
    unit = F.regexp_extract(half_digits(s), "^([0-9]+)(丁目|丁)$", 2)
    return F.when(n != "", F.concat(number_to_kanji(n.try_cast("long")), unit)).otherwise(s)


def chome_number(s: Column) -> Column:
    """The number of a 丁目 in digits or kanji, 0 for anything else."""
    head = F.regexp_extract(half_digits(s), f"^([0-9]+|[{_NUMERALS}]+)丁目$", 1)
    return F.coalesce(head.try_cast("int"), kanji_to_number(head).cast("int"), F.lit(0))


def normalize_banchi_of_nfkc(s: Column) -> Column:
    s = F.regexp_replace(arabic_numerals(s), "丁目|丁|番地の|番地|番|号|の|ノ|之", "-")
    s = F.regexp_replace(s, f"[{DASHES}]+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def normalize_banchi(s: Column) -> Column:
    """Numbers of an address joined by hyphens: 一丁目二番三号, 1の2の3 and １－２－３ are all 1-2-3."""
    return normalize_banchi_of_nfkc(nfkc(s))


def base_name(s: Column) -> Column:
    """A municipality's name without its last 市, 町, 村 or 区."""
    return F.regexp_replace(s, "[市町村区]$", "")


def town_name(oaza: Column, chome: Column, koaza: Column) -> Column:
    """Display name from the parts; chome is a number, 0 for none."""
    c = F.when(chome > 0, F.concat(number_to_kanji(chome), F.lit("丁目"))).otherwise("")
    return F.concat(F.coalesce(oaza, F.lit("")), c, F.coalesce(koaza, F.lit("")))


def strip_separator(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{DASHES}の]", "")


def digit_runs(s: Column) -> Column:
    return F.array_join(F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1)), ",")


def allowed_distance(length: Column) -> Column:
    """Names of up to three letters must be written right; longer ones may have one edit."""
    return F.when(length <= 3, 0).otherwise(1)


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 for anything beyond."""
    if most <= 0:
        return F.when(a == b, 0).otherwise(1)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def typo_distance(text: Column, name: Column) -> Column:
    """0 or 1 edits between text and name, null if more, or if their numbers differ, or if the name is short and differs."""
    d = bounded_levenshtein(text, name, 1)
    return F.when((digit_runs(text) == digit_runs(name)) & (d <= allowed_distance(F.length(name))), d)
