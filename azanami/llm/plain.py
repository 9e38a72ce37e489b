"""Visually identical text with different characters: one consistent form, and which values had deviated.

Most deviations are decided letter by letter: compatibility and presentation forms, radicals, uncomposed marks,
spaces, and characters that show nothing.  Look-alike letters of another script or kind need the corpus.  A value is cut
into tokens: runs of alphabet letters, and runs of kana with the ideographs that look like kana (the particles ノ and ケ stand
alone).  A token's *skeleton* has one letter for each class of look-alikes, so all its writings share it, and the vocabulary of
the whole corpus counts the values that hold each writing.

A token of mixed script is written in one script, the dominant one where there is one, if that result exists in the vocabulary.  A
token of one script is changed only where the vocabulary clearly prefers another writing of its skeleton in another script
(八口 for ハロ).  Where a mixed token's result is too rare to be in the vocabulary, its letters in their contexts must be, and
letters of an alphabet that the corpus does not use follow the one it uses.  Letters of one script never replace each other (土 and 士).
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from azanami.operators.skew import attach_by_key
from azanami.runtime import Stage

# Look-alikes, one class a word.
LOOK_ALIKES = (
    "AΑА BΒВ CСϹ EΕЕ FϜ HΗН I1lΙІӀӏ JЈͿ KΚК LᏞ MΜМϺ NΝ O0ΟО PΡР QԚ SЅ TΤТ UԱ VѴ WԜ XΧХ YΥҮ ZΖ "
    "aа cсϲ dԁ eе hһ iіι jјϳ kκ mⅿ nո oоο pрρ qԛ rг sѕ tτ uսυ vνѵ wԝ xхχ yу zᴢ "
    "カ力 ニ二 ハ八 ロ口 エ工 ト卜 タ夕 ミ三彡 ノ丿 チ千 ム厶 ヌ又 ー一 オ才 へヘ べベ ぺペ りリ"
)
# Radicals that normalization leaves alone, with the ideograph each looks like.
RADICALS = (
    "⺀冫 ⺁厂 ⺄乙 ⺅亻 ⺆冂 ⺇几 ⺈刀 ⺉刂 ⺊卜 ⺋㔾 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺑尣 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗心 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爪 ⺦丬 ⺧牛 ⺨犭 ⺩王 ⺪疋 ⺫罒 ⺬示 ⺭礻 ⺮竹 ⺯糹 "
    "⺰纟 ⺱罓 ⺲罒 ⺳网 ⺴网 ⺵网 ⺶羊 ⺷羊 ⺸羊 ⺹耂 ⺺肀 ⺻聿 ⺼肉 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻇角 ⻈讠 ⻉贝 ⻊足 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻕阝 ⻖阝 ⻗雨 ⻘青 ⻙韦 "
    "⻚页 ⻛风 ⻜飞 ⻝食 ⻞食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟"
)
_RADICAL = {p[0]: p[1] for p in RADICALS.split()}
#: Classes of alphabets, whose foreign members are told even where no context is known.
N_FOREIGN = sum(g[0].isascii() for g in LOOK_ALIKES.split())
_CLASS = {c: k for k, group in enumerate(LOOK_ALIKES.split()) for c in group}
_REP = {c: group[0] for group in LOOK_ALIKES.split() for c in group}
#: Uses from which a skeleton's or a class' favourite is trusted, and the part of them that it must have.  One value's
#: copies count as COPIES uses at most, so that a deviating value with many copies does not become the favourite.
MIN_USES, FAVOURITE, COPIES = 5, 0.8, 16
_PARTICLES = frozenset("ノ丿ケヶ")
#: Scripts and kinds that are told apart, by the expression that finds them in the JVM.
KINDS = {"L": r"\p{IsLatin}", "C": r"\p{IsCyrillic}", "G": r"\p{IsGreek}", "K": r"[\p{IsKatakana}ー]", "H": r"\p{IsHiragana}", "Z": r"\p{IsHan}", "N": r"\p{Nd}"}
_NAMED = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G", "KATAKANA": "K", "KATAKANA-HIRAGANA": "K", "HIRAGANA": "H", "CJK": "Z", "IDEOGRAPHIC": "Z", "DIGIT": "N"}


@cache
def kind(c: str) -> str:
    """Script of a letter, N for digits, ? for other scripts."""
    return _NAMED.get(unicodedata.name(c, "").split(" ")[0], "?")


#: class -> kind -> its first letter of that kind.
_BY_KIND = [{kind(c): c for c in reversed(g)} for g in LOOK_ALIKES.split()]


@cache
def _fix(c: str) -> str | None:
    """What c is replaced by if it is no plain character; None if it is one."""
    o = ord(c)
    if o < 0x80:
        return None if c in "\t" or o >= 0x20 and o != 0x7F else (" " if c in "\n\r\x0b\x0c" else "")
    cat = unicodedata.category(c)
    if cat in ("Zs", "Zl", "Zp") or o == 0x85:
        return " "
    if cat in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF or c in "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ⠀":
        return ""
    if c in _RADICAL:
        return _RADICAL[c]
    n = unicodedata.normalize("NFKC", c)
    if c in _CLASS and _CLASS.get(n) != _CLASS[c]:
        return None  # its compatible letter is another one than it looks like
    return n if n != c else None


def settle(value: str) -> tuple[str, bool]:
    """The value with everything repaired that needs no corpus, and whether anything was."""
    if value.isascii() and value.isprintable():
        return value, False
    odd = False
    out = []
    for c in value:
        f = _fix(c)
        odd |= f is not None
        out.append(c if f is None else f)
    text = "".join(out)
    composed = unicodedata.normalize("NFC", text)
    if composed != text or any(c in composed for c in "゙゚"):
        odd = True
    if not odd and any(unicodedata.category(c) == "Mn" and "̀" <= c <= "ͯ" for c in composed):
        odd = True
    return composed, odd


@cache
def _family(c: str) -> str:
    k = kind(c)
    if c in _CLASS:
        return "alphabet" if _CLASS[c] < N_FOREIGN else "kana"
    return "kana" if k in "KH" else "alphabet" if k in "LCG" else ""


def tokens(text: str) -> list[dict]:
    """Tokens that hold a letter with look-alikes: places, writing, skeleton, whether its script is mixed, the same in one script, and its letters."""
    if not any(c in _CLASS for c in text):
        return []
    spots = [i for i, c in enumerate(text) if c.isalnum()]
    near = ["^", *(_REP.get(text[i], text[i]).lower() for i in spots), "$"]
    out, run, last = [], [], ""
    for k, i in enumerate([*spots, None]):
        now = "" if i is None else "particle" if text[i] in _PARTICLES else _family(text[i])
        if run and (now != last or now == "particle"):
            if last and any(text[spots[j]] in _CLASS for j in run):
                out.append(_token(text, spots, run, near))
            run = []
        last = now
        run.append(k)
    return out


def _token(text: str, spots: list[int], run: list[int], near: list[str]) -> dict:
    at = [spots[j] for j in run]
    form = [text[i] for i in at]
    kinds = [kind(c) for c in form]
    mixed = len(set(kinds)) > 1
    one, most = [], Counter(kinds).most_common(1)[0]
    if mixed:
        for k in sorted((set(kinds) | {x for c in form if c in _CLASS for x in _BY_KIND[_CLASS[c]]}) - {"N"}):
            for digits in "N", "":  # digits go with any script, or stand for letters
                w = [c if kind(c) in (k, digits) else _BY_KIND[_CLASS[c]].get(k) if c in _CLASS else None for c in form]
                if None not in w:
                    one.append((-kinds.count(k), "".join(w)))
    rule = most[0] if mixed and 2 * most[1] > len(form) else None
    letters = []
    for j, c in zip(run, form):
        if c in _CLASS:
            want = _BY_KIND[_CLASS[c]].get(rule) if rule and kind(c) != rule else None
            letters.append({"at": spots[j], "cls": _CLASS[c], "c": c, "a": near[j], "b": near[j + 2], "want": want})
    return {"at": at, "form": "".join(form), "skel": "".join(_REP.get(c, c) for c in form), "one": [w for _, w in sorted(set(one))], "letters": letters}


def _settled(values: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [settle(v) for v in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "own": pdf["own"], "n": pdf["n"], "text": [t for t, _ in done], "odd": [o for _, o in done], "tokens": [tokens(t) for t, _ in done]})

    token = "at:array<int>,form:string,skel:string,one:array<string>,letters:array<struct<at:int,cls:int,c:string,a:string,b:string,want:string>>"
    return values.mapInPandas(run, f"value string, own long, n long, text string, odd boolean, tokens array<struct<{token}>>")


def _other_kinds(a: Column, b: Column) -> Column:
    """Whether two equally long writings differ only by letters of different kinds."""
    same = lambda x, y: F.coalesce(*(F.when(x.rlike(p) & y.rlike(p), True) for p in KINDS.values()), F.lit(False))
    return F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | ~same(x, y)), lambda ok: ok)


def _uses() -> Column:
    return F.least(F.col("n"), F.lit(COPIES)).alias("uses")


def rewritings(settled: DataFrame) -> DataFrame:
    """(skel, form, to): tokens that should be written otherwise, by the vocabulary of the whole corpus."""
    seen = settled.select(_uses(), F.explode("tokens").alias("t")).groupBy("t.skel", "t.form").agg(F.sum("uses").alias("n"), F.first("t.one").alias("one"))
    seen = Stage(settled.sparkSession, "vocabulary").keep(seen, "seen")
    best = seen.groupBy("skel").agg(F.sum("n").alias("all"), F.max(F.struct("n", "form")).alias("best"))
    sure = best.where((F.col("all") >= MIN_USES) & (F.col("best.n") >= FAVOURITE * F.col("all"))).select("skel", F.col("best.form").alias("fav"))
    tried = seen.select("skel", "form", F.posexplode("one").alias("i", "to")).where("form <> to")
    exists = tried.join(seen.select("skel", F.col("form").alias("to"), F.col("n").alias("m")), ["skel", "to"])
    # most frequent first; of equally frequent ones that in the token's dominant script
    exists = exists.groupBy("skel", "form").agg(F.max_by("to", F.struct("m", -F.col("i"))).alias("one_script"))
    both = seen.join(sure, "skel", "left").join(exists, ["skel", "form"], "left")
    to = F.when(F.col("fav").isNotNull() & ((F.col("fav") == F.col("form")) | _other_kinds(F.col("form"), F.col("fav"))), F.col("fav")).otherwise(F.col("one_script"))
    return both.select("skel", "form", to.alias("to")).where(F.col("to") != F.col("form"))


def letter_rules(settled: DataFrame) -> DataFrame:
    """(cls, a, b, c, want, to): what a letter between a and b becomes where its token's result is not in the vocabulary as a whole."""
    seen = settled.select(_uses(), F.explode("tokens").alias("t")).select("uses", F.explode("t.letters").alias("o")).groupBy("o.cls", "o.a", "o.b", "o.c", "o.want").agg(F.sum("uses").alias("n"))
    seen = Stage(settled.sparkSession, "letters").keep(seen, "letters")
    known = seen.groupBy("cls", "a", "b", F.col("c").alias("want")).agg(F.lit(True).alias("known"))
    alone = seen.where(F.col("cls") < N_FOREIGN).groupBy("cls", "c").agg(F.sum("n").alias("n")).groupBy("cls").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("best"))
    alone = alone.where((F.col("all") >= MIN_USES) & (F.col("best.n") >= FAVOURITE * F.col("all"))).select("cls", F.col("best.c").alias("fav"))
    both = seen.join(known, ["cls", "a", "b", "want"], "left").join(F.broadcast(alone), "cls", "left")  # one row a class
    to = F.coalesce(F.when(F.col("known"), F.col("want")), F.when(_other_kinds(F.col("c"), F.col("fav")), F.col("fav")))
    return both.select("cls", "a", "b", "c", "want", to.alias("to")).where(F.col("to") != F.col("c"))


def plain_values(values: DataFrame, value: str = "value", more: DataFrame | None = None) -> DataFrame:
    """(value, n, plain, deviates) for every distinct value of a column; null values have no row.

    ``more``: further values, in a column of the same name, that belong to the vocabulary only.  ``n`` counts the value's rows.  Empty text is plain.  ASCII letters, digits, spaces, tabs and punctuation never
    deviate.
    """
    stage = Stage(values.sparkSession, "plain")
    rows = values.select(F.col(value).cast("string").alias("value"), F.lit(1).alias("own"))
    if more is not None:
        rows = rows.unionByName(more.select(F.col(value).cast("string").alias("value"), F.lit(0).alias("own")))
    distinct = rows.where("value is not null").groupBy("value").agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("n"))
    settled = stage.keep(_settled(distinct), "settled")
    spots = settled.select("value", F.explode("tokens").alias("t")).select("value", "t.*")
    ruled = spots.join(stage.keep(rewritings(settled), "rules"), ["skel", "form"], "left")
    ruled = stage.keep(ruled.where("to is not null or exists(letters, x -> x.want is not null or ascii(x.c) > 127)"), "ruled")
    whole = ruled.where("to is not null").select("value", F.explode(F.arrays_zip("at", F.split("to", "").alias("to"))).alias("x")).select("value", "x.*")
    rest = ruled.where("to is null").select("value", F.explode("letters").alias("o")).select("value", "o.*")
    rules = letter_rules(settled).withColumnRenamed("want", "_want")
    single = rest.join(rules, ["cls", "a", "b", "c"]).where(F.col("want").eqNullSafe(F.col("_want"))).select("value", "at", "to")
    changed = whole.unionByName(single).groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("at", "to"))).alias("fix"))  # one value's letters
    both = settled.where("own > 0").drop("tokens").join(changed, "value", "left")
    letters = F.transform(F.split("text", ""), lambda c, i: F.coalesce(F.col("fix")[i], c))
    return both.select("value", F.col("own").alias("n"), F.when(F.col("fix").isNull(), F.col("text")).otherwise(F.array_join(letters, "")).alias("plain"), (F.col("odd") | F.col("fix").isNotNull()).alias("deviates"))


def plain_fields(tables: dict[str, tuple[DataFrame, str, list[str]]], vocabulary: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """(src_table, row_key, field_name, value, plain, deviates) for every value of the named fields.

    tables: name -> (DataFrame, key column, field columns).  All fields share one vocabulary, to which the
    columns in ``vocabulary`` add.  Null values have no row.
    """
    out = None
    for name, (df, key, fields) in tables.items():
        for f in fields:
            one = df.select(F.lit(name).alias("src_table"), F.col(key).cast("long").alias("row_key"), F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")).where("value is not null")
            out = one if out is None else out.unionByName(one)
    more = None
    for df, f in vocabulary:
        one = df.select(F.col(f).cast("string").alias("value"))
        more = one if more is None else more.unionByName(one)
    forms = Stage(out.sparkSession, "forms").keep(plain_values(out, more=more))
    return attach_by_key(out, forms, "value", "n").drop("n")


def deviating(tables: dict[str, tuple[DataFrame, str, list[str]]], vocabulary: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """(src_table, row_key, field_name) of the values that deviate from their plain form; rows without a key can't be named and are left out."""
    return plain_fields(tables, vocabulary).where("deviates and row_key is not null").select("src_table", "row_key", "field_name").distinct()
