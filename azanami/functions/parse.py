"""What follows the town in an address: numbers with their units, and the building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from azanami.functions.text import DASHES, arabic_numerals, let, nfkc, strip_separator

#: Three numbers make an address; what follows them is a room.
MAX_TOKENS = 3
# Unit words and what they number.
UNITS = {"丁目": "chome", "丁": "chome", "番地": "ban", "番": "ban", "号": "go", "条": "jo", "地割": "chiwari"}
#: What may stand between two numbers: a unit, a particle or a dash; longer words are tried first.
_BETWEEN = "|".join(sorted([*UNITS, "番地の", "の", "ノ", "之", *DASHES], key=lambda w: (-len(w), w)))
_RUN = f"^([0-9]+(?:(?:{_BETWEEN})[0-9]*)*)"
_UNIT = "|".join(sorted(UNITS, key=lambda w: (-len(w), w)))
#: Common words in the names of buildings and of their parts.
_BUILDING = "|".join("アパート エステート ガーデン コート コーポ センター タワー テラス ハイツ ハイム ハウス パレス パーク ビル プラザ マンション メゾン レジデンス ヴィラ 会館 寮 荘 館 棟 階 号室".split())
TOKENS = "array<struct<value:bigint,unit:string>>"


def parse_tail_of_nfkc(s: Column) -> Column:
    """struct(tokens, building) of text that is NFKC already; building is null if there is none."""
    text = F.regexp_replace(arabic_numerals(s), r"(?U)\s", "")
    pattern = F.lit(f"([0-9]+)({_UNIT})?")
    names = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))

    def scan(t: Column) -> Column:
        run = F.regexp_extract(t, _RUN, 1)
        tokens = F.zip_with(F.regexp_extract_all(run, pattern, F.lit(1)), F.regexp_extract_all(run, pattern, F.lit(2)), lambda n, w: F.struct(n.try_cast("long").alias("value"), F.when(w != "", names[w]).alias("unit")))
        return F.struct(F.filter(tokens, lambda x: x["value"].isNotNull()).alias("tokens"), F.substring(t, F.length(run) + 1, F.length(t)).alias("after"))

    def split(x: Column) -> Column:
        over = F.array_join(F.transform(F.filter(x["tokens"], lambda t, i: i >= MAX_TOKENS), lambda t: t["value"].cast("string")), "-")
        building = F.trim(strip_separator(F.concat(over, x["after"])))
        return F.struct(F.slice(x["tokens"], 1, MAX_TOKENS).cast(TOKENS).alias("tokens"), F.when(building != "", building).alias("building"))

    return let(let(text, scan), split)


def parse_tail(s: Column) -> Column:
    return parse_tail_of_nfkc(nfkc(s))


def looks_like_building(s: Column) -> Column:
    return F.coalesce(s.rlike(f"{_BUILDING}") | s.rlike("^[0-9]+$"), F.lit(False))


def assign_ban_go(tokens: Column) -> Column:
    """struct(block, number): named units win and exclude the rest; otherwise the unnamed numbers in order."""
    pick = lambda unit: F.get(F.filter(tokens, lambda t: t["unit"] == unit), F.lit(0))["value"]
    plain = F.filter(tokens, lambda t: t["unit"].isNull())
    named = pick("ban").isNotNull() | pick("go").isNotNull()
    at = lambda i: F.get(plain, F.lit(i))["value"]
    return F.struct(F.when(named, pick("ban")).otherwise(at(0)).alias("block"), F.when(named, pick("go")).otherwise(at(1)).alias("number"))


def assign_parcel(tokens: Column) -> Column:
    """struct(a, b, c) of all numbers but the 丁目, zeros for missing ones; null without any."""
    nums = F.filter(tokens, lambda t: ~t["unit"].eqNullSafe("chome"))
    at = lambda i: F.coalesce(F.get(nums, F.lit(i))["value"], F.lit(0)).cast("long")
    return F.when(F.size(nums) > 0, F.struct(at(0).alias("a"), at(1).alias("b"), at(2).alias("c")))


def building_of_nfkc(rest: Column) -> Column:
    return parse_tail_of_nfkc(strip_separator(rest))["building"]
