"""Index building: registers to the tables that lookups read.  Every function takes and returns DataFrames.

Where the order of rows matters (the first or last of several wins), a table may bring a column ``ord``; otherwise the order of
reading is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.functions.geo import STATION_BOX, accuracy_of_scale, finite, in_box, round_half_up
from azanami.functions.names import CHOME, expand_aliases
from azanami.functions.text import base_name, chome_display, chome_number, half_digits, to_exact_key, to_kana_key, to_key, town_name
from azanami.operators.order import first_wins, last_wins, mode_by
from azanami.operators.prefix import prefix_hits
from azanami.runtime import Stage

def _empty() -> Column:
    return F.lit("")


def with_order(df: DataFrame, ord_: str = "ord") -> DataFrame:
    return df if ord_ in df.columns else df.withColumn(ord_, F.monotonically_increasing_id())


def in_force(df: DataFrame) -> DataFrame:
    """Without rows that carry a date of abolition."""
    return df.where(F.coalesce(F.col("ablt_date"), _empty()) == "")


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("e_status") == "0")


def positions(pos: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat, lng): finite positions, the last row of a key."""
    p = with_order(pos).select(*keys, finite(F.col("rep_lat")).alias("lat"), finite(F.col("rep_lon")).alias("lng"), "ord").where("lat is not null and lng is not null")
    return last_wins(p, keys, "ord").drop("ord")


def city_level(ward: Column, pref: Column, city: Column) -> Column:
    return F.when(ward != "", "ward").when((pref == "東京都") & city.endswith("区"), "special_ward").otherwise("city")


def build_cities(mt_pref: DataFrame, mt_pref_pos: DataFrame, mt_city: DataFrame, mt_city_pos: DataFrame, mt_town: DataFrame) -> DataFrame:
    """Prefectures (code of two digits) and municipalities with their keys, readings, parent city, position and town count."""
    pref = in_force(mt_pref).join(positions(mt_pref_pos, ["lg_code"]), "lg_code", "left")
    code2 = F.substring("lg_code", 1, 2)
    prefs = pref.select(code2.alias("code"), code2.alias("pref"), F.col("pref").alias("name"), F.lit("pref").alias("level"), F.array(to_key(F.col("pref"))).alias("k"),
                        F.filter(F.array(to_kana_key(F.col("pref_kana"))), lambda x: x != "").alias("kk"), F.lit(None).cast("string").alias("county"), F.lit(None).cast("string").alias("parent"), "lat", "lng", F.lit(None).cast("long").alias("towns"))
    c = mt_city.select(*(F.coalesce(F.col(x), _empty()).alias(x) for x in mt_city.columns))
    towns = mt_town.groupBy("lg_code").agg(F.count(F.lit(1)).alias("towns"))
    bodies = c.where("ward = ''").select("pref", "city", F.col("lg_code").alias("parent")).dropDuplicates(["pref", "city"])
    ward = F.col("ward") != ""
    both = lambda w, ct, co: F.array(F.when(ward, F.col(w)).otherwise(F.col(ct)), F.when(ward, F.concat(ct, w)).when(F.col("county") != "", F.concat(co, ct)))
    keys = lambda arr, fn: F.array_distinct(F.transform(F.filter(arr, lambda x: x.isNotNull() & (x != "")), fn))
    names = c.select("*", F.posexplode(both("ward", "city", "county")).alias("_i", "_n"), both("ward_kana", "city_kana", "county_kana").alias("_kanas"))
    names = names.where("_n is not null and _n <> ''").select("lg_code", "_i", to_key(F.col("_n")).alias("_k"), to_kana_key(F.get("_kanas", F.col("_i"))).alias("_kk"))
    keyed = names.groupBy("lg_code").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_k"))), lambda x: x["_k"])).alias("k"),
        F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_kk"))), lambda x: x["_kk"]), lambda x: x.isNotNull() & (x != ""))).alias("kk"))
    out = c.join(keyed, "lg_code", "left").join(positions(mt_city_pos, ["lg_code"]), "lg_code", "left").join(towns, "lg_code", "left").join(bodies, ["pref", "city"], "left")
    cities = out.select(F.col("lg_code").alias("code"), code2.alias("pref"), F.concat("city", "ward").alias("name"), city_level(F.col("ward"), F.col("pref"), F.col("city")).alias("level"), "k", "kk",
                        F.when(F.col("county") != "", F.col("county")).alias("county"), F.when(ward, F.col("parent")).alias("parent"), "lat", "lng", F.coalesce("towns", F.lit(0)).cast("long").alias("towns"))
    return prefs.unionByName(cities)


def place_towns(mt_town: DataFrame, mt_town_pos: DataFrame, isj: DataFrame | None = None) -> DataFrame:
    """Named towns with the position of the first source that has one: own, other survey's, or inherited from the parent
    (chome, then the survey's chome, then its oaza).  Adds lat, lng, source and flags (1 residential, 2 inherited)."""
    t = with_order(mt_town)
    for c in ("oaza_cho", "chome", "koaza", "oaza_cho_kana", "chome_kana", "koaza_kana"):
        t = t.withColumn(c, F.coalesce(F.col(c), _empty()))
    t = t.where(F.concat("oaza_cho", "chome", "koaza") != "")
    t = t.withColumns({"_c5": F.substring("lg_code", 1, 5), "_own": to_key(F.concat("oaza_cho", "chome", "koaza")), "_up": to_key(F.concat("oaza_cho", "chome")), "_oaza": to_key(F.col("oaza_cho"))})
    abr = positions(mt_town_pos, ["lg_code", "machiaza_id"]).withColumnsRenamed({"lat": "_alat", "lng": "_alng"})
    t = t.join(abr, ["lg_code", "machiaza_id"], "left")
    if isj is not None:
        i = with_order(isj).select(F.col("city5").alias("_c5"), to_key(F.col("name")).alias("_k"), finite(F.col("lat")).alias("lat"), finite(F.col("lng")).alias("lng"), "ord").where("lat is not null and lng is not null")
        i = last_wins(i, ["_c5", "_k"], "ord").drop("ord")
        for tag, key in (("_i", "_own"), ("_j", "_up"), ("_o", "_oaza")):
            t = t.join(i.withColumnsRenamed({"_k": key, "lat": f"{tag}lat", "lng": f"{tag}lng"}), ["_c5", key], "left")
    else:
        t = t.withColumns({f"{tag}{x}": F.lit(None).cast("double") for tag in ("_i", "_j", "_o") for x in ("lat", "lng")})
    t = Stage(t.sparkSession, "place").keep(t, "keys")
    t = t.withColumns({"_slat": F.coalesce("_alat", "_ilat"), "_slng": F.coalesce("_alng", "_ilng")})
    up = first_wins(t.where("_slat is not null").select("lg_code", "_up", F.col("_slat").alias("_plat"), F.col("_slng").alias("_plng"), "ord"), ["lg_code", "_up"], "ord").drop("ord")
    t = t.join(up, ["lg_code", "_up"], "left")
    source = F.when(F.col("_alat").isNotNull(), "abr").when(F.col("_ilat").isNotNull(), "isj").when(F.coalesce("_plat", "_jlat", "_olat").isNotNull(), "parent").otherwise("none")
    out = t.withColumns({"lat": F.round(F.coalesce("_slat", "_plat", "_jlat", "_olat"), 6), "lng": F.round(F.coalesce("_slng", "_plng", "_jlng", "_olng"), 6), "source": source})
    flags = F.when(F.col("rsdt_addr_flg") == "1", 1).otherwise(0) + F.when(F.col("source") == "parent", 2).otherwise(0)
    return out.withColumn("flags", flags).select("ord", "lg_code", "machiaza_id", "oaza_cho", "oaza_cho_kana", "chome", "chome_kana", "koaza", "koaza_kana", "lat", "lng", "source", "flags")


def position_stats(placed: DataFrame) -> DataFrame:
    """One row: towns by source of their position, and coverage in percent of towns and of small sections."""
    own = F.col("source").isin("abr", "isj")
    small = F.col("koaza") != ""
    return placed.agg(*(F.count_if(F.col("source") == s).alias(s) for s in ("abr", "isj", "parent", "none")), F.round(100 * F.try_divide(F.count_if(own & ~small), F.count_if(~small)), 3).alias("oaza_pct"), F.round(100 * F.try_divide(F.count_if(own & small), F.count_if(small)), 3).alias("koaza_pct"))


def build_towns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(town_key, town_kana): one row per key and town, and per reading and key that it stands for."""
    no = chome_number(F.col("chome"))
    odd = F.when(no > 0, _empty()).otherwise(chome_display(F.col("chome")))
    t = placed.withColumns({"_no": no, "_o": half_digits(F.col("oaza_cho")), "_k": half_digits(F.concat(odd, "koaza"))})
    t = t.withColumn("_names", expand_aliases(F.col("oaza_cho"), F.col("chome"), F.col("koaza")))
    rows = t.select("*", F.posexplode("_names").alias("_a", "_n"))
    keys = rows.select(to_key(F.col("_n.name")).alias("key"), F.col("_n.guard").alias("guard"), "_a", "ord", "lg_code", "machiaza_id", F.col("_o").alias("oaza"), F.col("_no").alias("chome"), F.col("_k").alias("koaza"), "lat", "lng", "flags",
                       to_exact_key(town_name(F.col("_o"), F.col("_no"), F.col("_k"))).alias("exact_key")).where("key <> ''")
    keys = keys.withColumn("_r", F.row_number().over(Window.partitionBy("key", "ord", "lg_code", "machiaza_id").orderBy("_a"))).where("_r = 1").drop("_r", "_a")  # one town's few names
    number = F.regexp_extract("chome", CHOME, 1)
    kana = t.where((F.concat("oaza_cho_kana", "chome_kana", "koaza_kana") != "") & ((F.col("koaza") == "") | (F.col("koaza_kana") != "")))
    full = to_kana_key(F.concat("oaza_cho_kana", "chome_kana", "koaza_kana"))
    short = F.when((number != "") & (F.col("koaza") == "") & (F.col("oaza_cho_kana") != ""), F.concat(to_kana_key(F.col("oaza_cho_kana")), to_key(number)))
    kana = kana.select("ord", to_key(F.col("_names")[0]["name"]).alias("ref_key"), F.explode(F.array(full, short)).alias("kana_key")).where("kana_key is not null and kana_key <> ''")
    return keys, kana.groupBy("kana_key", "ref_key").agg(F.min("ord").alias("ord"))


def build_blocks(blk: DataFrame, blk_pos: DataFrame) -> DataFrame:
    keys = ["lg_code", "machiaza_id", "blk_id"]
    b = in_force(blk).join(positions(blk_pos, keys), keys)
    b = with_order(b).select(F.col("lg_code").alias("lg"), "machiaza_id", F.col("blk_num").alias("blk"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "ord")
    return last_wins(b, ["lg", "machiaza_id", "blk"], "ord").drop("ord")


def build_numbers(rsdt: DataFrame, rsdt_pos: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lg, machiaza_id, blk, no_key, no, branch, dlat, dlng): offsets from the block in 1e-6 degrees."""
    keys = ["lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id"]
    src = in_force(with_order(rsdt)).select(*(F.coalesce(F.col(c), _empty()).alias(c) for c in keys), F.col("blk_num").alias("blk"), "rsdt_num", F.coalesce("rsdt_num2", _empty()).alias("rsdt_num2"), "ord")
    pos = rsdt_pos.select(*(F.coalesce(F.col(c), _empty()).alias(c) for c in keys), "rep_lat", "rep_lon", *(["ord"] if "ord" in rsdt_pos.columns else []))
    n = src.join(positions(pos, keys), keys).withColumnRenamed("lg_code", "lg").join(blocks.withColumnsRenamed({"lat": "b_lat", "lng": "b_lng"}), ["lg", "machiaza_id", "blk"])
    n = n.where(F.coalesce("rsdt_num", _empty()) != "").select("lg", "machiaza_id", "blk", F.when(F.col("rsdt_num2") != "", F.concat_ws("-", "rsdt_num", "rsdt_num2")).otherwise(F.col("rsdt_num")).alias("no_key"),
                                                           F.col("rsdt_num").try_cast("int").alias("no"), F.when(F.col("rsdt_num2") != "", F.col("rsdt_num2")).alias("branch"),
                                                           round_half_up(F.col("lat") - F.col("b_lat"), 1e6).alias("dlat"), round_half_up(F.col("lng") - F.col("b_lng"), 1e6).alias("dlng"), "ord")
    return last_wins(n, ["lg", "machiaza_id", "blk", "no_key"], "ord").drop("ord")


def build_parcels(parcel: DataFrame, parcel_pos: DataFrame) -> DataFrame:
    """(lg, machiaza_id, ord, a, b, c, lat, lng, scale, accuracy): lots with a position, in order of their numbers; of repeated positions the first counts."""
    keys = ["machiaza_id", "prc_id"]
    pos = with_order(parcel_pos).select(*keys, finite(F.col("rep_lat")).alias("lat"), finite(F.col("rep_lon")).alias("lng"), F.coalesce(F.col("rep_scale").try_cast("int"), F.lit(0)).alias("scale"), "ord").where("lat is not null and lng is not null")
    pos = first_wins(pos, keys, "ord").drop("ord")
    num = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    p = in_force(parcel).select("lg_code", *keys, num("prc_num1").alias("a"), num("prc_num2").alias("b"), num("prc_num3").alias("c")).join(pos, keys)
    p = p.withColumnRenamed("lg_code", "lg").withColumn("ord", F.row_number().over(Window.partitionBy("lg", "machiaza_id").orderBy("a", "b", "c", "prc_id")))
    return p.select("lg", "machiaza_id", "ord", "a", "b", "c", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "scale", accuracy_of_scale(F.col("scale")).alias("accuracy"))


def parcel_deltas(parcels: DataFrame) -> DataFrame:
    """Consecutive differences of numbers and of offsets from the town's centroid in 1e-5 degrees, the compact exchange form."""
    from azanami.operators.order import delta_encode

    centre = parcels.groupBy("lg", "machiaza_id").agg(F.round(F.avg("lat"), 6).alias("o_lat"), F.round(F.avg("lng"), 6).alias("o_lng"))
    p = parcels.join(centre, ["lg", "machiaza_id"]).withColumns({"y": round_half_up(F.col("lat") - F.col("o_lat"), 1e5), "x": round_half_up(F.col("lng") - F.col("o_lng"), 1e5)})
    return delta_encode(p.select("lg", "machiaza_id", "o_lat", "o_lng", "ord", "a", "b", "c", "y", "x", "scale"), ["lg", "machiaza_id"], ["ord"], ["a", "y", "x"])


def build_aliases(old: DataFrame, current: DataFrame, cities: DataFrame, town_names: DataFrame) -> DataFrame:
    """(key, code, ord): names of former municipalities with the present one: by base name within the prefecture, else the
    one with most towns whose names begin with the old name.  town_names: (oaza, lg_code)."""
    prefs = cities.where("level = 'pref'").select(F.col("code").alias("p"), F.col("name").alias("pref"))
    o = with_order(old).withColumn("code5", F.substring("geoshape_city_id", 1, 5)).where(F.col("code5").rlike("^[0-9]{5}$")).join(F.broadcast(prefs), "pref")  # 47 rows
    o = o.join(current.select(F.col("geoshape_city_id").alias("code5")).distinct(), "code5", "left_anti")
    o = o.select("p", "pref", F.concat("name", F.coalesce(F.split("suffix", "/")[0], _empty())).alias("name"), "ord")
    o = first_wins(o, ["p", "name"], "ord").withColumn("base", base_name(F.col("name")))
    c = with_order(cities.where("level <> 'pref'"), "_o").withColumn("short", F.when(F.col("level") == "ward", F.substring_index("name", "市", -1)).otherwise(F.col("name")))
    bases = c.select(F.col("pref").alias("p"), "code", "_o", F.posexplode(F.array(base_name(F.col("short")), base_name(F.col("name")))).alias("_i", "base")).withColumn("_w", F.col("_o") * 2 + F.col("_i"))
    bases = first_wins(bases.select("p", "base", "code", "_w"), ["p", "base"], "_w").select("p", "base", F.col("code").alias("direct"))
    o = o.join(bases, ["p", "base"], "left")
    missing = o.where("direct is null").select("p", "name", "base").withColumn("forms", F.array_distinct(F.array("name", "base")))
    t = with_order(town_names, "_t").select(F.substring("lg_code", 1, 2).alias("p"), "oaza", "lg_code", "_t").where("oaza <> ''")
    forms = missing.select("p", "name", F.explode("forms").alias("form")).where("form <> ''")
    hits = prefix_hits(t, "oaza", forms.withColumnRenamed("p", "fp"), "form").where("p = fp").select("p", "name", "lg_code", "_t").distinct()
    via = mode_by(hits, ["p", "name"], "lg_code", "_t").select("p", "name", F.col("lg_code").alias("via"))
    found = o.join(via, ["p", "name"], "left").withColumn("code", F.coalesce("direct", "via")).where("code is not null")
    keys = found.select("code", "ord", F.explode(F.array("name", F.concat("pref", "name"))).alias("n")).select(to_key(F.col("n")).alias("key"), "code", "ord").where("key <> ''")
    return keys.groupBy("key", "code").agg(F.min("ord").alias("ord"))


def build_rail(company: DataFrame, line: DataFrame, station: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, stations) in operation; stations with a position in the country, in the order along their lines."""
    comp = active(company).select("company_cd", F.col("company_name"))
    lines = active(line).join(comp, "company_cd", "left").select(F.col("line_cd").cast("int").alias("code"), F.col("line_name").alias("name"), F.coalesce("company_name", _empty()).alias("company"))
    s = active(station).withColumns({"lat": finite(F.col("lat")), "lng": finite(F.col("lon"))}).where(in_box(F.col("lat"), F.col("lng"), STATION_BOX))
    s = s.select(F.col("station_cd").cast("int").alias("code"), F.col("station_g_cd").cast("int").alias("group_code"), F.col("station_name").alias("name"), F.col("line_cd").cast("int").alias("line_code"), F.col("pref_cd").try_cast("int").alias("pref"),
                 F.replace(F.coalesce("post", _empty()), F.lit("-"), F.lit("")).alias("postal_code"), "address", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.coalesce(F.col("e_sort").try_cast("long"), F.lit(0)).alias("e_sort"))
    return lines, s.withColumn("ord", F.col("e_sort") * F.lit(10_000_000) + F.col("code")).drop("e_sort")


def build_version(files: DataFrame) -> DataFrame:
    """One row from (source, name, modified, version): newest date, files, distinct names and the most frequent version of each source."""
    per = files.groupBy("source", "version").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("source").agg(F.max_by("version", F.struct("n", "version")).alias("version"))
    agg = files.groupBy("source").agg(F.date_format(F.max("modified"), "yyyy-MM-dd").alias("modified"), F.count(F.lit(1)).alias("files"), F.count_distinct("name").alias("names"))
    return agg.join(top, "source")
