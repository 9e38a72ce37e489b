"""Batch address resolution: prefecture, municipality, town, then number or lot, each with a score.

The plan is one DataFrame pipeline per batch.  Fallbacks (spelling, reading, one edit) are stages separated by anti-joins;
dictionary matches are equi-joins on expanded prefixes of *distinct* texts; only the first ``DESCEND``
towns of an address are looked up down to the number, by equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.functions.geo import accuracy_of_scale
from azanami.functions.names import prefecture_keys, prefectures
from azanami.functions.parse import assign_ban_go, assign_parcel, parse_tail_of_nfkc
from azanami.functions.text import kana_key_of_nfkc, strip_separator, to_exact_key, to_key, town_name
from azanami.operators.knn import nearest_stations
from azanami.operators.prefix import explains, fuzzy_prefix, prefix_hits, rest_after_kana, unguarded
from azanami.operators.small import join_small
from azanami.runtime import Stage

DEPTH = {"pref": 1, "city": 2, "oaza": 3, "block": 4, "parcel": 4, "rsdt": 5}
EXACT, KANA, TYPO, ALIAS = 1.0, 0.9, 0.6, 0.85
DESCEND, CITY_TYPOS, TOWN_TYPOS = 2, 8, 5
#: Keys of one municipality that keep their order.
MOST_KEYS = 2048
_GUARD = "[市区町村郡]"
CANDIDATE = ("address string, lat double, lng double, match_level string, system string, accuracy string, score double, building string, lg_code string, machiaza_id string, "
             "pref string, city string, county string, oaza string, chome int, koaza string, block bigint, rsdt bigint, parcel array<bigint>, parcel_exact boolean")


@dataclass
class Tables:
    """What the engine reads; a missing table switches its stage off."""

    cities: DataFrame
    town_key: DataFrame | None = None
    town_kana: DataFrame | None = None
    blocks: DataFrame | None = None
    numbers: DataFrame | None = None
    parcels: DataFrame | None = None
    aliases: DataFrame | None = None
    lines: DataFrame | None = None
    stations: DataFrame | None = None
    prefs: DataFrame | None = None


class GeoEngine:
    """Resolution and directory over one set of tables."""

    def __init__(self, spark: SparkSession, tables: Tables, limit: int = 5, apply_guard: bool = True):
        self.spark, self.t, self.limit, self.apply_guard = spark, tables, limit, apply_guard
        own = tables.cities.where("level = 'pref'").select("code", "name")
        self.prefs = tables.prefs if tables.prefs is not None else (own if not own.isEmpty() else prefectures(spark))
        c = tables.cities if "city_ord" in tables.cities.columns else tables.cities.withColumn("city_ord", F.row_number().over(Window.orderBy("code")).cast("long"))  # some thousand rows
        self.cities = c

    # ---- dictionaries

    def _entries(self) -> DataFrame:
        """(e_ord, key, kana, code, c_pref, towns): every key of a municipality, the first reading with each, further readings alone."""
        c = self.cities.where("level <> 'pref'").select("city_ord", "code", F.col("pref").alias("c_pref"), F.coalesce("k", F.array().cast("array<string>")).alias("k"), F.coalesce("kk", F.array().cast("array<string>")).alias("kk"))
        kana = F.get("kk", F.lit(0))
        keyed = c.select("*", F.posexplode("k").alias("_i", "key")).select((F.col("city_ord") * 2 * MOST_KEYS + F.col("_i")).alias("e_ord"), "key", kana.alias("kana"), "code", "c_pref")
        more = c.select("*", F.posexplode("kk").alias("_i", "kana")).where("_i > 0").select((F.col("city_ord") * 2 * MOST_KEYS + MOST_KEYS + F.col("_i")).alias("e_ord"), F.lit("").alias("key"), "kana", "code", "c_pref")
        return keyed.unionByName(more)

    def strip_pref(self, df: DataFrame) -> DataFrame:
        """Adds pref, pref_name and rest to (id, key): the longest prefecture name at the begin, a short one not before 市区町村郡."""
        hits = prefix_hits(df.select("id", "key").withColumnRenamed("key", "_text"), "_text", prefecture_keys(self.prefs).withColumnRenamed("key", "_k"), "_k")
        hits = hits.where(F.col("whole") | ~F.col("rest").rlike(f"^{_GUARD}"))
        best = hits.groupBy("id").agg(F.max_by(F.struct("pref", "pref_name", "rest"), F.col("matched")).alias("_b")).select("id", "_b.*")
        return df.join(best, "id", "left").withColumn("rest", F.coalesce("rest", "key"))

    def city_hits(self, a: DataFrame) -> DataFrame:
        """(id, code, score, hit_ord, rest) of (id, pref, rest): spelling, else reading, else former name; and always one edit."""
        stage = Stage(self.spark, "cities")
        entries = stage.keep(self._entries(), "entries")
        texts = stage.keep(a.where("rest <> ''").select("pref", F.col("rest").alias("text")).distinct(), "texts")
        fits = F.col("pref").isNull() | (F.col("pref") == F.col("c_pref"))
        exact = prefix_hits(texts, "text", entries.where("key <> ''")).where(fits)
        exact = exact.select("pref", "text", "code", F.lit(EXACT).alias("score"), (F.lit(1e12) - F.col("matched") * 1e10 + F.col("e_ord")).alias("hit_ord"), "rest")
        exact = stage.keep(exact, "exact")

        left = _null_safe_anti(texts, exact)
        kana = prefix_hits(left.withColumn("_kana", kana_key_of_nfkc(F.col("text"))), "_kana", entries.where("kana is not null and kana <> ''").drop("key").withColumnRenamed("kana", "_key"), "_key").where(fits)
        kana = kana.withColumn("rest", rest_after_kana(F.col("text"), F.col("_key"))).where("rest is not null")
        kana = kana.select("pref", "text", "code", F.lit(KANA).alias("score"), (F.lit(1e12) - F.col("matched") * 1e10 + F.col("e_ord")).alias("hit_ord"), "rest")
        hits = exact.unionByName(stage.keep(kana, "kana"))
        if self.t.aliases is not None:
            none = _null_safe_anti(texts, hits)
            old = prefix_hits(none, "text", self.t.aliases.withColumnRenamed("key", "_key"), "_key")
            top = Window.partitionBy("pref", "text")  # the few former names that one text begins with
            old = old.withColumn("_m", F.max("matched").over(top)).where("matched = _m").join(self.cities.select("code"), "code")
            hits = hits.unionByName(stage.keep(old.select("pref", "text", "code", F.lit(ALIAS).alias("score"), (F.lit(2e12) + F.col("ord")).alias("hit_ord"), "rest"), "old"))
        longest = entries.agg(F.max(F.length("key"))).first()[0] or 0
        heads = texts.select("pref", F.substring("text", 1, longest + 2).alias("head")).distinct()  # addresses of one municipality share their head
        keys = entries.where("key <> ''").select("key", "e_ord", "code", "c_pref")
        near = fuzzy_prefix(heads, "head", keys, "e_ord", limit=None).where(fits)
        rank = F.row_number().over(Window.partitionBy("pref", "head").orderBy(F.desc(F.length("key")), "e_ord"))
        near = stage.keep(near.withColumn("_rn", rank).where(F.col("_rn") <= CITY_TYPOS).select("pref", "head", "code", "_rn", (F.length("head") - F.length("rest")).alias("used")), "near")
        back = texts.withColumn("head", F.substring("text", 1, longest + 2))
        near = back.join(near, back["head"].eqNullSafe(near["head"]) & back["pref"].eqNullSafe(near["pref"])).select(back["pref"], "text", "code", F.lit(TYPO).alias("score"), (F.lit(3e12) + F.col("_rn")).alias("hit_ord"), F.substring(F.col("text"), F.col("used") + 1, F.length("text")).alias("rest"))
        both = hits.withColumn("_typo", F.lit(0)).unionByName(near.withColumn("_typo", F.lit(1)))
        w = Window.partitionBy("pref", "text", "code").orderBy("_typo", "hit_ord")  # hits of one municipality for one text
        both = both.withColumn("_first", F.min("_typo").over(w)).withColumn("_rn", F.row_number().over(w)).where("_typo = 0 or (_first = 1 and _rn = 1)")
        both = stage.keep(both.select("pref", "text", "code", "score", "hit_ord", F.col("rest").alias("tail")), "hits")
        ids = a.select("id", "pref", F.col("rest").alias("text"))
        out = ids.join(both, ids["text"].eqNullSafe(both["text"]) & ids["pref"].eqNullSafe(both["pref"]))
        return out.select("id", "code", "score", "hit_ord", F.col("tail").alias("rest"))

    # ---- towns

    def town_hits(self, texts: DataFrame) -> DataFrame:
        """(text, axis, hit_ord, key, rest) for distinct texts: spelling, else reading, else one edit.

        hit_ord ranks the hits of a text, the longest first; ``key`` is the spelling to look up.
        """
        stage = Stage(self.spark, "towns")
        keys = self.t.town_key.groupBy("key").agg(F.bool_and(F.coalesce(F.col("guard") == "nodigit", F.lit(False))).alias("guarded"))
        keys = stage.keep(keys, "keys")
        exact = prefix_hits(texts, "text", keys)
        if self.apply_guard:
            exact = exact.where(~(F.col("guarded") & F.col("rest").rlike("^[0-9]")))
        exact = exact.where(explains(F.col("key"), F.col("rest"))).select("text", F.lit("exact").alias("axis"), (-F.col("matched")).alias("hit_ord"), "key", F.lit(0).cast("long").alias("ref_ord"), "rest")
        out = stage.keep(exact, "exact")
        left = texts.join(out.select("text").distinct(), "text", "left_anti")
        if self.t.town_kana is not None:
            kk = self.t.town_kana.select("kana_key").distinct()
            kana = prefix_hits(left.withColumn("_kana", kana_key_of_nfkc(F.col("text"))), "_kana", kk, "kana_key")
            kana = kana.withColumn("rest", rest_after_kana(F.col("text"), F.col("kana_key"))).where(F.col("rest").isNotNull() & explains(F.col("kana_key"), F.col("rest")))
            kana = kana.join(self.t.town_kana.select("kana_key", "ref_key", F.col("ord").alias("ref_ord")), "kana_key")
            out = out.unionByName(stage.keep(kana.select("text", F.lit("kana").alias("axis"), (-F.col("matched")).alias("hit_ord"), F.col("ref_key").alias("key"), F.col("ref_ord").cast("long"), "rest"), "kana"))
            left = texts.join(out.select("text").distinct(), "text", "left_anti")
        ordered = keys.select("key", F.col("key").alias("_by"))
        typo = fuzzy_prefix(left, "text", ordered, "_by", TOWN_TYPOS).where(explains(F.col("key"), F.col("rest")))
        return out.unionByName(typo.select("text", F.lit("typo").alias("axis"), F.col("fuzzy_rank").alias("hit_ord"), "key", F.lit(0).cast("long").alias("ref_ord"), "rest"))

    def _resolve_towns(self, groups: DataFrame, stage: Stage) -> DataFrame:
        """Candidates of (id, text, g_ord, score, codes, pref, exact): codes null for any municipality."""
        texts = stage.keep(groups.select("text").distinct(), "texts")
        hits = stage.keep(self.town_hits(texts), "hits").withColumnRenamed("rest", "after")
        tk = self.t.town_key
        named = groups.where("codes is not null").select("*", F.explode("codes").alias("lg_code")).join(hits, "text").join(tk, ["key", "lg_code"])
        free = groups.where("codes is null").join(hits, "text").join(tk, "key").where(F.col("pref").isNull() | F.startswith("lg_code", F.col("pref")))
        e = named.select(*free.columns).unionByName(free)
        if self.apply_guard:
            e = e.where(unguarded(F.when(F.col("axis") == "exact", F.col("guard")), F.col("after")))
        one = Window.partitionBy("id", "text")  # hits of one rest of one address
        e = e.withColumn("_best", F.min("hit_ord").over(one)).where("hit_ord = _best")
        own = F.col("exact").isNotNull() & F.startswith(F.col("exact"), F.col("exact_key"))
        e = e.withColumns({"_own": F.coalesce(own, F.lit(False)), "_n": F.count(F.lit(1)).over(one)})
        e = e.withColumn("_any", F.max("_own").over(one)).where("_n = 1 or not _any or _own")
        c = self.cities.select(F.col("code").alias("lg_code"), F.col("name").alias("city"), "county", F.coalesce("towns", F.lit(0)).alias("towns"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
        e = join_small(e, c, "lg_code", "left")
        rank = F.row_number().over(one.orderBy(F.desc(F.coalesce("towns", F.lit(0))), "ref_ord", "ord"))
        e = e.withColumn("t_rank", rank).where(F.col("t_rank") <= max(self.limit, 5))
        axis = F.when(F.col("axis") == "exact", EXACT).when(F.col("axis") == "kana", KANA).otherwise(TYPO)
        return e.withColumn("score", F.round(axis * F.col("score"), 3))

    def _descend(self, e: DataFrame, stage: Stage) -> DataFrame:
        tail = parse_tail_of_nfkc(strip_separator(F.col("after")))
        e = e.withColumn("_tail", tail).withColumns({"_deep": F.col("t_rank") <= DESCEND, "residential": F.col("flags").bitwiseAND(1) != 0})
        e = e.withColumns({"building": F.col("_tail.building"), "_bg": assign_ban_go(F.col("_tail.tokens")), "_abc": assign_parcel(F.col("_tail.tokens"))})
        e = stage.keep(e.withColumn("_rid", F.monotonically_increasing_id()), "towns")
        none = lambda kind: F.lit(None).cast(kind)
        out = e
        if self.t.blocks is not None:
            want = e.where("_deep and residential and _bg.block is not null").select("_rid", F.col("lg_code").alias("lg"), "machiaza_id", F.col("_bg.block").cast("string").alias("blk"), F.col("_bg.number").alias("_no"))
            b = self.t.blocks.select("lg", "machiaza_id", F.col("blk").cast("string").alias("blk"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
            hit = want.join(b, ["lg", "machiaza_id", "blk"])
            if self.t.numbers is not None:
                hit = lookup_number(hit, self.t.numbers)
            else:
                hit = hit.withColumns({"n_key": none("string"), "n_lat": none("double"), "n_lng": none("double")})
            out = out.join(hit.select("_rid", F.col("blk").cast("long").alias("block"), "b_lat", "b_lng", "n_key", "n_lat", "n_lng"), "_rid", "left")
        else:
            out = out.withColumns({"block": none("long"), "b_lat": none("double"), "b_lng": none("double"), "n_key": none("string"), "n_lat": none("double"), "n_lng": none("double")})
        if self.t.parcels is not None:
            want = e.where("_deep and not residential and _abc is not null").select("_rid", F.col("lg_code").alias("lg"), "machiaza_id", F.col("_abc.a").alias("a"), F.col("_abc.b").alias("want_b"), F.col("_abc.c").alias("want_c"))
            hit = lookup_parcel(want, self.t.parcels)
            out = out.join(hit.select("_rid", "p_lat", "p_lng", "p_accuracy", "parcel_exact"), "_rid", "left")
        else:
            out = out.withColumns({"p_lat": none("double"), "p_lng": none("double"), "p_accuracy": none("string"), "parcel_exact": none("boolean")})
        return out

    # ---- candidates

    def geocode(self, addresses: DataFrame, ident: str = "id", address: str = "address") -> DataFrame:
        """(id, rank, candidate columns): up to ``limit`` candidates of every address, the deepest match first, then the best score.

        Null and empty addresses, and those that name nothing known, have no rows.  Each id should be given once.
        """
        stage = Stage(self.spark, "geocode")
        a = addresses.select(F.col(ident).alias("id"), F.col(address).cast("string").alias("_n")).where("_n is not null")
        a = a.select("id", to_key(F.col("_n")).alias("key"), to_exact_key(F.col("_n")).alias("exact_key")).where("key <> ''")
        a = stage.keep(self.strip_pref(a), "prefs")
        hits = stage.keep(self.city_hits(a), "hits")
        out = self._from_cities(a, hits)
        if self.t.town_key is not None:
            known = hits.where("rest <> ''").groupBy("id", "rest").agg(F.max("score").alias("score"), F.min("hit_ord").alias("g_ord"), F.collect_set("code").alias("codes"))
            free = a.join(hits.select("id").distinct(), "id", "left_anti").where("rest <> ''").select("id", "rest", F.lit(1.0).alias("score"), F.lit(0.0).alias("g_ord"), F.lit(None).cast("array<string>").alias("codes"))
            groups = known.unionByName(free).withColumnRenamed("rest", "text").join(a.select("id", "pref", "pref_name", "key", "exact_key"), "id")
            exact = F.when(F.length("key") == F.length("exact_key"), F.substring(F.col("exact_key"), F.length("exact_key") - F.length("text") + 1, F.length("text")))
            groups = stage.keep(groups.withColumn("exact", exact).drop("key", "exact_key"), "groups")
            towns = stage.keep(self._town_candidates(self._descend(self._resolve_towns(groups, stage), stage)), "candidates")
            out = towns.unionByName(out.join(towns.select("id").distinct(), "id", "left_anti"))
        depth = F.create_map(*(F.lit(x) for kv in DEPTH.items() for x in kv))[F.col("match_level")]
        town = depth >= 3
        w = Window.partitionBy("id").orderBy(F.when(town, -depth).otherwise(0), F.desc("score"), "_o1", "_o2")  # candidates of one address
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.limit).drop("_o1", "_o2")

    def _named_prefs(self) -> DataFrame:
        return self.prefs.select(F.col("code").alias("_p2"), F.col("name").alias("_p2name"))

    def _from_cities(self, a: DataFrame, hits: DataFrame) -> DataFrame:
        """Candidates at municipality level, and at prefecture level for addresses without a municipality."""
        w = Window.partitionBy("id", "code").orderBy("hit_ord")
        h = hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").join(a.select("id", "pref_name"), "id")
        c = self.cities.where("level <> 'pref'").select("code", F.col("name").alias("city"), "county", "lat", "lng", F.coalesce("towns", F.lit(0)).alias("towns"), F.col("pref").alias("_p2"))
        h = join_small(join_small(h, c, "code"), self._named_prefs(), "_p2", "left")
        pn = F.coalesce("pref_name", "_p2name")
        cols = self._columns(address=F.concat(F.coalesce(pn, F.lit("")), "city"), lat=F.coalesce("lat", F.lit(0.0)), lng=F.coalesce("lng", F.lit(0.0)), match_level=F.lit("city"), system=F.lit("residential"), accuracy=F.lit("representative"), score=F.col("score"),
                             building=building_of_plain_tail(F.col("rest")), lg_code=F.col("code"), pref=pn, city=F.col("city"), county=F.col("county"))
        cities = h.select("id", *cols, (-F.col("towns")).cast("double").alias("_o1"), F.col("hit_ord").alias("_o2"))
        lone = a.where("pref is not null").join(hits.select("id").distinct(), "id", "left_anti")
        p = self.cities.where("level = 'pref'").select(F.col("code").alias("pref"), "name", "lat", "lng")
        cols = self._columns(address=F.col("name"), lat=F.coalesce("lat", F.lit(0.0)), lng=F.coalesce("lng", F.lit(0.0)), match_level=F.lit("pref"), system=F.lit("residential"), accuracy=F.lit("representative"), score=F.lit(1.0), pref=F.col("name"))
        prefs = join_small(lone, p, "pref").select("id", *cols, F.lit(0.0).alias("_o1"), F.lit(0.0).alias("_o2"))
        return cities.unionByName(prefs)

    def _columns(self, **given) -> list:
        return [given.get(n, F.lit(None)).cast(k).alias(n) for n, k in (x.strip().split(" ", 1) for x in CANDIDATE.split(", "))]

    def _town_candidates(self, e: DataFrame) -> DataFrame:
        e = join_small(e.withColumn("_p2", F.substring("lg_code", 1, 2)), self._named_prefs(), "_p2", "left")
        pn = F.coalesce("pref_name", "_p2name")
        lot, num, blk = F.col("p_lat").isNotNull(), F.col("n_lat").isNotNull(), F.col("block").isNotNull()
        parcel = F.filter(F.array("_abc.a", "_abc.b", "_abc.c"), lambda x: x != 0)
        suffix = F.when(lot, F.concat(F.array_join(F.transform(parcel, lambda x: x.cast("string")), "-"), F.lit("番地"))).when(num, F.concat(F.col("block").cast("string"), F.lit("番"), F.col("n_key"), F.lit("号"))).when(blk, F.concat(F.col("block").cast("string"), F.lit("番"))).otherwise("")
        cols = self._columns(
            address=F.concat(F.coalesce(pn, F.lit("")), F.coalesce("city", F.lit("")), town_name(F.col("oaza"), F.col("chome"), F.col("koaza")), suffix),
            lat=F.coalesce("p_lat", "n_lat", "b_lat", "lat", "c_lat", F.lit(0.0)), lng=F.coalesce("p_lng", "n_lng", "b_lng", "lng", "c_lng", F.lit(0.0)),
            match_level=F.when(lot, "parcel").when(num, "rsdt").when(blk, "block").otherwise("oaza"), system=F.when(F.col("residential"), "residential").otherwise("parcel"),
            accuracy=F.when(lot, F.col("p_accuracy")).when(num, "surveyed").otherwise("representative"), score=F.col("score"), building=F.col("building"), lg_code=F.col("lg_code"), machiaza_id=F.col("machiaza_id"), pref=pn, city=F.col("city"), county=F.col("county"),
            oaza=F.col("oaza"), chome=F.when(F.col("chome") > 0, F.col("chome")), koaza=F.when(F.col("koaza") != "", F.col("koaza")), block=F.col("block"), rsdt=F.when(num, F.col("_bg.number")), parcel=F.when(lot, parcel), parcel_exact=F.col("parcel_exact"))
        return e.select("id", *cols, F.col("g_ord").cast("double").alias("_o1"), F.col("t_rank").cast("double").alias("_o2"))

    def nearest_by_address(self, addresses: DataFrame, limit: int = 10, group_by_station: bool = False, max_distance: float | None = None) -> DataFrame:
        """(id, address, rank, code, group_code, distance_m): stations around each address' first candidate; one row without a station for addresses that have none."""
        first = self.geocode(addresses).where("rank = 1").select("id", "address", "lat", "lng")
        near = nearest_stations(first, "id", self.t.stations, limit, group_by_station, max_distance)
        return addresses.select("id").join(first.select("id", "address"), "id", "left").join(near, "id", "left")


def _null_safe_anti(left: DataFrame, found: DataFrame) -> DataFrame:
    f = found.select(F.col("pref").alias("_fp"), F.col("text").alias("_ft")).distinct()
    return left.join(f, (F.col("text") == F.col("_ft")) & F.col("pref").eqNullSafe(F.col("_fp")), "left_anti")


def building_of_plain_tail(rest):
    """Municipality candidates keep what follows any numbers, without a leading separator being dropped first."""
    return parse_tail_of_nfkc(rest)["building"]


def lookup_number(hit: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds n_key, n_lat, n_lng to (lg, machiaza_id, blk, _no, b_lat, b_lng): the number itself, else its smallest branch."""
    n = numbers.select("lg", "machiaza_id", F.col("blk").cast("string").alias("blk"), "no_key", "dlat", "dlng").withColumn("_want", F.substring_index("no_key", "-", 1).try_cast("long"))
    best = n.groupBy("lg", "machiaza_id", "blk", "_want").agg(F.min_by(F.struct("no_key", "dlat", "dlng"), F.struct(F.col("no_key").contains("-"), F.col("no_key"))).alias("_n"))
    out = hit.join(best.withColumnRenamed("_want", "_no"), ["lg", "machiaza_id", "blk", "_no"], "left")
    return out.withColumns({"n_key": F.col("_n.no_key"), "n_lat": F.round(F.col("b_lat") + F.col("_n.dlat") / 1e6, 6), "n_lng": F.round(F.col("b_lng") + F.col("_n.dlng") / 1e6, 6)}).drop("_n")


def lookup_parcel(want: DataFrame, parcels: DataFrame) -> DataFrame:
    """Adds the lot (a, b, c) of (_rid, lg, machiaza_id, a, want_b, want_c), else the first with its a; in a town without lots those of its oaza.

    ``parcel_exact`` is false where the first one stands in.
    """
    p = parcels.select("lg", "machiaza_id", "ord", "a", "b", "c", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), "scale")
    have = p.select("lg", "machiaza_id").distinct().withColumn("_own", F.lit(True))
    w = want.join(have, ["lg", "machiaza_id"], "left")
    w = w.withColumn("machiaza_id", F.when(F.col("_own"), F.col("machiaza_id")).otherwise(F.concat(F.expr("left(machiaza_id, length(machiaza_id) - 3)"), F.lit("000")))).drop("_own")
    j = w.join(p, ["lg", "machiaza_id", "a"])
    same = (F.col("b") == F.col("want_b")) & (F.col("c") == F.col("want_c"))
    best = j.groupBy("_rid").agg(F.min_by(F.struct("p_lat", "p_lng", "scale", same.alias("same"), "b", "c"), F.struct(~same, F.col("b"), F.col("c"), F.col("ord"))).alias("_p"))
    return best.select("_rid", "_p.p_lat", "_p.p_lng", "_p.scale", accuracy_of_scale(F.col("_p.scale")).alias("p_accuracy"), F.col("_p.same").alias("parcel_exact"))
