"""Matching records of two sources that share no identifier, by loopy belief propagation.

Candidate pairs get a weight from several partial, noisy attributes.  Every left record is a variable whose values are
its candidates and "none"; factors say that a left record has one partner, that a right record has room for so many groups of left
records (for one, where nothing else is known: the one-to-one factor), and that left records of one group tend to have the same
partner.  Messages are exchanged through joins on the pairs until no marginal changes by more than ``TOLERANCE``; sums per
record are partial aggregates, so neither a hot right record nor a hot group is gathered in one task, and no pairs within a
group are formed.  Where a round brings the marginals less than a third closer, messages are damped more from then on.

Several stations may lie in one town, so a town has room for the station groups that name it exactly and ``FREE_PLACES``
more: readings with a wrong letter compete for the rest.  Rows of one station group, written differently, support each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.functions.geo import haversine_m, in_box
from azanami.functions.text import kana_key_of_nfkc, to_kana_key, to_key, word_ends
from azanami.llm.plain import plain_values
from azanami.operators.skew import attach_by_key
from azanami.operators.small import join_small
from azanami.runtime import Stage

TOLERANCE = 1e-3
#: Rounds after which messages that still change are given up; the result then tells by how much they do.
MAX_ROUNDS = 60
#: Strength with which one row of a group supports another.
COUPLING = 3.0
#: Places of a town beyond those of the station groups that name it exactly.
FREE_PLACES = 2
#: Room up to which the chance that all of it is taken is summed exactly; beyond, the share of those in excess is as near.
EXACT_ROOM = 64
#: Fewest letters of a name that may have a wrong one: a single letter that differs has nothing in common with the name.
SHORTEST = 2
#: The same of a municipality's writing.
SHORTEST_LOC = 3
#: Costs in log odds: a rare spelling, a municipality's writing that is not the longest that fits, one with a wrong letter, and a wrong letter in
#: both names (an address has one at most).
RARE, SHORTER, LOC_TYPO, TWO_TYPOS = 1.5, 1.0, 2.0, 4.0
_POSTCODE = r"(?U)^\s*(?:〒\s*[0-9０-９]{3}[-－‐−ー]?[0-9０-９]{4}|[0-9０-９]{3}[-－‐−][0-9０-９]{4}(?![0-9０-９]))"

def _full(room: Column, others: Column) -> Column:
    """Chance that ``room`` places are taken by a number of others with the given mean (Poisson, cut at the room), by its recursion."""
    exact = F.aggregate(F.sequence(F.lit(1), room), F.lit(1.0), lambda acc, k: others * acc / (k + others * acc))
    return F.when(room <= EXACT_ROOM, exact).otherwise(F.greatest(F.lit(0.0), 1 - room / others))


def marginals(pairs: DataFrame, one_to_one: bool = True, coupling: float = COUPLING, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(l, r, p, residual): the probability that l and r are the same, for every candidate pair.

    pairs: (l, g, r, w) and perhaps room; w is the log odds of the pair against "none", g the group of l or null.  Each pair once.  With
    one_to_one a right record has at most ``room`` groups as partners, one where the column is missing or null.  A left record's own
    candidates are compared in one window, so they must be few, as its blocking keys make them; right records and
    groups may be of any size.  ``residual`` is the last change of any marginal, above the tolerance only where max_rounds were not
    enough.  An empty table gives no rows.
    """
    stage = Stage(pairs.sparkSession, "beliefs")
    room = F.coalesce(F.col("room").cast("int"), F.lit(1)) if "room" in pairs.columns else F.lit(1)
    gr = F.when(F.col("g").isNotNull(), F.concat_ws("\u0001", "g", "r")).otherwise(F.concat_ws("\u0002", "l", "r"))
    state = pairs.select("l", "r", gr.alias("gr"), F.greatest(room, F.lit(1)).alias("room"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("up"), F.lit(0.0).alias("p"))
    state, path = stage.write(state, "pairs")
    total = state.count()
    own = Window.partitionBy("l")
    step, before, change = 1.0, None, 0.0
    for n in range(max_rounds):
        # left factors: odds of each pair against the left record's other values, in logs about the greatest
        cur = state.withColumn("_top", F.greatest(F.max(F.col("w") + F.col("up")).over(own), F.lit(0.0)))
        cur = cur.withColumn("_e", F.exp(F.col("w") + F.col("up") - F.col("_top")))
        cur = cur.withColumn("_o", F.greatest(F.sum("_e").over(own) - F.col("_e"), F.lit(0.0)) + F.exp(-F.col("_top")))
        cur = cur.withColumns({"_p": F.col("_e") / (F.col("_o") + F.col("_e")), "_f": F.exp(F.least(F.col("w") - F.log("_o") - F.col("_top"), F.lit(50.0)))})
        cur = cur.select("l", "r", "gr", "room", "w", "up", F.col("_p").alias("p"), F.abs(F.col("_p") - F.col("p")).alias("_d"), "_f")
        cur, now = stage.write(cur, "round")
        stage.drop(path)
        path = now
        change = cur.agg(F.max("_d")).first()[0] or 0.0
        if change <= tolerance or n == max_rounds - 1:
            break
        if before is not None and change > 0.67 * before:
            step = max(step * 0.7, 0.1)
        before = change
        # group factors: support from the group's other records; right factors: whether the other groups leave a place
        q = F.log1p(F.lit(float(coupling)) * F.col("p"))
        per = cur.groupBy("gr", "r").agg(F.count(F.lit(1)).alias("_n"), F.sum(q).alias("_t"), F.max("_f").alias("_gf"), F.first("room").alias("_room"))
        per = per.withColumn("_gq", F.col("_gf") / (1 + F.col("_gf")))
        up = F.least(F.col("_t") - q, F.lit(20.0)) if coupling > 0 else F.lit(0.0)
        if one_to_one:
            rights = per.groupBy("r").agg(F.count(F.lit(1)).alias("_m"), F.sum("_gf").alias("_sf"), F.sum("_gq").alias("_sq"))
            per = attach_by_key(per, rights, "r", "_m", total)
            alone = F.log1p(F.greatest(F.col("_sf") - F.col("_gf"), F.lit(0.0)))
            several = -F.log1p(-_full(F.col("_room"), F.greatest(F.col("_sq") - F.col("_gq"), F.lit(1e-9))))
            per = per.withColumn("_taken", F.when(F.col("_room") == 1, alone).otherwise(F.least(several, F.lit(50.0))))
            up = up - F.col("_taken")
        else:
            per = per.withColumn("_taken", F.lit(0.0))
        met = attach_by_key(cur, per.select("gr", "_n", "_t", "_taken"), "gr", "_n", total)
        state = met.select("l", "r", "gr", "room", "w", (F.col("up") * (1 - step) + up * step).alias("up"), "p")
    return cur.select("l", "r", "p", F.lit(float(change)).alias("residual"))


def register(towns: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(lg_code, oaza_no, axis, name, cost): the names under which a town may be written; axis 0 for spellings, 1 for readings.

    Codes are read without spaces and punctuation and in either order; a spelling is taken from oaza_cho, or from chome or koaza
    where the row's values have changed places.  A spelling with less than a fifth of the rows of the town's most frequent one
    costs ``RARE``.  ``entries`` (key, kana, code) adds readings.  Rows whose codes are neither six and seven digits are left
    out, as are null names.
    """
    digits = lambda c: F.regexp_replace(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "０１２３４５６７８９", "0123456789"), "[^0-9]", "")
    rows = towns.select(digits("lg_code").alias("_a"), digits("machiaza_id").alias("_b"), *(F.col(c).cast("string").alias(c) for c in ("oaza_cho", "oaza_cho_kana", "chome", "koaza")))
    swapped = (F.length("_a") == 7) & (F.length("_b") == 6)
    rows = rows.select(F.when(swapped, F.col("_b")).otherwise(F.col("_a")).alias("lg_code"), F.when(swapped, F.col("_a")).otherwise(F.col("_b")).alias("_id"), "oaza_cho", "oaza_cho_kana", "chome", "koaza")
    rows = rows.where((F.length("lg_code") == 6) & (F.length("_id") == 7)).withColumn("oaza_no", F.substring("_id", 1, 4)).drop("_id")
    rows = rows.groupBy("lg_code", "oaza_no", "oaza_cho", "oaza_cho_kana", "chome", "koaza").agg(F.count(F.lit(1)).alias("n"))
    rows = Stage(towns.sparkSession, "register").keep(rows, "rows")
    named = rows.select("lg_code", "oaza_no", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.col("oaza_cho").alias("value")), F.struct(F.lit(1).alias("place"), F.col("chome").alias("value")),
        F.struct(F.lit(2).alias("place"), F.col("koaza").alias("value")))).alias("x")).select("lg_code", "oaza_no", "n", "x.*").where("value is not null and value <> ''")
    forms = Stage(towns.sparkSession, "register").keep(plain_values(named), "forms").select("value", F.col("n").alias("_m"), "plain")
    named = attach_by_key(named, forms, "value", "_m").drop("_m")
    # brackets, underscores and the like don't belong to names
    key = F.regexp_replace(to_key("plain"), r"[\p{P}]+", "")
    named = named.withColumn("name", key).where("name <> ''").where(~F.col("name").rlike("^[0-9]+丁目$"))
    per = named.groupBy("lg_code", "oaza_no", "name").agg(F.sum(F.when(F.col("place") == 0, F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("n"))
    most = Window.partitionBy("lg_code", "oaza_no")  # a town's few spellings
    per = per.withColumn("best", F.max("own").over(most))
    per = per.where((F.col("own") >= 1) | (F.col("best") == 0))
    spelled = per.select("lg_code", "oaza_no", F.lit(0).alias("axis"), "name", F.when(F.col("own") >= F.col("best") * 0.2, 0.0).otherwise(RARE).alias("cost"))
    read = rows.select("lg_code", "oaza_no", "oaza_cho_kana").distinct().select("lg_code", "oaza_no", F.lit(1).alias("axis"), to_kana_key("oaza_cho_kana").alias("name"), F.lit(0.0).alias("cost"))
    out = spelled.unionByName(read)
    if entries is not None:
        e = entries.select(F.regexp_replace(F.col("code").cast("string"), "[^0-9]", "").alias("lg_code"), F.col("key").cast("string").alias("key"), F.col("kana").cast("string").alias("kana")).where("key is not null and kana is not null")
        e = e.distinct().select("lg_code", F.regexp_replace(to_key("key"), r"(?:[0-9]+(?:丁目)?)$", "").alias("name"), to_kana_key("kana").alias("reading")).distinct()
        out = out.unionByName(spelled.join(e, ["lg_code", "name"]).select("lg_code", "oaza_no", F.lit(1).alias("axis"), F.col("reading").alias("name"), "cost"))
    return out.where("name is not null and name <> ''").groupBy("lg_code", "oaza_no", "axis", "name").agg(F.min("cost").alias("cost"))

def localities(cities: DataFrame) -> DataFrame:
    """(loc, lg_code, lat, lng): each way to write a municipality in an address: with or without prefecture and county."""
    c = cities.select(*(F.col(x).cast("string").alias(x) for x in ("code", "pref", "name", "level", "county")), F.col("lat").cast("double").alias("c_lat"), F.col("lng").cast("double").alias("c_lng"))
    prefs = c.where("level = 'pref'").select("pref", F.col("name").alias("pref_name"))
    named = c.where("level <> 'pref'").join(prefs, "pref", "left")
    e = F.lit("")
    p, k = F.coalesce("pref_name", e), F.coalesce("county", e)
    forms = F.array_distinct(F.array(F.concat(p, k, "name"), F.concat(p, "name"), F.concat(k, "name"), F.col("name")))
    out = named.select(F.col("code").alias("lg_code"), "c_lat", "c_lng", F.explode(forms).alias("form"))
    return out.select(to_key("form").alias("loc"), "lg_code", "c_lat", "c_lng").where("loc <> ''").dropDuplicates(["loc", "lg_code"])

def _prefixes(text: Column, longest: int) -> Column:
    """All prefixes of up to ``longest`` letters, the longest key there is."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(text), F.lit(longest))), lambda i: F.substring(text, F.lit(1), i))

def _signs(text: Column) -> Column:
    """Signs of a text: two of one length that differ in one letter share at least one.  Short ones by their letters but one, others by either half."""
    n = F.length(text)
    masks = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(i, F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    half = F.floor(n / 2).cast("int")
    halves = F.array(F.xxhash64(F.lit(-1), n, F.substring(text, F.lit(1), half)), F.xxhash64(F.lit(-2), n, F.substring(text, half + 1, n)))
    return F.when(n < 6, masks).otherwise(halves)


def one_letter_off(heads: DataFrame, head: str, names: DataFrame, name: str, on: list[str]) -> DataFrame:
    """Rows of heads with the names that differ from head in exactly one letter at the same length, equal in ``on``; repeated rows may repeat.

    The join is on the signs, eight bytes each; the letters are compared after it.
    """
    a = heads.withColumn("_sign", F.explode(_signs(F.col(head))))
    b = names.select(*on, *(c for c in names.columns if c not in on), F.explode(_signs(F.col(name))).alias("_sign"))
    near = join_small(a, b, [*on, "_sign"])
    return near.where((F.length(head) == F.length(name)) & (F.levenshtein(head, name, 1) == 1)).drop("_sign")


def _located(addresses: DataFrame, locs: DataFrame) -> DataFrame:
    """(l, rest, ends, lg_code, loc_cost): all municipalities that an address may begin with, written right or with a wrong letter."""
    longest = locs.agg(F.max(F.length("loc"))).first()[0] or 1
    heads = addresses.select("l", "key", "ends", F.explode(_prefixes(F.col("key"), longest)).alias("head"))
    exact = join_small(heads, locs.select(F.col("loc").alias("head"), "lg_code"), "head")
    longest_of = Window.partitionBy("l")  # a handful of prefixes of one address
    exact = exact.withColumn("loc_cost", F.when(F.length("head") == F.max(F.length("head")).over(longest_of), 0.0).otherwise(SHORTER))
    near = one_letter_off(heads.where(F.length("head") >= SHORTEST_LOC), "head", locs.select("loc", "lg_code").where(F.length("loc") >= SHORTEST_LOC), "loc", [])
    both = exact.select("l", "key", "ends", "head", "lg_code", "loc_cost").unionByName(near.select("l", "key", "ends", "head", "lg_code", F.lit(LOC_TYPO).alias("loc_cost")))
    rest = both.select("l", F.expr("substring(key, length(head) + 1)").alias("rest"), F.expr("transform(ends, e -> e - length(head))").alias("ends"), "lg_code", "loc_cost").where("rest <> ''")
    return rest.groupBy("l", "rest", "ends", "lg_code").agg(F.min("loc_cost").alias("loc_cost"))


def candidates(stations: DataFrame, names: DataFrame, locs: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(l, g, r, room, w): the towns that each station's address may name, with the log odds of each and the places that a town has.

    stations: (code, group_code, address, pref, lat, lng).  names as of ``register``, locs as of ``localities``, positions (lg_code,
    oaza_no, t_lat, t_lng) of towns.  The town follows the municipality, perhaps after 大字 or 字.  All municipalities and all
    prefixes are kept, names with a wrong letter also beside those that fit: the weights and the factors decide.
    """
    stage = Stage(stations.sparkSession, "candidates")
    names, locs = stage.keep(names, "names"), stage.keep(locs, "locs")
    plain = F.regexp_replace(F.col("address").cast("string"), _POSTCODE, "")
    base = stations.select(F.col("code").cast("long").alias("l"), F.col("group_code").cast("string").alias("g"), to_key(plain).alias("key"), word_ends(plain).alias("ends"),
                           F.col("pref").cast("int").alias("pref"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).where("l is not null").dropDuplicates(["l"])
    base = stage.keep(base, "stations")
    spots = _located(base.where("key is not null and key <> ''").select("l", "key", "ends"), locs)
    spots = spots.withColumn("_all", F.length("rest")).withColumn("rest", F.regexp_replace("rest", "^(大字|字)", ""))
    spots = spots.withColumn("ends", F.filter(F.transform("ends", lambda e: e - F.col("_all") + F.length("rest")), lambda e: e > 0)).drop("_all")
    spots = stage.keep(spots.withColumn("kana", kana_key_of_nfkc(F.col("rest"))), "spots")
    longest = names.agg(F.max(F.length("name"))).first()[0] or 1
    read_ends = F.transform("ends", lambda e: F.length(kana_key_of_nfkc(F.substring(F.col("rest"), F.lit(1), e))))
    # readings are kana: of a text in ideographs no more than one wrong letter can be part of one
    spoken = F.length(F.regexp_extract("kana", "^[^\\p{IsHan}]*\\p{IsHan}?[^\\p{IsHan}]*", 0))
    texts = spots.select("l", "lg_code", "loc_cost", F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("rest").alias("t"), F.col("ends").alias("ends"), F.length("rest").alias("reach")), F.struct(F.lit(1).alias("axis"), F.col("kana").alias("t"), read_ends.alias("ends"), spoken.alias("reach")))).alias("x")).select("l", "lg_code", "loc_cost", "x.*").where("t <> ''")
    heads = texts.select("l", "lg_code", "loc_cost", "axis", "t", "ends", "reach", F.explode(_prefixes(F.col("t"), longest)).alias("head"))
    heads = heads.withColumn("clean", F.expr("length(head) = length(t) or substring(t, length(head) + 1, 1) rlike '[0-9(\\\\-]' or array_contains(ends, length(head))")).drop("ends", "t")
    cols = ["l", "lg_code", "oaza_no", "loc_cost", "axis", "clean", "cost", "len", "typo"]
    exact = heads.join(names.withColumnRenamed("name", "head"), ["lg_code", "axis", "head"]).withColumns({"len": F.length("head"), "typo": F.lit(False)}).select(*cols)
    open_ = heads.where(F.length("head").between(F.lit(SHORTEST), F.col("reach"))).drop("reach")
    near = one_letter_off(open_, "head", names.where(F.length("name") >= SHORTEST), "name", ["lg_code", "axis"])
    near = near.withColumns({"len": F.length("head"), "typo": F.lit(True)}).select(*cols)
    both = exact.unionByName(near)
    w = (F.when(F.col("typo"), 2.0).otherwise(4.0) - F.col("axis") * 0.5 - F.col("loc_cost") - F.col("cost") + F.when(F.col("clean"), 0.0).otherwise(-2.5) + F.col("len") * F.when(F.col("axis") == 1, 0.25).otherwise(0.5)
         - F.when(F.col("typo") & (F.col("len") <= 3), 2.0).otherwise(0.0) - F.when(F.col("typo") & (F.col("loc_cost") == LOC_TYPO), TWO_TYPOS).otherwise(0.0))
    best = both.groupBy("l", "lg_code", "oaza_no").agg(F.max(w).alias("w"), F.bool_or(~F.col("typo") & F.col("clean") & (F.col("loc_cost") == 0)).alias("exact"))
    cities = locs.select("lg_code", "c_lat", "c_lng").dropDuplicates(["lg_code"])
    out = join_small(best.join(base.select("l", "g", "pref", "lat", "lng"), "l"), cities, "lg_code", "left")
    if positions is not None:
        out = out.join(positions, ["lg_code", "oaza_no"], "left")
    else:
        out = out.withColumns({"t_lat": F.lit(None).cast("double"), "t_lng": F.lit(None).cast("double")})
    turned = in_box(F.col("lng"), F.col("lat")) & ~in_box(F.col("lat"), F.col("lng"))
    lat, lng = F.when(turned, F.col("lng")).otherwise(F.col("lat")), F.when(turned, F.col("lat")).otherwise(F.col("lng"))
    far = F.when(in_box(lat, lng), haversine_m(lat, lng, F.coalesce("t_lat", "c_lat"), F.coalesce("t_lng", "c_lng")))
    place = F.when(far.isNull(), 0.0).when(far < 8_000, 1.5).when(far < 40_000, 0.3).otherwise(-0.7)
    pref = F.when(F.col("pref").isNull(), 0.0).when(F.substring("lg_code", 1, 2).try_cast("int") == F.col("pref"), 1.0).otherwise(-1.0)
    out = stage.keep(out.select("l", "g", F.concat("lg_code", "oaza_no").alias("r"), (F.col("w") - 1.0 + place + pref).alias("w"), "exact"), "pairs")
    group = F.coalesce(F.concat(F.lit("g"), "g"), F.concat(F.lit("l"), F.col("l").cast("string")))
    named = out.where("exact").select("r", group.alias("_g")).distinct().groupBy("r").agg(F.count(F.lit(1)).alias("_named"))
    count = out.groupBy("r").agg(F.count(F.lit(1)).alias("_n")).join(named, "r", "left").select("r", "_n", (F.coalesce("_named", F.lit(0)) + FREE_PLACES).alias("room"))
    return attach_by_key(out, count, "r", "_n").select("l", "g", "r", "room", "w")


def town_positions(pos: DataFrame) -> DataFrame:
    """(lg_code, oaza_no, t_lat, t_lng): mean position of a town's parts; blank and malformed ones left out."""
    p = pos.select(F.regexp_replace(F.col("lg_code").cast("string"), "[^0-9]", "").alias("lg_code"), F.regexp_replace(F.col("machiaza_id").cast("string"), "[^0-9]", "").alias("_id"), F.col("rep_lat").try_cast("double").alias("lat"), F.col("rep_lon").try_cast("double").alias("lng"))
    p = p.where(in_box(F.col("lat"), F.col("lng")) & (F.length("_id") == 7))
    return p.groupBy("lg_code", F.substring("_id", 1, 4).alias("oaza_no")).agg(F.avg("lat").alias("t_lat"), F.avg("lng").alias("t_lng"))

def station_towns(stations: DataFrame, towns: DataFrame, cities: DataFrame, entries: DataFrame | None = None, pos: DataFrame | None = None, min_p: float = 0.5) -> DataFrame:
    """(station_code, lg_code, oaza_no, confidence, residual): the town each station lies in, where its probability reaches min_p.

    Stations with a null, blank or unknown address, and rows without a code, have no row; a code given twice counts once.  Of equally
    probable towns none is chosen unless one exceeds min_p; exact ties go to the smaller code.  ``residual``: the last change of any
    probability when the messages ended.
    """
    pairs = candidates(stations, register(towns, entries), localities(cities), None if pos is None else town_positions(pos))
    p = marginals(pairs)
    best = p.groupBy("l").agg(F.max(F.struct("p", F.col("r"))).alias("b"), F.max("residual").alias("residual")).where(F.col("b.p") >= min_p)
    return best.select(F.col("l").alias("station_code"), F.substring("b.r", 1, 6).alias("lg_code"), F.substring("b.r", 7, 4).alias("oaza_no"), F.col("b.p").alias("confidence"), "residual")
