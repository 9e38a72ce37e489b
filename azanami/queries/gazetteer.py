"""The gazetteer's operators over the generated tables, each with the same query in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from azanami.functions import geo, parse, text
from azanami.functions.names import expand_aliases
from azanami.operators import order, prefix, stats
from azanami.operators.knn import nearest_stations
from azanami.operators.skew import aggregate_by_key, plain_code
from azanami.operators.small import join_small
from azanami.plans import build, directory, quality
from azanami.plans.engine import GeoEngine, Tables, lookup_number, lookup_parcel
from azanami.runtime import Stage, table

Q: dict = {}
# A postal code before an address.
POSTCODE = r"(?U)^\s*(?:〒\s*[0-9０-９]{3}[-－‐−ー]?[0-9０-９]{4}|[0-9０-９]{3}[-－‐−][0-9０-９]{4}(?![0-9０-９]))"


def query(sql: str | None = None):
    def register(fn):
        Q[fn.__name__] = (fn, sql)
        return fn

    return register


def _q(s: str) -> str:
    return s.replace("'", "''")


# ---------------------------------------------------------------- text

_VAR = f"translate({{c}}, '{_q(text.VARIANT_FROM)}', '{_q(text.VARIANT_TO)}')"
_NOISE = r"regexp_replace({c}, '[\s\x{0b}\x{85}\p{Z}\x{FEFF},、，．.·・･]', '', 'g')"
_HIRA = f"translate({{c}}, '{text._KATAKANA}', '{text._HIRAGANA}')"
_KANA = f"translate(regexp_replace({_HIRA}, '[\\s\\x{{{{0b}}}}\\x{{{{85}}}}\\p{{{{Z}}}}\\x{{{{FEFF}}}}]', '', 'g'), '{text._FOLD_FROM}ー―‐−–—・･ヶヵゕゖ', '{text._FOLD_TO}')"


@query(f"SELECT row_id, {_NOISE.replace('{c}', 'oaza_cho')} AS stripped, {_VAR.format(c='oaza_cho')} AS unified FROM mt_town_all")
def key_strip_unify(spark, d):
    c = F.col("oaza_cho")
    return table(spark, d, "mt_town_all").select("row_id", text.strip_noise(c).alias("stripped"), text.unify_variants(c).alias("unified"))


_CHARS = "string_split(x, '')"
_HANDIGIT = r"regexp_full_match({c}, '[\p{Han}0-9]')"


@query(r"""SELECT code, x AS address, CASE WHEN length(x) <= 2 THEN x ELSE array_to_string(list_transform(range(1, length(x) + 1), lambda i:
  CASE WHEN i = 1 OR i = length(x) THEN x[i:i] WHEN x[i:i] IN ('ヶ','ヵ','ゕ','ゖ') THEN 'ケ'
  WHEN x[i:i] IN ('ケ','カ','が','ガ') AND regexp_full_match(x[i-1:i-1], '[\p{Han}0-9]') AND regexp_full_match(x[i+1:i+1], '[\p{Han}0-9]') THEN 'ケ'
  WHEN x[i:i] IN ('の','ノ','之') AND regexp_full_match(x[i-1:i-1], '[\p{Han}0-9]') AND regexp_full_match(x[i+1:i+1], '[\p{Han}0-9]') THEN 'ノ' ELSE x[i:i] END), '') END AS unified
  FROM (SELECT code, address AS x FROM station WHERE address IS NOT NULL)""")
def interstitial_unify(spark, d):
    return table(spark, d, "station").where("address is not null").select("code", "address", text.unify_interstitial(F.col("address")).alias("unified"))


@query(f"SELECT entry_id, {_KANA.replace('{{', '{').replace('}}', '}').replace('{c}', 'kana')} AS kana_key, translate({_KANA.replace('{{', '{').replace('}}', '}').replace('{c}', 'kana')}, '{text._LOOSE_FROM}', '{text._LOOSE_TO}') AS loose_key FROM dict_entry WHERE kana IS NOT NULL")
def kana_keys(spark, d):
    k = text.kana_key_of_nfkc(F.col("kana"))
    return table(spark, d, "dict_entry").where("kana is not null").select("entry_id", k.alias("kana_key"), text.loosen(k).alias("loose_key"))


@query("""SELECT num_id, no_num, CASE WHEN no_num = 0 THEN '〇' WHEN no_num < 0 OR no_num >= 1000 THEN no_num::VARCHAR ELSE
  (CASE no_num // 100 WHEN 0 THEN '' WHEN 1 THEN '百' ELSE '〇一二三四五六七八九'[no_num // 100 + 1] || '百' END) ||
  (CASE no_num // 10 % 10 WHEN 0 THEN '' WHEN 1 THEN '十' ELSE '〇一二三四五六七八九'[no_num // 10 % 10 + 1] || '十' END) ||
  (CASE no_num % 10 WHEN 0 THEN '' ELSE '〇一二三四五六七八九'[no_num % 10 + 1] END) END AS kanji, no_num::BIGINT AS back FROM rsdt_number WHERE no_num >= 0 AND no_num < 1000""")
def number_to_kanji_and_back(spark, d):
    t = table(spark, d, "rsdt_number").where("no_num >= 0 and no_num < 1000")
    return t.select("num_id", "no_num", text.number_to_kanji(F.col("no_num")).alias("kanji")).withColumn("back", text.kanji_to_number(F.col("kanji")))


@query("""SELECT row_id, CASE WHEN regexp_full_match(chome, '[一二三四五六七八九]丁目') THEN strpos('一二三四五六七八九', chome[1])
  WHEN regexp_full_match(chome, '十[一二三四五六七八九]?丁目') THEN 10 + strpos('一二三四五六七八九', chome[2])
  WHEN regexp_full_match(chome, '[0-9]+丁目') THEN replace(chome, '丁目', '')::INT ELSE 0 END::INT AS no FROM mt_town_all""")
def chome_numbers(spark, d):
    return table(spark, d, "mt_town_all").select("row_id", text.chome_number(F.col("chome")).alias("no"))


_TAIL = "(SELECT code, regexp_extract(address, '[0-9].*$') AS s FROM station WHERE address IS NOT NULL)"
_ZAP = r"regexp_replace(s, '[\s\x{0b}\x{85}\p{Z}]', '', 'g')"
_RUN = "^[0-9]+(?:(?:丁目|丁|番地の|番地|番|号|条|地割|の|ノ|之|[-ー―‐−–—])[0-9]*)*"
_PARSED = f"""WITH p AS (SELECT code, t, regexp_extract(t, '{_RUN}') AS run FROM (SELECT code, {_ZAP} AS t FROM {_TAIL} WHERE NOT regexp_matches(s, '[〇零一壱二弐三参四五六七八九十百千０-９]'))),
q AS (SELECT code, regexp_extract_all(run, '([0-9]+)(丁目|丁|番地|番|号|条|地割)?', 1) AS n, regexp_extract_all(run, '([0-9]+)(丁目|丁|番地|番|号|条|地割)?', 2) AS u, substr(t, length(run) + 1) AS after FROM p),
r AS (SELECT code, n[1:3] AS n, list_transform(u[1:3], lambda x: CASE x WHEN '丁目' THEN 'chome' WHEN '丁' THEN 'chome' WHEN '番地' THEN 'ban' WHEN '番' THEN 'ban' WHEN '号' THEN 'go' WHEN '条' THEN 'jo' WHEN '地割' THEN 'chiwari' ELSE '' END) AS u,
  trim(regexp_replace(array_to_string(n[4:], '-') || after, '^[-ー―‐−–—の]', '')) AS b FROM q) """


def _tails(spark, d):
    t = table(spark, d, "station").where("address is not null").select("code", F.regexp_extract("address", "[0-9].*$", 0).alias("s"))
    t = t.where(~F.col("s").rlike("[〇零一壱二弐三参四五六七八九十百千０-９]"))
    return t.select("code", "s", parse.parse_tail_of_nfkc(F.col("s")).alias("t"))


def _numbers_of(t):
    return t.select("code", F.array_join(F.transform("t.tokens", lambda x: x["value"].cast("string")), ",").alias("numbers"), F.array_join(F.transform("t.tokens", lambda x: F.coalesce(x["unit"], F.lit(""))), ",").alias("units"), F.col("t.building").alias("building"))


def _assigned(t):
    t = t.select("code", parse.assign_ban_go(F.col("t.tokens")).alias("x"), parse.assign_parcel(F.col("t.tokens")).alias("y"))
    return t.select("code", "x.block", "x.number", "y.a", "y.b", "y.c")


@query(_PARSED + "SELECT code, array_to_string(n, ',') AS numbers, array_to_string(u, ',') AS units, CASE WHEN b <> '' THEN b END AS building FROM r")
def tail_parse(spark, d):
    return _numbers_of(_tails(spark, d))


@query(_PARSED + """, i AS (SELECT code, list_filter(list_zip(n, u), lambda x: x[2] = '') AS p, list_filter(list_zip(n, u), lambda x: x[2] = 'ban') AS b, list_filter(list_zip(n, u), lambda x: x[2] = 'go') AS g, list_filter(list_zip(n, u), lambda x: x[2] <> 'chome') AS a FROM r)
  SELECT code, CASE WHEN len(b) + len(g) > 0 THEN b[1][1]::BIGINT ELSE p[1][1]::BIGINT END AS block, CASE WHEN len(b) + len(g) > 0 THEN g[1][1]::BIGINT ELSE p[2][1]::BIGINT END AS number,
  CASE WHEN len(a) > 0 THEN a[1][1]::BIGINT END AS a, CASE WHEN len(a) > 0 THEN coalesce(a[2][1]::BIGINT, 0) END AS b, CASE WHEN len(a) > 0 THEN coalesce(a[3][1]::BIGINT, 0) END AS c FROM i""")
def assign_numbers(spark, d):
    return _assigned(_tails(spark, d))


@query(f"""SELECT code, regexp_replace(regexp_replace(regexp_replace(s, '丁目|丁|番地の|番地|番|号|の|ノ|之', '-', 'g'), '[-ー―‐−–—]+', '-', 'g'), '^-|-$', '', 'g') AS banchi FROM {_TAIL} WHERE NOT regexp_matches(s, '[〇零一壱二弐三参四五六七八九十百千０-９]')""")
def banchi_normalize(spark, d):
    return _tails(spark, d).select("code", text.normalize_banchi_of_nfkc(F.col("s")).alias("banchi"))


_FIRST_NUMBER = f"(?s)(?:[0-9]|[{text._NUMERALS}]+(?:丁目|番地|番|号|地割)).*$"


def after_town(addresses, towns, cities):
    """addresses (code, address) with ``s``: what follows the town, or the first number where the address begins with no town's plain writing."""
    c = cities.where("level <> 'pref'").join(cities.where("level = 'pref'").select("pref", F.col("name").alias("pn")), "pref", "left")
    e = F.lit("")
    forms = F.array_distinct(F.array(*(F.concat(p, k, "name") for p in (F.coalesce("pn", e), e) for k in (F.coalesce("county", e), e))))
    locs = c.select(F.col("code").alias("lg_code"), F.explode(forms).alias("loc"))
    names = towns.where("oaza_cho <> ''").select("lg_code", "oaza_cho").distinct()
    keys = names.join(locs, "lg_code").select(F.explode(F.array(*(F.concat("loc", F.lit(x), "oaza_cho") for x in ("", "大字", "字")))).alias("key"))
    keys = Stage(towns.sparkSession, "tails").keep(keys.select(text.to_key("key").alias("key")).distinct(), "keys")
    plain = F.regexp_replace("address", POSTCODE, "")
    a = addresses.select("code", "address", text.to_key(plain).alias("_t"), text.to_exact_key(plain).alias("_x"), text.strip_noise(text.nfkc(plain)).alias("_n"))
    hits = prefix.prefix_hits(a.select("code", "_t"), "_t", keys).groupBy("code").agg(F.max("matched").alias("_m"))
    a = a.join(hits, "code", "left")
    return a.select("code", "address", F.when(F.col("_m").isNotNull(), F.substring(F.col("_x"), F.col("_m") + 1, F.length("_x"))).otherwise(F.regexp_extract("_n", _FIRST_NUMBER, 0)).alias("s"))


def _whole_tails(spark, d):
    a = table(spark, d, "station").where("address is not null").select("code", "address")
    return after_town(a, table(spark, d, "mt_town_all"), table(spark, d, "city"))


@query()
def tail_parse_whole(spark, d):
    """As tail_parse over every address after its town, numerals of all kinds; no SQL, since SQL has no NFKC numerals."""
    return _numbers_of(_whole_tails(spark, d).select("code", parse.parse_tail(F.col("s")).alias("t")))


@query()
def assign_numbers_whole(spark, d):
    return _assigned(_whole_tails(spark, d).select("code", parse.parse_tail(F.col("s")).alias("t")))


@query()
def banchi_normalize_whole(spark, d):
    return _whole_tails(spark, d).select("code", text.normalize_banchi(F.col("s")).alias("banchi"))


@query("""SELECT row_id, array_to_string(list_filter([oaza_cho || chome || koaza, CASE WHEN koaza = '' AND regexp_full_match(chome, '[0-9０-９〇零一壱二弐三参四五六七八九十百千]+丁目') THEN oaza_cho || regexp_extract(chome, '^(.+)丁目$', 1) || '*' END], lambda x: x IS NOT NULL AND x <> ''), '|') AS names FROM mt_town_all """)
def alias_expand(spark, d):
    t = table(spark, d, "mt_town_all")
    a = expand_aliases(F.col("oaza_cho"), F.col("chome"), F.col("koaza"))
    return t.select("row_id", F.array_join(F.transform(a, lambda x: F.concat(x["name"], F.when(x["guard"].isNotNull(), "*").otherwise(""))), "|").alias("names"))


@query("SELECT code, regexp_extract_all(address, '[0-9]+').array_to_string(',') AS runs FROM station WHERE address IS NOT NULL")
def digit_runs(spark, d):
    return table(spark, d, "station").where("address is not null").select("code", text.digit_runs(F.col("address")).alias("runs"))


@query("SELECT code, regexp_replace(name, '[市町村区]$', '') AS base FROM city")
def base_names(spark, d):
    return table(spark, d, "city").select("code", text.base_name(F.col("name")).alias("base"))


# ---------------------------------------------------------------- prefix, fuzzy and range joins

def _cities(spark, d):
    return table(spark, d, "city").where("level <> 'pref'").select(F.col("name").alias("key"), F.col("code").alias("lg_code"))


_LOC = """WITH pr AS (SELECT code AS p, name AS pn FROM city WHERE level = 'pref'),
a AS (SELECT DISTINCT address FROM station WHERE address IS NOT NULL),
s AS (SELECT address, CASE WHEN pn IS NULL THEN address ELSE substr(address, length(pn) + 1) END AS rest, p AS pref FROM (
  SELECT a.address, arg_max(pr.p, length(pn)) AS p, arg_max(pn, length(pn)) AS pn FROM a LEFT JOIN pr ON starts_with(a.address, pn) GROUP BY a.address)),
m AS (SELECT s.address, s.pref, c.code AS lg_code, c.name AS key, length(c.name) AS matched, substr(s.rest, length(c.name) + 1) AS rest FROM s JOIN city c ON c.level <> 'pref' AND starts_with(s.rest, c.name)) """


def _stripped(spark, d):
    prefs = table(spark, d, "city").where("level = 'pref'")
    a = table(spark, d, "station").where("address is not null").select("address").distinct()
    return directory.strip_prefectures(a, "address", prefs).withColumn("rest", F.coalesce("rest", "address"))


@query(_LOC + "SELECT address, pref, lg_code, key, matched, rest FROM m")
def all_prefix(spark, d):
    t = _stripped(spark, d).withColumnRenamed("rest", "_t")
    return prefix.prefix_hits(t, "_t", _cities(spark, d)).select("address", "pref", "lg_code", "key", "matched", "rest")


@query(_LOC + "SELECT address, arg_max(lg_code, matched * 1000000 - lg_code::INT / 1000000.0) AS lg_code, max(matched) AS matched FROM m GROUP BY address")
def longest_prefix(spark, d):
    t = _stripped(spark, d).withColumnRenamed("rest", "_t")
    return prefix.longest_prefix(t, ["address"], "_t", _cities(spark, d), [F.asc("lg_code")]).select("address", "lg_code", "matched")


@query(f"""WITH t AS (SELECT row_id, oaza_cho || chome AS key, {_KANA.replace('{{', '{').replace('}}', '}').replace('{c}', 'oaza_cho_kana')} AS kana FROM mt_town_all),
  tt AS (SELECT DISTINCT key, kana, translate(kana, '{text._LOOSE_FROM}', '{text._LOOSE_TO}') AS loose FROM t),
  e AS (SELECT entry_id, key, guard, {_KANA.replace('{{', '{').replace('}}', '}').replace('{c}', 'kana')} AS kana FROM dict_entry), ee AS (SELECT *, translate(kana, '{text._LOOSE_FROM}', '{text._LOOSE_TO}') AS loose FROM e),
  x AS (SELECT tt.key AS tkey, tt.kana AS tkana, entry_id, CASE WHEN ee.key <> '' AND starts_with(tt.key, ee.key) AND NOT (coalesce(ee.guard = 'nodigit', false) AND regexp_matches(substr(tt.key, length(ee.key) + 1), '^[0-9]')) THEN 'key'
    WHEN ee.kana <> '' AND tt.kana <> '' AND starts_with(tt.kana, ee.kana) THEN 'kana' WHEN ee.loose <> '' AND tt.loose <> '' AND starts_with(tt.loose, ee.loose) THEN 'loose' END AS axis, length(ee.key) AS lk, length(ee.kana) AS lr FROM tt, ee),
  m AS (SELECT *, CASE axis WHEN 'key' THEN lk ELSE lr END AS matched, CASE axis WHEN 'key' THEN 3 WHEN 'kana' THEN 2 ELSE 1 END AS s FROM x WHERE axis IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY tkey, tkana ORDER BY matched DESC, s DESC, entry_id) AS rn FROM m)
  SELECT t.row_id, r.entry_id, r.axis, r.matched FROM t JOIN r ON r.tkey = t.key AND r.tkana IS NOT DISTINCT FROM t.kana AND rn = 1""")
def longest_on_axes(spark, d):
    t = table(spark, d, "mt_town_all").select("row_id", F.concat("oaza_cho", "chome").alias("key"), text.kana_key_of_nfkc(F.col("oaza_cho_kana")).alias("kana"))
    e = table(spark, d, "dict_entry").select("entry_id", "key", text.kana_key_of_nfkc(F.col("kana")).alias("kana"), "guard")
    return prefix.longest_on_axes(t, "row_id", e, "entry_id").select("row_id", "entry_id", "axis", "matched")


@query()
def fuzzy_towns(spark, d):
    """Town names one edit away from the begin of a dictionary entry, the first letter included; no SQL, whose edit distance counts bytes."""
    t = table(spark, d, "dict_entry").where("key is not null and code is not null").select(F.concat("key", F.lit("・"), "code").alias("x")).distinct()
    k = table(spark, d, "mt_town_all").select(F.col("oaza_cho").alias("key")).distinct().withColumn("by", F.col("key"))
    return prefix.fuzzy_prefix(t, "x", k, "by", limit=None).select("x", "key", "rest")


@query("""WITH t AS (SELECT DISTINCT replace(p_name, 'i', 'e') || ' of ' || p_brand AS x FROM part), k AS (SELECT DISTINCT p_name AS k FROM part WHERE length(p_name) > 3),
  w AS (SELECT x, k, u FROM t, k, (SELECT unnest([-1, 0, 1]) AS dd) z, LATERAL (SELECT length(k) + dd AS u) WHERE NOT starts_with(x, k) AND u <= length(x) AND levenshtein(x[1:u], k) = 1 AND array_to_string(regexp_extract_all(x[1:u], '[0-9]+'), ',') = array_to_string(regexp_extract_all(k, '[0-9]+'), ',')),
  b AS (SELECT x, k, max(u) AS u FROM w GROUP BY x, k), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY length(k) DESC, k) AS fuzzy_rank FROM b)
  SELECT x, k AS key, substr(x, u + 1) AS rest, fuzzy_rank::INT AS fuzzy_rank FROM r WHERE fuzzy_rank <= 5""")
def fuzzy_prefix(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.concat(F.replace("p_name", F.lit("i"), F.lit("e")), F.lit(" of "), "p_brand").alias("x")).distinct()
    k = p.select(F.col("p_name").alias("key")).distinct().withColumn("by", F.col("key"))
    return prefix.fuzzy_prefix(t, "x", k, "by").select("x", "key", "rest", "fuzzy_rank")


_SHARDS = "WITH k AS (SELECT DISTINCT oaza_cho AS b FROM mt_town_all WHERE oaza_cho IS NOT NULL), s AS (SELECT (row_number() OVER (ORDER BY b) - 1) // 200 AS shard, b FROM k), g AS (SELECT shard, min(b) AS bound, count(*) AS n FROM s GROUP BY shard) "


@query(_SHARDS + "SELECT * FROM g")
def range_shard_bounds(spark, d):
    return order.shard_bounds(table(spark, d, "mt_town_all"), "oaza_cho", 200)


@query(_SHARDS + "SELECT entry_id, coalesce(max(shard), 0) AS shard FROM dict_entry LEFT JOIN g ON bound <= key GROUP BY entry_id")
def shard_of_key(spark, d):
    b = order.shard_bounds(table(spark, d, "mt_town_all"), "oaza_cho", 200)
    return order.as_of_shard(table(spark, d, "dict_entry").select("entry_id", "key"), "key", b).select("entry_id", "shard")


@query("SELECT row_id, len(list_filter(['0001000', '0003000', '0010000'], lambda b: b <= machiaza_id))::INT AS part FROM mt_town_all")
def part_by_bounds(spark, d):
    return table(spark, d, "mt_town_all").select("row_id", order.part_of(F.array(F.lit("0001000"), F.lit("0003000"), F.lit("0010000")), F.col("machiaza_id")).alias("part"))


# ---------------------------------------------------------------- lookups

@query("""WITH n AS (SELECT code, machiaza_id, blk, no_key, dlat, dlng, no_num FROM rsdt_number WHERE code IS NOT NULL AND dlat IS NOT NULL AND dlng IS NOT NULL),
  u AS (SELECT code, machiaza_id, blk, no_key, min(dlat) AS dlat, min(dlng) AS dlng FROM n GROUP BY ALL),
  u2 AS (SELECT code, machiaza_id, blk, no_key FROM u)
  SELECT code AS lg, machiaza_id, blk::VARCHAR AS blk, TRY_CAST(split_part(no_key, '-', 1) AS BIGINT) AS number, arg_min(no_key, (contains(no_key, '-')::INT)::VARCHAR || no_key) AS n_key FROM u2 GROUP BY 1, 2, 3, 4 HAVING number IS NOT NULL""")
def number_lookup(spark, d):
    n = table(spark, d, "rsdt_number").where("code is not null and dlat is not null and dlng is not null")
    u = n.groupBy(F.col("code").alias("lg"), "machiaza_id", "blk", "no_key").agg(F.min("dlat").alias("dlat"), F.min("dlng").alias("dlng"))
    want = u.select("lg", "machiaza_id", F.col("blk").cast("string").alias("blk"), F.substring_index("no_key", "-", 1).try_cast("long").alias("_no"), F.lit(35.0).alias("b_lat"), F.lit(135.0).alias("b_lng")).where("_no is not null").distinct()
    return lookup_number(want, u).select("lg", "machiaza_id", "blk", F.col("_no").alias("number"), "n_key")


@query("""WITH p AS (SELECT code AS lg, machiaza_id, a, b, c, lat, lng, scale, parcel_id FROM parcel WHERE code IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL)
  SELECT lg, machiaza_id, a, arg_min(round(lat, 6), row(NOT (b = 1 AND c = 0), b, c, parcel_id)) AS p_lat, bool_or(b = 1 AND c = 0) AS parcel_exact FROM p GROUP BY lg, machiaza_id, a""")
def parcel_lookup(spark, d):
    p = table(spark, d, "parcel").where("code is not null and lat is not null and lng is not null").select(F.col("code").alias("lg"), "machiaza_id", F.col("parcel_id").alias("ord"), "a", "b", "c", "lat", "lng", "scale")
    want = p.select("lg", "machiaza_id", "a").distinct().select(F.concat_ws("|", "lg", "machiaza_id", "a").alias("_rid"), "lg", "machiaza_id", "a", F.lit(1).alias("want_b"), F.lit(0).alias("want_c"))
    out = lookup_parcel(want, p)
    part = F.split("_rid", "\\|")
    return out.select(part[0].alias("lg"), part[1].alias("machiaza_id"), part[2].cast("int").alias("a"), F.round("p_lat", 6).alias("p_lat"), "parcel_exact")


def _engine(spark, d) -> GeoEngine:
    t = lambda n: table(spark, d, n)
    placed = build.place_towns(t("mt_town_all").withColumn("ord", F.col("row_id")), t("mt_town_pos"))
    stage = Stage(spark, "index")  # built once, read by every step of the lookup
    placed = stage.keep(order.first_wins(placed, ["lg_code", "machiaza_id", "oaza_cho", "chome", "koaza"], "ord"), "placed")
    keys, kana = (stage.keep(x, "towns") for x in build.build_towns(placed))
    code = plain_code(F.col("code")).alias("lg")
    base = placed.where("lat is not null").groupBy(F.col("lg_code").alias("lg"), "machiaza_id").agg(F.min_by("lat", "ord").alias("lat"), F.min_by("lng", "ord").alias("lng"))
    n = t("rsdt_number").where("dlat is not null and dlng is not null").select(code, "machiaza_id", "blk", "no_key", "dlat", "dlng", F.col("num_id").alias("ord")).where("lg is not null")
    n = order.last_wins(n, ["lg", "machiaza_id", "blk", "no_key"], "ord").drop("ord")
    blocks = n.select("lg", "machiaza_id", "blk").distinct().join(base, ["lg", "machiaza_id"])
    parcels = t("parcel").where("lat is not null and lng is not null").select(code, "machiaza_id", F.col("parcel_id").alias("ord"), "a", "b", "c", "lat", "lng", "scale").where("lg is not null")
    stations = t("station")
    return GeoEngine(spark, Tables(t("city"), keys, kana, stage.keep(blocks, "blocks"), stage.keep(n, "numbers"), stage.keep(parcels, "parcels"), None, stations.select(F.col("line_code").alias("code")).distinct(), stations))


@query()
def geocode_full(spark, d):
    a = table(spark, d, "station").where("address is not null").select("address").distinct()
    out = _engine(spark, d).geocode(a.select(F.col("address").alias("id"), "address"))
    return out.select(F.col("id").alias("input"), "rank", "address", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "match_level", "system", "accuracy", "score", "building", "lg_code", "machiaza_id")


@query()
def geo_flagship(spark, d):
    """Addresses resolved to municipality level, best candidate only."""
    engine = GeoEngine(spark, Tables(table(spark, d, "city")), limit=1)
    a = table(spark, d, "station").where("address is not null").select("address").distinct()
    return engine.geocode(a.select(F.col("address").alias("id"), "address")).select(F.col("id").alias("input"), "address", "match_level", "score", "lg_code", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


# ---------------------------------------------------------------- order and windows

_PD = "SELECT code, machiaza_id, parcel_id, a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM parcel WHERE code IS NOT NULL"


@query(f"SELECT parcel_id, a - coalesce(lag(a) OVER (PARTITION BY code, machiaza_id ORDER BY a, b, c, parcel_id), 0) AS da FROM ({_PD})")
def delta_encode(spark, d):
    p = table(spark, d, "parcel").where("code is not null").select("code", "machiaza_id", "parcel_id", "a", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("c", F.lit(0)).alias("c")).withColumn("da", F.col("a"))
    return order.delta_encode(p, ["code", "machiaza_id"], ["a", "b", "c", "parcel_id"], ["da"]).select("parcel_id", "da")


@query("SELECT parcel_id, a::BIGINT AS a FROM parcel WHERE code IS NOT NULL")
def delta_round_trip(spark, d):
    p = table(spark, d, "parcel").where("code is not null").select("code", "machiaza_id", "parcel_id", "a").withColumn("x", F.col("a"))
    by, o = ["code", "machiaza_id"], ["a", "parcel_id"]
    return order.delta_decode(order.delta_encode(p, by, o, ["x"]), by, o, ["x"]).select("parcel_id", F.col("x").cast("long").alias("a"))


@query("""SELECT code, machiaza_id, blk, count(*) AS n, min(no_num) = 1 AND max(no_num) = count(*) AND count(DISTINCT no_num) = count(*) AND bool_and(branch IS NULL) AS dense
  FROM rsdt_number WHERE code IS NOT NULL GROUP BY code, machiaza_id, blk""")
def dense_run_detect(spark, d):
    n = table(spark, d, "rsdt_number").where("code is not null")
    return order.dense_groups(n, ["code", "machiaza_id", "blk"], "no_num", F.col("branch").isNull())


@query("SELECT lg_code, machiaza_id, arg_min(oaza_cho, row_id) AS oaza_cho FROM mt_town_all GROUP BY ALL")
def first_wins(spark, d):
    return order.first_wins(table(spark, d, "mt_town_all").select("lg_code", "machiaza_id", "oaza_cho", "row_id"), ["lg_code", "machiaza_id"], "row_id").drop("row_id")


@query("SELECT lg_code, machiaza_id, arg_max(row_id, loaded_at::VARCHAR || lpad(row_id::VARCHAR, 12, '0')) AS row_id FROM mt_town_all GROUP BY lg_code, machiaza_id")
def last_wins(spark, d):
    t = table(spark, d, "mt_town_all").select("lg_code", "machiaza_id", "row_id", F.struct("loaded_at", "row_id").alias("o"))
    return order.last_wins(t, ["lg_code", "machiaza_id"], "o").drop("o")


@query("""WITH p AS (SELECT key, code, count(*) AS n, min(entry_id) AS f FROM dict_entry GROUP BY key, code), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS rn FROM p) SELECT key, code, n FROM r WHERE rn = 1""")
def mode_code(spark, d):
    return order.mode_by(table(spark, d, "dict_entry"), ["key"], "code", "entry_id")


@query("SELECT query_id, cand_id, rank::INT AS rank FROM (SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE match_level WHEN 'rsdt' THEN 5 WHEN 'block' THEN 4 WHEN 'parcel' THEN 4 WHEN 'oaza' THEN 3 WHEN 'city' THEN 2 ELSE 1 END DESC, score DESC, cand_rank, cand_id) AS rank FROM candidate) WHERE rank <= 5")
def candidate_order(spark, d):
    depth = F.when(F.col("match_level") == "rsdt", 5).when(F.col("match_level").isin("block", "parcel"), 4).when(F.col("match_level") == "oaza", 3).when(F.col("match_level") == "city", 2).otherwise(1)
    return order.top_n(table(spark, d, "candidate"), ["query_id"], [-depth, F.desc("score"), F.asc("cand_rank"), F.asc("cand_id")], 5).select("query_id", "cand_id", "rank")


@query()
def greedy_pack(spark, d):
    n = table(spark, d, "rsdt_number").withColumn("lg", plain_code(F.col("code"))).where("lg is not null").groupBy("lg", "machiaza_id").agg(F.count(F.lit(1)).alias("n"))
    return order.greedy_parts(n, "lg", "machiaza_id", "n", 15_000)


@query("""WITH m AS (SELECT strftime(loaded_at, '%Y-%m') AS month, count(*) AS n FROM mt_town_all GROUP BY 1)
  SELECT month, n, round((n - lag(n) OVER (ORDER BY month)) * 100.0 / lag(n) OVER (ORDER BY month), 4) AS n_pct FROM m""")
def metrics_regression(spark, d):
    m = table(spark, d, "mt_town_all").groupBy(F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return order.change_from_last(m, "month", ["n"]).withColumn("n_pct", F.round("n_pct", 4))


@query()
def seeded_sample(spark, d):
    return order.seeded_sample(table(spark, d, "mt_town_all").select("row_id", "lg_code"), 100, "row_id", 7)


# ---------------------------------------------------------------- aggregates

@query("SELECT lg_code, count(*) AS n FROM mt_town_all GROUP BY lg_code")
def town_counts(spark, d):
    return aggregate_by_key(table(spark, d, "mt_town_all"), ["lg_code"], n=F.count(F.lit(1)))


@query("SELECT level, count(*) AS n, count(lat) AS placed FROM city GROUP BY level")
def level_counts(spark, d):
    return aggregate_by_key(table(spark, d, "city"), ["level"], n=F.count(F.lit(1)), placed=F.count("lat"))


@query("SELECT key, array_to_string(list(code ORDER BY entry_id), ',') AS codes FROM (SELECT key, code, min(entry_id) AS entry_id FROM dict_entry GROUP BY key, code) GROUP BY key")
def inverted_index(spark, d):
    first = table(spark, d, "dict_entry").groupBy("key", "code").agg(F.min("entry_id").alias("o"))
    return first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "code"))), lambda x: x["code"]), ",").alias("codes"))


@query("SELECT pref, round(min(lat) - 0.6, 6) AS lat0, round(max(lat) + 0.6, 6) AS lat1, round(min(lng) - 0.6, 6) AS lng0, round(max(lng) + 0.6, 6) AS lng1 FROM city WHERE level <> 'pref' AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY pref")
def prefecture_boxes(spark, d):
    b = quality.prefecture_boxes(table(spark, d, "city"))
    return b.select("pref", *(F.round(c, 6).alias(c) for c in ("lat0", "lat1", "lng0", "lng1")))


_POS = "(SELECT lg_code, machiaza_id, min(TRY_CAST(nullif(rep_lat, '') AS DOUBLE)) AS lat, min(TRY_CAST(nullif(rep_lon, '') AS DOUBLE)) AS lng FROM mt_town_pos GROUP BY ALL)"
_HAV = ("CASE WHEN {a}lat + {a}lng + {b}lat + {b}lng IS NOT NULL THEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2)"
        " + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))) END")


def _pos(spark, d):
    p = table(spark, d, "mt_town_pos").select("lg_code", "machiaza_id", geo.finite(F.col("rep_lat")).alias("lat"), geo.finite(F.col("rep_lon")).alias("lng"))
    return p.groupBy("lg_code", "machiaza_id").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))


@query(f"""WITH b AS (SELECT pref, min(lat) - 0.6 AS a0, max(lat) + 0.6 AS a1, min(lng) - 0.6 AS o0, max(lng) + 0.6 AS o1 FROM city WHERE level <> 'pref' AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY pref),
  t AS (SELECT p.*, c.lat AS clat, c.lng AS clng, b.*, p.lat IS NOT NULL AND p.lng IS NOT NULL AS placed FROM {_POS} p LEFT JOIN city c ON c.code = p.lg_code LEFT JOIN b ON b.pref = p.lg_code[1:2]),
  r AS (SELECT *, placed AND NOT (lat BETWEEN 20.0 AND 45.8 AND lng BETWEEN 122.8 AND 154.1) AS outside, placed AND a0 IS NOT NULL AND NOT (lat BETWEEN a0 AND a1 AND lng BETWEEN o0 AND o1) AS beyond, {_HAV.format(a='', b='c')} AS far FROM t)
  SELECT count(*) AS towns, count_if(placed) AS placed, round(100 * count_if(placed) / count(*), 4) AS coverage_pct, count_if(outside) AS outside_country, count_if(beyond) AS outside_pref, count_if(far > 60000) AS far_towns, round(max(far), 1) AS farthest_m, count_if(outside) = 0 AS ok FROM r""")
def town_gate(spark, d):
    return quality.town_gate(_pos(spark, d), table(spark, d, "city"))


_OFF = f"(SELECT {_HAV.format(a='a.', b='b.')} AS m FROM (SELECT lat, lng, lat + dlat / 1e6 AS lat2, lng + dlng / 1e6 AS lng2 FROM rsdt_number JOIN city USING (code) WHERE dlat IS NOT NULL AND dlng IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL) a)".replace("b.lat", "lat2").replace("b.lng", "lng2").replace("a.lat", "lat").replace("a.lng", "lng")


def _offsets(spark, d):
    """Distances of the numbers from where their offset begins, here their municipality's position."""
    c = table(spark, d, "city").where("lat is not null and lng is not null").select("code", "lat", "lng")
    n = join_small(table(spark, d, "rsdt_number").where("dlat is not null and dlng is not null").select("code", "dlat", "dlng"), c, "code")
    return n.select("code", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("lat") + F.col("dlat") / 1e6, F.col("lng") + F.col("dlng") / 1e6).alias("metres"))


@query(f"SELECT least(floor(m / 5), 600)::BIGINT AS bucket, count(*) AS n FROM {_OFF} GROUP BY 1")
def dist_histogram(spark, d):
    return stats.histogram(_offsets(spark, d), [], "metres", 5.0, 600)


@query(f"""WITH d AS {_OFF}, h AS (SELECT least(floor(m / 5), 600)::BIGINT AS b, count(*) AS n FROM d GROUP BY 1),
  c AS (SELECT b, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS t FROM h) SELECT (SELECT count(*) FROM d) AS numbers, (SELECT round(max(m), 1) FROM d) AS max_m, (SELECT count_if(m > 500) FROM d) AS far, (SELECT count_if(m > 5000) FROM d) AS broken,
  min(CASE WHEN c >= t * 0.5 THEN b * 5.0 END)::DOUBLE AS median_m, min(CASE WHEN c >= t * 0.99 THEN b * 5.0 END)::DOUBLE AS p99_m, (SELECT count_if(m > 5000) = 0 FROM d) AS ok FROM c""")
def number_gate(spark, d):
    return quality.number_gate(_offsets(spark, d))


@query("""WITH s AS (SELECT match_level, score, row_number() OVER (PARTITION BY match_level ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY match_level) AS n FROM candidate WHERE score IS NOT NULL)
  SELECT match_level, n, max(CASE WHEN i = least(floor(n * 0.5)::BIGINT, n - 1) THEN score END) AS p50, max(CASE WHEN i = least(floor(n * 0.9)::BIGINT, n - 1) THEN score END) AS p90 FROM s GROUP BY match_level, n""")
def index_quantiles(spark, d):
    return stats.index_quantile(table(spark, d, "candidate"), ["match_level"], "score", {"p50": 0.5, "p90": 0.9})


@query("""WITH x AS (SELECT match_level, """ + _HAV.format(a="k.", b="c.") + """ AS m FROM candidate k JOIN city c ON c.code = k.lg_code WHERE k.lat BETWEEN 20 AND 46 AND k.lng BETWEEN 122 AND 154)
  SELECT match_level, count(*) AS n, round(avg((m <= 1000)::INT), 6) AS km1, round(avg((m <= 10000)::INT), 6) AS km10 FROM x WHERE m IS NOT NULL GROUP BY match_level""")
def within_shares(spark, d):
    c = table(spark, d, "city").select(F.col("code").alias("lg_code"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    k = table(spark, d, "candidate").where(geo.in_box(F.col("lat"), F.col("lng"))).join(c, "lg_code")
    x = k.withColumn("m", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))).where("m is not null")
    return stats.within_shares(x, ["match_level"], "m", {"km1": 1000, "km10": 10000}).select("match_level", "n", F.round("km1", 6).alias("km1"), F.round("km10", 6).alias("km10"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT lg_code, machiaza_id FROM mt_town_all)) AS base, (SELECT count(*) FROM (SELECT DISTINCT lg_code, machiaza_id FROM mt_town_pos)) AS other, (SELECT count(*) FROM (SELECT lg_code, machiaza_id FROM mt_town_all INTERSECT SELECT lg_code, machiaza_id FROM mt_town_pos)) AS \"both\", round((SELECT count(*) FROM (SELECT lg_code, machiaza_id FROM mt_town_all INTERSECT SELECT lg_code, machiaza_id FROM mt_town_pos)) / (SELECT count(*) FROM (SELECT DISTINCT lg_code, machiaza_id FROM mt_town_all)), 6) AS share")
def coverage_intersect(spark, d):
    return stats.coverage(table(spark, d, "mt_town_all"), table(spark, d, "mt_town_pos"), ["lg_code", "machiaza_id"]).withColumn("share", F.round("share", 6))


@query("""WITH g AS (SELECT code, count(*) AS total, count(lat) AS hits, round(count(lat) / count(*), 6) AS ratio FROM parcel WHERE code IS NOT NULL GROUP BY code HAVING count(*) >= 20),
  r AS (SELECT 'best' AS side, *, row_number() OVER (ORDER BY ratio DESC, code) AS rank FROM g UNION ALL SELECT 'worst', *, row_number() OVER (ORDER BY ratio, code) FROM g) SELECT side, rank::INT AS rank, code, total, hits, ratio FROM r WHERE rank <= 10""")
def coverage_by_group(spark, d):
    out = quality.coverage_extremes(table(spark, d, "parcel").where("code is not null"), "code", F.col("lat").isNotNull(), 20)
    return out.select("side", "rank", "code", "total", "hits", "ratio")


@query(f"""WITH x AS (SELECT p.lg_code, p.machiaza_id, {_HAV.format(a='p.', b='c.')} AS far FROM {_POS} p JOIN city c ON c.code = p.lg_code WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL AND c.lat IS NOT NULL AND c.lng IS NOT NULL)
  SELECT lg_code, round(max(far), 1) AS farthest_m, arg_min(machiaza_id, row(-far, machiaza_id)) AS farthest_town, count(*) AS n FROM x WHERE far > 60000 GROUP BY lg_code""")
def far_by_city(spark, d):
    return quality.far_by_city(_pos(spark, d), table(spark, d, "city"))


_LOTS = "(SELECT code AS lg, machiaza_id, lat, lng, scale FROM parcel WHERE code IS NOT NULL AND lat BETWEEN 20 AND 46 AND lng BETWEEN 122 AND 154)"


@query(f"""WITH p AS {_LOTS}, o AS (SELECT lg, machiaza_id, round(avg(lat), 6) AS olat, round(avg(lng), 6) AS olng FROM p GROUP BY ALL),
  d AS (SELECT scale, {_HAV.format(a='p.', b='o.o')} AS m FROM p JOIN o USING (lg, machiaza_id)), h AS (SELECT least(floor(m / 20), 500)::BIGINT AS b, count(*) AS n FROM d GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS t FROM h)
  SELECT (SELECT count(*) FROM d) AS lots, (SELECT round(100 * count_if(scale > 0 AND scale <= 500) / count(*), 4) FROM d) AS surveyed_pct, min(CASE WHEN c >= t * 0.5 THEN b * 20.0 END)::DOUBLE AS median_m, min(CASE WHEN c >= t * 0.99 THEN b * 20.0 END)::DOUBLE AS p99_m FROM c""")
def parcel_gate(spark, d):
    p = table(spark, d, "parcel").where(F.col("code").isNotNull() & geo.in_box(F.col("lat"), F.col("lng"))).select(F.col("code").alias("lg"), "machiaza_id", "lat", "lng", "scale")
    return quality.parcel_gate(p)


@query("""WITH x AS (SELECT match_level, """ + _HAV.format(a="k.", b="c.") + """ AS m FROM candidate k JOIN city c ON c.code = k.lg_code WHERE k.lat BETWEEN 20 AND 46 AND k.lng BETWEEN 122 AND 154),
  s AS (SELECT match_level, m, row_number() OVER (PARTITION BY match_level ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY match_level) AS n FROM x WHERE m IS NOT NULL)
  SELECT match_level, n, round(avg((m <= 10)::INT), 6) AS within_10, round(avg((m <= 50)::INT), 6) AS within_50, round(avg((m <= 100)::INT), 6) AS within_100, round(avg((m <= 500)::INT), 6) AS within_500,
  round(max(CASE WHEN i = least(floor(n * 0.5)::BIGINT, n - 1) THEN m END), 3) AS p50, round(max(CASE WHEN i = least(floor(n * 0.9)::BIGINT, n - 1) THEN m END), 3) AS p90, round(max(CASE WHEN i = least(floor(n * 0.99)::BIGINT, n - 1) THEN m END), 3) AS p99 FROM s GROUP BY match_level, n""")
def accuracy_audit(spark, d):
    c = table(spark, d, "city").select(F.col("code").alias("lg_code"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    k = join_small(table(spark, d, "candidate").where(geo.in_box(F.col("lat"), F.col("lng"))), c, "lg_code")
    x = k.select("match_level", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")).alias("metres"))
    out = quality.accuracy_audit(x)
    return out.select("match_level", "n", *(F.round(c, 6).alias(c) for c in ("within_10", "within_50", "within_100", "within_500")), *(F.round(c, 3).alias(c) for c in ("p50", "p90", "p99")))


@query("""WITH t AS (SELECT DISTINCT lg_code AS code, machiaza_id FROM mt_town_all WHERE lg_code IS NOT NULL AND machiaza_id IS NOT NULL), n AS (SELECT DISTINCT code, machiaza_id FROM rsdt_number WHERE code IS NOT NULL AND machiaza_id IS NOT NULL), b AS (SELECT * FROM t INTERSECT SELECT * FROM n)
  SELECT (SELECT count(*) FROM t) AS base, (SELECT count(*) FROM n) AS other, (SELECT count(*) FROM b) AS "both", round((SELECT count(*) FROM b) / (SELECT count(*) FROM t), 6) AS share""")
def town_coverage(spark, d):
    known = "code is not null and machiaza_id is not null"
    t = table(spark, d, "mt_town_all").withColumnRenamed("lg_code", "code").where(known)
    return quality.town_coverage(t, table(spark, d, "rsdt_number").where(known), ["code", "machiaza_id"]).withColumn("share", F.round("share", 6))


@query("SELECT lg_code[1:2] AS pref, rsdt_addr_flg AS flag, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lg_code[1:2]), 6) AS rate FROM mt_town_all GROUP BY 1, 2")
def flag_rates(spark, d):
    return quality.flag_rates(table(spark, d, "mt_town_all"))


@query("SELECT file_name AS file, count(*) AS rows FROM town_raw GROUP BY 1")
def rows_per_file(spark, d):
    return quality.rows_per_file(table(spark, d, "town_raw"))


@query("SELECT DISTINCT split_part(path, '/', -1) AS name, max(committed_at)::VARCHAR AS modified FROM documents WHERE split_part(path, '/', -1) <> '' GROUP BY 1")
def catalogue_dates(spark, d):
    f = table(spark, d, "documents").select("path", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("modified"))
    return quality.catalogued(f, f)


@query("SELECT DISTINCT blk::VARCHAR AS blk FROM rsdt_number WHERE regexp_full_match(blk::VARCHAR, '[0-9]+')")
def numeric_blocks(spark, d):
    n = table(spark, d, "rsdt_number").select(F.col("blk").cast("string").alias("blk"))
    return n.where(F.col("blk").rlike("^[0-9]+$")).distinct()


@query("SELECT scale, count(*) AS n, CASE WHEN scale > 0 AND scale <= 500 THEN 'surveyed' ELSE 'legacy' END AS accuracy FROM parcel GROUP BY scale")
def scale_counts(spark, d):
    return quality.scale_counts(table(spark, d, "parcel")).withColumn("accuracy", geo.accuracy_of_scale(F.col("scale")))


@query("SELECT oaza_cho[1] AS first, count(*) AS n, count(DISTINCT oaza_cho) AS \"distinct\" FROM mt_town_all WHERE oaza_cho <> '' GROUP BY 1")
def first_letter_profile(spark, d):
    return quality.profile(table(spark, d, "mt_town_all"), "oaza_cho")


_COLL = f"(SELECT t.lg_code, t.key, t.oaza_cho AS name, t.machiaza_id AS id, p.lat, p.lng FROM (SELECT lg_code, machiaza_id, oaza_cho, oaza_cho[1:3] AS key FROM mt_town_all WHERE oaza_cho <> '') t LEFT JOIN {_POS} p USING (lg_code, machiaza_id))"


@query(f"""WITH x AS {_COLL}, g AS (SELECT lg_code, key, count(DISTINCT name) AS names, count(DISTINCT id) AS ids FROM x GROUP BY 1, 2 HAVING count(DISTINCT name) > 1),
  y AS (SELECT DISTINCT lg_code, key, lat, lng FROM x WHERE lat IS NOT NULL AND lng IS NOT NULL), s AS (SELECT a.lg_code, a.key, max({_HAV.format(a='a.', b='c.')}) AS m FROM y a JOIN y c USING (lg_code, key) GROUP BY 1, 2)
  SELECT lg_code, key, names, ids, round(m, 1) AS spread_m, CASE WHEN m IS NULL THEN 'unknown' WHEN round(m, 1) < 200 THEN 'benign' WHEN round(m, 1) < 2000 THEN 'suspect' ELSE 'harmful' END AS class FROM g LEFT JOIN s USING (lg_code, key)""")
def key_collisions(spark, d):
    t = table(spark, d, "mt_town_all").where("oaza_cho <> ''").select("lg_code", "machiaza_id", F.col("oaza_cho").alias("name"), F.substring("oaza_cho", 1, 3).alias("key"))
    return quality.key_collisions(t.join(_pos(spark, d), ["lg_code", "machiaza_id"], "left").withColumnRenamed("machiaza_id", "id"), ["lg_code", "key"], "name", "id")


def collisions_of_names(towns, pos):
    """(axis, lg_code, key, names, ids, spread_m, class): different whole names with one ``to_key``, or whose readings have one ``to_kana_key``."""
    whole = lambda end: F.concat(*(F.coalesce(c + end, F.lit("")) for c in ("oaza_cho", "chome", "koaza")))
    t = towns.select("lg_code", "machiaza_id", whole("").alias("name"), whole("_kana").alias("kana")).where("name <> ''").distinct()
    spelled = t.select("lg_code", "machiaza_id", "name", F.lit("spelling").alias("axis"), text.to_key("name").alias("key"))
    read = t.where("kana <> ''").select("lg_code", "machiaza_id", "name", F.lit("reading").alias("axis"), text.to_kana_key("kana").alias("key"))
    named = spelled.unionByName(read).join(pos, ["lg_code", "machiaza_id"], "left").withColumnRenamed("machiaza_id", "id")
    return quality.key_collisions(named, ["axis", "lg_code", "key"], "name", "id")


@query()
def key_collisions_whole(spark, d):
    return collisions_of_names(table(spark, d, "mt_town_all"), _pos(spark, d))


@query("""WITH v AS (SELECT source, license_id AS version, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, arg_max(version, lpad(n::VARCHAR, 12, '0') || version) AS version FROM v WHERE version IS NOT NULL GROUP BY source)
  SELECT source, strftime(max(committed_at), '%Y-%m-%d') AS modified, count(*) AS files, count(DISTINCT path) AS names, any_value(t.version) AS version FROM documents JOIN t USING (source) GROUP BY source""")
def version_summary(spark, d):
    f = table(spark, d, "documents").select("source", F.col("path").alias("name"), F.col("committed_at").alias("modified"), F.col("license_id").alias("version"))
    all_ = build.build_version(f).drop("version")
    return all_.join(build.build_version(f.where("version is not null")).select("source", "version"), "source")


# ---------------------------------------------------------------- directory and rail

_MUNI = """WITH w AS (SELECT c.pref, c.code, c.name, c.lat, c.lng, p.name AS pn, p.lat AS plat, p.lng AS plng, CASE WHEN starts_with(c.name, p.name) THEN substr(c.name, length(p.name) + 1) ELSE c.name END AS w FROM city c LEFT JOIN city p ON p.code = c.parent WHERE c.level = 'ward'),
  n AS (SELECT pref, code, name, lat, lng FROM city c WHERE level NOT IN ('pref', 'ward') AND NOT (level = 'city' AND EXISTS (SELECT 1 FROM city x WHERE x.parent = c.code))) """


def _joined(df):
    return df.select("pref", "ord", "municipality", F.array_join("ward", ",").alias("wards"), "lat", "lng")


@query(_MUNI + "SELECT pref, code AS ord, name AS municipality, NULL::VARCHAR AS wards, lat, lng FROM n UNION ALL SELECT pref, code, coalesce(pn, name), CASE WHEN pn IS NOT NULL THEN w END, lat, lng FROM w")
def ward_fold_wards(spark, d):
    return _joined(directory.list_municipalities(table(spark, d, "city")))


@query(_MUNI + "SELECT pref, code AS ord, name AS municipality, NULL::VARCHAR AS wards, lat, lng FROM n UNION ALL SELECT pref, code, name, NULL, lat, lng FROM w WHERE pn IS NULL UNION ALL SELECT pref, min(code), pn, string_agg(w, ',' ORDER BY code), arg_min(plat, code), arg_min(plng, code) FROM w WHERE pn IS NOT NULL GROUP BY pref, pn")
def ward_fold_nested(spark, d):
    return _joined(directory.list_municipalities(table(spark, d, "city"), mode="nested"))


@query("SELECT code, name, lat, lng FROM city WHERE level = 'pref'")
def list_prefectures(spark, d):
    return directory.list_prefectures(table(spark, d, "city"))


@query("SELECT s.code, c.code AS pref, c.name AS pref_name FROM station s LEFT JOIN city c ON c.level = 'pref' AND c.code = lpad(s.pref::BIGINT::VARCHAR, 2, '0')")
def pref_resolve(spark, d):
    s = table(spark, d, "station").select("code", F.col("pref").cast("long").cast("string").alias("asked"))
    return directory.resolve_prefs(s, "asked", table(spark, d, "city").where("level = 'pref'").select("code", "name")).select("code", "pref", "pref_name")


@query("SELECT DISTINCT line_code AS code FROM station WHERE pref = 13")
def lines_in_pref(spark, d):
    s = table(spark, d, "station")
    return directory.list_lines(s.select(F.col("line_code").alias("code")).distinct(), s, 13)


@query("SELECT code, name, ord FROM station WHERE pref = 6 AND line_code = 11006")
def stations_filter(spark, d):
    return directory.list_stations(table(spark, d, "station"), pref=6, line=11006).select("code", "name", "ord")


@query("SELECT line_code AS code, count(*) AS stations FROM station GROUP BY line_code")
def stations_per_line(spark, d):
    s = table(spark, d, "station")
    return directory.stations_per_line(s.select(F.col("line_code").alias("code")).distinct(), s)


@query("SELECT code, row_number() OVER (PARTITION BY line_code ORDER BY ord, code)::INT AS place FROM station")
def rail_order(spark, d):
    return order.top_n(table(spark, d, "station"), ["line_code"], [F.asc("ord"), F.asc("code")], 1 << 30, "place").select("code", "place")


_KNN = f"""WITH q AS (SELECT cand_id, lat, lng FROM candidate WHERE cand_id % 100 = 0 AND lat IS NOT NULL AND lng IS NOT NULL), s AS (SELECT code, group_code, lat, lng, ord FROM station WHERE lat IS NOT NULL AND lng IS NOT NULL),
  d AS (SELECT cand_id, s.code, s.group_code, s.ord, {_HAV.format(a='q.', b='s.')} AS m FROM q, s) """


def _near(spark, d, **how):
    q = table(spark, d, "candidate").where("cand_id % 100 = 0").select("cand_id", "lat", "lng")  # the stated query set of a search
    out = nearest_stations(q, "cand_id", table(spark, d, "station"), **how)
    return out.select("cand_id", "rank", "code", F.round("distance_m", 3).alias("distance_m"))


@query(_KNN + "SELECT cand_id, rank::INT AS rank, code, round(m, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY m, ord, code) AS rank FROM d) WHERE rank <= 3")
def knn_stations(spark, d):
    return _near(spark, d, limit=3)


@query(_KNN + ", g AS (SELECT *, row_number() OVER (PARTITION BY cand_id, group_code ORDER BY m, ord, code) AS gr FROM d) SELECT cand_id, rank::INT AS rank, code, round(m, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY m, ord, code) AS rank FROM g WHERE gr = 1) WHERE rank <= 3")
def knn_grouped(spark, d):
    return _near(spark, d, limit=3, group_by_station=True)


@query(_KNN + "SELECT cand_id, rank::INT AS rank, code, round(m, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY m, ord, code) AS rank FROM d) WHERE rank <= 5 AND m <= 2000")
def knn_maxdist(spark, d):
    return _near(spark, d, limit=5, max_distance=2000.0)


@query("SELECT k.cand_id, round(" + _HAV.format(a="k.", b="c.") + ", 3) AS metres FROM candidate k JOIN city c ON c.code = k.lg_code WHERE k.lat IS NOT NULL AND k.lng IS NOT NULL AND c.lat IS NOT NULL AND c.lng IS NOT NULL")
def haversine_pairs(spark, d):
    c = table(spark, d, "city").where("lat is not null and lng is not null").select(F.col("code").alias("lg_code"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    k = table(spark, d, "candidate").where("lat is not null and lng is not null").join(c, "lg_code")
    return k.select("cand_id", F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")), 3).alias("metres"))


@query("SELECT DISTINCT lg_code, machiaza_id FROM mt_town_pos WHERE lg_code IS NOT NULL AND machiaza_id IS NOT NULL EXCEPT SELECT lg_code, machiaza_id FROM mt_town_all")
def positions_without_town(spark, d):
    p = table(spark, d, "mt_town_pos").select("lg_code", "machiaza_id").where("lg_code is not null and machiaza_id is not null").distinct()
    return p.join(table(spark, d, "mt_town_all").select("lg_code", "machiaza_id").distinct(), ["lg_code", "machiaza_id"], "left_anti")


QUERIES = Q
