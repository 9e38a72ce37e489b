"""The core's queries over the generated tables: hot keys, near points, malformed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from azanami.operators.near import containing_regions, pairs_within
from azanami.operators.skew import codes_by_table, heavy_codes
from azanami.plans.quality import prefecture_boxes
from azanami.runtime import table
from azanami.sources.records import parse_records

_PLAIN = "regexp_replace(translate(code, '０１２３４５６７８９', '0123456789'), '[\\s\\p{Zs}\\p{Pd}−­ｰー]+', '', 'g')"
_CODES = f"""
WITH r AS (
  SELECT 'rsdt_number' AS src_table, {_PLAIN} AS c FROM rsdt_number
  UNION ALL SELECT 'parcel', {_PLAIN} FROM parcel),
g AS (SELECT src_table, CASE WHEN regexp_full_match(c, '[0-9]{{6}}') THEN c END AS code, count(*) AS n_rows FROM r GROUP BY 1, 2),
t AS (SELECT src_table, sum(n_rows)::BIGINT AS n_all FROM g GROUP BY 1)
"""
_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2))))"
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_RECORDS = rf"""
WITH a AS (SELECT line_id, regexp_replace(raw, '\r$', '') AS r FROM town_raw),
q AS (SELECT *, r IS NOT NULL AND NOT regexp_full_match(r, '(?s){_FIELD}(?:,{_FIELD})*') AS broken FROM a),
f AS (SELECT line_id, broken, CASE WHEN NOT broken THEN list_transform(regexp_extract_all(',' || r, '(?s),({_FIELD})', 1),
        lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS v FROM q),
d AS (SELECT *, coalesce(regexp_full_match(v[1], '[0-9]{{6}}') AND v[1][1:2] BETWEEN '01' AND '47'
        AND (11 - (6 * TRY_CAST(v[1][1] AS INT) + 5 * TRY_CAST(v[1][2] AS INT) + 4 * TRY_CAST(v[1][3] AS INT) + 3 * TRY_CAST(v[1][4] AS INT)
          + 2 * TRY_CAST(v[1][5] AS INT)) % 11) % 10 = TRY_CAST(v[1][6] AS INT), false) AS lg_ok FROM f),
s AS (SELECT line_id, v, CASE WHEN broken THEN 'quoting' WHEN v IS NULL OR len(v) <> 8 THEN 'column_count' WHEN NOT lg_ok THEN 'lg_code'
        WHEN NOT regexp_full_match(v[2], '[0-9]{{7}}') THEN 'machiaza_id' END AS reason FROM d)
"""


# a broken record breaks at its end where a quote stays open, else at the first byte that no longer continues a sequence of fields
_OFFSETS = rf""", x AS (SELECT s.line_id, reason, a.r, coalesce(len(s.v), 0) AS n FROM s JOIN a USING (line_id) WHERE reason IS NOT NULL),
y AS (SELECT *, regexp_extract(r, '(?s)^(?:{_FIELD},)*') AS good FROM x),
z AS (SELECT *, substr(r, length(good) + 1) AS bad FROM y)
SELECT line_id, reason, CASE reason WHEN 'lg_code' THEN 0
  WHEN 'machiaza_id' THEN strlen(regexp_extract(r, '(?s)^{_FIELD},'))
  WHEN 'column_count' THEN CASE WHEN n > 8 THEN strlen(regexp_extract(r, '(?s)^(?:{_FIELD},){{8}}')) ELSE strlen(r) END
  ELSE strlen(good) + CASE WHEN starts_with(bad, '"') THEN CASE WHEN regexp_full_match(bad, '(?s)"(?:[^"]|"")*') THEN strlen(bad) ELSE strlen(regexp_extract(bad, '(?s)^"(?:[^"]|"")*"')) END
    ELSE strlen(regexp_extract(bad, '^[^",]*')) END END::BIGINT AS reason_offset FROM z"""


def p4_found(spark, d):
    return heavy_codes({"rsdt_number": (table(spark, d, "rsdt_number"), "code"), "parcel": (table(spark, d, "parcel"), "code")})


def p4_counts(spark, d):
    return codes_by_table({"rsdt_number": (table(spark, d, "rsdt_number"), "code"), "parcel": (table(spark, d, "parcel"), "code")})


def p5_found(spark, d):
    out = pairs_within(table(spark, d, "candidate"), "cand_id", table(spark, d, "station").withColumnRenamed("code", "station_code"), "station_code")
    return out.select(F.col("cand_id").cast("long"), F.col("station_code").cast("long"))


def p5_regions(spark, d):
    """Prefectures within whose box (of their municipalities, widened) each candidate lies."""
    b = prefecture_boxes(table(spark, d, "city"))
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lng"))
    r = b.select("pref", F.array(F.array(corner("lat0", "lng0"), corner("lat0", "lng1"), corner("lat1", "lng1"), corner("lat1", "lng0"))).alias("rings"))
    return containing_regions(table(spark, d, "candidate"), "cand_id", r, "pref")


def _parsed(spark, d):
    return parse_records(table(spark, d, "town_raw"), "line_id", "raw", types={"rsdt_addr_flg": "int", "efct_date": "date"})


def p6_found(spark, d):
    return _parsed(spark, d).where("reason is not null").select("line_id", "reason")


def p6_rows(spark, d):
    return _parsed(spark, d).where("reason is null").drop("reason", "reason_offset").withColumn("efct_date", F.date_format("efct_date", "yyyy-MM-dd"))


def p6_offsets(spark, d):
    return _parsed(spark, d).where("reason is not null").select("line_id", "reason", "reason_offset")


QUERIES = {
    "p4_found": (p4_found, _CODES + "SELECT g.src_table, code FROM g JOIN t USING (src_table) WHERE code IS NOT NULL AND n_rows >= 0.02 * n_all"),
    "p4_counts": (p4_counts, _CODES + "SELECT g.src_table, code, n_rows, n_all FROM g JOIN t USING (src_table)"),
    "p5_found": (p5_found, f"""SELECT c.cand_id, s.code::BIGINT AS station_code FROM candidate c JOIN station s
        ON abs(c.lat - s.lat) < 0.01 AND {_HAV} <= 250
        WHERE c.lat BETWEEN 20 AND 46 AND c.lng BETWEEN 122 AND 154 AND s.lat BETWEEN 20 AND 46 AND s.lng BETWEEN 122 AND 154"""),
    "p5_regions": (p5_regions, """WITH b AS (SELECT pref, min(lat) - 0.6 AS a0, max(lat) + 0.6 AS a1, min(lng) - 0.6 AS o0, max(lng) + 0.6 AS o1 FROM city WHERE level <> 'pref' AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY pref)
        SELECT cand_id, pref FROM candidate JOIN b ON lat >= a0 AND lat < a1 AND lng >= o0 AND lng < o1"""),
    "p6_found": (p6_found, _RECORDS + "SELECT line_id, reason FROM s WHERE reason IS NOT NULL"),
    "p6_offsets": (p6_offsets, _RECORDS + _OFFSETS),
    "p6_rows": (p6_rows, _RECORDS + "SELECT line_id, v[1] AS lg_code, v[2] AS machiaza_id, v[3] AS oaza_cho, v[4] AS oaza_cho_kana, v[5] AS chome, TRY_CAST(v[6] AS INT) AS rsdt_addr_flg, strftime(TRY_CAST(v[7] AS DATE), '%Y-%m-%d') AS efct_date, v[8] AS note FROM s WHERE reason IS NULL"),
}
