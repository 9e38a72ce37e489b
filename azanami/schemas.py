"""Columns of the source tables that are read, all of them text, and of the built tables."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType


def text_schema(*columns: str) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


# Column names of the published registers.
SOURCES = {
    "mt_pref": text_schema("lg_code", "pref", "pref_kana", "ablt_date"),
    "mt_pref_pos": text_schema("lg_code", "rep_lat", "rep_lon"),
    "mt_city": text_schema("lg_code", "pref", "county", "county_kana", "city", "city_kana", "ward", "ward_kana"),
    "mt_city_pos": text_schema("lg_code", "rep_lat", "rep_lon"),
    "mt_town": text_schema("lg_code", "machiaza_id", "oaza_cho", "oaza_cho_kana", "chome", "chome_kana", "koaza", "koaza_kana", "rsdt_addr_flg"),
    "mt_town_pos": text_schema("lg_code", "machiaza_id", "rep_lat", "rep_lon"),
    "isj_town": text_schema("pref_code", "pref", "city5", "city", "oaza_code", "name", "lat", "lng"),
    "isj_block": text_schema("pref", "city", "oaza", "koaza", "block", "sys", "x", "y", "lat", "lng"),
    "mt_rsdtdsp_blk": text_schema("lg_code", "machiaza_id", "blk_id", "blk_num", "ablt_date"),
    "mt_rsdtdsp_blk_pos": text_schema("lg_code", "machiaza_id", "blk_id", "rep_lat", "rep_lon"),
    "mt_rsdtdsp_rsdt": text_schema("lg_code", "machiaza_id", "blk_id", "blk_num", "rsdt_id", "rsdt2_id", "rsdt_num", "rsdt_num2", "ablt_date"),
    "mt_rsdtdsp_rsdt_pos": text_schema("lg_code", "machiaza_id", "blk_id", "rsdt_id", "rsdt2_id", "rep_lat", "rep_lon"),
    "mt_parcel": text_schema("lg_code", "machiaza_id", "prc_id", "prc_num1", "prc_num2", "prc_num3", "ablt_date"),
    "mt_parcel_pos": text_schema("lg_code", "machiaza_id", "prc_id", "rep_lat", "rep_lon", "rep_scale"),
    "old_city": text_schema("geoshape_city_id", "pref", "name", "suffix"),
    "current_city": text_schema("geoshape_city_id"),
    "company": text_schema("company_cd", "company_name", "e_status"),
    "line": text_schema("line_cd", "company_cd", "line_name", "e_status"),
    "station": text_schema("station_cd", "station_g_cd", "station_name", "line_cd", "pref_cd", "post", "address", "lon", "lat", "e_status", "e_sort"),
}
