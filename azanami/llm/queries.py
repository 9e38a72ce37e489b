"""Queries of this subpackage: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from azanami.llm import dups, leaks, match, packing, plain, subjects
from azanami.runtime import table

_KEY = ("array_to_string(list_sort(list_distinct(list_filter(["
        + ", ".join(f"regexp_replace(lower(coalesce({f}, '')), '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}\\p{{P}}]+', '', 'g')".replace("{{", "{").replace("}}", "}") for f in dups.FIELDS)
        + "], lambda v: v <> ''))), chr(1))")
_P8 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[abefnrtv0])', ' ', 'g')), '[\p{L}\p{N}]+') AS t FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[abefnrtv0])', ' ', 'g')), '[\p{L}\p{N}]+') AS t FROM eval_item),
dw AS (SELECT doc_id, array_to_string(t[k:k+15], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 14)) AS k FROM w WHERE len(t) >= 16)),
iw AS (SELECT DISTINCT item_id, array_to_string(t[k:k+15], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 14)) AS k FROM i WHERE len(t) >= 16))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""

_P8_SPANS = _P8[:_P8.index("SELECT DISTINCT doc_id, item_id")].replace("SELECT doc_id, array_to_string", "SELECT doc_id, k - 1 AS pos, array_to_string") + """,
m AS (SELECT DISTINCT doc_id, item_id, pos FROM dw JOIN iw USING (g)),
n AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + 16 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM n)
SELECT doc_id, item_id, min(pos) AS first_word, max(pos) + 16 AS end_word FROM s GROUP BY doc_id, item_id, span"""


def _towns(spark, d):
    t = lambda n: table(spark, d, n)
    return match.station_towns(t("station"), t("mt_town_all"), t("city"), t("dict_entry"), t("mt_town_pos"))


def p1_found(spark, d):
    return _towns(spark, d).select("station_code", "lg_code", "oaza_no")


def p1_confidence(spark, d):
    return _towns(spark, d)


def _fields(spark, d):
    towns = table(spark, d, "mt_town_all")
    return {"mt_town_all": (towns, "row_id", ["oaza_cho"]), "dict_entry": (table(spark, d, "dict_entry"), "entry_id", ["key", "kana"])}, [(towns, "chome"), (towns, "koaza")]


def p2_found(spark, d):
    return plain.deviating(*_fields(spark, d))


def p2_plain(spark, d):
    return plain.plain_fields(*_fields(spark, d))


def p3_found(spark, d):
    return dups.copies(table(spark, d, "mt_town_all"))


def p3_entries(spark, d):
    return dups.entries(table(spark, d, "mt_town_all"))


def p8_found(spark, d):
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_spans(spark, d):
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_pack(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p7_utilisation(spark, d):
    return packing.utilisation(p7_pack(spark, d))


def p9_found(spark, d):
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_label"), table(spark, d, "subject_area"))


QUERIES = {
    "p1_found": (p1_found, None),
    "p1_confidence": (p1_confidence, None),
    "p2_found": (p2_found, None),
    "p2_plain": (p2_plain, None),
    "p3_found": (p3_found, f"WITH k AS (SELECT row_id, {_KEY} AS key FROM mt_town_all), g AS (SELECT key, min(row_id) AS keep_id FROM k WHERE key <> '' GROUP BY key) SELECT keep_id, row_id AS copy_id FROM k JOIN g USING (key) WHERE row_id <> keep_id"),
    "p3_entries": (p3_entries, f"WITH k AS (SELECT row_id, {_KEY} AS key FROM mt_town_all) SELECT min(row_id) AS keep_id, count(*) AS n_copies FROM k WHERE key <> '' GROUP BY key"),
    "p8_found": (p8_found, _P8),
    "p7_pack": (p7_pack, None),
    "p7_utilisation": (p7_utilisation, None),
    "p8_spans": (p8_spans, _P8_SPANS),
    "p9_found": (p9_found, None),
}
