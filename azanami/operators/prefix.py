"""Prefix and fuzzy joins.

``ON text LIKE key || '%'`` would compare all texts with all keys.  Here a text is expanded to its prefixes, no longer
than the longest key, and an equi-join finds the keys among them; equal texts should be joined once (callers pass distinct
ones).  For one edit, texts and keys are blocked by their letters with one left out: two strings within
one edit always share such a form, so nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from azanami.functions.text import digit_runs, kana_key_of_nfkc, loosen
from azanami.operators.small import join_small


def prefixes(text: Column, longest: int) -> Column:
    n = F.least(F.length(text), F.lit(longest))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, F.lit(1), i)))


def shortened(text: Column) -> Column:
    """The text and every form of it with one letter left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), cut))


def longest_key(keys: DataFrame, key: str = "key") -> int:
    return keys.agg(F.max(F.length(key))).first()[0] or 0


def prefix_hits(texts: DataFrame, text: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """Every (row of texts, row of keys) where the text begins with the key; adds ``matched`` and ``rest``.

    Null texts and empty or null keys match nothing; the column ``key`` must not be in texts.
    """
    top = longest_key(keys, key)
    heads = texts.withColumn(key, F.explode(prefixes(F.col(text), top)))
    out = join_small(heads, keys.where(F.length(key) > 0), key)
    return out.withColumn("matched", F.length(key)).withColumn("rest", F.substring(F.col(text), F.col("matched") + 1, F.length(text)))


def unguarded(guard: Column, rest: Column) -> Column:
    """False where a guarded key is followed by a digit."""
    return ~(guard.eqNullSafe("nodigit") & rest.rlike("^[0-9]"))


def explains(key: Column, rest: Column) -> Column:
    """Whether what is left looks like numbers, or the key is long enough for anything to follow."""
    return (rest == "") | rest.rlike("^[0-9\\-ー―‐−–—の]") | (F.length(key) >= 3)


def rest_after_kana(text: Column, kana: Column) -> Column:
    """The rest of text after its longest prefix whose reading key is kana; null if there is none."""
    fits = F.filter(F.sequence(F.length(text), F.lit(1), F.lit(-1)), lambda i: kana_key_of_nfkc(F.substring(text, F.lit(1), i)) == kana)
    return F.when(F.size(fits) > 0, F.substring(text, F.get(fits, F.lit(0)) + 1, F.length(text)))


def longest_prefix(texts: DataFrame, ids: list[str], text: str, keys: DataFrame, order: list[Column], key: str = "key", guard: str | None = None) -> DataFrame:
    """The longest key that each text begins with; ties by ``order``."""
    hits = prefix_hits(texts, text, keys, key)
    if guard:
        hits = hits.where(unguarded(F.col(guard), F.col("rest")))
    w = Window.partitionBy(*ids).orderBy(F.desc("matched"), *order)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Scores of a hit by spelling, by reading, and by reading without voicing.
AXES = {"key": 1.0, "kana": 0.9, "loose": 0.7}


def longest_on_axes(texts: DataFrame, ident: str, keys: DataFrame, ord_: str) -> DataFrame:
    """(ident, ord_, axis, score, matched, rest): the entry with the longest hit on any axis; then the better axis, then the smaller ord_.

    texts: ident, key, kana (a reading key or null).  keys: ord_, key, kana (a reading key or null), guard.  An entry is
    compared by its spelling, unless its guard forbids that by its reading, and last by its reading without voicing; ``rest`` is what
    the hit leaves of the text on its axis.  Null and empty texts and keys match nothing.

    No dictionary goes through the driver, whatever its size.  Spellings and readings are searched once each, as distinct values cut at the
    lengths that keys have.
    A reading's entries are passed on as a list, since those that hit by spelling don't count by reading: a text begins with at most one key of
    each length, guarded and not, so of all entries of a reading the first, one more than that, always hold the one that counts.
    """
    t = texts.select(F.col(ident).alias("_id"), F.nullif(F.col("key"), F.lit("")).alias("_key"), F.nullif(F.col("kana"), F.lit("")).alias("_kana"))
    k = keys.select(F.col(ord_).alias("_ord"), F.nullif(F.col("key"), F.lit("")).alias("k_key"), F.nullif(F.col("kana"), F.lit("")).alias("k_kana"), F.when(F.col("guard") == "nodigit", F.col("guard")).alias("guard"))
    long_key, long_kana = k.agg(F.sort_array(F.collect_set(F.length("k_key"))), F.sort_array(F.collect_set(F.length("k_kana")))).first()
    spelt = _by_spelling(t.select("_key").distinct(), k, long_key)
    read = _by_reading(t.select("_kana").distinct(), k, long_kana, 2 * len(long_key) + 1)

    def hits(e: Column) -> Column:
        key = e["k_key"]
        return F.coalesce(F.startswith("_key", key) & unguarded(e["guard"], F.substring(F.col("_key"), F.length(key) + 1, F.length("_key"))), F.lit(False))

    out = t.join(spelt, "_key", "left").join(read, "_kana", "left").withColumn("_r", F.get(F.filter("_entries", lambda e: ~hits(e)), F.lit(0)))
    by_key = F.col("_long").isNotNull() & (F.col("_r").isNull() | (F.col("_long") >= -F.col("_r.shorter")))
    out = out.withColumn("axis", F.when(by_key, "key").when(F.col("_r").isNotNull(), F.when(F.col("_r.loose"), "loose").otherwise("kana"))).where("axis is not null")
    out = out.withColumn("matched", F.when(F.col("axis") == "key", F.col("_long")).otherwise(-F.col("_r.shorter")))
    out = out.withColumn("_text", F.when(F.col("axis") == "key", F.col("_key")).when(F.col("axis") == "kana", F.col("_kana")).otherwise(loosen(F.col("_kana"))))
    score = F.when(F.col("axis") == "key", AXES["key"]).when(F.col("axis") == "kana", AXES["kana"]).otherwise(AXES["loose"])
    rest = F.substring(F.col("_text"), F.col("matched") + 1, F.length("_text"))
    entry = F.when(F.col("axis") == "key", F.col("_first")).otherwise(F.col("_r._ord"))
    return out.select(F.col("_id").alias(ident), entry.alias(ord_), "axis", score.alias("score"), "matched", rest.alias("rest"))


def _heads(text: str, lengths: list[int]) -> Column:
    """The text's prefixes of the given lengths."""
    fit = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(text))
    return F.transform(fit, lambda n: F.substring(F.col(text), F.lit(1), n))


def _by_spelling(texts: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """(_key, _long, _first): the length of the longest key that a text begins with, and its first entry whose guard allows it."""
    held, named = F.col("guard").isNotNull(), keys.where("k_key is not null")
    named = named.groupBy("k_key").agg(F.min(F.when(~held, F.col("_ord"))).alias("_free"), F.min(F.when(held, F.col("_ord"))).alias("_held"), F.max(~held).alias("_any"))
    h = texts.select("_key", F.explode(_heads("_key", lengths)).alias("k_key")).join(named.hint("merge"), "k_key").withColumn("_n", F.length("k_key"))
    digit = F.substring(F.col("_key"), F.col("_n") + 1, F.length("_key")).rlike("^[0-9]")
    h = h.where(F.col("_any") | ~digit).withColumn("_o", F.when(digit, F.col("_free")).otherwise(F.least("_free", "_held")))
    return h.groupBy("_key").agg(F.max("_n").alias("_long"), F.max_by("_o", "_n").alias("_first"))


def _by_reading(texts: DataFrame, keys: DataFrame, lengths: list[int], most: int) -> DataFrame:
    """(_kana, _entries): entries (shorter, loose, last, _ord, k_key, guard) by whose reading a text's reading begins, the best first, up to ``most`` of each reading.

    ``shorter`` is the length below zero, ``last`` puts entries without an ord_ behind the others.
    """
    e = keys.where("k_kana is not null").groupBy("k_kana", "k_key", "guard").agg(F.min("_ord").alias("_ord"))
    w = Window.partitionBy("k_kana").orderBy(F.asc_nulls_last("_ord"))
    e = e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    e = e.groupBy("k_kana").agg(F.collect_list(F.struct("_ord", "k_key", "guard")).alias("_of")).withColumn("_loose", loosen(F.col("k_kana")))
    h = texts.select("_kana", F.explode(_heads("_kana", lengths)).alias("_head")).withColumn("_loose", loosen(F.col("_head"))).join(e.hint("merge"), "_loose")
    shorter, loose = -F.length("_head"), F.col("_head") != F.col("k_kana")
    of = F.transform("_of", lambda x: F.struct(shorter.alias("shorter"), loose.alias("loose"), x["_ord"].isNull().alias("last"), x["_ord"].alias("_ord"), x["k_key"].alias("k_key"), x["guard"].alias("guard")))
    return h.select("_kana", of.alias("_of")).groupBy("_kana").agg(F.sort_array(F.flatten(F.collect_list("_of"))).alias("_entries"))


def fuzzy_prefix(texts: DataFrame, text: str, keys: DataFrame, ord_: str, limit: int | None = 5, key: str = "key", partition: list[str] | None = None, same_first: bool = False) -> DataFrame:
    """Keys one edit away from a prefix of a text, where the text doesn't begin with the key itself.

    Keys of up to three letters and texts whose numbers differ from the key's are left out.  Of prefixes at the same distance the
    longest is consumed.  Adds ``rest``; keeps per text (and ``partition``) the ``limit`` best by key length, then ``ord_``.
    ``same_first`` compares only texts and keys that begin with the same letter.
    """
    by = [text, *(partition or [])]
    keys = keys.where(F.length(key) > 3)
    top = longest_key(keys, key)
    heads = texts.withColumn("_head", F.explode(F.filter(prefixes(F.col(text), top + 1), lambda h: F.length(h) > 2)))
    heads = heads.withColumn("_cut", F.explode(shortened(F.col("_head"))))
    cut = keys.withColumn("_cut", F.explode(shortened(F.col(key))))
    on = ["_cut"]
    if same_first:
        heads, cut = heads.withColumn("_c", F.substring("_head", 1, 1)), cut.withColumn("_c", F.substring(key, 1, 1))
        on.append("_c")
    near = heads.join(cut, on).drop(*on)
    near = near.where(~F.startswith(F.col(text), F.col(key)) & (F.abs(F.length("_head") - F.length(key)) <= 1))
    near = near.where((digit_runs(F.col("_head")) == digit_runs(F.col(key))) & (F.levenshtein("_head", key, 1) == 1))
    best = near.groupBy(*[c for c in near.columns if c != "_head"]).agg(F.max(F.length("_head")).alias("_used"))
    best = best.withColumn("rest", F.substring(F.col(text), F.col("_used") + 1, F.length(text))).drop("_used")
    if limit is None:
        return best
    w = Window.partitionBy(*by).orderBy(F.desc(F.length(key)), ord_)
    return best.withColumn("fuzzy_rank", F.row_number().over(w)).where(F.col("fuzzy_rank") <= limit)
