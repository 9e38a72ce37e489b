"""azanami: address resolution, gazetteer building and table cleaning as Spark DataFrame plans."""

from azanami.functions.geo import haversine_m
from azanami.functions.names import PREFECTURES, expand_aliases
from azanami.functions.text import normalize_banchi, to_kana_key, to_kana_loose_key, to_key
from azanami.plans.directory import resolve_prefs
from azanami.plans.engine import GeoEngine, Tables

__all__ = ["PREFECTURES", "GeoEngine", "Tables", "expand_aliases", "haversine_m", "normalize_banchi", "resolve_prefs", "to_kana_key", "to_kana_loose_key", "to_key"]
__version__ = "0.2.0"
