"""Coordinates, addresses of machines and files, and small closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.units import _lookup

# Patterns of address-like types, and words of closed vocabularies.
_HEX = "[0-9a-f]{1,4}"
PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "url": r"(?i)^((https?|ftp)://[^\s/?#]+[^\s]*|www\.[^\s]+\.[a-z]{2,}[^\s]*|localhost(:\d+)?(/\S*)?|[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|org|net|edu|gov|io|co|in|uk|de|fr|info|biz|dev|app|ai)(:\d+)?(/\S*)?)$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)(/([12]?\d|3[0-2]))?$",
    "ipv6": rf"(?i)^(({_HEX}:){{7}}{_HEX}|({_HEX}:){{1,7}}:|:(:{_HEX}){{1,7}}|({_HEX}:){{1,6}}:{_HEX}|({_HEX}:){{1,5}}(:{_HEX}){{2}}|({_HEX}:){{1,4}}(:{_HEX}){{3}}|({_HEX}:){{1,3}}(:{_HEX}){{4}}|({_HEX}:){{1,2}}(:{_HEX}){{5}}|{_HEX}:(:{_HEX}){{6}}|::)$",
    "mac": r"(?i)^(([0-9a-f]{2}[:-]){5}[0-9a-f]{2}|([0-9a-f]{4}\.){2}[0-9a-f]{4}|(?=.*[a-f])(?=.*\d)[0-9a-f]{12})$",
    "path": r"^([A-Za-z]:[\\/][^<>:\"|?*\n]*|\\\\[^\\\s]+\\\S+|/([^/\x00\s]+/)*[^/\x00\s]+|~/\S+|\.{1,2}[\\/]\S+|%\w+%[\\/]\S*|\$\{?\w+\}?/\S*)$",
    "file": r"(?i)^[^/\\\s]+\.(csv|tsv|xlsx?|json|xml|parquet|txt|md|pdf|docx?|pptx?|png|jpe?g|gif|svg|mp[34]|wav|zip|gz|tar|py|js|ts|html?|css|sql|java|c|cpp|go|rs|sh)$",
    "version": r"(?i)^v?\d+\.\d+(\.\d+){0,2}([-+.]?(alpha|beta|rc|build|dev|final)[-.]?\d*)?$",
    "timezone": r"^((UTC|GMT)([+-]\d{1,2}(:?\d{2})?)?|[A-Z][A-Za-z]+/[A-Z][A-Za-z_]+)$",
}
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1", "on", "active", "enabled"), ("false", "f", "no", "n", "0", "off", "inactive", "disabled")
GENDER = {"m": "male", "male": "male", "man": "male", "boy": "male", "f": "female", "female": "female", "woman": "female", "girl": "female", "transgender": "transgender", "trans": "transgender", "other": "other", "non-binary": "other", "nonbinary": "other"}


def is_a(kind: str, c: Column) -> Column:
    return F.trim(c).rlike(PATTERNS[kind])


def kept_if(kind: str, c: Column) -> Column:
    """The trimmed value if it is of that kind: addresses, paths, versions and time zones are checked and stay as they are."""
    return F.when(is_a(kind, c), F.trim(c))


def network_address(c: Column) -> Column:
    return F.when(is_a("ipv4", c) | is_a("ipv6", c) | is_a("mac", c), F.trim(c))


def boolean_of(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def email_of(c: Column) -> Column:
    return F.when(is_a("email", c), F.lower(F.trim(c)))


def gender_of(c: Column) -> Column:
    return _lookup(GENDER, F.lower(F.trim(c)))


def boolean_share(c: Column) -> Column:
    """Aggregate: 1.0 if all values are true or false words of at most two kinds and both sides occur, 0.3 for one side, else 0."""
    low = F.lower(F.trim(c))
    known = F.bool_and(low.isin(*TRUE_WORDS, *FALSE_WORDS))
    both = F.bool_or(low.isin(*TRUE_WORDS)) & F.bool_or(low.isin(*FALSE_WORDS))
    return F.when(known & (F.count_distinct(low) <= 2), F.when(both, 1.0).otherwise(0.3)).otherwise(0.0)


DMS = r"""^\s*(\d{1,3})[°\s]\s*(\d{1,2})['′\s]\s*(\d{1,2}(?:\.\d+)?)["″]?\s*([NSEWnsew])?\s*$"""
DEGREES = r"^\s*([+-]?\d{1,3}(?:\.\d+)?)\s*°?\s*([NSEWnsew])?\s*$"


def coordinate(c: Column, limit: int) -> Column:
    """Decimal degrees (six digits) of decimal or degree-minute-second forms, negative for S and W; null beyond ``limit``."""
    dms = F.regexp_extract(c, DMS, 1).cast("double") + F.regexp_extract(c, DMS, 2).cast("double") / 60 + F.regexp_extract(c, DMS, 3).cast("double") / 3600
    side = F.upper(F.when(c.rlike(DEGREES), F.regexp_extract(c, DEGREES, 2)).otherwise(F.regexp_extract(c, DMS, 4)))
    value = F.when(c.rlike(DEGREES), F.regexp_extract(c, DEGREES, 1).cast("double")).when(c.rlike(DMS), dms)
    value = F.bround(F.when(side.isin("S", "W"), -F.abs(value)).otherwise(value), 6)
    return F.when(F.abs(value) <= limit, value)


def latitude(c: Column) -> Column:
    return coordinate(c, 90)


def longitude(c: Column) -> Column:
    return coordinate(c, 180)


def geo_pair(c: Column) -> Column:
    """latitude and longitude of ``lat, lon`` (also ``;`` or ``|`` between)."""
    parts = F.split(F.regexp_replace(c, r"[()\[\]]", ""), r"\s*[,;|]\s*")
    lat, lon = latitude(F.get(parts, F.lit(0))), longitude(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("latitude"), lon.alias("longitude")))
