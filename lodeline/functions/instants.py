"""Timestamps written in many ways, read as one UTC instant; Catalyst expressions throughout.

A text is recognised by its form once, rewritten to one field list, and only then turned into numbers, so a value
costs a few regular expressions and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n\f\u000b 　﻿"
MONTHS = (
    # fixed values: month names, English, German, French, Spanish, Portuguese, Italian
    ("january", "januar", "jänner", "janvier", "enero", "janeiro", "gennaio", "jan", "janv", "ene", "gen"),
    ("february", "februar", "février", "febrero", "fevereiro", "febbraio", "feb", "févr", "fev"),
    ("march", "märz", "mars", "marzo", "março", "mar", "mär", "mrz"),
    ("april", "avril", "abril", "aprile", "apr", "avr", "abr"),
    ("may", "mai", "mayo", "maio", "maggio", "mag"),
    ("june", "juni", "juin", "junio", "junho", "giugno", "jun", "giu"),
    ("july", "juli", "juillet", "julio", "julho", "luglio", "jul", "juil", "lug"),
    ("august", "août", "agosto", "aug", "ago"),
    ("september", "septembre", "septiembre", "setembro", "settembre", "sep", "sept", "set"),
    ("october", "oktober", "octobre", "octubre", "outubro", "ottobre", "oct", "okt", "out", "ott"),
    ("november", "novembre", "noviembre", "novembro", "nov"),
    ("december", "dezember", "décembre", "diciembre", "dezembro", "dicembre", "dec", "dez", "déc", "dic"),
)
ABBREVIATIONS = {
    # fixed values: usual meanings of zone abbreviations, minutes east of UTC
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180,
    "SAST": 120, "MSK": 180, "PKT": 300, "IST": 330, "NPT": 345, "ICT": 420, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570,
    "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"(?: ?(Z|z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z][A-Za-z_]*(?:/[A-Za-z_+-]+\d*)*|\[[A-Za-z_/+-]+\d*\]))?"
_WORD = r"(\p{L}{3,12})\.?"
#: form -> (pattern, fields). Fields: y m d h mi s frac ampm zone order; order says how to read m and d.
FORMS = {
    "iso": (rf"^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]| +){_TIME}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|ymd"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|ymd"),
    "daymonth": (rf"^(?:\p{{L}}{{2,10}}\.?,? )?(\d{{1,2}})(?:\.|er|º)?(?:[ /-]|\. ?){_WORD}(?:[ /-])(\d{{4}}|\d{{2}})(?:,? {_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|name"),
    "monthday": (rf"^(?:\p{{L}}{{2,10}}\.?,? )?{_WORD} (\d{{1,2}}),? (\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|name"),
    "ctime": (rf"^\p{{L}}{{2,10}} {_WORD} +(\d{{1,2}}) {_TIME} (\d{{4}}){_ZONE}$", "$8|$1|$2|$3|$4|$5|$6|$7|$9|name"),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|ymd"),
    "numeric": (rf"^(\d{{1,2}})([/-])(\d{{1,2}})\2(\d{{4}})(?:,? {_TIME}{_ZONE})?$", "$4|$1|$3|$5|$6|$7|$8|$9|$10|site"),
    "epoch": (r"^([+-]?\d{1,20})(?:\.(\d+))?(?: (Z|UTC|[+-]\d{2}:?\d{2}))?$", "$1||||||$2|||epoch"),
}


def fields_of(text: Column) -> Column:
    """The field list ``y|m|d|h|mi|s|frac|ampm|zone|order`` of a text, null if it has no known form."""
    clean = F.btrim(text, F.lit(BLANK))
    out = None
    for pattern, layout in FORMS.values():
        hit = clean.rlike(pattern)
        value = F.regexp_replace(clean, F.lit(pattern), F.lit(layout))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _table(pairs: dict[str, int]) -> Column:
    """A lookup table that is one literal in the plan, however many entries it has."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in pairs.items())), F.lit(","), F.lit(":"))


def _month(name: Column) -> Column:
    table = _table({n: i for i, names in enumerate(MONTHS, 1) for n in names})
    return F.try_element_at(table, F.lower(name)).try_cast("int")


def _int(part: Column) -> Column:
    return F.when(part != "", part).try_cast("int")


def split_fields(fields: Column) -> Column:
    return F.split(fields, r"\|", -1)


def local_parts(p: Column, date_order: Column) -> tuple[Column, Column, Column]:
    """(local, zone, epoch): the wall-clock microseconds as if in UTC, the zone text, and microseconds of bare numbers.

    ``p`` is the split field list, as a column of its own, so that it is split once.
    """
    at = lambda i: F.get(p, F.lit(i))
    order = at(9)
    first, second = _int(at(1)), _int(at(2))
    swapped = (order == "site") & (F.coalesce(date_order, F.lit("dmy")) != "mdy")
    month = F.when(order == "name", _month(at(1))).when(swapped, second).otherwise(first)
    day = F.when(swapped, first).otherwise(second)
    year = F.when((F.length(at(0)) == 2), _int(at(0)) + 2000).otherwise(_int(at(0)))
    hour, half = F.coalesce(_int(at(3)), F.lit(0)), F.lower(at(7))
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), None).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second_ = F.coalesce(_int(at(4)), F.lit(0)), F.coalesce(_int(at(5)), F.lit(0))
    micros = F.rpad(F.substring(at(6), 1, 6), 6, "0").try_cast("long")
    real = (year >= 1) & (hour < 24) & (minute < 60) & (second_ < 60) & (month >= 1) & (month <= 12) & (day >= 1)
    stamp = F.try_make_timestamp_ltz(F.when(real, year), month, day, hour, minute, second_.cast("decimal(16,6)"), F.lit("UTC"))
    local = F.unix_micros(stamp) + F.coalesce(micros, F.lit(0))
    number, digits = at(0).try_cast("decimal(20,0)"), F.length(F.regexp_replace(at(0), F.lit("^[+-]?0*"), F.lit("")))
    scaled = (
        F.when(digits <= 11, number * 1000000 + F.coalesce(micros, F.lit(0)) * F.when(at(0).startswith("-"), -1).otherwise(1))
        .when(digits <= 14, number * 1000)
        .when(digits <= 17, number)
        .otherwise(F.floor(number / 1000))
    )
    return F.when(order != "epoch", local), F.regexp_replace(at(8), F.lit(r"[\[\]]"), F.lit("")), F.when(order == "epoch", scaled.try_cast("long"))


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC that a zone text fixes by itself; null for named regions and unknown words."""
    sign = F.when(F.regexp_extract(zone, r"([+-])\d{2}:?(?:\d{2})?$", 1) == "-", -1).otherwise(1)
    hours = _int(F.regexp_extract(zone, r"^(?:UTC|GMT)?[+-](\d{2})", 1))
    minutes = F.coalesce(_int(F.regexp_extract(zone, r"[+-]\d{2}:?(\d{2})$", 1)), F.lit(0))
    fixed = F.try_element_at(_table(ABBREVIATIONS), F.upper(zone)).try_cast("int")
    return F.when(zone.rlike(r"[+-]\d{2}"), F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))).otherwise(fixed)


def is_region(zone: Column, regions: list[str]) -> Column:
    """Whether a text is the name of a region; the names are one literal in the plan."""
    return zone.contains("/") & (F.find_in_set(zone, F.lit(",".join(regions))) > 0)


def utc_micros(local: Column, zone: Column, minutes: Column, regions: list[str]) -> Column:
    """Microseconds of a wall-clock time in a zone, ``minutes`` being its fixed offset if it has one; null if the zone is unknown.

    A time the clock showed twice or skipped has the offset in force before the change.
    """
    named = is_region(zone, regions)
    in_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.when(named, zone).otherwise("UTC")))
    return F.when(minutes.isNotNull(), local - minutes.cast("long") * 60_000_000).when(named, in_region)


def known_regions(spark) -> list[str]:
    """Region names that this JVM's zone database has."""
    names = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(n for n in map(str, names) if "/" in n and not n.startswith("SystemV"))
