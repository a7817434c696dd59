"""Readings of a written time as microseconds since 1970-01-01T00:00:00Z.

A spelling is brought into ten parts (kind, three date parts, hour, minute, second, fraction, am/pm, zone) by one
anchored pattern per family of formats. All arithmetic is on integers, so neither the session's time zone nor ANSI mode matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import staged

_ZONE = r"[Zz]|(?:GMT|UTC|UT|gmt|utc)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}"
_TIME = rf"(?:[Tt ] ?(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)? ?([AaPp][Mm])? ?({_ZONE})?)?"
_WEEKDAY = r"(?:[A-Za-z]{3,9},? )?"

YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$"
NUMERIC = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}$"
DAY_NAME_MONTH = rf"^{_WEEKDAY}(\d{{1,2}})[- /]([A-Za-z]{{3,9}})[- /](\d{{4}}|\d{{2}}){_TIME}$"
MONTH_FIRST = rf"^{_WEEKDAY}([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}){_TIME}$"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?({_ZONE})?$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"

# Minutes east of Greenwich of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def tidy(c: Column) -> Column:
    """Without white space of any kind at its ends, and single blanks within."""
    return F.when(c.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$|[\s\p{Z}]{2}|[\t  ]"), F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))).otherwise(c)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _micros(day: Column, clock: Column, offset: Column, zone: Column) -> Column:
    local = day.cast("long") * F.lit(86_400_000_000) + clock
    fixed = local - offset.cast("long") * F.lit(60_000_000)
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))
    return F.when(offset.isNotNull(), fixed).when(zone.isNotNull(), by_zone)


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970, null for a date that does not exist."""
    return F.unix_date(F.concat_ws("-", F.lpad(y, 4, "0"), m, d).try_cast("date"))


def with_readings(df: DataFrame, text: Column, zone: Column, order: Column, prefix: str = "_t") -> DataFrame:
    """df with {prefix}_fmt1, {prefix}_us1 and up to two further readings.

    zone: IANA zone of spellings without one (null: such spellings have no reading). order: dmy, mdy or ymd for
    all-numeric dates; null admits all three. Two-digit years are 20xx; parts not given are zero; a local time that
    occurs twice is its first occurrence and one that never occurs takes the offset in force before the change. Null,
    blank and impossible times have no reading (null fmt1 and us1).
    """
    p = prefix
    s = F.col(f"{p}_s")
    ten = lambda k, *g: k + "|" + "|".join(g)
    full = ("$1", "$2", "$3", "$4", "$5", "$6", "$7", "$8", "$9")
    digits = s.rlike(r"^\d{8,19}$")
    parts = (
        F.when(s.isNull() | (F.length(s) < 6) | (F.length(s) > 64), None)
        .when(s.rlike(YEAR_FIRST), F.regexp_replace(s, YEAR_FIRST, ten("Y", *full)))
        .when(digits, F.concat(F.lit("D|"), s, F.lit("||||||||")))
        .when(s.rlike(NUMERIC), F.regexp_replace(s, NUMERIC, ten("N", *full)))
        .when(s.rlike(DAY_NAME_MONTH), F.regexp_replace(s, DAY_NAME_MONTH, ten("M", *full)))
        .when(s.rlike(MONTH_FIRST), F.regexp_replace(s, MONTH_FIRST, ten("M", "$2", "$1", *full[2:])))
        .when(s.rlike(COMPACT), F.regexp_replace(s, COMPACT, ten("Y", *full[:7], "", "$8")))
    )
    df = staged(df, {f"{p}_s": tidy(text), f"{p}_z0": zone, f"{p}_o0": order})
    df = staged(df, {f"{p}_p": F.split(parts, r"\|")})
    at = lambda i: F.col(f"{p}_p").getItem(i)
    kind = at(0)
    clean = F.upper(at(9))
    number = F.regexp_replace(clean, r"[^0-9]", "")
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    four = F.when(F.length(number) <= 2, F.concat(F.lpad(number, 2, "0"), F.lit("00"))).otherwise(F.lpad(number, 4, "0"))
    hours_off, minutes_off = _int(F.substring(four, 1, 2)), _int(F.substring(four, 3, 2))
    signed = F.when((hours_off <= 18) & (minutes_off < 60), F.when(clean.contains("-"), -1).otherwise(1) * (hours_off * 60 + minutes_off))
    hour, minute, second = (F.when(at(i) == "", 0).otherwise(_int(at(i))) for i in (4, 5, 6))
    half = F.upper(at(8))
    hour = F.when(half == "", F.when(hour < 24, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    clock = F.when((minute < 60) & (second < 60), (hour * 3600 + minute * 60 + second).cast("long") * F.lit(1_000_000) + F.when(at(7) == "", 0).otherwise(_int(F.rpad(F.substring(at(7), 1, 6), 6, "0"))))
    year = F.when(F.length(at(3)) == 2, F.concat(F.lit("20"), at(3))).otherwise(at(3))
    month_at = F.instr(F.lit(_MONTHS), F.lower(F.substring(at(2), 1, 3)))
    named = F.when((month_at % 3) == 1, ((month_at + 2) / 3).cast("int").cast("string"))
    df = staged(
        df,
        {
            f"{p}_k": F.when(clock.isNotNull(), clock),
            f"{p}_off": F.when(clean == "", None).when(number != "", signed).otherwise(known[clean]),
            f"{p}_badzone": (clean != "") & F.when(number == "", known[clean]).otherwise(signed).isNull(),
        },
    )
    k, off = F.col(f"{p}_k"), F.col(f"{p}_off")
    z = F.when(~F.col(f"{p}_badzone"), F.col(f"{p}_z0"))
    o = F.lower(F.col(f"{p}_o0"))
    us = lambda day: _micros(day, k, off, z)
    dmy, mdy = us(_day(year, at(2), at(1))), us(_day(year, at(1), at(2)))
    ymd = F.when(F.length(at(3)) == 2, us(_day(F.concat(F.lit("20"), F.lpad(at(1), 2, "0")), at(2), at(3))))
    raw, n = at(1), F.length(at(1))
    unit = F.when(n == 10, 1_000_000).when(n == 13, 1_000).when(n == 16, 1)
    epoch = raw.try_cast("long") * unit
    sub = lambda a, b: F.substring(raw, a, b)
    run_clock = lambda h, m, s_: F.when((_int(h) < 24) & (_int(m) < 60) & (_int(s_) < 60), (_int(h) * 3600 + _int(m) * 60 + _int(s_)).cast("long") * F.lit(1_000_000))
    zero = F.lit("0")
    run = (
        F.when(n == 14, _micros(_day(sub(1, 4), sub(5, 2), sub(7, 2)), run_clock(sub(9, 2), sub(11, 2), sub(13, 2)), F.lit(None).cast("int"), F.col(f"{p}_z0")))
        .when(n == 12, _micros(_day(sub(1, 4), sub(5, 2), sub(7, 2)), run_clock(sub(9, 2), sub(11, 2), zero), F.lit(None).cast("int"), F.col(f"{p}_z0")))
        .when(n == 8, _micros(_day(sub(1, 4), sub(5, 2), sub(7, 2)), F.lit(0).cast("long"), F.lit(None).cast("int"), F.col(f"{p}_z0")))
        .when(n == 10, _micros(_day(F.concat(F.lit("20"), sub(1, 2)), sub(3, 2), sub(5, 2)), run_clock(sub(7, 2), sub(9, 2), zero), F.lit(None).cast("int"), F.col(f"{p}_z0")))
    )
    numeric, bare = kind == "N", kind == "D"
    free = o.isNull()
    us1 = (
        F.when(kind == "Y", us(_day(at(1), at(2), at(3))))
        .when(numeric, F.when(free | (o == "dmy"), dmy).when(o == "mdy", mdy).otherwise(ymd))
        .when(kind == "M", us(_day(year, named, at(1))))
        .when(bare, F.coalesce(epoch, run))
    )
    fmt1 = F.when(kind == "Y", "year_first").when(numeric, F.coalesce(o, F.lit("dmy"))).when(kind == "M", "named_month").when(bare, F.when(epoch.isNotNull(), "epoch").otherwise("run"))
    us2 = F.when(numeric & free, mdy).when(bare & epoch.isNotNull(), run)
    us3 = F.when(numeric & free, ymd)
    df = staged(df, {f"{p}_us1": us1, f"{p}_us2": us2, f"{p}_us3": us3, f"{p}_f1": fmt1, f"{p}_f2": F.when(numeric, "mdy").otherwise("run"), f"{p}_f3": F.lit("ymd")})
    return df.drop(*[f"{p}_{x}" for x in ("s", "z0", "o0", "p", "k", "off", "badzone")])
