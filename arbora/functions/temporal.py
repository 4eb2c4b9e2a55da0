"""Temporal values: constructors, accessors, arithmetic, truncation, differences.

Dates, local and zoned date-times are Spark's DATE, TIMESTAMP_NTZ and TIMESTAMP
(microseconds, the session's zone); times and durations are structs of integers,
so that the four parts of a duration stay apart.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans import values as v
from arbora.plans.lower import CypherError, Rows, Val

FUNCTIONS: dict = {}
LONG = T.LongType()
#: Days of a mean Gregorian month and nanoseconds of a second.
MONTH_DAYS = 30.436875
NANO = 1_000_000_000


def is_temporal(t) -> bool:
    return v.is_instant(t) or v.is_duration(t) or v.is_time(t)


def duration(months, days, seconds, nanos) -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(n) if not isinstance(x, Column) else x.cast("long").alias(n) for n, x in zip(("months", "days", "seconds", "nanos"), (months, days, seconds, nanos), strict=True)])


def _when_all(cols: list[Column], out: Column) -> Column:
    test = None
    for c in cols:
        test = c.isNotNull() if test is None else test & c.isNotNull()
    return F.when(test, out) if test is not None else out


# constructors ------------------------------------------------------------------------
def parse_date(s: str) -> dt.date:
    """A date in any of the ISO forms: year, month, calendar, week or ordinal date, with or without dashes."""
    for pattern, make in (
        (r"(\d{4})", lambda y: dt.date(y, 1, 1)), (r"(\d{4})-?(\d{2})-?(\d{2})", dt.date), (r"(\d{4})-(\d{2})", lambda y, m: dt.date(y, m, 1)), (r"(\d{4})(\d{2})", lambda y, m: dt.date(y, m, 1)),
        (r"(\d{4})-?W(\d{2})-?(\d)", dt.date.fromisocalendar), (r"(\d{4})-?W(\d{2})", lambda y, w: dt.date.fromisocalendar(y, w, 1)),
        (r"(\d{4})-?(\d{3})", lambda y, n: dt.date(y, 1, 1) + dt.timedelta(n - 1)), (r"(\d{4})-?Q(\d)-?(\d{2})", lambda y, q, n: dt.date(y, 3 * q - 2, 1) + dt.timedelta(n - 1)),
    ):
        if m := re.fullmatch(pattern, s):
            return make(*map(int, m.groups()))
    raise CypherError(f"{s!r} is no date")


def parse_time(s: str) -> tuple[int, int | None]:
    """(nanoseconds of the day, offset in seconds or None)."""
    m = re.fullmatch(r"(\d{2}):?(\d{2})?:?(\d{2})?(?:\.(\d{1,9}))?(Z|[+-]\d{2}:?(?:\d{2})?)?(?:\[.*\])?", s)
    if not m:
        raise CypherError(f"{s!r} is no time")
    h, mi, sec, frac, zone = m.groups()
    nanos = (int(h) * 3600 + int(mi or 0) * 60 + int(sec or 0)) * NANO + int((frac or "0").ljust(9, "0"))
    offset = None
    if zone:
        digits = zone[1:].replace(":", "") if zone != "Z" else "0000"
        offset = (int(digits[:2]) * 3600 + int(digits[2:4] or 0) * 60) * (-1 if zone[0] == "-" else 1)
    return nanos, offset


def parse_duration(s: str) -> tuple[int, int, int, int]:
    m = re.fullmatch(r"(-?)P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?", s)
    if not m or s in ("P", "-P"):
        raise CypherError(f"{s!r} is no duration")
    sign = -1 if m[1] else 1
    y, mo, w, d, h, mi, sec = (sign * float(x) if x else 0.0 for x in m.groups()[1:])
    return cascade(y * 12 + mo, w * 7 + d, h * 3600 + mi * 60 + sec)


def cascade(months: float, days: float, seconds: float, nanos: float = 0) -> tuple[int, int, int, int]:
    """Whole parts, with the fraction of a month carried to days and of a day to seconds."""
    m = int(months)
    days += (months - m) * MONTH_DAYS
    d = int(days)
    seconds += (days - d) * 86400
    s = int(seconds)
    n = round((seconds - s) * NANO + nanos)
    return m, d, s + int(n / NANO), int(n - int(n / NANO) * NANO)


def _text_of(x: Val):
    n = x.node
    return n[1] if n is not None and n[0] == "lit" and isinstance(n[1], str) else x.rows.params.get(n[1]) if n is not None and n[0] == "param" and isinstance(x.rows.params.get(n[1]), str) else None


def _map_date(c: Column, fields: list[str], base: Column | None) -> Column:
    get = lambda n, other: c[n].cast("int") if n in fields else other
    year = get("year", F.year(base) if base is not None else None)
    if year is None:
        raise CypherError("a date needs a year")
    if "week" in fields:
        jan4 = F.make_date(year, F.lit(1), F.lit(4))
        monday = F.date_sub(jan4, F.weekday(jan4))
        return F.date_add(monday, (c["week"].cast("int") - 1) * 7 + get("dayOfWeek", F.lit(1)) - 1)
    if "ordinalDay" in fields:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), c["ordinalDay"].cast("int") - 1)
    if "quarter" in fields:
        return F.date_add(F.make_date(year, c["quarter"].cast("int") * 3 - 2, F.lit(1)), get("dayOfQuarter", F.lit(1)) - 1)
    return F.make_date(year, get("month", F.month(base) if base is not None else F.lit(1)), get("day", F.dayofmonth(base) if base is not None else F.lit(1)))


def _map_nanos(c: Column, fields: list[str], base: Column | None) -> Column:
    out = base if base is not None else F.lit(0).cast("long")
    if base is not None and not set(fields) & {"hour", "minute", "second"}:
        pass
    else:
        out = F.lit(0).cast("long")
    for n, k in (("hour", 3600 * NANO), ("minute", 60 * NANO), ("second", NANO), ("millisecond", 1_000_000), ("microsecond", 1000), ("nanosecond", 1)):
        if n in fields:
            out = out + c[n].cast("long") * k
    return out


def _nanos_of(x: Column, t) -> Column:
    if v.is_time(t):
        return x["nano_of_day"]
    if isinstance(t, T.DateType):
        return F.lit(0).cast("long")
    return (F.hour(x) * 3600 + F.minute(x) * 60).cast("long") * NANO + (F.date_format(x, "s.SSSSSS").cast("decimal(9,6)") * NANO).cast("long")


def _at(date: Column, nanos: Column) -> Column:
    """Local date-time of a date and nanoseconds of the day."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (nanos / NANO).cast("decimal(18,6)"))


def _construct(kind: str):
    def f(rows: Rows, a: list[Val]) -> Val:
        if not a:
            now = F.current_timestamp()
            local = now.cast("timestamp_ntz")
            return Val({"date": F.current_date(), "datetime": now, "localdatetime": local}.get(kind, F.struct(*_time_fields(_nanos_of(now, T.TimestampType()), kind))), rows)
        x = a[0]
        t = x.type
        if v.is_null(t):
            return x
        s = _text_of(x)
        if s is not None:
            return Val(_literal(kind, s), rows)
        if v.is_string(t):
            if kind in ("time", "localtime"):
                at = F.to_timestamp(F.concat(F.lit("1970-01-01T"), x.col))
                return Val(F.when(x.col.isNotNull(), F.struct(*_time_fields(_nanos_of(at, T.TimestampType()), kind))), rows)
            return Val(x.col.cast({"date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz"}[kind]), rows)
        if v.is_instant(t) or v.is_time(t):
            if kind in ("time", "localtime"):
                offset = x.col["offset_s"] if v.is_time(t) and "offset_s" in t.names else 0
                return Val(F.when(x.col.isNotNull(), F.struct(*_time_fields(_nanos_of(x.col, t), kind, offset))), rows)
            return Val(x.col.cast({"date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz"}[kind]), rows)
        if isinstance(t, T.StructType):
            fields = t.fieldNames()
            based = next((n for n in ("datetime", "date") if n in fields), None)
            day_of = x.col[based].cast("date") if based else None
            clock = next((n for n in ("datetime", "time") if n in fields), None)
            nanos = _map_nanos(x.col, fields, _nanos_of(x.col[clock], t[clock].dataType) if clock else None)
            if "epochSeconds" in fields or "epochMillis" in fields:
                ms = x.col["epochMillis"] if "epochMillis" in fields else x.col["epochSeconds"] * 1000
                return Val(F.timestamp_millis(ms), rows)
            parts = [x.col[n] for n in fields if n != "timezone"]
            if kind in ("time", "localtime"):
                offset = offset_of(x.col["timezone"]) if "timezone" in fields else x.col[clock]["offset_s"] if clock and "offset_s" in (t[clock].dataType.names if v.is_time(t[clock].dataType) else ()) else 0
                return Val(_when_all(parts, F.struct(*_time_fields(nanos, kind, offset))), rows)
            date = _map_date(x.col, fields, day_of)
            if kind == "date":
                return Val(date, rows)
            at = _at(date, nanos)
            if kind == "datetime":
                at = F.to_utc_timestamp(at.cast("timestamp"), x.col["timezone"]) if "timezone" in fields else at.cast("timestamp")
            return Val(_when_all(parts, at), rows)
        raise CypherError(f"{kind} cannot be made of this value")

    return f


def _time_fields(nanos: Column, kind: str, offset: int | Column = 0) -> list[Column]:
    out = [nanos.cast("long").alias("nano_of_day")]
    return out if kind == "localtime" else [*out, (offset if isinstance(offset, Column) else F.lit(offset)).cast("int").alias("offset_s")]


def offset_of(zone: Column) -> Column:
    """Seconds of an offset that is given as text; a zone's name has no offset without a day."""
    form = r"^([+-])(\d{2}):?(\d{2})(?::?(\d{2}))?$"
    part = lambda i: F.coalesce(F.regexp_extract(zone, form, i).try_cast("int"), F.lit(0))
    far = part(2) * 3600 + part(3) * 60 + part(4)
    wrong = F.raise_error(F.concat(F.lit("a time needs an offset like +01:00, not "), zone)).cast("int")
    return F.when(F.upper(zone) == "Z", F.lit(0)).when(zone.rlike(form), F.when(F.regexp_extract(zone, form, 1) == "-", -far).otherwise(far)).when(zone.isNotNull(), wrong)


def _literal(kind: str, s: str) -> Column:
    if kind == "date":
        return F.lit(parse_date(s.partition("T")[0]))
    if kind in ("time", "localtime"):
        nanos, offset = parse_time(s.rpartition("T")[2])
        return F.struct(*_time_fields(F.lit(nanos), kind, offset or 0))
    day, _, clock = s.partition("T")
    nanos, offset = parse_time(clock) if clock else (0, None)
    zone = re.search(r"\[(.+)\]", s)
    at = dt.datetime.combine(parse_date(day), dt.time()) + dt.timedelta(microseconds=nanos // 1000)
    if kind == "localdatetime":
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    if offset is None and zone:
        return F.to_utc_timestamp(F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp"), F.lit(zone[1]))
    return F.lit((at - dt.timedelta(seconds=offset or 0)).isoformat(sep=" ") + "+00:00").cast("timestamp")


for _kind in ("date", "datetime", "localdatetime", "time", "localtime"):
    FUNCTIONS[_kind] = _construct(_kind)
    for _clock in ("transaction", "statement", "realtime"):
        FUNCTIONS[f"{_kind}.{_clock}"] = lambda rows, a, k=_kind: FUNCTIONS[k](rows, [])
FUNCTIONS["datetime.fromepoch"] = lambda rows, a: Val(F.timestamp_micros(a[0].col * 1_000_000 + (F.call_function("div", a[1].col, F.lit(1000).cast("long")) if len(a) > 1 else F.lit(0))), rows)
FUNCTIONS["datetime.fromepochmillis"] = lambda rows, a: Val(F.timestamp_millis(a[0].col), rows)


def _duration(rows: Rows, a: list[Val]) -> Val:
    s = _text_of(a[0])
    if s is not None:
        return Val(duration(*parse_duration(s)), rows, kind=v.DURATION)
    if v.is_duration(a[0].type) or v.is_null(a[0].type):
        return a[0]
    if not isinstance(a[0].type, T.StructType):
        raise CypherError("duration needs a map or a text")
    c, fields = a[0].col, a[0].type.fieldNames()
    part = lambda n: c[n].cast("double") if n in fields else F.lit(0.0)
    months = part("years") * 12 + part("quarters") * 3 + part("months")
    days = part("weeks") * 7 + part("days")
    seconds = part("hours") * 3600 + part("minutes") * 60 + part("seconds")
    nanos = part("milliseconds") * 1e6 + part("microseconds") * 1e3 + part("nanoseconds")
    return Val(_when_all([c[n] for n in fields], _cascaded(months, days, seconds, nanos)), rows, kind=v.DURATION)


def _whole(x: Column) -> Column:
    return x.cast("long")


def _cascaded(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    m = _whole(months)
    days = days + (months - m) * MONTH_DAYS
    d = _whole(days)
    seconds = seconds + (days - d) * 86400
    s = _whole(seconds)
    n = F.round((seconds - s) * NANO + nanos).cast("long")
    return duration(m, d, s + F.call_function("div", n, F.lit(NANO).cast("long")), n % NANO)


FUNCTIONS["duration"] = _duration


# text -----------------------------------------------------------------------------------
def offset_text(seconds: Column) -> Column:
    """An offset as Z, ±HH:MM or ±HH:MM:SS."""
    far = F.abs(seconds)
    part = lambda k, n: F.floor(far / k).cast("int") % n
    out = F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%02d:%02d", part(3600, 100), part(60, 60)), F.when(far % 60 != 0, F.format_string(":%02d", part(1, 60))).otherwise(F.lit("")))
    return F.when(seconds == 0, F.lit("Z")).otherwise(out)


def text(x: Val) -> Column:
    c, t = x.col, x.type
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        out = F.regexp_replace(out, r"(T\d\d:\d\d):00$", "$1")
        return F.concat(out, F.lit("Z")) if isinstance(t, T.TimestampType) else out
    if v.is_time(t):
        n = c["nano_of_day"]
        div = lambda a, k: F.call_function("div", a, F.lit(k).cast("long"))
        hms = F.format_string("%02d:%02d", div(n, 3600 * NANO), div(n, 60 * NANO) % 60)
        sec, frac = div(n, NANO) % 60, n % NANO
        out = F.concat(hms, F.when((sec > 0) | (frac > 0), F.format_string(":%02d", sec)).otherwise(F.lit("")), F.when(frac > 0, F.regexp_replace(F.format_string(".%09d", frac), "0+$", "")).otherwise(F.lit("")))
        return F.concat(out, offset_text(c["offset_s"])) if "offset_s" in t.fieldNames() else out
    months, days, s, nanos = (c[k] for k in ("months", "days", "seconds", "nanos"))
    div = lambda a, k: F.call_function("div", a, F.lit(k).cast("long"))
    some = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    date = F.concat(some(div(months, 12), "Y"), some(months % 12, "M"), some(days, "D"))
    second = F.when(nanos == 0, (s % 60).cast("string")).otherwise(F.regexp_replace(((s % 60) + nanos / NANO).cast("decimal(18,9)").cast("string"), "0+$", ""))
    clock = F.concat(some(div(s, 3600), "H"), some(div(s, 60) % 60, "M"), F.when((s % 60 != 0) | (nanos != 0), F.concat(second, F.lit("S"))).otherwise(F.lit("")))
    out = F.concat(F.lit("P"), date, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(F.lit("")))
    return F.when(out == "P", F.lit("PT0S")).otherwise(out)


# accessors ------------------------------------------------------------------------------
def accessor(rows: Rows, x: Val, key: str) -> Val:
    c, t = x.col, x.type
    long = lambda y: Val(y.cast("long"), rows, kind=LONG)
    if v.is_point(t):
        fields = {"x": "x", "y": "y", "z": "z", "longitude": "x", "latitude": "y", "height": "z"}
        if key in fields:
            return Val(c[fields[key]], rows, kind=T.DoubleType())
        if key == "srid":
            return long(c["srid"])
        if key == "crs":
            out = F.when(c["srid"] == 7203, F.lit("cartesian")).when(c["srid"] == 9157, F.lit("cartesian-3d")).when(c["srid"] == 4326, F.lit("wgs-84")).otherwise(F.lit("wgs-84-3d"))
            return Val(F.when(c.isNotNull(), out), rows, kind=T.StringType())
    elif v.is_duration(t):
        m, d, s, n = (c[k] for k in ("months", "days", "seconds", "nanos"))
        div = lambda a, k: F.call_function("div", a, F.lit(k).cast("long"))
        table = {
            "years": div(m, 12), "quarters": div(m, 3), "months": m, "quartersOfYear": div(m % 12, 3), "monthsOfYear": m % 12, "monthsOfQuarter": m % 3, "weeks": div(d, 7), "days": d, "daysOfWeek": d % 7,
            "hours": div(s, 3600), "minutes": div(s, 60), "seconds": s, "minutesOfHour": div(s, 60) % 60, "secondsOfMinute": s % 60, "milliseconds": s * 1000 + div(n, 1_000_000), "microseconds": s * 1_000_000 + div(n, 1000),
            "nanoseconds": s * NANO + n, "millisecondsOfSecond": div(n, 1_000_000), "microsecondsOfSecond": div(n, 1000), "nanosecondsOfSecond": n,
        }
        if key in table:
            return long(table[key])
    else:
        dated = v.is_instant(t)
        if dated:
            quarter_start = F.trunc(c, "quarter")
            table = {
                "year": lambda: F.year(c), "month": lambda: F.month(c), "day": lambda: F.dayofmonth(c), "week": lambda: F.weekofyear(c), "weekYear": lambda: F.extract(F.lit("YEAROFWEEK"), c),
                "dayOfWeek": lambda: F.weekday(c) + 1, "weekDay": lambda: F.weekday(c) + 1, "dayOfYear": lambda: F.dayofyear(c), "ordinalDay": lambda: F.dayofyear(c), "quarter": lambda: F.quarter(c),
                "dayOfQuarter": lambda: F.datediff(c, quarter_start) + 1, "epochSeconds": lambda: F.unix_seconds(c.cast("timestamp")), "epochMillis": lambda: F.unix_millis(c.cast("timestamp")),
            }
            if key in table:
                return long(table[key]())
        if not isinstance(t, T.DateType):
            n = _nanos_of(c, t)
            div = lambda a, k: F.call_function("div", a, F.lit(k).cast("long"))
            table = {"hour": div(n, 3600 * NANO), "minute": div(n, 60 * NANO) % 60, "second": div(n, NANO) % 60, "millisecond": div(n, 1_000_000) % 1000, "microsecond": div(n, 1000) % 1_000_000, "nanosecond": n % NANO}
            if key in table:
                return long(table[key])
            zoned = isinstance(t, T.TimestampType) or (v.is_time(t) and "offset_s" in t.fieldNames())
            if zoned:
                far = c["offset_s"] if v.is_time(t) else F.when(c.isNotNull(), F.lit(0))
                if key in ("timezone", "offset"):
                    return Val(F.when(c.isNotNull(), offset_text(far)), rows, kind=T.StringType())
                if key in ("offsetMinutes", "offsetSeconds"):
                    return long(F.call_function("div", far, F.lit(60)) if key == "offsetMinutes" else far)
    raise CypherError(f"there is no part {key} of this value")


# arithmetic -----------------------------------------------------------------------------
def scaled(rows: Rows, x: Val, k: Column) -> Val:
    part = lambda n: x.col[n].cast("double") * k.cast("double")
    return Val(F.when(x.col.isNotNull() & k.isNotNull(), _cascaded(part("months"), part("days"), part("seconds"), part("nanos"))), rows, kind=v.DURATION)


def arithmetic(rows: Rows, op: str, a: Val, b: Val) -> Val:
    ta, tb = a.type, b.type
    if v.is_null(ta) or v.is_null(tb):
        return Val(F.lit(None), rows, kind=T.NullType())
    if v.is_duration(ta) and v.is_duration(tb) and op in "+-":
        sign = 1 if op == "+" else -1
        n = a.col["nanos"] + b.col["nanos"] * sign
        div = F.call_function("div", n, F.lit(NANO).cast("long"))
        out = duration(*[a.col[k] + b.col[k] * sign for k in ("months", "days")], a.col["seconds"] + b.col["seconds"] * sign + div, n % NANO)
        return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), out), rows, kind=v.DURATION)
    if v.is_duration(ta) and v.is_number(tb) and op in "*/":
        return scaled(rows, a, b.col if op == "*" else F.lit(1.0) / b.col.cast("double"))
    if v.is_number(ta) and v.is_duration(tb) and op == "*":
        return scaled(rows, b, a.col)
    if v.is_duration(ta) and op == "+":
        a, b, ta, tb = b, a, tb, ta
    if v.is_duration(tb) and op in "+-":
        s = 1 if op == "+" else -1
        d = b.col
        if v.is_time(ta):
            day = 86400 * NANO
            n = a.col["nano_of_day"] + ((d["seconds"] % 86400) * NANO + d["nanos"]) * s
            fields = [((n % day + day) % day).alias("nano_of_day")] + ([a.col["offset_s"].alias("offset_s")] if "offset_s" in ta.fieldNames() else [])
            return Val(F.when(a.col.isNotNull() & d.isNotNull(), F.struct(*fields)), rows, kind=ta)
        if isinstance(ta, T.DateType):
            whole = F.call_function("div", d["seconds"], F.lit(86400).cast("long"))
            return Val(F.date_add(F.add_months(a.col, (d["months"] * s).cast("int")), ((d["days"] + whole) * s).cast("int")), rows, kind=ta)
        moved = F.add_months(a.col.cast("date"), (d["months"] * s).cast("int"))
        moved = F.date_add(moved, (d["days"] * s).cast("int"))
        clock = _nanos_of(a.col, ta) + (d["seconds"] * NANO + d["nanos"]) * s
        return Val(_at(moved, clock).cast(ta), rows, kind=ta)
    if v.is_instant(ta) and v.is_instant(tb) and op == "-":
        return between(rows, b, a)
    raise CypherError(f"{op} does not apply to these values")


# differences ----------------------------------------------------------------------------
def _local(x: Val) -> Column:
    return x.col.cast("timestamp_ntz")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def between(rows: Rows, a: Val, b: Val) -> Val:
    """Whole months first, then whole days, then the rest of the time."""
    if v.is_time(a.type) or v.is_time(b.type):
        n = _nanos_of(b.col, b.type) - _nanos_of(a.col, a.type)
        return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), duration(0, 0, F.call_function("div", n, F.lit(NANO).cast("long")), n % NANO)), rows, kind=v.DURATION)
    x, y = _local(a), _local(b)
    months = _months(a, b)
    moved = _at(F.add_months(x.cast("date"), months.cast("int")), _nanos_of(x, T.TimestampNTZType()))
    gap = _micros(y) - _micros(moved)
    div = lambda n, k: F.call_function("div", n, F.lit(k).cast("long"))
    rest = gap % 86_400_000_000
    out = duration(months, div(gap, 86_400_000_000), div(rest, 1_000_000), (rest % 1_000_000) * 1000)
    return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), out), rows, kind=v.DURATION)


def _months(a: Val, b: Val) -> Column:
    x, y = _local(a), _local(b)
    raw = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
    within = lambda z: F.dayofmonth(z).cast("long") * 86_400 * NANO + _nanos_of(z, T.TimestampNTZType())
    return F.when((y >= x) & (within(y) < within(x)), raw - 1).when((y < x) & (within(y) > within(x)), raw + 1).otherwise(raw)


FUNCTIONS["duration.between"] = lambda rows, a: between(rows, a[0], a[1])
FUNCTIONS["duration.inmonths"] = lambda rows, a: Val(F.when(a[0].col.isNotNull() & a[1].col.isNotNull(), duration(_months(a[0], a[1]), 0, 0, 0)), rows, kind=v.DURATION)


def _in_days(rows, a):
    gap = _micros(_local(a[1])) - _micros(_local(a[0]))
    return Val(F.when(gap.isNotNull(), duration(0, F.call_function("div", gap, F.lit(86_400_000_000).cast("long")), 0, 0)), rows, kind=v.DURATION)


def _in_seconds(rows, a):
    if v.is_time(a[0].type) or v.is_time(a[1].type):
        return between(rows, a[0], a[1])
    gap = _micros(_local(a[1])) - _micros(_local(a[0]))
    return Val(F.when(gap.isNotNull(), duration(0, 0, F.call_function("div", gap, F.lit(1_000_000).cast("long")), (gap % 1_000_000) * 1000)), rows, kind=v.DURATION)


FUNCTIONS["duration.indays"], FUNCTIONS["duration.inseconds"] = _in_days, _in_seconds


# truncation -----------------------------------------------------------------------------
def _truncate(kind: str):
    def f(rows: Rows, a: list[Val]) -> Val:
        from arbora.functions.scalars import constant

        unit = str(constant(a[0])).lower()
        if kind in ("time", "localtime"):
            k = {"day": 86400 * NANO, "hour": 3600 * NANO, "minute": 60 * NANO, "second": NANO, "millisecond": 1_000_000, "microsecond": 1000}.get(unit)
            if k is None:
                raise CypherError(f"unknown unit {unit}")
            n = _nanos_of(a[1].col, a[1].type)
            return Val(F.when(a[1].col.isNotNull(), F.struct(*_time_fields(n - n % k, kind))), rows)
        x = a[1].col.cast("timestamp_ntz") if a[1].type != T.DateType() else a[1].col.cast("timestamp_ntz")
        years = {"millennium": 1000, "century": 100, "decade": 10}
        if unit in years:
            out = F.make_date((F.call_function("div", F.year(x).cast("long"), F.lit(years[unit]).cast("long")) * years[unit]).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
        elif unit == "weekyear":
            jan4 = F.make_date(F.extract(F.lit("YEAROFWEEK"), x), F.lit(1), F.lit(4))
            out = F.date_sub(jan4, F.weekday(jan4)).cast("timestamp_ntz")
        elif unit in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond"):
            out = F.date_trunc(unit, x)
        else:
            raise CypherError(f"unknown unit {unit}")
        out = out.cast("timestamp_ntz")
        if len(a) > 2 and isinstance(a[2].type, T.StructType):
            c, fields = a[2].col, a[2].type.fieldNames()
            day = out.cast("date")
            if "dayOfWeek" in fields:
                day = F.date_add(F.trunc(day, "week"), c["dayOfWeek"].cast("int") - 1)
            day = F.make_date(c["year"].cast("int") if "year" in fields else F.year(day), c["month"].cast("int") if "month" in fields else F.month(day), c["day"].cast("int") if "day" in fields else F.dayofmonth(day))
            n = _nanos_of(out, T.TimestampNTZType())
            for name, k in (("hour", 3600), ("minute", 60), ("second", 1)):
                if name in fields:
                    wrap = {"hour": 86400, "minute": 3600, "second": 60}[name] * NANO
                    n = n - n % wrap + n % (k * NANO) + c[name].cast("long") * k * NANO
            for name, k in (("millisecond", 1_000_000), ("microsecond", 1000), ("nanosecond", 1)):
                if name in fields:
                    n = n + c[name].cast("long") * k
            out = _at(day, n)
        return Val(out.cast({"date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz"}[kind]), rows)

    return f


for _kind in ("date", "datetime", "localdatetime", "time", "localtime"):
    FUNCTIONS[f"{_kind}.truncate"] = _truncate(_kind)
