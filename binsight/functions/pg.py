"""Column helpers that reproduce the PostgreSQL behaviours the reports rely on.

All helpers return plain ``Column`` expressions built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- fixed values -------------------------------------------------------------
# Weekday labels, Sunday first (Spark dayofweek: 1 = Sunday).  These must equal
# the report output exactly, including the historical spelling of Tuesday.
WEEKDAYS_ACCENTED = ("Domenica", "Lunedì", "Marterdì", "Mercoledì", "Giovedì", "Venerdì", "Sabato")
WEEKDAYS_PLAIN = ("Domenica", "Lunedi", "Marterdi", "Mercoledi", "Giovedi", "Venerdi", "Sabato")
WEEKDAYS_SHORT = ("Dom", "Lun", "Mar", "Mer", "Gio", "Ven", "Sab")
FLAG_LABELS = ("NO", "SI")  # 0 -> NO, 1 -> SI
# ------------------------------------------------------------------------------

WEEKDAY_SETS = {"accented": WEEKDAYS_ACCENTED, "plain": WEEKDAYS_PLAIN, "short": WEEKDAYS_SHORT}


def weekday_label(ts: ColumnOrName, labels: str = "accented") -> Column:
    """``TO_CHAR(ts, 'Dy')`` mapped to a local label set (locale independent)."""
    names = WEEKDAY_SETS[labels]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek(col(ts)))


def decode_flag(c: ColumnOrName) -> Column:
    """0/1 -> NO/SI; anything else (incl. NULL) -> NULL, like a simple CASE."""
    c = col(c)
    return F.when(c == 0, F.lit(FLAG_LABELS[0])).when(c == 1, F.lit(FLAG_LABELS[1]))


def pg_concat(*cols: ColumnOrName) -> Column:
    """PostgreSQL ``CONCAT``: NULL arguments count as ''. (``||`` is F.concat.)"""
    return F.concat_ws("", *[col(c).cast("string") for c in cols])


def exact(x: ColumnOrName, scale: int = 6) -> Column:
    """A number as a decimal with ``scale`` digits (a DOUBLE through its shortest text)."""
    return col(x).cast(f"decimal(24,{scale})")


def truncated_ratio(x: ColumnOrName, y: ColumnOrName, times: int = 1, scale: int = 2) -> Column:
    """``TRUNC(x / y * times, scale)`` toward zero in whole-number arithmetic;
    NULL for a zero ``y``."""
    steps = 10 ** scale
    whole = F.call_function("div", exact(x) * F.lit(times * steps), F.nullif(exact(y), F.lit(0)))
    return (whole.cast("decimal(38,0)") / F.lit(steps)).cast(f"decimal(38,{scale})")


def num_text(x: ColumnOrName, scale: int = 3) -> Column:
    """Numeric -> text with a fixed number of decimals (via DECIMAL, never the
    scientific notation a DOUBLE prints with); zero prints as ``0``."""
    x = col(x).cast(f"decimal(38,{scale})")
    return F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))


def time_text(ts: ColumnOrName) -> Column:
    """``ts::time`` as text: ``HH:MM:SS`` and the fraction, if any, without trailing zeros."""
    return F.substring(col(ts).cast("string"), 12, 15)


def blank_sentinel(c: ColumnOrName, sentinel: str) -> Column:
    """``CASE c WHEN sentinel THEN '' ELSE c END`` (NULL stays NULL)."""
    c = col(c)
    return F.when(c == F.lit(sentinel), F.lit("")).otherwise(c)


def similar_to_regex(pattern: str, escape: str = "\\") -> str:
    """Translate a SQL ``SIMILAR TO`` pattern into an anchored Java regex.

    In SIMILAR TO ``%`` is any string, ``_`` any character (line feeds
    included) and ``.`` is a literal dot; brackets, braces, ``|``, ``*``, ``+``,
    ``?`` and groups keep their regex meaning; ``escape`` makes the next
    character literal.  The match is against the whole string.
    """
    out, in_bracket, literal = [], False, False
    for ch in pattern:
        if literal:
            out.append(re.escape(ch))
            literal = False
        elif ch == escape:
            literal = True
        elif in_bracket:
            out.append(ch)
            in_bracket = ch != "]"
        elif ch == "[":
            in_bracket = True
            out.append(ch)
        elif ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch in ".^$\\":
            out.append(re.escape(ch))
        else:
            out.append(ch)
    return r"\A(?s:" + "".join(out) + r")\z"


def similar_to(c: ColumnOrName, pattern: str) -> Column:
    return col(c).rlike(similar_to_regex(pattern))


def time_of_day(ts: ColumnOrName) -> Column:
    """Interval since midnight (``ts::time`` as a DAY TO SECOND interval)."""
    ts = col(ts)
    return F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts), F.date_part(F.lit("SECOND"), ts))


def tod(hms: str) -> Column:
    """Literal time of day ``'HH:MM:SS[.ffffff]'`` as an interval since midnight."""
    parts = hms.split(":")
    h, m = int(parts[0]), int(parts[1])
    s = float(parts[2]) if len(parts) > 2 else 0.0
    return F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m), F.lit(s))


def to_datetime(value) -> dt.datetime:
    """Python value (date, datetime or ISO text) -> naive datetime."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def _lit_ts(d: dt.datetime) -> Column:
    # via text, so no process or session time zone is involved
    return F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")


def as_ts(value) -> Column:
    """Literal TIMESTAMP_NTZ from a date/datetime/ISO string (a date means its midnight)."""
    if isinstance(value, Column):
        return value
    return _lit_ts(to_datetime(value))


def day_start(value) -> Column:
    """Midnight of the day of ``value``."""
    d = to_datetime(value)
    return _lit_ts(dt.datetime(d.year, d.month, d.day))


def next_day_start(value) -> Column:
    d = to_datetime(value)
    return _lit_ts(dt.datetime(d.year, d.month, d.day) + dt.timedelta(days=1))


def interval_seconds(seconds: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))


def interval_total_seconds(iv: ColumnOrName) -> Column:
    """Signed total seconds (double, microsecond precision) of a DAY TO
    SECOND interval."""
    iv = col(iv)
    ex = lambda unit: F.extract(F.lit(unit), iv)
    return (ex("DAY").cast("double") * 86400 + ex("HOUR").cast("double") * 3600
            + ex("MINUTE").cast("double") * 60 + ex("SECOND").cast("double"))


def micros_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Signed whole microseconds (long) between two TIMESTAMP_NTZ values; zone free."""
    iv = col(later) - col(earlier)
    ex = lambda unit: F.extract(F.lit(unit), iv)
    minutes = (ex("DAY").cast("long") * 24 + ex("HOUR")) * 60 + ex("MINUTE")
    return (minutes * 60_000_000 + (ex("SECOND") * 1_000_000).cast("long")).cast("long")


def interval_micros(micros: ColumnOrName) -> Column:
    """Whole microseconds as an interval."""
    m = col(micros)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (m.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def seconds_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Signed seconds (double, microsecond precision) between two
    TIMESTAMP_NTZ values.  Plain NTZ subtraction is zone free; Spark's
    ``timestamp_diff`` reads NTZ values in the session time zone and is off
    by the DST shift across a change."""
    return interval_total_seconds(col(later) - col(earlier))
