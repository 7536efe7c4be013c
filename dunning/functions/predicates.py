"""Row predicates of the reports, as Spark Columns.

All keep SQL three-valued logic: a predicate that evaluates to null drops the
row, exactly like the reference WHERE clauses (null ``stcli``, ``obs``,
``cod_usu`` or phone text all drop rows; nothing is coalesced).
LIKE in the reference runs under a case-insensitive collation, so every
contains-test uses ``ilike``; code equality (``stcli``, ``staco``) stays exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunning.fixed import (
    BAD_NOTE_FRAGMENTS,
    GOOD_PHONE_STATUS,
    INACTIVE,
    INTAKE_MONTHS,
    MASK,
    MIN_PHONE_BYTES,
    PERIOD_END,
    PERIOD_START,
    RECENT_DAYS,
    REPEATED_DIGITS,
    STATUS_BROKEN,
    STATUS_KNOWN,
    STATUS_OPEN,
    STATUS_SETTLED,
    SYSTEM_USER,
)

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_portfolios(col, portfolios) -> Column:
    ports = list(portfolios)
    if not ports:
        raise ValueError("select at least one portfolio")
    return _c(col).isin(ports)


def active(stcli="stcli") -> Column:
    """``stcli <> 'INA'``: null status is dropped too."""
    return _c(stcli) != F.lit(INACTIVE)


def phone_quality(status="status", obs="obs") -> Column:
    """Listed status, or a note that says neither unknown nor wrong."""
    s, o = _c(status), _c(obs)
    note_ok = None
    for frag in BAD_NOTE_FRAGMENTS:
        t = ~o.ilike(frag)
        note_ok = t if note_ok is None else (note_ok & t)
    return s.isin(list(GOOD_PHONE_STATUS)) | note_ok


def no_repeated_digits(phone) -> Column:
    """Reject six equal consecutive digits; a null phone is dropped."""
    return ~_c(phone).rlike(REPEATED_DIGITS)


def min_phone_length(phone, n: int = MIN_PHONE_BYTES) -> Column:
    """LENGTH in the reference counts bytes."""
    return F.octet_length(_c(phone)) >= F.lit(n)


def not_masked(phone) -> Column:
    return ~_c(phone).ilike(MASK)


def dialable(phone) -> Column:
    """No repeated run, at least 8 bytes, no mask letter."""
    return no_repeated_digits(phone) & min_phone_length(phone) & not_masked(phone)


def contains_ci(col, fragment: str) -> Column:
    return _c(col).ilike(f"%{fragment}%")


def not_contains_ci(col, fragment: str) -> Column:
    return ~_c(col).ilike(f"%{fragment}%")


def human_user(cod_usu="cod_usu") -> Column:
    """``cod_usu <> '999'``: system and null users are both dropped."""
    return _c(cod_usu) != F.lit(SYSTEM_USER)


def as_of_ts(as_of: dt.datetime | None, zone: str | None = None) -> Column:
    """The report clock as wall time. Without a fixed ``as_of`` it is the current
    time in ``zone``, or in the session's zone where none is given."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp_ntz")
    now = F.localtimestamp()
    return now if zone is None else F.convert_timezone(F.current_timezone(), F.lit(zone), now)


def as_of_date(as_of: dt.datetime | None, zone: str | None = None) -> Column:
    return F.lit(as_of.date()) if as_of is not None else as_of_ts(None, zone).cast("date")


def days_before(as_of, days: int = RECENT_DAYS, zone: str | None = None) -> Column:
    """``NOW() - INTERVAL n DAY`` (to the second)."""
    return as_of_ts(as_of, zone) - F.make_dt_interval(F.lit(days))


def midnight_days_before(as_of, days: int = RECENT_DAYS, zone: str | None = None) -> Column:
    """``CURDATE() - INTERVAL n DAY`` (from midnight)."""
    return F.date_sub(as_of_date(as_of, zone), days).cast("timestamp_ntz")


def recent_intake(data_cad, as_of, months: int = INTAKE_MONTHS, zone: str | None = None) -> Column:
    """``data_cad >= CURDATE() - INTERVAL n MONTH`` (month-end clamp)."""
    return _c(data_cad) >= F.add_months(as_of_date(as_of, zone), -months)


def period_start(start: dt.date | None) -> Column | None:
    """Optional inclusive period start at 00:00:00."""
    if start is None:
        return None
    return F.lit(dt.datetime.combine(start, PERIOD_START)).cast("timestamp_ntz")


def period_end(end: dt.date | None) -> Column | None:
    """Optional inclusive period end at 23:59:59 (a fraction of a second
    after 23:59:59 is outside, as in the reference)."""
    if end is None:
        return None
    return F.lit(dt.datetime.combine(end, PERIOD_END)).cast("timestamp_ntz")


def settled(staco="staco") -> Column:
    """Latest agreement promised, paid or open; false when there is none."""
    return F.coalesce(_c(staco).isin(list(STATUS_SETTLED)), F.lit(False))


def broken(staco="staco") -> Column:
    """Latest agreement broken or rejected; false when there is none."""
    return F.coalesce(_c(staco).isin(list(STATUS_BROKEN)), F.lit(False))


def known(staco="staco") -> Column:
    """An agreement status that has a label; false when there is none."""
    return F.coalesce(_c(staco).isin(list(STATUS_KNOWN)), F.lit(False))


def is_open(staco="staco") -> Column:
    """Latest agreement promised or open."""
    return _c(staco).isin(list(STATUS_OPEN))
