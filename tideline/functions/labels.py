"""TAI64N labels: the 24 hex digits that name, order and date a rotated file.

16 digits of seconds (biased by 2^62 and shifted by the leap offset) followed by
8 digits of nanoseconds. Labels have a fixed width, so text order is time order
and every comparison stays on the string. All functions are Column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instant (UTC midnight) from which each TAI-UTC offset in
# seconds counts. The published leap second list up to July 2012; pass a longer
# ``leap_table`` to extend it.
LEAP_TABLE: tuple[tuple[str, int], ...] = (
    ("1972-01-01", 10),
    ("1972-07-01", 11),
    ("1973-01-01", 12),
    ("1974-01-01", 13),
    ("1975-01-01", 14),
    ("1976-01-01", 15),
    ("1977-01-01", 16),
    ("1978-01-01", 17),
    ("1979-01-01", 18),
    ("1980-01-01", 19),
    ("1981-07-01", 20),
    ("1982-07-01", 21),
    ("1983-07-01", 22),
    ("1985-07-01", 23),
    ("1988-01-01", 24),
    ("1990-01-01", 25),
    ("1991-01-01", 26),
    ("1992-07-01", 27),
    ("1993-07-01", 28),
    ("1994-07-01", 29),
    ("1996-01-01", 30),
    ("1997-07-01", 31),
    ("1999-01-01", 32),
    ("2006-01-01", 33),
    ("2009-01-01", 34),
    ("2012-07-01", 35),
)

TAI_BASE = 1 << 62
LABEL_PATTERN = "^[0-9a-f]{24}$"
ROTATED_NAME_PATTERN = r"^@[0-9a-f]{24}\..$"

LeapTable = Sequence[tuple[str, int]]


def _epoch_ms(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp()) * 1000


def _raw_label(shifted_ms: int) -> str:
    """Label text of an already leap-shifted instant."""
    seconds, ms = divmod(shifted_ms, 1000)
    return f"{seconds + TAI_BASE:016x}{ms * 1_000_000:08x}"


def _offset_at(ms: int, leap_table: LeapTable) -> int:
    return next((off for at, off in _newest_first(leap_table) if at < ms), 0)


def _newest_first(leap_table: LeapTable) -> list[tuple[int, int]]:
    return sorted(((_epoch_ms(day), off) for day, off in leap_table), reverse=True)


def leap_offset(ms: Column, leap_table: LeapTable = LEAP_TABLE) -> Column:
    """JN4: the offset of the latest entry strictly before ``ms``, else 0.

    The table is a short constant, so the as-of lookup is a CASE with the newest
    entry first: no join, no shuffle, and recent data stops at the first test.
    """
    case = F
    for at, off in _newest_first(leap_table):
        case = case.when(ms > F.lit(at), F.lit(off))
    return case.otherwise(F.lit(0))


def encode_ms(ms: Column, leap_table: LeapTable = LEAP_TABLE) -> Column:
    """PRJ3 on epoch milliseconds."""
    seconds = F.floor(ms / F.lit(1000)).cast("bigint") + leap_offset(ms, leap_table)
    nanos = F.pmod(ms, F.lit(1000)).cast("bigint") * F.lit(1_000_000)
    return F.concat(
        F.lpad(F.lower(F.hex(seconds + F.lit(TAI_BASE))), 16, "0"),
        F.lpad(F.lower(F.hex(nanos)), 8, "0"),
    )


def encode(ts: Column, leap_table: LeapTable = LEAP_TABLE) -> Column:
    """PRJ3: the label of a timestamp, at millisecond precision."""
    return encode_ms(F.unix_millis(ts.cast("timestamp")), leap_table)


def _label_offset(label: Column, leap_table: LeapTable) -> Column:
    """JN4 on the shifted instant a label spells, by comparing the text itself: the
    hex digits are converted once, not once per comparison.
    """
    case = F
    for at, off in _newest_first(leap_table):
        case = case.when(label >= F.lit(_raw_label(at + 1)), F.lit(off))
    return case.otherwise(F.lit(0))


def decode_ms(label: Column, leap_table: LeapTable = LEAP_TABLE) -> Column:
    """PRJ2: epoch milliseconds of a label, NULL when it is not 24 hex digits.

    The offset is looked up with the still shifted instant. In the last seconds
    before (and at) a leap boundary this yields one second less than was
    encoded; that is the defined behaviour, see the tests.
    """
    seconds = F.conv(F.substring(label, 1, 16), 16, 10).try_cast("bigint") - F.lit(TAI_BASE)
    nanos = F.conv(F.substring(label, 17, 8), 16, 10).try_cast("bigint")
    whole = (seconds - _label_offset(label, leap_table)) * F.lit(1000)
    return F.when(
        label.rlike(LABEL_PATTERN), whole + F.floor(nanos / F.lit(1_000_000)).cast("bigint")
    )


def decode(label: Column, leap_table: LeapTable = LEAP_TABLE) -> Column:
    """PRJ2: the event time of a label."""
    return F.timestamp_millis(decode_ms(label, leap_table))


def first_label_at(ms: int, leap_table: LeapTable = LEAP_TABLE) -> str:
    """The smallest label that decodes to ``ms`` or later.

    Time limits become text constants, so file predicates compare the label (or the
    file name) itself and reach the scan.
    """
    offsets = {0, *(off for _, off in leap_table)}
    fits = [
        ms + 1000 * off for off in offsets
        if ms + 1000 * off - 1000 * _offset_at(ms + 1000 * off, leap_table) >= ms
    ]
    return _raw_label(min(fits))


def floor_to_ms(label: Column) -> Column:
    """The label without its part below a millisecond, which decoding ignores."""
    nanos = F.conv(F.substring(label, 17, 8), 16, 10).try_cast("bigint")
    whole = nanos - F.pmod(nanos, F.lit(1_000_000))
    return F.concat(F.substring(label, 1, 16), F.lpad(F.lower(F.hex(whole)), 8, "0"))


def label_of(file_name: Column) -> Column:
    """PRJ1: drop the first and the last two characters of a rotated name."""
    return F.substr(file_name, F.lit(2), F.greatest(F.length(file_name) - 3, F.lit(0)))


def is_rotated_name(file_name: Column) -> Column:
    """Guard for PRJ1/PRJ2: ``@``, 24 lower-case hex digits, dot, one character."""
    return file_name.rlike(ROTATED_NAME_PATTERN)
