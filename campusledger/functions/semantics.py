"""Column helpers for the comparison and casting rules all operators share.

Text comparisons made by the database ignore case (the record tables use a
case-insensitive collation), comparisons made by application code do not.
Everything here returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci_eq(c: ColumnOrName, value: str) -> Column:
    """Database-style equality: ``'YES' = 'Yes'``.

    Text without letters is compared as it is, so the filter reaches the scan.
    For ASCII text every spelling lies between the upper-case and the lower-case
    one; that range is added, as the scan can use it to skip row groups.
    """
    c = _col(c)
    if value.lower() == value.upper():
        return c == F.lit(value)
    same = F.lower(c) == F.lit(value.lower())
    if value.isascii():
        return (c >= F.lit(value.upper())) & (c <= F.lit(value.lower())) & same
    return same


def ci_key(c: ColumnOrName) -> Column:
    """The form in which text keys are joined and grouped (rule S1)."""
    return F.lower(_col(c))



def contains_pattern(text: str) -> str:
    """``%text%`` with the user's text left unescaped (``%``/``_`` stay wildcards)."""
    return f"%{text}%"


def escape_like(text: str) -> str:
    """Escape ``\\``, ``%`` and ``_`` so the text matches literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def ci_like_any(cols, pattern: str) -> Column:
    """``c1 LIKE p OR c2 LIKE p ...`` ignoring case; numbers compared as text."""
    return reduce(lambda a, b: a | b,
                  [_col(c).cast("string").ilike(pattern) for c in cols])


def unsigned(c: ColumnOrName) -> Column:
    """MySQL ``CAST(x AS UNSIGNED)`` on text: the leading digits, else 0."""
    digits = F.regexp_extract(_col(c).cast("string"), r"^\s*(\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def blank_to_null(c: ColumnOrName) -> Column:
    """Application-style ``a || b``: an empty string counts as missing."""
    return F.nullif(_col(c), F.lit(""))


def first_present(*cols: ColumnOrName) -> Column:
    """``a || b || c``: the first value that is neither NULL nor '', else the last one."""
    return F.coalesce(*[blank_to_null(c) for c in cols[:-1]], _col(cols[-1]))




def as_of_column(as_of=None) -> Column:
    """The clock used by an operator, as a zone-free timestamp.

    ``None`` means now; strings and ``datetime`` values fix it (tests, replays).
    """
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    if isinstance(as_of, _dt.date):
        return F.lit(as_of.isoformat()).cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def exact_id(c: ColumnOrName) -> Column:
    """A record id given as text or number: its whole value, NULL unless it is a whole number.

    Decimal, not double: ids above 2**53 stay exact and ``12.7`` finds nothing.
    """
    number = F.trim(_col(c).cast("string")).try_cast("decimal(38,9)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def iso_millis(c: ColumnOrName) -> Column:
    """JavaScript ``Date.toISOString()`` text of a zone-free timestamp."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_millis(c: ColumnOrName) -> Column:
    """``Date.getTime()`` of a zone-free timestamp read as UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, _col(c).cast("timestamp_ntz"))
