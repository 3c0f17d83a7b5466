"""Date parsing for imported student files.

A listed set of text forms is accepted (see README): ISO date and timestamp,
dates in numbers with ``/`` or ``-`` (month first unless the year is; two-digit
years count 1950-2049), and month names before or after the day. ``unparsed``
tells a text that has none of these forms from a blank one. Text starting with ``YYYY-MM-DD`` whose month or day is out
of range rolls over (``2024-13-45`` is 2025-02-14). A sheet cell holding a
number is a day count from 1899-12-30 (the spreadsheet epoch); a four-digit
text in a sheet is a year, unless the cell is marked as a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text forms and the spreadsheet day-count epoch.
TEXT_FORMATS = ("yyyy-MM-dd", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
                "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d MMM, yyyy", "d MMMM, yyyy")
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]",
                     "yyyy-MM-dd HH:mm:ss")
SHEET_EPOCH = "1899-12-30"


def _rollover(text: Column) -> Column:
    pat = r"^(\d{4})-(\d{2})-(\d{2})"
    y = F.regexp_extract(text, pat, 1)
    m = F.regexp_extract(text, pat, 2).try_cast("int")
    d = F.regexp_extract(text, pat, 3).try_cast("int")
    base = F.make_date(y.try_cast("int"), F.lit(1), F.lit(1))
    return F.when(y != "", F.date_add(F.add_months(base, m - 1), d - 1))


def _short_year(text: Column) -> Column:
    """``M/d/yy`` and ``M-d-yy``: 00-49 are 2000-2049, 50-99 are 1950-1999."""
    pat = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$"
    m, d, y = (F.regexp_extract(text, pat, i).try_cast("int") for i in (1, 2, 3))
    full = F.concat_ws("-", (y + F.when(y < 50, 2000).otherwise(1900)).cast("string"), m.cast("string"), d.cast("string"))
    return F.when(text.rlike(pat), F.try_to_date(full, "yyyy-M-d"))


def _year_only(text: Column) -> Column:
    return F.when(text.rlike(r"^(19|20)\d{2}$"), F.make_date(text.try_cast("int"), F.lit(1), F.lit(1)))


def unparsed(c, parsed: Column) -> Column:
    """A text that is there, but is no date."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return (F.coalesce(text, F.lit("")) != "") & parsed.isNull()


def parse_import_date(c, sheet_numbers: bool = False, is_number: Column | None = None) -> Column:
    """Text (or, for sheets, a day count) to a ``date``; blank or unparsable is NULL.

    ``is_number`` says, for sheets that carry cell types, that the cell holds a
    number; without it a number that reads as a year (1900-2099) is a year.
    """
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    tries = [F.try_to_date(text, f) for f in TEXT_FORMATS]
    tries += [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in TIMESTAMP_FORMATS]
    parsed = F.coalesce(*tries, _short_year(text), _year_only(text), _rollover(text))
    if sheet_numbers:
        serial = text.try_cast("double")
        counts = is_number if is_number is not None else ~text.rlike(r"^(19|20)\d{2}$")
        parsed = F.when(serial.isNotNull() & text.rlike(r"^\d+(\.\d+)?$") & counts,
                        F.date_add(F.lit(SHEET_EPOCH).cast("date"),
                                   F.floor(serial).cast("int"))).otherwise(parsed)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("date")).otherwise(parsed)
