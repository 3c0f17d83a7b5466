"""Bulk student import.

Input is a DataFrame of raw string rows: either a delimited file read with its
header (``sources.files.read_import_csv``) or a sheet given as cells
(``sources.files.read_import_cells``). Each has a ``pos`` column giving the
row's place in the file. One job then maps, cleans, rejects incomplete rows,
marks duplicates (in the file and against the table) and builds the summary:

* header resolution happens on the driver from the header names only (the
  schema for delimited files, the one header row for sheets);
* duplicates: key ``(lower(id), lower(semester))``; a key already stored, or
  seen earlier in the file, is a duplicate. "Earlier" is the minimum ``pos``
  per key: a partial aggregate joined back (split by AQE if a key is hot),
  never a sort of a whole key group in one task;
* the summary is one aggregate; the messages are the first 10 duplicates by
  file position (a top-k, not a collect).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.functions.dates import parse_import_date, unparsed
from campusledger.operators.changes import STUDENT_FIELDS

# Header aliases of delimited files (first non-empty wins) and
# keyword rules of sheets (first header containing a keyword wins).
DEFAULT_SEMESTER = "2025-2026-1"
DEFAULT_STATUS = "Active"
CSV_ALIASES = {
    "id": ("id number", "id"),
    "name": ("student name", "name"),
    "strand": ("strand",),
    "gradeLevel": ("grade level", "grade"),
    "section": ("section",),
    "religion": ("religion",),
    "previousSchool": ("previous school", "school"),
    "gender": ("gender",),
    "status": ("status",),
    "birthdate": ("birthdate",),
    "schoolYearSemesterr": ("school year and semester", "school year", "semester"),
}
SHEET_KEYWORDS = {
    "id": ("id", "number"),
    "name": ("name", "student"),
    "strand": ("strand",),
    "gradeLevel": ("grade", "level"),
    "section": ("section",),
    "religion": ("religion",),
    "previousSchool": ("previous", "school"),
    "gender": ("gender",),
    "status": ("status",),
    "birthdate": ("birth", "date"),
    "schoolYearSemesterr": ("semester", "year"),
}
TEXT_FIELDS = ("id", "name", "strand", "gradeLevel", "section", "religion", "previousSchool",
               "gender")


def clean_value(c: Column) -> Column:
    """NULL to '', else trimmed text."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _first_present(cols: list[Column]) -> Column:
    """``a || b || ''`` over raw cells: first non-empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _unread(text: Column, parsed: Column) -> Column:
    """The text of a birth date that no listed form reads, for the messages."""
    return F.when(unparsed(text, parsed), F.trim(text))


def map_csv_rows(raw: DataFrame, pos: str = "pos") -> DataFrame:
    """Delimited rows to student fields (O60). Headers are matched after
    lower-casing and trimming; of two equal headers the last one counts, of
    several aliases the first non-empty one."""
    by_key: dict[str, str] = {}
    for name in raw.columns:
        by_key[name.strip().lower()] = name

    def pick(field: str) -> list[Column]:
        return [F.col(f"`{by_key[a]}`") for a in CSV_ALIASES[field] if a in by_key]

    cols = {f: clean_value(_first_present(pick(f))) for f in TEXT_FIELDS}
    status = pick("status")
    cols["status"] = clean_value(F.coalesce(*[F.nullif(c, F.lit("")) for c in status],
                                            F.lit(DEFAULT_STATUS)))
    birth = pick("birthdate")
    cols["birthdate"] = parse_import_date(birth[0]) if birth else F.lit(None).cast("date")
    cols["birthdateText"] = _unread(birth[0], cols["birthdate"]) if birth else F.lit(None).cast("string")
    sem = pick("schoolYearSemesterr")
    cols["schoolYearSemesterr"] = clean_value(F.coalesce(
        *[F.nullif(c, F.lit("")) for c in sem], F.lit(DEFAULT_SEMESTER)))
    cols["schoolYearSem"] = F.lit(0)
    return raw.select(F.col(pos).alias("pos"), *[v.alias(k) for k, v in cols.items()])


def resolve_sheet_header(headers: list[str]) -> dict[str, int]:
    """Column index per field: the first header containing a keyword."""
    norm = [(h or "").strip().lower() for h in headers]
    out = {}
    for field, words in SHEET_KEYWORDS.items():
        out[field] = next((i for i, h in enumerate(norm) if any(w in h for w in words)), -1)
    return out


def map_sheet_cells(rows: DataFrame, headers: list[str], cells: str = "cells",
                    pos: str = "pos") -> DataFrame:
    """Sheet rows (``array<string>`` cells) to student fields.

    Defaults apply only when the column is absent: a blank semester cell stays
    '' here, unlike delimited files.
    """
    idx = resolve_sheet_header(headers)

    def cell(field: str) -> Column:
        return F.get(F.col(cells), idx[field])

    cols: dict[str, Column] = {}
    for f in TEXT_FIELDS:
        cols[f] = clean_value(cell(f)) if idx[f] >= 0 else F.lit("")
    cols["status"] = clean_value(cell("status")) if idx["status"] >= 0 else F.lit(DEFAULT_STATUS)
    cols["birthdate"] = (parse_import_date(cell("birthdate"), sheet_numbers=True)
                         if idx["birthdate"] >= 0 else F.lit(None).cast("date"))
    cols["birthdateText"] = (_unread(cell("birthdate"), cols["birthdate"]) if idx["birthdate"] >= 0
                             else F.lit(None).cast("string"))
    cols["schoolYearSem"] = F.lit(0)
    cols["schoolYearSemesterr"] = (clean_value(cell("schoolYearSemesterr"))
                                   if idx["schoolYearSemesterr"] >= 0 else F.lit(DEFAULT_SEMESTER))
    return rows.select(F.col(pos).alias("pos"), *[v.alias(k) for k, v in cols.items()])


class Rejects(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


def reject_incomplete(mapped: DataFrame) -> Rejects:
    """Rows without id or name are dropped from the import and its totals."""
    bad = (F.col("id") == "") | (F.col("name") == "")
    return Rejects(mapped.where(~bad), mapped.where(bad))


class ImportResult(NamedTuple):
    table: DataFrame      # the student table with the imported rows
    inserted: DataFrame   # rows added, as stored
    duplicates: DataFrame  # pos, id, semester of skipped rows
    summary: DataFrame    # one row: totals and an error text when nothing was importable
    messages: DataFrame   # first messages (failures and duplicates) in file order
    failed: DataFrame     # pos, message of rows that could not be stored
    rejected: DataFrame   # incomplete rows (not counted)


def import_students(students: DataFrame, mapped: DataFrame, max_messages: int = 10) -> ImportResult:
    """Insert mapped rows that are neither stored nor repeated in the file.

    A row whose birth date cannot be read fails: it is counted, named in the
    messages and not stored. A blank status is stored as the default.
    """
    valid, rejected = reject_incomplete(mapped)
    if "birthdateText" not in valid.columns:
        valid = valid.withColumn("birthdateText", F.lit(None).cast("string"))
    valid = valid.withColumn("status", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit(DEFAULT_STATUS)))
    k_id, k_sem = F.lower("id"), F.lower("schoolYearSemesterr")
    keyed = valid.withColumns({"_k1": k_id, "_k2": k_sem, "_unread": F.col("birthdateText").isNotNull()})
    firsts = (keyed.groupBy("_k1", "_k2")
              .agg(F.min(F.when(~F.col("_unread"), F.col("pos"))).alias("_first_pos")))
    # Stored keys are looked up only for the keys in the file: the table side
    # is semi-joined to the file's distinct keys before its own distinct.
    stored = (students.select(F.lower("sd_id_number").alias("_k1"),
                              F.lower("sd_school_year_semesterr").alias("_k2"))
              .join(firsts.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi")
              .distinct().withColumn("_stored", F.lit(True)))
    marked = (keyed.join(firsts, ["_k1", "_k2"], "left").join(stored, ["_k1", "_k2"], "left")
              .withColumn("_dup", F.coalesce(F.col("_stored"), F.lit(False))
                          | F.coalesce(F.col("pos") > F.col("_first_pos"), F.lit(False)))
              .withColumn("_failed", ~F.col("_dup") & F.col("_unread")))
    ins = marked.where(~F.col("_dup") & ~F.col("_failed"))
    failed = marked.where("_failed").select(
        "pos", F.format_string("Failed: %s has an unreadable birth date '%s'", "id", "birthdateText").alias("message"))
    inserted = ins.select(*[(F.col(f).cast("date") if c == "sd_birthdate" else
                             F.col(f).cast("int") if c == "sd_school_year_sem" else
                             F.col(f)).alias(c) for c, f in STUDENT_FIELDS])
    dups = marked.where("_dup").select("pos", "id", "schoolYearSemesterr")
    summary = marked.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_records"),
        F.count_if(~F.col("_dup") & ~F.col("_failed")).cast("bigint").alias("successful_imports"),
        F.count_if(F.col("_failed")).cast("bigint").alias("failed_imports"),
        F.count_if(F.col("_dup")).cast("bigint").alias("duplicates_found"),
    ).withColumn("error", F.when(F.col("total_records") == 0,
                                 F.lit("No valid student data found in the file.")))
    doubled = dups.select("pos", F.format_string("Duplicate: %s for semester %s", "id", "schoolYearSemesterr")
                          .alias("message"))
    messages = failed.unionByName(doubled).orderBy("pos", "message").limit(max_messages)
    return ImportResult(students.unionByName(inserted), inserted, dups, summary, messages,
                        failed, rejected)
