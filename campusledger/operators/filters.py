"""Filters, look-ups, searches and orderings of the record lists.

Every function returns a DataFrame plan; nothing is collected. Equality on
stored text ignores case (database rule); filter *arguments* follow the
screens' own rules (upper-cased for levels and statuses, exact for the
medical condition kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusledger.functions.semantics import (ci_eq, ci_key, ci_like_any, contains_pattern, escape_like,
                                              exact_id, unsigned)
from campusledger.operators import projections as P
from campusledger.operators.validation import numeric_id

# Filter arguments accepted by the record screens.
CASE_LEVELS = {"MINOR": "Minor", "MAJOR": "Major", "SERIOUS": "Serious"}
COUNSELING_STATUSES = {"TO_SCHEDULE": "TO SCHEDULE", "SCHEDULED": "SCHEDULED", "DONE": "DONE"}
MEDICAL_KINDS = {
    "MEDICAL": ("Yes", "No"),
    "PSYCHOLOGICAL": ("No", "Yes"),
    "MEDICALPSYCHOLOGICAL": ("Yes", "Yes"),
}


# ---- ordering helpers (O36-O38) --------------------------------------------

def order_by_numeric_id(df: DataFrame, id_col: str) -> DataFrame:
    """``ORDER BY CAST(id AS UNSIGNED) DESC`` (O36); a numeric column is its own order."""
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return df.orderBy(F.col(id_col).desc())
    return df.orderBy(unsigned(id_col).desc(), F.col(id_col).desc())


def order_by_date_desc(df: DataFrame, date_col: str, id_col: str) -> DataFrame:
    """Newest first, the id as a stable tie-break."""
    return df.orderBy(F.col(date_col).desc_nulls_last(), F.col(id_col).desc())


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows by ``order`` (O38); planned as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


# ---- filters (O14-O16) -----------------------------------------------------

def case_level_filter(cases: DataFrame, level: str | None) -> DataFrame:
    """Cases of one violation level, newest id first (O14a). Unknown level: all."""
    value = CASE_LEVELS.get((level or "").upper())
    if value is not None:
        cases = cases.where(ci_eq("cr_violation_level", value))
    return order_by_numeric_id(cases, "cr_case_id")


def counseling_status_filter(counseling: DataFrame, status: str | None) -> DataFrame:
    """Sessions of one status (O14b). Unknown status: all."""
    value = COUNSELING_STATUSES.get((status or "").upper())
    if value is not None:
        counseling = counseling.where(ci_eq("cor_status", value))
    return order_by_numeric_id(counseling, "cor_record_id")


def medical_condition(kind: str | None) -> Column | None:
    """Condition filter shared by every medical screen (O15); exact-case kind."""
    flags = MEDICAL_KINDS.get(kind or "ALL")
    if flags is None:
        return None
    return ci_eq("mr_is_medical", flags[0]) & ci_eq("mr_is_psychological", flags[1])


def medical_condition_filter(medical: DataFrame, kind: str | None) -> DataFrame:
    cond = medical_condition(kind)
    return medical.where(cond) if cond is not None else medical


def referred_cases(cases: DataFrame) -> DataFrame:
    """O16a."""
    return order_by_numeric_id(cases.where(ci_eq("cr_referred", "Yes")), "cr_case_id")


def referred_medical(medical: DataFrame, kind: str = "ALL") -> DataFrame:
    """O16b."""
    df = medical_condition_filter(medical.where(ci_eq("mr_referred", "Yes")), kind)
    return order_by_date_desc(df, "mr_record_date", "mr_medical_id")


def psychological_counseling(counseling: DataFrame) -> DataFrame:
    """O16c."""
    return order_by_numeric_id(counseling.where(ci_eq("cor_is_psychological_condition", "YES")),
                               "cor_record_id")


def active_users(users: DataFrame) -> DataFrame:
    """O16d: active accounts, newest first."""
    return users.where(ci_eq("u_status", "Active")) \
        .orderBy(F.col("created_at").desc_nulls_last(), F.col("u_email"))


def medical_list(medical: DataFrame, kind: str = "ALL") -> DataFrame:
    """O16e (medical screen)."""
    return order_by_date_desc(medical_condition_filter(medical, kind),
                              "mr_record_date", "mr_medical_id")


def infirmary_list(medical: DataFrame, kind: str = "ALL") -> DataFrame:
    """O16e (infirmary screen): same rows, O10 columns."""
    return medical_list(medical, kind)


# ---- look-ups (O17) --------------------------------------------------------

RECORD_KEYS = {
    "case": "cr_case_id",
    "counseling": "cor_record_id",
    "medical": "mr_medical_id",
    "student": "sd_id_number",
    "user": "u_email",
}


def record_by_id(df: DataFrame, kind: str, value) -> DataFrame:
    """Rows whose key equals ``value`` (O17a). Students: the latest semester only.

    Numeric record ids are validated first (O70): a non-numeric id is an error.
    """
    key = RECORD_KEYS[kind]
    if kind in ("student", "user"):
        out = df.where(ci_eq(key, str(value)))
    else:
        try:
            float(str(value))
        except ValueError:
            raise ValueError("Record ID must be a number") from None
        out = df.where(F.col(key) == exact_id(F.lit(str(value))))
    if kind == "student":
        # without any semester the latest one is NULL, and the rows still count
        latest = out.agg(F.max("sd_school_year_semesterr").alias("_m"))
        out = out.join(latest, F.col("sd_school_year_semesterr").eqNullSafe(F.col("_m"))).drop("_m")
    return out


def records_by_ids(df: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Batch look-up: ``ids`` has one column named like the key (semi join).
    For numeric keys, requests whose id is not numeric are dropped (O70)."""
    key = RECORD_KEYS[kind]
    if kind not in ("student", "user"):
        ids = ids.where(numeric_id(key)).select(exact_id(key).alias(key))
        return df.join(ids, key, "left_semi")
    ids = ids.select(ci_key(key).alias("_id"))
    return df.join(ids, ci_key(df[key]) == ids["_id"], "left_semi")


def records_by_student(df: DataFrame, kind: str, student_id: str, *, referred: bool = False,
                       psychological: bool = False, condition: str = "ALL") -> DataFrame:
    """A student's records, newest first (O17b), with working optional flags."""
    if kind == "case":
        out = df.where(ci_eq("cr_student_id", student_id))
        if referred:
            out = out.where(ci_eq("cr_referred", "Yes"))
        return order_by_numeric_id(out, "cr_case_id")
    if kind == "counseling":
        out = df.where(ci_eq("cor_student_id_number", student_id))
        if psychological:
            out = out.where(ci_eq("cor_is_psychological_condition", "YES"))
        return order_by_numeric_id(out, "cor_record_id")
    out = medical_condition_filter(df.where(ci_eq("mr_student_id", student_id)), condition)
    if referred:
        out = out.where(ci_eq("mr_referred", "Yes"))
    return order_by_date_desc(out, "mr_record_date", "mr_medical_id")


# ---- searches (O18, O19) ---------------------------------------------------
# User text is not escaped here: ``%`` and ``_`` act as wildcards, as in the
# record screens. Only the medical searches escape them.

CASE_SEARCH = ("cr_student_id", "cr_student_name", "cr_student_strand", "cr_violation_level",
               "cr_status", "cr_school_year_semester")
COUNSELING_SEARCH = ("cor_student_name", "cor_student_id_number", "cor_student_strand",
                     "cor_status", "cor_origin_medical_id", "cor_school_year_semester")
STUDENT_SEARCH = ("sd_id_number", "sd_student_name", "sd_strand", "sd_grade_level",
                  "sd_section", "sd_gender")
USER_SEARCH = ("u_email", "u_username", "u_name", "u_department", "u_type")
MEDICAL_SEARCH = ("mr_student_name", "mr_student_id", "mr_medical_id", "mr_school_year_semester")
MEDICAL_REFERRED_SEARCH = ("mr_student_name", "mr_student_id", "mr_medical_id",
                           "mr_medical_details", "mr_school_year_semester")


def _require(text: str | None) -> str:
    if text is None:
        raise ValueError("search text is required")
    return text


def case_search(cases: DataFrame, text: str, referred: bool = False) -> DataFrame:
    """O18a."""
    out = cases.where(ci_like_any(CASE_SEARCH, contains_pattern(_require(text))))
    if referred:
        out = out.where(ci_eq("cr_referred", "Yes"))
    return order_by_numeric_id(out, "cr_case_id")


def counseling_search(counseling: DataFrame, text: str) -> DataFrame:
    """O18b."""
    out = counseling.where(ci_like_any(COUNSELING_SEARCH, contains_pattern(_require(text))))
    return order_by_numeric_id(out, "cor_record_id")


def student_search(students: DataFrame, text: str) -> DataFrame:
    """Matching semester rows, ordered by id."""
    out = students.where(ci_like_any(STUDENT_SEARCH, contains_pattern(_require(text))))
    return out.orderBy("sd_id_number", "sd_school_year_semesterr")


def user_search(users: DataFrame, text: str) -> DataFrame:
    """O18d."""
    out = users.where(ci_like_any(USER_SEARCH, contains_pattern(_require(text))))
    return out.orderBy(F.col("created_at").desc_nulls_last(), "u_email")


def medical_search(medical: DataFrame, text: str, kind: str = "ALL",
                   referred: bool = False) -> DataFrame:
    """``%`` and ``_`` in the text match literally; blank text is rejected."""
    if text is None or text.strip() == "":
        raise ValueError("search text is required")
    pattern = contains_pattern(escape_like(text))
    out = medical
    if referred:
        out = out.where(ci_eq("mr_referred", "Yes")) \
            .where(ci_like_any(MEDICAL_REFERRED_SEARCH, pattern))
    else:
        out = out.where(ci_like_any(MEDICAL_SEARCH, pattern))
    out = medical_condition_filter(out, kind)
    return order_by_date_desc(out, "mr_record_date", "mr_medical_id")


def medical_referred_search(medical: DataFrame, text: str, kind: str = "ALL") -> DataFrame:
    return medical_search(medical, text, kind, referred=True)


# ---- distinct (O39) --------------------------------------------------------

def distinct_students(students: DataFrame) -> DataFrame:
    """The full student list: DISTINCT over the 12 screen columns, by id.

    Rows are dealt over all shuffle partitions before any is compared: a task that reads
    a whole row group would else hold all its students at once.
    """
    listed = P.student_projection(students)
    tasks = int(students.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, *listed.columns).distinct().orderBy("id", "schoolYearSemesterr")
