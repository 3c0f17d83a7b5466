"""KPI roll-ups and monthly trends.

All totals are single-pass global aggregates: every task builds partial
``count_if`` sums and one tiny row per task is shuffled to the final
aggregate, so cost is one scan of the pruned columns regardless of size.
``count_if`` is 0 on empty input, matching the handler's ``|| 0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.functions.jsoncols import has_medical_file, stored_files
from campusledger.functions.semantics import as_of_column, ci_eq


def _count_if(cond) -> F.Column:
    return F.count_if(cond).cast("bigint")


def case_totals(cases: DataFrame) -> DataFrame:
    """Counts by violation level and status."""
    lvl, st = "cr_violation_level", "cr_status"
    return cases.agg(
        _count_if(ci_eq(lvl, "Minor")).alias("minor"),
        _count_if(ci_eq(lvl, "Major")).alias("major"),
        _count_if(ci_eq(lvl, "Serious")).alias("serious"),
        _count_if(ci_eq(st, "Ongoing")).alias("ongoing"),
        _count_if(ci_eq(st, "Resolved")).alias("resolved"),
    )


def counseling_totals(counseling: DataFrame) -> DataFrame:
    """Counts by session status."""
    st = "cor_status"
    return counseling.agg(
        _count_if(ci_eq(st, "SCHEDULED")).alias("scheduled"),
        _count_if(ci_eq(st, "TO SCHEDULE")).alias("to_schedule"),
        _count_if(ci_eq(st, "DONE")).alias("done"),
    )


def medical_totals(medical: DataFrame) -> DataFrame:
    """Counts by condition flags and status."""
    st = "mr_status"
    return medical.agg(
        _count_if(ci_eq("mr_is_medical", "YES")).alias("medical"),
        _count_if(ci_eq("mr_is_psychological", "YES")).alias("psychological"),
        _count_if(ci_eq(st, "Ongoing")).alias("ongoing"),
        _count_if(ci_eq(st, "Treated")).alias("treated"),
        _count_if(ci_eq(st, "For Treatment")).alias("for_treatment"),
    )


def user_totals(users: DataFrame) -> DataFrame:
    """Account counts."""
    active = ci_eq("u_status", "Active")
    return users.agg(
        F.count(F.lit(1)).cast("bigint").alias("totalUsers"),
        _count_if(active).alias("activeUsers"),
        _count_if(ci_eq("u_status", "Inactive")).alias("inactiveUsers"),
        _count_if(ci_eq("u_type", "Administrator") & active).alias("activeAdmins"),
        _count_if(ci_eq("u_department", "OPD") & active).alias("activeOPD"),
        _count_if(ci_eq("u_department", "GCO") & active).alias("activeGCO"),
        _count_if(ci_eq("u_department", "INF") & active).alias("activeINF"),
    )


def user_status_breakdown(users: DataFrame) -> DataFrame:
    """Accounts per status, statuses grouped ignoring case.

    The rows are counted per exact spelling first (a hash aggregate with a
    fixed-width buffer); only the handful of spellings are then merged
    ignoring case, so no sort of the input is needed to pick a spelling.
    """
    per_spelling = users.groupBy("u_status").agg(F.count(F.lit(1)).alias("_n"))
    return (per_spelling.groupBy(F.lower("u_status").alias("_k"))
            .agg(F.min("u_status").alias("u_status"),
                 F.sum("_n").cast("bigint").alias("count"))
            .drop("_k"))


def certificate_totals(medical: DataFrame) -> DataFrame:
    """Records with / without a medical certificate, grades 11 and 12."""
    has_cert = has_medical_file(stored_files(medical, "mr_attachments")[0])
    g11, g12 = F.col("mr_grade_level") == "11", F.col("mr_grade_level") == "12"
    return medical.agg(
        _count_if(has_cert & g11).alias("with_certificates_grade_11"),
        _count_if(has_cert & g12).alias("with_certificates_grade_12"),
        _count_if(~has_cert & g11).alias("without_certificates_grade_11"),
        _count_if(~has_cert & g12).alias("without_certificates_grade_12"),
    )


def _monthly_by_grade(df: DataFrame, date_col: str, grade_col: str, as_of,
                      months: int = 6) -> DataFrame:
    start = as_of_column(as_of) - F.make_ym_interval(F.lit(0), F.lit(months))
    key = F.date_format(date_col, "yyyy-MM")
    return (df.where(F.col(date_col) >= start)
            .groupBy(key.alias("month_key"))
            .agg(_count_if(F.col(grade_col) == "11").alias("grade_11"),
                 _count_if(F.col(grade_col) == "12").alias("grade_12"))
            .orderBy(F.col("month_key").desc())
            .limit(months)
            .select(F.date_format(F.to_date(F.concat("month_key", F.lit("-01"))), "MMM yyyy")
                    .alias("month"), "grade_11", "grade_12"))


def monthly_cases_by_grade(cases: DataFrame, as_of=None, months: int = 6) -> DataFrame:
    """Case counts per month and grade, newest ``months`` since ``as_of``."""
    return _monthly_by_grade(cases, "cr_case_date", "cr_student_grade_level", as_of, months)


def monthly_counseling_by_grade(counseling: DataFrame, as_of=None, months: int = 6) -> DataFrame:
    """Session counts per month and grade, newest ``months`` since ``as_of``."""
    return _monthly_by_grade(counseling, "cor_date", "cor_student_grade_level", as_of, months)


CERTIFICATE_TYPE = "OPD Medical Certificate"


def unread_counts(notifications: DataFrame, receiver: str) -> DataFrame:
    """Unread notifications of one receiver, per type.

    Types are grouped ignoring case (the database rule), spelled as their
    smallest spelling. Rows: one per type (``count``, ``opd_certificate_count``)
    plus a total row (``is_total``, ``n_type`` NULL) whose
    ``opd_certificate_count`` holds the exact-case certificate count the
    handler reports; the total row exists even when nothing is unread.
    Rows are first counted per exact spelling (hash aggregate); both
    outputs are then computed from those few rows.
    """
    unread = notifications.where(ci_eq("n_receiver", receiver) & ci_eq("n_is_read", "No"))
    per_spelling = unread.groupBy("n_type").agg(F.count(F.lit(1)).alias("_n"))
    ci_cert = F.when(ci_eq("n_type", CERTIFICATE_TYPE), F.col("_n")).otherwise(0)
    exact_cert = F.when(F.col("n_type") == CERTIFICATE_TYPE, F.col("_n")).otherwise(0)
    per_type = (per_spelling.groupBy(F.lower("n_type").alias("_k"))
                .agg(F.min("n_type").alias("n_type"),
                     F.sum("_n").cast("bigint").alias("count"),
                     F.sum(ci_cert).cast("bigint").alias("opd_certificate_count"))
                .select("n_type", F.lit(False).alias("is_total"), "count",
                        "opd_certificate_count"))
    total = per_spelling.agg(
        F.lit(None).cast("string").alias("n_type"), F.lit(True).alias("is_total"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(F.sum(exact_cert), F.lit(0)).cast("bigint").alias("opd_certificate_count"))
    return per_type.unionByName(total)


def active_admin_count(users: DataFrame) -> DataFrame:
    """Active administrators and all administrators: the guards of O58/O59."""
    admin = ci_eq("u_type", "Administrator")
    return users.agg(_count_if(admin & ci_eq("u_status", "Active")).alias("active_admins"),
                     _count_if(admin).alias("total_admins"))
