"""Registered queries over clustered tables, posting tables and kept partial results.

Each writes the record table in its layout below the shared folder, runs the same
screen or batch through it, and is held against the SQL of the plain query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq
from campusledger.operators import attachments as A
from campusledger.operators import changes as C
from campusledger.operators import kpis as K
from campusledger.operators import projections as P
from campusledger.operators import rollups as R
from campusledger.operators import summaries as S
from campusledger.operators import text_search as X
from campusledger.plans.catalog import register
from campusledger.plans.queries_changes import AS_OF, _case_resolutions, _iso_cols
from campusledger.plans.queries_core import _CASE, _summary_sql
from campusledger.plans.queries_records import (CASE_TEXT, COUNSELING_TEXT, MEDICAL_REFERRED_TEXT, MEDICAL_TEXT, STUDENT_ID,
                                                STUDENT_TEXT, USER_TEXT, _cases, _counseling, _medical)
from campusledger.session import checkpoint_dir
from campusledger.sources import clustered as L


def _folder(df) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/layout-{uuid.uuid4().hex}"


def _clustered(table, layout) -> str:
    path = _folder(table)
    L.write_clustered(table, path, layout)
    return path


# ---- changes of parts (O49, O50) ---------------------------------------------------------------

@register("update_cases_in_parts", same_as="update_cases")
def update_cases_in_parts(t):
    cases = t["tbl_case_records"]
    layout = L.fitted(cases, L.LAYOUTS["tbl_case_records"]._replace(size=2_000))
    path = _clustered(cases, layout)
    w = L.change_parts(cases.sparkSession, path, layout, _case_resolutions(cases), "caseId",
                       lambda table, requests: C.update_cases(table, requests, AS_OF))
    return _iso_cols(w.table, ["cr_case_date", "cr_create_date"]).select(C.CASE_ORDER)


@register("delete_students_in_parts", """
SELECT sd_id_number, sd_school_year_semesterr FROM tbl_student_data WHERE sd_id_number NOT LIKE '%3'""")
def delete_students_in_parts(t):
    students, layout = t["tbl_student_data"], L.LAYOUTS["tbl_student_data"]._replace(size=64)
    path = _clustered(students, layout)
    ids = students.where(F.col("sd_id_number").endswith("3")).select(F.col("sd_id_number").alias("id")).distinct()
    w = L.change_parts(students.sparkSession, path, layout, ids.withColumn("seq", F.xxhash64("id")), "id", C.delete_students)
    return w.table.select("sd_id_number", "sd_school_year_semesterr")


# ---- look-ups (O17b) ---------------------------------------------------------------------------

@register("cases_of_student_in_part", f"""
SELECT cr_case_id, cr_student_id FROM tbl_case_records WHERE lower(cr_student_id) = lower('{STUDENT_ID}')""")
def cases_of_student_in_part(t):
    cases, layout = t["tbl_case_records"], L.BY_STUDENT["tbl_case_records"]._replace(size=64)
    path = _clustered(cases, layout)
    return L.rows_of(cases.sparkSession, path, layout, "cr_student_id", STUDENT_ID).select("cr_case_id", "cr_student_id")


# ---- searches through trigrams (O18, O19) ---------------------------------------------------------

def _through(t, name, text, **settings):
    table, (key, columns) = t[name], X.SEARCHES[name]
    spark, layout = table.sparkSession, L.LAYOUTS[name]
    layout = L.fitted(table, layout._replace(size=64 if layout.text else 2_000))
    path, postings = _clustered(table, layout), _folder(table)
    X.write_postings(table, key, columns, postings)
    return X.search_through(spark, name, text, postings, lambda c: X.narrowed_parts(spark, path, layout, c), **settings)


@register("case_search_trigrams", same_as="case_search")
def case_search_trigrams(t):
    return _cases(_through(t, "tbl_case_records", CASE_TEXT))


@register("counseling_search_trigrams", same_as="counseling_search")
def counseling_search_trigrams(t):
    return _counseling(_through(t, "tbl_counseling_records", COUNSELING_TEXT))


@register("student_search_trigrams", same_as="student_search")
def student_search_trigrams(t):
    return P.student_projection(_through(t, "tbl_student_data", STUDENT_TEXT))


@register("user_search_trigrams", same_as="user_search")
def user_search_trigrams(t):
    return P.user_projection(_through(t, "users", USER_TEXT))


@register("medical_search_trigrams", same_as="medical_search")
def medical_search_trigrams(t):
    return _medical(_through(t, "tbl_medical_records", MEDICAL_TEXT, kind="MEDICAL"))


@register("medical_referred_search_trigrams", same_as="medical_referred_search")
def medical_referred_search_trigrams(t):
    return _medical(_through(t, "tbl_medical_records", MEDICAL_REFERRED_TEXT, referred=True))


# ---- files parsed when they are stored (O31, O41-O43) ----------------------------------------------

def _parsed(t):
    medical = t["tbl_medical_records"]
    return L.read_clustered(medical.sparkSession, _clustered(medical, L.LAYOUTS["tbl_medical_records"]), parsed=True)


@register("attachment_files_parsed", same_as="attachment_files")
def attachment_files_parsed(t):
    return A.attachment_files(_parsed(t))


@register("certificate_totals_parsed", same_as="certificate_totals")
def certificate_totals_parsed(t):
    return K.certificate_totals(_parsed(t))


@register("opd_uploads_parsed", same_as="opd_uploads")
def opd_uploads_parsed(t):
    from campusledger.plans.queries_records import opd_uploads
    return opd_uploads({**t, "tbl_medical_records": _parsed(t)})


# ---- summaries and totals after a batch (O23, O32) ----------------------------------------------------

_AFTER = """(SELECT * REPLACE (CASE WHEN lower(cr_status) = 'ongoing' THEN 'Resolved' ELSE cr_status END AS cr_status)
             FROM tbl_case_records WHERE cr_case_id % 5 <> 1 OR lower(cr_status) <> 'ongoing')"""


def _batch(cases):
    """Every ongoing case is resolved, and every fifth id of them taken away instead."""
    old = cases.where(ci_eq("cr_status", "Ongoing"))
    new = old.where(F.col("cr_case_id") % 5 != 1).withColumn("cr_status", F.lit("Resolved"))
    return old, new, cases.where(~ci_eq("cr_status", "Ongoing")).unionByName(new)


@register("student_case_summary_after_batch", _summary_sql(**{**_CASE, "records": _AFTER}))
def student_case_summary_after_batch(t):
    cases = t["tbl_case_records"]
    old, new, after = _batch(cases)
    kept = R.update_partials(S.partial_counts(cases, S.CASES), old, new, after, S.CASES)
    return R.summary_of(t["tbl_student_data"], kept, S.CASES)


@register("monthly_cases_after_batch", f"""
SELECT strftime(cr_case_date, '%Y-%m') AS month_key, count(*) AS rows,
       count(*) FILTER (cr_student_grade_level = '11') AS grade_11,
       count(*) FILTER (cr_student_grade_level = '12') AS grade_12
FROM {_AFTER} AS c GROUP BY 1""")
def monthly_cases_after_batch(t):
    cases = t["tbl_case_records"]
    old, new, _ = _batch(cases)
    keys, measures = R.monthly_counts("cr_case_date", "cr_student_grade_level")
    return R.update_counts(R.count_table(cases, keys, measures), old, new, keys, measures)
