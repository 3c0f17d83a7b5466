"""Registered queries: batch changes, referral confirmation and inbox updates.

Each batch is derived from the whole tables (for example "resolve every
ongoing case"), so its size grows with the data; ``seq`` comes from the
source row's id. The oracle SQL states the resulting rows directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq, iso_millis
from campusledger.operators import changes as C, inbox as I, referrals as R
from campusledger.operators import attachments as A
from campusledger.plans.catalog import register
from campusledger.plans.queries_core import ISO
from campusledger.plans.queries_records import _FILES_CTE, _FILES_SELECT

AS_OF = "2025-06-01 09:00:00"
AS_OF_ISO = "2025-06-01T09:00:00.000Z"
AS_OF_DAY_ISO = "2025-06-01T00:00:00.000Z"
AS_OF_MS = 1748768400000
NEXT_SEMESTER = "2025-2026-1"
HISTORY_ENTRY = f'{{"editedBy":"%s","editedAt":"{AS_OF_ISO}","timestamp":{AS_OF_MS}}}'


def _iso_cols(df, cols):
    return df.withColumns({c: iso_millis(c) for c in cols})


def _hist_sql(col: str, editor: str) -> str:
    entry = HISTORY_ENTRY % editor
    return (f"CASE WHEN coalesce({col}, '') IN ('', '[]') THEN '[{entry}]' "
            f"ELSE rtrim({col}, ']') || ',{entry}]' END")


def _att_sql(col: str) -> str:
    return f"CASE WHEN coalesce({col}, '') IN ('', '[]') THEN NULL ELSE {col} END"


# ---- cases ---------------------------------------------------------------------------

def _case_followups(cases):
    """Batch: a follow-up case in the next semester for every ongoing case."""
    return cases.where(ci_eq("cr_status", "Ongoing")).select(
        F.col("cr_case_id").alias("seq"), F.col("cr_student_id").alias("studentId"),
        F.col("cr_student_name").alias("studentName"),
        F.col("cr_student_strand").alias("strand"),
        F.col("cr_student_grade_level").alias("gradeLevel"),
        F.col("cr_student_section").alias("section"),
        F.lit(NEXT_SEMESTER).alias("schoolYearSemester"),
        F.col("cr_violation_level").alias("violationLevel"), F.lit("Ongoing").alias("status"),
        F.concat(F.lit("follow-up of case "), F.col("cr_case_id").cast("string"))
        .alias("description"),
        F.lit("").alias("remarks"), F.col("cr_referred").alias("referredToGCO"),
        F.col("cr_attachments").alias("existingAttachments"))


_CASE_ROW_SQL = f"""
SELECT (SELECT max(cr_case_id) FROM tbl_case_records) + cr_case_id AS cr_case_id,
       cr_student_id, cr_student_name, cr_student_strand, cr_student_grade_level,
       cr_student_section, '{NEXT_SEMESTER}' AS cr_school_year_semester, cr_violation_level,
       'Ongoing' AS cr_status, '{AS_OF_ISO}' AS cr_case_date, cr_referred,
       CASE WHEN cr_referred = 'Yes' THEN 'Pending' END AS cr_referral_confirmation,
       concat('follow-up of case ', CAST(cr_case_id AS VARCHAR)) AS cr_general_description,
       '' AS cr_additional_remarks, {_att_sql('cr_attachments')} AS cr_attachments,
       '{AS_OF_ISO}' AS cr_create_date, '[]' AS cr_edit_history,
       CAST(NULL AS VARCHAR) AS cr_sender
FROM tbl_case_records WHERE lower(cr_status) = 'ongoing'"""


@register("insert_cases", _CASE_ROW_SQL)
def insert_cases(t):
    w = C.insert_cases(t["tbl_case_records"], _case_followups(t["tbl_case_records"]), AS_OF)
    return _iso_cols(w.rows, ["cr_case_date", "cr_create_date"])


@register("insert_cases_notifications", f"""
WITH r AS ({_CASE_ROW_SQL})
SELECT 'OPD' AS n_sender, 'GCO' AS n_receiver, 'Referral' AS n_type,
       format('New case referral for {{}} ({{}}) - {{}} violation', cr_student_name,
              cr_student_id, cr_violation_level) AS n_message,
       cr_case_id AS n_related_record_id, 'case_record' AS n_related_record_type
FROM r WHERE cr_referred = 'Yes'""")
def insert_cases_notifications(t):
    return C.insert_cases(t["tbl_case_records"], _case_followups(t["tbl_case_records"]),
                          AS_OF).notifications


def _case_resolutions(cases):
    """Batch: resolve every ongoing case, keeping its files."""
    return cases.where(ci_eq("cr_status", "Ongoing")).select(
        F.col("cr_case_id").alias("seq"), F.col("cr_case_id").alias("caseId"),
        F.col("cr_student_id").alias("studentId"), F.col("cr_student_name").alias("studentName"),
        F.col("cr_student_strand").alias("strand"),
        F.col("cr_student_grade_level").alias("gradeLevel"),
        F.col("cr_student_section").alias("section"),
        F.col("cr_school_year_semester").alias("schoolYearSemester"),
        F.col("cr_violation_level").alias("violationLevel"), F.lit("Resolved").alias("status"),
        F.col("cr_general_description").alias("description"), F.lit("closed").alias("remarks"),
        F.col("cr_referred").alias("referredToGCO"),
        F.col("cr_attachments").alias("existingAttachments"))


@register("update_cases", f"""
SELECT cr_case_id, cr_student_id, cr_student_name, cr_student_strand, cr_student_grade_level,
       cr_student_section, cr_school_year_semester, cr_violation_level,
       CASE WHEN u THEN 'Resolved' ELSE cr_status END AS cr_status,
       strftime(cr_case_date, {ISO}) AS cr_case_date, cr_referred,
       CASE WHEN u THEN (CASE WHEN cr_referred = 'Yes' THEN 'Pending' END)
            ELSE cr_referral_confirmation END AS cr_referral_confirmation,
       cr_general_description,
       CASE WHEN u THEN 'closed' ELSE cr_additional_remarks END AS cr_additional_remarks,
       CASE WHEN u THEN {_att_sql('cr_attachments')} ELSE cr_attachments END AS cr_attachments,
       strftime(cr_create_date, {ISO}) AS cr_create_date,
       CASE WHEN u THEN {_hist_sql('cr_edit_history', 'OPD')} ELSE cr_edit_history END
         AS cr_edit_history,
       cr_sender
FROM (SELECT *, lower(cr_status) = 'ongoing' AS u FROM tbl_case_records) c""")
def update_cases(t):
    cases = t["tbl_case_records"]
    w = C.update_cases(cases, _case_resolutions(cases), AS_OF)
    return _iso_cols(w.table, ["cr_case_date", "cr_create_date"])


@register("update_cases_status", """
SELECT cr_case_id AS seq, cr_case_id, 'applied' AS status
FROM tbl_case_records WHERE lower(cr_status) = 'ongoing'""")
def update_cases_status(t):
    cases = t["tbl_case_records"]
    return C.update_cases(cases, _case_resolutions(cases), AS_OF).status


@register("remove_case_attachment", """
SELECT cr_case_id, CASE WHEN cr_attachments IS NULL THEN NULL
       ELSE CAST(NULL AS VARCHAR) END AS cr_attachments
FROM tbl_case_records""")
def remove_case_attachment(t):
    cases = t["tbl_case_records"]
    req = cases.where(F.col("cr_attachments").isNotNull()).select(
        F.col("cr_case_id").alias("record_id"),
        F.concat(F.lit("c"), F.col("cr_case_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return A.remove_attachment(cases, "cr_case_id", "cr_attachments", req) \
        .select("cr_case_id", "cr_attachments")


# ---- counselling ------------------------------------------------------------------------

def _session_completions(counseling):
    """Batch: every scheduled session is marked done."""
    return counseling.where(ci_eq("cor_status", "SCHEDULED")).select(
        F.col("cor_record_id").alias("seq"), F.col("cor_record_id").alias("recordId"),
        F.col("cor_origin_medical_id").alias("originMedicalId"),
        F.col("cor_origin_case_id").alias("originCaseId"),
        F.col("cor_student_id_number").alias("studentId"),
        F.col("cor_student_name").alias("studentName"),
        F.col("cor_student_strand").alias("strand"),
        F.col("cor_student_grade_level").alias("gradeLevel"),
        F.col("cor_student_section").alias("section"),
        F.col("cor_school_year_semester").alias("schoolYearSemester"),
        F.col("cor_session_number").cast("string").alias("sessionNumber"),
        F.lit("DONE").alias("status"), F.col("cor_date").cast("string").alias("date"),
        F.col("cor_time").alias("time"), F.col("cor_general_concern").alias("concern"),
        F.col("cor_additional_remarks").alias("remarks"),
        F.col("cor_is_psychological_condition").alias("psychologicalCondition"))


@register("update_counseling", f"""
SELECT cor_record_id, cor_origin_medical_id, cor_origin_case_id, cor_session_number,
       cor_student_id_number, cor_student_name, cor_student_strand, cor_student_grade_level,
       cor_student_section, cor_school_year_semester,
       CASE WHEN u THEN 'DONE' ELSE cor_status END AS cor_status,
       strftime(cor_date, '%Y-%m-%d %H:%M:%S.%f') AS cor_date, cor_time, cor_general_concern,
       cor_additional_remarks, cor_attachments, cor_is_psychological_condition,
       strftime(cor_create_date, {ISO}) AS cor_create_date,
       CASE WHEN u THEN {_hist_sql('cor_edit_history', 'GCO')} ELSE cor_edit_history END
         AS cor_edit_history
FROM (SELECT *, lower(cor_status) = 'scheduled' AS u FROM tbl_counseling_records) c""")
def update_counseling(t):
    c = t["tbl_counseling_records"]
    w = C.update_counseling(c, _session_completions(c), AS_OF)
    return _iso_cols(w.table, ["cor_create_date"]).withColumn(
        "cor_date", F.date_format("cor_date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _next_sessions(counseling):
    """Batch: a follow-up session for every finished psychological session."""
    return counseling.where(ci_eq("cor_status", "DONE")
                            & ci_eq("cor_is_psychological_condition", "YES")).select(
        F.col("cor_record_id").alias("seq"),
        F.col("cor_origin_medical_id").alias("originMedicalId"),
        F.col("cor_origin_case_id").alias("originCaseId"),
        F.col("cor_student_id_number").alias("studentId"),
        F.col("cor_student_name").alias("studentName"),
        F.col("cor_student_strand").alias("strand"),
        F.col("cor_student_grade_level").alias("gradeLevel"),
        F.col("cor_student_section").alias("section"),
        F.col("cor_school_year_semester").alias("schoolYearSemester"),
        (F.col("cor_session_number") + 1).cast("string").alias("sessionNumber"),
        F.lit("TO SCHEDULE").alias("status"),
        F.concat(F.lit("follow-up "), F.col("cor_record_id").cast("string")).alias("concern"),
        F.col("cor_is_psychological_condition").alias("psychologicalCondition"))


@register("insert_counseling", f"""
SELECT (SELECT max(cor_record_id) FROM tbl_counseling_records) + cor_record_id AS cor_record_id,
       cor_origin_medical_id, cor_origin_case_id,
       CAST(cor_session_number + 1 AS INTEGER) AS cor_session_number,
       cor_student_id_number, cor_student_name, cor_student_strand, cor_student_grade_level,
       cor_student_section, nullif(cor_school_year_semester, '') AS cor_school_year_semester,
       'TO SCHEDULE' AS cor_status, CAST(NULL AS VARCHAR) AS cor_date,
       CAST(NULL AS VARCHAR) AS cor_time,
       concat('follow-up ', CAST(cor_record_id AS VARCHAR)) AS cor_general_concern,
       '' AS cor_additional_remarks, CAST(NULL AS VARCHAR) AS cor_attachments,
       cor_is_psychological_condition, '{AS_OF_ISO}' AS cor_create_date,
       '[]' AS cor_edit_history
FROM tbl_counseling_records
WHERE lower(cor_status) = 'done' AND lower(cor_is_psychological_condition) = 'yes'""")
def insert_counseling(t):
    c = t["tbl_counseling_records"]
    w = C.insert_counseling(c, _next_sessions(c), AS_OF)
    return _iso_cols(w.rows, ["cor_create_date", "cor_date"])


# ---- medical -----------------------------------------------------------------------------

def _medical_followups(medical):
    """Batch: a follow-up record for every ongoing medical record."""
    return medical.where(ci_eq("mr_status", "Ongoing")).select(
        F.col("mr_medical_id").alias("seq"), F.col("mr_student_id").alias("studentId"),
        F.col("mr_student_name").alias("studentName"),
        F.col("mr_student_strand").alias("strand"), F.col("mr_grade_level").alias("gradeLevel"),
        F.col("mr_section").alias("section"),
        F.col("mr_school_year_semester").alias("schoolYearSemester"),
        F.col("mr_subject").alias("subject"), F.lit("For Treatment").alias("status"),
        F.concat(F.lit("follow-up "), F.col("mr_medical_id").cast("string"))
        .alias("medicalDetails"),
        F.lit("").alias("remarks"), F.col("mr_referred").alias("referredToGCO"),
        F.col("mr_is_psychological").alias("isPsychological"),
        F.col("mr_is_medical").alias("isMedical"))


_MED_ROW_SQL = f"""
SELECT (SELECT max(mr_medical_id) FROM tbl_medical_records) + mr_medical_id AS mr_medical_id,
       mr_student_id, mr_student_name, mr_student_strand, mr_grade_level, mr_section,
       mr_school_year_semester, mr_subject, 'For Treatment' AS mr_status,
       concat('follow-up ', CAST(mr_medical_id AS VARCHAR)) AS mr_medical_details,
       '' AS mr_additional_remarks, mr_referred, 'Pending' AS mr_referral_confirmation,
       mr_is_psychological, mr_is_medical, CAST(NULL AS VARCHAR) AS mr_attachments,
       '{AS_OF_DAY_ISO}' AS mr_record_date, '{AS_OF_ISO}' AS mr_create_date,
       '[]' AS mr_edit_history, CAST(NULL AS VARCHAR) AS mr_sender
FROM tbl_medical_records WHERE lower(mr_status) = 'ongoing'"""


@register("insert_medical", _MED_ROW_SQL)
def insert_medical(t):
    m = t["tbl_medical_records"]
    w = C.insert_medical(m, _medical_followups(m), AS_OF)
    return _iso_cols(w.rows, ["mr_record_date", "mr_create_date"])


@register("insert_medical_notifications", f"""
WITH r AS ({_MED_ROW_SQL})
SELECT 'INF' AS n_sender, 'GCO' AS n_receiver, 'Referral' AS n_type,
       format('New {{}} referral for {{}} ({{}})',
              CASE WHEN mr_is_psychological = 'Yes' THEN 'psychological' ELSE 'medical' END,
              mr_student_name, mr_student_id) AS n_message,
       mr_medical_id AS n_related_record_id, 'medical_record' AS n_related_record_type
FROM r WHERE mr_referred = 'Yes'""")
def insert_medical_notifications(t):
    m = t["tbl_medical_records"]
    return C.insert_medical(m, _medical_followups(m), AS_OF).notifications


def _treatments(medical):
    """Batch: every record waiting for treatment is marked treated, files kept."""
    return medical.where(ci_eq("mr_status", "For Treatment")).select(
        F.col("mr_medical_id").alias("seq"), F.col("mr_medical_id").alias("recordId"),
        F.col("mr_student_id").alias("studentId"), F.col("mr_student_name").alias("studentName"),
        F.col("mr_student_strand").alias("strand"), F.col("mr_grade_level").alias("gradeLevel"),
        F.col("mr_section").alias("section"),
        F.col("mr_school_year_semester").alias("schoolYearSemester"),
        F.col("mr_subject").alias("subject"), F.lit("Treated").alias("status"),
        F.col("mr_medical_details").alias("medicalDetails"),
        F.col("mr_additional_remarks").alias("remarks"),
        F.col("mr_referred").alias("referredToGCO"),
        F.col("mr_is_psychological").alias("isPsychological"),
        F.col("mr_is_medical").alias("isMedical"),
        F.col("mr_attachments").alias("existingAttachments"))


_MEDICAL_FILES_SQL = ("CAST(CASE WHEN coalesce(mr_attachments, '') = '' THEN 0 "
                      "ELSE json_array_length(mr_attachments) END AS BIGINT)")
_MEDICAL_FLAGS_SQL = ("CAST(CASE WHEN coalesce(mr_attachments, '') = '' THEN 0 ELSE "
                      "len(list_filter(CAST(json_extract(mr_attachments, '$[*].isMedical') "
                      "AS BOOLEAN[]), lambda x: x)) END AS BIGINT)")


@register("update_medical", f"""
SELECT mr_medical_id, mr_student_id, mr_status, mr_referred, mr_referral_confirmation,
       {_MEDICAL_FILES_SQL} AS file_count, {_MEDICAL_FLAGS_SQL} AS medical_files,
       CAST(json_array_length(mr_edit_history) + CASE WHEN u THEN 1 ELSE 0 END AS BIGINT)
         AS edit_count
FROM (SELECT * REPLACE (CASE WHEN lower(mr_status) = 'for treatment' THEN 'Treated'
                             ELSE mr_status END AS mr_status,
                        CASE WHEN lower(mr_status) = 'for treatment'
                             THEN coalesce(nullif(mr_referred, ''), 'No')
                             ELSE mr_referred END AS mr_referred),
             lower(mr_status) = 'for treatment' AS u
      FROM tbl_medical_records) m""")
def update_medical(t):
    from campusledger.functions.jsoncols import parse_attachments, parse_edit_history
    m = t["tbl_medical_records"]
    w = C.update_medical(m, _treatments(m), AS_OF)
    files = parse_attachments("mr_attachments")
    return w.table.select(
        "mr_medical_id", "mr_student_id", "mr_status", "mr_referred", "mr_referral_confirmation",
        F.size(files).cast("bigint").alias("file_count"),
        F.size(F.filter(files, lambda f: F.coalesce(f["isMedical"], F.lit(False))))
        .cast("bigint").alias("medical_files"),
        F.size(parse_edit_history("mr_edit_history")).cast("bigint").alias("edit_count"))


@register("upload_notifications", f"""
WITH {_FILES_CTE},
files AS ({_FILES_SELECT}),
opd AS (SELECT * FROM files WHERE uploadedBy = 'OPD'),
tgt AS (SELECT * FROM (VALUES ('INF'), ('OPD')) v(r))
SELECT 'OPD' AS n_sender, tgt.r AS n_receiver, 'OPD Medical Certificate' AS n_type,
       format('{{}} uploaded file "{{}}" for {{}} ({{}})', uploadedBy, fileName, studentName,
              studentId) AS n_message,
       recordId AS n_related_record_id, 'medical_record' AS n_related_record_type
FROM opd JOIN tgt ON true""")
def upload_notifications(t):
    files = A.attachment_files(t["tbl_medical_records"], ordered=False)
    uploads = files.where(F.col("uploadedBy") == "OPD").select(
        F.col("recordId").alias("record_id"), F.col("studentId").alias("student_id"),
        F.col("studentName").alias("student_name"), F.col("fileName").alias("file_name"),
        F.col("uploadedBy").alias("sender"))
    return R.upload_notifications(uploads)


# ---- referral confirmation (O55, O56) --------------------------------------------------------

def _case_requests(cases):
    return cases.where(ci_eq("cr_referred", "Yes")).select(F.col("cr_case_id").alias("record_id"))


def _medical_requests(medical):
    return medical.where(ci_eq("mr_referred", "Yes")).select(
        F.col("mr_medical_id").alias("record_id"))


_PENDING_CASE = "lower(cr_referred) = 'yes' AND lower(cr_referral_confirmation) = 'pending'"
_PENDING_MED = "lower(mr_referred) = 'yes' AND lower(mr_referral_confirmation) = 'pending'"


@register("confirm_case_referrals_status", f"""
SELECT cr_case_id AS record_id,
       CASE WHEN coalesce({_PENDING_CASE}, false) THEN 'applied' ELSE 'not_found' END AS status
FROM tbl_case_records WHERE lower(cr_referred) = 'yes'""")
def confirm_case_referrals_status(t):
    cases = t["tbl_case_records"]
    return R.confirm_case_referrals(cases, _case_requests(cases)).status


@register("confirm_case_referrals_counseling", f"""
SELECT CAST(NULL AS BIGINT) AS cor_origin_medical_id, cr_case_id AS cor_origin_case_id,
       1 AS cor_session_number, cr_student_id AS cor_student_id_number,
       cr_student_name AS cor_student_name, cr_student_strand AS cor_student_strand,
       cr_student_grade_level AS cor_student_grade_level,
       cr_student_section AS cor_student_section,
       nullif(cr_school_year_semester, '') AS cor_school_year_semester,
       'TO SCHEDULE' AS cor_status, '' AS cor_general_concern,
       'UNCONFIRMED' AS cor_is_psychological_condition
FROM tbl_case_records WHERE {_PENDING_CASE}""")
def confirm_case_referrals_counseling(t):
    cases = t["tbl_case_records"]
    return R.confirm_case_referrals(cases, _case_requests(cases)).counseling


@register("confirm_case_referrals_notifications", f"""
SELECT 'GCO' AS n_sender, 'OPD' AS n_receiver, 'Acceptance' AS n_type,
       format('Case referral for {{}} ({{}}) has been accepted by GCO', cr_student_name,
              cr_student_id) AS n_message,
       cr_case_id AS n_related_record_id, 'case_record' AS n_related_record_type
FROM tbl_case_records WHERE {_PENDING_CASE}""")
def confirm_case_referrals_notifications(t):
    cases = t["tbl_case_records"]
    return R.confirm_case_referrals(cases, _case_requests(cases)).notifications


@register("confirm_case_referrals_table", f"""
SELECT cr_case_id, CASE WHEN {_PENDING_CASE} THEN 'Accepted'
                        ELSE cr_referral_confirmation END AS cr_referral_confirmation
FROM tbl_case_records""")
def confirm_case_referrals_table(t):
    cases = t["tbl_case_records"]
    return R.confirm_case_referrals(cases, _case_requests(cases)).table.select(
        "cr_case_id", "cr_referral_confirmation")


@register("confirm_medical_referrals_counseling", f"""
SELECT mr_medical_id AS cor_origin_medical_id, CAST(NULL AS BIGINT) AS cor_origin_case_id,
       1 AS cor_session_number, mr_student_id AS cor_student_id_number,
       mr_student_name AS cor_student_name, mr_student_strand AS cor_student_strand,
       mr_grade_level AS cor_student_grade_level, mr_section AS cor_student_section,
       nullif(mr_school_year_semester, '') AS cor_school_year_semester,
       'TO SCHEDULE' AS cor_status, '' AS cor_general_concern,
       CASE WHEN mr_is_psychological = 'Yes' THEN 'YES' ELSE 'NO' END
         AS cor_is_psychological_condition
FROM tbl_medical_records WHERE {_PENDING_MED}""")
def confirm_medical_referrals_counseling(t):
    med = t["tbl_medical_records"]
    return R.confirm_medical_referrals(med, _medical_requests(med)).counseling


@register("confirm_medical_referrals_status", f"""
SELECT mr_medical_id AS record_id,
       CASE WHEN coalesce({_PENDING_MED}, false) THEN 'applied' ELSE 'not_found' END AS status
FROM tbl_medical_records WHERE lower(mr_referred) = 'yes'""")
def confirm_medical_referrals_status(t):
    med = t["tbl_medical_records"]
    return R.confirm_medical_referrals(med, _medical_requests(med)).status


@register("confirm_medical_referrals_notifications", f"""
SELECT 'GCO' AS n_sender, 'INF' AS n_receiver, 'Acceptance' AS n_type,
       format('Medical referral for {{}} ({{}}) has been accepted by GCO', mr_student_name,
              mr_student_id) AS n_message,
       mr_medical_id AS n_related_record_id, 'medical_record' AS n_related_record_type
FROM tbl_medical_records WHERE {_PENDING_MED}""")
def confirm_medical_referrals_notifications(t):
    med = t["tbl_medical_records"]
    return R.confirm_medical_referrals(med, _medical_requests(med)).notifications


# ---- notifications (O57) ---------------------------------------------------------------------

@register("mark_read", """
SELECT n_id, CASE WHEN n_type = 'Referral' THEN 'Yes' ELSE n_is_read END AS n_is_read
FROM tbl_notifications""")
def mark_read(t):
    n = t["tbl_notifications"]
    ids = n.where(F.col("n_type") == "Referral").select("n_id")
    return I.mark_read(n, ids).table.select("n_id", "n_is_read")


@register("mark_all_read", """
SELECT CAST(count_if(lower(n_receiver) = 'gco' AND lower(n_is_read) = 'no') AS BIGINT)
  AS affectedRows FROM tbl_notifications""")
def mark_all_read(t):
    return I.mark_all_read(t["tbl_notifications"], "GCO").status


@register("mark_all_read_table", """
SELECT n_id, n_receiver, CASE WHEN lower(n_receiver) = 'gco' AND lower(n_is_read) = 'no'
                              THEN 'Yes' ELSE n_is_read END AS n_is_read
FROM tbl_notifications""")
def mark_all_read_table(t):
    return I.mark_all_read(t["tbl_notifications"], "GCO").table.select(
        "n_id", "n_receiver", "n_is_read")


# ---- students (O48d, O49d, O50) --------------------------------------------------------------

_STUDENT_API = (("sd_id_number", "id"), ("sd_student_name", "name"), ("sd_strand", "strand"),
                ("sd_grade_level", "gradeLevel"), ("sd_section", "section"),
                ("sd_gender", "gender"), ("sd_religion", "religion"),
                ("sd_previous_school", "previousSchool"), ("sd_status", "status"),
                ("sd_birthdate", "birthdate"), ("sd_school_year_sem", "schoolYearSem"))


def _student_change(students, where, overrides):
    cols = [F.col(s).alias(a) if a not in overrides else overrides[a].alias(a)
            for s, a in _STUDENT_API]
    # seq from the numeric student id: deterministic if a task is recomputed
    return students.where(where).select(
        F.col("sd_id_number").cast("bigint").alias("seq"), *cols,
        overrides.get("schoolYearSemesterr", F.col("sd_school_year_semesterr"))
        .alias("schoolYearSemesterr"))


_ENROLLED = "2023-2024-1"


@register("insert_students", f"""
SELECT sd_id_number, sd_student_name, sd_strand, '12' AS sd_grade_level, sd_section, sd_gender,
       sd_religion, sd_previous_school, sd_status, strftime(sd_birthdate, '%Y-%m-%d') AS sd_birthdate,
       sd_school_year_sem, '{NEXT_SEMESTER}' AS sd_school_year_semesterr
FROM tbl_student_data WHERE sd_school_year_semesterr = '{_ENROLLED}'""")
def insert_students(t):
    s = t["tbl_student_data"]
    ch = _student_change(s, F.col("sd_school_year_semesterr") == _ENROLLED,
                         {"gradeLevel": F.lit("12"),
                          "schoolYearSemesterr": F.lit(NEXT_SEMESTER)})
    rows = C.insert_students(s, ch).rows
    return rows.withColumn("sd_birthdate", F.date_format("sd_birthdate", "yyyy-MM-dd"))


@register("update_students", f"""
WITH c AS (SELECT * FROM tbl_student_data
           WHERE lower(sd_strand) = 'building' AND sd_school_year_semesterr = '{_ENROLLED}')
SELECT s.sd_id_number,
       coalesce(c.sd_student_name, s.sd_student_name) AS sd_student_name,
       coalesce(c.sd_strand, s.sd_strand) AS sd_strand,
       coalesce(c.sd_grade_level, s.sd_grade_level) AS sd_grade_level,
       coalesce(c.sd_section, s.sd_section) AS sd_section,
       CASE WHEN c.sd_id_number IS NULL THEN s.sd_status ELSE 'Transferred' END AS sd_status,
       CASE WHEN c.sd_id_number IS NULL THEN s.sd_school_year_semesterr
            ELSE c.sd_school_year_semesterr END AS sd_school_year_semesterr
FROM tbl_student_data s LEFT JOIN c ON s.sd_id_number = c.sd_id_number""")
def update_students(t):
    s = t["tbl_student_data"]
    ch = _student_change(s, ci_eq("sd_strand", "BUILDING")
                         & (F.col("sd_school_year_semesterr") == _ENROLLED),
                         {"status": F.lit("Transferred")})
    return C.update_students(s, ch).table.select(
        "sd_id_number", "sd_student_name", "sd_strand", "sd_grade_level", "sd_section",
        "sd_status", "sd_school_year_semesterr")


@register("delete_students", """
SELECT sd_id_number, sd_school_year_semesterr FROM tbl_student_data s
WHERE EXISTS (SELECT 1 FROM tbl_case_records c WHERE c.cr_student_id = s.sd_id_number)""")
def delete_students(t):
    s, cases = t["tbl_student_data"], t["tbl_case_records"]
    ids = s.select(F.col("sd_id_number").alias("id")).distinct() \
        .join(cases.select(F.col("cr_student_id").alias("id")), "id", "left_anti") \
        .withColumn("seq", F.col("id").cast("bigint"))
    return C.delete_students(s, ids).table.select("sd_id_number", "sd_school_year_semesterr")


# ---- users (O48e, O49e, O58, O59) ---------------------------------------------------------------

_USER_SEQ = "CAST(regexp_extract(u_email, 'u([0-9]+)@', 1) AS BIGINT)"


def _user_seq():
    return F.regexp_extract("u_email", r"u([0-9]+)@", 1).cast("bigint")


@register("insert_users", f"""
SELECT {_USER_SEQ} AS seq, concat('new.', u_email) AS email,
       CASE WHEN lower(u_status) = 'inactive' THEN 'applied'
            ELSE 'rejected:duplicate:username' END AS status
FROM users""")
def insert_users(t):
    u = t["users"]
    ch = u.select(_user_seq().alias("seq"), F.concat(F.lit("new."), "u_email").alias("email"),
                  F.when(ci_eq("u_status", "Inactive"), F.concat(F.lit("new"), "u_username"))
                  .otherwise(F.col("u_username")).alias("username"),
                  F.col("u_name").alias("name"), F.col("u_department").alias("department"),
                  F.col("u_type").alias("userType"), F.lit("secret").alias("password"))
    return C.insert_users(u, ch, AS_OF).status


@register("update_users", """
SELECT u_email, u_username, u_name,
       CASE WHEN lower(u_department) = 'gco' THEN 'Guidance' ELSE u_department END
         AS u_department, u_type, u_status
FROM users""")
def update_users(t):
    u = t["users"]
    ch = u.where(ci_eq("u_department", "GCO")).select(
        _user_seq().alias("seq"), F.col("u_email").alias("email"),
        F.lit("Guidance").alias("department"))
    return C.update_users(u, ch).table.select("u_email", "u_username", "u_name", "u_department",
                                              "u_type", "u_status")


@register("deactivate_users", f"""
WITH r AS (SELECT {_USER_SEQ} AS seq, u_email AS email, u_type, u_status FROM users
           WHERE lower(u_type) = 'administrator'),
a AS (SELECT count(*) AS n FROM users
      WHERE lower(u_type) = 'administrator' AND lower(u_status) = 'active'),
p AS (SELECT r.*, coalesce(sum(CASE WHEN u_type = 'Administrator' AND lower(u_status) = 'active'
                                    THEN 1 ELSE 0 END)
                  OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS prior FROM r)
SELECT seq, email,
       CASE WHEN u_type = 'Administrator' AND a.n - least(prior, greatest(a.n - 1, 0)) <= 1
            THEN 'rejected:last_active_administrator'
            WHEN lower(u_status) <> 'active' THEN 'rejected:already_inactive'
            ELSE 'applied' END AS status
FROM p, a""")
def deactivate_users(t):
    u = t["users"]
    req = u.where(ci_eq("u_type", "Administrator")).select(
        _user_seq().alias("seq"), F.col("u_email").alias("email"))
    return C.deactivate_users(u, req, AS_OF).status


@register("activate_users", f"""
SELECT {_USER_SEQ} AS seq, u_email AS email,
       CASE WHEN lower(u_status) = 'inactive' THEN 'applied' ELSE 'rejected:already_active' END
         AS status
FROM users""")
def activate_users(t):
    u = t["users"]
    return C.activate_users(u, u.select(_user_seq().alias("seq"),
                                        F.col("u_email").alias("email"))).status


@register("delete_users", f"""
WITH r AS (SELECT {_USER_SEQ} AS seq, u_email AS email, u_type, u_status FROM users),
a AS (SELECT count(*) AS n FROM users WHERE lower(u_type) = 'administrator'),
p AS (SELECT r.*, coalesce(sum(CASE WHEN u_type = 'Administrator' AND u_status <> 'Active'
                                    THEN 1 ELSE 0 END)
                  OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS prior FROM r)
SELECT seq, email,
       CASE WHEN u_status = 'Active' THEN 'rejected:active_user'
            WHEN u_type = 'Administrator' AND a.n - prior <= 1 THEN 'rejected:last_administrator'
            ELSE 'applied' END AS status
FROM p, a""")
def delete_users(t):
    u = t["users"]
    return C.delete_users(u, u.select(_user_seq().alias("seq"),
                                      F.col("u_email").alias("email"))).status


# ---- bulk import (O60-O65) --------------------------------------------------------------------
# The import file is derived from the case records: one row per case with the
# student's fields, headers in mixed case and spacing, status left blank. A
# student with several cases in one semester repeats in the file; keys already
# stored in the student table are duplicates too.

def _import_rows(cases):
    from campusledger.operators import imports as IM
    raw = cases.select(
        F.col("cr_case_id").alias("pos"),
        F.col("cr_student_id").alias(" ID Number "),
        F.concat(F.lit(" "), F.col("cr_student_name")).alias("Student Name"),
        F.col("cr_student_strand").alias("STRAND"),
        F.col("cr_student_grade_level").alias("Grade"),
        F.col("cr_student_section").alias("Section"),
        F.lit("").alias("Status"),
        F.col("cr_school_year_semester").alias("School Year and Semester"))
    return IM.map_csv_rows(raw)


_IMPORT_SQL = """
WITH f AS (SELECT cr_case_id AS pos, trim(cr_student_id) AS id,
                  trim(' ' || cr_student_name) AS name,
                  trim(cr_school_year_semester) AS sem FROM tbl_case_records),
v AS (SELECT * FROM f WHERE id <> '' AND name <> ''),
firsts AS (SELECT lower(id) AS k1, lower(sem) AS k2, min(pos) AS mp FROM v GROUP BY 1, 2),
stored AS (SELECT DISTINCT lower(sd_id_number) AS k1, lower(sd_school_year_semesterr) AS k2
           FROM tbl_student_data),
m AS (SELECT v.*, (v.pos <> firsts.mp OR stored.k1 IS NOT NULL) AS dup
      FROM v JOIN firsts ON lower(v.id) = firsts.k1 AND lower(v.sem) = firsts.k2
      LEFT JOIN stored ON lower(v.id) = stored.k1 AND lower(v.sem) = stored.k2)"""


@register("import_students_summary", _IMPORT_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total_records,
       CAST(count_if(NOT dup) AS BIGINT) AS successful_imports,
       CAST(0 AS BIGINT) AS failed_imports,
       CAST(count_if(dup) AS BIGINT) AS duplicates_found,
       CASE WHEN count(*) = 0 THEN 'No valid student data found in the file.' END AS error
FROM m""")
def import_students_summary(t):
    from campusledger.operators import imports as IM
    return IM.import_students(t["tbl_student_data"],
                              _import_rows(t["tbl_case_records"])).summary


@register("import_students_inserted", _IMPORT_SQL + """
SELECT m.id AS sd_id_number, m.name AS sd_student_name, c.cr_student_strand AS sd_strand,
       c.cr_student_grade_level AS sd_grade_level, c.cr_student_section AS sd_section,
       'Active' AS sd_status, m.sem AS sd_school_year_semesterr
FROM m JOIN tbl_case_records c ON c.cr_case_id = m.pos WHERE NOT dup""")
def import_students_inserted(t):
    from campusledger.operators import imports as IM
    res = IM.import_students(t["tbl_student_data"], _import_rows(t["tbl_case_records"]))
    return res.inserted.select("sd_id_number", "sd_student_name", "sd_strand", "sd_grade_level",
                               "sd_section", "sd_status", "sd_school_year_semesterr")


@register("import_students_messages", _IMPORT_SQL + """
SELECT pos, format('Duplicate: {} for semester {}', id, sem) AS message
FROM m WHERE dup ORDER BY pos LIMIT 10""")
def import_students_messages(t):
    from campusledger.operators import imports as IM
    return IM.import_students(t["tbl_student_data"],
                              _import_rows(t["tbl_case_records"])).messages


# Sheet form: the student table laid out as cells under a header row; the
# birthdate is written as a spreadsheet day count.
SHEET_HEADERS = ["ID Number", "Name", "Strand", "Grade", "Section", "Religion",
                 "Previous School", "Gender", "Status", "Birthdate", "Semester"]


@register("import_sheet_cells", """
SELECT sd_id_number AS id, sd_student_name AS name, sd_strand AS strand,
       sd_grade_level AS gradeLevel, sd_section AS section, sd_religion AS religion,
       sd_previous_school AS previousSchool, sd_gender AS gender, sd_status AS status,
       strftime(sd_birthdate, '%Y-%m-%d') AS birthdate, 0 AS schoolYearSem,
       sd_school_year_semesterr AS schoolYearSemesterr
FROM tbl_student_data""")
def import_sheet_cells(t):
    from campusledger.operators import imports as IM
    from campusledger.sources.files import read_import_cells
    s = t["tbl_student_data"]
    spark = s.sparkSession
    header = spark.createDataFrame([("0", SHEET_HEADERS)], "row_no string, cells array<string>")
    serial = F.date_diff(F.col("sd_birthdate"), F.lit("1899-12-30").cast("date")).cast("string")
    data = s.select(
        F.concat(F.lit("1|"), "sd_id_number", F.lit("|"), "sd_school_year_semesterr")
        .alias("row_no"),
        F.array("sd_id_number", "sd_student_name", "sd_strand", "sd_grade_level", "sd_section",
                "sd_religion", "sd_previous_school", "sd_gender", "sd_status", serial,
                "sd_school_year_semesterr").alias("cells"))
    headers, rows = read_import_cells(header.unionByName(data))
    out = IM.map_sheet_cells(rows, headers)
    return out.drop("pos", "birthdateText").withColumn("birthdate", F.date_format("birthdate", "yyyy-MM-dd"))
