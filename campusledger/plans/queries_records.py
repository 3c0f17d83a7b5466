"""Registered queries: record lists, filters, searches, JSON attachments,
referrals and the inbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from campusledger.operators import attachments as A, filters as Fl, inbox as I, \
    projections as P, referrals as R
from campusledger.plans.catalog import register
from campusledger.plans.queries_core import ISO

# Parameters of the registered runs.
STUDENT_ID = "000010"
CASE_TEXT = "minor"
COUNSELING_TEXT = "DONE"
STUDENT_TEXT = "BUILDING"
USER_TEXT = "admin"
MEDICAL_TEXT = "2024-2025-1"
MEDICAL_REFERRED_TEXT = "50%_details 1"
INBOX_RECEIVER = "INF"

# ---- SQL select lists mirroring the projections ------------------------------

CASE_SQL = f"""cr_case_id AS caseNo, cr_student_id AS id, cr_student_name AS name,
  cr_student_strand AS strand, cr_student_grade_level AS gradeLevel, cr_student_section AS section,
  cr_school_year_semester AS schoolYearSemester, cr_violation_level AS violationLevel,
  cr_status AS status, strftime(cr_case_date, '%m/%d/%Y') AS date, cr_referred AS referred,
  cr_referral_confirmation AS referralConfirmation, cr_general_description AS description,
  cr_additional_remarks AS remarks, cr_attachments AS attachments,
  strftime(cr_create_date, {ISO}) AS createDate, cr_edit_history AS editDate"""

COUNSELING_SQL = f"""cor_record_id AS recordId, cor_origin_medical_id AS originMedicalId,
  cor_origin_case_id AS originCaseId, cor_session_number AS sessionNumber,
  cor_student_id_number AS id, cor_student_name AS name, cor_student_strand AS strand,
  cor_student_grade_level AS gradeLevel, cor_student_section AS section,
  cor_school_year_semester AS schoolYearSemester, cor_status AS status,
  strftime(cor_date, '%m/%d/%Y') AS date, substr(cor_time, 1, 5) AS time,
  cor_general_concern AS concern, cor_additional_remarks AS remarks,
  cor_attachments AS attachments, cor_is_psychological_condition AS psychologicalCondition,
  strftime(cor_create_date, {ISO}) AS createDate, cor_edit_history AS editDate"""

MEDICAL_SQL = f"""mr_medical_id AS recordId, mr_student_id AS id, mr_student_name AS name,
  mr_student_strand AS strand, mr_subject AS subject, mr_status AS status,
  mr_grade_level AS gradeLevel, mr_section AS section,
  mr_school_year_semester AS schoolYearSemester, mr_medical_details AS medicalDetails,
  mr_additional_remarks AS remarks, mr_attachments AS attachments, mr_referred AS referred,
  mr_referral_confirmation AS referralConfirmation, mr_is_psychological AS isPsychological,
  mr_is_medical AS isMedical, strftime(mr_record_date, '%m/%d/%Y') AS date,
  strftime(mr_create_date, {ISO}) AS createDate, mr_edit_history AS editDate"""

INFIRMARY_SQL = f"""mr_medical_id AS recordId, mr_student_id AS id, mr_student_name AS name,
  mr_student_strand AS strand, mr_grade_level AS gradeLevel, mr_section AS section,
  mr_school_year_semester AS schoolYearSemester, mr_subject AS subject, mr_status AS status,
  mr_medical_details AS medicalDetails, mr_additional_remarks AS remarks,
  mr_attachments AS attachments, mr_is_psychological AS isPsychological,
  mr_is_medical AS isMedical, strftime(mr_record_date, '%m/%d/%Y') AS date,
  strftime(mr_create_date, {ISO}) AS createDate, mr_edit_history AS editDate"""

USER_SQL = """u_email AS email, u_username AS username, u_name AS name,
  u_department AS department, u_type AS userType, u_status AS status,
  strftime(created_at, '%m/%d/%Y %I:%M %p') AS createdAt,
  strftime(deactivated_at, '%m/%d/%Y %I:%M %p') AS deactivatedAt"""

STUDENT_SQL = """sd_id_number AS id, sd_student_name AS name, sd_strand AS strand,
  sd_grade_level AS gradeLevel, sd_section AS section, sd_gender AS gender,
  sd_religion AS religion, sd_previous_school AS previousSchool, sd_status AS status,
  strftime(sd_birthdate, '%Y-%m-%d') AS birthdate, sd_school_year_sem AS schoolYearSem,
  sd_school_year_semesterr AS schoolYearSemesterr"""

NOTIFICATION_SQL = f"""n_id, n_sender, n_receiver, n_type, n_message, n_is_read,
  strftime(n_created_at, {ISO}) AS n_created_at, n_related_record_id, n_related_record_type"""

_MED = {"MEDICAL": ("yes", "no"), "PSYCHOLOGICAL": ("no", "yes"),
        "MEDICALPSYCHOLOGICAL": ("yes", "yes")}


def _kind_sql(kind: str) -> str:
    m, p = _MED[kind]
    return f"lower(mr_is_medical) = '{m}' AND lower(mr_is_psychological) = '{p}'"


def _like_any(cols, pattern: str, escape: bool = False) -> str:
    esc = " ESCAPE '\\'" if escape else ""
    return "(" + " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '{pattern}'{esc}" for c in cols) + ")"


def _cases(t):
    return P.case_projection(t, parse_json=False)


def _counseling(t):
    return P.counseling_projection(t, parse_json=False)


def _medical(t):
    return P.medical_projection(t, parse_json=False)


# ---- projections (O7-O13) -------------------------------------------------------

@register("case_records", f"SELECT {CASE_SQL} FROM tbl_case_records")
def case_records(t):
    return _cases(Fl.order_by_numeric_id(t["tbl_case_records"], "cr_case_id"))


@register("counseling_records", f"SELECT {COUNSELING_SQL} FROM tbl_counseling_records")
def counseling_records(t):
    return _counseling(Fl.order_by_numeric_id(t["tbl_counseling_records"], "cor_record_id"))


@register("medical_records", f"SELECT {MEDICAL_SQL} FROM tbl_medical_records")
def medical_records(t):
    return _medical(Fl.medical_list(t["tbl_medical_records"], "ALL"))


@register("infirmary_records_medical",
          f"SELECT {INFIRMARY_SQL} FROM tbl_medical_records WHERE {_kind_sql('MEDICAL')}")
def infirmary_records_medical(t):
    return P.infirmary_projection(Fl.infirmary_list(t["tbl_medical_records"], "MEDICAL"),
                                  parse_json=False)


@register("user_list", f"SELECT {USER_SQL} FROM users")
def user_list(t):
    users = t["users"].orderBy(F.col("created_at").desc_nulls_last(), "u_email")
    return P.user_projection(users)


@register("user_directory", f"""SELECT u_email, u_username, u_name, u_department, u_type,
  u_status, strftime(created_at, {ISO}) AS created_at,
  strftime(deactivated_at, {ISO}) AS deactivated_at FROM users""")
def user_directory(t):
    from campusledger.functions.semantics import iso_millis
    return P.user_directory(t["users"]).withColumns({
        "created_at": iso_millis("created_at"), "deactivated_at": iso_millis("deactivated_at")})


@register("student_list", f"SELECT DISTINCT {STUDENT_SQL} FROM tbl_student_data")
def student_list(t):
    return Fl.distinct_students(t["tbl_student_data"])


@register("notification_list", f"SELECT {NOTIFICATION_SQL} FROM tbl_notifications")
def notification_list(t):
    return P.notification_projection(t["tbl_notifications"])


# ---- filters (O14-O16) ----------------------------------------------------------

@register("case_level_filter",
          f"SELECT {CASE_SQL} FROM tbl_case_records WHERE lower(cr_violation_level) = 'minor'")
def case_level_filter(t):
    return _cases(Fl.case_level_filter(t["tbl_case_records"], "minor"))


@register("case_level_filter_unknown", f"SELECT {CASE_SQL} FROM tbl_case_records")
def case_level_filter_unknown(t):
    return _cases(Fl.case_level_filter(t["tbl_case_records"], "Critical"))


@register("counseling_status_filter", f"""SELECT {COUNSELING_SQL} FROM tbl_counseling_records
WHERE lower(cor_status) = 'to schedule'""")
def counseling_status_filter(t):
    return _counseling(Fl.counseling_status_filter(t["tbl_counseling_records"], "to_schedule"))


@register("medical_condition_psychological",
          f"SELECT {MEDICAL_SQL} FROM tbl_medical_records WHERE {_kind_sql('PSYCHOLOGICAL')}")
def medical_condition_psychological(t):
    return _medical(Fl.medical_list(t["tbl_medical_records"], "PSYCHOLOGICAL"))


@register("referred_cases",
          f"SELECT {CASE_SQL} FROM tbl_case_records WHERE lower(cr_referred) = 'yes'")
def referred_cases(t):
    return _cases(Fl.referred_cases(t["tbl_case_records"]))


@register("referred_medical", f"""SELECT {MEDICAL_SQL} FROM tbl_medical_records
WHERE lower(mr_referred) = 'yes' AND {_kind_sql('MEDICALPSYCHOLOGICAL')}""")
def referred_medical(t):
    return _medical(Fl.referred_medical(t["tbl_medical_records"], "MEDICALPSYCHOLOGICAL"))


@register("psychological_counseling", f"""SELECT {COUNSELING_SQL} FROM tbl_counseling_records
WHERE lower(cor_is_psychological_condition) = 'yes'""")
def psychological_counseling(t):
    return _counseling(Fl.psychological_counseling(t["tbl_counseling_records"]))


@register("active_users", f"SELECT {USER_SQL} FROM users WHERE lower(u_status) = 'active'")
def active_users(t):
    return P.user_projection(Fl.active_users(t["users"]))


# ---- look-ups (O17) -------------------------------------------------------------

@register("cases_by_ids", f"""SELECT {CASE_SQL} FROM tbl_case_records
WHERE cr_case_id IN (SELECT cor_origin_case_id FROM tbl_counseling_records)""")
def cases_by_ids(t):
    ids = t["tbl_counseling_records"].select(F.col("cor_origin_case_id").alias("cr_case_id"))
    return _cases(Fl.records_by_ids(t["tbl_case_records"], "case", ids))


@register("student_by_id", f"""SELECT {STUDENT_SQL} FROM tbl_student_data
WHERE lower(sd_id_number) = '{STUDENT_ID}' AND sd_school_year_semesterr =
  (SELECT max(sd_school_year_semesterr) FROM tbl_student_data WHERE lower(sd_id_number) = '{STUDENT_ID}')""")
def student_by_id(t):
    return P.student_projection(Fl.record_by_id(t["tbl_student_data"], "student", STUDENT_ID))


@register("cases_by_student", f"""SELECT {CASE_SQL} FROM tbl_case_records
WHERE lower(cr_student_id) = '{STUDENT_ID}'""")
def cases_by_student(t):
    return _cases(Fl.records_by_student(t["tbl_case_records"], "case", STUDENT_ID))


@register("counseling_by_student_psychological", f"""SELECT {COUNSELING_SQL}
FROM tbl_counseling_records WHERE lower(cor_student_id_number) = '{STUDENT_ID}'
  AND lower(cor_is_psychological_condition) = 'yes'""")
def counseling_by_student_psychological(t):
    return _counseling(Fl.records_by_student(t["tbl_counseling_records"], "counseling",
                                             STUDENT_ID, psychological=True))


@register("medical_by_student_medical", f"""SELECT {MEDICAL_SQL} FROM tbl_medical_records
WHERE lower(mr_student_id) = '{STUDENT_ID}' AND {_kind_sql('MEDICAL')}""")
def medical_by_student_medical(t):
    return _medical(Fl.records_by_student(t["tbl_medical_records"], "medical", STUDENT_ID,
                                          condition="MEDICAL"))


# ---- searches (O18, O19) ----------------------------------------------------------

@register("case_search", f"""SELECT {CASE_SQL} FROM tbl_case_records
WHERE {_like_any(Fl.CASE_SEARCH, '%' + CASE_TEXT + '%')}""")
def case_search(t):
    return _cases(Fl.case_search(t["tbl_case_records"], CASE_TEXT))


@register("case_search_referred", f"""SELECT {CASE_SQL} FROM tbl_case_records
WHERE lower(cr_referred) = 'yes' AND {_like_any(Fl.CASE_SEARCH, '%' + CASE_TEXT + '%')}""")
def case_search_referred(t):
    return _cases(Fl.case_search(t["tbl_case_records"], CASE_TEXT, referred=True))


@register("counseling_search", f"""SELECT {COUNSELING_SQL} FROM tbl_counseling_records
WHERE {_like_any(Fl.COUNSELING_SEARCH, '%' + COUNSELING_TEXT + '%')}""")
def counseling_search(t):
    return _counseling(Fl.counseling_search(t["tbl_counseling_records"], COUNSELING_TEXT))


@register("student_search", f"""SELECT {STUDENT_SQL} FROM tbl_student_data
WHERE {_like_any(Fl.STUDENT_SEARCH, '%' + STUDENT_TEXT + '%')}""")
def student_search(t):
    return P.student_projection(Fl.student_search(t["tbl_student_data"], STUDENT_TEXT))


@register("user_search", f"""SELECT {USER_SQL} FROM users
WHERE {_like_any(Fl.USER_SEARCH, '%' + USER_TEXT + '%')}""")
def user_search(t):
    return P.user_projection(Fl.user_search(t["users"], USER_TEXT))


def _esc(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


@register("medical_search", f"""SELECT {MEDICAL_SQL} FROM tbl_medical_records
WHERE {_like_any(Fl.MEDICAL_SEARCH, '%' + _esc(MEDICAL_TEXT) + '%', escape=True)}
  AND {_kind_sql('MEDICAL')}""")
def medical_search(t):
    return _medical(Fl.medical_search(t["tbl_medical_records"], MEDICAL_TEXT, "MEDICAL"))


@register("medical_referred_search", f"""SELECT {MEDICAL_SQL} FROM tbl_medical_records
WHERE lower(mr_referred) = 'yes'
  AND {_like_any(Fl.MEDICAL_REFERRED_SEARCH, '%' + _esc(MEDICAL_REFERRED_TEXT) + '%', escape=True)}""")
def medical_referred_search(t):
    return _medical(Fl.medical_referred_search(t["tbl_medical_records"], MEDICAL_REFERRED_TEXT))


# ---- JSON attachments (O40-O44) ----------------------------------------------------

@register("medical_attachment_stats", """
SELECT mr_medical_id AS record_id,
       CAST(CASE WHEN coalesce(trim(mr_attachments), '') = '' THEN 0
                 ELSE json_array_length(mr_attachments) END AS BIGINT) AS file_count,
       CAST(CASE WHEN coalesce(trim(mr_edit_history), '') = '' THEN 0
                 ELSE json_array_length(mr_edit_history) END AS BIGINT) AS edit_count,
       false AS attachments_malformed, false AS history_malformed
FROM tbl_medical_records""")
def medical_attachment_stats(t):
    return A.attachment_stats(t["tbl_medical_records"], "mr_medical_id", "mr_attachments",
                              "mr_edit_history")


@register("case_attachment_stats", """
SELECT cr_case_id AS record_id,
       CAST(CASE WHEN coalesce(trim(cr_attachments), '') = '' THEN 0
                 ELSE json_array_length(cr_attachments) END AS BIGINT) AS file_count,
       CAST(CASE WHEN coalesce(trim(cr_edit_history), '') = '' THEN 0
                 ELSE json_array_length(cr_edit_history) END AS BIGINT) AS edit_count,
       false AS attachments_malformed, false AS history_malformed
FROM tbl_case_records""")
def case_attachment_stats(t):
    return A.attachment_stats(t["tbl_case_records"], "cr_case_id", "cr_attachments",
                              "cr_edit_history")


_FILES_CTE = """
m AS (SELECT mr_medical_id, mr_student_id, mr_student_name, mr_record_date, mr_is_medical,
             mr_is_psychological, CAST(mr_attachments AS JSON) AS j
      FROM tbl_medical_records
      WHERE mr_attachments IS NOT NULL AND lower(mr_attachments) <> 'null'
        AND mr_attachments <> '[]' AND mr_attachments <> '' AND ltrim(mr_attachments) LIKE '[%'),
f AS (SELECT m.*, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS idx FROM m),
g AS (SELECT f.*, json_extract(j, '$[' || idx || ']') AS e FROM f)"""

_FILES_SELECT = f"""
SELECT concat(CAST(mr_medical_id AS VARCHAR), '-file-', CAST(idx AS VARCHAR), '-',
              CAST(epoch_ms(mr_record_date) AS VARCHAR)) AS fileId,
       mr_medical_id AS recordId, mr_student_id AS studentId, mr_student_name AS studentName,
       coalesce(nullif(e->>'originalname', ''), e->>'filename') AS fileName,
       e->>'filename' AS storedFileName, e->>'mimetype' AS fileType,
       CAST(e->>'size' AS BIGINT) AS fileSize,
       coalesce(nullif(e->>'uploadDate', ''), strftime(mr_record_date, {ISO})) AS uploadDate,
       coalesce(nullif(e->>'uploadedBy', ''), 'Unknown') AS uploadedBy,
       (coalesce(CAST(e->>'isMedical' AS BOOLEAN), false) OR mr_is_medical = 'Yes') AS isMedical,
       (coalesce(CAST(e->>'isPsychological' AS BOOLEAN), false)
        OR mr_is_psychological = 'Yes') AS isPsychological,
       e->>'path' AS filePath
FROM g"""


@register("attachment_files", f"WITH {_FILES_CTE}\n{_FILES_SELECT}")
def attachment_files(t):
    return A.attachment_files(t["tbl_medical_records"])


@register("attachment_files_opd_medical", f"""WITH {_FILES_CTE},
files AS ({_FILES_SELECT})
SELECT * FROM files WHERE isMedical AND upper(uploadedBy) = 'OPD'""")
def attachment_files_opd_medical(t):
    return A.attachment_file_filter(A.attachment_files(t["tbl_medical_records"], ordered=False),
                                    "medical", "opd")


@register("attachment_file_counts", f"""WITH {_FILES_CTE},
files AS ({_FILES_SELECT})
SELECT CAST(count(*) AS BIGINT) AS totalCount,
       CAST(count_if(isPsychological) AS BIGINT) AS filteredCount FROM files""")
def attachment_file_counts(t):
    return A.attachment_file_counts(A.attachment_files(t["tbl_medical_records"], ordered=False),
                                    "PSYCHOLOGICAL")


_ANY_ARRAY_CTE = """
m AS (SELECT mr_medical_id, mr_student_id, mr_student_name, CAST(mr_attachments AS JSON) AS j
      FROM tbl_medical_records
      WHERE coalesce(mr_attachments, '') <> '' AND ltrim(mr_attachments) LIKE '[%'),
f AS (SELECT m.*, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS idx FROM m),
g AS (SELECT f.*, json_extract(j, '$[' || idx || ']') AS e FROM f)"""


@register("opd_uploads", f"""WITH {_ANY_ARRAY_CTE}
SELECT mr_medical_id AS recordId, mr_student_id AS studentId, mr_student_name AS studentName,
       e->>'originalname' AS fileName, e->>'uploadDate' AS uploadedDate,
       e->>'filename' AS storedFileName, CAST(e->>'size' AS BIGINT) AS fileSize
FROM g WHERE e->>'uploadedBy' = 'OPD'""")
def opd_uploads(t):
    return A.opd_uploads(t["tbl_medical_records"]).select(
        "recordId", "studentId", "studentName", "fileName", "uploadedDate",
        F.col("fileData.filename").alias("storedFileName"),
        F.col("fileData.size").alias("fileSize"))


@register("attachment_lookup", f"""WITH {_ANY_ARRAY_CTE},
req AS (SELECT mr_medical_id AS record_id, e->>'originalname' AS filename
        FROM g WHERE e->>'uploadedBy' = 'OPD'),
hits AS (SELECT req.record_id, req.filename AS requested, g.idx, g.e
         FROM req JOIN g ON g.mr_medical_id = req.record_id
          AND (g.e->>'filename' = req.filename OR g.e->>'originalname' = req.filename))
SELECT record_id, requested, arg_min(e->>'filename', idx) AS stored_name,
       arg_min(CAST(e->>'size' AS BIGINT), idx) AS size,
       arg_min(e->>'uploadedBy', idx) AS uploaded_by
FROM hits GROUP BY record_id, requested""")
def attachment_lookup(t):
    med = t["tbl_medical_records"]
    req = A.opd_uploads(med).select(F.col("recordId").alias("record_id"),
                                    F.col("fileName").alias("filename"))
    found = A.attachment_lookup(med, "mr_medical_id", "mr_attachments", req, match_original=True)
    return found.select("record_id", "requested", F.col("file.filename").alias("stored_name"),
                        F.col("file.size").alias("size"),
                        F.col("file.uploadedBy").alias("uploaded_by"))


# ---- referrals (O45) -------------------------------------------------------------------

@register("pending_referrals", f"""
SELECT cr_case_id AS record_id, cr_student_id AS student_id, cr_student_name AS student_name,
       cr_student_strand AS student_strand, cr_student_grade_level AS student_grade_level,
       cr_student_section AS student_section, cr_school_year_semester AS school_year_semester,
       cr_violation_level AS violation_level, strftime(cr_case_date, {ISO}) AS record_date,
       cr_general_description AS details, cr_sender AS sender, 'case_record' AS record_type
FROM tbl_case_records
WHERE lower(cr_referred) = 'yes' AND lower(cr_referral_confirmation) = 'pending'
UNION ALL
SELECT mr_medical_id, mr_student_id, mr_student_name, mr_student_strand, mr_grade_level,
       mr_section, mr_school_year_semester, NULL, strftime(mr_record_date, {ISO}),
       mr_medical_details, mr_sender, 'medical_record'
FROM tbl_medical_records
WHERE lower(mr_referred) = 'yes' AND lower(mr_referral_confirmation) = 'pending'""")
def pending_referrals(t):
    from campusledger.functions.semantics import iso_millis
    out = R.pending_referrals(t["tbl_case_records"], t["tbl_medical_records"])
    return out.withColumn("record_date", iso_millis("record_date"))


@register("pending_referral_counts", """
SELECT CAST(sum(n) AS BIGINT) AS count,
       CAST(sum(CASE WHEN k = 'c' THEN n ELSE 0 END) AS BIGINT) AS caseRecordCount,
       CAST(sum(CASE WHEN k = 'm' THEN n ELSE 0 END) AS BIGINT) AS medicalRecordCount
FROM (SELECT 'c' AS k, count(*) AS n FROM tbl_case_records
      WHERE lower(cr_referred) = 'yes' AND lower(cr_referral_confirmation) = 'pending'
      UNION ALL
      SELECT 'm', count(*) FROM tbl_medical_records
      WHERE lower(mr_referred) = 'yes' AND lower(mr_referral_confirmation) = 'pending') x""")
def pending_referral_counts(t):
    return R.pending_referral_counts(
        R.pending_referrals(t["tbl_case_records"], t["tbl_medical_records"], ordered=False))


# ---- inbox (O46, O47) -----------------------------------------------------------------

@register("notification_inbox", f"""SELECT {NOTIFICATION_SQL} FROM tbl_notifications
WHERE lower(n_receiver) = '{INBOX_RECEIVER.lower()}'""")
def notification_inbox(t):
    return P.notification_projection(I.notification_inbox(t["tbl_notifications"], INBOX_RECEIVER))


@register("certificate_inbox", f"""SELECT {NOTIFICATION_SQL} FROM tbl_notifications
WHERE lower(n_receiver) = 'inf' AND lower(n_type) = 'opd medical certificate'
  AND lower(n_sender) = 'opd'""")
def certificate_inbox(t):
    return P.notification_projection(I.certificate_inbox(t["tbl_notifications"]))


# ---- joins (O22) ---------------------------------------------------------------------------

from campusledger.operators import joins as J  # noqa: E402

_JOIN_STUDENT_COLS = ("sd_id_number", "sd_student_name", "sd_grade_level",
                      "sd_school_year_semesterr")


@register("students_join_cases", """
SELECT sd.sd_id_number, sd.sd_student_name, sd.sd_grade_level, sd.sd_school_year_semesterr,
       cr.cr_case_id, cr.cr_status
FROM tbl_student_data sd JOIN tbl_case_records cr ON sd.sd_id_number = cr.cr_student_id""")
def students_join_cases(t):
    return J.students_join_cases(t["tbl_student_data"], t["tbl_case_records"]).select(
        *_JOIN_STUDENT_COLS, "cr_case_id", "cr_status")


@register("students_join_counseling", """
SELECT sd.sd_id_number, sd.sd_student_name, sd.sd_grade_level, sd.sd_school_year_semesterr,
       c.cor_record_id, c.cor_status
FROM tbl_student_data sd
JOIN tbl_counseling_records c ON sd.sd_id_number = c.cor_student_id_number""")
def students_join_counseling(t):
    return J.students_join_counseling(t["tbl_student_data"], t["tbl_counseling_records"]).select(
        *_JOIN_STUDENT_COLS, "cor_record_id", "cor_status")


@register("students_join_medical", """
SELECT sd.sd_id_number, sd.sd_student_name, sd.sd_grade_level, sd.sd_school_year_semesterr,
       m.mr_medical_id, m.mr_status
FROM tbl_student_data sd JOIN tbl_medical_records m ON sd.sd_id_number = m.mr_student_id""")
def students_join_medical(t):
    return J.students_join_medical(t["tbl_student_data"], t["tbl_medical_records"]).select(
        *_JOIN_STUDENT_COLS, "mr_medical_id", "mr_status")


# ---- upload rules over stored file lists (O68, O71) ---------------------------------------

@register("attachment_checks", f"""WITH {_ANY_ARRAY_CTE},
per_record AS (
  SELECT mr_medical_id,
         coalesce(bool_and(coalesce(e->>'mimetype' IN ('application/pdf',
           'application/vnd.openxmlformats-officedocument.wordprocessingml.document',
           'application/msword'), false)), true) AS ok_type,
         coalesce(bool_and(coalesce(CAST(e->>'size' AS BIGINT), 0) <= 10485760), true) AS ok_size,
         count(*) AS n
  FROM g GROUP BY mr_medical_id)
SELECT m.mr_medical_id AS record_id,
       concat_ws(',', CASE WHEN NOT coalesce(p.ok_type, true) THEN 'file_type' END,
                      CASE WHEN NOT coalesce(p.ok_size, true) THEN 'file_size' END,
                      CASE WHEN coalesce(p.n, 0) > 5 THEN 'file_count' END) AS reasons
FROM m LEFT JOIN per_record p ON p.mr_medical_id = m.mr_medical_id""")
def attachment_checks(t):
    from campusledger.functions.jsoncols import ATTACHMENTS, looks_like_array
    med = t["tbl_medical_records"]
    text = F.col("mr_attachments")
    listed = med.where((F.coalesce(text, F.lit("")) != "") & looks_like_array(text))
    files = F.from_json(text, ATTACHMENTS)
    return listed.select(F.col("mr_medical_id").alias("record_id"),
                         F.array_join(A.attachment_checks(files), ",").alias("reasons"))


@register("stored_file_names", f"""WITH {_ANY_ARRAY_CTE},
n AS (SELECT mr_medical_id, idx, e->>'uploadedBy' AS who,
             regexp_extract(coalesce(nullif(e->>'originalname', ''), e->>'filename'),
                            '([^/]*)$', 1) AS base
      FROM g)
SELECT mr_medical_id AS record_id, CAST(idx AS BIGINT) AS idx,
       concat(CASE WHEN who = 'OPD' THEN 'OPDMC_' WHEN who = 'GCO' THEN 'GCO_' ELSE '' END,
              left(base, length(base) - length(regexp_extract(base, '^.+(\\.[^.]*)$', 1))),
              '-', CAST(mr_medical_id AS VARCHAR),
              regexp_extract(base, '^.+(\\.[^.]*)$', 1)) AS stored_name
FROM n""")
def stored_file_names(t):
    from campusledger.functions.jsoncols import ATTACHMENTS, looks_like_array
    from campusledger.functions.semantics import first_present
    med = t["tbl_medical_records"]
    text = F.col("mr_attachments")
    recs = med.where((F.coalesce(text, F.lit("")) != "") & looks_like_array(text)).select(
        "mr_medical_id", F.posexplode(F.from_json(text, ATTACHMENTS)).alias("idx", "f"))
    original = first_present(F.col("f.originalname"), F.col("f.filename"))
    return recs.select(F.col("mr_medical_id").alias("record_id"), F.col("idx").cast("bigint"),
                       A.stored_file_name(original, F.col("mr_medical_id").cast("string"),
                                          F.col("f.uploadedBy")).alias("stored_name"))


@register("counseling_forms_from_cases", f"""
SELECT {COUNSELING_SQL.replace("strftime(cor_date, '%m/%d/%Y') AS date",
                               "strftime(cor_date, '%Y-%m-%d') AS date")}
FROM tbl_counseling_records WHERE cor_record_id IN (
  SELECT cor_record_id FROM tbl_counseling_records WHERE cor_origin_case_id IS NOT NULL)""")
def counseling_forms_from_cases(t):
    """Single-record form (``yyyy-MM-dd`` dates, O8/O17a) for every session that
    originates from a case, looked up as one batch."""
    c = t["tbl_counseling_records"]
    ids = c.where(F.col("cor_origin_case_id").isNotNull()).select("cor_record_id")
    return P.counseling_projection(Fl.records_by_ids(c, "counseling", ids),
                                   date_pattern=P.FORM_DATE, parse_json=False)


# ---- further filter arguments ---------------------------------------------------------------

@register("case_level_filter_serious",
          f"SELECT {CASE_SQL} FROM tbl_case_records WHERE lower(cr_violation_level) = 'serious'")
def case_level_filter_serious(t):
    return _cases(Fl.case_level_filter(t["tbl_case_records"], "SERIOUS"))


@register("counseling_status_filter_done", f"""SELECT {COUNSELING_SQL}
FROM tbl_counseling_records WHERE lower(cor_status) = 'done'""")
def counseling_status_filter_done(t):
    return _counseling(Fl.counseling_status_filter(t["tbl_counseling_records"], "Done"))


@register("medical_records_both_conditions", f"""SELECT {MEDICAL_SQL} FROM tbl_medical_records
WHERE {_kind_sql('MEDICALPSYCHOLOGICAL')}""")
def medical_records_both_conditions(t):
    return _medical(Fl.medical_list(t["tbl_medical_records"], "MEDICALPSYCHOLOGICAL"))


@register("medical_search_psychological", f"""SELECT {MEDICAL_SQL} FROM tbl_medical_records
WHERE {_like_any(Fl.MEDICAL_SEARCH, '%' + _esc('Customer#00000') + '%', escape=True)}
  AND {_kind_sql('PSYCHOLOGICAL')}""")
def medical_search_psychological(t):
    return _medical(Fl.medical_search(t["tbl_medical_records"], "Customer#00000",
                                      "PSYCHOLOGICAL"))


@register("case_search_wildcard", f"""SELECT {CASE_SQL} FROM tbl_case_records
WHERE {_like_any(Fl.CASE_SEARCH, '%S_EM%')}""")
def case_search_wildcard(t):
    """User text is not escaped: ``_`` in ``S_EM`` matches any one character."""
    return _cases(Fl.case_search(t["tbl_case_records"], "S_EM"))
