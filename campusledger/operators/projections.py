"""Record-screen projections.

Each projection renames the stored columns to the screen's names, formats
dates, and by default parses the two JSON columns (attachments, edit
history) into typed arrays. ``parse_json=False`` keeps the stored text, which
is what a caller that only forwards the record (or an SQL engine comparing
results) wants. Column pruning reaches the parquet scan: only the columns a
projection names are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.functions.jsoncols import parse_attachments, parse_edit_history
from campusledger.functions.semantics import iso_millis

SCREEN_DATE = "MM/dd/yyyy"
FORM_DATE = "yyyy-MM-dd"
USER_STAMP = "MM/dd/yyyy hh:mm a"


def _json_cols(attachments: str, history: str, parse_json: bool):
    if parse_json:
        return [parse_attachments(attachments).alias("attachments"),
                parse_edit_history(history).alias("editDate")]
    return [F.col(attachments).alias("attachments"), F.col(history).alias("editDate")]


def case_projection(cases: DataFrame, date_pattern: str = SCREEN_DATE,
                    parse_json: bool = True) -> DataFrame:
    """17 case columns."""
    att, hist = _json_cols("cr_attachments", "cr_edit_history", parse_json)
    return cases.select(
        F.col("cr_case_id").alias("caseNo"),
        F.col("cr_student_id").alias("id"),
        F.col("cr_student_name").alias("name"),
        F.col("cr_student_strand").alias("strand"),
        F.col("cr_student_grade_level").alias("gradeLevel"),
        F.col("cr_student_section").alias("section"),
        F.col("cr_school_year_semester").alias("schoolYearSemester"),
        F.col("cr_violation_level").alias("violationLevel"),
        F.col("cr_status").alias("status"),
        F.date_format("cr_case_date", date_pattern).alias("date"),
        F.col("cr_referred").alias("referred"),
        F.col("cr_referral_confirmation").alias("referralConfirmation"),
        F.col("cr_general_description").alias("description"),
        F.col("cr_additional_remarks").alias("remarks"),
        att,
        iso_millis("cr_create_date").alias("createDate"),
        hist,
    )


def session_time(c: str):
    """``TIME_FORMAT(t, '%H:%i')`` on stored time text (``9:30:00`` -> ``09:30``)."""
    t = F.col(c)
    return F.coalesce(F.date_format(F.try_to_timestamp(t, F.lit("H:mm:ss")), "HH:mm"),
                      F.date_format(F.try_to_timestamp(t, F.lit("H:mm")), "HH:mm"),
                      F.substring(t, 1, 5))


def counseling_projection(counseling: DataFrame, date_pattern: str = SCREEN_DATE,
                          parse_json: bool = True) -> DataFrame:
    """19 counselling columns (O8); ``date_pattern=FORM_DATE`` for the single-record form."""
    att, hist = _json_cols("cor_attachments", "cor_edit_history", parse_json)
    return counseling.select(
        F.col("cor_record_id").alias("recordId"),
        F.col("cor_origin_medical_id").alias("originMedicalId"),
        F.col("cor_origin_case_id").alias("originCaseId"),
        F.col("cor_session_number").alias("sessionNumber"),
        F.col("cor_student_id_number").alias("id"),
        F.col("cor_student_name").alias("name"),
        F.col("cor_student_strand").alias("strand"),
        F.col("cor_student_grade_level").alias("gradeLevel"),
        F.col("cor_student_section").alias("section"),
        F.col("cor_school_year_semester").alias("schoolYearSemester"),
        F.col("cor_status").alias("status"),
        F.date_format("cor_date", date_pattern).alias("date"),
        session_time("cor_time").alias("time"),
        F.col("cor_general_concern").alias("concern"),
        F.col("cor_additional_remarks").alias("remarks"),
        att,
        F.col("cor_is_psychological_condition").alias("psychologicalCondition"),
        iso_millis("cor_create_date").alias("createDate"),
        hist,
    )


def medical_projection(medical: DataFrame, date_pattern: str = SCREEN_DATE,
                       parse_json: bool = True) -> DataFrame:
    """19 medical columns."""
    att, hist = _json_cols("mr_attachments", "mr_edit_history", parse_json)
    return medical.select(
        F.col("mr_medical_id").alias("recordId"),
        F.col("mr_student_id").alias("id"),
        F.col("mr_student_name").alias("name"),
        F.col("mr_student_strand").alias("strand"),
        F.col("mr_subject").alias("subject"),
        F.col("mr_status").alias("status"),
        F.col("mr_grade_level").alias("gradeLevel"),
        F.col("mr_section").alias("section"),
        F.col("mr_school_year_semester").alias("schoolYearSemester"),
        F.col("mr_medical_details").alias("medicalDetails"),
        F.col("mr_additional_remarks").alias("remarks"),
        att,
        F.col("mr_referred").alias("referred"),
        F.col("mr_referral_confirmation").alias("referralConfirmation"),
        F.col("mr_is_psychological").alias("isPsychological"),
        F.col("mr_is_medical").alias("isMedical"),
        F.date_format("mr_record_date", date_pattern).alias("date"),
        iso_millis("mr_create_date").alias("createDate"),
        hist,
    )


INFIRMARY_COLUMNS = ("recordId", "id", "name", "strand", "gradeLevel", "section",
                     "schoolYearSemester", "subject", "status", "medicalDetails", "remarks",
                     "attachments", "isPsychological", "isMedical", "date", "createDate",
                     "editDate")


def infirmary_projection(medical: DataFrame, date_pattern: str = SCREEN_DATE,
                         parse_json: bool = True) -> DataFrame:
    """O9 without the two referral columns, in the infirmary order."""
    return medical_projection(medical, date_pattern, parse_json).select(*INFIRMARY_COLUMNS)


def user_projection(users: DataFrame) -> DataFrame:
    """8 account columns, times as ``MM/dd/yyyy hh:mm AM``."""
    return users.select(
        F.col("u_email").alias("email"),
        F.col("u_username").alias("username"),
        F.col("u_name").alias("name"),
        F.col("u_department").alias("department"),
        F.col("u_type").alias("userType"),
        F.col("u_status").alias("status"),
        F.date_format("created_at", USER_STAMP).alias("createdAt"),
        F.date_format("deactivated_at", USER_STAMP).alias("deactivatedAt"),
    )


USER_DIRECTORY_COLUMNS = ("u_email", "u_username", "u_name", "u_department", "u_type",
                          "u_status", "created_at", "deactivated_at")


def user_directory(users: DataFrame) -> DataFrame:
    """The 8 raw account columns (O11b); the count is ``df.count()``."""
    return users.select(*USER_DIRECTORY_COLUMNS)


def student_projection(students: DataFrame) -> DataFrame:
    """12 student columns."""
    return students.select(
        F.col("sd_id_number").alias("id"),
        F.col("sd_student_name").alias("name"),
        F.col("sd_strand").alias("strand"),
        F.col("sd_grade_level").alias("gradeLevel"),
        F.col("sd_section").alias("section"),
        F.col("sd_gender").alias("gender"),
        F.col("sd_religion").alias("religion"),
        F.col("sd_previous_school").alias("previousSchool"),
        F.col("sd_status").alias("status"),
        F.date_format("sd_birthdate", FORM_DATE).alias("birthdate"),
        F.col("sd_school_year_sem").alias("schoolYearSem"),
        F.col("sd_school_year_semesterr").alias("schoolYearSemesterr"),
    )


NOTIFICATION_COLUMNS = ("n_id", "n_sender", "n_receiver", "n_type", "n_message", "n_is_read",
                        "n_created_at", "n_related_record_id", "n_related_record_type")


def notification_projection(notifications: DataFrame) -> DataFrame:
    """9 notification columns (O13); the time as ISO text."""
    return notifications.select(*[iso_millis(c).alias(c) if c == "n_created_at" else F.col(c)
                                  for c in NOTIFICATION_COLUMNS])
