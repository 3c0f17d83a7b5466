"""Referral hand-over between offices.

Confirmation is a batch operator: it takes a DataFrame of requested record
ids and returns the new record table, the derived notification rows and the
derived counselling rows, plus a per-request status. The requested ids are
matched with joins (never collected), so any number of confirmations is one
job.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq

# Notification wording and office codes.
CASE_REFERRAL_MESSAGE = "New case referral for %s (%s) - %s violation"
MEDICAL_REFERRAL_MESSAGE = "New %s referral for %s (%s)"
CASE_ACCEPTED_MESSAGE = "Case referral for %s (%s) has been accepted by GCO"
MEDICAL_ACCEPTED_MESSAGE = "Medical referral for %s (%s) has been accepted by GCO"
UPLOAD_MESSAGE = '%s uploaded file "%s" for %s (%s)'
CERTIFICATE_TYPE = "OPD Medical Certificate"

NOTIFICATION_COLUMNS = ("n_sender", "n_receiver", "n_type", "n_message",
                        "n_related_record_id", "n_related_record_type")


def _pending(prefix: str) -> Column:
    return ci_eq(f"{prefix}_referred", "Yes") & ci_eq(f"{prefix}_referral_confirmation", "Pending")


# ---- O45 -------------------------------------------------------------------------

REFERRAL_COLUMNS = ("record_id", "student_id", "student_name", "student_strand",
                    "student_grade_level", "student_section", "school_year_semester",
                    "violation_level", "record_date", "details", "sender", "record_type")


def pending_referrals(cases: DataFrame, medical: DataFrame, ordered: bool = True) -> DataFrame:
    """Pending case and medical referrals in one list with unified column names."""
    c = cases.where(_pending("cr")).select(
        F.col("cr_case_id").alias("record_id"), F.col("cr_student_id").alias("student_id"),
        F.col("cr_student_name").alias("student_name"),
        F.col("cr_student_strand").alias("student_strand"),
        F.col("cr_student_grade_level").alias("student_grade_level"),
        F.col("cr_student_section").alias("student_section"),
        F.col("cr_school_year_semester").alias("school_year_semester"),
        F.col("cr_violation_level").alias("violation_level"),
        F.col("cr_case_date").alias("record_date"),
        F.col("cr_general_description").alias("details"),
        F.col("cr_sender").alias("sender"), F.lit("case_record").alias("record_type"))
    m = medical.where(_pending("mr")).select(
        F.col("mr_medical_id").alias("record_id"), F.col("mr_student_id").alias("student_id"),
        F.col("mr_student_name").alias("student_name"),
        F.col("mr_student_strand").alias("student_strand"),
        F.col("mr_grade_level").alias("student_grade_level"),
        F.col("mr_section").alias("student_section"),
        F.col("mr_school_year_semester").alias("school_year_semester"),
        F.lit(None).cast("string").alias("violation_level"),
        F.col("mr_record_date").alias("record_date"),
        F.col("mr_medical_details").alias("details"),
        F.col("mr_sender").alias("sender"), F.lit("medical_record").alias("record_type"))
    out = c.unionByName(m).select(*REFERRAL_COLUMNS)
    if ordered:
        out = out.orderBy("record_type", F.col("record_date").desc_nulls_last(),
                          F.col("record_id").desc())
    return out


def pending_referral_counts(referrals: DataFrame) -> DataFrame:
    """``count``, ``caseRecordCount``, ``medicalRecordCount`` in one pass."""
    return referrals.agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.count_if(F.col("record_type") == "case_record").cast("bigint").alias("caseRecordCount"),
        F.count_if(F.col("record_type") == "medical_record").cast("bigint")
        .alias("medicalRecordCount"))


# ---- O53 / O54: notifications derived from record writes ----------------------------

def _notification(sender, receiver, type_, message, record_id, record_type) -> list[Column]:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)
    return [lit(sender).alias("n_sender"), lit(receiver).alias("n_receiver"),
            lit(type_).alias("n_type"), message.alias("n_message"),
            record_id.cast("bigint").alias("n_related_record_id"),
            lit(record_type).alias("n_related_record_type")]


def case_referral_notifications(case_rows: DataFrame) -> DataFrame:
    """OPD -> GCO ``Referral`` for written case rows whose referred flag is
    exactly ``Yes`` (O53)."""
    msg = F.format_string(CASE_REFERRAL_MESSAGE,
                          "cr_student_name", "cr_student_id", "cr_violation_level")
    return case_rows.where(F.col("cr_referred") == "Yes").select(
        *_notification("OPD", "GCO", "Referral", msg, F.col("cr_case_id"), "case_record"))


def medical_referral_notifications(medical_rows: DataFrame) -> DataFrame:
    """INF -> GCO ``Referral`` for inserted medical rows referred exactly ``Yes``."""
    kind = F.when(F.col("mr_is_psychological") == "Yes", F.lit("psychological")) \
        .otherwise(F.lit("medical"))
    msg = F.format_string(MEDICAL_REFERRAL_MESSAGE, kind, "mr_student_name", "mr_student_id")
    return medical_rows.where(F.col("mr_referred") == "Yes").select(
        *_notification("INF", "GCO", "Referral", msg, F.col("mr_medical_id"), "medical_record"))


def upload_notifications(uploads: DataFrame) -> DataFrame:
    """Rows for files uploaded to medical records.

    ``uploads``: ``record_id, student_id, student_name, file_name, sender``.
    A file uploaded by OPD gives two rows (to INF and to OPD) of type
    ``OPD Medical Certificate``; other senders give none.
    """
    opd = uploads.where(F.col("sender") == "OPD")
    rows = opd.select("*", F.explode(F.array(F.lit("INF"), F.lit("OPD"))).alias("_to"))
    msg = F.format_string(UPLOAD_MESSAGE, "sender", "file_name",
                          "student_name", "student_id")
    type_ = F.when(F.col("sender") == "OPD", F.lit(CERTIFICATE_TYPE)) \
        .otherwise(F.lit("Update"))
    return rows.select(*_notification(F.col("sender"), F.col("_to"), type_, msg,
                                      F.col("record_id"), "medical_record"))


# ---- O55 / O56: confirming referrals ---------------------------------------------------

class Confirmation(NamedTuple):
    table: DataFrame          # the record table after the update
    notifications: DataFrame  # Acceptance rows (n_* columns)
    counseling: DataFrame     # new counselling rows (cor_* columns, ids not yet assigned)
    status: DataFrame         # record_id, status: applied / not_found


def _confirm(records: DataFrame, requests: DataFrame, prefix: str, id_col: str,
             receiver: str, message: str, record_type: str, counseling_cols) -> Confirmation:
    req = requests.select(F.col("record_id").try_cast("bigint").alias(id_col)).distinct()
    eligible = records.where(_pending(prefix))
    picked = eligible.join(req, id_col, "left_semi")
    flag = req.join(eligible.select(id_col), id_col, "left_semi") \
        .withColumn("_hit", F.lit(True))
    table = (records.join(flag, id_col, "left")
             .withColumn(f"{prefix}_referral_confirmation",
                         F.when(F.col("_hit") & _pending(prefix), F.lit("Accepted"))
                         .otherwise(F.col(f"{prefix}_referral_confirmation")))
             .drop("_hit"))
    name, sid = (f"{prefix}_student_name", f"{prefix}_student_id")
    notes = picked.select(*_notification(
        "GCO", receiver, "Acceptance", F.format_string(message, name, sid), F.col(id_col),
        record_type))
    status = req.join(flag, id_col, "left").select(
        F.col(id_col).alias("record_id"),
        F.when(F.col("_hit"), F.lit("applied")).otherwise(F.lit("not_found")).alias("status"))
    return Confirmation(table.select(records.columns), notes, picked.select(*counseling_cols),
                        status)


def confirm_case_referrals(cases: DataFrame, requests: DataFrame) -> Confirmation:
    """Accept pending case referrals; each gives an Acceptance notice (GCO -> OPD)
    and a first counselling session ``TO SCHEDULE`` (O55)."""
    cols = [F.lit(None).cast("bigint").alias("cor_origin_medical_id"),
            F.col("cr_case_id").alias("cor_origin_case_id"),
            F.lit(1).alias("cor_session_number"),
            F.col("cr_student_id").alias("cor_student_id_number"),
            F.col("cr_student_name").alias("cor_student_name"),
            F.col("cr_student_strand").alias("cor_student_strand"),
            F.col("cr_student_grade_level").alias("cor_student_grade_level"),
            F.col("cr_student_section").alias("cor_student_section"),
            F.nullif(F.col("cr_school_year_semester"), F.lit("")).alias("cor_school_year_semester"),
            F.lit("TO SCHEDULE").alias("cor_status"),
            F.lit("").alias("cor_general_concern"),
            F.lit("UNCONFIRMED").alias("cor_is_psychological_condition")]
    return _confirm(cases, requests, "cr", "cr_case_id", "OPD",
                    CASE_ACCEPTED_MESSAGE, "case_record", cols)


def confirm_medical_referrals(medical: DataFrame, requests: DataFrame) -> Confirmation:
    """Accept pending medical referrals (GCO -> INF); the session's condition is
    ``YES`` when the record's psychological flag is exactly ``Yes`` (O56)."""
    cols = [F.col("mr_medical_id").alias("cor_origin_medical_id"),
            F.lit(None).cast("bigint").alias("cor_origin_case_id"),
            F.lit(1).alias("cor_session_number"),
            F.col("mr_student_id").alias("cor_student_id_number"),
            F.col("mr_student_name").alias("cor_student_name"),
            F.col("mr_student_strand").alias("cor_student_strand"),
            F.col("mr_grade_level").alias("cor_student_grade_level"),
            F.col("mr_section").alias("cor_student_section"),
            F.nullif(F.col("mr_school_year_semester"), F.lit("")).alias("cor_school_year_semester"),
            F.lit("TO SCHEDULE").alias("cor_status"),
            F.lit("").alias("cor_general_concern"),
            F.when(F.col("mr_is_psychological") == "Yes", F.lit("YES")).otherwise(F.lit("NO"))
            .alias("cor_is_psychological_condition")]
    return _confirm(medical, requests, "mr", "mr_medical_id", "INF",
                    MEDICAL_ACCEPTED_MESSAGE, "medical_record", cols)
