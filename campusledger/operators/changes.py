"""Batch change operators.

The record screens change one row per request. Here a *batch* of requests is
a DataFrame and each operator returns, in one plan:

* ``table``  -- the whole table after the batch (to be written as a new
  version, see ``sources.snapshots``), so the batch is all-or-nothing;
* ``rows``   -- the inserted / updated rows as stored;
* ``status`` -- one row per request: ``applied``, ``not_found`` or
  ``rejected:<reason>``, the batch form of the screens' affected-row counts;
* ``notifications`` -- rows derived for ``tbl_notifications`` (or ``None``).

Rules shared by all operators:

* new ids are ``max(existing id) + seq``; ``seq`` is the request's positive
  sequence number, unique within the batch (a dense 1..n numbering gives
  dense ids). The maximum is a scalar subquery, computed once.
* several requests for one key are applied in the order of ``seq``: a full
  overwrite leaves the values of the last, a partial one (accounts) the last
  sent value of each field, a kept file list (``keep_missing``) that of the last
  request that sent one; every request adds its history entry and its
  notices. All of this comes from one aggregate per key over the batch.
* a record whose stored history does not parse is not touched; its requests
  are reported as ``rejected:malformed``.
* request fields use the screens' names (``studentId``, ``referredToGCO``...);
  absent optional fields read as NULL.
* the clock is the ``as_of`` argument (default: now).
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusledger.functions.semantics import as_of_column, blank_to_null, ci_eq, ci_key
from campusledger.operators.attachments import (DEFAULT_EDITOR, append_edit_history, merged_json,
                                                new_file_entries, plain_file_entries)
from campusledger.functions.jsoncols import is_array_text, to_json_or_null
from campusledger.operators.ordering import first_takers, names_in_order
from campusledger.operators.referrals import (case_referral_notifications,
                                              medical_referral_notifications,
                                              upload_notifications)
from campusledger.operators.validation import (condition_consistency, first_in_batch,
                                               reasons, required_fields)


class Written(NamedTuple):
    table: DataFrame
    rows: DataFrame
    status: DataFrame
    notifications: DataFrame | None = None


FILE_LIST = T.ArrayType(T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("originalname", T.StringType()),
    T.StructField("mimetype", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("path", T.StringType())]))
CLASS_LIST = T.ArrayType(T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("isMedical", T.BooleanType()),
    T.StructField("isPsychological", T.BooleanType())]))

OPTIONAL_TYPES = {
    "existingAttachments": T.StringType(), "filesToDelete": T.ArrayType(T.StringType()),
    "newFiles": FILE_LIST, "fileClassifications": CLASS_LIST, "userType": T.StringType(),
    "uploaderType": T.StringType(), "remarks": T.StringType(), "referredToGCO": T.StringType(),
    "originMedicalId": T.LongType(), "originCaseId": T.LongType(), "date": T.StringType(),
    "time": T.StringType(), "psychologicalCondition": T.StringType(),
    "schoolYearSemester": T.StringType(), "password": T.StringType(),
    "username": T.StringType(), "name": T.StringType(), "department": T.StringType(),
    # request fields that may be absent; required ones are then reported missing
    "studentId": T.StringType(), "studentName": T.StringType(), "strand": T.StringType(),
    "gradeLevel": T.StringType(), "section": T.StringType(), "violationLevel": T.StringType(),
    "status": T.StringType(), "description": T.StringType(), "concern": T.StringType(),
    "sessionNumber": T.StringType(), "subject": T.StringType(),
    "medicalDetails": T.StringType(), "isPsychological": T.StringType(),
    "isMedical": T.StringType(),
}


def with_optional(changes: DataFrame) -> DataFrame:
    """Add absent optional request fields as typed NULL columns."""
    add = {k: F.lit(None).cast(t) for k, t in OPTIONAL_TYPES.items() if k not in changes.columns}
    return changes.withColumns(add) if add else changes


def _c(name: str) -> Column:
    return F.col(name)


def new_ids(table: DataFrame, id_col: str, seq: str = "seq") -> Column:
    base = table.agg(F.max(id_col)).scalar()
    return (F.coalesce(base, F.lit(0)).cast("bigint") + F.col(seq).cast("bigint"))


def one_per_key(changes: DataFrame, key: str, seq: str = "seq", editor: Column | None = None,
                sent: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: what its requests leave when they are applied in the order of ``seq``.

    A request overwrites every column, except that a column of ``sent`` is
    overwritten only by requests for which the condition holds; ``_sent_<column>``
    tells whether any did. ``_editors`` holds the editors of all requests in
    order. Overwriting is associative (the later request wins), so the fold is a
    partial aggregate: each column goes through on its own (``max_by``), so that those
    nobody reads are neither shuffled nor sorted, and only the editors, bounded by the
    requests for one record, are gathered.
    """
    editor = editor if editor is not None else F.lit(None).cast("string")
    sent = sent or {}
    rest = [c for c in changes.columns if c != key and c not in sent]
    kept = [x for c, cond in sent.items() for x in (
        F.max_by(c, F.when(cond, F.col(seq))).alias(c), F.coalesce(F.bool_or(cond), F.lit(False)).alias(f"_sent{c}"))]
    one = changes.withColumn("_by", editor).groupBy(key).agg(
        *(F.max_by(c, F.col(seq)).alias(c) for c in rest),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("_by").alias("e")))),
                    lambda x: x["e"]).alias("_editors"), *kept)
    return one.select(key, *rest, "_editors", *(x for c in sent for x in (c, f"_sent{c}")))


def _apply(table: DataFrame, changes: DataFrame, key: str, set_cols: dict[str, Column],
           order: list[str], editor: Column | None = None, history: str | None = None,
           ts: Column | None = None, sent: dict[str, Column] | None = None,
           ) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Left-join the table to its changes per key and overwrite ``set_cols`` on
    matched rows (NULLs in the change do overwrite; for ``sent`` see
    :func:`one_per_key`). With ``history`` each
    request appends its entry, and rows whose history does not parse stay.
    Returns the new table, the updated rows, and the keys of rows left alone."""
    ch = one_per_key(changes, key, editor=editor, sent=sent).withColumn("_hit", F.lit(True))
    j = table.join(ch, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    bad = F.lit(False)
    if history is not None:
        bad = hit & (F.coalesce(F.trim(history), F.lit("")) != "") & ~is_array_text(history)
        hit = hit & ~bad
        set_cols = {**set_cols, history: append_edit_history(F.col(history), F.col("_editors"), ts)}
    cols = [F.when(hit, set_cols[c]).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
            for c in order]
    new_table = j.select(*cols, hit.alias("_hit"), bad.alias("_bad"))
    rows = new_table.where("_hit").drop("_hit", "_bad")
    untouched = new_table.where("_bad").select(key) if history is not None else None
    return new_table.drop("_hit", "_bad"), rows, untouched


def _applied(changes: DataFrame, status: DataFrame) -> DataFrame:
    """The requests that took effect, for what each of them sets off."""
    return changes.join(status.where(F.col("status") == "applied").select("seq"), "seq", "left_semi")


def _status(changes: DataFrame, table: DataFrame, key: str,
            reject: Column | None = None, malformed: DataFrame | None = None) -> DataFrame:
    # Only the requested keys are looked up: the table's key column is
    # semi-joined to the (smaller) request keys before the distinct.
    wanted = changes.select(key).distinct()
    known = (table.select(key).join(wanted, key, "left_semi").distinct()
             .withColumn("_known", F.lit(True)))
    out = changes.join(known, key, "left")
    st = F.when(F.col("_known"), F.lit("applied")).otherwise(F.lit("not_found"))
    if malformed is not None:
        out = out.join(malformed.withColumn("_malformed", F.lit(True)), key, "left")
        st = F.when(F.col("_malformed"), F.lit("rejected:malformed")).otherwise(st)
    if reject is not None:
        st = F.when(F.size(reject) > 0, F.concat(F.lit("rejected:"), F.array_join(reject, ",")))\
            .otherwise(st)
    return out.select("seq", key, st.alias("status"))


# ---- cases (O48a, O49a) ----------------------------------------------------------

CASE_ORDER = ["cr_case_id", "cr_student_id", "cr_student_name", "cr_student_strand",
              "cr_student_grade_level", "cr_student_section", "cr_school_year_semester",
              "cr_violation_level", "cr_status", "cr_case_date", "cr_referred",
              "cr_referral_confirmation", "cr_general_description", "cr_additional_remarks",
              "cr_attachments", "cr_create_date", "cr_edit_history", "cr_sender"]


def _case_fields() -> dict[str, Column]:
    return {
        "cr_student_id": _c("studentId"), "cr_student_name": _c("studentName"),
        "cr_student_strand": _c("strand"), "cr_student_grade_level": _c("gradeLevel"),
        "cr_student_section": _c("section"), "cr_school_year_semester": _c("schoolYearSemester"),
        "cr_violation_level": _c("violationLevel"), "cr_status": _c("status"),
        "cr_referred": _c("referredToGCO"),
        # re-set on every write: Pending when referred (exactly 'Yes'), else NULL
        "cr_referral_confirmation": F.when(_c("referredToGCO") == "Yes", F.lit("Pending")),
        "cr_general_description": _c("description"), "cr_additional_remarks": _c("remarks"),
    }


def _new_record_attachments(mode: str) -> Column:
    """Attachment text of an inserted record (no stored value to keep)."""
    return merged_json(_c("existingAttachments"), _c("filesToDelete"), _c("newFiles"), mode)


def _merge_on_change_side(ch: DataFrame, mode: str, keep_missing: bool, stored: str,
                          **kw) -> tuple[DataFrame, Column, dict[str, Column]]:
    """Compute the merged attachment text on the request rows, before the join.

    The merge only reads request fields, so it runs once per request on the
    (smaller) change side instead of inside the join's projection. With
    ``keep_missing`` a request that sends neither a list nor files leaves the
    list that the requests before it left, and the stored one if none did.
    Returns the requests, the value to store, and when a request sends a list.
    """
    merged = merged_json(_c("existingAttachments"), _c("filesToDelete"), _c("newFiles"), mode, **kw)
    ch = ch.withColumn("_att", merged)
    if not keep_missing:
        return ch, F.col("_att"), {}
    ch = ch.withColumn("_lists", _c("existingAttachments").isNotNull() | (F.coalesce(F.size(_c("newFiles")), F.lit(0)) > 0))
    return ch, F.when(F.col("_sent_att"), F.col("_att")).otherwise(F.col(stored)), {"_att": F.col("_lists")}


def insert_cases(cases: DataFrame, changes: DataFrame, as_of=None) -> Written:
    """New case rows (O48a) and their referral notifications."""
    ts = as_of_column(as_of)
    ch = with_optional(changes)
    fields = _case_fields()
    rows = ch.select(
        new_ids(cases, "cr_case_id").alias("cr_case_id"),
        *[fields[c].alias(c) for c in CASE_ORDER[1:9]],
        ts.alias("cr_case_date"),
        fields["cr_referred"].alias("cr_referred"),
        fields["cr_referral_confirmation"].alias("cr_referral_confirmation"),
        fields["cr_general_description"].alias("cr_general_description"),
        fields["cr_additional_remarks"].alias("cr_additional_remarks"),
        _new_record_attachments("case_insert").alias("cr_attachments"),
        ts.alias("cr_create_date"), F.lit("[]").alias("cr_edit_history"),
        F.lit(None).cast("string").alias("cr_sender"))
    status = ch.select("seq", new_ids(cases, "cr_case_id").alias("cr_case_id"), F.lit("applied").alias("status"))
    return Written(cases.unionByName(rows), rows, status, case_referral_notifications(rows))


def update_cases(cases: DataFrame, changes: DataFrame, as_of=None,
                 keep_missing: bool = False) -> Written:
    """Overwrite 13 columns by case id, re-set the confirmation, append history
    (O49a). With ``keep_missing`` a request without any file list keeps the
    stored attachments instead of clearing them."""
    ts = as_of_column(as_of)
    ch = with_optional(changes).withColumnRenamed("caseId", "cr_case_id")
    sets = _case_fields()
    ch, sets["cr_attachments"], sent = _merge_on_change_side(ch, "case_update", keep_missing, "cr_attachments")
    table, rows, bad = _apply(cases, ch, "cr_case_id", sets, CASE_ORDER, history="cr_edit_history", ts=ts, sent=sent,
                              editor=F.coalesce(_c("userType"), F.lit(DEFAULT_EDITOR["case"])))
    status = _status(ch, cases, "cr_case_id", malformed=bad)
    done = _applied(ch, status).withColumns({k: v for k, v in _case_fields().items()})
    return Written(table, rows, status, case_referral_notifications(done))


# ---- counselling (O48b, O49b) ------------------------------------------------------

COUNSELING_ORDER = ["cor_record_id", "cor_origin_medical_id", "cor_origin_case_id",
                    "cor_session_number", "cor_student_id_number", "cor_student_name",
                    "cor_student_strand", "cor_student_grade_level", "cor_student_section",
                    "cor_school_year_semester", "cor_status", "cor_date", "cor_time",
                    "cor_general_concern", "cor_additional_remarks", "cor_attachments",
                    "cor_is_psychological_condition", "cor_create_date", "cor_edit_history"]


def _counseling_fields() -> dict[str, Column]:
    return {
        "cor_origin_medical_id": _c("originMedicalId").try_cast("bigint"),
        "cor_origin_case_id": _c("originCaseId").try_cast("bigint"),
        "cor_student_id_number": _c("studentId"), "cor_student_name": _c("studentName"),
        "cor_student_strand": _c("strand"), "cor_student_grade_level": _c("gradeLevel"),
        "cor_student_section": _c("section"),
        "cor_school_year_semester": blank_to_null(_c("schoolYearSemester")),
        "cor_session_number": _c("sessionNumber").try_cast("int"), "cor_status": _c("status"),
        "cor_date": blank_to_null(_c("date")).try_cast("timestamp_ntz"),
        "cor_time": blank_to_null(_c("time")),
        "cor_general_concern": _c("concern"),
        "cor_additional_remarks": F.coalesce(blank_to_null(_c("remarks")), F.lit("")),
        "cor_is_psychological_condition": F.coalesce(blank_to_null(_c("psychologicalCondition")),
                                                     F.lit("NO")),
    }


def insert_counseling(counseling: DataFrame, changes: DataFrame, as_of=None) -> Written:
    """New sessions (O48b); requests missing a required field are rejected."""
    ts = as_of_column(as_of)
    ch = with_optional(changes).withColumn("_missing", required_fields(
        with_optional(changes), "counseling"))
    ok = ch.where(F.size("_missing") == 0)
    f = _counseling_fields()
    files = plain_file_entries(_c("newFiles"))
    rows = ok.select(new_ids(counseling, "cor_record_id").alias("cor_record_id"),
                     *[f[c].alias(c) for c in COUNSELING_ORDER[1:15]],
                     to_json_or_null(files).alias("cor_attachments"),
                     f["cor_is_psychological_condition"].alias("cor_is_psychological_condition"),
                     ts.alias("cor_create_date"), F.lit("[]").alias("cor_edit_history"))
    status = ch.select("seq", F.when(F.size("_missing") > 0, F.concat(
        F.lit("rejected:missing:"), F.array_join("_missing", ","))).otherwise(F.lit("applied"))
        .alias("status"))
    return Written(counseling.unionByName(rows), rows, status)


def update_counseling(counseling: DataFrame, changes: DataFrame, as_of=None,
                      keep_missing: bool = False) -> Written:
    """Overwrite 16 columns by record id and append history."""
    ts = as_of_column(as_of)
    ch = with_optional(changes).withColumnRenamed("recordId", "cor_record_id")
    ch = ch.withColumn("_missing", required_fields(ch, "counseling"))
    valid = ch.where(F.size("_missing") == 0).drop("_missing")
    sets = _counseling_fields()
    valid, sets["cor_attachments"], sent = _merge_on_change_side(valid, "counseling_update", keep_missing,
                                                                 "cor_attachments")
    table, rows, bad = _apply(counseling, valid, "cor_record_id", sets, COUNSELING_ORDER,
                              history="cor_edit_history", ts=ts, sent=sent,
                              editor=F.coalesce(_c("userType"), F.lit(DEFAULT_EDITOR["counseling"])))
    status = _status(ch, counseling, "cor_record_id",
                     F.transform("_missing", lambda m: F.concat(F.lit("missing:"), m)), malformed=bad)
    return Written(table, rows, status)


# ---- medical (O48c, O49c) ------------------------------------------------------------

MEDICAL_ORDER = ["mr_medical_id", "mr_student_id", "mr_student_name", "mr_student_strand",
                 "mr_grade_level", "mr_section", "mr_school_year_semester", "mr_subject",
                 "mr_status", "mr_medical_details", "mr_additional_remarks", "mr_referred",
                 "mr_referral_confirmation", "mr_is_psychological", "mr_is_medical",
                 "mr_attachments", "mr_record_date", "mr_create_date", "mr_edit_history",
                 "mr_sender"]


def _medical_fields() -> dict[str, Column]:
    return {
        "mr_student_id": _c("studentId"), "mr_student_name": _c("studentName"),
        "mr_student_strand": _c("strand"), "mr_grade_level": _c("gradeLevel"),
        "mr_section": _c("section"), "mr_school_year_semester": _c("schoolYearSemester"),
        "mr_subject": _c("subject"), "mr_status": _c("status"),
        "mr_medical_details": _c("medicalDetails"), "mr_additional_remarks": _c("remarks"),
        "mr_referred": _c("referredToGCO"),
        "mr_is_psychological": _c("isPsychological"), "mr_is_medical": _c("isMedical"),
    }


def _uploads(rows: DataFrame, id_col: str, new_files: Column, uploader: Column) -> DataFrame:
    """Newly uploaded files as ``record_id, student_id, student_name, file_name, sender``."""
    return rows.select(F.col(id_col).alias("record_id"), F.col("mr_student_id").alias("student_id"),
                       F.col("mr_student_name").alias("student_name"), uploader.alias("sender"),
                       F.explode_outer(new_files).alias("_f")) \
        .where(F.col("_f").isNotNull()) \
        .select("record_id", "student_id", "student_name",
                F.col("_f.originalname").alias("file_name"), "sender")


def insert_medical(medical: DataFrame, changes: DataFrame, as_of=None) -> Written:
    """New medical records (O48c): confirmation always Pending, record date =
    the day of ``as_of``, files classified by original name; notifications for
    referrals (O53) and for files uploaded by OPD (O54)."""
    ts = as_of_column(as_of)
    ch = with_optional(changes)
    ch = ch.withColumn("_missing", required_fields(ch, "medical_insert"))
    ok = ch.where(F.size("_missing") == 0)
    uploader = F.coalesce(blank_to_null(_c("uploaderType")), F.lit("INF"))
    f = _medical_fields()
    files = new_file_entries(_c("newFiles"), _c("fileClassifications"), uploader,
                             F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    rows = ok.select(
        new_ids(medical, "mr_medical_id").alias("mr_medical_id"),
        *[f[c].alias(c) for c in MEDICAL_ORDER[1:12]],
        F.lit("Pending").alias("mr_referral_confirmation"),
        f["mr_is_psychological"].alias("mr_is_psychological"),
        f["mr_is_medical"].alias("mr_is_medical"),
        to_json_or_null(files).alias("mr_attachments"),
        F.to_date(ts).cast("timestamp_ntz").alias("mr_record_date"),
        ts.alias("mr_create_date"), F.lit("[]").alias("mr_edit_history"),
        F.lit(None).cast("string").alias("mr_sender"),
        uploader.alias("_uploader"), _c("newFiles").alias("_new"))
    notes = medical_referral_notifications(rows).unionByName(
        upload_notifications(_uploads(rows, "mr_medical_id", F.col("_new"), F.col("_uploader"))))
    rows = rows.drop("_uploader", "_new")
    status = ch.select("seq", F.when(F.size("_missing") > 0, F.concat(
        F.lit("rejected:missing:"), F.array_join("_missing", ","))).otherwise(F.lit("applied"))
        .alias("status"))
    return Written(medical.unionByName(rows), rows, status, notes)


def update_medical(medical: DataFrame, changes: DataFrame, as_of=None,
                   keep_missing: bool = False) -> Written:
    """Overwrite 14 columns by record id (O49c): referred defaults to 'No', the
    confirmation is left as it is, kept files get ``class OR file`` flags, new
    files carry uploader and date; required fields (O66) and the condition
    rule (O67) reject a request."""
    ts = as_of_column(as_of)
    ch = with_optional(changes).withColumnRenamed("recordId", "mr_medical_id")
    ch = ch.withColumn("_bad", F.concat(
        F.transform(required_fields(ch, "medical_update"), lambda m: F.concat(F.lit("missing:"), m)),
        reasons((~condition_consistency(), "neither_medical_nor_psychological"))))
    valid = ch.where(F.size("_bad") == 0).drop("_bad")
    uploader = F.coalesce(blank_to_null(_c("uploaderType")), F.lit(DEFAULT_EDITOR["medical"]))
    sets = _medical_fields()
    sets["mr_referred"] = F.coalesce(blank_to_null(_c("referredToGCO")), F.lit("No"))
    sets["mr_school_year_semester"] = blank_to_null(_c("schoolYearSemester"))
    sets["mr_additional_remarks"] = F.coalesce(blank_to_null(_c("remarks")), F.lit(""))
    valid, sets["mr_attachments"], sent = _merge_on_change_side(
        valid, "medical_update", keep_missing, "mr_attachments",
        classes=_c("fileClassifications"), uploader=uploader,
        upload_date=F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    table, rows, bad = _apply(medical, valid, "mr_medical_id", sets, MEDICAL_ORDER,
                              editor=uploader, history="mr_edit_history", ts=ts, sent=sent)
    status = _status(ch, medical, "mr_medical_id", F.col("_bad"), malformed=bad)
    done = _applied(ch, status).withColumns({"mr_student_id": _c("studentId"), "mr_student_name": _c("studentName")})
    notes = upload_notifications(_uploads(done, "mr_medical_id", F.col("newFiles"), uploader))
    return Written(table, rows, status, notes)


# ---- students (O48d, O49d, O50) --------------------------------------------------------

STUDENT_FIELDS = (("sd_id_number", "id"), ("sd_student_name", "name"), ("sd_strand", "strand"),
                  ("sd_grade_level", "gradeLevel"), ("sd_section", "section"),
                  ("sd_gender", "gender"), ("sd_religion", "religion"),
                  ("sd_previous_school", "previousSchool"), ("sd_status", "status"),
                  ("sd_birthdate", "birthdate"), ("sd_school_year_sem", "schoolYearSem"),
                  ("sd_school_year_semesterr", "schoolYearSemesterr"))


def _student_value(col: str, field: str) -> Column:
    if col == "sd_birthdate":
        return F.col(field).try_cast("date")
    if col == "sd_school_year_sem":
        return F.col(field).try_cast("int")
    return F.col(field).cast("string")


def insert_students(students: DataFrame, changes: DataFrame) -> Written:
    """Student rows as given, no checks (O48d)."""
    rows = changes.select(*[_student_value(c, f).alias(c) for c, f in STUDENT_FIELDS])
    status = changes.select("seq", F.lit("applied").alias("status"))
    return Written(students.unionByName(rows), rows, status)


def update_students(students: DataFrame, changes: DataFrame) -> Written:
    """Overwrite by id: every semester row of the id, semester included (O49d)."""
    ch = changes.withColumn("_id", ci_key("id"))
    sets = {c: _student_value(c, f) for c, f in STUDENT_FIELDS[1:]}
    keyed = students.withColumn("_id", ci_key("sd_id_number"))
    table, rows, _ = _apply(keyed, ch, "_id", sets, [c for c, _ in STUDENT_FIELDS] + ["_id"])
    return Written(table.drop("_id"), rows.drop("_id"), _student_status(ch, keyed))


def delete_students(students: DataFrame, ids: DataFrame) -> Written:
    """Remove every semester row of the requested ids."""
    req = ids.withColumn("_id", ci_key("id"))
    keyed, wanted = students.withColumn("_id", ci_key("sd_id_number")), req.select("_id").distinct()
    table = keyed.join(wanted, "_id", "left_anti").select(students.columns)
    removed = keyed.join(wanted, "_id", "left_semi").select(students.columns)
    return Written(table, removed, _student_status(req, keyed))


def _student_status(requests: DataFrame, keyed: DataFrame) -> DataFrame:
    """Status by request, with the id as it was sent."""
    found = _status(requests.select("seq", "_id"), keyed, "_id")
    return found.join(requests.select("seq", F.col("id").alias("sd_id_number")), "seq").select(
        "seq", "sd_id_number", "status")


# ---- users (O48e, O49e, O58, O59) -----------------------------------------------------------

USER_ORDER = ["u_email", "u_username", "u_name", "u_department", "u_type", "u_status",
              "created_at", "deactivated_at"]


def insert_users(users: DataFrame, changes: DataFrame, as_of=None) -> Written:
    """New accounts, status Active (O48e). Rejected: missing fields (O66),
    an e-mail or username already taken (ignoring case), or taken by an
    earlier request of the batch that was not rejected itself (O69); the failing
    field is named, e-mail first."""
    ts = as_of_column(as_of)
    ch = with_optional(changes)
    ch = ch.withColumn("_missing", required_fields(ch, "user"))
    ch = ch.withColumn("_e", F.lower("email")).withColumn("_u", F.lower("username"))
    # taken keys are looked up only for the requested ones (semi join first)
    taken_e = (users.select(F.lower("u_email").alias("_e"))
               .join(ch.select("_e"), "_e", "left_semi").distinct()
               .withColumn("_te", F.lit(True)))
    taken_u = (users.select(F.lower("u_username").alias("_u"))
               .join(ch.select("_u"), "_u", "left_semi").distinct()
               .withColumn("_tu", F.lit(True)))
    ch = ch.join(taken_e, "_e", "left").join(taken_u, "_u", "left")
    # Among those that miss nothing and clash with no account, names go out in order.
    could = (F.size("_missing") == 0) & F.col("_te").isNull() & F.col("_tu").isNull()
    got = first_takers(ch.where(could), ["_e", "_u"]).withColumn("_got", F.lit(True))
    ch = ch.join(got, "seq", "left")
    owners = (ch.where("_got").groupBy("_e").agg(F.min("seq").alias("_owner")))
    ch = ch.join(owners, "_e", "left")
    dup_email = F.coalesce(F.col("_te"), F.col("_owner") < F.col("seq"), F.lit(False))
    st = (F.when(F.size("_missing") > 0, F.lit("rejected:missing_fields"))
          .when(F.col("_got"), F.lit("applied"))
          .when(dup_email, F.lit("rejected:duplicate:email"))
          .otherwise(F.lit("rejected:duplicate:username")))
    ch = ch.withColumn("status", st)
    rows = ch.where(F.col("status") == "applied").select(
        F.col("email").alias("u_email"), F.col("username").alias("u_username"),
        F.col("name").alias("u_name"), F.col("department").alias("u_department"),
        F.col("userType").alias("u_type"), F.lit("Active").alias("u_status"),
        ts.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("deactivated_at"))
    return Written(users.unionByName(rows), rows, ch.select("seq", "email", "status"))


def update_users(users: DataFrame, changes: DataFrame) -> Written:
    """Change only the supplied fields of an account (O49e). A request with
    no field is rejected; so is one for a username that another account holds when
    its turn comes. A granted change frees the account's former username; requests
    for unknown accounts take none."""
    ch = with_optional(changes).withColumn("u_email", F.lower("email"))
    fields = {"u_username": "username", "u_name": "name", "u_department": "department",
              "u_type": "userType"}     # NULL: not sent; '' clears a field
    supplied = reduce(or_, (F.col(f).isNotNull() for f in [*fields.values(), "password"]))
    held = users.select(F.lower("u_email").alias("account"), F.lower("u_username").alias("name"))
    wanted = (ch.where(F.col("username").isNotNull() & F.col("u_email").isNotNull())
              .select("seq", F.col("u_email").alias("account"), F.lower("username").alias("name")))
    wanted = wanted.join(held.select("account"), "account", "left_semi")
    decided = names_in_order(wanted, held.where(F.col("name").isNotNull()))
    ch = ch.join(decided, "seq", "left")
    bad = reasons((~supplied, "no_fields"), (~F.coalesce(F.col("ok"), F.lit(True)), "duplicate:username"))
    ch = ch.withColumn("_bad", bad).drop("ok")
    valid = ch.where(F.size("_bad") == 0)
    # The last sent value of each field, whichever request of the account sent it.
    last = valid.groupBy("u_email").agg(
        F.max("seq").alias("seq"), *(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f)
                                     for f in fields.values()))
    sets = {c: F.coalesce(F.col(f), F.col(c)) for c, f in fields.items()}
    keyed = users.withColumn("_orig_email", F.col("u_email")).withColumn("u_email", F.lower("u_email"))
    table, rows, _ = _apply(keyed, last, "u_email", sets,
                            ["_orig_email"] + USER_ORDER[1:])
    table = table.withColumnRenamed("_orig_email", "u_email").select(*USER_ORDER)
    rows = rows.withColumnRenamed("_orig_email", "u_email").select(*USER_ORDER)
    status = _status(ch, keyed.select("u_email"), "u_email", F.col("_bad")) \
        .withColumnRenamed("u_email", "email")
    return Written(table, rows, status)


def _guard_from(r: DataFrame, consumes: Column, available: Column) -> Column:
    """The ``seq`` after which a guarded request would take the last administrator.

    ``available`` accounts, each consumed once at most, leave ``available - 1``
    requests to grant. So only the last two consuming requests matter: without
    a window, three scalar aggregates over the requests.
    """
    used = r.where(consumes)
    n, last = used.agg(F.count("*")).scalar(), used.agg(F.max("seq")).scalar()
    before = used.where(F.col("seq") < last).agg(F.max("seq")).scalar()
    never = F.lit((1 << 63) - 1)
    return (F.when(available <= 1, F.lit(-(1 << 63) + 1)).when(n >= available, before)
            .when(n == available - 1, last).otherwise(never))


def _requests(users: DataFrame, requests: DataFrame, cols: list[str]) -> DataFrame:
    """Requests joined to their account (ignoring case); ``_first`` marks the
    first request per account. Later repeats are reported as duplicates."""
    req = first_in_batch(requests.withColumn("_e", F.lower("email")), [F.col("_e")],
                         flag="_first")
    acct = users.select(F.lower("u_email").alias("_e"), *cols, F.lit(True).alias("_found"))
    return req.join(acct, "_e", "left")


def _set_users(users: DataFrame, status: DataFrame, sets: dict[str, Column]) -> tuple:
    done = status.where(F.col("status") == "applied").select(F.lower("email").alias("_e")) \
        .distinct().withColumn("_hit", F.lit(True))
    keyed = users.withColumn("_e", F.lower("u_email")).join(done, "_e", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    table = keyed.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets
                           else F.col(c) for c in USER_ORDER], hit.alias("_hit"))
    return table.drop("_hit"), table.where("_hit").drop("_hit")


def deactivate_users(users: DataFrame, requests: DataFrame, as_of=None) -> Written:
    """Deactivate accounts in request order.

    Administrators (exact type) are refused while the active administrators
    would drop below one; this guard is checked before the already-inactive
    check, as in the account screen.
    """
    ts = as_of_column(as_of)
    active_admins = users.agg(F.count_if(ci_eq("u_type", "Administrator")
                                         & ci_eq("u_status", "Active"))).scalar()
    r = _requests(users, requests, ["u_type", "u_status"])
    first = F.coalesce(F.col("_first"), F.lit(False))
    is_admin = F.coalesce(F.col("u_type") == "Administrator", F.lit(False))
    active = F.coalesce(ci_eq("u_status", "Active"), F.lit(False))
    guard = _guard_from(r, is_admin & first & active, active_admins)
    st = (F.when(F.col("_found").isNull(), F.lit("not_found"))
          .when(~first, F.lit("rejected:duplicate_request"))
          .when(is_admin & (F.col("seq") > guard), F.lit("rejected:last_active_administrator"))
          .when(~active, F.lit("rejected:already_inactive"))
          .otherwise(F.lit("applied")))
    status = r.select("seq", "email", st.alias("status"))
    table, rows = _set_users(users, status, {"u_status": F.lit("Inactive"), "deactivated_at": ts})
    return Written(table, rows, status)


def activate_users(users: DataFrame, requests: DataFrame) -> Written:
    """Re-activate inactive accounts and clear the stamp."""
    r = _requests(users, requests, ["u_status"])
    st = (F.when(F.col("_found").isNull(), F.lit("not_found"))
          .when(~F.col("_first"), F.lit("rejected:duplicate_request"))
          .when(~F.coalesce(ci_eq("u_status", "Inactive"), F.lit(False)), F.lit("rejected:already_active"))
          .otherwise(F.lit("applied")))
    status = r.select("seq", "email", st.alias("status"))
    table, rows = _set_users(users, status, {
        "u_status": F.lit("Active"), "deactivated_at": F.lit(None).cast("timestamp_ntz")})
    return Written(table, rows, status)


def delete_users(users: DataFrame, requests: DataFrame) -> Written:
    """Delete accounts in request order (O59): an account whose status is
    exactly 'Active' is refused; an administrator is refused while the
    administrators (any status) would drop below one."""
    total_admins = users.agg(F.count_if(ci_eq("u_type", "Administrator"))).scalar()
    r = _requests(users, requests, ["u_type", "u_status"])
    first = F.coalesce(F.col("_first"), F.lit(False))
    is_admin = F.coalesce(F.col("u_type") == "Administrator", F.lit(False))
    deletable = ~F.col("u_status").eqNullSafe("Active")     # no status is not 'Active'
    guard = _guard_from(r, F.col("_found").isNotNull() & is_admin & first & deletable, total_admins)
    st = (F.when(F.col("_found").isNull(), F.lit("not_found"))
          .when(~first, F.lit("rejected:duplicate_request"))
          .when(~deletable, F.lit("rejected:active_user"))
          .when(is_admin & (F.col("seq") > guard), F.lit("rejected:last_administrator"))
          .otherwise(F.lit("applied")))
    status = r.select("seq", "email", st.alias("status"))
    done = status.where(F.col("status") == "applied").select(F.lower("email").alias("_e"))
    keyed = users.withColumn("_e", F.lower("u_email"))
    table = keyed.join(done, "_e", "left_anti").select(*USER_ORDER)
    rows = keyed.join(done, "_e", "left_semi").select(*USER_ORDER)
    return Written(table, rows, status)


def sequence_ids(df: DataFrame, order_cols: list[str], base: Column, name: str,
                 partitions: int | None = None) -> DataFrame:
    """Dense ids ``base + 1 .. base + n`` in the order of ``order_cols`` (which
    must be unique), for derived rows that carry no request ``seq``.

    No single-partition window over the rows: they are range-partitioned on
    the order columns, numbered inside each partition, and shifted by the row
    counts of the earlier partitions (a table with one row per partition).
    The numbered rows are checkpointed to the shared checkpoint folder first,
    so the counts and the rows come from the same partitioning even if a task
    is recomputed.
    """
    from pyspark.sql import Window
    from campusledger.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)           # the cluster's shared folder (set if absent locally)
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    numbered = (df.repartitionByRange(n, *order_cols)
                .withColumn("_p", F.spark_partition_id())
                .withColumn("_r", F.row_number().over(
                    Window.partitionBy("_p").orderBy(*order_cols)))
                .checkpoint(eager=True))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("_p").agg(F.max("_r").alias("_c"))
               .withColumn("_off", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
               .select("_p", "_off"))
    return (numbered.join(F.broadcast(offsets), "_p")
            .withColumn(name, (base + F.col("_off") + F.col("_r")).cast("bigint"))
            .drop("_p", "_r", "_off"))
