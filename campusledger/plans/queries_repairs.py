"""Registered queries on inputs that reach the edges: several requests for one
key, ids in mixed case, lists that do not parse, several files of a record.

Each input is derived from the whole record tables, like those of
``queries_changes``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq
from campusledger.operators import attachments as A
from campusledger.operators import changes as C
from campusledger.operators import filters as Fl
from campusledger.operators import joins as J
from campusledger.operators import projections as P
from campusledger.operators import summaries as S
from campusledger.plans.catalog import register
from campusledger.plans.queries_changes import (_USER_SEQ, AS_OF, AS_OF_ISO, HISTORY_ENTRY, _att_sql,
                                                _case_resolutions, _user_seq)
from campusledger.plans.queries_core import _CASE, _summary_sql

# ---- several requests for one case (O49a, O52, O53) --------------------------------------


def _repeated(cases):
    """Two requests per ongoing case: a referral by GCO, then the resolution."""
    last = _case_resolutions(cases).withColumns({"seq": 2 * F.col("caseId") + 1, "userType": F.lit("OPD"),
                                                 "referredToGCO": F.lit("No")})
    first = last.withColumns({"seq": 2 * F.col("caseId"), "userType": F.lit("GCO"), "status": F.lit("Ongoing"),
                              "referredToGCO": F.lit("Yes"), "remarks": F.lit("first")})
    return first.unionByName(last)


_TWO = f"{HISTORY_ENTRY % 'GCO'},{HISTORY_ENTRY % 'OPD'}"


@register("update_cases_repeated", f"""
SELECT cr_case_id, CASE WHEN u THEN 'Resolved' ELSE cr_status END AS cr_status,
       CASE WHEN u THEN 'closed' ELSE cr_additional_remarks END AS cr_additional_remarks,
       CASE WHEN u THEN 'No' ELSE cr_referred END AS cr_referred,
       CASE WHEN NOT u THEN cr_referral_confirmation END AS cr_referral_confirmation,
       CASE WHEN u THEN {_att_sql('cr_attachments')} ELSE cr_attachments END AS cr_attachments,
       CASE WHEN NOT u THEN cr_edit_history
            WHEN coalesce(cr_edit_history, '') IN ('', '[]') THEN '[{_TWO}]'
            ELSE rtrim(cr_edit_history, ']') || ',{_TWO}]' END AS cr_edit_history
FROM (SELECT *, lower(cr_status) = 'ongoing' AS u FROM tbl_case_records) c""")
def update_cases_repeated(t):
    cases = t["tbl_case_records"]
    return C.update_cases(cases, _repeated(cases), AS_OF).table.select(
        "cr_case_id", "cr_status", "cr_additional_remarks", "cr_referred", "cr_referral_confirmation",
        "cr_attachments", "cr_edit_history")


@register("update_cases_repeated_status", """
SELECT 2 * cr_case_id + k AS seq, cr_case_id, 'applied' AS status
FROM tbl_case_records, (VALUES (0), (1)) AS v(k) WHERE lower(cr_status) = 'ongoing'""")
def update_cases_repeated_status(t):
    cases = t["tbl_case_records"]
    return C.update_cases(cases, _repeated(cases), AS_OF).status


@register("update_cases_repeated_notifications", """
SELECT 'OPD' AS n_sender, 'GCO' AS n_receiver, 'Referral' AS n_type,
       format('New case referral for {} ({}) - {} violation', cr_student_name, cr_student_id,
              cr_violation_level) AS n_message,
       cr_case_id AS n_related_record_id, 'case_record' AS n_related_record_type
FROM tbl_case_records WHERE lower(cr_status) = 'ongoing'""")
def update_cases_repeated_notifications(t):
    cases = t["tbl_case_records"]
    return C.update_cases(cases, _repeated(cases), AS_OF).notifications


# ---- history that does not parse; an unknown case ------------------------------------------

def _damaged(cases):
    return cases.withColumn("cr_edit_history", F.when(F.col("cr_case_id") % 7 == 1, F.lit("[{oops"))
                            .when(F.col("cr_case_id") % 7 == 2, F.lit('[{"editedBy":"X","note":"kept"}]'))
                            .otherwise(F.col("cr_edit_history")))


def _edits(cases):
    known = _case_resolutions(cases)
    return known.unionByName(known.withColumns({"seq": -F.col("seq") - 1, "caseId": -F.col("caseId") - 1}))


@register("update_cases_malformed_history", f"""
SELECT cr_case_id,
       CASE WHEN u AND cr_case_id % 7 <> 1 THEN 'Resolved' ELSE cr_status END AS cr_status,
       CASE WHEN cr_case_id % 7 = 1 THEN '[{{oops'
            WHEN cr_case_id % 7 = 2 THEN '[{{"editedBy":"X","note":"kept"}}' ||
                 CASE WHEN u THEN ',{HISTORY_ENTRY % 'OPD'}]' ELSE ']' END
            WHEN NOT u THEN cr_edit_history
            WHEN coalesce(cr_edit_history, '') IN ('', '[]') THEN '[{HISTORY_ENTRY % 'OPD'}]'
            ELSE rtrim(cr_edit_history, ']') || ',{HISTORY_ENTRY % 'OPD'}]' END AS cr_edit_history
FROM (SELECT *, lower(cr_status) = 'ongoing' AS u FROM tbl_case_records) c""")
def update_cases_malformed_history(t):
    cases = _damaged(t["tbl_case_records"])
    return C.update_cases(cases, _edits(cases), AS_OF).table.select("cr_case_id", "cr_status", "cr_edit_history")


@register("update_cases_malformed_status", """
SELECT CASE WHEN k = 0 THEN cr_case_id ELSE -cr_case_id - 1 END AS seq,
       CASE WHEN k = 0 THEN cr_case_id ELSE -cr_case_id - 1 END AS cr_case_id,
       CASE WHEN k = 1 THEN 'not_found' WHEN cr_case_id % 7 = 1 THEN 'rejected:malformed'
            ELSE 'applied' END AS status
FROM tbl_case_records, (VALUES (0), (1)) AS v(k) WHERE lower(cr_status) = 'ongoing'""")
def update_cases_malformed_status(t):
    cases = _damaged(t["tbl_case_records"])
    return C.update_cases(cases, _edits(cases), AS_OF).status


# ---- one of several files, unknown fields, a list that does not parse (O51) -----------------

@register("remove_medical_attachment", """
SELECT mr_medical_id,
       CASE WHEN slot = 3 AND mr_medical_id % 2 = 0 THEN '[{oops'
            WHEN slot = 3 THEN '[{"filename":"b.pdf","note":{"x":[1,null]}}]'
            WHEN slot = 4 THEN NULL ELSE mr_attachments END AS mr_attachments
FROM (SELECT *, mr_medical_id % 10 AS slot FROM tbl_medical_records) m""")
def remove_medical_attachment(t):
    slot = F.col("mr_medical_id") % 10
    two = F.lit('[{"filename":"a.pdf","note":1},{"filename":"b.pdf","note":{"x":[1,null]}}]')
    med = t["tbl_medical_records"].withColumn("mr_attachments", F.when(
        (slot == 3) & (F.col("mr_medical_id") % 2 == 0), F.lit("[{oops")).when(slot == 3, two).when(
        slot == 4, F.lit('[{"filename":"a.pdf"}]')).otherwise(F.col("mr_attachments")))
    req = med.where(slot.isin(3, 4)).select(F.col("mr_medical_id").alias("record_id"), F.lit("a.pdf").alias("filename"))
    return A.remove_attachment(med, "mr_medical_id", "mr_attachments", req).select("mr_medical_id", "mr_attachments")


# ---- ids in mixed case (rule S1) ---------------------------------------------------------------

def _mixed(t):
    """Students ``st...``, their cases ``ST...``, ``St...`` and ``st...`` in turn."""
    students = t["tbl_student_data"].withColumn("sd_id_number", F.concat(F.lit("st"), "sd_id_number"))
    k = F.col("cr_case_id") % 3
    prefix = F.when(k == 0, F.lit("ST")).when(k == 1, F.lit("St")).otherwise(F.lit("st"))
    cases = t["tbl_case_records"].withColumn("cr_student_id", F.concat(prefix, "cr_student_id"))
    return students, cases


@register("student_case_summary_mixed_case",
          f"SELECT * REPLACE (concat('st', id) AS id) FROM ({_summary_sql(**_CASE)}) AS s")
def student_case_summary_mixed_case(t):
    return S.student_case_summary(*_mixed(t))


@register("students_join_cases_mixed_case", """
SELECT sd_id_number AS id, sd_school_year_semesterr AS semester, cr_case_id
FROM tbl_student_data JOIN tbl_case_records ON sd_id_number = cr_student_id""")
def students_join_cases_mixed_case(t):
    return J.students_join_cases(*_mixed(t)).select(
        F.substring("sd_id_number", 3, 100).alias("id"), F.col("sd_school_year_semesterr").alias("semester"), "cr_case_id")


@register("delete_students_mixed_case", """
SELECT sd_id_number, sd_school_year_semesterr FROM tbl_student_data
WHERE NOT ends_with(sd_id_number, '3')""")
def delete_students_mixed_case(t):
    students = t["tbl_student_data"]
    lettered = students.withColumn("sd_id_number", F.concat(F.lit("st"), "sd_id_number"))
    ids = students.where(F.col("sd_id_number").endswith("3")).select(
        F.concat(F.lit("ST"), "sd_id_number").alias("id")).distinct()
    out = C.delete_students(lettered, ids.withColumn("seq", F.xxhash64("id"))).table
    return out.select(F.substring("sd_id_number", 3, 100).alias("sd_id_number"), "sd_school_year_semesterr")


@register("cases_of_odd_ids", """
SELECT c.cr_case_id FROM tbl_case_records c WHERE c.cr_case_id % 4 = 0""")
def cases_of_odd_ids(t):
    """Look-ups by text ids: whole numbers in several spellings, and fractions that find nothing."""
    cases = t["tbl_case_records"]
    k, text = F.col("cr_case_id") % 4, F.col("cr_case_id").cast("string")
    asked = cases.select(F.when(k == 0, F.concat(text, F.lit(".0"))).when(k == 1, F.concat(text, F.lit(".7")))
                         .when(k == 2, F.concat(text, F.lit("x"))).alias("cr_case_id"))
    return Fl.records_by_ids(cases, "case", asked).select("cr_case_id")


# ---- accounts (O48e, O49e, O58, O59): the new tables, and several requests for one account ----

@register("update_users_repeated", """
SELECT u_email, concat('New ', u_name) AS u_name, 'Guidance' AS u_department FROM users""")
def update_users_repeated(t):
    u = t["users"]
    asked = u.select(_user_seq().alias("seq"), F.upper("u_email").alias("email"), F.col("u_name").alias("n"))
    ch = asked.select((2 * F.col("seq")).alias("seq"), "email", F.concat(F.lit("New "), "n").alias("name"),
                      F.lit(None).cast("string").alias("department"))
    ch = ch.unionByName(asked.select((2 * F.col("seq") + 1).alias("seq"), "email",
                                     F.lit(None).cast("string").alias("name"), F.lit("Guidance").alias("department")))
    return C.update_users(u, ch).table.select("u_email", "u_name", "u_department")


@register("update_users_one_username", f"""
SELECT {_USER_SEQ} AS seq, u_email AS email,
       CASE WHEN {_USER_SEQ} = (SELECT min({_USER_SEQ}) FROM users) THEN 'applied'
            ELSE 'rejected:duplicate:username' END AS status
FROM users""")
def update_users_one_username(t):
    u = t["users"]
    return C.update_users(u, u.select(_user_seq().alias("seq"), F.col("u_email").alias("email"),
                                      F.concat(F.lit("the.same"), F.substring("u_email", 1, 0)).alias("username"))).status


@register("insert_users_table", f"""
SELECT u_email, u_username, u_status FROM users
UNION ALL
SELECT concat('new.', u_email), concat('new', u_username), 'Active' FROM users""")
def insert_users_table(t):
    """Each account asks twice: first without a password (rejected), then complete."""
    u = t["users"]
    full = u.select((2 * _user_seq() + 1).alias("seq"), F.concat(F.lit("new."), "u_email").alias("email"),
                    F.concat(F.lit("new"), "u_username").alias("username"), F.col("u_name").alias("name"),
                    F.col("u_department").alias("department"), F.col("u_type").alias("userType"),
                    F.lit("secret").alias("password"))
    bare = full.withColumns({"seq": F.col("seq") - 1, "password": F.lit("")})
    return C.insert_users(u, bare.unionByName(full), AS_OF).table.select("u_email", "u_username", "u_status")


_ADMINS = f"""WITH r AS (SELECT {_USER_SEQ} AS seq, * FROM users WHERE u_type = 'Administrator')"""


@register("deactivate_users_table", f"""
{_ADMINS}, last AS (SELECT max(seq) AS seq FROM r WHERE u_status = 'Active')
SELECT u.u_email, CASE WHEN r.seq IS NOT NULL AND u.u_status = 'Active' AND r.seq < last.seq
                       THEN 'Inactive' ELSE u.u_status END AS u_status,
       CASE WHEN r.seq IS NOT NULL AND u.u_status = 'Active' AND r.seq < last.seq THEN '{AS_OF_ISO}'
            ELSE strftime(u.deactivated_at, '%Y-%m-%dT%H:%M:%S.%gZ') END AS deactivated_at
FROM users u CROSS JOIN last LEFT JOIN r ON r.u_email = u.u_email""")
def deactivate_users_table(t):
    from campusledger.functions.semantics import iso_millis
    u = t["users"]
    req = u.where(ci_eq("u_type", "Administrator")).select(_user_seq().alias("seq"), F.col("u_email").alias("email"))
    return C.deactivate_users(u, req, AS_OF).table.select("u_email", "u_status",
                                                          iso_millis("deactivated_at").alias("deactivated_at"))


@register("delete_users_table", f"""
{_ADMINS}, n AS (SELECT count(*) AS n FROM r), g AS (SELECT max(seq) AS seq FROM r WHERE u_status IS DISTINCT FROM 'Active')
SELECT u.u_email FROM users u CROSS JOIN n CROSS JOIN g
WHERE u.u_status = 'Active'
   OR (u.u_type = 'Administrator' AND {_USER_SEQ.replace('u_email', 'u.u_email')} = g.seq
       AND (SELECT count(*) FROM r WHERE u_status IS DISTINCT FROM 'Active') = n.n)""")
def delete_users_table(t):
    u = t["users"]
    return C.delete_users(u, u.select(_user_seq().alias("seq"), F.col("u_email").alias("email"))).table.select("u_email")


# ---- the parsed form of the JSON columns (O7-O10) ------------------------------------------------

def _parsed(df, key):
    """Each typed list flattened to one text, so that the parsed fields are compared."""
    files = F.transform("attachments", lambda f: F.concat_ws(
        "|", f["filename"], f["mimetype"], f["size"].cast("string"), f["isMedical"].cast("string"), f["uploadedBy"]))
    edits = F.transform("editDate", lambda e: F.concat_ws("|", e["editedBy"], e["timestamp"].cast("string")))
    return df.select(F.col(key).alias("record"), F.array_join(files, ";").alias("files"), F.size("attachments").alias("n_files"),
                     F.array_join(edits, ";").alias("edits"))


def _parsed_sql(table, key, attachments, history):
    def fields(x, names):
        return "concat_ws('|', " + ", ".join(f"{x}->>'{n}'" for n in names) + ")"
    files = f"coalesce(CAST(nullif({attachments}, '') AS JSON[]), [])"
    edits = f"coalesce(CAST(nullif({history}, '') AS JSON[]), [])"
    return f"""
SELECT {key} AS record,
       array_to_string(list_transform({files}, lambda f: {fields('f', ['filename', 'mimetype', 'size', 'isMedical', 'uploadedBy'])}), ';') AS files,
       CAST(len({files}) AS INTEGER) AS n_files,
       array_to_string(list_transform({edits}, lambda e: {fields('e', ['editedBy', 'timestamp'])}), ';') AS edits
FROM {table}"""


@register("case_records_parsed", _parsed_sql("tbl_case_records", "cr_case_id", "cr_attachments", "cr_edit_history"))
def case_records_parsed(t):
    return _parsed(P.case_projection(t["tbl_case_records"]), "caseNo")


@register("counseling_records_parsed",
          _parsed_sql("tbl_counseling_records", "cor_record_id", "cor_attachments", "cor_edit_history"))
def counseling_records_parsed(t):
    return _parsed(P.counseling_projection(t["tbl_counseling_records"]), "recordId")


@register("medical_records_parsed",
          _parsed_sql("tbl_medical_records", "mr_medical_id", "mr_attachments", "mr_edit_history"))
def medical_records_parsed(t):
    return _parsed(P.medical_projection(t["tbl_medical_records"]), "recordId")


@register("infirmary_records_parsed",
          _parsed_sql("tbl_medical_records", "mr_medical_id", "mr_attachments", "mr_edit_history"))
def infirmary_records_parsed(t):
    return _parsed(P.infirmary_projection(t["tbl_medical_records"]), "recordId")
