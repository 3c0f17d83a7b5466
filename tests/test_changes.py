"""Batch changes: referrals, guards, imports, properties."""

import datetime as dt
import os

from pyspark.sql import functions as F

from campusledger.operators import changes as C, imports as IM, inbox as I, kpis, referrals as R
from campusledger.sources.files import read_import_cells, read_import_csv
from campusledger.sources.tables import SCHEMAS


def _users(spark, rows):
    return spark.createDataFrame(
        [(e, e.split("@")[0], e, "OPD", t, s, dt.datetime(2024, 1, 1), None) for e, t, s in rows],
        SCHEMAS["users"])


def _status(w):
    return {r.email: r.status for r in w.status.collect()}


def test_last_active_admin_guard(spark):
    users = _users(spark, [("a@x", "Administrator", "Active"), ("b@x", "Administrator", "Active"),
                           ("c@x", "Administrator", "Inactive"), ("d@x", "Staff", "Active")])
    req = spark.createDataFrame([(1, "a@x"), (2, "c@x"), (3, "b@x"), (4, "d@x"), (5, "zz@x"),
                                 (6, "d@x")], "seq long, email string")
    st = _status(C.deactivate_users(users, req, "2024-06-01 00:00:00"))
    assert st["a@x"] == "applied"
    assert st["c@x"] == "rejected:last_active_administrator"   # guard before inactive check
    assert st["b@x"] == "rejected:last_active_administrator"
    assert st["zz@x"] == "not_found"
    w = C.deactivate_users(users, req, "2024-06-01 00:00:00")
    table = {r.u_email: (r.u_status, r.deactivated_at) for r in w.table.collect()}
    assert table["a@x"] == ("Inactive", dt.datetime(2024, 6, 1))
    assert table["b@x"][0] == "Active"


def test_delete_users_guard(spark):
    users = _users(spark, [("a@x", "Administrator", "Inactive"),
                           ("b@x", "Administrator", "Inactive"), ("c@x", "Staff", "Active")])
    req = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "c@x")], "seq long, email string")
    w = C.delete_users(users, req)
    assert _status(w) == {"a@x": "applied", "b@x": "rejected:last_administrator",
                          "c@x": "rejected:active_user"}
    assert sorted(r.u_email for r in w.table.collect()) == ["b@x", "c@x"]


def test_insert_users_unique(spark):
    users = _users(spark, [("a@x", "Staff", "Active")])
    req = spark.createDataFrame(
        [(1, "A@x", "n1", "N", "Staff", "p"), (2, "new@x", "a", "N", "Staff", "p"),
         (3, "n2@x", "z", "N", "Staff", "p"), (4, "n3@x", "Z", "N", "Staff", "p"),
         (5, "n4@x", "q", "N", "Staff", None)],
        "seq long, email string, username string, name string, userType string, password string")
    st = {r.seq: r.status for r in C.insert_users(users, req).status.collect()}
    assert st == {1: "rejected:duplicate:email", 2: "rejected:duplicate:username",
                  3: "applied", 4: "rejected:duplicate:username", 5: "rejected:missing_fields"}


def _case_rows(spark, specs):
    rows = []
    for cid, referred, conf, sem in specs:
        rows.append((cid, "000001", "Ann", "STEM", "11", "S1", sem, "Minor", "Ongoing",
                     dt.datetime(2024, 1, 1), referred, conf, "d", "", None,
                     dt.datetime(2024, 1, 1), "[]", "OPD"))
    return spark.createDataFrame(rows, SCHEMAS["tbl_case_records"])


def test_confirm_case_referrals(spark):
    cases = _case_rows(spark, [(1, "Yes", "Pending", None), (2, "Yes", "Accepted", "x"),
                               (3, "No", None, "x"), (4, "yes", "pending", "")])
    req = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "record_id long")
    res = R.confirm_case_referrals(cases, req)
    st = {r.record_id: r.status for r in res.status.collect()}
    assert st == {1: "applied", 2: "not_found", 3: "not_found", 4: "applied", 9: "not_found"}
    conf = {r.cr_case_id: r.cr_referral_confirmation for r in res.table.collect()}
    assert conf == {1: "Accepted", 2: "Accepted", 3: None, 4: "Accepted"}
    sessions = sorted((r.cor_origin_case_id, r.cor_school_year_semester, r.cor_status,
                       r.cor_is_psychological_condition) for r in res.counseling.collect())
    assert sessions == [(1, None, "TO SCHEDULE", "UNCONFIRMED"),
                        (4, None, "TO SCHEDULE", "UNCONFIRMED")]
    msgs = sorted(r.n_message for r in res.notifications.collect())
    assert msgs[0] == "Case referral for Ann (000001) has been accepted by GCO"


def test_mark_all_read_is_idempotent(spark, tables):
    n = tables["tbl_notifications"]
    once = I.mark_all_read(n, "GCO").table
    twice = I.mark_all_read(once, "GCO")
    assert twice.status.first().affectedRows == 0
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.table.collect()))


def test_kpi_properties(spark, tables):
    users = tables["users"]
    total = kpis.user_totals(users).first().totalUsers
    assert sum(r["count"] for r in kpis.user_status_breakdown(users).collect()) == total
    med = tables["tbl_medical_records"]
    c = kpis.certificate_totals(med).first()
    graded = med.where(F.col("mr_grade_level").isin("11", "12")).count()
    assert sum(c) == graded


def test_import_csv_file(spark, tmp_dir):
    path = os.path.join(tmp_dir, "students.csv")
    with open(path, "w") as fh:
        fh.write(" ID Number ,Student Name,GRADE,Status,Birthdate,Semester\n")
        fh.write("1,Ann,11,,2008-02-03,2024-2025-1\n")
        fh.write("2,Ben,12,Inactive,3/4/2008,\n")
        fh.write(",NoId,11,,,2024-2025-1\n")
        fh.write("3,,11,,,2024-2025-1\n")
        fh.write("1,Ann again,11,,junk,2024-2025-1\n")
        fh.write("5,Eve,11,,2008-13-45,2023-2024-1\n")
    raw = read_import_csv(spark, path)
    mapped = IM.map_csv_rows(raw)
    students = spark.createDataFrame(
        [("5", "Eve", "STEM", "11", "S", "F", "R", "P", "Active", None, 0, "2023-2024-1")],
        SCHEMAS["tbl_student_data"])
    res = IM.import_students(students, mapped)
    s = res.summary.first()
    assert (s.total_records, s.successful_imports, s.failed_imports, s.duplicates_found) == \
        (4, 2, 0, 2)
    assert s.total_records == s.successful_imports + s.failed_imports + s.duplicates_found
    ins = {r.sd_id_number: r for r in res.inserted.collect()}
    assert ins["1"].sd_status == "Active" and ins["1"].sd_birthdate == dt.date(2008, 2, 3)
    assert ins["2"].sd_school_year_semesterr == "2025-2026-1"
    assert ins["2"].sd_birthdate == dt.date(2008, 3, 4)
    assert [r.message for r in res.messages.collect()] == [
        "Duplicate: 1 for semester 2024-2025-1", "Duplicate: 5 for semester 2023-2024-1"]
    assert res.rejected.count() == 2


def test_import_sheet_cells(spark):
    cells = spark.createDataFrame(
        [(1, ["Student Number", "Full Name", "Grade/Level", "Birth date", "School Year"]),
         (2, ["", "", "", "", ""]),
         (3, ["100", "Ann", "11", "45000", ""]),
         (4, ["101", "Ben", "12", "2008-01-02", "2024-2025-1"])],
        "row_no long, cells array<string>")
    headers, rows = read_import_cells(cells)
    out = {r.id: r for r in IM.map_sheet_cells(rows, headers).collect()}
    assert out["100"].birthdate == dt.date(2023, 3, 15)
    assert out["100"].schoolYearSemesterr == ""          # blank stays blank in sheets
    # 'Student Number' contains 'student', so the name rule also picks column 0
    assert out["100"].name == "100" and out["101"].gradeLevel == "12"
    assert out["100"].status == "Active"
    # 'Student ID' before 'Student Name': the name resolves to the id column
    idx = IM.resolve_sheet_header(["Student ID", "Student Name"])
    assert idx["id"] == 0 and idx["name"] == 0


def test_update_students_overwrites_all_semesters(spark):
    students = spark.createDataFrame(
        [("1", "Ann", "STEM", "11", "S", "F", "R", "P", "Active", None, 0, "2023-2024-1"),
         ("1", "Ann", "STEM", "12", "S", "F", "R", "P", "Active", None, 0, "2024-2025-1"),
         ("2", "Ben", "ABM", "11", "S", "M", "R", "P", "Active", None, 0, "2024-2025-1")],
        SCHEMAS["tbl_student_data"])
    ch = spark.createDataFrame(
        [(1, "1", "Ann B", "STEM", "12", "S", "F", "R", "P", "Active", None, "0", "2025-2026-1")],
        "seq long, id string, name string, strand string, gradeLevel string, section string, "
        "gender string, religion string, previousSchool string, status string, "
        "birthdate string, schoolYearSem string, schoolYearSemesterr string")
    w = C.update_students(students, ch)
    rows = sorted((r.sd_id_number, r.sd_student_name, r.sd_school_year_semesterr)
                  for r in w.table.collect())
    assert rows == [("1", "Ann B", "2025-2026-1"), ("1", "Ann B", "2025-2026-1"),
                    ("2", "Ben", "2024-2025-1")]


def _med_requests(spark, rows):
    return spark.createDataFrame(rows, (
        "seq long, studentId string, studentName string, strand string, gradeLevel string, "
        "section string, schoolYearSemester string, subject string, status string, "
        "medicalDetails string, remarks string, referredToGCO string, isPsychological string, "
        "isMedical string, uploaderType string, newFiles array<struct<filename:string,"
        "originalname:string,mimetype:string,size:bigint,path:string>>, fileClassifications "
        "array<struct<filename:string,isMedical:boolean,isPsychological:boolean>>"))


def test_insert_medical_files_and_notices(spark, tables):
    med = tables["tbl_medical_records"]
    req = _med_requests(spark, [
        (1, "000001", "Ann", "STEM", "11", "S1", "2024-2025-1", "flu", "Ongoing", "d", "",
         "Yes", "Yes", "No", "OPD",
         [("OPDMC_a-1.pdf", "a.pdf", "application/pdf", 10, "/u/a"),
          ("OPDMC_b-1.pdf", "b.pdf", "application/pdf", 20, "/u/b")],
         [("a.pdf", True, False)]),
        (2, "", "Ben", None, None, None, None, None, None, None, None, "No", "No", "Yes", None,
         None, None)])
    w = C.insert_medical(med, req, "2025-06-01 09:00:00")
    st = {r.seq: r.status for r in w.status.collect()}
    assert st == {1: "applied", 2: "rejected:missing:studentId"}
    row = w.rows.first()
    base = med.agg(F.max("mr_medical_id")).first()[0]
    assert row.mr_medical_id == base + 1 and row.mr_referral_confirmation == "Pending"
    assert row.mr_record_date == dt.datetime(2025, 6, 1)
    files = spark.createDataFrame([(row.mr_attachments,)], "t string").select(
        F.from_json("t", "array<struct<filename:string,isMedical:boolean,uploadedBy:string,"
                    "uploadDate:string>>").alias("f")).first().f
    assert [(f.filename, f.isMedical, f.uploadedBy) for f in files] == \
        [("OPDMC_a-1.pdf", True, "OPD"), ("OPDMC_b-1.pdf", False, "OPD")]
    notes = sorted((r.n_type, r.n_receiver, r.n_message) for r in w.notifications.collect())
    assert notes[0] == ("OPD Medical Certificate", "INF", 'OPD uploaded file "a.pdf" for Ann (000001)')
    assert len(notes) == 5          # 2 files x (INF, OPD) + 1 referral
    assert ("Referral", "GCO", "New psychological referral for Ann (000001)") in notes


def test_update_medical_flags_only_set(spark):
    from campusledger.sources.tables import SCHEMAS
    old = ('[{"filename":"a","originalname":"A","isMedical":true,"isPsychological":false},'
           '{"filename":"b","originalname":"B","isMedical":false}]')
    med = spark.createDataFrame(
        [(5, "000001", "Ann", "STEM", "11", "S1", "x", "s", "Ongoing", "d", "", "Yes",
          "Accepted", "No", "Yes", old, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), "[]",
          "INF")], SCHEMAS["tbl_medical_records"])
    req = spark.createDataFrame(
        [(1, 5, "000001", "Ann", "flu", "Treated", "d", "No", "Yes", None, old, ["b"],
          [("A", False, True)])],
        "seq long, recordId long, studentId string, studentName string, subject string, "
        "status string, medicalDetails string, isPsychological string, isMedical string, "
        "referredToGCO string, existingAttachments string, filesToDelete array<string>, "
        "fileClassifications array<struct<filename:string,isMedical:boolean,"
        "isPsychological:boolean>>")
    w = C.update_medical(med, req, "2025-06-01 09:00:00")
    row = w.table.first()
    assert row.mr_status == "Treated" and row.mr_referred == "No"
    assert row.mr_referral_confirmation == "Accepted"           # left as it was
    assert row.mr_attachments == ('[{"filename":"a","originalname":"A","isMedical":true,'
                                  '"isPsychological":true}]')
    assert '"editedBy":"INF"' in row.mr_edit_history
    bad = req.withColumn("isMedical", F.lit("No"))
    st = C.update_medical(med, bad, "2025-06-01 09:00:00").status.first().status
    assert st == "rejected:neither_medical_nor_psychological"


def test_lookups_validate_numeric_ids(spark, tables):
    import pytest
    from campusledger.operators import filters as Fl
    with pytest.raises(ValueError):
        Fl.record_by_id(tables["tbl_medical_records"], "medical", "abc")
    ids = spark.createDataFrame([("1",), ("x",)], "cr_case_id string")
    got = Fl.records_by_ids(tables["tbl_case_records"], "case", ids)
    assert [r.cr_case_id for r in got.collect()] == [1]


def test_import_order_across_splits(spark, tmp_dir):
    """Several files keep their order in ``pos``: the earlier row of a duplicate
    key wins even when the copies land in different tasks."""
    folder = os.path.join(tmp_dir, "upload")
    os.makedirs(folder)
    n = 4000
    for part in range(5):
        with open(os.path.join(folder, f"part{part}.csv"), "w") as fh:
            fh.write("ID Number,Student Name,Semester\n")
            for i in range(part * n // 5, (part + 1) * n // 5):
                fh.write(f"{i % 1000},Name {i},2024-2025-1\n")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")     # one task per file
    try:
        raw = read_import_csv(spark, folder)
        assert raw.rdd.getNumPartitions() > 4
        empty = spark.createDataFrame([], SCHEMAS["tbl_student_data"])
        res = IM.import_students(empty, IM.map_csv_rows(raw))
        names = sorted((int(r.sd_id_number), r.sd_student_name) for r in res.inserted.collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert names == [(i, f"Name {i}") for i in range(1000)]
    assert res.summary.first().duplicates_found == n - 1000


def test_search_wildcards(spark):
    from campusledger.operators import filters as Fl
    rows = []
    for i, name in enumerate(["50% off", "50X off", "a_b", "axb", "back\\slash"], start=1):
        rows.append((i, "000001", name, "STEM", "11", "S1", "x", "Minor", "Ongoing",
                     dt.datetime(2024, 1, 1), "No", None, "d", "", None,
                     dt.datetime(2024, 1, 1), "[]", "OPD"))
    cases = spark.createDataFrame(rows, SCHEMAS["tbl_case_records"])
    # unescaped: '%' and '_' stay wildcards
    assert Fl.case_search(cases, "50%").count() == 2
    assert Fl.case_search(cases, "a_b").count() == 2
    med_rows = [(i, "000001", name, "STEM", "11", "S1", "x", "s", "Ongoing", "d", "", "No",
                 "Pending", "No", "Yes", None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1),
                 "[]", "INF") for i, name in enumerate(["50% off", "50X off", "a_b", "axb"], 1)]
    med = spark.createDataFrame(med_rows, SCHEMAS["tbl_medical_records"])
    # escaped in the medical search: they match literally
    assert [r.mr_student_name for r in Fl.medical_search(med, "50%").collect()] == ["50% off"]
    assert [r.mr_student_name for r in Fl.medical_search(med, "a_b").collect()] == ["a_b"]
    import pytest
    with pytest.raises(ValueError):
        Fl.medical_search(med, "   ")


def test_confirm_medical_condition(spark):
    rows = []
    for mid, psych in [(1, "Yes"), (2, "No"), (3, "YES")]:
        rows.append((mid, "000001", "Ann", "STEM", "11", "S1", None, "s", "Ongoing", "d", "",
                     "Yes", "Pending", psych, "Yes", None, dt.datetime(2024, 1, 1),
                     dt.datetime(2024, 1, 1), "[]", "INF"))
    med = spark.createDataFrame(rows, SCHEMAS["tbl_medical_records"])
    req = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    res = R.confirm_medical_referrals(med, req)
    got = {r.cor_origin_medical_id: r.cor_is_psychological_condition
           for r in res.counseling.collect()}
    assert got == {1: "YES", 2: "NO", 3: "NO"}     # exact 'Yes' only
    assert {r.n_receiver for r in res.notifications.collect()} == {"INF"}


def test_sequence_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000).selectExpr("id * 7 % 5000 AS k")
    out = C.sequence_ids(df, ["k"], F.lit(100), "new_id", partitions=6)
    rows = sorted((r.k, r.new_id) for r in out.collect())
    assert rows == [(k, 101 + k) for k in range(5000)]


def test_batch_jobs_publish_together(spark, tables, tmp_dir):
    from campusledger.plans import jobs
    from campusledger.sources.snapshots import read_batch_table
    root = os.path.join(tmp_dir, "published")
    jobs.publish_tables({k: tables[k] for k in ("tbl_case_records", "tbl_medical_records",
                                                "tbl_counseling_records", "tbl_notifications")},
                        root)
    cases = read_batch_table(spark, root, "tbl_case_records")
    pending = cases.where("cr_referral_confirmation = 'Pending'").select(
        F.col("cr_case_id").alias("record_id"))
    n_pending = pending.count()
    before_sessions = tables["tbl_counseling_records"].count()
    before_notes = tables["tbl_notifications"].count()
    jobs.run_referral_confirmations(spark, root, pending, None, "2025-06-01 09:00:00")
    sessions = read_batch_table(spark, root, "tbl_counseling_records")
    notes = read_batch_table(spark, root, "tbl_notifications")
    assert sessions.count() == before_sessions + n_pending
    assert sessions.select("cor_record_id").distinct().count() == sessions.count()
    assert notes.count() == before_notes + n_pending
    assert notes.select("n_id").distinct().count() == notes.count()
    assert read_batch_table(spark, root, "tbl_case_records") \
        .where("cr_referral_confirmation = 'Pending'").count() == 0


def test_bad_request_text_does_not_fail_the_batch(spark, tables):
    """Under ANSI casts, one malformed request value must not fail the job."""
    c = tables["tbl_counseling_records"]
    req = spark.createDataFrame(
        [(1, "S1", "Ann", "STEM", "11", "S1", "two", "TO SCHEDULE", "c", "not a date", "x1")],
        "seq long, studentId string, studentName string, strand string, gradeLevel string, "
        "section string, sessionNumber string, status string, concern string, date string, "
        "originCaseId string")
    row = C.insert_counseling(c, req, "2025-06-01 09:00:00").rows.first()
    assert row.cor_session_number is None and row.cor_date is None
    assert row.cor_origin_case_id is None


def test_medical_kind_argument_is_exact_case(spark, tables):
    from campusledger.operators import filters as Fl
    med = tables["tbl_medical_records"]
    assert Fl.medical_condition("medical") is None          # lower-case kind: no filter
    assert Fl.medical_condition_filter(med, "medical").count() == med.count()
    assert Fl.medical_condition_filter(med, "MEDICAL").count() < med.count()


def test_case_update_keep_missing(spark):
    cases = _case_rows(spark, [(1, "No", None, "x")]).withColumn(
        "cr_attachments", F.lit('[{"filename":"k.pdf"}]'))
    req = spark.createDataFrame(
        [(1, 1, "000001", "Ann", "Resolved", "No")],
        "seq long, caseId long, studentId string, studentName string, status string, "
        "referredToGCO string")
    cleared = C.update_cases(cases, req, "2025-06-01 09:00:00").table.first()
    kept = C.update_cases(cases, req, "2025-06-01 09:00:00", keep_missing=True).table.first()
    assert cleared.cr_attachments is None           # the screens' behaviour: no list sent
    assert kept.cr_attachments == '[{"filename":"k.pdf"}]'
    assert cleared.cr_status == "Resolved" and cleared.cr_referral_confirmation is None


def test_case_and_inbox_jobs(spark, tables, tmp_dir):
    from campusledger.plans import jobs
    from campusledger.sources.snapshots import read_batch_table
    root = os.path.join(tmp_dir, "pub2")
    jobs.publish_tables({k: tables[k] for k in ("tbl_case_records", "tbl_notifications",
                                                "tbl_student_data")}, root)
    n_cases = tables["tbl_case_records"].count()
    n_notes = tables["tbl_notifications"].count()
    inserts = spark.createDataFrame(
        [(1, "000001", "Ann", "STEM", "11", "S1", "2025-2026-1", "Minor", "Ongoing", "d", "",
          "Yes"),
         (2, "000002", "Ben", "ABM", "12", "S2", "2025-2026-1", "Major", "Ongoing", "d", "",
          "No")],
        "seq long, studentId string, studentName string, strand string, gradeLevel string, "
        "section string, schoolYearSemester string, violationLevel string, status string, "
        "description string, remarks string, referredToGCO string")
    jobs.run_case_changes(spark, root, inserts, None, "2025-06-01 09:00:00")
    cases = read_batch_table(spark, root, "tbl_case_records")
    notes = read_batch_table(spark, root, "tbl_notifications")
    assert cases.count() == n_cases + 2
    assert notes.count() == n_notes + 1                    # one referral notice
    assert notes.select("n_id").distinct().count() == notes.count()
    assert read_batch_table(spark, root, "case_insert_status").count() == 2
    jobs.run_mark_all_read(spark, root, "GCO")
    unread = read_batch_table(spark, root, "tbl_notifications") \
        .where("lower(n_receiver) = 'gco' AND lower(n_is_read) = 'no'").count()
    assert unread == 0
    mapped = IM.map_csv_rows(spark.createDataFrame(
        [(1, "900001", "New Kid", "2025-2026-1"), (2, "900001", "Again", "2025-2026-1")],
        "pos long, `ID Number` string, `Student Name` string, Semester string"))
    jobs.run_student_import(spark, root, mapped)
    summary = read_batch_table(spark, root, "import_summary").first()
    assert (summary.successful_imports, summary.duplicates_found) == (1, 1)
    assert read_batch_table(spark, root, "tbl_student_data") \
        .where("sd_id_number = '900001'").count() == 1


def test_validation_split(spark):
    from campusledger.operators import validation as V
    req = spark.createDataFrame(
        [(1, "S1", "Ann", "Yes", "No"), (2, "", "Ben", "No", "No"), (3, "S3", None, "Yes", "Yes")],
        "seq long, studentId string, studentName string, isMedical string, "
        "isPsychological string")
    reasons = F.concat(V.required_fields(req, "medical_insert"),
                       V.reasons((~V.condition_consistency(), "neither")))
    valid, rejected = V.split(req, reasons)
    assert [r.seq for r in valid.collect()] == [1]
    got = {r.seq: list(r.reasons) for r in rejected.collect()}
    assert got == {2: ["studentId", "neither"], 3: ["studentName"]}
