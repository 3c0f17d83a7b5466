"""Edge fixtures: comparison rules, casts, JSON, ties and dates."""

import datetime as dt
import json

from pyspark.sql import functions as F

from campusledger.functions import semantics as S
from campusledger.functions.dates import parse_import_date
from campusledger.functions.jsoncols import has_medical_file
from campusledger.operators import attachments as A, kpis, summaries
from campusledger.sources.tables import SCHEMAS


def _one(df):
    return [tuple(r) for r in df.collect()]


def test_unsigned_cast(spark):
    df = spark.createDataFrame([("2nd",), ("bad",), (" 12x",), (None,), ("10",)], "v string")
    got = [r[0] for r in df.select(S.unsigned("v")).collect()]
    assert got == [2, 0, 12, 0, 10]


def test_case_rules(spark):
    df = spark.createDataFrame([("Yes",), ("YES",), ("yes",), ("No",)], "v string")
    assert df.where(S.ci_eq("v", "Yes")).count() == 3
    assert df.where(F.col("v") == "Yes").count() == 1          # application-side rule
    assert S.escape_like("50%_a\\b") == "50\\%\\_a\\\\b"


def test_first_present(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.first_present("a", "b")).collect()] == ["b", "b", "a", ""]


def _students(spark, rows):
    full = []
    for sid, sem in rows:
        full.append((sid, "N" + sid, "STEM", "11", "S1", "M", "R", "P", "Active",
                     dt.date(2008, 1, 1), 0, sem))
    return spark.createDataFrame(full, SCHEMAS["tbl_student_data"])


def test_latest_semester_ties_and_text_max(spark):
    st = _students(spark, [("100001", "2024-2025-2"), ("100001", "2024-2025-2"),
                           ("100002", "2024-2025-10"), ("100002", "2024-2025-2"),
                           ("100003", None), ("100004", "2024-2025-2nd"),
                           ("100004", "2024-2025-2")])
    out = summaries.latest_semester_per_student(st, "1000", limit=None)
    got = sorted((r.sd_id_number, r.sd_school_year_semesterr) for r in out.collect())
    # ties kept, NULL semester dropped, text max ('2024-2' > '2024-10'), '2nd' ties with '2'
    assert got == [("100001", "2024-2025-2"), ("100001", "2024-2025-2"),
                   ("100002", "2024-2025-2"), ("100004", "2024-2025-2"),
                   ("100004", "2024-2025-2nd")]
    num = summaries.latest_semester_per_student(st, "100002", limit=None, numeric=True)
    assert [r.sd_school_year_semesterr for r in num.collect()] == ["2024-2025-10"]


def test_prefix_search_needs_three_chars(spark):
    st = _students(spark, [("100001", "2024-2025-1"), ("100001", "2024-2025-2"),
                           ("100001", "2023-2024-2")])
    assert summaries.student_prefix_search(st, "10").count() == 0
    got = [r.sd_school_year_semesterr for r in summaries.student_prefix_search(st, "100").collect()]
    assert got == ["2024-2025-2", "2024-2025-1", "2023-2024-2"]


def test_certificate_json_edges(spark):
    texts = [None, "", "null", "[]", "{}", '{"isMedical":true}', "oops",
             '[{"isMedical":"true"}]', '[{"a":1},{"isMedical":true}]', '[{"isMedical":false}]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(has_medical_file("t")).collect()]
    assert got == [False, False, False, False, False, True, False, False, True, False]


def _medical_rows(spark, specs):
    rows = []
    for i, (att, is_med) in enumerate(specs, start=1):
        rows.append((i, "000001", "N", "STEM", "11", "S1", "2024-2025-1", "s", "Ongoing", "d", "",
                     "No", "Pending", "No", is_med, att,
                     dt.datetime(2024, 1, i), dt.datetime(2024, 1, i), "[]", "INF"))
    return spark.createDataFrame(rows, SCHEMAS["tbl_medical_records"])


def test_attachment_files_edges(spark):
    med = _medical_rows(spark, [
        ('{"filename":"x.pdf"}', "Yes"),                     # object: skipped
        ("null", "Yes"), ("[]", "Yes"), ("oops", "Yes"), ("", "Yes"),
        ('[{"filename":"a.pdf","originalname":"","size":1}]', "YES"),
        ('[{"filename":"b.pdf","originalname":"B.pdf","uploadedBy":"OPD",'
         '"uploadDate":"2024-05-05T00:00:00.000Z","isMedical":true}]', "No"),
    ])
    files = A.attachment_files(med).collect()
    assert len(files) == 2
    by_name = {f.storedFileName: f for f in files}
    a = by_name["a.pdf"]
    assert a.fileName == "a.pdf" and a.uploadedBy == "Unknown"
    assert a.uploadDate == "2024-01-06T00:00:00.000Z"
    assert a.isMedical is False                    # record flag 'YES' is not exactly 'Yes'
    assert a.fileId == "6-file-0-" + str(int(dt.datetime(2024, 1, 6, tzinfo=dt.timezone.utc)
                                              .timestamp() * 1000))
    b = by_name["b.pdf"]
    assert (b.fileName, b.uploadedBy, b.isMedical) == ("B.pdf", "OPD", True)
    counts = A.attachment_file_counts(A.attachment_files(med, ordered=False), "MEDICAL").first()
    assert (counts.totalCount, counts.filteredCount) == (2, 1)


def _cases(spark, rows):
    out = []
    for cid, sid, status, day in rows:
        out.append((cid, sid, "N" + sid, "STEM", "11", "S1", "2024-2025-1", "Minor", status,
                    dt.datetime(2024, 1, day) if day else None, "No", None, "d", "", None,
                    dt.datetime(2024, 1, 1), "[]", "OPD"))
    return spark.createDataFrame(out, SCHEMAS["tbl_case_records"])


def test_status_ties_and_nulls(spark):
    st = _students(spark, [("000001", "2024-2025-1"), ("000001", "2024-2025-2")])
    cases = _cases(spark, [(1, "000001", "Resolved", 5), (2, "000001", "Ongoing", 5),
                           (3, "000001", "a,b", 3), (4, "000001", None, 9),
                           (5, "000001", "ONGOING", 1)])
    row = summaries.student_case_summary(st, cases).first()
    assert row.caseCount == 5                       # the NULL-status case is counted
    # one entry per status ignoring case, spelled as its newest record; same
    # latest date: the status whose newest record id is higher comes first
    assert row.statuses == "ONGOING,Resolved,a,b"
    assert row.latestStatus == "ONGOING"            # not split on the comma
    assert row.allSemesters == "2024-2025-1"
    assert row.latestCaseDate == "2024-01-09T00:00:00.000Z"


def test_monthly_edges(spark):
    days = [dt.datetime(2024, 2, 28), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 15),
            dt.datetime(2024, 8, 31), None]
    rows = [(i, "000001", "N", "STEM", "11" if i % 2 else "12", "S1", "x", "Minor", "Ongoing",
             d, "No", None, "d", "", None, dt.datetime(2024, 1, 1), "[]", "OPD")
            for i, d in enumerate(days)]
    cases = spark.createDataFrame(rows, SCHEMAS["tbl_case_records"])
    got = [tuple(r) for r in kpis.monthly_cases_by_grade(cases, "2024-08-31 00:00:00").collect()]
    # Aug 31 - 6 months = Feb 29: Feb 28 is out, Feb 29 is in; months without rows are absent
    assert got == [("Aug 2024", 1, 0), ("Mar 2024", 0, 1), ("Feb 2024", 1, 0)]


def test_empty_tables_give_zero(spark):
    from campusledger.sources.tables import empty_table
    for fn, name in [(kpis.case_totals, "tbl_case_records"),
                     (kpis.counseling_totals, "tbl_counseling_records"),
                     (kpis.medical_totals, "tbl_medical_records"),
                     (kpis.user_totals, "users"),
                     (kpis.certificate_totals, "tbl_medical_records")]:
        row = fn(empty_table(spark, name)).first()
        assert all(v == 0 for v in row), (name, row)
    inbox = kpis.unread_counts(empty_table(spark, "tbl_notifications"), "GCO").collect()
    assert [(r.n_type, r.is_total, r["count"], r.opd_certificate_count) for r in inbox] == \
        [(None, True, 0, 0)]


def test_import_dates(spark):
    df = spark.createDataFrame([("2024-03-05",), ("3/5/2024",), ("Mar 5, 2024",),
                                ("2024-03-05T10:00:00.000Z",), ("2024-13-45",), ("junk",),
                                ("",), (None,), ("45000",)], "v string")
    got = [r[0] for r in df.select(parse_import_date("v", sheet_numbers=True)).collect()]
    d = dt.date
    assert got == [d(2024, 3, 5), d(2024, 3, 5), d(2024, 3, 5), d(2024, 3, 5), d(2025, 2, 14),
                   None, None, None, d(2023, 3, 15)]


def test_merge_attachments_modes(spark):
    old = '[{"filename":"a","originalname":"A","isMedical":true},{"filename":"b","originalname":"B"}]'
    df = spark.createDataFrame(
        [(old, ["a"], [("n", "N", "application/pdf", 5, "/p")],
          [("B", True, False)])],
        "ex string, del array<string>, new array<struct<filename:string,originalname:string,"
        "mimetype:string,size:bigint,path:string>>, cls array<struct<filename:string,"
        "isMedical:boolean,isPsychological:boolean>>")

    def names(mode, **kw):
        col = A.merge_attachments(F.col("ex"), F.col("del"), F.col("new"), mode, **kw)
        return [json.loads(f)["filename"] for f in df.select(col.alias("m")).first().m]

    assert names("case_update") == ["n"]                 # new files replace everything
    assert names("case_insert") == ["b", "n"]
    assert names("counseling_update") == ["b", "n"]
    merged = df.select(A.merge_attachments(F.col("ex"), F.col("del"), F.col("new"),
                                           "medical_update", classes=F.col("cls"),
                                           uploader=F.lit("OPD"),
                                           upload_date=F.lit("2024-01-01")).alias("m")).first().m
    assert [(f["filename"], f["isMedical"], f.get("uploadedBy")) for f in map(json.loads, merged)] == \
        [("b", True, None), ("n", False, "OPD")]


def test_edit_history_json(spark):
    df = spark.createDataFrame([(None,), ("[]",), ('[{"editedBy":"GCO","editedAt":"x","timestamp":1}]',)],
                               "h string")
    out = [r[0] for r in df.select(A.append_edit_history(
        F.col("h"), F.array(F.lit("OPD")), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))).collect()]
    entry = '{"editedBy":"OPD","editedAt":"2024-01-02T03:04:05.000Z","timestamp":1704164645000}'
    assert out == [f"[{entry}]", f"[{entry}]",
                   f'[{{"editedBy":"GCO","editedAt":"x","timestamp":1}},{entry}]']


def test_stored_names_and_checks(spark):
    df = spark.createDataFrame([("my report.v2.pdf", 7)], "n string, c int")
    row = df.select(A.stored_file_name(F.col("n"), F.lit("123-9"), F.lit("OPD")).alias("a"),
                    A.case_file_name(F.col("c"), F.lit(99), F.col("n")).alias("b")).first()
    assert row.a == "OPDMC_my report.v2-123-9.pdf"
    assert row.b == "7_99_my_report.v2.pdf"
    files = spark.createDataFrame(
        [([("a.pdf", "a.pdf", "application/pdf", 1, "p")],),
         ([("a.exe", "a.exe", "application/x", 11 * 1024 * 1024, "p")],)],
        "f array<struct<filename:string,originalname:string,mimetype:string,size:bigint,"
        "path:string>>")
    got = [r[0] for r in files.select(A.attachment_checks(F.col("f"))).collect()]
    assert got == [[], ["file_type", "file_size"]]


def test_summary_with_one_hot_student(spark, tables):
    """One student holds a third of all case rows: counts stay exact and the
    records are aggregated map-side before any shuffle (partial aggregate)."""
    cases, students = tables["tbl_case_records"], tables["tbl_student_data"]
    hot = (cases
           .withColumn("cr_case_id", F.col("cr_case_id") + F.lit(10 ** 9))
           .withColumn("cr_student_id", F.lit("000001")))
    skewed = cases.unionByName(hot)
    total = skewed.count()
    hot_rows = skewed.where(F.col("cr_student_id") == "000001").count()
    assert hot_rows * 3 >= total
    out = summaries.student_case_summary(students, skewed)
    got = {r.caseCount for r in out.where(F.col("id") == "000001").collect()}
    assert got == {hot_rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_unordered_summary_has_same_rows(spark, tables):
    st, cases = tables["tbl_student_data"], tables["tbl_case_records"]
    a = summaries.student_summary(st, cases, summaries.CASES)
    b = summaries.student_summary(st, cases, summaries.CASES, ordered=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert "rangepartitioning" not in b._jdf.queryExecution().executedPlan().toString()
