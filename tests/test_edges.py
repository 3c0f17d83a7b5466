"""Inputs, orders, pushdown and small answers at their edges."""

import datetime as dt
import os

import duckdb
import pytest
from data_paths import SF_SMALL
from pyspark.sql import functions as F

from campusledger.functions.dates import parse_import_date, unparsed
from campusledger.functions.semantics import exact_id
from campusledger.operators import attachments as A
from campusledger.operators import changes as C
from campusledger.operators import filters as Fl
from campusledger.operators import imports as IM
from campusledger.operators import inbox as I
from campusledger.operators import summaries as S
from campusledger.plans import QUERIES, load_all
from campusledger.plans import jobs
from campusledger.sources import snapshots
from campusledger.sources.files import read_import_csv
from campusledger.sources.tables import FIXTURE_SQL, SCHEMAS, render

load_all()


def test_padding_never_cuts(spark):
    sql = render("SELECT {pad:v:6} AS p FROM (VALUES (7), (1000000), (1000009)) AS t(v)", {}, "timestamp")
    assert [r[0] for r in spark.sql(sql).collect()] == ["000007", "1000000", "1000009"]
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == ["000007", "1000000", "1000009"]


@pytest.mark.parametrize("table, key, source", [
    ("tbl_case_records", "cr_case_id", "orders"), ("tbl_medical_records", "mr_medical_id", "orders"),
    ("tbl_counseling_records", "cor_record_id", None), ("tbl_notifications", "n_id", None), ("users", "u_email", "supplier")])
def test_one_record_per_source_row(spark, tables, table, key, source):
    row = tables[table].agg(F.count("*"), F.countDistinct(key)).first()
    assert row[0] == row[1]
    if source:
        assert row[0] == spark.read.parquet(f"{SF_SMALL}/{source}.parquet").count()


def test_inputs_neither_aggregate_nor_nest_loops(tables):
    for name in FIXTURE_SQL:
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "NestedLoop" not in plan


# ---- orders (O36, O37) -----------------------------------------------------------------

BY_ID = {"case_records": "caseNo", "case_level_filter": "caseNo", "referred_cases": "caseNo", "case_search": "caseNo",
         "counseling_records": "recordId", "psychological_counseling": "recordId", "counseling_search": "recordId"}


@pytest.mark.parametrize("name", sorted(n for n in BY_ID if n in QUERIES))
def test_lists_come_by_id_newest_first(spark, name):
    ids = [r[BY_ID[name]] for r in QUERIES[name](spark, SF_SMALL).collect()]
    assert ids == sorted(ids, reverse=True)


@pytest.mark.parametrize("name", [n for n in ("medical_records", "referred_medical", "medical_search") if n in QUERIES])
def test_medical_lists_come_by_date_then_id(spark, tables, name):
    dates = {r["mr_medical_id"]: r["mr_record_date"] for r in tables["tbl_medical_records"].collect()}
    ids = [r["recordId"] for r in QUERIES[name](spark, SF_SMALL).collect()]
    assert ids == sorted(ids, key=lambda i: (dates[i], i), reverse=True)


# ---- pushdown (O14-O17, O34, O45-O47) ------------------------------------------------------

def test_equality_reaches_the_scan(spark, tables, tmp_dir):
    stored = {}
    for name in ("tbl_case_records", "tbl_notifications", "users"):
        path = os.path.join(tmp_dir, name)
        tables[name].write.parquet(path)
        stored[name] = spark.read.parquet(path)

    def pushed(df):
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return " ".join(x for x in text.split("\n") if "PushedFilters" in x)
    assert "EqualTo(cr_student_id,000010)" in pushed(Fl.records_by_student(stored["tbl_case_records"], "case", "000010"))
    assert "GreaterThanOrEqual(cr_referred,YES)" in pushed(Fl.referred_cases(stored["tbl_case_records"]))
    assert "LessThanOrEqual(u_status,active)" in pushed(Fl.active_users(stored["users"]))
    assert "GreaterThanOrEqual(n_receiver,OPD)" in pushed(I.notification_inbox(stored["tbl_notifications"], "opd"))


def test_equality_in_every_spelling(spark):
    df = spark.createDataFrame([(x,) for x in ("YES", "Yes", "yES", "yes", "Yess", "ye", "no", None, "ÿes")], "x string")
    from campusledger.functions.semantics import ci_eq
    assert [r[0] for r in df.where(ci_eq("x", "Yes")).collect()] == ["YES", "Yes", "yES", "yes"]


# ---- ids (O17a, O70) -------------------------------------------------------------------------

def test_exact_ids(spark):
    texts = ["12", " 12 ", "12.0", "12.7", "9007199254740993", "x", "", None, "-3", "1e1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(exact_id("t")).collect()] == [12, 12, 12, None, 9007199254740993, None, None, None, -3, 10]


def test_student_without_any_semester_is_found(spark):
    s = spark.createDataFrame([("ab1", "Ann", "S", "11", "A", "F", "R", "P", "Active", None, 0, None)],
                              SCHEMAS["tbl_student_data"])
    assert Fl.record_by_id(s, "student", "AB1").count() == 1


def test_flag_lists_merge_spellings(spark):
    when = dt.datetime(2024, 1, 1)
    students = spark.createDataFrame([("ab1", "Ann", "S", "11", "A", "F", "R", "P", "Active", None, 0, "2024-2025-1")],
                                     SCHEMAS["tbl_student_data"])
    rows = [(i, sid, "Ann", "S", "11", "A", "2024-2025-1", "s", "Ongoing", "d", "", "No", "Pending", flag, "Yes", None, when,
             when, "[]", "INF") for i, (sid, flag) in enumerate([("AB1", "YES"), ("Ab1", "Yes"), ("ab1", "No")])]
    med = spark.createDataFrame(rows, SCHEMAS["tbl_medical_records"])
    out = S.student_medical_summary(students, med).collect()
    assert [(r["id"], r["medicalCount"], r["hasPsychological"]) for r in out] == [("ab1", 3, "No,YES")]


# ---- imports (O3, O63, O65) ----------------------------------------------------------------------

def test_date_forms(spark):
    want = {"2005/03/04": "2005-03-04", "2005-3-4": "2005-03-04", "Mar 4 2005": "2005-03-04", "4 March 2005": "2005-03-04",
            "12/31/05": "2005-12-31", "1-2-99": "1999-01-02", "March 4, 2005": "2005-03-04", "2024-13-45": "2025-02-14",
            "2004": "2004-01-01", "soon": None, "": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    d = parse_import_date("t", sheet_numbers=True)
    got = {r[0]: (str(r[1]) if r[1] else None, r[2]) for r in df.select("t", d, unparsed("t", d)).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert [k for k, v in got.items() if v[1]] == ["soon"]
    marked = df.select(parse_import_date(F.lit("2004"), True, F.lit(True))).first()[0]
    assert str(marked) == "1905-06-26"


def test_quoted_cells(spark, tmp_dir):
    path = os.path.join(tmp_dir, "q.csv")
    with open(path, "w") as fh:
        fh.write('ID Number,Student Name,Section,Status,Status\n1,"Juan ""JJ"", Cruz","A\nB",x,\n2,Ann,C,y,Inactive\n')
    raw = read_import_csv(spark, path)
    assert raw.count() == 2
    got = raw.collect()
    assert got[0]["Student Name"] == 'Juan "JJ", Cruz' and got[0]["Section"] == "A\nB"
    # of two equal headers the last one counts; a blank cell there is the default
    assert {r["id"]: r["status"] for r in IM.map_csv_rows(raw).collect()} == {"1": "Active", "2": "Inactive"}


def test_failed_rows_are_named_and_blank_status_defaults(spark):
    cells = spark.createDataFrame([("1", ["7", "Ann", "soon", " "]), ("2", ["8", "Ben", "2005-01-02", ""]),
                                   ("3", ["8", "Ben", "never", ""])], "pos string, cells array<string>")
    mapped = IM.map_sheet_cells(cells, ["ID", "Name", "Birthdate", "Status"])
    res = IM.import_students(spark.createDataFrame([], SCHEMAS["tbl_student_data"]), mapped)
    s = res.summary.first()
    assert (s.total_records, s.successful_imports, s.failed_imports, s.duplicates_found) == (3, 1, 1, 1)
    assert [r.sd_status for r in res.inserted.collect()] == ["Active"]
    assert [r.message[:9] for r in res.messages.collect()] == ["Failed: 7", "Duplicate"]


# ---- small answers -----------------------------------------------------------------------------------

def test_upload_without_type_is_refused(spark):
    df = spark.sql("SELECT array(named_struct('filename','a','originalname','a.exe','mimetype',CAST(NULL AS STRING),"
                   "'size',1L,'path','/a')) AS f")
    assert df.select(A.attachment_checks(F.col("f"))).first()[0] == ["file_type"]


def test_session_files_store_five_fields(spark, tables):
    req = spark.sql("SELECT 1 AS seq, '1' AS studentId, 'A' AS studentName, 'S' AS strand, '11' AS gradeLevel, 'x' AS section,"
                    " '1' AS sessionNumber, 'DONE' AS status, 'c' AS concern, array(named_struct('filename','f.pdf',"
                    "'originalname','o.pdf','mimetype','application/pdf','size',3L,'path','/f')) AS newFiles")
    row = C.insert_counseling(tables["tbl_counseling_records"], req, "2025-06-01 09:00:00").rows.first()
    assert row.cor_attachments == ('[{"filename":"f.pdf","originalname":"o.pdf","mimetype":"application/pdf","size":3,'
                                   '"path":"/f"}]')


def test_account_without_status_can_be_deleted(spark):
    users = spark.createDataFrame([("a@x", "a", "A", "OPD", None, None, None, None),
                                   ("b@x", "b", "B", "OPD", "Staff", "Active", None, None)], SCHEMAS["users"])
    req = spark.createDataFrame([(1, "A@x"), (2, "b@x"), (3, "c@x")], "seq long, email string")
    got = {r.seq: r.status for r in C.delete_users(users, req).status.collect()}
    assert got == {1: "applied", 2: "rejected:active_user", 3: "not_found"}


def test_jobs_publish_every_table(spark, tables, tmp_dir):
    jobs.publish_tables({n: tables[n].limit(20) if n != "users" else tables[n] for n in FIXTURE_SQL}, tmp_dir)
    cases = snapshots.read_batch_table(spark, tmp_dir, "tbl_case_records")
    req = cases.limit(3).select(F.col("cr_case_id").alias("seq"), F.col("cr_case_id").alias("caseId"),
                                F.lit("Yes").alias("referredToGCO"), F.lit("1").alias("studentId"))
    jobs.run_case_changes(spark, tmp_dir, updates=req)
    ids = spark.createDataFrame([(1, "nobody@x")], "seq long, email string")
    out = jobs.run_user_changes(spark, tmp_dir, deactivations=ids, deletes=ids)
    assert {"user_deactivate_status", "user_delete_status", "users"} <= set(out)
    assert jobs.run_counseling_changes(spark, tmp_dir) == {}
    new = snapshots.read_batch_table(spark, tmp_dir, "tbl_notifications")
    assert new.where("n_type = 'Referral' AND n_is_read = 'No'").where(F.col("n_related_record_id").isin(
        [r.seq for r in req.collect()])).count() >= 3
    assert new.select("n_created_at").distinct().count() >= 1


def test_two_writers_keep_both_entries(spark, tmp_dir):
    df = spark.range(3)
    snapshots.write_batch({"a": df}, tmp_dir)
    snapshots.write_batch({"b": df}, tmp_dir)
    assert set(snapshots.current_manifest(spark, tmp_dir)) == {"a", "b"}
    assert snapshots.current_manifest(spark, os.path.join(tmp_dir, "none")) == {}
