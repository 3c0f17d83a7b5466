"""Clustered tables: small changes, point look-ups, and searches through trigrams."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from campusledger.operators import changes as C
from campusledger.operators import filters as Fl
from campusledger.operators import inbox as I
from campusledger.operators import text_search as X
from campusledger.sources import clustered as K

AS_OF = "2025-06-01 09:00:00"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_part=*/*.parquet")}


def part(path):
    return int(path.split("_part=")[1].split("/")[0])


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def scan_rows(df, at_least=0):
    """Rows and files the parquet scans of ``df`` gave out when it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    metrics = []

    def walk(p):
        if p.nodeName().startswith("Scan parquet"):
            m = p.metrics()
            metrics.append((m.apply("numOutputRows").value(), m.apply("numFiles").value()))
        if p.nodeName() == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        elif hasattr(p, "plan") and p.nodeName().endswith("QueryStage"):
            walk(p.plan())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    assert metrics, text
    return metrics


@pytest.fixture(scope="module")
def cases(spark, tables):
    return spark.createDataFrame(tables["tbl_case_records"].collect(), tables["tbl_case_records"].schema)


LAYOUT = K.Layout("cr_case_id", 100, lookups=("cr_student_id",))


def test_round_trip(spark, tables, tmp_dir):
    for name, layout in K.LAYOUTS.items():
        table = tables[name]
        K.write_clustered(table, f"{tmp_dir}/{name}", layout._replace(size=64))
        back = K.read_clustered(spark, f"{tmp_dir}/{name}")
        assert set(back.columns) == set(table.columns) and rows(back) == rows(table)


def test_update_rewrites_the_touched_parts_only(spark, cases, tmp_dir):
    path = f"{tmp_dir}/t"
    K.write_clustered(cases, path, LAYOUT)
    before = files(path)
    picked = cases.where(F.col("cr_case_id").isin(5, 17, 310))
    req = picked.select(F.col("cr_case_id").alias("seq"), F.col("cr_case_id").alias("caseId"), F.lit("Resolved").alias("status"),
                        F.lit("9").alias("studentId")).unionByName(
        spark.createDataFrame([(10 ** 6, 10 ** 9, "x", "y")], "seq long, caseId long, status string, studentId string"))
    w = K.change_parts(spark, path, LAYOUT, req, "caseId", lambda t, r: C.update_cases(t, r, AS_OF))
    whole = C.update_cases(cases, req, AS_OF)
    assert rows(w.table) == rows(whole.table) and rows(w.status) == rows(whole.status)
    assert rows(w.notifications) == rows(whole.notifications) and rows(w.rows) == rows(whole.rows)
    after = files(path)
    assert {f for f in before if part(f) not in (0, 3)} == {f for f in after if part(f) not in (0, 3)}
    assert all(after[f] == before[f] for f in after if part(f) not in (0, 3))
    assert not {f for f in before if part(f) in (0, 3)} & set(after)


def test_deletes_empty_parts_and_insert_adds_files(spark, tables, tmp_dir):
    path, layout = f"{tmp_dir}/s", K.LAYOUTS["tbl_student_data"]._replace(size=16)
    students = tables["tbl_student_data"]
    K.write_clustered(students, path, layout)
    before = files(path)
    doomed = students.select(F.col("sd_id_number").alias("id"), K.part_of(layout, F.col("sd_id_number")).alias("p"))
    first = doomed.agg(F.min("p")).first()[0]
    ids = doomed.where(F.col("p") == first).select("id").distinct().withColumn("seq", F.xxhash64("id"))
    w = K.change_parts(spark, path, layout, ids.withColumn("id", F.upper("id")), "id", C.delete_students)
    assert rows(w.table) == rows(C.delete_students(students, ids).table) and w.table.count() < students.count()
    assert {f: t for f, t in files(path).items() if part(f) != first} == {f: t for f, t in before.items() if part(f) != first}
    gone = students.join(ids.select(F.col("id").alias("sd_id_number")), "sd_id_number", "left_semi").select(students.columns)
    kept = files(path)
    K.insert_rows(gone, path, layout)
    assert rows(K.read_clustered(spark, path)) == rows(students)
    assert all(files(path)[f] == t for f, t in kept.items())


def test_mark_read(spark, tables, tmp_dir):
    path, layout = f"{tmp_dir}/n", K.Layout("n_id", 500)
    notes = tables["tbl_notifications"]
    K.write_clustered(notes, path, layout)
    req = notes.where("n_is_read = 'No'").orderBy("n_id").limit(3).select("n_id")
    want = I.mark_read(notes, req)
    got = K.change_parts(spark, path, layout, req, "n_id", lambda t, r: C.Written(
        I.mark_read(t, r).table, t.limit(0), I.mark_read(t, r).status))
    assert rows(got.table) == rows(want.table) and rows(got.status) == rows(want.status)


def test_lookups_read_little(spark, cases, tmp_dir):
    """One student's rows: by the table by student from one part, by record id through row groups."""
    big = cases.unionByName(cases.withColumns({"cr_student_id": F.concat(F.lit("Ab"), "cr_student_id"),
                                               "cr_case_id": F.col("cr_case_id") + 10 ** 6}))
    by_student, by_id = f"{tmp_dir}/bs", f"{tmp_dir}/bi"
    layout = K.BY_STUDENT["tbl_case_records"]._replace(size=32)
    K.write_clustered(big, by_student, layout)
    K.write_clustered(big, by_id, LAYOUT._replace(size=200))
    student = big.where(F.col("cr_student_id").startswith("Ab")).agg(F.min("cr_student_id")).first()[0]
    want = rows(big.where(F.col("cr_student_id") == student))
    for path, lay, one_part in ((by_student, layout, True), (by_id, LAYOUT._replace(size=200), False)):
        got = K.rows_of(spark, path, lay, "cr_student_id", student.upper())
        assert rows(got) == want and want
        df = K.rows_of(spark, path, lay, "cr_student_id", student.upper())
        df.collect()
        (read, n_files), = scan_rows(df)
        assert read < big.count() / (8 if one_part else 2)      # its part, or the parts it has cases in
        assert (n_files <= 2) if one_part else (n_files == len(files(path)))
    one = K.rows_of(spark, by_id, LAYOUT._replace(size=200), "cr_case_id", 7)
    assert [r.cr_case_id for r in one.collect()] == [7] and scan_rows(one)[0][1] <= 2
    assert K.rows_of(spark, by_id, LAYOUT._replace(size=200), "cr_case_id", 10 ** 12).collect() == []
    prefix = K.rows_of_prefix(spark, by_student, "cr_student_id", student[:6].upper())
    assert rows(prefix) == rows(big.where(F.col("cr_student_id").startswith(student[:6])))


def test_a_hot_key_spreads_over_files(spark, cases, tmp_dir):
    hot = cases.withColumn("cr_student_id", F.when(F.col("cr_case_id") % 3 == 0, F.lit("H")).otherwise(F.col("cr_student_id")))
    path, layout = f"{tmp_dir}/hot", K.BY_STUDENT["tbl_case_records"]._replace(size=4)
    K.write_clustered(hot, path, layout)
    assert rows(K.rows_of(spark, path, layout, "cr_student_id", "h")) == rows(hot.where("cr_student_id = 'H'"))
    plan = K._arranged(hot, layout)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_part" in plan.replace("RANGEPARTITIONING", "rangepartitioning")


# ---- searches ------------------------------------------------------------------------------

@pytest.mark.parametrize("pattern,runs", [
    ("%abc%", ["abc"]), ("%a_c%d", ["a", "c", "d"]), (r"%50\%\_x\\y%", [r"50%_x\y"]), ("%%", []), ("", [])])
def test_literal_runs(pattern, runs):
    assert X.literal_runs(pattern) == runs


TEXTS = {
    "tbl_case_records": ["major", "0001", "s_em", "ab", "no such text", "O%G"],
    "tbl_counseling_records": ["scheduled", "0000", "HUM", "x", "TO SCH%LE"],
    "tbl_student_data": ["Customer#00000", "fema", "S1", "stem"],
    "users": ["X.TEST", "admin", "u1@", "Supplier#"],
    "tbl_medical_records": ["Customer#0000", "50%_det", "00_1"],
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_searches_find_the_same_rows(spark, tables, tmp_dir, name):
    table, (key, columns), layout = tables[name], X.SEARCHES[name], K.LAYOUTS[name]._replace(size=64)
    table = spark.createDataFrame(table.collect(), table.schema)
    K.write_clustered(table, f"{tmp_dir}/t", layout)
    X.write_postings(table, key, columns, f"{tmp_dir}/p")
    plain = {"tbl_case_records": Fl.case_search, "tbl_counseling_records": Fl.counseling_search, "tbl_student_data": Fl.student_search,
             "users": Fl.user_search, "tbl_medical_records": Fl.medical_search}[name]
    found = 0
    for text in TEXTS[name]:
        for settings in ([{}, {"referred": True}] if name in ("tbl_case_records", "tbl_medical_records") else [{}]):
            want = plain(table, text, **settings)
            got = X.search_through(spark, name, text, f"{tmp_dir}/p",
                                   lambda c: X.narrowed_parts(spark, f"{tmp_dir}/t", layout, c), **settings)
            assert [tuple(r) for r in got.select(want.columns).collect()] == [tuple(r) for r in want.collect()], (text, settings)
            found += want.count()
        other = X.search_through(spark, name, text, f"{tmp_dir}/p", lambda c: X.narrowed(table, key, c))
        assert rows(other) == rows(plain(table, text))
    assert found


def test_a_search_reads_the_candidates_only(spark, cases, tmp_dir):
    layout = K.Layout("cr_case_id", 50)
    some = cases.withColumn("cr_student_name", F.when(F.col("cr_case_id").isin(11, 420), F.lit("Zoë Quixote"))
                            .otherwise(F.col("cr_student_name")))
    K.write_clustered(some, f"{tmp_dir}/t", layout)
    X.write_postings(some, *X.SEARCHES["tbl_case_records"], f"{tmp_dir}/p")
    grams = X.candidates(spark, f"{tmp_dir}/p", "%QUIXOTE%", 6)
    assert sorted(r.key for r in grams.collect()) == [11, 420]
    assert sum(r for r, _ in scan_rows(grams)) < X.postings(some, *X.SEARCHES["tbl_case_records"]).count() / 20
    got = X.search_through(spark, "tbl_case_records", "ZOË qui", f"{tmp_dir}/p",
                           lambda c: X.narrowed_parts(spark, f"{tmp_dir}/t", layout, c))
    assert [r.cr_case_id for r in got.collect()] == [420, 11]
    (read, n_files), = scan_rows(got)
    assert n_files <= 4 and read <= 200


def test_postings_after_a_batch(spark, cases, tmp_dir):
    key, columns = X.SEARCHES["tbl_case_records"]
    X.write_postings(cases, key, columns, f"{tmp_dir}/p")
    changed = cases.where("cr_case_id % 50 = 1").withColumn("cr_student_name", F.lit("Renamed Person"))
    after = cases.where("cr_case_id % 50 <> 1").unionByName(changed)
    X.add_postings(changed, key, columns, f"{tmp_dir}/p")
    for text in ("renamed", "Customer#00000000", "STEM"):
        got = X.search_through(spark, "tbl_case_records", text, f"{tmp_dir}/p", lambda c: X.narrowed(after, key, c))
        assert rows(got) == rows(Fl.case_search(after, text))


def test_files_are_parsed_once(spark, tables, tmp_dir):
    """The certificate screens read nested fields of the stored lists and no text."""
    from campusledger.operators import attachments as A
    from campusledger.operators import kpis
    path, layout = f"{tmp_dir}/m", K.LAYOUTS["tbl_medical_records"]._replace(size=4000)
    odd = ["null", "NULL", "[]", "", "{}", '{"isMedical":true}', "[{oops", '[null,{"isMedical":true,"filename":"x","extra":[1]}]']
    medical = tables["tbl_medical_records"].withColumn("mr_attachments", F.when(F.col("mr_medical_id") % 5 == 0, F.element_at(
        F.array(*map(F.lit, odd)), (F.col("mr_medical_id") % 8 + 1).cast("int"))).otherwise(F.col("mr_attachments")))
    K.write_clustered(medical, path, layout)
    screens = [kpis.certificate_totals, lambda m: A.attachment_files(m, ordered=False),
               lambda m: A.attachment_file_filter(A.attachment_files(m, ordered=False), "medical", "opd"), A.opd_uploads]

    def check(table):
        stored = K.read_clustered(spark, path, parsed=True)
        for screen in screens:
            assert rows(screen(stored)) == rows(screen(table))
            plan = spark._jvm.PythonSQLUtils.explainString(screen(stored)._jdf.queryExecution(), "formatted")
            schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
            assert schema and all("mr_attachments:string" not in line for line in schema)
        totals = spark._jvm.PythonSQLUtils.explainString(kpis.certificate_totals(stored)._jdf.queryExecution(), "formatted")
        assert "_f_mr_attachments:array<struct<isMedical:boolean>>" in totals

    check(medical)
    req = medical.where("mr_medical_id % 7 = 1").select(
        F.col("mr_medical_id").alias("seq"), F.col("mr_medical_id").alias("recordId"), F.lit("1").alias("studentId"),
        F.lit("A").alias("studentName"), F.lit("s").alias("subject"), F.lit("Treated").alias("status"),
        F.lit("m").alias("medicalDetails"), F.lit("Yes").alias("isPsychological"), F.lit("Yes").alias("isMedical"),
        F.lit('[{"filename":"f","isMedical":true,"uploadedBy":"OPD"}]').alias("existingAttachments"))
    K.change_parts(spark, path, layout, req, "recordId", lambda t, r: C.update_medical(t, r, AS_OF))
    check(C.update_medical(medical, req, AS_OF).table)


# ---- sizes -----------------------------------------------------------------------------------

def test_bloom_filters_are_as_large_as_their_part(spark, tmp_dir):
    """A part of a few rows takes a few kilobytes, not the megabyte of a filter of fixed size."""
    cases = spark.range(400).selectExpr("id AS cr_case_id", "cast(id % 90 AS string) AS cr_student_id")
    K.write_clustered(cases, f"{tmp_dir}/t", LAYOUT)
    sizes = [os.path.getsize(f) for f in files(f"{tmp_dir}/t")]
    assert len(sizes) >= 4 and max(sizes) < 100_000
    got = K.rows_of(spark, f"{tmp_dir}/t", LAYOUT, "cr_student_id", "7")
    assert sorted(r.cr_case_id for r in got.collect()) == [7, 97, 187, 277, 367]


def test_a_fitted_layout_has_a_bounded_number_of_parts(spark, tmp_dir):
    ids = [(-2 ** 63,), (2 ** 63 - 1,), (None,)] + [(i * 10 ** 9,) for i in range(2000)]
    wide = spark.createDataFrame(ids, "cr_case_id long")
    layout = K.fitted(wide, LAYOUT)
    n = wide.select(K.part_of(layout, F.col("cr_case_id")).alias("p")).distinct().count()
    assert n <= K.PARTS + 3
    near = wide.where("cr_case_id BETWEEN 0 AND 1999000000000")
    n = near.select(K.part_of(K.fitted(near, LAYOUT), F.col("cr_case_id"))).distinct().count()
    assert K.PARTS / 2 < n <= K.PARTS + 1
    assert K.fitted(spark.range(90).toDF("cr_case_id"), LAYOUT) == K.fitted(wide.limit(0), LAYOUT) == LAYOUT


def test_postings_and_distinct_students_are_dealt_by_rows(spark, tables):
    """No task holds what one row group of the table gives, whatever its size."""
    for df in (X.postings(tables["tbl_student_data"], *X.SEARCHES["tbl_student_data"]), Fl.distinct_students(tables["tbl_student_data"])):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_requests_carry_the_columns_that_are_read(spark):
    """The fold of a record's requests leaves out columns that nobody asks for."""
    ch = spark.createDataFrame([(1, 5, "a", "x"), (2, 5, "b", None)], "seq long, id long, status string, unread string")
    one = C.one_per_key(ch, "id")
    assert [(r.seq, r.status, r.unread) for r in one.collect()] == [(2, "b", None)]
    assert "max_by(unread" not in one.select("id", "status")._jdf.queryExecution().optimizedPlan().toString()
