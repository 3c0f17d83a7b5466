"""Summaries and totals updated by batches equal those of the whole table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from campusledger.operators import kpis
from campusledger.operators import rollups as R
from campusledger.operators import summaries as S

KINDS = {"tbl_case_records": S.CASES, "tbl_counseling_records": S.COUNSELING, "tbl_medical_records": S.MEDICAL}


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def batch(table, kind):
    """Old rows that go (the latest of many groups among them), rows that replace them, new ones and deletions."""
    ids = [r[0] for r in table.select(kind.id).orderBy(kind.id).collect()]
    gone = set(ids[::3]) | set(ids[-30:])
    removed = table.where(F.col(kind.id).isin(sorted(gone)))
    changed = removed.where(F.col(kind.id) % 2 == 0).withColumns({
        kind.status: F.when(F.col(kind.id) % 4 == 0, F.upper(kind.status)).otherwise(F.lit("Brand new")),
        kind.date: F.when(F.col(kind.id) % 6 == 0, F.lit(None)).otherwise(F.col(kind.date)).cast("timestamp_ntz")})
    new = removed.limit(20).withColumns({kind.id: F.col(kind.id) + 10 ** 9,
                                         kind.date: F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz"),
                                         kind.student: F.when(F.col(kind.id) % 2 == 0, F.lit("Zz1")).otherwise(F.col(kind.student))})
    added = changed.unionByName(new)
    after = table.where(~F.col(kind.id).isin(sorted(gone))).unionByName(added)
    return removed, added, after


@pytest.mark.parametrize("name", sorted(KINDS))
def test_summaries(spark, tables, name):
    kind, students = KINDS[name], tables["tbl_student_data"]
    table = spark.createDataFrame(tables[name].collect(), tables[name].schema).where(F.col(kind.id) % 5 < 3)
    removed, added, after = batch(table, kind)
    partials = S.partial_counts(table, kind)
    assert rows(R.summary_of(students, partials, kind)) == rows(S.student_summary(students, table, kind))
    updated = R.update_partials(partials, removed, added, after, kind)
    assert rows(updated) == rows(S.partial_counts(after, kind))
    assert rows(R.summary_of(students, updated, kind)) == rows(S.student_summary(students, after, kind))
    # and a second batch on top: everything of the first goes
    again = R.update_partials(updated, added, table.limit(0), after.join(added.select(kind.id), kind.id, "left_anti"), kind)
    assert rows(again) == rows(S.partial_counts(after.join(added.select(kind.id), kind.id, "left_anti"), kind))


def test_an_empty_batch_and_an_empty_table(spark, tables):
    cases = tables["tbl_case_records"]
    none, partials = cases.limit(0), S.partial_counts(cases, S.CASES)
    assert rows(R.update_partials(partials, none, none, cases, S.CASES)) == rows(partials)
    assert R.update_partials(partials, cases, none, none, S.CASES).collect() == []
    assert rows(R.update_partials(S.partial_counts(none, S.CASES), none, cases, cases, S.CASES)) == rows(partials)


def test_totals(spark, tables):
    cases, medical, notes = tables["tbl_case_records"], tables["tbl_medical_records"], tables["tbl_notifications"]
    as_of = dt.datetime(1999, 1, 1)
    keys, measures = R.monthly_counts("cr_case_date", "cr_student_grade_level")
    removed, added, after = batch(cases, S.CASES)
    months = R.update_counts(R.count_table(cases, keys, measures), removed, added, keys, measures)
    assert rows(months) == rows(R.count_table(after, keys, measures))
    trend = kpis.monthly_cases_by_grade(after, as_of, months=600).select("grade_11", "grade_12")
    assert rows(trend) == rows(months.where("month_key >= '1949-01'").select("grade_11", "grade_12"))

    keys, measures = R.certificate_counts()
    removed, added, after = batch(medical, S.MEDICAL)
    got = R.update_counts(R.count_table(medical, keys, measures), removed, added, keys, measures).drop("rows")
    assert rows(got) == rows(kpis.certificate_totals(after))

    keys, measures = R.unread_by_type()
    read = notes.where("n_id % 3 = 0")
    marked = read.withColumn("n_is_read", F.lit("Yes"))
    got = R.update_counts(R.count_table(notes, keys, measures), read, marked, keys, measures)
    assert rows(got) == rows(R.count_table(notes.where("n_id % 3 <> 0").unionByName(marked), keys, measures))


def test_replaced_rows(spark, tables):
    from campusledger.operators import changes as C
    cases = tables["tbl_case_records"]
    req = cases.where("cr_case_id % 100 = 7").select(F.col("cr_case_id").alias("seq"), F.col("cr_case_id").alias("caseId"),
                                                      F.lit("Done").alias("status"), F.col("cr_student_id").alias("studentId"))
    after = C.update_cases(cases, req, "2025-06-01 09:00:00").table
    old, new = R.replaced_rows(cases, after, "cr_case_id", req, "caseId")
    assert rows(old.select("cr_case_id")) == rows(new.select("cr_case_id")) and new.where("cr_status <> 'Done'").isEmpty()
    got = R.update_partials(S.partial_counts(cases, S.CASES), old, new, after, S.CASES)
    assert rows(got) == rows(S.partial_counts(after, S.CASES))
