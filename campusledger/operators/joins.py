"""Student-to-record joins (O22a-c).

The record screens join each record table to the student table on the
student id (and repeat the condition in ``WHERE``, which adds nothing: both
forms give one equi-join key). A student has one row per semester, so a
record appears once per semester row of its student. The summaries do not
use this join directly; they aggregate first and join the small result
(see ``summaries``). This operator is the plain join for callers that need
the joined rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from campusledger.functions.semantics import ci_key

RECORD_STUDENT_KEY = {
    "case": "cr_student_id",
    "counseling": "cor_student_id_number",
    "medical": "mr_student_id",
}


def students_join_records(students: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """Inner equi-join of students and one record table on the student id,
    ignoring case (rule S1).

    Spark picks the strategy from sizes: a broadcast of the smaller side when
    it is under the broadcast threshold (checked at runtime by AQE), else a
    sort-merge join whose skewed partitions AQE splits.
    """
    key = RECORD_STUDENT_KEY[kind]
    return students.join(records, ci_key(students["sd_id_number"]) == ci_key(records[key]), "inner")


def students_join_cases(students: DataFrame, cases: DataFrame) -> DataFrame:
    return students_join_records(students, cases, "case")


def students_join_counseling(students: DataFrame, counseling: DataFrame) -> DataFrame:
    return students_join_records(students, counseling, "counseling")


def students_join_medical(students: DataFrame, medical: DataFrame) -> DataFrame:
    return students_join_records(students, medical, "medical")
