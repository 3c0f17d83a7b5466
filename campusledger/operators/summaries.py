"""Per-student summaries and semester look-ups.

Plan shape used by every summary, chosen for very large record tables:

1. Records are aggregated first, by (student id, status, semester, flags):
   row count, latest date, newest id -- fixed-width buffers, so a
   code-generated hash aggregate with map-side partial aggregation. One
   student holding a third of all records is collapsed inside each map task
   before the shuffle, so it overloads neither a task nor the network.
2. The small level-1 result is repartitioned once by student id; on that
   partitioning a status merge (ignoring case) and the per-student lists run
   without further exchanges. Each list holds at most one entry per distinct
   status / semester, so its size is bounded by the vocabulary, not the data.
3. The per-student rows are joined to the DISTINCT student key tuples
   (id, name, strand, grade, section). Joining after aggregating avoids the
   semester fan-out of the raw join; a student listed with two grades still
   shows once per tuple, each with the full count, as in the record screens.

Status lists: each distinct status (ignoring case) appears once, ordered by
its latest date (newest first, undated last), ties broken by the newest
record id; ``latestStatus`` is the first entry. NULL statuses are left out of
the list but their records are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq, ci_key, ci_like_any, iso_millis, unsigned
from campusledger.operators.filters import medical_condition, top_n


@dataclass(frozen=True)
class RecordKind:
    id: str
    student: str
    date: str
    status: str
    semester: str
    count_name: str
    date_name: str
    flag_lists: tuple = ()          # (output name, source column)


CASES = RecordKind("cr_case_id", "cr_student_id", "cr_case_date", "cr_status",
                   "cr_school_year_semester", "caseCount", "latestCaseDate")
COUNSELING = RecordKind("cor_record_id", "cor_student_id_number", "cor_date", "cor_status",
                        "cor_school_year_semester", "counselingCount", "latestCounselingDate")
MEDICAL = RecordKind("mr_medical_id", "mr_student_id", "mr_record_date", "mr_status",
                     "mr_school_year_semester", "medicalCount", "latestMedicalDate",
                     (("hasMedical", "mr_is_medical"), ("hasPsychological", "mr_is_psychological")))

STUDENT_KEYS = (("sd_id_number", "id"), ("sd_student_name", "name"), ("sd_strand", "strand"),
                ("sd_grade_level", "gradeLevel"), ("sd_section", "section"))


def student_keys(students: DataFrame) -> DataFrame:
    """DISTINCT (id, name, strand, gradeLevel, section) tuples."""
    return students.select([F.col(s).alias(a) for s, a in STUDENT_KEYS]).distinct()


def _sorted_join(c) -> F.Column:
    """The distinct texts ignoring case (the smallest spelling of each), joined."""
    keys = F.array_distinct(F.transform(c, F.lower))
    arr = F.array_sort(F.transform(keys, lambda k: F.array_min(F.filter(c, lambda x: F.lower(x) == k))))
    return F.when(F.size(arr) > 0, F.array_join(arr, ","))


def partial_counts(records: DataFrame, kind: RecordKind, with_semesters: bool = True) -> DataFrame:
    """Level 1: rows, latest date and newest id per student, status (as spelled), semester and flags.

    Fixed-width buffers only, so it is a code-generated hash aggregate with map-side
    partial aggregation. Record ids are the tables' primary keys, so counting rows
    per student before any join equals the distinct count of ids. These partial
    results can be stored and kept up to date by batches (``operators.rollups``).
    """
    keys = [ci_key(kind.student).alias("id"), F.col(kind.status).alias("_status")]
    if with_semesters:
        keys.append(F.col(kind.semester).alias("_sem"))
    keys += [F.col(src).alias("_" + name) for name, src in kind.flag_lists]
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                      F.max(kind.date).alias("_last_date"),
                                      F.max(kind.id).alias("_last_id"))


def _per_student(level1: DataFrame, kind: RecordKind, with_semesters: bool) -> DataFrame:
    # The level-1 output is small (students x statuses x semesters). One
    # explicit exchange by student id serves the two small aggregates below
    # and the final join: hash partitioning on the id satisfies all three.
    small = level1.repartition("id")
    sets = [F.collect_set("_sem").alias("_sem")] if with_semesters else []
    sets += [F.collect_set("_" + name).alias("_" + name) for name, _ in kind.flag_lists]
    per_status = (small.groupBy("id", F.lower("_status").alias("_sk"))
                  .agg(F.sum("_n").alias("_n"),
                       F.max("_last_date").alias("_last_date"),
                       F.max("_last_id").alias("_last_id"),
                       F.max_by("_status", "_last_id").alias("_status"),
                       *sets))
    entry = F.struct(F.col("_last_date").isNotNull().alias("dated"),
                     F.col("_last_date").alias("last_date"),
                     F.col("_last_id").alias("last_id"),
                     F.col("_status").alias("status"))
    extra2 = []
    if with_semesters:
        extra2.append(F.array_distinct(F.flatten(F.collect_list("_sem"))).alias("_sem"))
    for name, _ in kind.flag_lists:
        extra2.append(F.array_distinct(F.flatten(F.collect_list("_" + name))).alias("_" + name))
    return (per_status.groupBy("id")
            .agg(F.sum("_n").cast("bigint").alias(kind.count_name),
                 F.max("_last_date").alias("_latest"),
                 F.sort_array(F.collect_list(F.when(F.col("_status").isNotNull(), entry)),
                              asc=False).alias("_ordered"),
                 *extra2))


def student_summary(students: DataFrame, records: DataFrame | None, kind: RecordKind, *,
                    with_date: bool = True, with_semesters: bool = True,
                    search: str | None = None, limit: int | None = None,
                    ordered: bool = True, partials: DataFrame | None = None) -> DataFrame:
    """Shared builder behind O23-O25.

    ``partials`` (stored :func:`partial_counts`) are used in place of ``records``.

    ``search`` is a LIKE pattern matched (ignoring case) against the student's
    id, name and strand; the matching ids also prune the records before
    aggregation (a semi join that AQE broadcasts when the match set is small).
    ``ordered=False`` skips the screen's global sort by name (for callers that
    write the summary rather than display it); a ``limit`` always orders.
    """
    keys = student_keys(students)
    if search is not None:
        keys = keys.where(ci_like_any(["id", "name", "strand"], search))
        wanted = keys.select(ci_key("id").alias("_id")).distinct()
        if partials is None:
            records = records.join(wanted, ci_key(records[kind.student]) == wanted["_id"], "left_semi")
        else:
            partials = partials.join(wanted, partials["id"] == wanted["_id"], "left_semi")
    if partials is None:
        partials = partial_counts(records, kind, with_semesters)
    agg = _per_student(partials, kind, with_semesters).withColumnRenamed("id", "_id")
    status_list = F.col("_ordered")
    cols = [F.col(a) for _, a in STUDENT_KEYS] + [F.col(kind.count_name)]
    if with_date:
        cols.append(iso_millis("_latest").alias(kind.date_name))
    cols.append(F.when(F.size(status_list) > 0,
                       F.array_join(F.transform(status_list, lambda e: e["status"]), ","))
                .alias("statuses"))
    for name, _ in kind.flag_lists:
        cols.append(_sorted_join(F.col("_" + name)).alias(name))
    if with_semesters:
        cols.append(_sorted_join(F.col("_sem")).alias("allSemesters"))
    cols.append(F.try_element_at(status_list, F.lit(1))["status"].alias("latestStatus"))
    out = keys.join(agg, ci_key("id") == F.col("_id"), "inner").select(cols)
    order = ("name", "id", "strand", "gradeLevel", "section")
    if limit is not None:
        return out.orderBy(*order).limit(limit)
    return out.orderBy(*order) if ordered else out


# ---- O23 --------------------------------------------------------------------

def student_case_summary(students: DataFrame, cases: DataFrame, referred: bool = False) -> DataFrame:
    """Students with case records (O23a); ``referred`` keeps referred cases only."""
    if referred:
        cases = cases.where(ci_eq("cr_referred", "Yes"))
    return student_summary(students, cases, CASES)


def student_case_summary_search(students: DataFrame, cases: DataFrame, text: str,
                                referred: bool = False, limit: int = 50) -> DataFrame:
    """Search form of O23a: no date, no semesters, first 50 by name."""
    if referred:
        cases = cases.where(ci_eq("cr_referred", "Yes"))
    return student_summary(students, cases, CASES, with_date=False, with_semesters=False,
                           search=f"%{text}%", limit=limit)


# ---- O24 --------------------------------------------------------------------

def _psych(counseling: DataFrame, psychological: bool) -> DataFrame:
    return counseling.where(ci_eq("cor_is_psychological_condition", "YES")) if psychological \
        else counseling


def student_counseling_summary(students: DataFrame, counseling: DataFrame,
                               psychological: bool = False) -> DataFrame:
    """Students with counselling records."""
    return student_summary(students, _psych(counseling, psychological), COUNSELING)


def student_counseling_summary_search(students: DataFrame, counseling: DataFrame, text: str,
                                      psychological: bool = False, limit: int = 50) -> DataFrame:
    """Search form of O24a."""
    return student_summary(students, _psych(counseling, psychological), COUNSELING,
                           with_date=False, with_semesters=False, search=f"%{text}%", limit=limit)


# ---- O25 --------------------------------------------------------------------

def student_medical_summary(students: DataFrame, medical: DataFrame, referred: bool = False,
                            kind: str = "ALL") -> DataFrame:
    """Students with medical records (O25a). When ``referred`` is set the kind
    filter is not applied, as in the record screens."""
    if referred:
        medical = medical.where(ci_eq("mr_referred", "Yes"))
    else:
        cond = medical_condition(kind)
        if cond is not None:
            medical = medical.where(cond)
    return student_summary(students, medical, MEDICAL)


def student_medical_summary_search(students: DataFrame, medical: DataFrame, text: str,
                                   kind: str = "ALL", referred: bool = False,
                                   limit: int = 50) -> DataFrame:
    """Search form (O25b); ``referred=True`` is the referred search (O25c),
    where the kind filter *does* apply."""
    if referred:
        medical = medical.where(ci_eq("mr_referred", "Yes"))
    cond = medical_condition(kind)
    if cond is not None:
        medical = medical.where(cond)
    return student_summary(students, medical, MEDICAL, with_date=False, with_semesters=False,
                           search=f"%{text}%", limit=limit)


def student_medical_referred_search(students: DataFrame, medical: DataFrame, text: str,
                                    kind: str = "ALL", limit: int = 50) -> DataFrame:
    """O25c."""
    return student_medical_summary_search(students, medical, text, kind, referred=True,
                                          limit=limit)


# ---- O20 / O21 --------------------------------------------------------------

STUDENT_LOOKUP_COLS = ("sd_id_number", "sd_student_name", "sd_strand",
                       "sd_school_year_semesterr", "sd_grade_level", "sd_section")


def _id_prefix(prefix: str) -> F.Column:
    """``sd_id_number LIKE 'prefix%'`` ignoring case.

    A prefix without letters or wildcard characters is case-free, so it is
    expressed as ``startswith``, which reaches the parquet reader as a pushed
    ``StringStartsWith`` filter.
    """
    plain = prefix.lower() == prefix.upper() and not any(ch in prefix for ch in "%_\\")
    if plain:
        return F.col("sd_id_number").startswith(prefix)
    return F.col("sd_id_number").ilike(prefix + "%")


def student_prefix_search(students: DataFrame, prefix: str, limit: int = 30) -> DataFrame:
    """Semester rows of ids starting with ``prefix``.

    Fewer than three characters gives no rows. Order: id, school year
    (text) descending, semester number descending; ties broken by the other
    columns so the first ``limit`` rows are well defined.
    """
    sem = F.col("sd_school_year_semesterr")
    rows = students.select(*STUDENT_LOOKUP_COLS)
    if prefix is None or len(prefix) < 3:
        return rows.where(F.lit(False))
    return top_n(rows.where(_id_prefix(prefix)), limit,
                 F.col("sd_id_number").asc(),
                 F.substring_index(sem, "-", 1).desc(),
                 unsigned(F.substring_index(sem, "-", -1)).desc(),
                 sem.asc(), F.col("sd_student_name"), F.col("sd_strand"),
                 F.col("sd_grade_level"), F.col("sd_section"))


def semester_key(numeric: bool = False) -> F.Column:
    """``year-<unsigned semester>``; text order unless ``numeric``."""
    sem = F.col("sd_school_year_semesterr")
    year, num = F.substring_index(sem, "-", 1), unsigned(F.substring_index(sem, "-", -1))
    if numeric:
        return F.struct(year.alias("y"), num.alias("n"))
    return F.concat(year, F.lit("-"), num.cast("string"))


def latest_semester_per_student(students: DataFrame, prefix: str, limit: int | None = 10,
                                numeric: bool = False) -> DataFrame:
    """Rows of each matching id at its latest semester, ties kept.

    The maximum is taken on the text ``year-n`` (so ``2024-10`` sorts before
    ``2024-2``) unless ``numeric``; rows without a semester drop out.
    Aggregate-then-join rather than a window: the aggregate is partial per
    task and the join is split by AQE if one id is hot, whereas a window would
    put all rows of an id in one task.
    """
    rows = students.select(*STUDENT_LOOKUP_COLS)
    if prefix is None or len(prefix) < 3:
        return rows.where(F.lit(False))
    rows = rows.where(_id_prefix(prefix)).withColumn("_key", semester_key(numeric))
    best = rows.groupBy("sd_id_number").agg(F.max("_key").alias("_key"))
    out = (rows.join(best, ["sd_id_number", "_key"], "inner").drop("_key")
           .orderBy(*STUDENT_LOOKUP_COLS))
    return out.limit(limit) if limit is not None else out
