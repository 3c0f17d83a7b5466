"""Summaries and totals kept up to date by batches.

A batch tells which rows it took away and which it put in their place. Counts are
adjusted by both. The latest date and newest id of a group only grow by what is put
in; where a row that held one of them is taken away, the group is counted again from
the table, reading the rows of those students only.

The stored partial results have one row per student, status, semester and flags
(``summaries.partial_counts``) or per key of a total, so an update shuffles the batch
and, once, the partial results, never the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq, ci_key
from campusledger.functions.jsoncols import has_medical_file
from campusledger.operators.summaries import RecordKind, partial_counts, student_summary


def replaced_rows(before: DataFrame, after: DataFrame, key: str, requests: DataFrame, request_key: str) -> tuple[DataFrame, DataFrame]:
    """The requested rows as they were and as they are."""
    wanted = requests.select(F.col(request_key).alias(key)).distinct()
    return tuple(t.join(wanted, key, "left_semi").select(t.columns) for t in (before, after))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def update_partials(partials: DataFrame, removed: DataFrame, added: DataFrame, table: DataFrame, kind: RecordKind) -> DataFrame:
    """The partial results of ``table``, from those before the batch and its rows.

    ``removed`` and ``added`` are the batch's old and new rows, ``table`` is the table
    after it (read only for groups that lost their latest row).
    """
    measures = ["_n", "_last_date", "_last_id"]
    keys = [c for c in partials.columns if c not in measures]
    gone = partial_counts(removed, kind).withColumns({
        "_n": -F.col("_n"), "_gone_date": F.col("_last_date"), "_gone_id": F.col("_last_id"),
        "_last_date": F.lit(None), "_last_id": F.lit(None)})
    every = partials.unionByName(partial_counts(added, kind)).unionByName(gone, allowMissingColumns=True)
    merged = every.groupBy(*keys).agg(F.sum("_n").alias("_n"), *(
        F.max(c).alias(c) for c in ("_last_date", "_last_id", "_gone_date", "_gone_id"))).where(F.col("_n") > 0)
    # Of equal values one may have been taken away while another stays, so equal counts as lost.
    lost = F.coalesce(F.col("_gone_date") >= F.col("_last_date"), F.col("_gone_date").isNotNull()) \
        | F.coalesce(F.col("_gone_id") >= F.col("_last_id"), F.col("_gone_id").isNotNull())
    merged = merged.withColumn("_lost", lost)
    again = merged.where("_lost").select(*(F.col(k).alias(k) for k in keys))
    students = again.select("id").distinct()
    rows = table.join(students, ci_key(table[kind.student]).eqNullSafe(students["id"]), "left_semi")
    fresh = partial_counts(rows, kind)
    fresh = fresh.join(again, _same(fresh, again, keys), "left_semi")
    return merged.where("NOT _lost").select(*keys, *measures).unionByName(fresh.select(*keys, *measures))


def summary_of(students: DataFrame, partials: DataFrame, kind: RecordKind, **settings) -> DataFrame:
    """The per-student summary (O23-O25) from stored partial results."""
    return student_summary(students, None, kind, partials=partials, **settings)


# ---- totals: counts per key, adjusted by a batch's rows -------------------------------------

def count_table(df: DataFrame, keys: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """Counts of the rows for which each measure holds, per key; keys without any row do not appear."""
    return df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(
        F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(m) for m, c in measures.items()))


def update_counts(counts: DataFrame, removed: DataFrame, added: DataFrame, keys: dict[str, Column],
                  measures: dict[str, Column]) -> DataFrame:
    """The count table after a batch."""
    names = ["rows", *measures]
    gone = count_table(removed, keys, measures).withColumns({m: -F.col(m) for m in names})
    every = counts.unionByName(count_table(added, keys, measures)).unionByName(gone)
    if not keys:
        return every.agg(*(F.sum(m).alias(m) for m in names))
    return every.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in names)).where(F.col("rows") > 0)


GRADES = {"grade_11": "11", "grade_12": "12"}


def monthly_counts(date_col: str, grade_col: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Keys and measures of the trends by month and grade (O32, O33), all months."""
    return ({"month_key": F.date_format(date_col, "yyyy-MM")},
            {m: F.col(grade_col) == g for m, g in GRADES.items()})


def certificate_counts() -> tuple[dict[str, Column], dict[str, Column]]:
    """Keys and measures of the records with and without a certificate."""
    has = has_medical_file("mr_attachments")
    return {}, {f"{w}_certificates_grade_{g}": (has if w == "with" else ~has) & (F.col("mr_grade_level") == g)
                for w in ("with", "without") for g in ("11", "12")}


def unread_by_type() -> tuple[dict[str, Column], dict[str, Column]]:
    """Keys and measures of the unread notifications per receiver and type."""
    return ({"receiver": F.lower("n_receiver"), "n_type": F.col("n_type")}, {"unread": ci_eq("n_is_read", "No")})
