"""Validation of change batches.

Batch form: every check yields a reason column; ``split`` separates valid
rows from rejected ones (with their reasons) in one pass, without collecting.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.functions.semantics import exact_id

# Required request fields per screen.
REQUIRED = {
    "counseling": ("studentId", "studentName", "strand", "gradeLevel", "section",
                   "sessionNumber", "status", "concern"),
    "medical_insert": ("studentId", "studentName"),
    "medical_update": ("studentId", "studentName", "subject", "status", "medicalDetails",
                       "isPsychological", "isMedical"),
    "user": ("email", "username", "name", "userType", "password"),
}


def missing(c: str) -> Column:
    """Application-style ``!value``: NULL or empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def required_fields(df: DataFrame, kind: str) -> Column:
    """Array of the required fields that are missing."""
    fields = [f for f in REQUIRED[kind] if f in df.columns]
    absent = [F.lit(f) for f in REQUIRED[kind] if f not in df.columns]
    arr = F.array(*[F.when(missing(f), F.lit(f)) for f in fields], *absent)
    return F.filter(arr, lambda x: x.isNotNull())


def condition_consistency() -> Column:
    """A medical record must be medical or psychological: not both exactly 'No' (O67)."""
    return ~((F.col("isPsychological") == "No") & (F.col("isMedical") == "No"))


def numeric_id(c: str) -> Column:
    """The record id must be a whole number (O70); see ``semantics.exact_id``."""
    return exact_id(c).isNotNull()


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of reason texts whose condition holds (conditions mean *bad*)."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]),
                    lambda x: x.isNotNull())


class Split(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


def split(df: DataFrame, reason_col: Column) -> Split:
    """Rows without reasons, and rows with a ``reasons`` array."""
    tagged = df.withColumn("reasons", reason_col)
    return Split(tagged.where(F.size("reasons") == 0).drop("reasons"),
                 tagged.where(F.size("reasons") > 0))


def first_in_batch(df: DataFrame, keys: list[Column], seq: str = "seq",
                   flag: str = "_first", among: Column | None = None) -> DataFrame:
    """Flag the earliest row (by ``seq``) of each key (O69 in-batch, O65), of
    the rows where ``among`` holds (others are not flagged).

    Aggregate-then-join instead of a window: the minimum is a partial
    aggregate and the join is split by AQE when one key is hot, so a key
    shared by a third of the rows does not land in one task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns({n: k for n, k in zip(names, keys)})
    pool = keyed if among is None else keyed.where(among)
    firsts = pool.groupBy(*names).agg(F.min(seq).alias("_min_seq"))
    return (keyed.join(firsts, names, "left")
            .withColumn(flag, F.coalesce(F.col(seq) == F.col("_min_seq"), F.lit(False)))
            .drop(*names, "_min_seq"))
