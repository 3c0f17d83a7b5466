"""Notification inbox (O46, O47, O57); the unread counts (O34) live in kpis."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.functions.semantics import ci_eq
from campusledger.operators.kpis import CERTIFICATE_TYPE


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("n_created_at").desc_nulls_last(), F.col("n_id").desc())


def notification_inbox(notifications: DataFrame, receiver: str) -> DataFrame:
    """All notifications of one receiver, newest first."""
    return _newest_first(notifications.where(ci_eq("n_receiver", receiver)))


def certificate_inbox(notifications: DataFrame, receiver: str = "INF",
                      sender: str | None = "OPD") -> DataFrame:
    """Certificate notices for a receiver (O47); ``sender=None`` drops the sender test."""
    cond = ci_eq("n_receiver", receiver) & ci_eq("n_type", CERTIFICATE_TYPE)
    if sender is not None:
        cond = cond & ci_eq("n_sender", sender)
    return _newest_first(notifications.where(cond))


class ReadResult(NamedTuple):
    table: DataFrame
    status: DataFrame   # per requested id (mark_read) or one summary row (mark_all_read)


def mark_read(notifications: DataFrame, ids: DataFrame) -> ReadResult:
    """Set ``n_is_read = 'Yes'`` for the requested ``n_id`` values."""
    req = ids.select(F.col("n_id").try_cast("bigint").alias("n_id")).distinct().withColumn("_hit", F.lit(True))
    table = (notifications.join(req, "n_id", "left")
             .withColumn("n_is_read", F.when(F.col("_hit"), F.lit("Yes"))
                         .otherwise(F.col("n_is_read")))
             .select(notifications.columns))
    known = (notifications.select("n_id").join(req.select("n_id"), "n_id", "left_semi")
             .distinct().withColumn("_known", F.lit(True)))
    status = req.join(known, "n_id", "left").select(
        "n_id", F.when(F.col("_known"), F.lit("applied")).otherwise(F.lit("not_found"))
        .alias("status"))
    return ReadResult(table, status)


def mark_all_read(notifications: DataFrame, receiver: str) -> ReadResult:
    """Mark every unread row of one receiver; the status row holds the affected count."""
    unread = ci_eq("n_receiver", receiver) & ci_eq("n_is_read", "No")
    table = notifications.withColumn("n_is_read", F.when(unread, F.lit("Yes"))
                                     .otherwise(F.col("n_is_read")))
    status = notifications.agg(F.count_if(unread).cast("bigint").alias("affectedRows"))
    return ReadResult(table, status)
