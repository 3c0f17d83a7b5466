"""Batch jobs: read the published tables, apply one request batch, publish
all outputs together (``sources.snapshots.write_batch``).

Each job is one Spark plan per output; nothing but the request batch's
outputs is collected, and a failure before publishing leaves the published
tables untouched. The request batches are DataFrames (for example read from
a landing folder of JSON or parquet request files).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from campusledger.operators import changes as C, imports as IM, inbox as I, referrals as R
from campusledger.operators.account_stream import account_stream
from campusledger.sources.snapshots import read_batch_table, write_batch


def _clock(as_of):
    """One time for a whole job: every output of a batch carries the same."""
    return as_of if as_of is not None else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _run(spark: SparkSession, root: str, table: str, steps: list, as_of=None) -> dict[str, str]:
    """Apply ``(name, operator, requests)`` steps to one table, in order, and
    publish the new table, the status of each step and the derived notices."""
    current = _table(spark, root, table)
    outputs, notes = {}, []
    for name, operator, requests in steps:
        if requests is None:
            continue
        written = operator(current, requests)
        current, outputs[f"{name}_status"] = written.table, written.status
        if written.notifications is not None:
            notes.append(written.notifications)
    if not outputs:
        return {}
    outputs[table] = current
    if notes:
        outputs["tbl_notifications"] = _with_notifications(spark, root, notes, as_of)
    return write_batch(outputs, root)


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_batch_table(spark, root, name)


def publish_tables(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Publish an initial set of tables (for example from ``load_tables``)."""
    return write_batch(tables, root)


def run_case_changes(spark: SparkSession, root: str, inserts: DataFrame | None = None,
                     updates: DataFrame | None = None, as_of=None) -> dict[str, str]:
    """Insert and update case records, with their referral notices."""
    ts = _clock(as_of)
    return _run(spark, root, "tbl_case_records", [
        ("case_insert", lambda t, r: C.insert_cases(t, r, ts), inserts),
        ("case_update", lambda t, r: C.update_cases(t, r, ts), updates)], ts)


def run_counseling_changes(spark: SparkSession, root: str, inserts: DataFrame | None = None,
                           updates: DataFrame | None = None, as_of=None) -> dict[str, str]:
    """Insert and update counselling sessions."""
    ts = _clock(as_of)
    return _run(spark, root, "tbl_counseling_records", [
        ("counseling_insert", lambda t, r: C.insert_counseling(t, r, ts), inserts),
        ("counseling_update", lambda t, r: C.update_counseling(t, r, ts), updates)], ts)


def run_medical_changes(spark: SparkSession, root: str, inserts: DataFrame | None = None,
                        updates: DataFrame | None = None, as_of=None) -> dict[str, str]:
    """Insert and update medical records, with referral and upload notices."""
    ts = _clock(as_of)
    return _run(spark, root, "tbl_medical_records", [
        ("medical_insert", lambda t, r: C.insert_medical(t, r, ts), inserts),
        ("medical_update", lambda t, r: C.update_medical(t, r, ts), updates)], ts)


def run_student_changes(spark: SparkSession, root: str, inserts: DataFrame | None = None,
                        updates: DataFrame | None = None, deletes: DataFrame | None = None) -> dict[str, str]:
    """Insert, update and delete students, in this order."""
    return _run(spark, root, "tbl_student_data", [
        ("student_insert", C.insert_students, inserts), ("student_update", C.update_students, updates),
        ("student_delete", C.delete_students, deletes)])


def run_user_changes(spark: SparkSession, root: str, inserts: DataFrame | None = None,
                     updates: DataFrame | None = None, deactivations: DataFrame | None = None,
                     activations: DataFrame | None = None, deletes: DataFrame | None = None,
                     as_of=None) -> dict[str, str]:
    """Change accounts, in the order of the arguments."""
    ts = _clock(as_of)
    return _run(spark, root, "users", [
        ("user_insert", lambda t, r: C.insert_users(t, r, ts), inserts), ("user_update", C.update_users, updates),
        ("user_deactivate", lambda t, r: C.deactivate_users(t, r, ts), deactivations),
        ("user_activate", C.activate_users, activations), ("user_delete", C.delete_users, deletes)])


def run_account_stream(spark: SparkSession, root: str, requests: DataFrame, as_of=None) -> dict[str, str]:
    """Activate, deactivate and delete accounts in the order of the requests' ``seq``."""
    ts = _clock(as_of)
    return _run(spark, root, "users", [("account_stream", lambda t, r: account_stream(t, r, ts), requests)], ts)


def run_mark_read(spark: SparkSession, root: str, requests: DataFrame) -> dict[str, str]:
    """Mark single notifications as read."""
    res = I.mark_read(_table(spark, root, "tbl_notifications"), requests)
    return write_batch({"tbl_notifications": res.table, "mark_read_status": res.status}, root)


def _with_notifications(spark: SparkSession, root: str, notes: list[DataFrame],
                        as_of) -> DataFrame:
    """The published notifications plus the batch's derived notices, with new ids."""
    from pyspark.sql import functions as F
    from campusledger.functions.semantics import as_of_column
    current = _table(spark, root, "tbl_notifications")
    new = notes[0]
    for n in notes[1:]:
        new = new.unionByName(n)
    base = F.coalesce(current.agg(F.max("n_id")).scalar(), F.lit(0))
    new = C.sequence_ids(new, ["n_related_record_type", "n_related_record_id", "n_receiver",
                               "n_type", "n_message"], base, "n_id")
    new = new.select("n_id", "n_sender", "n_receiver", "n_type", "n_message",
                     F.lit("No").alias("n_is_read"), as_of_column(as_of).alias("n_created_at"),
                     "n_related_record_id", "n_related_record_type")
    return current.unionByName(new)


def run_referral_confirmations(spark: SparkSession, root: str, case_ids: DataFrame | None,
                               medical_ids: DataFrame | None, as_of=None) -> dict[str, str]:
    """Accept pending referrals: the record tables, the acceptance notices and
    the first counselling sessions are published together."""
    from pyspark.sql import functions as F
    from campusledger.functions.semantics import as_of_column
    as_of = _clock(as_of)
    outputs: dict[str, DataFrame] = {}
    notes, sessions = [], []
    if case_ids is not None:
        res = R.confirm_case_referrals(_table(spark, root, "tbl_case_records"), case_ids)
        outputs["tbl_case_records"] = res.table
        outputs["case_confirmation_status"] = res.status
        notes.append(res.notifications)
        sessions.append(res.counseling)
    if medical_ids is not None:
        res = R.confirm_medical_referrals(_table(spark, root, "tbl_medical_records"), medical_ids)
        outputs["tbl_medical_records"] = res.table
        outputs["medical_confirmation_status"] = res.status
        notes.append(res.notifications)
        sessions.append(res.counseling)
    if sessions:
        counseling = _table(spark, root, "tbl_counseling_records")
        new = sessions[0]
        for s in sessions[1:]:
            new = new.unionByName(s)
        ts = as_of_column(as_of)
        base = F.coalesce(counseling.agg(F.max("cor_record_id")).scalar(), F.lit(0))
        # one session per accepted record: its origin id orders the new sessions
        new = new.withColumn("_kind", F.col("cor_origin_case_id").isNull()).withColumn(
            "_origin", F.coalesce("cor_origin_case_id", "cor_origin_medical_id"))
        new = C.sequence_ids(new, ["_kind", "_origin"], base, "cor_record_id")
        new = new.select(*[
            F.col(c) if c in new.columns else
            (ts.alias(c) if c == "cor_create_date" else
             F.lit("[]").alias(c) if c == "cor_edit_history" else
             F.lit("").alias(c) if c == "cor_additional_remarks" else
             F.lit(None).cast(counseling.schema[c].dataType).alias(c))
            for c in counseling.columns])
        outputs["tbl_counseling_records"] = counseling.unionByName(new)
        outputs["tbl_notifications"] = _with_notifications(spark, root, notes, as_of)
    return write_batch(outputs, root)


def run_mark_all_read(spark: SparkSession, root: str, receiver: str) -> dict[str, str]:
    res = I.mark_all_read(_table(spark, root, "tbl_notifications"), receiver)
    return write_batch({"tbl_notifications": res.table, "mark_all_read_status": res.status}, root)


def run_student_import(spark: SparkSession, root: str, mapped: DataFrame) -> dict[str, str]:
    """Import mapped student rows (``imports.map_csv_rows`` / ``map_sheet_cells``)."""
    res = IM.import_students(_table(spark, root, "tbl_student_data"), mapped)
    return write_batch({"tbl_student_data": res.table, "import_summary": res.summary,
                        "import_messages": res.messages, "import_failed": res.failed, "import_rejected": res.rejected}, root)
