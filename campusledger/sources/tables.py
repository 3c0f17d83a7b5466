"""The six record tables.

Production deployments point :func:`load_tables` at parquet folders holding
the six tables. For verification the driver's synthetic parquet tables
(``customer orders events supplier``) are viewed as the six record
tables through portable SQL; the very same text is run by the DuckDB oracle,
so both engines start from identical inputs.

Placeholders: ``{customer}`` etc. name a source table; ``{timestamp}`` is the
zone-free timestamp literal keyword (``timestamp_ntz`` in Spark, where a bare
``timestamp`` literal would be zoned; ``timestamp`` in DuckDB);
``{pad:column:width}`` is the number as text, zero-padded to ``width`` digits
and never cut.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECORD_TABLES = (
    "tbl_student_data",
    "tbl_case_records",
    "tbl_counseling_records",
    "tbl_medical_records",
    "tbl_notifications",
    "users",
)

SOURCE_TABLES = ("customer", "orders", "events", "supplier")

# The view definitions below fix the test inputs; they are the
# same text for Spark and for the DuckDB oracle.
FIXTURE_SQL: dict[str, str] = {
    "tbl_student_data": """
SELECT {pad:c_custkey:6} AS sd_id_number,
       c_name AS sd_student_name,
       c_mktsegment AS sd_strand,
       CASE WHEN s.i < 2 THEN '11' ELSE '12' END AS sd_grade_level,
       concat('S', cast(c_nationkey % 5 AS string)) AS sd_section,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sd_gender,
       concat('R', cast(c_nationkey % 3 AS string)) AS sd_religion,
       concat('School ', cast(c_nationkey AS string)) AS sd_previous_school,
       'Active' AS sd_status,
       date '2005-01-01' + cast(c_custkey % 1000 AS int) AS sd_birthdate,
       0 AS sd_school_year_sem,
       s.sem AS sd_school_year_semesterr
FROM {customer}
JOIN (VALUES (0, 0, '2023-2024-1'),
             (1, 0, '2023-2024-1'), (1, 1, '2023-2024-2'),
             (2, 0, '2023-2024-1'), (2, 1, '2023-2024-2'), (2, 2, '2024-2025-1'),
             (3, 0, '2023-2024-1'), (3, 1, '2023-2024-2'), (3, 2, '2024-2025-1'), (3, 3, '2024-2025-2')) AS s(m, i, sem)
  ON s.m = c_custkey % 4
""",
    "tbl_case_records": """
SELECT o_orderkey AS cr_case_id,
       {pad:o_custkey:6} AS cr_student_id,
       concat('Customer#', {pad:o_custkey:9}) AS cr_student_name,
       CASE o_custkey % 3 WHEN 0 THEN 'STEM' WHEN 1 THEN 'ABM' ELSE 'HUMSS' END AS cr_student_strand,
       CASE WHEN o_orderkey % 2 = 0 THEN '11' ELSE '12' END AS cr_student_grade_level,
       concat('S', cast(o_custkey % 5 AS string)) AS cr_student_section,
       CASE o_orderkey % 4 WHEN 0 THEN '2023-2024-1' WHEN 1 THEN '2023-2024-2'
                           WHEN 2 THEN '2024-2025-1' ELSE '2024-2025-2' END AS cr_school_year_semester,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Serious' WHEN '2-HIGH' THEN 'Major'
                            WHEN '3-MEDIUM' THEN 'minor' ELSE 'Minor' END AS cr_violation_level,
       CASE o_orderstatus WHEN 'F' THEN 'Resolved' WHEN 'O' THEN 'Ongoing' ELSE 'ONGOING' END AS cr_status,
       o_orderdate AS cr_case_date,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS cr_referred,
       CASE WHEN o_orderkey % 6 = 0 THEN 'Pending' WHEN o_orderkey % 3 = 0 THEN 'Accepted' END AS cr_referral_confirmation,
       concat('case ', cast(o_orderkey AS string)) AS cr_general_description,
       '' AS cr_additional_remarks,
       CASE WHEN o_orderkey % 5 = 0
            THEN concat('[{"filename":"c', cast(o_orderkey AS string), '.pdf","originalname":"c.pdf","mimetype":"application/pdf","size":10,"path":"/u/c.pdf"}]')
       END AS cr_attachments,
       o_orderdate AS cr_create_date,
       CASE WHEN o_orderkey % 7 = 0
            THEN '[{"editedBy":"OPD","editedAt":"2024-01-02T03:04:05.000Z","timestamp":1704164645000}]'
            ELSE '[]' END AS cr_edit_history,
       'OPD' AS cr_sender
FROM {orders}
""",
    "tbl_counseling_records": """
SELECT event_id AS cor_record_id,
       CASE WHEN event_id % 5 = 0 THEN event_id + 1 END AS cor_origin_medical_id,
       CASE WHEN event_id % 5 = 1 THEN event_id + 2 END AS cor_origin_case_id,
       cast(event_id % 4 + 1 AS int) AS cor_session_number,
       {pad:user_id:6} AS cor_student_id_number,
       concat('Customer#', {pad:user_id:9}) AS cor_student_name,
       CASE user_id % 3 WHEN 0 THEN 'STEM' WHEN 1 THEN 'ABM' ELSE 'HUMSS' END AS cor_student_strand,
       CASE WHEN event_id % 2 = 0 THEN '11' ELSE '12' END AS cor_student_grade_level,
       concat('S', cast(user_id % 5 AS string)) AS cor_student_section,
       CASE event_id % 4 WHEN 0 THEN '2023-2024-1' WHEN 1 THEN '2023-2024-2'
                         WHEN 2 THEN '2024-2025-1' ELSE '2024-2025-2' END AS cor_school_year_semester,
       CASE event_type WHEN 'click' THEN 'SCHEDULED' WHEN 'view' THEN 'TO SCHEDULE' ELSE 'DONE' END AS cor_status,
       CASE WHEN event_type <> 'view' THEN ts END AS cor_date,
       CASE WHEN event_type <> 'view' THEN concat(lpad(cast(event_id % 24 AS string), 2, '0'), ':30:00') END AS cor_time,
       concat('concern ', cast(event_id AS string)) AS cor_general_concern,
       '' AS cor_additional_remarks,
       cast(NULL AS string) AS cor_attachments,
       CASE event_id % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'UNCONFIRMED' END AS cor_is_psychological_condition,
       ts AS cor_create_date,
       '[]' AS cor_edit_history
FROM {events}
WHERE event_type IN ('click', 'view', 'signup')
""",
    "tbl_medical_records": """
SELECT o_orderkey * 10 + slot AS mr_medical_id,
       {pad:o_custkey:6} AS mr_student_id,
       concat('Customer#', {pad:o_custkey:9}) AS mr_student_name,
       CASE o_custkey % 3 WHEN 0 THEN 'STEM' WHEN 1 THEN 'ABM' ELSE 'HUMSS' END AS mr_student_strand,
       CASE WHEN o_orderkey % 2 = 0 THEN '11' ELSE '12' END AS mr_grade_level,
       concat('S', cast(o_custkey % 5 AS string)) AS mr_section,
       CASE o_orderkey % 4 WHEN 0 THEN '2023-2024-1' WHEN 1 THEN '2023-2024-2'
                           WHEN 2 THEN '2024-2025-1' ELSE '2024-2025-2' END AS mr_school_year_semester,
       concat('subject ', cast(slot AS string)) AS mr_subject,
       CASE rf WHEN 'A' THEN 'Ongoing' WHEN 'N' THEN 'Treated' ELSE 'For Treatment' END AS mr_status,
       concat('50%_details ', cast(o_orderkey AS string)) AS mr_medical_details,
       '' AS mr_additional_remarks,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS mr_referred,
       CASE WHEN o_orderkey % 6 = 0 THEN 'Accepted' ELSE 'Pending' END AS mr_referral_confirmation,
       CASE WHEN rf = 'A' OR ls = 'O' THEN 'Yes' ELSE 'No' END AS mr_is_psychological,
       CASE WHEN rf = 'A' THEN 'No' ELSE 'Yes' END AS mr_is_medical,
       CASE slot % 5
         WHEN 0 THEN NULL
         WHEN 1 THEN '[]'
         WHEN 2 THEN concat('[{"filename":"OPDMC_f', cast(o_orderkey AS string), '.pdf","originalname":"f', cast(o_orderkey AS string), '.pdf","mimetype":"application/pdf","size":', cast(o_custkey AS string), ',"path":"/u/f.pdf","isMedical":true,"isPsychological":false,"uploadedBy":"OPD","uploadDate":"2024-01-02T03:04:05.000Z"}]')
         WHEN 3 THEN concat('[{"filename":"a', cast(o_orderkey AS string), '.pdf","originalname":"a.pdf","mimetype":"application/pdf","size":1,"path":"/u/a.pdf","isMedical":false,"isPsychological":true,"uploadedBy":"INF"},{"filename":"b', cast(o_orderkey AS string), '.docx","originalname":"","mimetype":"application/msword","size":2,"path":"/u/b.docx","isMedical":true}]')
         ELSE concat('[{"filename":"c', cast(o_orderkey AS string), '.pdf","size":3}]')
       END AS mr_attachments,
       o_orderdate AS mr_record_date,
       o_orderdate AS mr_create_date,
       '[]' AS mr_edit_history,
       'INF' AS mr_sender
FROM (SELECT *, o_orderkey % 7 + 1 AS slot,
             CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS rf,
             CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS ls
      FROM {orders}) AS o
""",
    "tbl_notifications": """
SELECT event_id AS n_id,
       CASE user_id % 2 WHEN 0 THEN 'OPD' ELSE 'GCO' END AS n_sender,
       CASE user_id % 3 WHEN 0 THEN 'OPD' WHEN 1 THEN 'GCO' ELSE 'INF' END AS n_receiver,
       CASE WHEN event_type = 'error' THEN 'OPD Medical Certificate'
            WHEN event_id % 2 = 0 THEN 'Referral' ELSE 'Acceptance' END AS n_type,
       concat('message ', cast(event_id AS string)) AS n_message,
       CASE WHEN event_id % 4 = 0 THEN 'Yes' ELSE 'No' END AS n_is_read,
       ts AS n_created_at,
       event_id AS n_related_record_id,
       CASE WHEN event_type = 'error' THEN 'medical_record' ELSE 'case_record' END AS n_related_record_type
FROM {events}
WHERE event_type IN ('error', 'purchase')
""",
    "users": """
SELECT concat('u', cast(s_suppkey AS string), '@x.test') AS u_email,
       concat('user', cast(s_suppkey AS string)) AS u_username,
       s_name AS u_name,
       CASE s_nationkey % 3 WHEN 0 THEN 'OPD' WHEN 1 THEN 'GCO' ELSE 'INF' END AS u_department,
       CASE WHEN s_suppkey % 10 = 0 THEN 'Administrator' ELSE 'Staff' END AS u_type,
       CASE WHEN s_acctbal < 0 OR s_suppkey % 4 = 1 THEN 'Inactive' ELSE 'Active' END AS u_status,
       {timestamp} '2024-01-01 08:00:00' AS created_at,
       CASE WHEN s_acctbal < 0 OR s_suppkey % 4 = 1 THEN {timestamp} '2024-06-01 15:30:00' END AS deactivated_at
FROM {supplier}
""",
}


_PAD = re.compile(r"\{pad:(\w+):(\d+)\}")


def render(sql: str, names: dict[str, str], timestamp_keyword: str) -> str:
    """Substitute the ``{table}`` and ``{timestamp}`` placeholders."""
    out = _PAD.sub(lambda m: (f"CASE WHEN length(cast({m[1]} AS string)) < {m[2]} "
                              f"THEN lpad(cast({m[1]} AS string), {m[2]}, '0') ELSE cast({m[1]} AS string) END"), sql)
    out = out.replace("{timestamp}", timestamp_keyword)
    for name, target in names.items():
        out = out.replace("{" + name + "}", target)
    return out


def _view_suffix(sf_dir: str) -> str:
    return hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]


def source_views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Register the driver's parquet tables as session views.

    View names carry a hash of the folder, so several scale factors can be
    open in one session. Returns table name -> view name.
    """
    suffix = _view_suffix(sf_dir)
    names = {}
    for table in SOURCE_TABLES:
        view = f"src_{table}_{suffix}"
        if not spark.catalog.tableExists(view):
            spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")) \
                .createOrReplaceTempView(view)
        names[table] = view
    return names


class _LazyTables(dict):
    """Builds (and keeps) a record table's plan on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in FIXTURE_SQL:
            raise KeyError(name)
        names = source_views(self._spark, self._dir)
        df = self._spark.sql(render(FIXTURE_SQL[name], names, "timestamp_ntz"))
        self[name] = df
        return df


_FIXTURE_CACHE: dict = {}


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six record tables derived from the driver parquet in ``sf_dir``.

    Plans are built lazily and reused per session and folder (a DataFrame is
    an immutable plan; nothing is cached in memory).
    """
    key = (id(spark._jsparkSession), os.path.abspath(sf_dir))
    tables = _FIXTURE_CACHE.get(key)
    if tables is None:
        tables = _FIXTURE_CACHE[key] = _LazyTables(spark, sf_dir)
    return tables


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Production loader: ``<root>/<table>`` parquet folders for the six tables.

    Only the columns an operator selects are read (Catalyst prunes the scan).
    """
    return {name: spark.read.parquet(os.path.join(root, name)) for name in RECORD_TABLES}


def load_published_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six tables at their latest published versions under ``root`` (see
    ``sources.snapshots.write_batch``)."""
    from campusledger.sources.snapshots import read_batch_table
    return {name: read_batch_table(spark, root, name) for name in RECORD_TABLES}


# Explicit schemas for writers and for hand-made rows in tests. Types follow
# the column use in the record screens (see README, "Data model").
ATTACHMENT_FIELDS = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("originalname", T.StringType()),
    T.StructField("mimetype", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("isMedical", T.BooleanType()),
    T.StructField("isPsychological", T.BooleanType()),
    T.StructField("uploadedBy", T.StringType()),
    T.StructField("uploadDate", T.StringType()),
])

EDIT_FIELDS = T.StructType([
    T.StructField("editedBy", T.StringType()),
    T.StructField("editedAt", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])


SCHEMAS: dict[str, str] = {
    "tbl_student_data": (
        "sd_id_number string, sd_student_name string, sd_strand string, "
        "sd_grade_level string, sd_section string, sd_gender string, sd_religion string, "
        "sd_previous_school string, sd_status string, sd_birthdate date, "
        "sd_school_year_sem int, sd_school_year_semesterr string"),
    "tbl_case_records": (
        "cr_case_id bigint, cr_student_id string, cr_student_name string, "
        "cr_student_strand string, cr_student_grade_level string, cr_student_section string, "
        "cr_school_year_semester string, cr_violation_level string, cr_status string, "
        "cr_case_date timestamp_ntz, cr_referred string, cr_referral_confirmation string, "
        "cr_general_description string, cr_additional_remarks string, cr_attachments string, "
        "cr_create_date timestamp_ntz, cr_edit_history string, cr_sender string"),
    "tbl_counseling_records": (
        "cor_record_id bigint, cor_origin_medical_id bigint, cor_origin_case_id bigint, "
        "cor_session_number int, cor_student_id_number string, cor_student_name string, "
        "cor_student_strand string, cor_student_grade_level string, cor_student_section string, "
        "cor_school_year_semester string, cor_status string, cor_date timestamp_ntz, "
        "cor_time string, cor_general_concern string, cor_additional_remarks string, "
        "cor_attachments string, cor_is_psychological_condition string, "
        "cor_create_date timestamp_ntz, cor_edit_history string"),
    "tbl_medical_records": (
        "mr_medical_id bigint, mr_student_id string, mr_student_name string, "
        "mr_student_strand string, mr_grade_level string, mr_section string, "
        "mr_school_year_semester string, mr_subject string, mr_status string, "
        "mr_medical_details string, mr_additional_remarks string, mr_referred string, "
        "mr_referral_confirmation string, mr_is_psychological string, mr_is_medical string, "
        "mr_attachments string, mr_record_date timestamp_ntz, mr_create_date timestamp_ntz, "
        "mr_edit_history string, mr_sender string"),
    "tbl_notifications": (
        "n_id bigint, n_sender string, n_receiver string, n_type string, n_message string, "
        "n_is_read string, n_created_at timestamp_ntz, n_related_record_id bigint, "
        "n_related_record_type string"),
    "users": (
        "u_email string, u_username string, u_name string, u_department string, "
        "u_type string, u_status string, created_at timestamp_ntz, deactivated_at timestamp_ntz"),
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A zero-row table with the record schema (used for empty-input checks)."""
    return spark.createDataFrame([], SCHEMAS[name])
