"""Relational source (O2): the record tables straight from the operational
database, read in parallel.

Connection settings come from the caller (or environment variables the
deployment defines); nothing is hard-coded. A numeric ``partition_column``
with bounds splits the scan into ``num_partitions`` range queries; filters and
column lists Spark can push are sent to the database.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# The pool's timeouts in the source system, in milliseconds.
CONNECT_TIMEOUT_MS = 60000
QUERY_TIMEOUT_MS = 60000

# Partition columns per table (numeric ids); students have none, so they are
# read in one query or through ``predicates``.
PARTITION_COLUMNS = {
    "tbl_case_records": "cr_case_id",
    "tbl_counseling_records": "cor_record_id",
    "tbl_medical_records": "mr_medical_id",
    "tbl_notifications": "n_id",
}


def jdbc_url(host: str | None = None, port: int | str | None = None,
             database: str | None = None) -> str:
    host = host or os.environ.get("DB_HOST", "localhost")
    port = port or os.environ.get("DB_PORT", "3306")
    database = database or os.environ.get("DB_NAME", "")
    return f"jdbc:mysql://{host}:{port}/{database}?connectTimeout={CONNECT_TIMEOUT_MS}"


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower_bound: int | None = None,
                 upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10000) -> dict[str, str]:
    """Reader options for one table; partitioned when a column and bounds are given."""
    opts = {
        "url": url,
        "dbtable": table,
        "fetchsize": str(fetch_size),
        "queryTimeout": str(QUERY_TIMEOUT_MS // 1000),
        "pushDownPredicate": "true",
        "pushDownAggregate": "true",
        "pushDownLimit": "true",
    }
    user = user if user is not None else os.environ.get("DB_USER")
    password = password if password is not None else os.environ.get("DB_PASSWORD")
    if user:
        opts["user"] = user
    if password:
        opts["password"] = password
    if partition_column is None and lower_bound is not None:
        partition_column = PARTITION_COLUMNS.get(table)
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned reads need lower_bound, upper_bound, num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return opts


# Text keys of the tables without a numeric id, and how many keys are sampled to part one.
KEY_COLUMNS = {"tbl_student_data": "sd_id_number", "users": "u_email"}
SAMPLE_KEYS = 10_000


def text_literal(value: str) -> str:
    """A text as an SQL literal of the database (quotes doubled, backslashes escaped)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"


def boundaries(sample: list[str], parts: int) -> list[str]:
    """At most ``parts - 1`` keys that cut a sample, sorted by the database, into even ranges.

    A key that fills several ranges is one boundary: rows of one key stay together.
    """
    found: list[str] = []
    for i in range(1, parts):
        at = len(sample) * i // parts
        if at < len(sample) and sample[at] not in found and sample[at] != sample[0]:
            found.append(sample[at])
    return found


def range_predicates(key: str, cuts: list[str]) -> list[str]:
    """Disjoint conditions on the indexed ``key`` that cover the table; rows without a key go with the first."""
    if not cuts:
        return ["1 = 1"]
    text = [text_literal(c) for c in cuts]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(text, text[1:])]
    return [f"{key} < {text[0]} OR {key} IS NULL", *inner, f"{key} >= {text[-1]}"]


def sample_query(table: str, key: str, share: float) -> str:
    """A derived table of about ``share`` of the keys, read from the key's index."""
    return f"(SELECT {key} AS k FROM {table} WHERE {key} IS NOT NULL AND RAND() < {share:.9f}) AS sampled"


def key_predicates(spark: SparkSession, url: str, table: str, parts: int, **kw) -> list[str]:
    """Range conditions that part a table with a text key evenly, from quantiles of its keys.

    Two index scans in the database: the number of keys and a sample of about
    ``SAMPLE_KEYS``, sorted by the database, whose order the ranges must follow.
    """
    key = KEY_COLUMNS[table]
    properties = {k: v for k, v in jdbc_options(url, table, **kw).items() if k not in ("url", "dbtable")}

    def ask(query: str) -> list:
        return [r[0] for r in spark.read.jdbc(url, query, properties=properties).collect()]     # bounded

    n = ask(f"(SELECT COUNT({key}) AS n FROM {table}) AS counted")[0]
    share = min(1.0, SAMPLE_KEYS / max(1, int(n)))
    inner = sample_query(table, key, share)
    # LIMIT makes the database keep the order of the derived table
    sample = ask(f"(SELECT k FROM {inner} ORDER BY k LIMIT {4 * SAMPLE_KEYS}) AS sorted")
    return range_predicates(key, boundaries(sample, parts))


def load_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None,
              num_partitions: int | None = None, **kw) -> DataFrame:
    """One table by JDBC, read in parallel.

    Tables with a numeric id take its bounds (see ``jdbc_options``); students
    and users are parted by ``predicates``, one task each, made from quantiles of
    their key when only ``num_partitions`` is given. Each task reads one range of the
    key's index.
    """
    if predicates is None and num_partitions and table in KEY_COLUMNS:
        predicates = key_predicates(spark, url, table, num_partitions, **kw)
    if predicates is None:
        opts = jdbc_options(url, table, num_partitions=num_partitions, **kw)
        return spark.read.format("jdbc").options(**opts).load()
    properties = {k: v for k, v in jdbc_options(url, table, **kw).items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
