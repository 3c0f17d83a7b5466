"""File sources: import files and the stored case files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited student file with a header row (O3).

    Every column stays text (no inference); header names keep their case and
    spaces (normalised later by ``map_csv_rows``); blank cells read as NULL.
    Quotes inside a quoted cell are doubled, and a quoted cell may hold line
    breaks, so a file is read by one task (uploads are limited to 10 MiB; a
    folder of them is read in parallel). All files share one header. Of headers that
    are equal (ignoring case) the last counts, as in the upload screen's row objects.
    ``pos`` orders rows as in the file(s): file path, then the row's place
    (``monotonically_increasing_id`` increases within a task).
    """
    reader = (spark.read.option("inferSchema", False).option("multiLine", True)
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))
    df = reader.option("header", True).csv(path)
    # Spark numbers headers that are equal (ignoring case) by their place; the header
    # row itself tells them from a header that ends in a digit. The last one keeps the name.
    header = reader.option("header", False).csv(path).first() or ()     # one row
    written = [h if h is not None else "" for h in header] + [""] * (len(df.columns) - len(header))
    repeated = {i for i, (c, h) in enumerate(zip(df.columns, written)) if h and c == f"{h}{i}"}
    if not repeated and all(written):   # then files whose headers differ are an error, not mixed up by position
        df = reader.option("header", True).option("enforceSchema", False).csv(path)
    plain = [h if i in repeated else c for i, (c, h) in enumerate(zip(df.columns, written))]
    last = {plain[i].lower(): i for i in sorted(repeated)}
    meta = F.col("_metadata")
    named = [F.col(f"`{c}`").alias(plain[i]) if i in repeated else F.col(f"`{c}`")
             for i, c in enumerate(df.columns) if i not in repeated or last[plain[i].lower()] == i]
    return (df.select(*named, meta).withColumn("_file", meta["file_path"])
            .withColumn("_block", meta["file_block_start"])
            .withColumn("_row", F.monotonically_increasing_id())
            .withColumn("pos", F.struct("_file", "_block", "_row"))
            .drop("_file", "_block", "_row", "_metadata"))


def read_import_cells(cells: DataFrame, row_no: str = "row_no",
                      cells_col: str = "cells") -> tuple[list[str], DataFrame]:
    """A sheet given as raw cells, one ``array<string>`` per row.

    The first row is the header; blank rows are dropped; fewer than two rows
    gives no data. Only the header row (one row) reaches the driver, to
    resolve column positions; data rows stay distributed.
    Returns ``(headers, rows)`` where rows carry ``pos`` and the cells.
    """
    non_blank = cells.where(F.exists(F.col(cells_col),
                                     lambda c: F.coalesce(c, F.lit("")) != ""))
    first = non_blank.orderBy(row_no).select(cells_col).take(1)
    if not first:
        return [], non_blank.where(F.lit(False)).select(F.col(row_no).alias("pos"), cells_col)
    headers = [h if h is not None else "" for h in first[0][0]]
    header_no = non_blank.agg(F.min(row_no)).scalar()
    rows = non_blank.where(F.col(row_no) > header_no).select(F.col(row_no).alias("pos"), cells_col)
    return headers, rows


def list_case_files(spark: SparkSession, directory: str, case_id) -> DataFrame:
    """Stored files of one case: names ``<caseId>_<ms>_<original>``.

    Reads only file metadata (path, length, modification time); the content
    column is pruned, so no file body is read.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", f"{case_id}_*")
          .load(directory).select("path", "length", "modificationTime"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select(
        name.alias("fileName"),
        F.substring(name, F.length(F.substring_index(name, "_", 2)) + 2, 1 << 30)
        .alias("originalName"),
        F.concat(F.lit("/uploads/case-files/"), name).alias("filePath"),
        F.col("length").alias("fileSize"),
        F.col("modificationTime").alias("uploadDate"))
