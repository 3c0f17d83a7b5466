"""Searches for ``%text%`` through a table of trigrams.

``write_postings`` stores, for the searched columns of a table, which row (by its key)
holds which three characters, lower-cased: one row per (gram, column, key), never a
list, so a gram that a third of all rows hold spreads over files like any other. The
folder is partitioned by a hash of the gram, and its files are sorted by gram.

A search reads the rows of the pattern's grams only, keeps the keys that have all of
them in one column, reads those rows of the table, and applies the plain search to
them. So results are those of the plain search; a pattern without three literal
characters in a row narrows nothing and reads the table as before.

After a batch ``add_postings`` adds those of the new and changed rows. Postings of
deleted or changed values stay behind and do no harm: every candidate is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusledger.operators import filters as Fl
from campusledger.functions.semantics import contains_pattern, escape_like
from campusledger.sources.clustered import Layout, _live, _plain, part_of

GRAM = 3
BUCKETS = 256               # folders of a posting table
FEW = 1_000                 # candidates that are pushed to the scan one by one

# Table -> (key, searched columns); students and accounts are found by their text key.
SEARCHES = {
    "tbl_case_records": ("cr_case_id", Fl.CASE_SEARCH),
    "tbl_counseling_records": ("cor_record_id", Fl.COUNSELING_SEARCH),
    "tbl_student_data": ("sd_id_number", Fl.STUDENT_SEARCH),
    "users": ("u_email", Fl.USER_SEARCH),
    "tbl_medical_records": ("mr_medical_id", tuple(dict.fromkeys(Fl.MEDICAL_SEARCH + Fl.MEDICAL_REFERRED_SEARCH))),
}


def grams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text."""
    def runs(low):      # lower-cased once, not once for each place
        places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1))
        return F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))

    return F.coalesce(F.array_distinct(F.get(F.transform(F.array(F.lower(text)), runs), F.lit(0))),
                      F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def postings(table: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """gram, col (place in ``columns``), key, bucket: one row for each."""
    each = F.array(*(F.struct(F.lit(i).alias("col"), grams(F.col(c).cast("string")).alias("grams"))
                     for i, c in enumerate(columns)))
    # the searched columns alone are dealt first: a table of few row groups would keep few tasks busy
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = table.select(*dict.fromkeys((key, *columns))).repartition(tasks, *dict.fromkeys((key, *columns)))
    rows = searched.select(F.col(key).alias("key"), F.explode(each).alias("e"))
    rows = rows.select(F.explode("e.grams").alias("gram"), F.col("e.col").alias("col"), "key")
    return rows.withColumn("bucket", _bucket(F.col("gram")))


def _save(rows: DataFrame, path: str, mode: str) -> None:
    # by bucket, large ones split and small ones put together: no pass for ranges, and a task's rows do not grow with the table
    order = ["bucket", "gram", "col", "key"]
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions(*order)
    rows.write.mode(mode).partitionBy("bucket").parquet(path)


def write_postings(table: DataFrame, key: str, columns: tuple[str, ...], path: str) -> None:
    """Write the posting table (``path`` must not exist)."""
    _save(postings(table, key, columns), path, "errorifexists")


def add_postings(changed: DataFrame, key: str, columns: tuple[str, ...], path: str) -> None:
    """Add the postings of new and changed rows."""
    _save(postings(changed, key, columns), path, "append")


def literal_runs(pattern: str) -> list[str]:
    """The literal parts of a LIKE pattern, between its wildcards (``\\`` escapes)."""
    runs, run, escaped = [], "", False
    for c in pattern:
        if escaped:
            run, escaped = run + c, False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
    return [r for r in (*runs, run) if r]


def candidates(spark: SparkSession, path: str, pattern: str, columns: int) -> DataFrame | None:
    """The keys whose rows hold all grams of ``pattern`` in one of the first ``columns`` columns; ``None`` if it has no gram."""
    runs = literal_runs(pattern)
    if not any(len(r) >= GRAM for r in runs):
        return None
    asked = spark.createDataFrame([(r,) for r in runs], "run string").select(F.explode(grams(F.col("run"))).alias("gram"))
    asked = [tuple(r) for r in asked.distinct().select("gram", _bucket(F.col("gram"))).collect()]     # those of one pattern
    rows = spark.read.parquet(path).where(F.col("bucket").isin(sorted({b for _, b in asked}))
                                          & F.col("gram").isin([g for g, _ in asked]) & (F.col("col") < columns))
    full = rows.groupBy("key", "col").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(asked))
    return full.select("key").distinct()


def narrowed(table: DataFrame, key: str, found: DataFrame | None) -> DataFrame:
    """The rows of the candidate keys; all of them if there is nothing to go by."""
    if found is None:
        return table
    return table.join(found.select(F.col("key").alias(key)), key, "left_semi").select(table.columns)


def narrowed_parts(spark: SparkSession, path: str, layout: Layout, found: DataFrame | None) -> DataFrame:
    """The candidate rows of a clustered table: only their parts are read, and of few candidates only their row groups."""
    rows = _live(spark, path)
    if found is None:
        return _plain(rows)
    found = found.select(F.col("key").alias(layout.key), part_of(layout, F.col("key")).alias("_part"))
    some = found.limit(FEW + 1).collect()
    if len(some) <= FEW:
        column = f"_k_{layout.key}" if layout.text else layout.key
        keys = sorted({str(r[0]).lower() if layout.text else r[0] for r in some if r[0] is not None})
        return _plain(rows.where(F.col("_part").isin(sorted({r[1] for r in some})) & F.col(column).isin(keys)))
    parts = [r[0] for r in found.select("_part").distinct().collect()]      # at most the number of parts
    rows = rows.where(F.col("_part").isin(parts))
    return _plain(rows.join(found.select(layout.key), layout.key, "left_semi").select(rows.columns))


def _pattern(text: str, literal: bool) -> str:
    return contains_pattern(escape_like(text) if literal else text)


def search_through(spark: SparkSession, name: str, text: str, postings_path: str, rows_of, **settings) -> DataFrame:
    """The search screen of table ``name`` over the rows that ``rows_of(candidates)`` gives.

    Same rows and order as the plain search; ``settings`` are those of the screen
    (``referred``, ``kind``).
    """
    key, columns = SEARCHES[name]
    medical = name == "tbl_medical_records"
    if text is None or (medical and text.strip() == ""):
        raise ValueError("search text is required")
    width = len(columns)
    rows = rows_of(candidates(spark, postings_path, _pattern(text, medical), width))
    screen = {"tbl_case_records": Fl.case_search, "tbl_counseling_records": Fl.counseling_search,
              "tbl_student_data": Fl.student_search, "users": Fl.user_search,
              "tbl_medical_records": Fl.medical_search}[name]
    return screen(rows, text, **settings)
