"""Sources and sinks."""

import os

from pyspark.sql import functions as F

from campusledger.operators import kpis
from campusledger.sources import jdbc, snapshots
from campusledger.sources.files import list_case_files, read_import_csv


def test_jdbc_options():
    opts = jdbc.jdbc_options(jdbc.jdbc_url("db", 3306, "records"), "tbl_case_records",
                             user="u", password="p", partition_column="cr_case_id",
                             lower_bound=1, upper_bound=1000, num_partitions=8)
    assert opts["url"].startswith("jdbc:mysql://db:3306/records")
    assert opts["partitionColumn"] == "cr_case_id" and opts["numPartitions"] == "8"
    assert opts["queryTimeout"] == "60"
    assert "connectTimeout=60000" in opts["url"]
    auto = jdbc.jdbc_options("jdbc:mysql://db/x", "tbl_notifications", lower_bound=1,
                             upper_bound=9, num_partitions=2)
    assert auto["partitionColumn"] == "n_id"


def test_jdbc_ranges_part_text_keys():
    """Checked on an in-process engine: disjoint, complete with NULL keys, even on a skewed table."""
    import random

    import duckdb
    r = random.Random(1)
    keys = [None] * 7 + ["hot"] * 300 + ["O'Neil\\x", "", "Z"] + ["%06d" % (r.randrange(1000) ** 2) for _ in range(700)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in keys])
    sample = [x[0] for x in con.execute("SELECT k FROM t WHERE k IS NOT NULL ORDER BY k").fetchall()]
    for parts in (1, 2, 5, 8, 2000):
        predicates = jdbc.range_predicates("k", jdbc.boundaries(sample, parts))
        plain = [p.replace("\\\\", "\\") for p in predicates]      # this engine does not escape backslashes
        counts = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in plain]
        assert sum(counts) == len(keys) and len(predicates) <= parts
        together = " + ".join(f"CAST(coalesce({p}, false) AS INTEGER)" for p in plain)
        assert con.execute(f"SELECT count(*) FROM t WHERE {together} <> 1").fetchone()[0] == 0
        if parts == 8:
            assert max(counts) <= 300 + len(keys) // 8 + 10 and sorted(counts)[-2] <= 2 * len(keys) // 8
    assert jdbc.range_predicates("k", []) == ["1 = 1"] and jdbc.boundaries([], 4) == []
    assert jdbc.boundaries(["a"] * 10, 4) == [] and jdbc.boundaries(list("abcdefgh"), 4) == ["c", "e", "g"]
    assert jdbc.text_literal("O'Neil\\") == "'O''Neil\\\\'"


def test_snapshot_versions(spark, tmp_dir):
    root = os.path.join(tmp_dir, "cases")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    v1 = snapshots.write_snapshot(df, root)
    assert snapshots.read_snapshot(spark, root).count() == 5
    v2 = snapshots.write_snapshot(df.where("id < 2"), root)
    assert v1 != v2 and snapshots.current_version(spark, root) == v2
    assert snapshots.read_snapshot(spark, root).count() == 2
    broot = os.path.join(tmp_dir, "batch")
    first = snapshots.write_batch({"a": df, "b": df.limit(1)}, broot)
    assert set(first) == {"a", "b"}
    second = snapshots.write_batch({"b": df.limit(3)}, broot)
    assert second["a"] == first["a"] and second["b"] != first["b"]     # a is carried over
    assert snapshots.read_batch_table(spark, broot, "a").count() == 5
    assert snapshots.read_batch_table(spark, broot, "b").count() == 3


def test_case_file_listing(spark, tmp_dir):
    for name in ["7_1700000000000_report_final.pdf", "7_1700000000001_x.docx",
                 "77_1700000000000_other.pdf"]:
        with open(os.path.join(tmp_dir, name), "wb") as fh:
            fh.write(b"abc")
    rows = {r.fileName: r for r in list_case_files(spark, tmp_dir, 7).collect()}
    assert set(rows) == {"7_1700000000000_report_final.pdf", "7_1700000000001_x.docx"}
    r = rows["7_1700000000000_report_final.pdf"]
    assert r.originalName == "report_final.pdf" and r.fileSize == 3
    assert r.filePath == "/uploads/case-files/7_1700000000000_report_final.pdf"


def test_load_published_tables(spark, tables, tmp_dir):
    from campusledger.sources.tables import RECORD_TABLES, load_published_tables
    root = os.path.join(tmp_dir, "pub")
    snapshots.write_batch({name: tables[name] for name in RECORD_TABLES}, root)
    loaded = load_published_tables(spark, root)
    assert set(loaded) == set(RECORD_TABLES)
    assert loaded["users"].count() == tables["users"].count()
    assert kpis.case_totals(loaded["tbl_case_records"]).first() == \
        kpis.case_totals(tables["tbl_case_records"]).first()


def test_headers_that_end_in_a_digit_are_not_repeated(spark, tmp_dir):
    def read(name, text):
        path = os.path.join(tmp_dir, name)
        with open(path, "w") as fh:
            fh.write(text)
        df = read_import_csv(spark, path).drop("pos")
        return df.columns, [tuple(r) for r in df.collect()]

    assert read("a.csv", "Section,Section1,ID\ns,t,1\n") == (["Section", "Section1", "ID"], [("s", "t", "1")])
    assert read("b.csv", "ID,Name,Name\n1,a,b\n") == (["ID", "Name"], [("1", "b")])
    assert read("c.csv", "ID,Name,Name,Name1,Name1\n1,a,b,c,d\n") == (["ID", "Name", "Name1"], [("1", "b", "d")])
    assert read("d.csv", "Id,x,ID\n1,a,2\n") == (["x", "ID"], [("a", "2")])
    assert read("e.csv", "Section0,b\ns,t\n") == (["Section0", "b"], [("s", "t")])
    assert read("f.csv", "A,,B\n1,2,3\n")[1] == [("1", "2", "3")]
