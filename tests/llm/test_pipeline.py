import os
import random
import shutil
import subprocess
import sys
import tempfile

import pytest
from llm_fixtures import prose
from test_line_dedup import brute as line_brute
from test_minmax_dedup import brute as near_brute

import corpus_pipeline
from campusledger.llm import decontaminate, packing, toxicity
from campusledger.llm.common import read_table, stored

BAD = ["grumblewort", "snarkfiend", "vexmonger", "louthollow"]
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def sf_dir(spark):
    r = random.Random(21)
    folder = tempfile.mkdtemp(prefix="campusledger-pipeline-")
    items = [prose(5000 + i, 30) for i in range(3)]
    shared = [prose(6000 + i, 14).replace("\n", " ") for i in range(6)]
    rows = []
    for i in range(240):
        lines = [prose(i * 7 + k, 25).replace("\n", " ") for k in range(4)]
        if i % 5 == 0:
            lines.insert(r.randrange(4), r.choice(shared))
        if i % 4 == 0:
            lines = [x.replace(" ", f" {BAD[(i // 4 + k) % 4]} ", 1) for k, x in enumerate(lines)]
        if i % 30 == 7:
            lines.insert(1, items[i % 3].replace("\n", " "))
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows += [(1000 + i, rows[2 * i + 1][1] + f"\nown ending number {i} of this copy here", "en", "s") for i in range(10)]
    rows += [(2000, None, None, None), (2001, "", "en", "s"), (2002, "\n\n", "en", "s"), (2003, "single", None, "s"),
             (2004, prose(99, 9000), "en", "s"), (1, rows[1][1], "en", "s1")]
    full = [(*x, len(x[1]) if x[1] is not None else None) for x in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def as_rows(df):
    return sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = as_rows(docs)
        docs = stored(stage(spark, docs, sf_dir), "test-stage")
        seen[name] = before
        if name == "toxicity":
            model = toxicity.fit_from_tables(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
            want = [(d, t) for d, t in before if model.scores(model.counts(t or "")[None])[0] < toxicity.REJECT_SCORE]
            gone = {d for d, _ in before} - {d for d, _ in want}
            assert len(gone & set(range(0, 240, 4))) >= 50 and len(gone - set(range(0, 240, 4))) <= 3
        elif name == "line_dedup":
            classes, want = line_brute(before), []
            for d, t in before:
                if t is None or not any(c != (a, n) for (a, n), c in classes.items() if a == d):
                    want.append((d, t))
                    continue
                left = "\n".join(x for n, x in enumerate(t.split("\n")) if classes.get((d, n), (d, n)) == (d, n))
                if left.strip():
                    want.append((d, left))
            assert want != before
        elif name == "near_dedup":
            kept = {d for d, (_, c) in near_brute(before).items() if d == c}
            want = sorted({(d, t) for d, t in before if d in kept}, key=str)
            assert len(want) < len(before)
        elif name == "decontamination":
            items = [decontaminate.plain(x["text"]).strip() for x in read_table(spark, sf_dir, "benchmark").collect()]
            want = [(d, t) for d, t in before if not any(i in decontaminate.plain(t or "") for i in items)]
            assert len(want) < len(before)
        else:
            tokens = packing.WordTokenizer()
            want = {d: len(b) // 4 + 1 for (d, _), b in zip(before, tokens.encode([t or "" for _, t in before]))}
            got = {}
            for x in docs.collect():
                got[x["doc_id"]] = got.get(x["doc_id"], 0) + x["length"]
            assert got == want
            break
        assert docs.columns == columns
        assert as_rows(docs) == sorted(want, key=str), name
    assert list(seen) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_near_dedup_links_at_four_fifths(spark, make_docs):
    """Similarity 176 / 216 = 0.81 is a link, 166 / 226 = 0.73 is none."""
    base = [f"word{i}" for i in range(200)]

    def changed(places, name):
        return " ".join(f"{name}{i}" if i in places else w for i, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, changed({20, 60, 100, 140}, "x")), (3, changed({30, 50, 70, 90, 110, 130}, "y"))]
    kept = corpus_pipeline.near_dedup(spark, make_docs(rows), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3]


def test_run_returns_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, tmp_dir):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).collect() == []


def test_registered_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)


def test_the_rest_works_without_this_part(tmp_dir):
    copy = os.path.join(tmp_dir, "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                          cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 107 and int(said[1]) >= 107
