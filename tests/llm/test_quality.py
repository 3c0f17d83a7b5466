import re
from collections import Counter

import duckdb
import pytest

from campusledger.llm import quality as q
from llm_fixtures import prose


SMALL = "/root/testdata/sf0.001"


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(make_docs, edge_rows):
    rows = edge_rows + [(20, "a b c a b c"), (21, "a b c a b c a b c x a b"), (22, "x\nx\n\n \ny\nx"), (23, "a #$ | b & <c>\x0bd"),
                        (24, "é ü 日本 é ü 日本"), (25, "a a a a")]
    got = q.with_base_rule(q.document_counts(make_docs(rows))).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *counts(r[1])) for r in rows)
    assert Counter((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
                   for x in got) == want
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])


def test_host_verdict_shrinks_small_hosts(make_docs):
    rows = [(i, prose(i, 60), "en", f"good{i % 30}") for i in range(300)]
    rows += [(1000 + i, "short", "en", "bad") for i in range(60)] + [(2000 + i, prose(i, 60), "en", "bad") for i in range(3)]
    rows += [(3000, "short", "en", "single"), (3001, prose(9, 70), "en", None)]
    out = {x["doc_id"]: x for x in q.quality_rules(make_docs(rows)).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["kept"] for i in range(300))
    assert not any(out[2000 + i]["kept"] for i in range(3)) and not out[2000]["base_failed"]
    assert not out[3000]["kept"] and out[3001]["kept"] and out[3001]["host_docs"] is None
    v = {x["host"]: x for x in q.host_verdicts(q.with_base_rule(q.document_counts(make_docs(rows)))).collect()}
    assert v["bad"]["host_rejected"] and 0 < v["single"]["host_rate"] < 1


def test_no_python_in_the_plan(make_docs, capsys):
    q.quality_rules(make_docs([(1, "a")])).explain()
    q.with_base_rule(q.document_counts(make_docs([(1, "a")]))).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_empty_table(make_docs):
    assert q.quality_rules(make_docs([])).collect() == []


@pytest.mark.parametrize("name", ["documents"])
def test_sql_twin(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(q.ORACLE_SQL)
    got = q.quality_rules(spark.read.parquet(f"{SMALL}/{name}.parquet"))
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
