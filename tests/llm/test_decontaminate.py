import random

import pytest
from llm_fixtures import prose

from campusledger.llm import decontaminate as d


def edits(item, text):
    """Fewest edits of ``item`` against any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def damaged(text, r, n):
    for _ in range(n):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1:], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1:]])
    return text


def test_myers_against_the_table():
    r = random.Random(2)
    for _ in range(200):
        item = "".join(r.choice("ab c") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("ab c") for _ in range(r.randint(0, 60)))
        got = d.myers(item, text, len(item))
        assert (got[0] if got else len(item)) == edits(item, text)


def test_pieces_cover_the_item():
    for n, k in ((1, 0), (10, 3), (7, 6)):
        item = "x" * n
        assert "".join(p for _, p in d.pieces(item, k)) == item and len(d.pieces(item, k)) == k + 1


@pytest.mark.parametrize("block_chars", [10**6, 300])
def test_against_brute_force(spark, make_docs, block_chars):
    r = random.Random(4)
    items = [(i, prose(900 + i, 20 + i)) for i in range(6)] + [(50, None), (51, "  "), (52, prose(900, 20)), (53, "tiny")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    rows = []
    for i in range(40):
        host = prose(i, 60)
        if i % 2:
            at = r.randrange(len(host))
            host = host[:at] + " " + damaged(items[i % 6][1].upper(), r, i % 12) + " " + host[at:]
        rows.append((i, host))
    rows += [(100, None), (101, ""), (102, items[2][1] * 40), (102, items[2][1] * 40)]
    out = d.contaminated(make_docs(rows), bench, block_chars=block_chars).collect()
    got = sorted((x["doc_id"], x["item_id"], x["edits"]) for x in out)
    want = []
    for doc, t in rows:
        for i, item in items:
            q = d.plain(item or "").strip()
            if q and t:
                e = edits(q, d.plain(t))
                if e <= int(len(q) * d.ERROR_RATE):
                    want.append((doc, i, e))
    assert got == sorted(want) and len(want) > 10
    for x in out:
        if x["edits"] == 0:
            t = dict(rows)[x["doc_id"]]
            assert d.plain(t[x["start"]:x["end"]]) == d.plain(dict(items)[x["item_id"]]).strip()


def test_dropping(spark, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = make_docs([(1, "x alpha beta\ngamma  delta epsilon y"), (2, "clean"), (3, None), (None, "clean too")])
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {2, 3, None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, none).collect() == []
    assert d.contaminated(make_docs([]), bench).collect() == []
