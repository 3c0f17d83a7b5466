import zlib

from llm_fixtures import prose

from campusledger.llm import toxicity as t
from campusledger.llm.common import read_table

BAD = ["grumblewort", "snarkfiend", "vexmonger", "louthollow"]


def rows(n):
    out = []
    for i in range(n):
        words = prose(i, 90).split(" ")
        if i % 4 == 0:
            for k in range(4):
                words.insert(7 + 20 * k, BAD[(i // 4 + k) % 4])
        out.append((i, " ".join(words)))
    return out


def test_learns_planted_words(spark, make_docs):
    docs = make_docs(rows(400))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(400)] + [(9999, 1, 1, "x"), (5, 1, None, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    model = t.fit_from_tables(docs, labels)
    out = {r["doc_id"]: r for r in t.score_documents(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r["held_out"]} == set(held)
    right = sum(out[i]["predicted"] == (i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    out = {r["doc_id"]: r for r in t.score_documents(docs, t.fit_from_tables(docs, labels)).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [d for d in truth if out[d]["held_out"]]
    toxic = [d for d in held if truth[d]]
    assert sum(out[d]["predicted"] for d in toxic) >= 0.6 * len(toxic)
    clean = [d for d in held if not truth[d]]
    assert sum(out[d]["predicted"] for d in clean) <= 0.01 * len(clean)


def test_edges(spark, make_docs, edge_rows):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = t.fit_from_tables(make_docs(rows(200)), labels)
    out = t.score_documents(make_docs(edge_rows), model).collect()
    assert len(out) == len(edge_rows)
    assert all(r["predicted"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert len({r["score"] for r in out if r["doc_id"] == 6}) == 1
    assert t.score_documents(make_docs([]), model).collect() == []
    # nothing to learn from, one class only
    none = t.fit_from_tables(make_docs([]), labels)
    assert {r["score"] for r in t.score_documents(make_docs(edge_rows), none).collect()} == {0.0}
    assert t.fit([("a b c", 1)] * 5).scores(model.counts("x")[None])[0] == 1.0


def test_tiny_samples_still_train():
    model = t.fit([("you grumblewort", 1), ("a grumblewort", 1), ("fine words", 0), ("more words", 0)])
    assert 0 <= model.scores(model.counts("grumblewort")[None])[0] <= 1
