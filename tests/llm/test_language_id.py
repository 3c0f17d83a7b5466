import zlib

import numpy as np

from campusledger.llm import language_id as lid
from campusledger.llm.common import read_table


def slow_bundle(text):
    q = " "
    for c in text.lower():
        q += c if c.isalpha() else (" " if q[-1] != " " else "")
    q = q if q[-1] == " " else q + " "
    v = np.zeros(lid.DIMENSIONS)
    if q.strip():
        for i in range(len(q) - 2):
            v += (np.roll(lid.letter_vector(ord(q[i])), 2) * np.roll(lid.letter_vector(ord(q[i + 1])), 1)
                  * lid.letter_vector(ord(q[i + 2])))
    return v


def test_bundles_equal_the_definition(monkeypatch):
    samples = ["Hello, wörld 12!", "", "123 !?", "a", "İß x", "日本語 text", "ab " * 50]
    want = np.stack([slow_bundle(t) for t in samples])
    assert np.array_equal(lid.bundles(samples), want)
    monkeypatch.setattr(lid, "_CHUNK_CODES", 7)
    monkeypatch.setattr(lid, "_CHUNK_GRAMS", 5)
    assert np.array_equal(lid.bundles(samples), want)


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = {r["doc_id"]: r for r in lid.predict(docs, lid.train(docs)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(out) == set(truth)
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in out.items() if r["held_out"]} == set(held)
    assert sum(out[d]["lang_pred"] == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_edges(make_docs, edge_rows):
    train = [(100 + i, "the cat and the dog of the house", "en") for i in range(8)]
    train += [(200 + i, "el gato y el perro de la casa", "es") for i in range(8)] + [(300, None, "fr"), (301, "xx", None)]
    model = lid.train(make_docs(train))
    assert sorted(model) == ["en", "es"]
    out = lid.predict(make_docs(edge_rows + [(50, "the dog"), (51, "la casa"), (52, "12 34")]), model).collect()
    assert len(out) == len(edge_rows) + 3
    by = {r["doc_id"]: r for r in out}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (1, 2, 3, 8, 52))
    assert (by[50]["lang_pred"], by[51]["lang_pred"]) == ("en", "es")
    nothing = lid.predict(make_docs(edge_rows), lid.train(make_docs([]))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert lid.predict(make_docs([]), model).collect() == []
