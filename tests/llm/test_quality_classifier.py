import random
import zlib

import numpy as np
import pytest

from campusledger.llm import quality_classifier as q
from llm_fixtures import prose

COLUMNS = ["doc_id", "held_out", "score", "predicted"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def junk(seed, words):
    r = random.Random(seed)
    text = prose(seed, words)
    kind = seed % 3
    if kind == 0:
        return " | ".join(text.split())
    if kind == 1:
        return " ".join([prose(seed, 6)] * (words // 6))
    return " ".join(w.upper() + r.choice(["!!", "$$$", "###"]) for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    good = [(i, prose(i, 60 + i % 200)) for i in range(300)]
    bad = [(1000 + i, junk(i, 60 + i % 90)) for i in range(150)]
    return good + bad


@pytest.fixture(scope="module")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, shard int")
    return make


def scored(docs, labels):
    out = q.score_quality(docs, q.train(docs, labels))
    assert out.columns == COLUMNS
    return out.collect()


def test_held_out_accuracy(make_docs, labels, corpus):
    known = labels([(d, int(d < 1000), 0, "x", 1) for d, _ in corpus] + [(5, 2, 0, "x", 1), (6, None, 0, "x", 1)])
    rows = scored(make_docs(corpus), known)
    assert len(rows) == len(corpus)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    test = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] < 1000) for r in test)
    assert len(test) > 60 and right >= 0.95 * len(test)


def test_held_out_labels_are_never_read(make_docs, labels, corpus):
    docs = make_docs(corpus)
    one = q.train(docs, labels([(d, int(d < 1000), 0, "x", 1) for d, _ in corpus]), rounds=1)
    two = q.train(docs, labels([(d, int(d < 1000) if not held(d) else int(d >= 1000), 1, "y", 2) for d, _ in corpus]), rounds=1)
    assert np.array_equal(one, two)
    assert np.any(one)


def test_one_shard_equals_plain_updates(make_docs, labels, corpus):
    """Brute force: the same documents, one after the other, in one loop."""
    docs, known = make_docs(corpus), labels([(d, int(d < 1000), 0, "x", 1) for d, _ in corpus])
    order = [r["doc_id"] for r in q.draw(docs, known).selectExpr("doc_id", "xxhash64(xxhash64(doc_id)) h")
             .orderBy("h", "doc_id").collect()]
    assert sorted(order) == sorted(d for d, _ in corpus if not held(d))
    found, leader = dict(corpus), q.Leader()
    for _ in range(2):
        for d in order:
            leader.update(*q.features(found[d]), int(d < 1000))
    assert np.allclose(q.train(docs, known, rounds=2), leader.weights())


def test_shards_are_averaged(make_docs, labels, corpus, monkeypatch):
    monkeypatch.setattr(q, "SHARD_ROWS", 60)
    known = labels([(d, int(d < 1000), 0, "x", 1) for d, _ in corpus])
    test = [r for r in scored(make_docs(corpus), known) if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in test) >= 0.95 * len(test)


def test_draw_is_bounded_and_repeatable(make_docs, labels, corpus, monkeypatch):
    monkeypatch.setattr(q, "MAX_LABELLED", 50)
    known = labels([(d, int(d < 1000), 0, "x", 1) for d, _ in corpus])
    one, two = (sorted(r["doc_id"] for r in q.draw(make_docs(corpus, p), known).collect()) for p in (2, 5))
    assert one == two and len(one) == 50 and not any(map(held, one))


def test_edges(make_docs, labels, edge_rows):
    docs = make_docs(edge_rows)
    for known in ([], [(4, 1, 0, "x", 1)], [(None, 0, 0, "x", 1)]):
        rows = scored(docs, labels(known))
        assert len(rows) == len(edge_rows) and all(r["score"] > 0.99 and r["predicted"] == 1 for r in rows)
    known = labels([(d, int(d in (5, 6)), 0, "x", 1) for d, *_ in edge_rows if d is not None])
    rows = scored(docs, known)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3, 8)}
    assert len(empty) == 1 and len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert scored(make_docs([]), labels([])) == []


def test_features():
    at, x = q.features("One  two\tTHREE one two three 12!")
    assert len(at) == len(set(at.tolist())) and (np.diff(at) > 0).all()
    assert np.isclose((x.astype(float) ** 2).sum(), 4, atol=1e-3)           # four kinds of grams
    assert np.array_equal(at, q.features("One two THREE one two three 12!\n")[0])
    assert len(q.features(" \t\n")[0]) == 0
    assert len(q.form_hashes(b"ABC!! abc")) == 2
    assert q.form_hashes(b"ABC!! Abcd x1")[0] == q.form_hashes(b"XY!")[0]
    assert q.form_hashes("É9".encode())[0] == q.form_hashes(b"z7")[0]
    assert q.repeated(np.array([3, 1, 3, 2], np.uint64)).tolist() == [True, False, True, False]
    assert len(q.features(prose(1, 40_000))[0]) <= q.BUCKETS
