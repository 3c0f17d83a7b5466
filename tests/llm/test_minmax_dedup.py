import random
import re

import numpy as np
import pytest

from campusledger.llm import minmax_dedup as m
from campusledger.llm.words import seeds
from llm_fixtures import prose


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (size, component) for distinct ids."""
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {d: (len(sets[d]), root[d]) for d in sets}


def changed(text, r, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "new%d" % r.randrange(10**6)
    return " ".join(w)


@pytest.mark.parametrize("block", [4, 128])
def test_against_brute_force(make_docs, block):
    r = random.Random(3)
    base = [prose(i, 150) for i in range(4)]
    rows = [(i, changed(base[i % 4], r, i % 5)) for i in range(60)]
    rows += [(100 + i, prose(50 + i, 80)) for i in range(20)] + [(200, "tiny text"), (201, "TINY text"), (202, "")]
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in m.near_duplicates(make_docs(rows), block=block).collect()}
    assert got == brute(rows)


def test_edges(make_docs, edge_rows):
    out = m.near_duplicates(make_docs(edge_rows)).collect()
    assert len(out) == len(edge_rows)
    by = {x["doc_id"]: x for x in out}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[1]["kept"] and by[1]["component_id"] == 1
    assert by[4]["n_shingles"] == 1 and by[9]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert all(x["component_id"] == 6 and x["kept"] for x in out if x["doc_id"] == 6)
    assert m.near_duplicates(make_docs([])).collect() == []


def test_dropping_keeps_one_row_and_all_columns(make_docs, edge_rows):
    docs = make_docs(edge_rows + [(60, prose(6, 200))])
    kept = m.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"]) == [1, 2, 3, 4, 5, 6, 8, 9]


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:900], r.integers(0, 2**63, 100).astype(np.uint64)])
    a, b = (m.min_max_signature(v, seeds(500, 1)) for v in (x, y))
    assert abs((a == b).mean() - 900 / 1100) < 0.05
    assert a.shape == (500, 2)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(m, "_CHUNK", 3)
    x = [np.array(v, np.uint64) for v in ([1, 2, 3], [4, 5], [1, 9])]
    y = [np.array(v, np.uint64) for v in ([2, 3, 4], [9])]
    assert m._overlaps(x, y).tolist() == [[2, 0], [1, 0], [0, 1]]


def test_rows_that_repeat_an_id_with_another_text(make_docs):
    rows = [(5, prose(1, 90)), (5, prose(2, 90)), (5, prose(2, 90)), (6, prose(1, 90)), (7, prose(3, 90)), (4, prose(2, 90)),
            (None, prose(1, 90)), (5, None), (5, None)]
    out = m.drop_near_duplicates(make_docs(rows))
    got = sorted((x["doc_id"] or 0, x["text"] or "") for x in out.collect())
    assert sorted(t for d, t in got if d) == sorted(["", prose(1, 90), prose(2, 90), prose(3, 90)])     # each text once
    assert (0, prose(1, 90)) in got and (5, "") in got and {d for d, t in got if t == prose(1, 90)} <= {0, 5, 6}
    assert out.columns == make_docs(rows).columns
