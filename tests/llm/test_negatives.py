import math
import random

import duckdb
import numpy as np
import pytest

from campusledger.llm import negatives as m

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int, row long, q string, tile_a long, anchor string, place int, score long"
LONG = (1 << 63) - 1


def brute(rows):
    """The contract on (vec_id, embedding, label) rows, with exact integers; a row is itself by its id."""
    v = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        v.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x], label))

    def dot(a, b):
        return max(-LONG, min(LONG, sum(p * q for p, q in zip(a, b))))

    out = []
    for i, (a, x, label) in enumerate(v):
        if a is None or a % 50:
            continue
        scored = sorted(((-dot(x, y), b is None, b or 0, other) for b, y, other in v), key=lambda t: t[:3])
        positives = [t for t in scored if t[3] == label and (t[1] or t[2] != a)][:5]
        for p, p_null, p_id, _ in positives:
            p = -p
            chosen = [t for t in scored if t[3] != label and 50 * p <= -100 * t[0] <= 95 * p][:3]
            for rank, (s, null, b, _) in enumerate(chosen, 1):
                out.append((a, None if p_null else p_id, rank, None if null else b, p, -s))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, x, y, 1, "x", 2, "y", 3, 4) for i, x, y in rows], SCHEMA).repartition(3)
    return make


def mined(df):
    out = m.hard_negatives(m.labelled_vectors(df))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(seed, n, d, labels=10, spread=0.4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(labels, d))
    y = r.integers(0, labels, n)
    x = (spread * centre[y] + r.normal(size=(n, d))) * 0.2
    return [(i, [float(c) for c in row.astype(np.float32)], int(k)) for i, (row, k) in enumerate(zip(x, y))]


@pytest.mark.parametrize("n,d,tile", [(400, 64, (4, 70)), (300, 200, (4096, 8192)), (220, 3, (2, 50))])
def test_against_brute_force(make_vectors, monkeypatch, n, d, tile):
    monkeypatch.setattr(m, "ANCHORS_IN_TILE", tile[0])
    monkeypatch.setattr(m, "ROWS_IN_TILE", tile[1])
    rows = vectors(n, n, d)
    got = mined(make_vectors(rows))
    assert got == brute(rows) and got


def test_ties_copies_and_one_hot_label(make_vectors, monkeypatch):
    monkeypatch.setattr(m, "ROWS_IN_TILE", 60)
    rows = vectors(5, 300, 4, labels=2)
    rows = [(i, [round(c * 4) / 4 for c in x], 1 if i % 3 else y) for i, x, y in rows]      # many equal scores
    rows += [(300 + i, rows[50][1], 2 + i % 2) for i in range(120)]
    assert mined(make_vectors(rows)) == brute(rows)


def test_edges(make_vectors):
    nan, inf = float("nan"), float("inf")
    rows = vectors(6, 130, 8, labels=3)
    rows += [(150, None, 1), (200, [1.0] * 8, None), (250, [nan] * 8, 1), (300, [1.0, None] * 4, 1), (350, [inf] + [0.0] * 7, 2),
             (400, [], 1), (450, [0.5] * 3, 1), (500, [0.5] * 12, 1), (None, [0.1] * 8, 1), (None, [0.3] * 8, 2), (550, [0.0] * 8, 0),
             rows[7], rows[50], rows[50], (-50, [0.2] * 8, 2), (-7, [0.1] * 8, 0), (100, [0.4] * 8, 9)]
    assert mined(make_vectors(rows)) == brute(rows)
    assert mined(make_vectors([])) == []
    assert mined(make_vectors([(50, [1.0], 1)])) == []
    assert mined(make_vectors([(None, None, None)])) == []


@pytest.mark.parametrize("size", [1e4, 1e8, 1e25])
def test_large_components(make_vectors, size):
    rows = [(i, [c * size for c in x], y) for i, x, y in vectors(8, 120, 6, labels=3)]
    rows = [(i, [float(np.float32(c)) for c in x], y) for i, x, y in rows]
    assert mined(make_vectors(rows)) == brute(rows)


@pytest.mark.parametrize("bits,d", [(3, 5), (12, 70), (24, 1000), (60, 40), (300, 7)])
def test_scores_are_exact(bits, d):
    r = random.Random(bits)
    a, b = ([[float(r.randint(-2 ** bits, 2 ** bits)) for _ in range(d)] for _ in range(4)] for _ in range(2))
    primes = m.primes_for(d * max(int(abs(x)) for row in a + b for x in row) ** 2)
    got = m.Residues(np.array(a), primes).scores(slice(0, 4), m.Residues(np.array(b), primes))
    exact = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
    assert got.tolist() == [[max(-LONG, min(LONG, s)) for s in row] for row in exact]


def test_residue_sums_stay_below_the_float32_limit():
    assert m._RUN * (m.PRIME_BELOW // 2) ** 2 <= 2 ** 24
    primes = m.primes_for(10 ** 30)
    assert len(set(primes)) == len(primes) and all(all(p % k for k in range(2, p)) for p in primes)
    assert math.prod(primes) > 2 * 10 ** 30


@pytest.mark.parametrize("p", [-7, -1, 0, 1, 19, 20, 21, 10 ** 17 + 3])
def test_window(p):
    lowest, highest = m.window_of(p, 50, 95)
    for s in {lowest, lowest - 1, highest, highest + 1}:
        assert (lowest <= s <= highest) == (50 * p <= 100 * s <= 95 * p)


def test_sql_twin(make_vectors):
    rows = vectors(9, 500, 16)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({m.ORACLE_SQL})").fetchall()
    assert sorted(found, key=repr) == mined(make_vectors(rows))
