import random
import re

import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from campusledger.llm import line_dedup as m

EDGE = [(1, None), (2, ""), (3, "\n \n\t"), (4, "a"), (5, "a\n\nb"), (6, "same line of text here\n\nsame line of text here")]


def lines_of(rows):
    return [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))
            if re.search(r"[^\x20\x09-\x0D]", x)]


def shingles(x, n=m.SHINGLE_CHARS):
    return frozenset(x[i:i + n] for i in range(max(1, len(x) - n + 1)))


def brute(rows):
    """(doc_id, line_no) -> first line of its class, by comparing all pairs."""
    found = lines_of(rows)
    sets = [shingles(x) for _, _, x in found]
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(found)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= m.SIMILARITY_PERCENT * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (d, n, _) in enumerate(found):
        k = find(i)
        first[k] = min(first.get(k, (d, n)), (d, n))
    return {(d, n): first[find(i)] for i, (d, n, _) in enumerate(found)}


def changed(x, r):
    i = r.randrange(len(x))
    return x[:i] + r.choice("XYZ") + x[i + 1:]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    pool = [prose(i, 14).replace("\n", " ") for i in range(25)]
    out = []
    for d in range(10, 50):
        lines = []
        for _ in range(r.randint(1, 8)):
            x = r.choice(pool)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                x = changed(x, r)
            lines.append(x)
        lines.append(prose(1000 + d, 12).replace("\n", " "))
        out.append((d, "\n".join(lines)))
    return EDGE + out


def test_against_brute_force(make_docs, rows):
    out = m.line_classes(make_docs(rows)).collect()
    want = brute(rows)
    got = {(x["doc_id"], x["line_no"]): (x["class_doc_id"], x["class_line_no"]) for x in out}
    assert len(out) == len(want) and got == want
    assert all(x["kept"] == (got[x["doc_id"], x["line_no"]] == (x["doc_id"], x["line_no"])) for x in out)


def test_dropping(make_docs, rows):
    docs = make_docs(rows)
    kept = m.drop_duplicate_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = {x["doc_id"]: x for x in kept.collect()}
    want = brute(rows)
    for d, t in rows:
        if t is None or not [1 for (a, n) in want if a == d and want[a, n] != (a, n)]:
            assert got[d]["text"] == t
            continue
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((d, n), (d, n)) == (d, n))
        if left.strip():
            assert got[d]["text"] == left and got[d]["n_chars"] == len(left)
        else:
            assert d not in got
    assert got[6]["text"] == "same line of text here\n"


def test_repeated_and_null_ids(make_docs):
    docs = make_docs([(None, "shared line of words"), (None, "other line of words"), (1, "shared line of words"),
                      (1, "shared line of words")])
    out = sorted(((x["doc_id"] or 0, x["class_doc_id"] or 0, x["kept"]) for x in m.line_classes(docs).collect()))
    assert out == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True)]
    assert sorted(x["text"] for x in m.drop_duplicate_lines(docs).collect()).count("shared line of words") == 3
    assert m.line_classes(make_docs([])).collect() == []


def test_long_line(make_docs):
    x = prose(77, 6000).replace("\n", " ")
    out = m.line_classes(make_docs([(1, x), (2, x[:-5] + "ABCDE"), (3, x[::-1])])).collect()
    assert {y["doc_id"]: y["kept"] for y in out} == {1: True, 2: False, 3: True}


def test_no_python_in_the_plans(make_docs, rows, capsys, monkeypatch):
    plans = []
    stored = m.stored
    monkeypatch.setattr(m, "stored", lambda df, name: plans.append(df) or stored(df, name))
    plans.append(m.line_classes(make_docs(rows[:20])))
    capsys.readouterr()
    for df in plans:
        df.explain()
    shown = capsys.readouterr().out
    assert len(plans) > 5 and not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", shown)


def test_bands_and_packed_values(spark):
    assert (1 - (m.SIMILARITY_PERCENT / 100) ** m.BAND_VALUES) ** m.BANDS < 0.004
    x = "one line of words that stands in several documents"
    lines = spark.createDataFrame([(1, 1, x), (2, 2, x), (3, 3, "nothing of these words is shared here, not one bit")],
                                  "k1 long, k2 long, line string").withColumn("first", m.F.lit(0))
    d = m.signatures(lines, m.SHINGLE_CHARS).select("k1", "bands", m.F.struct(*m.BYTES).alias("v"))
    got = {(r["a"], r["b"]): (r["n"], r["same"]) for r in d.alias("x").join(d.alias("y"), m.F.expr("x.k1 < y.k1")).select(
        m.F.col("x.k1").alias("a"), m.F.col("y.k1").alias("b"), m.equal_values("x.v", "y.v").alias("n"),
        m.F.size(m.F.array_intersect("x.bands", "y.bands")).alias("same")).collect()}
    assert got[1, 2] == (24, 8)
    assert got[1, 3][0] <= 2 and got[1, 3][1] == 0


def test_rows_that_repeat_an_id_keep_their_own_lines(make_docs):
    own, common = "a line that stands in one row only", "a common line of several documents"
    docs = make_docs([(1, common), (5, own), (5, common), (5, f"{common}\n{own} too, but not quite the same one\n"), (None, common)])
    out = sorted((x["doc_id"] or 0, x["text"]) for x in m.drop_duplicate_lines(docs).collect())
    assert (5, own) in out and (1, common) in out and (5, common) not in out and (0, common) in out


def test_clashing_columns(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "same line here", 3), (2, "same line here\nother words", 4)], "doc_id long, text string, n_chars int")
    docs = docs.withColumns({c: F.lit(c) for c in ("_gone", "_lines", "_left", "gone", "lines", "left", "now", "row", "key", "id", "own")})
    out = m.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    assert sorted((x["doc_id"], x["text"], x["n_chars"], x["row"]) for x in out.collect()) == [
        (1, "same line here", 3, "row"), (2, "other words", 11, "row")]


def test_a_crowded_band_in_rounds(make_docs, monkeypatch):
    """Many lines alike in most characters: chains of links, hubs, and rows with more links than they hand on."""
    monkeypatch.setattr(m, "BLOCK", 6)
    r = random.Random(3)
    base = prose(1, 30).replace("\n", " ")
    lines, x = [base], base
    for i in range(40):
        x = changed(x, r) if i % 3 else changed(changed(r.choice(lines), r), r)
        lines.append(x)
    seen = []
    real = m._block_links

    def watched(members, lines, shingle, percent, todo):
        seen.append(todo is not None)
        return real(members, lines, shingle, percent, todo)

    monkeypatch.setattr(m, "_block_links", watched)
    rows = [(i, line) for i, line in enumerate(lines)]
    r.shuffle(rows)
    got = {x["doc_id"]: x["class_doc_id"] for x in m.line_classes(make_docs(rows)).collect()}
    assert got == {d: first for (d, _), (first, _) in brute(rows).items()}
    assert seen[0] is False


def test_a_row_hands_on_one_link_per_line(spark):
    """Every line similar to every other: as many links as lines, and word that there are more."""
    texts = [prose(5, 40).replace("\n", " ") + f" {i}" for i in range(20)]
    lines = spark.createDataFrame([(i, [7], t) for i, t in enumerate(texts)], "sid long, bands array<long>, line string")
    members = spark.createDataFrame([(7, i, i, 20) for i in range(20)], "band long, sid long, root long, members long")
    row, = m._block_links(members, lines, m.SHINGLE_CHARS, 80, None).collect()
    assert row["more"] and len(row["links"]) <= 2 * 20 and {p["a"] for p in row["links"]} | {p["b"] for p in row["links"]} == set(range(20))
    todo = spark.createDataFrame([(7, 0, 0)], "band long, i long, j long")
    assert m._block_links(members.withColumn("root", members["sid"] % 1), lines, m.SHINGLE_CHARS, 80, todo).collect() == []
    assert m._block_links(members, lines, m.SHINGLE_CHARS, 80, todo.limit(0)).collect() == []


def test_only_lines_that_share_a_band_go_on(make_docs, monkeypatch):
    """The table of all lines is gone before pairs are compared; their texts are those of lines that share a band."""
    made, real = {}, m.stored

    def watched(df, name):
        if name == "lines-pairs":
            assert made["lines"]._stored_at is None and made["lines-text"].count() == 2
        made.setdefault(name, real(df, name))
        return made[name] if name in ("lines", "lines-text", "lines-pairs") else real(df, name)

    monkeypatch.setattr(m, "stored", watched)
    near = prose(1, 40).replace("\n", " ")
    rows = [(i, prose(50 + i, 30).replace("\n", " ")) for i in range(40)] + [(90, near), (91, near + "X")]
    got = {x["doc_id"]: x["class_doc_id"] for x in m.line_classes(make_docs(rows)).collect()}
    assert got == {d: 90 if d == 91 else d for d, _ in rows}


def test_maps_rule_out_only_pairs_that_are_not_similar(spark):
    """No similar pair is ruled out, and nearly all pairs far from similar are, before shingle sets are made."""
    r = random.Random(3)
    base = [prose(i, 60).replace("\n", " ") for i in range(6)] + ["", "a", "short one", "x" * 3000, "\U0001f600 " * 40]
    texts = base + ["".join(c for c in t if r.random() > e) for t in base for e in (0.005, 0.01, 0.02, 0.1)]
    lines = spark.createDataFrame(list(enumerate(texts)), "sid long, line string")
    maps = m.shingle_maps(lines, m.SHINGLE_CHARS)
    assert maps.count() == len(texts)
    x, y = maps.toDF("a", "x"), maps.toDF("b", "y")
    may = {(p["a"], p["b"]): p["may"] for p in x.crossJoin(y).select(
        "a", "b", m.may_be_similar(F.col("x"), F.col("y"), 80).alias("may")).collect()}
    units = [t.encode("utf-16-be") for t in texts]
    sets = [{u[2 * i:2 * i + 16] for i in range(max(1, len(u) // 2 - 7))} for u in units]
    far = similar = 0
    for (a, b), kept in may.items():
        share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        similar += a != b and share >= 0.8
        assert kept or share < 0.8
        if share < 0.3 and min(len(sets[a]), len(sets[b])) > 20:
            far += 1
            assert not kept
    assert similar and far


def test_strides_hash_every_shingle_of_a_line(spark):
    """The rows of several shingles hold the hashes of all shingles and no others."""
    texts = ["", "a", "sevench", "exactly8", "nine char", prose(2, 30).replace("\n", " ")] + ["abcdefghijklmnopqrstuvwxyz"[:n] for n in range(9, 26)]
    lines = spark.createDataFrame(list(enumerate(texts)), "sid long, line string")
    one = {x["sid"]: set(x["h"]) for x in lines.select("sid", m.shingles(F.col("line"), m.SHINGLE_CHARS).alias("h")).collect()}
    got = {}
    for x in m._strides(lines.select("sid", F.encode("line", "UTF-16BE").alias("units")), m.SHINGLE_CHARS).collect():
        got.setdefault(x["sid"], set()).update(x[h] for h in m.STRIDE)
    assert got == one
