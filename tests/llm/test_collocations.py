import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import pytest

from campusledger.llm import collocations as c

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    """The contract, word for word, on (doc_id, text, lang) rows."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        inside = set()
        for q in candidates:
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    if counts[q] >= counts[q[i:i + size]]:
                        inside.add(q[i:i + size])
        scored = []
        for p in candidates:
            if p not in inside:
                cuts = [(floor(Fraction(1000 * counts[p] * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -counts[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[x] for x in COLUMNS) for r in df.collect())


def corpus(seed, docs, langs=("en", "fr", None, "und")):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a", "New", "york", "CITY", "state", "é", "É", "i̇", "x1", "#", "zoo", "\x1cq", "a b"]
    stock = ["New York City state of the zoo", "of the the the the the", "x1 # x1 # x1"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(r.randint(0, 30)):
            words.append(r.choice(stock) if r.random() < 0.2 else r.choice(vocabulary))
            words.append(r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", ";"]))
        out.append((i, "".join(words), r.choice(langs)))
    return out


@pytest.mark.parametrize("seed,least,top,chunk", [(1, 3, 2000, 1 << 22), (2, 8, 7, 50), (3, 1, 40, 1000)])
def test_against_brute_force(make_docs, monkeypatch, seed, least, top, chunk):
    monkeypatch.setattr(c, "_CHUNK_WORDS", chunk)
    monkeypatch.setattr(c, "_CHUNK_VOCABULARY", chunk)
    rows = corpus(seed, 120)
    got = c.collocations(make_docs(rows), least, top)
    assert got.columns == COLUMNS
    assert dict(got.dtypes) == {x: "string" if x in ("lang", "phrase") else "bigint" for x in COLUMNS}
    assert rows_of(got) == brute(rows, least, top)


def test_a_bitmap_that_lets_everything_through_changes_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(c, "_has", lambda bitmap, hashes: hashes == hashes)
    rows = corpus(4, 60)
    assert rows_of(c.collocations(make_docs(rows), 4)) == brute(rows, 4, 2000)


def test_bitmap_holds_what_it_was_made_of_in_slices(make_docs, monkeypatch):
    monkeypatch.setattr(c, "_SLICE_BITS", 1 << 14)
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 40)), "en") for i in range(0, 400, 5)]
    assert rows_of(c.collocations(make_docs(rows), 2)) == brute(rows, 2, 2000)


@pytest.mark.parametrize("hot", [1, 20])
def test_dealt_out_stripes(make_docs, monkeypatch, hot):
    monkeypatch.setattr(c, "HOT", hot)
    rows = corpus(8, 150)
    assert rows_of(c.collocations(make_docs(rows), 3)) == brute(rows, 3, 2000)


def test_hot_prefix_long_text_and_repeated_rows(make_docs):
    r = random.Random(5)
    long = " ".join("the " + f"w{r.randrange(300)}" for _ in range(30_000))
    rows = [(1, long, "en"), (1, long, "en"), (2, "the end", "en"), (None, "the end", None), (None, "the end", None)]
    assert rows_of(c.collocations(make_docs(rows), 2)) == brute(rows, 2, 2000)


def test_ties_go_to_the_phrase_in_byte_order(make_docs):
    rows = [(i, "b a. é z, a b. Z é", "en") for i in range(3)]
    got = [x[2] for x in rows_of(c.collocations(make_docs(rows), 3))]
    assert got == [x[2] for x in brute(rows, 3, 2000)] and got == ["a b", "b a", "z é", "é z"]


def test_edges(make_docs, edge_rows):
    assert rows_of(c.collocations(make_docs([]))) == []
    assert rows_of(c.collocations(make_docs([(1, None), (2, ""), (3, " .\n!")]), 1)) == []
    rows = [(d, t, lang) for d, t, lang in ((*r, None)[:3] for r in edge_rows)]
    assert rows_of(c.collocations(make_docs(edge_rows), 2)) == brute(rows, 2, 2000)


def test_stripes_give_prefix_totals(make_docs):
    rows = corpus(6, 80, langs=("en",))
    phrases, totals = c.phrase_counts(make_docs(rows), 3)
    f = Counter()
    for _, text, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(FOLD)):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(" ".join(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert {r["phrase"]: r["f"] for r in phrases.collect()} == {p: a for p, a in f.items() if a >= 3}
    assert [tuple(r) for r in totals.collect()] == [("en", sum(a for p, a in f.items() if " " not in p))]


def test_sql_twin(make_docs):
    rows = corpus(7, 400)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({c.ORACLE_SQL})").fetchall()
    assert sorted(found) == rows_of(c.collocations(make_docs(rows)))
    assert found
