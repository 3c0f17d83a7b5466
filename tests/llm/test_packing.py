import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from campusledger.llm import packing as p

ODD = ["", " a  b c\x1cd é ̈x <|endoftext|> don't I'LL ΑΣ ΑΣ. x\x85y İ", "日本 語　x", "a" * 500 + " b", "ΑΣ ΑΣ. Σ",
       "é café", "<|startoftext|> x", "l'eau d'un don'ts it's ' ''s !'s", "a1b22 3.5% ²½ x_y — “q”", "\x0b\x0c \xa0 \t"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path(p.VOCABULARY))


def test_ids_are_the_tokenizers(reference, monkeypatch):
    from llm_fixtures import prose
    samples = ODD + [prose(i, 300) for i in range(5)]
    want = [reference.encode(t, add_special_tokens=False).ids for t in samples]
    for bound in (1_000_000, 40):
        monkeypatch.setattr(p, "_KEPT_WORDS", bound)
        t = p.WordTokenizer()
        for group in ([s] for s in samples):
            t.encode(group)
        assert [np.frombuffer(b, "<u4").tolist() for b in t.encode(samples)] == want


def optimum(lengths, size):
    """Fewest bins, by trying every placement."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= size:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1:])
        go(i + 1, bins + [lengths[i]])
    go(0, [])
    return best[0]


def test_bins_are_valid_and_few():
    r = random.Random(0)
    worse = 0
    for _ in range(150):
        size = r.choice([10, 20, 50])
        lengths = [r.randint(1, size) for _ in range(r.randint(1, 8))]
        bins = p.bin_completion(lengths, size)
        assert Counter(x for b in bins for x in b) == Counter(lengths) and max(map(sum, bins)) <= size
        assert len(bins) <= len(p.best_fit(lengths, size))
        worse += len(bins) - optimum(lengths, size)
    assert worse <= 2
    # best-fit decreasing needs 4 bins here, bin completion finds the 3
    assert len(p.best_fit([6, 5, 5, 5, 5, 4], 10)) >= len(p.bin_completion([6, 5, 5, 5, 5, 4], 10)) == 3


def test_round_trip(make_docs, edge_rows, reference):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(ODD)]
    out = p.pack(make_docs(rows), size=64, block_pieces=40).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [p.END_ID]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at:at + 64], "<u4")
            want[d, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == want
    sequences = defaultdict(list)
    for x in out:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x["length"] for x in out)
    assert len(sequences) <= -(-total // 64) + 4


def test_empty_table(make_docs):
    assert p.pack(make_docs([])).collect() == []


def test_null_ids_beside_large_ones(make_docs):
    rows = [(9007199254740993, "one"), (None, "two"), (-9007199254740995, "three words here"), (None, None)]
    out = p.pack(make_docs(rows, parts=1)).collect()
    assert Counter(x["doc_id"] for x in out) == Counter([9007199254740993, -9007199254740995, None, None])


def test_fillings_of_many_pieces():
    r = random.Random(1)
    lengths = [r.randint(500, 800) for _ in range(600)]
    assert len(p.best_fit(lengths, 4096)) == 101 and len(p.bin_completion(lengths, 4096)) <= 98
    counts = np.bincount([7, 7, 5, 3, 3, 3])
    found = p.Fillings(counts, 16).best(10, 2)
    assert all(sum(f) <= 16 and sum(f) >= 14 for f in found) and (7, 3, 3, 3) in found and found[0] == (7, 3, 3, 3)
    assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)
    assert p.Fillings(np.bincount([5, 9]), 4).best(3, 4) == [()]
