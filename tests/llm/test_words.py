import re

import numpy as np

from campusledger.llm import words


def test_words_are_runs_outside_ascii_space():
    text = "a  b\x0b\x0cé x y 　 z\x1cq\n"
    expected = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert len(words.word_hashes(text.encode())) == len(expected)
    s, e = words.word_spans(text.encode())
    assert [text.encode()[a:b].decode() for a, b in zip(s, e)] == expected


def test_equal_words_equal_hashes_anywhere():
    h = words.word_hashes(b"alpha beta alpha  gamma alpha")
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_blocks_do_not_change_the_result(monkeypatch):
    data = " ".join(str(i * 7919) for i in range(5000)).encode()
    whole = words.word_hashes(data)
    monkeypatch.setattr(words, "_BLOCK", 100)
    assert np.array_equal(words.word_hashes(data), whole)
    assert len(words.word_spans(data)[0]) == 5000


def test_shingles():
    h = words.word_hashes(b"a b c d e f a b c d e")
    s = words.shingle_hashes(h)
    assert len(s) == 7 and s[0] == s[6] and len(set(s.tolist())) == 6
    assert len(words.shingle_hashes(h[:3])) == 1 and not len(words.shingle_hashes(h[:0]))
    assert words.distinct(np.array([3, 1, 3], np.uint64)).tolist() == [1, 3]
