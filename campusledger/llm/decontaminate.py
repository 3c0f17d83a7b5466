"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from its copy in a document by at most ``k`` edits. Cut
into ``k + 1`` pieces, one piece of it must then stand in the document
unchanged. An Aho-Corasick automaton over all pieces finds those places in one
pass over a text; around each, Myers' bit-parallel algorithm computes the edit
distance of the item to the best matching passage.

Both sides are compared with A-Z in lower case and every white space character
as a space, one character for one, so that offsets stay those of the text.

The items are the stated query set: they are worked through in blocks of at
most ``BLOCK_CHARS`` characters, each block in one pass over the documents, so
the automaton in a task stays bounded whatever the size of the benchmark. No
cap stands on hits, pieces or matches.

Cases: null or blank items and null or empty texts match nothing. Items with
equal texts are each reported; repeated document rows give repeated result
rows. Of several passages for one item the one with the fewest edits, then the
leftmost, is reported. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import each_batch, record_batch, small_batches, stored, texts

ERROR_RATE = 0.08     # edits allowed per character of the item
BLOCK_CHARS = 2_000_000

_SPACE = re.compile(r"\s")


def plain(text: str) -> str:
    """A-Z lower-cased and white space as spaces, every character in its place."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return _SPACE.sub(" ", low)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces ``(offset, piece)`` of nearly equal length."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Fewest edits (and the first end reaching them) of ``pattern`` against any substring of ``text``.

    Myers (1999): the column of the dynamic programme is held in the bits of two
    integers. None if every substring needs more than ``most`` edits.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    pv, mv, score, best, end = mask, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return None if end < 0 else (best, end)


def best_match(item: str, text: str, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best passage inside ``text[low:high]``."""
    at = text.find(item, low, high)
    if at >= 0:
        return 0, at, at + len(item)
    found = myers(item, text[low:high], most)
    if not found:
        return None
    edits, end = found
    end += low
    # the same distance read backwards from the end gives the start
    begin = max(low, end - len(item) - edits)
    back = myers(item[::-1], text[begin:end][::-1], edits)
    return edits, end - back[1] if back else begin, end


class Block:
    """The automaton of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.items = [t for _, t in items]
        self.edits = [int(len(t) * rate) for t in self.items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.items):
            for at, piece in pieces(t, self.edits[n]):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item number, edits, start, end)`` for every item found in a text."""
        spans: dict[int, list[list[int]]] = {}
        for last, (size, own) in self.automaton.iter(text):
            for n, at in own:
                k = self.edits[n]
                low = last + 1 - size - at - k
                high = low + len(self.items[n]) + 2 * k
                known = spans.setdefault(n, [])
                if known and low <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], high)
                    known[-1][0] = min(known[-1][0], low)
                else:
                    known.append([low, high])
        found = []
        for n, windows in spans.items():
            tried = [best_match(self.items[n], text, max(0, a), min(len(text), b), self.edits[n]) for a, b in windows]
            if hit := min(filter(None, tried), default=None):
                found.append((n, *hit))
        return sorted(found)


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items as ``(item_id, plain text)``, in blocks of bounded size."""
    block, room = [], block_chars
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        item = plain(text).strip()
        if item:
            if block and len(item) > room:
                yield block
                block, room = [], block_chars
            block.append((item_id, item))
            room -= len(item)
    if block:
        yield block


_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("item_chars", pa.int64()),
                  ("start", pa.int64()), ("end", pa.int64())])
_HIT_SQL = "doc_id long, item_id long, edits long, item_chars long, start long, end long"


def _search(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items, rate)
        for b in each_batch(batches):
            rows = [(d, block.ids[n], k, len(block.items[n]), s, e)
                    for d, t in zip(b.column(0).to_pylist(), texts(b)) for n, k, s, e in block.matches(plain(t))]
            if rows:
                yield record_batch(_HIT, [list(c) for c in zip(*rows)])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item found in it.

    Columns: doc_id, item_id, edits, item_chars, start, end (code points of the
    text, end exclusive).
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(text) > 0")
    blocks = item_blocks(benchmark, block_chars)
    first = next(blocks, [])
    second = next(blocks, None)
    out = docs.mapInArrow(_search(first, rate), _HIT_SQL) if first else docs.sparkSession.createDataFrame([], _HIT_SQL)
    if second is None:
        return out
    out = stored(out, "contaminated")
    while second is not None:      # one pass per block; each is written before the next is read
        out = out.unionByName(stored(docs.mapInArrow(_search(second, rate), _HIT_SQL), "contaminated"))
        second = next(blocks, None)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    gone = contaminated(docs, benchmark, **settings).select("doc_id").distinct()
    return docs.join(stored(gone, "contaminated"), "doc_id", "left_anti").select(docs.columns)
