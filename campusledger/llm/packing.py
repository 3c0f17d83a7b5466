"""Best-fit packing of documents into sequences by bin completion.

Documents are tokenised, given an end id, and cut into pieces of at most the
sequence length (only longer documents are cut). Pieces of full length are a
sequence by themselves. The others are dealt into blocks of about
``BLOCK_PIECES`` and each block is packed by bin completion (Korf 2002): take
the largest piece left, list the undominated ways to fill up its sequence with any
number of other pieces, go on with the one of least waste, and come back to the
others while the waste so far leaves room to beat the incumbent, which is at first
the best-fit-decreasing solution. A block stops at its lower bound, or after a
bounded number of nodes.

A filling dominates another of the same waste if it uses larger pieces: they are
tried first. Blocks are independent, so each costs at most part of one sequence over
the optimum of all pieces.

Cases: a null text reads as empty, and an empty document is one piece, the end
id alone. Repeated rows are packed as often as they occur. Texts are
tokenised whole, word by word. Extra columns are ignored.

The vocabulary file is a parameter; each task reads it where the tasks run
(``public_tokenizers`` must be installed there) and keeps a bounded table of
word -> ids, because the tokenizer treats words between spaces independently.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import each_batch, record_batch, small_batches, stored, texts
from campusledger.llm.words import word_hashes, word_spans

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEQUENCE_TOKENS = 4096
BLOCK_PIECES = 20_000

_KEPT_WORDS = 1_000_000   # distinct words a task keeps the ids of (about 50 MB)


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's ids of a word between spaces do not depend on its
    neighbours. So the words of a batch are hashed in numpy, the ids of each
    distinct word are looked up in a bounded sorted table, and only words new to
    the table reach the tokenizer, many in one text. There they are parted again
    by counting tokens that end a word of the vocabulary's pattern (runs of
    letters, single digits, runs of anything else). Words with an apostrophe,
    which the pattern treats by case, go alone. Texts for which this could
    differ from the tokenizer (not NFC, capital sigma, separator controls, the
    text of special tokens) go through it whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import json
        import os

        import public_tokenizers
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = [*special, "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f"]
        self.kind = np.zeros(0x110000, np.uint8)      # of a code point: 0 not looked up, 1-3 see _kinds, 4 space
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)          # sorted; of each word its ids' start and length
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, "<u4")

    def _usual(self, text: str) -> bool:
        return not any(u in text for u in self.unusual) and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """1 letter, 2 number, 3 other, 4 white space."""
        kinds = self.kind[codes]
        if not kinds.all():
            for c in np.unique(codes[kinds == 0]).tolist():
                category = unicodedata.category(chr(c))[0]
                self.kind[c] = 4 if chr(c).isspace() else {"L": 1, "N": 2}.get(category, 3)
            kinds = self.kind[codes]
        return kinds

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without an apostrophe, tokenised as one text, and the length of each."""
        text = " ".join(words)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._kinds(codes)
        begins = kinds != 4
        begins[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        tokens = np.bincount(np.cumsum(codes == 0x20)[begins], minlength=len(words))
        ids = self._alone([text])[0]
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != tokens.sum():
            found = self._alone(words)
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum(tokens)], prepend=0)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words to the table; ``hashes`` are sorted."""
        plain = [i for i, w in enumerate(words) if "'" not in w]
        quoted = [i for i, w in enumerate(words) if "'" in w]
        found = [self._together([words[i] for i in plain[at:at + 2048]]) for at in range(0, len(plain), 2048)]
        alone = self._alone([words[i] for i in quoted])
        ids = np.concatenate([np.empty(0, "<u4"), *(i for i, _ in found), *alone])
        lengths = np.concatenate([np.empty(0, np.int64), *(n for _, n in found), [len(x) for x in alone]]).astype(np.int64)
        length, start = np.empty((2, len(words)), np.int64)
        order = np.array(plain + quoted, np.int64)
        length[order] = lengths
        start[order] = len(self.ids) + np.cumsum(lengths) - lengths
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.start = np.insert(self.start, place, start)
        self.length = np.insert(self.length, place, length)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, many: list[str]) -> list[bytes]:
        usual = [self._usual(t) for t in many]
        parts = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(many, usual)]
        data = b"\n".join(parts)
        first, last = word_spans(data)
        found, index, inverse = np.unique(word_hashes(data), return_index=True, return_inverse=True)
        new = np.append(self.hashes, found[-1:])[np.searchsorted(self.hashes, found)] != found
        new |= np.searchsorted(self.hashes, found) == len(self.hashes)
        if len(self.hashes) + new.sum() > _KEPT_WORDS:
            self._clear()
            new[:] = True
        at = index[new]
        self._learn(found[new], [data[a:b].decode() for a, b in zip(first[at].tolist(), last[at].tolist())])
        place = np.searchsorted(self.hashes, found)[inverse]
        length = self.length[place]
        before = np.concatenate([[0], np.cumsum(length)])
        out = self.ids[np.repeat(self.start[place] - before[:-1], length) + np.arange(before[-1])]
        text_ends = np.cumsum([len(p) + 1 for p in parts])
        cuts = before[np.searchsorted(first, np.concatenate([[0], text_ends]))].tolist()
        whole = iter(self._alone([t for t, ok in zip(many, usual) if not ok]))
        return [out[a:b].tobytes() if ok else next(whole).tobytes() for a, b, ok in zip(cuts, cuts[1:], usual)]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


def _cutter(vocabulary: str, end_id: int, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in each_batch(batches):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), tokenizer.encode(texts(b))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield record_batch(_PIECE, [list(c) for c in zip(*rows)])
    return run


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID,
           size: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document row."""
    small_batches(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_cutter(vocabulary, end_id, size),
                        "doc_id long, piece int, start long, length long, ids_crc32 long"))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: each length into the fullest bin that still takes it."""
    room_of: list[list[list[int]]] = [[] for _ in range(size + 1)]
    open_rooms = np.zeros(size + 1, bool)
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        fits = open_rooms[n:].argmax() + n if n <= size else n
        if open_rooms[fits]:
            b = room_of[fits].pop()
            open_rooms[fits] = bool(room_of[fits])
        else:
            fits, b = size, []
            bins.append(b)
        b.append(n)
        room_of[fits - n].append(b)
        open_rooms[fits - n] = True
    return bins


class Fillings:
    """Ways to fill ``room`` with any number of the pieces at hand, least waste first.

    ``reach[i]`` is the set of sums (bits of a whole number) that the ``i`` shortest
    distinct lengths can make, each as often as it is at hand, so every possible
    filling of every size is known and one of a given sum can be traced back. The
    fillings of least waste leave no length that would still fit; of equal sums those
    with longer pieces come first, as they leave the shorter, more flexible ones.
    """

    def __init__(self, counts: np.ndarray, room: int):
        self.room = room
        have = np.flatnonzero(counts[:room + 1])
        self.lengths = have[have > 0].tolist()
        self.counts = [min(int(counts[n]), room // n) for n in self.lengths]
        full, sums = (1 << (room + 1)) - 1, 1
        self.reach = [sums]
        for n, c in zip(self.lengths, self.counts):
            k = 1
            while c > 0:                    # c copies as groups of 1, 2, 4, ... copies
                k = min(k, c)
                sums |= sums << (k * n) & full
                c -= k
                k *= 2
            self.reach.append(sums)

    def _trace(self, i: int, total: int) -> list[int]:
        """Pieces of the ``i`` shortest lengths that add up to ``total``, longest first."""
        found: list[int] = []
        while total:
            i -= 1
            n, below = self.lengths[i], self.reach[i]
            for k in range(min(self.counts[i], total // n), -1, -1):
                if below >> (total - k * n) & 1:
                    found += [n] * k
                    total -= k * n
                    break
        return found

    def best(self, most: int, slack: int) -> list[tuple[int, ...]]:
        """At most ``most`` fillings that waste ``slack`` at most; one per choice of the longest piece and its copies."""
        found: list[tuple[int, ...]] = []
        reach = self.reach[-1]
        for total in range(self.room, max(-1, self.room - slack - 1), -1):
            if not reach >> total & 1:
                continue
            if not total:
                found.append(())
            for i in range(len(self.lengths) - 1, -1, -1):
                n, below = self.lengths[i], self.reach[i]
                for k in range(min(self.counts[i], total // n), 0, -1):
                    if below >> (total - k * n) & 1:
                        found.append((*[n] * k, *self._trace(i, total - k * n)))
                        if len(found) == most:
                            return found
        return found


def bin_completion(lengths: list[int], size: int, nodes_per_bin: int = 3, most: int = 3) -> list[list[int]]:
    """Pack ``lengths`` into few bins of ``size``: bin completion with a bounded search.

    Each bin is built around the longest piece left, by the ``most`` fillings of
    least waste; a branch whose waste rules out a better solution than the incumbent
    is cut. The search ends after ``nodes_per_bin`` nodes a bin.
    """
    incumbent = best_fit(lengths, size)
    total = sum(lengths)
    bound = -(-total // size)
    if len(incumbent) <= bound:
        return incumbent
    nodes = nodes_per_bin * len(incumbent) + 64
    counts = np.bincount(np.array(lengths, np.int64), minlength=size + 1)
    spare = (len(incumbent) - 1) * size - total        # waste a better solution may have
    stack: list[tuple[tuple[int, ...], list[tuple[int, ...]], int]] = []   # bin, fillings left, waste before
    waste, left = 0, len(lengths)
    options: list[tuple[int, ...]] | None = None
    while nodes > 0:
        if not left:
            solution = [list(b) for b, _, _ in stack]
            if len(solution) < len(incumbent):
                incumbent = solution
                spare = (len(incumbent) - 1) * size - total
            if len(incumbent) <= bound:
                break
            options = []
        if options is None:
            largest = int(np.flatnonzero(counts)[-1])
            counts[largest] -= 1
            options = [(largest, *f) for f in Fillings(counts, size - largest).best(most, max(0, spare - waste))]
            counts[largest] += 1
        chosen = None
        while options:
            chosen = options.pop(0)
            if waste + size - sum(chosen) <= spare:
                break
            chosen = None
        if chosen is None:                              # no filling left here: step back
            if not stack:
                break
            last, options, waste = stack.pop()
            np.add.at(counts, list(last), 1)
            left += len(last)
            continue
        nodes -= 1
        stack.append((chosen, options, waste))
        np.subtract.at(counts, list(chosen), 1)
        left -= len(chosen)
        waste += size - sum(chosen)
        options = None
    return incumbent


_PACKED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _packer(size: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "ascending"), ("row", "ascending")])
        lengths = group.column("length").to_pylist()
        by_length: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            by_length.setdefault(n, []).append(i)
        place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, content in enumerate(bin_completion(lengths, size)):
            at = 0
            for n in content:
                i = by_length[n].pop()
                place[i], offset[i] = number, at
                at += n
        # Even numbers; full pieces take the odd ones.
        sequence = (group.column("block")[0].as_py() * (1 << 24) + place) * 2
        return pa.table([*(group.column(n) for n in _PIECE.names), pa.array(sequence), pa.array(offset)], schema=_PACKED)
    return run


_PACKED_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, size: int = SEQUENCE_TOKENS,
         block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: where it stands (``sequence_id``, ``offset``) and what it holds."""
    cut = stored(pieces(docs, vocabulary, end_id, size), "pieces").withColumn("row", F.monotonically_increasing_id())
    open_ = cut.where(F.col("length") < size)
    blocks = max(1, -(-open_.count() // block_pieces))
    packed = (open_.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
              .groupBy("block").applyInArrow(_packer(size), _PACKED_SQL))
    full = cut.where(F.col("length") == size).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
