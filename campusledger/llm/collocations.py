"""Collocations by the stripes pattern.

Each prefix of one to four words keys an associative counter of the words that
follow it (a stripe). Map tasks count whole batches of texts and send one stripe
a prefix; stripes are merged element by element. An occurrence of the prefix at
the end of its piece, or before a word that cannot end a candidate, counts under
the empty word, so that

* the entries of a stripe are the counts of its extensions,
* the sum of a stripe is the count of its prefix,
* the largest entry of a stripe tells whether a longer phrase subsumes its prefix
  (and grouped by the phrase less its first word: whether one subsumes its rest).

It suffices to look one word ahead or back: a longer phrase as frequent as one it
holds has every phrase between the two exactly as frequent.

A phrase can reach ``least`` only if all its parts do, so four passes read the
texts: words; stripes of single words over frequent words; stripes of pairs over
frequent pairs; stripes of three and four words over frequent triples. "Frequent" is
tested against a bitmap of hashes, built from the exact counts of the pass before,
of at most ``MAX_BITS`` bits (16 MB). It holds every frequent word, pair or triple;
what it lets through by accident is counted exactly and falls out at the end, so its
size changes the work and never the result.

Shuffles: word counts and stripes, each summed in the task first; a stripe travels
as one row. A prefix of words that occur ``HOT`` times or more is dealt out in
``SEGMENTS`` segments by its next words; any other stripe has fewer than ``HOT``
entries. Merging is a hash aggregate that may spill: no stripe has to fit one
task's memory, and only its entries of ``least`` and more are kept. Counts of
occurrences are longs, scores are exact decimals.

Cases: a null text is empty; a null language is ``und``. Empty texts and tables
give nothing. Repeated rows count as often as they occur; texts are read whole;
extra columns are ignored. Ties: score, then count, descending, then the phrase in
byte order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campusledger.llm.common import each_batch, record_batch, small_batches, stored, texts
from campusledger.llm.words import U, mix64

LEAST = 100             # occurrences of a candidate
LONGEST = 5             # words of a candidate
TOP = 2000              # phrases returned per language
NO_LANG = "und"

HOT = 1 << 18           # occurrences of each of a prefix's words from which its stripe is dealt out
SEGMENTS = 64           # parts of such a stripe, by next word
MAX_BITS = 1 << 27      # bits of a bitmap of frequent words or pairs
_MIN_BITS = 1 << 16
_SLICE_BITS = 1 << 19   # bits of a bitmap put together in one task
_CHUNK_WORDS = 1 << 22  # words a task counts at once
_CHUNK_VOCABULARY = 1 << 20

_BREAK = b"\xff"        # no byte of UTF-8
_FOLD = bytearray(range(256))
_FOLD[0x41:0x5B] = range(0x61, 0x7B)
_FOLD[0x09] = 0x20
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 0xFF
_FOLD = bytes(_FOLD)
_END, _RARE = 0, 1      # ids of the end of a piece and of a word that is not frequent


def words_of(text: str) -> list[bytes]:
    """The folded words of a text, with ``_BREAK`` between pieces and at the end."""
    return (text.encode("utf-8", "replace").translate(_FOLD).replace(_BREAK, b" \xff ") + b" \xff").split()


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & U(bits - 1)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes, len(bitmap) * 8)
    return (bitmap[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def _joined(*hashes: np.ndarray) -> np.ndarray:
    """Hash of a sequence of words from the words' hashes."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix64(out * U(0x9E3779B97F4A7C15) + h)
    return out


_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            counts.pop(_BREAK, None)
            if counts:
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield record_batch(_WORDS, [[lang] * len(words), words, list(counts.values())])
        found.clear()

    for b in each_batch(batches):
        for lang, text in zip(b.column(0).to_pylist(), texts(b)):
            found[lang].update(words_of(text))
        if sum(map(len, found.values())) > _CHUNK_VOCABULARY:
            yield from flush()
    yield from flush()


class _Ids(dict):
    """Word -> id from 2 on; ``_RARE`` for a word that the bitmap does not hold."""

    def __init__(self, lang: str, bitmap: np.ndarray):
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.bits, self.bitmap = len(bitmap) * 8, bitmap.tobytes()
        self.words: list[bytes] = [b"", b""]
        self.hashes: list[int] = [0, 0]
        self[_BREAK] = _END

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        at = h & (self.bits - 1)
        if self.bitmap[at >> 3] >> (at & 7) & 1:
            self[word] = found = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
            return found
        if len(self) < 4 * _CHUNK_VOCABULARY:
            self[word] = _RARE
        return _RARE


class _Filters(NamedTuple):
    """Bitmaps: frequent words, hot words, and frequent runs of ``size`` words (``None``: the words)."""

    words: np.ndarray
    hot: np.ndarray
    size: int
    runs: np.ndarray | None


_STRIPE = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("prefix", pa.string()), ("segment", pa.int32()),
                     ("next", pa.string()), ("f", pa.list_(pa.int32()))])
_STRIPE_DDL = "lang string, size int, prefix string, segment int, next string, f array<int>"
_WHOLE = -1             # segment of a stripe in one piece


def _stripe_rows(lang: str, size: int, phrases: pa.Array, hot: np.ndarray, vocabulary: pa.Array, hashes: np.ndarray,
                 prefix: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
    """Count (prefix, next) pairs; one row per prefix and segment, the next words joined by spaces.

    ``following`` holds word ids, ``_END`` for no word (an empty next word).
    """
    # one number per (prefix, segment, next), so that one sort counts and groups
    width, parts = len(vocabulary), SEGMENTS + 1
    part = np.where(hot[prefix], 1 + (mix64(hashes) % U(SEGMENTS)).astype(np.int64)[following], 0)
    keys, f = np.unique((prefix * parts + part) * width + following, return_counts=True)
    prefix, following = np.divmod(keys, width)
    prefix, segment = np.divmod(prefix, parts)
    segment -= 1                                        # ``_WHOLE`` where not dealt out
    first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])]))
    offsets = pa.array(np.append(first, len(f)), pa.int32())
    return record_batch(_STRIPE, [
        pa.repeat(lang, len(first)), pa.array(np.full(len(first), size), pa.int32()),
        phrases.take(pa.array(prefix[first])), pa.array(segment[first], pa.int32()),
        pc.binary_join(pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(following))), " "),
        pa.ListArray.from_arrays(offsets, pa.array(f, pa.int32()))])


def _chunk_stripes(lang: str, ids: _Ids, chunk: list[np.ndarray], filters: _Filters) -> Iterator[pa.RecordBatch]:
    x = np.concatenate([*chunk, np.full(LONGEST, _END, np.int64)])
    vocabulary = pa.array(ids.words, pa.binary()).cast(pa.string())
    hashes = np.array(ids.hashes, U)
    hot = _has(filters.hot, hashes)
    span = filters.size
    end = len(x) - LONGEST
    good = x > _RARE                                    # places where a frequent run of ``span`` words starts
    for j in range(1, span):
        good[:end] &= x[j:end + j] > _RARE
    if filters.runs is not None:
        at = np.flatnonzero(good)
        good[at] = _has(filters.runs, _joined(*(hashes[x[at + j]] for j in range(span))))
    at = np.flatnonzero(good)
    part, phrases, width = x[at], vocabulary, len(vocabulary)
    for size in range(2, (LONGEST if span == LONGEST - 2 else span + 1)):       # prefixes of ``size`` words
        if size > span:
            at, part = at[good[at + size - span]], part[good[at + size - span]]
        keys, part = np.unique(part * width + x[at + size - 1], return_inverse=True)
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(keys // width)), vocabulary.take(pa.array(keys % width)), " ")
        hot = hot[keys // width] & _has(filters.hot, hashes[keys % width])
        if size >= span and len(at):
            yield _stripe_rows(lang, size, phrases, hot, vocabulary, hashes, part,
                               np.where(good[at + size - span + 1], x[at + size], _END))
    if span == 1 and len(at):
        yield _stripe_rows(lang, 1, vocabulary, hot, vocabulary, hashes, part, np.where(good[at + 1], x[at + 1], _END))


def _count_stripes(filters: _Filters, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[str, _Ids] = {}
    chunks: dict[str, list[np.ndarray]] = defaultdict(list)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, chunk in chunks.items():
            yield from _chunk_stripes(lang, ids[lang], chunk, filters)
        chunks.clear()
        ids.clear()

    held = 0
    for b in each_batch(batches):
        for lang, text in zip(b.column(0).to_pylist(), texts(b)):
            if lang not in ids:
                ids[lang] = _Ids(lang, filters.words)
            found = words_of(text)
            chunks[lang].append(np.fromiter(map(ids[lang].__getitem__, found), np.int64, len(found)))
            held += len(found)
            if held > _CHUNK_WORDS:
                yield from flush()
                held = 0
    yield from flush()


def _bitmap(hashed: DataFrame, name: str) -> np.ndarray:
    """A bitmap of the hashes (column ``h``), 16 bits a row, within bounds; put together in slices."""
    hashed = stored(hashed, name)
    rows = hashed.count()
    bits = min(MAX_BITS, max(_MIN_BITS, 1 << (16 * rows - 1).bit_length() if rows else 0))
    slices = max(1, bits // _SLICE_BITS)

    def build(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        flags = np.zeros(bits // slices, np.uint8)
        flags[at % len(flags)] = 1
        return pa.table({"slice": [int(at[0]) // len(flags)], "bytes": [np.packbits(flags, bitorder="little").tobytes()]})

    placed = (hashed.select(F.expr(f"h & {bits - 1}L").alias("at")).distinct()      # at most a slice's bits a group
              .groupBy(F.floor(F.col("at") / (bits // slices)).alias("slice")).applyInArrow(build, "slice long, bytes binary"))
    made = np.zeros(bits // 8, np.uint8)
    width = len(made) // slices
    for part, data in placed.collect():                 # MAX_BITS / 8 bytes at most
        made[part * width:(part + 1) * width] = np.frombuffer(data, np.uint8)
    return made


_HASH = pa.schema([("h", pa.int64())])


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the words (equally many in each row) in the column ``phrase``."""
    for b in each_batch(batches):
        made = []
        for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seed = xxhash.xxh64_intdigest(lang.encode())
            made.append([xxhash.xxh64_intdigest(w.encode(), seed) for w in phrase.split(" ")])
        yield record_batch(_HASH, [_joined(*np.array(made, U).T).view(np.int64)])


def _bits_of(phrases: DataFrame, name: str) -> np.ndarray:
    return _bitmap(phrases.select("lang", "phrase").mapInArrow(_hashes, "h long"), name)


def stripes(docs: DataFrame, filters: _Filters, least: int) -> DataFrame:
    """lang, size, prefix, total, entries: merged stripes, one row per prefix and segment.

    ``total`` counts the prefix (in its segment), ``entries`` holds the next words
    counted ``least`` times or more. Prefixes below ``least`` are left out.
    """
    kept = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_stripes(kept.value, batches)

    key = ["lang", "size", "prefix", "segment"]
    sent = docs.mapInArrow(run, _STRIPE_DDL).repartition(*key)
    merged = (sent.select(*key, F.explode(F.arrays_zip(F.split("next", " ").alias("next"), "f")).alias("e"))
              .groupBy(*key, F.col("e.next").alias("next")).agg(F.sum("e.f").alias("f")))
    frequent = F.when((F.col("next") != "") & (F.col("f") >= least), F.struct("next", "f"))
    return (merged.groupBy(*key).agg(F.sum("f").alias("total"), F.collect_list(frequent).alias("entries"))
            .where((F.col("segment") != _WHOLE) | (F.col("total") >= least)).drop("segment"))


def _extensions(found: DataFrame) -> DataFrame:
    """lang, size, prefix, phrase, f: the phrases one word longer than the prefixes."""
    return (found.select("lang", "size", "prefix", F.explode("entries").alias("e"))
            .select("lang", "size", "prefix", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.f").alias("f")))


def phrase_counts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to five words with at least ``least`` occurrences, and the words of each language.

    The first table has lang, size, phrase, f and ``longer``: whether a longer
    phrase holds it and is as frequent. The second has lang and n.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
                            F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    counts = (docs.mapInArrow(_count_words, "lang string, word string, f long")
              .groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("f").alias("f")))
    # Rare words only matter for the totals, so they are kept as one row a language and task.
    words = stored(counts.groupBy("lang", F.when(F.col("f") >= least, F.col("phrase")).alias("phrase"))
                   .agg(F.sum("f").alias("f")), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("phrase").isNotNull())
    common, hot = _bits_of(words, "words"), _bits_of(words.where(F.col("f") >= HOT), "words")
    runs, found = None, []
    for size in range(1, LONGEST - 1):
        found.append(stored(stripes(docs, _Filters(common, hot, size, runs), least), "collocation-stripes"))
        if size < LONGEST - 2:
            runs = _bits_of(_extensions(found[-1]), "runs")
    every = reduce(DataFrame.unionByName, found)
    longer = _extensions(every).where(F.col("size") > 1)
    right = longer.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("f").alias("right"))
    left = (longer.groupBy("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"))
            .agg(F.max("f").alias("left")))
    phrases = (every.groupBy("lang", "size", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"))
               .where(F.col("f") >= least)
               .unionByName(longer.where(F.col("size") == LONGEST - 1).select("lang", F.lit(LONGEST).alias("size"), "phrase", "f")))
    held = F.coalesce(F.greatest("left", "right") >= F.col("f"), F.lit(False))
    phrases = phrases.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left")
    return stored(phrases.select("lang", "size", "phrase", "f", held.alias("longer")), "collocation-phrases"), totals


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of every language."""
    phrases, totals = phrase_counts(documents, least)
    f = phrases.select("lang", "phrase", "f")
    cuts = (phrases.where((F.col("size") > 1) & ~F.col("longer"))
            .select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "size")
            .select("lang", "phrase", "a", "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
                    F.expr("array_join(slice(w, k + 1, size), ' ')").alias("tail")))
    both = (cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
            .join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang"))
    # exact: counts below 10**15 each, products in decimals of 38 digits
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)))"
                   " div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    worst = (both.withColumn("score", score)
             .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
grams AS (
  SELECT lang, CAST(unnest(range(1, least(5, len(w) - i + 1) + 1)) AS BIGINT) AS size, w, i FROM places),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (
  SELECT lang, f, unnest([array_to_string(w[2:size], ' '), array_to_string(w[1:size - 1], ' ')]) AS phrase
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 2)),
longer AS (SELECT lang, phrase, max(f) AS f FROM parts GROUP BY ALL),
candidates AS (
  SELECT f.lang, f.phrase, f.f AS a, f.size, string_split(f.phrase, ' ') AS w
  FROM f LEFT JOIN longer g ON g.lang = f.lang AND g.phrase = f.phrase
  WHERE f.size > 1 AND (g.f IS NULL OR g.f < f.f)),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, totals.n,
         (CAST(1000 AS HUGEINT) * c.a * totals.n) // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM cuts c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')
  JOIN totals ON totals.lang = c.lang),
lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
