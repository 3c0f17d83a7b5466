"""Language identification with hyperdimensional profiles.

Every letter gets a fixed random vector of +1 and -1. An n-gram is bound as the
element-wise product of its letters' vectors, each permuted (rotated) by its
position; a text bundles (adds) the vectors of all its n-grams; the prototype
of a language bundles its training documents, each at unit length. A document
takes the language whose prototype is nearest by cosine.

Letters are lower-cased; any run of other characters counts as one space, and a
text has a space before and after. The random vector of a character depends on
its code point alone, so all tasks agree without sharing a table.

Training adds up partial bundles per task and then per (language, dimension),
so what reaches the driver is languages x dimensions numbers, whatever the
input. It reads ``text`` and ``lang`` of the documents whose
``crc32(doc_id as text) mod 4`` is not 2. Prediction reads ``text`` only.

Cases: a null text or one without a letter is ``und`` with score 0; so is every
text when nothing could be learnt. Documents without a language are not learnt
from. Texts are read whole. Repeated rows get equal results, ties go
to the language first in order, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import crc32_bucket, each_batch, record_batch, small_batches, texts
from campusledger.llm.words import mix64

FOLDS, HELD_OUT_FOLD = 4, 2
DIMENSIONS = 512
GRAM = 3
UNKNOWN = "und"
SHARPNESS = 60.0        # score = softmax over languages of SHARPNESS * cosine

_SPACE = 0x20
_CHUNK_CODES = 1 << 20  # characters worked on at once
_CHUNK_GRAMS = 8192     # distinct n-grams worked on at once


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one space; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return codes
    found = np.flatnonzero(np.bincount(codes))
    letter = np.zeros(int(found[-1]) + 1, bool)
    letter[[c for c in found.tolist() if chr(c).isalpha()]] = True
    is_letter = letter[codes]
    if not is_letter.any():
        return codes[:0]
    codes = np.where(is_letter, codes, np.uint32(_SPACE))
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    edge = np.array([_SPACE], np.uint32)
    codes = codes[keep]
    return np.concatenate([edge[:int(codes[0] != _SPACE)], codes, edge[:int(codes[-1] != _SPACE)]])


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed random vector of a character, +1 and -1."""
    words = mix64(np.arange(dimensions // 64, dtype=np.uint64) + np.uint64(code << 20 | 1))
    return np.unpackbits(words.view(np.uint8)).astype(np.float32) * 2 - 1


def _chunks(many: list[str]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """``(row, codes)`` pieces in chunks of bounded size; pieces of one text overlap by n - 1."""
    chunk, room = [], _CHUNK_CODES
    for row, text in enumerate(many):
        codes = letter_codes(text)
        for at in range(0, max(0, len(codes) - GRAM + 1), _CHUNK_CODES):
            piece = codes[at:at + _CHUNK_CODES + GRAM - 1]
            if chunk and len(piece) > room:
                yield chunk
                chunk, room = [], _CHUNK_CODES
            chunk.append((row, piece))
            room -= len(piece)
    if chunk:
        yield chunk


def bundles(many: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One vector per text; the zero vector for a text without a letter."""
    out = np.zeros((len(many), dimensions), np.float32)
    for chunk in _chunks(many):
        codes = np.concatenate([c for _, c in chunk])
        piece = np.repeat(np.arange(len(chunk)), [len(c) for _, c in chunk])
        alphabet = np.flatnonzero(np.bincount(codes))
        index = np.zeros(int(alphabet[-1]) + 1, np.int64)
        index[alphabet] = np.arange(len(alphabet))
        codes, size = index[codes], len(alphabet)
        gram = np.zeros(len(codes) - GRAM + 1, np.int64)
        for j in range(GRAM):
            gram = gram * size + codes[j:len(codes) - GRAM + 1 + j]
        whole = piece[:len(gram)] == piece[GRAM - 1:]      # not across two pieces
        gram, row = gram[whole], piece[:len(gram)][whole]
        if size ** GRAM <= 1 << 22:
            found = np.flatnonzero(np.bincount(gram))
            place = np.zeros(int(found[-1]) + 1, np.int64)
            place[found] = np.arange(len(found))
            column = place[gram]
        else:
            found, column = np.unique(gram, return_inverse=True)
        letters = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
        rotated = [np.roll(letters, GRAM - 1 - j, axis=1) for j in range(GRAM)]
        owners = np.array([r for r, _ in chunk])
        for at in range(0, len(found), _CHUNK_GRAMS):
            part = found[at:at + _CHUNK_GRAMS]
            bound = np.ones((len(part), dimensions), np.float32)
            for j in range(GRAM):
                bound *= rotated[j][part // size ** (GRAM - 1 - j) % size]
            inside = (column >= at) & (column < at + len(part))
            counts = np.bincount(row[inside] * len(part) + column[inside] - at, minlength=len(chunk) * len(part))
            np.add.at(out, owners, counts.reshape(len(chunk), len(part)).astype(np.float32) @ bound)
    return out


_PART = pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.float64()))])


def _partial_bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in each_batch(batches):
        v = bundles(texts(b)).astype(np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v /= np.where(size > 0, size, 1)
        langs = np.array(b.column(0).to_pylist(), object)
        for lang in set(langs):
            sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(axis=0)
    if sums:
        yield record_batch(_PART, [list(sums), [s.tolist() for s in sums.values()]])


def train(documents: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of the languages, at unit length."""
    small_batches(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                            & (crc32_bucket("doc_id", FOLDS) != HELD_OUT_FOLD)).select("lang", "text")
    parts = known.mapInArrow(_partial_bundles, "lang string, bundle array<double>")
    rows = (parts.select("lang", F.posexplode("bundle").alias("at", "x"))
            .groupBy("lang", "at").agg(F.sum("x").alias("x")))
    bundles: dict[str, np.ndarray] = {}
    for lang, at, x in rows.collect():      # languages x DIMENSIONS numbers
        bundles.setdefault(lang, np.zeros(DIMENSIONS))[at] = x
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(bundles.items())}
    return unit


_SAID = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    small_batches(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())).astype(np.float32) if names else np.zeros((0, DIMENSIONS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            v = bundles(texts(b))
            size = np.linalg.norm(v, axis=1, keepdims=True)
            cosine = (v / np.where(size > 0, size, 1)) @ matrix.T
            lettered = (size[:, 0] > 0) & bool(names)
            best = cosine.argmax(axis=1) if names else np.zeros(len(v), int)
            top = cosine.max(axis=1, keepdims=True) if names else size
            score = 1 / np.exp(SHARPNESS * (cosine - top)).sum(axis=1) if names else np.zeros(len(v))
            said = [names[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
            yield record_batch(_SAID, [b.column(0), said, np.where(lettered, score, 0.0)])

    out = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
           .mapInArrow(run, "doc_id long, lang_pred string, score double"))
    return out.select("doc_id", (crc32_bucket("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"),
                      "lang_pred", "score")
