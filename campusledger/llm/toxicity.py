"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the
text of toxic documents that ordinary text does not share. A document is cut
into windows of a few words; each window is compressed with the ordinary
dictionary alone and with both (the toxic one nearest). A window that gets
clearly shorter holds a string typical of toxic text. How many windows save how
many bytes is turned into a score by a logistic calibration on labelled rows
that the dictionaries did not see.

Training is a classifier fit on a bounded sample: at most ``MAX_TOXIC`` toxic
and ``MAX_ORDINARY`` other labelled documents (the first by a hash of their id)
and at most ``MAX_SAMPLE_CHARS`` characters of them. Scoring reads every whole
text. Only labels with ``crc32(doc_id as text) mod 3 != 1`` are learnt from.

Cases: a null or empty text has no window and gets the score of zero evidence
(low, never rejected by itself). Without any toxic (or any other) labelled
document every score is the share of toxic labels. Null labels are not learnt
from; a document labelled twice counts as toxic if either label says so.
Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import crc32_bucket, each_batch, record_batch, small_batches, texts

FOLDS, HELD_OUT_FOLD = 3, 1
MAX_TOXIC, MAX_ORDINARY = 4000, 8000
MAX_SAMPLE_CHARS = 80_000_000
REJECT_SCORE = 0.7

WINDOW_WORDS = 8
SAVINGS = (1, 2, 3, 4, 5)          # bytes saved by a window, counted at or above each
ORDINARY_PARTS, ORDINARY_BYTES = 2, 57_000
TOXIC_BYTES = 8192
_EDGE = b'.,;:!?"\'()[]{}|#*$%&<>-'


def clean_words(text: str) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    words = (w.strip(_EDGE) for w in text.lower().encode("utf-8", "replace").split())
    return [w for w in words if w]


def windows(text: str) -> set[bytes]:
    """The distinct windows of a whole text."""
    w = clean_words(text)
    return {b" " + b" ".join(w[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(w), WINDOW_WORDS)}


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=6, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    # zstandard refuses an empty dictionary and ignores one under 8 bytes
    content = zstandard.ZstdCompressionDict(dictionary.rjust(16, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=content)


@dataclass
class ToxicityModel:
    """Both dictionaries and the calibration; small enough to ship with a task."""

    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base_rate: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def counts(self, text: str) -> np.ndarray:
        """Windows by bytes saved (one count for each of SAVINGS), and all windows."""
        if "_pair" not in self.__dict__:
            self._pair = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        plain, both = self._pair
        saved = [len(plain.compress(w)) - len(both.compress(w)) for w in windows(text)]
        return np.array([*(sum(s >= t for s in saved) for t in SAVINGS), len(saved)], float)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(counts), self.base_rate)
        x = (_features(counts) - self.mean) / self.scale
        z = np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)
        return 1 / (1 + np.exp(-z))


def _features(counts: np.ndarray) -> np.ndarray:
    n, hits = counts[:, -1:] + 1, counts[:, :-1]
    return np.hstack([np.log1p(hits), np.log((hits + 0.3) / (n + 8)), np.log(n)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        w -= np.linalg.solve(h, x.T @ (p - y) + keep * w)
    return w


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """Train on ``(text, toxic)`` rows: every other row of a class calibrates."""
    toxic, other = ([t for t, y in rows if y == k] for k in (1, 0))
    model = ToxicityModel(base_rate=len(toxic) / max(1, len(rows)))
    if len(toxic) < 2 or len(other) < 2:
        return model
    ordinary = [clean_words(t) for t in other[::2]]
    known = {w for d in ordinary for w in d}
    n = len(ordinary)
    model.ordinary = b"".join(
        _trained([b" " + w + b" " for d in ordinary[p * n // ORDINARY_PARTS:(p + 1) * n // ORDINARY_PARTS] for w in d],
                 ORDINARY_BYTES) for p in range(ORDINARY_PARTS))
    # Toxic text without what ordinary text also has. A line counts once however
    # often documents copy it, and a word must recur on several lines.
    lines = dict.fromkeys(line for t in toxic[::2] for line in t.lower().split("\n"))
    found = [{w for w in clean_words(line) if len(w) > 2 and w not in known} for line in lines]
    seen = Counter(w for ws in found for w in ws)
    least = max(2, math.ceil(0.2 * math.sqrt(len(toxic[::2]))))
    model.toxic = _trained([b" " + w + b" " for ws in found for w in sorted(ws) if seen[w] >= least], TOXIC_BYTES)
    held = [(t, 1) for t in toxic[1::2]] + [(t, 0) for t in other[1::2]]
    x = _features(np.stack([model.counts(t) for t, _ in held]))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, np.array([y for _, y in held], float))
    return model


def fit_from_tables(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Draw the bounded sample of labelled rows and train on it."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                          & (crc32_bucket("doc_id", FOLDS) != HELD_OUT_FOLD))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = (known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC)
             .unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_ORDINARY)))
    # The sample is bounded by the two limits above, so it may be broadcast.
    sample = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = sample.where("length(text) > 0")
    # The sample is bounded, so one task can train on it; the driver gets the model only.
    trained = (sample.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions(*order, "text")
               .mapInArrow(_fit_task, _MODEL_SQL))
    row = trained.first()
    if row is None:
        return ToxicityModel()
    return ToxicityModel(bytes(row["ordinary"]), bytes(row["toxic"]), *(np.array(row[c]) for c in
                                                                        ("mean", "scale", "weights")), row["base_rate"])


_MODEL = pa.schema([("ordinary", pa.binary()), ("toxic", pa.binary()), ("mean", pa.list_(pa.float64())),
                    ("scale", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64())), ("base_rate", pa.float64())])
_MODEL_SQL = ("ordinary binary, toxic binary, mean array<double>, scale array<double>, weights array<double>, "
              "base_rate double")


def _fit_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, room = [], MAX_SAMPLE_CHARS
    for b in batches:
        for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            room -= len(text)
            if room >= 0:
                rows.append((text, toxic))
    m = fit(rows)
    yield record_batch(_MODEL, [[m.ordinary], [m.toxic], [m.mean.tolist()], [m.scale.tolist()], [m.weights.tolist()],
                                [m.base_rate]])


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            counts = np.stack([model.counts(t) for t in texts(b)])
            yield record_batch(_SCORED, [b.column(0), model.scores(counts)])

    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", (crc32_bucket("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"), "score",
                         (F.col("score") >= REJECT_SCORE).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that score below ``REJECT_SCORE``, columns unchanged."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            counts = np.stack([model.counts(t or "") for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(model.scores(counts) < REJECT_SCORE))

    return docs.mapInArrow(run, docs.schema)
