"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

A word counts by its spelling (lower-cased A-Z) and by its form: its characters by
class (capital, small, digit, each sign for itself; runs as one) together with
whether the three words from it on occur again in the text. The grams are single
words, pairs of words, forms and pairs of forms. Each gram is hashed into one of
``BUCKETS`` weights; its value is the root of its share of the text's grams of its
kind, so a text of any length is a sparse vector of bounded length.

Training follows the regularised leader (McMahan et al., "Ad Click Prediction: a
View from the Trenches", 2013), one document at a time, with a rate per weight. It
learns from at most ``MAX_LABELLED`` labelled documents, drawn by the hash of their
ids. They are dealt to shards of about ``SHARD_ROWS``; every round each shard
streams its documents through the updates from a common state, and the states are
averaged (iterative parameter mixing). The driver sees the averaged state only:
at most ``BUCKETS`` weights and their rates, whatever the input.

Shuffles: the drawn ids are broadcast (``MAX_LABELLED`` rows); only the sample's
sparse vectors, at most ``BUCKETS`` entries each, are dealt to the shards. Scoring
is one pass over the texts, a sparse dot product each. Texts are read whole.

Only rows whose ``crc32(doc_id as text) mod 5`` is not 0 are learnt from, and only
their ``text`` and ``labels.quality`` (0 or 1; anything else is no label).

Cases: a null text is empty; an empty text scores by the intercept alone, as does
every text when nothing could be learnt (then the score is the share of label 1,
1 without any label). Several labels of one document count as the largest; several
rows of one labelled document are each learnt from. Repeated rows get equal
results. A null doc_id is not learnt from and not held out (null). Extra columns are
ignored. Ties in the draw: by id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import crc32_bucket, each_batch, record_batch, small_batches, stored, texts
from campusledger.llm.words import U, mix64, shingle_hashes, word_hashes

FOLDS, HELD_OUT_FOLD = 5, 0
KEEP_SCORE = 0.3
BUCKETS = 1 << 18
MAX_LABELLED = 24_000       # labelled documents learnt from
SHARD_ROWS = 4_000
ROUNDS = 3

# FTRL: rate alpha / (beta + root of the summed squared gradients), l1 and l2 penalties
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.1

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FORM = bytes(0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x30 if 0x30 <= c <= 0x39
              else 0x20 if c in (0x20, *range(0x09, 0x0E)) else c for c in range(256))


def form_hashes(data: bytes) -> np.ndarray:
    """Hashes of the forms of the words of a text, in order."""
    a = np.frombuffer(data.translate(_FORM), np.uint8)
    if not len(a):
        return np.empty(0, U)
    return word_hashes(a[np.concatenate([[True], a[1:] != a[:-1]])].tobytes())


def repeated(hashes: np.ndarray) -> np.ndarray:
    """For each place whether its value stands at another place too."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.empty(len(hashes), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and values of the grams of a text."""
    data = text.encode("utf-8", "replace")
    words, forms = word_hashes(data.translate(_LOWER)), form_hashes(data)
    if not len(words):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    again = np.zeros(len(words), bool)
    if len(words) > 3:
        again[:len(words) - 2] = repeated(shingle_hashes(words, 3))
        again[-2:] = again[-3]
    forms = mix64(forms + again.astype(U))
    kinds = [words, shingle_hashes(words, 2), forms, shingle_hashes(forms, 2)]
    buckets = np.concatenate([mix64(g + U(k << 56)) % U(BUCKETS) for k, g in enumerate(kinds, 1)]).astype(np.int64)
    share = np.concatenate([np.full(len(g), 1 / len(g)) for g in kinds])
    order = np.argsort(buckets, kind="stable")
    buckets, share = buckets[order], share[order]
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets[first].astype(np.int32), np.sqrt(np.add.reduceat(share, first)).astype(np.float32)


class Leader:
    """State of the follow-the-regularised-leader updates; the last entry is the intercept."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BUCKETS + 1) if z is None else z.copy()
        self.n = np.zeros(BUCKETS + 1) if n is None else n.copy()

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(BUCKETS + 1)[at] == BUCKETS, 0, L1) if isinstance(at, slice) else np.where(at == BUCKETS, 0, L1)
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, buckets: np.ndarray, values: np.ndarray, label: int) -> None:
        at = np.append(buckets, BUCKETS).astype(np.int64)
        x = np.append(values, 1).astype(np.float64)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


_EXAMPLE = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
_EXAMPLE_DDL = "doc_id long, quality int, at array<int>, x array<float>"
_STATE = pa.schema([("at", pa.int32()), ("z", pa.float64()), ("n", pa.float64())])
_STATE_DDL = "at int, z double, n double"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(p) for p in parts]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), kind))


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in each_batch(batches):
        found = [features(t) for t in texts(b)]
        yield record_batch(_EXAMPLE, [b.column(0), b.column(2), _lists([f[0] for f in found], pa.int32()),
                                      _lists([f[1] for f in found], pa.float32())])


def draw(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The sparse vectors of the labelled documents to learn from: shard, doc_id, quality, at, x."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                          & (crc32_bucket("doc_id", FOLDS) != HELD_OUT_FOLD))
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    return stored(sample.select("doc_id", "text", "quality").mapInArrow(_examples, _EXAMPLE_DDL), "quality-sample")


def _round(z: np.ndarray, n: np.ndarray):
    """One pass of every shard of the partition from the common state; ``(shard, quality, at, x)`` sorted by shard."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, leader = None, None

        def state() -> pa.RecordBatch:
            at = np.flatnonzero(leader.n)
            return record_batch(_STATE, [pa.array(at, pa.int32()), leader.z[at], leader.n[at]])

        for b in each_batch(batches):
            at, x = b.column(2), b.column(3)
            flat_at, flat_x = at.flatten().to_numpy(), x.flatten().to_numpy()
            bounds = at.offsets.to_numpy() - at.offsets[0].as_py()
            for i, (s, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if s != shard:
                    if leader is not None:
                        yield state()
                    shard, leader = s, Leader(z, n)
                span = slice(bounds[i], bounds[i + 1])
                leader.update(flat_at[span], flat_x[span], y)
        if leader is not None:
            yield state()
    return run


def train(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The weights, the intercept last."""
    small_batches(documents.sparkSession)
    sample = draw(documents, labels)
    rows, good = sample.agg(F.count("*"), F.sum("quality")).first()
    if not rows or good in (0, rows):       # one class only: its rate, near 0 or 1, as the intercept
        flat = np.zeros(BUCKETS + 1)
        flat[-1] = -35.0 if rows and not good else 35.0
        return flat
    shards = -(-rows // SHARD_ROWS)
    key = F.xxhash64("doc_id")
    dealt = sample.withColumn("shard", F.pmod(key, F.lit(shards)))
    leader = Leader()
    for _ in range(rounds):
        passed = (dealt.repartition("shard").sortWithinPartitions("shard", F.xxhash64(key), "doc_id", "at", "x")
                  .select("shard", "quality", "at", "x").mapInArrow(_round(leader.z, leader.n), _STATE_DDL))
        mixed = passed.groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toArrow()
        at = mixed.column("at").to_numpy()              # BUCKETS + 1 rows at most
        leader = Leader()
        leader.z[at], leader.n[at] = mixed.column("z").to_numpy(), mixed.column("n").to_numpy()
    return leader.weights()


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = spark.sparkContext.broadcast(weights.astype(np.float32))      # BUCKETS + 1 weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = kept.value
        for b in each_batch(batches):
            sums = np.array([w[at].astype(np.float64) @ x for at, x in map(features, texts(b))]) + w[-1]
            yield record_batch(_SCORED, [b.column(0), 1 / (1 + np.exp(-np.clip(sums, -35, 35)))])

    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", (crc32_bucket("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"), "score",
                         (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))
