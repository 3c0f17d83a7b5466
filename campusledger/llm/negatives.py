"""Hard negatives by exact integer products in a residue number system.

Vectors are whole numbers. For several primes below ``PRIME_BELOW`` the matrices
of anchors and rows are reduced to residues and multiplied in float32, in runs of
``_RUN`` components, so that no sum passes 2**24 and every product is exact. The
Chinese remainder theorem (mixed radix digits) puts the signed score together. As
many primes are taken as the largest component and the longest vector ask for.

The anchors are held against all rows in tiles: both sides are dealt at random
into blocks of bounded size, each anchor block meets each row block once, and a
tile sends on only the best few rows of each anchor. Two rounds of tiles:

1. the anchors' positives: the best rows of the anchor's own label;
2. for each anchor and positive the best rows of other labels whose score lies in
   the window ``low * positive <= 100 * negative <= high * positive`` (percent).

The best of all tiles are the best of their bests. Positives are written to the
shared folder between the rounds; nothing is collected or broadcast.

Cases: rows with a null label, a null vector, or a null or non-finite component
take no part. A vector shorter than another counts as followed by zeros. A row is
itself by its ``vec_id``: rows repeating the anchor's id are not its positives
(they are its negatives where their label differs); a repeated anchor row is an
anchor of its own and gives its rows again; other repeated rows count each. A row
without ``vec_id`` is no anchor and comes last in ties. A score outside the range
of long counts as the nearest long, a component beyond 1e200 as 1e200. No labels in common, or an empty table, give
nothing. Extra columns are ignored. Ties: smaller ``vec_id``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campusledger.llm.common import each_batch, record_batch, stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # the window, in percent of the positive's score
SCALE = 256
ANCHOR_EVERY, NOISE_EVERY, LABELS = 50, 7, 10

PRIME_BELOW = 1024
_RUN = 64                   # components in one float32 product: 64 * 510**2 < 2**24
ANCHORS_IN_TILE, ROWS_IN_TILE = 4096, 8192
_CELLS = 1 << 19            # scores worked on at once
_LARGEST = (1 << 63) - 1
_WIDEST = 1e200            # the primes below PRIME_BELOW tell products of such numbers apart
_NONE = np.iinfo(np.int64).min      # below every score


def primes_for(bound: int) -> list[int]:
    """Primes from ``PRIME_BELOW`` down whose product passes ``2 * bound``."""
    found, product = [], 1
    for p in range(PRIME_BELOW - 1, 2, -2):
        if product > 2 * bound and found:
            return found
        if all(p % q for q in range(3, int(p ** 0.5) + 1, 2)):
            found.append(p)
            product *= p
    if product > 2 * bound:
        return found
    raise ValueError("scores too large for the primes at hand")


def residues(q: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo ``p`` nearest to zero, as float32."""
    r = np.remainder(q, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def signed(remainders: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The numbers of least size with these remainders, by mixed radix digits; clipped to long."""
    product = 1
    for p in primes:
        product *= p
    digits: list[np.ndarray] = []
    for r, p in zip(remainders, primes):
        weight, known = 1, np.zeros(r.shape, np.int64)
        for digit, q in zip(digits, primes):
            known += digit * (weight % p)
            weight = weight * q
        inverse = pow(weight, -1, p)
        digits.append((r.astype(np.int64) - known) % p * inverse % p)
    kind = np.int64 if product < 1 << 62 else object
    x, weight = np.zeros(remainders[0].shape, kind), 1
    for digit, p in zip(digits, primes):
        x = x + digit.astype(kind) * weight
        weight *= p
    x = np.where(x > product // 2, x - product, x)
    return x if kind is np.int64 else np.clip(x, -_LARGEST, _LARGEST).astype(np.int64)


class Residues:
    """A matrix of whole numbers, one row a vector, modulo each prime."""

    def __init__(self, q: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [residues(q, p) for p in primes]

    def __len__(self) -> int:
        return len(self.parts[0])

    def scores(self, rows: slice, others: "Residues", columns: slice = slice(None)) -> np.ndarray:
        """Exact inner products of ``rows`` with the rows ``columns`` of ``others``."""
        out = []
        for p, a, b in zip(self.primes, self.parts, others.parts):
            a, b = a[rows], b[columns]
            width = min(a.shape[1], b.shape[1])         # further components meet zeros
            total = np.zeros((len(a), len(b)), np.float32)
            for at in range(0, width, _RUN):
                end = min(at + _RUN, width)
                part = a[:, at:end] @ b[:, at:end].T
                total = part if at == 0 else np.mod(total, p) + np.mod(part, p)
            out.append(np.mod(total, p))
        return signed(out, self.primes)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists as a matrix, shorter lists followed by zeros."""
    lists = column.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 for null, and which are null."""
    return pc.fill_null(column, 0).to_numpy(), pc.is_null(column).to_numpy()


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, width))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


_FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor long, place int, vec_id long, score long"


def _found(anchors: list, places: list, ids: list, score: list, no_id: list) -> pa.Table:
    def joined(parts: list, kind: type) -> np.ndarray:
        return np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.Table.from_batches([record_batch(_FOUND, [
        pa.array(joined(anchors, np.int64)), pa.array(joined(places, np.int32), pa.int32()),
        pa.array(joined(ids, np.int64), mask=joined(no_id, bool)), pa.array(joined(score, np.int64))])])


def _by_id(rows: pa.Table, *first: str) -> pa.Table:
    """The rows in order of ``first``, then id, null ids last."""
    return rows.sort_by([(c, "ascending") for c in (*first, "vec_id")])


def _positives_in_tile(primes: list[int], wanted: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = anchor_out, places, ids_out, score_out, no_ids = [], [], [], [], []
        if anchors.num_rows and rows.num_rows:
            anchors, rows = _by_id(anchors, "label"), _by_id(rows, "label")
            (ids, no_id), labels = _ids(rows.column("vec_id")), rows.column("label").to_numpy()
            own, own_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
            keys = anchors.column("row").to_numpy()
            a, b = Residues(_matrix(anchors.column("q")), primes), Residues(_matrix(rows.column("q")), primes)
            for label in np.unique(own_labels):
                start, end = np.searchsorted(labels, [label, label + 1])
                first, last = np.searchsorted(own_labels, [label, label + 1])
                if start == end:
                    continue
                for block in _blocks(last - first, end - start):
                    block = slice(block.start + first, block.stop + first)
                    s = a.scores(block, b, slice(start, end))
                    s[(ids[start:end] == own[block][:, None]) & ~no_id[start:end]] = _NONE
                    best = np.argsort(~s, axis=1, kind="stable")[:, :wanted]
                    score = np.take_along_axis(s, best, 1)
                    real = score != _NONE
                    anchor_out.append(np.repeat(keys[block], real.sum(1)))
                    places.append(np.zeros(int(real.sum()), np.int32))
                    ids_out.append(ids[start:end][best][real])
                    no_ids.append(no_id[start:end][best][real])
                    score_out.append(score[real])
        return _found(*out)
    return run


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score with ``low * positive <= 100 * score <= high * positive``."""
    return -(-low * positive // 100), high * positive // 100


def _negatives_in_tile(primes: list[int], wanted: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = anchor_out, places, ids_out, score_out, no_ids = [], [], [], [], []
        if anchors.num_rows and rows.num_rows:
            rows = _by_id(rows)
            (ids, no_id), labels = _ids(rows.column("vec_id")), rows.column("label").to_numpy()
            own_labels, keys = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
            windows = [[window_of(p, low, high) for p in found] for found in anchors.column("scores").to_pylist()]
            a, b = Residues(_matrix(anchors.column("q")), primes), Residues(_matrix(rows.column("q")), primes)
            for block in _blocks(len(a), len(b)):
                s = a.scores(block, b)
                for i, line in zip(range(block.start, block.stop), s):
                    least = min((w[0] for w in windows[i]), default=_LARGEST)
                    at = np.flatnonzero((line >= least) & (labels != own_labels[i]))
                    at = at[np.argsort(~line[at], kind="stable")]
                    falling = ~line[at]
                    for place, (lowest, highest) in enumerate(windows[i]):
                        start, end = np.searchsorted(falling, ~highest, "left"), np.searchsorted(falling, ~lowest, "right")
                        taken = at[start:min(end, start + wanted)]
                        if len(taken):
                            anchor_out.append(np.full(len(taken), keys[i]))
                            places.append(np.full(len(taken), place, np.int32))
                            ids_out.append(ids[taken])
                            no_ids.append(no_id[taken])
                            score_out.append(line[taken])
        return _found(*out)
    return run


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, work) -> DataFrame:
    """Hold every block of anchors against every block of rows."""
    across, down = -(-n_anchors // ANCHORS_IN_TILE), -(-n_rows // ROWS_IN_TILE)
    left = (anchors.withColumn("tile_a", F.pmod(F.xxhash64("row"), F.lit(across)))
            .withColumn("tile_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))))
    # Aliases tell the columns of the two sides apart: both stem from one table.
    right = (rows.select(*(F.col(c).alias(c) for c in rows.columns))
             .withColumn("tile_r", F.pmod(F.xxhash64("row"), F.lit(down)))
             .withColumn("tile_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))))
    return (left.groupBy("tile_a", "tile_r").cogroup(right.groupBy("tile_a", "tile_r"))
            .applyInArrow(work, _FOUND_DDL))


_ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("q", pa.list_(pa.float64())),
                  ("peak", pa.float64()), ("width", pa.int32())])


def whole_numbers(scale: int):
    """Batches of (vec_id, label, anchor, vector): vectors as whole numbers ``floor(scale * x)``, invalid rows left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            b = b.filter(pc.and_(pc.is_valid(b.column(1)), pc.is_valid(b.column(3))))
            lists = b.column(3)
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
            owner = pc.list_parent_indices(lists).to_numpy()
            good = np.bincount(owner[~np.isfinite(flat)], minlength=b.num_rows) == 0
            q = np.floor(np.clip(flat, -_WIDEST, _WIDEST) * scale)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            peak = np.zeros(b.num_rows)
            np.maximum.at(peak, owner, np.where(np.isfinite(q), np.abs(q), 0))
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            made = record_batch(_ROW, [b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(q)),
                                       pa.array(peak), pa.array(lengths, pa.int32())])
            yield made.filter(pa.array(good))
    return run


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Mine ``vectors`` (vec_id long, label, anchor boolean, vector array of numbers).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                          F.coalesce(F.col("anchor"), F.lit(False)), F.col("vector").cast("array<double>"))
    rows = rows.mapInArrow(whole_numbers(scale), "vec_id long, label long, anchor boolean, q array<double>, peak double, width int")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_anchors, peak, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max("peak"), F.max("width")).first()
    primes = primes_for((width or 0) * int(peak or 0) ** 2)
    rows, anchors = rows.select("row", "vec_id", "label", "q"), rows.where("anchor").select("row", "vec_id", "label", "q")
    n, n_anchors = max(n, 1), max(n_anchors, 1)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    chosen = stored(_tiles(anchors, rows, n_anchors, n, _positives_in_tile(primes, positives))
                    .withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    lists = (chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))
             .select(F.col("anchor").alias("row"), F.col("p.score").alias("scores")))
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    mined = (_tiles(anchors.join(lists, "row"), rows, n_anchors, n, _negatives_in_tile(primes, negatives, low, high))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
             .select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"),
                     F.col("score").alias("negative_score")))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (mined.join(chosen.select("anchor", "place", F.col("vec_id").alias("positive_id"),
                                     F.col("score").alias("positive_score")), ["anchor", "place"])
            .join(named, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows of ``embeddings`` as the query takes them: every fiftieth id an anchor, labels of every seventh moved on."""
    return embeddings.select(
        "vec_id", F.when(F.col("vec_id") % NOISE_EVERY == 0, (F.col("label") + 1) % LABELS)
        .otherwise(F.col("label")).alias("label"),
        (F.col("vec_id") % ANCHOR_EVERY == 0).alias("anchor"), F.col("embedding").alias("vector"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p
JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
