"""MinHash near-dedup by min-max hashing.

Ji et al., "Min-Max Hash for Jaccard Similarity" (2013): under each permutation
keep both the smallest and the largest value of the set. Both agree between two
sets with probability equal to their Jaccard similarity, so half as many hash
evaluations give a signature of the same length, with a smaller variance. The
signature is banded; documents that share a band are candidates, and each
candidate link is confirmed on the full shingle sets.

Steps, all linear in the input but for the residual one:

1. per text: set of 5-word shingles, 128-bit fingerprint of the set, band keys;
2. equal sets collapse to their smallest document (copies never pair up);
3. in each band every set is held against the band's smallest member;
4. verified links are joined to components;
5. residual: sets that share a band but are in different components yet are
   held against each other too, so that a band whose smallest member is not
   similar to the others loses no link. A crowded band is dealt into blocks and
   worked through block by block, where only links leave a task;
6. components of all verified links; documents follow their set.

Cases: a null text or one without words has an empty set, links with nothing
and is kept. A null ``doc_id`` is a document of its own (its ``component_id`` is
null, it is kept). Rows that repeat a ``doc_id`` each get a row, placed by their
own text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import keyed_rows, each_batch, record_batch, small_batches, stored, texts
from campusledger.llm.components import components
from campusledger.llm.words import U, distinct, mix64, seeds, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
PERMUTATIONS = 48     # 96 signature values: a minimum and a maximum of each
BAND_VALUES = 6       # three permutations a band: 16 bands
THRESHOLD_PERCENT = 85

BLOCK = 128           # sets held against each other at once in a crowded band

_CHUNK = 4096


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return distinct(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower()), size))


def min_max_signature(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Columns (minimum, maximum) for each permutation ``x -> x * a mod 2**64``."""
    low = np.full(len(multipliers), np.iinfo(U).max, U)
    high = np.zeros(len(multipliers), U)
    for at in range(0, len(values), _CHUNK):
        p = values[at:at + _CHUNK, None] * multipliers[None, :]
        np.minimum(low, p.min(axis=0), out=low)
        np.maximum(high, p.max(axis=0), out=high)
    return np.stack([low, high], axis=1)


def band_keys(signature: np.ndarray, band_values: int = BAND_VALUES) -> np.ndarray:
    """One 64-bit key per band of ``band_values`` consecutive signature values."""
    rows = signature.reshape(-1)
    rows = rows[:len(rows) // band_values * band_values].reshape(-1, band_values)
    key = np.arange(1, len(rows) + 1, dtype=U)
    for j in range(band_values):
        key = mix64(key * U(0xD6E8FEB86659FD93) + rows[:, j])
    return key.view(np.int64)


_SIGN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()),
                   ("bands", pa.list_(pa.int64()))])


def _signer(size: int, permutations: int, band_values: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = seeds(permutations, 10)
        for b in each_batch(batches):
            n, fp, bands = [], [], []
            for t in texts(b):
                s = shingle_set(t, size)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(min_max_signature(s, multipliers), band_values) if len(s) else [])
            yield record_batch(_SIGN, [b.column(0), n, fp, bands])
    return run


_SETS = pa.schema([("sid", pa.int64()), ("shingles", pa.binary())])


def _set_maker(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            yield record_batch(_SETS, [b.column(0), [shingle_set(t, size).tobytes() for t in texts(b)]])
    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verifier(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep)).cast(_LINK)
    return run


def _set_table(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The full shingle sets of all documents that stand in a pair."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    some = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    return stored(some.mapInArrow(_set_maker(size), "sid long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` of set ids, those whose full sets reach the threshold."""
    x = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_verifier(percent), "a long, b long"), "confirmed")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``."""
    values, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in (*x, *y)])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(x), len(y)), np.float64)
    for at in range(0, len(values), _CHUNK):
        s, e = np.searchsorted(column, [at, at + _CHUNK])
        part = np.zeros((len(x) + len(y), min(_CHUNK, len(values) - at)), np.float32)
        part[row[s:e], column[s:e] - at] = 1
        total += part[:len(x)] @ part[len(x):].T
    return total


def _block_linker(percent: int):
    def run(group):
        low, high = group["i"].iloc[0], group["j"].iloc[0]
        x, y = group[group["part"] == low], group[group["part"] == high]
        sx, sy = ([np.frombuffer(v, U) for v in g["shingles"]] for g in (x, y))
        if not sx or not sy:
            return group.iloc[:0][["sid", "root"]].set_axis(["a", "b"], axis=1)
        both = _overlaps(sx, sy)
        nx, ny = (np.array([len(v) for v in s]) for s in (sx, sy))
        rx, ry = x["root"].to_numpy(), y["root"].to_numpy()
        linked = (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (rx[:, None] != ry[None, :])
        i, j = np.nonzero(linked)
        found = pd.DataFrame({"a": x["sid"].to_numpy()[i], "b": y["sid"].to_numpy()[j], "ra": rx[i], "rb": ry[j]})
        return found.drop_duplicates(["ra", "rb"])[["a", "b"]]
    return run


def _block_links(members: DataFrame, sets: DataFrame, block: int, percent: int) -> DataFrame:
    """Links between components inside crowded bands.

    The members of a band are dealt into blocks; each pair of blocks is one
    small group, so no task ever holds a whole band, and only links leave it.
    """
    parts = F.ceil(F.col("members") / block)
    m = (members.withColumn("part", F.pmod(F.xxhash64("sid"), parts).cast("long"))
         .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
         .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                 "part", "sid", "root"))
    m = m.join(sets.hint("merge"), "sid")
    return stored(m.groupBy("key", "i", "j").applyInPandas(_block_linker(percent), "a long, b long"), "confirmed")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS,
                    band_values: int = BAND_VALUES, percent: int = THRESHOLD_PERCENT,
                    block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest ``doc_id`` reachable over links of Jaccard
    similarity ``percent``/100 or more between sets of ``shingle_words``-word
    shingles. At that similarity a link shares no band with probability
    ``(1 - s**band_values) ** bands`` (0.05 % with the defaults).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_signer(shingle_words, permutations, band_values),
                                    "doc_id long, n_shingles long, fp binary, bands array<long>"), "signed")
    full = signed.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    sets = full.groupBy("fp").agg(F.min("doc_id").alias("sid"), F.max("n_shingles").alias("n"))
    bands = stored(full.select("fp", F.col("doc_id").alias("sid"), "bands").join(sets, ["fp", "sid"])
                   .select("sid", "n", F.explode("bands").alias("key")).distinct(), "bands")

    lead = bands.groupBy("key").agg(F.min("sid").alias("lead"), F.max("sid").alias("last"),
                                    F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    lead = lead.where(F.col("lead") != F.col("last"))
    stars = (bands.join(lead, "key").where(F.col("sid") != F.col("lead"))
             .select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct())
    stars = stored(stars, "pairs")
    shingles = _set_table(stars, docs, shingle_words)
    links = _confirmed(stars, shingles, percent)
    roots = stored(components(links), "roots")

    # Residual: members of one band in different components.
    placed = (bands.join(lead.select("key"), "key")
              .join(roots.withColumnRenamed("node", "sid"), "sid", "left")
              .select("key", "sid", "n", F.coalesce("root", "sid").alias("root")))
    split = (placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"),
                                       F.count("*").alias("members")).where("r0 != r1"))
    open_ = stored(placed.join(split.select("key", "members"), "key"), "open")
    few, many = open_.where(F.col("members") <= block), open_.where(F.col("members") > block)
    x, y = few.alias("x"), few.alias("y")
    rest = (x.join(y, F.col("x.key") == F.col("y.key"))
            .where((F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))
                   & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
            .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
            .join(stars, ["a", "b"], "left_anti"))
    more = _confirmed(rest, shingles, percent).unionByName(_block_links(many, shingles, block, percent))
    roots = components(links.unionByName(more))

    placed = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    placed = placed.select("fp", F.coalesce("root", "sid").alias("root"))
    out = signed.select("doc_id", "n_shingles", "fp").join(placed, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose document is the one kept of its group.

    Rows that repeat a ``doc_id`` with other texts are documents of their own; of
    rows equal in both one stays. Rows without a ``doc_id`` stay.
    """
    keyed = keyed_rows(docs)
    near = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), **settings)
    gone = near.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    repeated = keyed.where(F.col("key").isNotNull()).groupBy("key").count().where("count > 1").select("key")
    repeated = stored(repeated, "repeated")
    kept = keyed.join(gone, "key", "left_anti")
    once = kept.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(repeated, "key", "left_anti").unionByName(once).select("row.*")
