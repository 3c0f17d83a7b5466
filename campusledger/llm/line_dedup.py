"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Every line with a word is a node of its distinct text. Its character shingles
are hashed once; a signature value is the smallest shingle hash after an
exclusive or with a constant, which orders the hashes anew for each constant.
Lines that share a band of signature values, and about half of all their values
(compared by one byte of each), are candidates. Candidates are confirmed by the
exact Jaccard similarity of their shingle sets, and confirmed links are joined
by distributed union-find. Of each component the first line
(by document, then place) stays.

Shuffles: the distinct lines once, with their text; band keys and line numbers; the
lines by number once, to pick those that share a band; then only those; last, (line hashes, document, place) to
mark every occurrence. Copies of a line collapse before they are shuffled, so a
line that a third of all documents hold is one row per map task. Signatures are
built by exploding shingles straight into a partial aggregate: nothing of that
size is shuffled or kept. Lines are told apart by two independent 64-bit hashes.

Before two lines are compared by their shingle sets, bit maps of the sets are: where the bits
that differ are more than two similar lines can have, the pair is done with. That is exact.

In each band the members are held against the smallest. Members of one band that
are in different components after that are held against each other, block by
block inside single rows. A row gives one link per line at most, and rows that had
more are looked at again with the components joined so far, until none is left.

Cases: null or empty texts have no lines; lines without a word are left alone.
Lines shorter than a shingle are one shingle. A null ``doc_id`` sorts last, so
other documents keep the line before it. In ``line_classes`` rows that repeat a
``doc_id`` share its line places: a line kept in one is kept in both;
``drop_duplicate_lines`` tells them apart by their text. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import keyed_rows, release, stored
from campusledger.llm.components import components

SHINGLE_CHARS = 8
BANDS, BAND_VALUES = 8, 3      # a pair at 0.8 shares no band with probability 0.3 %
MIN_EQUAL = 10                 # of the 24 values, for a candidate: a pair at 0.8 has fewer with probability 0.001 %
SIMILARITY_PERCENT = 80
SPACES = " \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]
BYTES = ["s0", "s1", "s2", "s3"]     # 4 x 6 = BANDS * BAND_VALUES

STRIDE = [f"h{j}" for j in range(8)]     # shingles hashed in one row
MAP = [f"b{j}" for j in range(16)]       # a bit for each of 1,024 classes of shingle hashes
BLOCK = 256                    # lines held against each other at once in a crowded band
_PLACES = 1 << 20              # more than the lines of a block

_GOLDEN = 0x9E3779B97F4A7C15


def _constants(n: int) -> list[int]:
    """Constants spread evenly over the hash space, as signed 64-bit numbers."""
    values = [(i * ((1 << 64) // n) + i * _GOLDEN % ((1 << 64) // n)) % (1 << 64) for i in range(n)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def line_occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, and its hashes k1, k2, of every line with a word."""
    at = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    at = at.where(F.length(F.btrim("line", F.lit(SPACES))) > 0)
    return at.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), F.col("line"))})


def _first(column: str = "first") -> Column:
    """The earliest occurrence: smallest document, nulls last, then smallest place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"),
                          F.col("line_no").alias("line_no"))).alias(column)


def _strides(lines: DataFrame, shingle: int) -> DataFrame:
    """``lines`` with ``units`` (UTF-16BE) -> a row for every few shingles, with their hashes; the last one may repeat."""
    others = [c for c in lines.columns if c != "units"]
    last = F.greatest((F.octet_length("units") / 2).cast("int") - shingle, F.lit(0))
    d = lines.select("*", last.alias("last"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(len(STRIDE)))).alias("i"))
    return d.select(*others, *(F.xxhash64(F.substr("units", 2 * F.least(F.col("i") + j, F.col("last")) + 1, F.lit(2 * shingle)))
                               .alias(h) for j, h in enumerate(STRIDE)))


def signatures(lines: DataFrame, shingle: int) -> DataFrame:
    """``lines`` (k1, k2, line, first), one row per key -> k1, k2, band keys, one byte of each value."""
    # ``place`` keeps this side's columns those of ``lines``, so that a join of
    # the two shuffles (and dedups) the lines once, not once for each side.
    d = _strides(lines.select(*KEY, F.encode("line", "UTF-16BE").alias("units"), F.hash("first").alias("place")), shingle)
    low = [F.min(F.least(*(F.col(h).bitwiseXOR(F.lit(c)) for h in STRIDE))).alias(f"m{n}")
           for n, c in enumerate(_constants(BANDS * BAND_VALUES))]
    d = d.groupBy(*KEY).agg(*low, F.max("place").alias("place"))
    keys = [F.xxhash64(F.lit(b), *(f"m{b * BAND_VALUES + j}" for j in range(BAND_VALUES))) for b in range(BANDS)]

    def packed(n):     # six bytes: the eighth stays free, so that sums of bytes cannot overflow
        return reduce(Column.bitwiseOR, (F.shiftleft(F.col(f"m{n + j}").bitwiseAND(F.lit(255)), 8 * j) for j in range(6)))
    return d.select(*KEY, F.array(*keys).alias("bands"), *(packed(6 * n).alias(c) for n, c in enumerate(BYTES)), "place")


def equal_values(x: str, y: str) -> Column:
    """How many of the packed bytes agree."""
    def differing(c):
        d = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        carried = (d.bitwiseAND(F.lit(0x7F7F7F7F7F7F)) + F.lit(0x7F7F7F7F7F7F)).bitwiseOR(d)
        return F.bit_count(carried.bitwiseAND(F.lit(0x808080808080)))
    return F.lit(BANDS * BAND_VALUES) - sum((differing(c) for c in BYTES), F.lit(0))


def shingle_maps(lines: DataFrame, shingle: int) -> DataFrame:
    """``lines`` (sid, line) -> sid, map: ``n`` (places of shingles) and the bits MAP of the shingles that are there."""
    d = lines.select("sid", F.encode("line", "UTF-16BE").alias("units")).repartition("sid")
    last = F.greatest((F.octet_length("units") / 2).cast("int") - shingle, F.lit(0))
    d = d.select("sid", "units", last.alias("last")).select("sid", "units", "last", F.explode(F.sequence(F.lit(0), "last")).alias("i"))
    d = d.select("sid", "last", F.xxhash64(F.substr("units", 2 * F.col("i") + 1, F.lit(2 * shingle))).alias("h"))
    # ``sid`` deals out both groupings, so nothing of this size is shuffled
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 4) & 63 AS int))")
    d = d.groupBy("sid", "last", F.col("h").bitwiseAND(F.lit(15)).alias("slot")).agg(F.bit_or(bit).alias("bits"))
    bits = (F.coalesce(F.bit_or(F.when(F.col("slot") == j, F.col("bits"))), F.lit(0).cast("long")).alias(c) for j, c in enumerate(MAP))
    return d.groupBy("sid").agg((F.max("last") + 1).alias("n"), *bits).select("sid", F.struct("n", *MAP).alias("map"))


def may_be_similar(x: Column, y: Column, percent: int) -> Column:
    """False only if the MAP bits of ``x`` and ``y`` alone rule the similarity out.

    Each bit that differs is a shingle of one side that the other lacks, and similar sets
    differ in ``(100 - percent) / (100 + percent)`` of all their shingles at most.
    """
    most = (100 - percent) * (x["n"] + y["n"])

    def differing(names):
        return reduce(Column.__add__, (F.bit_count(x[c].bitwiseXOR(y[c])) for c in names))
    half = len(MAP) // 2
    return (most >= (100 + percent) * differing(MAP[:half])) & (most >= (100 + percent) * differing(MAP))


def shingles(line: Column, shingle: int, hashed=F.xxhash64) -> Column:
    """The distinct character shingles of a line, as hashes."""
    def of(units):
        last = F.greatest((F.octet_length(units) / 2).cast("int") - shingle, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: hashed(
            F.substr(units, 2 * i + 1, F.lit(2 * shingle)))))
    # the one-element array binds the encoded line, so it is encoded once
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), of), F.lit(0))


def _confirmed(pairs: DataFrame, lines: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the stored pairs ``(a, b)`` of line numbers, those similar enough."""
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    lines = stored(lines.select("sid", "line").join(ids.hint("merge"), "sid", "left_semi"), "lines-some")
    x = lines.select(F.col("sid").alias("a"), F.col("line").alias("x"))
    y = lines.select(F.col("sid").alias("b"), F.col("line").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    # explode(array(...)) holds a value: Catalyst neither repeats nor inlines it
    both = both.select("a", "b", "y", F.explode(F.array(shingles(F.col("x"), shingle))).alias("sx"))
    both = both.select("a", "b", "sx", F.explode(F.array(shingles(F.col("y"), shingle))).alias("sy"))
    both = both.select("a", "b", "sx", "sy", F.explode(F.array(F.size(F.array_intersect("sx", "sy")))).alias("n"))
    found = stored(both.where(100 * F.col("n") >= percent * (F.size("sx") + F.size("sy") - F.col("n")))
                   .select("a", "b"), "lines-confirmed")
    release(lines)
    return found


def _block_links(members: DataFrame, lines: DataFrame, shingle: int, percent: int, todo: DataFrame | None) -> DataFrame:
    """band, i, j, links, more: links between members of one band in different components.

    The members of a band are dealt into blocks, and each pair of blocks is one
    row holding at most ``2 * BLOCK`` lines. All its pairs are compared inside the
    row, by their maps first; shingle sets are made of the lines in a pair that is left.
    Of the links found there each line keeps one, to the first line it is similar
    to, so a row has no more links than lines (as in Boruvka's algorithm each component
    with a link keeps one); ``more`` tells that there were others. ``todo`` names the
    rows to look at (``None``: all).
    """
    parts = F.ceil(F.col("members") / BLOCK)
    m = (members.withColumn("part", F.pmod(F.xxhash64("sid"), parts).cast("long"))
         .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
         .select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                 "part", "sid", "root"))
    if todo is not None:
        m = m.join(todo, ["band", "i", "j"], "left_semi")
    if "map" not in lines.columns:
        lines = lines.join(shingle_maps(lines, shingle), "sid")
    ids = (members if todo is None else m).select("sid").distinct()
    text = lines.select("sid", "bands", "map", "line").join(ids.hint("merge"), "sid", "left_semi")
    m = m.join(text, "sid")
    rows = m.groupBy("band", "i", "j").agg(F.collect_list(F.struct("part", "sid", "root", "bands", "map", "line")).alias("all"))

    def possible(x, y):
        once = F.array_min(F.array_intersect(x["bands"], y["bands"])) == F.col("band")
        return ((x["root"] != y["root"]) & ((F.col("i") < F.col("j")) | (x["sid"] < y["sid"]))
                & may_be_similar(x["map"], y["map"], percent) & once)

    def partners(x, at):        # pairs as numbers: places in x and y; nothing larger is kept of a pair
        return F.filter(F.transform("y", lambda y, to: F.when(possible(x, y), at.cast("long") * _PLACES + to)),
                        lambda c: c.isNotNull())

    def similar(c):
        x, y = (F.get(F.col(side), at.cast("int")) for side, at in (("hx", F.floor(c / _PLACES)), ("hy", c % _PLACES)))
        smaller, larger = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
        # (100 + percent) * both >= percent * (all of x + all of y) says 100 * both >= percent * union
        return ((100 * smaller >= percent * larger)
                & ((100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))))

    def hashed(side, places):   # the shingles of those lines of a side that are in a pair
        return F.explode(F.array(F.transform(side, lambda v, at: F.when(
            F.array_contains(places, at.cast("long")), shingles(v["line"], shingle)))))

    def turned(c):
        return c % _PLACES * _PLACES + F.floor(c / _PLACES)

    def firsts(name):           # of the pairs of one line, which stand together, the first
        return F.filter(name, lambda c, at: F.coalesce(
            F.floor(F.get(F.col(name), at - 1) / _PLACES) != F.floor(c / _PLACES), F.lit(True)))

    def link(c):
        return F.struct(F.get(F.col("x"), F.floor(c / _PLACES).cast("int"))["sid"].alias("a"),
                        F.get(F.col("y"), (c % _PLACES).cast("int"))["sid"].alias("b"))

    rows = rows.select("band", "i", "j", F.filter("all", lambda v: v["part"] == F.col("i")).alias("x"),
                       F.filter("all", lambda v: v["part"] == F.col("j")).alias("y"))
    rows = rows.select("*", F.explode(F.array(F.flatten(F.transform("x", partners)))).alias("near")).where(F.size("near") > 0)
    rows = rows.select("*", F.explode(F.array(F.array_distinct(F.transform("near", lambda c: F.floor(c / _PLACES))))).alias("px"),
                       F.array_distinct(F.transform("near", lambda c: c % _PLACES)).alias("py"))
    rows = rows.select("*", hashed("x", F.col("px")).alias("hx")).select("*", hashed("y", F.col("py")).alias("hy"))
    near = F.explode(F.array(F.filter("near", similar))).alias("near")

    def bare(side):
        return F.transform(side, lambda v: F.struct(v["sid"].alias("sid"))).alias(side)

    rows = rows.select("band", "i", "j", "x", "y", near).where(F.size("near") > 0)
    rows = rows.select("band", "i", "j", "near", bare("x"), bare("y"))
    rows = rows.select("*", F.explode(F.array(F.sort_array(F.transform("near", turned)))).alias("back"))
    links = F.array_union(F.transform(firsts("near"), link), F.transform(firsts("back"), lambda c: link(turned(c))))
    return (rows.select("band", "i", "j", links.alias("links"), F.size("near").alias("n"))
            .select("band", "i", "j", "links", (F.col("n") > F.size("links")).alias("more")))


def line_classes(docs: DataFrame, shingle: int = SHINGLE_CHARS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per line with a word: doc_id, line_no, class_doc_id, class_line_no, kept.

    The class is named by its first line, the one that is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = line_occurrences(docs)
    distinct = found.groupBy(*KEY).agg(F.first("line").alias("line"), _first())
    signed = signatures(distinct, shingle)
    lines = stored(distinct.join(signed, KEY).where(F.col("place").isNotNull())
                   .select(*KEY, "line", "first", "bands", *BYTES, F.monotonically_increasing_id().alias("sid")), "lines")

    member = lines.select("sid", F.explode("bands").alias("band"))
    lead = (member.groupBy("band").agg(F.min("sid").alias("lead"), F.max("sid").alias("last"))
            .where("lead != last").select("band", "lead"))
    shared = stored(member.join(lead, "band"), "lines-shared")
    # From here on only lines that share a band are read with their text. Text and signature
    # are picked out one after the other, so that only one of them is shuffled at a time.
    ids = shared.select("sid").distinct().hint("merge")
    text = stored(lines.select("sid", "line").join(ids, "sid", "left_semi"), "lines-text")
    signs = stored(lines.select("sid", "bands", *BYTES).join(ids, "sid", "left_semi"), "lines-signs")
    own = stored(lines.select(*KEY, "sid", "first"), "lines-own")
    release(lines)
    maps = stored(shingle_maps(text, shingle), "lines-maps")
    lines = text.join(signs.select("sid", "bands"), "sid").join(maps, "sid")
    values = signs.join(maps, "sid").select("sid", F.struct(*BYTES, "map").alias("values"))
    stars = shared.where("sid != lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    stars = (stars.join(values.select(F.col("sid").alias("a"), F.col("values").alias("x")), "a")
             .join(values.select(F.col("sid").alias("b"), F.col("values").alias("y")), "b")
             .where((equal_values("x", "y") >= MIN_EQUAL) & may_be_similar(F.col("x.map"), F.col("y.map"), percent))
             .select("a", "b"))
    stars = stored(stars, "lines-pairs")
    links = _confirmed(stars, text, shingle, percent)
    release(stars)
    roots = stored(components(links), "lines-roots")

    # Residual: members of one band in different components, until no link joins two of them.
    todo, rounds = None, []
    while True:
        placed = (shared.select("band", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
                  .select("band", "sid", F.coalesce("root", "sid").alias("root")))
        split = (placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"),
                                            F.count("*").alias("members")).where("r0 != r1"))
        open_ = stored(placed.join(split.select("band", "members"), "band"), "lines-open")
        rounds.append(stored(_block_links(open_, lines, shingle, percent, todo), "lines-linked"))
        release(open_, roots)
        more = [r.select(F.explode("links").alias("p")).select("p.a", "p.b") for r in rounds]
        roots = stored(components(reduce(DataFrame.unionByName, more, links)), "lines-roots")
        todo = rounds[-1].where("more").select("band", "i", "j")
        if todo.isEmpty():
            break
    release(links, shared, text, signs, maps, *rounds)

    # The first line of each class of several texts; other texts stand for themselves.
    in_class = roots.join(own, roots["node"] == own["sid"]).select(*KEY, "root", "first")
    leader = in_class.groupBy("root").agg(F.min("first").alias("class"))
    named = stored(in_class.join(leader, "root").select(*KEY, "class"), "lines-named")
    release(roots)
    named = own.join(named, KEY, "left").select(*KEY, F.coalesce("class", "first").alias("class"))
    out = found.select("doc_id", "line_no", *KEY).join(named, KEY)
    kept = F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("line_no") == F.col("class.line_no"))
    return out.select("doc_id", "line_no", F.col("class.doc_id").alias("class_doc_id"),
                      F.col("class.line_no").alias("class_line_no"), kept.alias("kept"))


def drop_duplicate_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with only the first line of each class left; columns unchanged.

    A document that loses all its lines with a word is dropped: all it says is
    said elsewhere. Documents that lose nothing, have no such line, or have no
    ``doc_id`` stay as they are. Rows that repeat a ``doc_id`` with other texts are
    documents of their own; rows equal in both keep the same lines. ``n_chars``, if
    there, follows the new text.
    """
    keyed = keyed_rows(docs)
    classes = line_classes(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), **settings)
    gone = (classes.where(~F.col("kept") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key"))
            .agg(F.collect_set("line_no").alias("gone")))                       # bounded by a document's lines
    # Both sides grow with the corpus: always a sort-merge join, which AQE may split.
    d = keyed.join(stored(gone, "lines-gone").hint("merge"), "key", "left")
    changed = F.col("gone").isNotNull()
    d = d.select("row", "gone", F.explode(F.array(F.when(changed, F.split("row.text", "\n")))).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    d = d.select("row", "gone", "lines", F.explode(F.array(F.when(changed, places))).alias("left"))
    left = F.array_join(F.transform("left", lambda i: F.get(F.col("lines"), i)), "\n")
    d = d.select("row", "gone", F.when(changed, left).otherwise(F.col("row.text")).alias("now"))
    d = d.where(~changed | (F.length(F.btrim("now", F.lit(SPACES))) > 0))
    new = {"text": F.col("now")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("now").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return d.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
