"""Host-level quality rules, in DataFrame functions only.

Per document: counts of words, symbols, repeated lines and words in repeated
three-word windows, and a base rule over them. Per host: documents and base
failures are added up, the failure rates of all hosts give an empirical beta
prior (by moments), and each host's rate is shrunk towards it, so that a host
with few documents is judged by the corpus and one with many by itself. A host
whose shrunk rate is above ``max_host_rate`` loses all its documents.

The counts need one pass over the texts and no shuffle: words and windows stay
in arrays of their row. The counts (no texts) are written to the shared folder
once, then read for the host totals and for the join back. A host holding a
third of all rows meets partial aggregation and a join that AQE may split or
turn into a broadcast of the host table when that is small.

Cases: a null text has no words (and fails the base rule). A null host is not
judged: such a document is kept or not by the base rule alone. Repeated rows
count as often as they occur and each get a row. Windows are compared by a
64-bit hash of their three words within one text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
MAX_PRIOR_STRENGTH = 1000.0     # used when hosts do not differ beyond chance

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that Catalyst computes once and does not inline again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every document row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"))
    d = _held(d, "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    w = F.col("words")
    trio = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))).alias("a"),
                        _shifted(w, 1).alias("b"), _shifted(w, 2).alias("c"))
    trio = F.slice(trio, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    d = _held(d, "windows", F.transform(trio, lambda t: F.xxhash64(t["a"], t["b"], t["c"])))
    h = F.col("windows")

    # Positions of windows that occur twice or more: neighbours in sorted order.
    def with_place(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    d = _held(d, "placed", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(with_place(h)))
              .otherwise(with_place(F.slice(h, 1, 0))))
    p = F.col("placed")
    before = F.concat(F.array(F.lit(None).cast(d.schema["placed"].dataType.elementType)), p)
    near = F.arrays_zip(p.alias("p"), before.alias("q"), _shifted(p, 1).alias("r"))
    repeats = F.filter(near, lambda z: (z["p"]["x"] == z["q"]["x"]) | (z["p"]["x"] == z["r"]["x"]))
    found = F.sort_array(F.transform(repeats, lambda z: z["p"]["i"]))
    d = _held(d, "found", F.when(F.size(p) > 0, found).otherwise(F.transform(p, lambda z: z["i"])))
    # Words covered by those windows: up to the next window, three at most.
    f = F.col("found")
    steps = F.arrays_zip(f.alias("at"), _shifted(f, 1).alias("next"))
    covered = F.aggregate(steps, F.lit(0).cast("long"),
                          lambda n, s: n + F.least(F.lit(3), F.coalesce(s["next"] - s["at"], F.lit(3))))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = _held(d, "lines", lines)
    return d.select(
        "doc_id", "host", F.size(w).cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def with_base_rule(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def host_verdicts(checked: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate (shrunk), host_rejected."""
    hosts = (checked.where(F.col("host").isNotNull()).groupBy("host")
             .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.count("*").alias("hosts"),
                      F.sum(F.col("host_docs") * rate * rate).alias("sq")).first()
    n, mean = total["n"] or 1, (total["f"] or 0) / (total["n"] or 1)
    # Spread of the hosts' rates beyond what binomial chance would give.
    chance = mean * (1 - mean) * (total["hosts"] or 1) / n
    spread = (total["sq"] or 0.0) / n - mean * mean - chance
    strength = MAX_PRIOR_STRENGTH
    if spread > 0:
        strength = min(MAX_PRIOR_STRENGTH, max(0.0, mean * (1 - mean) / spread - 1))
    shrunk = (F.col("host_failed") + strength * mean) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_host_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document row: counts, base_failed, kept, and its host's figures."""
    checked = stored(with_base_rule(document_counts(docs, host)), "quality")
    verdicts = host_verdicts(checked, max_host_rate)
    out = checked.join(verdicts, "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      kept.alias("kept"), "host_docs", "host_failed")


# The same in DuckDB SQL; the constants are those above.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (
  SELECT w.rid, doc_id, host, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*)::BIGINT AS host_docs, sum(base_failed::BIGINT)::BIGINT AS host_failed
      FROM b WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE / sum(host_docs) AS mean, count(*) AS hosts,
             sum(host_docs * (host_failed::DOUBLE / host_docs) * (host_failed::DOUBLE / host_docs)) AS sq FROM h),
s AS (SELECT *, sq / n - mean * mean - mean * (1 - mean) * hosts / n AS spread FROM m),
k AS (SELECT mean, CASE WHEN spread > 0 THEN least(1000.0, greatest(0.0, mean * (1 - mean) / spread - 1))
                        ELSE 1000.0 END AS strength FROM s),
v AS (SELECT host, host_docs, host_failed,
             (host_failed + strength * mean) / (host_docs + strength) > 0.5 AS rejected FROM h CROSS JOIN k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept, host_docs, host_failed
FROM b LEFT JOIN v USING (host)
"""
