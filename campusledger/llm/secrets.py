"""Secret scan: keyword prefilter, anchored patterns, embedded checksums.

An Aho-Corasick automaton over all keywords reads a text once; a pattern is
tried only at the places where its keyword stands, anchored there. As every
pattern begins with its keyword, taking the hits in order and skipping those
inside an earlier match gives the leftmost non-overlapping matches. Long runs
of hexadecimal digits have no keyword and are found by a pattern of their own.
Token formats that carry a checksum are kept only if the checksum holds.

Kinds, in this order: ``assign`` (a name such as password or api_key, then ``:``
or ``=``, then a value of 6 characters or more; the span is the whole
assignment), ``access`` (AKIA key ids of 20 characters or more), ``hex`` (24
lower-case hexadecimal digits or more), ``github`` and ``npm`` (prefixed tokens
whose last 6 characters are the base-62 CRC-32 of the 30 before them).

Cases: a null text reads as empty and has no spans. Offsets are code points,
ends exclusive. Every row gets a row, repeated rows too; extra columns are
ignored. Texts are scanned whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import each_batch, record_batch, small_batches, texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc32_base62(payload: str) -> str:
    """Six base-62 digits of the CRC-32 of an ASCII payload."""
    value, out = zlib.crc32(payload.encode("ascii")), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _checksum_holds(m: re.Match) -> bool:
    return crc32_base62(m[1]) == m[2]


# kind -> (keywords, pattern that begins with one of them, what a match must fulfil)
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (("akia",), _ACCESS, lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, _checksum_holds),
    "npm": (("npm_",), _NPM, _checksum_holds),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for k in keywords:
            a.add_word(k, (kind, len(k)))
    a.make_automaton()
    return a


def _ascii_lower(text: str) -> str:
    """A-Z lower-cased, every character in its place."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` of a text by start, then kind."""
    hits = sorted((end - size + 1, kind) for end, (kind, size) in keywords.iter(_ascii_lower(text)))
    found, done = [], dict.fromkeys(RULES, 0)
    for start, kind in hits:
        if start >= done[kind]:
            _, pattern, holds = RULES[kind]
            if m := pattern.match(text, start):
                done[kind] = m.end()
                if holds(m):
                    found.append((kind, start, m.end()))
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, spans (kind, start, end), one row each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for b in each_batch(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, keywords)] for t in texts(b)]
            yield record_batch(_FOUND, [b.column(0), spans])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in BASE_KINDS),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
