import pytest
from llm_fixtures import prose

from campusledger.llm.common import small_batches

# Columns that operators use internally, as extra columns of the input.
CLASHING = "key string, sid long, host string, row long, block long, words string, line string, band long, root long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
N_EXTRA = CLASHING.count(",") + 1


@pytest.fixture(scope="session")
def make_docs(spark):
    """DataFrame of (doc_id, text[, lang, source]) rows, with clashing extra columns."""
    small_batches(spark, 7)

    def make(rows, parts=3):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, *(["x", None, "h"] * 3)[:N_EXTRA]))
        fixed = [tuple(v if not isinstance(v, str) or i < 4 else (v if t == "string" else 1)
                       for i, (v, t) in enumerate(zip(f, [c.split()[1] for c in SCHEMA.split(", ")]))) for f in full]
        df = spark.createDataFrame(fixed, SCHEMA)
        return df.repartition(parts) if fixed else df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, short, very long, repeated rows."""
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, prose(5, 30_000)), (6, prose(6, 200)), (6, prose(6, 200)),
            (None, prose(7, 120)), (8, None, "en", "s"), (9, "word " * 4000)]
