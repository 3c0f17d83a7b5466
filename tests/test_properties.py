"""Property checks: generated inputs, evaluated in one DataFrame per property,
compared with a plain-Python statement of the rule (brute force)."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campusledger.functions.dates import parse_import_date
from campusledger.functions.semantics import ci_like_any, contains_pattern, escape_like, unsigned

SETTINGS = settings(max_examples=5, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _unsigned_rule(text):
    m = re.match(r"^\s*(\d+)", text or "")
    return int(m.group(1)) if m and len(m.group(1)) < 19 else (0 if not m else None)


@SETTINGS
@given(st.lists(st.one_of(st.text(alphabet=" 0123456789abc-x", max_size=8), st.none()),
                min_size=1, max_size=60))
def test_unsigned_matches_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(unsigned("v")).collect()]
    for v, g in zip(values, got):
        want = _unsigned_rule(v)
        if want is not None:
            assert g == want, (v, g)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1990, 2030), st.integers(1, 99), st.integers(1, 99)),
                min_size=1, max_size=60))
def test_date_rollover_matches_calendar_arithmetic(spark, parts):
    texts = [f"{y:04d}-{m:02d}-{d:02d}" for y, m, d in parts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_import_date("t")).collect()]
    for (y, m, d), g in zip(parts, got):
        # a month/day out of range rolls over: (month - 1) months and (day - 1)
        # days after January 1st of the year
        months = y * 12 + (m - 1)
        want = dt.date(months // 12, months % 12 + 1, 1) + dt.timedelta(days=d - 1)
        assert g == want, ((y, m, d), g)


@SETTINGS
@given(st.lists(st.text(alphabet="ab%_\\", min_size=1, max_size=6), min_size=2, max_size=40),
       st.text(alphabet="ab%_\\", min_size=1, max_size=3))
def test_escaped_search_is_literal_substring(spark, names, needle):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    pattern = contains_pattern(escape_like(needle))
    got = [r[0] for r in df.where(ci_like_any(["n"], pattern)).collect()]
    want = [n for n in names if needle.lower() in n.lower()]
    assert sorted(got) == sorted(want)
