"""JSON text columns: attachment lists and edit histories.

Both are stored as JSON text. They are parsed with ``from_json`` into typed
arrays of structs where a query reads their fields. Changes work on the text of
each element instead (:func:`raw_elements`, :func:`with_members`), so whatever a
change does not touch is stored as it was: unknown fields, nested values, strings,
nulls and numbers such as ``2.50``. Parsing rules (see README, "Semantics"):

* falsy text (NULL, ``''``) reads as an empty list;
* malformed text reads as NULL and is flagged, never fails a whole query;
* a lone object is lifted into a one-element list by ``from_json``; callers
  that need a real array check :func:`looks_like_array` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.sources.tables import ATTACHMENT_FIELDS, EDIT_FIELDS
from pyspark.sql import types as T

ATTACHMENTS = T.ArrayType(ATTACHMENT_FIELDS)
EDIT_HISTORY = T.ArrayType(EDIT_FIELDS)

_BLANKS = " \t\n\r"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_json_array(c, schema: T.ArrayType) -> Column:
    """Typed array; NULL for malformed text, empty for NULL or ''."""
    text = _c(c)
    parsed = F.from_json(text, schema)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast(schema)) \
        .otherwise(parsed)


def parse_attachments(c) -> Column:
    return F.coalesce(parse_json_array(c, ATTACHMENTS), F.array().cast(ATTACHMENTS))


def parse_edit_history(c) -> Column:
    return F.coalesce(parse_json_array(c, EDIT_HISTORY), F.array().cast(EDIT_HISTORY))


# Strings, structural signs, and whatever stands between them.
_TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},]|[^"\[\]{},]++'


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column) -> Column:
    """The texts of an array's elements, or of an object's members, as written.

    One pass over the tokens of a well-formed text: a part ends at a comma or
    bracket at depth one. NULL when anything follows the closing bracket.
    """
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), none.alias("done"))

    def step(s, token):
        opens, closes = token.isin("[", "{"), token.isin("]", "}")
        ends = (s["depth"] == 1) & (closes | (token == ","))
        part = F.btrim(s["part"], F.lit(_BLANKS))
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(ends | ((s["depth"] == 0) & opens), F.lit("")).otherwise(F.concat(s["part"], token)).alias("part"),
            F.when(ends & (part != ""), F.concat(s["done"], F.array(part))).otherwise(s["done"]).alias("done"))

    tokens = F.regexp_extract_all(F.btrim(text, F.lit(_BLANKS)), F.lit(_TOKENS), F.lit(0))
    return F.aggregate(tokens, state, step, lambda s: F.when(s["part"] == "", s["done"]))


def raw_elements(c) -> Column:
    """The text of each element as stored; empty for NULL or '', NULL for text that is no array."""
    text = _c(c)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    well_formed = looks_like_array(text) & F.from_json(text, T.ArrayType(T.StringType())).isNotNull()
    return F.when(blank, F.array().cast("array<string>")).when(well_formed, _parts(text))


def is_array_text(c) -> Column:
    """The text is a well-formed array and nothing more.

    Where the only closing bracket is the last character, parsing the array proves it;
    other texts are split.
    """
    def check(t):
        parsed = F.from_json(t, T.ArrayType(T.StringType())).isNotNull()
        return looks_like_array(t) & parsed & ((F.instr(t, "]") == F.length(t)) | _parts(t).isNotNull())

    return F.coalesce(_bound(F.btrim(_c(c), F.lit(_BLANKS)), check), F.lit(False))


def append_elements(c, added: Column) -> Column:
    """The array's text with elements (texts) added at its end; NULL or '' is an empty array."""
    def put(t):
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        return F.when(F.btrim(inner, F.lit(_BLANKS)) == "", raw_array(added)).otherwise(
            F.concat(F.lit("["), inner, F.lit(","), F.array_join(added, ","), F.lit("]")))

    return _bound(F.coalesce(F.btrim(_c(c), F.lit(_BLANKS)), F.lit("")), put)


def is_object(part: Column) -> Column:
    """The element is an object (not a string, number, list, true, false or null)."""
    return part.startswith("{")


def with_members(part: Column, members: dict[str, Column]) -> Column:
    """An object's text with members set (values as JSON text), the others as they were.

    A member that is there keeps its place, a new one goes to the end. Elements
    that are no objects stay as they are.
    """
    def key(m):
        return F.regexp_extract(m, r'^"((?:[^"\\]|\\.)*)"', 1)

    def put(m):
        out = m
        for name, value in members.items():
            out = F.when(key(m) == name, F.concat(F.lit(f'"{name}":'), value)).otherwise(out)
        return out

    def rebuilt(found):
        keys = F.transform(found, key)
        absent = [F.when(~F.array_contains(keys, name), F.concat(F.lit(f'"{name}":'), value)) for name, value in members.items()]
        every = F.concat(F.transform(found, put), F.filter(F.array(*absent), lambda x: x.isNotNull()))
        return F.concat(F.lit("{"), F.array_join(every, ","), F.lit("}"))

    return F.when(is_object(part), _bound(_parts(part), rebuilt)).otherwise(part)


def raw_array(parts: Column) -> Column:
    """JSON text of an array from the texts of its elements."""
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def raw_array_or_null(parts: Column) -> Column:
    """JSON text of an array; an empty one is stored as NULL."""
    return _bound(parts, lambda p: F.when(F.size(p) > 0, raw_array(p)))


def is_malformed(c, schema: T.ArrayType = ATTACHMENTS) -> Column:
    """True when the text is present but not parseable (audit flag)."""
    text = _c(c)
    return (F.coalesce(F.trim(text), F.lit("")) != "") & F.from_json(text, schema).isNull()


def looks_like_array(c) -> Column:
    """The text starts with ``[`` (an object is not a list for the file screens)."""
    return F.coalesce(F.ltrim(_c(c), F.lit(_BLANKS)).startswith("["), F.lit(False))


def listed(text: Column) -> Column:
    """Rows the certificate screen reads: text present, not 'null', not '[]', not '', and an actual JSON array."""
    return (text.isNotNull() & (F.lower(text) != "null") & (text != "[]") & (text != "")
            & looks_like_array(text))


def stored_files(df: DataFrame, column: str) -> tuple[Column, Column]:
    """The typed list of a JSON column and whether it is a list: as stored by a clustered table, else parsed here."""
    if f"_f_{column}" in df.columns:
        return F.col(f"_f_{column}"), F.coalesce(F.col(f"_l_{column}"), F.lit(False))
    return F.from_json(F.col(column), ATTACHMENTS), listed(F.col(column))


def has_medical_file(c) -> Column:
    """Any element has ``isMedical`` true; missing fields and bad text are false. ``c``: the text, or the typed list."""
    arr = c if isinstance(c, Column) else F.from_json(_c(c), ATTACHMENTS)
    # the field of all elements, so that only this field is read or parsed
    return F.coalesce(F.array_contains(arr["isMedical"], True), F.lit(False))


def to_json_or_null(arr: Column) -> Column:
    """Serialise a list; an empty list is stored as NULL."""
    return F.when(F.size(arr) > 0, F.to_json(arr))
