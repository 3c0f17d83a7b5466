"""Attachment lists and edit histories.

Attachment lists are JSON text per record. Flattening uses ``posexplode`` on
the parsed array, which is a narrow operator: each task flattens its own
records, nothing is shuffled. Filters on file fields are applied to the
array (``filter``) before it is exploded, so only matching files become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusledger.functions.jsoncols import (ATTACHMENTS, EDIT_HISTORY, append_elements, is_array_text,
                                             is_malformed, is_object,
                                             parse_attachments, parse_edit_history, raw_array,
                                             raw_array_or_null, raw_elements, stored_files, with_members)
from campusledger.functions.semantics import epoch_millis, first_present, iso_millis

# Accepted uploads.
RECORD_MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
)
IMPORT_MIME_TYPES = (
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "text/csv",
    "application/csv",
)
IMPORT_EXTENSIONS = (".xlsx", ".xls", ".csv")
CASE_FILE_EXTENSIONS = (".pdf", ".docx")
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILES = 5
STORED_NAME_PREFIX = {"OPD": "OPDMC_", "GCO": "GCO_"}
DEFAULT_EDITOR = {"case": "OPD", "counseling": "GCO", "medical": "INF"}


# ---- O40: parse ------------------------------------------------------------

def parsed_lists(df: DataFrame, attachments: str, history: str) -> DataFrame:
    """Per record: typed attachment and history arrays plus audit flags."""
    return df.withColumns({
        "_attachments": parse_attachments(attachments),
        "_history": parse_edit_history(history),
        "_attachments_malformed": is_malformed(attachments, ATTACHMENTS),
        "_history_malformed": is_malformed(history, EDIT_HISTORY),
    })


def attachment_stats(df: DataFrame, id_col: str, attachments: str, history: str) -> DataFrame:
    """Counts of files and edits per record, with the malformed flags."""
    p = parsed_lists(df, attachments, history)
    return p.select(F.col(id_col).alias("record_id"),
                    F.size("_attachments").cast("bigint").alias("file_count"),
                    F.size("_history").cast("bigint").alias("edit_count"),
                    F.col("_attachments_malformed").alias("attachments_malformed"),
                    F.col("_history_malformed").alias("history_malformed"))


# ---- O41 / O42: flattened certificate files ---------------------------------

def attachment_files(medical: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per stored file of the medical records."""
    stored, is_list = stored_files(medical, "mr_attachments")
    recs = medical.where(is_list).select(
        "mr_medical_id", "mr_student_id", "mr_student_name", "mr_record_date",
        "mr_is_medical", "mr_is_psychological", stored.alias("_files"))
    files = recs.select("*", F.posexplode("_files").alias("_idx", "f"))
    out = files.select(
        # the id's time part is the record date's epoch milliseconds at whole
        # seconds (the date is re-read from its text form, which has no ms)
        F.concat(F.col("mr_medical_id").cast("string"), F.lit("-file-"),
                 F.col("_idx").cast("string"), F.lit("-"),
                 (F.floor(epoch_millis("mr_record_date") / 1000) * 1000).cast("bigint")
                 .cast("string")).alias("fileId"),
        F.col("mr_medical_id").alias("recordId"),
        F.col("mr_student_id").alias("studentId"),
        F.col("mr_student_name").alias("studentName"),
        first_present(F.col("f.originalname"), F.col("f.filename")).alias("fileName"),
        F.col("f.filename").alias("storedFileName"),
        F.col("f.mimetype").alias("fileType"),
        F.col("f.size").alias("fileSize"),
        first_present(F.col("f.uploadDate"), iso_millis("mr_record_date")).alias("uploadDate"),
        F.coalesce(F.nullif(F.col("f.uploadedBy"), F.lit("")), F.lit("Unknown")).alias("uploadedBy"),
        (F.coalesce(F.col("f.isMedical"), F.lit(False)) | (F.col("mr_is_medical") == "Yes"))
        .alias("isMedical"),
        (F.coalesce(F.col("f.isPsychological"), F.lit(False))
         | (F.col("mr_is_psychological") == "Yes")).alias("isPsychological"),
        F.col("f.path").alias("filePath"),
        F.col("mr_record_date").alias("_date"), F.col("_idx"))
    if ordered:
        out = out.orderBy(F.col("_date").desc_nulls_last(), F.col("recordId").desc(), "_idx")
    return out.drop("_date", "_idx")


def _file_filter(type_: str | None, uploaded_by: str | None) -> Column:
    cond = F.lit(True)
    kind = (type_ or "").upper()
    if kind == "MEDICAL":
        cond = cond & F.col("isMedical")
    elif kind == "PSYCHOLOGICAL":
        cond = cond & F.col("isPsychological")
    if uploaded_by:
        cond = cond & (F.upper("uploadedBy") == uploaded_by.upper())
    return cond


def attachment_file_filter(files: DataFrame, type_: str | None = None,
                           uploaded_by: str | None = None) -> DataFrame:
    """Files of one kind and/or uploader."""
    return files.where(_file_filter(type_, uploaded_by))


def attachment_file_counts(files: DataFrame, type_: str | None = None,
                           uploaded_by: str | None = None) -> DataFrame:
    """``totalCount`` and ``filteredCount`` from one pass over the files."""
    return files.agg(F.count(F.lit(1)).cast("bigint").alias("totalCount"),
                     F.count_if(_file_filter(type_, uploaded_by)).cast("bigint")
                     .alias("filteredCount"))


def opd_uploads(medical: DataFrame, uploader: str = "OPD") -> DataFrame:
    """Files uploaded by one office, exact-case match.

    The array is filtered before it is exploded.
    """
    stored, is_list = stored_files(medical, "mr_attachments")
    recs = medical.where(is_list).select(
        "mr_medical_id", "mr_student_id", "mr_student_name", "mr_record_date",
        F.filter(stored, lambda f: f["uploadedBy"] == uploader).alias("_files"))
    return (recs.where(F.size("_files") > 0)
            .select("*", F.posexplode("_files").alias("_idx", "f"))
            .select(F.col("mr_medical_id").alias("recordId"),
                    F.col("mr_student_id").alias("studentId"),
                    F.col("mr_student_name").alias("studentName"),
                    F.col("f.originalname").alias("fileName"),
                    F.col("f.uploadDate").alias("uploadedDate"),
                    F.col("f").alias("fileData")))


# ---- O44: one file of a record ------------------------------------------------

def attachment_lookup(records: DataFrame, id_col: str, attachments: str, requests: DataFrame,
                      match_original: bool = False, keep: tuple = ()) -> DataFrame:
    """For each request ``(record_id, filename)``, the first file whose stored
    name (and, for certificates, original name) equals ``filename``.

    Requests are joined to the records on the id (shuffle or broadcast picked
    by AQE from runtime sizes); requests without a record or a file yield no
    row, the batch form of "not found".
    """
    joined = records.select(F.col(id_col).alias("record_id"), F.col(attachments).alias("_text"),
                            *keep).join(requests, "record_id", "inner")

    def match(f):
        cond = f["filename"] == F.col("filename")
        if match_original:
            cond = cond | (f["originalname"] == F.col("filename"))
        return F.coalesce(cond, F.lit(False))

    found = F.try_element_at(F.filter(F.from_json("_text", ATTACHMENTS), match), F.lit(1))
    return (joined.select("record_id", F.col("filename").alias("requested"), *keep,
                          found.alias("file"))
            .where(F.col("file").isNotNull()))


# ---- O51: merging attachment lists --------------------------------------------

def _field(element: Column, name: str) -> Column:
    """A field of an element's JSON text; NULL where it is no object or lacks the field."""
    return F.when(is_object(element), F.get_json_object(element, f"$.{name}"))


def _without(elements: Column, to_delete: Column) -> Column:
    dels = F.coalesce(to_delete, F.array().cast("array<string>"))
    return F.filter(elements, lambda e: ~F.coalesce(F.array_contains(dels, _field(e, "filename")), F.lit(False)))


def _flag_lookup(classes: Column, name: Column, field: str) -> Column:
    """``classes.find(c => c.filename === name)?.<field>`` (NULL if absent)."""
    hit = F.try_element_at(F.filter(F.coalesce(classes, F.array().cast(
        "array<struct<filename:string,isMedical:boolean,isPsychological:boolean>>")),
        lambda c: c["filename"] == name), F.lit(1))
    return hit[field]


def plain_file_entries(new_files: Column) -> Column:
    """Stored form of a new session's files: the five upload fields only."""
    return F.transform(new_files, lambda f: F.struct(
        f["filename"].alias("filename"), f["originalname"].alias("originalname"), f["mimetype"].alias("mimetype"),
        f["size"].cast("bigint").alias("size"), f["path"].alias("path")))


def new_file_entries(new_files: Column, classes: Column | None, uploader: Column | None,
                     upload_date: Column | None) -> Column:
    """Stored form of newly uploaded files (flags from the classification list)."""
    def entry(f):
        fields = [f["filename"].alias("filename"), f["originalname"].alias("originalname"),
                  f["mimetype"].alias("mimetype"), f["size"].cast("bigint").alias("size"),
                  f["path"].alias("path")]
        if classes is not None:
            fields += [
                F.coalesce(_flag_lookup(classes, f["originalname"], "isMedical"), F.lit(False))
                .alias("isMedical"),
                F.coalesce(_flag_lookup(classes, f["originalname"], "isPsychological"),
                           F.lit(False)).alias("isPsychological")]
        else:
            fields += [F.lit(None).cast("boolean").alias("isMedical"),
                       F.lit(None).cast("boolean").alias("isPsychological")]
        fields += [(uploader if uploader is not None else F.lit(None).cast("string"))
                   .alias("uploadedBy"),
                   (upload_date if upload_date is not None else F.lit(None).cast("string"))
                   .alias("uploadDate")]
        return F.struct(*fields)
    return F.transform(F.coalesce(new_files, F.array().cast(
        "array<struct<filename:string,originalname:string,mimetype:string,size:bigint,path:string>>")),
        entry)


def _reflag(element: Column, classes: Column) -> Column:
    """A kept file with ``class.flag OR file.flag`` for both flags, its other members as they were."""
    name = first_present(_field(element, "originalname"), _field(element, "filename"))
    flags = ("isMedical", "isPsychological")

    def flag(field):
        own = F.coalesce(_field(element, field) == "true", F.lit(False))
        return (F.coalesce(_flag_lookup(classes, name, field), F.lit(False)) | own).cast("string")

    # without classes an element that has both flags stays as it is
    flagged = F.coalesce(_field(element, flags[0]).isin("true", "false") & _field(element, flags[1]).isin("true", "false"),
                         F.lit(False))
    settled = (F.coalesce(F.size(classes), F.lit(0)) <= 0) & flagged
    return F.when(settled, element).otherwise(with_members(element, {f: flag(f) for f in flags}))


def merge_attachments(existing: Column, to_delete: Column, new_files: Column, mode: str, *,
                      classes: Column | None = None, uploader: Column | None = None,
                      upload_date: Column | None = None) -> Column:
    """The elements (JSON texts) of a record's attachment list after an edit.

    ``existing`` is the client's JSON text of the files it keeps (unparsable
    text counts as none). Modes:

    * ``case_update``: new files replace everything, else existing minus deleted;
    * ``case_insert``: existing minus deleted, plus new;
    * ``counseling_update``: existing minus deleted, plus new;
    * ``medical_update``: as counselling, and each kept file's flags become
      ``class.flag OR file.flag`` (looked up by original name, else stored
      name), so a flag is never unset; new files carry uploader and date.

    Kept elements are stored as the client sent them, whatever they hold; the flag
    merge sets two members of an object and leaves its other members as sent.
    """
    none = F.array().cast("array<string>")
    old = _without(F.coalesce(raw_elements(existing), none), to_delete)
    is_medical = mode == "medical_update"
    new = F.transform(new_file_entries(new_files, classes if is_medical else None, uploader if is_medical else None,
                                       upload_date if is_medical else None), lambda f: F.to_json(f))
    if mode == "case_update":
        return F.when(F.size(new) > 0, new).otherwise(old)
    if mode in ("case_insert", "counseling_update"):
        return F.concat(old, new)
    if is_medical:
        return F.concat(F.transform(old, lambda e: _reflag(e, classes)) if classes is not None else old, new)
    raise ValueError(f"unknown mode {mode}")


def merged_json(existing, to_delete, new_files, mode, **kw) -> Column:
    """JSON text of :func:`merge_attachments`; an empty list is stored as NULL."""
    return raw_array_or_null(merge_attachments(existing, to_delete, new_files, mode, **kw))


def remove_attachment(records: DataFrame, id_col: str, attachments: str,
                      requests: DataFrame) -> DataFrame:
    """Delete files by request ``(record_id, filename)``; empty lists become NULL.

    The other elements keep their text, unknown fields included. A list that
    does not parse is left as it is. The names to delete are gathered per
    record, so they are bounded by one record's requests.
    """
    req = requests.groupBy("record_id").agg(F.collect_set("filename").alias("_del"))
    joined = records.join(req.withColumnRenamed("record_id", id_col), id_col, "left")
    parts = raw_elements(attachments)
    new = raw_array_or_null(_without(parts, F.col("_del")))
    return joined.withColumn(attachments, F.when(F.col("_del").isNull() | parts.isNull(), F.col(attachments))
                             .otherwise(new)).drop("_del")


# ---- O52: edit history ----------------------------------------------------------

def append_edit_history(history: Column, editors: Column, as_of: Column) -> Column:
    """Append ``{editedBy, editedAt, timestamp}`` and return the JSON text.

    ``editors`` is an array: one entry per element, in order. Stored entries
    keep their text, unknown fields included; text that does not parse is left
    as it is (callers report the request as ``rejected:malformed``).
    """
    def entry(by):
        return F.to_json(F.struct(by.alias("editedBy"), iso_millis(as_of).alias("editedAt"),
                                  epoch_millis(as_of).alias("timestamp")))
    added = F.transform(editors, entry)
    blank = F.coalesce(F.trim(history), F.lit("")) == ""
    return F.when(blank | is_array_text(history), append_elements(history, added)).otherwise(history)


# ---- O68 / O71: upload checks and stored names --------------------------------------

def _ext(name: Column) -> Column:
    """``path.extname``: from the last dot of the base name, '' if none or leading."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^.+(\.[^.]*)$", 1)


def _basename_no_ext(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.left(base, F.length(base) - F.length(_ext(name)))


def _known(cond: Column) -> Column:
    """An absent MIME type or name is in no list."""
    return F.coalesce(cond, F.lit(False))


def attachment_checks(files: Column, kind: str = "record", max_files: int = MAX_FILES) -> Column:
    """Array of rejection reasons for one request's upload list (empty = valid)."""
    files = F.coalesce(files, F.array())
    if kind == "record":
        ok_type = F.forall(files, lambda f: _known(f["mimetype"].isin(*RECORD_MIME_TYPES)))
    elif kind == "case_file":
        ok_type = F.forall(files, lambda f: _known(F.lower(_ext(f["originalname"])).isin(*CASE_FILE_EXTENSIONS)))
    elif kind == "import":
        ok_type = F.forall(files, lambda f: _known(f["mimetype"].isin(*IMPORT_MIME_TYPES))
                           | _known(F.lower(_ext(f["originalname"])).isin(*IMPORT_EXTENSIONS)))
    else:
        raise ValueError(kind)
    ok_size = F.forall(files, lambda f: F.coalesce(f["size"], F.lit(0)) <= MAX_FILE_BYTES)
    reasons = F.array(
        F.when(~F.coalesce(ok_type, F.lit(True)), F.lit("file_type")),
        F.when(~F.coalesce(ok_size, F.lit(True)), F.lit("file_size")),
        F.when(F.size(files) > max_files, F.lit("file_count")))
    return F.filter(reasons, lambda r: r.isNotNull())


def stored_file_name(original: Column, suffix: Column, uploader: Column | None = None) -> Column:
    """``<prefix><base>-<suffix><ext>``; prefix by uploading office."""
    prefix = F.lit("")
    if uploader is not None:
        prefix = F.coalesce(F.when(uploader == "OPD", F.lit(STORED_NAME_PREFIX["OPD"]))
                            .when(uploader == "GCO", F.lit(STORED_NAME_PREFIX["GCO"])), F.lit(""))
    return F.concat(prefix, _basename_no_ext(original), F.lit("-"), suffix, _ext(original))


def case_file_name(case_id: Column, millis: Column, original: Column) -> Column:
    """``<case>_<ms>_<base><ext>`` with characters outside ``[a-zA-Z0-9._-]`` as ``_``."""
    raw = F.concat(F.coalesce(case_id.cast("string"), F.lit("temp")), F.lit("_"),
                   millis.cast("string"), F.lit("_"), _basename_no_ext(original), _ext(original))
    return F.regexp_replace(raw, r"[^a-zA-Z0-9._-]", "_")
