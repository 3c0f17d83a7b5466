"""Stored JSON lists: whatever a change does not touch keeps its text."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campusledger.functions import jsoncols as J
from campusledger.operators import attachments as A
from campusledger.operators import changes as C

AS_OF = "2025-06-01 09:00:00"
ENTRY = '{"editedBy":"%s","editedAt":"2025-06-01T09:00:00.000Z","timestamp":1748768400000}'
ODD = ['"text, [with] {signs} \\" and \\\\"', "null", "2.50", "true", "-1e+3", "[1, [2,{}], \"]\"]", "{}",
       '{"filename":"a.pdf","size":2.50,"note":{"x":[1,null,"},{"]}}', '{"filename": "b.pdf", "z" : 1,"a":null}']


def _random_element(r, depth=0):
    kind = r.randrange(8 if depth < 3 else 5)
    space = r.choice(["", "", " ", "\n"])
    if kind == 0:
        return json.dumps("".join(r.choice('ab"\\{}[],:é\n') for _ in range(r.randrange(6))), ensure_ascii=r.random() < 0.5)
    if kind < 5:
        return r.choice(["null", "true", "false", "2.50", "0", "-1.0e10", "12345678901234567890"])
    inner = [space + _random_element(r, depth + 1) + space for _ in range(r.randrange(4))]
    if kind == 5:
        return "[" + ",".join(inner) + "]"
    return "{" + ",".join(f'{space}"{r.choice("abc")}{i}" :{x}' for i, x in enumerate(inner)) + "}"


def test_elements_keep_their_text(spark):
    r = random.Random(1)
    lists = [[_random_element(r) for _ in range(r.randrange(6))] for _ in range(300)]
    rows = [(i, r.choice(["[", " [", "\t[ "]) + r.choice([",", " ,", ",\n "]).join(x) + r.choice(["]", " ] \n"]))
            for i, x in enumerate(lists)]
    for _, text in rows:
        json.loads(text)
    got = {x[0]: x[1] for x in spark.createDataFrame(rows, "i int, t string").select("i", J.raw_elements("t")).collect()}
    assert got == dict(enumerate(lists))


@pytest.mark.parametrize("text,found", [
    (None, []), ("", []), ("  ", []), ("[]", []), ("[ ]", []), ("{}", None), ("null", None), ('"x"', None), ("[", None),
    ("[1", None), ("[1]]", None), ("[1] x", None), ("[1,]", None), ("[{oops", None), ('["a]', None), ("[[[1]]]", ["[[1]]"])])
def test_what_is_a_list(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(J.raw_elements("t")).first()[0] == found


def test_very_long_elements(spark):
    text = json.dumps(["x" * 200_000, {"k": '\\"' * 50_000}, [1] * 20_000], separators=(",", ":"))
    parts = spark.createDataFrame([(text,)], "t string").select(J.raw_elements("t")).first()[0]
    assert "[" + ",".join(parts) + "]" == text and len(parts) == 3


def test_with_members(spark):
    rows = [('{"a":1, "b" : 2.50}',), ('{"b":{"b":1},"c":[1,2]}',), ("{}",), ("null",), ('"{"',), ("[1]",), ('{"x":"\\"b\\":"}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string").select(
        J.with_members(F.col("e"), {"b": F.lit("true"), "n": F.lit('"v"')})).collect()]
    assert got == ['{"a":1,"b":true,"n":"v"}', '{"b":true,"c":[1,2],"n":"v"}', '{"b":true,"n":"v"}', "null", '"{"', "[1]",
                   '{"x":"\\"b\\":","b":true,"n":"v"}']


MODES = ["case_update", "case_insert", "counseling_update", "medical_update"]


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("new", [False, True])
def test_every_mode_keeps_what_it_does_not_touch(spark, mode, new):
    files = [("n", "N.pdf", "application/pdf", 5, "/p")] if new else None
    df = spark.createDataFrame(
        [("[" + " , ".join(ODD) + "]", ["a.pdf"], files, [("b.pdf", True, None), ("N.pdf", None, True)])],
        "ex string, del array<string>, new array<struct<filename:string,originalname:string,mimetype:string,"
        "size:bigint,path:string>>, cls array<struct<filename:string,isMedical:boolean,isPsychological:boolean>>")
    kw = dict(classes=F.col("cls"), uploader=F.lit("OPD"), upload_date=F.lit("D")) if mode == "medical_update" else {}
    got = df.select(A.merged_json(F.col("ex"), F.col("del"), F.col("new"), mode, **kw)).first()[0]
    kept, added = ODD[:7] + ODD[8:], '{"filename":"n","originalname":"N.pdf","mimetype":"application/pdf","size":5,"path":"/p"}'
    if mode == "medical_update":
        kept[6] = '{"isMedical":false,"isPsychological":false}'
        kept[7] = '{"filename": "b.pdf","z" : 1,"a":null,"isMedical":true,"isPsychological":false}'
        added = added[:-1] + ',"isMedical":false,"isPsychological":true,"uploadedBy":"OPD","uploadDate":"D"}'
    every = ([added] if mode == "case_update" else kept + [added]) if new else kept
    assert got == "[" + ",".join(every) + "]"


def test_a_flag_is_never_unset_and_keeps_its_place(spark):
    df = spark.createDataFrame([('[{"isMedical":true,"filename":"x","isPsychological":false,"k":1.0}]',
                                 [("x", False, True)])],
                               "ex string, cls array<struct<filename:string,isMedical:boolean,isPsychological:boolean>>")
    got = df.select(A.merged_json(F.col("ex"), F.lit(None).cast("array<string>"), F.lit(None), "medical_update",
                                  classes=F.col("cls"), uploader=F.lit("INF"), upload_date=F.lit("D"))).first()[0]
    assert got == '[{"isMedical":true,"filename":"x","isPsychological":true,"k":1.0}]'


def test_history_keeps_odd_entries(spark):
    df = spark.createDataFrame([("[" + ",".join(ODD) + "]",), ("",), (None,), ("[{oops",), ("{}",)], "h string")
    got = [r[0] for r in df.select(A.append_edit_history(F.col("h"), F.array(F.lit("GCO"), F.lit("INF")),
                                                         F.lit(AS_OF).cast("timestamp_ntz"))).collect()]
    two = f"{ENTRY % 'GCO'},{ENTRY % 'INF'}"
    assert got == ["[" + ",".join(ODD) + f",{two}]", f"[{two}]", f"[{two}]", "[{oops", "{}"]


def test_remove_keeps_the_other_elements(spark):
    df = spark.createDataFrame([(1, "[" + ",".join(ODD) + "]"), (2, '[{"filename":"a.pdf"}]'), (3, "[{oops"), (4, None)],
                               "id long, files string")
    req = spark.createDataFrame([(i, "a.pdf") for i in (1, 2, 3, 4, 5)], "record_id long, filename string")
    got = {r.id: r.files for r in A.remove_attachment(df, "id", "files", req).collect()}
    assert got == {1: "[" + ",".join(ODD[:7] + ODD[8:]) + "]", 2: None, 3: "[{oops", 4: None}


# ---- several requests for one record, in order ------------------------------------------------

KINDS = {
    "case": (C.update_cases, "tbl_case_records", "caseId", "cr_case_id", "cr_attachments", "cr_edit_history", "cr_status", "OPD", dict(
        studentId="1", studentName="A", violationLevel="Minor", description="d", status="Ongoing")),
    "counseling": (C.update_counseling, "tbl_counseling_records", "recordId", "cor_record_id", "cor_attachments",
                   "cor_edit_history", "cor_status", "GCO", dict(
                       studentId="1", studentName="A", strand="S", gradeLevel="11", section="x", sessionNumber="1",
                       status="DONE", concern="c")),
    "medical": (C.update_medical, "tbl_medical_records", "recordId", "mr_medical_id", "mr_attachments", "mr_edit_history",
                "mr_status", "INF", dict(studentId="1", studentName="A", subject="s", status="Treated", medicalDetails="m",
                                         isPsychological="No", isMedical="Yes")),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("keep", [False, True])
def test_requests_of_a_record_apply_one_after_the_other(spark, tables, kind, keep):
    """A batch of three requests a record leaves what three batches of one leave."""
    update, name, id_field, id_col, att, history, status, editor, values = KINDS[kind]
    stored = '[{"filename":"old.pdf","k":2.50},null]'
    table = tables[name].orderBy(id_col).limit(24).withColumn(
        att, F.when(F.col(id_col) % 3 == 0, F.lit(None)).otherwise(F.lit(stored)))
    ids = [r[0] for r in table.select(id_col).collect()]
    r = random.Random(kind)
    fields = sorted(values)
    schema = (f"seq int, {id_field} long, existingAttachments string, filesToDelete array<string>, "
              "newFiles array<struct<filename:string,originalname:string,mimetype:string,size:bigint,path:string>>, "
              + ", ".join(f"{f} string" for f in fields))
    requests = []
    for k, i in enumerate(ids):
        for n in range(3):
            ex = r.choice([None, None, "[]", '["s",{"filename":"u.pdf","deep":{"a":[1]}},{"filename":"v.pdf"}]', "[{oops"])
            new = [(f"n{n}", f"N{n}", "application/pdf", n, "/p")] if r.random() < 0.3 else None
            requests.append((100 * n + k, i, ex, ["v.pdf"] if r.random() < 0.5 else None, new,
                             *(f"{values[f]}{n}" if f == "status" else values[f] for f in fields)))
    schema_of_table = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])
    table = spark.createDataFrame(table.collect(), schema_of_table)
    cols = [id_col, att, history, status]
    batch = update(table, spark.createDataFrame(requests, schema), AS_OF, keep_missing=keep)
    one_by_one = table
    for n in range(3):
        part = [q for q in requests if q[0] // 100 == n]
        one_by_one = spark.createDataFrame(
            update(one_by_one, spark.createDataFrame(part, schema), AS_OF, keep_missing=keep).table.collect(), schema_of_table)
    got = sorted(map(tuple, batch.table.select(*cols).collect()))
    assert got == sorted(map(tuple, one_by_one.select(*cols).collect()))
    assert all(row[2].count('"editedBy"') >= 3 for row in got)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_a_later_request_without_files_keeps_the_first_ones(spark, tables, kind):
    update, name, id_field, id_col, att, _, _, _, values = KINDS[kind]
    table = tables[name].limit(1)
    i = table.first()[id_col]
    fields = sorted(values)
    req = spark.createDataFrame(
        [(1, i, '[{"filename":"first.pdf","x":2.50}]', *(values[f] for f in fields)), (2, i, None, *(values[f] for f in fields))],
        f"seq int, {id_field} long, existingAttachments string, " + ", ".join(f"{f} string" for f in fields))
    flags = ',"isMedical":false,"isPsychological":false' if kind == "medical" else ""
    kept = update(table, req, AS_OF, keep_missing=True).rows.select(att).first()[0]
    assert kept == '[{"filename":"first.pdf","x":2.50%s}]' % flags
    assert update(table, req, AS_OF).rows.select(att).first()[0] is None
