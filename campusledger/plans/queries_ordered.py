"""Registered batches in which requests depend on the requests before them.

The requests are derived from the whole tables, several per record or account, in
an order that is not the order of the ids. For records the SQL states the stored
text in full; for accounts it handles the requests one after the other in a
recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from campusledger.functions.semantics import iso_millis
from campusledger.operators import changes as C
from campusledger.operators.account_stream import account_stream
from campusledger.plans.catalog import register
from campusledger.plans.queries_changes import _USER_SEQ, AS_OF, AS_OF_ISO, HISTORY_ENTRY, _user_seq

# ---- three requests per record (O49a-c, O51, O52) -------------------------------------------
#
# By id modulo 4: 0 the first request sends a list and the others none; 1 the second
# replaces it and deletes a file of its own; 2 nobody sends one; 3 the first sends a
# list that does not parse, the last one a new file.

_ODD = '"text, [1]",null,2.50,{{"k":[{{"x":"]"}}]{flags}}}'
_FIRST = '{{"filename":"a%s.pdf","n":2.50,"deep":{{"x":[1,null]}}{flags}}}'
_KEPT = '{{"filename":"y.pdf","k":1e3{flags}}}'
_NEW = '{"filename":"new.pdf","originalname":"New.pdf","mimetype":"application/pdf","size":7,"path":"/up/new.pdf"%s}'
_FILES = ("array<struct<filename:string,originalname:string,mimetype:string,size:bigint,path:string>>")


def _three(base, key: str, editor_field: str):
    """Requests 0, 1 and 2 of every record, by the rules above; ``base`` has one row per record."""
    k = F.col(key) % 4
    text, files = "existingAttachments", "newFiles"
    none, no_files = F.lit(None).cast("string"), F.lit(None).cast(_FILES)
    first = F.concat(F.lit("[" + _ODD.format(flags="") + ","),
                     F.format_string(_FIRST.format(flags=""), F.col(key).cast("string")), F.lit("]"))
    second = F.lit('[{"filename":"x.pdf"} , ' + _KEPT.format(flags="") + "]")
    new = F.array(F.struct(F.lit("new.pdf").alias("filename"), F.lit("New.pdf").alias("originalname"),
                           F.lit("application/pdf").alias("mimetype"), F.lit(7).cast("bigint").alias("size"),
                           F.lit("/up/new.pdf").alias("path")))
    parts = []
    for n, (ex, f) in enumerate((
            (F.when(k.isin(0, 1), first).when(k == 3, F.lit("[{oops")), no_files),
            (F.when(k == 1, second), no_files),
            (none, F.when(k == 3, new).otherwise(no_files)))):
        # the later a request, the lower the place of its record: order is by seq alone
        parts.append(base.withColumns({
            "seq": F.lit(n * 10 ** 12).cast("bigint") - F.col(key), text: ex, files: f,
            "filesToDelete": F.when((k == 1) & F.lit(n == 1), F.array(F.lit("x.pdf"))),
            editor_field: F.lit(f"E{n}"), "status": F.lit(f"S{n}")}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _three_sql(table: str, key: str, att: str, history: str, status: str, flags: str = "", new: str = "") -> str:
    entries = ",".join(HISTORY_ENTRY % f"E{n}" for n in range(3))
    first = _FIRST.format(flags=flags) % f"' || CAST({key} AS VARCHAR) || '"
    return f"""
SELECT {key}, 'S2' AS {status},
       CASE {key} % 4 WHEN 0 THEN '[{_ODD.format(flags=flags)},{first}]'
                      WHEN 1 THEN '[{_KEPT.format(flags=flags)}]'
                      WHEN 2 THEN {att}
                      ELSE '[{_NEW % new}]' END AS {att},
       CASE WHEN coalesce({history}, '') IN ('', '[]') THEN '[{entries}]'
            ELSE rtrim({history}, ']') || ',{entries}]' END AS {history}
FROM {table}"""


@register("update_cases_three_requests",
          _three_sql("tbl_case_records", "cr_case_id", "cr_attachments", "cr_edit_history", "cr_status"))
def update_cases_three_requests(t):
    cases = t["tbl_case_records"]
    base = cases.select(F.col("cr_case_id").alias("caseId"), F.col("cr_student_id").alias("studentId"),
                        F.col("cr_student_name").alias("studentName"), F.lit("Minor").alias("violationLevel"),
                        F.lit("d").alias("description"))
    w = C.update_cases(cases, _three(base, "caseId", "userType"), AS_OF, keep_missing=True)
    return w.table.select("cr_case_id", "cr_status", "cr_attachments", "cr_edit_history")


@register("update_counseling_three_requests", _three_sql(
    "tbl_counseling_records", "cor_record_id", "cor_attachments", "cor_edit_history", "cor_status"))
def update_counseling_three_requests(t):
    sessions = t["tbl_counseling_records"]
    base = sessions.select(F.col("cor_record_id").alias("recordId"), F.col("cor_student_id_number").alias("studentId"),
                           F.col("cor_student_name").alias("studentName"), F.lit("S").alias("strand"),
                           F.lit("11").alias("gradeLevel"), F.lit("x").alias("section"), F.lit("1").alias("sessionNumber"),
                           F.lit("c").alias("concern"))
    w = C.update_counseling(sessions, _three(base, "recordId", "userType"), AS_OF, keep_missing=True)
    return w.table.select("cor_record_id", "cor_status", "cor_attachments", "cor_edit_history")


@register("update_medical_three_requests", _three_sql(
    "tbl_medical_records", "mr_medical_id", "mr_attachments", "mr_edit_history", "mr_status",
    ',"isMedical":false,"isPsychological":false',
    f',"isMedical":false,"isPsychological":false,"uploadedBy":"E2","uploadDate":"{AS_OF_ISO}"'))
def update_medical_three_requests(t):
    medical = t["tbl_medical_records"]
    base = medical.select(F.col("mr_medical_id").alias("recordId"), F.col("mr_student_id").alias("studentId"),
                          F.col("mr_student_name").alias("studentName"), F.lit("s").alias("subject"),
                          F.lit("m").alias("medicalDetails"), F.lit("Yes").alias("isPsychological"),
                          F.lit("Yes").alias("isMedical"))
    w = C.update_medical(medical, _three(base, "recordId", "uploaderType"), AS_OF, keep_missing=True)
    return w.table.select("mr_medical_id", "mr_status", "mr_attachments", "mr_edit_history")


@register("update_medical_text", f"""
SELECT mr_medical_id,
       CASE WHEN lower(mr_status) = 'for treatment' THEN
         CASE WHEN coalesce(mr_attachments, '') IN ('', '[]') THEN NULL
              ELSE '[' || array_to_string(list_transform(CAST(mr_attachments AS JSON[]), lambda f:
                   left(CAST(f AS VARCHAR), len(CAST(f AS VARCHAR)) - 1)
                   || CASE WHEN json_exists(f, '$.isMedical') THEN '' ELSE ',"isMedical":false' END
                   || CASE WHEN json_exists(f, '$.isPsychological') THEN '' ELSE ',"isPsychological":false' END
                   || '}}'), ',') || ']' END
       ELSE mr_attachments END AS mr_attachments,
       CASE WHEN lower(mr_status) <> 'for treatment' THEN mr_edit_history
            WHEN coalesce(mr_edit_history, '') IN ('', '[]') THEN '[{HISTORY_ENTRY % 'INF'}]'
            ELSE rtrim(mr_edit_history, ']') || ',{HISTORY_ENTRY % 'INF'}]' END AS mr_edit_history
FROM tbl_medical_records""")
def update_medical_text(t):
    """The stored text after ``update_medical``: flags that are set stay in their place."""
    from campusledger.plans.queries_changes import _treatments
    medical = t["tbl_medical_records"]
    return C.update_medical(medical, _treatments(medical), AS_OF).table.select(
        "mr_medical_id", "mr_attachments", "mr_edit_history")


# ---- accounts: names given out in order (O48e, O49e, O69) ------------------------------------

_OFTEN = "(VALUES (0), (1), (2)) AS v(j)"


def _tripled(users):
    return users.select(_user_seq().alias("s"), F.explode(F.array(*map(F.lit, range(3)))).alias("j"))


@register("insert_users_in_order", f"""
WITH RECURSIVE asked AS (
  SELECT 3 * s + j AS seq,
         CASE WHEN j = 2 AND s % 6 = 0 THEN concat('U', s, '@X.TEST') ELSE concat('e', (3 * s + j) // 2, '@x') END AS email,
         concat('n', ((3 * s + j) * 5) % (s + 7)) AS username
  FROM (SELECT {_USER_SEQ} AS s FROM users) u, {_OFTEN}),
req AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM asked),
run AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS status,
         (SELECT list(lower(u_email)) FROM users) AS emails, (SELECT list(lower(u_username)) FROM users) AS names
  UNION ALL
  SELECT k, seq, email, status, CASE WHEN status = 'applied' THEN list_append(emails, lower(email)) ELSE emails END,
         CASE WHEN status = 'applied' THEN list_append(names, lower(username)) ELSE names END
  FROM (SELECT req.*, run.emails, run.names,
               CASE WHEN list_contains(run.emails, lower(req.email)) THEN 'rejected:duplicate:email'
                    WHEN list_contains(run.names, lower(req.username)) THEN 'rejected:duplicate:username'
                    ELSE 'applied' END AS status
        FROM run JOIN req ON req.k = run.k + 1) AS turn)
SELECT seq, email, status FROM run WHERE k > 0""")
def insert_users_in_order(t):
    u, n = t["users"], 3 * F.col("s") + F.col("j")
    req = _tripled(u).select(
        n.alias("seq"), F.when((F.col("j") == 2) & (F.col("s") % 6 == 0), F.concat(F.lit("U"), "s", F.lit("@X.TEST")))
        .otherwise(F.concat(F.lit("e"), F.floor(n / 2).cast("bigint"), F.lit("@x"))).alias("email"),
        F.concat(F.lit("n"), (n * 5) % (F.col("s") + 7)).alias("username"), F.lit("N").alias("name"),
        F.lit("Staff").alias("userType"), F.lit("secret").alias("password"))
    return C.insert_users(u, req, AS_OF).status


# Request 0 asks for the name of the next account, 1 for one of a few free names, 2
# comes from an unknown account. The order runs through the accounts in leaps.
_RENAMES = f"""asked AS (
  SELECT 3 * (s * 7919 % 100003) + j AS seq,
         CASE WHEN j = 2 THEN concat('nobody', s, '@x.test') ELSE concat('u', s, '@x.test') END AS email,
         CASE WHEN j = 0 THEN concat('User', s + 1) ELSE concat('free', s % 17) END AS username
  FROM (SELECT {_USER_SEQ} AS s FROM users) u, {_OFTEN}),
req AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM asked),
run AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS status,
         (SELECT map(list(u_email), list(u_username)) FROM users) AS names
  UNION ALL
  SELECT k, seq, email, status,
         CASE WHEN status = 'applied' THEN map_concat(names, map([email], [username])) ELSE names END
  FROM (SELECT req.*, run.names,
               CASE WHEN NOT map_contains(run.names, req.email) THEN 'not_found'
                    WHEN len(list_filter(map_entries(run.names), lambda x:
                             x.key <> req.email AND lower(x.value) = lower(req.username))) > 0
                    THEN 'rejected:duplicate:username' ELSE 'applied' END AS status
        FROM run JOIN req ON req.k = run.k + 1) AS turn)"""


def _renames(users):
    s, j = F.col("s"), F.col("j")
    return _tripled(users).select(
        (3 * (s * 7919 % 100003) + j).alias("seq"),
        F.concat(F.when(j == 2, "nobody").otherwise("u"), s, F.lit("@x.test")).alias("email"),
        F.when(j == 0, F.concat(F.lit("User"), s + 1)).otherwise(F.concat(F.lit("free"), s % 17)).alias("username"))


@register("update_users_in_order", f"WITH RECURSIVE {_RENAMES} SELECT seq, email, status FROM run WHERE k > 0")
def update_users_in_order(t):
    return C.update_users(t["users"], _renames(t["users"])).status


@register("update_users_in_order_table", f"""
WITH RECURSIVE {_RENAMES}
SELECT x.key AS u_email, x.value AS u_username
FROM (SELECT unnest(map_entries(names)) AS x FROM run WHERE k = (SELECT count(*) FROM req)) AS last""")
def update_users_in_order_table(t):
    return C.update_users(t["users"], _renames(t["users"])).table.select("u_email", "u_username")


# ---- one stream of activations, deactivations and deletions (O58, O59) -------------------------
#
# Three requests per account in leaps, then one account after the other is asked to be
# deactivated, activated and deleted, or, every other one, deleted before it is activated.

_STREAM = f"""asked AS (
  SELECT 3 * (s * 7919 % 100003) + j AS seq, concat('U', s, '@x.test') AS email,
         ['activate', 'deactivate', 'delete'][CAST((s * 31 + j * 17) % 3 + 1 AS BIGINT)] AS action
  FROM (SELECT {_USER_SEQ} AS s FROM users) u, {_OFTEN}
  UNION ALL
  SELECT 1000000 + 3 * s + j, concat('u', s, '@x.test'),
         ['deactivate', 'activate', 'delete', 'deactivate', 'delete', 'activate'][CAST(3 * (s % 2) + j + 1 AS BIGINT)]
  FROM (SELECT {_USER_SEQ} AS s FROM users) u, {_OFTEN}),
req AS (SELECT *, lower(email) AS e, row_number() OVER (ORDER BY seq) AS k FROM asked),
run AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS status,
         (SELECT map(list(u_email), list(struct_pack(t := u_type, s := u_status,
                 d := strftime(deactivated_at, '%Y-%m-%dT%H:%M:%S.%gZ')))) FROM users) AS st
  UNION ALL
  SELECT k, seq, email, status,
         CASE WHEN status <> 'applied' THEN st
              WHEN action = 'delete' THEN map_from_entries(list_filter(map_entries(st), lambda x: x.key <> e))
              WHEN action = 'activate' THEN map_concat(st, map([e], [struct_pack(t := own.t, s := 'Active', d := CAST(NULL AS VARCHAR))]))
              ELSE map_concat(st, map([e], [struct_pack(t := own.t, s := 'Inactive', d := '{AS_OF_ISO}')])) END
  FROM (SELECT *, CASE
               WHEN own IS NULL THEN 'not_found'
               WHEN action = 'deactivate' AND own.t = 'Administrator' AND active <= 1 THEN 'rejected:last_active_administrator'
               WHEN action = 'deactivate' AND own.s <> 'Active' THEN 'rejected:already_inactive'
               WHEN action = 'activate' AND own.s <> 'Inactive' THEN 'rejected:already_active'
               WHEN action = 'delete' AND own.s = 'Active' THEN 'rejected:active_user'
               WHEN action = 'delete' AND own.t = 'Administrator' AND admins <= 1 THEN 'rejected:last_administrator'
               ELSE 'applied' END AS status
        FROM (SELECT req.*, run.st, run.st[req.e] AS own,
                     len(list_filter(map_values(run.st), lambda x: x.t = 'Administrator')) AS admins,
                     len(list_filter(map_values(run.st), lambda x: x.t = 'Administrator' AND x.s = 'Active')) AS active
              FROM run JOIN req ON req.k = run.k + 1) AS seen) AS turn)"""


def _stream(users):
    def action(names, at):
        return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))

    s, j = F.col("s"), F.col("j")
    rows = _tripled(users)
    leaps = rows.select((3 * (s * 7919 % 100003) + j).alias("seq"), F.concat(F.lit("U"), s, F.lit("@x.test")).alias("email"),
                        action(["activate", "deactivate", "delete"], (s * 31 + j * 17) % 3).alias("action"))
    return leaps.unionByName(rows.select(
        (1000000 + 3 * s + j).alias("seq"), F.concat(F.lit("u"), s, F.lit("@x.test")).alias("email"),
        action(["deactivate", "activate", "delete", "deactivate", "delete", "activate"], 3 * (s % 2) + j).alias("action")))


@register("account_stream", f"WITH RECURSIVE {_STREAM} SELECT seq, email, status FROM run WHERE k > 0")
def account_stream_status(t):
    return account_stream(t["users"], _stream(t["users"]), AS_OF).status


@register("account_stream_table", f"""
WITH RECURSIVE {_STREAM}
SELECT x.key AS u_email, x.value.s AS u_status, x.value.d AS deactivated_at
FROM (SELECT unnest(map_entries(st)) AS x FROM run WHERE k = (SELECT count(*) FROM req)) AS last""")
def account_stream_table(t):
    return account_stream(t["users"], _stream(t["users"]), AS_OF).table.select(
        "u_email", "u_status", iso_millis("deactivated_at").alias("deactivated_at"))
