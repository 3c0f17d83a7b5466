"""Registered queries: KPIs, monthly trends and per-student summaries."""

from __future__ import annotations

from campusledger.operators import kpis, summaries as S
from campusledger.plans.catalog import register

# Parameters of the registered runs. The clocks sit at the end of the case
# and counselling date ranges of the driver data.
CASE_AS_OF = "2001-08-15 00:00:00"
COUNSELING_AS_OF = "2024-02-15 00:00:00"
UNREAD_RECEIVER = "GCO"
SUMMARY_SEARCH = "Customer#0000001"
ID_PREFIX = "000"

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"      # DuckDB form of Date.toISOString()


def _ci(col: str, value: str) -> str:
    return f"lower({col}) = '{value.lower()}'"


def _cnt(cond: str, name: str) -> str:
    return f"CAST(count_if({cond}) AS BIGINT) AS {name}"


# ---- KPIs -------------------------------------------------------------------

@register("case_totals", f"""
SELECT {_cnt(_ci('cr_violation_level', 'Minor'), 'minor')},
       {_cnt(_ci('cr_violation_level', 'Major'), 'major')},
       {_cnt(_ci('cr_violation_level', 'Serious'), 'serious')},
       {_cnt(_ci('cr_status', 'Ongoing'), 'ongoing')},
       {_cnt(_ci('cr_status', 'Resolved'), 'resolved')}
FROM tbl_case_records""")
def case_totals(t):
    return kpis.case_totals(t["tbl_case_records"])


@register("counseling_totals", f"""
SELECT {_cnt(_ci('cor_status', 'SCHEDULED'), 'scheduled')},
       {_cnt(_ci('cor_status', 'TO SCHEDULE'), 'to_schedule')},
       {_cnt(_ci('cor_status', 'DONE'), 'done')}
FROM tbl_counseling_records""")
def counseling_totals(t):
    return kpis.counseling_totals(t["tbl_counseling_records"])


@register("medical_totals", f"""
SELECT {_cnt(_ci('mr_is_medical', 'YES'), 'medical')},
       {_cnt(_ci('mr_is_psychological', 'YES'), 'psychological')},
       {_cnt(_ci('mr_status', 'Ongoing'), 'ongoing')},
       {_cnt(_ci('mr_status', 'Treated'), 'treated')},
       {_cnt(_ci('mr_status', 'For Treatment'), 'for_treatment')}
FROM tbl_medical_records""")
def medical_totals(t):
    return kpis.medical_totals(t["tbl_medical_records"])


@register("user_totals", f"""
SELECT CAST(count(*) AS BIGINT) AS totalUsers,
       {_cnt(_ci('u_status', 'Active'), 'activeUsers')},
       {_cnt(_ci('u_status', 'Inactive'), 'inactiveUsers')},
       {_cnt(_ci('u_type', 'Administrator') + ' AND ' + _ci('u_status', 'Active'), 'activeAdmins')},
       {_cnt(_ci('u_department', 'OPD') + ' AND ' + _ci('u_status', 'Active'), 'activeOPD')},
       {_cnt(_ci('u_department', 'GCO') + ' AND ' + _ci('u_status', 'Active'), 'activeGCO')},
       {_cnt(_ci('u_department', 'INF') + ' AND ' + _ci('u_status', 'Active'), 'activeINF')}
FROM users""")
def user_totals(t):
    return kpis.user_totals(t["users"])


@register("user_status_breakdown", """
SELECT min(u_status) AS u_status, CAST(count(*) AS BIGINT) AS count
FROM users GROUP BY lower(u_status)""")
def user_status_breakdown(t):
    return kpis.user_status_breakdown(t["users"])


_HAS_CERT = "coalesce(json_contains(mr_attachments, '{\"isMedical\":true}'), false)"


@register("certificate_totals", f"""
SELECT {_cnt(_HAS_CERT + " AND mr_grade_level = '11'", 'with_certificates_grade_11')},
       {_cnt(_HAS_CERT + " AND mr_grade_level = '12'", 'with_certificates_grade_12')},
       {_cnt("NOT " + _HAS_CERT + " AND mr_grade_level = '11'", 'without_certificates_grade_11')},
       {_cnt("NOT " + _HAS_CERT + " AND mr_grade_level = '12'", 'without_certificates_grade_12')}
FROM tbl_medical_records""")
def certificate_totals(t):
    return kpis.certificate_totals(t["tbl_medical_records"])


def _monthly_sql(table: str, date_col: str, grade_col: str, as_of: str) -> str:
    return f"""
SELECT strftime(strptime(month_key || '-01', '%Y-%m-%d'), '%b %Y') AS month, grade_11, grade_12
FROM (SELECT strftime({date_col}, '%Y-%m') AS month_key,
             {_cnt(grade_col + " = '11'", 'grade_11')},
             {_cnt(grade_col + " = '12'", 'grade_12')}
      FROM {table}
      WHERE {date_col} >= TIMESTAMP '{as_of}' - INTERVAL 6 MONTH
      GROUP BY 1 ORDER BY 1 DESC LIMIT 6) m"""


@register("monthly_cases_by_grade",
          _monthly_sql("tbl_case_records", "cr_case_date", "cr_student_grade_level", CASE_AS_OF))
def monthly_cases_by_grade(t):
    return kpis.monthly_cases_by_grade(t["tbl_case_records"], CASE_AS_OF)


@register("monthly_counseling_by_grade",
          _monthly_sql("tbl_counseling_records", "cor_date", "cor_student_grade_level",
                       COUNSELING_AS_OF))
def monthly_counseling_by_grade(t):
    return kpis.monthly_counseling_by_grade(t["tbl_counseling_records"], COUNSELING_AS_OF)


_UNREAD = (f"FROM tbl_notifications WHERE lower(n_receiver) = '{UNREAD_RECEIVER.lower()}' "
           "AND lower(n_is_read) = 'no'")


@register("unread_counts", f"""
SELECT min(n_type) AS n_type, false AS is_total, CAST(count(*) AS BIGINT) AS count,
       {_cnt("lower(n_type) = 'opd medical certificate'", 'opd_certificate_count')}
{_UNREAD} GROUP BY lower(n_type)
UNION ALL
SELECT NULL, true, CAST(count(*) AS BIGINT),
       {_cnt("n_type = 'OPD Medical Certificate'", 'opd_certificate_count')}
{_UNREAD}""")
def unread_counts(t):
    return kpis.unread_counts(t["tbl_notifications"], UNREAD_RECEIVER)


@register("active_admin_count", f"""
SELECT {_cnt(_ci('u_type', 'Administrator') + ' AND ' + _ci('u_status', 'Active'), 'active_admins')},
       {_cnt(_ci('u_type', 'Administrator'), 'total_admins')}
FROM users""")
def active_admin_count(t):
    return kpis.active_admin_count(t["users"])


# ---- per-student summaries --------------------------------------------------

def _summary_sql(records: str, rid: str, sid: str, date: str, status: str, sem: str,
                 count_name: str, date_name: str, where: str = "", flags=(),
                 search: str | None = None, with_date: bool = True,
                 with_semesters: bool = True) -> str:
    """Join-first formulation, as the record screens state it."""
    where_r = f"WHERE {where}" if where else ""
    cols = [f"CAST(count(DISTINCT r.{rid}) AS BIGINT) AS {count_name}"]
    if with_date:
        cols.append(f"strftime(max(r.{date}), {ISO}) AS {date_name}")
    cols.append("any_value(l.statuses) AS statuses")
    for name, src in flags:
        cols.append(f"string_agg(DISTINCT r.{src}, ',' ORDER BY r.{src}) AS {name}")
    if with_semesters:
        cols.append(f"string_agg(DISTINCT r.{sem}, ',' ORDER BY r.{sem}) AS allSemesters")
    cols.append("any_value(l.latestStatus) AS latestStatus")
    search_where = ""
    if search is not None:
        p = f"'%{search}%'"
        search_where = (f"WHERE (sd.sd_id_number ILIKE {p} OR sd.sd_student_name ILIKE {p} "
                        f"OR sd.sd_strand ILIKE {p})")
    tail = ""
    if search is not None:
        tail = ("ORDER BY name ASC NULLS FIRST, id ASC NULLS FIRST, strand ASC NULLS FIRST, "
                "gradeLevel ASC NULLS FIRST, section ASC NULLS FIRST LIMIT 50")
    return f"""
WITH r AS (SELECT * FROM {records} {where_r}),
per_status AS (
  SELECT {sid} AS sid, lower({status}) AS sk, max({date}) AS last_date, max({rid}) AS last_id,
         arg_max({status}, {rid}) AS status
  FROM r GROUP BY 1, 2),
lists AS (
  SELECT sid,
         string_agg(status, ',' ORDER BY last_date DESC NULLS LAST, last_id DESC) AS statuses,
         (list(status ORDER BY last_date DESC NULLS LAST, last_id DESC))[1] AS latestStatus
  FROM per_status WHERE status IS NOT NULL GROUP BY sid)
SELECT sd.sd_id_number AS id, sd.sd_student_name AS name, sd.sd_strand AS strand,
       sd.sd_grade_level AS gradeLevel, sd.sd_section AS section,
       {", ".join(cols)}
FROM tbl_student_data sd
JOIN r ON sd.sd_id_number = r.{sid}
LEFT JOIN lists l ON l.sid = sd.sd_id_number
{search_where}
GROUP BY sd.sd_id_number, sd.sd_student_name, sd.sd_strand, sd.sd_grade_level, sd.sd_section
{tail}"""


_CASE = dict(records="tbl_case_records", rid="cr_case_id", sid="cr_student_id",
             date="cr_case_date", status="cr_status", sem="cr_school_year_semester",
             count_name="caseCount", date_name="latestCaseDate")
_COUNSELING = dict(records="tbl_counseling_records", rid="cor_record_id",
                   sid="cor_student_id_number", date="cor_date", status="cor_status",
                   sem="cor_school_year_semester", count_name="counselingCount",
                   date_name="latestCounselingDate")
_MEDICAL = dict(records="tbl_medical_records", rid="mr_medical_id", sid="mr_student_id",
                date="mr_record_date", status="mr_status", sem="mr_school_year_semester",
                count_name="medicalCount", date_name="latestMedicalDate",
                flags=(("hasMedical", "mr_is_medical"), ("hasPsychological", "mr_is_psychological")))
_SEARCH = dict(search=SUMMARY_SEARCH, with_date=False, with_semesters=False)
_MED_KIND = "lower(mr_is_medical) = 'yes' AND lower(mr_is_psychological) = 'no'"


@register("student_case_summary", _summary_sql(**_CASE))
def student_case_summary(t):
    return S.student_case_summary(t["tbl_student_data"], t["tbl_case_records"])


@register("student_case_summary_referred",
          _summary_sql(**_CASE, where="lower(cr_referred) = 'yes'"))
def student_case_summary_referred(t):
    return S.student_case_summary(t["tbl_student_data"], t["tbl_case_records"], referred=True)


@register("student_case_summary_search", _summary_sql(**_CASE, **_SEARCH))
def student_case_summary_search(t):
    return S.student_case_summary_search(t["tbl_student_data"], t["tbl_case_records"],
                                         SUMMARY_SEARCH)


@register("student_counseling_summary", _summary_sql(**_COUNSELING))
def student_counseling_summary(t):
    return S.student_counseling_summary(t["tbl_student_data"], t["tbl_counseling_records"])


@register("student_counseling_summary_psychological",
          _summary_sql(**_COUNSELING, where="lower(cor_is_psychological_condition) = 'yes'"))
def student_counseling_summary_psychological(t):
    return S.student_counseling_summary(t["tbl_student_data"], t["tbl_counseling_records"],
                                        psychological=True)


@register("student_counseling_summary_search", _summary_sql(**_COUNSELING, **_SEARCH))
def student_counseling_summary_search(t):
    return S.student_counseling_summary_search(t["tbl_student_data"],
                                               t["tbl_counseling_records"], SUMMARY_SEARCH)


@register("student_medical_summary", _summary_sql(**_MEDICAL))
def student_medical_summary(t):
    return S.student_medical_summary(t["tbl_student_data"], t["tbl_medical_records"])


@register("student_medical_summary_referred",
          _summary_sql(**_MEDICAL, where="lower(mr_referred) = 'yes'"))
def student_medical_summary_referred(t):
    return S.student_medical_summary(t["tbl_student_data"], t["tbl_medical_records"],
                                     referred=True, kind="MEDICAL")


@register("student_medical_summary_medical", _summary_sql(**_MEDICAL, where=_MED_KIND))
def student_medical_summary_medical(t):
    return S.student_medical_summary(t["tbl_student_data"], t["tbl_medical_records"],
                                     kind="MEDICAL")


@register("student_medical_summary_search", _summary_sql(**_MEDICAL, **_SEARCH, where=_MED_KIND))
def student_medical_summary_search(t):
    return S.student_medical_summary_search(t["tbl_student_data"], t["tbl_medical_records"],
                                            SUMMARY_SEARCH, kind="MEDICAL")


@register("student_medical_referred_search",
          _summary_sql(**_MEDICAL, **_SEARCH, where="lower(mr_referred) = 'yes' AND " + _MED_KIND))
def student_medical_referred_search(t):
    return S.student_medical_referred_search(t["tbl_student_data"], t["tbl_medical_records"],
                                             SUMMARY_SEARCH, kind="MEDICAL")


# ---- semester look-ups ------------------------------------------------------

_LOOKUP = "sd_id_number, sd_student_name, sd_strand, sd_school_year_semesterr, sd_grade_level, sd_section"
_UNSIGNED_SEM = ("coalesce(try_cast(regexp_extract(split_part(sd_school_year_semesterr, '-', -1), "
                 "'^\\s*(\\d+)', 1) AS BIGINT), 0)")


@register("student_prefix_search", f"""
SELECT {_LOOKUP} FROM tbl_student_data
WHERE sd_id_number ILIKE '{ID_PREFIX}%'
ORDER BY sd_id_number ASC NULLS FIRST,
         split_part(sd_school_year_semesterr, '-', 1) DESC NULLS LAST,
         {_UNSIGNED_SEM} DESC NULLS LAST,
         sd_school_year_semesterr ASC NULLS FIRST, sd_student_name ASC NULLS FIRST,
         sd_strand ASC NULLS FIRST, sd_grade_level ASC NULLS FIRST, sd_section ASC NULLS FIRST
LIMIT 30""")
def student_prefix_search(t):
    return S.student_prefix_search(t["tbl_student_data"], ID_PREFIX)


@register("latest_semester_per_student", f"""
WITH r AS (SELECT {_LOOKUP},
                  concat(split_part(sd_school_year_semesterr, '-', 1), '-',
                         CAST({_UNSIGNED_SEM} AS VARCHAR)) AS k
           FROM tbl_student_data WHERE sd_id_number ILIKE '{ID_PREFIX}%'),
m AS (SELECT sd_id_number, max(k) AS k FROM r GROUP BY sd_id_number)
SELECT {", ".join("r." + c for c in _LOOKUP.split(", "))}
FROM r JOIN m ON r.sd_id_number = m.sd_id_number AND r.k = m.k
ORDER BY {", ".join("r." + c + " ASC NULLS FIRST" for c in _LOOKUP.split(", "))}
LIMIT 10""")
def latest_semester_per_student(t):
    return S.latest_semester_per_student(t["tbl_student_data"], ID_PREFIX)


@register("student_counseling_summary_search_psychological",
          _summary_sql(**_COUNSELING, **_SEARCH,
                       where="lower(cor_is_psychological_condition) = 'yes'"))
def student_counseling_summary_search_psychological(t):
    return S.student_counseling_summary_search(t["tbl_student_data"],
                                               t["tbl_counseling_records"], SUMMARY_SEARCH,
                                               psychological=True)
