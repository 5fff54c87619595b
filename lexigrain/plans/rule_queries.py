"""Grounding, the thirty checks and the routing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.operators import grounding as gr
from lexigrain.operators import operations as op
from lexigrain.operators import rules as ru
from lexigrain.plans.registry import Inputs, query
from lexigrain.plans.text_queries import NORM

EVIDENCE = f"""
    ev AS (SELECT e.*, d.text, substring(d.text, char_start + 1, greatest(char_end - char_start, 0)) AS here FROM {{evidence}} e JOIN {{docs}} d USING (document_id)),
    checked AS (SELECT *, CASE
        WHEN trim(replace(quote, chr(10), ' ')) = '' THEN 'empty' WHEN here = quote THEN 'exact'
        WHEN here <> '' AND {NORM.format('here')} = {NORM.format('quote')} THEN 'normalized'
        WHEN contains(text, quote) THEN 'relocated'
        WHEN contains({NORM.format('text')}, {NORM.format('quote')}) THEN 'relocated'
        WHEN char_end > length(text) OR char_start >= length(text) THEN 'out_of_bounds' ELSE 'not_found' END AS status FROM ev)"""
FLAGS = "status NOT IN ('exact', 'normalized', 'relocated', 'artifact_elided')"


@query("G1_check_evidence", f"WITH {EVIDENCE} SELECT document_id, clause_type, seq, ev_ord, status FROM checked")
def _(t: Inputs):
    return gr.check_evidence(t.evidence, t.docs).select("document_id", "clause_type", "seq", "ev_ord", "status")


@query("G2_locate_exact", f"""
    WITH {EVIDENCE} SELECT document_id, clause_type, seq, ev_ord, strpos(text, quote) - 1 AS found_start, strpos(text, quote) - 1 + length(quote) AS found_end,
        cast(floor((length(text) - length(replace(text, quote, ''))) / length(quote)) AS bigint) - 1 AS other_occurrences
    FROM checked WHERE status = 'relocated' AND contains(text, quote)""")
def _(t: Inputs):
    c = gr.check_evidence(t.evidence, t.docs).where("status = 'relocated' and found_quote = quote")
    return c.select("document_id", "clause_type", "seq", "ev_ord", *[F.col(x).cast("long").alias(x) for x in ("found_start", "found_end", "other_occurrences")])


@query("G3_locate_loosely")
def _(t: Inputs):
    return gr.check_evidence(t.evidence, t.docs).where("status = 'relocated' and found_quote <> quote")


@query("G5_repaired_clauses", f"""
    WITH {EVIDENCE} SELECT c.document_id, c.clause_type, c.seq, count(e.quote) AS kept FROM {{clauses}} c
    LEFT JOIN (SELECT * FROM checked WHERE NOT ({FLAGS})) e USING (document_id, clause_type, seq) GROUP BY 1, 2, 3""")
def _(t: Inputs):
    r = gr.repaired_clauses(t.clauses, gr.check_evidence(t.evidence, t.docs))
    return r.select("document_id", "clause_type", "seq", F.size("evidence").cast("long").alias("kept"))


@query("G6_check_extractions", f"WITH {EVIDENCE} SELECT status, count(*) AS n FROM checked GROUP BY 1")
def _(t: Inputs):
    return gr.check_evidence(t.evidence, t.docs).groupBy("status").agg(F.count("*").alias("n"))


@query("G7_grounding_report", f"""
    WITH {EVIDENCE} SELECT document_id, count(*) AS total, count(*) FILTER (WHERE {FLAGS}) AS ungrounded,
        count(*) FILTER (WHERE status = 'exact') AS n_exact, count(*) FILTER (WHERE {FLAGS}) / count(*)::double AS violation_rate FROM checked GROUP BY 1""")
def _(t: Inputs):
    return gr.report(gr.check_evidence(t.evidence, t.docs), ["document_id"]).select("document_id", "total", "ungrounded", "n_exact", "violation_rate")


# the checks: each by its own SQL over clause, evidence and document rows

_HAS = ", ".join(f"coalesce(bool_or(present) FILTER (WHERE clause_type = '{c}'), false) AS has_{c}" for c, *_ in dims.CLAUSE_TYPES)
_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_DATE = r"^\d{4}(-\d{2})?(-\d{2})?$"
BASE = f"""
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, clause_type ORDER BY seq DESC) AS rn FROM {{clauses}}) WHERE rn = 1),
    cited AS (SELECT document_id, clause_type, seq, count(*) AS n_evidence, count(DISTINCT (char_start, char_end)) AS n_spans FROM {{evidence}} GROUP BY 1, 2, 3),
    c AS (SELECT l.*, t.tier, t.presence_only, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_spans, 0) AS n_spans, d.text,
                 replace(trim(value), '_', '') AS digits, regexp_matches(trim(value), '{_INT}') AS is_int, regexp_matches(trim(value), '{_DATE}') AS is_date
          FROM last l JOIN {{types}} t USING (clause_type) LEFT JOIN cited USING (document_id, clause_type, seq) JOIN {{docs}} d ON d.document_id = l.document_id),
    e AS (SELECT e.*, length(d.text) AS size FROM {{evidence}} e JOIN last USING (document_id, clause_type, seq) JOIN {{docs}} d ON d.document_id = e.document_id),
    p AS (SELECT document_id, count(*) AS n, bool_or(present) AS any_p, bool_and(present) AS all_p, count(DISTINCT confidence) AS n_conf, {_HAS},
                 max(value) FILTER (WHERE clause_type = 'effective_date' AND present) AS s, max(value) FILTER (WHERE clause_type = 'expiration_date' AND present) AS x
          FROM last GROUP BY 1)"""
_N = "clause_type = 'notice_period_to_terminate_renewal' AND present AND value IS NOT NULL AND value <> 'UNSPECIFIED'"
_LOW = "try_cast({0} || CASE WHEN length({0}) = 7 THEN '-01' ELSE '' END AS date)"
_KNOWN = "[" + ", ".join(f"'{k}'" for k in dims.known_jurisdictions()) + "]"


def _row(rule: str, severity: str, condition: str, frame: str = "c") -> str:
    return f"SELECT document_id, '{rule}' AS rule_id, '{severity}' AS severity, clause_type AS clause_types FROM {frame} WHERE {condition}"


def _doc(rule: str, severity: str, condition: str, *types: str) -> str:
    return f"SELECT document_id, '{rule}' AS rule_id, '{severity}' AS severity, '{','.join(types)}' AS clause_types FROM p WHERE {condition}"


def _implies(rule: str, severity: str, a: str, b: str) -> str:
    return _doc(rule, severity, f"has_{a} AND NOT has_{b}", a, b)


_NOTICE = "notice_period_to_terminate_renewal"
CHECKS: dict[str, tuple[str, str]] = {
    "V1": ("presence_requires_evidence", _row("presence_requires_evidence", "error", "present AND n_evidence = 0")),
    "V2": ("absence_forbids_evidence", _row("absence_forbids_evidence", "error", "NOT present AND n_evidence > 0")),
    "V3": ("absence_forbids_value", _row("absence_forbids_value", "error", "NOT present AND value IS NOT NULL")),
    "V4": ("absence_forbids_raw_text", _row("absence_forbids_raw_text", "error", "NOT present AND raw_text <> ''")),
    "V5": ("boolean_clause_carries_no_value", _row("boolean_clause_carries_no_value", "warning", "presence_only AND value IS NOT NULL")),
    "V6": ("valued_clause_missing_value", _row("valued_clause_missing_value", "warning", "present AND NOT presence_only AND value IS NULL")),
    "V7": ("governing_law_unknown_jurisdiction", _row("governing_law_unknown_jurisdiction", "error",
        f"clause_type = 'governing_law' AND present AND len(list_filter(string_split(value, ';'), lambda x: trim(x) <> '' AND NOT list_contains({_KNOWN}, trim(x)))) > 0")),
    "V8": ("date_unparseable", _row("date_unparseable", "error",
        "clause_type IN ('effective_date', 'expiration_date') AND present AND value NOT IN ('PERPETUAL', 'UNSPECIFIED') AND NOT is_date")),
    "V9": ("date_implausible_year", _row("date_implausible_year", "error",
        "clause_type IN ('effective_date', 'expiration_date') AND present AND is_date AND NOT (try_cast(substring(value, 1, 4) AS int) BETWEEN 1900 AND 2100)")),
    "V10": ("perpetual_effective_date", _row("perpetual_effective_date", "error", "clause_type = 'effective_date' AND value = 'PERPETUAL'")),
    "V11": ("notice_period_format", " UNION ALL ".join((
        _row("notice_period_not_integer", "error", f"{_N} AND NOT is_int"),
        _row("notice_period_non_positive", "error", f"{_N} AND is_int AND try_cast(digits AS bigint) <= 0"),
        _row("notice_period_implausible", "warning", f"{_N} AND is_int AND try_cast(digits AS bigint) > 1825")))),
    "V12": ("evidence_offsets_inverted", _row("evidence_offsets_inverted", "error", "char_end <= char_start", "e")),
    "V13": ("evidence_outside_document", _row("evidence_outside_document", "error", "char_end > size", "e")),
    "V14": ("evidence_too_short", _row("evidence_too_short", "warning", r"length(regexp_replace(quote, '^\s+|\s+$', '', 'g')) < 12", "e")),
    "V15": ("evidence_duplicated", _row("evidence_duplicated", "warning", "n_spans < n_evidence")),
    "V16": ("raw_text_not_verbatim", _row("raw_text_not_verbatim", "error", f"raw_text <> '' AND NOT contains({NORM.format('text')}, {NORM.format('raw_text')})")),
    "V17": ("uncapped_without_cap", _implies("uncapped_without_cap", "error", "uncapped_liability", "cap_on_liability")),
    "V18": ("notice_period_without_renewal_term", _implies("notice_period_without_renewal_term", "warning", _NOTICE, "renewal_term")),
    "V19": ("renewal_term_without_notice_period", _implies("renewal_term_without_notice_period", "info", "renewal_term", _NOTICE)),
    "V20": ("effective_after_expiration", _doc("effective_after_expiration", "error",
        f"regexp_matches(s, '{_DATE}') AND regexp_matches(x, '{_DATE}') AND (substring(s, 1, 4)::int > substring(x, 1, 4)::int OR (substring(s, 1, 4) = substring(x, 1, 4) "
        f"AND length(s) > 4 AND length(x) > 4 AND {_LOW.format('s')} > {_LOW.format('x')}))", "effective_date", "expiration_date")),
    "V21": ("expiration_without_effective", _implies("expiration_without_effective", "info", "expiration_date", "effective_date")),
    "V22": ("parties_absent", _row("parties_absent", "warning", "clause_type = 'parties' AND NOT present")),
    "V23": ("non_compete_without_exclusivity", _implies("non_compete_without_exclusivity", "info", "non_compete", "exclusivity")),
    "V24": ("tier3_low_confidence", _row("tier3_low_confidence", "warning", "tier = 3 AND present AND confidence < 0.7::double")),
    "V25": ("very_low_confidence", _row("very_low_confidence", "warning", "present AND confidence < 0.4::double")),
    "V26": ("confidence_is_constant", _doc("confidence_is_constant", "warning", "n >= 3 AND n_conf = 1")),
    "V27": ("nothing_extracted", _doc("nothing_extracted", "error", "NOT any_p")),
    "V28": ("everything_present", _doc("everything_present", "warning", "n >= 12 AND all_p")),
    "V29": ("incomplete_clause_coverage", "SELECT document_id, 'incomplete_clause_coverage' AS rule_id, 'warning' AS severity, string_agg(clause_type, ',' ORDER BY clause_type) AS clause_types "
        "FROM (SELECT document_id, clause_type FROM {docs} CROSS JOIN {types} EXCEPT SELECT document_id, clause_type FROM last) GROUP BY 1"),
    "V30": ("duplicate_clause_types", "SELECT document_id, 'duplicate_clause_types' AS rule_id, 'error' AS severity, clause_type AS clause_types "
        "FROM {clauses} GROUP BY document_id, clause_type HAVING count(*) > 1"),
}


def _violations(t: Inputs, only: list[str] | None = None):
    return ru.apply_rules(t.clauses, t.evidence, t.docs.select("document_id", "text"), t.types, only)


for _id, (_rule, _sql) in CHECKS.items():
    query(f"{_id}_{_rule}", f"WITH {BASE} {_sql}")(lambda t, r=_rule: _violations(t, [r]))

ALL = " UNION ALL ".join(f"({sql})" for _, sql in CHECKS.values())


@query("V0_apply_rules", f"WITH {BASE} SELECT rule_id, severity, count(*) AS n FROM ({ALL}) GROUP BY 1, 2")
def _(t: Inputs):
    return _violations(t).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_REVIEW = f"""
    errs AS (SELECT document_id, count(*) AS n FROM ({ALL}) WHERE severity = 'error' GROUP BY 1),
    unsure AS (SELECT document_id, count(*) AS n FROM {{clauses}} JOIN {{types}} USING (clause_type) WHERE tier = 3 AND present AND confidence < 0.7::double GROUP BY 1)"""


@query("V31_needs_review", f"""
    WITH {BASE}, {_REVIEW}
    SELECT d.document_id, coalesce(errs.n, 0) > 0 OR coalesce(unsure.n, 0) > 0 AS needs_review, concat_ws('; ',
        CASE WHEN errs.n > 0 THEN errs.n || ' error-severity rule violation(s)' END, CASE WHEN unsure.n > 0 THEN unsure.n || ' Tier-3 clause(s) below confidence 0.7' END) AS reasons
    FROM {{docs}} d LEFT JOIN errs USING (document_id) LEFT JOIN unsure USING (document_id)""")
def _(t: Inputs):
    r = ru.needs_review(t.docs, _violations(t), t.clauses, t.types)
    return r.select("document_id", "needs_review", F.array_join("reasons", "; ").alias("reasons"))


@query("V32_routing", f"""
    WITH {BASE}, {_REVIEW}, {EVIDENCE}, bad AS (SELECT document_id, count(*) AS n FROM checked WHERE {FLAGS} GROUP BY 1)
    SELECT d.document_id, coalesce(errs.n, 0) > 0 OR coalesce(unsure.n, 0) > 0 OR coalesce(bad.n, 0) > 0 OR doc_id % 40 = 0 OR doc_id % 30 = 0 AS needs_review, concat_ws('; ',
        CASE WHEN errs.n > 0 THEN errs.n || ' error-severity rule violation(s)' END, CASE WHEN unsure.n > 0 THEN unsure.n || ' Tier-3 clause(s) below confidence 0.7' END,
        CASE WHEN doc_id % 40 = 0 THEN 'the agent loop stopped on a budget limit rather than finishing' END,
        CASE WHEN bad.n > 0 THEN bad.n || ' ungrounded evidence span(s)' END, CASE WHEN doc_id % 30 = 0 THEN 'agent: timeout' END) AS reasons
    FROM {{docs}} d LEFT JOIN errs USING (document_id) LEFT JOIN unsure USING (document_id) LEFT JOIN bad USING (document_id)""")
def _(t: Inputs):
    report = gr.report(gr.check_evidence(t.evidence, t.docs), ["document_id"]).select("document_id", "ungrounded")
    runs = t.docs.join(report, "document_id", "left").select(
        "document_id", (F.col("doc_id") % 40 == 0).alias("stopped_on_budget"), F.coalesce("ungrounded", F.lit(0)).alias("ungrounded"),
        F.when(F.col("doc_id") % 30 == 0, "timeout").alias("agent_error"))
    r = ru.needs_review(t.docs, _violations(t), t.clauses, t.types, runs)
    return r.select("document_id", "needs_review", F.array_join("reasons", "; ").alias("reasons"))


@query("V33_validate_submission", """
    WITH lacking AS (SELECT document_id, string_agg(clause_type, ',' ORDER BY ordinal) AS missing FROM {docs} CROSS JOIN {types}
                     WHERE (document_id, clause_type) NOT IN (SELECT (document_id, clause_type) FROM {clauses}) GROUP BY 1)
    SELECT document_id, doc_id % 29 <> 0 AS parsed, CASE WHEN doc_id % 29 <> 0 THEN coalesce(missing, '') END AS missing
    FROM (SELECT DISTINCT document_id, doc_id FROM {clauses}) LEFT JOIN lacking USING (document_id)""")
def _(t: Inputs):
    """Submissions as JSON: which parse, and which types they lack."""
    kind = "array<struct<clause_type:string,present:boolean,value:string,confidence:double>>"
    rows = t.clauses.groupBy("document_id", "doc_id").agg(F.to_json(F.collect_list(F.struct("clause_type", "present", "value", "confidence"))).alias("j"))
    cut = rows.withColumn("j", F.when(F.col("doc_id") % 29 == 0, F.substring("j", 1, 40)).otherwise(F.col("j")))
    parsed = cut.withColumn("c", F.from_json("j", kind, {"mode": "PERMISSIVE"}))
    every = F.array(*[F.lit(c) for c, *_ in dims.CLAUSE_TYPES])
    missing = F.array_except(every, F.transform("c", lambda x: x["clause_type"]))
    return parsed.select("document_id", F.col("c").isNotNull().alias("parsed"), F.array_join(missing, ",").alias("missing"))


@query("V34_run_status", """
    SELECT event_id, CASE WHEN s = 'submitted' THEN 'completed' WHEN s = 'max_turns' THEN 'incomplete_max_turns' WHEN s = 'timeout' THEN 'incomplete_timeout'
        WHEN n_clauses > 0 THEN 'completed' ELSE 'error' END AS status
    FROM (SELECT event_id, event_id % 3 AS n_clauses, CASE event_id % 5 WHEN 0 THEN 'submitted' WHEN 1 THEN 'max_turns' WHEN 2 THEN 'timeout' WHEN 3 THEN 'end_turn' ELSE 'unheard_of' END AS s FROM {events})""")
def _(t: Inputs):
    s = F.expr("case event_id % 5 when 0 then 'submitted' when 1 then 'max_turns' when 2 then 'timeout' when 3 then 'end_turn' else 'unheard_of' end")
    return op.run_status(t.events.select("event_id", s.alias("stop_reason"), (F.col("event_id") % 3).alias("n_clauses"))).select("event_id", "status")


_FLAT = "translate(text, chr(10) || chr(9) || chr(13), '   ')"  # as long as the text; white space stands alone in the tables' texts
_MOVED = f"CASE WHEN contains(text, quote) THEN strpos(text, quote) ELSE strpos({_FLAT}, {NORM.format('quote')}) END - 1"
_LENGTH = f"CASE WHEN contains(text, quote) THEN length(quote) ELSE length({NORM.format('quote')}) END"
REPAIRED = f"""
    repaired AS (SELECT document_id, doc_id, clause_type, seq, ev_ord,
        CASE WHEN status = 'relocated' THEN substring(text, {_MOVED} + 1, {_LENGTH}) ELSE quote END AS quote,
        CASE WHEN status = 'relocated' THEN {_MOVED} ELSE char_start END AS char_start,
        CASE WHEN status = 'relocated' THEN {_MOVED} + {_LENGTH} ELSE char_end END AS char_end
        FROM checked WHERE NOT ({FLAGS}))"""


@query("P1_extract_pipeline", f"""
    WITH {EVIDENCE}, {REPAIRED}, {BASE.replace('{evidence}', 'repaired')}, {_REVIEW},
    every AS (SELECT document_id, count(*) AS n FROM ({ALL}) GROUP BY 1), bad AS (SELECT document_id, count(*) AS n FROM checked WHERE {FLAGS} GROUP BY 1)
    SELECT d.document_id, coalesce(every.n, 0) AS violations, coalesce(errs.n, 0) AS errors, coalesce(bad.n, 0) AS ungrounded,
        coalesce(errs.n, 0) > 0 OR coalesce(unsure.n, 0) > 0 OR coalesce(bad.n, 0) > 0 OR doc_id % 40 = 0 OR doc_id % 30 = 0 AS needs_review, concat_ws('; ',
        CASE WHEN errs.n > 0 THEN errs.n || ' error-severity rule violation(s)' END, CASE WHEN unsure.n > 0 THEN unsure.n || ' Tier-3 clause(s) below confidence 0.7' END,
        CASE WHEN doc_id % 40 = 0 THEN 'the agent loop stopped on a budget limit rather than finishing' END,
        CASE WHEN bad.n > 0 THEN bad.n || ' ungrounded evidence span(s)' END, CASE WHEN doc_id % 30 = 0 THEN 'agent: timeout' END) AS reasons
    FROM {{docs}} d LEFT JOIN every USING (document_id) LEFT JOIN errs USING (document_id) LEFT JOIN unsure USING (document_id) LEFT JOIN bad USING (document_id)""")
def _(t: Inputs):
    """Grounding, the thirty checks on the repaired evidence, the review and its reasons."""
    runs = t.docs.select("document_id", (F.col("doc_id") % 40 == 0).alias("stopped_on_budget"), F.when(F.col("doc_id") % 30 == 0, "timeout").alias("agent_error"))
    r = ru.review(t.docs.select("document_id", "text"), t.clauses, t.evidence, t.types, runs)
    return r.withColumn("reasons", F.array_join("reasons", "; "))


@query("P8_get_schema", "SELECT clause_type, tier, CASE WHEN presence_only THEN 'presence' ELSE 'value' END AS value_format FROM {types}")
def _(t: Inputs):
    return t.types.select("clause_type", "tier", F.when(F.col("presence_only"), "presence").otherwise("value").alias("value_format"))
