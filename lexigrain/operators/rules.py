"""Thirty deterministic checks of extracted clauses, and the routing to review.

``clauses``: document_id, seq, clause_type, present, value, raw_text,
confidence.  ``evidence``: document_id, clause_type, seq, ev_ord, quote,
char_start, char_end.  Of clauses that repeat a type the last counts, except
for the check on repeats.  Each check is a filter over one of five frames
(clauses, evidence, documents, repeats, missing types), so a run is a few
joins on document_id and one union.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.functions import text as tx
from lexigrain.operators import grounding

SEVERITIES = ("error", "warning", "info")
DATES = ("effective_date", "expiration_date")
NOTICE = "notice_period_to_terminate_renewal"


@dataclass(frozen=True)
class Rule:
    """A check; ``emits`` lists (id, severity, condition) and ``types`` what is named (None: the row's own type)."""

    rule_id: str
    frame: str
    emits: tuple[tuple[str, str, Column], ...]
    types: tuple[str, ...] | None = None


def last_clauses(clauses: DataFrame) -> DataFrame:
    """The last row of each (document, type)."""
    order = Window.partitionBy("document_id", "clause_type").orderBy(F.desc("seq"))
    return clauses.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def per_clause(clauses: DataFrame, evidence: DataFrame, docs: DataFrame, types: DataFrame) -> DataFrame:
    """Last clauses with tier, evidence counts and whether raw_text is verbatim."""
    keys = ["document_id", "clause_type", "seq"]
    cited = evidence.groupBy(*keys).agg(
        F.count("*").alias("n_evidence"), F.countDistinct("char_start", "char_end").alias("n_spans")
    )
    last = last_clauses(clauses)
    return (
        last.join(cited, keys, "left")
        .join(verbatim(last, docs), ["document_id", "clause_type"], "left")
        .join(F.broadcast(types), "clause_type")
        .fillna(0, ["n_evidence", "n_spans"])
    )


def verbatim(last: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, clause_type, verbatim): whether the document holds the raw_text, up to white space.

    A document's raw texts (one a type at most) meet its text in one row, so
    the text is joined and normalised once; empty raw texts have no row.
    """
    raw = last.where(F.coalesce("raw_text", F.lit("")) != "").select("document_id", F.struct("clause_type", "raw_text").alias("r"))
    raw = raw.groupBy("document_id").agg(F.collect_list("r").alias("raws"))
    text = docs.select("document_id", tx.normalize_whitespace("text").alias("_text"))
    found = F.transform("raws", lambda r: F.struct(
        r["clause_type"].alias("clause_type"), F.contains(F.col("_text"), tx.normalize_whitespace(r["raw_text"])).alias("verbatim")))
    rows = raw.join(text, "document_id", "left").select("document_id", F.explode(found).alias("v"))
    return rows.select("document_id", "v.clause_type", "v.verbatim")


def per_document(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document: which types are present, and what whole results show."""
    has = [F.coalesce(F.bool_or(F.when(F.col("clause_type") == c, F.col("present"))), F.lit(False)).alias(f"has_{c}") for c, *_ in dims.CLAUSE_TYPES]
    dates = [F.max(F.when((F.col("clause_type") == d) & F.col("present"), F.col("value"))).alias(d) for d in DATES]
    found = rows.groupBy("document_id").agg(
        F.count("*").alias("n_types"), F.bool_or("present").alias("any_present"), F.bool_and("present").alias("all_present"),
        F.countDistinct("confidence").alias("n_confidences"), *has, *dates,
    )
    return docs.select("document_id").join(found, "document_id", "left").fillna(0, ["n_types"]).fillna(False, [f"has_{c}" for c, *_ in dims.CLAUSE_TYPES])


def dates_out_of_order(start: Column, end: Column) -> Column:
    """Years first; within a year the first days that the partial dates may mean."""
    a, b = tx.partial_date(start), tx.partial_date(end)
    usable = ~end.isin(dims.PERPETUAL, dims.UNSPECIFIED) & (start != dims.UNSPECIFIED)
    later = (a["y"] > b["y"]) | ((a["y"] == b["y"]) & (tx.date_lower_bound(a) > tx.date_lower_bound(b)))
    return F.coalesce(usable & later, F.lit(False))


def registry() -> list[Rule]:
    """The thirty checks."""
    present, value = F.col("present"), F.col("value")
    is_date = F.col("clause_type").isin(*DATES)
    has = lambda c: F.col(f"has_{c}")
    parsed = tx.partial_date(value)
    law = F.col("clause_type") == "governing_law"
    known = F.array(*[F.lit(k) for k in dims.known_jurisdictions()])
    parts = F.filter(F.transform(F.split(value, ";"), tx.strip), lambda p: p != "")
    notice = (F.col("clause_type") == NOTICE) & present & value.isNotNull() & (value != dims.UNSPECIFIED)
    days = tx.python_int(value)
    short = F.length(tx.strip("quote")) < dims.MIN_QUOTE_CHARS

    def one(rule_id: str, severity: str, frame: str, condition: Column, *types: str) -> Rule:
        return Rule(rule_id, frame, ((rule_id, severity, condition),), types or None)

    def implies(rule_id: str, severity: str, a: str, b: str) -> Rule:
        return one(rule_id, severity, "document", has(a) & ~has(b), a, b)

    none = ("",)
    return [
        one("presence_requires_evidence", "error", "clause", present & (F.col("n_evidence") == 0)),
        one("absence_forbids_evidence", "error", "clause", ~present & (F.col("n_evidence") > 0)),
        one("absence_forbids_value", "error", "clause", ~present & value.isNotNull()),
        one("absence_forbids_raw_text", "error", "clause", ~present & (F.col("raw_text") != "")),
        one("boolean_clause_carries_no_value", "warning", "clause", F.col("presence_only") & value.isNotNull()),
        one("valued_clause_missing_value", "warning", "clause", present & ~F.col("presence_only") & value.isNull()),
        one("governing_law_unknown_jurisdiction", "error", "clause", law & present & F.exists(parts, lambda p: ~F.array_contains(known, p))),
        one("date_unparseable", "error", "clause", is_date & present & ~value.isin(dims.PERPETUAL, dims.UNSPECIFIED) & parsed.isNull()),
        one("date_implausible_year", "error", "clause", is_date & present & ~parsed["y"].between(*dims.YEARS)),
        one("perpetual_effective_date", "error", "clause", (F.col("clause_type") == "effective_date") & (value == dims.PERPETUAL)),
        Rule("notice_period_format", "clause", (
            ("notice_period_not_integer", "error", notice & days.isNull()),
            ("notice_period_non_positive", "error", notice & (days <= 0)),
            ("notice_period_implausible", "warning", notice & (days > dims.MAX_NOTICE_DAYS)),
        )),
        one("evidence_offsets_inverted", "error", "evidence", F.col("char_end") <= F.col("char_start")),
        one("evidence_outside_document", "error", "evidence", F.col("char_end") > F.col("size")),
        one("evidence_too_short", "warning", "evidence", short),
        one("evidence_duplicated", "warning", "clause", F.col("n_spans") < F.col("n_evidence")),
        one("raw_text_not_verbatim", "error", "clause", ~F.col("verbatim")),
        implies("uncapped_without_cap", "error", "uncapped_liability", "cap_on_liability"),
        implies("notice_period_without_renewal_term", "warning", NOTICE, "renewal_term"),
        implies("renewal_term_without_notice_period", "info", "renewal_term", NOTICE),
        one("effective_after_expiration", "error", "document", dates_out_of_order(F.col(DATES[0]), F.col(DATES[1])), *DATES),
        implies("expiration_without_effective", "info", "expiration_date", "effective_date"),
        one("parties_absent", "warning", "clause", (F.col("clause_type") == "parties") & ~present),
        implies("non_compete_without_exclusivity", "info", "non_compete", "exclusivity"),
        one("tier3_low_confidence", "warning", "clause", (F.col("tier") == 3) & present & (F.col("confidence") < dims.TIER3_FLOOR)),
        one("very_low_confidence", "warning", "clause", present & (F.col("confidence") < dims.GLOBAL_FLOOR)),
        one("confidence_is_constant", "warning", "document", (F.col("n_types") >= 3) & (F.col("n_confidences") == 1), *none),
        one("nothing_extracted", "error", "document", (F.col("n_types") > 0) & ~F.col("any_present"), *none),
        one("everything_present", "warning", "document", (F.col("n_types") >= len(dims.CLAUSE_TYPES)) & F.col("all_present"), *none),
        one("incomplete_clause_coverage", "warning", "missing", F.lit(True)),
        one("duplicate_clause_types", "error", "repeat", F.lit(True)),
    ]


def apply_rules(clauses: DataFrame, evidence: DataFrame, docs: DataFrame, types: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(document_id, rule_id, severity, clause_types): all violations.

    clause_types is the comma-joined list of the types a violation names.
    ``only`` keeps the checks of these registry ids.  Sorting by severity and
    rule is left to ``in_order``.
    """
    rules = [r for r in registry() if only is None or r.rule_id in only]
    rows = per_clause(clauses, evidence, docs, types)
    last = last_clauses(clauses).select("document_id", "clause_type", "seq")
    missing = docs.select("document_id").join(F.broadcast(types.select("clause_type"))).join(last, ["document_id", "clause_type"], "left_anti")
    frames = {
        "clause": lambda: rows,
        "evidence": lambda: evidence.join(last, ["document_id", "clause_type", "seq"]).join(
            docs.select("document_id", F.length("text").alias("size")), "document_id", "left"),
        "document": lambda: per_document(last_clauses(clauses), docs),
        "missing": lambda: missing.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("clause_type")), ",").alias("clause_type")),
        "repeat": lambda: clauses.groupBy("document_id", "clause_type").agg(F.count("*").alias("n")).where("n > 1"),
    }
    out = None
    for frame in dict.fromkeys(r.frame for r in rules):
        # one pass per frame: every check adds an element, failed ones are null
        found = []
        for rule in (r for r in rules if r.frame == frame):
            named = F.col("clause_type") if rule.types is None else F.lit(",".join(rule.types))
            for rule_id, severity, condition in rule.emits:
                found.append(F.when(condition, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), named.alias("clause_types"))))
        part = frames[frame]().select("document_id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("document_id", "v.*")
        out = part if out is None else out.unionByName(part)
    return out


def in_order(violations: DataFrame) -> DataFrame:
    """Most severe first within a document, then by rule."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return violations.orderBy("document_id", rank, "rule_id", "clause_types")


def needs_review(docs: DataFrame, violations: DataFrame, clauses: DataFrame, types: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(document_id, needs_review, reasons): error violations, unsure Tier-3 clauses, budget stops.

    runs: document_id, stopped_on_budget, ungrounded, agent_error; a missing
    frame adds no reasons.
    """
    errors = violations.where("severity = 'error'").groupBy("document_id").agg(F.count("*").alias("n_errors"))
    unsure = (
        clauses.join(F.broadcast(types), "clause_type")
        .where(f"tier = 3 and present and confidence < {dims.TIER3_FLOOR}")
        .groupBy("document_id").agg(F.count("*").alias("n_unsure"))
    )
    joined = docs.select("document_id").join(errors, "document_id", "left").join(unsure, "document_id", "left")
    if runs is None:
        joined = joined.select("*", F.lit(False).alias("stopped_on_budget"), F.lit(0).alias("ungrounded"), F.lit(None).cast("string").alias("agent_error"))
    else:
        joined = joined.join(runs.select("document_id", "stopped_on_budget", "ungrounded", "agent_error"), "document_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("n_errors") > 0, F.format_string("%d error-severity rule violation(s)", "n_errors")),
        F.when(F.col("n_unsure") > 0, F.format_string("%d Tier-3 clause(s) below confidence 0.7", "n_unsure")),
        F.when(F.col("stopped_on_budget"), F.lit("the agent loop stopped on a budget limit rather than finishing")),
        F.when(F.col("ungrounded") > 0, F.format_string("%d ungrounded evidence span(s)", "ungrounded")),
        F.when(F.col("agent_error").isNotNull(), F.concat(F.lit("agent: "), "agent_error")),
    ))
    return joined.select("document_id", (F.size(reasons) > 0).alias("needs_review"), reasons.alias("reasons"))


def review(docs: DataFrame, clauses: DataFrame, evidence: DataFrame, types: DataFrame, runs: DataFrame) -> DataFrame:
    """(document_id, violations, errors, ungrounded, needs_review, reasons): from quoted evidence to the routing.

    Evidence is grounded first, the checks see what was kept at the offsets
    found, and what was not grounded is a reason for a review.  runs:
    document_id, stopped_on_budget, agent_error.
    """
    checked = grounding.check_evidence(evidence, docs)
    found = apply_rules(clauses, grounding.repaired(checked), docs, types)
    report = grounding.report(checked, ["document_id"]).select("document_id", "ungrounded")
    known = docs.select("document_id").join(runs, "document_id", "left").join(report, "document_id", "left").fillna(0, ["ungrounded"])
    counts = found.groupBy("document_id").agg(F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"))
    routed = needs_review(docs, found, clauses, types, known.select("document_id", "stopped_on_budget", "ungrounded", "agent_error"))
    joined = known.select("document_id", "ungrounded").join(counts, "document_id", "left").join(routed, "document_id")
    return joined.fillna(0, ["violations", "errors"]).select("document_id", "violations", "errors", "ungrounded", "needs_review", "reasons")
