"""Verification of quoted evidence against its document.

Statuses that built-in functions decide are decided there; only the quotes
left over, with the texts they belong to, go through a Python regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import text as tx

STATUSES = ("exact", "normalized", "relocated", "artifact_elided", "not_found", "out_of_bounds", "empty")
STRICT = ("exact", "normalized", "relocated")
GROUNDED = (*STRICT, "artifact_elided")
# Fixed value: a page footer of the filing system, which a quote may skip between two words.
FOOTER = r"(?:\d{1,4}\s+)?Source:[^\S\n]+[^\n]{1,160}?\d{1,2}/\d{1,2}/\d{4}"


def locate_loosely(text: str, quote: str) -> tuple[int, int, int, bool] | None:
    """(start, stop, matches, footer skipped) of a quote up to white space and footers."""
    words = tx.escape_words(quote)
    if not words:
        return None
    for gap, elided in ((r"\s+", False), (rf"(?:\s+{FOOTER})?\s+", True)):
        if elided and "Source:" not in text:
            return None
        found = [m.span() for m in re.finditer(gap.join(words), text)]
        if found:
            return *found[0], len(found), elided
    return None


_LOOSE = "start int, stop int, n int, elided boolean"


def _loose(texts: Column, quotes: Column) -> Column:
    return tx.by_rows(_LOOSE, lambda t, q: None if t is None or q is None else locate_loosely(t, q))(texts, quotes)


def check_evidence(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds status, found_start, found_end, found_quote and other_occurrences.

    evidence: document_id, quote, char_start, char_end and any other columns.
    """
    keep = [F.col(f"e.`{c}`") for c in evidence.columns]
    joined = evidence.alias("e").join(docs.select("document_id", F.col("text").alias("_text")).alias("d"), "document_id")
    q, s, e, t = F.col("quote"), F.col("char_start"), F.col("char_end"), F.col("_text")
    here = tx.slice_text(t, s, e)
    cheap = (
        F.when(tx.strip(q) == "", "empty")
        .when(here == q, "exact")
        .when((here != "") & (tx.normalize_whitespace(here) == tx.normalize_whitespace(q)), "normalized")
        .when(F.contains(t, q), "relocated")
    )
    beyond = F.when((e > F.length(t)) | (s >= F.length(t)), "out_of_bounds").otherwise("not_found")
    staged = joined.select("document_id", *[k.alias(c) for k, c in zip(keep, evidence.columns, strict=True) if c != "document_id"],
                           "_text", cheap.alias("_cheap"))
    # one plan for all rows: where built-in functions have decided, the Python function gets nulls
    undecided = F.col("_cheap").isNull()
    loose = _loose(F.when(undecided, F.col("_text")), F.when(undecided, q))
    fields = [x.split()[0] for x in _LOOSE.split(", ")]
    both = staged.withColumn("_l", loose).select(*[F.col(f"`{c}`") for c in staged.columns], *[F.col(f"_l.{n}").alias(f"_{n}") for n in fields])
    at, n = tx.find("_text", "quote"), tx.count_occurrences("_text", "quote")
    status = F.coalesce("_cheap", F.when(F.col("_start").isNull(), beyond).when(F.col("_elided"), "artifact_elided").otherwise("relocated"))
    native = F.col("_cheap").isin("exact", "normalized")
    moved = F.col("_cheap") == "relocated"
    start = F.when(native, s).when(moved, at).otherwise(F.col("_start"))
    stop = F.when(native, e).when(moved, at + F.length(q)).otherwise(F.col("_stop"))
    out = both.select(*[F.col(f"`{c}`") for c in staged.columns if c not in ("_text", "_cheap")], "_text", "_cheap",
                      status.alias("status"), start.alias("found_start"), stop.alias("found_end"),
                      F.when(moved, n - 1).otherwise(F.coalesce(F.col("_n") - 1, F.lit(0))).alias("other_occurrences"))
    quote = F.when(native, q).when(F.col("found_start").isNotNull(), tx.slice_text("_text", F.col("found_start"), F.col("found_end")))
    return out.withColumn("found_quote", quote).drop("_text", "_cheap")


def repaired(checked: DataFrame) -> DataFrame:
    """Evidence with its found offsets; ungrounded rows are gone."""
    kept = checked.where(F.col("status").isin(*GROUNDED))
    changed = {"quote": "found_quote", "char_start": "found_start", "char_end": "found_end"}
    drop = {"status", "found_start", "found_end", "found_quote", "other_occurrences"}
    return kept.select(*[F.col(changed.get(c, c)).alias(c) for c in checked.columns if c not in drop])


def repaired_clauses(clauses: DataFrame, checked: DataFrame) -> DataFrame:
    """Clauses with their kept evidence as an ordered array (empty if none)."""
    keys = ["document_id", "clause_type", "seq"]
    item = F.struct("ev_ord", "quote", "char_start", "char_end")
    kept = repaired(checked).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    empty = F.array().cast("array<struct<ev_ord:int,quote:string,char_start:int,char_end:int>>")
    return clauses.join(kept, keys, "left").withColumn("evidence", F.coalesce("evidence", empty))


def report(checked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """total, ungrounded, strictly grounded, one count per status, violation_rate."""
    bad = F.count_if(~F.col("status").isin(*GROUNDED))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    grouped = checked.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), bad.alias("ungrounded"), F.count_if(F.col("status").isin(*STRICT)).alias("strict"), *counts
    )
    return grouped.withColumn("violation_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("ungrounded") / F.col("total")))
