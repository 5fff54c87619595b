"""Extraction without a model: patterns for governing law, dates, parties and perpetual terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.dims import MONTHS

# The phrasings the baseline knows.
_M = "|".join(MONTHS)
LAW = (  # the first letters of what follows come first, as in the other patterns: most places of a text are refused by that alone
    r"(?iU)(?=[gcs])(?:governed\s+by|construed\s+in\s+accordance\s+with|subject\s+to)\s+(?:and\s+construed\s+in\s+accordance\s+with\s+)?"
    r"the\s+(?:internal\s+|substantive\s+)?laws?\s+of\s+(?:the\s+)?"
    r"(?:State\s+of\s+|Commonwealth\s+of\s+|State\s+or\s+Commonwealth\s+of\s+)?"
    r"([A-Z][A-Za-z\s]{2,30}?)(?=[,\.\;\)]|\s+without|\s+and\s|\s+excluding)"
)
DAY_OF_MONTH = rf"(?iU)(\d{{1,2}})(?:st|nd|rd|th)?\s+day\s+of\s+({_M}),?\s+(\d{{4}})"
MONTH_FIRST = rf"(?iU)(?=[jfmasond])({_M})\s+(\d{{1,2}}),?\s+(\d{{4}})"
RECITAL = r"(?iU)(?=[ba])(?:by\s+and\s+between|between|among)\s+([^.;]{10,400}?)(?=\s*(?:\.|;|\n\n|WHEREAS|RECITAL|W\s?I\s?T\s?N\s?E\s?S))"
COMPANY = r"(?U)\b(?:Inc|LLC|L\.L\.C|Ltd|Limited|Corp|Corporation|Company|Co|plc|PLC|GmbH|S\.A|N\.V|LP|L\.P|Trust|Partnership)\b\.?"
PERPETUAL = r"(?iU)(?=[ipur])\b(?:in\s+perpetuity|perpetual|until\s+terminated|remain\s+in\s+(?:full\s+)?force\s+and\s+effect\s+until\s+terminated)\b"
RECITAL_WINDOW, PARTY_LENGTH = 6000, 300
CONFIDENCE = {"governing_law": 0.60, "effective_date": 0.55, "parties": 0.55, "expiration_date": 0.50}

FOUND = "clause_type string, value string, char_start int, char_end int, confidence double"


def alias_index(aliases: dict[str, list[str]] = dims.ALIASES) -> dict[str, str]:
    """Lower-cased names and aliases to ids."""
    names = {v.lower(): k for k, v in dims.jurisdiction_names().items()}
    return names | {a.lower(): k for k, more in aliases.items() for a in more}


def _one_space(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def _lookup(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))


def _place(gaps: Column, whole: Column, i: Column) -> Column:
    """Where the i-th match ends: the text is the gaps between the matches and the matches in turn, so a place is a sum of lengths."""
    return _total(F.slice(gaps, F.lit(1), i + 1)) + _total(F.slice(whole, F.lit(1), i + 1))


# Letters that a pattern without case takes for one of ASCII, and that lower() leaves or makes longer.
_LIKE_ASCII = ("\u017f", "\u0131", "\u0130")
_LOOK_BACK = 64  # code points kept before a match, for what a word's edge needs to know
# Words of which each match begins with one; in a text with a word of the second list it may begin anywhere.
# A recital may also begin with the "by and" before its "between", which is no part of what it says.
_BEGINS = {
    "law": (("governed", "construed", "subject"), ()),
    "day": ((), ("day",)),
    "month": (tuple(m.lower() for m in MONTHS), ()),
    "recital": (("between", "among"), ()),
    "perpetual": (("until", "remain"), ("perpetu",)),
}


def _skipped(kind: str) -> Column:
    """How much of ``text`` comes before any match, by its lower case ``low``; null where there can be none."""
    begins, anywhere = _BEGINS[kind]
    at = [F.when(F.contains("low", F.lit(w)), F.instr("low", w)) for w in begins]
    first = F.least(*at) if at else F.lit(None).cast("int")
    whole = F.lit(False)
    for found in [F.contains("low", F.lit(w)) for w in anywhere] + [F.contains("text", F.lit(x)) for x in _LIKE_ASCII]:
        whole = whole | found
    return F.when(whole, 0).when(first.isNotNull(), F.greatest(first - 1 - _LOOK_BACK, F.lit(0)))


def _clause(kind: str, value: Column, end: Column, length: Column) -> Column:
    found = F.struct(F.lit(kind).alias("clause_type"), value.alias("value"), (end - length).cast("int").alias("char_start"),
                     end.cast("int").alias("char_end"), F.lit(CONFIDENCE[kind]).alias("confidence"))
    return F.when(value.isNotNull(), found)


def _named(x: Column) -> Column:
    return F.try_element_at(_lookup(alias_index()), F.lower(_one_space(x)))


def find_clauses(docs: DataFrame) -> DataFrame:
    """(document_id, FOUND): what the patterns find in each document, in built-in functions.

    The governing law is the first phrase that names a known jurisdiction, the
    date the first 'n-th day of month, year' or else the first 'month day, year'
    (no calendar check), the parties the first recital of the opening that names
    at least two companies, and a perpetual term its first phrase.  Patterns
    read a text only from the first word on that a match may begin with.  What
    is used more than once is a column of its own, so that no pattern runs once
    for each use.
    """
    c = F.col
    size = lambda k: F.lit(RECITAL_WINDOW) if k == "recital" else F.length("text")
    rest = lambda k: F.when(c(f"{k}_skip") < size(k), F.substring("text", c(f"{k}_skip") + 1, size(k) - c(f"{k}_skip"))).alias(k)
    companies = lambda x: F.size(F.regexp_extract_all(x, F.lit(COMPANY), F.lit(0)))
    one = {"day": DAY_OF_MONTH, "month": MONTH_FIRST, "perpetual": PERPETUAL}
    many = {"law": (LAW, lambda x: _named(x).isNotNull()), "recital": (RECITAL, lambda x: companies(x) > 1)}
    found = lambda k: F.nullif(F.regexp_extract(k, one[k], 0), F.lit("")).alias(f"{k}_found")
    kept = lambda k: F.filter(F.transform(f"{k}_said", lambda x, i: F.when(many[k][1](x), i)), lambda i: i.isNotNull())

    rows = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    kinds = ("day", "perpetual", *many)
    rows = rows.select("*", *[_skipped(k).alias(f"{k}_skip") for k in kinds]).select("*", *[rest(k) for k in kinds])
    rows = rows.select("*", found("day"), found("perpetual"), *[F.regexp_extract_all(k, F.lit(p), F.lit(1)).alias(f"{k}_said") for k, (p, _) in many.items()])
    # a date of the second form only where there is none of the first
    rows = rows.select("*", *[F.get(kept(k), F.lit(0)).alias(f"{k}_i") for k in many], F.when(c("day_found").isNull(), _skipped("month")).alias("month_skip"))
    rows = rows.select("*", *[F.when(c(f"{k}_i").isNotNull(), F.regexp_extract_all(k, F.lit(p), F.lit(0))).alias(f"{k}_whole") for k, (p, _) in many.items()], rest("month"))
    rows = rows.select("*", found("month"))

    def first(k: str) -> Column:
        """(said, length, end) of the first match."""
        n = F.length(f"{k}_found")
        end = c(f"{k}_skip") + F.length(F.get(F.split(k, one[k], 2), F.lit(0))) + n
        return F.when(n.isNotNull(), F.struct(c(f"{k}_found").alias("said"), n.alias("length"), end.alias("end")))

    def accepted(k: str) -> Column:
        """(said, length, end) of the match that was kept."""
        i, whole = c(f"{k}_i"), c(f"{k}_whole")
        end = c(f"{k}_skip") + _place(F.split(k, many[k][0]), whole, i)
        return F.when(i.isNotNull(), F.struct(F.get(f"{k}_said", i).alias("said"), F.length(F.get(whole, i)).alias("length"), end.alias("end")))

    rows = rows.select("document_id", accepted("law").alias("law"), F.coalesce(first("day"), first("month")).alias("day"),
                       accepted("recital").alias("recital"), first("perpetual").alias("perpetual"))
    body = F.length("recital.said")  # a recital ends with the part that names the parties
    clauses = F.array(
        _clause("governing_law", _named(c("law.said")), c("law.end"), c("law.length")),
        _clause("effective_date", iso_date(c("day.said")), c("day.end"), c("day.length")),
        _clause("parties", F.substring(_one_space(c("recital.said")), 1, PARTY_LENGTH), c("recital.end"), body),
        _clause("expiration_date", F.when(c("perpetual").isNotNull(), dims.PERPETUAL), c("perpetual.end"), c("perpetual.length")),
    )
    return rows.select("document_id", F.explode(F.array_compact(clauses)).alias("c")).select("document_id", "c.*")


def run_baseline(docs: DataFrame, types: DataFrame) -> DataFrame:
    """Twelve clauses per document; types without a finding are absent at confidence 0.5."""
    grid = docs.select("document_id").join(F.broadcast(types.select("clause_type", F.col("ordinal").alias("seq"))))
    joined = grid.join(find_clauses(docs), ["document_id", "clause_type"], "left")
    return joined.select(
        "document_id", "seq", "clause_type", F.col("value").isNotNull().alias("present"), "value", "char_start", "char_end",
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def iso_date(text: Column | str = "text") -> Column:
    """The value of ``first_date``."""
    months = _lookup({m.lower(): f"{i:02d}" for i, m in enumerate(MONTHS, 1)})
    part = lambda p, i: F.regexp_extract(text, p, i)

    def value(p, d, m):
        iso = F.concat_ws("-", part(p, 3), F.try_element_at(months, F.lower(part(p, m))), F.lpad(part(p, d), 2, "0"))
        return F.when(part(p, 0) != "", iso)

    return F.coalesce(value(DAY_OF_MONTH, 1, 2), value(MONTH_FIRST, 2, 1))


def resolve_aliases(values: DataFrame, aliases: DataFrame, column: str = "value") -> DataFrame:
    """Adds jurisdiction_id by the lower-cased, white-space-collapsed name."""
    key = F.lower(F.btrim(F.regexp_replace(column, r"(?U)\s+", " ")))
    return values.withColumn("_a", key).join(F.broadcast(aliases.select(F.col("alias").alias("_a"), F.col("id").alias("jurisdiction_id"))), "_a", "left").drop("_a")
