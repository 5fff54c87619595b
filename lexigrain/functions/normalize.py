"""Normal forms of dates, durations and parties, in built-in functions.

Every form is idempotent: a normal value stays as it is.  Values that fit no
rule are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain import dims
from lexigrain.dims import MONTHS
from lexigrain.functions.text import PARTIAL_DATE, strip

# Days of a unit, number words, and phrasings of the two sentinels.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
NUMBERS |= {"fifteen": 15, "twenty": 20, "thirty": 30, "forty-five": 45, "sixty": 60, "ninety": 90, "one hundred twenty": 120, "one hundred eighty": 180}
OPEN_ENDED = ("perpetual", "indefinite", "until terminated")
MASKED = ("[]", "[* * *]")


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def normalize_date(value: Column) -> Column:
    """An ISO prefix at the known precision, PERPETUAL, UNSPECIFIED, or null.

    US order of month and day; two-digit years fall in 1950-2049; masked parts
    shorten the prefix.
    """
    s = strip(value)
    names = "|".join(MONTHS)
    month_of = _map({m.lower(): f"{i:02d}" for i, m in enumerate(MONTHS, 1)})
    get = lambda p, i: F.regexp_extract(s, p, i)
    two = lambda c: F.lpad(c, 2, "0")
    slashed = r"^(\d{1,2}|\[\])/(\d{1,2}|\[\])/(\d{4}|\d{2})$"
    year = get(slashed, 3)
    year = F.when(F.length(year) == 4, year).when(year.try_cast("int") < 50, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    m, d = get(slashed, 1), get(slashed, 2)
    short = F.when(m == "[]", year).when(d == "[]", F.concat_ws("-", year, two(m))).otherwise(F.concat_ws("-", year, two(m), two(d)))
    day_of = rf"(?i)^(?:the )?(\d{{1,2}})(?:st|nd|rd|th)? day of ({names}),? (\d{{4}})$"
    month_day, month_year = rf"(?i)^({names}) (\d{{1,2}}),? (\d{{4}})$", rf"(?i)^({names}),? (\d{{4}})$"
    named = lambda p, i: F.try_element_at(month_of, F.lower(get(p, i)))
    return (
        F.when(F.lower(s).isin(*OPEN_ENDED), dims.PERPETUAL)
        .when(s.isin(*MASKED), dims.UNSPECIFIED)
        .when(s.isin(dims.PERPETUAL, dims.UNSPECIFIED) | s.rlike(PARTIAL_DATE), s)
        .when(s.rlike(slashed), short)
        .when(s.rlike(day_of), F.concat_ws("-", get(day_of, 3), named(day_of, 2), two(get(day_of, 1))))
        .when(s.rlike(month_day), F.concat_ws("-", get(month_day, 3), named(month_day, 1), two(get(month_day, 2))))
        .when(s.rlike(month_year), F.concat_ws("-", get(month_year, 2), named(month_year, 1)))
    )


def normalize_days(value: Column) -> Column:
    """A whole number of days: units are fixed, business days count as days."""
    s = F.lower(strip(value))
    digits = F.coalesce(*[F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"\((\d+)\)", r"(\d+)")]).try_cast("int")
    words = "|".join(sorted(NUMBERS, key=len, reverse=True))
    spelt = F.try_element_at(_map(NUMBERS), F.regexp_extract(s, rf"\b({words})\b", 1))
    unit = F.try_element_at(_map(UNIT_DAYS), F.regexp_extract(s, r"\b(day|week|month|quarter|year)s?\b", 1))
    return F.when(s.rlike(r"^\d+$"), s.try_cast("int")).otherwise(F.coalesce(digits, spelt) * unit)


def normalize_duration(value: Column) -> Column:
    """struct<length_days, recurring>: rolling extensions are recurring."""
    days = normalize_days(value)
    rolling = F.lower(value).rlike(r"\b(?:successive|automatic(?:ally)?|consecutive|each)\b")
    return F.when(days.isNotNull(), F.struct(days.alias("length_days"), rolling.alias("recurring")))


def normalize_parties(value: Column) -> Column:
    """array<struct<name, role>> of 'Name ("Role"); Name', in order; role null where none is given."""
    role = r'\("([^"]+)"\)\s*$'
    items = F.filter(F.transform(F.split(value, ";"), strip), lambda p: p != "")
    return F.transform(items, lambda p: F.struct(
        strip(F.regexp_replace(p, role, "")).alias("name"), F.nullif(F.regexp_extract(p, role, 1), F.lit("")).alias("role")))
