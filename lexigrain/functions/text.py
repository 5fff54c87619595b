"""Text primitives as columns; offsets are code points, half-open."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and the separators U+001C to U+001F, as Python's \s has it
SPACE = "[\\s\\x{1c}-\\x{1f}]"
NOT_SPACE = "[^\\s\\x{1c}-\\x{1f}]"
_NO_KEY = re.compile(r"[\W_]+")  # all but what str.isalnum() has for letters and digits


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without the white space at both ends."""
    return F.regexp_replace(_col(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"(?U){SPACE}+", " "), "^ | $", "")


def slice_text(text: Column | str, start: Column, stop: Column) -> Column:
    """The code points [start, stop)."""
    return F.substring(_col(text), start + 1, F.greatest(stop - start, F.lit(0)))


def find(text: Column | str, needle: Column | str) -> Column:
    """Offset of the first occurrence, or null."""
    at = F.position(_col(needle), _col(text))
    return F.when(at > 0, at - 1)


def count_occurrences(text: Column | str, needle: Column | str) -> Column:
    """How often ``needle`` occurs without overlaps."""
    t, n = _col(text), _col(needle)
    return F.when(F.length(n) == 0, 0).otherwise(
        ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("int")
    )


def words_with_space(text: Column | str) -> Column:
    """Words with the white space behind them; their lengths add up to offsets."""
    return F.regexp_extract_all(_col(text), F.lit(f"(?U){NOT_SPACE}+{SPACE}*"), F.lit(0))


def single_words(text: Column | str) -> Column:
    """What each single blank or line end parts, with it (the last one gets a line end): words may be empty, an empty text has none."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.regexp_extract_all(F.concat(t, F.lit("\n")), F.lit("[^ \n]*[ \n]"), F.lit(0)))


def single_count(text: Column | str) -> Column:
    """One more than there are blanks and line ends."""
    t = _col(text)
    rest = F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.length(t) - F.length(rest) + 1


def single_starts(text: Column | str, start: Column, stop: Column) -> Column:
    """How many of ``single_words`` begin in [start, stop)."""
    t = _col(text)
    first = ((start <= 0) & (stop > 0) & (F.length(t) > 0)).cast("int")
    return first + single_count(slice_text(t, F.greatest(start, F.lit(1)) - 1, stop - 1)) - 1


def word_starts(text: Column | str, start: Column, stop: Column) -> Column:
    """How many words begin in [start, stop)."""
    t = _col(text)
    before = F.greatest(start, F.lit(0)) - 1
    part = F.when(before < 0, F.concat(F.lit(" "), slice_text(t, F.lit(0), stop))).otherwise(slice_text(t, before, stop))
    return F.regexp_count(part, F.lit(f"(?U)(?<={SPACE}){NOT_SPACE}"))


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_col(text), F.lit(f"(?U){NOT_SPACE}+"), F.lit(0)))


def query_terms(query: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(_col(query)), F.lit("[a-z0-9]+"), F.lit(0))


def or_query(query: Column | str) -> Column:
    """The terms joined by OR, null where there are none."""
    terms = query_terms(query)
    return F.when(F.size(terms) > 0, F.array_join(terms, " | "))


def by_rows(kind: str, f: Callable):
    """A Python function of whole texts.

    Spark sends it a hundred rows at a time: an Arrow batch holds ten thousand, of texts several hundred MB for a worker.
    """
    return F.udf(f, kind, useArrow=False)


def document_key(names: Column | str) -> Column:
    """Unicode NFC, the key of documents and titles."""

    return by_rows("string", lambda s: None if s is None else unicodedata.normalize("NFC", s))(names)


def relaxed_key(names: Column | str) -> Column:
    """NFC, case-folded, letters and digits only."""

    return by_rows("string", lambda s: None if s is None else _NO_KEY.sub("", unicodedata.normalize("NFC", s).casefold()))(names)


def span_status(source: Column | str, start: Column | str, gold: Column | str) -> Column:
    """exact, whitespace_only, out_of_bounds or mismatch of ``gold`` at ``start``."""
    t, at, g = _col(source), _col(start), _col(gold)
    found = slice_text(t, at, at + F.length(g))
    tail = normalize_whitespace(F.substring(t, at + 1, F.length(t)))
    return (
        F.when((at < 0) | ((g != "") & (at >= F.length(t))), "out_of_bounds")
        .when(found == g, "exact")
        .when(F.startswith(tail, normalize_whitespace(g)), "whitespace_only")
        .when(F.length(found) < F.length(g), "out_of_bounds")
        .otherwise("mismatch")
    )


def actual_offset(source: Column | str, gold: Column | str, status: Column) -> Column:
    """Where ``gold`` first occurs, for spans that are not exact."""
    return F.when((status != "exact") & (_col(gold) != ""), find(source, gold))


def python_int(c: Column | str) -> Column:
    """Python's int(): white space, a sign and single underscores allowed; null otherwise."""
    s = strip(c)
    digits = F.regexp_replace(s, "_", "")
    return F.when(s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), digits.try_cast("decimal(38,0)"))


PARTIAL_DATE = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"


def partial_date(c: Column | str) -> Column:
    """(y, m, d) of YYYY, YYYY-MM or YYYY-MM-DD; null struct otherwise."""
    s = strip(c)
    part = lambda i: F.regexp_extract(s, PARTIAL_DATE, i).try_cast("int")
    return F.when(s.rlike(PARTIAL_DATE), F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")))


def date_lower_bound(parsed: Column) -> Column:
    """The first day a partial date may mean; null for bare years and impossible dates."""
    y, m, d = parsed["y"], parsed["m"], parsed["d"]
    text = F.format_string("%04d-%02d-%02d", y, m, F.coalesce(d, F.lit(1)))
    return F.when(m.isNotNull() & (y > 0), F.try_to_date(text, "yyyy-MM-dd"))


def escape_words(quote: str) -> list[str]:
    return [re.escape(w) for w in quote.split()]
