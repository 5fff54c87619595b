"""Structure-aware chunks that are verbatim slices of their document.

``split_long_text`` is the native form for text without headings or blank
lines; ``chunk_documents`` follows headings, paragraphs and overlaps and runs
batch by batch beside the data.  Neither shuffles.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions import text as tx

CHUNK = (
    "chunk_id string, document_id string, text string, char_start int, char_end int, ordinal int, heading string, token_count int"
)
# What counts as a heading, and how much of it is kept.
_AT = r"(?:\A|(?<=\n)|(?<=\s{2}))[ \t]*"
NUMBERED = re.compile(_AT + r"(?P<label>\d{1,2}(?:\.\d{1,2}){0,3})\.?[ \t]+(?=[A-Z\"(])")
ARTICLE = re.compile(
    _AT + r"(?P<label>(?:ARTICLE|Article|SECTION|Section)[ \t]+(?:[IVXLC]{1,6}|\d{1,2}(?:\.\d{1,2}){0,2}))"
    r"(?=[ \t]*(?:\n|[:.—-]|[ \t]+[A-Z]))"
)
_DIGIT, _NAMED = re.compile(r"\d"), re.compile("A(?:RTICLE|rticle)|S(?:ECTION|ection)")
BLANK_LINE = re.compile(r"\n[ \t]*\n")
TITLE_WINDOW = 80
_TITLE_END, _WORD, _SINGLE = re.compile("\n|  "), re.compile(r"\S+"), re.compile("([^ \n]*)[ \n]")


class Range(NamedTuple):
    """Words ``lo`` to ``hi`` of a text, under a heading's title; ``cut`` out of a paragraph or not."""

    lo: int
    hi: int
    title: str | None
    cut: bool = False


@dataclass(frozen=True)
class ChunkLimits:
    """Words per chunk, words below which chunks are joined, words shared by split pieces."""

    max_tokens: int = 512
    min_tokens: int = 64
    overlap_tokens: int = 64

    def __post_init__(self):
        if self.max_tokens <= 0 or self.min_tokens < 0 or self.overlap_tokens < 0:
            raise ValueError("max_tokens must be positive, the others not negative")

    @property
    def shared(self) -> int:
        return min(self.overlap_tokens, self.max_tokens - 1)


def headings(text: str) -> list[tuple[int, str, str]]:
    """(offset, label, title) of each heading in order; the longer label at one offset."""
    marks = [(m.start("label"), m["label"]) for kind, hint in ((NUMBERED, _DIGIT), (ARTICLE, _NAMED)) if hint.search(text) for m in kind.finditer(text)]
    longest = dict(sorted(marks, key=lambda m: (m[0], len(m[1]))))
    return [(at, label, _TITLE_END.split(text[at : at + TITLE_WINDOW], maxsplit=1)[0].strip()) for at, label in longest.items()]


Count = Callable[[str, list[tuple[int, int]]], "np.ndarray"]


def word_count(text: str, words: list[tuple[int, int]]) -> np.ndarray:
    """Tokens up to each word, where every word is one token."""
    return np.arange(len(words) + 1)


def tokenizer_count(path: str) -> Count:
    """Counts tokens of a tokenizers file: a word has those that begin in it."""
    loaded: dict[str, object] = {}

    def count(text: str, words: list[tuple[int, int]]) -> np.ndarray:
        if path not in loaded:
            from tokenizers import Tokenizer

            loaded[path] = Tokenizer.from_file(path)
        begins = np.array([a for a, b in loaded[path].encode(text, add_special_tokens=False).offsets if b > a], np.int64)
        ends = np.array([b for _, b in words], np.int64)
        return np.concatenate(([0], np.searchsorted(np.sort(begins), ends, "left")))

    return count


def _merged(ranges: list[Range], fits: Callable[[Range, Range], bool]) -> list[Range]:
    """Neighbouring ranges joined from the left wherever ``fits`` allows it; the first title stays."""
    out: list[Range] = []
    for r in ranges:
        if out and fits(out[-1], r):
            out[-1] = out[-1]._replace(hi=r.hi, title=out[-1].title or r.title)
        else:
            out.append(r)
    return out


def word_ranges(text: str, words: list[tuple[int, int]], upto: np.ndarray, limits: ChunkLimits, marks: list[tuple[int, str, str]]) -> list[Range]:
    """The chunks of a text as ranges of its words; ``upto`` counts the tokens before each word, ``marks`` are its headings."""
    size = lambda lo, hi: int(upto[hi] - upto[lo])
    starts = [a for a, _ in words]
    edges = [0, *(bisect_left(starts, at) for at, _, _ in marks), len(words)]
    sections = [Range(lo, hi, title) for lo, hi, title in zip(edges, edges[1:], [None, *(m[2] for m in marks)], strict=False) if hi > lo]
    most, least = limits.max_tokens, limits.min_tokens

    def windows(r: Range) -> Iterator[Range]:
        """Overlapping runs of words with at most ``most`` tokens; a longer word is a run of its own."""
        lo = r.lo
        while True:
            hi = min(r.hi, max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1))
            yield Range(lo, hi, r.title, True)
            if hi == r.hi:
                return
            lo = max(lo + 1, min(hi, int(np.searchsorted(upto, upto[hi] - limits.shared, "left"))))

    def parts(section: Range) -> list[Range]:
        """A section too long for a chunk: its paragraphs, joined as far as they fit, and cut where one does not."""
        if size(section.lo, section.hi) <= most:
            return [section]
        breaks = [k for k in range(section.lo + 1, section.hi) if starts[k] - words[k - 1][1] > 1 and BLANK_LINE.search(text, words[k - 1][1], starts[k])]
        edges = [section.lo, *breaks, section.hi]
        paragraphs = [Range(lo, hi, section.title) for lo, hi in zip(edges, edges[1:], strict=False)]
        ranges = [w for p in paragraphs for w in (windows(p) if size(p.lo, p.hi) > most else (p,))]
        return _merged(ranges, lambda a, b: not b.cut and a.hi <= b.lo and size(a.lo, b.hi) <= most)

    found = [p for s in sections for p in parts(s)]
    return _merged(found, lambda a, b: least > 0 and size(a.lo, a.hi) < least and a.hi <= b.lo and size(a.lo, b.hi) <= most)


def single_spans(text: str) -> list[tuple[int, int]]:
    """The spans of ``text.single_words`` without what parts them."""
    return [m.span(1) for m in _SINGLE.finditer(text + "\n")] if text else []


def chunk_text(text: str, limits: ChunkLimits = ChunkLimits(), count: Count = word_count, single: bool = False) -> list[tuple[int, int, str | None, int]]:
    """(start, stop, heading, token count) of the chunks of one text.

    ``single``: each blank or line end parts two words, which may be empty, and nothing is a heading.
    """
    words = single_spans(text) if single else [m.span() for m in _WORD.finditer(text)]
    upto = count(text, words)
    marks = [] if single else headings(text)
    return [(words[r.lo][0], words[r.hi - 1][1], r.title, int(upto[r.hi] - upto[r.lo])) for r in word_ranges(text, words, upto, limits, marks)]


def chunk_documents(docs: DataFrame, limits: ChunkLimits = ChunkLimits(), count: Count = word_count, single: bool = False) -> DataFrame:
    """Chunks of ``document_id, text``; null texts have none.  ``single``: as for ``chunk_text``."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.document_id, b.text, strict=True):
                for n, (s, e, h, t) in enumerate(chunk_text(text or "", limits, count, single)):
                    rows.append((f"{doc}::{n:04d}", doc, text[s:e], s, e, n, h, t))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return docs.select("document_id", "text").mapInPandas(run, CHUNK)


def find_headings(docs: DataFrame) -> DataFrame:
    """(document_id, char_start, label, heading) of every heading."""

    def run(batches):
        for b in batches:
            rows = [(d, *h) for d, t in zip(b.document_id, b.text, strict=True) for h in headings(t or "")]
            yield pd.DataFrame(rows, columns=["document_id", "char_start", "label", "heading"])

    return docs.select("document_id", "text").mapInPandas(run, "document_id string, char_start int, label string, heading string")


def _words(single: bool) -> tuple[Column, Column, Callable[[Column], Column]]:
    """Of ``text``: what comes before the words, the words with what follows them, and how a run of words is freed from that."""
    if single:
        return F.lit(0), tx.single_words("text"), lambda w: F.substring(w, F.lit(1), F.length(w) - 1)
    return F.length(F.regexp_extract("text", f"(?U)^{tx.SPACE}*", 0)), tx.words_with_space("text"), tx.strip


def tokens(docs: DataFrame, single: bool = False) -> DataFrame:
    """(document_id, pos, tstart, tend): words with code-point offsets, natively; those of ``single_words`` if ``single``."""
    lead, words, bare = _words(single)
    rows = docs.select("document_id", lead.alias("lead"), F.posexplode(words).alias("pos", "w"))
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("lead") + F.coalesce(F.sum(F.length("w")).over(before), F.lit(0))
    return rows.select("document_id", "pos", at.cast("int").alias("tstart"), (at + F.length(bare(F.col("w")))).cast("int").alias("tend"))


def tokens_in_range(token_rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds token_count to (document_id, char_start, char_end): tokens that start inside."""
    inside = (F.col("t.tstart") >= F.col("r.char_start")) & (F.col("t.tstart") < F.col("r.char_end"))
    joined = ranges.alias("r").join(token_rows.alias("t"), (F.col("r.document_id") == F.col("t.document_id")) & inside, "left")
    return joined.groupBy("r.document_id", "r.char_start", "r.char_end").agg(F.count("t.pos").alias("token_count"))


def tokens_in_own_range(ranges: DataFrame, single: bool = False) -> DataFrame:
    """``tokens_in_range`` for (document_id, text, char_start, char_end): counted in each text, where no token becomes a row."""
    count = tx.single_starts if single else tx.word_starts
    inside = F.coalesce(count("text", F.col("char_start"), F.col("char_end")), F.lit(0)).cast("long")
    return ranges.select("document_id", "char_start", "char_end", inside.alias("n")).groupBy("document_id", "char_start", "char_end").agg(F.sum("n").alias("token_count"))


def split_long_text(docs: DataFrame, limits: ChunkLimits = ChunkLimits(), single: bool = False) -> DataFrame:
    """Chunks of texts without headings and blank lines, in built-in functions.

    Pieces of max_tokens words start every max_tokens - overlap words, of ``single_words`` if ``single``.
    """
    size, step = limits.max_tokens, limits.max_tokens - limits.shared
    lead, words, bare = _words(single)
    words = docs.select("document_id", lead.alias("lead"), words.alias("words")).where(F.size("words") > 0)
    # sums of whole steps first, so that a piece's offset needs only those before it
    step_of = lambda k: F.slice("words", k * step + 1, F.lit(step))
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, w: n + F.length(w))
    extra = F.greatest(F.lit(0), F.ceil((F.size("words") - size) / F.lit(step)).cast("int"))
    sums = words.withColumn("sums", F.transform(F.sequence(F.lit(0), extra), lambda k: total(step_of(k))))
    piece = F.transform("sums", lambda n, k: F.struct(
        k.alias("k"),
        (F.col("lead") + F.aggregate(F.slice("sums", F.lit(1), k), F.lit(0), lambda a, x: a + x)).alias("char_start"),
        bare(F.array_join(F.slice("words", k * step + 1, F.lit(size)), "")).alias("text"),
        F.least(F.lit(size), F.size("words") - k * step).alias("token_count"),
    ))
    rows = sums.select("document_id", F.explode(piece).alias("p"))
    return rows.select(
        F.concat_ws("::", "document_id", F.lpad(F.col("p.k").cast("string"), 4, "0")).alias("chunk_id"),
        "document_id",
        "p.text",
        "p.char_start",
        (F.col("p.char_start") + F.length("p.text")).alias("char_end"),
        F.col("p.k").alias("ordinal"),
        F.lit(None).cast("string").alias("heading"),
        "p.token_count",
    )


def sections(heading_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, char_start, char_end, heading), untrimmed: each heading up to the next."""
    order = Window.partitionBy("document_id").orderBy("char_start")
    ends = heading_rows.withColumn("next_start", F.lead("char_start").over(order)).withColumn("n", F.row_number().over(order))
    joined = docs.select("document_id", F.length("text").alias("size")).join(ends, "document_id", "left")
    own = joined.where("char_start is not null").select(
        "document_id", "char_start", F.coalesce("next_start", "size").alias("char_end"), "heading")
    preamble = joined.where("n is null or (n = 1 and char_start > 0)").select(
        "document_id", F.lit(0).alias("char_start"), F.coalesce("char_start", "size").alias("char_end"), F.lit(None).cast("string").alias("heading"))
    return preamble.unionByName(own).where("char_end > char_start")


def chunk_violations(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks that break an invariant; must be empty."""
    d = docs.select("document_id", F.col("text").alias("source"))
    c = chunks.join(d, "document_id", "left")
    bad = (
        (F.col("char_end") < F.col("char_start"))
        | (F.col("char_end") - F.col("char_start") != F.length("text"))
        | F.coalesce(tx.slice_text("source", F.col("char_start"), F.col("char_end")) != F.col("text"), F.lit(True))
    )
    return c.where(bad).select("chunk_id", "document_id", "char_start", "char_end")


def content_hash(text: Column | str) -> Column:
    return F.sha2(text, 256)


def chunk_content_hash(chunks: DataFrame, model: str) -> DataFrame:
    """(document_id, content_hash) over the model name and the chunk spans in order."""
    part = F.concat_ws(":", "chunk_id", F.col("char_start").cast("string"), F.col("char_end").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", part.alias("part"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["part"]), "")
    return chunks.groupBy("document_id").agg(F.sha2(F.concat(F.lit(model), joined), 256).alias("content_hash"))


def unindexed(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids whose stored hash is missing or differs, in order."""
    new = docs.select("document_id", content_hash("text").alias("new_hash"))
    old = stored.select("document_id", F.col("content_hash").alias("old_hash"))
    return new.join(old, "document_id", "left").where(~F.col("new_hash").eqNullSafe(F.col("old_hash"))).select("document_id").orderBy("document_id")


def read_span(docs: DataFrame, reads: DataFrame, pad: int = 400, most: int = 8000, per_run: int = 6) -> DataFrame:
    """Text of the requested spans with context; per run the first ``per_run`` reads."""
    order = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text")
    valid = (F.col("char_end") > F.col("char_start")) & (F.col("char_start") < size)
    joined = reads.join(docs.select("document_id", "text"), "document_id").withColumn("n", F.sum(valid.cast("int")).over(order))
    lo = F.greatest(F.lit(0), F.col("char_start") - pad)
    hi = F.least(size, F.least(F.col("char_end"), F.col("char_start") + most) + pad)
    status = F.when(~valid, "out_of_bounds").when(F.col("n") > per_run, "read_limit").otherwise("ok")
    return joined.select(
        "run_id", "seq", "document_id", status.alias("status"),
        F.when(status == "ok", lo).alias("from_char"), F.when(status == "ok", hi).alias("to_char"),
        F.when(status == "ok", tx.slice_text("text", lo, hi)).alias("span_text"),
    )


def with_context(hits: DataFrame, docs: DataFrame, pad: int = 400) -> DataFrame:
    """Adds the chunk's text with ``pad`` code points on both sides."""
    joined = hits.join(docs.select("document_id", F.col("text").alias("source")), "document_id")
    lo, hi = F.greatest(F.lit(0), F.col("char_start") - pad), F.least(F.length("source"), F.col("char_end") + pad)
    return joined.withColumn("context", tx.slice_text("source", lo, hi)).drop("source")


def truncated(docs: DataFrame, max_tokens: int = 8192, chars_per_token: int = 4) -> DataFrame:
    """(document_id, text, was_truncated): at most max_tokens * chars_per_token code points."""
    limit = max_tokens * chars_per_token
    return docs.select("document_id", F.substring("text", 1, limit).alias("text"), (F.length("text") > limit).alias("was_truncated"))
