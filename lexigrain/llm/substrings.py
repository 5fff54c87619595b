"""Removal of passages that repeat across documents, by content-defined chunks.

A gear rolling hash of the last 16 bytes cuts a text behind white space where
it falls under a bound (one word end in ``words_a_chunk``; anywhere else, in
texts without white space, once in 256 bytes).  Cuts depend on nothing but
these bytes, so a passage has the same chunks wherever it stands and whatever
was inserted before it.  What is compared is runs of ``join`` successive chunks,
one begun at each chunk, by the digest of them all: single chunks are short and
meet by chance.  A run whose digest occurs in more than one document belongs to
the smallest id; in the others such runs overlap to a repeated passage, which is
cut out if it has at least ``min_words`` words.

Digests travel as 16 bytes a chunk, once to be aggregated (a digest in a third
of all documents is one row per task) and once to find the documents that
repeat one, where the rows of digests that very many hold are dealt to many
parts; texts are only read again, where they stand.  ``min_words`` is less than
the 50 words looked for, since the chunks at the two ends of a passage also
hold other text.

Defined results: null text counts as empty and stays empty; a document all of
which stands in others before it has an empty text and keeps its row; rows
that repeat an id are one document, so nothing is removed on account of the
other; rows with a null id come after all others; an empty table gives an empty
one; other columns are ignored here and kept by ``dedup_documents``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import gear_hashes, id_text, join_on_key, materialise

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_LAST = (1 << 63) - 1


def chunk_ends(data: np.ndarray, words_a_chunk: int) -> np.ndarray:
    """Byte offsets where chunks end, the last one included."""
    h = gear_hashes(data)
    space = _SPACE[data]
    hit = (space & (h < np.uint32((1 << 32) // words_a_chunk))) | (~space & (h < np.uint32(1 << 24)))
    at = np.flatnonzero(hit) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    return np.append(at, len(data))


def digests(raw: bytes, ends: np.ndarray) -> list[int]:
    """A signed 64-bit digest of each chunk, without the white space around it."""
    digest, start, out = xxhash.xxh3_64_intdigest, 0, []
    for end in ends.tolist():
        out.append(digest(raw[start:end].strip()) - (1 << 63))
        start = end
    return out


def run_digests(raw: bytes, ends: np.ndarray, join: int) -> list[int]:
    """A digest of each ``join`` successive chunks; of all of them, if they are fewer."""
    own = np.array(digests(raw, ends), np.int64).view(np.uint64)
    n, out = max(1, len(own) - join + 1), np.zeros(max(1, len(own) - join + 1), np.uint64)
    for i in range(min(join, len(own))):
        out = (out ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def repeated_spans(text: str, repeated: set[int], words_a_chunk: int, min_words: int, join: int) -> list[tuple[int, int]]:
    """Code-point spans of overlapping repeated runs that have at least ``min_words`` words together."""
    raw = text.encode("utf-8")
    if not raw or not repeated:
        return []
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data, words_a_chunk)
    starts = np.concatenate(([0], ends[:-1]))
    space = _SPACE[data]
    first = ~space & np.concatenate(([True], space[:-1]))
    words = np.concatenate(([0], np.cumsum(first)))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begun = np.flatnonzero(np.fromiter((d in repeated for d in run_digests(raw, ends, join)), bool))
    cover = np.zeros(len(ends) + 1, np.int64)  # by how many repeated runs a chunk is covered, as differences
    np.add.at(cover, begun, 1)
    np.add.at(cover, np.minimum(begun + join, len(ends)), -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        lo, hi = int(starts[a]), int(ends[b - 1])
        if words[hi] - words[lo] >= min_words:
            out.append((int(points[lo]), int(points[hi])))
    return out


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_chunk: int = 4, min_words: int = 30, join: int = 3
) -> DataFrame:
    """(row, spans, kept_text): each row of ``docs`` as a struct, and its cuts.

    spans are code-point offsets [start, stop) of the passages of the text that
    stand in a document of a smaller id; kept_text is the text without them.
    """
    rows = id_text(docs, id_col, text_col)

    def chunks(batches):
        for b in batches:
            ids, found = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8")
                if raw:
                    own = set(run_digests(raw, chunk_ends(np.frombuffer(raw, np.uint8), words_a_chunk), join))
                    found.extend(own)
                    ids.extend([_LAST if doc_id is None else doc_id] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc", "digest"])

    held = rows.mapInArrow(chunks, "doc long, digest long")
    owners = held.groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("other"), F.count("*").alias("held"))
    owners = materialise(owners.where("owner < other").drop("other"), "substrings-owners")
    repeats = join_on_key(held, owners, "digest", "held", "doc").where("doc <> owner")
    by_doc = repeats.groupBy("doc").agg(F.collect_list("digest").alias("repeats"))
    return with_cuts(docs, by_doc, id_col, text_col, words_a_chunk, min_words, join)


def with_cuts(docs: DataFrame, by_doc: DataFrame, id_col: str, text_col: str, words_a_chunk: int, min_words: int, join: int) -> DataFrame:
    """``docs`` with spans and kept_text, given the repeated digests by document."""

    @F.pandas_udf("spans array<struct<start:bigint,stop:bigint>>, kept_text string")
    def cut(texts: pd.Series, repeats: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for text, repeated in zip(texts, repeats, strict=True):
            if text is None:  # nothing repeated
                spans.append([])
                kept.append(None)
                continue
            found = repeated_spans(text, set(repeated.tolist()), words_a_chunk, min_words, join)
            at, parts = 0, []
            for lo, hi in found:
                parts.append(text[at:lo])
                at = hi
            spans.append([{"start": lo, "stop": hi} for lo, hi in found])
            kept.append("".join([*parts, text[at:]]))
        return pd.DataFrame({"spans": spans, "kept_text": kept})

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    joined = own.withColumn("doc", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(_LAST))).join(by_doc, "doc", "left")
    done = joined.withColumn("cut", cut(F.when(F.col("repeats").isNotNull(), text), F.col("repeats")))
    return done.select("row", "cut.spans", F.coalesce("cut.kept_text", text).alias("kept_text"))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **kw) -> DataFrame:
    """``docs`` with ``text_col`` cut and ``length_col`` counted again."""
    rows = repeated_passages(docs, id_col, text_col, **kw)
    changed = {text_col: F.col("kept_text"), length_col: F.length("kept_text").cast("long")}
    return rows.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])
