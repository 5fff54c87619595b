"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Fingerprints that
differ in at most three bits differ in at most one bit of one segment, so that
segment with one bit deleted is equal in both.  Every distinct fingerprint is
indexed under its two whole segments and its 64 one-deletion variants, the
index is equality-joined with itself, and pairs are verified by counting bits.

Equal fingerprints are one class from the start, so groups of copies of any
size cost one fingerprint.  In a variant's bucket only fingerprints that hold a
0 at the deleted bit meet those that hold a 1 there, and the count of differing
bits is part of the join condition: only verified links leave the join.

Defined results: null text counts as empty; a text without words has
fingerprint zero and links like any other; repeated rows are returned as often
as they occur; a null id keeps its row and never names a component (a component
of null ids only has a null component_id); an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.common import connected_components, id_text, join_on_key, materialise

SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fold(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The fingerprint: a bit is 1 where over half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, block):
        part = np.ascontiguousarray(hashes[i : i + block]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            fps = np.array([fold(shingle_hashes(t, width)) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """The rows of ``fps`` (fp and others) under both segments and their one-deletion variants: with key, whole and side.

    Segments that differ in at most one bit share the key of a variant; side is the deleted bit.
    """
    # slot 0 and 33: whole segment; the others: segment with bit (slot % 33 - 1) deleted
    slot = F.col("slot")
    bit = F.pmod(slot, F.lit(33)) - 1
    upper = slot >= 33
    segment = F.when(upper, F.expr("shiftrightunsigned(fp, 32)")).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return (
        fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("slot"))
        .select(*fps.columns, slot, bit.alias("bit"), segment.alias("seg"))
        .select(
            *fps.columns,
            (F.col("bit") < 0).alias("whole"),
            F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(seg, bit) & 1L")).alias("side"),
            F.expr(
                "shiftleft(cast(slot as bigint), 32) | case when bit < 0 then seg else "
                "shiftleft(shiftright(seg, bit + 1), bit) | (seg & (shiftleft(1L, bit) - 1L)) end"
            ).alias("key"),
        )
    )


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within ``max_bits`` (at most 3)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments guarantee at most 3 differing bits")
    index = variants(fps.select("fp"))
    a = index.where("whole or side = 0").select("key", "whole", F.col("fp").alias("a"))
    b = index.where("whole or side = 1").select(F.col("key").alias("key_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    ordered = ~F.col("whole") | (F.col("a") < F.col("b"))
    # Spark takes a side for as small as ``fps``, 33 times too small: unasked it sends millions of rows through the driver
    return a.hint("merge").join(b, (F.col("key") == F.col("key_b")) & near & ordered).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of at most
    ``max_bits`` differing bits.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), max_bits), "simhash-links")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "copies", "first_id", F.coalesce("root", "fp").alias("root")
    )
    # classes of one fingerprint need no second pass; only linked ones share a root
    component = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(component, "root").select("fp", "copies", "component_id"), "simhash-named")
    return join_on_key(rows, named, "fp", "copies", "doc_id").select("doc_id", "fp", "component_id")
