"""Near copies by SimHash segments and shingle sets: Jaccard similarity of word shingles, verified.

Texts with the same set of shingles are one class from the start.  A class has
a SimHash fingerprint of ``2 * WORDS`` segments of 32 bits, indexed as in
``simhash`` under every one-deletion variant of each segment: classes with a
segment that differs in at most one bit meet.  Each meets the next one of its
bucket, so a bucket makes as many pairs as it has classes, and a pair is a link
only if the similarity of the two whole sets of 64-bit shingle hashes reaches
the bound.

At 0.8 two fingerprints differ in 15 % of their bits, more than the segments
can promise to find.  So the exact step looks further: a class also has a
MinHash signature of ``BANDS`` bands of ``ROWS`` values, and classes that share a
band are candidates too.  A pair at 0.8 shares no band with a chance of 1.3e-7,
a closer one with less.

Links serve to find components, so pairs that are connected already need no
look.  A band has a head, the class that shares bands with most others (in a
group of copies, that nearest to all).  Each class first meets one class only by
each way, that of its segments with which it shares most buckets and that of its
heads which shares bands with most, so a group of copies is one component after
about two pairs a copy; then the others of its buckets and heads, where these
are of other components, and in up to ``TURNS`` turns a class drawn from each
band that still holds several: as many pairs as classes in bands.  New links
join components, not classes, so no link is followed twice.  The classes of bands that still
hold several components are then joined exactly, by prefixes: with all sets in
one order, rare shingles first, two sets of a similarity of 0.8 share one of the
first fifth of both, and its places bound what they can share.  A sentence that
many texts hold is common, so it stands last and brings none together.  Sizes
and four bits of each of 192 MinHash values are conditions too: at 0.8 on
average 36 values differ there, and more than 68 with a chance below 1e-7.

Defined results: words are as in ``simhash``; a text of at most ``width`` words
is one shingle; texts without words are one class and link to nothing else;
null text counts as empty; a null id keeps its row and never names a component;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.common import _splitmix, connected_components, id_text, join_on_key, materialise
from lexigrain.llm.simhash import fold, shingle_hashes, variants

WORDS = 2
BANDS, ROWS = 40, 5
SKETCH, PLANES, MOST_VALUES = 3, 4, 68
TURNS = 3
SLACK = 1e-6
_FACTOR = (_splitmix(BANDS * ROWS, 51) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_splitmix(BANDS * ROWS, 52) >> np.uint64(32)).astype(np.uint32)
_BAND = _splitmix(BANDS, 53)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, width))


def signature(hashes: np.ndarray, block: int = 1024) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), block):
        np.minimum(low, (_FACTOR[:, None] * short[i : i + block] + _SHIFT[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a signature."""
    keys = _BAND.copy()
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def sketch(low: np.ndarray) -> np.ndarray:
    """Four bits of each of the first 192 values: three integers for the first bits, three for the second, and so on."""
    mixed = (low[: 64 * SKETCH].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    planes = (mixed >> np.arange(PLANES, dtype=np.uint64)[:, None]).astype(np.uint8) & np.uint8(1)
    return np.packbits(planes, axis=1).view(np.int64).reshape(-1)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set as ``WORDS`` integers, each of hashes of its own."""
    words = []
    for _ in range(WORDS):
        words.append(fold(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(29)
    return np.array(words, np.uint64).view(np.int64)


def _keys_and_sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, bands and sketch of a set; an empty one has no fingerprint and no bands."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(SKETCH * PLANES, np.int64)
    low = signature(hashes)
    return fingerprint(hashes), band_keys(low).view(np.int64), sketch(low)


def _class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, text_key, class, size, words, bands, sketch) for each row of ``docs``."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            words, bands, bits = zip(*map(_keys_and_sketch, sets), strict=True) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([_class_of(s) for s in sets], pa.int64()),
                    pa.array(map(len, sets), pa.int32()),
                    pa.array(words, pa.list_(pa.int64())),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "class", "size", "words", "bands", "sketch"],
            )

    columns = "doc_id long, text_key long, class long, size int, words array<long>, bands array<long>, sketch array<long>"
    return _keyed(docs, id_col, text_col).mapInArrow(run, columns)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(class, hashes) for each row of ``texts`` (class, text)."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["class", "hashes"])

    return texts.select("class", "text").mapInArrow(run, "class long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b and other columns) of classes whose sets have a similarity of at least ``least``."""
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("hashes_b"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    total = F.size("hashes_a") + F.size("hashes_b")
    # divisions round correctly, so a similarity of exactly ``least`` is met
    sized = F.least(F.size("hashes_a"), F.size("hashes_b")) / F.greatest(F.size("hashes_a"), F.size("hashes_b")) >= least
    return pairs.join(left, "a").join(right, "b").where(sized).where(both / (total - both) >= least).select(*pairs.columns)


def segment_pairs(known: DataFrame) -> DataFrame:
    """(a, b, shared): each class and those before it among the classes whose fingerprints share a variant of a segment, with how many they share."""
    words = known.select("class", F.posexplode("words").alias("word", "fp"))
    index = variants(words).where("not whole").select("class", F.expr("shiftleft(cast(word as bigint), 40) | key").alias("key"))
    before = F.lag("class").over(Window.partitionBy("key").orderBy("class"))
    return index.select(before.alias("a"), F.col("class").alias("b")).where("a is not null").groupBy("a", "b").agg(F.count("*").alias("shared"))


def _alike(least: float):
    """Whether sizes and sketches of the classes a and b leave room for a similarity of ``least``."""
    apart = 0
    for i in range(SKETCH):
        differ = [F.col("sketch_a")[j].bitwiseXOR(F.col("sketch_b")[j]) for j in range(i, SKETCH * PLANES, SKETCH)]
        apart += F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), differ))
    return (F.least("size_a", "size_b") / F.greatest("size_a", "size_b") >= least) & (apart <= MOST_VALUES)


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{x}" for c in df.columns})


def _between(pairs: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of classes of two components that may be links, with root_a and root_b."""
    sides = pairs.join(_side(roots, "a"), F.col("a") == F.col("class_a")).join(_side(roots, "b"), F.col("b") == F.col("class_b"))
    return sides.where("root_a <> root_b").where(_alike(least)).select("a", "b", "root_a", "root_b")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The ``roots`` (class, root, size, sketch) after more ``links`` (root_a, root_b); only components with a new link are looked at."""
    edges = links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    over = connected_components(edges, "copies-links").withColumnRenamed("root", "to")
    moved = roots.join(over, F.col("root") == F.col("node"), "left")
    return materialise(moved.select("class", F.coalesce("to", "root").alias("root"), "size", "sketch"), "copies-roots")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, class, root) of the bands that hold classes of several components."""
    rooted = members.join(roots, "class").select("band", "class", "root")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return rooted.join(mixed, "band")


def rare_starts(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``left`` (class, root, size, sketch) with each shingle (shingle, at) that may be the rarest of a link.

    All sets are put in one order, rare shingles first.  A set that shares
    ``least`` of its shingles with another shares one of its first 1 - ``least``,
    and so does the other.  Shingles that classes of one component only hold there are left out.
    """
    held = sets.join(left.select("class", "root", "size"), "class").select("class", "root", "size", F.explode("hashes").alias("shingle"))
    held = held.join(held.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    held = held.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("n", "shingle")) - 1)
    held = materialise(held.where(F.col("at") <= F.col("size") * (1 - least) + SLACK).select("class", "root", "shingle", "at"), "copies-order")
    mixed = held.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
    return held.drop("root").join(mixed, "shingle").join(left, "class")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8
) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over pairs of texts whose sets of
    ``width``-word shingles have a Jaccard similarity of at least ``least``.
    """
    rows = materialise(classes(docs, id_col, text_col, width), "copies")
    same = [F.first(c).alias(c) for c in ("size", "words", "bands", "sketch")]
    known = materialise(
        rows.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.count("*").alias("copies"), *same), "copies-classes"
    )
    index = known.select("class", F.explode("bands").alias("band"))
    shared = index.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(index.join(shared, "band"), "copies-bands")
    met = members.groupBy("class").agg(F.sum("n").alias("met"))
    heads = members.join(met, "class").groupBy("band").agg(F.max(F.struct("met", "class")).alias("head"))
    led = members.join(heads, "band").where("class <> head.class")
    led = led.select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b"), F.col("class").alias("asks"), F.lit(True).alias("led"), F.col("head.met").alias("shared"))
    asked = segment_pairs(known).select("a", "b", F.col("b").alias("asks"), F.lit(False).alias("led"), "shared").unionByName(led)
    asked = materialise(asked.distinct(), "copies-asked")
    best = asked.groupBy("asks", "led").agg(F.max(F.struct("shared", "a", "b")).alias("best"))
    best = materialise(best.select("best.a", "best.b").distinct(), "copies-first")
    tried = asked.select("a", "b")
    # the texts of classes that are in a pair or share a band are read again, one a class
    wanted = tried.select(F.explode(F.array("a", "b")).alias("class")).unionByName(members.select("class")).distinct()
    wanted = wanted.join(known.select("class", "text_key"), "class")
    texts = _keyed(docs, id_col, text_col).select("text_key", "text").join(wanted, "text_key").dropDuplicates(["class"])
    sets = materialise(shingle_sets(texts, width), "copies-sets")

    def linked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        return materialise(verified(_between(pairs, roots, least), sets, least), "copies-linked")

    roots = known.select("class", F.col("class").alias("root"), "size", "sketch")
    roots = _merged(roots, linked(best, roots))
    roots = _merged(roots, linked(tried.join(best, ["a", "b"], "left_anti").distinct(), roots))
    mixed = materialise(_mixed(members, roots), "copies-mixed")
    for turn in range(TURNS):
        drawn = F.max(F.struct(F.xxhash64("class", F.lit(turn)).alias("draw"), "class", "root")).alias("head")
        met = mixed.join(mixed.groupBy("band").agg(drawn), "band").where("root <> head.root")
        met = met.select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b")).distinct()
        met = materialise(met.join(tried, ["a", "b"], "left_anti"), "copies-turn")
        tried, more = tried.unionByName(met), linked(met, roots)
        if more.isEmpty():
            break
        roots = _merged(roots, more)
        mixed = materialise(_mixed(members, roots), "copies-mixed")
    # what has been found so far is stored, so the steps below read it and do not find it again
    left = materialise(mixed.select("class").distinct().join(roots, "class"), "copies-left")
    starts = materialise(rare_starts(left, sets, least), "copies-starts")
    meet = (F.col("shingle_a") == F.col("shingle_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("class_a") < F.col("class_b"))
    # from a shared shingle on, at most what is left of the shorter rest is shared
    after = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = after >= (F.col("size_a") + F.col("size_b")) * (least / (1 + least)) - SLACK
    # the file repeats each sketch at little cost, a broadcast of it would not
    rest = _side(starts, "a").hint("merge").join(_side(starts, "b"), meet & enough & _alike(least))
    rest = rest.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "root_a", "root_b").distinct()
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"), "copies-rest")
    roots = _merged(roots, verified(rest, sets, least))

    rooted = known.select("class", "copies", "first_id").join(roots, "class")
    component = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(component, "root").select("class", "copies", "component_id"), "copies-named")
    return join_on_key(rows.select("doc_id", "class"), named, "class", "copies", "doc_id").select("doc_id", "component_id")
