"""Order MinHash fingerprints, in DataFrame functions only.

A text is a sequence of words (runs without ASCII white space).  Every run of
``k`` words is a k-mer, hashed together with its occurrence number, so that
repeats count.  In each of ``m`` orders the ``l`` minimal k-mers are selected,
put back into text order and hashed as a tuple: one value of the signature.
The share of equal values estimates how likely the same k-mers are chosen in
the same order, which falls with the edit distance of the texts.

The orders are those of fast similarity sketching.  In round r a k-mer's hash
of (k-mer, r) deals it to one of the m orders with a priority, and rounds come
one after the other, so an order ranks k-mers by (round, priority).  Rounds go
on until an order has ``points`` k-mers on average: a long text needs only a
part of its first round, by priority, a text of one k-mer many rounds.  What
an order holds beyond its l first plays no part, so texts of different length
are compared alike.  An order that got no k-mer at all (a chance of e**-points)
takes the tuple of the next one.

Everything is per row on arrays, so nothing is sorted across rows or spilled;
memory is in proportion to one document.

Defined results: null text counts as empty; a text of fewer than k words
(an empty one as well) has its whole word sequence as its only k-mer; a tuple
of a text with fewer than l k-mers holds those there are; equal texts have
equal fingerprints.  In ``fingerprint_edits`` rows are kept one for one, null
ids come first, rows that share an id are ordered by their texts, a table of
one row is its own next document, an empty table gives an empty one, and other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
# a key is, from the highest bit: order (m_bits), whether the round is not the first, priority, position (31 bits, more than any text has words)
_POS = (1 << 31) - 1
_ROUND_BITS = 10


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_POS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shift(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n) if n else x


def signature(df: DataFrame, text_col: str, out_col: str, k: int = 2, l: int = 2, m_bits: int = 6, points: int = 8) -> DataFrame:  # noqa: E741
    """Adds ``out_col``: array of 2**m_bits 32-bit values for ``text_col``.

    Each step is its own column that later steps read more than once, so the
    optimizer keeps the steps apart and no step runs again for each element.
    """
    m, keep = 1 << m_bits, [F.col(f"`{c}`") for c in df.columns]
    rank_bits = 32 - m_bits  # of the first round; later ones have _ROUND_BITS for the round
    late_bits = rank_bits - _ROUND_BITS
    order_mask, rank_mask, late_mask = _signed(((m - 1) << (64 - m_bits))), ((1 << rank_bits) - 1) << 31, ((1 << late_bits) - 1) << 31
    late_mark, absent = 1 << (31 + rank_bits), -1
    frame = df

    def step(name: str, value: Column) -> Column:
        nonlocal frame
        frame = frame.withColumn(f"__omh_{out_col}_{name}", value)
        return F.col(f"__omh_{out_col}_{name}")

    def key(h: Column, pos: Column) -> Column:
        """In the first round."""
        rank = F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(rank_mask))
        return h.bitwiseAND(F.lit(order_mask)).bitwiseOR(rank).bitwiseOR(pos)

    def late_key(x: Column, r: Column) -> Column:
        """Of the k-mer with first key ``x`` in round ``r``."""
        h = F.xxhash64(F.shiftrightunsigned(x, 31), r)
        rank = F.shiftrightunsigned(h, 1 + _ROUND_BITS).bitwiseAND(F.lit(late_mask)).bitwiseOR(F.shiftleft(r.cast("long"), 31 + late_bits))
        return h.bitwiseAND(F.lit(order_mask)).bitwiseOR(F.lit(late_mark)).bitwiseOR(rank).bitwiseOR(_pos(x))

    order_of = lambda x: F.shiftrightunsigned(x, 64 - m_bits)
    kmer = lambda x: F.shiftrightunsigned(x, 31)
    code = lambda x: F.shiftrightunsigned(x, 31).bitwiseAND(F.lit((1 << (rank_bits + 1)) - 1))

    w = step("words", F.split(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(_SPACE)), "[\\x20\\x09-\\x0D]+"))
    n = F.size(w)
    hashed = F.when(
        n >= k,
        F.transform(
            F.sequence(F.lit(0), n - k),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array(F.xxhash64(w).bitwiseAND(F.lit(~_POS))))
    s = step("sorted", F.sort_array(hashed))
    # first occurrences; the others are numbered apart, since most k-mers occur once
    firsts = step("firsts", F.transform(s, lambda x, i: F.when(
        (i > 0) & (kmer(x) == kmer(F.get(s, i - 1))), F.lit(absent)
    ).otherwise(key(F.xxhash64(kmer(x), F.lit(0)), _pos(x)))))
    again = step("again", F.filter(F.transform(firsts, lambda x, i: F.when(x == absent, i)), lambda i: i.isNotNull()))
    begins = step("begins", F.filter(F.sequence(F.lit(0), F.size(again)), lambda j: (j < F.size(again)) & (
        (j == 0) | (F.get(again, j - 1) != F.get(again, j) - 1))))
    others = F.flatten(F.transform(begins, lambda b, i: F.transform(
        F.slice(again, b + 1, F.coalesce(F.get(begins, i + 1), F.size(again)) - b),
        lambda at, occurrence: key(F.xxhash64(kmer(F.get(s, at)), occurrence + 1), _pos(F.get(s, at))),
    )))
    keys = step("keys", F.concat(firsts, others))
    total = F.size(s)
    wanted = points * m  # k-mers dealt in all
    rounds = F.least(F.ceil(F.lit(wanted) / total), F.lit((1 << _ROUND_BITS) - 1)).cast("int")
    bound = F.floor(F.least(F.lit(1.0), F.lit(float(wanted)) / total) * F.lit(float(1 << rank_bits))).cast("long")
    first_round = F.filter(keys, lambda x: (x != absent) & (F.shiftrightunsigned(x, 31).bitwiseAND(F.lit((1 << rank_bits) - 1)) < bound))
    late = F.when(rounds > 1, F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(rounds - 1, F.lit(1))),
        lambda r: F.transform(F.filter(keys, lambda x: x != absent), lambda x: late_key(x, r)),
    ))).otherwise(F.array().cast("array<bigint>"))
    dealt = step("dealt", F.sort_array(F.concat(first_round, late)))
    starts = step("starts", F.filter(F.sequence(F.lit(0), F.size(dealt)), lambda i: (i < F.size(dealt)) & (
        (i == 0) | (order_of(F.get(dealt, i)) != order_of(F.get(dealt, i - 1))))))
    rest = step("rest", F.transform(starts, lambda i, j: F.slice(dealt, i + 1, F.coalesce(F.get(starts, j + 1), F.size(dealt)) - i)))
    orders = step("orders", F.transform(rest, lambda r: order_of(r[0]).cast("int")))
    minimal = []  # (position, code) of the first, second, ... k-mer of each order
    for i in range(l):
        minimal.append(step(f"minimal{i}", F.transform(rest, lambda r: F.shiftleft(_pos(F.get(r, F.lit(0))), rank_bits + 1).bitwiseOR(code(F.get(r, F.lit(0)))))))
        if i < l - 1:
            rest = step(f"rest{i}", F.transform(rest, lambda r: F.filter(r, lambda x: _pos(x) != _pos(r[0]))))
    # zipped, not fetched by index: what a lambda names once would be computed again for each element
    chosen = F.transform(minimal[0], lambda x: F.array(x))
    for more in minimal[1:]:
        chosen = F.zip_with(chosen, more, lambda x, y: F.concat(x, F.array(y)))
    tuples = step("tuples", F.transform(chosen, lambda x: F.shiftright(F.xxhash64(F.transform(
        F.sort_array(x), lambda y: y.bitwiseAND(F.lit((1 << (rank_bits + 1)) - 1))
    )), 32).cast("int")))
    # orders are sorted by their sign bit first; an order without k-mers takes the next one's tuple, the last ones that of the first
    at = lambda o: F.pmod(o + m // 2, F.lit(m)).cast("int")
    body = step("body", F.flatten(F.transform(tuples, lambda t, i: F.array_repeat(t, F.when(i == 0, at(F.get(orders, i)) + 1).otherwise(
        at(F.get(orders, i)) - at(F.get(orders, i - 1)))))))
    tail = F.array_repeat(F.get(body, F.lit(0)), F.lit(m) - F.size(body))
    return frame.select(*keep, F.concat(body, tail).alias(out_col))


def as_text(sig: Column) -> Column:
    """The signature as lowercase hexadecimal, 8 digits a value."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same.cast("double") / F.size(a)


def with_next(docs: DataFrame, id_col: str, text_col: str, carry: list[str], buckets: int) -> DataFrame:
    """Adds next_<c> for each column in ``carry``: that of the next row.

    Rows are in ascending order of id (null first, ties by text) and the last
    is followed by the first.  The ids are cut into ranges at values that occur
    in the table, so the first row of a range is known by its id alone; it is
    also dealt to the range before as that range's end.  One shuffle.
    """
    share = [i / buckets for i in range(1, buckets)]
    cut = docs.agg(F.min(id_col).alias("lo"), F.percentile_approx(id_col, share, 10_000).alias("q") if share else F.array().alias("q")).first()
    bounds = sorted({cut["lo"], *(cut["q"] or [])} - {None}) or [0]
    ident, last = F.col(id_col), len(bounds) - 1
    # a range is found in two steps, among every wide-th bound and then among the next wide ones
    wide = int(len(bounds) ** 0.5) + 1
    edges, coarse = (F.array(*[F.lit(x).cast("long") for x in part]) for part in (bounds, bounds[::wide]))
    group = F.size(F.filter(coarse, lambda x: x <= ident)) - 1
    within = F.size(F.filter(F.slice(edges, group * wide + 1, F.lit(wide)), lambda x: x <= ident)) - 1
    bucket = F.when(ident.isNull(), 0).otherwise(group * wide + within)
    ranged = docs.withColumn("__omh_bucket", bucket)
    bucket = F.col("__omh_bucket")
    starts = ident.isNull() | (F.get(edges, bucket) == ident)
    previous = F.when(ident.isNull() | (bucket == 0), last).otherwise(bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("end"))
    as_end = F.struct(previous.alias("bucket"), F.lit(1).alias("end"))
    dealt = ranged.select(*docs.columns, F.explode(F.when(starts, F.array(own, as_end)).otherwise(F.array(own))).alias("__omh_at"))
    order = Window.partitionBy("__omh_at.bucket").orderBy("__omh_at.end", F.col(id_col).asc_nulls_first(), text_col)
    ahead = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return ahead.where("__omh_at.end = 0").drop("__omh_at")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, l: int = 2, m_bits: int = 6) -> DataFrame:  # noqa: E741
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited form has the last quarter of the code points replaced by the
    first as many of the next document.
    """
    spark = docs.sparkSession
    buckets = min(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = signature(rows, "text", "sig", k, l, m_bits)
    rows = with_next(rows, "doc_id", "text", ["text", "sig"], buckets)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = signature(rows, "edited", "edited_sig", k, l, m_bits)
    return rows.select("doc_id", "n_chars", "edited_sha256", "sig", "edited_sig", "next_sig")
