"""Length quartiles, stratified draws, splits and case sets.

Draws order rows by md5 of a seed and the id, so they are the same in any
engine and on any number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = 4


def draw_key(seed: int, ident: Column | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident) if isinstance(ident, str) else ident))


def length_quartiles(docs: DataFrame, id_col: str = "document_id", size_col: str = "size") -> DataFrame:
    """Adds length_quartile: min(4, 4 rank / n + 1) in order of (size, id).

    The rank is made of counts per size and, in the sizes where a quartile ends,
    a rank within the size, so no window spans the whole table.
    """
    below = ranks_below(docs.where(F.col(size_col).isNotNull()).groupBy(size_col).agg(F.count("*").alias("n")), size_col, "n")
    quartile = lambda rank, n: F.least(F.lit(QUARTILES), F.floor(rank * QUARTILES / n).cast("int") + 1)
    edges = below.withColumn("total", F.lit(docs.where(F.col(size_col).isNotNull()).count()))
    edges = edges.withColumns({"low": quartile(F.col("below"), F.col("total")), "high": quartile(F.col("below") + F.col("n") - 1, F.col("total"))})
    # where each quartile begins, and the sizes in which one ends: seven rows at most
    begins = edges.groupBy("low").agg(F.min(size_col).alias("size")).collect()
    split = edges.where("low <> high").collect()
    size = F.col(size_col)
    by_size = F.greatest(F.lit(0), *[F.when(size >= r["size"], r["low"]) for r in begins]).cast("int")
    inside = size.isin([r[size_col] for r in split])
    whole = docs.where(size.isNotNull() & ~inside).withColumn("length_quartile", by_size)
    if not split:
        return whole
    rank = F.row_number().over(Window.partitionBy(size_col).orderBy(id_col)) - 1
    first = F.coalesce(*[F.when(size == r[size_col], r["below"]) for r in split])
    ranked = docs.where(inside).withColumn("length_quartile", quartile(first + rank, F.lit(split[0]["total"])))
    return whole.unionByName(ranked)


def ranks_below(counts: DataFrame, value: str, n: str, width: int = 4096) -> DataFrame:
    """Adds below: how many rows have a smaller ``value``, given counts ``n`` by value.

    Values are summed up in ranges of ``width`` first, so one window holds a
    row for each range and the others run side by side.
    """
    ranged = counts.withColumn("_range", F.floor(F.col(value) / width))
    ranges = ranged.groupBy("_range").agg(F.sum(n).alias("_n"))
    before = lambda w: F.coalesce(F.sum(w[1]).over(w[0].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", before((Window.orderBy("_range"), "_n")).alias("_before"))
    inside = before((Window.partitionBy("_range").orderBy(value), n))
    return ranged.withColumn("_in", inside).join(ranges, "_range").withColumn("below", F.col("_before") + F.col("_in")).drop("_range", "_before", "_in")


def allocation(sizes: DataFrame, n: int, stratum: str = "length_quartile") -> DataFrame:
    """(stratum, take): ``n`` by largest remainder over (stratum, count)."""
    total = sizes.agg(F.sum("count").alias("total"))
    shared = sizes.join(F.broadcast(total)).withColumn("quota", F.col("count") * F.lit(float(n)) / F.col("total"))
    shared = shared.withColumn("base", F.floor("quota"))
    order = Window.orderBy(F.desc(F.col("quota") - F.col("base")), stratum)
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    return shared.select(stratum, (F.col("base") + (F.row_number().over(order) <= left).cast("long")).alias("take"))


def stratified_sample(rows: DataFrame, n: int, seed: int, id_col: str = "document_id", stratum: str = "length_quartile") -> DataFrame:
    """``n`` rows, split over the strata in proportion, in md5 order within each."""
    takes = allocation(rows.groupBy(stratum).count(), n, stratum)
    order = Window.partitionBy(stratum).orderBy(draw_key(seed, id_col), id_col)
    # no stratum gives more than n: with a literal bound each task cuts its rows before they are sent
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return first.join(F.broadcast(takes), stratum).where("_n <= take").drop("_n", "take")


def build_split(docs: DataFrame, dev: int = 60, golden: int = 100, seed: int = 42) -> DataFrame:
    """(document_id, length_quartile, split): dev, golden from the rest, reserve."""
    rows = length_quartiles(docs).select("document_id", "length_quartile")
    first = stratified_sample(rows, dev, seed).select("document_id", F.lit("dev").alias("split"))
    rest = rows.join(F.broadcast(first), "document_id", "left_anti")
    second = stratified_sample(rest, golden, seed + 1).select("document_id", F.lit("golden").alias("split"))
    drawn = F.broadcast(first.unionByName(second))  # dev + golden rows
    return rows.join(drawn, "document_id", "left").fillna("reserve", ["split"]).select("document_id", "length_quartile", "split")


def even_shares(n: int, caps: list[int]) -> list[int]:
    """``n`` spread evenly under caps; what is left over goes in order."""
    take = [0] * len(caps)
    while n > 0 and any(t < c for t, c in zip(take, caps, strict=True)):
        open_ = [i for i, (t, c) in enumerate(zip(take, caps, strict=True)) if t < c]
        each = max(1, n // len(open_))
        for i in open_:
            more = min(each, caps[i] - take[i], n)
            take[i] += more
            n -= more
    return take


def build_cases(candidates: DataFrame, total: int = 150, seed: int = 42) -> DataFrame:
    """Cases spread evenly over clause types, then over quartiles within a type.

    candidates: case_id, clause_type, length_quartile.  The shares are worked
    out on the driver from the counts of types by quartiles, at most 48 rows.
    """
    counts = {(r["clause_type"], r["length_quartile"]): r["count"] for r in candidates.groupBy("clause_type", "length_quartile").count().collect()}
    types = sorted({c for c, _ in counts})
    by_type = even_shares(total, [sum(v for (c, _), v in counts.items() if c == t) for t in types])
    takes = []
    for t, n in zip(types, by_type, strict=True):
        caps = [counts.get((t, q), 0) for q in range(1, QUARTILES + 1)]
        takes += [(t, q, k) for q, k in enumerate(even_shares(n, caps), 1) if k]
    shares = candidates.sparkSession.createDataFrame(takes, "clause_type string, length_quartile int, take int")
    order = Window.partitionBy("clause_type", "length_quartile").orderBy(draw_key(seed, "case_id"), "case_id")
    most = max((k for _, _, k in takes), default=0)  # a literal bound, by which each task cuts its rows
    ranked = candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return ranked.join(F.broadcast(shares), ["clause_type", "length_quartile"]).where("_n <= take").drop("_n", "take")


def stratum_summary(cases: DataFrame) -> DataFrame:
    """Cases, positives and documents per (clause type, quartile)."""
    return cases.groupBy("clause_type", "length_quartile").agg(
        F.count("*").alias("cases"), F.count_if("present").alias("positives"), F.countDistinct("document_id").alias("documents"))


def cases_by_document(cases: DataFrame) -> DataFrame:
    """(document_id, case_ids): sorted and comma-joined."""
    return cases.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("case_ids"))
