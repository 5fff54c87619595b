"""Unions of half-open intervals in arrays of struct<s, e>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KIND = "array<struct<s:int,e:int>>"


def merge(spans: Column) -> Column:
    """The union in order: empty spans go, touching ones join."""
    full = F.array_sort(F.filter(spans.cast(_KIND), lambda x: x["e"] > x["s"]))

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when(
            (F.size(done) > 0) & (x["s"] <= last["e"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(full, F.array().cast(_KIND), add)


def covered(merged: Column) -> Column:
    """Length of a merged union."""
    return F.aggregate(merged, F.lit(0), lambda n, x: n + (x["e"] - x["s"]))


def intersection(a: Column, b: Column) -> Column:
    """Length that two merged unions share."""
    common = lambda x, y: F.greatest(F.lit(0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]))
    return F.aggregate(a, F.lit(0), lambda n, x: n + F.aggregate(b, F.lit(0), lambda k, y: k + common(x, y)))


def span_f1(predicted: Column, gold: Column) -> Column:
    """F1 of covered positions: 1 if both are empty, 0 if one is."""
    p, g = merge(predicted), merge(gold)
    np_, ng, shared = covered(p).cast("double"), covered(g).cast("double"), intersection(p, g).cast("double")
    precision, recall = shared / np_, shared / ng
    return (
        F.when((np_ == 0) & (ng == 0), 1.0)
        .when((np_ == 0) | (ng == 0) | (shared == 0), 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )


def overlap(a: Column, b: Column) -> Column:
    """Whether any span of ``a`` shares a position with one of ``b``."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])) > 0))


def merge_rows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e): the same union over rows, by gaps and islands."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("e > s").withColumn("starts", F.coalesce((F.col("s") > before).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")
